"""Path-dependent steps on small series made for their branches, without Spark where none is needed."""

from collections import deque

import pytest

from covary.operators.folds import Rules, gate_step, kalman_step, signal_step


def walk(step, state, rows):
    out = []
    for row in rows:
        state, made = step(state, *row)
        out.append(made[0])
    return out


def test_signal_enters_short_and_leaves_after_the_minimum_hold():
    z = [None, 0.0, 1.6, 0.1, 0.1, 0.1, 0.0]
    assert walk(signal_step(Rules()), (0, 0, 0), [(v, 2) for v in z]) == [0, 0, -1, -1, -1, 0, 0]


def test_signal_stops_before_the_minimum_hold_and_carries_over_nulls():
    assert walk(signal_step(Rules()), (0, 0, 0), [(1.6, 2), (None, 2), (3.1, 2)]) == [-1, -1, 0]


def test_crisis_opens_nothing_and_takes_no_profit():
    assert walk(signal_step(Rules()), (0, 0, 0), [(2.5, 0), (-1.6, 2), (-1.0, 2), (-1.0, 2), (-1.0, 2), (0.0, 0), (-3.1, 0)]) == [0, 1, 1, 1, 1, 1, 0]


def test_longest_hold():
    rules = Rules(max_hold=3)
    assert walk(signal_step(rules), (0, 0, 0), [(1.6, 2)] + [(1.0, 2)] * 4) == [-1, -1, -1, -1, 0]


def test_volatile_levels():
    assert walk(signal_step(Rules()), (0, 0, 0), [(1.6, 1), (2.1, 1)]) == [0, -1]


def test_gate_keeps_a_position_for_the_grace_period_and_ignores_signals_within():
    rows = [(1, True), (0, False), (0, False), (0, False), (1, False), (1, True)]
    assert walk(gate_step(2), (0, 0), rows) == [1, 1, 1, 0, 0, 1]


def test_kalman_damps_an_outlier():
    rows = [(2.0 * x + 0.001 * ((-1) ** i), float(x), 2) for i, x in enumerate(range(1, 21))]
    state = (None, 0.0, deque(maxlen=50))
    step = kalman_step()
    for row in rows:
        state, _ = step(state, *row)
    before = state[0]
    damped, _ = step((state[0], state[1], deque(state[2], maxlen=50)), 500.0, 21.0, 2)
    plain, _ = kalman_step(damp=False)((state[0], state[1], deque(state[2], maxlen=50)), 500.0, 21.0, 2)
    assert abs(damped[0] - before) == pytest.approx(abs(plain[0] - before) * 0.05)


def test_kalman_first_row_without_price():
    (w, _, seen), out = kalman_step()((None, 0.0, deque(maxlen=50)), 1.0, 0.0, 2)
    assert w == 0.0 and not seen and out[0] == 0.0
