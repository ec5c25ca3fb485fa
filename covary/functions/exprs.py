"""Column expressions: every one is a plain function that returns a Column over built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair_window(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("pair",))).orderBy("t")


def pct_change(x, w: WindowSpec, k: int = 1) -> Column:
    return F.try_divide(c(x), F.lag(c(x), k).over(w)) - 1


def diff(x, w: WindowSpec, k: int = 1) -> Column:
    return c(x) - F.lag(c(x), k).over(w)


def rolling(agg, x, w: WindowSpec, n: int, least: int | None = None, before: bool = False) -> Column:
    """agg over the last n rows (before: the n rows before this one), null until `least` values (n) are there."""
    frame = w.rowsBetween(-n, -1) if before else w.rowsBetween(-(n - 1), 0)
    xs = [c(v) for v in (x if isinstance(x, (list, tuple)) else [x])]
    n_seen = F.count(F.when(_all_there(xs), 1)).over(frame)
    return F.when(n_seen >= (n if least is None else least), agg(*xs).over(frame))


def _all_there(xs: list[Column]) -> Column:
    out = xs[0].isNotNull()
    for x in xs[1:]:
        out = out & x.isNotNull()
    return out


def expanding(agg, x, w: WindowSpec, least: int = 1) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(c(x)).over(frame) >= least, agg(c(x)).over(frame))


def zscore(x, w: WindowSpec, n: int = 40, keys: tuple[str, ...] = ("pair",)) -> Column:
    """Rolling z-score; a series shorter than n is scored over all rows so far (10 at least)."""
    short = F.count(F.lit(1)).over(Window.partitionBy(*keys)) < n
    roll = (c(x) - rolling(F.avg, x, w, n)) / (rolling(F.stddev_samp, x, w, n) + 1e-8)
    grow = (c(x) - expanding(F.avg, x, w, 10)) / (expanding(F.stddev_samp, x, w, 10) + 1e-8)
    return F.when(short, grow).otherwise(roll)


def ffill(x, w: WindowSpec, default=None) -> Column:
    got = F.last(c(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return got if default is None else F.coalesce(got, F.lit(default))


def clip(x, low, high) -> Column:
    return F.when(c(x).isNotNull(), F.least(F.greatest(c(x), F.lit(low)), F.lit(high)))


def annualise(std) -> Column:
    return c(std) * math.sqrt(252)


def annual_return(total, n) -> Column:
    """Geometric: (1 + total) ^ (252 / n) - 1."""
    return F.pow(1 + c(total), 252.0 / c(n)) - 1


def safe_ratio(a, b, eps: float = 1e-8) -> Column:
    return c(a) / (c(b) + eps)


def size_by_health(score, low=0.4, mid=0.6, high=0.8, size_low=0.5, size_mid=0.75) -> Column:
    """Four half-open bands of health: none, two partial sizes, full."""
    s = c(score)
    return F.when(s < low, 0.0).when(s < mid, size_low).when(s < high, size_mid).otherwise(1.0)


def position_size(z, vol) -> Column:
    """Larger with the z-score beyond 2, smaller with volatility above 15 %, within 0.5 and 1.5."""
    strong = clip((F.abs(c(z)) - 2) / 2, 0.0, 0.5) + 1
    calm = clip(1 - (c(vol) - 0.15) / 0.15, 0.5, 1.0)
    return clip(strong * calm, 0.5, 1.5)


REGIMES = {0: "crisis", 1: "volatile", 2: "normal"}


def regime_name(code) -> Column:
    names = F.create_map(*[F.lit(v) for kv in REGIMES.items() for v in kv])
    return F.element_at(names, c(code).cast("int"))


def mark_period(date, train_end: str) -> Column:
    return F.when(c(date) <= F.lit(train_end).cast("date"), "train").otherwise("oos")


def mark_three(date, train_end: str, val_end: str) -> Column:
    d = c(date)
    return F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(val_end).cast("date"), "val").otherwise("test")


def confidence(z, entry: float = 1.5) -> Column:
    return F.least(F.lit(1.0), F.abs(c(z)) / max(entry, 1e-6))


def finite(x, value: float = 0.0) -> Column:
    """The value for what is null, NaN or infinite."""
    bad = c(x).isNull() | F.isnan(c(x)) | (F.abs(c(x)) == float("inf"))
    return F.when(bad, F.lit(value)).otherwise(c(x))


def cohens_band(d) -> Column:
    a = F.abs(c(d))
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def compound(x) -> Column:
    return F.product(1 + c(x)) - 1


def regime_rule(vol, drawdown, acceleration=None, spike=None, corr=None) -> Column:
    """0 crisis, 1 volatile, 2 normal by thresholds, crisis first; a missing value meets none."""
    no = F.lit(False)
    crisis = F.coalesce(c(vol) > 0.35, no) | F.coalesce(c(drawdown) < -0.20, no)
    shaky = F.coalesce(c(vol) > 0.22, no) | F.coalesce(c(drawdown) < -0.10, no)
    if acceleration is not None:
        crisis, shaky = crisis | F.coalesce(c(acceleration) > 2.5, no), shaky | F.coalesce(c(acceleration) > 1.8, no)
    if spike is not None:
        shaky = shaky | F.coalesce(c(spike) > 1.5, no)
    if corr is not None:
        crisis = crisis | F.coalesce(c(corr) < -0.1, no)
    return F.when(crisis, 0).when(shaky, 1).otherwise(2)


# Dickey-Fuller response surfaces (fixed values): level below which the small polynomial holds, the two polynomials, limits of p
_SURFACES = {
    1: (-1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), 2.74, -18.83),
    2: (-2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377), 0.92, -18.86),
}


def norm_cdf(x) -> Column:
    """Standard normal distribution by a rational approximation (error below 1e-7)."""
    a = F.abs(c(x))
    k = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return F.when(c(x) >= 0, 1 - tail).otherwise(tail)


def unit_root_p(tau, series: int = 1) -> Column:
    """p of a Dickey-Fuller statistic with constant (series 1) or of residuals of a regression of two series (2)."""
    star, small, large, top, bottom = _SURFACES[series]
    t = c(tau)
    poly = lambda k: sum((F.lit(v) * F.pow(t, F.lit(float(i))) for i, v in enumerate(k[1:], 1)), F.lit(k[0]))
    return F.when(t > top, 1.0).when(t < bottom, 0.0).otherwise(norm_cdf(F.when(t <= star, poly(small)).otherwise(poly(large))))


def chi2_sf(x, df: int) -> Column:
    """Exact upper tail for an even number of degrees of freedom."""
    h = c(x) / 2
    return F.exp(-h) * sum((F.pow(h, F.lit(float(i))) / math.factorial(i) for i in range(1, df // 2)), F.lit(1.0))


def hash_draw(*parts) -> Column:
    """A reproducible draw from 0 .. 2^32-1: the head of md5 of the parts."""
    text = F.concat_ws(":", *[c(p).cast("string") if not isinstance(p, int) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
