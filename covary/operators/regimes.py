"""Regime classifiers in pyspark.ml over the feature table: fit on the train rows only, then frozen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.functions import exprs as x

VOL, DOWN, RET = (5, 10, 20, 40, 60), (10, 20, 40, 60), (5, 10, 20)
GROUPS = {
    "volatility": [f"vol_{n}" for n in VOL],
    "volatility trend": ["vol_trend", "vol_accel"],
    "drawdown": [f"dd_{n}" for n in DOWN],
    "return": [f"ret_{n}" for n in RET],
    "trend": ["trend", "trend_strength"],
    "range": ["range_expansion"],
    "correlation": ["pair_corr", "corr_change"],
    "pair volatility": ["pair_vol", "pair_vol_spike"],
}
FEATURES = [f for g in GROUPS.values() for f in g]


def features(df: DataFrame) -> DataFrame:
    """df (pair, t, y, x, m) with the 21 features, filled forward and then with 0; one window by pair serves them all."""
    w = x.pair_window()
    roll = lambda f, c, n, least=None: x.rolling(f, c, w, n, least)
    d = df.withColumn("rm_", x.pct_change("m", w)).withColumn("ratio_", F.col("y") / F.col("x"))
    d = d.withColumns({f"vol_{n}": x.annualise(roll(F.stddev_samp, "rm_", n)) for n in VOL} | {f"dd_{n}": F.col("m") / roll(F.max, "m", n, 1) - 1 for n in DOWN} | {f"ret_{n}": x.pct_change("m", w, n) for n in RET})
    d = d.withColumns({"s20_": roll(F.avg, "m", 20), "s50_": roll(F.avg, "m", 50), "rr_": x.pct_change("ratio_", w), "pair_corr": roll(F.corr, ["y", "x"], 30)})
    d = d.withColumns({
        "vol_trend": F.col("vol_5") - F.col("vol_60"), "vol_accel": x.safe_ratio("vol_5", "vol_20"), "trend": F.col("m") / F.col("s20_") - 1, "trend_strength": F.col("s20_") / F.col("s50_") - 1,
        "range_expansion": (roll(F.max, "m", 20) - roll(F.min, "m", 20)) / roll(F.avg, "m", 60), "corr_change": x.diff("pair_corr", w, 10), "pair_vol": x.annualise(roll(F.stddev_samp, "rr_", 20)),
    })
    d = d.withColumn("pair_vol_spike", F.try_divide("pair_vol", roll(F.avg, "pair_vol", 60)))
    return d.withColumns({c: x.ffill(c, w, 0.0) for c in FEATURES}).drop("rm_", "ratio_", "s20_", "s50_", "rr_")


def labels(df: DataFrame) -> Column:
    return x.regime_rule("vol_20", "dd_60", "vol_accel", "pair_vol_spike", "pair_corr")


@dataclass
class Forest:
    trees: int = 300
    depth: int = 6
    leaf: int = 20
    seed: int = 42

    def fit(self, train: DataFrame, columns: list[str] | None = None) -> PipelineModel:
        """Standardised features, a forest of balanced classes (each class weighs as much as any other)."""
        weighed = _balanced(train)
        stages = [VectorAssembler(inputCols=columns or FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.leaf, seed=self.seed)]
        return Pipeline(stages=stages).fit(weighed)


def _balanced(train: DataFrame) -> DataFrame:
    """With weights by the counts of the classes, which are three at most."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_"))
    total = train.agg(F.count(F.lit(1)).alias("all_"), F.countDistinct("label").alias("kinds_"))
    return train.join(F.broadcast(counts), "label").join(F.broadcast(total)).withColumn("weight", F.col("all_") / (F.col("kinds_") * F.col("n_"))).drop("n_", "all_", "kinds_")


def predict(model: PipelineModel, df: DataFrame, gate: float = 0.6) -> DataFrame:
    """df with predicted (class) and gated: crisis where the probability of normal (2) is below the gate."""
    p = vector_to_array("probability")
    out = model.transform(df).withColumn("predicted", F.col("prediction").cast("int"))
    normal = F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))
    return out.withColumn("p_normal", normal).withColumn("gated", F.when(normal < gate, 0).otherwise(F.col("predicted"))).drop("raw", "features", "rawPrediction", "probability", "prediction")


def scores(df: DataFrame, by: list[str], truth: str = "label", said: str = "predicted") -> DataFrame:
    """(by.., accuracy, macro_f1, weighted_f1, kappa) from the confusion of truth and prediction."""
    n = df.groupBy(*by, F.col(truth).alias("a"), F.col(said).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = n.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.when(c, F.col("n")).otherwise(0).alias(v) for v, c in (("hit", (F.col("a") == k) & (F.col("b") == k)), ("row", F.col("a") == k), ("col", F.col("b") == k))]) for k in (0, 1, 2)])).alias("v"))
    of = sides.groupBy(*by, F.col("v.k").alias("k")).agg(*[F.sum(f"v.{c}").alias(c) for c in ("hit", "row", "col")])
    of = of.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("row") + F.col("col")), F.lit(0.0)))
    g = of.groupBy(*by).agg(F.sum("row").alias("n"), F.sum("hit").alias("h"), F.sum(F.col("row") * F.col("col")).alias("e"), (F.sum(F.when(F.col("row") > 0, F.col("f1"))) / F.count_if(F.col("row") > 0)).alias("macro_f1"), F.sum(F.col("f1") * F.col("row")).alias("wf"))
    po, pe = F.col("h") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return g.select(*by, "n", po.alias("accuracy"), "macro_f1", (F.col("wf") / F.col("n")).alias("weighted_f1"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"))


def permutation_importance(model: PipelineModel, test: DataFrame, columns: list[str] | None = None, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance): mean loss of accuracy when a column's values change places among rows, over `repeats` shuffles.

    Shuffles of all columns are rows of one job: places by hash order within a pair meet values by number, so that no group is larger than a pair.
    """
    columns = columns or FEATURES
    base = predict(model, test).agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    ids = test.select("pair", "t", "label", *columns)
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    draws = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    long = ids.select("pair", "t", F.explode(named).alias("v")).select("pair", "t", "v.*").withColumn("repeat", draws)
    group = ["pair", "feature", "repeat"]
    here = long.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("t"))).select(*group, "t", "k")
    there = long.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), "feature", "repeat", "t"), "t"))).select(*group, "k", "value")
    moved = here.join(there, [*group, "k"]).join(ids, ["pair", "t"])
    moved = moved.withColumns({c: F.when(F.col("feature") == c, F.col("value")).otherwise(F.col(c)) for c in columns})
    hit = predict(model, moved).groupBy("feature").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a"))
    return hit.select("feature", (F.lit(base) - F.col("a")).alias("importance"))


def shapley(df: DataFrame, columns: list[str], value, rows: int = 500, draws: int = 10, seed: int = 42, keys: tuple[str, ...] = ("pair", "t")) -> DataFrame:
    """(keys.., feature, shapley): what each feature adds to a row's value, over random orders in which features join.

    value(df) gives df with a column `value` from the columns. `rows` rows of the least hashes are explained, each `draws` times: the
    features of a row replace those of another row (that of the next hash) in a random order, and every step's change of value
    belongs to the feature that came in. All coalitions of all rows are scored as one table.
    """
    d = len(columns)
    drawn = F.xxhash64(F.lit(seed), *keys)
    some = df.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("own")).withColumn("_h", drawn)
    some = some.orderBy("_h", *keys).limit(rows)
    by_hash = Window.orderBy("_h", *keys)  # `rows` rows
    some = some.withColumn("_i", F.row_number().over(by_hash)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    each = some.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    # every draw meets another row: as many places on as the draw says, around the end
    other = some.select(F.col("_i").alias("_j"), F.col("own").alias("other"))
    each = each.withColumn("_j", (F.col("_i") - 1 + F.pmod(F.xxhash64(F.lit(seed), "_i", "_draw"), F.greatest(F.col("_n") - 1, F.lit(1))) + 1) % F.col("_n") + 1).join(other, "_j")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda c: F.struct(F.xxhash64(F.lit(seed), "_i", "_draw", c).alias("h"), c.alias("c"))))
    each = each.withColumn("_order", F.transform(order, lambda v: v["c"])).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = [F.when(F.array_position(F.slice("_order", 1, F.col("_step")), F.lit(i)) > 0, F.get("own", F.lit(i))).otherwise(F.get("other", F.lit(i))).alias(c) for i, c in enumerate(columns)]
    scored = value(each.select(*keys, "_draw", "_order", "_step", *mixed)).select(*keys, "_draw", "_order", "_step", "value")
    change = F.col("value") - F.lag("value").over(Window.partitionBy(*keys, "_draw").orderBy("_step"))
    steps = scored.withColumn("_change", change).filter("_step > 0").withColumn("_c", F.get("_order", F.col("_step") - 1))
    named = F.element_at(F.array(*map(F.lit, columns)), (F.col("_c") + 1).cast("int"))
    return steps.groupBy(*keys, named.alias("feature")).agg(F.avg("_change").alias("shapley"))
