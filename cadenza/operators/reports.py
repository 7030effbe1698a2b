"""Evaluation reports: everything is an aggregation; nothing but the few report rows leaves the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.constants import CLASSES

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
NAN = float("nan")


def classes(spark: SparkSession, name: str = "class") -> DataFrame:
    """The class dimension: three rows, so classes without rows stay in a report."""
    return spark.createDataFrame([(i, c) for i, c in enumerate(CLASSES)], f"class_index int, {name} string")


def rate(n: Column, of: Column) -> Column:
    return n / F.greatest(F.lit(1), of)


def _moments(x: Column, y: Column) -> list[Column]:
    # a constant side is known by its least and greatest value: its variance, merged from many tasks, can be off 0 by a last bit
    flat = lambda c: (F.stddev_pop(c) == 0) | (F.min(c) == F.max(c))
    return [F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * y).alias("mxy"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), (flat(x) | flat(y)).alias("flat")]


def _correlation() -> Column:
    r = F.try_divide(F.col("mxy") - F.col("mx") * F.col("my"), F.col("sx") * F.col("sy"))
    return F.when((F.col("n") < 2) | F.col("flat"), F.lit(NAN)).otherwise(r)


def pearson(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """AG-13: one row ``r``; NaN for fewer than two rows or a side without variance (checked before dividing)."""
    return df.agg(F.count(F.lit(1)).alias("n"), *_moments(x, y)).select(_correlation().alias("r"))


def errors(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """AG-12: one row of mean absolute and root mean squared errors."""
    out = []
    for name, (p, t) in pairs.items():
        out += [F.avg(F.abs(p - t)).alias(f"{name}_mae"), F.sqrt(F.avg((p - t) * (p - t))).alias(f"{name}_rmse")]
    return df.agg(*out)


def class_rates(df: DataFrame, column: str) -> DataFrame:
    """AG-10: count and rate of each class, classes without rows included."""
    n = df.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # three rows
    d = classes(df.sparkSession).join(n, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("class", "n", rate(F.col("n"), total).alias("rate"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """AG-11: nine rows of counts and of rates within the true class."""
    spark = df.sparkSession
    cells = classes(spark, "true_class").drop("class_index").crossJoin(classes(spark, "predicted_class").drop("class_index"))  # 3 x 3 fixed rows
    n = df.groupBy(F.col(true).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(F.count(F.lit(1)).alias("n"))
    d = cells.join(n, ["true_class", "predicted_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.withColumn("rate", rate(F.col("n"), F.sum("n").over(Window.partitionBy("true_class"))))


def percentiles(df: DataFrame, by: str, value: Column, approximate: bool = False, bins: int = 1000) -> DataFrame:
    """AG-14: linear percentiles for each class, exact at any size.

    Values are counted, equal ones together; counts of ``bins`` bins between the least and the largest value place every
    bin's values in the class's order, and running sums within a bin place each value, so no class meets in one task.
    With ``approximate`` a sketch of each class gives them in one aggregation.
    """
    if approximate:
        p = F.percentile_approx(value, F.array(*[F.lit(p / 100) for p in PERCENTILES]))
        d = df.groupBy(F.col(by).alias("class")).agg(p.alias("p"))
        return d.select("class", *[F.get("p", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTILES)])
    v = df.select(F.col(by).alias("class"), value.cast("double").alias("v"))
    ends = v.agg(F.min("v"), F.max("v")).first()
    low, width = ends[0] or 0.0, ((ends[1] or 0.0) - (ends[0] or 0.0)) / bins or 1.0
    v = v.groupBy("class", F.floor((F.col("v") - low) / width).alias("b"), "v").agg(F.count("v").alias("n"))
    bins = v.groupBy("class", "b").agg(F.sum("n").alias("m"))  # as many rows as bins
    bins = bins.select(
        "class", "b", (F.sum("m").over(Window.partitionBy("class").orderBy("b")) - F.col("m")).alias("before"),
        (F.sum("m").over(Window.partitionBy("class")) - 1).alias("last"),
    )
    upto = F.sum("n").over(Window.partitionBy("class", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = v.withColumn("upto", upto).join(bins, (v["class"].eqNullSafe(bins["class"])) & (v["b"].eqNullSafe(bins["b"]))).drop(bins["class"]).drop(bins["b"])
    end = F.col("before") + F.col("upto")
    at = lambda rank: F.max(F.when((rank < end) & (rank >= end - F.col("n")), F.col("v")))
    place = {p: F.col("last") * (p / 100) for p in PERCENTILES}
    ends = [x.alias(f"{side}{p}") for p, h in place.items() for side, x in (("lo", at(F.floor(h))), ("hi", at(F.ceil(h))))]
    d = placed.groupBy("class").agg(*ends, F.first("last").alias("last"))
    return d.select("class", *[(F.col(f"lo{p}") + (F.col(f"hi{p}") - F.col(f"lo{p}")) * (h - F.floor(h))).alias(f"p{p}") for p, h in place.items()])


def histogram(df: DataFrame, by: str, value: Column, bucket: int = 10, upper: int = 100) -> DataFrame:
    """AG-15: counts of fixed-width bins from 0 to ``upper``, values clipped into it, empty bins included."""
    bin_ = (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(upper - 1e-6), value)) / bucket) * bucket).cast("int")
    n = df.groupBy(F.col(by).alias("class"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("class").distinct().select("class", F.explode(F.sequence(F.lit(0), F.lit(upper - bucket), F.lit(bucket))).alias("bin"))
    d = grid.join(n, ["class", "bin"], "left")
    return d.select("class", F.format_string("%02d-%02d", "bin", F.col("bin") + bucket - 1).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def presence_stats(df: DataFrame, prob: Column, present: Column) -> DataFrame:
    """AG-16: accuracy at one half, mean probability by truth and counts."""
    yes = present == 1
    return df.agg(
        F.avg(F.when((prob >= 0.5) == yes, 1.0).otherwise(0.0)).alias("accuracy"), F.coalesce(F.avg(F.when(yes, prob)), F.lit(NAN)).alias("mean_present"),
        F.coalesce(F.avg(F.when(~yes, prob)), F.lit(NAN)).alias("mean_omitted"), F.count_if(yes).alias("present"), F.count_if(~yes).alias("omitted"),
    )


def class_stats(df: DataFrame, true: str, predicted: str, score: Column, target: Column, prob: Column, high: float = 80.0) -> DataFrame:
    """AG-17: a row for each class; means of a class without rows are NaN, its count 0."""
    g = df.groupBy(F.col(true).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(target).alias("mean_target"), F.avg(prob).alias("mean_prob"),
        F.count_if(F.col(predicted) == CLASSES[2]).alias("called_correct"), F.count_if(score >= high).alias("high"),
    )
    d = classes(df.sparkSession).join(g, "class", "left")
    nan = lambda c: F.coalesce(c, F.lit(NAN)).alias(c)
    n = F.coalesce("n", F.lit(0))
    return d.select("class", n.alias("n"), nan("mean_score"), nan("mean_target"), nan("mean_prob"), rate(F.coalesce("called_correct", F.lit(0)), n).alias("called_correct_rate"), rate(F.coalesce("high", F.lit(0)), n).alias("high_score_rate"))


#: The order and wording of the messages that the diagnostics give (our own).
MESSAGES = {
    "all_correct": "every phone is predicted correct",
    "collapsed": "true classes have nearly the same mean score",
    "weak": "scores hardly correlate with targets",
    "uninformative": "no omitted phones, so presence says nothing",
}


def diagnostics(df: DataFrame, true: str, predicted: str, score: Column, target: Column, present: Column) -> DataFrame:
    """AG-19: one row with the three separations of class means, four flags and their messages."""
    wrong, middle, right = CLASSES
    m = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(predicted) == right).alias("called"), F.avg(F.when(F.col(true) == right, score)).alias("mc"), F.avg(F.when(F.col(true) == wrong, score)).alias("mw"), F.avg(F.when(F.col(true) == middle, score)).alias("ma"),
        F.count_if(present != 1).alias("omitted"), *_moments(score, target),
    )
    r = _correlation()
    sep = F.coalesce(F.col("mc") - F.col("mw"), F.lit(NAN))
    below = lambda c, v: ~F.isnan(c) & (c < v)  # noqa: E731  NaN is not below anything
    upper, lower = F.coalesce(F.col("mc") - F.col("ma"), F.lit(NAN)), F.coalesce(F.col("ma") - F.col("mw"), F.lit(NAN))
    m = m.select(sep.alias("separation"), upper.alias("separation_correct_accented"), lower.alias("separation_accented_wrong"), (F.col("called") == F.col("n")).alias("all_correct"), below(r, 0.3).alias("weak"), below(sep, 5.0).alias("collapsed"), (F.col("omitted") == 0).alias("uninformative"))
    told = F.filter(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in MESSAGES.items()]), lambda x: x.isNotNull())
    return m.withColumn("messages", F.when(F.size(told) > 0, F.array_join(told, "; ")).otherwise("no collapse found"))


def told(diagnosis: DataFrame) -> dict[str, DataFrame]:
    """The numbers of the diagnostics and their messages, a row each, as two report parts."""
    message = F.explode(F.split("messages", "; ")).alias("message")
    return {"diagnostics": diagnosis.drop("messages"), "interpretation": diagnosis.select(message, F.lit(1).alias("told"))}


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """AG-20: inverse frequencies with counts of at least one, scaled to mean 1."""
    n = df.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    d = classes(df.sparkSession).join(n, "class", "left").select("class", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).alias("n"))
    w = Window.partitionBy(F.lit(0))  # three rows
    d = d.withColumn("w", F.sum("n").over(w) / (3 * F.col("n")))
    return d.select("class", "n", (F.col("w") / F.avg("w").over(w)).alias("weight"))


def long_report(parts: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Report parts as (section, key, metric, value) rows, so that one table holds a whole report."""
    out: DataFrame | None = None
    for section, df in parts.items():
        key = F.concat_ws("/", *keys.get(section, [])) if keys.get(section) else F.lit("all")
        metrics = [c for c in df.columns if c not in keys.get(section, [])]
        rows = df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
        out = rows if out is None else out.unionByName(rows)
    return out
