"""Retrieval quality over a grid of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.numbers import round_exact
from corpusloom.storage import materialize


def grid(spark: SparkSession, top_ks: list[int], thresholds: list[float]) -> DataFrame:
    """Every pair of the two short lists."""
    return spark.createDataFrame([(k, t) for k in top_ks for t in thresholds], "top_k int, threshold double")


def outcomes(cases: DataFrame, hits: DataFrame, settings: DataFrame) -> DataFrame:
    """(case_id, top_k, threshold, expected, retained, first_match) of every case under every setting.

    ``cases`` has (case_id, expected; null where nothing is to be found),
    ``hits`` has (case_id, rank, target, score).  A hit counts if its rank is
    within top_k and its score, rounded to six places, reaches the threshold.
    """
    rounded = hits.withColumn("_score", round_exact(F.col("score")))  # once for each hit
    joined = cases.join(rounded, "case_id", "left").crossJoin(F.broadcast(settings))  # a handful of settings
    kept = (F.col("rank") <= F.col("top_k")) & (F.col("_score") >= F.col("threshold"))
    return joined.groupBy("case_id", "expected", "top_k", "threshold").agg(F.count(F.when(kept, 1)).alias("retained"), F.min(F.when(kept & (F.col("target") == F.col("expected")), F.col("rank"))).alias("first_match"))


def metrics(results: DataFrame, reject_below: int = 2) -> DataFrame:
    """Recall and mean reciprocal rank of the answerable cases, rejection and zero-result rates of the others, and balanced accuracy."""
    inside, outside = F.col("expected").isNotNull(), F.col("expected").isNull()
    m = results.groupBy("top_k", "threshold").agg(
        F.coalesce(F.avg(F.when(inside, F.col("first_match").isNotNull().cast("int"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(inside, F.coalesce(F.lit(1.0) / F.col("first_match"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(outside, (F.col("retained") < reject_below).cast("int"))), F.lit(0.0)).alias("rejection"),
        F.coalesce(F.avg(F.when(outside, (F.col("retained") == 0).cast("int"))), F.lit(0.0)).alias("zero_result"),
    )
    return m.withColumn("balanced", (F.col("recall") + F.col("rejection")) / 2)


def best(m: DataFrame) -> DataFrame:
    """The setting with the best balanced accuracy, then recall, rejection, reciprocal rank, a small top_k and a high threshold."""
    r = lambda c: F.round(c, 6)
    return m.orderBy(r("balanced").desc(), r("recall").desc(), r("rejection").desc(), r("mrr").desc(), F.col("top_k"), F.col("threshold").desc()).limit(1)


def errors(cases: DataFrame, hits: DataFrame, top_k: int, threshold: float, reject_below: int = 2) -> DataFrame:
    """(case_id, outcome): hit, below_rank, below_threshold or not_in_pool; accepted or rejected where nothing is to be found."""
    match = F.col("target") == F.col("expected")
    ok = round_exact(F.col("score")) >= threshold
    x = cases.join(hits, "case_id", "left").groupBy("case_id", "expected").agg(
        F.max((match & (F.col("rank") <= top_k) & ok).cast("int")).alias("hit"), F.min(F.when(match, F.col("rank"))).alias("first"), F.count(F.when((F.col("rank") <= top_k) & ok, 1)).alias("kept")
    )
    found = F.when(F.col("hit") == 1, "hit").when(F.col("first").isNull(), "not_in_pool").when(F.col("first") > top_k, "below_rank").otherwise("below_threshold")
    return x.select("case_id", F.when(F.col("expected").isNull(), F.when(F.col("kept") < reject_below, "rejected").otherwise("accepted")).otherwise(found).alias("outcome"))


def margins(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, margin): the best score of an expected target less the best of any other; null where either is missing."""
    match = F.col("target") == F.col("expected")
    x = cases.where("expected is not null").join(hits, "case_id").groupBy("case_id").agg(F.max(F.when(match, F.col("score"))).alias("yes"), F.max(F.when(~match, F.col("score"))).alias("no"))
    return x.select("case_id", (F.col("yes") - F.col("no")).alias("margin"))


def numeric_summary(df: DataFrame, value_col: str, fractions: dict[str, float]) -> DataFrame:
    """Least, greatest, mean and the values at ``round((n - 1) * f)``, halves to even, of a column.

    Counts of distinct values stand in ranges; the totals of the ranges tell in
    which range a place lies, so that only there values are put in order.  An
    empty input gives zeros.
    """
    from pyspark.sql import Window as W

    counts = df.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("v")).agg(F.count("*").alias("n"))
    counts = materialize(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "counts")
    totals = dict(counts.groupBy("part").agg(F.sum("n")).toLocalIterator())  # a row for each range
    total, before, starts = sum(totals.values()), 0, []
    for part in sorted(totals):
        starts.append((part, before, before + totals[part]))
        before += totals[part]
    places = {name: round((total - 1) * f) for name, f in fractions.items()}
    picks = [(name, part, at - lo) for name, at in places.items() for part, lo, hi in starts if lo <= at < hi]
    wanted = counts.sparkSession.createDataFrame(picks, "name string, part int, at long")
    upto = F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    run = counts.join(F.broadcast(wanted.select("part").distinct()), "part", "left_semi").withColumn("upto", upto)
    found = run.join(F.broadcast(wanted), "part").where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
    picked = found.agg(*(F.coalesce(F.max(F.when(F.col("name") == name, F.col("v"))), F.lit(0)).alias(name) for name in fractions))
    mean = F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")), F.lit(0.0))
    ends = counts.agg(F.coalesce(F.min("v"), F.lit(0)).alias("min"), F.coalesce(F.max("v"), F.lit(0)).alias("max"), mean.alias("mean"))
    return ends.crossJoin(picked)  # one row each


def values_at(df: DataFrame, group_col: str, value_col: str, places: dict) -> DataFrame:
    """(group, n, sum, one column for each place): the values at given places, from 1, in the order of each group.

    ``places`` maps names to functions of the group's size ``n``.  A crowded
    group is spread over ranges of its values; a task orders one range only.
    """
    from pyspark.sql import Window as W

    rows = df.where(F.col(value_col).isNotNull()).select(F.col(group_col).alias("grp"), F.col(value_col).alias("v"))
    counts = rows.groupBy("grp", "v").agg(F.count("*").alias("n"))
    counts = materialize(counts.repartitionByRange("grp", "v").withColumn("part", F.spark_partition_id()), "counts")
    group = W.partitionBy(F.struct("grp"))
    parts = counts.groupBy("grp", "part").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("before", F.sum("m").over(group.orderBy("part")) - F.col("m")).withColumn("total", F.sum("m").over(group))
    upto = F.sum("n").over(W.partitionBy("grp", "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    parts = parts.select(F.col("grp").alias("_g"), F.col("part").alias("_p"), "before", "total")
    run = counts.join(parts, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p"))).withColumn("upto", upto)
    picks = [F.min(F.when(F.col("upto") >= at(F.col("total")), F.col("v"))).alias(name) for name, at in places.items()]
    return run.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("sum"), *picks).withColumnRenamed("grp", group_col)


def stratified_sample(df: DataFrame, id_col: str, band_col: str, kind_col: str, key, per_band: int) -> DataFrame:
    """Round robin over the kinds (by name) of each band, each kind in the order of a stable key, until the band has its rows."""
    from pyspark.sql import Window as W

    x = df.withColumn("_k", F.coalesce(F.col(kind_col), F.lit("bilinmiyor"))).withColumn("_key", key)
    x = x.withColumn("_turn", F.row_number().over(W.partitionBy(band_col, "_k").orderBy("_key", id_col))).where(F.col("_turn") <= per_band)
    x = x.withColumn("_place", F.row_number().over(W.partitionBy(band_col).orderBy("_turn", "_k"))).where(F.col("_place") <= per_band)
    return x.select(F.col(id_col).alias("id"), F.col(band_col).alias("band"), F.col("_k").alias("kind"), F.col("_place").alias("place"))
