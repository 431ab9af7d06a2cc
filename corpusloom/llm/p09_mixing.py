"""Problem 9: mixing sources to target weights.

Method: temperature mixing.  The weight of a source is a product of powers of
its share in the corpus and of its target share, ``natural ** (1 - x) * target ** x``,
normalised.  Without a budget ``x`` is 1, the weights are the targets, and the
mix is as large as the repetition limits allow.  With a budget in tokens ``x``
is found by bisection: the largest at which no source has to repeat a document
more often than its limit, or the one that meets a given entropy.

A plan that knows no targets (:func:`temperature`) takes powers of the sources'
own shares, ``natural ** a``, and bisects ``a``, for an entropy or, between the
natural shares (1) and equal ones (0), for the least that the repetition limits
allow.  Such powers alone cannot reach arbitrary targets, hence the products.

The weights are realised as budgeted permutations of blocks: every source is
dealt to blocks by a hash of the document's id, at most ``MOST_BLOCKS`` of them, whole passes use all of its
blocks, and the last pass takes blocks in a hashed order until the budget is
met, with a part of the documents of one block.  Sums are taken over blocks,
so that no task sees all documents of a source.

Defined cases: null and empty texts have no tokens and are in no mix; null ids
and sources and sources without a weight are left out; a source that has a
weight but no documents counts as unreached, and the other targets are raised
in proportion; repeated rows are separate documents; limits below 1 count as 1;
an empty input gives an empty mix.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import arrow_map
from corpusloom.llm.tokens import VOCABULARY, tokens
from corpusloom.storage import materialize


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, n_tokens) of the documents that have tokens and a source."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(tokens(t, vocabulary)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["id", "source", "n_tokens"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0))
    return arrow_map(rows, per_batch, "id string, source string, n_tokens long")


SHARPEST = 8.0  # exponent; above 1 large sources gain
MOST_BLOCKS = 4096  # of a source; bounds what one task sums up and what it orders


def powers(natural: dict[str, float], a: float) -> dict[str, float]:
    """The shares to a power, normalised."""
    top = max(natural.values(), default=1.0)
    raw = {s: (p / top) ** a for s, p in natural.items() if p > 0}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def temperature(tokens_of: dict[str, int], limits: dict[str, int], budget: float, target_entropy: float | None = None) -> tuple[dict[str, float], float]:
    """(weights, exponent): powers of the sources' token shares that meet an entropy, or as even as the repetition limits allow."""
    total = sum(tokens_of.values())
    natural = {s: t / total for s, t in tokens_of.items() if t > 0}
    if not natural:
        return {}, 1.0

    sharpest = 1.0 if target_entropy is None else SHARPEST

    def allowed(flat: float) -> bool:
        weights = powers(natural, sharpest * (1 - flat))
        if target_entropy is not None:
            return entropy(weights) <= target_entropy
        return all(budget * w <= max(1, limits.get(s, 1)) * tokens_of[s] + 1e-9 for s, w in weights.items())

    a = sharpest * (1 - bisect(allowed))
    return powers(natural, a), a


def tempered(natural: dict[str, float], target: dict[str, float], x: float) -> dict[str, float]:
    """Weights between the natural and the target shares."""
    logs = {s: (1 - x) * math.log(natural[s]) + x * math.log(target[s]) for s in target if target[s] > 0 and natural.get(s, 0) > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(v - top) for s, v in logs.items()}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(good, steps: int = 60) -> float:
    """The largest x in [0, 1] at which ``good`` holds, if it holds up to a point."""
    if good(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return lo


def plan(tokens_of: dict[str, int], target: dict[str, float], limits: dict[str, int], budget: int | None = None, target_entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, exponent, tokens of the mix)."""
    have = {s: t for s, t in tokens_of.items() if t > 0 and target.get(s, 0) > 0}
    if not have:
        return {}, 1.0, 0.0
    total = sum(have.values())
    natural = {s: t / total for s, t in have.items()}
    most = {s: max(1, limits.get(s, 1)) * t for s, t in have.items()}
    if target_entropy is not None:
        ends = [entropy(tempered(natural, target, x)) for x in (0.0, 1.0)]
        rising = ends[1] >= ends[0]
        x = bisect(lambda x: (entropy(tempered(natural, target, x)) <= target_entropy) == rising)
    elif budget is not None:
        x = bisect(lambda x: all(budget * w <= most[s] + 1e-9 for s, w in tempered(natural, target, x).items()))
    else:
        x = 1.0
    weights = tempered(natural, target, x)
    largest = min(most[s] / w for s, w in weights.items())
    return weights, x, min(largest, budget) if budget is not None else largest


def mixed(documents: DataFrame, weights: DataFrame, source_col: str = "source", share_col: str = "target_share", repeats_col: str = "max_repeats", budget: int | None = None, target_entropy: float | None = None, block_docs: int = 1000, seed: int = 17, exponents=None) -> DataFrame:
    """(id, source, use, n_tokens, place): every use of every document of :func:`sized` in the mix; sorted by ``place`` the mix is shuffled.

    ``exponents``, if given, makes (weights, tokens of the mix) from the sources'
    tokens and limits instead.  The weights are a small table, with a row for each source, as are the sums
    that reach the driver.
    """
    spark = documents.sparkSession
    rules = {r[0]: (r[1] or 0.0, r[2] or 1) for r in weights.select(source_col, share_col, repeats_col).where(F.col(source_col).isNotNull()).toLocalIterator()}
    sums = {r["source"]: (r["t"], r["n"]) for r in documents.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).toLocalIterator() if r["source"] in rules}
    if exponents is not None:
        shares, total = exponents({s: t for s, (t, _) in sums.items()}, {s: x[1] for s, x in rules.items()})
    else:
        shares, _, total = plan({s: t for s, (t, _) in sums.items()}, {s: x[0] for s, x in rules.items()}, {s: x[1] for s, x in rules.items()}, budget, target_entropy)
    rows = []
    for s, w in shares.items():
        t, n = sums[s]
        wanted = min(total * w, t * max(1, rules[s][1]))
        passes = int(wanted // t)
        rows.append((s, passes, float(wanted - passes * t), min(MOST_BLOCKS, -(-n // block_docs))))
    quotas = F.broadcast(spark.createDataFrame(rows, "source string, passes int, rest double, blocks long"))
    docs = documents.join(quotas, "source").withColumn("u", F.xxhash64("id", F.lit(seed)))
    docs = docs.withColumn("block", F.pmod("u", F.col("blocks")))
    sized_blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    order = W.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed + 1)), "block")
    turn = sized_blocks.withColumn("before", F.sum("t").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("t"))
    turn = turn.where("before < rest").select("source", "block", (F.col("rest") - F.col("before")).alias("left"), (F.col("before") + F.col("t") > F.col("rest")).alias("partial"))
    docs = docs.join(turn, ["source", "block"], "left")
    # only the one partial block of a source is ordered document by document
    inside = W.partitionBy("source", "block").orderBy("u", "id").rowsBetween(W.unboundedPreceding, 0)
    part = docs.where("partial").withColumn("upto", F.sum("n_tokens").over(inside)).withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("left")).cast("int")).drop("upto")
    whole = docs.where("partial is null or not partial").withColumn("extra", F.col("left").isNotNull().cast("int"))
    uses = whole.unionByName(part).withColumn("uses", F.col("passes") + F.col("extra")).where("uses > 0")
    uses = uses.select("id", "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use"), "n_tokens")
    return uses.withColumn("place", F.xxhash64("id", "use", F.lit(seed + 2)))


def share_report(mix: DataFrame, weights: DataFrame, source_col: str = "source", share_col: str = "target_share", repeats_col: str = "max_repeats") -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats, max_repeats, total_variation) of every source that has a weight.

    The last column, equal in all rows, is half the sum of all differences of shares.
    """
    per_doc = mix.groupBy("source", "id").agg(F.sum("n_tokens").alias("t"), F.max("use").alias("uses"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_repeats"))
    every = W.partitionBy(F.lit(1))  # one row for each source
    rules = weights.select(F.col(source_col).alias("source"), F.col(share_col).alias("target_share"), F.col(repeats_col).alias("max_repeats"))
    rows = rules.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    rows = rows.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)))
    rows = rows.withColumn("total_variation", F.sum(F.abs(F.col("actual_share") - F.coalesce("target_share", F.lit(0.0)))).over(every) / 2)
    return rows.select("source", "target_share", "actual_share", "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats", "total_variation")
