"""Problem 3: text cut off by field limits.

Method: a backward character n-gram model.  For the last ``n`` characters of
every value it is counted, over all texts, how often a text ends after them and
how often it goes on.  The log-odds of an end, interpolated from short contexts
to long ones and without the value's own end, are held against a threshold for
each language and column, the emptiest place in the histogram of all values.

Counts are kept for contexts that end some value only, by their 64-bit hashes.
Where a text goes on, a context is looked up in bit sets of 2**BITS bits for each
order, built in the executors, so that what is broadcast is bounded however many
texts there are.  A long context is looked up only where all shorter ones were
found; what passes by chance meets no end in the join that follows, so the bit
sets decide about work and never about counts.

Defined cases: null and blank texts are not cut; punctuation, and so a mark of
omission after the end, is set aside; exact copies count once in the model, in ends, continuations and the histogram; an empty input gives an
empty result; the boundary between the classes is never set where ends are as
likely as continuations; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, code_points, slices
from corpusloom.llm.p02_lookalikes import unify
from corpusloom.llm.p05_shared_spans import window_hashes
from corpusloom.storage import materialize

ORDERS = (3, 6, 10, 15)
BITS = 22
SLOTS = 1 << 20  # of digests that repeat; bounds what is broadcast
TAIL = 256  # characters from the last letter or digit on; more than the longest order reaches
#: A character reference, or its beginning, that a cut left at the end.
_FRAGMENT = re.compile(r"&(?:#[xX]?[0-9A-Fa-f]{0,6}|[A-Za-z]{0,8});?$")
_LOWEST, _HIGHEST, _BINS, _WINDOW = -14.0, 10.0, 480, 15
_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Characters without case, all digits as 0, all white space as a blank, punctuation and marks of omission as none."""
    if not _TABLE:
        t = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x3000):
            ch = chr(c)
            low = "i" if ch in "Iİı" else ch.lower()
            t[c] = ord(low) if len(low) == 1 else c
            if ch.isspace():
                t[c] = 32
            elif ch.isdigit():
                t[c] = 48
            elif unicodedata.category(ch)[0] == "P" or c == 0x307:
                t[c] = 0
        _TABLE.append(t)
    return _TABLE[0]


def _condense(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without punctuation; runs of digits and of white space within a text become one."""
    some = codes > 0
    codes, doc = codes[some], doc[some]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != codes[:-1]) | ((codes[1:] != 48) & (codes[1:] != 32)) | (doc[1:] != doc[:-1])
    return codes[keep], doc[keep]


#: What may follow the end of a text without saying anything: white space, punctuation, controls and marks of format.
_IDLE = "".join(chr(c) for c in (*range(0x3100), *range(0xFE00, 0xFF00), *range(0xFF01, 0xFF10)) if chr(c).isspace() or unicodedata.category(chr(c))[0] in "PCZ" and unicodedata.category(chr(c)) != "Cn" and chr(c) not in "&;#")


def tail_contexts(tail: str) -> list[int | None] | None:
    """The hash of each order's context at the end of a text; null for blank texts and for orders longer than the text.

    Look-alike characters are set right first; punctuation at the end, with it
    marks of omission, and a broken character reference play no part.
    """
    codes = _table()[code_points(_FRAGMENT.sub("", unify(tail).rstrip()))]
    codes, _ = _condense(codes, np.zeros(len(codes), dtype=np.int8))
    while len(codes) and codes[-1] == 32:
        codes = codes[:-1]
    if not len(codes):
        return None
    return [int(window_hashes(codes[-n:], n).view(np.int64)[0]) if len(codes) >= n else None for n in ORDERS]


def _tails(df: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group_cols)).alias("grp"), F.xxhash64(text_col).alias("tid"), F.right(F.rtrim(F.col(text_col), F.lit(_IDLE)), F.lit(TAIL)).alias("tail"))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [None if t is None else tail_contexts(t) for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64()))], names=["id", "grp", "tid", "contexts"])

    return arrow_map(rows.where(F.col("id").isNotNull()), per_batch, "id string, grp array<string>, tid long, contexts array<long>")


def _wanted(ends: DataFrame) -> bytes:
    """The bit sets of the contexts, 2**BITS bits for each order, put together in the executors."""
    slot = (F.col("k").cast("long") * (1 << BITS) + F.shiftrightunsigned("context", 64 - BITS)) + 1
    sets = ends.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(len(ORDERS) << (BITS - 3), dtype=np.uint8)
    for r in sets.toLocalIterator():  # of fixed number and size
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.tobytes()


def _continuations(df: DataFrame, text_col: str, wanted) -> DataFrame:
    """(k, context, goes_on): how often the texts go on after each context that the bit sets hold."""

    def run(batches):
        bits = np.frombuffer(wanted.value, dtype=np.uint8).reshape(len(ORDERS), -1)
        table = _table()
        held: list[list[tuple]] = [[] for _ in ORDERS]

        def merged(k: int) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([x for x, _ in held[k]] or [np.empty(0, dtype=np.uint64)])
            counts = np.concatenate([n for _, n in held[k]] or [np.empty(0, dtype=np.int64)])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)

        def rows(k: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "context", "goes_on"])

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for start, end in slices(texts):
                parts = [code_points(t) for t in texts[start:end]]
                codes = table[np.concatenate(parts)]
                codes, doc = _condense(codes, np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                solid = np.nonzero(codes != 32)[0]
                last = np.full(len(parts), -1)
                last[doc[solid]] = solid  # the last of equal indices is kept
                at = np.nonzero(np.arange(len(codes)) < last[doc])[0]  # the end of a text does not go on
                for k, n in enumerate(ORDERS):
                    at = at[at >= n - 1]
                    at = at[doc[at] == doc[at - n + 1]]
                    if not len(at):
                        break
                    h = window_hashes(codes, n)[at - n + 1]
                    b = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    ok = (bits[k][b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0
                    at, h = at[ok], h[ok]
                    held[k].append(np.unique(h, return_counts=True))
            for k in range(len(ORDERS)):
                if sum(len(x) for x, _ in held[k]) > 1 << 21:
                    held[k] = [merged(k)]
                    if len(held[k][0][0]) > 1 << 20:
                        yield rows(k, *held[k][0])
                        held[k] = []
        for k in range(len(ORDERS)):
            yield rows(k, *merged(k))

    parts = df.select(text_col).mapInArrow(run, "k int, context long, goes_on long")
    return parts.groupBy("k", "context").agg(F.sum("goes_on").alias("goes_on"))


def _once(df: DataFrame, id_col: str, text_col: str, tails: DataFrame) -> DataFrame:
    """(text): one row for each text digest; texts move only where the slot of their digest holds one that repeats."""
    slot = F.pmod("tid", F.lit(SLOTS))
    repeated = materialize(tails.groupBy("tid").count().where("count > 1").select(slot.alias("slot")).distinct(), "repeated")
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text")).withColumn("slot", slot)
    alone = rows.join(F.broadcast(repeated), "slot", "left_anti")
    again = rows.join(F.broadcast(repeated), "slot", "left_semi").dropDuplicates(["tid"])
    return alone.select("text").unionByName(again.select("text"))


def end_scores(df: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """(id, tid, grp, log_odds) of every value: the digest of its text and the log-odds of an end after its final context."""
    tails = materialize(_tails(df, id_col, text_col, group_cols), "tails")
    finals = tails.where("contexts is not null").dropDuplicates(["tid"]).select("tid", F.posexplode("contexts").alias("k", "context")).where("context is not null")
    finals = materialize(finals, "finals")
    ends = materialize(finals.groupBy("k", "context").agg(F.count("*").alias("ends")), "ends")
    wanted = df.sparkSession.sparkContext.broadcast(_wanted(ends))
    counts = ends.join(_continuations(_once(df, id_col, text_col, tails), "text", wanted), ["k", "context"], "left").select("k", "context", "ends", F.coalesce("goes_on", F.lit(0)).alias("goes_on"))
    seen = finals.join(counts, ["k", "context"])
    odds = seen.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("ends") - 1).alias("e"), "goes_on"))).alias("c"))  # at most one entry for each order
    p = F.aggregate("c", F.lit(1e-3), lambda p, x: (x["e"] + p * 4) / (x["e"] + x["goes_on"] + 4))
    odds = odds.withColumn("p", p).select("tid", F.log(F.col("p") / (1 - F.col("p") + 1e-9)).alias("log_odds"))
    return tails.join(odds, "tid").select("id", "tid", "grp", "log_odds")


def _threshold(histogram: dict[int, int]) -> float:
    """The emptiest place between -7 and -1: the middle of the longest stretch where a window of the histogram holds least."""
    n = np.zeros(_BINS)
    for k, v in histogram.items():
        n[k] = v
    x = _LOWEST + (np.arange(_BINS) + 0.5) * (_HIGHEST - _LOWEST) / _BINS
    near = np.convolve(n, np.ones(_WINDOW), mode="same")
    inside = np.nonzero((x > -7) & (x < -1))[0]
    least = inside[near[inside] == near[inside].min()]
    runs = np.split(least, np.nonzero(np.diff(least) > 1)[0] + 1)
    return float(x[max(runs, key=len)].mean())


def truncated(df: DataFrame, id_col: str, text_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """(id, grp, log_odds, threshold, cut) of every value that is not blank; a threshold for each group, taken from all of its different texts.

    ``group_cols`` name the language and the column of a value; there are few
    groups, of which only histograms of fixed size reach the driver.
    """
    scores = materialize(end_scores(df, id_col, text_col, group_cols or []), "scores")
    width = (_HIGHEST - _LOWEST) / _BINS
    bins = scores.select("grp", "tid", "log_odds").distinct().groupBy("grp", F.least(F.greatest(F.floor((F.col("log_odds") - _LOWEST) / width), F.lit(0)), F.lit(_BINS - 1)).alias("bin")).count()
    by: dict[tuple, dict[int, int]] = {}
    for r in bins.toLocalIterator():
        by.setdefault(tuple(r["grp"]), {})[r["bin"]] = r["count"]
    rows = [(list(g), _threshold(h)) for g, h in by.items()]
    limits = df.sparkSession.createDataFrame(rows, "grp array<string>, threshold double")
    joined = scores.join(F.broadcast(limits), "grp")
    return joined.select("id", "grp", "log_odds", "threshold", (F.col("log_odds") < F.col("threshold")).alias("cut"))


def source_shares(df: DataFrame, cut: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """(source, records, cut_records, cut_share): how often each source truncates; records count once, null sources are a source."""
    ids = cut.groupBy("id").agg(F.max("cut").alias("cut"))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source")).where("id is not null").distinct().join(ids, "id", "left")
    n = F.sum(F.when(F.col("cut"), 1).otherwise(0))
    return rows.groupBy("source").agg(F.count("*").alias("records"), n.alias("cut_records"), (n / F.count("*")).alias("cut_share"))
