"""Problem 5: long exact spans shared between records.

Method: a log-structured fingerprint index.  Every text is winnowed: hashes of
all windows of ``min_chars // 2`` characters, of which the least one of each
run of ``min_chars - min_chars // 2 + 1`` windows is kept, so that any common
span of ``min_chars`` characters leaves a common fingerprint in both texts.  The
fingerprints of a batch become a sorted immutable run; a new batch is merged
with the runs before it, candidates are verified on the texts, and runs are
compacted into one when a batch is to come and there are more than ``max_runs``.

Of fingerprints and texts only those move that a bit set of the shared ones may
hold.  The bit sets have 2**BITS bits at most, built in the executors; what
passes by chance is dropped by the join that follows, so they decide about work
and never about results.

Defined cases: null texts or ids take no part; texts shorter than ``min_chars``
share nothing; rows with one id are one record with several texts; exact copies
are one class (``tid``) that is fingerprinted once and expanded only in
:func:`record_pairs`; an empty input gives empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import arrow_map, code_points, slices
from corpusloom.storage import fresh_path, materialize, remove

BITS = 26  # at most a million words of 64 bits are broadcast
_BASE = 1099511628211  # odd, so that it has an inverse modulo 2**64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        down = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64))
        _POWERS[size] = up, down
    return _POWERS[size]


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` code points."""
    n = len(codes)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return _mixed((total[width:] - total[:-width]) * down[: n - width + 1])


def suffix_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all suffixes, the empty one last."""
    n = len(codes)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return _mixed((total[n] - total) * down[: n + 1])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least hash of each run of ``width`` neighbours, by prefix and suffix minima of blocks."""
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    b = padded.reshape(blocks, width)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(h) - width + 1], left[width - 1 : len(h)])


def winnow(texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, fingerprint, fingerprint before it, whether there is one) for each distinct fingerprint of each text."""
    k = min_chars // 2
    w = min_chars - k + 1
    docs, fps = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
    for start, end in slices(texts):
        parts = [code_points(t) for t in texts[start:end]]
        sizes = np.array([len(p) for p in parts])
        codes = np.concatenate(parts)
        if len(codes) < min_chars:
            continue
        least = _window_minima(window_hashes(codes, k), w)
        last = np.cumsum(sizes)  # windows that lie within one text start no later than min_chars before its end
        doc = np.repeat(np.arange(start, end), sizes)[: len(least)]
        whole = np.arange(len(least)) + min_chars <= last[doc - start]
        doc, least = doc[whole], least[whole]
        if len(doc):
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            docs.append(doc[new])
            fps.append(least[new])
    doc, fp = np.concatenate(docs), np.concatenate(fps)
    order = np.lexsort((np.arange(len(doc)), fp, doc))
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (fp[order][1:] != fp[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    keep = np.sort(order[first])
    doc, fp = doc[keep], fp[keep]
    before, has = np.zeros_like(fp), np.zeros(len(fp), dtype=bool)
    if len(fp):
        before[1:], has[1:] = fp[:-1], doc[1:] == doc[:-1]
    return doc, fp, before, has


def text_classes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(record, tid, text): tid names the class of equal texts."""
    rows = df.select(F.col(id_col).cast("string").alias("record"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("record").isNotNull() & (F.length("text") >= min_chars))
    return rows.withColumn("tid", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def fingerprints(classes: DataFrame, min_chars: int) -> DataFrame:
    """(fp, tid, before): before is the fingerprint in front of it in the text, or null."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        tids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        once = dict(zip(tids, texts))  # copies within a batch are fingerprinted once
        keys = list(once)
        doc, fp, before, has = winnow(list(once.values()), min_chars)
        return pa.RecordBatch.from_arrays(
            [pa.array(fp.view(np.int64)), pa.array(keys, pa.binary()).take(pa.array(doc)), pa.array(before.view(np.int64), mask=~has)], names=["fp", "tid", "before"]
        )

    return arrow_map(classes.select("tid", "text"), per_batch, "fp long, tid binary, before long")


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be one of ``keys``, by a broadcast bit set; an exact join has to follow."""
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.join(F.broadcast(words), (word == F.col("word")) & (F.getbit("bits", bit) == 1), "left_semi")


class FingerprintLog:
    """Sorted immutable runs of fingerprints in the shared folder."""

    SCHEMA = "fp long, tid binary, before long"

    def __init__(self, spark: SparkSession, max_runs: int = 4):
        self.spark, self.max_runs, self.runs = spark, max_runs, []

    def _write(self, rows: DataFrame) -> str:
        path = fresh_path(self.spark, "run")
        rows.repartition("fp").sortWithinPartitions("fp", "tid").dropDuplicates(["fp", "tid"]).write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def append(self, rows: DataFrame, block: int = 1000) -> DataFrame:
        """Add a batch; its candidates (tid_a < tid_b) within itself and with every run before.

        A text that an older run holds already is merged again without harm.
        A fingerprint that many texts share is joined in blocks of ``block`` of
        its texts, so that no task holds all of its pairs.
        """
        new = self._write(rows)
        every = self._read([new]).withColumn("fresh", F.lit(True))
        if self.runs:
            every = every.unionByName(self._read(self.runs).withColumn("fresh", F.lit(False)))
        shared = materialize(every.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        known = perhaps_in(every, shared, "fp").join(shared.select("fp", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "fp").withColumn("at", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
        a = known.where("fresh").select("fp", F.col("tid").alias("tid_a"), F.col("before").alias("before_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
        b = known.select("fp", "at", F.col("tid").alias("tid_b"), F.col("before").alias("before_b"), "fresh")
        # if the fingerprints before them are equal too, the pair came out there
        met = (F.col("tid_a") != F.col("tid_b")) & ~((F.col("before_a") == F.col("before_b")) & F.col("before_a").isNotNull() & F.col("before_b").isNotNull()).eqNullSafe(True)
        found = a.join(b, ["fp", "at"]).where(met & (~F.col("fresh") | (F.col("tid_a") < F.col("tid_b"))))
        self.runs.append(new)
        return found.select(F.least("tid_a", "tid_b").alias("tid_a"), F.greatest("tid_a", "tid_b").alias("tid_b")).distinct()

    def compact(self) -> None:
        """Merge the runs into one if there are more than ``max_runs``."""
        if len(self.runs) > self.max_runs:
            old, merged = self.runs, self._write(self._read(self.runs))
            self.runs = [merged]
            for path in old:
                remove(self.spark, path)

    def close(self) -> None:
        """Remove the runs, when all candidates are written."""
        for path in self.runs:
            remove(self.spark, path)
        self.runs = []


def _common(a: np.ndarray, b: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in each text, of the windows of min_chars that both hold, every one confirmed on the characters.

    Windows that follow each other in both texts are one stretch: its first
    characters are compared start by start, its last window as a whole.
    """
    ha, hb = window_hashes(a, min_chars), window_hashes(b, min_chars)
    values, at_b = np.unique(hb, return_index=True)
    if not len(ha) or not len(values):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    place = np.minimum(np.searchsorted(values, ha), len(values) - 1)
    starts = np.nonzero(values[place] == ha)[0]
    to = at_b[place[starts]]
    ends = np.nonzero(np.append((np.diff(starts) != 1) | (np.diff(to) != 1), True))[0] if len(starts) else starts
    right = bool((a[starts] == b[to]).all()) and all(np.array_equal(a[starts[e] : starts[e] + min_chars], b[to[e] : to[e] + min_chars]) for e in ends)
    if not right:  # hashes that met by chance
        good = [k for k, (x, y) in enumerate(zip(starts, to)) if np.array_equal(a[x : x + min_chars], b[y : y + min_chars])]
        starts = starts[good]
    return starts, np.nonzero(np.isin(hb, ha[starts]))[0]


def _intervals(starts: np.ndarray, width: int) -> list[dict]:
    """The union of windows as intervals [start, end)."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) > width)[0]
    return [{"start": int(s), "end": int(e) + width} for s, e in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]])]


def verify(candidates: DataFrame, classes: DataFrame, min_chars: int) -> DataFrame:
    """(tid_a, tid_b, spans_a, spans_b) of the candidates that do share a span."""
    ends = candidates.select(F.explode(F.array("tid_a", "tid_b")).alias("tid"))
    texts = perhaps_in(classes.select("tid", "text"), ends, "tid").join(ends.distinct(), "tid", "left_semi").dropDuplicates(["tid"])
    pairs = candidates.join(texts.select(F.col("tid").alias("tid_a"), F.col("text").alias("text_a")), "tid_a").join(texts.select(F.col("tid").alias("tid_b"), F.col("text").alias("text_b")), "tid_b")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for ta, tb, xa, xb in zip(*(batch.column(c).to_pylist() for c in ("tid_a", "tid_b", "text_a", "text_b"))):
            sa, sb = _common(code_points(xa), code_points(xb), min_chars)
            if len(sa):
                out.append((ta, tb, _intervals(sa, min_chars), _intervals(sb, min_chars)))
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], spans), pa.array(cols[3], spans)], names=["tid_a", "tid_b", "spans_a", "spans_b"])

    s = "array<struct<start:int,end:int>>"
    return arrow_map(pairs.select("tid_a", "tid_b", "text_a", "text_b"), per_batch, f"tid_a binary, tid_b binary, spans_a {s}, spans_b {s}")


def shared_spans(df: DataFrame, id_col: str, text_col: str, min_chars: int = 300, batches: int = 3, max_runs: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs of text classes that share a span, and the membership (record, tid) of the classes."""
    if min_chars < 2:
        raise ValueError("min_chars must be at least 2")
    classes = text_classes(df, id_col, text_col, min_chars)
    log = FingerprintLog(df.sparkSession, max_runs)
    found = []
    for i in range(batches):
        log.compact()
        batch = classes.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == i)  # copies are in one batch
        found.append(materialize(log.append(fingerprints(batch, min_chars)), "candidates"))
    log.close()
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    return verify(candidates, classes, min_chars), classes.select("record", "tid").distinct()


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b): records whose texts share a span, copies expanded; the smaller id comes first."""
    a = members.select(F.col("tid").alias("tid_a"), F.col("record").alias("ra"))
    b = members.select(F.col("tid").alias("tid_b"), F.col("record").alias("rb"))
    across = pairs.select("tid_a", "tid_b").join(a, "tid_a").join(b, "tid_b").where("ra <> rb").select("ra", "rb")
    repeated = members.withColumn("lo", F.min("record").over(W.partitionBy("tid"))).withColumn("hi", F.max("record").over(W.partitionBy("tid"))).where("lo <> hi")
    within = repeated.select("tid", F.col("record").alias("ra")).join(repeated.select("tid", F.col("record").alias("rb")), "tid").where("ra < rb").select("ra", "rb")
    both = across.unionByName(within)
    return both.select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b")).distinct()


def shared_amounts(df: DataFrame, id_col: str, text_col: str, pairs: DataFrame, members: DataFrame, min_chars: int = 300) -> DataFrame:
    """(id, n_chars, shared_chars, shared_share) of each record: its characters that stand in a shared span.

    A text that another record holds as well is shared as a whole; of a record
    with several texts the sums count.  Records without a text have zeros.
    """
    sides = [pairs.select(F.col(f"tid_{s}").alias("tid"), F.explode(f"spans_{s}").alias("x")).select("tid", "x.start", "x.end") for s in "ab"]
    w = W.partitionBy("tid").orderBy("start", "end")
    cover = sides[0].unionByName(sides[1]).distinct().withColumn("until", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    cover = cover.groupBy("tid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("until", F.lit(0))))).alias("covered"))
    copies = members.groupBy("tid").agg((F.count("*") > 1).alias("copied"))
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    texts = texts.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("tid")).distinct()
    shared = F.when(F.col("copied") & (F.col("n") >= min_chars), F.col("n")).otherwise(F.coalesce("covered", F.lit(0)))
    rows = texts.join(copies, "tid", "left").join(cover, "tid", "left").groupBy("id").agg(F.sum("n").alias("n_chars"), F.sum(shared).alias("shared_chars"))
    return rows.select("id", F.col("n_chars").cast("long").alias("n_chars"), F.col("shared_chars").cast("long").alias("shared_chars"), F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))
