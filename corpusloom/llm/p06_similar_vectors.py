"""Problem 6: the most similar vectors for every vector.

Method: inverted multi-index.  Vectors are normalised and cut in two halves,
each quantised by its own codebook; a vector's cell is the pair of its nearest
centroids.  A query visits the cells with the least summed distance, found with
a heap over pairs of ranked centroids, and takes the best of each visit; the best
over its visits are reranked.  With a least score entries carry 8-bit components
and pairs are reranked on the full vectors; without one they carry 16-bit
components, on which they are ranked at once (scores are then off by less than
1e-4), as a rerank would move a vector for every hit.

The codebooks are fitted on a sample of at most ``sample`` vectors (the least
by a hash of the id); every vector is indexed and every vector is a query.
A codebook has ``fineness * n ** growth`` centroids, 2,048 at most; what that
leaves in a cell is met in full, so the bound costs time, not hits.

A cell with more than ``block`` entries or 4 ``block`` visits is split into blocks
of both, and every block of visits meets every block of entries: no task holds
more than a block of each, and a visit returns its best ``k`` only, so a cluster
of near-equal vectors gives no more rows than any other.  ``block`` grows where
otherwise more than ``HOT_CELLS`` cells could be crowded; so many rows at most
reach the driver.

Defined cases: vectors that are null, of another length, not finite or all zero
take no part, nor do null ids; rows with one id are one vector (the least if
they differ); equal vectors under different ids are one class, whose members
are each other's nearest; equal scores are ordered by id; fewer than ``k``
others give fewer hits; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import arrow_map
from corpusloom.storage import materialize

_SCALES = {np.int8: 127.0, np.int16: 32767.0}
_SCORES = 1 << 23  # that are held at once
HOT_CELLS = 200_000
_LEFT_OUT = 0.02  # more than the 8-bit components can be off


def codebook_size(n: int, fineness: float = 1.2, growth: float = 0.3) -> int:
    """Centroids for each half of ``n`` vectors."""
    return int(min(2048, max(4, round(fineness * max(n, 1) ** growth))))


def fit_codebook(sample: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced distinct rows of the sample; empty ones are given up."""
    points = np.unique(sample, axis=0)
    centres = points[np.unique(np.linspace(0, len(points) - 1, min(size, len(points))).astype(int))]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=len(centres))
        n = n[n > 0]
        centres = (np.add.reduceat(sample[order], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]).astype(np.float32)
    return centres


def _nearest_cells(left: list[float], right: list[float], wanted: int) -> list[tuple[int, int]]:
    """Pairs of ranks by increasing sum of their distances: the multi-sequence walk with a heap."""
    heap, seen, out = [(left[0] + right[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < wanted:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        if i + 1 < len(left) and (i + 1, j) not in seen:
            seen.add((i + 1, j))
            heapq.heappush(heap, (left[i + 1] + right[j], i + 1, j))
        if j + 1 < len(right) and (i, j + 1) not in seen:
            seen.add((i, j + 1))
            heapq.heappush(heap, (left[i] + right[j + 1], i, j + 1))
    return out


def visited_cells(x: np.ndarray, books: list[np.ndarray], probes: int) -> np.ndarray:
    """The cells that each row of ``x`` visits, its own first; -1 where there are no more."""
    half, ranks, distances = x.shape[1] // 2, [], []
    for part, book in zip((x[:, :half], x[:, half:]), books):
        d = (book * book).sum(1) - 2 * (part @ book.T)
        n = min(probes, d.shape[1])
        near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(d), 1))
        values = np.take_along_axis(d, near, 1)
        order = np.argsort(values, axis=1, kind="stable")
        ranks.append(np.take_along_axis(near, order, 1))
        distances.append(np.take_along_axis(values, order, 1).tolist())
    out = np.full((len(x), probes), -1, dtype=np.int64)
    for r, (a, b) in enumerate(zip(*distances)):
        for c, (i, j) in enumerate(_nearest_cells(a, b, probes)):
            out[r, c] = ranks[0][r, i] * len(books[1]) + ranks[1][r, j]
    return out


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a valid vector, these vectors normalised)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.nonzero(sizes == dim)[0]
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(rows) else np.empty((0, dim))
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (x[good] / norm[good, None]).astype(np.float32)


def _fixed(data: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(data.shape[1]), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _bytes(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _keys(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x), dtype=np.uint8).reshape(-1, 16)


def _codes(x: np.ndarray, kind) -> np.ndarray:
    return np.rint(x * _SCALES[kind]).astype(kind)


def _index(rows: DataFrame, dim: int, books: list[np.ndarray], probes: int, kind) -> DataFrame:
    """(id, key, code, cells): key names the class of equal vectors."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, x = _vectors(batch.column(1), dim)
        cells = visited_cells(x, books, probes)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * probes), pa.array(cells.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _fixed(_keys(x)), _fixed(_codes(x, kind).view(np.uint8).reshape(len(x), -1)), lists], names=["id", "key", "code", "cells"])

    return arrow_map(rows, per_batch, "id string, key binary, code binary, cells array<long>")


QUERY, ENTRY = 1, 2


def _spread(entries: DataFrame, hot) -> DataFrame:
    """A row for each visit, (cell, block, turn, role, key, code); ``hot`` has the crowded cells with their blocks of entries and of visits."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        cells = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        row = np.repeat(np.arange(n), cells.shape[1])
        home = np.tile(np.arange(cells.shape[1]) == 0, n)
        cell = cells.ravel()
        keep = cell >= 0
        row, home, cell = row[keep], home[keep], cell[keep]
        block = turn = np.zeros(len(cell), dtype=np.int32)
        role = np.where(home, QUERY | ENTRY, QUERY).astype(np.int8)
        names, blocks, turns = hot.value
        if len(names):
            at = np.minimum(np.searchsorted(names, cell), len(names) - 1)
            crowded = names[at] == cell
            own = _bytes(batch.column(0), 16)[:, :8].copy().view(np.uint32)
            b, t = blocks[at[crowded]], turns[at[crowded]]
            r, h, c = row[crowded], home[crowded], cell[crowded]
            asks = np.repeat(np.arange(len(r)), b)  # a query meets all blocks of entries, in its own turn
            ask_block = np.concatenate([np.arange(x) for x in b]) if len(b) else b
            gives = np.repeat(np.nonzero(h)[0], t[h])  # an entry stands in one block, in all turns
            give_turn = np.concatenate([np.arange(x) for x in t[h]]) if h.any() else t[:0]
            row = np.concatenate([row[~crowded], r[asks], r[gives]])
            cell = np.concatenate([cell[~crowded], c[asks], c[gives]])
            block = np.concatenate([block[~crowded], ask_block, own[r[gives], 0] % b[gives]]).astype(np.int32)
            turn = np.concatenate([turn[~crowded], own[r[asks], 1] % t[asks], give_turn]).astype(np.int32)
            role = np.concatenate([role[~crowded], np.full(len(asks), QUERY), np.full(len(gives), ENTRY)]).astype(np.int8)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block), pa.array(turn), pa.array(role), batch.column(0).take(take), batch.column(1).take(take)], names=["cell", "block", "turn", "role", "key", "code"])

    return arrow_map(entries.select("key", "code", "cells"), per_batch, "cell long, block int, turn int, role byte, key binary, code binary")


def _visits_in_order(batches, dim: int, kind):
    """(keys, codes, roles) of each block and turn of a cell, from batches sorted by them."""
    held: list[tuple] = []

    def groups(last: bool):
        if not held:
            return
        cell, role, keys, codes = (np.concatenate(x) for x in zip(*held))
        cut = np.nonzero((cell[1:] != cell[:-1]).any(axis=1))[0] + 1
        bounds = [0, *cut.tolist(), len(cell)]
        stop = len(bounds) - 1 if last else len(bounds) - 2
        for s, e in zip(bounds[:stop], bounds[1 : stop + 1]):
            if (role[s:e] & ENTRY).any():
                yield keys[s:e], codes[s:e], role[s:e]
        held[:] = [] if last else [tuple(x[bounds[stop] :] for x in (cell, role, keys, codes))]

    for batch in batches:
        if batch.num_rows:
            where = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2)], axis=1)
            held.append((where, batch.column(3).to_numpy(), _bytes(batch.column(4), 16), _bytes(batch.column(5), dim * np.dtype(kind).itemsize).view(kind)))
            yield from groups(False)
    yield from groups(True)


def _ragged(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of bytes of different lengths as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _meet(visits: DataFrame, dim: int, k: int, kind, least: float | None = None) -> DataFrame:
    """(a, b, score): the best ``k`` of each query over all its visits, of those that score at least ``least``.

    A visit returns its best ``k`` in one packed row; the rows of a query, no
    more than its visits, are then merged.
    """

    def run(batches):
        scale = np.float32(1 / _SCALES[kind])
        for keys, codes, role in _visits_in_order(batches, dim, kind):
            gives, asks = np.nonzero(role & ENTRY)[0], np.nonzero(role & QUERY)[0]
            entries, names = codes[gives].astype(np.float32) * scale, keys[gives]
            order = np.argsort(short := names[:, :8].copy().view(np.uint64).ravel(), kind="stable")
            many, rows = min(k, len(names)), max(64, _SCORES // len(names))
            for s in range(0, len(asks), rows):
                own = keys[asks[s : s + rows]]
                near = (codes[asks[s : s + rows]].astype(np.float32) * scale) @ entries.T
                mine = own[:, :8].copy().view(np.uint64).ravel()
                at = order[np.minimum(np.searchsorted(short, mine, sorter=order), len(order) - 1)]
                same = np.nonzero(short[at] == mine)[0]
                near[same, at[same]] = -9  # a query is no hit of itself
                col = np.argpartition(-near, many - 1, axis=1)[:, :many] if many < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                score = np.take_along_axis(near, col, 1).astype("<f4")
                good = score >= (-2 if least is None else least)
                n = good.sum(axis=1)
                some = n > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([_fixed(own[some]), _ragged(names[col[good]], 16 * n[some]), _ragged(score[good].view(np.uint8), 4 * n[some])], names=["a", "bs", "scores"])

    def merge(batches):
        held: list[tuple] = []

        def best(last: bool):
            if not held:
                return
            a = [x for h in held for x in h[0]]
            bs, scores = ([x for h in held for x in h[i]] for i in (1, 2))
            stop = len(a)
            if not last:
                while stop and a[stop - 1] == a[-1]:
                    stop -= 1
            if stop:
                number = np.cumsum([0, *(x != y for x, y in zip(a[1:stop], a[: stop - 1]))])
                n = np.array([len(x) // 4 for x in scores[:stop]])
                group = np.repeat(number, n)
                s = np.frombuffer(b"".join(scores[:stop]), dtype="<f4").astype(np.float64)
                b = np.frombuffer(b"".join(bs[:stop]), dtype=np.uint8).reshape(-1, 16)
                order = np.lexsort((b[:, 0], -s, group))
                g = group[order]
                first = np.searchsorted(g, np.arange(number[-1] + 1))
                keep = order[(np.arange(len(g)) - first[g] < k) & (s[order] > -2)]
                owner = np.frombuffer(b"".join(a[:stop]), dtype=np.uint8).reshape(-1, 16)[np.searchsorted(number, group[keep])]
                yield pa.RecordBatch.from_arrays([_fixed(owner), _fixed(b[keep]), pa.array(s[keep])], names=["a", "b", "score"])
            held[:] = [] if last else [(a[stop:], bs[stop:], scores[stop:])]

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_pylist() for c in batch.columns))
                yield from best(False)
        yield from best(True)

    packed = visits.repartition("cell", "block", "turn").sortWithinPartitions("cell", "block", "turn").mapInArrow(run, "a binary, bs binary, scores binary")
    return packed.repartition("a").sortWithinPartitions("a").mapInArrow(merge, "a binary, b binary, score double")


def _rerank(pairs: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """(a, b, score) with the cosine of the full vectors."""

    def load(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, x = _vectors(batch.column(1), dim)
        return pa.RecordBatch.from_arrays([_fixed(_keys(x)), _fixed(x.view(np.uint8).reshape(len(x), -1))], names=["key", "full"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    full = arrow_map(rows, load, "key binary, full binary").join(ends, "key", "left_semi").dropDuplicates(["key"])
    both = pairs.select("a", "b").join(full.select(F.col("key").alias("a"), F.col("full").alias("fa")), "a").join(full.select(F.col("key").alias("b"), F.col("full").alias("fb")), "b")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        fa, fb = (_bytes(batch.column(c), dim * 4).view(np.float32).astype(np.float64) for c in (2, 3))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip((fa * fb).sum(1), -1, 1))], names=["a", "b", "score"])

    return arrow_map(both.select("a", "b", "fa", "fb"), score, "a binary, b binary, score double")


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, min_score: float | None = None, probes: int = 8, sample: int = 20_000, block: int = 32_768, fineness: float = 1.2, growth: float = 0.3) -> DataFrame:
    """(id, rank, neighbour, score): the ``k`` most similar other ids of each id by cosine; with ``min_score`` only hits that reach it."""
    if dim < 2 or k < 1 or probes < 1:
        raise ValueError("dim must be at least 2, k and probes at least 1")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim))
    n = rows.count()
    drawn = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(1.1 * sample / n * (1 << 30)) + 1)
    drawn = drawn.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()  # at most ``sample`` vectors
    points = np.concatenate([_vectors(c, dim)[1] for c in drawn.column(0).chunks] or [np.empty((0, dim), dtype=np.float32)])
    if not len(points):
        return df.sparkSession.createDataFrame([], "id string, rank int, neighbour string, score double")
    size = codebook_size(n, fineness, growth)
    half = dim // 2
    books = [fit_codebook(points[:, :half], size), fit_codebook(points[:, half:], size)]
    index = materialize(_index(rows, dim, books, probes, np.int16 if min_score is None else np.int8), "cells")
    names = index.select("key", "id").groupBy("id").agg(F.min("key").alias("key"))
    entries = index.select("key", "code", "cells").dropDuplicates(["key"])
    block = max(block, -(-n * probes // HOT_CELLS))
    counts = index.select(F.posexplode("cells").alias("at", "cell")).where("cell >= 0").groupBy("cell").agg(F.count_if(F.col("at") == 0).alias("homes"), F.count("*").alias("visits"))
    crowded = counts.where((F.col("homes") > block) | (F.col("visits") > 4 * block)).orderBy("cell").toArrow()  # at most HOT_CELLS
    cell, homes, visits = (crowded.column(c).to_numpy() for c in ("cell", "homes", "visits"))
    hot = df.sparkSession.sparkContext.broadcast((cell, np.maximum(1, -(-homes // block)), np.maximum(1, -(-visits // (4 * block)))))
    visits = _spread(entries, hot)
    if min_score is None:
        both = _meet(visits, dim, k, np.int16)
    else:
        found = _meet(visits, dim, 3 * k + 1, np.int8, min_score - _LEFT_OUT)  # more than k, as 8 bits may order them otherwise
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        exact = _rerank(materialize(pairs, "pairs"), rows, dim).where(F.col("score") >= min_score)
        both = exact.select("a", "b", "score").unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        best = W.partitionBy("a").orderBy(F.desc("score"), "b")
        both = both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    first = W.partitionBy("key").orderBy("id")
    members = names.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("key", "id")  # enough for any member
    offers = both.join(members.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), "score", F.col("id").alias("neighbour"))
    twins = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").join(members, "key").select("key", F.lit(1.0).alias("score"), F.col("id").alias("neighbour"))
    order = W.partitionBy("key").orderBy(F.desc("score"), "neighbour")
    offers = offers.unionByName(twins).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    hits = names.join(offers, "key").where("id <> neighbour")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "neighbour"))).where(F.col("rank") <= k)
    return ranked.select("id", "rank", "neighbour", "score")
