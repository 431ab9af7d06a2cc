"""Problem 8: filling fixed-capacity containers with items.

Method: lexical retrieval packing.  Documents are dealt to shards of about
``shard_docs`` by their words: a tree of two-means splits, fitted on a sample in
the space of its main lexical axes, whose neighbouring leaves make a shard.
Where a shard gets too many, it is split by a hash of the words, so that exact
repeats stay together, and what still is too large by a hash of the id.  Each
shard holds a BM25 inverted index of its documents, with all of their tokens and
document frequencies over all documents.  The longest unused item seeds a
container; its unused neighbours, best first, fill it as far as they fit, and
what space is left goes to the largest unused items that still fit.

A text longer than the capacity is cut into pieces of exactly the capacity, which
are containers of their own, and a rest, which is an item like others.

Defined cases: null and empty texts have no tokens and are in no container;
null ids are left out; rows with one id are separate items; an empty input
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map
from corpusloom.llm.tokens import VOCABULARY, tokens
from corpusloom.storage import materialize

IDS = 1 << 16  # token ids are below this
K1, B = 1.2, 0.75


def token_bags(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, bag): bag holds a document's distinct tokens and their counts, both as 16-bit numbers."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, bags = [], []
        for t in batch.column(1).to_pylist():
            ids = np.array(tokens(t, vocabulary), dtype=np.uint32)
            if len(ids) and ids.max() >= IDS:
                raise ValueError("the vocabulary has more than 65,536 tokens")
            u, n = np.unique(ids, return_counts=True)
            sizes.append(len(ids))
            bags.append(u.astype("<u2").tobytes() + np.minimum(n, 65535).astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(bags, pa.binary())], names=["id", "n_tokens", "bag"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    return arrow_map(rows, per_batch, "id string, n_tokens int, bag binary")


def _bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, dtype="<u2")
    return both[: len(both) // 2].astype(np.int64), both[len(both) // 2 :].astype(np.float64)


def _frequencies(bags: DataFrame) -> tuple[np.ndarray, int, float]:
    """(document frequency of each token, documents, mean length); the first has 65,536 entries at most."""

    def run(batches):
        df, n, size = np.zeros(IDS, dtype=np.int64), 0, 0
        for batch in batches:
            for data in batch.column(1).to_pylist():
                df[_bag(data)[0]] += 1
            n += batch.num_rows
            size += int(np.sum(batch.column(0).to_numpy()))
        some = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [IDS, IDS + 1]])), pa.array(np.concatenate([df[some], [n, size]]))], names=["token", "n"])

    total = bags.select("n_tokens", "bag").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(IDS + 2, dtype=np.int64)
    df[total.column("token").to_numpy()] = total.column("n").to_numpy()
    return df[:IDS], int(df[IDS]), float(df[IDS + 1]) / max(1, int(df[IDS]))


def _postings(size: int, data: bytes, idf: np.ndarray, mean: float) -> bytes:
    """The tokens of a document and their BM25 impacts."""
    ids, tf = _bag(data)
    w = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    return ids.astype("<u2").tobytes() + w.astype("<f4").tobytes()


def _terms(postings: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(postings) // 3
    return np.frombuffer(postings[:n], dtype="<u2").astype(np.int64), np.frombuffer(postings[n:], dtype="<f4")


def _coordinates(postings: list[bytes], axes: np.ndarray) -> np.ndarray:
    """Where documents lie on the axes, at length one."""
    out = np.zeros((len(postings), axes.shape[1]), dtype=np.float32)
    for i, p in enumerate(postings):
        ids, w = _terms(p)
        out[i] = w @ axes[ids]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _axes(postings: list[bytes], dims: int = 32, rounds: int = 3) -> np.ndarray:
    """The main lexical axes of a sample, by subspace iteration: a row for each token."""
    rows = [(ids, w / max(float(np.linalg.norm(w)), 1e-9)) for ids, w in map(_terms, postings)]
    axes = np.random.default_rng(8).normal(size=(IDS, dims)).astype(np.float32)
    for _ in range(rounds):
        image = np.zeros((IDS, dims), dtype=np.float32)
        for ids, w in rows:  # the tokens of a document are distinct
            image[ids] += np.outer(w, w @ axes[ids])
        used = np.nonzero(image.any(axis=1))[0]
        axes = np.zeros_like(image)
        q = np.linalg.qr(image[used])[0]
        axes[used, : q.shape[1]] = q
    return axes


def _tree(points: np.ndarray, leaf: float, shard: float) -> list[tuple]:
    """Nodes (normal, offset, low, high) of two-means splits of a sample; a child below 0 is shard -1 - child.

    Leaves of at most ``leaf`` points are joined in their order to shards of at most ``shard``.
    """
    nodes: list[list] = []
    stack: list[tuple] = [(np.arange(len(points)), -1, 0)]  # the points of a branch, its parent and its side
    held, name = 0, 0
    while stack:
        at, parent, side = stack.pop()
        x, sides = points[at], None
        if len(at) > leaf:
            away = x - x.mean(axis=0)
            normal = away[np.argmax((away**2).sum(axis=1))]
            offset = np.float32(normal @ x.mean(axis=0))
            for _ in range(8):
                high = x @ normal > offset
                if high.all() or not high.any():
                    break
                c0, c1 = x[~high].mean(axis=0), x[high].mean(axis=0)
                normal, offset = c1 - c0, np.float32((c1 @ c1 - c0 @ c0) / 2)
            sides = x @ normal > offset
        if sides is None or sides.all() or not sides.any():
            if held and held + len(at) > shard:
                held, name = 0, name + 1
            held += len(at)
            child = -1 - name
        else:
            child = len(nodes)
            nodes.append([normal, offset, 0, 0])
            stack += [(at[sides], child, 3), (at[~sides], child, 2)]
        if parent >= 0:
            nodes[parent][side] = child
    return [tuple(x) for x in nodes]


def _fall(points: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """The shard of each point."""
    out = np.zeros(len(points), dtype=np.int32)
    stack = [(0, np.arange(len(points)))] if nodes else []
    while stack:
        k, at = stack.pop()
        high = points[at] @ nodes[k][0] > nodes[k][1]
        for child, some in ((nodes[k][2], at[~high]), (nodes[k][3], at[high])):
            if child < 0:
                out[some] = -1 - child
            elif len(some):
                stack.append((child, some))
    return out


def dealt(bags: DataFrame, idf: np.ndarray, n: int, mean: float, shard_docs: int, sample: int = 20_000) -> DataFrame:
    """(shard, part, rest, id, n_tokens, bag): the first three name the shard of each document."""
    if n <= shard_docs:
        return bags.select(F.lit(0).alias("shard"), F.lit(0).alias("part"), F.lit(0).alias("rest"), "id", "n_tokens", "bag")
    drawing = bags.select("n_tokens", "bag", F.xxhash64("id", "bag").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, 1.2 * sample / n) * (1 << 30)))  # else every partition would send as many
    some = drawing.orderBy("h", "n_tokens", "bag").limit(sample).toArrow()
    drawn = [_postings(size, data, idf, mean) for size, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
    axes = _axes(drawn[:4000])
    share = shard_docs * len(drawn) / n
    nodes = _tree(_coordinates(drawn, axes), max(8.0, share / 4), share)
    fitted = bags.sparkSession.sparkContext.broadcast((axes, nodes))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        axes, nodes = fitted.value
        points = _coordinates([_postings(size, data, idf, mean) for size, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], axes)
        return pa.RecordBatch.from_arrays([pa.array(_fall(points, nodes)), *batch.columns], names=["shard", "id", "n_tokens", "bag"])

    rows = materialize(arrow_map(bags.select("id", "n_tokens", "bag"), per_batch, "shard int, id string, n_tokens int, bag binary"), "dealt")
    for column, by, key in (("part", ["shard"], "bag"), ("rest", ["shard", "part"], "id")):
        crowded = rows.groupBy(*by).count().where(F.col("count") > 1.5 * shard_docs).select(*by, F.ceil(F.col("count") / shard_docs).alias("split"))  # few: each has many documents
        rows = rows.join(F.broadcast(crowded), by, "left").withColumn(column, F.pmod(F.xxhash64(key), F.coalesce("split", F.lit(1))).cast("int")).drop("split")
    return rows.select("shard", "part", "rest", "id", "n_tokens", "bag")


class InvertedIndex:
    """Postings of a shard, by token; those of tokens that many of its documents hold are kept as rows of a matrix."""

    BLOCK = 256

    def __init__(self, postings: list[bytes]):
        self.n = len(postings)
        both = [_terms(p) for p in postings]
        docs = np.repeat(np.arange(self.n), [len(t) for t, _ in both])
        term = np.concatenate([t for t, _ in both]) if both else np.empty(0, dtype=np.int64)
        weight = np.concatenate([w for _, w in both]) if both else np.empty(0, dtype=np.float32)
        held = np.bincount(term, minlength=IDS)
        frequent = held > max(8, self.n // 12)
        place = np.cumsum(frequent) - 1
        many = frequent[term]
        self.impact = np.zeros((int(frequent.sum()), self.n), dtype=np.float32)
        self.impact[place[term[many]], docs[many]] = weight[many]
        self.docs, self.weight, term = docs[~many], weight[~many].astype(np.float64), term[~many]
        self.terms = np.split(term, np.searchsorted(self.docs, np.arange(1, self.n))) if self.n else []
        order = np.argsort(term, kind="stable")
        self.docs, self.weight = self.docs[order], self.weight[order]
        self.start = np.searchsorted(term[order], np.arange(IDS + 1))
        self.blocks: dict[int, np.ndarray] = {}

    def scores(self, doc: int) -> np.ndarray:
        """BM25 scores of all documents of the shard for all terms of one."""
        k, row = divmod(doc, self.BLOCK)
        if k not in self.blocks:
            self.blocks[k] = (self.impact[:, k * self.BLOCK : (k + 1) * self.BLOCK] > 0).astype(np.float32).T @ self.impact
        t = self.terms[doc]
        s, n = self.start[t], self.start[t + 1] - self.start[t]
        at = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.blocks[k][row] + np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n)


def pack(sizes: np.ndarray, index: InvertedIndex, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers as lists of (document, first token, tokens)."""
    full = [[(d, k * capacity, capacity)] for d in range(len(sizes)) for k in range(int(sizes[d]) // capacity)]
    rest = sizes % capacity
    first = sizes - rest
    unused = rest > 0
    waiting: list[tuple[int, int]] = sorted((int(rest[d]), d) for d in np.nonzero(unused)[0])
    containers = []

    def take(d: int) -> None:
        unused[d] = False
        del waiting[bisect_right(waiting, (int(rest[d]), d)) - 1]

    while waiting:
        _, seed = waiting[-1]
        take(seed)
        held, room = [seed], capacity - int(rest[seed])
        if room and waiting and waiting[0][0] <= room:
            s = index.scores(seed)
            s[~unused | (rest > room)] = 0
            near = np.nonzero(s)[0]
            for d in near[np.argsort(-s[near], kind="stable")].tolist():
                if rest[d] <= room:
                    take(d)
                    held.append(d)
                    room -= int(rest[d])
                    if not waiting or waiting[0][0] > room:
                        break
            while room and waiting and waiting[0][0] <= room:
                size, d = waiting[bisect_right(waiting, (room, len(sizes))) - 1]
                take(d)
                held.append(d)
                room -= size
        containers.append([(d, int(first[d]), int(rest[d])) for d in held])
    return full + containers


def packed(df: DataFrame, id_col: str, text_col: str, capacities: dict[str, int], shard_docs: int = 2000, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_name, container, id, first_token, n_tokens): where each part of each document went, for every capacity."""
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    bags = materialize(token_bags(df, id_col, text_col, vocabulary), "bags")
    frequency, n, mean = _frequencies(bags)
    if not n:
        return df.sparkSession.createDataFrame([], "pack_name string, container string, id string, first_token int, n_tokens int")
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))

    def per_shard(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["id", "n_tokens"], kind="stable").reset_index(drop=True)
        index, sizes, ids = InvertedIndex([_postings(size, data, idf, mean) for size, data in zip(shard["n_tokens"], shard["bag"])]), shard["n_tokens"].to_numpy().astype(np.int64), shard["id"].tolist()
        out: list[tuple] = []
        for name, capacity in capacities.items():
            for c, parts in enumerate(pack(sizes, index, capacity)):
                label = f"{name}-{shard['shard'].iat[0]}.{shard['part'].iat[0]}.{shard['rest'].iat[0]}-{c}"
                out += [(name, label, ids[d], a, k) for d, a, k in parts]
        return pd.DataFrame(out, columns=["pack_name", "container", "id", "first_token", "n_tokens"])

    # a task takes whole shards, of bounded size; their number grows with the collection
    return dealt(bags, idf, n, mean, shard_docs).groupBy("shard", "part", "rest").applyInPandas(per_shard, "pack_name string, container string, id string, first_token int, n_tokens int")


def similarity_report(placed: DataFrame, df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_name, containers, similarity, random_similarity): how alike the documents of a container are, against random containers.

    Similarity is the mean cosine of the BM25 impacts of two documents of a
    container, over all containers that hold two or more; random ones are as many
    and get their documents by a hash.
    """
    bags = materialize(token_bags(df, id_col, text_col, vocabulary), "bags")
    frequency, n, mean = _frequencies(bags)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))

    def alike(group: pd.DataFrame) -> pd.DataFrame:
        total, m = np.zeros(IDS, dtype=np.float32), len(group)
        for size, data in zip(group["n_tokens"], group["bag"]):
            ids, w = _terms(_postings(size, data, idf, mean))
            total[ids] += w / max(float(np.linalg.norm(w)), 1e-9)
        mates = (float(total @ total) - m) / (m * (m - 1)) if m > 1 else None
        return pd.DataFrame({"pack_name": [group["pack_name"].iat[0]], "kind": [group["kind"].iat[0]], "mates": [mates]})

    counts = placed.groupBy("pack_name").agg(F.count_distinct("container").alias("containers"))
    homes = placed.select("pack_name", "container", "id").distinct().join(F.broadcast(counts), "pack_name")
    drawn = homes.select("pack_name", "id", "containers").distinct().withColumn("container", F.pmod(F.xxhash64("id", "pack_name"), F.col("containers")).cast("string"))
    both = homes.select("pack_name", "id", "containers", "container").withColumn("kind", F.lit("packed")).unionByName(drawn.withColumn("kind", F.lit("random"))).join(bags, "id")
    rows = both.groupBy("pack_name", "kind", "container").applyInPandas(alike, "pack_name string, kind string, mates double")
    means = rows.groupBy("pack_name").pivot("kind", ["packed", "random"]).agg(F.avg("mates"))
    return means.join(counts, "pack_name").select("pack_name", "containers", F.col("packed").alias("similarity"), F.col("random").alias("random_similarity"))


def fill_report(placed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(pack_name, capacity, containers, tokens, filled): the share of the space that is used."""
    spark = placed.sparkSession
    sizes = spark.createDataFrame(list(capacities.items()), "pack_name string, capacity int")
    sums = placed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return sums.join(sizes, "pack_name").select("pack_name", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))
