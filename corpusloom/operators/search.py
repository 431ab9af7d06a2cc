"""Exact vector search, ranking and the de-duplication of hits by decision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OVERFETCH, MOST = 5, 100


#: Queries whose vectors are sent to the items; more of them are met in blocks.
MOST_SENT = 20_000


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a valid vector, these vectors at length one)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.nonzero(sizes == dim)[0]
    m = np.asarray(column.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        norms = np.sqrt((m * m).sum(1))
    fine = np.isfinite(norms) & (norms > 0)
    return rows[fine], m[fine] / norms[fine, None]


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is among the ``k`` best of each row, all that ties with the last place included."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        return np.nonzero((scores >= least[:, None]) & (scores > -2))
    return np.nonzero(scores > -2)


def _met(asked, wanted: np.ndarray, names, items: np.ndarray, k: int):
    """Rows (query, item, score) of the ``k`` best items of each query, a query itself and lesser ties left out."""
    out_q, out_i, out_s = [], [], []
    for at in range(0, len(wanted), 512):
        scores = np.round(wanted[at : at + 512] @ items.T, 12)
        scores[asked[at : at + 512, None] == names[None, :]] = -9
        r, c = _best(scores, k)
        order = np.lexsort((names[c], -scores[r, c], r))
        r, c = r[order], c[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out_q.append(asked[at + r[keep]])
        out_i.append(names[c[keep]])
        out_s.append(scores[r[keep], c[keep]])
    return tuple(np.concatenate(x) for x in (out_q, out_i, out_s)) if out_q else (asked[:0], names[:0], np.empty(0))


def _names(column) -> np.ndarray:
    """Ids as an array that compares element by element."""
    plain = column.to_pylist()
    return np.array(plain, dtype=object if plain and isinstance(plain[0], str) else None)


def knn(queries: DataFrame, items: DataFrame, id_col: str, vec_col: str, k: int, dim: int, min_score: float | None = None, item_rows: int = 65_536, most_sent: int = MOST_SENT) -> DataFrame:
    """(query_id, item_id, score, rank): the exact ``k`` nearest items of each query by cosine.

    Queries are a stated set.  At most ``most_sent`` of them are sent to the items,
    which stay where they are: every partition returns its ``k`` best for each
    query, which are then merged.  More queries are met in blocks, each of which
    reads the items again in place.  Ties go to the lesser id; invalid vectors
    and null ids take no part; a query is no hit of itself.
    """
    spark = items.sparkSession
    q = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    x = items.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    kind, plain = queries.schema[id_col].dataType.simpleString(), pa.string() if queries.schema[id_col].dataType.simpleString() == "string" else pa.int64()
    schema = f"query_id {kind}, item_id {kind}, score double"

    def block(rows: pa.Table) -> DataFrame:
        at, wanted = _unit(rows.column("v"), dim)
        sent = spark.sparkContext.broadcast((_names(rows.column("id").take(pa.array(at))), wanted))

        def run(batches):
            asked, wanted = sent.value
            held, size = [], 0

            def flush():
                names, vectors = np.concatenate([n for n, _ in held]), np.concatenate([v for _, v in held])
                out = _met(asked, wanted, names, vectors, k)
                return pa.RecordBatch.from_arrays([pa.array(out[0].tolist(), plain), pa.array(out[1].tolist(), plain), pa.array(out[2])], names=["query_id", "item_id", "score"])

            for batch in batches:
                good, v = _unit(batch.column(1), dim)
                if len(good) and len(asked):
                    held.append((_names(batch.column(0).take(pa.array(good))), v))
                    size += len(good)
                    if size >= item_rows:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

        return x.mapInArrow(run, schema)

    first = q.limit(most_sent + 1).toArrow()  # bounded
    if first.num_rows <= most_sent:
        found = block(first)
    else:
        parts = -(-q.count() // (most_sent // 2))  # a block holds half as many on average
        q = q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        found = None
        for p in range(parts):
            some = block(q.where(F.col("part") == p).drop("part").toArrow())
            found = some if found is None else found.unionByName(some)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(hits: DataFrame, query_col: str, score_col: str, id_col: str) -> DataFrame:
    """``hits`` with their rank by score, ties by id."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(query_col).orderBy(F.desc(score_col), id_col)))


def unique_decisions(hits: DataFrame, top_k: DataFrame, query_col: str, score_col: str, id_col: str, decision_col: str) -> DataFrame:
    """The first hit of each decision among the over-fetched candidates, ranked anew, as many as the query asks for.

    ``top_k`` has a row (query, top_k) for each query; candidates are the best
    ``min(5 * top_k, 100)`` hits, so a result can be shorter than ``top_k``.
    """
    best = hits.join(top_k, query_col)
    most = F.least(F.lit(OVERFETCH) * F.col("top_k"), F.lit(MOST))
    best = ranked(best, query_col, score_col, id_col).where(F.col("rank") <= MOST).where(F.col("rank") <= most)
    first = W.partitionBy(query_col, decision_col).orderBy("rank")
    best = best.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    again = W.partitionBy(query_col).orderBy("rank")
    return best.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= F.col("top_k"))


FILTER_FIELDS = ("karar_turu", "daire", "veri_kalite_durumu", "metin_2000_karakter_sinirinda")


def metadata_filter(**wanted):
    """A conjunction of equalities over the allowed fields; nulls are ignored, unknown fields and empty values refused."""
    unknown = set(wanted) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    out = F.lit(True)
    for name, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, str):
            value = " ".join(value.split())
            if not value or len(value) > 120:
                raise ValueError(f"{name} must have 1 to 120 characters")
        if name == "metin_2000_karakter_sinirinda" and not isinstance(value, bool):
            raise ValueError(f"{name} must be a boolean")
        out = out & (F.col(name) == value)
    return out


def check_request(query: str, top_k: int, min_score: float | None) -> str:
    """The normalised query of a valid request."""
    import unicodedata

    text = " ".join(unicodedata.normalize("NFC", query).replace(" ", " ").split())
    if not 10 <= len(text) <= 4000 or "\x00" in text or "�" in text:
        raise ValueError("a query has 10 to 4,000 characters")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 20:
        raise ValueError("top_k is a number from 1 to 20")
    if min_score is not None and not -1 <= min_score <= 1:
        raise ValueError("min_score is between -1 and 1")
    return text
