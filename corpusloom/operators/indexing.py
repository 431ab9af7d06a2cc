"""Resumable indexing of chunks: checked payloads, batches that are never skipped, a state that refuses other settings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions.providers import embedded
from corpusloom.operators.index import BadPoints, IndexMismatch, VectorIndex
from corpusloom.operators.records import violations
from corpusloom.storage import publish_file, read_file

REQUIRED = ("id", "karar_id", "daire", "karar_turu", "baslik", "chunk_metni", "chunk_metni_sha256", "veri_kalite_durumu", "kaynak")
OPTIONAL = ("esas_no", "karar_no", "karar_tarihi")
PAYLOAD = ("chunk_id", "karar_id", "chunk_sirasi", "toplam_chunk", "daire", "karar_turu", *OPTIONAL, "baslik", "chunk_metni", "chunk_metni_sha256", "veri_kalite_uyarilari", "veri_kalite_durumu", "metin_2000_karakter_sinirinda", "kaynak")
SOURCE_COLUMNS = ("kaynak_url", "kaynak_lisans", "kaynak_kayit_id")


def payload_rules(columns: list[str]) -> dict:
    """The rules of a chunk that is to be indexed; a rule that is null is broken."""
    filled = lambda c: F.trim(F.col(c).cast("string")) != ""
    rules = {c: filled(c) for c in (*REQUIRED, *(c for c in SOURCE_COLUMNS if c in columns))}
    rules |= {c: F.col(c).isNull() | filled(c) for c in OPTIONAL}
    rules["chunk_sirasi"] = F.col("chunk_sirasi") >= 1
    rules["toplam_chunk"] = F.col("toplam_chunk") >= F.col("chunk_sirasi")
    rules["veri_kalite_uyarilari"] = F.col("veri_kalite_uyarilari").isNotNull() & ~F.exists("veri_kalite_uyarilari", lambda w: F.coalesce(F.trim(w), F.lit("")) == "")
    rules["metin_2000_karakter_sinirinda"] = F.col("metin_2000_karakter_sinirinda").isNotNull()
    rules["digest"] = F.sha2("chunk_metni", 256) == F.col("chunk_metni_sha256")
    rules["length"] = F.length("chunk_metni") == F.col("karakter_sayisi")
    return rules


def payloads(chunks: DataFrame, model: str, dim: int, schema_version: str = "1.0") -> tuple[DataFrame, DataFrame]:
    """(points without vectors, rejected): the projection that is indexed, and (id, violated) of the chunks that break a rule."""
    rules = payload_rules(chunks.columns)
    good = F.lit(True)
    for rule in rules.values():
        good = good & F.coalesce(rule, F.lit(False))
    kept = [F.col("id").alias("chunk_id") if c == "chunk_id" else F.col(c) for c in PAYLOAD] + [F.col(c) for c in SOURCE_COLUMNS if c in chunks.columns]
    points = chunks.where(good).select(X.point_id(F.col("id")).alias("point_id"), *kept, F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dimension"), F.lit(schema_version).alias("koleksiyon_sema_surumu"))
    return points, violations(chunks, ["id"], rules)


def source_samples(chunks: DataFrame, order_col: str) -> DataFrame:
    """The first, the middle and the last row in an order, of places 1, (n + 1) div 2 and n; ranks are taken within ranges."""
    n = chunks.count()
    wanted = sorted({1, (n + 1) // 2, n}) if n else []
    keys = chunks.select(order_col).repartitionByRange(F.col(order_col)).withColumn("part", F.spark_partition_id())
    sizes = dict(keys.groupBy("part").count().toLocalIterator())  # a row for each partition
    picks, before = [], 0
    for part in sorted(sizes):
        picks += [(part, w - before, w) for w in wanted if before < w <= before + sizes[part]]
        before += sizes[part]
    from pyspark.sql import Window as W

    places = chunks.sparkSession.createDataFrame(picks, "part int, at long, place long")
    ranked = keys.join(F.broadcast(places.select("part").distinct()), "part", "left_semi").withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(order_col)))
    return ranked.join(F.broadcast(places), ["part", "at"]).select("place", order_col)


class ResumableIndexing:
    """Index a stream of chunk files, batch by batch, and go on after any failure where it stopped.

    A batch is checked, embedded and upserted as a whole; upserts are by id, so a
    batch that is repeated changes nothing.  It is tried ``attempts`` times; each
    failure is written to ``failures``, and after the last one the run stops:
    no batch is skipped.  ``state.json`` holds the fingerprint of the settings;
    a run with others is refused.
    """

    def __init__(self, spark: SparkSession, path: str, index: VectorIndex, model: str, dim: int, provider=None, attempts: int = 3, wait: float = 0.0, files_per_batch: int = 1):
        self.spark, self.path, self.index, self.provider = spark, path.rstrip("/"), index, provider
        self.model, self.dim, self.attempts, self.wait, self.files = model, dim, attempts, wait, files_per_batch
        self.fingerprint = {"model": model, "dim": dim, "files_per_batch": files_per_batch, "index": index.path}

    def state(self) -> dict:
        held = read_file(self.spark, f"{self.path}/state.json")
        if held is None:
            return {"fingerprint": self.fingerprint, "batches": 0, "indexed": 0, "failed_attempts": 0, "completed": False}
        state = json.loads(held)
        if state["fingerprint"] != self.fingerprint:
            raise IndexMismatch(f"the run was begun with {state['fingerprint']}, not {self.fingerprint}")
        return state

    def _save(self, state: dict) -> None:
        publish_file(self.spark, f"{self.path}/state.json", json.dumps(state, sort_keys=True).encode())

    def _batch(self, chunks: DataFrame, number: int, before: Callable[[int], None] | None) -> None:
        for attempt in range(1, self.attempts + 1):
            try:
                if before:
                    before(number)
                points, rejected = payloads(chunks, self.model, self.dim)
                bad = rejected.limit(3).collect()  # three for the message
                if bad:
                    raise BadPoints("; ".join(f"{r['id']}: {', '.join(r['violated'])}" for r in bad))
                self.index.upsert(embedded(points.dropDuplicates(["point_id"]), "chunk_metni", self.provider))
                state = self.state()
                if number >= state["batches"]:
                    self._save({**state, "batches": number + 1, "indexed": state["indexed"] + points.select("point_id").distinct().count()})
                return
            except Exception as x:
                row = [(number, attempt, type(x).__name__, str(x)[:500])]
                self.spark.createDataFrame(row, "batch long, attempt int, error_type string, error string").coalesce(1).write.mode("append").json(f"{self.path}/failures")
                self._save({**self.state(), "failed_attempts": self.state()["failed_attempts"] + 1})
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait * attempt)

    def run(self, folder: str, schema: T.StructType, before: Callable[[int], None] | None = None) -> dict:
        """Index what is in the folder now; ``before`` is called ahead of each attempt."""
        self.index.ensure()
        self._save({**self.state(), "completed": False})
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files).parquet(folder)
        q = stream.writeStream.foreachBatch(lambda rows, number: self._batch(rows, number, before)).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        state = {**self.state(), "completed": True}
        self._save(state)
        return state

    def failures(self) -> DataFrame:
        return self.spark.read.schema("batch long, attempt int, error_type string, error string").json(f"{self.path}/failures")
