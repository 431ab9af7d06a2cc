"""Search and answers as services over an index; embedding and generation are passed in."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.providers import HashingEmbedder
from corpusloom.operators import answers, search


class Unavailable(RuntimeError):
    """A provider or an index cannot be used now."""


def retried(operation: Callable, attempts: int = 3, delay: float = 1.0, never: tuple = (), sleep: Callable[[float], None] = time.sleep):
    """Call until it succeeds; the wait grows with each attempt, and errors named in ``never`` are raised at once."""
    for n in range(1, attempts + 1):
        try:
            return operation()
        except never:
            raise
        except Exception:
            if n == attempts:
                raise
            sleep(delay * n)


@dataclass(frozen=True)
class Settings:
    """What a service needs to know; values out of range are refused."""

    dim: int = 64
    top_k: int = 10
    min_score: float | None = None
    least_sources: int = answers.LEAST_SOURCES

    def __post_init__(self):
        if self.dim < 1 or not 1 <= self.top_k <= 20 or self.least_sources < 1:
            raise ValueError("a setting is out of range")


class SearchService:
    """Text queries against a table of points (point_id, chunk_id, karar_id, vector and metadata)."""

    def __init__(self, spark: SparkSession, points: DataFrame, settings: Settings = Settings(), embedder=None):
        self.spark, self.points, self.settings = spark, points, settings
        self.embedder = embedder or HashingEmbedder(settings.dim)

    def search(self, query: str, top_k: int | None = None, min_score: float | None = None, **filters) -> DataFrame:
        """(rank, karar_id, chunk_id, score): the best hit of each decision, filtered before and cut by the raw score."""
        k = self.settings.top_k if top_k is None else top_k
        least = self.settings.min_score if min_score is None else min_score
        text = search.check_request(query, k, least)
        pool = self.points.where(search.metadata_filter(**filters))
        vector = self.embedder.embed([text])[0]
        asked = self.spark.createDataFrame([("query", vector)], "chunk_id string, vector array<double>")
        hits = search.knn(asked, pool.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")), "chunk_id", "vector", min(search.OVERFETCH * k, search.MOST), self.settings.dim, least)
        found = hits.withColumnRenamed("item_id", "chunk_id").drop("rank").join(pool.select("chunk_id", "karar_id").distinct(), "chunk_id")
        best = search.unique_decisions(found, self.spark.createDataFrame([("query", k)], "query_id string, top_k int"), "query_id", "score", "chunk_id", "karar_id")
        return best.select("rank", "karar_id", "chunk_id", F.round("score", 6).alias("score"))

    def health(self) -> dict:
        return {"points": self.points.count(), "dim": self.settings.dim}


def extract(query: str, sources: list[tuple[str, str]]) -> str:
    """The default generator: the first sentence of each source with its label."""
    lines = [f"{' '.join(text.split())[:200]} [{label}]" for label, text in sources]
    return "Değerlendirme\n" + "\n".join(lines) + "\n\nSınırlamalar\n\n" + answers.CLOSING


class AnswerService:
    """Sources to a checked answer: too few sources give none, a faulty answer is asked for once more, then refused."""

    def __init__(self, service: SearchService, texts: DataFrame, generate: Callable[[str, list], str] = extract):
        self.service, self.texts, self.generate = service, texts, generate

    def _faults(self, answer: str, labels: list[str]) -> list[str]:
        row = self.service.spark.createDataFrame([(answer, labels)], "a string, l array<string>")
        return row.select(answers.answer_faults(F.col("a"), F.col("l"))).first()[0]

    def answer(self, query: str, **kw) -> dict:
        """{answer, sources, attempts}; the answer is null where there are too few sources."""
        hits = self.service.search(query, **kw).join(self.texts, "chunk_id").withColumn("query_id", F.lit(0))
        rows = answers.context_prefix(hits, "query_id", "rank", F.col("chunk_metni")).orderBy("rank").select("label", "chunk_id", "karar_id", "chunk_metni").collect()  # at most 20 sources
        sources = [(r["label"], r["chunk_metni"]) for r in rows]
        if len(sources) < self.service.settings.least_sources:
            return {"answer": None, "sources": [r["chunk_id"] for r in rows], "attempts": 0}
        faults: list[str] = []
        for attempt in (1, 2):
            asked = query if not faults else f"{query}\n\nÖnceki cevabın kusurları: {', '.join(faults)}"
            text = self.generate(asked, sources)
            faults = self._faults(text, [s[0] for s in sources])
            if not faults:
                return {"answer": text.strip(), "sources": [r["chunk_id"] for r in rows], "attempts": attempt}
        raise Unavailable(f"no valid answer: {', '.join(faults)}")


CASES = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("hukuk_alani", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("expected_decision_ids", T.ArrayType(T.StringType())),
        T.StructField("expected_chamber", T.StringType()),
        T.StructField("rag_test", T.BooleanType()),
    ]
)


def load_cases(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """The cases of an evaluation file, which must be of both kinds, unique and consistent."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    if set(held) != {"version", "description", "cases"} or any(set(c) != {x.name for x in CASES} for c in held["cases"]):
        raise ValueError("an evaluation file has other keys")
    rows = held["cases"]
    inside = [c for c in rows if c["expected_decision_ids"]]
    wrong = [c["case_id"] for c in rows if bool(c["expected_decision_ids"]) != bool(c["expected_chamber"]) or not isinstance(c["rag_test"], bool) or c["rag_test"] and not c["expected_decision_ids"]]
    if len(rows) < least or not inside or len(inside) == len(rows) or len({c["case_id"] for c in rows}) != len(rows) or wrong:
        raise ValueError(f"the cases are too few, of one kind, repeated or inconsistent {wrong}")
    return spark.createDataFrame([tuple(c[x.name] for x in CASES) for c in rows], CASES)
