"""A versioned vector index on Parquet: immutable runs of changes, and a pointer to those that count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import vectors as V
from corpusloom.operators.records import violations
from corpusloom.storage import publish_file, read_file, remove


class IndexMismatch(ValueError):
    """The stored index was made with other settings."""


class BadPoints(ValueError):
    """A batch holds points that the index cannot take."""


class VectorIndex:
    """Upsert by id (the latest row wins), delete, count and point lookups.

    An upsert or delete writes a run of its own rows only; readers merge the
    runs, newest first, and a run is read only for ids that no newer one holds.
    More than ``max_runs`` runs are compacted into one.  A pointer file, replaced
    atomically, names the runs, so readers see whole versions only; runs that no
    pointer names any more are kept for ``keep`` further versions.  If the
    settings name ``dim`` and ``vector_col``, every vector is checked before
    anything is written.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "point_id", vector_col: str | None = None, max_runs: int = 4, keep: int = 1, **settings):
        self.spark, self.path, self.id_col, self.vector_col, self.settings = spark, path.rstrip("/"), id_col, vector_col, settings
        self.max_runs, self.keep = max_runs, keep

    def _read_json(self, name: str):
        held = read_file(self.spark, f"{self.path}/{name}")
        return None if held is None else json.loads(held)

    def _write_json(self, name: str, value) -> None:
        publish_file(self.spark, f"{self.path}/{name}", json.dumps(value, sort_keys=True).encode())

    def ensure(self) -> dict:
        """Create the index, or check that it has these settings."""
        held = self._read_json("settings.json")
        if held is None:
            self._write_json("settings.json", self.settings)
            return self.settings
        if held != self.settings:
            raise IndexMismatch(f"the index has {held}, not {self.settings}")
        return held

    def _pointer(self) -> dict:
        return self._read_json("current.json") or {"version": 0, "runs": [], "old": []}

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _merged(self, runs: list[str]) -> DataFrame | None:
        """Runs from the newest to the oldest; of an older one only ids that no newer one holds."""
        out, seen = None, None
        for name in reversed(runs):
            run = self._run(name)
            ids = run.select(self.id_col)
            left = run if seen is None else run.join(seen, self.id_col, "left_anti").select(*run.columns)
            out = left if out is None else out.unionByName(left, allowMissingColumns=True)
            seen = ids if seen is None else seen.unionByName(ids)
        return None if out is None else out.where("not _deleted").drop("_deleted")

    def current(self) -> DataFrame | None:
        return self._merged(self._pointer()["runs"])

    def _publish(self, rows: DataFrame) -> None:
        pointer = self._pointer()
        runs = [*pointer["runs"], self._write(rows)]
        old = [x for x in pointer["old"] if x["until"] + self.keep > pointer["version"]]
        if len(runs) > self.max_runs:
            merged = self._merged(runs)
            old += [{"run": r, "until": pointer["version"]} for r in runs]
            runs = [self._write(merged.withColumn("_deleted", F.lit(False)))]
        self._write_json("current.json", {"version": pointer["version"] + 1, "runs": runs, "old": old})
        for x in pointer["old"]:
            if x not in old:
                remove(self.spark, f"{self.path}/{x['run']}")

    def _write(self, rows: DataFrame) -> str:
        name = f"r-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _check(self, rows: DataFrame) -> None:
        rules = {"id": F.col(self.id_col).isNotNull()}
        if self.vector_col and "dim" in self.settings:
            rules["vector"] = V.is_valid(F.col(self.vector_col), self.settings["dim"])
        bad = violations(rows, [self.id_col], rules).limit(3).collect()  # three for the message
        if bad:
            raise BadPoints("; ".join(f"{r[0]}: {', '.join(r[1])}" for r in bad))

    def upsert(self, rows: DataFrame, order_col: str | None = None) -> None:
        """Add or replace points; of several rows with one id the latest by ``order_col`` counts, else they are refused."""
        self._check(rows)
        if order_col is None:
            if rows.groupBy(self.id_col).count().where("count > 1").limit(1).count():
                raise BadPoints("a batch holds an id twice")
        else:
            rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(self.id_col).orderBy(F.desc(order_col)))).where("_r = 1").drop("_r")
        self._publish(rows.withColumn("_deleted", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        if self._pointer()["runs"]:
            self._publish(ids.select(self.id_col).distinct().withColumn("_deleted", F.lit(True)))

    def get(self, point_id: str) -> DataFrame:
        """The point of an id; the filter reaches the scan of every run."""
        return self.current().where(F.col(self.id_col) == point_id)

    def count(self) -> int:
        held = self.current()
        return 0 if held is None else held.count()
