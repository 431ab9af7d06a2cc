"""Incremental ingest: each micro-batch is checked, bad rows go to a dead-letter table, new ids to the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


class IncrementalTable:
    """A Parquet table that a stream appends to, once for each id.

    A batch is written into a folder of its own number, so that a batch that is
    repeated after a failure replaces its own output instead of adding to it.
    Ids that an earlier batch holds are left out by an anti join on the ids
    alone; no state grows in the stream itself.
    """

    def __init__(self, path: str, id_col: str, order: list[str], rules: dict[str, Column]):
        self.path, self.id_col, self.order, self.rules = path.rstrip("/"), id_col, order, rules

    def _earlier(self, spark, batch: int, schema) -> DataFrame:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").where(F.col("batch") < batch)

    def write(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in self.rules.items())))
        checked = rows.withColumn("_broken", broken)
        bad = checked.where(F.size("_broken") > 0).select(F.col(self.id_col).cast("string").alias("id"), F.array_join("_broken", ",").alias("error"))
        bad.write.mode("overwrite").parquet(f"{self.path}/failures/batch={batch}")
        good = checked.where(F.size("_broken") == 0).drop("_broken")
        good = good.withColumn("_r", F.row_number().over(W.partitionBy(self.id_col).orderBy(*self.order))).where("_r = 1").drop("_r")
        if batch:
            seen = self._earlier(spark, batch, rows.schema).select(self.id_col)
            good = good.join(seen, self.id_col, "left_anti").select(*rows.columns)
        good.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def rows(self, spark, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/rows").drop("batch")

    def failures(self, spark) -> DataFrame:
        return spark.read.schema("id string, error string").parquet(f"{self.path}/failures").select("id", "error")


def run_available(stream: DataFrame, table: IncrementalTable, checkpoint: str) -> None:
    """Take in what is there now and end; a later call goes on from the checkpoint."""
    q = stream.writeStream.foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
