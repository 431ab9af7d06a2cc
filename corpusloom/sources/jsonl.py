"""Strict JSON Lines: every bad line is known by file and number, and nothing is guessed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.storage import publish_file, read_file, remove


class BadLines(ValueError):
    """The input holds lines that are no record."""


_PLACE = ("_file", "_block", "_row")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, ``_line`` with the text of lines that are no object of that schema, else null, and where each line stands.

    Lines that are not valid UTF-8 are bad; a byte order mark at the start of a
    line is none of it.  ``_file``, ``_block`` and ``_row`` give the place, from
    which :func:`bad_lines` makes line numbers.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.is_valid_utf8("value").alias("_utf8"))
    raw = raw.withColumn("value", F.when(F.col("_utf8"), F.regexp_replace("value", "^\\x{FEFF}", "")).otherwise(F.make_valid_utf8("value")))
    bad = "_bad"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    x = raw.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    wrong = ~F.col("_utf8") | F.col("r").isNull() | F.col(f"r.{bad}").isNotNull() | (F.trim("value") == "") | ~F.startswith(F.trim("value"), F.lit("{"))
    return x.select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields), F.when(wrong, F.col("value")).alias("_line"), *_PLACE)


def bad_lines(rows: DataFrame) -> DataFrame:
    """(file, number, line) of the lines that are no record; lines are counted by block, and blocks are few."""
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_file", "_block", "first", before.alias("before"))
    bad = rows.where(F.col("_line").isNotNull()).select("_line", *_PLACE).join(starts, ["_file", "_block"])
    return bad.select(F.col("_file").alias("file"), (F.col("before") + F.col("_row") - F.col("first") + 1).alias("number"), F.col("_line").alias("line"))


def read_strict(spark: SparkSession, path: str, schema: T.StructType, expected_rows: int | None = None, unique: str | None = None) -> DataFrame:
    """The records; a blank or broken line, another number of rows than expected, or an id that is null or there twice, stops the job."""
    rows = read_lines(spark, path, schema)
    bad = bad_lines(rows).orderBy("file", "number").limit(3).collect()  # three lines for the message
    if bad:
        raise BadLines("; ".join(f"{r['file'].rpartition('/')[2]}, line {r['number']}: {r['line'][:80]!r}" for r in bad))
    rows = rows.drop("_line", *_PLACE)
    if expected_rows is not None and (n := rows.count()) != expected_rows:
        raise BadLines(f"{n} rows instead of {expected_rows}")
    if unique is not None:
        again = rows.groupBy(unique).count().where((F.col("count") > 1) | F.col(unique).isNull()).limit(3).collect()
        if again:
            raise BadLines(f"{unique} is null or there twice: {', '.join(str(r[0]) for r in again)}")
    return rows


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, bad lines by file and number), for runs that set bad lines aside instead of stopping."""
    return rows.where(F.col("_line").isNull()).drop("_line", *_PLACE), bad_lines(rows)


def select_in_order(rows: DataFrame, id_col: str, ids: list) -> DataFrame:
    """The rows of the given ids, with their place in the list; a missing id stops the job.

    The list is the caller's and is sent to the rows.
    """
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("place", T.IntegerType())]))
    found = rows.join(F.broadcast(wanted), id_col)
    missing = wanted.join(found.select(id_col), id_col, "left_anti").limit(3).collect()
    if missing:
        raise KeyError(f"no row has the id {', '.join(str(r[0]) for r in missing)}")
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of each file, read in pieces of a megabyte."""
    names = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    local = names.where(~F.startswith("path", F.lit("file:"))).limit(1).count() == 0
    if not local:  # other stores hand over a file as a whole
        return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def run(batches):
        import hashlib
        from urllib.parse import unquote, urlparse

        import pyarrow as pa

        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                with open(unquote(urlparse(p).path), "rb") as f:
                    out.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["path", "size", "sha256"])

    return names.mapInArrow(run, "path string, size long, sha256 string")


def write_atomic(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Publish a table: a new version is written beside the old one, then a pointer file is replaced, which is atomic.

    Readers (:func:`read_published`) see the old version or the new one, never a
    part; after an error the old one stays.  The version before is kept for
    readers that are at it, older ones go.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    held = json.loads(read_file(spark, f"{path}/current.json") or b"{}")
    version = f"v-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).save(f"{path}/{version}")
    except Exception:
        remove(spark, f"{path}/{version}")
        raise
    publish_file(spark, f"{path}/current.json", json.dumps({"version": version, "format": fmt, "before": held.get("version")}).encode())
    if held.get("before"):
        remove(spark, f"{path}/{held['before']}")


def read_published(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version of a table that :func:`write_atomic` published."""
    held = read_file(spark, f"{path.rstrip('/')}/current.json")
    if held is None:
        raise FileNotFoundError(path)
    at = json.loads(held)
    reader = spark.read.format(at["format"])
    return (reader.schema(schema) if schema else reader).load(f"{path.rstrip('/')}/{at['version']}")
