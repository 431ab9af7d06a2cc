"""Record operators: validation, identity de-duplication, quality labels, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as X


def once(df: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """One row for each id: the first by ``order``, which must tell rows apart."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(id_col).orderBy(*order))).where("_r = 1").drop("_r")


def with_identity(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with an array of the cleaned identity columns; null if any is missing."""
    parts = [X.missing_as_null(F.col(c)) for c in cols]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return df.withColumn("identity", F.when(known, F.array(*parts)))


def identity_groups(df: DataFrame, id_col: str, text_col: str, date_col: str, cols: list[str]) -> DataFrame:
    """``df`` with its rank within its identity (1 is kept) and the kept row's id and length.

    The longest text is kept, then one with a date, then the least id; a record
    whose identity is incomplete is never a duplicate and always has rank 1.
    The window sees ids and lengths only; no text is shuffled twice.
    """
    rows = with_identity(df, cols)
    n = F.coalesce(F.length(text_col), F.lit(0))
    key = F.coalesce(F.sha2(F.array_join("identity", "\x1f"), 256), F.concat(F.lit("id:"), F.col(id_col)))
    w = W.partitionBy("identity_key").orderBy(F.desc("text_length"), F.col("has_date").desc(), F.col(id_col))
    rows = rows.withColumns({"identity_key": key, "text_length": n, "has_date": X.missing_as_null(F.col(date_col)).isNotNull()})
    return rows.withColumns({"identity_rank": F.row_number().over(w), "kept_id": F.first(id_col).over(w), "kept_length": F.first("text_length").over(w)})


def duplicate_audit(groups: DataFrame, id_col: str) -> DataFrame:
    """The dropped records with the record that stands for them."""
    return groups.where("identity_rank > 1").select(F.col(id_col).alias("id"), F.col("kept_id").alias("duplicate_of_id"), F.lit("same_identity").alias("reason"), F.col("text_length").alias("dropped_text_length"), F.col("kept_length").alias("kept_text_length"))


def quality_labels(df: DataFrame, id_col: str, text_col: str, flag_col: str, number_cols: list[str]) -> DataFrame:
    """Ordered warnings of each record and its status; the count of equal texts is a partial aggregate joined back."""
    hashed = df.withColumn("text_sha256", F.sha2(F.col(text_col), 256))
    counts = hashed.groupBy("text_sha256").agg(F.count("*").alias("same_text_count"))
    rows = hashed.join(counts, "text_sha256", "left")
    checks = [F.when(X.missing_as_null(F.col(c)).isNull(), F.lit(f"eksik_{c}")) for c in number_cols]
    checks += [F.when(F.col(flag_col), F.lit("kaynak_metin_2000_karakter_sinirinda")), F.when(F.col("same_text_count") > 1, F.lit("ayni_metin_farkli_kararlarda"))]
    rows = rows.withColumn("warnings", F.array_compact(F.array(*checks)))
    return rows.select(F.col(id_col).alias("id"), "text_sha256", F.length(text_col).alias("text_length"), F.coalesce("same_text_count", F.lit(1)).alias("same_text_count"), "warnings", F.when(F.size("warnings") > 0, "uyarili").otherwise("gecerli").alias("status"))


def violations(df: DataFrame, key_cols: list[str], rules: dict[str, Column]) -> DataFrame:
    """The rows that break a rule, with the names of the broken rules; a rule that is null is broken."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.withColumn("violated", found).where(F.size("violated") > 0).select(*key_cols, "violated")


def fail_if_any(bad: DataFrame, what: str) -> None:
    """Stop the job if there is a violation; nothing has been written then."""
    first = bad.limit(3).toJSON().collect() if hasattr(bad, "rdd") else []
    if first:
        raise ValueError(f"{what}: {'; '.join(first)}")


def order_free_digest(df: DataFrame) -> DataFrame:
    """One SHA-256 for the content of a table, whatever the order of its rows.

    Row digests are summed in 16 parts of 32 bits, so any number of rows is
    aggregated in constant space.
    """
    d = df.select(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    return d.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws("|", "rows", *(f"s{i}" for i in range(8))), 256).alias("digest"))
