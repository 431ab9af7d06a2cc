"""Import of an outside corpus: projection with constants and derived columns, and the rules that reject a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.records import violations

SOURCE_LIMIT = 2000
COURT = "Yargıtay"


def _is_text(c: Column) -> Column:
    return (c != "") & ~X.has_bad_characters(c, "")


def import_records(df: DataFrame, source: str, url: str, licence: str, id_col: str = "_id", title_col: str = "title", text_col: str = "text", chamber_col: str = "kurul", case_col: str = "esas_no", decision_col: str = "karar_no", date_col: str = "tarih") -> tuple[DataFrame, DataFrame]:
    """(records, rejected): records of the import schema, and (id, violated) of those that break a rule.

    A dash stands for a missing number or date; null does not.  Whether a text
    stands at the source's limit is told before any cleaning.  Nothing is
    published where ``rejected`` has rows, unless the caller sets them aside.
    """
    name = lambda c: X.squeeze(X.nfc(F.col(c)))
    x = df.select(name(id_col).alias("id"), name(title_col).alias("baslik"), X.chamber(X.nfc(F.col(chamber_col))).alias("daire"), X.plain_text(F.col(text_col)).alias("karar_metni"), name(case_col).alias("_e"), name(decision_col).alias("_k"), name(date_col).alias("_d"))
    none = lambda c: F.when(F.col(c) != "-", F.col(c))
    rules = {
        "id": _is_text(F.col("id")),
        "title": _is_text(F.col("baslik")),
        "chamber": _is_text(F.col("daire")) & X.is_known_chamber(F.col("daire")),
        "text": (F.col("karar_metni") != "") & ~X.has_bad_characters(F.col("karar_metni"), "\n\t"),
        "case_no": (F.col("_e") == "-") | X.is_number(F.col("_e")),
        "decision_no": (F.col("_k") == "-") | X.is_number(F.col("_k")),
        "date": (F.col("_d") == "-") | X.is_date(F.col("_d")),
    }
    bad = violations(x, ["id"], rules)
    good = F.lit(True)
    for rule in rules.values():
        good = good & F.coalesce(rule, F.lit(False))
    records = x.where(good).select(
        "id", F.lit(COURT).alias("mahkeme"), "daire", X.decision_type(F.col("daire")).alias("karar_turu"), none("_e").alias("esas_no"), none("_k").alias("karar_no"), none("_d").alias("karar_tarihi"), "baslik", "karar_metni",
        (F.length("karar_metni") == SOURCE_LIMIT).alias("metin_2000_karakter_sinirinda"), F.lit(source).alias("kaynak"), F.lit(url).alias("kaynak_url"), F.lit(licence).alias("kaynak_lisans"), F.col("id").alias("kaynak_kayit_id"),
    )
    return records, bad


def import_report(records: DataFrame, rejected: DataFrame) -> DataFrame:
    """(measure, value): what was taken in, what was set aside and why."""
    n = records.agg(F.count("*").alias("records"), F.count_distinct("id").alias("unique_ids"), F.count_if("metin_2000_karakter_sinirinda").alias("at_limit"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("esas_no", "karar_no", "karar_tarihi")))
    out = n.unpivot([], [F.col(c) for c in n.columns], "measure", "value")
    kinds = records.groupBy(F.concat(F.lit("kind_"), F.col("karar_turu")).alias("measure")).agg(F.count("*").alias("value"))
    why = rejected.select(F.explode("violated").alias("rule")).groupBy(F.concat(F.lit("rejected_"), F.col("rule")).alias("measure")).agg(F.count("*").alias("value"))
    return out.unionByName(kinds).unionByName(why)
