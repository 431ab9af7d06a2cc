"""Cleaning as one job: cleaned records with their labels, the audit of dropped duplicates, and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import records as R
from corpusloom.storage import materialize

VERSION = "1.0"
#: What cleaning may do to a text; the two counts are of characters, the others 0 or 1.
ACTIONS = ("line_ends", "entities", "markup", "unicode_spaces", "zero_width", "composed", "layout", "label_quote")
NUMBERS = ("esas_no", "karar_no", "karar_tarihi")


def _did(before: str, after: str) -> Column:
    return F.coalesce((F.col(before) != F.col(after)).cast("int"), F.lit(0))


def cleaned_texts(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with its text cleaned and ``actions``, an array of how often each of :data:`ACTIONS` was taken.

    A null text stays null and takes no action.
    """
    kept = [c for c in df.columns if c != text_col]
    x = df.select(*kept, F.col(text_col).alias("_t0"), X.line_ends(F.col(text_col)).alias("_t1"))
    x = x.withColumns({"_t2": X.unescape_entities(F.col("_t1")), "_t3": X.visible_text(F.col("_t1")), "_tag": F.col("_t1").rlike(X.TAG_PATTERN)})
    x = x.withColumn("_t4", X.plain_spaces(F.col("_t3"))).withColumn("_t5", X.without_zero_width(F.col("_t4"))).withColumn("_t6", X.nfc(F.col("_t5")))
    x = x.withColumn("_t7", X.layout(F.col("_t6"))).withColumn("_t8", X.label_artifact(F.col("_t7")))
    n = lambda c, chars: F.coalesce(X.count_of(F.col(c), chars), F.lit(0))
    taken = [_did("_t0", "_t1"), _did("_t1", "_t2"), F.coalesce(F.col("_tag").cast("int"), F.lit(0)), n("_t3", X.UNICODE_SPACES), n("_t4", X.ZERO_WIDTH), _did("_t5", "_t6"), _did("_t6", "_t7"), _did("_t7", "_t8")]
    return x.select(*kept, F.col("_t8").alias(text_col), F.array(*taken).alias("actions"))


def clean_records(df: DataFrame, text_col: str = "karar_metni") -> tuple[DataFrame, DataFrame]:
    """(records, rejected): every column is kept; names are normalised, the text is cleaned; (id, violated) of what breaks a rule."""
    for c in ("id", "daire", "baslik", *NUMBERS):
        if c in df.columns:
            df = df.withColumn(c, X.squeeze(X.nfc(F.col(c))))
    for c in NUMBERS:
        df = df.withColumn(c, X.missing_as_null(F.col(c)))
    x = cleaned_texts(df.withColumn("daire", X.chamber(F.col("daire"))), text_col)
    rules = {
        "id": F.col("id") != "",
        "court": F.col("mahkeme") == "Yargıtay",
        "kind": F.col("karar_turu").isin("hukuk", "ceza", "kurul", "diger"),
        "chamber": F.col("daire") != "",
        "limit_flag": F.col("metin_2000_karakter_sinirinda").isNotNull(),
        "text": (F.col(text_col) != "") & ~X.has_bad_characters(F.col(text_col)),
    }
    good = F.lit(True)
    for rule in rules.values():
        good = good & F.coalesce(rule, F.lit(False))
    return x.where(good), R.violations(x, ["id"], rules)


def clean_job(df: DataFrame, text_col: str = "karar_metni") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, audit, rejected, report) of a table with one row for each id.

    Of records with one identity the best stays and the others are audited;
    equal texts are counted among those that stay.
    """
    records, rejected = clean_records(df, text_col)
    records = materialize(records, "cleaned")
    groups = R.identity_groups(records, "id", text_col, "karar_tarihi", ["daire", "esas_no", "karar_no"])
    kept = groups.where("identity_rank = 1")
    labels = R.quality_labels(kept, "id", text_col, "metin_2000_karakter_sinirinda", list(NUMBERS))
    named = labels.select("id", F.col("text_sha256").alias("karar_metni_sha256"), F.col("text_length").alias("karar_metni_karakter_sayisi"), F.col("same_text_count").alias("ayni_metin_kayit_sayisi"), F.col("warnings").alias("veri_kalite_uyarilari"), F.col("status").alias("veri_kalite_durumu"))
    out = kept.select(*records.columns).join(named, "id").withColumn("temizleme_surum", F.lit(VERSION))
    audit = R.duplicate_audit(groups, "id")
    return out, audit, rejected, report(records, audit, labels)


def report(records: DataFrame, audit: DataFrame, labels: DataFrame) -> DataFrame:
    """(measure, value): rows in and out, and for each action its total and the number of records it was taken on."""
    totals = [F.sum(F.col("actions")[i]).cast("long").alias(f"{a}_total") for i, a in enumerate(ACTIONS)]
    touched = [F.count_if(F.col("actions")[i] > 0).alias(f"{a}_records") for i, a in enumerate(ACTIONS)]
    n = records.agg(F.count("*").alias("cleaned"), *totals, *touched)
    out = n.unpivot([], [F.col(c) for c in n.columns], "measure", "value")
    dropped = audit.agg(F.lit("duplicates_dropped").alias("measure"), F.count("*").alias("value"))
    status = labels.groupBy(F.concat(F.lit("status_"), F.col("status")).alias("measure")).agg(F.count("*").alias("value"))
    warned = labels.select(F.explode("warnings").alias("w")).groupBy(F.concat(F.lit("warning_"), F.col("w")).alias("measure")).agg(F.count("*").alias("value"))
    return out.unionByName(dropped).unionByName(status).unionByName(warned)
