"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import p01_markup as p01
from corpusloom.llm import p02_lookalikes as p02
from corpusloom.llm import p03_truncation as p03
from corpusloom.llm import p04_splitting as p04
from corpusloom.llm import p05_shared_spans as p05
from corpusloom.llm import p06_similar_vectors as p06
from corpusloom.llm import p07_format_duplicates as p07
from corpusloom.llm import p08_packing as p08
from corpusloom.llm import p09_mixing as p09
from corpusloom.llm import p10_personal_information as p10
from corpusloom.session import table
from corpusloom.storage import materialize


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p01.clean_text(table(spark, sf_dir, "scraped_decisions").select("satir_no", "karar_html"), "karar_html")
    return rows.select("satir_no", F.explode("structures").alias("yapi")).where("satir_no is not null").distinct()


def p1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p01.clean_text(table(spark, sf_dir, "scraped_decisions").select("satir_no", "karar_html"), "karar_html")
    return rows.select("satir_no", "clean_text", F.array_join("structures", ",").alias("structures"))


P2_COLUMNS = (("imported_decisions", "id", "karar_metni"), ("search_requests", "istek_id", "olay"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = p02.cases(table(spark, sf_dir, "imported_decisions"), "id", "karar_metni")
    requests = p02.cases(table(spark, sf_dir, "search_requests"), "istek_id", "olay")
    return decisions.select(F.lit("imported_decisions").alias("tablo"), "kayit").unionByName(requests.select(F.lit("search_requests").alias("tablo"), "kayit"))


def p2_look_alike_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [p02.look_alike_groups(table(spark, sf_dir, name), key, column).where("forms > 1").select(F.lit(name).alias("tablo"), "*") for name, key, column in P2_COLUMNS]
    return parts[0].unionByName(parts[1])


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every row of both tables; no text is shuffled, so rows delivered again come out again."""
    parts = [p02.consistent_form(table(spark, sf_dir, name).select(F.lit(name).alias("tablo"), F.col(key).cast("string").alias("kayit"), F.col(column).alias("text")), "text") for name, key, column in P2_COLUMNS]
    return parts[0].unionByName(parts[1]).select("tablo", "kayit", "unified")


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "imported_decisions").withColumns({"dil": F.lit("tr"), "alan": F.lit("karar_metni")})
    return df, p03.truncated(df, "id", "karar_metni", ["dil", "alan"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir)[1].where("cut").select("id").distinct()


def p3_source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03.source_shares(*_cut(spark, sf_dir), "id", "kaynak")


def p3_column_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each column truncates in each language, every group with its own threshold."""
    parts = [
        table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"), F.col(column).alias("text"), dil.alias("dil"), F.lit(column).alias("alan"))
        for name, key, column, dil in (("imported_decisions", "id", "karar_metni", F.lit("tr")), ("search_requests", "istek_id", "olay", F.lit("tr")), ("documents", "doc_id", "text", F.col("lang")))
    ]
    cut = p03.truncated(parts[0].unionByName(parts[1]).unionByName(parts[2]), "id", "text", ["dil", "alan"])
    once = cut.groupBy("id", "grp").agg(F.max("cut").alias("cut"), F.max("threshold").alias("threshold"))
    n = F.count_if("cut")
    rows = once.groupBy("grp").agg(F.first("threshold").alias("threshold"), F.count("*").alias("records"), n.alias("cut_records"), (n / F.count("*")).alias("cut_share"))
    return rows.select(F.col("grp")[0].alias("dil"), F.col("grp")[1].alias("alan"), "threshold", "records", "cut_records", "cut_share")


def _oversized(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return p04.oversized(table(spark, sf_dir, name), "id", column)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_oversized(spark, sf_dir, name, column).select(F.lit(name).alias("tablo"), "kayit", p04.cut_kind(F.col("pieces")).alias("kesim")) for name, column in (("imported_decisions", "karar_metni"), ("text_chunks", "chunk_metni"))]
    return parts[0].unionByName(parts[1]).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [p04.exploded(_oversized(spark, sf_dir, name, column)).select(F.lit(name).alias("tablo"), "*") for name, column in (("imported_decisions", "karar_metni"), ("text_chunks", "chunk_metni"))]
    return parts[0].unionByName(parts[1]).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "imported_decisions")
    return p05.record_pairs(*p05.shared_spans(df, "id", "karar_metni"))


def p5_shared_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "imported_decisions")
    return p05.shared_amounts(df, "id", "karar_metni", *p05.shared_spans(df, "id", "karar_metni"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = p06.similar_vectors(table(spark, sf_dir, "chunk_vectors"), "chunk_id", "vector", min_score=0.85)
    return hits.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p6_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = p06.similar_vectors(table(spark, sf_dir, "chunk_vectors"), "chunk_id", "vector", fineness=2.4, growth=0.1)
    return hits.select(F.col("id").alias("query_id"), F.col("neighbour").alias("chunk_id"), "score", "rank")


NUMBERS = ["esas_no", "karar_no"]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p07.group_pairs(p07.copy_groups(table(spark, sf_dir, "imported_decisions"), "id", "karar_metni", NUMBERS))


def p7_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p07.collapse(table(spark, sf_dir, "imported_decisions"), "id", "karar_metni", NUMBERS)


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["pack_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").collect()}  # a fixed table of three rows


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = p08.packed(table(spark, sf_dir, "documents"), "doc_id", "text", _capacities(spark, sf_dir))
    return placed.withColumn("doc_id", F.col("id").cast("long")).drop("id")


def p8_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _capacities(spark, sf_dir)
    return p08.fill_report(p08.packed(table(spark, sf_dir, "documents"), "doc_id", "text", sizes), sizes)


def p8_similarity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where("doc_id is not null")
    return p08.similarity_report(p08.packed(documents, "doc_id", "text", _capacities(spark, sf_dir)), documents, "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weights = table(spark, sf_dir, "source_weights")
    sizes = materialize(p09.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "sizes")
    return p09.mixed(sizes, weights), weights


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumn("doc_id", F.col("id").cast("long")).drop("id")


def _budget_mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weights = table(spark, sf_dir, "source_weights")
    sizes = materialize(p09.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return p09.mixed(sizes, weights, budget=total // 4), weights


def p9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of a quarter of the corpus: the exponent gives way where small sources would repeat too often."""
    return _budget_mix(spark, sf_dir)[0].withColumn("doc_id", F.col("id").cast("long")).drop("id")


def p9_budget_mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09.share_report(*_budget_mix(spark, sf_dir))


def p9_entropy_mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers of the sources' own shares with the entropy of the targets, as large as the corpus allows."""
    weights = table(spark, sf_dir, "source_weights")
    sizes = materialize(p09.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "sizes")
    wanted = p09.entropy({r["source"]: r["target_share"] or 0.0 for r in weights.toLocalIterator()})

    def exponents(tokens: dict, limits: dict) -> tuple[dict, float]:
        shares, _ = p09.temperature(tokens, limits, 0, wanted)
        return shares, min((max(1, limits.get(s, 1)) * tokens[s] / w for s, w in shares.items()), default=0.0)

    return p09.share_report(p09.mixed(sizes, weights, exponents=exponents), weights)


def p9_share_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09.share_report(*_mix(spark, sf_dir))


#: The key of the pseudonyms; production passes its own secret.
PII_KEY = b"corpusloom-example-key"


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p10.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", PII_KEY)
    return rows.select(F.col("id").alias("doc_id"), "pii_type", "seq")


def p10_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", PII_KEY).select("doc_id", "safe_text")


def p10_replaced_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p10_replaced, with all dates permuted too, which problem 10 as stated leaves unchanged."""
    return p10.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", PII_KEY, dates=True).select("doc_id", "safe_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean_text": p1_clean_text,
    "p2_found": p2_found,
    "p2_look_alike_groups": p2_look_alike_groups,
    "p2_unified": p2_unified,
    "p3_found": p3_found,
    "p3_source_shares": p3_source_shares,
    "p3_column_shares": p3_column_shares,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_shared_amounts": p5_shared_amounts,
    "p8_packing": p8_packing,
    "p8_fill_report": p8_fill_report,
    "p8_similarity_report": p8_similarity_report,
    "p9_mix": p9_mix,
    "p9_share_report": p9_share_report,
    "p9_budget_mix": p9_budget_mix,
    "p9_budget_mix_report": p9_budget_mix_report,
    "p9_entropy_mix_report": p9_entropy_mix_report,
    "p10_found": p10_found,
    "p10_replaced": p10_replaced,
    "p10_replaced_with_dates": p10_replaced_with_dates,
    "p6_found": p6_found,
    "p6_hits": p6_hits,
    "p7_found": p7_found,
    "p7_collapsed": p7_collapsed,
}

#: SQL for the queries that it can express on whole tables.
SQL: dict[str, str] = {
    "p4_found": """SELECT DISTINCT tablo, kayit, CASE WHEN len(list_filter(regexp_extract_all(metin, '\\S+'), lambda w: length(w) > 1200)) > 0 THEN 'zorunlu' ELSE 'dogal' END AS kesim FROM (SELECT 'imported_decisions' AS tablo, id AS kayit, karar_metni AS metin FROM imported_decisions UNION ALL SELECT 'text_chunks', id, chunk_metni FROM text_chunks) WHERE length(metin) > 1200""",
}
