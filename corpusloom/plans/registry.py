"""Named queries over the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions.numbers import round_exact
from corpusloom.functions.providers import embedded
from corpusloom.operators import answers, chunk, cleaning, evaluate, importing, indexing, records, search
from corpusloom.session import table
from corpusloom.storage import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_C = F.col


def query(sql: str | None = None):
    """Register a function of (spark, dir) under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# pieces of SQL that several queries share
_SQUEEZE = "trim(regexp_replace(replace({0}, chr(160), ' '), '[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f]+', ' ', 'g'))"
_CHAMBER = "regexp_replace(" + _SQUEEZE + ", '^([0-9]+)\\.[ ]*', '\\1. ')"
_NULLED = "CASE WHEN trim({0}) IN ('-', '') THEN NULL ELSE trim({0}) END"
_ONCE = "(SELECT * FROM imported_decisions QUALIFY row_number() OVER (PARTITION BY id ORDER BY yuklenme_zamani, kaynak_kayit_id) = 1)"


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each decision once: its first delivery.  The window sees every row; equal rows are equal choices."""
    return records.once(table(spark, d, "imported_decisions"), "id", [_C("yuklenme_zamani"), _C("kaynak_kayit_id")])


def _long(*names: str) -> dict:
    return {n: _C(n).cast("long") for n in names}


# ---- profiles and aggregates


@query(f"""SELECT count(*) AS records, count(DISTINCT id) AS ids, count_if({_NULLED.format('esas_no')} IS NULL) AS no_case_no,
count_if({_NULLED.format('karar_no')} IS NULL) AS no_decision_no, count_if({_NULLED.format('karar_tarihi')} IS NULL) AS no_date,
count_if(metin_2000_karakter_sinirinda) AS flagged, min(length(karar_metni)) AS shortest, max(length(karar_metni)) AS longest FROM imported_decisions""")
def corpus_profile(spark, d):
    x = table(spark, d, "imported_decisions")
    none = lambda c: F.count_if(X.missing_as_null(_C(c)).isNull())
    n = F.length("karar_metni").cast("long")
    return x.agg(F.count("*").alias("records"), F.count_distinct("id").alias("ids"), none("esas_no").alias("no_case_no"), none("karar_no").alias("no_decision_no"), none("karar_tarihi").alias("no_date"), F.count_if("metin_2000_karakter_sinirinda").alias("flagged"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query("""SELECT count_if(n > 1) AS repeated_texts, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS records_in_them, CAST(max(n) AS BIGINT) AS largest
FROM (SELECT sha256(karar_metni) h, count(*) n FROM imported_decisions WHERE karar_metni IS NOT NULL GROUP BY 1)""")
def exact_text_groups(spark, d):
    g = table(spark, d, "imported_decisions").where("karar_metni is not null").groupBy(F.sha2("karar_metni", 256).alias("h")).agg(F.count("*").alias("n"))
    return g.agg(F.count_if(_C("n") > 1).alias("repeated_texts"), F.coalesce(F.sum(F.when(_C("n") > 1, _C("n"))), F.lit(0)).alias("records_in_them"), F.max("n").alias("largest"))


@query("""SELECT CAST(sum(sp) AS BIGINT) AS spaces_replaced, count_if(sp > 0) AS records_with_spaces, CAST(sum(zw) AS BIGINT) AS zero_width_removed, count_if(zw > 0) AS records_with_zero_width
FROM (SELECT length(karar_metni) - length(translate(karar_metni, chr(160) || chr(8199) || chr(8239), '')) sp, length(karar_metni) - length(translate(karar_metni, chr(8203) || chr(8204) || chr(8205) || chr(65279), '')) zw FROM imported_decisions)""")
def cleaning_action_totals(spark, d):
    c = _C("karar_metni")
    x = table(spark, d, "imported_decisions").select(X.count_of(c, X.UNICODE_SPACES).alias("sp"), X.count_of(c, X.ZERO_WIDTH).alias("zw"))
    return x.agg(F.sum("sp").alias("spaces_replaced"), F.count_if(_C("sp") > 0).alias("records_with_spaces"), F.sum("zw").alias("zero_width_removed"), F.count_if(_C("zw") > 0).alias("records_with_zero_width"))


@query("SELECT CAST(n AS BIGINT) AS chunks, count(*) AS decisions FROM (SELECT karar_id, count(DISTINCT id) n FROM text_chunks GROUP BY 1) GROUP BY 1")
def chunks_per_decision(spark, d):
    x = table(spark, d, "text_chunks").groupBy("karar_id").agg(F.count_distinct("id").alias("chunks"))
    return x.groupBy("chunks").agg(F.count("*").alias("decisions"))


_PICKS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("WITH a AS (SELECT list_sort(list(CAST(karakter_sayisi AS BIGINT))) l, count(*) n, avg(karakter_sayisi) m FROM text_chunks WHERE karakter_sayisi IS NOT NULL) SELECT l[1] AS min, l[n] AS max, round(m, 6) AS mean, " + ", ".join(f"l[CAST(round_even((n - 1) * {f}, 0) AS BIGINT) + 1] AS {k}" for k, f in _PICKS.items()) + " FROM a")
def chunk_length_summary(spark, d):
    x = evaluate.numeric_summary(table(spark, d, "text_chunks").select(_C("karakter_sayisi").cast("long").alias("v")), "v", _PICKS)
    return x.withColumn("mean", F.round("mean", 6))


@query("SELECT daire, count(*) AS hits, round(quantile_disc(score, 0.95), 6) AS p95, round(median(score), 6) AS median, round(avg(score), 6) AS mean FROM search_hits WHERE score IS NOT NULL GROUP BY 1")
def score_percentiles(spark, d):
    h = table(spark, d, "search_hits").where("score is not null")
    means = h.groupBy(_C("daire").alias("_d")).agg(F.avg("score").alias("mean"))
    x = evaluate.values_at(h, "daire", "score", {"p95": lambda n: F.expr("(total * 95 + 99) div 100"), "a": lambda n: F.expr("(total + 1) div 2"), "b": lambda n: F.expr("total div 2 + 1")})
    x = x.join(means, _C("daire").eqNullSafe(_C("_d")))  # a row for each chamber
    return x.select("daire", _C("n").alias("hits"), F.round("p95", 6).alias("p95"), F.round((_C("a") + _C("b")) / 2, 6).alias("median"), F.round("mean", 6).alias("mean"))


@query("""SELECT CASE WHEN n <= 800 THEN 'kisa' WHEN n <= 1200 THEN 'orta' WHEN n <= 1800 THEN 'uzun' ELSE 'cok_uzun' END AS band, karar_turu AS kind, count(*) AS records
FROM (SELECT length(karar_metni) n, karar_turu FROM imported_decisions) GROUP BY 1, 2""")
def length_bands(spark, d):
    x = table(spark, d, "imported_decisions")
    return x.groupBy(X.length_band(F.length("karar_metni")).alias("band"), _C("karar_turu").alias("kind")).agg(F.count("*").alias("records"))


# ---- projections, predicates, text functions


@query(f"""WITH c AS (SELECT DISTINCT daire FROM imported_decisions), n AS (SELECT daire, {_CHAMBER.format('daire')} clean FROM c)
SELECT daire, clean, CASE WHEN lower(clean) LIKE '%kurul%' THEN 'kurul' WHEN lower(clean) LIKE '%ceza%' THEN 'ceza' WHEN lower(clean) LIKE '%hukuk%' THEN 'hukuk' ELSE 'diger' END AS kind,
coalesce(regexp_matches(clean, '^[0-9]+\\. (?:Hukuk|Ceza) Dairesi$') OR clean IN ('Hukuk Genel Kurulu', 'Ceza Genel Kurulu') OR starts_with(clean, 'Yargıtay '), false) AS known FROM n""")
def chamber_names(spark, d):
    x = table(spark, d, "imported_decisions").select("daire").distinct().withColumn("clean", X.chamber(_C("daire")))
    return x.select("daire", "clean", X.decision_type(_C("clean")).alias("kind"), X.is_known_chamber(_C("clean")).alias("known"))


@query(f"""SELECT id, coalesce(regexp_matches({_NULLED.format('esas_no')}, '^[0-9]{{4}}/[0-9]+$'), false) AS case_no_ok, coalesce(regexp_matches({_NULLED.format('karar_no')}, '^[0-9]{{4}}/[0-9]+$'), false) AS decision_no_ok,
try_strptime(CASE WHEN regexp_matches({_NULLED.format('karar_tarihi')}, '^[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{4}}$') THEN {_NULLED.format('karar_tarihi')} END, '%d.%m.%Y') IS NOT NULL AS date_ok FROM (SELECT DISTINCT id, esas_no, karar_no, karar_tarihi FROM imported_decisions)""")
def number_and_date_validity(spark, d):
    x = table(spark, d, "imported_decisions").select("id", "esas_no", "karar_no", "karar_tarihi").distinct()
    n = lambda c: X.missing_as_null(_C(c))
    return x.select("id", X.is_number(n("esas_no")).alias("case_no_ok"), X.is_number(n("karar_no")).alias("decision_no_ok"), X.is_date(n("karar_tarihi")).alias("date_ok"))


@query("SELECT id, sha256(nfc_normalize(karar_metni)) AS digest, nfc_normalize(karar_metni) <> karar_metni AS changed FROM (SELECT DISTINCT id, karar_metni FROM imported_decisions)")
def nfc_normalised(spark, d):
    x = table(spark, d, "imported_decisions").select("id", "karar_metni").distinct().withColumn("n", X.nfc(_C("karar_metni")))
    return x.select("id", F.sha2("n", 256).alias("digest"), (_C("n") != _C("karar_metni")).alias("changed"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t\\f\\x0b]+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '^\\n+|\\n+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents""")
def whitespace_layout(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.layout(X.line_ends(_C("text"))), 256).alias("digest"))


@query(f"""SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 119) || '…' END AS preview FROM (SELECT doc_id, {_SQUEEZE.format('text')} s FROM documents)""")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(_C("text"), 120).alias("preview"))


@query("""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\n{2,}'), lambda p: trim(translate(p, chr(10) || chr(13) || chr(9), '   ')) <> '')) AS BIGINT) AS paragraphs FROM documents""")
def paragraph_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.paragraph_count(_C("text")).cast("long").alias("paragraphs"))


@query("SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(karar_metni, '(?im){X.marker_pattern(k)}') THEN '{k}' END" for k in X.SECTION_MARKERS) + "], lambda x: x IS NOT NULL), ',') AS markers FROM (SELECT DISTINCT id, karar_metni FROM imported_decisions)")
def section_markers(spark, d):
    x = table(spark, d, "imported_decisions").select("id", "karar_metni").distinct()
    return x.select("id", F.array_join(X.section_markers(_C("karar_metni")), ",").alias("markers"))


_SHA1 = f"sha1(from_hex('{X.POINT_NAMESPACE.replace('-', '')}') || encode(trim(chunk_id)))"


@query(f"""SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT DISTINCT chunk_id, {_SHA1} h FROM chunk_vectors)""")
def point_ids(spark, d):
    return table(spark, d, "chunk_vectors").select("chunk_id").distinct().select("chunk_id", X.point_id(_C("chunk_id")).alias("point_id"))


@query()
def visible_page_text(spark, d):
    x = table(spark, d, "scraped_decisions").select("satir_no", X.clean_text(_C("karar_html")).alias("text"))
    return x.withColumn("is_valid", F.coalesce(F.length("text") > 0, F.lit(False)))


@query(f"""SELECT istek_id, length(q) BETWEEN 10 AND 4000 AND NOT contains(q, chr(65533)) AS query_ok, top_k BETWEEN 1 AND 20 AS top_k_ok, min_score IS NULL OR min_score BETWEEN -1 AND 1 AS min_score_ok
FROM (SELECT DISTINCT istek_id, {_SQUEEZE.format('nfc_normalize(olay)')} q, top_k, min_score FROM search_requests)""")
def request_validity(spark, d):
    x = table(spark, d, "search_requests").select("istek_id", X.squeeze(X.nfc(_C("olay"))).alias("q"), "top_k", "min_score").distinct()
    ok = F.length("q").between(10, 4000) & ~F.contains("q", F.lit("�"))
    return x.select("istek_id", ok.alias("query_ok"), _C("top_k").between(1, 20).alias("top_k_ok"), (_C("min_score").isNull() | _C("min_score").between(-1, 1)).alias("min_score_ok"))


# ---- validation


@query("""WITH r AS (SELECT DISTINCT id, karar_id, chunk_sirasi, toplam_chunk, karakter_sayisi, chunk_metni, chunk_metni_sha256, veri_kalite_durumu FROM text_chunks), v AS (
SELECT id, unnest([CASE WHEN NOT coalesce(id = karar_id || ':c' || lpad(CAST(chunk_sirasi AS VARCHAR), 4, '0'), false) THEN 'id' END, CASE WHEN NOT coalesce(length(chunk_metni) = karakter_sayisi, false) THEN 'length' END,
CASE WHEN NOT coalesce(sha256(chunk_metni) = chunk_metni_sha256, false) THEN 'digest' END, CASE WHEN NOT coalesce(chunk_sirasi BETWEEN 1 AND toplam_chunk, false) THEN 'order' END,
CASE WHEN NOT coalesce(length(chunk_metni) <= 1200, false) THEN 'size' END, CASE WHEN NOT coalesce(veri_kalite_durumu IN ('gecerli', 'uyarili'), false) THEN 'status' END]) rule FROM r)
SELECT id, rule FROM v WHERE rule IS NOT NULL""")
def chunk_violations(spark, d):
    x = table(spark, d, "text_chunks").select("id", "karar_id", "chunk_sirasi", "toplam_chunk", "karakter_sayisi", "chunk_metni", "chunk_metni_sha256", "veri_kalite_durumu").distinct()
    rules = {
        "id": _C("id") == F.format_string("%s:c%04d", _C("karar_id"), _C("chunk_sirasi")),
        "length": F.length("chunk_metni") == _C("karakter_sayisi"),
        "digest": F.sha2("chunk_metni", 256) == _C("chunk_metni_sha256"),
        "order": _C("chunk_sirasi").between(1, _C("toplam_chunk")),
        "size": F.length("chunk_metni") <= 1200,
        "status": _C("veri_kalite_durumu").isin("gecerli", "uyarili"),
    }
    return records.violations(x, ["id"], rules).select("id", F.explode("violated").alias("rule"))


@query("""SELECT chunk_id, len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AS is_valid,
CASE WHEN len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 THEN round(sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x))), 6) END AS norm
FROM (SELECT chunk_id, any_value(vector) vector FROM chunk_vectors WHERE vector IS NOT NULL GROUP BY 1)""")
def vector_validity(spark, d):
    x = table(spark, d, "chunk_vectors").where("vector is not null").groupBy("chunk_id").agg(F.first("vector").alias("v"))
    finite = (F.size("v") == 64) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return x.select("chunk_id", V.is_valid(_C("v"), 64).alias("is_valid"), F.when(finite, F.round(V.norm(_C("v")), 6)).alias("norm"))


@query("""SELECT t.n AS chunks, t.ids AS chunk_ids, t.orphans, v.n AS vectors, v.missing FROM (SELECT count(*) n, count(DISTINCT id) ids, count_if(karar_id NOT IN (SELECT id FROM imported_decisions)) orphans FROM text_chunks) t,
(SELECT count(*) n, count_if(chunk_id NOT IN (SELECT id FROM text_chunks)) missing FROM chunk_vectors) v""")
def key_checks(spark, d):
    c, v = table(spark, d, "text_chunks"), table(spark, d, "chunk_vectors")
    known = table(spark, d, "imported_decisions").select(_C("id").alias("karar_id")).distinct().withColumn("known", F.lit(1))
    a = c.join(known, "karar_id", "left").agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("chunk_ids"), F.count_if(_C("known").isNull()).alias("orphans"))
    held = c.select(_C("id").alias("chunk_id")).distinct().withColumn("held", F.lit(1))
    b = v.join(held, "chunk_id", "left").agg(F.count("*").alias("vectors"), F.count_if(_C("held").isNull()).alias("missing"))
    return a.crossJoin(b)  # one row each


# ---- import


_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize({{0}}), chr(146), '’'), '\\r\\n?', chr(10), 'g'), '^{X.WHITE}+', ''), '{X.WHITE}+$', '')"
_NAME = _SQUEEZE.format("nfc_normalize({0})")
_IMPORT = f"""WITH s AS (SELECT DISTINCT id, baslik, karar_metni, daire, coalesce(esas_no, '-') e, coalesce(karar_no, '-') k, coalesce(karar_tarihi, '-') t FROM imported_decisions),
n AS (SELECT {_NAME.format('id')} id, {_NAME.format('baslik')} baslik, {_CHAMBER.format('nfc_normalize(daire)')} daire, {_PLAIN.replace('{0}', 'karar_metni')} metin, {_NAME.format('e')} e, {_NAME.format('k')} k, {_NAME.format('t')} t FROM s),
v AS (SELECT *, list_filter([CASE WHEN NOT coalesce(id <> '' AND NOT regexp_matches(id, '[\\p{{Cc}}\\x{{FFFD}}]'), false) THEN 'id' END, CASE WHEN NOT coalesce(baslik <> '' AND NOT regexp_matches(baslik, '[\\p{{Cc}}\\x{{FFFD}}]'), false) THEN 'title' END,
CASE WHEN NOT coalesce((regexp_matches(daire, '^[0-9]+\\. (?:Hukuk|Ceza) Dairesi$') OR daire IN ('Hukuk Genel Kurulu', 'Ceza Genel Kurulu') OR starts_with(daire, 'Yargıtay ')) AND NOT regexp_matches(daire, '[\\p{{Cc}}\\x{{FFFD}}]'), false) THEN 'chamber' END,
CASE WHEN NOT coalesce(metin <> '' AND NOT regexp_matches(translate(metin, chr(10) || chr(9), ''), '[\\p{{Cc}}\\x{{FFFD}}]'), false) THEN 'text' END,
CASE WHEN NOT (e = '-' OR regexp_matches(e, '^[0-9]{{4}}/[0-9]+$')) THEN 'case_no' END, CASE WHEN NOT (k = '-' OR regexp_matches(k, '^[0-9]{{4}}/[0-9]+$')) THEN 'decision_no' END,
CASE WHEN NOT (t = '-' OR try_strptime(CASE WHEN regexp_matches(t, '^[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{4}}$') THEN t END, '%d.%m.%Y') IS NOT NULL) THEN 'date' END], lambda x: x IS NOT NULL) violated FROM n)"""


def _imported(spark, d):
    """The decisions as records of an outside source, in which a dash stands for what is missing."""
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    x = table(spark, d, "imported_decisions").select("id", "baslik", "karar_metni", "daire", dash("esas_no"), dash("karar_no"), dash("karar_tarihi")).distinct()
    return importing.import_records(x, "açık derlem", "https://kaynak.example", "CC-BY-4.0", "id", "baslik", "karar_metni", "daire", "esas_no", "karar_no", "karar_tarihi")


@query(_IMPORT + """ SELECT id, 'Yargıtay' AS mahkeme, daire, CASE WHEN lower(daire) LIKE '%kurul%' THEN 'kurul' WHEN lower(daire) LIKE '%ceza%' THEN 'ceza' WHEN lower(daire) LIKE '%hukuk%' THEN 'hukuk' ELSE 'diger' END AS karar_turu, nullif(e, '-') AS esas_no, nullif(k, '-') AS karar_no,
nullif(t, '-') AS karar_tarihi, baslik, sha256(metin) AS text_sha256, length(metin) = 2000 AS metin_2000_karakter_sinirinda, 'açık derlem' AS kaynak, id AS kaynak_kayit_id FROM v WHERE len(violated) = 0""")
def imported_projection(spark, d):
    x = _imported(spark, d)[0].withColumn("text_sha256", F.sha2("karar_metni", 256))
    return x.drop("karar_metni", "kaynak_url", "kaynak_lisans")


@query(_IMPORT + " SELECT id, array_to_string(violated, ',') AS violated FROM v WHERE len(violated) > 0")
def import_rejections(spark, d):
    return _imported(spark, d)[1].withColumn("violated", F.array_join("violated", ","))


@query(_IMPORT + """, g AS (SELECT *, CASE WHEN lower(daire) LIKE '%kurul%' THEN 'kurul' WHEN lower(daire) LIKE '%ceza%' THEN 'ceza' WHEN lower(daire) LIKE '%hukuk%' THEN 'hukuk' ELSE 'diger' END kind FROM v WHERE len(violated) = 0)
SELECT 'records' AS measure, count(*) AS value FROM g UNION ALL SELECT 'unique_ids', count(DISTINCT id) FROM g UNION ALL SELECT 'at_limit', count_if(length(metin) = 2000) FROM g UNION ALL SELECT 'no_esas_no', count_if(e = '-') FROM g UNION ALL SELECT 'no_karar_no', count_if(k = '-') FROM g
UNION ALL SELECT 'no_karar_tarihi', count_if(t = '-') FROM g UNION ALL SELECT 'kind_' || kind, count(*) FROM g GROUP BY kind UNION ALL SELECT 'rejected_' || r, count(*) FROM (SELECT unnest(violated) r FROM v) GROUP BY r""")
def import_report(spark, d):
    return importing.import_report(*_imported(spark, d))


# ---- cleaning, identity, labels


@query()
def cleaned_records(spark, d):
    """The whole cleaning of every decision: cleaned columns, labels, and the actions taken on its text."""
    x = cleaning.clean_job(_decisions(spark, d).withColumn("metin_2000_karakter_sinirinda", F.coalesce("metin_2000_karakter_sinirinda", F.lit(False))))[0]
    return x.drop("karar_metni").withColumns({"actions": F.array_join(_C("actions").cast("array<string>"), ","), "veri_kalite_uyarilari": F.array_join("veri_kalite_uyarilari", ",")})


@query()
def cleaning_report(spark, d):
    return cleaning.clean_job(_decisions(spark, d).withColumn("metin_2000_karakter_sinirinda", F.coalesce("metin_2000_karakter_sinirinda", F.lit(False))))[3]


_IDENTITY = f"""WITH r AS (SELECT *, {_NULLED.format('esas_no')} e, {_NULLED.format('karar_no')} k, {_CHAMBER.format('daire')} c FROM {_ONCE}),
g AS (SELECT id, length(karar_metni) n, CASE WHEN e IS NULL OR k IS NULL OR c IS NULL OR c IN ('-', '') THEN 'id:' || id ELSE c || chr(31) || e || chr(31) || k END key, {_NULLED.format('karar_tarihi')} IS NOT NULL hd FROM r),
w AS (SELECT id, n, row_number() OVER o rn, first_value(id) OVER o kept, first_value(n) OVER o kn FROM g WINDOW o AS (PARTITION BY key ORDER BY n DESC, hd DESC, id))"""


def _identity(spark, d):
    x = _decisions(spark, d).withColumn("chamber", X.chamber(_C("daire")))
    return records.identity_groups(x, "id", "karar_metni", "karar_tarihi", ["chamber", "esas_no", "karar_no"])


@query(_IDENTITY + " SELECT id, CAST(n AS BIGINT) AS text_length FROM w WHERE rn = 1")
def identity_dedup(spark, d):
    return _identity(spark, d).where("identity_rank = 1").select("id", _C("text_length").cast("long").alias("text_length"))


@query(_IDENTITY + " SELECT id, kept AS duplicate_of_id, 'same_identity' AS reason, CAST(n AS BIGINT) AS dropped_text_length, CAST(kn AS BIGINT) AS kept_text_length FROM w WHERE rn > 1")
def duplicate_audit(spark, d):
    return records.duplicate_audit(_identity(spark, d), "id").withColumns(_long("dropped_text_length", "kept_text_length"))


_LABELS = _IDENTITY + f""", l AS (SELECT id, karar_metni, sha256(karar_metni) h, list_filter([CASE WHEN {_NULLED.format('esas_no')} IS NULL THEN 'eksik_esas_no' END, CASE WHEN {_NULLED.format('karar_no')} IS NULL THEN 'eksik_karar_no' END,
CASE WHEN {_NULLED.format('karar_tarihi')} IS NULL THEN 'eksik_karar_tarihi' END, CASE WHEN metin_2000_karakter_sinirinda THEN 'kaynak_metin_2000_karakter_sinirinda' END,
CASE WHEN count(*) OVER (PARTITION BY sha256(karar_metni)) > 1 THEN 'ayni_metin_farkli_kararlarda' END], lambda x: x IS NOT NULL) w, count(*) OVER (PARTITION BY sha256(karar_metni)) c FROM {_ONCE} WHERE id IN (SELECT id FROM w WHERE rn = 1))"""


def _labels(spark, d):
    """Labels of the records that de-duplication keeps: equal texts are counted among them."""
    return records.quality_labels(_identity(spark, d).where("identity_rank = 1"), "id", "karar_metni", "metin_2000_karakter_sinirinda", ["esas_no", "karar_no", "karar_tarihi"])


@query(_LABELS + " SELECT id, h AS text_sha256, CAST(length(karar_metni) AS BIGINT) AS text_length, c AS same_text_count, array_to_string(w, ',') AS warnings, CASE WHEN len(w) > 0 THEN 'uyarili' ELSE 'gecerli' END AS status FROM l")
def quality_labels(spark, d):
    return _labels(spark, d).withColumns({"text_length": _C("text_length").cast("long"), "warnings": F.array_join("warnings", ",")})


@query(_LABELS + " SELECT x AS warning, count(*) AS records FROM (SELECT unnest(w) x FROM l) GROUP BY 1")
def warning_counts(spark, d):
    return _labels(spark, d).select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("records"))


@query("""SELECT satir_no, id, karar_turu AS given_kind, CASE WHEN lower(daire) LIKE '%kurul%' THEN 'kurul' WHEN lower(daire) LIKE '%ceza%' THEN 'ceza' WHEN lower(daire) LIKE '%hukuk%' THEN 'hukuk' ELSE 'diger' END AS kind
FROM (SELECT * FROM scraped_decisions QUALIFY row_number() OVER (PARTITION BY id ORDER BY cekilme_zamani DESC, satir_no DESC) = 1)""")
def latest_scrape(spark, d):
    x = records.once(table(spark, d, "scraped_decisions"), "id", [F.desc("cekilme_zamani"), F.desc("satir_no")])
    return x.select("satir_no", "id", _C("karar_turu").alias("given_kind"), X.decision_type(_C("daire")).alias("kind"))


# ---- joins and sets


_VALID = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"


@query(f"SELECT DISTINCT h.chunk_id FROM search_hits h ANTI JOIN (SELECT chunk_id FROM chunk_vectors WHERE vector IS NOT NULL AND {_VALID}) v ON h.chunk_id = v.chunk_id")
def hits_without_vector(spark, d):
    """Hits whose chunk has no vector that a search could have met."""
    good = table(spark, d, "chunk_vectors").where(F.coalesce(V.is_valid(_C("vector"), 64), F.lit(False))).select("chunk_id")
    return table(spark, d, "search_hits").select("chunk_id").distinct().join(good, "chunk_id", "left_anti")


@query("SELECT DISTINCT istek_id FROM search_requests r ANTI JOIN search_hits h ON r.istek_id = h.istek_id AND h.score >= 0.6")
def requests_without_good_hit(spark, d):
    good = table(spark, d, "search_hits").where("score >= 0.6").select("istek_id")
    return table(spark, d, "search_requests").select("istek_id").distinct().join(good, "istek_id", "left_anti")


@query("SELECT id, CAST(length(karar_metni) AS BIGINT) AS n_chars FROM (SELECT DISTINCT id, karar_metni FROM imported_decisions) i SEMI JOIN search_hits h ON i.id = h.karar_id")
def decisions_with_hits(spark, d):
    x = table(spark, d, "imported_decisions").select("id", F.length("karar_metni").cast("long").alias("n_chars")).distinct()
    return x.join(table(spark, d, "search_hits").select(_C("karar_id").alias("id")), "id", "left_semi")


@query("SELECT id FROM imported_decisions UNION SELECT id FROM scraped_decisions")
def all_ids(spark, d):
    return table(spark, d, "imported_decisions").select("id").union(table(spark, d, "scraped_decisions").select("id")).distinct()


@query("SELECT karar_id FROM text_chunks INTERSECT SELECT karar_id FROM search_hits")
def chunked_and_hit(spark, d):
    return table(spark, d, "text_chunks").select("karar_id").intersect(table(spark, d, "search_hits").select("karar_id"))


@query("SELECT id AS karar_id FROM imported_decisions EXCEPT SELECT karar_id FROM text_chunks WHERE toplam_chunk > 1")
def decisions_without_several_chunks(spark, d):
    return table(spark, d, "imported_decisions").select(_C("id").alias("karar_id")).subtract(table(spark, d, "text_chunks").where("toplam_chunk > 1").select("karar_id"))


@query(f"""SELECT c.daire, c.karar_turu, CAST(c.kurulus_yili AS BIGINT) AS founded, count(*) AS hits, round(avg(h.score), 6) AS mean_score FROM (SELECT {_CHAMBER.format('daire')} daire, score FROM search_hits) h JOIN chambers c ON h.daire = c.daire GROUP BY 1, 2, 3""")
def hits_by_chamber(spark, d):
    h = table(spark, d, "search_hits").select(X.chamber(_C("daire")).alias("daire"), "score")
    g = h.groupBy("daire").agg(F.count("*").alias("hits"), F.round(F.avg("score"), 6).alias("mean_score"))  # aggregated before the join
    c = table(spark, d, "chambers").select("daire", "karar_turu", _C("kurulus_yili").cast("long").alias("founded"))
    return g.join(c, "daire").select("daire", "karar_turu", "founded", "hits", "mean_score")


# ---- search


_KNN = "list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(q.embedding, lambda v: CAST(v AS DOUBLE) * v))) * sqrt(list_sum(list_transform(x.embedding, lambda v: CAST(v AS DOUBLE) * v))))"


def _knn(spark, d, k, min_score=None, same_label=False):
    x = table(spark, d, "embeddings")
    hits = search.knn(x.where(_C("vec_id") % 100 == 0), x, "vec_id", "embedding", k, 64, min_score)
    return hits.select("query_id", "item_id", round_exact(_C("score")).alias("score"), _C("rank").cast("long").alias("rank"))


@query(f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id query_id, x.vec_id item_id, {_KNN} score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_KNN}, 12) DESC, x.vec_id) rank
FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id) WHERE rank <= 10""")
def knn_topk(spark, d):
    return _knn(spark, d, 10)


@query(f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id query_id, x.vec_id item_id, {_KNN} score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_KNN}, 12) DESC, x.vec_id) rank
FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id AND x.label % 2 = 1 AND round({_KNN}, 12) >= 0.1) WHERE rank <= 5""")
def knn_filtered_threshold(spark, d):
    x = table(spark, d, "embeddings")
    hits = search.knn(x.where(_C("vec_id") % 100 == 0), x.where("label % 2 = 1"), "vec_id", "embedding", 5, 64, 0.1)
    return hits.select("query_id", "item_id", round_exact(_C("score")).alias("score"), _C("rank").cast("long").alias("rank"))


_HITS = "(SELECT DISTINCT istek_id, chunk_id, karar_id, daire, karar_turu, score FROM search_hits WHERE score IS NOT NULL)"


def _hits(spark, d):
    """Each scored hit once."""
    return table(spark, d, "search_hits").where("score is not null").select("istek_id", "chunk_id", "karar_id", "daire", "karar_turu", "score").distinct()


def _requests(spark, d):
    """Each request once; requests sent again are equal."""
    return table(spark, d, "search_requests").select("istek_id", "top_k", "min_score", "filtre_daire", "filtre_karar_turu").distinct()


_REQUESTS = "(SELECT DISTINCT istek_id, top_k, min_score, filtre_daire, filtre_karar_turu FROM search_requests)"


@query(f"SELECT istek_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY istek_id ORDER BY score DESC, chunk_id) AS rank FROM {_HITS}")
def ranked_hits(spark, d):
    return search.ranked(_hits(spark, d), "istek_id", "score", "chunk_id").select("istek_id", "chunk_id", round_exact(_C("score")).alias("score"), _C("rank").cast("long").alias("rank"))


_UNIQUE = f"""WITH h AS (SELECT s.*, r.top_k, row_number() OVER (PARTITION BY s.istek_id ORDER BY s.score DESC, s.chunk_id) rk FROM {_HITS} s JOIN {_REQUESTS} r ON s.istek_id = r.istek_id),
c AS (SELECT * FROM h WHERE rk <= least(5 * top_k, 100) QUALIFY row_number() OVER (PARTITION BY istek_id, karar_id ORDER BY rk) = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY istek_id ORDER BY rk) rank FROM c QUALIFY row_number() OVER (PARTITION BY istek_id ORDER BY rk) <= top_k)"""


def _unique(spark, d):
    return search.unique_decisions(_hits(spark, d), _requests(spark, d).select("istek_id", "top_k"), "istek_id", "score", "chunk_id", "karar_id")


@query(_UNIQUE + " SELECT istek_id, karar_id, chunk_id, round(score, 6) AS score, rank FROM u")
def search_unique_decisions(spark, d):
    return _unique(spark, d).select("istek_id", "karar_id", "chunk_id", round_exact(_C("score")).alias("score"), _C("rank").cast("long").alias("rank"))


@query(f"""SELECT s.istek_id, s.chunk_id, round(s.score, 6) AS score FROM {_HITS} s JOIN {_REQUESTS} r ON s.istek_id = r.istek_id
WHERE (r.filtre_daire IS NULL OR s.daire = r.filtre_daire) AND (r.filtre_karar_turu IS NULL OR s.karar_turu = r.filtre_karar_turu) AND (r.min_score IS NULL OR s.score >= r.min_score)""")
def filtered_hits(spark, d):
    x = _hits(spark, d).join(_requests(spark, d), "istek_id")
    ok = (_C("filtre_daire").isNull() | (_C("daire") == _C("filtre_daire"))) & (_C("filtre_karar_turu").isNull() | (_C("karar_turu") == _C("filtre_karar_turu"))) & (_C("min_score").isNull() | (_C("score") >= _C("min_score")))
    return x.where(ok).select("istek_id", "chunk_id", round_exact(_C("score")).alias("score"))


@query(_UNIQUE + " SELECT istek_id, karar_id FROM u WHERE rank <= 10 UNION SELECT istek_id, any_value(karar_id) FROM (SELECT istek_id, karar_id FROM search_hits QUALIFY row_number() OVER (PARTITION BY istek_id ORDER BY sira, karar_id) = 1) GROUP BY istek_id")
def hard_negatives(spark, d):
    anchors = table(spark, d, "search_hits").groupBy("istek_id").agg(F.min_by("karar_id", F.struct("sira", "karar_id")).alias("karar_id"))
    return _unique(spark, d).where("rank <= 10").select("istek_id", "karar_id").union(anchors).distinct()


# ---- answers


_CHUNK_TEXTS = "(SELECT id, any_value(chunk_metni) chunk_metni FROM (SELECT id, chunk_metni FROM text_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_metni) = 1) GROUP BY id)"


def _sources(spark, d):
    texts = table(spark, d, "text_chunks").groupBy(_C("id").alias("chunk_id")).agg(F.min("chunk_metni").alias("chunk_metni"))
    return answers.context_prefix(_unique(spark, d).join(texts, "chunk_id"), "istek_id", "rank", _C("chunk_metni"))


_CONTEXT = _UNIQUE + f""", s AS (SELECT u.*, t.chunk_metni, sum(length(t.chunk_metni)) OVER (PARTITION BY u.istek_id ORDER BY u.rank ROWS UNBOUNDED PRECEDING) run FROM u JOIN {_CHUNK_TEXTS} t ON u.chunk_id = t.id),
p AS (SELECT *, 'K' || row_number() OVER (PARTITION BY istek_id ORDER BY rank) label FROM s WHERE run <= 12000)"""


@query(_CONTEXT + " SELECT istek_id, chunk_id, CAST(run AS BIGINT) AS context_chars, label FROM p")
def context_sources(spark, d):
    return _sources(spark, d).select("istek_id", "chunk_id", "context_chars", "label")


@query(_CONTEXT + " SELECT istek_id, count(*) AS n_sources, count(*) >= 2 AS answered FROM p GROUP BY 1")
def source_gate(spark, d):
    return answers.enough_sources(_sources(spark, d), "istek_id")


_BLOCK = """'[' || label || ']' || chr(10) || 'Daire: ' || daire || chr(10) || 'Esas no: ' || coalesce(esas_no, 'Kaynakta yok') || chr(10) || 'Karar no: ' || coalesce(karar_no, 'Kaynakta yok') || chr(10) || 'Karar tarihi: ' || coalesce(karar_tarihi, 'Kaynakta yok') || chr(10) ||
'Başlık: ' || baslik || chr(10) || 'Veri kalitesi uyarıları: ' || coalesce(nullif(array_to_string(list_transform(veri_kalite_uyarilari, lambda w: CASE WHEN w = 'kaynak_metin_2000_karakter_sinirinda' THEN 'kaynak metin 2.000 karakter sınırında bitiyor ve kararın tamamını içermeyebilir' ELSE 'kaynakta belirtilen ek bir veri kalitesi uyarısı bulunuyor' END), '; '), ''), 'Yok')
|| chr(10) || 'Karar parçası:' || chr(10) || chunk_metni || chr(10) || '[/' || label || ']'"""


@query(_CONTEXT + f", t AS (SELECT DISTINCT ON (id) id, daire, esas_no, karar_no, karar_tarihi, baslik, veri_kalite_uyarilari, chunk_metni FROM text_chunks ORDER BY id, chunk_metni) SELECT p.istek_id, p.label, {_BLOCK.replace('daire', 't.daire').replace('chunk_metni', 't.chunk_metni')} AS block FROM p JOIN t ON p.chunk_id = t.id")
def prompt_sources(spark, d):
    """The sources of each request as they stand in the prompt."""
    kept = records.once(table(spark, d, "text_chunks"), "id", [_C("chunk_metni")]).select(_C("id").alias("chunk_id"), "daire", "esas_no", "karar_no", "karar_tarihi", "baslik", "veri_kalite_uyarilari", "chunk_metni")
    x = _sources(spark, d).select("istek_id", "chunk_id", "label").join(kept, "chunk_id")
    names = ("label", "daire", "esas_no", "karar_no", "karar_tarihi", "baslik", "veri_kalite_uyarilari", "chunk_metni")
    return x.select("istek_id", "label", answers.source_block(*(_C(n) for n in names)).alias("block"))


_ANSWER = "'Değerlendirme [' || string_agg(label, ', ' ORDER BY rank) || '] ve [K9]. ' || CASE WHEN istek_id % 3 = 0 THEN '' ELSE '" + answers.CLOSING + "' END"


def _answers(spark, d):
    """An extractive answer from the sources of each request; every third lacks the closing sentence."""
    x = _sources(spark, d).groupBy("istek_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("s"))  # at most 20 sources
    labels = F.transform("s", lambda e: e["label"])
    closing = F.when(_C("istek_id") % 3 == 0, "").otherwise(answers.CLOSING)
    return x.select("istek_id", labels.alias("labels"), F.concat(F.lit("Değerlendirme ["), F.array_join(labels, ", "), F.lit("] ve [K9]. "), closing).alias("answer"))


@query(_CONTEXT + f", a AS (SELECT istek_id, {_ANSWER} answer, list(label) labels FROM p GROUP BY istek_id) SELECT istek_id, CAST(len(labels) AS BIGINT) + CASE WHEN list_contains(labels, 'K9') THEN 0 ELSE 1 END AS n_cited FROM a")
def answer_citations(spark, d):
    return _answers(spark, d).select("istek_id", F.size(X.citation_labels(_C("answer"))).cast("long").alias("n_cited"))


@query(_CONTEXT + f""", a AS (SELECT istek_id, {_ANSWER} answer, list(label) labels FROM p GROUP BY istek_id) SELECT istek_id, array_to_string(list_filter([CASE WHEN NOT list_contains(labels, 'K9') THEN 'unknown_citation' END,
CASE WHEN NOT ends_with(trim(answer), '{answers.CLOSING}') THEN 'no_closing' END], lambda x: x IS NOT NULL), ',') AS faults FROM a""")
def answer_faults(spark, d):
    return _answers(spark, d).select("istek_id", F.array_join(answers.answer_faults(_C("answer"), _C("labels")), ",").alias("faults"))


# ---- evaluation: a request with a chamber filter is answerable, its chamber is what is to be found


_CASES = f"(SELECT istek_id case_id, filtre_daire expected FROM {_REQUESTS})"
_POOL = f"(SELECT istek_id case_id, daire target, score, row_number() OVER (PARTITION BY istek_id ORDER BY score DESC, chunk_id) rank FROM {_HITS})"
_GRID = "(SELECT unnest([1, 3, 5, 10]) top_k) k, (SELECT unnest([0.5, 0.55, 0.6, 0.65]::DOUBLE[]) threshold) t"
_METRICS = f"""WITH o AS (SELECT c.case_id, c.expected, k.top_k, t.threshold, count(CASE WHEN h.rank <= k.top_k AND round(h.score, 6) >= t.threshold THEN 1 END) retained,
min(CASE WHEN h.rank <= k.top_k AND round(h.score, 6) >= t.threshold AND h.target = c.expected THEN h.rank END) first_match FROM {_CASES} c LEFT JOIN {_POOL} h ON c.case_id = h.case_id, {_GRID} GROUP BY 1, 2, 3, 4),
m AS (SELECT top_k, threshold, coalesce(avg(CASE WHEN expected IS NOT NULL THEN CASE WHEN first_match IS NOT NULL THEN 1 ELSE 0 END END), 0) recall, coalesce(avg(CASE WHEN expected IS NOT NULL THEN coalesce(1.0 / first_match, 0) END), 0) mrr,
coalesce(avg(CASE WHEN expected IS NULL THEN CASE WHEN retained < 2 THEN 1 ELSE 0 END END), 0) rejection, coalesce(avg(CASE WHEN expected IS NULL THEN CASE WHEN retained = 0 THEN 1 ELSE 0 END END), 0) zero_result FROM o GROUP BY 1, 2)"""


def _cases(spark, d):
    cases = _requests(spark, d).select(_C("istek_id").alias("case_id"), _C("filtre_daire").alias("expected"))
    hits = search.ranked(_hits(spark, d), "istek_id", "score", "chunk_id").select(_C("istek_id").alias("case_id"), _C("daire").alias("target"), "score", "rank")
    return cases, hits


def _metrics(spark, d):
    return evaluate.metrics(evaluate.outcomes(*_cases(spark, d), evaluate.grid(spark, [1, 3, 5, 10], [0.5, 0.55, 0.6, 0.65])))


_R = "round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(rejection, 6) AS rejection, round(zero_result, 6) AS zero_result, round((recall + rejection) / 2, 6) AS balanced"


@query(_METRICS + f" SELECT CAST(top_k AS BIGINT) AS top_k, threshold, {_R} FROM m")
def retrieval_metrics_grid(spark, d):
    return _metrics(spark, d).select(_C("top_k").cast("long").alias("top_k"), "threshold", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "rejection", "zero_result", "balanced")))


@query(_METRICS + f", b AS (SELECT CAST(top_k AS BIGINT) AS top_k, threshold, {_R} FROM m) SELECT top_k, threshold, balanced FROM b ORDER BY balanced DESC, recall DESC, rejection DESC, mrr DESC, top_k, threshold DESC LIMIT 1")
def best_setting(spark, d):
    return evaluate.best(_metrics(spark, d)).select(_C("top_k").cast("long").alias("top_k"), "threshold", F.round("balanced", 6).alias("balanced"))


@query(f"""WITH x AS (SELECT c.case_id, c.expected, max(CASE WHEN h.target = c.expected AND h.rank <= 5 AND round(h.score, 6) >= 0.6 THEN 1 ELSE 0 END) hit, min(CASE WHEN h.target = c.expected THEN h.rank END) f,
count(CASE WHEN h.rank <= 5 AND round(h.score, 6) >= 0.6 THEN 1 END) kept FROM {_CASES} c LEFT JOIN {_POOL} h ON c.case_id = h.case_id GROUP BY 1, 2)
SELECT case_id, CASE WHEN expected IS NULL THEN CASE WHEN kept < 2 THEN 'rejected' ELSE 'accepted' END WHEN hit = 1 THEN 'hit' WHEN f IS NULL THEN 'not_in_pool' WHEN f > 5 THEN 'below_rank' ELSE 'below_threshold' END AS outcome FROM x""")
def retrieval_errors(spark, d):
    return evaluate.errors(*_cases(spark, d), 5, 0.6)


@query(f"""WITH x AS (SELECT c.case_id, max(CASE WHEN h.target = c.expected THEN h.score END) y, max(CASE WHEN h.target <> c.expected THEN h.score END) n FROM {_CASES} c JOIN {_POOL} h ON c.case_id = h.case_id WHERE c.expected IS NOT NULL GROUP BY 1)
SELECT case_id, round(y - n, 6) AS margin FROM x""")
def score_margins(spark, d):
    return evaluate.margins(*_cases(spark, d)).select("case_id", F.round("margin", 6).alias("margin"))


_BAND = "CASE WHEN length(karar_metni) <= 800 THEN 'kisa' WHEN length(karar_metni) <= 1200 THEN 'orta' WHEN length(karar_metni) <= 1800 THEN 'uzun' ELSE 'cok_uzun' END"


@query(f"""WITH a AS (SELECT id, {_BAND} band, coalesce(karar_turu, 'bilinmiyor') kind, sha256(id || '|' || sha256(karar_metni)) key FROM {_ONCE}), b AS (SELECT *, row_number() OVER (PARTITION BY band, kind ORDER BY key, id) turn FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY turn, kind) place FROM b WHERE turn <= 6) SELECT id, band, kind, place FROM c WHERE place <= 6""")
def stratified_sample(spark, d):
    x = _decisions(spark, d).select("id", "karar_turu", F.sha2("karar_metni", 256).alias("h"), X.length_band(F.length("karar_metni")).alias("band"))
    s = evaluate.stratified_sample(x, "id", "band", "karar_turu", F.sha2(F.concat_ws("|", "id", "h"), 256), 6)
    return s.withColumn("place", _C("place").cast("long"))


# ---- chunks


_CARRIED = ("daire", "karar_turu", "esas_no", "karar_no", "karar_tarihi", "baslik", "kaynak")


@query()
def chunk_documents(spark, d):
    """Every decision in chunks, each with the metadata of its decision."""
    x = _decisions(spark, d).select("id", "karar_metni", *_CARRIED)
    return chunk.chunk_rows(x, "id", "karar_metni", carry=_CARRIED)


_BLANK = "[ \\t\\n\\r\\f\\v]"


@query(f"""SELECT id AS decision_id, CAST(length(regexp_replace(karar_metni, '{X.WHITE}', '', 'g')) AS BIGINT) AS ink, CAST(length(karar_metni) - length(regexp_replace(karar_metni, '^{X.WHITE}+', '')) AS BIGINT) AS first_char,
CAST(length(regexp_replace(karar_metni, '{X.WHITE}+$', '')) AS BIGINT) AS last_char, sha256(regexp_replace(karar_metni, '{X.WHITE}', '', 'g')) AS ink_sha256, true AS sizes_hold FROM {_ONCE} WHERE regexp_matches(karar_metni, '[^{X.WHITE[1:]}')""")
def chunk_coverage(spark, d):
    """What the chunks of a decision hold, put together again without their overlaps: it must be the text, blanks aside."""
    c = chunk.chunk_rows(_decisions(spark, d).select("id", "karar_metni"), "id", "karar_metni")
    fresh = F.regexp_replace(F.expr("substr(chunk_text, overlap_chars + 1)"), X.WHITE, "")
    parts = c.groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", fresh.alias("ink")))).alias("p"), F.min("start_char").alias("a"), F.max("end_char").alias("b"), F.max("n_chars").alias("n"), F.max("overlap_chars").alias("o"))
    ink = F.array_join(F.transform("p", lambda x: x["ink"]), "")  # the chunks of one text
    return parts.select("decision_id", F.length(ink).cast("long").alias("ink"), _C("a").cast("long").alias("first_char"), _C("b").cast("long").alias("last_char"), F.sha2(ink, 256).alias("ink_sha256"), ((_C("n") <= 1200) & (_C("o") <= 600)).alias("sizes_hold"))


#: The settings that are compared.
_CONFIGURATIONS = [(size, overlap, 250) for size in (800, 1200, 1600) for overlap in (100, 200, 300)]


@query()
def chunk_configurations(spark, d):
    """Chunk counts, mean length, share of natural boundaries and of repeated characters for nine settings, in one pass."""
    return chunk.compare_configurations(_decisions(spark, d).select("id", "karar_metni"), "karar_metni", _CONFIGURATIONS)


@query()
def chunk_embeddings(spark, d):
    x = table(spark, d, "text_chunks").select("id", "chunk_metni").dropDuplicates(["id"])
    return embedded(x, "chunk_metni").select("id", "vector", V.digest(_C("vector")).alias("digest"))


# ---- index and streams


_POINTS = f"(SELECT DISTINCT ON (point_id) point_id, chunk_id, daire, vector FROM chunk_vectors WHERE vector IS NOT NULL AND {_VALID} ORDER BY point_id, indekslenme_zamani DESC)"


def _points(spark, d):
    x = table(spark, d, "chunk_vectors").where(F.coalesce(V.is_valid(_C("vector"), 64), F.lit(False)))
    return x.select("point_id", "chunk_id", "daire", "vector", "indekslenme_zamani")


def _index(spark):
    from corpusloom.operators.index import VectorIndex

    index = VectorIndex(spark, fresh_path(spark, "index"), vector_col="vector", dim=64, distance="cosine", schema_version="1.0")
    index.ensure()
    return index


@query(f"SELECT point_id, chunk_id, CASE WHEN daire LIKE '9. %' THEN 'yeni' ELSE daire END AS daire, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), 4) AS vector_sum FROM {_POINTS}")
def index_upsert(spark, d):
    """All points with their vectors, then new values for those of one chamber, which replace the old ones."""
    x, index = _points(spark, d), _index(spark)
    index.upsert(x, "indekslenme_zamani")
    index.upsert(x.where(_C("daire").startswith("9. ")).withColumn("daire", F.lit("yeni")), "indekslenme_zamani")
    total = F.aggregate("vector", F.lit(0.0), lambda a, e: a + e.cast("double"))
    return index.current().select("point_id", "chunk_id", "daire", F.round(total, 4).alias("vector_sum"))


@query(f"SELECT point_id, chunk_id FROM {_POINTS} WHERE daire NOT LIKE '9. %' OR daire IS NULL")
def index_delete(spark, d):
    x, index = _points(spark, d), _index(spark)
    index.upsert(x, "indekslenme_zamani")
    index.delete(x.where(_C("daire").startswith("9. ")).select("point_id"))
    return index.current().select("point_id", "chunk_id")


_CHUNKS = """(SELECT DISTINCT ON (id) * FROM text_chunks ORDER BY id, chunk_metni)"""
_RULES = """list_filter([CASE WHEN NOT coalesce(trim(id) <> '', false) THEN 'id' END, CASE WHEN NOT coalesce(trim(chunk_metni) <> '', false) THEN 'chunk_metni' END, CASE WHEN NOT coalesce(sha256(chunk_metni) = chunk_metni_sha256, false) THEN 'digest' END,
CASE WHEN NOT coalesce(length(chunk_metni) = karakter_sayisi, false) THEN 'length' END, CASE WHEN NOT coalesce(chunk_sirasi >= 1, false) THEN 'chunk_sirasi' END, CASE WHEN NOT coalesce(toplam_chunk >= chunk_sirasi, false) THEN 'toplam_chunk' END,
CASE WHEN NOT coalesce(trim(daire) <> '', false) THEN 'daire' END, CASE WHEN veri_kalite_uyarilari IS NULL THEN 'veri_kalite_uyarilari' END], lambda x: x IS NOT NULL)"""


def _chunk_rows(spark, d):
    """Each chunk once; rows written twice are equal."""
    return records.once(table(spark, d, "text_chunks"), "id", [_C("chunk_metni")])


@query(f"SELECT id AS chunk_id, karar_id, CAST(chunk_sirasi AS BIGINT) AS chunk_sirasi, chunk_metni_sha256, array_to_string(veri_kalite_uyarilari, ',') AS veri_kalite_uyarilari, 64 AS embedding_dimension FROM {_CHUNKS} WHERE len({_RULES}) = 0")
def index_payloads(spark, d):
    """The checked projection that is indexed."""
    points, _ = indexing.payloads(_chunk_rows(spark, d), "hashing", 64)
    return points.select("chunk_id", "karar_id", _C("chunk_sirasi").cast("long").alias("chunk_sirasi"), "chunk_metni_sha256", F.array_join("veri_kalite_uyarilari", ",").alias("veri_kalite_uyarilari"), "embedding_dimension")


@query(f"SELECT id AS chunk_id, karar_id, daire FROM {_CHUNKS} WHERE len({_RULES}) = 0")
def index_resume(spark, d):
    """A resumable run over the chunks that fails in its second batch, and a second run that goes on from there."""
    from corpusloom.operators.index import VectorIndex

    source, chunks = fresh_path(spark, "chunks"), _chunk_rows(spark, d)
    _, rejected = indexing.payloads(chunks, "hashing", 64)
    chunks.join(rejected.select("id"), "id", "left_anti").select(*chunks.columns).repartition(4, "id").write.parquet(source)
    index = VectorIndex(spark, fresh_path(spark, "index"), vector_col="vector", dim=64, model="hashing")
    job = indexing.ResumableIndexing(spark, fresh_path(spark, "indexing"), index, "hashing", 64, files_per_batch=2, attempts=2)

    def fail_once(batch: int) -> None:
        if batch == 1 and job.state()["failed_attempts"] < 2:
            raise ConnectionError("the store is away")

    try:
        job.run(source, chunks.schema, fail_once)
    except Exception as x:  # both attempts of the second batch
        if job.state()["batches"] != 1:
            raise x
    job.run(source, chunks.schema, fail_once)
    return index.current().select("chunk_id", "karar_id", "daire")


@query(f"WITH c AS (SELECT id, row_number() OVER (ORDER BY id) place, count(*) OVER () n FROM {_CHUNKS}) SELECT place, id FROM c WHERE place IN (1, (n + 1) // 2, n)")
def index_source_samples(spark, d):
    return indexing.source_samples(_chunk_rows(spark, d), "id").select("place", "id")


@query("SELECT id, daire, kaynak FROM (SELECT id, daire, kaynak FROM imported_decisions WHERE karar_metni IS NOT NULL AND length(karar_metni) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY yuklenme_zamani, kaynak_kayit_id) = 1)")
def stream_ingest(spark, d):
    """The decisions table as a stream of its files, taken in once for each id."""
    from corpusloom.streaming.ingest import IncrementalTable, run_available

    whole = table(spark, d, "imported_decisions")
    source = fresh_path(spark, "arrivals")
    x = whole.select("id", "daire", "kaynak", "yuklenme_zamani", "kaynak_kayit_id", F.length("karar_metni").alias("n"))
    x.repartition(3, "id").write.parquet(source)
    schema = x.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    target = IncrementalTable(fresh_path(spark, "ingested"), "id", ["yuklenme_zamani", "kaynak_kayit_id"], {"id": _C("id").isNotNull(), "text": _C("n") > 0})
    run_available(stream, target, fresh_path(spark, "progress"))
    return target.rows(spark, T.StructType(list(schema))).select("id", "daire", "kaynak")


@query("SELECT window_start, event_type, n, round(value, 4) AS value FROM (SELECT time_bucket(INTERVAL '1 hour', ts) window_start, event_type, count(*) n, sum(value) value FROM events GROUP BY 1, 2)")
def hourly_events(spark, d):
    x = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return x.withColumn("value", F.round("value", 4))


@query()
def table_digest(spark, d):
    """The digests of the cleaned and of the chunked corpus."""
    parts = [records.order_free_digest(table(spark, d, name)).select(F.lit(name).alias("tablo"), "*") for name in ("imported_decisions", "text_chunks")]
    return parts[0].unionByName(parts[1])
