"""Source assembly and the checks of grounded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import citation_labels

CONTEXT_CHARS, LEAST_SOURCES, LONGEST_ANSWER = 12_000, 2, 20_000
#: Patterns of claims that an answer must not make, marks of a disclosed limit, and the closing sentence.
CERTAINTY = (r"davay[ıi]\s+kesin\s+kazan", r"kesin\s+olarak\s+hakl[ıi]", r"mahkeme\s+mutlaka", r"sonu[cç]\s+garanti")
DISCLOSURES = ("veri kalitesi notu:", "veri kalitesi uyar", "2000 karakter", "2.000 karakter", "tam metin", "metinlerin eksik", "metinler eksik")
CLOSING = "Somut olayın özelliklerine göre sonuç değişebilir; bu değerlendirme hukuki danışmanlık değildir."


#: What warnings mean, what an unknown one means, and what stands for a missing number.
WARNING_TEXTS = {"kaynak_metin_2000_karakter_sinirinda": "kaynak metin 2.000 karakter sınırında bitiyor ve kararın tamamını içermeyebilir"}
OTHER_WARNING, MISSING, NO_WARNING = "kaynakta belirtilen ek bir veri kalitesi uyarısı bulunuyor", "Kaynakta yok", "Yok"


def warning_text(warnings: Column) -> Column:
    """The meaning of an array of warnings, in its order."""
    known = F.create_map(*(F.lit(x) for pair in WARNING_TEXTS.items() for x in pair))
    return F.array_join(F.transform(warnings, lambda w: F.coalesce(F.element_at(known, w), F.lit(OTHER_WARNING))), "; ")


def source_block(label: Column, chamber: Column, case_no: Column, decision_no: Column, date: Column, title: Column, warnings: Column, text: Column) -> Column:
    """A source as it stands in the prompt."""
    said = warning_text(warnings)
    lines = [
        F.concat(F.lit("["), label, F.lit("]")),
        F.concat(F.lit("Daire: "), chamber),
        *(F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(MISSING))) for name, value in (("Esas no", case_no), ("Karar no", decision_no), ("Karar tarihi", date))),
        F.concat(F.lit("Başlık: "), title),
        F.concat(F.lit("Veri kalitesi uyarıları: "), F.when(said == "", NO_WARNING).otherwise(said)),
        F.lit("Karar parçası:"),
        text,
        F.concat(F.lit("[/"), label, F.lit("]")),
    ]
    return F.concat_ws("\n", *lines)


def user_prompt(query: Column, context: Column) -> Column:
    """The question and its sources; null where either is blank."""
    text = F.concat_ws("\n", F.lit("KULLANICI OLAYI"), F.trim(query), F.lit(""), F.lit("KAYNAKLAR"), context, F.lit(""), F.lit("Yalnızca yukarıdaki kaynaklara dayanarak değerlendirme üret."))
    return F.when((F.trim(query) != "") & (F.trim(context) != ""), text)


def context_prefix(sources: DataFrame, query_col: str, rank_col: str, text: Column, most: int = CONTEXT_CHARS) -> DataFrame:
    """The sources of each query, in order of rank, as long as their lengths together stay within ``most``; with a label and the running length."""
    w = W.partitionBy(query_col).orderBy(rank_col).rowsBetween(W.unboundedPreceding, 0)
    rows = sources.withColumn("context_chars", F.sum(F.length(text)).over(w)).where(F.col("context_chars") <= most)
    return rows.withColumn("label", F.format_string("K%d", F.row_number().over(W.partitionBy(query_col).orderBy(rank_col))))


def enough_sources(sources: DataFrame, query_col: str, least: int = LEAST_SOURCES) -> DataFrame:
    """(query, n_sources, answered): queries with fewer sources get no answer."""
    return sources.groupBy(query_col).agg(F.count("*").alias("n_sources")).withColumn("answered", F.col("n_sources") >= least)


def answer_faults(answer: Column, labels: Column) -> Column:
    """Names of the rules that an answer breaks, in order; an answer without a fault has none."""
    text = F.trim(answer)
    cited = citation_labels(text)
    certain = F.lit(False)
    for p in CERTAINTY:
        certain = certain | text.rlike("(?iu)" + p)
    checks = {
        "empty": F.coalesce(text, F.lit("")) == "",
        "too_long": F.length(text) > LONGEST_ANSWER,
        "bad_character": text.rlike("[\\x00\\x{FFFD}]"),
        "no_citation": F.size(cited) == 0,
        "unknown_citation": F.size(F.array_except(cited, labels)) > 0,
        "certainty": certain,
        "no_closing": ~F.endswith(text, F.lit(CLOSING)),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items())))


def is_disclosed(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for m in DISCLOSURES:
        out = out | F.contains(low, F.lit(m))
    return out


def with_disclosure(answer: Column, details: Column) -> Column:
    """The answer with a note before its closing sentence, where there are details that it does not disclose."""
    text = F.trim(answer)
    body = F.rtrim(F.substr(text, F.lit(1), F.length(text) - len(CLOSING)))
    noted = F.concat(F.regexp_replace(body, "\\s+$", ""), F.lit("\n\nVeri kalitesi notu: "), details, F.lit(".\n\n" + CLOSING))
    return F.when(is_disclosed(answer) | (F.coalesce(details, F.lit("")) == "") | ~F.endswith(text, F.lit(CLOSING)), answer).otherwise(noted)
