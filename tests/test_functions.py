import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions.providers import HashingEmbedder, embedded


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "source,text",
    [
        ("<div>İçtihat&nbsp; Metni\"</div><p>Karar&nbsp;  metni</p><script>gizli</script>", "İçtihat Metni\n\nKarar metni"),
        ("İçtihat Metni\"Adalet Bakanlığı açıklaması", "İçtihat Metni\n\nAdalet Bakanlığı açıklaması"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("x &lt; y", "x < y"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, source, text):
    assert one(spark, source, X.clean_text) == text


def test_text_functions(spark):
    assert one(spark, "10.Hukuk Dairesi", X.chamber) == "10. Hukuk Dairesi"
    assert [one(spark, c, X.decision_type) for c in ("Ceza Genel Kurulu", "1. Ceza Dairesi", "1. Hukuk Dairesi", "Başka")] == ["kurul", "ceza", "hukuk", "diger"]
    assert [one(spark, c, X.is_date) for c in ("1.2.2024", "31.02.2020", "-", "2020-01-01", None)] == [True, False, False, False, False]
    assert [one(spark, c, X.is_number) for c in ("2020/1", "20/1", None)] == [True, False, False]
    assert [one(spark, c, X.missing_as_null) for c in ("-", " x ", "", None)] == [None, "x", None, None]
    assert [one(spark, n, X.length_band, "int") for n in (800, 801, 1201, 1801)] == ["kisa", "orta", "uzun", "cok_uzun"]
    assert one(spark, "a" * 130, lambda c: X.preview(c, 120)) == "a" * 119 + "…"
    assert one(spark, "Kanun\u0092un maddesi", X.repair_quote) == "Kanun’un maddesi"
    assert one(spark, "Bozuk\x01metin", X.has_bad_characters) and not one(spark, "iyi\nmetin", X.has_bad_characters)
    assert one(spark, "é", X.nfc) == "é"
    assert one(spark, "a\n\nb\n \n\nc", X.paragraph_count) == 3


def test_point_id_is_a_uuid5(spark):
    space = uuid.UUID(X.POINT_NAMESPACE)
    for name in ("d1:c0001", "İçtihat", "x" * 200):
        assert one(spark, f" {name} ", X.point_id) == str(uuid.uuid5(space, name))


def test_section_markers(spark):
    text = "İçtihat Metni\n\nMAHKEMESİ: Ankara\n\nÖZET\n\nKARAR\n\nSONUÇ"
    assert one(spark, text, X.section_markers) == ["ictihat_metni", "mahkemesi", "karar", "sonuc", "ozet"]
    assert one(spark, "hukukİ süreç", X.section_markers) == ["hukuki_surec"]


def test_citations(spark):
    assert one(spark, "a [K1, K2] b [K2] [X] [K10]", X.citation_labels) == ["K1", "K2", "K10"]


def test_vectors(spark):
    x = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in x.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, -1.0, None, None]
    y = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([None, 1.0],)], "v array<float>")
    assert [r[0] for r in y.select(V.is_valid(F.col("v"), 2)).collect()] == [True, False, False, False, False, False]


def test_embedding_is_stable(spark):
    a = HashingEmbedder(16).embed(["kira alacağı", "kira"])
    assert a == HashingEmbedder(16).embed(["kira alacağı", "kira"]) and abs(sum(v * v for v in a[0]) - 1) < 1e-9
    with pytest.raises(ValueError):
        HashingEmbedder().embed(["  "])
    got = embedded(spark.createDataFrame([(1, "kira"), (2, None), (3, "")], "id int, t string"), "t", HashingEmbedder(8)).orderBy("id").collect()
    assert len(got[0]["vector"]) == 8 and got[1]["vector"] is None and got[2]["vector"] is None
