import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.numbers import round_exact
from corpusloom.operators import answers, chunk, cleaning, evaluate, importing, indexing
from corpusloom.operators.index import IndexMismatch, VectorIndex

SOURCE = "_id string, title string, text string, kurul string, esas_no string, karar_no string, tarih string"


def test_import_rules(spark):
    rows = [
        ("a", "Başlık", "a" * 2000, "10.Hukuk Dairesi", "-", "2020/1", "-"),
        ("b", "Başlık", "Kanun\u0092un maddesi\r\nson \u00a0\n", "Ceza Genel Kurulu", "2020/5", "2021/6", "1.2.2024"),
        ("c", "Başlık", "Bozuk\x01metin", "Danıştay 1. Daire", "20/5", None, "31.02.2024"),
        (" ", None, " ", None, "-", "-", "-"),
    ]
    records, rejected = importing.import_records(spark.createDataFrame(rows, SOURCE), "k", "u", "l")
    got = {r["id"]: r for r in records.collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["daire"] == "10. Hukuk Dairesi" and got["a"]["karar_turu"] == "hukuk" and got["a"]["metin_2000_karakter_sinirinda"] and got["a"]["esas_no"] is None and got["a"]["karar_no"] == "2020/1"
    assert got["b"]["karar_metni"] == "Kanun’un maddesi\nson" and got["b"]["karar_turu"] == "kurul" and not got["b"]["metin_2000_karakter_sinirinda"] and got["b"]["karar_tarihi"] == "1.2.2024"
    bad = {r["id"]: r["violated"] for r in rejected.collect()}
    assert bad["c"] == ["chamber", "text", "case_no", "decision_no", "date"] and bad[""] == ["id", "title", "chamber", "text"]
    measures = {r["measure"]: r["value"] for r in importing.import_report(records, rejected).collect()}
    assert measures["records"] == 2 and measures["at_limit"] == 1 and measures["kind_kurul"] == 1 and measures["rejected_text"] == 2
    empty = importing.import_records(spark.createDataFrame([], SOURCE), "k", "u", "l")
    assert empty[0].count() == 0 and empty[1].count() == 0


def _decision(i, text, **more):
    return {"id": i, "mahkeme": "Yargıtay", "daire": "1.Hukuk Dairesi", "karar_turu": "hukuk", "esas_no": "2020/1", "karar_no": "2020/2", "karar_tarihi": "1.1.2020", "baslik": "B", "karar_metni": text, "metin_2000_karakter_sinirinda": False, "ek": 7, **more}


DECISION = "id string, mahkeme string, daire string, karar_turu string, esas_no string, karar_no string, karar_tarihi string, baslik string, karar_metni string, metin_2000_karakter_sinirinda boolean, ek int"


def test_clean_job(spark):
    rows = [
        _decision("a", '<div>İçtihat&nbsp; Metni"</div><p>Karar&nbsp;  metni</p><script>gizli</script>'),
        _decision("b", "kısa", esas_no="2020/9"),
        _decision("c", "uzun\u200b metin", esas_no="2020/9"),
        _decision("d", "uzun metin", esas_no="-", karar_tarihi=None),
        _decision("e", "x", mahkeme="Başka"),
        _decision("f", None),
    ]
    records, audit, rejected, report = cleaning.clean_job(spark.createDataFrame(rows, DECISION))
    got = {r["id"]: r for r in records.collect()}
    assert set(got) == {"a", "c", "d"} and got["a"]["ek"] == 7 and got["a"]["daire"] == "1. Hukuk Dairesi"
    assert got["a"]["karar_metni"] == "İçtihat Metni\n\nKarar metni" and dict(zip(cleaning.ACTIONS, got["a"]["actions"])) == {"line_ends": 0, "entities": 1, "markup": 1, "unicode_spaces": 2, "zero_width": 0, "composed": 0, "layout": 1, "label_quote": 1}
    assert got["c"]["ayni_metin_kayit_sayisi"] == 2 and got["d"]["veri_kalite_uyarilari"] == ["eksik_esas_no", "eksik_karar_tarihi", "ayni_metin_farkli_kararlarda"] and got["a"]["veri_kalite_durumu"] == "gecerli"
    assert [(r["id"], r["duplicate_of_id"]) for r in audit.collect()] == [("b", "c")]
    assert {r["id"]: r["violated"] for r in rejected.collect()} == {"e": ["court"], "f": ["text"]}
    said = {r["measure"]: r["value"] for r in report.collect()}
    assert said["cleaned"] == 4 and said["duplicates_dropped"] == 1 and said["unicode_spaces_total"] == 2 and said["zero_width_records"] == 1 and said["status_uyarili"] == 2


CHUNK = "id string, karar_id string, chunk_sirasi int, toplam_chunk int, daire string, karar_turu string, esas_no string, karar_no string, karar_tarihi string, baslik string, chunk_metni string, chunk_metni_sha256 string, karakter_sayisi int, veri_kalite_uyarilari array<string>, veri_kalite_durumu string, metin_2000_karakter_sinirinda boolean, kaynak string"


def _chunk(i, text="kira alacağı davası", **more):
    import hashlib

    row = {"id": f"d:c{i:04d}", "karar_id": "d", "chunk_sirasi": i, "toplam_chunk": 9, "daire": "1. Hukuk Dairesi", "karar_turu": "hukuk", "esas_no": None, "karar_no": "1/2", "karar_tarihi": None, "baslik": "B", "chunk_metni": text, "chunk_metni_sha256": hashlib.sha256(text.encode()).hexdigest(), "karakter_sayisi": len(text), "veri_kalite_uyarilari": [], "veri_kalite_durumu": "gecerli", "metin_2000_karakter_sinirinda": False, "kaynak": "k"}
    return {**row, **more}


def test_payload_rules(spark):
    rows = [_chunk(1), _chunk(2, karakter_sayisi=1), _chunk(3, chunk_metni_sha256="x"), _chunk(4, toplam_chunk=3), _chunk(5, daire=" ", esas_no=""), _chunk(6, veri_kalite_uyarilari=None, metin_2000_karakter_sinirinda=None), _chunk(7, veri_kalite_uyarilari=[""])]
    points, bad = indexing.payloads(spark.createDataFrame(rows, CHUNK), "m", 8)
    assert [r["chunk_id"] for r in points.collect()] == ["d:c0001"] and points.first()["embedding_dimension"] == 8
    assert {r["id"][-1]: r["violated"] for r in bad.collect()} == {"2": ["length"], "3": ["digest"], "4": ["toplam_chunk"], "5": ["daire", "esas_no"], "6": ["veri_kalite_uyarilari", "metin_2000_karakter_sinirinda"], "7": ["veri_kalite_uyarilari"]}


def test_resumable_indexing(spark, tmp_path):
    source = str(tmp_path / "chunks")
    spark.createDataFrame([_chunk(i) for i in range(1, 9)], CHUNK).repartition(4, "id").write.parquet(source)
    index = VectorIndex(spark, str(tmp_path / "index"), vector_col="vector", dim=64)
    job = lambda **more: indexing.ResumableIndexing(spark, str(tmp_path / "job"), index, **{"model": "m", "dim": 64, **more})
    schema = spark.read.parquet(source).schema
    calls = []

    def away(batch):
        calls.append(batch)
        if batch == 1 and calls.count(1) <= 3:
            raise ConnectionError("away")

    with pytest.raises(Exception, match="away"):
        job().run(source, schema, away)
    assert calls == [0, 1, 1, 1] and job().state()["batches"] == 1 and job().failures().count() == 3 and 0 < index.count() < 8
    with pytest.raises(IndexMismatch):
        job(model="other").run(source, schema)
    state = job().run(source, schema, away)
    assert state["completed"] and state["indexed"] == 8 and index.count() == 8
    assert job().run(source, schema, away)["batches"] == state["batches"]  # nothing left


def test_source_samples(spark):
    for n in (1, 2, 5, 200):
        x = spark.createDataFrame([(f"{i:04d}",) for i in range(n)], "id string")
        assert {(r["place"], r["id"]) for r in indexing.source_samples(x, "id").collect()} == {(p, f"{p - 1:04d}") for p in {1, (n + 1) // 2, n}}
    assert indexing.source_samples(x.limit(0), "id").count() == 0


def test_round_exact(spark):
    rng = random.Random(1)
    v = [0.0, 1.0000005, 0.0078125, -0.0078125, 2.675, 5e-7, 1.5e-6, 7.9999995, 1e-9, 12.0000005, *(rng.randint(0, 2_000_000) / 1e6 + 5e-7 for _ in range(500)), *(rng.randint(0, 1 << 14) / (1 << 14) for _ in range(500))]
    got = spark.createDataFrame([(x,) for x in v if x < 8], "v double").select("v", round_exact(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in got] == [round(r["v"], 6) for r in got]
    assert spark.range(1).select(round_exact(F.lit(None).cast("double"))).first()[0] is None


def test_numeric_summary_against_plain(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 101, 500):
        v = [rng.randint(0, 60) for _ in range(n)]
        got = evaluate.numeric_summary(spark.createDataFrame([(x,) for x in [*v, None]], "v long"), "v", {"p25": 0.25, "median": 0.5, "p99": 0.99}).first()
        s = sorted(v)
        at = lambda f: s[round((n - 1) * f)] if n else 0
        assert (got["min"], got["max"], got["p25"], got["median"], got["p99"]) == ((s or [0])[0], (s or [0])[-1], at(0.25), at(0.5), at(0.99))
        assert abs(got["mean"] - (sum(v) / n if n else 0)) < 1e-9


def test_values_at_places(spark):
    rng = random.Random(3)
    rows = [(g, rng.random() // 0.01) for g in ("a", "a", "a", "b", None) for _ in range(rng.randint(30, 90))] + [("c", 1.0), ("d", None)]
    got = {r["g"]: r for r in evaluate.values_at(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p95": lambda n: F.expr("(total * 95 + 99) div 100"), "least": lambda n: F.lit(1)}).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g)
        assert r["n"] == len(v) and r["least"] == v[0] and r["p95"] == v[(len(v) * 95 + 99) // 100 - 1] and abs(r["sum"] - sum(v)) < 1e-9


def test_chunk_configurations(spark):
    x = spark.createDataFrame([("a", "Bir cümle burada biter. " * 60), ("b", "kısa"), ("c", None), ("d", " ")], "id string, t string")
    got = {r["configuration"]: r for r in chunk.compare_configurations(x, "t", [(800, 100, 250), (400, 100, 100)]).collect()}
    rows = chunk.chunk_rows(x, "id", "t", 400, 100, 100, carry=("id",))
    assert got["400_100"]["chunks"] == rows.count() and got["400_100"]["decisions"] == 2 and got["800_100"]["single_chunk"] == 1 and rows.where("id <> decision_id").count() == 0
    with pytest.raises(ValueError):
        chunk.compare_configurations(x, "t", [(800, 100, 250), (800, 100, 200)])
    assert X.parse_config("800:100") == (800, 100, 250) and X.parse_config("800/100/50") == (800, 100, 50)
    for bad in ("800", "a:b", "1:2:3:4"):
        with pytest.raises(ValueError):
            X.parse_config(bad)


def test_prompt(spark):
    x = spark.createDataFrame([("K1", "D", None, "1/2", None, "B", ["kaynak_metin_2000_karakter_sinirinda", "başka"], "metin", " soru ")], "label string, c string, e string, k string, d string, b string, w array<string>, t string, q string")
    block = x.select(answers.source_block(*(F.col(c) for c in ("label", "c", "e", "k", "d", "b", "w", "t"))).alias("b"), "q")
    text = block.first()["b"]
    assert text.startswith("[K1]\nDaire: D\nEsas no: Kaynakta yok\nKarar no: 1/2\n") and "; kaynakta belirtilen ek" in text and text.endswith("Karar parçası:\nmetin\n[/K1]")
    prompt = block.select(answers.user_prompt(F.col("q"), F.col("b"))).first()[0]
    assert prompt.startswith("KULLANICI OLAYI\nsoru\n\nKAYNAKLAR\n[K1]") and block.select(answers.user_prompt(F.lit(" "), F.col("b"))).first()[0] is None
