import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import answers, chunk, evaluate, records, search
from corpusloom.operators.index import BadPoints, IndexMismatch, VectorIndex
from corpusloom.sources import jsonl, paged


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n!1é", max_size=900), st.sampled_from([(120, 20, 20), (100, 0, 1), (200, 150, 50)]))
def test_chunks_cover_the_text(text, config):
    size, overlap, least = config
    at, covered = -1, set()
    for seq, s, e, o, kind in chunk.chunk(text, size, overlap, least):
        assert 0 < e - s <= size and e > at and kind in ("paragraph", "sentence", "word", "hard")
        at = e
        covered.update(range(s, e))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_chunk_boundaries():
    assert {c[4] for c in chunk.chunk("kelime " * 80, 120, 20, 20)} >= {"word"}
    assert {c[4] for c in chunk.chunk("a" * 350, 120, 20, 20)} >= {"hard"}
    assert [c[1:3] for c in chunk.chunk("Bkz. md. 5. bir. İki üç.")] == [(0, 24)]
    with pytest.raises(ValueError):
        chunk.check_configuration(50, 0, 1)


def test_chunk_rows_and_coverage(spark):
    x = spark.createDataFrame([("d1", "Bir cümle. " * 300), ("d2", None), ("d3", ""), ("d4", "kısa")], "id string, t string")
    rows = chunk.chunk_rows(x, "id", "t")
    assert rows.where("chunk_id = 'd4:c0001'").first()["chunk_text"] == "kısa"
    got = {r["decision_id"]: r for r in chunk.coverage(x, "id", "t", rows).collect()}
    assert set(got) == {"d1", "d4"} and all(r["uncovered_ink"] == 0 for r in got.values())


def test_identity_keeps_the_longest(spark):
    x = spark.createDataFrame(
        [("a", "D", "1", "2", "kısa", None), ("b", "D", "1", "2", "daha uzun", None), ("c", "D", "-", "2", "x", None), ("d", "D", "-", "2", "x", None), ("e", "D", "1", "2", "daha uzun", "1.1.2020")],
        "id string, c string, e string, k string, t string, tarih string",
    )
    g = records.identity_groups(x, "id", "t", "tarih", ["c", "e", "k"])
    assert {r["id"] for r in g.where("identity_rank = 1").collect()} == {"e", "c", "d"}
    assert {(r["id"], r["duplicate_of_id"]) for r in records.duplicate_audit(g, "id").collect()} == {("a", "e"), ("b", "e")}


def test_labels_and_violations(spark):
    x = spark.createDataFrame([("a", "t", True, None), ("b", "t", False, "1")], "id string, t string, f boolean, e string")
    got = {r["id"]: r for r in records.quality_labels(x, "id", "t", "f", ["e"]).collect()}
    assert got["a"]["warnings"] == ["eksik_e", "kaynak_metin_2000_karakter_sinirinda", "ayni_metin_farkli_kararlarda"]
    assert got["b"]["warnings"] == ["ayni_metin_farkli_kararlarda"] and got["b"]["status"] == "uyarili"
    bad = records.violations(x, ["id"], {"e": F.col("e") == "1"})
    assert [r["id"] for r in bad.collect()] == ["a"]
    with pytest.raises(ValueError):
        records.fail_if_any(bad, "test")
    assert records.order_free_digest(x).first() == records.order_free_digest(x.orderBy(F.desc("id"))).first()


def test_knn_order_and_ties(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0])], "id long, v array<float>")
    q = spark.createDataFrame([(9, [0.9, 0.1, 0.0])], "id long, v array<float>")
    got = search.knn(q, x, "id", "v", 3, 3, item_rows=2).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == [1, 4, 2]
    assert search.knn(q, x, "id", "v", 3, 3, min_score=0.999).count() == 0
    assert search.knn(q.limit(0), x, "id", "v", 3, 3).count() == 0
    every = search.knn(x, x, "id", "v", 2, 3).select("query_id", "item_id", "rank")
    assert set(every.collect()) == set(search.knn(x, x, "id", "v", 2, 3, most_sent=2).select("query_id", "item_id", "rank").collect()) and every.count() == 8
    named = x.withColumn("id", F.concat(F.lit("n"), "id"))
    assert [r["item_id"] for r in search.knn(named.where("id = 'n1'"), named, "id", "v", 2, 3).orderBy("rank").collect()] == ["n4", "n2"]


def test_unique_decisions(spark):
    h = spark.createDataFrame([(1, "d1:c1", "d1", 0.9), (1, "d1:c2", "d1", 0.8), (1, "d2:c1", "d2", 0.7)], "q int, c string, d string, s double")
    got = search.unique_decisions(h, spark.createDataFrame([(1, 2)], "q int, top_k int"), "q", "s", "c", "d").orderBy("rank").collect()
    assert [(r["d"], r["rank"]) for r in got] == [("d1", 1), ("d2", 2)]


def test_request_checks():
    assert search.check_request("  kira  alacağı ", 5, None) == "kira alacağı"
    for bad in (("kısa", 5, None), ("x" * 4001, 5, None), ("yeterince uzun", True, None), ("yeterince uzun", 21, None), ("yeterince uzun", 5, 2.0)):
        with pytest.raises(ValueError):
            search.check_request(*bad)
    for bad in ({"bilinmeyen": 1}, {"daire": "  "}, {"metin_2000_karakter_sinirinda": "evet"}):
        with pytest.raises(ValueError):
            search.metadata_filter(**bad)


def test_metrics_fixture(spark):
    cases = spark.createDataFrame([("c1", "A"), ("c2", "B"), ("c3", None)], "case_id string, expected string")
    hits = spark.createDataFrame([("c1", 1, "A", 0.7), ("c2", 1, "X", 0.66), ("c2", 2, "B", 0.62), ("c3", 1, "Y", 0.55)], "case_id string, rank int, target string, score double")
    m = {(r["top_k"], r["threshold"]): r for r in evaluate.metrics(evaluate.outcomes(cases, hits, evaluate.grid(spark, [1, 3], [0.6, 0.65]))).collect()}
    assert (m[3, 0.6]["recall"], m[3, 0.6]["mrr"], m[3, 0.6]["rejection"], m[3, 0.6]["balanced"]) == (1.0, 0.75, 1.0, 1.0)
    assert m[1, 0.6]["recall"] == 0.5 and m[3, 0.65]["recall"] == 0.5
    chosen = evaluate.best(evaluate.metrics(evaluate.outcomes(cases, hits, evaluate.grid(spark, [1, 3], [0.6, 0.65])))).first()
    assert (chosen["top_k"], chosen["threshold"]) == (3, 0.6)
    assert {r["case_id"]: r["outcome"] for r in evaluate.errors(cases, hits, 1, 0.6).collect()} == {"c1": "hit", "c2": "below_rank", "c3": "rejected"}
    none = evaluate.metrics(evaluate.outcomes(cases.where("expected is not null"), hits, evaluate.grid(spark, [1], [0.6]))).first()
    assert none["rejection"] == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 39])
def test_summary_rounds_halves_to_even(spark, n):
    x = spark.createDataFrame([(i,) for i in range(n)], "v long")
    got = evaluate.numeric_summary(x, "v", {"p25": 0.25, "p50": 0.5, "p95": 0.95}).first()
    values = list(range(n))
    for name, f in (("p25", 0.25), ("p50", 0.5), ("p95", 0.95)):
        assert got[name] == (values[round((n - 1) * f)] if n else 0)


def test_answers(spark):
    ok = f"Değerlendirme [K1]. {answers.CLOSING}"
    x = spark.createDataFrame([(t,) for t in (ok, "", f"[K7] {answers.CLOSING}", f"davayı kesin kazanırsınız [K1] {answers.CLOSING}", "[K1] son yok")], "a string")
    got = [r[0] for r in x.select(answers.answer_faults(F.col("a"), F.array(F.lit("K1")))).collect()]
    assert got[0] == [] and "empty" in got[1] and got[2] == ["unknown_citation"] and got[3] == ["certainty"] and got[4] == ["no_closing"]
    noted = x.limit(1).select(answers.with_disclosure(F.col("a"), F.lit("[K1] eksik"))).first()[0]
    assert noted == f"Değerlendirme [K1].\n\nVeri kalitesi notu: [K1] eksik.\n\n{answers.CLOSING}"


def test_context_is_a_prefix(spark):
    s = spark.createDataFrame([(1, 1, "a" * 7000), (1, 2, "b" * 6000), (1, 3, "c"), (2, 1, "x" * 12001)], "q int, rank int, t string")
    got = [(r["q"], r["label"]) for r in answers.context_prefix(s, "q", "rank", F.col("t")).collect()]
    assert got == [(1, "K1")]


def test_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"), dim=2)
    index.ensure()
    index.ensure()
    with pytest.raises(IndexMismatch):
        VectorIndex(spark, str(tmp_path / "i"), dim=3).ensure()
    rows = lambda *r: spark.createDataFrame(r, "point_id string, n int")
    index.upsert(rows(("a", 1), ("b", 1)))
    index.upsert(rows(("b", 2), ("c", 2)))
    index.upsert(rows(("b", 2), ("c", 2)))
    assert {(r[0], r[1]) for r in index.current().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    index.delete(rows(("a", 0), ("nein", 0)))
    assert index.count() == 2 and index.get("b").first()["n"] == 2
    with pytest.raises(ValueError):
        index.upsert(rows(("x", 1), ("x", 2)))
    for n in range(6):  # more runs than are kept apart
        index.upsert(rows(("b", 10 + n), (f"d{n}", n)))
    index.delete(rows(("d0", 0)))
    assert {(r[0], r[1]) for r in index.current().collect()} == {("b", 15), ("c", 2), *((f"d{n}", n) for n in range(1, 6))}
    assert len(index._pointer()["runs"]) <= 5 and len(list((tmp_path / "i").glob("r-*"))) <= 2 * 6


def test_index_checks_vectors(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"), vector_col="v", dim=2)
    index.ensure()
    good = spark.createDataFrame([("a", [1.0, 0.0])], "point_id string, v array<float>")
    index.upsert(good)
    for bad in ([("b", [1.0])], [("b", None)], [("b", [0.0, 0.0])], [("b", [float("nan"), 1.0])], [(None, [1.0, 0.0])]):
        with pytest.raises(BadPoints):
            index.upsert(spark.createDataFrame(bad, "point_id string, v array<float>"))
    assert index.count() == 1


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\nkein json\n[1]\n{"id": "b"}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    good, bad = jsonl.split_quarantine(jsonl.read_lines(spark, str(p), schema))
    assert {r["id"] for r in good.collect()} == {"a", "b"} and sorted((r["number"], r["line"]) for r in bad.collect()) == [(2, ""), (3, "kein json"), (4, "[1]")]
    with pytest.raises(jsonl.BadLines, match="line 2"):
        jsonl.read_strict(spark, str(p), schema)
    jsonl.write_atomic(good, str(tmp_path / "out"))
    assert jsonl.read_published(spark, str(tmp_path / "out"), schema).count() == 2
    for n in range(3):
        jsonl.write_atomic(good.where("id = 'a'").withColumn("n", F.lit(n)), str(tmp_path / "out"))
    assert [r["n"] for r in jsonl.read_published(spark, str(tmp_path / "out"), schema).collect()] == [2] and len(list((tmp_path / "out").glob("v-*"))) == 2
    with pytest.raises(Exception):
        jsonl.write_atomic(good.withColumn("n", F.raise_error(F.lit("broken"))), str(tmp_path / "out"))
    assert jsonl.read_published(spark, str(tmp_path / "out"), schema).count() == 1
    import hashlib

    assert jsonl.file_digests(spark, str(p)).first()["sha256"] == hashlib.sha256(p.read_bytes()).hexdigest()


def test_jsonl_bytes_and_ids(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType())])
    p = tmp_path / "x.jsonl"
    p.write_bytes("\ufeff".encode() + b'{"id": "a"}\n{"id": "\xff"}\n{"id": "a"}\n')
    assert [(r["number"]) for r in jsonl.bad_lines(jsonl.read_lines(spark, str(p), schema)).collect()] == [2]
    p.write_text('{"id": "a"}\n{"id": "b"}\n{"id": "a"}\n', encoding="utf-8")
    assert jsonl.read_strict(spark, str(p), schema, expected_rows=3).count() == 3
    with pytest.raises(jsonl.BadLines, match="twice"):
        jsonl.read_strict(spark, str(p), schema, unique="id")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    assert [r["n"] for r in jsonl.select_in_order(rows, "id", ["c", "a"]).orderBy("place").collect()] == [3, 1]
    with pytest.raises(KeyError):
        jsonl.select_in_order(rows, "id", ["a", "x"])


def test_paged_source(spark, tmp_path):
    for n, size in ((1, 2), (2, 1)):
        rows = [{"id": f"{n}-{i}", "daire": "D"} for i in range(size)]
        (tmp_path / f"page-{n}.json").write_text("﻿" + json.dumps({"data": {"recordsFiltered": 3, "data": rows}}), encoding="utf-8")
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("corpus_pages").option("page_size", 2).load(str(tmp_path)).collect()
    assert sorted(r["id"] for r in got) == ["1-0", "1-1", "2-0"] and got[0]["esasNo"] is None
    assert [paged.expected_rows(p, 100, 250) for p in (1, 3, 4)] == [100, 50, 0]


def test_streamed_table_goes_on(spark, tmp_path):
    from corpusloom.streaming.ingest import IncrementalTable, run_available

    rows = lambda *r: spark.createDataFrame(r, "id string, n int")
    target = IncrementalTable(str(tmp_path / "t"), "id", ["n"], {"n": F.col("n") > 0})
    schema = rows().schema

    rows(("a", 2), ("a", 1), ("b", 0)).write.parquet(str(tmp_path / "in/1"))
    (tmp_path / "in").mkdir(exist_ok=True)
    stream_in = str(tmp_path / "in/*")
    run_available(spark.readStream.schema(schema).parquet(stream_in), target, str(tmp_path / "cp"))
    rows(("a", 5), ("c", 3)).write.parquet(str(tmp_path / "in/2"))
    run_available(spark.readStream.schema(schema).parquet(stream_in), target, str(tmp_path / "cp"))
    assert {(r["id"], r["n"]) for r in target.rows(spark, schema).collect()} == {("a", 1), ("c", 3)}
    assert [(r["id"], r["error"]) for r in target.failures(spark).collect()] == [("b", "n")]
    target.write(rows(("a", 5), ("c", 3)), 1)  # a repeated batch changes nothing
    assert target.rows(spark, schema).count() == 2


def test_no_import_of_the_subpackage():
    root = Path(__file__).resolve().parents[1] / "corpusloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "corpusloom.llm" not in p.read_text(encoding="utf-8"), p
