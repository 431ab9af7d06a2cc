from corpusloom.plans import registry


def test_digests_of_both_corpora(spark, tmp_path):
    def digests(name, chunks):
        spark.createDataFrame([("d1", "metin")], "id string, karar_metni string").write.parquet(f"{tmp_path}/{name}/imported_decisions.parquet")
        spark.createDataFrame(chunks, "id string, chunk_metni string").write.parquet(f"{tmp_path}/{name}/text_chunks.parquet")
        return {r["tablo"]: (r["rows"], r["digest"]) for r in registry.QUERIES["table_digest"](spark, f"{tmp_path}/{name}").collect()}

    a, b, c = digests("a", [("1", "x"), ("2", None)]), digests("b", [("2", None), ("1", "x")]), digests("c", [("1", "y"), ("2", None)])
    assert a == b and a["imported_decisions"] == c["imported_decisions"] and a["text_chunks"] != c["text_chunks"]
    assert {k: v[0] for k, v in a.items()} == {"imported_decisions": 1, "text_chunks": 2}
