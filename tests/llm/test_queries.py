from corpusloom.llm import queries


def test_pieces_of_both_tables(spark, tmp_path):
    spark.createDataFrame([("d1", "söz " * 400), ("d2", "kısa")], "id string, karar_metni string").write.parquet(f"{tmp_path}/imported_decisions.parquet")
    spark.createDataFrame([("d1:c0001", "k" * 1300), ("d1:c0001", "k" * 1300), ("d1:c0002", "kısa"), ("d1:c0003", None)], "id string, chunk_metni string").write.parquet(f"{tmp_path}/text_chunks.parquet")
    rows = queries.p4_pieces(spark, str(tmp_path)).orderBy("tablo", "kayit", "seq").collect()
    assert {(r["tablo"], r["kayit"]) for r in rows} == {("imported_decisions", "d1"), ("text_chunks", "d1:c0001")}
    chunk = [r for r in rows if r["tablo"] == "text_chunks"]
    assert [r["seq"] for r in chunk] == [1, 2] and "".join(r["piece"][r["overlap"] :] for r in chunk) == "k" * 1300


def test_unified_texts_of_both_tables(spark, tmp_path):
    spark.createDataFrame([("d1", "pay"), ("d2", "рау"), ("d3", None)], "id string, karar_metni string").write.parquet(f"{tmp_path}/imported_decisions.parquet")
    spark.createDataFrame([(1, "DAVA"), (2, "ＤＡＶＡ"), (3, "başka")], "istek_id long, olay string").write.parquet(f"{tmp_path}/search_requests.parquet")
    groups = {tuple(r) for r in queries.p2_look_alike_groups(spark, str(tmp_path)).select("tablo", "grp", "records", "forms").collect()}
    assert groups == {("imported_decisions", "d1", 2, 2), ("search_requests", "1", 2, 2)}
    rows = {tuple(r) for r in queries.QUERIES["p2_unified"](spark, str(tmp_path)).select("tablo", "kayit", "unified").collect()}
    assert rows == {("imported_decisions", k, v) for k, v in (("d1", "pay"), ("d2", "pay"), ("d3", None))} | {("search_requests", k, v) for k, v in (("1", "DAVA"), ("2", "DAVA"), ("3", "başka"))}
