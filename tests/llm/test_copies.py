import random

from corpusloom.llm import p03_truncation as p03


def test_copies_leave_the_model_as_it_is(spark):
    rng = random.Random(8)
    words = [f"kelime{i}" for i in range(40)]
    body = lambda: " ".join(rng.choices(words, k=30))
    rows = [(f"a{i}", f"{body()}. Gereği yapıldı, dosya kapatıldı.") for i in range(20)] + [(f"b{i}", f"{body()}. Davanın reddine.") for i in range(40)]
    quoting = f"{body()}. Dosya kapatıldı denilmiş, {body()}. Davanın reddine."
    plain = spark.createDataFrame([*rows, ("q", quoting)], "id string, t string")
    copied = spark.createDataFrame([*rows, ("q", quoting), *((f"q{i}", quoting) for i in range(300)), *((None, quoting) for _ in range(30))], "id string, t string")
    scores = [{r["id"]: (round(r["log_odds"], 6), round(r["threshold"], 6), r["cut"]) for r in p03.truncated(x, "id", "t").collect()} for x in (plain, copied)]
    assert scores[0] == {k: scores[1][k] for k in scores[0]} and len(scores[1]) == 361
