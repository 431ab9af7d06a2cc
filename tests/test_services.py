import json

import pytest

from corpusloom.functions.providers import HashingEmbedder
from corpusloom.operators.answers import CLOSING
from corpusloom.services import AnswerService, SearchService, Settings, Unavailable, load_cases, retried

TEXTS = [("d1:c1", "d1", "hukuk", "kira tespiti davası bedelin artırılması"), ("d1:c2", "d1", "hukuk", "kira bedeli davası"), ("d2:c1", "d2", "ceza", "hırsızlık suçu ve ceza davası"), ("d3:c1", "d3", "hukuk", "kira sözleşmesi feshi")]


@pytest.fixture(scope="module")
def service(spark):
    e = HashingEmbedder(32)
    rows = [(c, d, k, e.embed([t])[0]) for c, d, k, t in TEXTS]
    return SearchService(spark, spark.createDataFrame(rows, "chunk_id string, karar_id string, karar_turu string, vector array<double>"), Settings(dim=32, top_k=2), e)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(c, t) for c, _, _, t in TEXTS], "chunk_id string, chunk_metni string")


def test_search(service):
    got = service.search("kira tespiti davası").orderBy("rank").collect()
    assert [r["karar_id"] for r in got][0] == "d1" and len({r["karar_id"] for r in got}) == 2
    assert [r["karar_id"] for r in service.search("kira tespiti davası", karar_turu="ceza").collect()] == ["d2"]
    assert service.search("kira tespiti davası", min_score=0.999).count() == 0
    assert service.health()["points"] == 4


def test_answer(service, texts):
    got = AnswerService(service, texts).answer("kira tespiti davası")
    assert got["attempts"] == 1 and got["answer"].endswith(CLOSING) and len(got["sources"]) == 2
    assert AnswerService(service, texts).answer("kira tespiti davası", karar_turu="ceza") == {"answer": None, "sources": ["d2:c1"], "attempts": 0}
    said = iter(["kaynaksız", f"[K1] {CLOSING}"])
    assert AnswerService(service, texts, lambda q, s: next(said)).answer("kira tespiti davası")["attempts"] == 2
    with pytest.raises(Unavailable):
        AnswerService(service, texts, lambda q, s: "kaynaksız").answer("kira tespiti davası")


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retried(flaky, 3, 2.0, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        retried(lambda: {}["x"], 5, never=(KeyError,), sleep=waits.append)
    assert len(waits) == 2


def test_cases(spark, tmp_path):
    case = lambda i, ids: {"case_id": f"c{i}", "hukuk_alani": "x", "query": "soru", "expected_decision_ids": ids, "expected_chamber": "D" if ids else None, "rag_test": bool(ids)}
    p = tmp_path / "cases.json"
    p.write_text(json.dumps({"version": "1", "description": "", "cases": [case(i, ["d1"] if i % 2 else []) for i in range(10)]}))
    assert load_cases(spark, str(p)).count() == 10
    p.write_text(json.dumps({"version": "1", "description": "", "cases": [case(i, ["d1"]) for i in range(10)]}))
    with pytest.raises(ValueError):
        load_cases(spark, str(p))
