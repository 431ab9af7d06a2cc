import itertools
import random
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import p04_splitting as p04
from corpusloom.llm import p05_shared_spans as p05
from corpusloom.llm import p06_similar_vectors as p06
from corpusloom.llm import p07_format_duplicates as p07
from corpusloom.storage import shared_dir


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n!É", max_size=700), st.sampled_from([(60, 10), (100, 0), (50, 49)]))
def test_pieces(text, config):
    limit, overlap = config
    pieces, at = p04.split(text, limit, overlap), 0
    for k, (s, e, o, kind) in enumerate(pieces):
        assert 0 < e - s <= limit and e > at and 0 <= o <= overlap
        if k:
            assert (at - s == o if s < at else not text[at:s].strip())
        at = e
    assert not text[at:].strip()
    longest = max((len(w) for w in text.split()), default=0)
    if len(text) > limit:
        assert any(p[3] == p04.HARD for p in pieces) == (longest > limit)


def test_pieces_break_where_text_does():
    text = ("Bir cümle daha var. " * 20 + "\n\n") * 6
    assert {p04.KINDS[p[3]] for p in p04.split(text, 500, 100)} == {"paragraph", "end"}
    assert all(text[e - 1] == "." for _, e, _, _ in p04.split(text, 500, 100))


def test_split_columns(spark):
    x = spark.createDataFrame([("a", "x " * 900, 1), ("b", "k" * 1300, 1), ("c", "kısa", 1), ("d", None, 1)], "id string, t string, pieces_ int")
    got = {r["kayit"]: r["k"] for r in p04.oversized(x, "id", "t").select("kayit", p04.cut_kind(p04.F.col("pieces")).alias("k")).collect()}
    assert got == {"a": "dogal", "b": "zorunlu"}
    rows = p04.exploded(p04.oversized(x, "id", "t")).where("kayit = 'b'").orderBy("seq").collect()
    assert "".join(r["piece"][r["overlap"] :] for r in rows) == "k" * 1300
    assert p04.with_pieces(x.where("id = 'd'"), "t").first()["pieces"] is None
    assert p04.oversized(x.limit(0), "id", "t").count() == 0


def brute_spans(rows, n):
    grams = {}
    for i, t in rows:
        for s in range(len(t or "") - n + 1):
            grams.setdefault(t[s : s + n], set()).add(i)
    pairs, shared = set(), {}
    for ids in grams.values():
        pairs |= set(itertools.combinations(sorted(ids), 2))
    for i, t in rows:
        cover = set()
        for s in range(len(t or "") - n + 1):
            if len(grams[t[s : s + n]]) > 1:
                cover |= set(range(s, s + n))
        shared[i] = len(cover)
    return pairs, shared


def test_shared_spans(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    quote, other = word(55), word(40)
    rows = [(f"r{i:02d}", word(rng.randint(0, 200))) for i in range(25)]
    rows += [("q1", word(30) + quote + word(20)), ("q2", quote), ("q3", word(5) + quote[:41] + word(9)), ("q4", word(9) + other[:39] + word(9)), ("q5", other[:39])]
    rows += [("k1", rows[3][1] + "x" * 60), ("k2", rows[3][1] + "x" * 60), ("z1", "y" * 300), ("z2", "y" * 45 + word(20)), ("e", "")]
    x = spark.createDataFrame([*rows, rows[0], ("n", None), (None, quote)], "id string, t string")
    pairs, members = p05.shared_spans(x, "id", "t", min_chars=40, batches=3, max_runs=1)
    got = {(r["id_a"], r["id_b"]) for r in p05.record_pairs(pairs, members).collect()}
    truth, shared = brute_spans(dict(rows).items(), 40)
    assert got == truth
    amounts = {r["id"]: r["shared_chars"] for r in p05.shared_amounts(x, "id", "t", pairs, members, 40).collect()}
    assert {k: amounts[k] for k in shared} == shared and amounts["n"] == 0
    assert p05.record_pairs(*p05.shared_spans(x.limit(0), "id", "t")).count() == 0


def test_crowded_fingerprint(spark):
    quote = "Bu paragraf kırk kayıtta aynen durur ve bloklara bölünerek eşleştirilir."
    x = spark.createDataFrame([(f"d{i:02d}", f"{i} {i * 7919} " * 5 + quote) for i in range(40)], "id string, t string")
    classes = p05.text_classes(x, "id", "t", 60)
    log = p05.FingerprintLog(spark)
    assert log.append(p05.fingerprints(classes, 60), block=7).count() == 40 * 39 // 2


def shuffled(spark, run):
    """Bytes that a run shuffles without joins that Spark broadcasts by itself."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        time.sleep(0.3)
        spark.range(1).collect()  # brings the figures up to date
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = total()
        run()
        return total() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_only_texts_of_candidates_move(spark):
    rng = random.Random(5)
    rows = [(f"d{i:04d}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))) for i in range(1000)]
    rows[1] = ("d0001", rows[0][1][:500] + rows[1][1])
    classes = p05.text_classes(spark.createDataFrame(rows, "id string, t string"), "id", "t", 300)
    tids = {r["record"]: r["tid"] for r in classes.where("record < 'd0002'").collect()}
    candidates = spark.createDataFrame([(tids["d0000"], tids["d0001"])], "tid_a binary, tid_b binary")
    found = []
    assert shuffled(spark, lambda: found.extend(p05.verify(candidates, classes, 300).collect())) < 100_000
    assert len(found) == 1 and [tuple(x) for x in found[0]["spans_a"]] == [(0, 500)]


def test_only_shared_fingerprints_move(spark):
    rows = spark.range(100_000).select(F.xxhash64("id").alias("fp"), F.unhex(F.md5(F.col("id").cast("string"))).alias("tid"), F.lit(None).cast("long").alias("before"))
    again = rows.limit(3).withColumn("tid", F.unhex(F.md5("tid")))
    found = p05.FingerprintLog(spark).append(rows.unionByName(again))
    assert shuffled(spark, lambda: found.collect()) < 100_000
    assert found.count() == 3


def test_log_leaves_no_runs(spark, monkeypatch):
    written, write = [], p05.FingerprintLog._write
    monkeypatch.setattr(p05.FingerprintLog, "_write", lambda log, rows: written.append(write(log, rows)) or written[-1])
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    x = spark.createDataFrame([(f"d{i}", f"{i * 7919} " * 20 + "Bu paragraf üç kayıtta aynen durur." * (i < 3)) for i in range(9)], "id string, t string")
    pairs, members = p05.shared_spans(x, "id", "t", min_chars=30, batches=3, max_runs=1)
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before}
    assert len(written) == 4 and left <= {"candidates", "shared"}  # three batches, compacted before the third
    assert {("d0", "d1"), ("d0", "d2"), ("d1", "d2")} <= {tuple(r) for r in p05.record_pairs(pairs, members).collect()}


def brute_hits(v, k):
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize("least", [None, 0.85])
def test_similar_vectors(spark, least):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[300:] = v[:300] + 0.25 * rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(f"c{i:04d}", [float(a) for a in r]) for i, r in enumerate(v)]
    bad = [("x1", None), ("x2", [0.0] * 16), ("x3", [1.0] * 3), ("x4", [float("nan")] * 16), (None, [1.0] * 16), ("x5", [float("inf")] * 16)]
    x = spark.createDataFrame([*rows, *rows[:20], *bad], "id string, v array<float>")
    hits = p06.similar_vectors(x, "id", "v", k=3, dim=16, min_score=least, block=64, **({"probes": 13, "fineness": 0.4} if least is None else {})).collect()
    s, top = brute_hits(v, 3)
    want = {(f"c{i:04d}", f"c{j:04d}") for i, row in enumerate(top) for j in row if least is None or s[i, j] >= least}
    got = {(r["id"], r["neighbour"]) for r in hits}
    assert len(got & want) >= 0.9 * len(want)
    assert all(abs(r["score"] - s[int(r["id"][1:]), int(r["neighbour"][1:])]) < 2e-4 for r in hits)
    assert all(r["rank"] <= 3 for r in hits)


def test_equal_vectors(spark):
    rows = [(f"e{i}", [1.0, 2.0, 0.0, 0.0]) for i in range(9)] + [("f", [1.0, 2.0, 0.1, 0.0]), ("g", [0.0, 0.0, 0.0, 5.0])]
    x = spark.createDataFrame(rows, "id string, v array<float>")
    hits = p06.similar_vectors(x, "id", "v", k=2, dim=4, min_score=0.9).collect()
    by = {}
    for r in sorted(hits, key=lambda r: (r["id"], r["rank"])):
        by.setdefault(r["id"], []).append(r["neighbour"])
    assert by["e5"] == ["e0", "e1"] and by["e0"] == ["e1", "e2"] and by["f"] == ["e0", "e1"] and "g" not in by
    assert p06.similar_vectors(x.limit(0), "id", "v", dim=4).count() == 0


HEAD = ["MAHKEMESİ : Ankara 1. İş Mahkemesi", "TARİHİ : 01.02.2003", "NUMARASI : 2003/12", "SUÇ : Hakaret"]
BODY = "Işıklar ilçesinde keşif yapılmış, değer 12,5 TL bulunmuştur. Karar verildi."


def test_format_duplicates(spark):
    text = lambda head, body: "\n".join(head) + "\n\n" + body
    rows = [
        ("a", text(HEAD, BODY), "2003/1", "2004/2"),
        ("b", text(HEAD, BODY).upper(), "2003-1", " 2004/2"),
        ("c", text([HEAD[2], HEAD[0], HEAD[3], HEAD[1]], BODY.lower()), "2003/1", "2004/2"),
        ("d", " ".join(text(HEAD, BODY).split()).replace(",", ""), "2003/1.", "2004/2"),
        ("e", "\n".join([HEAD[3], *HEAD[:3], BODY]), "2003/1", "2004/2"),
        ("n1", text(HEAD, BODY.replace("12,5", "12,6")), "2003/1", "2004/2"),
        ("n2", text(HEAD, BODY.replace("12,5", "52,1")), "2003/1", "2004/2"),
        ("n3", text(HEAD, "Karar verildi. Işıklar ilçesinde keşif yapılmış, değer 12,5 TL bulunmuştur."), "2003/1", "2004/2"),
        ("n4", text(HEAD, BODY), "2003/9", "2004/2"),
        ("m1", "tek", None, "-"),
        ("m2", "TEK.", "-", None),
        ("n", None, "1", "2"),
        ("o", "", "1", "2"),
    ]
    x = spark.createDataFrame([*rows, rows[0]], "id string, t string, e string, k string")
    pairs = {(r["id_a"], r["id_b"]) for r in p07.group_pairs(p07.copy_groups(x, "id", "t", ["e", "k"])).collect()}
    assert pairs == set(itertools.combinations("abcde", 2)) | {("m1", "m2")}
    copies = {r["id"]: r["copies"] for r in p07.collapse(x, "id", "t", ["e", "k"]).collect()}
    assert copies["a"] == 5 and copies["m1"] == 2 and copies["n1"] == 1 and "n" not in copies and copies["o"] == 1
    assert p07.copy_groups(x.limit(0), "id", "t", ["e", "k"]).count() == 0


def test_leaves_and_roots():
    flat, loose = p07._leaves(["abc", "CBA.", "abd", "a b\nc"], [("1/2",), ("12",), ("1/2",), ("1-2",)])
    assert flat[0] == flat[3] != flat[1] and loose[0] == loose[1] != loose[2]
    label = p07._label_pattern(["suç", "tarihi"])
    one, two = (dict((r, e) for e, r in p07.roots(t, b"", label)) for t in ("SUÇ : x y\nTARİHİ : 1.2\nGövde metni", "tarihi 1 2 suç x y gövde metni"))
    both = set(one) & set(two)
    assert both and all(p07.structure("SUÇ : x y\nTARİHİ : 1.2\nGövde metni", one[r], label) == p07.structure("tarihi 1 2 suç x y gövde metni", two[r], label) for r in both)
    assert not p07.roots("başlıksız", b"", label)


def test_headers_have_no_limits(spark):
    long = ["SUÇ : " + "uzun bir suç listesi ve " * 30, "MAHKEMESİ : Ankara 1. İş Mahkemesi", "TARİHİ : 01.02.2003"]
    lead = "önce gelen bir söz " * 70
    other = [f"HÂKİM : {'Bir'}", f"KÂTİP : {'İki'}", "SUÇ : Hakaret"]
    rows = [
        ("a", "\n".join([*long, BODY])),
        ("b", "\n".join([long[1], long[2], long[0], BODY])),
        ("c", lead + "\n" + "\n".join([*HEAD, BODY])),
        ("d", " ".join([lead, *HEAD[::-1], BODY]).upper()),
        ("e", "\n".join([*other, "", BODY])),
        ("f", "\n".join([*other[::-1], BODY])),
        *((f"x{i}", f"HÂKİM : {i}\nKÂTİP : {i}\n\n{i} ayrı metin") for i in range(40)),  # from which labels are learnt
    ]
    x = spark.createDataFrame(rows, "id string, t string")
    got = p07.group_pairs(p07.copy_groups(x, "id", "t", [], block=1))
    assert {tuple(r) for r in got.collect()} == {("a", "b"), ("c", "d"), ("e", "f")}
