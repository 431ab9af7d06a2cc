import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import p01_markup as p01
from corpusloom.llm import p02_lookalikes as p02
from corpusloom.llm import p03_truncation as p03
from corpusloom.llm import p08_packing as p08
from corpusloom.llm import p09_mixing as p09
from corpusloom.llm import p10_personal_information as p10


@pytest.mark.parametrize(
    "source,kinds",
    [
        ("<h2>Başlık</h2><p>metin</p>", ["baslik"]),
        ("Başlık\n-----\n\nmetin", ["baslik"]),
        ("== Başlık ==\nmetin", ["baslik"]),
        ("\\section*{Başlık} metin", ["baslik"]),
        ("**KARAR**\n\nKARAR\n\nmetin", []),
        ("<ul><li>a<li>b</ul>", ["liste"]),
        ("- a\n- b", ["liste"]),
        ("#bir\n#iki", ["liste"]),
        ("1. bir\n2. iki", ["liste"]),
        ("3. Hukuk Dairesi kararına göre belirlenmiştir.", []),
        ("Dosya # 81 ile klasör # 502", []),
        ("<table><tr><td>a<td>b</table>", ["tablo"]),
        ("| a | b |\n|---|---:|\n| 1 | 2 |", ["tablo"]),
        ('{| class="wikitable"\n|-\n| a || b\n|}', ["tablo"]),
        ("\\begin{tabular}{lr}\na & 1 \\\\\nb & 2\n\\end{tabular}", ["tablo"]),
        ("```sql\nSELECT 1\n- x\n- y\n```", ["kod"]),
        ("<pre><code>if (a &lt; 1) {\n}</code></pre>", ["kod"]),
        ('<syntaxhighlight lang="python">\nx = 1\n</syntaxhighlight>', ["kod"]),
        ("<math><mi>x</mi></math>", ["formul"]),
        ("Hesap $K = \\sum_i u_i$ biçimindedir.", ["formul"]),
        ("Fatura bedeli $ 418 ve masraf $ 18 tutarındadır.", []),
        ("&lt;h5&gt;Başlık&lt;/h5&gt;", ["baslik"]),
        ("<!-- <h2>x</h2> --><script>var s = '<ul><li>x</li></ul>';</script><style>h1 { }</style>", []),
        ("", []),
    ],
)
def test_structures(source, kinds):
    assert p01.convert(source)[1] == kinds


def test_clean_text_keeps_structure():
    text, kinds = p01.convert("<html><body><h2>Olay &amp; Olgu</h2><p>Bir <b>iki</b>&nbsp;üç.</p><ol><li>a<li>b</ol><pre>x &lt; 1\n  y</pre><table><tr><td>k</td><td>1</td></tr></table></body></html>")
    assert text == "## Olay & Olgu\n\nBir iki üç.\n\n1. a\n2. b\n\n```\nx < 1\n  y\n```\n\n| k | 1 |"
    assert kinds == ["baslik", "kod", "liste", "tablo"]


def test_furniture_goes():
    body = "".join(f"<p>{'Uzun bir cümle, virgüllü ve noktalı. ' * 8}</p>" for _ in range(6))
    text, _ = p01.convert(f"<body><nav><div>Ana</div><div>Ara</div></nav><main>{body}</main></body>")
    assert "Ana" not in text and text.count("Uzun") == 48


def test_tag_paths_decide_about_structures(monkeypatch):
    nav = "<nav><ul>" + "".join(f"<li><a href='#'>{x}</a></li>" for x in "Ana Arama Kararlar Daireler Yardım Üyelik".split()) + "</ul></nav>"
    para = "<p>" + "Dosyadaki rapor, keşif tutanağı ve tanık anlatımları birlikte değerlendirildiğinde, hüküm kurulması doğru görülmemiştir. " * 2 + "</p>"
    page = f"<body>{nav}<h2>GEREKÇE</h2>{para * 5}<table><tr><td>Gider</td><td>12,5 TL</td></tr></table>{para * 3}</body>"
    text, kinds = p01.convert(page)
    assert kinds == ["baslik", "tablo"] and "Arama" not in text and "## GEREKÇE" in text
    monkeypatch.setattr(p01, "content_nodes", lambda nodes: [True] * len(nodes))
    assert p01.convert(page)[1] == ["baslik", "liste", "tablo"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/&;ab h2uli=\"'\n#*-|$\\{}[]`~", max_size=200))
def test_any_page_converts(source):
    text, kinds = p01.convert(source)
    assert set(kinds) <= {"baslik", "liste", "tablo", "kod", "formul"} and "\ue000" not in text


def test_markup_column(spark):
    x = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "<h1>a</h1>", "z"), (3, "<h1>a</h1>", "z")], "id int, page string, clean string")
    got = p01.clean_text(x, "page").orderBy("id").collect()
    assert got[0]["clean_text"] is None and got[1]["clean_text"] == "" and [r["structures"] for r in got[2:]] == [["baslik"]] * 2
    again = p01.clean_text(p01.clean_text(x, "page", out_col="CLEAN"), "page", out_col="page", kinds_col="clean").orderBy("id").collect()
    assert again[2]["page"] == "# a" and again[2]["clean"] == ["baslik"]
    assert p01.clean_text(x.limit(0), "page").count() == 0


def test_lookalikes():
    plain = "Yargıtay 4. Hukuk Dairesi naïve œuvre “…” § € –\t\r\nÂ î"
    assert p02.unify(plain) == plain
    real = "Здоровье Θάλασσα Волна Ωμέγα Снежинка"
    assert p02.unify(real) == real
    for odd, even in (("Μahkemesi", "Mahkemesi"), ("daνalı", "davalı"), ("рау", "pay"), ("ＤＡＶＡ", "DAVA"), ("𝐓Ü𝐑Ü", "TÜRÜ"), ("na\u200bme", "name"), ("a\u00a0b", "a b"), ("s\u0327", "ş"), ("so\u00adn", "son"), ("Fіkrî", "Fikrî")):
        assert p02.unify(odd) == even and p02.skeleton(odd) == p02.skeleton(even)
    assert p02.skeleton("ısı") != p02.skeleton("isi")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_unify_is_stable(text):
    assert p02.unify(p02.unify(text)) == p02.unify(text)


def test_lookalike_columns(spark):
    x = spark.createDataFrame([("1", "pay"), ("2", "рау"), ("3", None), ("4", ""), ("5", "pay"), (None, "ＡＢ")], "id string, t string")
    assert [r[0] for r in p02.cases(x, "id", "t").collect()] == ["2"]
    assert {(r["grp"], r["records"], r["forms"]) for r in p02.look_alike_groups(x, "id", "t").collect()} == {("1", 3, 2), ("4", 1, 1)}
    assert p02.cases(x.limit(0), "id", "t").count() == 0
    clash = x.selectExpr("id as kayit", "t as unified", "id as Text", "t")
    assert sorted(r[0] or "" for r in p02.consistent_form(clash, "t").select("unified").collect()) == ["", "", "AB", "pay", "pay", "pay"]
    assert [r[0] for r in p02.cases(clash, "kayit", "t").collect()] == ["2"]


def test_truncation(spark):
    rng = random.Random(3)
    words = [f"kelime{i}" for i in range(60)]
    rows, truth = [], set()
    for i in range(800):
        body = ". ".join(" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(6, 10)))
        text = body + ". Açıklanan nedenlerle hükmün BOZULMASINA karar verildi." + rng.choice(["", "\n\nBaşkan Üye Üye", "\n\n* * *"])
        if i % 10 == 0:
            text = text[: rng.randint(60, len(body) - 12)].rstrip(" .") + rng.choice(["", "...", "…"])
            truth.add(str(i))
        rows.append((i, text))
    x = spark.createDataFrame([*rows, (None, "x"), (9001, None), (9002, "  ")], "id int, t string").withColumn("src", F.when(F.col("id") % 2 == 0, "çift").otherwise("tek"))
    got = p03.truncated(x, "id", "t")
    found = {r["id"] for r in got.where("cut").collect()}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 4
    shares = {r["source"]: r for r in p03.source_shares(x, got, "id", "src").collect()}
    assert shares["tek"]["cut_records"] <= 4 < shares["çift"]["cut_records"]
    assert p03.truncated(x.limit(0), "id", "t").count() == 0


def test_blanks_and_stars_after_the_end(spark):
    rows = [(i, f"Dava {i} hakkında karar verildi.") for i in range(60)]
    idle = [" " * 300, "* " * 150, "\u200b\n" * 200, "…" + "\u00a0" * 400]
    rows += [(100 + i, f"Dosya {i} hakkında karar veri{x}") for i, x in enumerate(idle)] + [(200 + i, f"Dosya {i} hakkında karar verildi.{x}") for i, x in enumerate(idle)]
    got = {r["id"]: r["log_odds"] for r in p03.truncated(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert len(got) == 68 and max(got[str(100 + i)] for i in range(4)) < min(got[str(200 + i)] for i in range(4))


def test_end_sets_and_counts(spark):
    """The counts behind the log-odds are those of a plain count over all positions."""
    texts = ["bir iki üç karar verildi", "karar verildi ve sonra bir iki", "üç bir iki"]
    x = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    tails = p03._tails(x, "id", "t", [])
    ends = tails.select(F.posexplode("contexts").alias("k", "context")).where("context is not null").groupBy("k", "context").count()
    counts = p03._continuations(x, "t", spark.sparkContext.broadcast(p03._wanted(ends))).where("k = 1").collect()
    want = {}
    for end in {t[-6:] for t in texts}:
        n = sum(t[i : i + 6] == end and i + 6 < len(t) for t in texts for i in range(len(t)))
        if n:
            want[int(p03.window_hashes(p03.code_points(end), 6).view("int64")[0])] = n
    assert {r["context"]: r["goes_on"] for r in counts} == want


GIVEN = ("sevgi", "tuna", "çağatay")


def test_personal_information():
    text = (
        "Sayın Lâle ULUPINARCI, 0499-448-63-49 veya ayse.k+dosya(at)mail(nokta)kent(nokta)example. "
        "GÖKARDIÇCI, Sevgi ile Çağatay Tuna Bükyelkenli (T.C. Kimlik No: 953-642-569-92), Gül Bahçesi Mahallesi, Bülbül Sok., No: 12/3, 39400 Kestanelik – Tuzlabaşı adresinde. "
        "Pasaport No: U 99756441. Gönderi takip numarası 49824682229, Ürün barkodu 1962853299358, Hesap no 1292-1292 ve fiş no 89055099316. "
        "Defne Tekstil Sanayi A.Ş., Selvan Köprüsü, Kardelen Caddesi boyunca, K. ile davalı S. Y., k***@*** ve @kararizleyen, 2011/12345 sayılı dosya."
    )
    found = [(k, text[a:b]) for a, b, k in p10.find(text, GIVEN)]
    assert found == [
        ("name", "Lâle ULUPINARCI"),
        ("phone", "0499-448-63-49"),
        ("email", "ayse.k+dosya(at)mail(nokta)kent(nokta)example"),
        ("name", "GÖKARDIÇCI, Sevgi"),
        ("name", "Çağatay Tuna Bükyelkenli"),
        ("national_id", "953-642-569-92"),
        ("address", "Gül Bahçesi Mahallesi, Bülbül Sok., No: 12/3, 39400 Kestanelik – Tuzlabaşı"),
        ("national_id", "U 99756441"),
    ]
    key = b"k"
    safe = p10.replace(text, key, GIVEN)
    assert "ULUPINARCI" not in safe and "448-63-49" not in safe and safe.startswith("Sayın [NAME:") and "1962853299358" in safe


@pytest.mark.parametrize("phone", ["(0 299) 418 32 26", "0598-313-19-75", "05975260005", "0090 598 213 2538", "+90 (597) 529 60 18", "+905976807792", "0499.209.55.97", "(0499) 5385248", "0 597 9401219"])
def test_phone_formats(phone):
    assert [(k, f"Tel: {phone}."[a:b]) for a, b, k in p10.find(f"Tel: {phone}.")] == [("phone", phone)]


def test_feistel_is_a_permutation():
    key = b"secret"
    assert len({p10.permute_digits(f"{i:03d}", key) for i in range(1000)}) == 1000
    assert p10.pseudonym("phone", "0598-313-19-75", key) == p10.pseudonym("phone", "+90 (598) 313 19 75", key)
    assert p10.pseudonym("name", "Sevgi GÖK", key) == p10.pseudonym("name", "GÖK, Sevgi", key)
    days = [datetime.date(1980, 1, 1) + datetime.timedelta(i) for i in range(400)]
    assert len({p10.permute_date(x, key) for x in days}) == 400


def test_pii_columns(spark):
    x = spark.createDataFrame([(1, "a@b.example c@d.example"), (2, None), (3, ""), (1, "a@b.example c@d.example")], "doc_id long, text string")
    assert sorted((r["id"], r["pii_type"], r["seq"]) for r in p10.occurrences(x, "doc_id", "text", b"k").collect()) == [(1, "email", 1), (1, "email", 1), (1, "email", 2), (1, "email", 2)]
    assert p10.occurrences(x.selectExpr("doc_id", "text", "doc_id as id", "text as pii_type"), "doc_id", "text", b"k").count() == 4
    got = p10.pseudonymised(x.selectExpr("*", "'x' as safe_text"), "text", b"k").orderBy("doc_id").collect()
    assert got[0]["safe_text"].count("[EMAIL:") == 2 and got[2]["safe_text"] is None and got[3]["safe_text"] == ""


def _unlisted(rng, n):
    ends, out = ["an", "il", "ra", "em", "os", "ün"], set()
    while len(out) < n:
        name = "".join(rng.choice("bcdfgklmnprstvyz") + rng.choice("aeıioöuü") for _ in range(2)) + rng.choice(ends)
        out.add(p10._upper(name[0]) + name[1:])
    return sorted(out - set(p10.COMMON_NAMES))


def test_names_on_no_list(spark):
    rng = random.Random(10)
    given, surnames = _unlisted(rng, 200), [x + "oğlu" for x in _unlisted(rng, 60)]
    rows, truth = [], {}
    shown = ["Davacı {} dava açmıştır.", "Tanık {} dinlendi.", "Sanık {}’nın beyanı alındı.", "VEKİLİ : Av. {}\nKonu", "Keşifte {} adlı kişi görüldü.", "The witness {} was heard.", "Die Zeugin {} wurde vernommen."]
    bare = ["Bedel ödenmiştir. {} ise kabul etmemiştir.", "Belgeyi {} adına getirmişler.", "Hazır bulunanlar: {} ve başkaları."]
    for i, g in enumerate(given):
        for j, pattern in enumerate([*rng.sample(shown, 3), *bare]):
            name = f"{g} {rng.choice(surnames)}"
            rows.append((10 * i + j, pattern.format(name)))
            truth[10 * i + j] = name
    decoys = ["Davacı vekili duruşmaya gelmedi.", "Davalı İdare Vekili İse Temyiz Etmiştir Ve Karar Verilmiştir.", "Sayın Mahkeme Başkanlığına sunulur.", "Tanık Çınar Caddesi Başında Bekledi", "Davalı Akpınar Tekstil Sanayi Limited Şirketi cevap verdi.", "DAVALI İDARE VEKİLİ TEMYİZ ETMİŞTİR"]
    rows += [(100000 + i, d) for i, d in enumerate(decoys)]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    names = p10.learn_names(x, "text")
    hit = sum([t[a:b] for a, b, k in p10.find(t, names) if k == "name"] == [truth[i]] for i, t in rows if i in truth)
    assert hit >= 0.9 * len(truth)
    assert not [d for d in decoys if any(k == "name" for _, _, k in p10.find(d, names))]
    once = sum(any(t[a:b] == truth[i] for a, b, k in p10.find(t)) for i, t in rows if i % 10 < 3 and i in truth)
    assert once >= 0.9 * 600  # shown by their surroundings alone
    for name in ("Abdullah Yıldız", "Süleyman Kaya", "Jennifer Miller"):
        assert p10.find(f"{name} bunu söyledi.") == [(0, len(name), "name")]


def test_dates_on_request():
    key, text = b"k", "Karar 01.02.2003 gününde, 2003/12 sayılı dosyada, 31.02.2003 diye yazılmış; 1.2.2003 ve 01/02/2003 aynıdır."
    assert p10.replace(text, key) == text
    got = p10.replace(text, key, dates=True)
    assert "01.02.2003" not in got and "2003/12" in got and "31.02.2003" in got
    day = p10.permute_date(datetime.date(2003, 2, 1), key)
    assert f"{day:%d.%m.%Y}" in got and f"{day:%d/%m/%Y}" in got
    assert len(p10.pseudonym("name", "A B", key)) == len("[NAME:]") + 32


def test_packing(spark):
    rng = random.Random(5)
    x = spark.createDataFrame([(i, " ".join(f"söz{rng.randint(0, 300)}" for _ in range(rng.randint(1, 120)))) for i in range(300)] + [(900, None), (901, ""), (None, "x")], "id long, t string")
    sizes = {"az": 64, "çok": 512}
    placed = p08.packed(x, "id", "t", sizes, shard_docs=100).collect()
    tokens = {r["id"]: r["n_tokens"] for r in p08.token_bags(x, "id", "t").collect()}
    for name, capacity in sizes.items():
        rows = [r for r in placed if r["pack_name"] == name]
        by, parts = {}, {}
        for r in rows:
            by[r["container"]] = by.get(r["container"], 0) + r["n_tokens"]
            parts.setdefault(r["id"], []).append((r["first_token"], r["n_tokens"]))
        assert max(by.values()) <= capacity and {k: sum(n for _, n in v) for k, v in parts.items()} == tokens
        assert all(len(v) == 1 for k, v in parts.items() if tokens[k] <= capacity)
        assert sum(by.values()) / (capacity * len(by)) > 0.85
    assert p08.packed(x.limit(0), "id", "t", sizes).count() == 0


def test_neighbours_come_first():
    import numpy as np

    index = p08.InvertedIndex([np.array([1, 2], "<u2").tobytes() + np.array([1, 1], "<f4").tobytes(), np.array([2, 3], "<u2").tobytes() + np.array([2, 1], "<f4").tobytes(), np.array([9], "<u2").tobytes() + np.array([5], "<f4").tobytes()])
    assert index.scores(0).tolist() == [2.0, 2.0, 0.0]
    packs = p08.pack(np.array([60, 40, 40]), index, 100)
    assert [sorted(d for d, _, _ in c) for c in packs] == [[0, 1], [2]]


def test_mixing(spark):
    docs = spark.createDataFrame([(f"a{i}", "a", 10) for i in range(200)] + [(f"b{i}", "b", 10) for i in range(20)] + [("c0", "c", 5)], "id string, source string, n_tokens long")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("fehlt", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = p09.mixed(docs, weights, block_docs=16)
    report = {r["source"]: r for r in p09.share_report(mix, weights.where("source is not null")).collect()}
    assert abs(report["a"]["actual_share"] - 0.5) < 0.02 and report["b"]["most_repeats"] == 3 and report["fehlt"]["tokens"] == 0
    assert mix.where("source = 'c'").count() == 0
    assert mix.groupBy("id").count().agg(F.max("count")).first()[0] <= 3
    big = p09.share_report(p09.mixed(docs, weights, budget=2200, block_docs=16), weights.where("source is not null"))
    got = {r["source"]: r for r in big.collect()}
    assert abs(got["b"]["tokens"] - 600) <= 10 and got["a"]["most_repeats"] == 1
    assert p09.mixed(docs.limit(0), weights).count() == 0


def test_exponent():
    tokens, target, limits = {"a": 900, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    w, x, total = p09.plan(tokens, target, limits)
    assert x == 1.0 and total == pytest.approx(400) and w["b"] == pytest.approx(0.5)
    w, x, total = p09.plan(tokens, target, limits, budget=1000)
    assert 0 < x < 1 and total * w["b"] <= 200 + 1e-6 and total * w["a"] <= 900 + 1e-6
    w, x, _ = p09.plan(tokens, target, limits, target_entropy=0.5)
    assert p09.entropy(w) == pytest.approx(0.5, abs=1e-6)


def test_more_scripts_and_variants():
    for odd, plain in (("Ꭺnkara", "Ankara"), ("ɑnkara", "ankara"), ("ⲟrtak", "ortak"), ("ꓮnkara", "Ankara"), ("ſatış", "satış"), ("ᴋarar", "karar"), ("🅐nkara", "Ankara"), ("Ⅳ", "IV"), ("а\u0301", "á"), ("ᎪᏟ", "AC")):
        assert p02.unify(odd) == plain and p02.skeleton(odd) == p02.skeleton(plain)
    for real in ("ᏣᎳᎩ", "ⲙⲛⲧⲣⲙⲛⲕⲏⲙⲉ", "Москва", "Αθήνα", "ışık İzmir — “söz” § 5 €"):
        assert p02.unify(real) == real


def test_temperature_meets_entropy_and_limits():
    tokens = {"a": 1000, "b": 100, "c": 10}
    weights, a = p09.temperature(tokens, {}, 0, target_entropy=0.9)
    assert 0 < a < 1 and abs(p09.entropy(weights) - 0.9) < 1e-6
    assert all(abs(w - (t / 1110) ** a / sum((x / 1110) ** a for x in tokens.values())) < 1e-9 for w, t in zip(weights.values(), tokens.values()))
    weights, a = p09.temperature(tokens, {"a": 1, "b": 2, "c": 4}, 1110)
    assert 0 < a < 1 and all(1110 * w <= t * r * 1.0001 for w, t, r in zip(weights.values(), tokens.values(), (1, 2, 4)))
    assert p09.temperature({}, {}, 5) == ({}, 1.0)
