import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import p08_packing as p08


def fitted(bags):
    frequency, n, mean = p08._frequencies(bags)
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5)), n, mean


def test_all_tokens_count(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"söz{rng.randint(0, 4000)}" for _ in range(150))) for i in range(60)]
    bags = p08.token_bags(spark.createDataFrame(rows, "id long, t string"), "id", "t").cache()
    idf, n, mean = fitted(bags)
    docs = bags.collect()
    assert min(len(r["bag"]) // 4 for r in docs) > 48
    index = p08.InvertedIndex([p08._postings(r["n_tokens"], r["bag"], idf, mean) for r in docs])
    dense = np.zeros((n, p08.IDS))
    for i, r in enumerate(docs):
        t, w = p08._terms(p08._postings(r["n_tokens"], r["bag"], idf, mean))
        dense[i, t] = w
    for i in range(n):
        assert np.allclose(index.scores(i), dense @ (dense[i] > 0), rtol=1e-4)


def test_neighbours_share_a_shard(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'abcdefgh'[i % 8] * 3}{rng.randint(0, 80)}" for _ in range(60))) for i in range(400)] + [(1000 + i, "aynı metin burada durur") for i in range(150)]
    bags = p08.token_bags(spark.createDataFrame(rows, "id long, t string"), "id", "t").cache()
    placed = p08.dealt(bags, *fitted(bags), 60).collect()
    assert sorted(int(r["id"]) for r in placed) == sorted(i for i, _ in rows)
    shards = {}
    for r in placed:
        shards.setdefault((r["shard"], r["part"], r["rest"]), []).append(int(r["id"]))
    assert max(map(len, shards.values())) <= 2 * 60
    home = {i: k for k, ids in shards.items() for i in ids}
    same = [home[i] == home[j] for i in range(400) for j in range(i) if i % 8 == j % 8]
    assert np.mean(same) > 0.6


def test_containers_hold_what_is_alike(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'abcdefgh'[i % 8] * 3}{rng.randint(0, 60)}" for _ in range(40))) for i in range(160)]
    x = spark.createDataFrame(rows, "id long, t string")
    r = p08.similarity_report(p08.packed(x, "id", "t", {"k": 600}), x, "id", "t").first()
    assert r["containers"] > 10 and r["similarity"] > 1.5 * r["random_similarity"]


def test_crowded_cells_are_met_in_blocks(spark):
    """A cluster of near-equal vectors that all lie in a few cells, against brute force."""
    from corpusloom.llm import p06_similar_vectors as p06

    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((3000, 8)) + 0.02 * rng.normal(size=(3000, 8)), rng.normal(size=(200, 8))]).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i:05d}", [float(e) for e in v]) for i, v in enumerate(x)], "id string, v array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -9)
    best = np.sort(scores, axis=1)[:, ::-1][:, :5]
    for least in (None, 0.9):
        hits = p06.similar_vectors(rows, "id", "v", dim=8, probes=6, block=150, sample=2000, min_score=least).toPandas()
        assert hits.groupby("id").size().max() == 5 and (hits["id"] != hits["neighbour"]).all()
        got = {k: g["score"].to_numpy() for k, g in hits[hits["id"] < "v03000"].groupby("id")}
        near = np.mean([(got.get(f"v{i:05d}", np.array([-9.0])).min() >= best[i].min() - (2e-4 if least is None else 1e-3)) for i in range(3000)])
        assert len(got) == 3000 and near > 0.9
