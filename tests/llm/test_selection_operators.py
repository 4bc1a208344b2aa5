import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rostire.llm import groups as P
from rostire.llm import packing as B
from rostire.llm import queries as llm
from rostire.llm import samples as Q

DATA = "/root/testdata/sf0.001"
TARGET = "plan_name string, field_name string, category string, sample_permille int, target_permille int, min_rows int"


def records(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = [(f"r{k}", rng.choices(["Big ", "mid", "SMALL", None], [70, 20, 3, 7])[0], rng.sample(["p", "q", "Q ", "s"], rng.randrange(0, 4)) if rng.random() < 0.95 else None, k) for k in range(n)]
    return spark.createDataFrame(rows + rows[:50], "id string, reg string, ph array<string>, plan int"), rows


def draw(spark, df, targets):
    t = spark.createDataFrame(targets, TARGET)
    return Q.calibrated_sample(df, t, {"reg": F.array("reg"), "ph": F.col("ph")})


def test_sample(spark):
    df, rows = records(spark)
    s = draw(spark, df, [("a", "reg", "big", 100, 500, 1), ("a", "reg", " Mid", 100, 300, 1), ("a", "reg", "small", 100, 400, 2), ("b", "ph", "q", 200, 600, 1), ("b", "ph", "none", 200, 100, 3)])
    have = Counter((r[1] or "").strip().lower() for r in rows)
    rep = {(r["plan_name"], r["category"]): r for r in s.report.collect()}
    assert rep["a", "big"]["available"] == have["big"] and rep["a", "small"]["available"] == have["small"]
    assert rep["a", "small"]["unmet"] == (have["small"] < 3000 * 0.1 * 0.4) and not rep["a", "big"]["unmet"]
    assert rep["b", "none"]["unmet"] and rep["b", "none"]["available"] == 0
    assert rep["a", "small"]["sampled"] == min(have["small"], 120)
    assert abs(rep["a", "big"]["sampled"] - 150) <= 8 and abs(rep["a", " Mid"]["sampled"] - 90) <= 8
    own = s.sample.where("plan_name = 'a'")
    assert own.count() == own.distinct().count() and own.count() <= 340  # the targets add up to more than the sample
    first = sorted(map(tuple, s.sample.collect()))
    again = sorted(map(tuple, draw(spark, df.repartition(3), [("a", "reg", "big", 100, 500, 1), ("a", "reg", " Mid", 100, 300, 1), ("a", "reg", "small", 100, 400, 2), ("b", "ph", "q", 200, 600, 1), ("b", "ph", "none", 200, 100, 3)]).sample.collect()))
    assert first == again


def test_sample_empty(spark):
    df, _ = records(spark, 5)
    s = draw(spark, df.limit(0), [("a", "reg", "big", 100, 500, 1), (None, "reg", "x", 1, 1, 1)])
    assert s.sample.count() == 0 and [r["unmet"] for r in s.report.collect()] == [True]
    assert draw(spark, df, []).report.count() == 0


def test_gaps_of_unknown_fields_and_conflicts(spark):
    df, _ = records(spark)
    s = draw(spark, df, [("a", "nowhere", "x", 100, 200, 0), ("a", "reg", "big", 100, 500, 1), ("c", "reg", "big", 500, 100, 0), ("c", "reg", "mid", 500, 100, 0)])
    rep = {(r["plan_name"], r["category"]): r for r in s.report.collect()}
    assert rep["a", "x"]["unmet"] and rep["a", "x"]["available"] == 0 and not rep["a", "x"]["conflict"]
    # Both goals can be reached, but then the sample cannot have its size: the shares go first.
    assert not rep["c", "big"]["unmet"] and not rep["c", "mid"]["unmet"]
    # p and its own double cannot both have their goals.
    twice = draw(spark, df.withColumn("reg", F.lit("one")), [("d", "reg", "one", 100, 900, 0), ("d", "ph", "p", 100, 100, 0), ("d", "ph", "none", 100, 100, 0)])
    assert [r["category"] for r in twice.report.where("unmet").collect()] == ["none"]
    same = spark.createDataFrame([(f"i{k}", "u", ["v"]) for k in range(500)], "id string, reg string, ph array<string>")
    both = draw(spark, same, [("e", "reg", "u", 100, 900, 0), ("e", "ph", "v", 100, 100, 0)])
    assert both.report.where("conflict").count() >= 1 and both.report.where("unmet").count() == 0


def test_floors_hold_after_the_draw(spark):
    rng = random.Random(5)
    rows = [(f"r{k}", "rare" if k < 60 else "much", rng.sample(["p", "q", "s", "t", "u"], rng.randrange(0, 5))) for k in range(2000)]
    df = spark.createDataFrame(rows, "id string, reg string, ph array<string>")
    targets = [("a", "reg", "rare", 100, 50, 50), ("a", "reg", "none", 100, 10, 5), *(("a", "ph", x, 100, 300, 1) for x in "pqstu")]
    fields = {"reg": F.array("reg"), "ph": F.col("ph")}
    for seed in range(4):
        s = Q.calibrated_sample(df, spark.createDataFrame(targets, TARGET), fields, seed=seed)
        rep = {r["category"]: r for r in s.report.collect()}
        assert rep["rare"]["sampled"] >= 50 and not rep["rare"]["short"] and rep["none"]["short"]
        assert s.sample.count() == s.sample.distinct().count()


def test_topped_up(spark):
    masks = spark.createDataFrame([("a", f"r{k}", 1 if k < 10 else 2) for k in range(30)] + [("a", "both", 3)], "plan string, id string, mask long")
    sample = spark.createDataFrame([("a", "r0"), ("a", "r20")], "plan string, id string")
    got = [r["id"] for r in Q.topped_up(sample, masks, {("a", 0): 11, ("a", 1): 2}, 1).collect()]
    assert len(got) == len(set(got)) == 12 and {"r0", "r20", "both", *(f"r{k}" for k in range(10))} == set(got)
    assert Q.topped_up(sample.limit(0), masks, {("a", 1): 4}, 1).count() == 4


def test_distributed_moments_agree(spark, monkeypatch):
    df, _ = records(spark, 800)
    targets = [("a", "ph", "p", 200, 300, 1), ("a", "ph", "q", 200, 500, 1)]
    near = [r["expected"] for r in draw(spark, df, targets).report.orderBy("category").collect()]
    monkeypatch.setattr(Q, "PATTERNS", 0)
    far = [r["expected"] for r in draw(spark, df, targets).report.orderBy("category").collect()]
    assert near == pytest.approx(far, abs=0.01)


def test_pivotal_keeps_totals():
    rng = random.Random(1)
    for seed in range(40):
        ps = [rng.random() for _ in range(31)]
        got = [u for u in Q.pivotal((("a", i, p) for i, p in enumerate(ps)), seed, True) if u[2] == 1.0]
        assert abs(len(got) - sum(ps)) < 1 and len({i for _, i, _ in got}) == len(got)


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in up}


@pytest.mark.parametrize("small", [100_000, 3])
def test_components(spark, small):
    rng = random.Random(7)
    edges = [(f"p{k:03}", f"p{k + 1:03}") for k in range(90)] + [(f"s{k}", "hub") for k in range(60)]
    edges += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)] + [("x", "x"), (None, "y"), ("y", None), ("p000", "p001"), ("p001", "p000")]
    df = spark.createDataFrame(edges, "a string, b string")
    labels = {r["node"]: r["label"] for r in P.components(df, small=small).collect()}
    want = union_find(edges)
    assert labels.keys() == want.keys()
    pairs = {(labels[x], want[x]) for x in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    if small > 3:
        assert {r["key"]: r["group_key"] for r in P.grouped_keys(df).collect()} == want


def test_groups_and_assignment(spark):
    rng = random.Random(2)
    rows = [(str(k), "hot" if k % 3 == 0 else f"k{rng.randrange(200)}", rng.choice(["train", "dev"])) for k in range(2000)] + [("n", None, "dev")]
    links = [("k1", "k2"), ("k2", "zz"), ("alone", "k3")]
    df = spark.createDataFrame(rows, "id string, key string, split string")
    g = P.groups_of(P.key_splits(df), spark.createDataFrame(links, "a string, b string"))
    group = union_find(links)
    want = defaultdict(set)
    for _, k, s in rows:
        if k:
            want[group.get(k, k)].add(s)
    assert {r["group_key"] for r in P.spread_groups(g).collect()} == {k for k, s in want.items() if len(s) > 1}
    done = P.assign_splits(g, {"train": 0.5, "dev": 0.3, "test": 0.2}).collect()
    assert len(done) == len(want) and {r["group_key"] for r in done} == set(want)
    share = Counter()
    for r in done:
        share[r["split"]] += r["n"]
    assert sum(share.values()) == 2000
    small = P.assign_splits(g.where("group_key <> 'hot'"), {"train": 0.5, "dev": 0.3, "test": 0.2}).groupBy("split").agg(F.sum("n").alias("n")).collect()
    n = {r["split"]: r["n"] for r in small}
    total = sum(n.values())
    assert abs(n["train"] / total - 0.5) < 0.05 and abs(n["dev"] / total - 0.3) < 0.05


def test_every_record_is_assigned(spark):
    rng = random.Random(4)
    rows = [("e", str(k), rng.choice([None, "hot", f"k{rng.randrange(150)}"])) for k in range(1500)] + [("u", str(k), rng.choice([None, f"u/{rng.randrange(90)}"])) for k in range(900)]
    links = [("k1", "k2"), ("k2", "zz"), ("u/3", "k3"), (None, "k4")]
    df = spark.createDataFrame(rows + rows[:200], "tbl string, id string, key string")
    ldf = spark.createDataFrame(links, "a string, b string")
    done = P.assign_records(df, ldf, {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()
    assert len(done) == len(rows) and {(r["tbl"], r["id"]) for r in done} == {(t, i) for t, i, _ in rows}
    key, group, homes = {(t, i): k for t, i, k in rows}, union_find([x for x in links if x[0]]), defaultdict(set)
    for r in done:
        k = key[r["tbl"], r["id"]]
        assert r["group_key"] == group.get(k, k)
        homes[r["group_key"]].add(r["split"])
    assert all(len(v) == 1 for k, v in homes.items() if k) and homes[None] == {"train", "dev", "test"}
    share = Counter(r["split"] for r in done if r["group_key"] != "hot")
    assert abs(share["train"] / sum(share.values()) - 0.8) < 0.25
    again = P.assign_records(df.repartition(3), ldf, {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()
    assert sorted(map(str, again)) == sorted(map(str, done))
    assert P.assign_records(df.limit(0), ldf, {"train": 1.0}).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_assignment_query_covers_both_tables(spark):
    got = llm.QUERIES["p6_assignment"](spark, DATA).collect()
    ids = {(t, r[0]) for t, k in (("evaluation_example", "id"), ("utterance", "utt_id")) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(k).collect()}
    assert len(got) == len(ids) and {(r["tbl"], r["id"]) for r in got} == ids and {r["split"] for r in got} == {"train", "dev", "test"}


def test_groups_empty(spark):
    df = spark.createDataFrame([], "id string, key string, split string")
    g = P.groups_of(P.key_splits(df), spark.createDataFrame([], "a string, b string"))
    assert P.spread_groups(g).count() == 0 and P.assign_splits(g, {"a": 1.0}).count() == 0


@pytest.mark.parametrize("cap,n", [(256, 4000), (1024, 3000), (4096, 1500), (10, 50), (7, 0), (5, 1)])
def test_pack(cap, n):
    rng = random.Random(cap)
    sizes = [min(cap, max(0, int(rng.lognormvariate(5, 1)))) for _ in range(n)]
    home = B.pack(sizes, cap)
    use = Counter()
    for s, b in zip(sizes, home):
        use[b] += s
    assert len(home) == n and all(v <= cap for v in use.values())
    if n > 1000:
        assert sum(sizes) / (len(use) * cap) > 0.95


def test_best_configurations_are_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.array(sorted(rng.choice(np.arange(6, 30), 4, replace=False))[::-1])
        counts = rng.integers(1, 40, 4).astype(float)
        mix = B.best_configurations(sizes, counts, 30)
        assert np.allclose(sum(c * t for c, t in mix), counts) and all(c @ sizes <= 30 for c, _ in mix)
        # Optimal: under the prices of the basis no configuration is worth more than a container.
        prices = np.linalg.inv(np.array([c for c, _ in mix], dtype=float).T).sum(0)
        every = (c for c in itertools.product(range(6), repeat=4) if np.dot(c, sizes) <= 30)
        assert max(np.dot(c, prices) for c in every) <= 1 + 1e-5


def test_containers(spark):
    rng = random.Random(9)
    counts = [(k, rng.choice([0, 1, 5, 40, 100, 101, 250, 999])) for k in range(400)]
    df = spark.createDataFrame(counts, "doc_id long, tokens int")
    specs = spark.createDataFrame([(1, "a", 100), (2, "b", 1000), (3, "c", None)], "spec_id int, purpose string, capacity_tokens int")
    rows = B.fill_containers(df, specs, shard_items=150).collect()
    for spec, cap in ((1, 100), (2, 1000)):
        use, parts = Counter(), defaultdict(list)
        for r in rows:
            if r["spec_id"] == spec:
                use[r["container"]] += r["token_to"] - r["token_from"]
                parts[r["doc_id"]].append((r["token_from"], r["token_to"]))
        assert max(use.values()) <= cap and set(parts) == {k for k, _ in counts}
        for k, t in counts:
            p = sorted(parts[k])
            assert p[0][0] == 0 and p[-1][1] == t and all(a[1] == b[0] for a, b in zip(p, p[1:]))
            assert len(p) == 1 if t <= cap else len(p) == -(-t // cap)
    assert {r["spec_id"] for r in rows} == {1, 2}
    assert B.fill_containers(df.limit(0), specs).count() == 0


def test_token_counts(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Ana are mere."), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in B.token_counts(df).collect()}
    assert got[2] == got[3] == 0 and got[1] > 3 and got[4] > 1
