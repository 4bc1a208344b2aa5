import json
import random
from collections import defaultdict

from rostire.llm import copies as C
from rostire.llm import overlaps as O
from rostire.llm.textform import words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(rows):
    seen = {(i, s, t) for i, s, t in rows if i and s and t}
    held = [(i, words_of(t)) for i, s, t in seen if s != "train"]
    train = [(i, words_of(t)) for i, s, t in seen if s == "train"]
    return {(i, j) for i, a in held for j, b in train if a and b and lcs(a, b) * 5 >= 4 * max(len(a), len(b))}


def corpus(n=140, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["și", "de", "la", "în"] * 20
    rows = []
    for k in range(n):
        text = rng.choices(vocab, k=rng.choice([3, 5, 8, 11, 12, 13, 14, 15, 20, 30, 60]))
        rows.append((f"train-{k}", "train", " ".join(text)))
        for j in range(rng.randrange(3)):
            other = list(text)
            for _ in range(rng.randrange(0, max(1, len(other) // 5) + 1)):
                p, kind = rng.randrange(len(other)), rng.randrange(3)
                if kind == 0:
                    other[p] = rng.choice(vocab)
                elif kind == 1 and len(other) > 1:
                    del other[p]
                else:
                    other.insert(p, rng.choice(vocab))
            noisy = " ".join(other)
            rows.append((f"{rng.choice(['dev', 'test'])}-{k}-{j}", rng.choice(["dev", "test"]), rng.choice([noisy, noisy.upper(), noisy.replace(" ", "  ,")])))
    return rows


def overlaps(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, split string, text string, cid int, block string")
    o = O.cross_split_overlaps(df)
    return {(r["held_id"], r["train_id"]) for r in o.id_pairs().collect()}, o


def test_overlaps_match_brute_force(spark):
    rows = corpus()
    rows += [rows[0], ("train-null", "train", None), ("dev-null", "dev", None), ("dev-empty", "dev", "!!"), ("train-empty", "train", "..."), (None, "dev", rows[0][2]), ("x", None, rows[0][2])]
    got, o = overlaps(spark, rows)
    want = brute([r for r in rows])
    assert got == want and len(want) > 60
    assert o.pairs.where("covered < 2 AND a <> b").count() == 0


def scattered(rng, text, vocab, part=5):
    """The text with words dropped and others put in, far apart, as many as a case may have."""
    n = len(text)
    spots = [i for i in range(n) if i % part == part - 1][: n // part]
    out = []
    for i, w in enumerate(text):
        if i in spots:
            continue
        out.append(w)
        if i % part == 1 and len(out) < n:
            out.append(rng.choice(vocab))
    return out


def test_overlaps_with_scattered_drops_and_insertions_in_long_texts(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        text = rng.choices(vocab, k=rng.randrange(17, 120))
        rows += [(f"train-{k}", "train", " ".join(text)), (f"dev-{k}", "dev", " ".join(scattered(rng, text, vocab)))]
        swapped = list(text)
        for i in range(0, len(text) - 10, 10):
            swapped[i], swapped[i + 1] = swapped[i + 1], swapped[i]
        rows.append((f"test-{k}", "test", " ".join(swapped)))
    got, _ = overlaps(spark, rows)
    want = brute(rows)
    assert got == want and len(want) >= 40


def test_least_shared_pairs_hold_for_any_edits():
    rng = random.Random(3)
    seen = 0
    for _ in range(20000):
        n = rng.randrange(2, 26)
        a = [rng.choice("abcdefghijklmnop") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(0, n // 4 + 2)):
            p = rng.randrange(len(b) + 1)
            if rng.random() < 0.5 and len(b) > 1:
                del b[min(p, len(b) - 1)]
            else:
                b.insert(p, rng.choice("abcdefghijklmnop"))
        if a != b and lcs(a, b) * 5 >= 4 * max(len(a), len(b)):
            seen += 1
            assert O.covered(a, b) > O.shared_pairs(len(a), len(b))
            assert len(set(zip(a, a[1:])) & set(zip(b, b[1:]))) >= 1
    assert seen > 2000


def test_overlaps_split_hot_intervals(spark):
    rows = [(f"train-{k}", "train", f"una doua trei patru cinci sase sapte w{k} zece") for k in range(40)]
    rows += [(f"dev-{k}", "dev", f"una doua trei patru cinci sase sapte v{k} zece") for k in range(30)]
    df = spark.createDataFrame(rows, "id string, split string, text string")
    classes = df.selectExpr("monotonically_increasing_id() AS num", "text AS key", "split <> 'train' AS held_out", "split = 'train' AS train")
    want = O.cross_neighbours(O.suffix_array(classes, O.pair_rarity(classes)))
    array = O.suffix_array(classes, O.pair_rarity(classes), hot=5)
    assert array.groupBy("pair", "cell").count().agg({"count": "max"}).first()[0] < 60
    assert set(O.cross_neighbours(array).collect()) == set(want.collect()) and want.count() == 1200


def test_overlaps_hot_group(spark):
    rows = [(f"train-{k}", "train", "una două trei patru cinci șase") for k in range(300)] + [("dev-1", "dev", "Una, două: TREI patru cinci sase!")]
    got, o = overlaps(spark, rows)
    assert len(got) == 300 and o.pairs.count() == 1


def test_overlaps_empty(spark):
    got, _ = overlaps(spark, [])
    assert got == set()


def test_common_in_order():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(1, 14))] for _ in "ab")
        assert O.common_in_order(a, b) == lcs(a, b)


def copies(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "rec_key string, canon string, n int")
    classes, members = C.collapse(C.canonical_records(df, "rec_key", "canon", "t"), **kw)
    return {(r["key_a"], r["n"]) for r in classes.collect()}, {(r["key_a"], r["key_b"]) for r in members.collect()}


def test_copies_match_brute_force(spark):
    rng = random.Random(2)
    base = ["Ana are mere", "Ana are pere", "x" * 5000, "x" * 5000 + "y", "Ăsta e", "Asta e", "ａna are mere"] + [f"prefix comun foarte lung {k}" for k in range(60)]
    rows = []
    for k in range(700):
        t = rng.choice(base)
        rows.append((f"k{k:04}", rng.choice([t, t.upper(), t.replace(" ", " \t"), f"„{t}”!", t.replace(" ", "")])))
    rows += [("n1", None), ("n2", ""), ("n3", "?!"), ("n4", "..."), rows[0], (None, "Ana are mere")]
    groups = defaultdict(set)
    for k, t in rows:
        if k and C.copy_key(t):
            groups[C.copy_key(t)].add(k)
    want = {(min(g), b) for g in groups.values() for b in g if b != min(g)}
    for kw in ({}, {"capacity": 5, "first": 2}):
        classes, members = copies(spark, rows, **kw)
        assert members == want
        assert classes == {(min(g), len(g)) for g in groups.values() if len(g) > 1}
    assert C.copy_key("Ăsta") != C.copy_key("Asta")


def test_unequal_deliveries_and_long_texts_of_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH_BYTES", 50)
    rows = [("a", "unu doi"), ("a", "trei patru"), ("b", "Unu, doi"), ("c", "TREI patru!"), ("c", "trei-patru"), ("d", "x" * 100_000), ("e", "X" * 100_000)]
    classes, members = copies(spark, rows)
    assert members == {("a", "b"), ("a", "c"), ("d", "e")} and classes == {("a", 2), ("d", 2)}


def test_copies_empty(spark):
    assert copies(spark, []) == (set(), set())


def test_record_key():
    a = {"text": "Ana are", "x": {"b": [1, 2], "a": "Q"}, "c": 0.50}
    b = json.dumps({"c": 0.5, "x": {"a": "q!", "b": [1, 2]}, "text": "ANA  are."}, indent=1)
    assert C.record_key(json.dumps(a)) == C.record_key(b)
    assert C.record_key(json.dumps({**a, "x": {"b": [2, 1], "a": "Q"}})) != C.record_key(b)
    assert C.record_key(json.dumps({**a, "y": None})) != C.record_key(b)
    for bad in (None, "", "{", "[1]", '"a"', '{"a": NaN}', '{"text": "!"}', "[" * 100000):
        assert C.record_key(bad) is None


def test_trie():
    t = C.Trie()
    for v, k in ((b"", "e"), (b"a" * 16, "b"), (b"a" * 16, "a"), (b"a" * 40, "c"), (b"", "d")):
        t.add(v, k, 1)
    assert sorted(t.terminals()) == [(b"", "d", 2), (b"a" * 16, "a", 2), (b"a" * 40, "c", 1)]
