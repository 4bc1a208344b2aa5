import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostire.llm import languages as G
from rostire.llm import leaks as K
from rostire.llm import lookalikes as L
from rostire.llm import sentences as S
from rostire.llm.queries import QUERIES
from rostire.llm.textform import consistent, consistent_form, word_spans, words_of

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

FORMS = [
    ("Ρavel ｍｅｒｇｅ", "Pavel merge"), ("şi ţară, întǎi", "și țară, întăi"), ("café ă", "café ă"), ("do​sar­", "dosar"), ("a b　c d", "a b c d"), ("ﬁlm", "film"),
    ("Москва и мир", "Москва и мир"), ("Мoй", "Мой"), ("рrеѕіunеа", "presiunea"), ("a b", "a\nb"), ("今日は！", "今日は！"), ("", ""), (None, None), ("48％", "48%"), ("ın ş", "ın ș"), ("am о casă", "am o casă"),
]


@pytest.mark.parametrize("text,form", FORMS)
def test_consistent(text, form):
    assert consistent(text) == form and consistent(form) == form


def test_consistent_column(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)], "i int, t string").select("i", consistent_form(F.col("t")).alias("c")).orderBy("i")
    assert [r["c"] for r in df.collect()] == [f for _, f in FORMS]


def test_inconsistent_fields(spark):
    rows = [(f"r{i}", t, "plain", 1) for i, (t, _) in enumerate(FORMS)] * 2
    df = spark.createDataFrame(rows, "id string, text string, word string, canonical int")
    got = {r["rec_key"] for r in L.inconsistent_fields(L.suspect_fields(df, "id", ["text", "word"], "t")).collect()}
    assert got == {f"r{i}" for i, (t, f) in enumerate(FORMS) if t != f}
    assert L.inconsistent_fields(L.suspect_fields(df.limit(0), "id", ["text"], "t")).count() == 0


def test_fields_in_consistent_form(spark):
    rows = [(f"r{i}", t, None if i % 2 else "plain") for i, (t, _) in enumerate(FORMS)] + [(None, "şi ａ", "x")]
    df = spark.createDataFrame(rows * 2, "id string, text string, word string")
    got = L.in_consistent_form(L.text_fields(df, "id", ["text", "word"], "t")).collect()
    want = {("t", i, "text", consistent(t)) for i, t, _ in rows} | {("t", i, "word", w) for i, _, w in rows}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert L.in_consistent_form(L.text_fields(df.limit(0), "id", ["text"], "t")).count() == 0


def test_texts_are_built_from_canonical_words(spark, monkeypatch):
    named = spark.createDataFrame([("ţară", "CANONICAL")], "word string, canonical string")
    monkeypatch.setattr(L, "word_classes", lambda words: named)
    df = spark.createDataFrame([("a", "o ţară, două")], "id string, text string")
    assert [r["value"] for r in L.in_consistent_form(L.text_fields(df, "id", ["text"], "t")).collect()] == ["o CANONICAL, două"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_consistent_query_covers_all_three_fields(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in QUERIES["p3_consistent"](spark, sf).select("tbl", "rec_key", "field_name", "value").collect()}
    want = set()
    for tbl, key, fields in (("evaluation_example", "id", ["text", "expected_normalized_text"]), ("utterance", "utt_id", ["text"])):
        for r in spark.read.parquet(f"{sf}/{tbl}.parquet").select(key, *fields).collect():
            want |= {(tbl, r[key], f, consistent(r[f])) for f in fields}
    assert got == want


def test_classes_have_one_canonical_member(spark):
    df = spark.createDataFrame([("Ρavel",), ("Pavel",), ("Pаvel",), ("Pâvel",), (None,), ("Ρavel",)], "word string")
    got = {(r["word"], r["canonical"]) for r in L.word_classes(df).collect()}
    assert got == {("Ρavel", "Pavel"), ("Pаvel", "Pavel")}


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([5, 13, 14, 20, 60])))) for k in range(25)]
    docs = []
    for k in range(60):
        text = rng.choices(vocab, k=rng.randrange(0, 50))
        own = rng.choice(items)[1].split()
        n = rng.randrange(10, 18)
        a = rng.randrange(max(1, len(own) - n + 1))
        text[rng.randrange(len(text) + 1) : 0] = own[a : a + n]
        docs.append((k, " ".join(text).upper(), "s"))
    docs += [(100, None, "s"), (101, "", "s"), (102, items[4][1] if len(items[4][1].split()) >= 14 else " ".join(vocab[:14]), "s")]
    items += [(200, None), (201, ""), items[0]]

    def windows(t):
        w = words_of(t)
        return {tuple(w[i : i + K.RUN]) for i in range(len(w) - K.RUN + 1)}

    want = {(d, i) for d, t, _ in docs for i, u in items if windows(t) & windows(u)}
    ddf = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    every = [sorted(map(tuple, K.leaked_spans(ddf, idf, held_chars=most).collect())) for most in (0, K.HELD_CHARS)]
    assert every[0] == every[1]
    for most in (0, K.HELD_CHARS):
        spans = K.leaked_spans(ddf, idf, held_chars=most)
        assert {(r["doc_id"], r["item_id"]) for r in spans.select("doc_id", "item_id").collect()} == want and want
    cleaned = K.remove_leaks(ddf, spans, most_share=0.99).collect()
    again = spark.createDataFrame([(r["doc_id"], r["text"]) for r in cleaned], "doc_id long, text string")
    assert K.leaked_spans(again, idf).count() == 0
    assert K.leak_report(spans).count() == len({i for _, i in want})
    assert K.leaked_spans(ddf.limit(0), idf).count() == 0 and K.leaked_spans(ddf, idf.limit(0)).count() == 0


def test_text_around_leaks_is_kept():
    for t in ("Unu \u0301 doi, trei. \u0301Patru", "a\u0301b \u0327 Ștefan straße 한국 ﬁlm", "हिन्दी भाषा और"):
        form, at = consistent(t), word_spans(t)
        assert [words_of(form[a:b]) for a, b in at] == [[w] for w in words_of(t)]
    assert K.without_spans("Unu \u0301 doi, trei. \u0301Patru", [(1, 2)]) == "Unu \u0301 , trei. \u0301Patru"
    assert K.without_spans("Unu \u0301 doi, trei. Patru", [(0, 2)]) == ", trei. Patru"


@needs_data
def test_sentences_held_out(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT DISTINCT id, text, sentence_boundaries FROM '/root/testdata/sf0.01/evaluation_example.parquet' WHERE sentence_boundaries IS NOT NULL AND text IS NOT NULL ORDER BY hash(id)").fetchall()
    rows = [(t, [(s["start"], s["end"]) for s in b]) for _, t, b in rows]
    cut = len(rows) * 3 // 4
    model = S.train(rows[:cut])
    held = [(t, b) for t, b in rows[cut:] if S.gold_tags(t, b, S.places(t)) is not None]
    right = sum(model.spans(t) == b for t, b in held)
    assert right / len(held) > 0.95


def test_sentence_edges(spark):
    model = S.train([])
    assert model.spans(None) == [] and model.spans("  \n ") == [] and model.spans("a") == [(0, 1)]
    t = " Una. Doua!\n\nTrei "
    assert [t[a:b] for a, b in model.spans(t)] == ["Una.", "Doua!", "Trei"]
    assert model.spans("x" * 200_000) == [(0, 200_000)]
    df = spark.createDataFrame([("a", "Da. Nu.", None), ("a", "Da. Nu.", None), ("b", None, None), (None, "x", None)], "id string, text string, sentence_boundaries array<struct<start:int,end:int>>")
    fitted = S.fit_segmenter(df)
    assert sorted(tuple(r) for r in S.segment(df, fitted).distinct().collect()) == [("a", 0, 3), ("a", 4, 7)]
    assert S.segment(df.limit(0), fitted).count() == 0


def test_viterbi_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        e, moves = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist()
        m = S.Model({}, moves)
        m.emissions = lambda text, where, e=e: e
        where = [(i, i + 1) for i in range(n)]
        score = lambda tags: sum(e[i] * t for i, t in enumerate(tags)) + sum(moves[a][b] for a, b in zip((0, *tags), tags))
        best = max(product((0, 1), repeat=n), key=score)
        assert score(m.tags("x" * (n + 2), where)) == pytest.approx(score(best))


@needs_data
def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    c = G.fit_centroids(docs)
    assert {"ro", "en", "fr"} <= set(c.langs)
    texts = ["Ieri dimineață bătrânul pescar a vândut barca lângă port. The quiet librarian cleaned the old lamp near the station and the church.", "---", "12 34", "The old fisherman sold the bicycle."]
    rows = [(1, texts[0], "ro"), (2, texts[1], None), (3, texts[2], "ro"), (4, texts[3], " EN-gb"), (5, texts[3], "und"), (6, texts[3], "ro"), (7, None, "ro"), (8, "", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, chars int")
    segs = G.language_segments(df, c)
    got = sorted((r["doc_id"], r["lang"]) for r in G.label_cases(G.document_languages(segs)).collect())
    assert got == [(1, "en"), (1, "ro"), (5, "en"), (6, "en")]
    ends = [(r["seg_start"], r["seg_end"]) for r in segs.where("doc_id = 1").orderBy("seg_start").collect()]
    assert ends[0][0] == 0 and ends[-1][1] == len(texts[0]) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert all(0 <= r["confidence"] <= 1 for r in segs.collect())
    assert G.language_segments(df.limit(0), c).count() == 0


def words_in(letters, n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices(letters, k=rng.randrange(3, 8))) for _ in range(120)]
    return [" ".join(rng.choices(vocab, k=12)) + "." for _ in range(n)]


def test_wrong_label_is_folded_whatever_the_size():
    ru, ro = words_in("абвгдежзик", 400, 1), words_in("abcdefghik", 60, 2)
    sample = [("ru", t) for t in ru[:60]] + [("bg", t) for t in ru[60:120]] + [("ro", t) for t in ro]
    assert G.fit(sample, counts={"ru": 2200, "bg": 60, "ro": 56000}).langs == ["ro", "ru"]
    few = [("ru", t) for t in ru[:60]] + [("bg", t) for t in ru[60:66]] + [("ro", t) for t in ro]
    assert G.fit(few, counts={"ru": 220, "bg": 6, "ro": 5600}).langs == ["ro", "ru"]


def test_rare_language_close_to_another_is_kept():
    ro, es = words_in("abcdefghik", 60, 2), words_in("abcdefghop", 60, 3)
    assert G.fit([("ro", t) for t in ro] + [("es", t) for t in es], counts={"ro": 56000, "es": 900}).langs == ["es", "ro"]


def test_fit_centroids_counts_all_documents(spark):
    ru = words_in("абвгдежзик", 400, 1)
    rows = [(i, t, "bg" if i % 10 == 0 else "ru") for i, t in enumerate(ru)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert G.fit_centroids(df, per_label=30).langs == ["ru"]


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "Ana are mere.", None)], "doc_id long, text string, lang string")
    assert [r["lang"] for r in G.language_segments(df, G.fit_centroids(df)).collect()] == ["und"]


def test_similarities_are_cosines():
    docs = [("aa", t) for t in words_in("abcdefgh", 40, 4)] + [("bb", t) for t in words_in("mnopqrst", 40, 5)]
    c = G.fit(docs)
    ws = G.words("abba abba mona strop abcdef " + "x" * 40)
    ids, _ = G.grams(ws)
    v = np.bincount(ids, minlength=G.DIMS) * c.idf
    want = (v @ (c.weight.T / c.idf).T) / np.linalg.norm(v)
    best = [want[c.owner == j].max() for j in range(len(c.langs))]
    assert np.allclose(c.similarities([ws, ws[:2], ws])[[0, 2]], best, atol=1e-4)
    assert np.allclose(c.similarities([ws[::-1]])[0], best, atol=1e-4)


def test_pieces_do_not_end_at_abbreviations():
    text = "Se depun avize, procuri etc. pentru dosar. Vezi art. 5 azi! Il gatto dorme."
    assert [text[a:b].strip() for a, b in G.pieces(text)] == ["Se depun avize, procuri etc. pentru dosar.", "Vezi art. 5 azi!", "Il gatto dorme."]
    assert [b - a for a, b in G.pieces("a" * 100_000)] == [100_000]


@needs_data
def test_languages_of_documents_of_one_script(spark):
    """Held-out accuracy: documents whose label the fit did not see, in scripts that tell the language."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    c = G.fit_centroids(docs.where("doc_id % 2 = 0"))
    known = {"el": "[Ͱ-Ͽ]", "th": "[฀-๿]", "hi": "[ऀ-ॿ]", "zh": "[一-鿿]", "ru": "[Ѐ-ӿ]"}
    for r in G.document_languages(G.language_segments(docs.where("doc_id % 2 = 1"), c)).join(docs.select("doc_id", "text"), "doc_id").where("part > 0.9").collect():
        if r["lang"] in known:
            assert len(re.findall(known[r["lang"]], r["text"])) > 10
        assert 0 <= r["confidence"] <= 1


def test_rejected_documents_come_out_as_und(spark):
    docs = [("aa", t) for t in words_in("abcdefgh", 40, 4)]
    c = G.fit(docs)
    df = spark.createDataFrame([(1, "Жук щука яма.", "aa"), (2, docs[0][1], None)], "doc_id long, text string, lang string")
    langs = G.document_languages(G.language_segments(df, c))
    assert sorted((r["doc_id"], r["lang"]) for r in langs.collect()) == [(1, "und"), (2, "aa")]
    assert [(r["doc_id"], r["lang"]) for r in G.label_cases(langs).collect()] == [(2, "aa")]


def test_marginals_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    e, moves = rng.normal(size=(5, 6)), rng.normal(size=(2, 2))
    size = [6, 3, 1, 5, 2]
    real = np.array([[k < n for k in range(6)] for n in size])
    p, counts = S.marginals(np.where(real, e, 0.0), real, moves)
    want = np.zeros((2, 2))
    for i, n in enumerate(size):
        paths = list(product((0, 1), repeat=n))
        score = np.array([sum(e[i, k] * t + moves[a][t] for k, (a, t) in enumerate(zip((0, *x), x))) for x in paths])
        prob = np.exp(score) / np.exp(score).sum()
        assert np.allclose(p[i, :n], prob @ np.array(paths))
        for x, q in zip(paths, prob):
            for a, b in zip((0, *x), x):
                want[a, b] += q
    assert np.allclose(counts, want)


def test_sentences_without_marks_or_spaces_between_words():
    """Units of a script that writes no end marks are told by their spaces; one without spaces either by its marks."""
    rng = random.Random(8)
    first, rest = "กขค", "งจฉชซฌญ"
    unit = lambda: rng.choice(first) + "".join(rng.choices(rest, k=rng.randrange(4, 12)))
    rows = []
    for _ in range(300):
        text, spans = "", []
        for u in (unit() for _ in range(rng.randrange(1, 6))):
            text += " " if text else ""
            spans.append((len(text), len(text) + len(u)))
            text += u
        rows.append((text, spans))
        text, spans = "", []
        for u in ("".join(rng.choices("山川田中", k=5)) + "。" for _ in range(3)):
            spans.append((len(text), len(text) + len(u)))
            text += u
        rows.append((text, spans))
    model = S.train(rows[:400])
    assert sum(model.spans(t) == b for t, b in rows[400:]) / 200 > 0.95


def test_digits_of_other_scripts_are_no_look_alikes(spark):
    rows = [("a", "preț १२ lei"), ("b", "preț １２ lei"), ("c", "٣ mere"), ("d", "３ mere"), ("e", "३ mere"), ("f", "merge 3"), ("g", "ｍｅｒｇｅ café")]
    fields = L.text_fields(spark.createDataFrame(rows, "id string, text string"), "id", ["text"], "t")
    got = {r["rec_key"]: r["value"] for r in L.in_consistent_form(fields).collect()}
    assert got == {"a": "preț १२ lei", "b": "preț 12 lei", "c": "٣ mere", "d": "3 mere", "e": "३ mere", "f": "merge 3", "g": "merge café"}
    wrong = L.inconsistent_fields(L.suspect_fields(spark.createDataFrame(rows, "id string, text string"), "id", ["text"], "t"))
    assert {r["rec_key"] for r in wrong.collect()} == {"b", "d", "g"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rostire_words_")]
