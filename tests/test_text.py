import random
import re

import pytest
from pyspark.sql import functions as F

from rostire.functions import text as X
from rostire.operators.normalize import Cascade


def col(spark, texts, fn):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_clean(spark):
    cases = {"Ştiu că e ţeapă": "Știu că e țeapă", "„Bună” ziua ’n’": "\"Bună\" ziua 'n'", "  a  \x1cb\n\nc ": "a b c", "și ă": "și ă", "": "", None: None}
    assert col(spark, list(cases), X.clean) == list(cases.values())


def plain_segment(text):
    """Boundaries by the rules, one character at a time."""
    abbr = "|".join(sorted((re.escape(a) for a in X.PROTECTED_ABBREVIATIONS), key=len, reverse=True))
    spans = [m.span() for p, f in ((X.URL, re.I), (X.EMAIL, 0), (X.DATE, 0), (X.DECIMAL, 0), (rf"\b(?:{abbr})\.", re.I)) for m in re.finditer(p, text, f)]
    out, last = [], 0
    for m in re.finditer("[.!?…]+", text):
        if m.start() < last or any(a <= m.start() < b for a, b in spans):
            continue
        end = m.end()
        while end < len(text) and text[end] in "\"')]":
            end += 1
        out.append((last, end))
        last = end
    out.append((last, len(text)))
    res = []
    for a, b in out:
        s = text[a:b]
        if s.strip():
            start = a + len(s) - len(s.lstrip())
            res.append((s.strip(), start, start + len(s.strip())))
    return res


def test_segment_goldens(spark):
    cases = ["Nu știu... poate mâine.", "Dl. dr. Pop a venit. Da!", "Pe 3.05.2020 era 3,5 grade. Bine", "Scrie la a.b@c.ro azi. Vezi www.x.ro", "", 'He said "Da!". Ok?', "etc. Apoi vine."]
    got = col(spark, cases, X.segment)
    for t, g in zip(cases, got):
        assert [(s["text"], s["start"], s["end"]) for s in g] == plain_segment(t), t
        assert all(t[s["start"] : s["end"]] == s["text"] for s in g)


def test_segment_random(spark):
    rng = random.Random(3)
    parts = ["Ana", "are", "3,5", "mere.", "dr.", "Pop", "12.03.2021", "www.a.ro", "Da!", "Ce?!", '"Vai..."', "etc.", "a@b.ro", "(nu)", "…", "str.", "1.2."]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(150)]
    for t, g in zip(texts, col(spark, texts, X.segment)):
        assert [(s["text"], s["start"], s["end"]) for s in g] == plain_segment(t), t


@pytest.mark.parametrize(
    "text,spoken",
    [
        ("Costă 10€.", "Costă zece euro."), ("Vino la ora 09:00.", "Vino la ora nouă fix."), ("3,14", "trei virgulă paisprezece"), ("25 kg", "douăzeci și cinci de kilograme"),
        ("al XIV-lea", "al paisprezecelea"), ("a II-a", "a doua"), ("1.03.2020", "întâi martie două mii douăzeci"), ("40.03.2020", "patruzeci virgulă trei.două mii douăzeci"), ("5%", "cinci la sută"),
        ("Dr. Pop", "Doctor Pop"), ("3,5 kg", "trei,cinci kilograme"), ("25kg", "25kg"), ("12:30", "doisprezece și treizeci de minute"), ("9999999999999999", "9999999999999999"),
    ],
)
def test_normalize(text, spoken):
    out, trace, errors = Cascade().run(text)
    assert out == spoken
    assert (errors != []) == (text == "9999999999999999")
    assert all(o != r for _, o, r, _, _ in trace)


def test_trace():
    _, trace, _ = Cascade().run("Are 25 kg.")
    assert trace == [("unit", "25 kg", "douăzeci și cinci de kilograme", 4, 9)]


def test_small_functions(spark):
    assert col(spark, ["A  ß ", None], X.dedup_key) == ["a ss", None]
    assert col(spark, ["a b/c?.wav"], X.slug) == ["a_b_c_.wav"]
    pauses = col(spark, ["Da, nu... bine."], X.pause_locations)[0]
    assert [(p["offset"], p["category"]) for p in pauses] == [(2, "comma"), (6, "ellipsis"), (14, "period")]
    assert col(spark, ["Prima propoziție.\n\nA doua. A treia.", "Una. Doua.\n \nTrei."], X.paragraph_starts) == [[0, 1], [0, 2]]
    assert col(spark, ["A=B|C=D", "_", None], X.parse_feats) == [{"A": "B", "C": "D"}, {}, {}]
    row = spark.range(1).select(X.detokenize(F.array(F.lit("Da"), F.lit("!")), F.array(F.lit(False), F.lit(True))).alias("t")).first()
    assert row["t"] == "Da!"
