import json

import pytest
from pyspark.sql import functions as F

from rostire.operators import layers as Y
from rostire.operators import serializers as Z
from rostire.operators.pipeline import Pipeline, load_config, process, requested
from rostire.operators.registry import CycleError, Layer, Registry, UnknownLayerError

NOOP = lambda df, c: df


def make(*specs):
    return Registry([Layer(n, frozenset(p), frozenset(r), NOOP, frozenset(a)) for n, p, r, a in specs])


def test_registry():
    reg = make(("c", "C", "B", ""), ("b", "B", "A", ""), ("a", "A", "", ""), ("d", "D", "", "C"))
    assert [x.name for x in reg.resolve(["C", "D"])] == ["a", "b", "c", "d"]
    assert [x.name for x in reg.resolve(["D"])] == ["d"]
    with pytest.raises(UnknownLayerError):
        reg.resolve(["X"])
    with pytest.raises(ValueError):
        reg.register(Layer("e", frozenset("A"), frozenset(), NOOP))
    with pytest.raises(CycleError):
        make(("a", "A", "B", ""), ("b", "B", "A", "")).resolve(["A"])


def test_prosody_runs_after_what_it_reads():
    names = [x.name for x in Y.default_registry().resolve(["prosody", "focus", "emotion"])]
    assert names.index("prosody") > max(names.index("focus"), names.index("emotion"))


def test_config():
    assert load_config({"processing": {"include": ["a", "b"], "exclude": ["b"]}})["include"] == ["a"]
    assert requested({"include": ["a"]}, include=["b", "c"], exclude=["c"]) == ["b"]
    with pytest.raises(ValueError):
        requested({"include": ["a"]}, exclude=["a"])


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def dist(**kw):
    return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(float(v)))])


def test_decide_label(spark):
    cases = [(dict(happy=0.55, surprise=0.35, neutral=0.1), ("happy", "surprise")), (dict(happy=0.5, sad=0.5), ("unspecified", None)), (dict(happy=0.3, sad=0.29), ("unspecified", None)), (dict(happy=0, sad=0), ("unspecified", None))]
    for d, (label, second) in cases:
        got = one(spark, Y.decide_label(dist(**d)))
        assert got["label"] == label
        if second:
            assert got["secondary_label"] == second
    assert one(spark, Y.decide_label(dist(happy=0)))["confidence"] == 0.0


def test_weighted_and_intensity(spark):
    assert one(spark, Y.weighted(dist(happy=1), 0)) == pytest.approx(0.85) and one(spark, Y.weighted(dist(happy=1), 1)) == pytest.approx(0.65)
    assert one(spark, Y.weighted(F.expr("cast(map() as map<string,double>)"), 0)) is None
    for label, a, want in (("angry", 0.8, "high"), ("neutral", 0.5, "medium"), ("sad", 0.3, "low"), ("unspecified", 0.9, "unspecified")):
        assert one(spark, Y.intensity(F.lit(label), F.lit(a), F.lit(0), F.lit(0), F.lit(0))) == want
    raw = one(spark, Y.aggregate_labels(dist(joy=0.3, love=0.3, anger=0.2, fear=0.2)))
    assert raw["happy"] == pytest.approx(0.6) and raw["angry"] == pytest.approx(0.2)


def test_stress(spark):
    words = {"fericire": "fe-ri-ci-re", "aplic": "a-plic", "ochi": "o-chi", "xyz": "xyz", "important": "im-por-tant", "frumoasă": "fru-moa-să"}
    for w, s in words.items():
        assert "-".join(one(spark, Y.syllabify(F.lit(w)))) == s
    assert one(spark, Y.stressed_group(F.lit("fˌeɾitʃˈiɾe"))) == 2 and one(spark, Y.stressed_group(F.lit("abc"))) is None
    for w, i in (("frumoasă", 1), ("important", 2), ("da", 0)):
        assert one(spark, Y.fallback_stress(Y.syllabify(F.lit(w)), F.lit(w))) == i


def run(spark, text, **kw):
    df = spark.createDataFrame([("d", text)], "id string, text string")
    return Pipeline(kw.pop("profile", "expressive")).process(df, "text", "id", **kw)


def test_focus_and_prosody(spark):
    r = run(spark, "Nu e bine, ci FOARTE rău!").first()
    toks = {t["text"]: t for t in r["sentences"][0]["tokens"]}
    assert toks["FOARTE"]["is_focus"] and toks["rău"]["focus_score"] == 1.0 and toks["rău"]["focus_rules"] == ["intensifier_target", "corrective_construction"]
    assert toks["bine"]["focus_score"] == 0.0 and toks["bine"]["focus_rules"] == ["contrastive_negation_suppressed"]
    assert toks[","]["pause_after_ms"] == 150 and toks["bine"]["pause_after_ms"] is None
    p = r["sentences"][0]["prosody"]
    assert p["pause_after_ms"] == 400 and p["terminal_contour"] == "falling" and r["sentences"][0]["is_negated"]


def test_user_overrides(spark):
    r = run(spark, "Casa este mare.", user_focus_words=["Casa"], prosody_overrides={0: {"speaking_rate": 0.9}}).first()
    s = r["sentences"][0]
    assert s["tokens"][0]["focus_score"] == 1.0 and s["tokens"][0]["focus_provenance"] == "user"
    assert s["prosody"]["speaking_rate"] == 0.9 and "user_override_speaking_rate" in s["prosody"]["rules"]


def emo(label, conf, d, intensity="medium"):
    return F.struct(F.lit(label).alias("label"), F.lit(conf).alias("confidence"), F.lit(0.5).alias("valence"), F.lit(0.5).alias("arousal"), F.lit(intensity).alias("intensity"), dist(**d).alias("distribution"))


def test_context_adjustment(spark):
    happy = emo("happy", 0.9, dict(happy=1))
    none = F.lit(None).cast("string")
    weak = emo("unspecified", 0.3, dict(sad=0.3, happy=0.25, angry=0.15, fear=0.15, surprise=0.15))
    got = one(spark, Y.adjust(weak, happy, none))
    assert got["label"] == "happy" and got["changed"] and "context_blend:unspecified->happy" in got["reason"]
    assert not one(spark, Y.adjust(happy, weak, none))["changed"]
    assert one(spark, Y.adjust(weak, happy, F.lit("contrast")))["label"] == "unspecified"


def test_style_and_insertion(spark):
    r = run(spark, "Sunt fericit. Conform legii, e bine.", profile={"include": ["interjections"]}).first()
    assert r["document_style"] == "formal" and r["sentences"][0]["interjection_suggestions"] == []
    r = run(spark, "Sunt fericit.", profile={"include": ["interjections"]}, interjection_mode="insert").first()
    assert r["document_style"] == "conversational" and r["sentences"][0]["text_with_interjections"] == "Bravo, sunt fericit." and r["sentences"][0]["text"] == "Sunt fericit."


def test_pronunciation(spark):
    r = run(spark, "TVA.", profile="pronunciation").first()
    assert r["phoneme_text"] == "tˈe vˈe ˈa ."


def test_serializers(spark):
    assert [one(spark, Z.quantize(F.lit(x))) for x in (1.123, 1.176, 0.981)] == [1.10, 1.20, 1.00]
    df = run(spark, "Vai, ce frică îmi e! FOARTE bine?", serialize=True).cache()
    back = Z.parse_control_tokens(df, "id", "tts_token_text").orderBy("sentence_index").collect()
    sents = df.first()["sentences"]
    assert [b["sentence_type"] for b in back] == [s["sentence_type"] for s in sents]
    assert [b["pause_after_ms"] for b in back] == [s["prosody"]["pause_after_ms"] for s in sents]
    assert back[1]["focus_count"] >= 1
    assert "<speak>" in df.select(Z.ssml_like(F.col("sentences")).alias("x")).first()["x"]
    row = json.loads(df.select(Z.canonical_json(F.struct(*df.columns)).alias("x")).first()["x"])
    assert "phoneme_text" in row and row["phoneme_text"] is None


@pytest.mark.parametrize("text", ["", None, "�", "🙂 \x07 da", "la " * 400, "áb?!?!", "123"])
def test_edge_texts(spark, text):
    r = run(spark, text, profile={"include": ["context", "interjections", "prosody", "focus", "lexical_stress"]}).first()
    assert r["original_text"] == text and r["errors"] == []


def test_injected_models(spark):
    df = spark.createDataFrame([("a", "Salut.")], "id string, text string")
    p = Pipeline({"include": ["emotion", "phonemes"], "predictor": lambda t: dist(sad=0.9, happy=0.1), "phonemizer": lambda w: F.concat(F.lower(w), F.lit("ˈa"))})
    s = p.process(df, "text", "id").first()["sentences"][0]
    assert s["emotion"]["label"] == "sad" and s["tokens"][0]["phonemes"] == "salutˈa" and s["tokens"][0]["pronunciation_provenance"] == "predicted"


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", "Da.", 1, 2)], "id string, text string, sentences int, trace int")
    assert process(df, id_col="id").first()["normalized_text"] == "Da."
