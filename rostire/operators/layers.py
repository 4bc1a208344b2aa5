"""The annotation layers. Each widens the row; none moves it.

A document is one row with ``original_text``; ``sentences`` holds one struct per sentence. All rules
are native expressions over arrays, except spoken forms (with trace) and injected models.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X
from . import lexicon as L
from . import normalize
from .registry import Layer, Registry

NO_STRINGS = "cast(array() as array<string>)"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _by_word(spec: dict[str, str]) -> dict[str, str]:
    """Each listed word with the key it stands under; the first key wins."""
    out: dict[str, str] = {}
    for k, words in spec.items():
        for w in words.split():
            out.setdefault(w, k)
    return out


def each(df: DataFrame, fn) -> DataFrame:
    """``df`` with ``fn`` applied to every sentence."""
    return df.withColumn("sentences", F.transform("sentences", fn))


# clean, sentences, normalized


def _clean_edits(s: pd.Series) -> pd.Series:
    import unicodedata

    passes = [
        ("legacy_diacritics", re.compile(f"[{X.LEGACY[0]}]"), str.maketrans(*X.LEGACY)),
        ("quotes", re.compile(f"[{X.QUOTES[0]}]"), str.maketrans(*X.QUOTES)),
        ("whitespace", re.compile(r"\s+"), None),
    ]

    def one(t: str | None) -> list | None:
        if t is None:
            return None
        text, out = unicodedata.normalize("NFC", t), []
        for name, pattern, table in passes:
            edits: list = []
            text = normalize.substitute(text, pattern, (lambda m, tb=table: m[0].translate(tb)) if table else (lambda m: " "), name, edits)
            out += edits
        if text != text.strip():
            out.append(("strip", text, text.strip(), 0, len(text)))
        keys = ("operation", "original", "replacement", "start", "end")
        rest = {"stage": "clean", "provenance": "rule", "producer": "rostire_cleaner_1", "confidence": 1.0, "sentence_index": None}
        return [dict(zip(keys, e)) | rest for e in out]

    return s.map(one)


def clean(df: DataFrame, config: dict) -> DataFrame:
    """``clean_text`` and its trace (38 to 42)."""
    df = df.withColumn("clean_text", X.clean(F.col("original_text")))
    edits = F.pandas_udf(_clean_edits, f"array<{S.struct(S.TRACE)}>")
    trace = edits(F.when(F.col("clean_text") != F.col("original_text"), F.col("original_text")))
    return df.withColumn("trace", F.coalesce(trace, F.expr(f"cast(array() as array<{S.struct(S.TRACE)}>)")))


def sentences(df: DataFrame, config: dict) -> DataFrame:
    """``sentences`` with text and offsets into ``clean_text`` (43 to 45)."""
    return df.withColumn("sentences", X.segment(F.col("clean_text")))


def normalized(df: DataFrame, config: dict) -> DataFrame:
    """Spoken form of each sentence and of the document, with trace and errors (49 to 58)."""
    parts = normalize.normalize_sentences(F.transform("sentences", lambda s: s["text"]), config.get("currencies"), config.get("units"), config.get("abbreviations"))
    df = df.withColumn("_norm", parts)
    fixed = lambda e, i: F.struct(
        F.lit("normalize").alias("stage"), e["operation"].alias("operation"), e["original"].alias("original"), e["replacement"].alias("replacement"), e["start"].alias("start"), e["end"].alias("end"),
        F.lit("rule").alias("provenance"), F.lit(normalize.PRODUCER).alias("producer"), F.lit(1.0).alias("confidence"), i.alias("sentence_index"),
    )
    trace = F.flatten(F.transform("_norm", lambda p, i: F.transform(p["trace"], lambda e: fixed(e, i))))
    return (
        df.withColumn("trace", F.concat("trace", trace))
        .withColumn("errors", F.flatten(F.transform("_norm", lambda p: p["errors"])))
        .withColumn("sentences", F.zip_with("sentences", "_norm", lambda s, p: s.withField("normalized", p["text"])))
        .withColumn("normalized_text", F.array_join(F.transform("_norm", lambda p: p["text"]), " "))
        .drop("_norm")
    )


# tokens


TOKEN = re.compile(X.TOKEN.removeprefix("(?U)").replace("|[^", r"|\.\.\.|[^"))
_TAGGED = {"text": pa.string(), "start": pa.int32(), "lemma": pa.string(), "upos": pa.string(), "negative": pa.bool_(), "person": pa.string(), "ordered": pa.bool_()}
_CLASSES, _PERSONS = _by_word(L.CLOSED_CLASS), _by_word(L.PERSONS)
_EXCLAIM, _NEGATIVE, _ORDERED = {w for w, _, _ in L.INTERJECTIONS} - {"super"}, set(L.NEGATIONS), set(L.IMPERATIVES)


def tagged(text: str) -> list[tuple]:
    """Tokens of a sentence with offsets, closed-class tags, negation, person and command."""
    out = []
    for i, m in enumerate(TOKEN.finditer(text)):
        word, low = m[0], m[0].lower()
        command = i == 0 and low in _ORDERED
        if not (word[0].isalnum() or "_" in word):
            upos = "PUNCT"
        elif word[0].isdecimal():
            upos = "NUM"
        elif low in _EXCLAIM:
            upos = "INTJ"
        else:
            upos = _CLASSES.get(low) or ("VERB" if command else "PROPN" if i and word[0].isupper() and word[1:2].islower() else "NOUN")
        out.append((word, m.start(), low, upos, low in _NEGATIVE, _PERSONS.get(low), command))
    return out


_SPARK = {pa.string(): T.StringType(), pa.int32(): T.IntegerType(), pa.bool_(): T.BooleanType()}


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField(k, _SPARK[v]) for k, v in _TAGGED.items()]))))
def _tag(texts: pa.Array) -> pa.Array:
    docs = texts.to_pylist()
    flat = X.struct_lists([None if t is None else tagged(t) for d in docs if d for t in d], _TAGGED)
    ends = np.cumsum([0] + [len(d or ()) for d in docs])
    starts = pa.array([None if d is None else int(e) for d, e in zip(docs, ends)] + [int(ends[-1])], pa.int32())
    return pa.ListArray.from_arrays(starts, flat)


def rule_tokens_of(texts: Column) -> Column:
    """Tokens of each sentence of an array by rules: offsets, closed-class tags, negation and person features.

    A deterministic stand-in for a parser; ``head`` and ``deprel`` stay null but for commands.
    """
    blank = "cast(map() as map<string,string>)"

    def token(t: Column) -> Column:
        feats = F.map_concat(
            F.when(t["negative"], _map({"Polarity": "Neg"})).otherwise(F.expr(blank)), F.when(t["person"].isNotNull(), F.create_map(F.lit("Person"), t["person"])).otherwise(F.expr(blank)),
            F.when(t["ordered"], _map({"Mood": "Imp"})).otherwise(F.expr(blank)),
        )
        plain = ~(t["negative"] | t["person"].isNotNull() | t["ordered"])
        own = {k: t[k] for k in ("text", "start", "lemma", "upos")} | {"end": t["start"] + F.length(t["text"]), "feats": F.when(plain, F.expr(blank)).otherwise(feats), "deprel": F.when(t["ordered"], "root"), "is_interjection": t["upos"] == "INTJ"}
        return token_struct(own)

    return F.transform(_tag(texts), lambda s: F.transform(s, token))


def rule_tokens(text: Column) -> Column:
    """Tokens of one sentence by rules."""
    return F.get(rule_tokens_of(F.array(text)), F.lit(0))


def token_struct(own: dict[str, Column]) -> Column:
    """A full token with the given fields and nulls (empty lists of rules) elsewhere."""
    fields = []
    for spec in S._fields(S.TOKEN):
        name, kind = spec.split(":", 1)
        blank = F.expr(NO_STRINGS) if name in ("focus_rules", "prosody_rules") else _null(kind)
        fields.append(own.get(name, blank).cast(kind).alias(name))
    return F.struct(*fields)


def sentence_type(text: Column, tokens: Column) -> Column:
    """Imperative by a root in the imperative, else by the last mark, else incomplete (69)."""
    imp = F.exists(tokens, lambda t: (t["deprel"] == "root") & (F.try_element_at(t["feats"], F.lit("Mood")) == "Imp"))
    last = F.right(F.rtrim(text), F.lit(1))
    return F.when(F.coalesce(imp, F.lit(False)), "imperative").when(last.isin(".", "…"), "declarative").when(last == "?", "interrogative").when(last == "!", "exclamative").otherwise("incomplete")


def tokens(df: DataFrame, config: dict) -> DataFrame:
    """Tokens, sentence type and negation (64 to 70). ``config['analyzer']`` maps a text column to tokens."""
    if config.get("analyzer"):
        df = each(df, lambda s: s.withField("tokens", config["analyzer"](s["normalized"])))
    else:
        df = df.withColumn("_tokens", rule_tokens_of(F.transform("sentences", lambda s: s["normalized"])))
        df = df.withColumn("sentences", F.zip_with("sentences", "_tokens", lambda s, t: s.withField("tokens", t))).drop("_tokens")
    return each(
        df,
        lambda s: s.withField("sentence_type", sentence_type(s["normalized"], s["tokens"])).withField(
            "is_negated", F.exists(s["tokens"], lambda t: F.coalesce(F.try_element_at(t["feats"], F.lit("Polarity")) == "Neg", F.lit(False)))
        ),
    )


# phonemes, stress


def phonemes(df: DataFrame, config: dict) -> DataFrame:
    """Pronunciation cascade: override, injected backend, grapheme fallback (71, 73 to 75)."""
    overrides, backend = _map(config.get("pronunciations", L.PRONUNCIATIONS)), config.get("phonemizer", lambda w: _null("string"))

    def one(t: Column) -> Column:
        low = F.lower(t["text"])
        fixed, spoken = F.try_element_at(overrides, low), F.nullif(backend(t["text"]), F.lit(""))
        source = F.when(fixed.isNotNull(), "lexicon").when(spoken.isNotNull(), "predicted").otherwise("fallback")
        sure = F.when(fixed.isNotNull(), 1.0).when(spoken.isNotNull(), 0.85).otherwise(0.1)
        full = t.withField("phonemes", F.coalesce(fixed, spoken, low)).withField("pronunciation_provenance", source).withField("pronunciation_producer", F.lit("rostire_phonemes_1")).withField("pronunciation_confidence", sure)
        return F.when(t["upos"] == "PUNCT", t.withField("phonemes", t["text"]).withField("pronunciation_provenance", F.lit("rule")).withField("pronunciation_producer", F.lit("rostire_phonemes_1")).withField("pronunciation_confidence", F.lit(1.0))).otherwise(full)

    df = each(df, lambda s: s.withField("tokens", F.transform(s["tokens"], one)))
    return df.withColumn("phoneme_text", F.array_join(F.transform("sentences", lambda s: F.array_join(F.transform(s["tokens"], lambda t: t["phonemes"]), " ")), " "))


def unknown_symbols(phoneme_text: Column) -> Column:
    """Characters outside the inventory, whitespace aside (74, 122)."""
    return F.array_except(F.filter(F.split(phoneme_text, ""), lambda c: (c != "") & ~c.rlike(r"(?U)\s")), F.lit(L.INVENTORY))


# Vowels of the spelling and onsets that are never split.
VOWELS = "aăâîeiou"
ONSETS = "pl|pr|bl|br|tr|dr|cl|cr|gl|gr|fl|fr|vl|vr|ch|gh"
IPA_VOWELS = "aeiouəɨɔɪʊy"


def syllabify(word: Column) -> Column:
    """Syllables: a cluster between vowels gives its last sound, or its last whole onset, to the next (76)."""
    cut = F.regexp_replace(word, rf"(?iu)(?<=[{VOWELS}])([^{VOWELS}]*?)((?:{ONSETS})|[^{VOWELS}])(?=[{VOWELS}])", "$1\u0001$2")
    return F.when(word == "", F.expr(NO_STRINGS)).otherwise(F.split(cut, "\u0001"))


def stressed_group(phoneme: Column) -> Column:
    """Which vowel group carries primary stress; null without a mark (77)."""
    before = F.regexp_extract(phoneme, rf"(?s)^(.*)ˈ(?=.*[{IPA_VOWELS}])", 1)
    return F.when(phoneme.rlike(rf"(?s)ˈ.*[{IPA_VOWELS}]"), F.size(F.regexp_extract_all(before, F.lit(rf"[{IPA_VOWELS}]+"), F.lit(0))))


def fallback_stress(syllables: Column, word: Column) -> Column:
    """Penultimate after a final vowel, else last (78)."""
    n = F.size(syllables)
    return F.when(n <= 1, 0).when(word.rlike(f"(?iu)[{VOWELS}]$"), n - 2).otherwise(n - 1)


def stress(df: DataFrame, config: dict) -> DataFrame:
    """Syllables and the stress cascade: override, pronunciation, rule (79)."""
    overrides = config.get("stresses") or {}
    known = _map(overrides) if overrides else F.expr("cast(map() as map<string,int>)")

    def one(t: Column) -> Column:
        parts = syllabify(t["text"])
        fixed = F.try_element_at(known, F.lower(t["text"]))
        heard = F.when(t["pronunciation_provenance"] != "fallback", stressed_group(t["phonemes"]))
        heard = F.when(heard < F.size(parts), heard)
        source = F.when(fixed.isNotNull(), "lexicon").when(heard.isNotNull(), "predicted").otherwise("fallback")
        sure = F.when(fixed.isNotNull(), 1.0).when(heard.isNotNull(), 0.8).otherwise(0.3)
        full = t.withField("syllables", parts).withField("stressed_syllable_index", F.coalesce(fixed, heard, fallback_stress(parts, t["text"])).cast("int"))
        return F.when(t["upos"] == "PUNCT", t).otherwise(full.withField("stress_provenance", source).withField("stress_producer", F.lit("rostire_stress_1")).withField("stress_confidence", sure))

    return each(df, lambda s: s.withField("tokens", F.transform(s["tokens"], one)))


# emotion


def cue_predictor(text: Column) -> Column:
    """Default predictor: label distribution from a few cue words, one part neutral."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    hits = {k: F.size(F.array_intersect(words, F.lit(v.split()))).cast("double") for k, v in L.CUES.items()}
    total = reduce(lambda a, b: a + b, hits.values()) + 0.5
    return F.create_map(*[x for k in L.LABELS for x in (F.lit(k), (hits.get(k, F.lit(0.0)) if k != "neutral" else F.lit(0.5)) / total)])


def aggregate_labels(raw: Column) -> Column:
    """Distribution over our labels from one over a classifier's own, renormalised (82)."""
    entries = F.map_entries(raw)
    raws = {k: [r for r, own in L.RAW_LABELS.items() if own == k] for k in L.LABELS}
    part = lambda names: F.aggregate(F.filter(entries, lambda e: e["key"].isin(names)), F.lit(0.0), lambda a, e: a + e["value"])
    sums = [part(raws[k]) for k in L.LABELS]
    total = reduce(lambda a, b: a + b, sums)
    return F.create_map(*[x for k, s in zip(L.LABELS, sums) for x in (F.lit(k), F.when(total > 0, s / total).otherwise(0.0))])


def ranked(distribution: Column) -> Column:
    """Entries from the most likely down; ties keep a fixed order of labels."""
    return F.array_sort(F.transform(F.map_entries(distribution), lambda e: F.struct((-e["value"]).alias("v"), F.array_position(F.lit(L.LABELS), e["key"]).alias("o"), e["key"].alias("k"))))


def decide_label(distribution: Column) -> Column:
    """``struct<label,confidence,secondary_label>``: a tie or less than 0.40 decides nothing (83)."""

    def decide(r: Column) -> Column:
        top, second = -F.get(r, F.lit(0))["v"], F.coalesce(-F.get(r, F.lit(1))["v"], F.lit(0.0))
        none = F.coalesce(top, F.lit(0.0)) <= 0
        return F.struct(
            F.when(none | (top == second) | (top < 0.40), "unspecified").otherwise(F.get(r, F.lit(0))["k"]).alias("label"),
            F.when(none, 0.0).otherwise(top).alias("confidence"),
            F.when(~none & (second >= 0.5 * top), F.get(r, F.lit(1))["k"]).alias("secondary_label"),
        )

    return X.let(ranked(distribution), decide)


def weighted(distribution: Column, axis: int) -> Column:
    """Mean valence (0) or arousal (1) of the labels; null for an empty distribution (84)."""
    proto = _map({k: v[axis] for k, v in L.PROTOTYPES.items()})

    def mean(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x["value"])
        return F.when(total > 0, F.aggregate(e, F.lit(0.0), lambda a, x: a + x["value"] * F.try_element_at(proto, x["key"])) / total)

    return X.let(F.map_entries(distribution), mean)


def shouted(text: Column) -> Column:
    """Whether a token is of two or more capital letters alone."""
    return text.rlike(r"^\p{Lu}{2,}$")


def intensity(label: Column, arousal: Column, bangs: Column, questions: Column, caps: Column) -> Column:
    """Intensity from arousal, raised a little by marks and capitals (85, 86)."""
    score = F.coalesce(arousal, F.lit(0.5)) + F.least(F.lit(0.15), 0.05 * bangs + 0.03 * questions + 0.05 * caps)
    return F.when(label == "unspecified", "unspecified").when(score >= 0.65, "high").when(score >= 0.45, "medium").otherwise("low")


def emotion(df: DataFrame, config: dict) -> DataFrame:
    """Emotion of each sentence (81 to 87). ``config['predictor']`` maps a text column to a distribution, over raw labels with ``raw_labels``."""
    predict = config.get("predictor", cue_predictor)
    df = df.withColumn("_dist", F.transform("sentences", lambda s: predict(s["normalized"]))) if config.get("row_predictor") is None else df.withColumn("_dist", config["row_predictor"](F.transform("sentences", lambda s: s["normalized"])))
    if config.get("raw_labels"):  # the predictor has a classifier's own labels
        df = df.withColumn("_dist", F.transform("_dist", aggregate_labels))
    df = df.withColumn("_emo", F.transform("_dist", lambda d: F.struct(decide_label(d).alias("d"), weighted(d, 0).alias("v"), weighted(d, 1).alias("a"), d.alias("m"))))

    def one(s: Column, e: Column) -> Column:
        count = lambda cond: F.size(F.filter(s["tokens"], cond))
        marks = lambda c: count(lambda t: (t["upos"] == "PUNCT") & (t["text"] == c))
        bangs, questions = marks("!"), marks("?")
        level = intensity(e["d"]["label"], e["a"], bangs, questions, count(lambda t: (t["upos"] != "PUNCT") & shouted(t["text"])))
        evidence = F.when(e["d"]["label"] != "unspecified", F.array(F.struct(F.left(F.trim(s["normalized"]), F.lit(80)).alias("span"), F.lit("predictor").alias("rule")))).otherwise(F.expr("cast(array() as array<struct<span:string,rule:string>>)"))
        return s.withField(
            "emotion",
            F.struct(
                e["d"]["label"].alias("label"), F.round(e["d"]["confidence"], 3).alias("confidence"), F.round(e["v"], 3).alias("valence"), F.round(e["a"], 3).alias("arousal"), level.alias("intensity"),
                e["d"]["secondary_label"].alias("secondary_label"), F.transform_values(e["m"], lambda k, v: F.round(v, 3)).alias("distribution"), evidence.alias("evidence"),
                F.lit("predicted").alias("provenance"), F.lit("rostire_emotion_1").alias("producer"),
            ).cast(S.struct(S.EMOTION)),
        )

    return df.withColumn("sentences", F.zip_with("sentences", "_emo", one)).drop("_dist", "_emo")


# focus

FUNCTION_UPOS = ["DET", "ADP", "CCONJ", "SCONJ", "AUX", "PART", "PUNCT"]


def focus_tokens(toks: Column, intensifiers: dict | None = None, emotive: list[str] | None = None, user_words: list[str] | None = None) -> Column:
    """Tokens with focus score and rules (88 to 96); rules apply from left to right."""
    strong = F.lit(sorted(intensifiers if intensifiers is not None else L.INTENSIFIERS))
    key = lambda t: F.lower(F.coalesce(t["lemma"], t["text"]))

    def bound(toks: Column) -> Column:
        keys = F.transform(toks, lambda t: F.when(t["upos"] != "PUNCT", key(t)))
        neg = F.array_position(F.transform(toks, lambda t: F.coalesce(F.try_element_at(t["feats"], F.lit("Polarity")) == "Neg", F.lit(False))), True)
        root = F.array_position(F.transform(toks, lambda t: F.coalesce((t["deprel"] == "root") & (t["upos"] == "VERB"), F.lit(False))), True)
        first = X.let(F.struct(toks.alias("toks"), keys.alias("keys"), neg.alias("neg"), root.alias("root")), lambda v: F.struct(v["toks"].alias("toks"), v["keys"].alias("keys"), v["neg"].alias("neg"), v["root"].alias("root"), ci_of(v).alias("ci")))
        return X.let(first, close_all)

    def ci_of(v: Column) -> Column:
        return F.array_min(F.filter(F.transform(v["keys"], lambda k, i: F.when((k == "ci") & (i + 1 > v["neg"]), i + 1)), lambda x: x.isNotNull()))

    def scored_of(v: Column) -> Column:
        return F.transform(v["toks"], lambda t, i: one(v, t, i))

    def close_all(v: Column) -> Column:
        return F.zip_with(v["toks"], scored_of(v), close)

    def one(v: Column, t: Column, i: Column) -> Column:
        toks, keys, neg, root, ci = (v[n] for n in ("toks", "keys", "neg", "root", "ci"))
        before = lambda n: F.when(i >= n, key(F.get(toks, i - n)))
        content = ~t["upos"].isin(FUNCTION_UPOS)
        steps: list[tuple[str, Column, str]] = [
            ("all_caps", shouted(t["text"]), "+0.9"),
            ("intensifier_target", F.coalesce(F.array_contains(strong, F.concat_ws(" ", before(2), before(1))) & (i >= 2), F.lit(False)) | F.coalesce(F.array_contains(strong, before(1)), F.lit(False)), "+0.6"),
            ("repetition", content & (F.size(F.filter(keys, lambda k: k == key(t))) >= 2), "+0.4"),
            ("emotion_bearing", content & key(t).isin(emotive or ["\u0000"]), "+0.3"),
            ("contrastive_negation_suppressed", ci.isNotNull() & (neg > 0) & (i + 1 > neg) & (i + 1 < ci), "*0.3"),
            ("corrective_construction", ci.isNotNull() & (neg > 0) & (i + 1 > ci), "+0.7"),
            ("main_predicate", (root > 0) & (i + 1 == root), "+0.15"),
        ]
        on = [F.coalesce(c, F.lit(False)) for _, c, _ in steps]
        at = F.array(*on)
        sums = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
        factor = F.lit([float(x[1:]) for _, _, x in steps])
        score = F.aggregate(
            at, sums,
            lambda a, c: F.struct(
                F.when(~c, a["s"]).when(a["k"] == 4, a["s"] * F.get(factor, a["k"])).otherwise(a["s"] + F.get(factor, a["k"])).alias("s"), (a["k"] + 1).alias("k")
            ),
            lambda a: a["s"],
        )
        names = F.filter(F.zip_with(at, F.lit([n for n, _, _ in steps]), lambda c, n: F.when(c, n)), lambda n: n.isNotNull())
        return F.struct(score.alias("raw"), names.alias("names"))

    def close(t: Column, r: Column) -> Column:
        weak = t["upos"].isin(FUNCTION_UPOS) & (r["raw"] < 0.8)
        score = F.when(weak, 0.0).otherwise(F.least(F.lit(1.0), r["raw"]))
        user = (key(t).isin(user_words) | F.lower(t["text"]).isin(user_words)) if user_words else F.lit(False)
        full = (
            t.withField("focus_score", F.when(user, 1.0).otherwise(F.round(score, 3)))
            .withField("is_focus", user | (score >= 0.5))
            .withField("focus_provenance", F.when(user, "user").otherwise("rule"))
            .withField("focus_producer", F.lit("rostire_focus_1"))
            .withField("focus_rules", F.when(user, F.array(F.lit("user_override"))).when(weak, F.expr(NO_STRINGS)).otherwise(r["names"]))
        )
        return F.when(t["upos"] == "PUNCT", t).otherwise(full)

    return bound(toks)


def focus(df: DataFrame, config: dict) -> DataFrame:
    """Emphasis of each token."""
    user = [w.lower() for w in config.get("user_focus_words") or []]
    return each(df, lambda s: s.withField("tokens", focus_tokens(s["tokens"], config.get("intensifiers"), config.get("emotive_words"), user)))


# prosody

# Pauses in milliseconds.
PAUSES = {",": 150, ";": 250, ":": 250, ".": 400, "!": 400, "?": 400, "…": 600, "...": 600}


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def contour(kind: Column) -> Column:
    """Terminal contour of a sentence type (101)."""
    return F.when(kind == "interrogative", "rising").when(kind == "incomplete", "continuation").otherwise("falling")


def rates(arousal: Column) -> tuple[Column, Column, Column]:
    """Speaking rate, pitch and energy from arousal; 1.0 without it (100)."""
    x = F.lit(1.0) + (arousal - 0.5) * 0.4
    return tuple(F.when(arousal.isNull(), 1.0).otherwise(_clamp(x, a, b)) for a, b in ((0.80, 1.20), (0.85, 1.20), (0.80, 1.20)))


def prosody(df: DataFrame, config: dict) -> DataFrame:
    """Pauses, rate, pitch, energy and contour (97 to 104).

    ``config['prosody_overrides']``: sentence index to fields that win one by one.
    """
    fields = {f.name: f.dataType for f in df.schema["sentences"].dataType.elementType.fields}
    overrides = config.get("prosody_overrides") or {}
    names = ("speaking_rate", "relative_pitch", "relative_energy", "terminal_contour", "pause_after_ms")

    def token(t: Column, long: Column, pitch: Column, energy: Column) -> Column:
        key = F.when(t["text"] == "...", "…").otherwise(t["text"])
        base = F.try_element_at(_map(PAUSES), t["text"])
        terminal = long & key.isin(".", "!", "?", "…")
        pause = F.when(base.isNotNull(), F.least(F.lit(1000), base + F.when(terminal, 100).otherwise(0)))
        clause = F.coalesce(t["deprel"].isin("mark", "advcl", "ccomp"), F.lit(False))
        hot = F.coalesce(t["is_focus"], F.lit(False))
        boost = 0.15 * F.coalesce(t["focus_score"], F.lit(0.0))
        rules = F.concat(
            F.when(base.isNotNull(), F.array(F.concat(F.lit("punctuation_"), key))).otherwise(F.expr(NO_STRINGS)), F.when(base.isNotNull() & terminal, F.array(F.lit("long_sentence"))).otherwise(F.expr(NO_STRINGS)),
            F.when(clause, F.array(F.lit("clause_boundary"))).otherwise(F.expr(NO_STRINGS)), F.when(hot, F.array(F.lit("local_focus_boost"))).otherwise(F.expr(NO_STRINGS)),
        )
        return (
            t.withField("pause_after_ms", pause.cast("int")).withField("pause_before_ms", F.when(clause, 100).cast("int"))
            .withField("local_relative_pitch", F.when(hot, F.round(_clamp(pitch + boost, 0.85, 1.20), 3))).withField("local_relative_energy", F.when(hot, F.round(_clamp(energy + boost, 0.80, 1.20), 3)))
            .withField("prosody_rules", rules).withField("prosody_provenance", F.when(F.size(rules) > 0, "rule")).withField("prosody_producer", F.when(F.size(rules) > 0, "rostire_prosody_1"))
        )

    def one(s: Column) -> Column:
        arousal = s["emotion"]["arousal"] if "emotion" in fields else _null("double")
        _, pitch, energy = rates(arousal)
        long = F.size(F.filter(s["tokens"], lambda t: t["upos"] != "PUNCT")) > 15
        known = F.struct(long.alias("long"), pitch.alias("pitch"), energy.alias("energy"), s["tokens"].alias("tokens"))
        return s.withField("tokens", X.let(known, lambda v: F.transform(v["tokens"], lambda t: token(t, v["long"], v["pitch"], v["energy"]))))

    df = each(df, one)

    def close(s: Column, i: Column) -> Column:
        arousal = s["emotion"]["arousal"] if "emotion" in fields else _null("double")
        rate, pitch, energy = (F.round(x, 3) for x in rates(arousal))
        paused = F.filter(s["tokens"], lambda t: t["pause_after_ms"].isNotNull())
        last = F.when(F.size(paused) > 0, F.element_at(paused, -1)["pause_after_ms"]).otherwise(0)
        values = dict(zip(names, (rate, pitch, energy, contour(s["sentence_type"]), last)))
        rules = F.array(F.when(arousal.isNull(), "no_emotion_data").otherwise("arousal_driven"), F.concat(F.lit("terminal_contour_from_"), F.coalesce(s["sentence_type"], F.lit("unknown"))))
        for k, own in overrides.items():
            here = i == int(k)
            for n in names:
                if n in own:
                    values[n] = F.when(here, F.lit(own[n])).otherwise(values[n])
            rules = F.when(here, F.concat(rules, F.lit([f"user_override_{n}" for n in own]))).otherwise(rules)
        return s.withField("prosody", F.struct(*[v.alias(n) for n, v in values.items()], rules.alias("rules"), F.lit("rule").alias("provenance"), F.lit("rostire_prosody_1").alias("producer")).cast(S.struct(S.PROSODY)))

    return df.withColumn("sentences", F.transform("sentences", close))


# interjections and style


def has_interjection(toks: Column, words: list[str] | None = None) -> Column:
    """Whether a sentence has an interjection of the dictionary (105)."""
    known = F.lit(words if words is not None else [w for w, _, _ in L.INTERJECTIONS])
    return F.exists(toks, lambda t: (t["upos"] != "PUNCT") & F.array_contains(known, F.lower(F.coalesce(t["lemma"], t["text"]))))


def document_style(sents: Column, markers: list[str] | None = None) -> Column:
    """``struct<style,score>``: a marker decides, else three weak signs together (106)."""
    own = markers if markers is not None else L.FORMAL_MARKERS

    def style(sents: Column) -> Column:
        n = F.size(sents)
        content = F.aggregate(sents, F.lit(0), lambda a, s: a + F.size(F.filter(s["tokens"], lambda t: t["upos"] != "PUNCT")))
        person = F.exists(sents, lambda s: F.exists(s["tokens"], lambda t: F.coalesce(F.try_element_at(t["feats"], F.lit("Person")).isin("1", "2"), F.lit(False))))
        full = F.lower(F.array_join(F.transform(sents, lambda s: F.coalesce(s["normalized"], s["text"])), " "))
        weak = F.when(n > 0, (content / n > 12).cast("int")).otherwise(0) + (~person).cast("int") + (~F.exists(sents, lambda s: has_interjection(s["tokens"]))).cast("int")
        facts = F.struct(n.alias("n"), weak.alias("weak"), X.let(full, lambda t: X.contains_any(t, own)).alias("hit"))
        return X.let(facts, verdict)

    def verdict(v: Column) -> Column:
        some = F.coalesce(v["n"], F.lit(0)) > 0
        formal = some & (v["hit"] | (v["weak"] == 3))
        return F.struct(F.when(formal, "formal").otherwise("conversational").alias("style"), F.when(~some, 0.0).when(v["hit"], 1.0).otherwise(v["weak"] / 3).alias("score"))

    return X.let(sents, style)


def candidates(label: str, words: list | None = None, most: int = 2) -> list[tuple[str, float]]:
    """Interjections of a label from the heaviest down, in order of the list (107)."""
    own = [(w, x) for w, lab, x in (words if words is not None else L.INTERJECTIONS) if lab == label]
    return sorted(own, key=lambda p: -p[1])[:most]


def interjections(df: DataFrame, config: dict) -> DataFrame:
    """Suggestions behind their gates, and the inserted text if asked for (105 to 109)."""
    mode = config.get("interjection_mode", "suggest")
    df = df.withColumn("_style", document_style(F.col("sentences"), config.get("formal_markers")))
    df = df.withColumn("document_style", F.col("_style.style"))
    none = F.expr(f"cast(array() as array<{S.struct(S.SUGGESTION)}>)")

    def one(s: Column, style: Column) -> Column:
        e = s["emotion"]
        offer = none
        for label in L.LABELS:
            own = candidates(label)
            if own:
                rows = F.array(*[
                    F.struct(F.lit(w.capitalize()).alias("text"), F.lit(0).alias("position"), F.lit(f"emotion_match:{label}").alias("reason"), F.round(F.lit(x) * e["confidence"], 3).alias("confidence"), F.lit(label).alias("matched_emotion"))
                    for w, x in own
                ])
                offer = F.when(e["label"] == label, rows).otherwise(offer)
        allowed = F.lit(mode != "disabled") & (style != "formal") & ~has_interjection(s["tokens"]) & (e["confidence"] >= 0.6)
        text = F.coalesce(s["normalized"], s["text"])
        return X.let(F.when(F.coalesce(allowed, F.lit(False)), offer).otherwise(none), lambda out: fill(s, text, out))

    def fill(s: Column, text: Column, out: Column) -> Column:
        put = F.concat(F.get(out, F.lit(0))["text"], F.lit(", "), F.lower(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30)) if mode == "insert" else _null("string")
        return s.withField("interjection_suggestions", out).withField("text_with_interjections", F.when(F.size(out) > 0, put))

    both = F.struct("sentences", "document_style")
    return df.withColumn("sentences", X.let(both, lambda v: F.transform(v["sentences"], lambda s: one(s, v["document_style"])))).drop("_style")


# context


def discourse(toks: Column, markers: dict | None = None) -> Column:
    """Category of the sentence's first word, punctuation aside (111)."""
    first = F.get(F.filter(toks, lambda t: t["upos"] != "PUNCT"), F.lit(0))
    word = F.lower(F.coalesce(first["lemma"], first["text"]))
    return reduce(lambda rest, kv: F.when(word.isin(kv[1]), kv[0]).otherwise(rest), reversed(list((markers or L.DISCOURSE).items())), _null("string"))


def blend(current: Column, previous: Column, alpha: Column | float, beta: Column | float) -> Column:
    """Renormalised mix of two distributions over the union of their labels (112)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mix = F.map_zip_with(current, previous, lambda k, a, b: F.lit(alpha) * zero(a) + beta * zero(b))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)
    both = X.let(mix, lambda m: F.struct(m.alias("m"), total(m).alias("t")))
    return _scaled(both, current)


def _scaled(both: Column, current: Column) -> Column:
    scaled = X.let(both, lambda v: F.when(v["t"] > 0, F.transform_values(v["m"], lambda k, x: x / v["t"])))
    return F.coalesce(scaled, current)


def adjust(cur: Column, prev: Column, category: Column, alpha: float = 0.7, beta: float = 0.3, skip: float = 0.75, smooth: float = 0.5) -> Column:
    """Smoothed emotion of a sentence given that of the one before, which may be null (113)."""
    b = F.when(category == "contrast", 0.0).when(category == "consequence", min(1 - alpha, beta * 1.5)).otherwise(beta)
    dist = lambda e: F.when(F.size(e["distribution"]) > 0, e["distribution"]).otherwise(F.create_map(e["label"], F.lit(1.0)))
    still = (cur["confidence"] >= skip) | prev.isNull() | (b <= 0)
    mixed = F.when(~still, F.get(ranked(blend(dist(cur), dist(prev), alpha, b)), F.lit(0)))
    facts = F.struct(
        cur.alias("cur"), prev.alias("prev"), F.coalesce(mixed["k"], cur["label"]).alias("label"), F.coalesce(F.round(-mixed["v"], 3), cur["confidence"]).alias("sure"),
        F.coalesce((cur["confidence"] < skip) & (cur["confidence"] < smooth) & (prev["intensity"] != cur["intensity"]), F.lit(False)).alias("level"), F.concat(F.lit("discourse_marker:"), category).alias("marker"),
    )

    def close(v: Column) -> Column:
        cur, new_label = v["cur"], v["label"] != v["cur"]["label"]
        changed = new_label | v["level"]
        reason = F.concat_ws(";", F.when(changed, v["marker"]), F.when(new_label, F.concat(F.lit("context_blend:"), cur["label"], F.lit("->"), v["label"])), F.when(v["level"], "intensity_smoothed"))
        return F.when(
            cur.isNotNull(),
            F.struct(
                v["label"].alias("label"), v["sure"].alias("confidence"), cur["valence"].alias("valence"), cur["arousal"].alias("arousal"), F.when(v["level"], v["prev"]["intensity"]).otherwise(cur["intensity"]).alias("intensity"),
                changed.alias("changed"), F.when(changed, reason).alias("reason"), F.lit("rostire_context_1").alias("producer"),
            ).cast(S.struct(S.CONTEXT)),
        )

    return X.let(facts, close)


def context(df: DataFrame, config: dict) -> DataFrame:
    """Smoothing against the local emotion of the sentence before, anew in each paragraph (110 to 114)."""
    k = {n: config[f"context_{n}"] for n in ("alpha", "beta", "skip", "smooth") if f"context_{n}" in config}
    facts = F.struct("sentences", X.paragraph_starts(F.col("original_text")).alias("starts"))

    def one(v: Column, s: Column, i: Column) -> Column:
        fresh = (i == 0) | F.array_contains(v["starts"], i)
        prev = F.when(~fresh, F.get(v["sentences"], i - 1)["emotion"])
        return s.withField("context_emotion", adjust(s["emotion"], prev, discourse(s["tokens"], config.get("discourse_markers")), **k))

    return df.withColumn("sentences", X.let(facts, lambda v: F.transform(v["sentences"], lambda s, i: one(v, s, i))))


def default_registry() -> Registry:
    """All layers with what they provide, require, and read if present."""
    f = frozenset
    return Registry([
        Layer("cleaner", f({"clean"}), f(), clean),
        Layer("segmenter", f({"sentences"}), f({"clean"}), sentences),
        Layer("normalizer", f({"normalized"}), f({"clean", "sentences"}), normalized),
        Layer("linguistic", f({"tokens", "linguistic"}), f({"normalized"}), tokens),
        Layer("phonemizer", f({"phonemes"}), f({"tokens"}), phonemes),
        Layer("stress", f({"syllables", "lexical_stress"}), f({"phonemes"}), stress),
        Layer("emotion", f({"emotion", "intensity"}), f({"linguistic"}), emotion),
        Layer("focus", f({"focus"}), f({"linguistic"}), focus),
        Layer("prosody", f({"prosody"}), f({"linguistic"}), prosody, after=f({"emotion", "focus"})),
        Layer("interjections", f({"interjections"}), f({"emotion"}), interjections),
        Layer("context", f({"context"}), f({"emotion"}), context),
    ])
