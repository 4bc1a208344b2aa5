"""Queries whose rules are stated as literal cases with their results, and round trips of the formats."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audio, corpus, layers, metrics, serializers
from ..operators.pipeline import load_config, process, requested
from ..runtime import cut, shared_dir, table
from ..sources import readers, sinks
from .catalog import _CLEAN, _ev, query


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def golden(name: str, doc: str, cases: list[tuple[str, str]], fn: Callable[[DataFrame], DataFrame]) -> None:
    """A query of literal cases: ``fn`` gives ``n, got`` for the column ``given`` of each case ``n``; the SQL holds the results."""
    values = ", ".join(f"({n}, {_quoted(given)}, {_quoted(want)})" for n, (given, want) in enumerate(cases))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = spark.createDataFrame([(n, given) for n, (given, _) in enumerate(cases)], "n int, given string")
        return rows.join(fn(rows).select(F.col("n").cast("int").alias("n"), "got"), "n").select("n", "given", "got")

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT * FROM (VALUES {values}) t(n, given, got)")(run)


def _documents(df: DataFrame, profile: str | dict, **kw) -> DataFrame:
    return process(df, profile, text="given", id_col="n", **kw).withColumnRenamed("id", "n")


def _each(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.select("n", F.coalesce(fn(F.col("given")).cast("string"), F.lit("none")).alias("got"))


# The annotation rules' own examples.
golden(
    "spoken_forms", "Spoken forms of sentences through the whole cascade (49 to 58).",
    [
        ("Dr. Popescu a trimis 25 kg pe 12.07.2026, la ora 14:30.", "Doctor Popescu a trimis douăzeci și cinci de kilograme pe doisprezece iulie două mii douăzeci și șase, la ora paisprezece și treizeci de minute."),
        ("Am 25 de mere.", "Am douăzeci și cinci de mere."), ("Am 3 mere.", "Am trei mere."), ("Anul 2026.", "Anul două mii douăzeci și șase."),
        ("Ne vedem pe 1.01.2026.", "Ne vedem pe întâi ianuarie două mii douăzeci și șase."), ("Vino la ora 09:00.", "Vino la ora nouă fix."), ("Reducere de 25%.", "Reducere de douăzeci și cinci la sută."),
        ("Costă 25 lei.", "Costă douăzeci și cinci de lei."), ("Costă 10€.", "Costă zece euro."), ("Am cumpărat 2 kg.", "Am cumpărat două kilograme."), ("A durat 1 h.", "A durat o oră."), ("A durat 2 h.", "A durat două ore."),
        ("Dr. Ionescu, vezi nr. 5.", "Doctor Ionescu, vezi numărul cinci."), ("Ludovic al XIV-lea a domnit mult.", "Ludovic al paisprezecelea a domnit mult."), ("Elisabeta a II-a a domnit mult.", "Elisabeta a doua a domnit mult."),
        ("Rezultatul este 3,14.", "Rezultatul este trei virgulă paisprezece."), ("Nimic aici.", "Nimic aici."), ("", ""),
    ],
    lambda df: _documents(df, "normalize_only").select("n", F.col("normalized_text").alias("got")),
)
golden(
    "edits_of_spoken_forms", "Operation, original and replacement of each edit of the cascade (37, 49 to 58).",
    [
        ("25 kg", "unit:25 kg>douăzeci și cinci de kilograme@0-5"), ("Vezi nr. 5.", "integer:5>cinci@9-10 abbreviation:nr.>numărul@5-8"), ("La 14:30.", "time:14:30>paisprezece și treizeci de minute@3-8"), ("Da.", ""),
        ("al X-lea, 3,5 și 7%", "roman_ordinal:al X-lea>al zecelea@0-8 percentage:7%>șapte la sută@19-21 decimal:3,5>trei virgulă cinci@12-15"),
    ],
    lambda df: _documents(df, "normalize_only").select("n", F.array_join(F.transform("trace", lambda t: F.format_string("%s:%s>%s@%d-%d", t["operation"], t["original"], t["replacement"], t["start"], t["end"])), " ").alias("got")),
)
golden(
    "cut_sentences", "Where sentences are cut, and where not (43 to 45).",
    [
        ("Nu pot să cred! Am reușit.", "Nu pot să cred!|Am reușit."), ("Dr. Popescu a venit. A plecat repede.", "Dr. Popescu a venit.|A plecat repede."),
        ("Ne-am întâlnit pe 12.07.2026. A fost o zi bună.", "Ne-am întâlnit pe 12.07.2026.|A fost o zi bună."), ("Rezultatul este 3.14. Următorul pas urmează.", "Rezultatul este 3.14.|Următorul pas urmează."),
        ("Nu știu... poate mâine.", "Nu știu...|poate mâine."), ("", ""), ("Scrie la ion.pop@x.ro. Apoi vino.", "Scrie la ion.pop@x.ro.|Apoi vino."), ("Vezi http://a.ro/b?c=1 acum! Da.", "Vezi http://a.ro/b?c=1 acum!|Da."),
        ('"Da!" a spus. Fără semn', '"Da!"|a spus.|Fără semn'), ("Bună! Ce faci?", "Bună!|Ce faci?"),
    ],
    lambda df: df.select("n", F.array_join(F.transform(X.segment(X.clean(F.col("given"))), lambda s: s["text"]), "|").alias("got")),
)
golden(
    "syllables_of_words", "Syllables (76).",
    [("fericire", "fe-ri-ci-re"), ("reușit", "reu-șit"), ("copii", "co-pii"), ("copil", "co-pil"), ("frumoasă", "fru-moa-să"), ("important", "im-por-tant"), ("cred", "cred"), ("aplic", "a-plic"), ("ochi", "o-chi"), ("", ""), ("xyz", "xyz")],
    lambda df: _each(df, lambda w: F.array_join(layers.syllabify(w), "-")),
)
golden(
    "stressed_groups_of_words", "Which vowel group of a pronunciation carries stress (77).",
    [("reuʃˈit", "1"), ("kˈopiɪ", "0"), ("fˌeɾitʃˈiɾe", "2"), ("krˈed", "0"), ("kopˈil", "1"), ("frumˈɔasə", "1"), ("ˌimportˈant", "2"), ("kred", "none")],
    lambda df: _each(df, layers.stressed_group),
)


def _marked_tokens(given: Column) -> Column:
    """Tokens of ``text/UPOS/flag`` items; flags are ``root``, ``mark``, ``neg`` and ``hot``."""

    def one(w: Column) -> Column:
        part = lambda i: F.get(F.split(w, "/"), F.lit(i))
        flag = part(2)
        own = {
            "text": part(0), "start": F.lit(0), "end": F.length(part(0)), "lemma": F.lower(part(0)), "upos": part(1), "deprel": F.when(flag.isin("root", "mark"), flag), "is_focus": flag == "hot", "focus_score": F.when(flag == "hot", 1.0),
            "feats": F.when(flag == "neg", F.create_map(F.lit("Polarity"), F.lit("Neg"))).otherwise(F.expr("cast(map() as map<string,string>)")),
        }
        return layers.token_struct(own)

    return F.transform(F.split(given, " "), one)


def _focus_notes(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(t["focus_score"].isNull(), "-").otherwise(F.concat(t["focus_score"].cast("string"), F.lit(":"), F.array_join(t["focus_rules"], "+")))), " ")


golden(
    "focus_of_tokens", "Emphasis of tokens by every rule (88 to 95).",
    [
        ("FRUMOS/ADJ", "0.9:all_caps"), ("masă/NOUN", "0.0:"), ("foarte/ADV frumos/ADJ", "0.0: 0.6:intensifier_target"), ("extrem/ADV de/ADP greu/ADJ", "0.0: 0.0: 0.6:intensifier_target"), ("bine/ADV bine/ADV", "0.4:repetition 0.4:repetition"),
        ("și/CCONJ și/CCONJ", "0.0: 0.0:"), ("fericit/ADJ", "0.3:emotion_bearing"), ("este/AUX este/AUX", "0.0: 0.0:"), ("Nu/PART/neg e/AUX roșu/ADJ/root ,/PUNCT ci/CCONJ albastru/ADJ", "0.0: 0.0: 0.0:contrastive_negation_suppressed - 0.0: 1.0:emotion_bearing+corrective_construction"),
        ("aleargă/VERB/root", "0.15:main_predicate"), ("este/AUX/root", "0.0:"), ("./PUNCT", "-"),
    ],
    lambda df: _each(df, lambda g: _focus_notes(layers.focus_tokens(_marked_tokens(g), {"foarte": 1.6, "extrem de": 1.9}, ["fericit", "trist", "albastru"]))),
)
golden(
    "focus_by_user", "Words the user wants emphasised win over all rules (96).", [("masă/NOUN", "1.0:user_override"), ("și/CCONJ masă/NOUN", "0.0: 1.0:user_override"), ("scaun/NOUN", "0.0:")],
    lambda df: _each(df, lambda g: _focus_notes(layers.focus_tokens(_marked_tokens(g), {}, [], ["masă"]))),
)


def _prosody_notes(df: DataFrame, **config) -> DataFrame:
    one = F.struct(F.lit("x").alias("text"), _marked_tokens(F.col("given")).alias("tokens"), F.lit("declarative").alias("sentence_type"))
    s = F.get("sentences", F.lit(0))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    notes = F.transform(s["tokens"], lambda t: F.concat_ws("/", dash(t["pause_after_ms"]), dash(t["pause_before_ms"]), dash(t["local_relative_pitch"]), F.array_join(t["prosody_rules"], "+")))
    p = s["prosody"]
    out = layers.prosody(df.select("n", F.array(one).alias("sentences")), config)
    return out.select("n", F.concat(F.array_join(notes, " "), F.lit(" = "), p["speaking_rate"].cast("string"), F.lit(" "), p["terminal_contour"], F.lit(" "), p["pause_after_ms"].cast("string"), F.lit(" "), F.array_join(p["rules"], "+")).alias("got"))


golden(
    "prosody_of_tokens", "Pauses, long sentences, clause boundaries, boosts of emphasis and the sentence's own pause (97 to 103).",
    [
        ("masă/NOUN ,/PUNCT", "-/-/-/ 150/-/-/punctuation_, = 1.0 falling 150 no_emotion_data+terminal_contour_from_declarative"), ("că/SCONJ/mark plouă/VERB", "-/100/-/clause_boundary -/-/-/ = 1.0 falling 0 no_emotion_data+terminal_contour_from_declarative"),
        ("vino/VERB/hot ./PUNCT", "-/-/1.15/local_focus_boost 400/-/-/punctuation_. = 1.0 falling 400 no_emotion_data+terminal_contour_from_declarative"),
        (" ".join(["w/NOUN"] * 16 + ["./PUNCT"]), " ".join(["-/-/-/"] * 16 + ["500/-/-/punctuation_.+long_sentence"]) + " = 1.0 falling 500 no_emotion_data+terminal_contour_from_declarative"),
        (" ".join(["w/NOUN"] * 15 + [".../PUNCT"]), " ".join(["-/-/-/"] * 15 + ["600/-/-/punctuation_…"]) + " = 1.0 falling 600 no_emotion_data+terminal_contour_from_declarative"),
    ],
    _prosody_notes,
)
golden(
    "prosody_by_user", "Values the user sets win one by one (104).",
    [("da/INTJ ./PUNCT", "-/-/-/ 400/-/-/punctuation_. = 0.9 falling 700 no_emotion_data+terminal_contour_from_declarative+user_override_speaking_rate+user_override_pause_after_ms")],
    lambda df: _prosody_notes(df, prosody_overrides={"0": {"speaking_rate": 0.9, "pause_after_ms": 700}}),
)
_HAPPY = {"include": ["interjections"], "predictor": lambda t: F.create_map(F.lit("happy"), F.when(F.contains(t, F.lit("poate")), 0.5).otherwise(0.9), F.lit("neutral"), F.when(F.contains(t, F.lit("poate")), 0.5).otherwise(0.1))}
golden(
    "styled_interjections", "Style of a document and interjections put into it behind their gates (105 to 109).",
    [("Sunt fericit.", "conversational|Bravo, sunt fericit."), ("Conform legii, plata este datorată.", "formal|"), ("Bravo, sunt fericit.", "conversational|"), ("Sunt poate fericit.", "conversational|"), ("", "conversational|")],
    lambda df: _documents(df, _HAPPY, interjection_mode="insert").select("n", F.concat("document_style", F.lit("|"), F.array_join(F.transform("sentences", lambda s: F.coalesce(s["text_with_interjections"], F.lit(""))), " ")).alias("got")),
)


def _by_sentence(t: Column) -> Column:
    spread = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    flat = spread({"happy": 0.17, "sad": 0.17, "angry": 0.17, "fear": 0.17, "surprise": 0.16, "neutral": 0.16})
    return F.when(t == "Unu.", spread({"happy": 1.0})).when(t == "Trei.", spread({"sad": 0.30, "happy": 0.25, "angry": 0.15, "fear": 0.15, "surprise": 0.15})).otherwise(flat)


golden(
    "smoothed_emotions", "Emotion of a sentence given that of the one before, anew in each paragraph and off the local one (110, 112 to 114).",
    [("Unu. Doi. Trei.", "happy/happy unspecified/happy unspecified/sad"), ("Unu.\n\nDoi.", "happy/happy unspecified/unspecified"), ("Unu. Dar doi.", "happy/happy unspecified/unspecified"), ("Doi.", "unspecified/unspecified")],
    lambda df: _documents(df, {"include": ["context"], "predictor": _by_sentence}).select("n", F.array_join(F.transform("sentences", lambda s: F.concat(s["emotion"]["label"], F.lit("/"), s["context_emotion"]["label"])), " ").alias("got")),
)
golden(
    "paragraphs", "Sentence indices at which paragraphs start (110).", [("Prima propoziție.\n\nA doua. A treia.", "0,1"), ("Una. Doua!\n \nTrei", "0,2"), ("Una.", "0")],
    lambda df: _each(df, lambda g: F.array_join(X.paragraph_starts(g), ",")),
)
golden(
    "labels_of_a_classifier", "Our labels from a classifier's own (82).",
    [("joy=0.5 sadness=0.3 love=0.1 neutral=0.1", "happy:0.6 angry:0.0 sad:0.3 fear:0.0 surprise:0.0 neutral:0.1"), ("anger=0.2 disgust=0.2 fear=0.1 other=0.5", "happy:0.0 angry:0.8 sad:0.0 fear:0.2 surprise:0.0 neutral:0.0"), ("other=1.0", "happy:0.0 angry:0.0 sad:0.0 fear:0.0 surprise:0.0 neutral:0.0")],
    lambda df: _each(df, lambda g: F.array_join(F.transform(F.map_entries(layers.aggregate_labels(F.transform_values(F.str_to_map(g, F.lit(" "), F.lit("=")), lambda k, v: v.cast("double")))), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], 3).cast("string"))), " ")),
)
golden(
    "emotion_of_sentences", "Label, confidence, valence, arousal and intensity of sentences by their words and marks (81, 83 to 87).",
    [("MERGEM acasă.", "neutral|1.0|0.5|0.4|medium"), ("Vii azi?", "neutral|1.0|0.5|0.4|low"), ("Vii azi!!", "neutral|1.0|0.5|0.4|medium")],
    lambda df: _documents(df, {"include": ["emotion"]}).select("n", F.array_join(F.transform("sentences", lambda s: F.concat_ws("|", *[s["emotion"][k].cast("string") for k in ("label", "confidence", "valence", "arousal", "intensity")])), " ").alias("got")),
)
golden(
    "readable_forms", "Annotated text, an SSML-like form and control tokens (115, 116, 118, 120).",
    [
        ("MERGEM acasă.", '[FOCUS] MERGEM acasă . [emotion=neutral, intensity=medium; pause=400ms]¦<speak>~  <s type="declarative"><prosody rate="0.96" pitch="0.96"><emphasis>MERGEM</emphasis> acasă .</prosody></s><break time="400ms"/>~</speak>¦[SENT_DECLARATIVE]~[EMO_NEUTRAL]~[INT_MEDIUM]~[RATE_0.95]~[PITCH_0.95]~[ENERGY_0.95]~[FOCUS] MERGEM acasă .~[BREAK_400]~'),
        ("Vii azi?", 'Vii azi ? [emotion=neutral, intensity=low; pause=400ms]¦<speak>~  <s type="interrogative"><prosody rate="0.96" pitch="0.96">Vii azi ?</prosody></s><break time="400ms"/>~</speak>¦[SENT_INTERROGATIVE]~[EMO_NEUTRAL]~[INT_LOW]~[RATE_0.95]~[PITCH_0.95]~[ENERGY_0.95]~Vii azi ?~[BREAK_400]~'),
    ],
    lambda df: _documents(df, "expressive", serialize=True).select("n", F.translate(F.concat_ws("¦", serializers.annotated_text(F.col("sentences")), serializers.ssml_like(F.col("sentences")), "tts_token_text"), "\n", "~").alias("got")),
)
golden(
    "stress_of_words", "Syllables and stress by pronunciation, rule and override (71, 78, 79).",
    [("Important.", "Im-por-tant:2:fallback"), ("Frumoasă.", "Fru-moa-să:1:fallback"), ("Copil.", "Co-pil:1:predicted"), ("Copii.", "Co-pii:0:lexicon")],
    lambda df: _documents(df, {"include": ["lexical_stress"], "phonemizer": lambda w: F.when(F.lower(w) == "copil", "kopˈil"), "stresses": {"copii": 0}}).select(
        "n", F.get(F.flatten(F.transform("sentences", lambda s: F.transform(s["tokens"], lambda t: F.concat_ws(":", F.array_join(t["syllables"], "-"), t["stressed_syllable_index"].cast("string"), t["stress_provenance"])))), F.lit(0)).alias("got")),
)


def _layers_of(spec: str) -> str:
    given = json.loads(spec)
    try:
        return " ".join(requested(load_config(given["config"]), given.get("include"), given.get("exclude")))
    except ValueError as e:
        return f"error: {e}"


golden(
    "layers_of_requests", "Layers a config and a call ask for (3 to 5).",
    [
        ('{"config": "default"}', "clean normalized sentences"), ('{"config": {"processing": {"include": ["tokens", "focus"], "exclude": ["focus"]}}}', "tokens"), ('{"config": {"include": ["tokens"]}, "include": ["emotion", "focus"]}', "emotion focus"),
        ('{"config": {"include": ["tokens", "focus"]}, "exclude": ["focus"]}', "tokens"), ('{"config": {"include": ["focus"]}, "exclude": ["focus"]}', "error: no layer requested"),
    ],
    lambda df: df.sparkSession.createDataFrame([(r["n"], _layers_of(r["given"])) for r in df.collect()], "n int, got string"),  # the cases above
)
golden(
    "adoption", "Whether a classifier with this gain and Brier score is adopted (152).", [("0.50 0.40 0.40", "true"), ("0.42 0.40 0.10", "false"), ("0.90 0.40 0.60", "false")],
    lambda df: df.sparkSession.createDataFrame([(r["n"], str(metrics.adopt(*map(float, r["given"].split()))[0]).lower()) for r in df.collect()], "n int, got string"),  # the cases above
)

golden(
    "addresses_read_out", "Addresses and listed acronyms in words.",
    [
        ("Scrie la ion.pop@x-y.ro.", "Scrie la ion punct pop arond x liniuță y punct ro."), ("Vezi https://a.ro/b?c=1!", "Vezi a punct ro slash b semnul întrebării c egal 1!"), ("La www.exemplu.ro, acum.", "La www punct exemplu punct ro, acum."),
        ("ONU și NATO", "Organizația Națiunilor Unite și NATO"), ("Fără nimic.", "Fără nimic."),
    ],
    lambda df: _each(df, lambda g: X.expand_addresses(g, {"ONU": "Organizația Națiunilor Unite"})),
)


# Whole tables through formats and back


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT id, text, source, emotion.value AS emotion FROM evaluation_example")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows written as JSON lines and read under their schema (21, 34)."""
    path = _place(spark, "jsonl")
    sinks.write_json_lines(table(spark, sf, "evaluation_example").select("id", "text", "source", "emotion"), path)
    return readers.read_jsonl(spark, path).select("id", "text", "source", F.col("emotion.value").alias("emotion")).distinct()


@query("SELECT DISTINCT id, text_register, len(sentences) AS n FROM context_paragraph")
def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Context paragraphs as files of one JSON array each, and read back (22)."""
    path = _place(spark, "json")
    rows = table(spark, sf, "context_paragraph").withColumn("part", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(table(spark, sf, "context_paragraph").count() // 500))))
    rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("id", "sentences", "text_register"))).alias("value")).select("value").write.text(path)  # about 500 rows a file
    return readers.read_json_array(spark, path, readers.CONTEXT).select("id", "text_register", F.size("sentences").cast("long").alias("n")).distinct()


_LINE = "trim(translate(text, chr(10) || chr(13) || '|', '   '), ' ')"


@query(f"SELECT DISTINCT 'wavs/' || utt_id || '.wav' AS rel_wav, {_LINE} AS text, 'mara' AS speaker FROM utterance WHERE text IS NOT NULL AND lower(trim(corpus)) = 'mara'")
def flat_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus of one metadata file of ``id|text`` lines (10 to 12)."""
    path = _place(spark, "metadata")
    rows = table(spark, sf, "utterance").where("text IS NOT NULL AND lower(trim(corpus)) = 'mara'")
    rows.select(F.concat("utt_id", F.lit("|"), F.translate("text", "\n\r|", "   ")).alias("value")).distinct().write.text(path)
    return readers.ljspeech(spark, path, speaker="mara").distinct()


@query("SELECT DISTINCT 'clips/' || trim(rel_wav) AS rel_wav, trim(translate(text, chr(9) || chr(10) || chr(13), '   '), ' ') AS text, 'cv_' || left(coalesce(nullif(trim(speaker), ''), 'unknown'), 12) AS speaker FROM utterance WHERE trim(translate(text, chr(9) || chr(10) || chr(13), '   '), ' ') <> ''")
def crowd_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus of one table of client, path and sentence, written and scanned (16)."""
    path = _place(spark, "tsv")
    rows = table(spark, sf, "utterance").select(F.col("speaker").alias("client_id"), F.col("rel_wav").alias("path"), F.translate("text", "\t\n\r", "   ").alias("sentence")).distinct()
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.common_voice(spark, path).distinct()


@query("SELECT DISTINCT rel_wav AS wav, coalesce(speaker, '') AS speaker FROM utterance")
def synthesized_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table of synthesized clips, written and read back (35)."""
    path = _place(spark, "synthesized")
    rows = table(spark, sf, "utterance").select(F.col("rel_wav").alias("wav"), F.coalesce("speaker", F.lit("")).alias("speaker"), F.col("rel_wav").alias("ref_wav"), F.translate("text", "\n\r", "  ").alias("text"))
    sinks.write_synthesized(rows, path)
    back = spark.read.option("sep", "|").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return back.select("wav", F.coalesce("speaker", F.lit("")).alias("speaker")).distinct()


@query("SELECT DISTINCT id, to_json({'id': id, 'source': source, 'boundaries': sentence_boundaries}) AS json FROM evaluation_example")
def canonical_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON that keeps its null fields (31)."""
    return table(spark, sf, "evaluation_example").select("id", serializers.canonical_json(F.struct("id", "source", F.col("sentence_boundaries").alias("boundaries"))).alias("json")).distinct()


@query("SELECT DISTINCT utt_id, round((length(text) * 10) / 8000.0, 6) AS seconds FROM utterance WHERE length(text) > 0")
def clip_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of clips by their headers (29)."""
    rows = table(spark, sf, "utterance").where("length(text) > 0").select("utt_id", (F.length("text") * 10).alias("n")).distinct()
    return rows.select("utt_id", F.round(audio.wav_seconds(audio.silent_wav(F.col("n"), F.lit(8000))), 6).alias("seconds"))


@query(f"SELECT count(*) AS n, count(*) FILTER (c <> '') AS cut, count(*) FILTER (c IS NULL) AS empty, 0 AS failed FROM (SELECT id, {_CLEAN.replace('{c}', 'text')} AS c FROM (SELECT DISTINCT id, text FROM evaluation_example))")
def assembled_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of the evaluation texts: those with sentences, those without text, and those that failed (6, 7)."""
    out = process(_ev(spark, sf, "text"), "default", id_col="id")
    return out.agg(F.count("*").alias("n"), F.count_if(F.size("sentences") > 0).alias("cut"), F.count_if(F.col("clean_text").isNull()).alias("empty"), F.count_if(F.size("errors") > 0).cast("int").alias("failed"))


@query("SELECT vec_id, CAST(-23.0 AS DOUBLE) AS level_db, round(list_max([abs(x) for x in embedding]), 3) > 0 AS sounds FROM embeddings WHERE list_max([abs(x) for x in embedding]) > 0.001")
def levelled_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as a signal brought to a level (156)."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("float")).alias("x")).where(F.array_max(F.transform("x", lambda v: F.abs(v))) > 0.001)
    return rows.select("vec_id", F.round(audio.rms_db(audio.levelled(F.col("x"))), 1).alias("level_db"), (F.round(F.array_max(F.transform("x", lambda v: F.abs(v))).cast("double"), 3) > 0).alias("sounds"))


@query("SELECT vec_id, round(least(0.97, 9 * list_max([abs(CAST(x AS DOUBLE)) for x in embedding])), 3) AS peak FROM embeddings")
def limited_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding, made loud, as a signal whose peaks are limited (157)."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v * 9).cast("float")).alias("x"))
    return rows.select("vec_id", F.round(F.array_max(F.transform(audio.limited(F.col("x")), lambda v: F.abs(v))).cast("double"), 3).alias("peak"))


@query("""SELECT string_agg(line, chr(10) ORDER BY k, line) || chr(10) AS report FROM (SELECT 0 AS k, '# Corpora' || chr(10) || chr(10) || '| corpus | n |' || chr(10) || '|---|---|' AS line
    UNION ALL SELECT 1, '| ' || coalesce(corpus, '') || ' | ' || n || ' |' FROM (SELECT corpus, count(*) AS n FROM utterance GROUP BY corpus))""")
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """A small aggregate as a Markdown report (36)."""
    counts = table(spark, sf, "utterance").groupBy("corpus").agg(F.count("*").alias("n")).orderBy("corpus", "n")
    return spark.createDataFrame([(sinks.markdown_table(counts, "Corpora"),)], "report string")  # a row for each corpus


@query("SELECT vec_id, CAST(len(embedding) + 20 AS BIGINT) AS samples, CAST(2 * len(embedding) AS BIGINT) AS twice, round(list_sum([CAST(CAST(x AS FLOAT) AS DOUBLE) for x in embedding]), 2) + CAST(0 AS DOUBLE) AS total FROM embeddings")
def joined_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as two signals joined with a pause of 20 samples, and at twice the rate."""
    x = F.transform("embedding", lambda v: v.cast("float"))
    half = (F.size("embedding") / 2).cast("int")
    halves = F.array(F.slice(x, F.lit(1), half), F.slice(x, half + 1, F.size("embedding")))
    rows = table(spark, sf, "embeddings").select("vec_id", audio.joined_signals(halves, 1000, F.array(F.lit(20))).alias("y"), audio.resampled_signals(x, 8000, 16000).alias("z"))
    return rows.select("vec_id", F.size("y").cast("long").alias("samples"), F.size("z").cast("long").alias("twice"), (F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 2) + F.lit(0.0)).alias("total"))


@query("SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM (SELECT lower(trim(text_register)) AS label, count(*) AS n FROM (SELECT DISTINCT id, text_register FROM evaluation_example WHERE text_register IS NOT NULL) GROUP BY 1)")
def register_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights under which all registers are drawn equally often."""
    rows = _ev(spark, sf, "text_register").where("text_register IS NOT NULL").select(F.lower(F.trim("text_register")).alias("label"))
    return corpus.sampling_weights(rows, "label").select("label", "n", F.round("weight", 9).alias("weight"))


@query("SELECT speaker, row_number() OVER (ORDER BY encode(speaker)) - 1 AS idx FROM (SELECT DISTINCT lower(trim(speaker)) AS speaker FROM utterance WHERE speaker IS NOT NULL)")
def speaker_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A number for each speaker, in their order."""
    return corpus.id_map(table(spark, sf, "utterance").select(F.lower(F.trim("speaker")).alias("speaker")), "speaker")
