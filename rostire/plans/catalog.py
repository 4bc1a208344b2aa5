"""All queries of the core over whole tables, with the SQL that states them where SQL can."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as X
from ..operators import audio, corpus, layers, lexicon, metrics, serializers
from ..operators.pipeline import PROFILES, Pipeline, process
from ..runtime import cut, shared_dir, shuffle_width, table
from ..sources import readers, sinks
from ..streaming import documents as streams
from . import sqlwords as W

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """All queries by name."""
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    """SQL by query name."""
    return dict(_SQL)


def _ev(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Named columns of the evaluation rows, each delivered id once."""
    return table(spark, sf, "evaluation_example").select("id", *[c for c in cols if c != "id"]).distinct()


def _once(df: DataFrame, key: str) -> DataFrame:
    """Each delivered key once, in one shuffle as wide as the session asks for.

    The width is explicit, because rows that are small now become heavy in the layers.
    """
    return df.repartition(shuffle_width(df.sparkSession), key).dropDuplicates([key])


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if a scan of one small file would leave most of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLEAN = "trim(regexp_replace(translate(translate(nfc_normalize({c}), 'şŞţŢ', 'șȘțȚ'), '“”„«»‘’ʼ', '\"\"\"\"\"'''''''), '" + _SPACES + "+', ' ', 'g'))"


# Orchestration


@query("SELECT * FROM (VALUES ('default', 0, 'cleaner'), ('default', 1, 'segmenter'), ('default', 2, 'normalizer'), ('normalize_only', 0, 'cleaner'), ('normalize_only', 1, 'segmenter'), ('normalize_only', 2, 'normalizer'), ('pronunciation', 0, 'cleaner'), ('pronunciation', 1, 'segmenter'), ('pronunciation', 2, 'normalizer'), ('pronunciation', 3, 'linguistic'), ('pronunciation', 4, 'phonemizer'), ('pronunciation', 5, 'stress'), ('expressive', 0, 'cleaner'), ('expressive', 1, 'segmenter'), ('expressive', 2, 'normalizer'), ('expressive', 3, 'linguistic'), ('expressive', 4, 'emotion'), ('expressive', 5, 'focus'), ('expressive', 6, 'prosody')) t(profile, place, layer)")
def layer_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Order of the layers of each profile (1 to 5)."""
    reg = layers.default_registry()
    rows = [(p, i, x.name) for p, c in PROFILES.items() for i, x in enumerate(reg.resolve(c["include"]))]
    return spark.createDataFrame(rows, "profile string, place int, layer string")


@query()
def sentence_type_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of all documents by label and punctuation type: clean, segment, explode, count (flagship)."""
    docs = _spread(table(spark, sf, "documents").select("lang", "text")).select("lang", X.clean(F.col("text")).alias("c"))
    each = docs.select(F.lower(F.trim("lang")).alias("lang"), F.explode(X.segment(F.col("c"))).alias("s"))
    return each.select("lang", X.punctuation_type(F.col("s.text")).alias("sentence_type")).groupBy("lang", "sentence_type").agg(F.count("*").alias("n"))


@query()
def annotate_expressive(spark: SparkSession, sf: str) -> DataFrame:
    """All utterances through the expressive profile (6, 7), as canonical JSON of prosody and focus counts."""
    out = process(_once(table(spark, sf, "utterance").select("utt_id", "text"), "utt_id"), "expressive", id_col="utt_id")
    return out.select("id", F.size("sentences").alias("sentences"), F.to_json(F.transform("sentences", lambda s: s["prosody"])).alias("prosody"), F.aggregate("sentences", F.lit(0), lambda a, s: a + F.size(F.filter(s["tokens"], lambda t: F.coalesce(t["is_focus"], F.lit(False))))).alias("focused"))


@query()
def annotate_pronunciation(spark: SparkSession, sf: str) -> DataFrame:
    """All utterances through the pronunciation profile (71 to 79)."""
    out = process(_once(table(spark, sf, "utterance").select("utt_id", "text"), "utt_id"), "pronunciation", id_col="utt_id")
    stressed = F.flatten(F.transform("sentences", lambda s: F.transform(F.filter(s["tokens"], lambda t: t["upos"] != "PUNCT"), lambda t: F.concat(F.array_join(t["syllables"], "-"), F.lit(":"), t["stressed_syllable_index"].cast("string")))))
    return out.select("id", "phoneme_text", F.array_join(stressed, " ").alias("syllables"))


@query()
def annotate_full(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through every layer, serialized as control tokens (66, 101 to 118)."""
    out = Pipeline({"include": ["context", "interjections", "prosody", "focus", "lexical_stress"]}).process(_spread(table(spark, sf, "documents").select("doc_id", "text")), "text", "doc_id", serialize=True)
    return out.select("id", "document_style", "tts_token_text", F.size("trace").alias("edits"))


@query()
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and checksum of a normalising run over the evaluation rows."""
    return metrics.run_summary(process(_ev(spark, sf, "text"), "normalize_only", id_col="id"))


# Clean


@query(f"SELECT DISTINCT id, {_CLEAN.replace('{c}', 'text')} AS clean_text FROM evaluation_example")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """The clean layer's text of every evaluation row (38 to 42)."""
    return _ev(spark, sf, "text").select("id", X.clean(F.col("text")).alias("clean_text"))


@query("SELECT DISTINCT utt_id, translate(text, 'şŞţŢ', 'șȘțȚ') AS text FROM utterance")
def legacy_diacritics(spark: SparkSession, sf: str) -> DataFrame:
    """Commas for cedillas in every utterance (39)."""
    return table(spark, sf, "utterance").select("utt_id", X.legacy_diacritics(F.col("text")).alias("text")).distinct()


@query("SELECT DISTINCT id, translate(text, '“”„«»‘’ʼ', '\"\"\"\"\"''''''') AS text FROM evaluation_example")
def straight_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Straight quotation marks in every evaluation row (40)."""
    return _ev(spark, sf, "text").select("id", X.straight_quotes(F.col("text")).alias("text"))


@query(f"SELECT count(*) AS n, count(*) FILTER (c <> text) AS changed, CAST(sum(length(text) - length(c)) AS BIGINT) AS saved FROM (SELECT text, trim(regexp_replace(text, '{_SPACES}+', ' ', 'g')) AS c FROM documents)")
def collapse_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What collapsing whitespace changes over all documents (41, 42)."""
    rows = table(spark, sf, "documents").select("text", F.trim(X.collapse_space(F.col("text"))).alias("c"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("c") != F.col("text")).alias("changed"), F.sum(F.length("text") - F.length("c")).cast("long").alias("saved"))


@query()
def clean_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of the clean layer, one row each (37)."""
    out = process(_ev(spark, sf, "text"), {"include": ["clean"]}, id_col="id")
    return out.select("id", F.posexplode("trace").alias("place", "t")).select("id", "place", "t.operation", "t.original", "t.replacement", "t.start", "t.end")


# Sentences


@query()
def segment_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every document with offsets into the clean text (43 to 45)."""
    docs = _spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.clean(F.col("text")).alias("c"))
    return docs.select("doc_id", F.posexplode(X.segment(F.col("c"))).alias("place", "s")).select("doc_id", "place", "s.text", "s.start", "s.end")


@query("""SELECT text_register, kind AS sentence_type, count(*) AS n FROM (
    SELECT DISTINCT id, text_register, sentences FROM context_paragraph) p, unnest(sentences) t(s), LATERAL (SELECT CASE WHEN s LIKE '%?' THEN 'interrogative' WHEN s LIKE '%!' THEN 'exclamative' ELSE 'declarative' END AS kind) k
    GROUP BY ALL""")
def punctuation_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of the sentences of context paragraphs by their last mark (46)."""
    rows = table(spark, sf, "context_paragraph").select("id", "text_register", "sentences").distinct().select("text_register", F.explode("sentences").alias("s"))
    return rows.groupBy("text_register", X.punctuation_type(F.col("s")).alias("sentence_type")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT id, g.i AS place, trim(string_split(text, ', ')[g.i]) AS t FROM (SELECT DISTINCT id, text FROM evaluation_example WHERE text IS NOT NULL) e, generate_series(1, len(string_split(text, ', '))) g(i)),
    m AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(rtrim(t), '[.!?…]$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM f)
    SELECT id, CAST(island AS BIGINT) AS island, string_agg(t, ' ' ORDER BY place) AS text, CAST(min(place) AS INT) AS first_at FROM m GROUP BY id, island""")
def fragments_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """Comma fragments of evaluation rows joined until one ends a sentence (47)."""
    rows = _ev(spark, sf, "text").where("text IS NOT NULL").select("id", F.posexplode(F.split("text", ", ")).alias("p", "t")).select("id", (F.col("p") + 1).alias("place"), F.regexp_replace("t", "^ +| +$", "").alias("t"))
    return corpus.reconstitute(rows, "t", "place", "id").select("id", "island", "text", "first_at")


@query("""WITH t AS (SELECT DISTINCT id, text AS x FROM evaluation_example), p AS (SELECT id, x, replace(replace(x, '...', ''), '…', '') AS y FROM t)
    SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['ellipsis', 'comma', 'semicolon', 'colon', 'period', 'exclamation', 'question']) AS category,
    unnest([(length(x) - length(replace(x, '...', ''))) // 3 + length(x) - length(replace(x, '…', '')), length(y) - length(replace(y, ',', '')), length(y) - length(replace(y, ';', '')), length(y) - length(replace(y, ':', '')),
    length(y) - length(replace(y, '.', '')), length(y) - length(replace(y, '!', '')), length(y) - length(replace(y, '?', ''))]) AS n FROM p) GROUP BY 1""")
def pause_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Pause marks of evaluation texts by kind (48)."""
    rows = _ev(spark, sf, "text").select(F.explode(X.pause_locations(F.col("text"))).alias("p"))
    return rows.groupBy("p.category").agg(F.count("*").alias("n"))


# Numbers and spoken forms


@query(f"SELECT DISTINCT n, {W.cardinal('n')} AS masculine, {W.cardinal('n', True)} AS feminine FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders UNION SELECT CAST(l_quantity AS BIGINT) FROM lineitem UNION SELECT CAST(p_size AS BIGINT) FROM part)")
def number_words(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of the star schema in words, in both genders (59, 60)."""
    n = lambda t, c: table(spark, sf, t).select(F.floor(F.col(c)).cast("long").alias("n"))
    rows = n("orders", "o_totalprice").union(n("lineitem", "l_quantity")).union(n("part", "p_size")).distinct()
    return rows.select("n", N.cardinal_col(F.col("n")).alias("masculine"), N.cardinal_col(F.col("n"), "feminine").alias("feminine"))


@query(f"SELECT DISTINCT n, {W.phrase('n', 'un leu', 'lei')} AS lei, {W.phrase('n', 'o oră', 'ore', True)} AS hours, {W.phrase('n', 'un kilogram', 'kilograme', True)} AS kilograms FROM (SELECT CAST(l_quantity AS BIGINT) AS n FROM lineitem UNION SELECT CAST(p_size AS BIGINT) FROM part)")
def count_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Counted nouns of each gender (61)."""
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("n")).union(table(spark, sf, "part").select(F.col("p_size").cast("long"))).distinct()
    p = lambda *a: N.count_phrase_col(F.col("n"), *a)
    return rows.select("n", p("leu", "lei").alias("lei"), p("oră", "ore", "feminine").alias("hours"), p("kilogram", "kilograme", "neuter").alias("kilograms"))


@query("""SELECT n, CASE WHEN n = 1 THEN 'primul' WHEN n < 10 THEN 'al ' || (['unulea','doilea','treilea','patrulea','cincilea','șaselea','șaptelea','optulea','nouălea'])[n]
      WHEN n < 20 THEN 'al ' || (['zece','unsprezece','doisprezece','treisprezece','paisprezece','cincisprezece','șaisprezece','șaptesprezece','optsprezece','nouăsprezece'])[n - 9] || 'lea'
      WHEN n % 10 = 0 THEN 'al ' || (['','două','trei','patru','cinci','șai','șapte','opt','nouă'])[n // 10] || 'zecilea'
      ELSE 'al ' || (['','două','trei','patru','cinci','șai','șapte','opt','nouă'])[n // 10] || 'zeci și ' || (['unulea','doilea','treilea','patrulea','cincilea','șaselea','șaptelea','optulea','nouălea'])[n % 10] END AS masculine
    FROM (SELECT DISTINCT CAST(p_size AS INT) AS n FROM part)""")
def ordinal_words(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinals (62)."""
    return table(spark, sf, "part").select(F.col("p_size").cast("int").alias("n")).distinct().select("n", N.ordinal_col(F.col("n")).alias("masculine"))


@query("""WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:al|a) ([IVXLCDM]+)-(?:lea|a)', 1)) AS roman FROM evaluation_example),
    v AS (SELECT roman, [CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END for c in string_split(roman, '')] AS d FROM r)
    SELECT roman, CAST(list_sum([CASE WHEN d[i] >= coalesce(list_max(d[i + 1:]), 0) THEN d[i] ELSE -d[i] END for i in range(1, len(d) + 1)]) AS INT) AS value FROM v""")
def roman_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the Roman ordinals in the texts (49, 50, 63)."""
    rows = table(spark, sf, "evaluation_example").select(F.explode(F.regexp_extract_all("text", F.lit("(?:al|a) ([IVXLCDM]+)-(?:lea|a)"), F.lit(1))).alias("roman")).distinct()
    return rows.select("roman", N.roman_col(F.col("roman")).alias("value"))


_H, _M = "CAST(hour(ts) AS BIGINT)", "CAST(minute(ts) AS BIGINT)"


@query(f"SELECT DISTINCT CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CASE WHEN minute(ts) = 0 THEN {W.cardinal(_H)} || ' fix' ELSE {W.cardinal(_H)} || ' și ' || {W.phrase(_M, 'un minut', 'minute', True)} END AS words FROM events")
def time_words(spark: SparkSession, sf: str) -> DataFrame:
    """Clock times of events in words (52)."""
    rows = table(spark, sf, "events").select(F.hour("ts").alias("h"), F.minute("ts").alias("m")).distinct()
    return rows.select("h", "m", N.time_col(F.col("h"), F.col("m")).alias("words"))


@query(f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, {W.date('o_orderdate')} AS words FROM orders")
def date_words(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates in words (51)."""
    rows = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return rows.select("d", N.date_col(F.dayofmonth("d"), F.month("d"), F.year("d")).alias("words"))


@query(f"""SELECT o_orderkey, 'Costă ' || {W.phrase('p', 'un leu', 'lei')} || ' pe ' || {W.date('o_orderdate')} || ', adică ' || {W.cardinal('k')} || ' la sută din ' || {W.phrase('k', 'un kilogram', 'kilograme', True)} || '.' AS normalized_text
    FROM (SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(o_orderkey AS BIGINT) % 97 AS k FROM orders)""")
def normalized_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences made of orders, through the whole cascade (51, 53 to 57)."""
    o = table(spark, sf, "orders")
    k = (F.col("o_orderkey") % 97).cast("string")
    text = F.concat(F.lit("Costă "), F.floor("o_totalprice").cast("string"), F.lit(" lei pe "), F.date_format("o_orderdate", "d.MM.yyyy"), F.lit(", adică "), k, F.lit("% din "), k, F.lit(" kg."))
    out = process(_spread(o.select("o_orderkey", text.alias("text"))), "normalize_only", id_col="o_orderkey")
    return out.select(F.col("id").cast("long").alias("o_orderkey"), "normalized_text")


@query()
def normalized_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Spoken form of every evaluation row with its number of edits and errors (49 to 58)."""
    out = process(_once(table(spark, sf, "evaluation_example").select("id", "text"), "id"), "normalize_only", id_col="id")
    return out.select("id", "normalized_text", F.size("trace").alias("edits"), F.size("errors").alias("failed"))


@query()
def normalization_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Exact match and token accuracy of spoken forms against the given ones."""
    given = _ev(spark, sf, "text", "expected_normalized_text").where("expected_normalized_text IS NOT NULL")
    out = process(given, "normalize_only", id_col="id").select("id", "normalized_text")
    return metrics.exact_match(given.join(out, "id"), "expected_normalized_text", "normalized_text")


# Tokens, pronunciation


@query("""SELECT id, feature, CAST(m[feature] AS VARCHAR) AS value FROM (SELECT id, m, unnest(map_keys(m)) AS feature FROM (SELECT id, map_from_entries([(p, CAST(length(p) AS VARCHAR)) for p in list_distinct(phenomena)]) AS m FROM (SELECT DISTINCT id, phenomena FROM evaluation_example WHERE len(phenomena) > 0)))""")
def feature_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Feature strings, made of the phenomena of the rows, as maps (67)."""
    rows = _ev(spark, sf, "phenomena").select("id", F.array_join(F.transform(F.array_distinct("phenomena"), lambda p: F.concat(p, F.lit("="), F.length(p).cast("string"))), "|").alias("feats"))
    return rows.select("id", F.explode(X.parse_feats(F.col("feats"))).alias("feature", "value"))


@query()
def token_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of all utterance tokens (64, 66, 68)."""
    toks = _once(table(spark, sf, "utterance").select("utt_id", "text"), "utt_id").select(F.explode(layers.rule_tokens(F.col("text"))).alias("t"))
    return toks.groupBy("t.upos", F.col("t.is_interjection").alias("is_interjection")).agg(F.count("*").alias("n"))


@query()
def sentence_features(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence type and negation of all utterances (69, 70)."""
    out = process(_once(table(spark, sf, "utterance").select("utt_id", "text"), "utt_id"), {"include": ["tokens"]}, id_col="utt_id")
    return out.select(F.explode("sentences").alias("s")).groupBy("s.sentence_type", "s.is_negated").agg(F.count("*").alias("n"))


@query(f"""SELECT symbol, count(*) AS n FROM (SELECT unnest(list_distinct([c for c in string_split(phonemes, '') if c <> '' and not regexp_matches(c, '{_SPACES}') and not list_contains({_list(lexicon.INVENTORY)}, c)])) AS symbol FROM (SELECT DISTINCT audio_file, phonemes FROM manifest_row)) GROUP BY 1""")
def unknown_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of manifest rows outside the inventory (74, 122)."""
    rows = table(spark, sf, "manifest_row").select("audio_file", "phonemes").distinct()
    return rows.select(F.explode(layers.unknown_symbols(F.col("phonemes"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("""SELECT c, count(*) AS n FROM (SELECT unnest(string_split(phonemes, '')) AS c FROM manifest_row) WHERE c <> '' AND NOT list_contains(string_split('.,!?;:-…"'' ', ''), c) GROUP BY 1""")
def training_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Characters a model must know (80)."""
    return corpus.training_characters(table(spark, sf, "manifest_row"))


@query()
def word_syllables(spark: SparkSession, sf: str) -> DataFrame:
    """Syllables and fallback stress of each distinct word (72, 76, 78): words first, then one row each."""
    words = table(spark, sf, "utterance").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    parts = words.withColumn("syllables", layers.syllabify(F.col("word")))
    return parts.select("word", F.array_join("syllables", "-").alias("syllables"), layers.fallback_stress(F.col("syllables"), F.col("word")).alias("stress"))


@query("""WITH w AS (SELECT DISTINCT left(phonemes, length(phonemes) // 2) AS a, substr(phonemes, length(phonemes) // 2 + 1) AS b FROM (SELECT replace(phonemes, 'ˈ', '') AS phonemes FROM manifest_row WHERE phonemes IS NOT NULL))
    SELECT a || 'ˈ' || b AS p, CASE WHEN regexp_matches(b, '[aeiouəɨɔɪʊy]') THEN CAST(len(regexp_extract_all(a, '[aeiouəɨɔɪʊy]+')) AS INT) END AS stressed FROM w""")
def stressed_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Which vowel group carries stress where the mark is moved into the middle of a pronunciation (77)."""
    plain = table(spark, sf, "manifest_row").where("phonemes IS NOT NULL").select(F.replace("phonemes", F.lit("ˈ"), F.lit("")).alias("x"))
    rows = plain.select(F.expr("concat(left(x, length(x) div 2), 'ˈ', substring(x, length(x) div 2 + 1))").alias("p")).distinct()
    return rows.select("p", layers.stressed_group(F.col("p")).alias("stressed"))


# Emotion, focus, prosody, style, context


def _distribution(c, v):
    """A made-up distribution: the given confidence for the label, the rest for two others."""
    return F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.when(v == k, c).when((F.lit(k) == "neutral"), (1 - c) * 0.6).when(F.lit(k) == "fear", (1 - c) * 0.4).otherwise(0.0)) for k in lexicon.LABELS])), lambda k, p: p > 0)


_EMO = "SELECT DISTINCT id, lower(trim(emotion.value)) AS v, emotion.confidence AS c FROM evaluation_example WHERE emotion.confidence IS NOT NULL AND lower(trim(emotion.value)) IN ('happy', 'angry', 'sad', 'surprise')"


@query(f"""SELECT id, CASE WHEN top = second OR top < 0.4 THEN 'unspecified' WHEN top = c THEN v ELSE 'neutral' END AS label, round(top, 6) AS confidence, CASE WHEN second >= 0.5 * top THEN CASE WHEN second = c THEN v WHEN second = n THEN 'neutral' ELSE 'fear' END END AS secondary,
    round((c * va + n * 0.5 + f * 0.2) / (c + n + f), 6) AS valence, round((c * ar + n * 0.4 + f * 0.75) / (c + n + f), 6) AS arousal
    FROM (SELECT *, greatest(c, n) AS top, CASE WHEN c >= n THEN n WHEN c >= f THEN c ELSE f END AS second, CASE v WHEN 'happy' THEN 0.85 WHEN 'angry' THEN 0.15 WHEN 'sad' THEN 0.15 ELSE 0.6 END AS va, CASE v WHEN 'happy' THEN 0.65 WHEN 'angry' THEN 0.8 WHEN 'sad' THEN 0.3 ELSE 0.75 END AS ar
          FROM (SELECT *, (1 - c) * 0.6 AS n, (1 - c) * 0.4 AS f FROM ({_EMO})))""")
def emotion_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, confidence, valence and arousal of distributions (83, 84)."""
    rows = _ev(spark, sf, "emotion").select("id", F.lower(F.trim("emotion.value")).alias("v"), F.col("emotion.confidence").alias("c")).where("c IS NOT NULL AND v IN ('happy', 'angry', 'sad', 'surprise')").distinct()
    rows = rows.withColumn("d", _distribution(F.col("c"), F.col("v"))).withColumn("x", layers.decide_label(F.col("d")))
    return rows.select("id", "x.label", F.round("x.confidence", 6).alias("confidence"), F.col("x.secondary_label").alias("secondary"), F.round(layers.weighted(F.col("d"), 0), 6).alias("valence"), F.round(layers.weighted(F.col("d"), 1), 6).alias("arousal"))


@query("""SELECT event_id, CASE WHEN s >= 0.65 THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS intensity FROM (SELECT event_id, a + least(0.15, 0.05 * b + 0.03 * q) AS s FROM (SELECT event_id, (event_id % 101) / 100.0 AS a, event_id % 3 AS b, event_id % 5 AS q FROM events))""")
def intensity_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Intensity from arousal and marks (85, 86)."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", layers.intensity(F.lit("happy"), (e % 101) / 100, e % 3, e % 5, F.lit(0)).alias("intensity"))


@query("""SELECT event_id, round(greatest(0.8, least(1.2, 1 + (a - 0.5) * 0.4)), 3) AS rate, round(greatest(0.85, least(1.2, 1 + (a - 0.5) * 0.4)), 3) AS pitch, CASE event_id % 5 WHEN 0 THEN 'rising' WHEN 1 THEN 'continuation' ELSE 'falling' END AS contour
    FROM (SELECT event_id, (event_id % 101) / 100.0 AS a FROM events)""")
def prosody_values(spark: SparkSession, sf: str) -> DataFrame:
    """Rate, pitch and contour (100, 101)."""
    rate, pitch, _ = layers.rates((F.col("event_id") % 101) / 100)
    kind = F.get(F.lit(["interrogative", "incomplete", "declarative", "exclamative", "imperative"]), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf, "events").select("event_id", F.round(rate, 3).alias("rate"), F.round(pitch, 3).alias("pitch"), layers.contour(kind).alias("contour"))


@query()
def focus_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How often each focus rule fires over all utterances (88 to 95)."""
    toks = _once(table(spark, sf, "utterance").select("utt_id", "text"), "utt_id").withColumn("tokens", layers.rule_tokens(F.col("text")))
    scored = toks.select(F.explode(layers.focus_tokens(F.col("tokens"))).alias("t"))
    return scored.select(F.explode("t.focus_rules").alias("rule"), "t.focus_score").groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("focus_score"), 4).alias("score"))


@query(f"""SELECT DISTINCT id, coalesce(list_bool_or([contains(lower(text), m) for m in {_list(lexicon.FORMAL_MARKERS)}]), false) AS formal FROM evaluation_example WHERE text IS NOT NULL""")
def formal_register(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a formal marker (106, 136)."""
    rows = _ev(spark, sf, "text").where("text IS NOT NULL")
    return rows.select("id", (corpus.register_of(F.col("text"), lexicon.FORMAL_MARKERS) == "formal").alias("formal"))


@query("""SELECT label, word, CAST(weight AS DOUBLE) AS weight, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, ord) AS r FROM (VALUES ('uau','surprise',1.0,0),('oau','surprise',1.0,1),('vai','surprise',0.5,2),('bravo','happy',1.0,3),('super','happy',0.8,4),('ura','happy',1.0,5),('haha','happy',0.9,6),('of','sad',0.7,7),('aoleu','fear',0.8,8),('ah','surprise',0.4,9),('oh','surprise',0.4,10)) t(word, label, weight, ord)) WHERE r <= 2""")
def interjection_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The two heaviest interjections of each label (107)."""
    rows = [(k, w, float(x), i + 1) for k in lexicon.LABELS for i, (w, x) in enumerate(layers.candidates(k))]
    return spark.createDataFrame(rows, "label string, word string, weight double, place int")


@query()
def interjection_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions and inserted texts over context paragraphs (105 to 109)."""
    docs = table(spark, sf, "context_paragraph").select("id", F.array_join("sentences", " ").alias("text")).distinct()
    out = process(docs, {"include": ["interjections"]}, id_col="id", interjection_mode="insert")
    return out.select("id", "document_style", F.posexplode("sentences").alias("place", "s")).where(F.size("s.interjection_suggestions") > 0).select("id", "document_style", "place", "s.text_with_interjections")


@query()
def context_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Share of sentences whose emotion the sentence before changes (110 to 114, 147)."""
    docs = table(spark, sf, "context_paragraph").select("id", F.array_join("sentences", " ").alias("text")).distinct()
    out = process(docs, {"include": ["context"]}, id_col="id").select(F.explode("sentences").alias("s"))
    return metrics.rate(out, F.col("s.context_emotion.changed"))


@query("""SELECT user_id, event_id, round(CASE WHEN p IS NULL THEN v ELSE (0.7 * v + 0.3 * p) END, 6) AS blended FROM (SELECT user_id, event_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, (event_id % 101) / 100.0 AS v FROM events))""")
def turn_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's distribution blended with the user's one before (112, 114)."""
    v = (F.col("event_id") % 101) / 100
    rows = table(spark, sf, "events").select("user_id", "event_id", F.create_map(F.lit("happy"), v, F.lit("sad"), 1 - v).alias("d"))
    rows = rows.withColumn("p", F.lag("d").over(Window.partitionBy("user_id").orderBy("event_id")))
    mixed = F.when(F.col("p").isNull(), F.col("d")).otherwise(layers.blend(F.col("d"), F.col("p"), 0.7, F.lit(0.3)))
    return rows.select("user_id", "event_id", F.round(F.try_element_at(mixed, F.lit("happy")), 6).alias("blended"))


@query("""SELECT category, count(*) AS n FROM (SELECT CASE WHEN w IN ('dar', 'însă', 'totuși', 'ci') THEN 'contrast' WHEN w IN ('deci', 'așadar', 'astfel') THEN 'consequence' END AS category FROM (SELECT lower(regexp_extract(text, '[\\pL\\pN_]+(?:[-’''][\\pL\\pN_]+)*')) AS w FROM (SELECT DISTINCT utt_id, text FROM utterance))) GROUP BY 1""")
def discourse_openings(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances by the discourse marker they open with (111)."""
    rows = _once(table(spark, sf, "utterance").select("utt_id", "text"), "utt_id").select(layers.discourse(layers.rule_tokens(F.col("text"))).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


# Serializers


_Q = "round(round_even({v} / 0.05, 0) * 0.05, 2)"
_HEAD = f"'[SENT_DECLARATIVE]' || chr(10) || '[EMO_' || upper(coalesce(v, 'unspecified')) || ']' || chr(10) || '[INT_UNSPECIFIED]' || chr(10) || '[RATE_' || printf('%.2f', {_Q.format(v='a')}) || ']' || chr(10) || '[PITCH_' || printf('%.2f', {_Q.format(v='b')}) || ']' || chr(10) || '[ENERGY_UNSPECIFIED]'"


@query(f"SELECT id, {_HEAD} AS header FROM (SELECT DISTINCT id, lower(trim(emotion.value)) AS v, 0.8 + (length(text) % 41) / 100.0 AS a, 0.85 + (length(text) % 31) / 100.0 AS b FROM evaluation_example)")
def control_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Control-token headers with quantized values (116, 117)."""
    n = F.length("text")
    rows = _ev(spark, sf, "text", "emotion").select("id", F.lower(F.trim("emotion.value")).alias("v"), (F.lit(0.8) + (n % 41) / 100).alias("a"), (F.lit(0.85) + (n % 31) / 100).alias("b")).distinct()
    none = F.lit(None).cast("string")
    return rows.select("id", serializers.header(F.lit("declarative"), F.col("v"), none, F.round("a", 6), F.round("b", 6), F.lit(None).cast("double")).alias("header"))


@query(f"SELECT id, CAST(0 AS BIGINT) AS sentence_index, 'declarative' AS sentence_type, v AS emotion_label, CAST(NULL AS VARCHAR) AS intensity, {_Q.format(v='a')} AS speaking_rate FROM (SELECT DISTINCT id, nullif(lower(trim(emotion.value)), 'unspecified') AS v, 0.8 + (length(text) % 41) / 100.0 AS a FROM evaluation_example)")
def control_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Control tokens read back to quantized values (119)."""
    heads = control_headers(spark, sf)
    return serializers.parse_control_tokens(heads, "id", "header").select(F.col("key").alias("id"), F.col("sentence_index").cast("long").alias("sentence_index"), "sentence_type", "emotion_label", "intensity", "speaking_rate")


@query()
def serialization_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Success, unknown tokens and determinism of serializing the evaluation rows twice (146)."""
    rows = _ev(spark, sf, "text").where("text IS NOT NULL")
    run = lambda: process(rows, "expressive", id_col="id", serialize=True).select("id", "tts_token_text")
    return metrics.serialization_checks(run().withColumnRenamed("tts_token_text", "one").join(run().withColumnRenamed("tts_token_text", "two"), "id"), "one", "two")


@query()
def rendered_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated text, SSML-like text and canonical JSON of context paragraphs (31, 115, 120)."""
    docs = table(spark, sf, "context_paragraph").select("id", F.array_join("sentences", " ").alias("text")).distinct()
    out = process(docs, "expressive", id_col="id")
    return out.select("id", serializers.annotated_text(F.col("sentences")).alias("annotated"), serializers.ssml_like(F.col("sentences")).alias("ssml"), F.length(serializers.canonical_json(F.struct(*out.columns))).alias("json_length"))


# Sources and sinks


@query("""SELECT feed, count(*) AS n, count(*) FILTER (json_valid(payload)) AS valid FROM (SELECT DISTINCT record_id, payload, feed FROM raw_record) GROUP BY feed""")
def bad_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each feed that are JSON, under the keeping policy (21, 22)."""
    rows = table(spark, sf, "raw_record").select("record_id", "payload", "feed").distinct()
    ok = F.try_parse_json("payload").isNotNull()
    return rows.groupBy("feed").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


@query("""SELECT rel_wav, text, speaker FROM (SELECT DISTINCT 'clips/' || trim(rel_wav) AS rel_wav, trim(text, ' ') AS text, 'cv_' || left(coalesce(nullif(trim(speaker), ''), 'unknown'), 12) AS speaker FROM utterance WHERE trim(coalesce(text, ''), ' ') <> '' AND trim(coalesce(rel_wav, '')) <> '')""")
def common_voice_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances read as rows of a crowd corpus (16)."""
    return readers.common_voice_rows(table(spark, sf, "utterance").select(F.col("speaker").alias("client_id"), F.col("rel_wav").alias("path"), F.col("text").alias("sentence"))).distinct()


@query("""SELECT DISTINCT 'wavs/' || regexp_extract(rel_wav, '([^/]+)$', 1) AS rel_wav, trim(coalesce(replace(replace(text, chr(10), ' '), '|', ' '), ''), ' ') AS text, coalesce(nullif(lower(regexp_extract(regexp_extract(rel_wav, '([^/]+)$', 1), '^([^_]*)_', 1)), ''), 'swara') AS speaker FROM utterance WHERE rel_wav IS NOT NULL""")
def flat_metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances read from lines of ``file|text`` (10, 11, 15)."""
    text = F.coalesce(F.translate("text", "\n|", "  "), F.lit(""))
    lines = table(spark, sf, "utterance").where("rel_wav IS NOT NULL").select(F.concat("rel_wav", F.lit("|"), text).alias("value"))
    return readers.swara_metadata(lines).distinct()


@query("""SELECT DISTINCT audio_file, coalesce(phonemes, '') AS phonemes, nullif(speaker, '') AS speaker, nullif(emotion, '') AS emotion FROM manifest_row""")
def manifest_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows written as lines and read back (19, 20, 32)."""
    m = table(spark, sf, "manifest_row")
    lines = m.select(sinks.manifest_line(*[F.col(c) for c in ("audio_file", "phonemes", "speaker", "emotion")]).alias("value"))
    return readers.manifest_fields(lines, 3).drop("language").distinct()


@query("""SELECT word, list_sort(list_distinct(list(p))) AS tags FROM (SELECT lower(trim(source)) AS word, unnest(phenomena) AS p FROM evaluation_example WHERE source IS NOT NULL) WHERE p IS NOT NULL GROUP BY word""")
def lexicon_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags united by lower-case word (26)."""
    rows = table(spark, sf, "evaluation_example").select(F.col("source").alias("word"), F.explode("phenomena").alias("emotion"), F.lit(1).alias("flag"))
    return readers.lexicon_tags(rows.where("emotion IS NOT NULL"))


@query("""SELECT lower(trim(speaker)) AS word, round(avg(duration_s), 6) AS valence, round(avg(duration_s / 2), 6) AS arousal FROM utterance WHERE speaker IS NOT NULL GROUP BY 1""")
def lexicon_vad(spark: SparkSession, sf: str) -> DataFrame:
    """Means by lower-case word (27)."""
    rows = table(spark, sf, "utterance").where("speaker IS NOT NULL").select(F.col("speaker").alias("word"), F.col("duration_s").alias("valence"), (F.col("duration_s") / 2).alias("arousal"))
    return readers.lexicon_vad(rows, ("word", "valence", "arousal")).select("word", F.round("valence", 6).alias("valence"), F.round("arousal", 6).alias("arousal"))


@query("""SELECT DISTINCT utt_id, text FROM (SELECT utt_id, trim(array_to_string([t || CASE WHEN length(t) % 5 = 0 THEN '' ELSE ' ' END for t in string_split(text, ' ') if t <> ''], ''), ' ') AS text FROM utterance) WHERE length(text) BETWEEN 20 AND 220""")
def detokenized(spark: SparkSession, sf: str) -> DataFrame:
    """Texts put together from tokens and space flags (24, 25)."""
    toks = F.filter(F.split("text", " "), lambda t: t != "")
    rows = table(spark, sf, "utterance").select("utt_id", toks.alias("tokens"), F.transform(toks, lambda t: F.length(t) % 5 != 0).alias("space_after"))
    return readers.ronec_rows(rows).select("utt_id", "text").distinct()


@query("""SELECT DISTINCT id, text, 'happy' AS emotion FROM evaluation_example WHERE length(text) BETWEEN 10 AND 200 AND length(text) % 3 = 1""")
def agreed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with exactly one agreed label (23)."""
    n = F.length("text") % 3
    flags = F.when(n == 1, F.array(F.lit(0), F.lit(1))).when(n == 2, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))
    raw = _ev(spark, sf, "text").select("id", "text", flags.alias("agreed_labels"), F.lit(["Trust", "Happy"]).alias("labels"), F.lit([0.2, 0.8]).alias("percents"))
    kept = readers.redv2_rows(raw)
    return raw.select("id", "text").join(kept.select("text", "emotion").distinct(), "text").select("id", "text", "emotion")


@query("""SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, rn) AS k FROM (SELECT left(utt_id, 9) AS id, trim(text, ' ') AS text, corpus AS source, utt_id AS rn FROM (SELECT DISTINCT utt_id, corpus, replace(replace(text, chr(10), ' '), '|', ' ') AS text FROM utterance WHERE text IS NOT NULL AND corpus IS NOT NULL))) WHERE k = 1""")
def central_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts of a central file: the first line of an id counts (13, 14)."""
    rows = table(spark, sf, "utterance").where("text IS NOT NULL AND corpus IS NOT NULL").select("utt_id", "corpus", F.translate("text", "\n|", "  ").alias("text")).distinct()
    return readers.central_transcripts(rows.select(F.col("corpus").alias("file"), F.col("utt_id").alias("line_no"), F.concat(F.left("utt_id", F.lit(9)), F.lit("|"), "text").alias("value")))


@query("""SELECT DISTINCT lower(trim(corpus)) AS corpus, regexp_replace(rel_wav, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM utterance""")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """File names fit for any system (129)."""
    return table(spark, sf, "utterance").select(F.lower(F.trim("corpus")).alias("corpus"), X.slug(F.col("rel_wav")).alias("slug")).distinct()


@query("SELECT DISTINCT rel_wav, greatest(1, CAST(floor((length(text) - 44) / 2) AS BIGINT)) AS samples FROM utterance")
def sample_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of clips by their size (30)."""
    return table(spark, sf, "utterance").select("rel_wav", readers.sample_estimate(F.length("text")).alias("samples")).distinct()


# Corpus


@query("""SELECT CASE WHEN trim(coalesce(u.text, '')) = '' THEN 'empty_text' WHEN m.audio_file IS NULL THEN 'missing_audio' WHEN trim(coalesce(m.phonemes, '')) = '' THEN 'empty_phonemes' ELSE 'written' END AS status, count(*) AS n
    FROM (SELECT DISTINCT utt_id, rel_wav, regexp_replace(text, '\\s', '', 'g') AS text FROM utterance) u LEFT JOIN (SELECT audio_file, min(phonemes) AS phonemes FROM manifest_row GROUP BY 1) m ON m.audio_file = u.rel_wav GROUP BY 1""")
def manifest_status(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances by whether a manifest row can be written (121)."""
    spoken = table(spark, sf, "manifest_row").groupBy("audio_file").agg(F.min("phonemes").alias("spoken"))
    utt = table(spark, sf, "utterance").select("utt_id", "rel_wav", F.regexp_replace("text", r"[ \t\n\r\f]", "").alias("text"), F.lit("s").alias("speaker")).distinct()
    utt = utt.join(spoken, utt["rel_wav"] == spoken["audio_file"], "left")
    return corpus.build_manifest(utt, spoken.select(F.col("audio_file").alias("path")), F.col("spoken"), F.lit("neutral"))[1].select("status", "n")


@query("""SELECT audio_file, coalesce(list_filter(l, lambda x: x IS NOT NULL AND x <> 'unspecified')[1], 'neutral') AS emotion FROM (SELECT audio_file, list(e ORDER BY e) AS l FROM (SELECT DISTINCT audio_file, nullif(emotion, '') AS e FROM manifest_row) WHERE e IS NOT NULL GROUP BY 1)""")
def first_emotions(spark: SparkSession, sf: str) -> DataFrame:
    """First label of each clip that says something (123)."""
    rows = table(spark, sf, "manifest_row").select("audio_file", F.nullif("emotion", F.lit("")).alias("e")).distinct().where("e IS NOT NULL")
    return rows.groupBy("audio_file").agg(F.array_sort(F.collect_list("e")).alias("l")).select("audio_file", corpus.first_emotion(F.col("l")).alias("emotion"))


@query("SELECT corpus, count(*) AS n FROM (SELECT DISTINCT utt_id, corpus, duration_s FROM utterance) WHERE duration_s IS NULL OR duration_s <= 10 GROUP BY 1")
def short_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of at most ten seconds or unknown length (124)."""
    rows = table(spark, sf, "utterance").select("utt_id", "corpus", "duration_s").distinct()
    return rows.where(sinks.within_duration(F.col("duration_s"), 10.0)).groupBy("corpus").agg(F.count("*").alias("n"))


@query("SELECT corpus_name, count(*) AS n FROM (SELECT text, 'read' AS corpus_name FROM utterance UNION ALL SELECT text, 'written' FROM evaluation_example UNION ALL SELECT text, 'web' FROM documents) GROUP BY 1")
def corpora_united(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three corpora under their names (125)."""
    parts = {"read": "utterance", "written": "evaluation_example", "web": "documents"}
    return corpus.union_corpora({k: table(spark, sf, t).select("text") for k, t in parts.items()}).groupBy("corpus_name").agg(F.count("*").alias("n"))


@query("""SELECT speaker, duration_s, utt_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY duration_s, utt_id) AS k FROM (SELECT DISTINCT lower(trim(speaker)) AS speaker, duration_s, utt_id FROM utterance WHERE speaker IS NOT NULL AND duration_s IS NOT NULL)) WHERE k = 1""")
def reference_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest clip of each speaker (126)."""
    rows = table(spark, sf, "utterance").where("speaker IS NOT NULL AND duration_s IS NOT NULL").select(F.lower(F.trim("speaker")).alias("speaker"), "duration_s", "utt_id").distinct()
    return corpus.first_per_group(rows, "speaker", ["duration_s", "utt_id"])


@query("SELECT text, min(utt_id) AS first_at FROM utterance WHERE text IS NOT NULL GROUP BY text ORDER BY first_at, text LIMIT 100")
def first_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred distinct transcripts (127)."""
    return corpus.distinct_top(table(spark, sf, "utterance").where("text IS NOT NULL"), "text", "utt_id", 100)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every region with every nation (128), a small stated set."""
    return corpus.pairs(table(spark, sf, "region").select("r_name"), table(spark, sf, "nation").select("n_name"))


_KEY = f"replace(lower(replace(trim(regexp_replace({{c}}, '{_SPACES}+', ' ', 'g')), 'ß', 'ss')), 'i̇', 'i̇')"


@query(f"SELECT k AS dedup_key, min(id) AS id FROM (SELECT {_KEY.replace('{c}', 'text')} AS k, id FROM evaluation_example WHERE text IS NOT NULL) GROUP BY 1")
def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """First row of each text, whitespace and case aside (130)."""
    return corpus.deduplicated(_ev(spark, sf, "text").where("text IS NOT NULL"), "text", ["id"]).select("dedup_key", "id")


@query(f"""WITH u AS (SELECT DISTINCT {_KEY.replace('{c}', 'text')} AS k FROM evaluation_example WHERE text IS NOT NULL)
    SELECT k AS dedup_key, min(utt_id) AS utt_id FROM (SELECT {_KEY.replace('{c}', 'text')} AS k, utt_id FROM utterance WHERE text IS NOT NULL) s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = s.k) GROUP BY 1""")
def unused_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances whose text is no evaluation text, each once (131)."""
    utt = table(spark, sf, "utterance").select("utt_id", "text").where("text IS NOT NULL").distinct()
    return corpus.unused(utt, "text", table(spark, sf, "evaluation_example"), "text", ["utt_id"]).select("dedup_key", "utt_id")


_STRATA = "SELECT DISTINCT id, lower(trim(emotion.value)) AS label FROM evaluation_example WHERE emotion.value IS NOT NULL"


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf, "emotion").where("emotion.value IS NOT NULL").select("id", F.lower(F.trim("emotion.value")).alias("label")).distinct()


@query(f"SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('13:' || id), id) AS k FROM ({_STRATA})) WHERE k <= 30")
def stratified_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most thirty rows of each label (132)."""
    return corpus.stratified_cap(_strata(spark, sf), "label", "id")


@query(f"SELECT id, label, CASE WHEN k <= round_even(n * 0.8, 0) THEN 'train' ELSE 'heldout' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('13:' || id), id) AS k, count(*) OVER (PARTITION BY label) AS n FROM ({_STRATA}))")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """Four fifths of each label for training (133)."""
    return corpus.stratified_split(_strata(spark, sf), "label", "id")


@query("SELECT source, count(*) AS n FROM (SELECT DISTINCT id, lower(trim(split_part(source, '#', 1))) AS source FROM evaluation_example) WHERE source IN (SELECT s FROM (SELECT lower(trim(split_part(source, '#', 1))) AS s, id FROM evaluation_example GROUP BY ALL) GROUP BY s HAVING count(*) >= 5) GROUP BY 1")
def common_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with at least five rows (134)."""
    rows = _ev(spark, sf, "source").select("id", F.lower(F.trim(F.substring_index("source", "#", 1))).alias("source")).distinct()
    return corpus.common_labels(rows, "source").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT part, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, CASE WHEN k <= round_even(n * 0.55, 0) THEN 'dev' ELSE 'test' END AS part FROM (SELECT id, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM evaluation_example))) GROUP BY 1")
def positional_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first 55 percent of rows and the rest (135)."""
    rows = corpus.positional_split(table(spark, sf, "evaluation_example").select("id").distinct(), ["id"])
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT chunk, texts FROM (SELECT CAST((k - 1) // 5 AS BIGINT) AS chunk, list(utt_id ORDER BY k) AS texts FROM (SELECT utt_id, row_number() OVER (ORDER BY utt_id) AS k FROM (SELECT DISTINCT utt_id FROM utterance)) GROUP BY 1) WHERE len(texts) = 5")
def chunks_of_five(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive groups of five, without the rest (137)."""
    return corpus.chunked(table(spark, sf, "utterance").select("utt_id").distinct(), ["utt_id"], "utt_id", 5)


@query("SELECT DISTINCT d.doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) d WHERE k IN (SELECT (i * n) // 50 FROM range(50) r(i))")
def evenly_spaced(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty documents at even distances (138)."""
    return corpus.evenly_spaced(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 50)


@query("SELECT DISTINCT e.id, text FROM evaluation_example e WHERE text IN (SELECT text FROM evaluation_example WHERE text IS NOT NULL ORDER BY text LIMIT 3)")
def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of given texts (139)."""
    rows = _ev(spark, sf, "text")
    wanted = [r[0] for r in table(spark, sf, "evaluation_example").where("text IS NOT NULL").select("text").orderBy("text").limit(3).collect()]
    return corpus.lookup_by_text(rows, "text", wanted).select("id", "text")


# Metrics: the register stands in for gold, the emotion's length class for a prediction

_PAIR = "SELECT DISTINCT id, lower(trim(emotion.value)) AS gold, coalesce(lower(trim(secondary_emotion.value)), 'unspecified') AS predicted, emotion.confidence AS c FROM evaluation_example WHERE emotion.value IS NOT NULL"


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ev(spark, sf, "emotion", "secondary_emotion").where("emotion.value IS NOT NULL")
    return rows.select("id", F.lower(F.trim("emotion.value")).alias("gold"), F.coalesce(F.lower(F.trim("secondary_emotion.value")), F.lit("unspecified")).alias("predicted"), F.col("emotion.confidence").alias("c")).distinct()


@query(f"SELECT gold, predicted, count(*) AS n FROM ({_PAIR}) GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Gold against predicted labels (140)."""
    return metrics.confusion(_pair(spark, sf), "gold", "predicted")


@query(f"SELECT gold, count(*) FILTER (predicted = 'happy') AS happy, count(*) FILTER (predicted = 'sad') AS sad, count(*) FILTER (predicted = 'unspecified') AS unspecified FROM ({_PAIR}) GROUP BY gold")
def confusion_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a matrix (140)."""
    return metrics.confusion_matrix(_pair(spark, sf), "gold", "predicted", ["happy", "sad", "unspecified"])


_CELLS = f"WITH p AS ({_PAIR}), l AS (SELECT gold AS label FROM p UNION SELECT predicted FROM p), s AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn FROM l, p GROUP BY label)"


@query(_CELLS + " SELECT label, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM s")
def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of each label (141)."""
    s = metrics.label_scores(_pair(spark, sf), "gold", "predicted")
    return s.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(_CELLS + " SELECT round(avg(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 9) AS macro_f1, count(*) AS labels FROM s")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Macro F1 (141)."""
    return metrics.macro_f1(_pair(spark, sf), "gold", "predicted").select(F.round("macro_f1", 9).alias("macro_f1"), "labels")


@query(f"SELECT round(avg(CAST(gold = predicted AS INT)), 9) AS accuracy, round(avg(CAST(predicted <> 'unspecified' AS INT)), 9) AS coverage, count(*) AS n FROM ({_PAIR})")
def accuracy_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and coverage (142)."""
    return metrics.accuracy_coverage(_pair(spark, sf), "gold", "predicted").select(F.round("accuracy", 9).alias("accuracy"), F.round("coverage", 9).alias("coverage"), "n")


@query(f"SELECT round(avg(pow(c - CAST(gold = 'happy' AS INT), 2) + pow(1 - c - CAST(gold = 'neutral' AS INT), 2)), 9) AS brier FROM ({_PAIR}) WHERE c IS NOT NULL")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score (143)."""
    rows = _pair(spark, sf).where("c IS NOT NULL").withColumn("d", F.create_map(F.lit("happy"), F.col("c"), F.lit("neutral"), 1 - F.col("c")))
    return metrics.brier(rows, "gold", "d", ["happy", "neutral"]).select(F.round("brier", 9).alias("brier"))


@query("""WITH s AS (SELECT list_distinct(g) AS g, list_distinct(p) AS p FROM (SELECT DISTINCT id, string_split(text, ' ') AS g, string_split(expected_normalized_text, ' ') AS p FROM evaluation_example WHERE text IS NOT NULL AND expected_normalized_text IS NOT NULL)),
    t AS (SELECT sum(len(list_intersect(g, p))) AS tp, sum(len(p) - len(list_intersect(g, p))) AS fp, sum(len(g) - len(list_intersect(g, p))) AS fn FROM s)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM t""")
def token_set_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the texts against those of their spoken forms, as sets (144)."""
    rows = _ev(spark, sf, "text", "expected_normalized_text").where("text IS NOT NULL AND expected_normalized_text IS NOT NULL").select(F.split("text", " ").alias("g"), F.split("expected_normalized_text", " ").alias("p"))
    return metrics.set_scores(rows, "g", "p").select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT count(*) FILTER (v) AS hits, count(*) AS n, round(count(*) FILTER (v) / count(*), 9) AS rate FROM (SELECT DISTINCT id, interjection_appropriate.value AS v FROM evaluation_example WHERE lower(trim(text_register)) = 'formal')")
def formal_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Formal texts for which an interjection was found fit (145)."""
    rows = _ev(spark, sf, "interjection_appropriate", "text_register").where("lower(trim(text_register)) = 'formal'").select("id", F.col("interjection_appropriate.value").alias("v")).distinct()
    return metrics.rate(rows, F.col("v")).select("hits", "n", F.round("rate", 9).alias("rate"))


@query("WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT DISTINCT p, v AS value FROM s, (SELECT CAST(unnest([0.5, 0.95, 0.99]) AS DOUBLE) AS p) WHERE k = round_even(p * (n - 1), 0)")
def nearest_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Values at nearest ranks (148)."""
    return metrics.nearest_rank(table(spark, sf, "events"), "value", [0.5, 0.95, 0.99]).distinct()


@query("SELECT round(median(value), 9) AS median FROM events")
def median_value(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolated median (149)."""
    return metrics.exact_median(table(spark, sf, "events"), "value").select(F.round("median", 9).alias("median"))


@query()
def error_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and failures of each layer over the evaluation rows (150)."""
    out = Pipeline({"include": ["normalized", "phonemes", "emotion", "context"]}).process(_ev(spark, sf, "text").where("text IS NOT NULL"), "text", "id")
    s = F.col("sentences")
    checks = {"clean": F.col("clean_text").isNull(), "normalized": F.size("errors") > 0, "tokens": F.exists(s, lambda x: x["tokens"].isNull()), "emotion": F.exists(s, lambda x: x["emotion"].isNull()), "context": F.exists(s, lambda x: x["context_emotion"].isNull())}
    return metrics.errors_by_layer(out, checks)


@query(f"SELECT round(1 - avg(pow(g - p, 2)) / (avg(g * g) + avg(p * p) - 2 * avg(g) * avg(p)), 9) AS kappa FROM (SELECT list_position(['neutral', 'sad', 'happy', 'angry'], gold) AS g, list_position(['neutral', 'sad', 'happy', 'angry'], predicted) AS p FROM ({_PAIR})) WHERE g > 0 AND p > 0")
def weighted_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Quadratic weighted kappa."""
    return metrics.weighted_kappa(_pair(spark, sf), "gold", "predicted", ["neutral", "sad", "happy", "angry"]).select(F.round("kappa", 9).alias("kappa"))


@query(f"SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM (SELECT least(9, floor(c * 10)) AS b, count(*) AS n, avg(c) AS c, avg(CAST(gold = 'neutral' AS INT)) AS a FROM ({_PAIR}) WHERE c IS NOT NULL GROUP BY 1)")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error."""
    return metrics.calibration_error(_pair(spark, sf), "c", F.col("gold") == "neutral").select(F.round("ece", 9).alias("ece"))


@query("SELECT round(sum(levenshtein(a, b)) / sum(length(a)), 9) AS per FROM (SELECT DISTINCT id, text_register AS a, lower(trim(text_register)) AS b FROM evaluation_example WHERE text_register IS NOT NULL)")
def symbol_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Edits over gold symbols."""
    rows = _ev(spark, sf, "text_register").where("text_register IS NOT NULL").select("id", F.col("text_register").alias("a"), F.lower(F.trim("text_register")).alias("b"))
    return metrics.phoneme_error_rate(rows, "a", "b").select(F.round("per", 9).alias("per"))


@query("SELECT round(avg(abs(duration_s - length(text) / 15.0)), 6) AS mae FROM (SELECT DISTINCT utt_id, duration_s, text FROM utterance)")
def duration_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute error of a rule that guesses durations."""
    rows = table(spark, sf, "utterance").select("utt_id", "duration_s", (F.length("text") / 15).alias("guess")).distinct()
    return metrics.mean_absolute_error(rows, "duration_s", "guess").select(F.round("mae", 6).alias("mae"))


@query()
def boundary_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Rule boundaries against the given ones, as sets of ends."""
    rows = _ev(spark, sf, "text", "sentence_boundaries").where("sentence_boundaries IS NOT NULL AND text IS NOT NULL")
    ends = F.transform(X.segment(F.col("text")), lambda s: s["end"])
    scores = metrics.boundary_scores(rows.select(F.transform("sentence_boundaries", lambda b: b["end"]).alias("g"), ends.alias("p")), "g", "p")
    return scores.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query()
def emotion_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Classifier on TF-IDF and the emotion layer's features, fitted on four fifths of the rows, scored on the rest (133, 134, 141, 151)."""
    rows = _ev(spark, sf, "text", "text_register").where("text IS NOT NULL AND text_register IS NOT NULL").select("id", "text", F.lower(F.trim("text_register")).alias("label"))
    said = process(_once(rows, "id"), {"include": ["emotion"]}, id_col="id").select("id", array_to_vector(metrics.rule_features(F.col("sentences"))).alias("rules"))
    parts = cut(corpus.stratified_split(corpus.common_labels(rows, "label"), "label", "id").join(said, "id"), "parts")
    model = metrics.train_text_classifier(parts.where("part = 'train'"), "text", "label", rules="rules")
    return metrics.label_scores(model.transform(parts.where("part = 'heldout'")), "label", "predicted")


@query()
def enriched_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows with spoken text and boundaries from the layers (159a, 159c)."""
    rows = _ev(spark, sf, "text", "phenomena").where("text IS NOT NULL")
    out = corpus.enriched(rows, process(rows, "normalize_only", id_col="id"), "id")
    return out.select("id", "expected_normalized_text", F.size("sentence_boundaries").alias("sentences"), "draft_confidence")


# Audio and streams


@query("SELECT user_id, round(10 * log10(sum(value * value) / count(*)), 6) AS rms_db FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING sum(value * value) > 0")
def signal_levels(spark: SparkSession, sf: str) -> DataFrame:
    """RMS level of each user's values taken as a signal (156)."""
    rows = table(spark, sf, "events").where("value IS NOT NULL").groupBy("user_id").agg(audio.level_db(F.col("value")).alias("rms_db"))
    return rows.select("user_id", F.round("rms_db", 6).alias("rms_db")).where("rms_db IS NOT NULL")


@query()
def finished_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as a short signal through the finishing chain (153 to 158)."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("float")).alias("x"))
    done = rows.select("vec_id", audio.finished(F.col("x"), F.lit(16000)).alias("y"))
    return done.select("vec_id", F.size("y").alias("samples"), F.round(F.array_max(F.transform("y", lambda v: F.abs(v))).cast("double"), 4).alias("peak"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day and type, counted as a stream until all of the table is done."""
    done = f"{shared_dir(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf, "events"))
    source = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = streams.counts_by_window(source, "ts", "event_type", "1 day", late="1 day")
    # All counts come out with every batch, so no state may expire; they go to a table, not to the driver.
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(done)).option("checkpointLocation", f"{done}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(done).select("event_type", F.to_date("w.start").alias("day"), "n")


def _folder(spark: SparkSession, sf: str, name: str) -> str:
    """A folder to stream a table from: the table's own, or a copy where it is a single file."""
    path = f"{sf}/{name}.parquet"
    if os.path.isdir(path):
        return path
    copy = f"{shared_dir(spark).rstrip('/')}/source-{uuid.uuid4().hex}"
    spark.read.parquet(path).write.parquet(copy)
    return copy


from . import cases, rules  # noqa: E402, F401  register more queries and their SQL
