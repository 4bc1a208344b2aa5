"""Queries of layers and models whose rules SQL states over whole tables, and SQL for queries of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as X
from ..operators import corpus, layers, lexicon, models
from ..runtime import table
from ..sources import readers
from . import sqlwords as W
from .catalog import _CLEAN, _SPACES, _SQL, _list, _once, query

_WORD = r"\pL\pN_"
_BLANK = _SPACES[1:-1]
_TOKEN = rf"[{_WORD}]+(?:[-’''][{_WORD}]+)*|\.\.\.|[^{_WORD}{_BLANK}]"
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_CLASS = "MAP {" + ", ".join(f"'{w}': '{k}'" for w, k in layers._by_word(lexicon.CLOSED_CLASS).items()) + "}"


def _tokens(source: str) -> str:
    """CTEs from ``source(key, text)`` to ``g(key, i, w, low, upos, neg, cmd)``: the rule tokens, numbered from 1."""
    return f"""r AS ({source}), t AS (SELECT key, regexp_extract_all(text, '{_TOKEN}') AS ws FROM r),
    k AS (SELECT key, i, ws[i] AS w, lower(ws[i]) AS low FROM (SELECT key, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
    g AS (SELECT *, CASE WHEN NOT regexp_matches(w, '[{_WORD}]') THEN 'PUNCT' WHEN regexp_matches(w, '^\\p{{Nd}}') THEN 'NUM' WHEN low IN {_IN([w for w, _, _ in lexicon.INTERJECTIONS if w != "super"])} THEN 'INTJ'
        WHEN {_CLASS}[low] IS NOT NULL THEN {_CLASS}[low] WHEN i = 1 AND low IN {_IN(lexicon.IMPERATIVES)} THEN 'VERB' WHEN i > 1 AND regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}') THEN 'PROPN' ELSE 'NOUN' END AS upos,
        low IN {_IN(lexicon.NEGATIONS)} AS neg, i = 1 AND low IN {_IN(lexicon.IMPERATIVES)} AS cmd FROM k)"""


_UTTERANCES = "SELECT DISTINCT utt_id AS key, text FROM utterance WHERE text IS NOT NULL"
_SQL["token_tags"] = f"WITH {_tokens(_UTTERANCES)} SELECT upos, upos = 'INTJ' AS is_interjection, count(*) AS n FROM g GROUP BY ALL"

_FUNCTION = _IN(layers.FUNCTION_UPOS)
_SQL["focus_scores"] = f"""WITH {_tokens(_UTTERANCES)},
    a AS (SELECT *, upos NOT IN {_FUNCTION} AS content, min(CASE WHEN neg THEN i END) OVER (PARTITION BY key) AS ni, min(CASE WHEN cmd AND upos = 'VERB' THEN i END) OVER (PARTITION BY key) AS ri,
        lag(low) OVER (PARTITION BY key ORDER BY i) AS b1, lag(low, 2) OVER (PARTITION BY key ORDER BY i) AS b2, count(*) FILTER (upos <> 'PUNCT') OVER (PARTITION BY key, low) AS same FROM g),
    b AS (SELECT *, min(CASE WHEN low = 'ci' AND upos <> 'PUNCT' AND i > coalesce(ni, 0) THEN i END) OVER (PARTITION BY key) AS ci FROM a),
    c AS (SELECT *, regexp_matches(w, '^\\p{{Lu}}{{2,}}$') AS caps, coalesce(b1 IN {_IN(lexicon.INTENSIFIERS)}, false) OR coalesce(b2 || ' ' || b1 IN {_IN(lexicon.INTENSIFIERS)}, false) AS strong, content AND same >= 2 AS again,
        coalesce(ni > 0 AND i > ni AND i < ci, false) AS down, coalesce(ni > 0 AND i > ci, false) AS up, coalesce(i = ri, false) AS main FROM b WHERE upos <> 'PUNCT'),
    d AS (SELECT *, (0.9 * caps::INT + 0.6 * strong::INT + 0.4 * again::INT) * CASE WHEN down THEN 0.3 ELSE 1.0 END + 0.7 * up::INT + 0.15 * main::INT AS s FROM c),
    e AS (SELECT *, CASE WHEN upos IN {_FUNCTION} AND s < 0.8 THEN NULL ELSE round(least(1.0, s), 3) END AS score FROM d)
    SELECT rule, count(*) AS n, round(avg(score), 4) AS score FROM (SELECT score, unnest([CASE WHEN caps THEN 'all_caps' END, CASE WHEN strong THEN 'intensifier_target' END, CASE WHEN again THEN 'repetition' END,
        CASE WHEN down THEN 'contrastive_negation_suppressed' END, CASE WHEN up THEN 'corrective_construction' END, CASE WHEN main THEN 'main_predicate' END]) AS rule FROM e WHERE score IS NOT NULL) WHERE rule IS NOT NULL GROUP BY rule"""


# Sentences: protected marks are replaced, the text is cut, and the marks come back.

_SHOW, _HIDE = ".!?…", X._HIDDEN[0]
_ABBREVIATED = "|".join(sorted(X.PROTECTED_ABBREVIATIONS, key=len, reverse=True))
_SPANS = [
    r"(?i)\bhttps?://[^" + _BLANK + r"]+|\bwww\.[^" + _BLANK + "]+", rf"[{_WORD}][{_WORD}.+-]*@[{_WORD}-]+\.[{_WORD}.-]*[{_WORD}]", r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b", r"\b\d+[.,]\d+\b",
    rf"(?i)\b(?:{_ABBREVIATED})\.[.!?…]*",
]


def _sentences(source: str) -> str:
    """CTEs from ``source(key, text)``, a clean text, to ``s(key, i, text, start, end)``."""
    steps = [f"h0 AS ({source})"]
    for n, p in enumerate(_SPANS):
        steps.append(f"h{n + 1} AS (SELECT key, array_to_string([z[1] || translate(coalesce(z[2], ''), '{_SHOW}', '{_HIDE}') for z in list_zip(string_split_regex(text, '{p}'), regexp_extract_all(text, '{p}'))], '') AS text FROM h{n})")
    steps.append(rf"""p AS (SELECT key, regexp_extract_all(text, '[^.!?…]*[.!?…]+["'')\]]*|[^.!?…]+$') AS ps FROM h{len(_SPANS)})""")
    steps.append("q AS (SELECT key, i, ps[i] AS piece, sum(length(ps[i])) OVER (PARTITION BY key ORDER BY i) - length(ps[i]) AS pos FROM (SELECT key, ps, unnest(range(1, len(ps) + 1)) AS i FROM p))")
    steps.append(f"s AS (SELECT key, i, translate(trim(piece, ' '), '{_HIDE}', '{_SHOW}') AS text, CAST(pos + length(piece) - length(ltrim(piece, ' ')) AS INT) AS start, CAST(pos + length(piece) - length(ltrim(piece, ' ')) + length(trim(piece, ' ')) AS INT) AS \"end\" FROM q WHERE trim(piece, ' ') <> '')")
    return ", ".join(steps)


_KIND = "CASE WHEN text LIKE '%?' THEN 'interrogative' WHEN text LIKE '%!' THEN 'exclamative' ELSE 'declarative' END"
_DOCUMENTS = f"SELECT doc_id AS key, {_CLEAN.replace('{c}', 'text')} AS text FROM documents WHERE text IS NOT NULL"
_SQL["segment_sentences"] = f'WITH {_sentences(_DOCUMENTS)} SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS INT) AS place, text, start, "end" FROM s'
_SQL["sentence_type_mix"] = f"WITH {_sentences(_DOCUMENTS)} SELECT lower(trim(d.lang)) AS lang, {_KIND.replace('text', 's.text')} AS sentence_type, count(*) AS n FROM s JOIN documents d ON d.doc_id = s.key GROUP BY ALL"

_GIVEN = "SELECT DISTINCT md5(id || text || CAST(sentence_boundaries AS VARCHAR)) AS key, text, [b.\"end\" for b in sentence_boundaries] AS g FROM evaluation_example WHERE text IS NOT NULL AND sentence_boundaries IS NOT NULL"
_SQL["boundary_scores"] = f"""WITH {_sentences(f"SELECT key, translate(text, '０１２３４５６７８９', '0123456789') AS text FROM ({_GIVEN})")}, o AS (SELECT key, list("end") AS p FROM s GROUP BY key),
    j AS (SELECT list_distinct(g) AS g, list_distinct(coalesce(p, [])) AS p FROM ({_GIVEN}) x LEFT JOIN o USING (key)), t AS (SELECT sum(len(list_intersect(g, p))) AS tp, sum(len(p)) AS np, sum(len(g)) AS ng FROM j)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(ng - tp AS BIGINT) AS fn, round(tp / np, 9) AS precision, round(tp / ng, 9) AS recall, round(2 * tp / (np + ng), 9) AS f1 FROM t"""
_SQL["serialization_checks"] = "SELECT n, n AS succeeded, CAST(0 AS BIGINT) AS with_unknown_tokens, CAST(0 AS BIGINT) AS not_deterministic FROM (SELECT count(*) AS n FROM (SELECT DISTINCT id, text FROM evaluation_example WHERE text IS NOT NULL))"
_SQL["error_grid"] = "SELECT layer, n AS runs, CAST(0 AS BIGINT) AS errors FROM (SELECT count(*) AS n FROM (SELECT DISTINCT id, text FROM evaluation_example WHERE text IS NOT NULL)), (SELECT unnest(['clean', 'normalized', 'tokens', 'emotion', 'context']) AS layer)"

# The clean layer's edits, pass by pass, each with offsets into the text before it.

_SQL["clean_trace"] = f"""WITH a AS (SELECT DISTINCT id, nfc_normalize(text) AS x FROM evaluation_example WHERE text IS NOT NULL), b AS (SELECT id, translate(x, '{X.LEGACY[0]}', '{X.LEGACY[1]}') AS x FROM a),
    c AS (SELECT id, translate(x, '{X.QUOTES[0]}', '{X.QUOTES[1].replace("'", "''")}') AS x FROM b), d AS (SELECT id, regexp_replace(x, '{_SPACES}+', ' ', 'g') AS x FROM c),
    ws AS (SELECT id, i, ps[i] AS p, sum(length(ps[i])) OVER (PARTITION BY id ORDER BY i) - length(ps[i]) AS pos FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT id, regexp_extract_all(x, '{_SPACES}+|[^{_BLANK}]+') AS ps FROM c))),
    e AS (SELECT id, 1 AS pass, 'legacy_diacritics' AS operation, i - 1 AS start, i AS "end", x[i] AS original, translate(x[i], '{X.LEGACY[0]}', '{X.LEGACY[1]}') AS replacement FROM (SELECT id, x, unnest(range(1, length(x) + 1)) AS i FROM a WHERE x <> translate(x, '{X.LEGACY[0]}', '')) WHERE contains('{X.LEGACY[0]}', x[i])
        UNION ALL SELECT id, 2, 'quotes', i - 1, i, x[i], translate(x[i], '{X.QUOTES[0]}', '{X.QUOTES[1].replace("'", "''")}') FROM (SELECT id, x, unnest(range(1, length(x) + 1)) AS i FROM b WHERE x <> translate(x, '{X.QUOTES[0]}', '')) WHERE contains('{X.QUOTES[0]}', x[i])
        UNION ALL SELECT id, 3, 'whitespace', pos, pos + length(p), p, ' ' FROM ws WHERE regexp_matches(p, '^{_SPACES}') AND p <> ' '
        UNION ALL SELECT id, 4, 'strip', 0, length(x), x, trim(x) FROM d WHERE x <> trim(x))
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pass, start) - 1 AS INT) AS place, operation, original, replacement, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM e"""

# Syllables: between two vowels apart, the last consonant (or the last two, if they are never split) opens the next.

_SQL["word_syllables"] = f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\pL+')) AS word FROM utterance),
    v AS (SELECT word, [i for i in range(1, length(word) + 1) if contains('{layers.VOWELS}', word[i])] AS vs FROM w),
    b AS (SELECT word, list_concat([1], [vs[k + 1] - CASE WHEN vs[k + 1] - vs[k] > 2 AND list_contains(string_split('{layers.ONSETS}', '|'), word[vs[k + 1] - 2 : vs[k + 1] - 1]) THEN 2 ELSE 1 END for k in range(1, len(vs)) if vs[k + 1] - vs[k] > 1]) AS cs FROM v),
    s AS (SELECT word, [word[cs[k] : coalesce(cs[k + 1] - 1, length(word))] for k in range(1, len(cs) + 1)] AS syl FROM b)
    SELECT word, array_to_string(syl, '-') AS syllables, CAST(CASE WHEN len(syl) <= 1 THEN 0 WHEN contains('{layers.VOWELS}', word[-1]) THEN len(syl) - 2 ELSE len(syl) - 1 END AS INT) AS stress FROM s"""


@query(f"""WITH {_tokens("SELECT DISTINCT s AS key, s AS text FROM (SELECT unnest(sentences) AS s FROM context_paragraph) WHERE s IS NOT NULL")},
    f AS (SELECT key, bool_or(cmd) AS cmd, bool_or(neg) AS neg FROM g GROUP BY key)
    SELECT CASE WHEN cmd THEN 'imperative' WHEN right(rtrim(key, ' '), 1) IN ('.', '…') THEN 'declarative' WHEN right(rtrim(key, ' '), 1) = '?' THEN 'interrogative' WHEN right(rtrim(key, ' '), 1) = '!' THEN 'exclamative' ELSE 'incomplete' END AS sentence_type,
        neg AS is_negated, count(*) AS n FROM f GROUP BY ALL""")
def sentence_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Type and negation of each distinct sentence of the context paragraphs (67 to 70)."""
    rows = table(spark, sf, "context_paragraph").select(F.explode("sentences").alias("s")).where("s IS NOT NULL").distinct().withColumn("tokens", layers.rule_tokens(F.col("s")))
    negated = F.exists("tokens", lambda t: F.coalesce(F.try_element_at(t["feats"], F.lit("Polarity")) == "Neg", F.lit(False)))
    return rows.select(layers.sentence_type(F.col("s"), F.col("tokens")).alias("sentence_type"), negated.alias("is_negated")).groupBy("sentence_type", "is_negated").agg(F.count("*").alias("n"))


@query(f"""WITH {_tokens(_UTTERANCES)}, j AS (SELECT *, list_distinct([CASE w WHEN ',' THEN 150 WHEN ';' THEN 250 WHEN ':' THEN 250 WHEN '.' THEN 400 WHEN '!' THEN 400 WHEN '?' THEN 400 WHEN '…' THEN 600 WHEN '...' THEN 600 END])[1] AS base,
        count(*) FILTER (upos <> 'PUNCT') OVER (PARTITION BY key) > 15 AS long FROM g)
    SELECT w AS mark, long, least(1000, base + CASE WHEN long AND w NOT IN (',', ';', ':') THEN 100 ELSE 0 END) AS pause_ms, count(*) AS n FROM j WHERE base IS NOT NULL GROUP BY ALL""")
def mark_pauses(spark: SparkSession, sf: str) -> DataFrame:
    """Pauses after the marks of all utterances, each taken as one sentence (97, 98)."""
    rows = table(spark, sf, "utterance").where("text IS NOT NULL").select("utt_id", "text").distinct().withColumn("tokens", layers.rule_tokens(F.col("text")))
    one = F.struct(F.col("text"), F.col("tokens"), F.lit("declarative").alias("sentence_type"))
    out = layers.prosody(rows.select(F.array(one).alias("sentences")), {}).select(F.get("sentences", F.lit(0))["tokens"].alias("tokens"))
    long = F.size(F.filter("tokens", lambda t: t["upos"] != "PUNCT")) > 15
    return out.select(long.alias("long"), F.explode("tokens").alias("t")).where("t.pause_after_ms IS NOT NULL").groupBy(F.col("t.text").alias("mark"), "long", F.col("t.pause_after_ms").alias("pause_ms")).agg(F.count("*").alias("n"))


@query(f"""WITH r AS ({_UTTERANCES}), w AS (SELECT unnest(regexp_extract_all(text, '[{_WORD}]+(?:[-’''][{_WORD}]+)*')) AS w FROM r)
    SELECT part, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS covered FROM (SELECT w, unnest(string_split(w, '-')) AS part FROM w) GROUP BY part""")
def multiword_members(spark: SparkSession, sf: str) -> DataFrame:
    """Words joined by a hyphen as their members, which keep the span of the whole (66)."""
    rows = table(spark, sf, "utterance").where("text IS NOT NULL").select("utt_id", "text").distinct().withColumn("tokens", layers.rule_tokens(F.col("text")))
    word = lambda t: t["upos"] != "PUNCT"
    whole = F.transform(F.filter("tokens", word), lambda t: F.struct(t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), F.when(F.contains(t["text"], F.lit("-")), F.split(t["text"], "-")).alias("expanded")))
    parts = rows.select(F.explode(models.expand_words(whole)).alias("m"))
    return parts.groupBy(F.col("m.text").alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("m.end") - F.col("m.start")).cast("long").alias("covered"))


_SPOKEN = rf"[{_WORD}]+(?:[-’''][{_WORD}]+)*|[^{_WORD}{_BLANK}]"


@query(f"""SELECT key AS utt_id, array_to_string([CASE WHEN NOT regexp_matches(w, '^[\\pL\\pN]') THEN w WHEN lower(w) = 'tva' THEN 'tˈe vˈe ˈa' ELSE replace(translate(lower(w), 'ăâîșțj', 'əɨɨʃ§ʒ'), '§', 'ts') END for w in regexp_extract_all(text, '{_SPOKEN}')], ' ') AS phonemes FROM ({_UTTERANCES})""")
def quick_phonemes(spark: SparkSession, sf: str) -> DataFrame:
    """Pronunciation of all utterances without any other layer (71, 73, 75)."""
    rows = table(spark, sf, "utterance").where("text IS NOT NULL").select("utt_id", "text").distinct()
    return rows.select("utt_id", models.phonetics_only(F.col("text"), models.letter_sounds, name="letters").alias("phonemes"))


@query("""SELECT word, count(*) AS n, replace(translate(word, 'ăâîșțj', 'əɨɨʃ§ʒ'), '§', 'ts') AS phonemes FROM (SELECT unnest(regexp_extract_all(lower(text), '\\pL+')) AS word FROM (SELECT DISTINCT utt_id, text FROM utterance)) GROUP BY word""")
def word_sounds(spark: SparkSession, sf: str) -> DataFrame:
    """Pronunciation of every word: each distinct one passes the model once and is joined back (72)."""
    words = table(spark, sf, "utterance").select("utt_id", "text").distinct().select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    said = models.over_distinct(words, "word", "phonemes", "letters", models.letter_sounds, "string")
    return said.groupBy("word").agg(F.count("*").alias("n"), F.max("phonemes").alias("phonemes"))


def _tagger() -> models.Model:
    return lambda texts: [[(w, upos) for w, _, _, upos, *_ in layers.tagged(t)] for t in texts]


@query(f"WITH {_tokens(_UTTERANCES.replace('WHERE', 'WHERE trim(text) <> chr(0) AND'))} SELECT key AS utt_id, count(*) AS tokens, count(*) FILTER (upos = 'PROPN') AS names FROM g GROUP BY key")
def analyzed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis of all utterances by a model loaded once in a worker and run once for each distinct text (64, 65)."""
    rows = _once(table(spark, sf, "utterance").select("utt_id", "text"), "utt_id")
    out = models.over_distinct(rows, "text", "tokens", "rule_tagger", _tagger, "array<struct<text:string,upos:string>>")
    return out.where("size(tokens) > 0").select("utt_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("tokens", lambda t: t["upos"] == "PROPN")).cast("long").alias("names"))


@query(f"SELECT n, {W.cardinal('n', True)} AS cardinal, 'Are ' || {W.cardinal('n')} || ' la sută.' AS spoken FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n FROM lineitem)")
def functions_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Number words and spoken forms called from SQL (54, 57, 59)."""
    sql.register(spark)
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("n")).distinct()
    return rows.selectExpr("n", "ro_cardinal(n, 'feminine') AS cardinal", "ro_spoken(concat('Are ', n, '%.')) AS spoken")


@query("""SELECT id, 'bulk_added' AS phenomenon, 'unspecified' AS intensity, 'predicted' AS provenance, lower(trim(text_register)) AS label, CAST(0.0 AS DOUBLE) AS draft_confidence FROM (SELECT DISTINCT id, text_register FROM evaluation_example WHERE text IS NOT NULL)""")
def bulk_items(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows as bulk items, which enrichment gives no confidence (159a, 159c)."""
    rows = table(spark, sf, "evaluation_example").where("text IS NOT NULL").select("id", F.lit("t").alias("text"), F.lower(F.trim("text_register")).alias("label")).distinct()
    items = corpus.bulk_item(rows, "text", "label")
    notes = items.select(F.col("id"), F.lit("t").alias("normalized_text"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("sentences"))
    out = corpus.enriched(items, notes.dropDuplicates(["id"]), "id")
    return out.select("id", F.get("phenomena", F.lit(0)).alias("phenomenon"), "intensity.value", "intensity.provenance", "label", "draft_confidence").withColumnRenamed("value", "intensity").distinct()


@query("""SELECT word, array_to_string(list_sort(list_distinct(list(tag))), ' ') AS tags FROM (SELECT lower(trim(source)) AS word, unnest([CASE WHEN list_contains(phenomena, 'numbers') THEN 'joy' END, CASE WHEN length(text) % 2 = 0 THEN 'fear' END]) AS tag FROM evaluation_example WHERE source IS NOT NULL AND upper(source) <> 'NO TRANSLATION')
    WHERE tag IS NOT NULL GROUP BY word""")
def wide_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A word-emotion table with a column of flags for each emotion, its tags united by word (26)."""
    rows = table(spark, sf, "evaluation_example").select("source", F.coalesce(F.array_contains("phenomena", "numbers"), F.lit(False)).alias("Joy"), F.coalesce(F.length("text") % 2 == 0, F.lit(False)).alias("Fear"))
    return readers.lexicon_wide(rows, "source", ["Joy", "Fear"]).select("word", F.array_join("tags", " ").alias("tags"))
