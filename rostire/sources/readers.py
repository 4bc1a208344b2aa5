"""Sources: corpora, manifests, evaluation rows, lexicons and plain texts as DataFrames."""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCE = "rel_wav string, text string, speaker string"
ANNOTATION = "struct<value:{},provenance:string,confidence:double,note:string>"
EVALUATION = (
    "id string, text string, source string, license string, text_register string, phenomena array<string>, split string, expected_normalized_text string, "
    "sentence_boundaries array<struct<start:int,end:int>>, "
    + ", ".join(f"{n} {ANNOTATION.format(t)}" for n, t in (("emotion", "string"), ("secondary_emotion", "string"), ("intensity", "string"), ("sentence_type", "array<string>"), ("focus_words", "array<string>"), ("pause_locations", "array<struct<offset:int,category:string>>"), ("interjection_appropriate", "boolean"), ("acceptable_interjections", "array<string>")))
    + ", lexical_stress array<struct<word:string,syllables:array<string>,stressed_syllable_index:int,provenance:string,confidence:double>>"
)
CONTEXT = "id string, sentences array<string>, source string, license string, text_register string, split string"
POLICIES = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}


def read_input_text(spark: SparkSession, text: str | None = None, stdin: bool = False, input_file: str | None = None, doc_id: str | None = None) -> DataFrame:
    """One document from exactly one of a text, standard input or a file (9)."""
    if sum((text is not None, stdin, input_file is not None)) != 1:
        raise ValueError("give exactly one of text, stdin and input file")
    if input_file is not None:
        return spark.read.text(input_file, wholetext=True).select(F.lit(doc_id).cast("string").alias("id"), F.col("value").alias("text"))
    return spark.createDataFrame([(doc_id, sys.stdin.read() if stdin else text)], "id string, text string")


def read_documents(spark: SparkSession, path: str, form: str | None = None, text: str = "text", id_col: str | None = None, keep: list[str] | None = None, policy: str = "fail", schema: str | None = None) -> DataFrame:
    """Documents from a file, directory or glob of text, CSV, TSV, JSON lines, JSON or Parquet.

    ``text`` and ``id_col`` map columns, ``keep`` passes others through. ``policy`` says what becomes of
    invalid records: ``fail``, ``skip``, or ``keep`` with the raw record in ``_corrupt_record``.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    form = form or {"txt": "text", "jsonl": "jsonl", "ndjson": "jsonl"}.get(Path(path).suffix.lstrip(".").lower(), Path(path).suffix.lstrip(".").lower() or "text")
    r = spark.read.option("mode", POLICIES[policy])
    own = schema or ", ".join(f"`{c}` string" for c in dict.fromkeys([*([id_col] if id_col else []), text, *(keep or [])]))
    bad = policy == "keep" and form not in ("parquet", "text")
    if bad:
        own += ", _corrupt_record string"
    if form == "text":
        df = r.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
        return df.select(F.col("file_name").alias("id"), "text")
    if form in ("csv", "tsv"):
        df = r.schema(own).option("header", True).option("sep", "\t" if form == "tsv" else ",").option("enforceSchema", False).csv(path) if schema else r.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)
    elif form in ("json", "jsonl"):
        df = r.schema(own).option("multiLine", form == "json").json(path)
    elif form == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format: {form}")
    key = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    extra = [*(keep or []), *(["_corrupt_record"] if bad and "_corrupt_record" in df.columns else [])]
    return df.select(key.alias("id"), F.col(text).cast("string").alias("text"), *extra)


def pipe_lines(lines: DataFrame, delimiter: str = "|") -> DataFrame:
    """``key, rest`` of lines split at the first delimiter, both stripped; blank lines are skipped (10)."""
    at = F.instr("value", delimiter)
    key = F.when(at > 0, F.expr("substring(value, 1, instr(value, '{0}') - 1)".format(delimiter.replace("'", "\\'")))).otherwise(F.col("value"))
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '{0}') + {1})".format(delimiter.replace("'", "\\'"), len(delimiter)))).otherwise("")
    return lines.where(F.trim("value") != "").select(F.trim(key).alias("key"), F.trim(rest).alias("rest"))


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of all files under a folder, without reading them; paths relative to it."""
    base = F.lit("/" + str(Path(root).resolve()).strip("/") + "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.select(F.replace(F.regexp_replace("path", "^file:/*", "/"), base, F.lit("")).alias("path"), "length")


def resolve_suffix(rows: DataFrame, listing: DataFrame, stem: str, suffixes: list[str]) -> DataFrame:
    """``rows`` with ``rel_wav``: the stem with the first suffix that exists, else with the first (12)."""
    options = F.posexplode(F.array(*[F.concat(F.col(stem), F.lit(s)) for s in suffixes]))
    tried = rows.select("*", options.alias("_rank", "_try")).join(listing.select(F.col("path").alias("_try"), F.lit(True).alias("_there")).distinct(), "_try", "left")
    best = F.coalesce(F.min_by("_try", F.when(F.col("_there"), F.col("_rank"))), F.min_by("_try", "_rank"))
    keys = rows.columns
    return tried.groupBy(*keys).agg(best.alias("rel_wav"))


def ljspeech(spark: SparkSession, metadata: str, wav_dir: str = "wavs", speaker: str = "speaker", suffixes: tuple[str, ...] = (".wav", ".WAV"), delimiter: str = "|", root: str | None = None) -> DataFrame:
    """Utterances of a metadata file of ``id|text``; ids that are empty are dropped, no header is skipped (11)."""
    rows = pipe_lines(spark.read.text(metadata), delimiter).where("key <> ''").select(F.concat(F.lit(wav_dir + "/"), "key").alias("stem"), F.col("rest").alias("text"), F.lit(speaker).alias("speaker"))
    listing = file_listing(spark, root) if root else spark.createDataFrame([], "path string, length long")
    return resolve_suffix(rows, listing, "stem", list(suffixes)).select("rel_wav", "text", "speaker")


def central_transcripts(lines: DataFrame) -> DataFrame:
    """``id, text`` of transcript lines ``file, line_no, value``: first separator of ``|``, tab, space; first id wins (14)."""
    sep = F.when(F.contains("value", F.lit("|")), "|").when(F.contains("value", F.lit("\t")), "\t").otherwise(" ")
    at = F.call_function("locate", sep, F.col("value"))
    rows = lines.where((F.trim("value") != "") & (at > 0)).select(F.trim(F.substring("value", F.lit(1), at - 1)).alias("id"), F.trim(F.substring("value", at + 1, F.length("value"))).alias("text"), "file", "line_no")
    return rows.where("id <> ''").groupBy("id").agg(F.min_by("text", F.struct("file", "line_no")).alias("text"))


def swara(spark: SparkSession, root: str) -> DataFrame:
    """Utterances of a corpus with one flat file, or of per-speaker folders with sidecars (13)."""
    flat = Path(root) / "SWARA_ALL.csv"
    if flat.exists():
        return swara_metadata(spark.read.text(str(flat)))
    wavs = file_listing(spark, root).where(F.lower("path").endswith(".wav")).select("path", F.regexp_extract("path", r"^([^/]+)/", 1).alias("speaker"), F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"))
    base = "/" + str(Path(root).resolve()).strip("/") + "/"
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,lab}").text(root, wholetext=True)
    own = texts.select(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), F.lit(base), F.lit("")).alias("file"), F.trim("value").alias("text"))
    side = own.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1)).alias("kind"), "text")
    txt, lab = (side.where(F.col("kind") == k).select("stem", F.col("text").alias(k)) for k in ("txt", "lab"))
    lines = own.where(F.instr("file", "/") == 0).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "value"))
    central = central_transcripts(lines).select(F.col("id").alias("utt"), F.col("text").alias("central"))
    rows = wavs.withColumn("utt", F.regexp_extract("stem", r"([^/]+)$", 1)).join(txt, "stem", "left").join(lab, "stem", "left").join(central, "utt", "left")
    return rows.select(F.col("path").alias("rel_wav"), F.coalesce("txt", "lab", "central").alias("text"), F.lower("speaker").alias("speaker")).where("text IS NOT NULL")


def swara_metadata(lines: DataFrame) -> DataFrame:
    """Utterances of ``file.wav|text`` lines; the speaker is what stands before the first underscore (15)."""
    name = F.regexp_extract("key", r"([^/]+)$", 1)
    speaker = F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"^([^_]*)_", 1)), F.lit("")), F.lit("swara"))
    return pipe_lines(lines).where("key <> ''").select(F.concat(F.lit("wavs/"), name).alias("rel_wav"), F.col("rest").alias("text"), speaker.alias("speaker"))


def common_voice(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of a TSV with client_id, path and sentence (16)."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return common_voice_rows(rows)


def common_voice_rows(rows: DataFrame) -> DataFrame:
    """Rows without sentence or path are dropped; the speaker is ``cv_`` and twelve characters."""
    client = F.coalesce(F.nullif(F.trim("client_id"), F.lit("")), F.lit("unknown"))
    ok = rows.where("trim(coalesce(sentence, '')) <> '' AND trim(coalesce(path, '')) <> ''")
    return ok.select(F.concat(F.lit("clips/"), F.trim("path")).alias("rel_wav"), F.trim("sentence").alias("text"), F.concat(F.lit("cv_"), F.left(client, F.lit(12))).alias("speaker"))


def corpus_root(name: str, root: str | None = None, fallback: str | None = None) -> str:
    """Folder of a corpus: the explicit root, else ``TTS_DATASETS_DIR``, else a fallback; an error if none exists (18)."""
    for base in (root, os.environ.get("TTS_DATASETS_DIR"), fallback):
        if base:
            path = Path(base) if base == root else Path(base) / name
            if path.exists():
                return str(path)
            if base == root:
                break
    raise FileNotFoundError(f"corpus not found: {name}")


#: Corpora by name (17): each takes a session and a folder.
CORPORA = {
    "mara": lambda s, r: ljspeech(s, f"{r}/metadata.csv", speaker="mara", root=r),
    "hria": lambda s, r: ljspeech(s, f"{r}/metadata.csv", speaker="hria", root=r),
    "swara": swara,
    "swara_train": lambda s, r: swara_metadata(s.read.text(f"{r}/metadata_train.csv")),
    "swara_test": lambda s, r: swara_metadata(s.read.text(f"{r}/metadata_test.csv")),
    "common_voice": lambda s, r: common_voice(s, f"{r}/validated.tsv"),
}


def manifest_fields(lines: DataFrame, least: int, col: str = "value") -> DataFrame:
    """``audio_file, phonemes, speaker, emotion`` of manifest lines with at least ``least`` fields (19, 20).

    Fields that are missing or empty are null; with three or more the language is ``ro``.
    """
    parts = F.split(col, r"\|")
    get = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    ok = lines.where((F.trim(col) != "") & (F.size(parts) >= least))
    return ok.select(get(0).alias("audio_file"), F.coalesce(get(1), F.lit("")).alias("phonemes"), get(2).alias("speaker"), get(3).alias("emotion"), F.lit("ro").alias("language"))


def read_jsonl(spark: SparkSession, path: str, schema: str = EVALUATION, policy: str = "fail") -> DataFrame:
    """Evaluation rows, one JSON object a line, under a schema (21)."""
    extra = ", _corrupt_record string" if policy == "keep" else ""
    return spark.read.schema(schema + extra).option("mode", POLICIES[policy]).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of one JSON array (22)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def redv2_rows(raw: DataFrame) -> DataFrame:
    """Usable rows of a multi-annotator emotion set (23).

    ``text, agreed_labels array<int>, labels array<string>, percents array<double>``: texts of 10 to 200
    characters with exactly one agreed label other than trust.
    """
    ok = raw.where((F.length("text").between(10, 200)) & (F.aggregate("agreed_labels", F.lit(0), lambda a, x: a + x) == 1))
    label = F.lower(F.get("labels", F.array_position("agreed_labels", 1).cast("int") - 1))
    out = ok.select("text", label.alias("emotion"), F.map_from_arrays("labels", "percents").alias("procentual_labels"))
    return out.where("emotion <> 'trust'")


def ronec_rows(raw: DataFrame) -> DataFrame:
    """Texts of 20 to 220 characters from tokens and space flags (24, 25)."""
    from ..functions.text import detokenize

    text = raw.withColumn("text", detokenize(F.col("tokens"), F.col("space_after")))
    return text.where(F.length("text").between(20, 220))


def lexicon_tags(rows: DataFrame) -> DataFrame:
    """``word, tags`` of a word-emotion table ``word, emotion, flag``: tags of equal lower-case words unite (26)."""
    ok = rows.where("flag = 1 AND word IS NOT NULL AND upper(word) <> 'NO TRANSLATION'")
    return ok.groupBy(F.lower(F.trim("word")).alias("word")).agg(F.array_sort(F.collect_set("emotion")).alias("tags"))


def lexicon_wide(rows: DataFrame, word: str, flags: list[str]) -> DataFrame:
    """``word, tags`` of a word-emotion table with a word column and one column of flags for each emotion (26)."""
    each = F.explode(F.array(*[F.struct(F.lit(c.lower()).alias("emotion"), F.col(c).cast("int").alias("flag")) for c in flags])).alias("x")
    return lexicon_tags(rows.select(F.col(word).alias("word"), each).select("word", "x.emotion", "x.flag"))


def lexicon_vad(rows: DataFrame, names: tuple[str, str, str, str] = ("word", "valence", "arousal", "dominance")) -> DataFrame:
    """Mean values of each lower-case word (27); other columns than expected are an error."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    w, *axes = names
    return rows.groupBy(F.lower(F.trim(w)).alias("word")).agg(*[F.avg(F.col(a).cast("double")).alias(a) for a in axes])


def dictionary(path: str) -> dict:
    """A YAML dictionary (28); files are small and read on the driver."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def sample_estimate(length: Column) -> Column:
    """Samples of a 16-bit mono file by its size (30)."""
    return F.greatest(F.lit(1), F.floor((length - 44) / 2)).cast("long")
