"""Annotated documents as text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = 0.05


def canonical_json(row: Column) -> Column:
    """A result as JSON with its null fields."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def quantize(value: Column, step: float = STEP) -> Column:
    """Nearest multiple of ``step``; halves go to the even one."""
    return F.round(F.bround(value / step, 0) * step, 2)


def chosen_emotion(s: Column, field: str) -> Column:
    """A field of the smoothed emotion, else of the local one (118)."""
    return F.when(s["context_emotion"].isNotNull(), s["context_emotion"][field]).otherwise(s["emotion"][field])


def _surface(s: Column, mark, plain: str = "text") -> Column:
    """The tokens of a sentence, each as ``mark`` gives it; its text where there are none."""
    return F.when(F.coalesce(F.size(s["tokens"]), F.lit(0)) > 0, F.array_join(F.transform(s["tokens"], mark), " ")).otherwise(s[plain])


def annotated_text(sentences: Column) -> Column:
    """Readable text with ``[FOCUS]`` and annotations in brackets (115)."""

    def line(s: Column) -> Column:
        label = chosen_emotion(s, "label")
        notes = F.concat_ws(
            "; ",
            F.when(label.isNotNull(), F.concat(F.lit("emotion="), label, F.lit(", intensity="), chosen_emotion(s, "intensity"))),
            F.when(s["prosody"]["pause_after_ms"] > 0, F.concat(F.lit("pause="), s["prosody"]["pause_after_ms"].cast("string"), F.lit("ms"))),
        )
        text = _surface(s, lambda t: F.when(t["is_focus"], F.concat(F.lit("[FOCUS] "), t["text"])).otherwise(t["text"]))
        return F.concat(text, F.when(notes != "", F.concat(F.lit(" ["), notes, F.lit("]"))).otherwise(""))

    return F.array_join(F.transform(sentences, line), "\n")


def header(kind: Column, label: Column, level: Column, rate: Column, pitch: Column, energy: Column) -> Column:
    """The lines before a sentence's text; UNSPECIFIED for what is not known."""
    named = lambda name, v: F.concat(F.lit(f"[{name}_"), F.coalesce(F.upper(v), F.lit("UNSPECIFIED")), F.lit("]"))
    number = lambda v: F.format_string("%.2f", quantize(v))
    some = lambda v: F.when(v.isNotNull(), number(v))
    return F.concat_ws("\n", named("SENT", kind), named("EMO", label), named("INT", level), named("RATE", some(rate)), named("PITCH", some(pitch)), named("ENERGY", some(energy)))


def control_tokens(sentences: Column) -> Column:
    """Control-token lines of a document; a pause of zero writes no line (116)."""

    def lines(s: Column) -> Column:
        p = s["prosody"]
        known = F.lit(["declarative", "interrogative", "exclamative", "imperative", "incomplete"])
        kind = F.when(F.array_contains(known, s["sentence_type"]), s["sentence_type"])
        text = _surface(s, lambda t: F.concat(F.when(t["is_focus"], "[FOCUS] ").otherwise(""), F.coalesce(F.nullif(t["phonemes"], F.lit("")), t["text"])))
        stop = F.when(p.isNull(), "[BREAK_UNSPECIFIED]").when(p["pause_after_ms"] > 0, F.concat(F.lit("[BREAK_"), p["pause_after_ms"].cast("string"), F.lit("]")))
        head = header(kind, chosen_emotion(s, "label"), chosen_emotion(s, "intensity"), p["speaking_rate"], p["relative_pitch"], p["relative_energy"])
        return F.concat_ws("\n", head, text, stop)

    body = F.array_join(F.transform(sentences, lines), "\n")
    return F.when(F.size(sentences) > 0, F.concat(body, F.lit("\n"))).when(F.size(sentences) == 0, "")


def parse_control_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each sentence of serialized documents, with quantized values (119).

    Lines before the first sentence header are skipped; keys are assumed unique.
    """
    lines = df.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    tag, value = F.regexp_extract("line", r"^\[([A-Z]+)_(.+)\]$", 1), F.regexp_extract("line", r"^\[([A-Z]+)_(.+)\]$", 2)
    lines = lines.withColumn("tag", tag).withColumn("value", F.when(value != "UNSPECIFIED", value))
    number = F.sum(F.when(F.col("tag") == "SENT", 1).otherwise(0)).over(Window.partitionBy("key").orderBy("at"))
    grouped = lines.withColumn("sentence_index", number - 1).where("sentence_index >= 0").groupBy("key", "sentence_index")
    of = lambda name: F.max(F.when(F.col("tag") == name, F.col("value")))
    plain = F.max_by(F.when(F.col("tag") == "", F.col("line")), F.when(F.col("tag") == "", F.col("at")))
    return grouped.agg(
        F.lower(of("SENT")).alias("sentence_type"), F.lower(of("EMO")).alias("emotion_label"), F.lower(of("INT")).alias("intensity"), of("RATE").cast("double").alias("speaking_rate"),
        of("PITCH").cast("double").alias("relative_pitch"), of("ENERGY").cast("double").alias("relative_energy"), of("BREAK").cast("int").alias("pause_after_ms"), plain.alias("text"),
    ).withColumn("focus_count", F.size(F.regexp_extract_all("text", F.lit(r"\[FOCUS\]"), F.lit(0))))


def ssml_like(sentences: Column) -> Column:
    """A simple SSML-like rendering; nothing is escaped (120)."""

    def line(s: Column) -> Column:
        p = s["prosody"]
        attrs = F.when(p.isNotNull(), F.format_string(' rate="%.2f" pitch="%.2f"', p["speaking_rate"], p["relative_pitch"])).otherwise("")
        body = _surface(s, lambda t: F.when(t["is_focus"], F.concat(F.lit("<emphasis>"), t["text"], F.lit("</emphasis>"))).otherwise(t["text"]))
        stop = F.when(p["pause_after_ms"] > 0, F.format_string('<break time="%dms"/>', p["pause_after_ms"])).otherwise("")
        return F.concat(F.lit('  <s type="'), F.coalesce(s["sentence_type"], F.lit("unspecified")), F.lit('"><prosody'), attrs, F.lit(">"), body, F.lit("</prosody></s>"), stop)

    return F.concat(F.lit("<speak>\n"), F.array_join(F.transform(sentences, line), "\n"), F.when(F.size(sentences) > 0, "\n").otherwise(""), F.lit("</speak>"))
