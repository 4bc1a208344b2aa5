"""Sinks: JSON, manifests, training folders and reports."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields kept (31, 34)."""
    df.write.option("ignoreNullFields", False).mode("error").json(path)


def manifest_line(audio: Column, phonemes: Column, speaker: Column, emotion: Column) -> Column:
    """``audio|phonemes|speaker|emotion``; nulls are empty and nothing is escaped (32)."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (audio, phonemes, speaker, emotion)])


def write_manifest(rows: DataFrame, path: str) -> None:
    """Manifest files of ``audio_file, phonemes, speaker, emotion``."""
    rows.select(manifest_line(*[F.col(c) for c in ("audio_file", "phonemes", "speaker", "emotion")]).alias("value")).write.mode("error").text(path)


def write_synthesized(rows: DataFrame, path: str) -> None:
    """``wav|speaker|ref_wav|text`` with a header (35)."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # values go out as they are
    rows.select("wav", "speaker", "ref_wav", "text").write.mode("error").options(sep="|", header=True, **kept).csv(path)


def write_training_folder(manifests: dict[str, DataFrame], audio_root: str, out: str, max_seconds: float | None = None, copy: bool = False) -> DataFrame:
    """Folder of ``wavs/<manifest>__<name>`` and ``metadata.csv`` with header ``audio_file|text`` (33, 124, 125).

    Clips longer than ``max_seconds`` are left out, those whose length cannot be told are kept; links
    are made by the executors, so the folder must be shared. Returns the rows written.
    """
    from ..operators.audio import wav_seconds

    rows = None
    for name, df in manifests.items():
        own = df.select(F.col("audio_file").alias("src"), F.col("phonemes").alias("text"), F.concat(F.lit(f"{name}__"), F.regexp_extract("audio_file", r"([^/]+)$", 1)).alias("dst"))
        rows = own if rows is None else rows.unionByName(own)
    if max_seconds is not None:
        spark = rows.sparkSession
        wavs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(audio_root)
        base = "/" + str(Path(audio_root).resolve()).strip("/") + "/"
        lengths = wavs.select(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(base), F.lit("")).alias("src"), wav_seconds(F.col("content")).alias("seconds"))
        rows = rows.join(lengths, "src", "left").where(within_duration(F.col("seconds"), max_seconds)).drop("seconds")
    target = os.path.join(out, "wavs")
    os.makedirs(target, exist_ok=True)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for src, dst in zip(b["src"], b["dst"]):
                a, z = os.path.abspath(os.path.join(audio_root, src)), os.path.join(target, dst)
                if os.path.exists(a) and not os.path.lexists(z):
                    shutil.copy2(a, z) if copy else os.symlink(a, z)
            yield b[["dst", "text"]]

    done = rows.mapInPandas(link, "dst string, text string").select(F.concat(F.lit("wavs/"), "dst").alias("audio_file"), "text")
    done.write.mode("overwrite").options(sep="|", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(os.path.join(out, "metadata.csv"))
    return done.sparkSession.read.option("sep", "|").option("header", True).option("quote", "").csv(os.path.join(out, "metadata.csv"))


def within_duration(seconds: Column, most: float) -> Column:
    """Whether a clip is kept: short enough, or of unknown length (124)."""
    return seconds.isNull() | (seconds <= most)


def markdown_table(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A small aggregate as a Markdown report (36); more than ``most`` rows are refused, not cut."""
    names = df.columns
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report")
    line = lambda cells: "| " + " | ".join("" if v is None else str(v) for v in cells) + " |"
    return "\n".join([f"# {title}", "", line(names), "|" + "---|" * len(names), *map(line, rows)]) + "\n"
