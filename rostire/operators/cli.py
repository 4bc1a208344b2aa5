"""Command line: annotate one text and write its result as JSON or control tokens."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_input_text
from .pipeline import Pipeline
from .serializers import annotated_text, canonical_json, ssml_like


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rostire", description=__doc__)
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--text")
    src.add_argument("--stdin", action="store_true")
    src.add_argument("--input-file")
    p.add_argument("--include", help="layers, separated by commas")
    p.add_argument("--exclude", help="layers, separated by commas")
    p.add_argument("--profile", default="default")
    p.add_argument("--config", help="YAML file")
    p.add_argument("--id")
    p.add_argument("--output-file")
    p.add_argument("--serialize", choices=["json", "control", "annotated", "ssml"], default="json")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run the command; returns the exit code."""
    a = parser().parse_args(argv)
    names = lambda x: [n.strip() for n in x.split(",") if n.strip()] if x else None
    spark = spark or SparkSession.builder.appName("rostire").getOrCreate()
    df = read_input_text(spark, text=a.text, stdin=a.stdin, input_file=a.input_file, doc_id=a.id)
    try:
        out = Pipeline(a.config or a.profile).process(df, "text", "id", names(a.include), names(a.exclude), serialize=a.serialize == "control")
    except (ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    forms = {"json": canonical_json(F.struct(*out.columns)), "control": F.col("tts_token_text"), "annotated": annotated_text(F.col("sentences")), "ssml": ssml_like(F.col("sentences"))}
    text = out.select(forms[a.serialize].alias("x")).first()["x"] or ""
    if a.output_file:
        Path(a.output_file).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
