"""Models that are costly to load or to run: loaded once in a worker, run once for each distinct value.

A text or word that stands in many rows passes the model once and its result is joined back, so a value that a
third of all rows share costs one call. Results may be kept in a Parquet cache, from which later runs take them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as L

#: A model takes the values of a batch and gives a result for each.
Model = Callable[[list[str]], list]

_LOADED: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The model of that name, loaded when a worker first asks for it."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def results_of(values: DataFrame, name: str, load: Callable[[], Model], kind: str) -> DataFrame:
    """``value, result`` of each row of ``values``, whose only column is ``value``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, load)
        for b in batches:
            given = b["value"].tolist()
            yield pd.DataFrame({"value": given, "result": model(given)})

    return values.mapInPandas(run, f"value string, result {kind}")


def _cached(df: DataFrame, path: str) -> DataFrame | None:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None


def over_distinct(df: DataFrame, col: str, out: str, name: str, load: Callable[[], Model], kind: str, cache: str | None = None) -> DataFrame:
    """``df`` with the model's result for ``col`` as ``out``, of type ``kind``.

    Nulls and blank values pass no model and have a null result. ``cache`` is a Parquet folder for one model; new
    results are added to it.
    """
    values = df.select(F.col(col).alias("value")).where(F.length(F.trim("value")) > 0).distinct()
    known = _cached(df, cache) if cache else None
    made = results_of(values if known is None else values.join(known, "value", "left_anti"), name, load, kind)
    if cache:
        made.write.mode("append").parquet(cache)
        made = df.sparkSession.read.parquet(cache)
    found = made.select(F.col("value").alias("_value"), F.col("result").alias(out))
    return df.join(found, F.col(col) == F.col("_value"), "left").drop("_value")


def expand_words(tokens: Column) -> Column:
    """Tokens ``text, start, end, expanded`` with each multi-word token as its members, which inherit its span."""

    def members(t: Column) -> Column:
        here = lambda text: F.struct(text.alias("text"), t["start"].alias("start"), t["end"].alias("end"))
        return F.when(F.size(t["expanded"]) > 0, F.transform(t["expanded"], here)).otherwise(F.array(here(t["text"])))

    return F.flatten(F.transform(tokens, members))


#: Words and single marks, for a pronunciation without a parser.
SPOKEN = re.compile(r"\w+(?:[-’']\w+)*|[^\w\s]")


def phonetics_only(text: Column, load: Callable[[], Model] | None = None, overrides: dict[str, str] | None = None, name: str = "phonetics") -> Column:
    """Pronunciation of each word of a spoken text, marks kept, with no other layer.

    An override wins, then the model's word if it has one, then the word in lower case. The model, if any, is loaded
    once in a worker and sees each distinct word of a batch once.
    """
    fixed = L.PRONUNCIATIONS if overrides is None else overrides

    @F.pandas_udf(T.StringType())
    def say(texts: pd.Series) -> pd.Series:
        split = [None if t is None else SPOKEN.findall(t) for t in texts]
        words = sorted({w for ws in split if ws for w in ws if w[0].isalnum()})
        heard = dict(zip(words, loaded(name, load)(words))) if load and words else {}
        one = lambda w: fixed.get(w.lower(), heard.get(w) or w.lower()) if w[0].isalnum() else w
        return pd.Series([None if ws is None else " ".join(map(one, ws)) for ws in split], dtype=object)

    return say(text)


# Letters of Romanian that are read otherwise than written.
SOUNDS = {"ă": "ə", "â": "ɨ", "î": "ɨ", "ș": "ʃ", "ț": "ts", "j": "ʒ"}


def letter_sounds() -> Model:
    """A small deterministic stand-in for a pronunciation model: one sound for each letter."""
    table = str.maketrans(SOUNDS)
    return lambda words: [w.lower().translate(table) for w in words]
