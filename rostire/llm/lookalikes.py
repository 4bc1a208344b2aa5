"""Problem 3: visually identical text with different characters.

Method: suspect words are mapped to what they look like, grouped in SQL under an accent-sensitive
Unicode collation, one canonical member is chosen per equivalence class, and it is joined back.

* Only texts that hold a suspect character leave the scan (JVM regular expressions); their words are reduced to
  distinct values before anything is shuffled, so hot words cost one row per partition.
* A class is the set of words with equal look under ``UNICODE`` collation (case- and accent-sensitive, blind to how a
  character is encoded), plain words among them. The collation takes equal digits of all scripts for one; they
  look different, so the digits must agree too. The canonical member is the one that stands in consistent form in
  the texts, else the mapped value itself as a virtual member; ties go to the smallest byte string, so the choice
  does not depend on the order of rows.
* Joining back is a left join on the word; the dictionary is broadcast only if Spark measures it small.

Edge cases: null and empty texts are in consistent form; repeated rows and ties change nothing; an
empty table gives an empty result; only named columns are read, so others may have any name.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .textform import SPELT, SUSPECT, consistent, consistent_form, consistent_word, rebuilt

#: Gaps that are no ordinary space, tab or line break, and invisible characters.
ODD = r"[\p{Zs}\p{Cf}\x0b\x0c\x85\x1c-\x1f  ͏︀-️％&&[^\x20؀-؅۝]]"


@F.pandas_udf(T.StringType())
def _look(s: pd.Series) -> pd.Series:
    """What a word looks like: its consistent form without regard to its neighbours."""
    return s.map(lambda w: consistent_word(consistent(w)), na_action="ignore")


def word_classes(words: DataFrame) -> DataFrame:
    """Equivalence classes of distinct words: ``word, canonical`` for each word that is not canonical.

    ``words`` has a column ``word``; nulls are left out.
    """
    spark = words.sparkSession
    look = F.coalesce(_look(F.when(F.col("word").rlike(SUSPECT), F.col("word"))), F.col("word"))
    seen = words.where("word IS NOT NULL").select("word").distinct().withColumn("look", look)
    name = f"rostire_words_{uuid.uuid4().hex}"
    cut(seen, "words").createOrReplaceTempView(name)
    classes = spark.sql(f"""
        WITH classes AS (
            SELECT word, look, look COLLATE UNICODE AS class, regexp_replace(look, '[^\\\\p{{N}}]', '') AS digits FROM {name}
        ), canon AS (
            SELECT class, digits, coalesce(min(CASE WHEN word = look THEN word END), min(look)) AS canonical
            FROM classes GROUP BY class, digits
        )
        SELECT m.word, c.canonical
        FROM classes m JOIN canon c ON m.class = c.class AND m.digits = c.digits
        WHERE m.word <> c.canonical""")
    spark.catalog.dropTempView(name)  # the plan holds the table itself
    return classes


def text_fields(df: DataFrame, key: str, fields: list[str], tbl: str) -> DataFrame:
    """``tbl, rec_key, field_name, value`` of each field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    return df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("rec_key"), F.explode(pairs).alias("x")).select("tbl", "rec_key", "x.field_name", "x.value")


def suspect_fields(df: DataFrame, key: str, fields: list[str], tbl: str) -> DataFrame:
    """``tbl, rec_key, field_name, value`` of each field with a suspect character."""
    return text_fields(df, key, fields, tbl).where(F.col("value").rlike(SUSPECT))


def _words() -> Column:
    """The words of ``value``."""
    return F.regexp_extract_all("value", F.lit(f"({SPELT})"), F.lit(1))


def _suspect_words() -> Column:
    """The words with a suspect character in ``value``."""
    return F.filter(_words(), lambda w: w.rlike(SUSPECT))


def inconsistent_fields(fields: DataFrame) -> DataFrame:
    """Distinct ``tbl, rec_key, field_name`` of fields whose value is not in consistent form.

    ``fields`` is the union of ``suspect_fields``. A word counts if it is not its class's canonical
    member; a gap or an invisible character counts by itself; words that only context unmasks are
    judged with the whole text.
    """
    fields = cut(fields, "suspect")
    words = fields.select(
        "tbl", "rec_key", "field_name", F.col("value").rlike(ODD).alias("odd"),
        F.explode_outer(_suspect_words()).alias("word"),
    )
    classes = word_classes(fields.select(F.explode(_words()).alias("word")))
    hit = (
        words.join(classes, "word", "left")
        .where("odd OR canonical IS NOT NULL")
        .select("tbl", "rec_key", "field_name")
    )
    # Cyrillic and Greek beside Latin letters in one text: only the context tells a disguise.
    mixed = fields.where(F.col("value").rlike(r"[Ͱ-ԯ]") & F.col("value").rlike("[A-Za-z]"))
    hidden = mixed.where(consistent_form(F.col("value")) != F.col("value")).select("tbl", "rec_key", "field_name")
    return hit.unionByName(hidden).distinct()


@F.pandas_udf(T.StringType())
def _rebuilt(value: pd.Series, words: pd.Series, canonical: pd.Series) -> pd.Series:
    return pd.Series([rebuilt(v, dict(zip(w, c))) for v, w, c in zip(value, words, canonical)], dtype=object)


def in_consistent_form(fields: DataFrame) -> DataFrame:
    """Distinct ``tbl, rec_key, field_name, value`` with every value in consistent form; nulls stay null.

    ``fields`` is the union of ``text_fields``. Words are replaced by the canonical members of their classes, joined
    to the words and gathered for each text; plain texts are passed on as they are.
    """
    fields = cut(fields.distinct().withColumn("suspect", F.coalesce(F.col("value").rlike(SUSPECT), F.lit(False))), "fields")
    own = ["tbl", "rec_key", "field_name", "value"]
    words = fields.where("suspect").select(*own, F.explode_outer(F.array_distinct(_suspect_words())).alias("word"))
    swaps = words.join(word_classes(fields.where("suspect").select(F.explode(_words()).alias("word"))), "word", "left").groupBy(*own).agg(F.collect_list(F.when(F.col("canonical").isNotNull(), F.struct("word", "canonical"))).alias("swap"))
    formed = swaps.select(*own[:3], _rebuilt("value", "swap.word", "swap.canonical").alias("value"))
    return fields.where("NOT suspect").select(*own).unionByName(formed).distinct()
