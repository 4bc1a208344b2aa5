"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import table
from . import copies, groups, languages, leaks, lookalikes, overlaps, packing, samples, sentences


def _latest(df: DataFrame, key: str, order: str, *cols: Column | str) -> DataFrame:
    """The last delivery of each ``key`` by ``order``; among equal ones that with the greatest columns."""
    picked = F.max(F.struct(F.col(order), *cols))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked.alias("x")).select(key, "x.*").drop(order)


def _overlaps(spark: SparkSession, sf: str) -> overlaps.Overlaps:
    return overlaps.cross_split_overlaps(table(spark, sf, "evaluation_example"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a held-out and a training record whose texts are the same or nearly so."""
    ids = _overlaps(spark, sf).id_pairs()
    return ids.select(F.least("held_id", "train_id").alias("id_a"), F.greatest("held_id", "train_id").alias("id_b")).distinct()


def p1_overlap_report(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out records with a counterpart in training, per split and source name."""
    df = table(spark, sf, "evaluation_example")
    o = overlaps.cross_split_overlaps(df)
    most = F.max(F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("covered") / F.col("words"))).alias("share")
    hit = o.members.where("NOT train").join(o.pairs.groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("partners"), most), "cid")
    rows = _latest(df, "id", "ingested_at", F.lower(F.trim("split")).alias("split"), F.lower(F.trim(F.substring_index("source", "#", 1))).alias("source"))
    return (
        rows.where("split <> 'train'").join(hit.select("id", "partners", "share"), "id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.count("partners").alias("overlapping"), F.coalesce(F.max("partners"), F.lit(0)).alias("most_partner_texts"), F.round(F.avg("share"), 4).alias("mean_covered_share"))
    )


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping texts, one row for each pair of classes of equal texts, with coverage and words in order."""
    return _overlaps(spark, sf).pairs.select(F.hex("a").alias("held_out_class"), F.hex("b").alias("train_class"), "words", "covered", "common")


def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every record, for ``p1_pairs``."""
    return _overlaps(spark, sf).members.select("id", "train", F.hex("cid").alias("class"))


def _copies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    records = (
        copies.canonical_records(table(spark, sf, "evaluation_example"), "id", "text", "evaluation_example")
        .unionByName(copies.canonical_records(table(spark, sf, "utterance"), "utt_id", "text", "utterance"))
        .unionByName(copies.canonical_records(table(spark, sf, "raw_record"), "record_id", "payload", "raw_record", json_object=True))
    )
    return copies.collapse(records)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each copy with the smallest key of its group."""
    return _copies(spark, sf)[1].distinct()


def p2_copy_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each record that has copies, with their number."""
    return _copies(spark, sf)[0].withColumnRenamed("n", "copies")


def _suspect_fields(spark: SparkSession, sf: str) -> DataFrame:
    ev, ut = table(spark, sf, "evaluation_example"), table(spark, sf, "utterance")
    return lookalikes.suspect_fields(ev, "id", ["text", "expected_normalized_text"], "evaluation_example").unionByName(
        lookalikes.suspect_fields(ut, "utt_id", ["text"], "utterance")
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that are not yet in consistent form."""
    return lookalikes.inconsistent_fields(_suspect_fields(spark, sf))


def p3_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Text and normalized text of evaluation records and text of utterances in consistent form."""
    ev, ut = table(spark, sf, "evaluation_example"), table(spark, sf, "utterance")
    fields = lookalikes.text_fields(ev, "id", ["text", "expected_normalized_text"], "evaluation_example")
    return lookalikes.in_consistent_form(fields.unionByName(lookalikes.text_fields(ut, "utt_id", ["text"], "utterance")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the records without given boundaries."""
    df = table(spark, sf, "evaluation_example").select("id", "text", "sentence_boundaries")
    model = sentences.fit_segmenter(df)
    return sentences.segment(df.where("sentence_boundaries IS NULL"), model).distinct()


def p4_sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of all documents, by the model fitted on the evaluation records."""
    model = sentences.fit_segmenter(table(spark, sf, "evaluation_example").select("id", "text", "sentence_boundaries"))
    return sentences.segment(table(spark, sf, "documents"), model, "doc_id", "text").withColumnRenamed("id", "doc_id")


def _sample(spark: SparkSession, sf: str) -> samples.CalibratedSample:
    train = _latest(table(spark, sf, "evaluation_example"), "id", "ingested_at", "split", "text_register", F.col("emotion.value").alias("emotion"), "phenomena").where("lower(trim(split)) = 'train'")
    fields = {"text_register": F.array("text_register"), "emotion": F.array("emotion"), "phenomena": F.col("phenomena")}
    return samples.calibrated_sample(train, table(spark, sf, "sampling_target"), fields)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Categories whose target the training records cannot meet."""
    return _sample(spark, sf).report.where("unmet").select("plan_name", "category").distinct()


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn sample of each plan."""
    return _sample(spark, sf).sample


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Targets, expected and drawn numbers of each plan and category."""
    return _sample(spark, sf).report


def _keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev, ut, al = (table(spark, sf, t) for t in ("evaluation_example", "utterance", "source_alias"))
    own = ev.select(F.lit("evaluation_example").alias("tbl"), "id", groups.tidy(F.substring_index("source", "#", 1)).alias("key"), groups.tidy(F.col("split")).alias("split"))
    said = ut.select(F.lit("utterance").alias("tbl"), F.col("utt_id").alias("id"), F.concat(groups.tidy(F.col("corpus")), F.lit("/"), groups.tidy(F.col("speaker"))).alias("key"), groups.tidy(F.col("split")).alias("split"))
    links = al.select(groups.tidy(F.col("alias_name")).alias("a"), groups.tidy(F.col("same_as")).alias("b"))
    return own.unionByName(said), links


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    records, links = _keyed(spark, sf)
    return groups.groups_of(groups.key_splits(records.distinct()), links)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of related records that stand in two or more splits."""
    return groups.spread_groups(_groups(spark, sf)).distinct()


def p6_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """A new split for every record, groups whole, in the proportions 80 : 10 : 10 of all records."""
    return groups.assign_records(*_keyed(spark, sf), {"train": 0.8, "dev": 0.1, "test": 0.1})


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Records and groups of each new split, and the share of all records."""
    per = p6_assignment(spark, sf).groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_key").alias("groups"))
    whole = F.sum("records").over(Window.partitionBy(F.lit(1)))  # a row for each split
    return per.withColumn("share", F.round(F.col("records") / whole, 4))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of every capacity, filled with all documents."""
    counts = packing.token_counts(table(spark, sf, "documents"))
    return packing.fill_containers(counts, table(spark, sf, "container_spec"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(p7_containers(spark, sf), table(spark, sf, "container_spec"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, sf, "documents"), table(spark, sf, "heldout_item"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the held-out items that leaked into them."""
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_item_report(spark: SparkSession, sf: str) -> DataFrame:
    """How far each leaked item stands in the corpus."""
    return leaks.leak_report(_leaks(spark, sf))


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents concerned without the leaked spans."""
    return leaks.remove_leaks(table(spark, sf, "documents"), _leaks(spark, sf))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return languages.language_segments(docs, languages.fit_centroids(docs))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents with several, or with a missing or wrong label."""
    return languages.label_cases(languages.document_languages(_segments(spark, sf))).distinct()


def p9_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of each document with their share of it and a confidence; ``und`` where none is near."""
    return languages.document_languages(_segments(spark, sf)).drop("label")


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of each segment of each document."""
    return _segments(spark, sf).drop("label", "chars")


_ALL = (
    p1_found, p1_overlap_report, p1_pairs, p1_members, p2_found, p2_copy_counts, p3_found, p3_consistent, p4_found, p4_sentence_units, p5_found, p5_sample,
    p5_report, p6_found, p6_assignment, p6_report, p7_containers, p7_fill, p8_found, p8_item_report, p8_cleaned, p9_found, p9_documents, p9_segments,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: SQL for what SQL can state over whole tables; tests hold the rest against brute force.
ORACLES: dict[str, str] = {
    "p5_found": """
        WITH r AS (SELECT DISTINCT id, lower(trim(text_register)) AS reg, lower(trim(emotion.value)) AS emo, phenomena
                   FROM evaluation_example WHERE lower(trim(split)) = 'train' AND id IS NOT NULL),
        n AS (SELECT count(*) AS n FROM r),
        c AS (SELECT 'text_register' AS f, reg AS cat, count(*) AS k FROM r GROUP BY ALL
              UNION ALL SELECT 'emotion', emo, count(*) FROM r GROUP BY ALL
              UNION ALL SELECT 'phenomena', p, count(*) FROM (SELECT DISTINCT id, lower(trim(u)) AS p FROM r, unnest(phenomena) AS t(u)) GROUP BY ALL)
        SELECT DISTINCT plan_name, category
        FROM sampling_target t CROSS JOIN n LEFT JOIN c ON c.f = t.field_name AND c.cat = lower(trim(t.category))
        WHERE coalesce(k, 0) * 1000000 < n * sample_permille * target_permille OR coalesce(k, 0) < min_rows""",
    "p6_found": """
        WITH RECURSIVE e AS (
            SELECT DISTINCT a, b FROM (SELECT lower(trim(alias_name)) AS a, lower(trim(same_as)) AS b FROM source_alias
                                       UNION ALL SELECT lower(trim(same_as)), lower(trim(alias_name)) FROM source_alias)
            WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
        reach AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
        g AS (SELECT node, min(other) AS group_key FROM reach GROUP BY node),
        k AS (SELECT lower(trim(split_part(source, '#', 1))) AS key, lower(trim(split)) AS s FROM evaluation_example WHERE source IS NOT NULL
              UNION ALL SELECT lower(trim(corpus)) || '/' || lower(trim(speaker)), lower(trim(split)) FROM utterance WHERE speaker IS NOT NULL)
        SELECT coalesce(group_key, key) AS group_key FROM k LEFT JOIN g ON g.node = k.key
        GROUP BY 1 HAVING count(DISTINCT s) > 1""",
}
