"""Corpus building: manifests, selections, deduplication, splits and chunks.

Ranks that choose rows use ``md5(seed:key)``, so a selection is the same wherever it runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_any, dedup_key
from ..runtime import cut
from .layers import unknown_symbols


def manifest_status(text: Column, audio_there: Column, phonemes: Column) -> Column:
    """Why a row is not written, or ``written`` (121)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(text), "empty_text").when(~F.coalesce(audio_there, F.lit(False)), "missing_audio").when(blank(phonemes), "empty_phonemes").otherwise("written")


def build_manifest(utterances: DataFrame, audio: DataFrame | None, phonemes: Column, emotion: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest rows and the counters of each status (121, 122).

    ``utterances`` has rel_wav, text, speaker; ``audio`` has the paths that exist, or is None to take
    all as there. The limit counts written rows, in the order of ``rel_wav``.
    """
    rows = utterances.withColumn("phonemes", phonemes).withColumn("emotion", emotion)
    if audio is not None:
        rows = rows.join(audio.select(F.col("path").alias("rel_wav"), F.lit(True).alias("there")).distinct(), "rel_wav", "left")
    else:
        rows = rows.withColumn("there", F.lit(True))
    rows = rows.withColumn("status", manifest_status(F.col("text"), F.col("there"), F.col("phonemes")))
    odd = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("status") == "written", unknown_symbols(F.col("phonemes")))))))
    stats = rows.groupBy("status").agg(F.count("*").alias("n"), odd.alias("odd_symbols"))
    written = rows.where("status = 'written'").select(F.col("rel_wav").alias("audio_file"), "phonemes", "speaker", "emotion")
    return (written.orderBy("audio_file").limit(limit) if limit is not None else written), stats


def first_emotion(labels: Column) -> Column:
    """First label that says something, else neutral (123)."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x.isNotNull() & (x != "unspecified")), F.lit(0)), F.lit("neutral"))


def training_characters(manifest: DataFrame, punctuation: str = ".,!?;:-…\"' ") -> DataFrame:
    """Characters of a manifest's phonemes that are no punctuation, each once (80)."""
    chars = manifest.select(F.explode(F.split("phonemes", "")).alias("c")).where((F.col("c") != "") & ~F.col("c").isin(list(punctuation)))
    return chars.groupBy("c").agg(F.count("*").alias("n"))


def union_corpora(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several corpora with the name of theirs (125)."""
    return reduce(DataFrame.unionByName, [d.withColumn("corpus_name", F.lit(n)) for n, d in parts.items()])


def first_per_group(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """First row of each group (126); ``min_by`` over a struct, so a hot group is reduced before the shuffle."""
    rest = [c for c in df.columns if c != group]
    best = df.groupBy(group).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("x"))
    return best.select(group, *[F.col(f"x.{c}").alias(c) for c in rest])


def distinct_top(df: DataFrame, text: str, order: str, n: int) -> DataFrame:
    """First ``n`` distinct texts in order of their first place (127)."""
    return df.groupBy(text).agg(F.min(order).alias("first_at")).orderBy("first_at", text).limit(n)


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one with every row of the other (128); for small stated sets such as voices and sentences."""
    return left.crossJoin(right)


def deduplicated(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """First row of each text, whitespace and case aside (130)."""
    return first_per_group(df.withColumn("dedup_key", dedup_key(F.col(text))), "dedup_key", order)


def unused(df: DataFrame, text: str, used: DataFrame, used_text: str, order: list[str]) -> DataFrame:
    """Rows whose text is not among the used ones, each text once (131)."""
    taken = used.select(dedup_key(F.col(used_text)).alias("dedup_key")).where("dedup_key IS NOT NULL").distinct()
    fresh = df.withColumn("dedup_key", dedup_key(F.col(text))).join(taken, "dedup_key", "left_anti")
    return first_per_group(fresh, "dedup_key", order)


def shuffle_rank(key: Column, seed: int) -> Column:
    """Order of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_cap(df: DataFrame, label: str, key: str, most: int = 30, seed: int = 13) -> DataFrame:
    """At most ``most`` rows of each label after a seeded shuffle (132).

    The cap is the feature; a label's rows are first cut down in salted parts, so no task ranks a hot label whole.
    """
    rank = shuffle_rank(F.col(key), seed)
    salted = df.withColumn("_r", rank).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    part = salted.withColumn("_n", F.row_number().over(Window.partitionBy(label, "_s").orderBy("_r", key))).where(F.col("_n") <= most)
    return part.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy("_r", key))).where(F.col("_n") <= most).drop("_r", "_s", "_n")


def numbered(df: DataFrame, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """``df`` with ``rn`` (1-based rank) and ``total`` in each partition, without ranking it in one task.

    Ranks come from range buckets: a rank is the rows in the buckets before plus the rank inside.
    """
    part = partition or []
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    # The bucket of a row must not change between uses, so it is written with the row.
    ranged = cut(ranged, "ranged")
    sizes = ranged.groupBy(*part, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*part)
    before = sizes.select(*part, "_p", (F.sum("_c").over(w.orderBy("_p")) - F.col("_c")).alias("_b"), F.sum("_c").over(w).alias("total"))
    inside = F.row_number().over(Window.partitionBy(*part, "_p").orderBy(*order))
    keys = [*part, "_p"]
    joined = ranged.withColumn("_i", inside).join(before, [ranged[k].eqNullSafe(before[k]) for k in keys] if part else "_p")
    if part:
        for k in keys:
            joined = joined.drop(before[k])
    return joined.withColumn("rn", F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 13) -> DataFrame:
    """``df`` with ``part``: per label the first ``round(n * share)`` rows of a seeded shuffle train (133)."""
    ranked = numbered(df.withColumn("_r", shuffle_rank(F.col(key), seed)), ["_r", key], [label])
    return ranked.withColumn("part", F.when(F.col("rn") <= F.bround(F.col("total") * share, 0), "train").otherwise("heldout")).drop("_r", "rn", "total")


def common_labels(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Rows whose label has at least ``least`` rows (134)."""
    enough = df.groupBy(label).count().where(F.col("count") >= least).select(label)
    return df.join(enough, label, "left_semi")


def positional_split(df: DataFrame, order: list[str], share: float = 0.55, names: tuple[str, str] = ("dev", "test")) -> DataFrame:
    """``df`` with ``part``: the first ``round(share * n)`` rows and the rest (135)."""
    return numbered(df, order).withColumn("part", F.when(F.col("rn") <= F.bround(F.col("total") * share, 0), names[0]).otherwise(names[1])).drop("rn", "total")


def register_of(text: Column, markers: list[str], hit: str = "formal", miss: str = "conversational") -> Column:
    """Register by marker substrings (136)."""
    return F.when(contains_any(text, markers), hit).otherwise(miss)


def chunked(df: DataFrame, order: list[str], text: str, size: int, partition: list[str] | None = None, drop_rest: bool = True) -> DataFrame:
    """Consecutive groups of ``size`` texts (137); a rest that does not fill one is dropped or kept."""
    part = partition or []
    rows = numbered(df, order, part).withColumn("chunk", F.floor((F.col("rn") - 1) / size))
    out = rows.groupBy(*part, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(text).alias("t")))), lambda x: x["t"]).alias("texts"))
    return out.where(F.size("texts") == size) if drop_rest else out


def evenly_spaced(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows at even distances: those at 0-based places ``int(i * total / n)`` (138)."""
    rows = numbered(df, order).withColumn("_at", F.col("rn") - 1)
    want = F.floor(F.col("_i") * F.col("total") / n)
    # A row is wanted if some i below n falls on it; that i lies within one of at * n / total.
    first = F.ceil(F.col("_at") * n / F.col("total"))
    picked = rows.withColumn("_i", first).where((F.col("_i") < n) & (want == F.col("_at")))
    return picked.drop("_at", "_i", "rn", "total")


def lookup_by_text(df: DataFrame, text: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted texts (139); a text that is absent is an error."""
    spark = df.sparkSession
    want = spark.createDataFrame([(t,) for t in dict.fromkeys(wanted)], f"{text} string")
    absent = want.join(df.select(text).distinct(), text, "left_anti").collect()
    if absent:
        raise KeyError(f"not found: {[r[0] for r in absent]}")
    return df.join(want, text)


def reconstitute(df: DataFrame, text: str, order: str, group: str) -> DataFrame:
    """Fragments joined until one ends a sentence (47): gaps and islands over a running count of ends."""
    ends = F.rtrim(F.col(text)).rlike("[.!?…]$").cast("int")
    before = F.coalesce(F.sum(ends).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("island", before).groupBy(group, "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), " ").alias("text"), F.min(order).alias("first_at")
    )


def bulk_item(df: DataFrame, text: str, label: str) -> DataFrame:
    """Evaluation rows of bulk items, with placeholders where nothing is known (159c)."""
    note = lambda v, kind: F.struct(v.cast(kind).alias("value"), F.lit("predicted").alias("provenance"), F.lit(0.0).alias("confidence"), F.lit("bulk").alias("note"))
    return df.select(
        "*", F.array(F.lit("bulk_added")).alias("phenomena"), note(F.lit("unspecified"), "string").alias("intensity"), note(F.array(), "array<string>").alias("focus_words"), note(F.lit(False), "boolean").alias("interjection_appropriate")
    )


def enriched(df: DataFrame, annotated: DataFrame, key: str) -> DataFrame:
    """Items with spoken text and boundaries from the layers (159a); bulk items get no confidence."""
    own = annotated.select(F.col("id").alias(key), F.col("normalized_text").alias("expected_normalized_text"), F.transform("sentences", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("sentence_boundaries"))
    bulk = F.coalesce(F.array_contains("phenomena", "bulk_added"), F.lit(False))
    return df.drop("expected_normalized_text", "sentence_boundaries").join(own, key, "left").withColumn("draft_confidence", F.when(bulk, 0.0).otherwise(0.5))


def sampling_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: the weight under which every label is drawn equally often, one on average."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_labels"))  # one row
    return counts.join(F.broadcast(whole), F.lit(True)).select(label, "n", (F.col("_all") / (F.col("_labels") * F.col("n"))).alias("weight"))


def id_map(df: DataFrame, col: str) -> DataFrame:
    """``col, idx``: the distinct values, numbered from 0 in their order."""
    return numbered(df.where(F.col(col).isNotNull()).select(col).distinct(), [col]).select(col, (F.col("rn") - 1).alias("idx"))
