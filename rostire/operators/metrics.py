"""Evaluation metrics as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import numbered
from .lexicon import LABELS


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``gold, predicted, n`` (140)."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row a gold label, one column a predicted one (140)."""
    return df.groupBy(F.col(gold).alias("gold")).pivot(predicted, labels).agg(F.count(F.lit(1))).na.fill(0)


def label_scores(df: DataFrame, gold: str, predicted: str, labels: list[str] | None = None) -> DataFrame:
    """``label, precision, recall, f1`` over the union of both sides' labels, or over ``labels`` (141)."""
    cells = confusion(df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()), gold, predicted)
    both = F.explode(F.array_distinct(F.array("gold", "predicted"))).alias("label")
    rows = cells.select("gold", "predicted", "n", both)
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g, p = F.col("gold") == F.col("label"), F.col("predicted") == F.col("label")
    out = rows.groupBy("label").agg(n(g & p).alias("tp"), n(~g & p).alias("fp"), n(g & ~p).alias("fn"))
    if labels is not None:
        out = out.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(out, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(
        "label", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")
    )


def macro_f1(df: DataFrame, gold: str, predicted: str, labels: list[str] | None = None) -> DataFrame:
    """Mean F1 of the labels; a label without cases counts zero (141)."""
    return label_scores(df, gold, predicted, labels).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("labels"))


def accuracy_coverage(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Share of right predictions, and of predictions that say something (142)."""
    return df.agg(F.avg((F.col(gold) == F.col(predicted)).cast("int")).alias("accuracy"), F.avg((F.col(predicted) != "unspecified").cast("int")).alias("coverage"), F.count("*").alias("n"))


def brier(df: DataFrame, gold: str, distribution: str, labels: list[str]) -> DataFrame:
    """Multiclass Brier score (143)."""
    term = lambda k: F.pow(F.coalesce(F.try_element_at(F.col(distribution), F.lit(k)), F.lit(0.0)) - (F.col(gold) == k).cast("int"), 2)
    return df.agg(F.avg(reduce(lambda a, b: a + b, map(term, labels))).alias("brier"))


def set_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 of sets in array columns (144)."""
    count = lambda a: F.coalesce(F.sum(F.size(a)), F.lit(0))
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    s = df.agg(count(F.array_intersect(g, p)).alias("tp"), count(F.array_except(p, g)).alias("fp"), count(F.array_except(g, p)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def rate(df: DataFrame, cond: Column, of: Column | None = None) -> DataFrame:
    """How many of the rows that count fulfil a condition, and their share (145, 147)."""
    base = F.lit(True) if of is None else F.coalesce(of, F.lit(False))
    hit, n = F.count_if(base & F.coalesce(cond, F.lit(False))), F.count_if(base)
    return df.agg(hit.alias("hits"), n.alias("n"), F.when(n > 0, hit / n).alias("rate"))


def serialization_checks(df: DataFrame, first: str, second: str, known: str = r"^\[(SENT|EMO|INT|RATE|PITCH|ENERGY|BREAK)_[^\]]+\]$|^\[FOCUS\]$") -> DataFrame:
    """Success, unknown bracket tokens and differences between two runs (146)."""
    odd = F.filter(F.regexp_extract_all(first, F.lit(r"\[[A-Z]+(?:_[^\]\s]+)?\]"), F.lit(0)), lambda x: ~x.rlike(known))
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(first).isNotNull()).alias("succeeded"), F.count_if(F.size(odd) > 0).alias("with_unknown_tokens"), F.count_if(~F.col(first).eqNullSafe(F.col(second))).alias("not_deterministic")
    )


def nearest_rank(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    """Values at the ranks ``round(p * (n - 1))``, halves to even (148)."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).alias("value")), ["value"])
    wanted = F.explode(F.lit([float(p) for p in points])).alias("p")
    return rows.select("value", "rn", "total", wanted).where(F.col("rn") - 1 == F.bround(F.col("p") * (F.col("total") - 1), 0)).select("p", "value")


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """Interpolated median (149)."""
    return df.agg(F.median(value).alias("median"))


def errors_by_layer(df: DataFrame, layers: dict[str, Column]) -> DataFrame:
    """Rows in which each layer failed (150): a layer's column is null or lists errors there."""
    per = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.coalesce(v, F.lit(True)).alias("bad")) for k, v in layers.items()])).alias("x")
    return df.select(per).groupBy("x.layer").agg(F.count("*").alias("runs"), F.count_if("x.bad").alias("errors"))


def exact_match(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Share of equal texts, and mean share of gold tokens at the same place."""
    g, p = F.split(gold, " "), F.split(predicted, " ")
    same = F.size(F.filter(F.zip_with(g, p, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    return df.where(F.col(gold).isNotNull()).agg(F.avg((F.col(gold) == F.coalesce(predicted, F.lit(""))).cast("int")).alias("exact"), F.avg(F.coalesce(same, F.lit(0)) / F.size(g)).alias("token_accuracy"))


def boundary_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of boundary offsets in arrays."""
    return set_scores(df, gold, predicted)


def phoneme_error_rate(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Edits over gold symbols."""
    return df.agg((F.sum(F.levenshtein(gold, predicted)) / F.sum(F.length(gold))).alias("per"))


def mean_absolute_error(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Mean absolute difference."""
    return df.agg(F.avg(F.abs(F.col(gold) - F.col(predicted))).alias("mae"))


def weighted_kappa(df: DataFrame, gold: str, predicted: str, levels: list[str]) -> DataFrame:
    """Quadratic weighted kappa over ordered levels."""
    place = lambda c: F.array_position(F.lit(levels), F.col(c)).cast("double")
    rows = df.where(F.col(gold).isin(levels) & F.col(predicted).isin(levels)).select(place(gold).alias("g"), place(predicted).alias("p"))
    s = rows.agg(F.avg(F.pow(F.col("g") - F.col("p"), 2)).alias("o"), F.avg("g").alias("mg"), F.avg("p").alias("mp"), F.avg(F.pow("g", 2)).alias("g2"), F.avg(F.pow("p", 2)).alias("p2"))
    expected = F.col("g2") + F.col("p2") - 2 * F.col("mg") * F.col("mp")
    return s.select(F.when(expected > 0, 1 - F.col("o") / expected).otherwise(1.0).alias("kappa"))


def calibration_error(df: DataFrame, confidence: str, right: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins))
    per = df.where(F.col(confidence).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(right.cast("int")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def run_summary(df: DataFrame) -> DataFrame:
    """One row about an annotated run: documents, warnings, errors, and a checksum that ignores order."""
    return df.agg(
        F.count("*").alias("documents"), F.sum(F.size(F.coalesce("warnings", F.array().cast("array<string>")))).alias("warnings"), F.count_if(F.size("errors") > 0).alias("failed"),
        F.bit_xor(F.xxhash64("id", "normalized_text")).alias("checksum"),
    )


def adopt(new_f1: float, old_f1: float, new_brier: float, gain: float = 0.03, most: float = 0.5) -> tuple[bool, str]:
    """Whether a new classifier replaces the old one, and why (152)."""
    if new_f1 - old_f1 < gain:
        return False, f"macro F1 gains {new_f1 - old_f1:.3f}, less than {gain}"
    if new_brier > most:
        return False, f"Brier score {new_brier:.3f} is above {most}"
    return True, "adopted"


def rule_features(sentences: Column) -> Column:
    """What the emotion layer says of a text's first sentence, as numbers (151).

    The distribution over the labels but neutral, valence, arousal, negation, and one number for each sentence type.
    """
    s = F.get(sentences, F.lit(0))
    e = s["emotion"]
    given = lambda c, d: F.coalesce(c.cast("double"), F.lit(d))
    negated = F.exists(s["tokens"], lambda t: F.coalesce(F.try_element_at(t["feats"], F.lit("Polarity")) == "Neg", F.lit(False)))
    kinds = [given((s["sentence_type"] == k).cast("int"), 0.0) for k in ("declarative", "interrogative", "exclamative", "imperative", "incomplete")]
    return F.array(*[given(F.try_element_at(e["distribution"], F.lit(k)), 0.0) for k in LABELS if k != "neutral"], given(e["valence"], 0.5), given(e["arousal"], 0.5), given(negated.cast("int"), 0.0), *kinds)


def train_text_classifier(df: DataFrame, text: str, label: str, features: int = 1500, rules: str | None = None):
    """TF-IDF of word 1- and 2-grams with class-balanced logistic regression (151).

    ``rules`` is a column with a vector of further features. Expects a ``text`` and a ``label`` column; returns the fitted ``pyspark.ml`` pipeline model, whose
    ``predicted`` column holds labels.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler

    counts = df.groupBy(label).count()
    n, k = df.count(), counts.count()
    weighted = df.join(counts.select(label, (F.lit(n) / (k * F.col("count"))).alias("weight")), label)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(weighted)
    stages = [
        index, RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\w+", gaps=False), NGram(n=2, inputCol="_w", outputCol="_b"),
        CountVectorizer(inputCol="_w", outputCol="_cw", vocabSize=features), CountVectorizer(inputCol="_b", outputCol="_cb", vocabSize=features),
        VectorAssembler(inputCols=["_cw", "_cb"], outputCol="_c"), IDF(inputCol="_c", outputCol="_t"), VectorAssembler(inputCols=["_t", *([rules] if rules else [])], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=30, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(weighted)
