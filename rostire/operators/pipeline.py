"""Documents in, annotated documents out: the layers a request names, in their order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .layers import default_registry
from .registry import Registry
from .serializers import control_tokens

# The layers of each profile.
PROFILES: dict[str, dict] = {
    "default": {"include": ["clean", "sentences", "normalized"]},
    "normalize_only": {"include": ["normalized"]},
    "pronunciation": {"include": ["normalized", "phonemes", "syllables", "lexical_stress"]},
    "expressive": {"include": ["normalized", "tokens", "emotion", "intensity", "focus", "prosody"]},
}


def load_config(source: str | dict) -> dict:
    """Config from a profile name, a YAML file or a dict; a ``processing`` block may hold the layers.

    Layers named by ``exclude`` are taken from its own ``include``, here and only here.
    """
    if isinstance(source, str):
        if source in PROFILES:
            source = PROFILES[source]
        else:
            import yaml

            with open(source, encoding="utf-8") as f:
                source = yaml.safe_load(f) or {}
    body = {**source, **source["processing"]} if isinstance(source.get("processing"), dict) else dict(source)
    body.pop("processing", None)
    out = set(body.pop("exclude", None) or [])
    body["include"] = [x for x in body.get("include") or [] if x not in out]
    return body


def requested(config: dict, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> list[str]:
    """Layers to run: a call's ``include`` replaces the config's, its ``exclude`` is subtracted.

    An excluded layer still runs if another needs it. Nothing left is an error.
    """
    names = set(config.get("include") or [] if include is None else include) - set(exclude or [])
    if not names:
        raise ValueError("no layer requested")
    return sorted(names)


class Pipeline:
    """Layers of a registry under a config."""

    def __init__(self, config: str | dict = "default", registry: Registry | None = None) -> None:
        self.config = load_config(config)
        self.registry = registry or default_registry()

    def process(
        self, df: DataFrame, text: str = "text", id_col: str | None = None, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None,
        user_focus_words: list[str] | None = None, prosody_overrides: dict | None = None, interjection_mode: str = "suggest", serialize: bool = False,
    ) -> DataFrame:
        """``df`` as annotated documents: the columns of ``result_columns`` and, as ``extra``, those not used.

        Null texts give null layers; nothing is collected and no row is moved.
        """
        if interjection_mode not in ("disabled", "suggest", "insert"):
            raise ValueError(f"unknown interjection mode: {interjection_mode}")
        names = requested(self.config, include, exclude)
        config = {**self.config, "user_focus_words": user_focus_words, "prosody_overrides": prosody_overrides, "interjection_mode": interjection_mode}
        key = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
        out = df.select(key.alias("id"), F.col(text).alias("original_text"))
        for layer in self.registry.resolve(names):
            out = layer.fn(out, config)
        return assemble(out, serialize)


def process(df: DataFrame, profile: str | dict = "default", **kw) -> DataFrame:
    """Annotate ``df`` under a profile or config."""
    return Pipeline(profile).process(df, **kw)


def result_columns() -> list[tuple[str, str]]:
    """Names and types of a result row."""
    return [
        ("schema_version", "string"), ("id", "string"), ("original_text", "string"), ("clean_text", "string"), ("normalized_text", "string"), ("document_style", "string"),
        ("phoneme_text", "string"), ("tts_token_text", "string"), ("sentences", f"array<{S.struct(S.SENTENCE)}>"), ("trace", f"array<{S.struct(S.TRACE)}>"),
        ("warnings", "array<string>"), ("errors", "array<string>"),
    ]


def _sentence(s: Column, have: list[str]) -> Column:
    """A full sentence; its text is the normalized one where there is one."""
    fields = []
    for spec in S._fields(S.SENTENCE):
        name, kind = spec.split(":", 1)
        value = s[name] if name in have else F.lit(None)
        if name == "text" and "normalized" in have:
            value = F.coalesce(s["normalized"], s["text"])
        fields.append(value.cast(kind).alias(name))
    return F.struct(*fields)


def assemble(df: DataFrame, serialize: bool = False) -> DataFrame:
    """One result row for each document; every field that a layer filled is returned, all others are null."""
    have = {f.name: f.dataType for f in df.schema}
    inner = [f.name for f in have["sentences"].elementType.fields] if "sentences" in have else []
    values = {"schema_version": F.lit(S.SCHEMA_VERSION)}
    if inner:
        df = df.withColumn("sentences", F.transform("sentences", lambda s: _sentence(s, inner)))
    warn = F.expr("cast(array() as array<string>)")
    if inner and "tokens" in inner and "phonemes" in [f.name for f in have["sentences"].elementType["tokens"].dataType.elementType.fields]:
        guessed = F.flatten(F.transform("sentences", lambda s: F.transform(F.filter(s["tokens"], lambda t: t["pronunciation_provenance"] == "fallback"), lambda t: F.concat(F.lit("phonemes: no pronunciation for "), t["text"]))))
        warn = F.coalesce(F.array_distinct(guessed), warn)
    values["warnings"] = warn
    blank = {"errors": F.expr("cast(array() as array<string>)"), "trace": F.expr(f"cast(array() as array<{S.struct(S.TRACE)}>)")}
    columns = [values.get(n, F.coalesce(F.col(n), blank[n]) if n in blank and n in have else F.col(n) if n in have else blank.get(n, F.lit(None))).cast(k).alias(n) for n, k in result_columns()]
    out = df.select(*columns)
    return out.withColumn("tts_token_text", control_tokens(F.col("sentences"))) if serialize else out
