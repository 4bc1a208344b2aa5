"""The functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numbers as N


def _or_null(fn, *args):  # noqa: ANN001, ANN002, ANN202
    try:
        return None if any(a is None or a != a for a in args) else fn(*args)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _cardinal(n: pd.Series, gender: pd.Series) -> pd.Series:
    return pd.Series([_or_null(lambda a, g: N.cardinal(int(a), g), a, g) for a, g in zip(n, gender)], dtype=object)


@F.pandas_udf(T.StringType())
def _ordinal(n: pd.Series, gender: pd.Series) -> pd.Series:
    return pd.Series([_or_null(lambda a, g: N.ordinal(int(a), g), a, g) for a, g in zip(n, gender)], dtype=object)


@F.pandas_udf(T.StringType())
def _spoken(texts: pd.Series) -> pd.Series:
    from ..operators.normalize import Cascade

    cascade = Cascade()
    return texts.map(lambda t: cascade.run(t)[0], na_action="ignore")


#: Names and functions: number and gender to a cardinal or ordinal, a sentence to its spoken form.
FUNCTIONS = {"ro_cardinal": _cardinal, "ro_ordinal": _ordinal, "ro_spoken": _spoken}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; values they cannot read are null."""
    for name, fn in FUNCTIONS.items():
        spark.udf.register(name, fn)
    return sorted(FUNCTIONS)
