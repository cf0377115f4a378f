"""Functions of this library by name in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.text import CUT_MARK, _fixed, _units


@F.pandas_udf(T.IntegerType())
def _lengths(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else len(x.encode("utf-16-le")) // 2 for x in texts], dtype="Int32")


@F.pandas_udf(T.StringType())
def _cuts(texts: pd.Series, most: pd.Series) -> pd.Series:
    def cut(text: str | None, n: int) -> str | None:
        if text is None or len(text.encode("utf-16-le")) <= 2 * n:
            return text
        return _units(text, n * 6 // 10, None) + CUT_MARK + _units(text, None, n - n * 6 // 10)

    return pd.Series([cut(x, int(n)) for x, n in zip(texts, most)], dtype=object)


@F.pandas_udf(T.StringType())
def _decimals(values: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([_fixed(v, int(d)) for v, d in zip(values, digits)], dtype=object)


#: Names in SQL: UTF-16 units of a text; a text with its middle cut to so many units; a number with so many decimals.
SQL_FUNCTIONS = {"cuewright_units": _lengths, "cuewright_cut": _cuts, "cuewright_fixed": _decimals}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; to register them again changes nothing."""
    for name, function in SQL_FUNCTIONS.items():
        spark.udf.register(name, function)
