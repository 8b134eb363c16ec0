"""The tool set as SQL functions: Arrow UDFs, a pandas aggregate and a table function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from . import expr


def _tool(name: str):
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(a is None for a in row) else expr.call(f"<tool>{name}" + "".join(f"<arg>{a}" for a in row) + "</tool>") for row in zip(*args)])

    return run


def _typed(name: str, n: int):
    run = _tool(name)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return pandas_udf({1: one, 2: two, 3: three}[n], T.StringType())


eval_expr, conv_expr, solve_expr, diff_expr, integ_expr = _typed("eval", 1), _typed("conv", 2), _typed("solve", 2), _typed("diff", 2), _typed("integ", 2)
evalat_expr = _typed("evalat", 3)


@pandas_udf(T.StringType())
def tool_call(s: pd.Series) -> pd.Series:
    return s.map(expr.call)


@pandas_udf(T.StringType())
def fmt_num(v: pd.Series) -> pd.Series:
    def one(x: float) -> str:
        try:
            return expr.fmt(x)
        except expr.Refused as e:
            return e.code

    return v.astype(float).map(one)


@pandas_udf(T.DoubleType())
def sem2(v: pd.Series) -> float:
    """Twice the standard error of the mean; NaN below two values."""
    v = v.dropna()
    return float(2 * v.std(ddof=1) / len(v) ** 0.5) if len(v) > 1 else float("nan")


@udtf(returnType=T.StructType([T.StructField("tag", T.StringType()), T.StructField("body", T.StringType()), T.StructField("pos", T.IntegerType())]))
class Spans:
    """Tagged spans of a document: tag, body up to the next tag, position."""

    def eval(self, text: str):
        parts = re.split(r"(<[a-z/]+>)", text or "")
        at = len(parts[0])
        for tag, body in zip(parts[1::2], parts[2::2]):
            yield tag, body, at
            at += len(tag) + len(body)


def register(spark: SparkSession) -> None:
    for name, f in {"eval_expr": eval_expr, "evalat_expr": evalat_expr, "conv_expr": conv_expr, "solve_expr": solve_expr, "diff_expr": diff_expr, "integ_expr": integ_expr, "tool_call": tool_call, "fmt_num": fmt_num, "sem2": sem2}.items():
        spark.udf.register(name, f)
    spark.udtf.register("spans", Spans)
