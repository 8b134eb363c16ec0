"""Queries over formulas, slips, rearrangements, generation loops and inference arithmetic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import expr, markup
from ..operators import synthesis
from ..operators import relations as R
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col


@book.query("SELECT p_partkey, 'v^2/(2*' || p_size || ')' AS infix, true AS parsed FROM part")
def mathml_linear(spark, t):
    """Formulas in presentation markup to infix text, with whether they parsed."""

    @F.pandas_udf("infix string, parsed boolean")
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([markup.mathml(x) for x in s], columns=["infix", "parsed"])

    source = F.concat(F.lit("<math><mfrac><msup><mi>v</mi><mn>2</mn></msup><mrow><mn>2</mn><mo>·</mo><mn>"), C("p_size").cast("string"), F.lit("</mn></mrow></mfrac></math>"))
    return t.part.select("p_partkey", read(source).alias("r")).select("p_partkey", "r.infix", "r.parsed")


@book.query()
def mangled_questions(spark, t):
    """Typing slips with rates, and which of them fired."""

    @F.pandas_udf("text string, fired array<string>")
    def slip(key: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([synthesis.mangle(x, k) for k, x in zip(key, s)], columns=["text", "fired"])

    return t.part.select("p_partkey", slip("p_partkey", F.concat(F.lit("What's the "), "p_name", F.lit("?"))).alias("m")).select("p_partkey", "m.text", F.array_join("m.fired", ",").alias("fired"))


@book.query()
def rearranged(spark, t):
    """Every relation solved for each of its variables, with the check that it solves it."""

    @F.pandas_udf("array<struct<var:string,solved:string>>")
    def turn(s: pd.Series) -> pd.Series:
        def one(f):
            try:
                return [{"var": v, "solved": x} for v, x in synthesis.rearrangements(f)]
            except expr.Refused:
                return []

        return s.map(one)

    return R.store(spark).select("ord", F.explode(turn("formula")).alias("r")).select("ord", "r.var", "r.solved")


@book.query("SELECT p_partkey, '<q>go<tool>eval<arg>' || p_size || '+1</tool><res>' || (p_size + 1) || '</res><a>' || (p_size + 1) || '<end>' AS said FROM part")
def generation_loop(spark, t):
    """A scripted decoder whose complete call is run and whose result is injected."""

    @F.pandas_udf("string")
    def say(n: pd.Series) -> pd.Series:
        def one(k):
            script = iter(["<tool>", "eval", "<arg>", f"{k}+1", "</tool>", "<res>", "<a>", None, "<end>"])

            def step(out):
                token = next(script)
                return token if token is not None else out[out.index("</res>") - 1]

            return "".join(synthesis.generate(step, ["<q>", "go"]))

        return n.map(one)

    return t.part.select("p_partkey", say("p_size").alias("said"))
