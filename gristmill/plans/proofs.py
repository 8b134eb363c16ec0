"""Queries that parse, simplify, compare and check expressions, and read formulas from markup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import expr, markup
from ..functions import sql as S
from ..operators import relations as R
from ..operators import verify as V
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col

#: Expressions with their values at x = 2, y = 3: what the reader and the evaluator must give.  `{n}` is a part's size.
CASES = (
    ("2+3*4", "14"), ("2(3+4)", "14"), ("-2^2", "-4"), ("2^3^2", "512"), ("|-5|+1", "6"), ("4!/3!", "4"), ("3x+y", "9"), ("x^2y", "12"), ("sqrt(16)+ln(e)", "5"),
    ("max(x,y)-min(x,y)", "1"), ("floor(2.7)+ceil(2.1)", "5"), ("1/(x-2)", "!domain"), ("2+", "!parse"), ("z+1", "!expr"), ("6/2(1+2)", "!expr"), ("ln(-1)", "!domain"),
    ("(x+y)(x-y)", "-5"), ("10^-2*100", "1"), ("sin(0)+cos(0)", "1"), ("round(2.5)", "3"), ("abs(-y)", "3"), ("5-3-1", "1"), ("2*-3", "-6"), ("((7))", "7"),
)
_CASES = "(VALUES " + ", ".join(f"({i}, '{e}', '{v}')" for i, (e, v) in enumerate(CASES)) + ") AS c(k, e, v)"


@book.query(f"SELECT p_partkey, e AS text, v AS value FROM part JOIN {_CASES} ON k = p_partkey % {len(CASES)}")
def parse_cases(spark, t):
    """One expression of many shapes for each part, read and evaluated, or refused by a code."""

    @F.pandas_udf("string")
    def value(s: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            try:
                return expr.fmt(expr.number(text, {"x": 2.0, "y": 3.0}))
            except expr.Refused as e:
                return e.code

        return s.map(one)

    pick = F.element_at(F.array(*(F.lit(e) for e, _ in CASES)), (C("p_partkey") % len(CASES) + 1).cast("int"))
    return t.part.select("p_partkey", pick.alias("text")).withColumn("value", value("text"))


@book.query("SELECT p_partkey, '' || (p_size * 3 + p_partkey % 7) AS value FROM part")
def evalat_cases(spark, t):
    """A value of an expression at a value of its variable."""
    return t.part.select("p_partkey", S.evalat_expr(F.concat(F.lit("3*x+"), (C("p_partkey") % 7).cast("string")), F.lit("x"), C("p_size").cast("string")).alias("value"))


@book.query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_size + 2) || '*x' WHEN 1 THEN '2*x+' || (p_size + 1) WHEN 2 THEN 'x^2+2*x+1' WHEN 3 THEN 'x^3' ELSE '0' END AS plain FROM part")
def simplify_cases(spark, t):
    """One normal form of an expression: terms collected, ordered by degree, rendered."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda text: expr.canonical(expr.parse(text), "x"))

    n, k = C("p_size").cast("string"), C("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("2x+"), n, F.lit("x"))).when(k == 1, F.concat((C("p_size") + 1).cast("string"), F.lit("+x+x"))).when(k == 2, F.lit("(x+1)^2")).when(k == 3, F.lit("x*x*x")).otherwise(F.concat(n, F.lit("x-"), n, F.lit("x")))
    return t.part.select("p_partkey", plain(text).alias("plain"))


@book.query("SELECT p_partkey, p_partkey % 4 < 2 AS same FROM part WHERE p_size > 0")
def equivalent_forms(spark, t):
    """Two forms of a relation agree at twelve random substitutions, or do not."""

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return a.combine(b, V.equivalent).astype(bool)

    n, k = C("p_size").cast("string"), C("p_partkey") % 4
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    a = F.when(k == 0, text("y=(x+", n, ")^2")).when(k == 1, text(n, "*x/y")).when(k == 2, text("(x+", n, ")^2")).otherwise(text(n, "*x/y"))
    b = F.when(k == 0, text("x^2+", (2 * C("p_size")).cast("string"), "*x+", (C("p_size") ** 2).cast("long").cast("string"))).when(k == 1, text("x/(y/", n, ")")).when(k == 2, text("x^2+", (C("p_size") ** 2).cast("long").cast("string"))).otherwise(text(n, "*y/x"))
    return t.part.filter("p_size > 0").select("p_partkey", same(a, b).alias("same"))


@book.query("SELECT p_partkey, true AS holds, false AS spoilt_holds FROM part WHERE p_size > 1")
def antiderivative_checks(spark, t):
    """An integral differentiated back is its integrand at four points; with a term more it is not."""

    @F.pandas_udf("boolean")
    def holds(whole: pd.Series, f: pd.Series) -> pd.Series:
        return whole.combine(f, V.antiderivative_holds).astype(bool)

    f = F.concat(C("p_size").cast("string"), F.lit("*x^2+cos(x)"))
    made = t.part.filter("p_size > 1").select("p_partkey", f.alias("f"), S.integ_expr(f, F.lit("x")).alias("whole"))
    return made.select("p_partkey", holds("whole", "f").alias("holds"), holds(F.concat("whole", F.lit("+x")), "f").alias("spoilt_holds"))


@book.query(f"SELECT ord, CASE WHEN ord IN (26, 27) THEN 'unknown' ELSE 'ok' END AS status, CASE WHEN ord IN (26, 27) THEN 'unknown' ELSE 'fail' END AS spoilt FROM {R.records_sql()}")
def dimension_checks(spark, t):
    """The right side of every relation has the unit that its left side declares; with another it has not.

    Relations 26 and 27 have no single variable on their left, so nothing is declared for it.
    """

    @F.pandas_udf("string")
    def status(formula: pd.Series, variables: pd.Series, units: pd.Series) -> pd.Series:
        return pd.Series([V.dimensions(f, dict(zip(v, u))) for f, v, u in zip(formula, variables, units)])

    other = F.transform("units", lambda u, i: F.when(i == 0, F.when(u == "K", "s").otherwise("K")).otherwise(u))
    return R.records(spark).select("ord", status("formula", "vars", "units").alias("status"), status("formula", "vars", other).alias("spoilt"))


_SHAPES = (("OK", ""), ("OK", ""), ("MISMATCH", "operators"), ("MISMATCH", "missing operand"), ("MISMATCH", "foreign operand"), ("MISMATCH", "argument not read"), ("UNCHECKED", "no rule for this tool"), ("UNCHECKED", "variable without value"), ("MISMATCH", "operands in other places"))


@book.query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(_SHAPES)) + " END AS status, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(_SHAPES)) + " END AS why FROM part")
def shape_reasons(spark, t):
    """Calls against their relation with the values put in: order does not count, and a mismatch has a reason."""

    @F.pandas_udf("status string, why string")
    def shape(formula: pd.Series, values: pd.Series, call: pd.Series) -> pd.DataFrame:
        told = [V.shape(f, dict(v), c) for f, v, c in zip(formula, values, call)]
        return pd.DataFrame([(s, " ".join(w.split()[:2]) if "operand " in w else w) for s, w in told], columns=["status", "why"])

    k, m, v = C("p_partkey") % 9, (C("p_size") + 101).cast("string"), (C("p_partkey") % 7 + 11).cast("string")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    formula = F.when(k == 8, F.lit("r=m/v")).otherwise(F.lit("p=m*v"))
    values = F.when(k == 7, F.create_map(F.lit("m"), m)).otherwise(F.create_map(F.lit("m"), m, F.lit("v"), v))
    call = (
        F.when(k == 1, text("<tool>eval<arg>", v, "*", m, "</tool>")).when(k == 2, text("<tool>eval<arg>", m, "/", v, "</tool>")).when(k == 3, text("<tool>eval<arg>", m, "*3</tool>"))
        .when(k == 4, text("<tool>eval<arg>", m, "*", v, "*3</tool>")).when(k == 5, text("<tool>eval<arg>", m, "*</tool>")).when(k == 6, text("<tool>stat<arg>mean<arg>", m, "</tool>"))
        .when(k == 8, text("<tool>eval<arg>", v, "/", m, "</tool>")).otherwise(text("<tool>eval<arg>", m, "*", v, "</tool>"))
    )
    return t.part.select("p_partkey", shape(formula, values, call).alias("r")).select("p_partkey", "r.status", "r.why")


#: Markup with the infix text and the evaluator's text it must give; `{n}` is a part's size.
FORMULAS = (
    ("<mfrac><msup><mi>v</mi><mn>2</mn></msup><mrow><mn>2</mn><mo>·</mo><mn>{n}</mn></mrow></mfrac>", "v^2/(2*{n})", "v^2/(2*{n})"),
    ("<mrow><mn>{n}</mn><mi>m</mi><mi>v</mi></mrow>", "{n} m v", "{n}*m*v"),
    ("<msqrt><mrow><mi>a</mi><mo>+</mo><mn>{n}</mn></mrow></msqrt>", "sqrt(a+{n})", "sqrt(a+{n})"),
    ("<mroot><mi>x</mi><mn>3</mn></mroot>", "x^(1/3)", "x^(1/3)"),
    ("<mrow><mi>Δ</mi><mi>t</mi><mo>×</mo><mn>{n}</mn></mrow>", "Delta t*{n}", "Delta_t*{n}"),
    ("<msubsup><mi>v</mi><mn>0</mn><mn>2</mn></msubsup>", "v_0^2", "v_0^2"),
    ("<mfrac><mrow><mi>a</mi><mo>−</mo><mi>b</mi></mrow><mi>λ</mi></mfrac>", "(a-b)/lambda", "(a-b)/lambda"),
    ("<munderover><mi>Σ</mi><mrow><mi>i</mi><mo>=</mo><mn>1</mn></mrow><mi>n</mi></munderover>", "sum_(i=1)^n", "sum_*(i=1)^n"),
    ("<mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><mn>{n}</mn></mtd></mtr></mtable>", "a, b; {n}", "a,b;{n}"),
    ("<mrow><mn>2</mn><mo>(</mo><mi>a</mi><mo>+</mo><mi>b</mi><mo>)</mo></mrow>", "2 (a+b)", "2*(a+b)"),
    ("<mfrac><mi>a</mi></mfrac>", None, None),
    ("<mrow><mi>sin</mi><mo>⁡</mo><mfenced><mi>θ</mi></mfenced></mrow>", "sin(theta)", "sin(theta)"),
)
_FORMULAS = "(VALUES " + ", ".join(f"({i}, {'NULL' if a is None else repr(a)}, {'NULL' if b is None else repr(b)})" for i, (_, a, b) in enumerate(FORMULAS)) + ") AS f(k, infix, evaluator)"


@book.query(f"SELECT p_partkey, coalesce(replace(infix, '{{n}}', '' || p_size), 'a') AS infix, coalesce(replace(evaluator, '{{n}}', '' || p_size), 'a') AS evaluator, infix IS NOT NULL AS parsed FROM part JOIN {_FORMULAS} ON k = p_partkey % {len(FORMULAS)}")
def mathml_evaluable(spark, t):
    """Formulas of many shapes in markup to infix text and to what the evaluator reads."""

    @F.pandas_udf("infix string, evaluator string, parsed boolean")
    def read(s: pd.Series) -> pd.DataFrame:
        told = [markup.mathml(x) for x in s]
        return pd.DataFrame([(a, markup.evaluable(a), ok) for a, ok in told], columns=["infix", "evaluator", "parsed"])

    pick = F.element_at(F.array(*(F.lit(m) for m, _, _ in FORMULAS)), (C("p_partkey") % len(FORMULAS) + 1).cast("int"))
    source = F.concat(F.lit("<math>"), F.replace(pick, F.lit("{n}"), C("p_size").cast("string")), F.lit("</math>"))
    return t.part.select("p_partkey", read(source).alias("r")).select("p_partkey", "r.infix", "r.evaluator", "r.parsed")


@book.query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN length('' || p_size) WHEN p_partkey % 3 = 1 THEN length('' || p_size) + 2 ELSE length(ltrim('' || (p_size * 10), '0')) END::INT AS digits FROM part WHERE p_size > 0")
def digits_written(spark, t):
    """Significant digits that a number is written with: leading zeros do not count, those after a point do."""
    n, k = C("p_size").cast("string"), C("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("0.000"), n)).when(k == 1, F.concat(n, F.lit(".00"))).otherwise((C("p_size") * 10).cast("string"))
    bare = F.regexp_replace(F.regexp_replace(text, "[eE].*$|[-+.]", ""), "^0+", "")
    return t.part.filter("p_size > 0").select("p_partkey", F.length(bare).cast("int").alias("digits"))
