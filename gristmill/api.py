"""Entry points: what a user or a harness calls, on DataFrames of lines, questions or generations.

From a shell, `python -m gristmill.api eval` runs one call a line without a cluster;
`rank`, `ask`, `prompt`, `grade` and `gen N SEED` start a session."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import expr
from .functions import sql as S
from .operators import relations as R
from .operators import verify
from .plans import cues, gates
from .plans.stores import REFUSES
from .session import ship

C = F.col

#: Share of each class that a corpus must have, with the least and the greatest; fixed values of this repository.
BANDS = {"ANSWER": (0.25, 0.35), "D1": (0.08, 0.12), "D3": (0.08, 0.12), "EXPLAIN": (0.08, 0.12), "C1": (0.08, 0.12), "R1": (0.08, 0.12), "K1": (0.08, 0.12), "F1": (0.08, 0.12)}
#: Keystrokes of a character that a plain key does not give: shift, or a menu.
SHIFTED, MENU = "ABCDEFGHIJKLMNOPQRSTUVWXYZ?!:\"_<>|", "&@#%{}[]\\~`$"


def calls(lines: DataFrame, text: str = "value") -> DataFrame:
    """`lines` with `result`: what each call gives, or its code."""
    return lines.withColumn("result", S.tool_call(text))


def rank(spark: SparkSession, questions: DataFrame, k: int = 3) -> DataFrame:
    """The `k` best relations of each question (columns `id` and `q`): id, rank, ord, name, score."""
    met = cues.meet(spark, cues.read(questions.select("id", "q")))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "ord")
    return met.withColumn("rank", F.row_number().over(best)).filter(C("rank") <= k).select("id", "rank", "ord", "name", "score")


def _sure(spark: SparkSession, questions: DataFrame) -> DataFrame:
    """id, q, ord and formula of each id's best relation; ord and formula are null where it is not sure."""
    ship(spark)
    best = cues.judged(questions, "id", "q").select("id", "top.*")
    sure = (C("relation_bonus") > 0) | (C("bound") & ~C("others")) | ((C("open_words") > 0) & (100 * C("covered") >= 75 * C("open_words")))
    formula = F.get(F.array(*(F.lit(f) for f, _, _ in R.RELATIONS)), C("ord").cast("int"))
    return best.select("id", "q", F.when(sure, C("ord")).alias("ord"), F.when(sure, formula).alias("formula"))


def ask(spark: SparkSession, questions: DataFrame) -> DataFrame:
    """The relation that a question is sure of, or none: id, ord, formula."""
    return _sure(spark, questions).select("id", "ord", "formula")


def prompt(spark: SparkSession, questions: DataFrame) -> DataFrame:
    """id and the prompt of each question, with its relation or with none."""
    none = F.concat(F.lit("<q>"), "q", F.lit("</q><r>none | missing:none | no matching relation | fit:low<a>"))
    return _sure(spark, questions).select("id", F.coalesce(F.concat(F.lit("<q>"), "q", F.lit("</q><r>"), "formula", F.lit(" | missing:none | fit:high<a>")), none).alias("prompt"))


def well_formed(g: Column) -> Column:
    n = lambda tag: F.regexp_count(g, F.lit(tag))
    return g.rlike("(?s)<a>.*<end>") & (n("<tool>") == n("</tool>")) & ((n("<tool>") == 0) | (n("<arg>") >= n("<tool>")))


def _last(g: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(g, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


_NUMBER = "(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"


@F.pandas_udf(T.StringType())
def _shape(formula: pd.Series, said: pd.Series, call: pd.Series) -> pd.Series:
    import re

    def one(f: str | None, q: str | None, c: str | None) -> str:
        values = dict(re.findall(r"([A-Za-z][A-Za-z0-9_]*) = (-?[0-9.]*[0-9])", q or ""))
        return verify.shape(f or "", values, c or "")[0]

    return pd.Series([one(*row) for row in zip(formula, said, call)])


def grade(generations: DataFrame, text: str = "gen") -> DataFrame:
    """`generations` with every grade: form, refusal, result stated, provenance, shape, and all together."""
    g = C(text)
    answer = F.regexp_extract(g, "(?s)<a>(.*?)(<end>|$)", 1)
    result, stated = _last(g, "<res>" + _NUMBER), _last(answer, _NUMBER)
    near = F.abs(stated.try_cast("double") - result.try_cast("double")) <= 0.02 * F.abs(result.try_cast("double"))
    call = F.concat(F.lit("<tool>"), _last(g, "<tool>([^<]*<arg>[^/]*?)</tool>"), F.lit("</tool>"))
    literals = F.regexp_extract_all(F.coalesce(_last(g, "<arg>([^<]*)"), F.lit("")), F.lit("([0-9]+(?:\\.[0-9]+)?)"), F.lit(1))
    known = F.regexp_extract_all(F.substring_index(g, "<tool>", 1), F.lit("([0-9]+(?:\\.[0-9]+)?)"), F.lit(1))
    out = generations.withColumns({
        "well_formed": well_formed(g), "is_refusal": g.rlike(REFUSES), "answer_matches_result": F.when(result.isNotNull(), F.coalesce(near, F.lit(False))),
        "prov_clean": F.size(F.array_except(literals, known)) == 0, "shape_status": _shape(F.regexp_extract(g, "<r>([^|<]*?)(?: \\||<|$)", 1), F.substring_index(g, "<tool>", 1), call),
    })
    ok = C("well_formed") & (C("is_refusal") | (F.coalesce(C("answer_matches_result"), F.lit(False)) & C("prov_clean") & (C("shape_status") != "MISMATCH")))
    return out.withColumn("answer_ok", ok)


def score(items: DataFrame, generations: DataFrame) -> DataFrame:
    """Graded generations joined to items (id, expect: answer or refuse) with `right`."""
    told = grade(generations).join(items, "id")
    return told.withColumn("right", C("well_formed") & F.when(C("expect") == "refuse", C("is_refusal")).otherwise(~C("is_refusal") & C("answer_ok")))


def aggregate(scored: DataFrame, by: str = "expect") -> DataFrame:
    """Rates by arm; an arm without items has no rate."""
    return scored.groupBy(by).agg(F.count("*").alias("n"), F.count_if("right").alias("right"), F.try_divide(F.count_if("right"), F.count("*")).alias("rate"))


def gen(spark: SparkSession, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """`n` documents of all classes as a rule of the seed, and those that were dropped with the reason."""
    size = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(50)).cast("int")
    part = spark.range(n).select((C("id") + seed).alias("p_partkey"), F.concat(F.lit("made part "), C("id").cast("string")).alias("p_name"), size.alias("p_size"))
    made = gates.documents_of(spark, part).filter("corpus = 'clean'").select("id", "kind", "head", "q", "record", "call", "res", "ans")
    whole = F.concat(F.lit("<q>"), "q", F.lit("</q><r>"), "record", "call", F.when(C("res") != "", F.concat(F.lit("<res>"), "res", F.lit("</res>"))).otherwise(""), F.lit("<a>"), "ans", F.lit("<end>"))
    made = made.withColumn("text", whole)
    bad = (C("kind") == "ANSWER") & (C("res").try_cast("double") == 0)
    return made.filter(~bad), made.filter(bad).select("id", F.lit("result is zero").alias("reason"))


def check(documents: DataFrame) -> DataFrame:
    """Composition by class: share, band and status; a class without documents is no pass."""
    spark = documents.sparkSession
    bands = spark.createDataFrame([(k, a, b) for k, (a, b) in BANDS.items()], "kind string, least double, most double")
    shares = documents.groupBy("kind").agg(F.count("*").alias("n")).withColumn("share", C("n") / F.sum("n").over(Window.partitionBy()))
    both = bands.join(shares, "kind", "left")
    status = F.when(C("n").isNull(), "cannot check").when(C("share").between(C("least"), C("most")), "ok").otherwise("fail")
    return both.select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.round("share", 6).alias("share"), status.alias("status"))


def key_cost(text: Column) -> Column:
    """Keystrokes to type a text: one a character, two where a shift is needed, four from a menu."""
    n = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return F.length(text) + n(SHIFTED) + 3 * n(MENU)


def prompt_check(text: Column) -> Column:
    """Why a prompt cannot be sent, or ok."""
    tags = F.regexp_extract_all(text, F.lit("<[a-z/]+>"), F.lit(0))
    return (
        F.when(text.isNull() | (text == ""), "empty").when(text.rlike("[^\\x20-\\x7E]"), "characters").when(F.length(text) > 640, "long")
        .when(~text.startswith("<q>") | ~text.endswith("<a>"), "frame").when(F.size(F.filter(tags, lambda x: x == "</q>")) != 1, "question").otherwise("ok")
    )


def main(args: list[str]) -> int:
    what, lines = args[0] if args else "", (line.rstrip("\n") for line in sys.stdin)
    if what == "eval":
        for line in lines:
            print(expr.call(line))
        return 0
    if what not in ("rank", "ask", "prompt", "grade", "gen"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if what == "gen":
        out = gen(spark, int(args[1]), int(args[2]) if len(args) > 2 else 0)[0].select("text")
    else:
        rows = spark.createDataFrame(list(enumerate(lines)), "id long, q string")
        out = grade(rows.withColumnRenamed("q", "gen")) if what == "grade" else {"rank": rank, "ask": ask, "prompt": prompt}[what](spark, rows)
    for row in out.toLocalIterator():
        print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
