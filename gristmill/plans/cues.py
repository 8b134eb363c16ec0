"""Ranking of relations for questions by single cues, their controls, and the rules of certainty.

Questions are made from the whole part table; each meets the store of relations, a
dimension of fixed length that is broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relations as R
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col

#: Question of a part about the relation `p_partkey % 30`, in an SQL that Spark and the oracle read alike.
ASKED = (
    "CASE p_partkey % 8 WHEN 0 THEN 'Given ' || given || ', find ' || lhs || '.' WHEN 1 THEN 'What is the ' || name || '?' WHEN 2 THEN 'Solve ' || formula || ' for ' || lhs || '.' "
    "WHEN 3 THEN 'What is the derivative of ' || rhs || ' with respect to x?' WHEN 4 THEN 'What was ' || lhs || ' when ' || given || '?' WHEN 5 THEN 'Where ' || given || ', how large is a ' || name || ' in 3 m/s at I?' "
    "WHEN 6 THEN 'If ' || given || ', how about T and q of it?' ELSE 'How long is the ' || p_name || ' in m/s?' END"
)
STOP = [*X.ASK_VERBS, *X.FUNCTION_WORDS, "respect", "given", "large", "about"]
GIVEN = "([A-Za-z][A-Za-z0-9_]*) = -?[0-9.]+"
TOKEN = "(?:^|[^A-Za-z0-9_.])([A-Za-z][A-Za-z0-9_]*)"
#: Single letters that name no variable: units, possessives, articles that do not end a clause.
EXEMPT = ("([0-9/^*]) ?([A-Za-z])([^A-Za-z0-9_]|$)", "(^|[^A-Za-z0-9_.])([A-Za-z])([/^*])", "(') ?([A-Za-z])([^A-Za-z0-9_]|$)", "(^|[^A-Za-z0-9_.])([aAI])( +[^ ?.,;:!]|[^ A-Za-z0-9_?.,;:!])")

_n = len(R.RELATIONS)
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_left = "q"
for _p in EXEMPT:
    _left = f"regexp_replace({_left}, '{_p.replace(chr(39), chr(39) * 2)}', '\\1 \\3', 'g')"
_ALL = _list(sorted({v for d in R.dimension()[1] for v in d[R.dimension()[0].index("vars")]}))
_hit = lambda c: f"len(list_filter({c}, lambda x: list_contains(qw, x)))::BIGINT"
_SCORED = f"""WITH rel AS (SELECT * FROM {R.records_sql()}), asked AS (SELECT p_partkey, p_partkey % {_n} AS source, {ASKED} AS q FROM part JOIN rel ON ord = p_partkey % {_n}),
  words AS (SELECT *, list_distinct(regexp_extract_all(lower(q), '[a-z]{{3,}}')) AS qw, translate(q, ' ()', '') AS nq, list_distinct(regexp_extract_all(q, '{GIVEN}', 1)) AS have, regexp_extract_all({_left}, '{TOKEN}', 1) AS tokens FROM asked),
  met AS (SELECT *, {_hit('words')} AS matched, len(words)::BIGINT AS terms, coalesce(list_sum([CASE WHEN list_contains(qw, words[i]) THEN weights[i] ELSE 0 END for i in range(1, len(words) + 1)]), 0)::BIGINT AS name_score,
    CASE WHEN length(nf) >= 4 AND contains(nq, nf) THEN 48 * length(nf) ELSE 0 END + CASE WHEN op AND contains(nq, nr) THEN 48 * length(nr) ELSE 0 END AS relation_bonus,
    32 * {_hit('asked')} + 16 * {_hit('mentioned')} AS family_cue, 48 * {_hit('nouns')} AS noun_cue, 32 * {_hit('other_asked')} + 16 * {_hit('other_mentioned')} AS family_control, 48 * {_hit('other_nouns')} AS noun_control,
    len(list_filter(free, lambda x: list_contains(have, x)))::BIGINT AS used, len(free)::BIGINT AS inputs,
    len(list_filter(qw, lambda x: NOT list_contains({_list(STOP)}, x)))::BIGINT AS open_words, len(list_filter(qw, lambda x: list_contains(words, x) AND NOT list_contains({_list(STOP)}, x)))::BIGINT AS covered
    FROM words CROSS JOIN rel),
  scored AS (SELECT *, name_score * matched * matched // (terms * terms) AS coverage_bonus, name_score * matched * matched // (other_terms * other_terms) AS coverage_control, 16 * used + 32 * used * used // (inputs * inputs) AS supplied,
    len(have) > 0 AND len(have) = inputs AND used = inputs AS bound, list_contains(tokens, lhs) AS named,
    len(list_filter(tokens, lambda x: x <> lhs AND NOT list_contains(have, x) AND list_contains({_ALL}, x))) > 0 AS others FROM met),
  totals AS (SELECT *, name_score + coverage_bonus + relation_bonus + family_cue + noun_cue + supplied AS score FROM scored),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, ord) AS rank FROM totals)"""


def _hits(c: str) -> Column:
    return F.size(F.filter(c, lambda x: F.array_contains("qw", x))).cast("long")


def asked(spark, t) -> DataFrame:
    """Questions with their words, given variables and the tokens that may name a variable."""
    return read(posed(spark, t))


def posed(spark, t) -> DataFrame:
    """The question of each part, as text."""
    return t.part.withColumn("source", C("p_partkey") % _n).join(F.broadcast(R.records(spark)), C("source") == C("ord")).select("p_partkey", "source", F.expr(ASKED).alias("q"))


def read(questions: DataFrame) -> DataFrame:
    """`questions` (with text `q`) and what ranking reads in them."""
    left = C("q")
    for p in EXEMPT:
        left = F.regexp_replace(left, p, "$1 $3")
    return questions.select(
        "*", F.array_distinct(F.regexp_extract_all(F.lower("q"), F.lit("[a-z]{3,}"), F.lit(0))).alias("qw"), F.translate("q", " ()", "").alias("nq"),
        F.array_distinct(F.regexp_extract_all("q", F.lit(GIVEN), F.lit(1))).alias("have"), F.regexp_extract_all(left, F.lit(TOKEN), F.lit(1)).alias("tokens"),
    )


def scored(spark, t) -> DataFrame:
    return meet(spark, asked(spark, t))


def meet(spark, questions: DataFrame) -> DataFrame:
    """Every question (as `read` gives it) with every relation and all cues."""
    met = questions.crossJoin(F.broadcast(R.records(spark)))  # a dimension of fixed length
    stop = F.array(*map(F.lit, STOP))
    variables = F.array(*map(F.lit, sorted({v for r in R.DECLARED for v in (x.split(" ")[0] for x in r.split(", "))})))
    met = met.withColumns({
        "matched": _hits("words"), "terms": F.size("words").cast("long"),
        "name_score": F.aggregate(F.zip_with("words", "weights", lambda w, x: F.when(F.array_contains("qw", w), x).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x),
        "relation_bonus": F.when((F.length("nf") >= 4) & C("nq").contains(C("nf")), 48 * F.length("nf")).otherwise(0) + F.when(C("op") & C("nq").contains(C("nr")), 48 * F.length("nr")).otherwise(0),
        "family_cue": 32 * _hits("asked") + 16 * _hits("mentioned"), "noun_cue": 48 * _hits("nouns"),
        "family_control": 32 * _hits("other_asked") + 16 * _hits("other_mentioned"), "noun_control": 48 * _hits("other_nouns"),
        "used": F.size(F.array_intersect("free", "have")).cast("long"), "inputs": F.size("free").cast("long"), "open": F.array_except("qw", stop),
    })
    met = met.withColumns({
        "coverage_bonus": F.expr("name_score * matched * matched div (terms * terms)"), "coverage_control": F.expr("name_score * matched * matched div (other_terms * other_terms)"),
        "supplied": F.expr("16 * used + 32 * used * used div (inputs * inputs)"), "bound": (F.size("have") > 0) & (F.size("have") == C("inputs")) & (C("used") == C("inputs")),
        "named": F.array_contains("tokens", C("lhs")), "others": F.exists("tokens", lambda x: (x != C("lhs")) & ~F.array_contains("have", x) & F.array_contains(variables, x)),
        "open_words": F.size("open").cast("long"), "covered": F.size(F.array_intersect("open", "words")).cast("long"),
    })
    return met.withColumn("score", F.expr("name_score + coverage_bonus + relation_bonus + family_cue + noun_cue + supplied"))


@lru_cache(1)
def _sheet() -> SimpleNamespace:
    """What each word and each variable of the store adds to each relation: matrices with a column a relation."""
    columns, rows = R.dimension()
    store = [dict(zip(columns, row)) for row in rows]
    if len(store) > 62:
        raise ValueError("sets of relations are the bits of a long")
    words = sorted({w for r in store for c in ("words", "asked", "mentioned", "nouns") for w in r[c]} | set(STOP))
    names = sorted({v for r in store for v in [r["lhs"], *r["vars"]]})

    def summed(vocabulary: list[str], of) -> np.ndarray:
        out = np.zeros((len(vocabulary), len(store)))
        for i, r in enumerate(store):
            for w, x in of(r):
                out[vocabulary.index(w), i] += x
        return out

    adds = {
        "matched": lambda r: ((w, 1) for w in r["words"]), "name_score": lambda r: zip(r["words"], r["weights"]), "noun_cue": lambda r: ((w, 48) for w in r["nouns"]),
        "family_cue": lambda r: [*((w, 32) for w in r["asked"]), *((w, 16) for w in r["mentioned"])], "covered": lambda r: ((w, 1) for w in r["words"] if w not in STOP),
    }
    formulas = [r["formula"] for r in store]
    return SimpleNamespace(
        words=pa.array(words), adds=list(adds), by_word=np.concatenate([summed(words, f) for f in adds.values()], axis=1), stop=np.array([w in STOP for w in words]),
        names=pa.array(names), free=summed(names, lambda r: ((v, 1) for v in r["free"])), lhs=np.array([names.index(r["lhs"]) for r in store]), variable=np.array([any(v in r["vars"] for r in store) for v in names]),
        terms=np.array([len(r["words"]) for r in store]), inputs=np.array([len(r["free"]) for r in store]), bit=np.array([1 << formulas.index(f) for f in formulas]),
        parts=[(i, r[c]) for i, r in enumerate(store) for c, held in (("nf", len(r["nf"]) >= 4), ("nr", r["op"])) if held],
    )


def _held(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of `vocabulary` each list holds, and the lists' lengths; null lists are empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = pc.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), len(vocabulary)))
    out[np.repeat(np.arange(len(sizes)), sizes)[at >= 0], at[at >= 0]] = 1
    return out, sizes


JUDGED = "score long, ord long, relation_bonus long, bound boolean, others boolean, covered long, open_words long, bound_set long, pick_score long, pick long, pick_others boolean, pick_set long"


def _judge(qw: pa.Array, nq: pa.Array, have: pa.Array, tokens: pa.Array) -> list[pa.Array]:
    """The columns JUDGED of some questions: the cues of `meet` with all relations at once."""
    s = _sheet()
    told, n_words = _held(qw, s.words)
    given, n_given = _held(have, s.names)
    said, _ = _held(tokens, s.names)
    cue = dict(zip(s.adds, np.split((told @ s.by_word).astype(np.int64), len(s.adds), axis=1)))
    used = (given @ s.free).astype(np.int64)
    bonus = np.zeros(used.shape, np.int64)
    for i, part in s.parts:
        bonus[:, i] += 48 * len(part) * pc.match_substring(nq, part).fill_null(False).to_numpy(zero_copy_only=False)
    score = cue["name_score"] + cue["name_score"] * cue["matched"] ** 2 // s.terms**2 + bonus + cue["family_cue"] + cue["noun_cue"] + 16 * used + 32 * used**2 // s.inputs**2
    bound = (n_given[:, None] > 0) & (n_given[:, None] == s.inputs) & (used == s.inputs)
    open_names = (said > 0) & (given == 0) & s.variable
    others = open_names.sum(1)[:, None] - open_names[:, s.lhs] > 0
    named = bound & (said[:, s.lhs] > 0)
    row, best, pick = np.arange(len(score)), score.argmax(1), np.where(named, score, -1).argmax(1)
    none = ~named.any(1)
    union = lambda held: np.bitwise_or.reduce(np.where(held, s.bit, 0), axis=1)
    n_open = n_words - (told[:, s.stop] > 0).sum(1)
    out = [pa.array(x) for x in (score[row, best], best, bonus[row, best], bound[row, best], others[row, best], cue["covered"][row, best], n_open, union(bound))]
    return [*out, *(pa.array(x, mask=none) for x in (score[row, pick], pick, others[row, pick])), pa.array(union(named))]


def _judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in JUDGED.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            kept = part.schema.names[:-4]
            yield pa.RecordBatch.from_arrays([*part.columns[:-4], *(x.cast(t) for x, t in zip(_judge(*part.columns[-4:]), _ARROW))], names=[*kept, *names])


_ARROW = [pa.bool_() if f.endswith("boolean") else pa.int64() for f in JUDGED.split(", ")]


def judged(questions: DataFrame, key: str, *keep: str) -> DataFrame:
    """One row per `key`: its best relation (`top`, with `keep` of that question), the best of those that the givens bind
    and the question names (`own`), and the sets of formulas (bits) that are bound and that are bound and named.

    The cues and the order are those of `meet` and `ranked`, but a question meets the whole store in matrices of an
    Arrow batch; no row is made per question and relation.
    """
    dealt = questions.select(*dict.fromkeys((key, *keep, "q"))).repartition(F.xxhash64(key, "q"))  # a table of one file is one task
    known = read(dealt).select(key, *keep, "qw", "nq", "have", "tokens")
    rows = known.mapInArrow(_judge_all, ", ".join([*(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in (key, *keep)), JUDGED]))
    top = F.struct("score", (-C("ord")).alias("least"), "ord", "relation_bonus", "bound", "others", "covered", "open_words", *keep)
    own = F.when(C("pick").isNotNull(), F.struct("pick_score", (-C("pick")).alias("least"), C("pick").alias("ord"), C("pick_others").alias("others")))
    return rows.groupBy(key).agg(F.max(top).alias("top"), F.max(own).alias("own"), F.bit_or("bound_set").alias("bound_set"), F.bit_or("pick_set").alias("pick_set"))


def ranked(spark, t) -> DataFrame:
    best = Window.partitionBy("p_partkey").orderBy(F.desc("score"), "ord")
    return scored(spark, t).withColumn("rank", F.row_number().over(best))


@book.query(f"{_SCORED} SELECT p_partkey, ord, CAST(matched * 1000 // terms AS BIGINT) AS milli, matched - (SELECT coalesce(max(b.matched), 0) FROM totals b WHERE b.p_partkey = a.p_partkey AND b.ord <> a.ord) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY matched DESC, ord) AS r FROM totals) a WHERE r = 1")
def rank_band(spark, t):
    """The simple ranker: share of name words matched, and the margin of matches to the second."""
    by = Window.partitionBy("p_partkey").orderBy(F.desc("matched"), "ord")
    two = scored(spark, t).select("p_partkey", "ord", "matched", "terms").withColumn("r", F.row_number().over(by)).filter("r <= 2")
    pick = lambda c, r: F.max(F.when(C("r") == r, C(c)))
    top = two.groupBy("p_partkey").agg(pick("ord", 1).alias("ord"), pick("matched", 1).alias("m"), pick("terms", 1).alias("n"), F.coalesce(pick("matched", 2), F.lit(0)).alias("second"))
    return top.select("p_partkey", "ord", F.expr("m * 1000 div n").alias("milli"), (C("m") - C("second")).alias("margin"))


def _cue(column: str):
    """A cue by itself, where it says anything."""

    def cue(spark, t):
        return scored(spark, t).filter(C(column) > 0).select("p_partkey", "ord", C(column).cast("long").alias("points"))

    cue.__name__ = f"rank_{column}"
    return book.query(f"{_SCORED} SELECT p_partkey, ord, CAST({column} AS BIGINT) AS points FROM totals WHERE {column} > 0")(cue)


for _column in ("relation_bonus", "coverage_bonus", "family_cue", "noun_cue", "supplied"):
    _cue(_column)


@book.query(f"{_SCORED} SELECT p_partkey, ord, CAST(score AS BIGINT) AS score, rank FROM ranked WHERE rank <= 3")
def rank_relations(spark, t):
    """All cues together: the three best relations of a question."""
    return ranked(spark, t).filter("rank <= 3").select("p_partkey", "ord", "score", "rank")


_MODES = {"names": "name_score", "coverage": "name_score + coverage_bonus", "coverage_control": "name_score + coverage_control", "family": "name_score + family_cue", "family_control": "name_score + family_control", "noun": "name_score + noun_cue", "noun_control": "name_score + noun_control"}


@book.query(f"{_SCORED} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS asked, count(*) FILTER (ord = source) AS right_first FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY {e} DESC, ord) AS r FROM totals) WHERE r = 1" for m, e in _MODES.items()))
def rank_controls(spark, t):
    """Questions whose relation comes first by each cue, and by the same cue of another relation."""
    best = scored(spark, t).groupBy("p_partkey", "source").agg(*(F.max(F.struct(F.expr(e).alias("s"), (-C("ord")).alias("o"))).alias(m) for m, e in _MODES.items()))
    each = best.select("source", F.explode(F.map_from_arrays(F.array(*map(F.lit, _MODES)), F.array(*(-C(f"{m}.o") for m in _MODES)))).alias("mode", "ord"))
    return each.groupBy("mode").agg(F.count("*").alias("asked"), F.count_if(C("ord") == C("source")).alias("right_first"))


@book.query(f"{_SCORED} SELECT p_partkey, ord FROM ranked WHERE rank = 1 AND relation_bonus > 0")
def confident_relation(spark, t):
    """The best relation stands in the question, whole or by its right side."""
    return ranked(spark, t).filter("rank = 1 and relation_bonus > 0").select("p_partkey", "ord")


_PICK = "picked AS (SELECT p_partkey, arg_max(ord, score * 100 - ord) AS ord, arg_max(others, score * 100 - ord) AS others FROM totals WHERE bound AND named GROUP BY 1 HAVING count(DISTINCT formula) = 1)"


@book.query(f"{_SCORED}, {_PICK} SELECT p_partkey, ord FROM picked WHERE NOT others")
def confident_symbol(spark, t):
    """Of the relations that the givens bind, the one whose symbol the question names."""
    return _symbol(scored(spark, t)).select("p_partkey", C("pick").alias("ord"))


def _symbol(rows: DataFrame) -> DataFrame:
    own = rows.filter("bound and named").groupBy("p_partkey").agg(F.max_by(F.struct("ord", "others"), F.struct("score", -C("ord"))).alias("p"), F.countDistinct("formula").alias("n"))
    return own.filter("n = 1 and not p.others").select("p_partkey", C("p.ord").alias("pick"))


_ALONE = "alone AS (SELECT p_partkey, count(DISTINCT formula) AS n FROM totals WHERE bound GROUP BY 1)"


@book.query(f"{_SCORED}, {_ALONE} SELECT p_partkey, ord FROM ranked JOIN alone USING (p_partkey) WHERE rank = 1 AND bound AND n = 1 AND NOT others")
def confident_givens(spark, t):
    """The best relation is the only one that the givens bind, and no other variable is named."""
    return _rules(spark, t).filter("bound and formulas = 1 and not others").select("p_partkey", "ord")


def _rules(spark, t) -> DataFrame:
    n = Window.partitionBy("p_partkey")
    rows = ranked(spark, t).withColumn("formulas", F.size(F.collect_set(F.when(C("bound"), C("formula"))).over(n)))
    return rows.filter("rank = 1").select("p_partkey", "ord", "relation_bonus", "bound", "others", "formulas", "covered", "open_words")


@book.query(f"{_SCORED} SELECT p_partkey, array_to_string(tokens, ' ') AS tokens FROM words")
def exempt_letters(spark, t):
    """Tokens that may name a variable; single letters of units, possessives and articles are left out."""
    return asked(spark, t).select("p_partkey", F.array_join("tokens", " ").alias("tokens"))


@book.query(f"""{_SCORED}, {_PICK}, {_ALONE} SELECT p_partkey, CASE WHEN rule = 'symbol' THEN p.ord WHEN rule <> 'refuse' THEN r.ord END AS ord, rule FROM (SELECT r.*, CASE WHEN relation_bonus > 0 THEN 'relation' WHEN p.ord IS NOT NULL THEN 'symbol'
  WHEN bound AND n = 1 AND NOT r.others THEN 'givens' WHEN open_words > 0 AND 100 * covered // open_words >= 75 THEN 'coverage' ELSE 'refuse' END AS rule FROM ranked r LEFT JOIN (SELECT * FROM picked WHERE NOT others) p USING (p_partkey) LEFT JOIN alone USING (p_partkey) WHERE rank = 1) r
  LEFT JOIN (SELECT * FROM picked WHERE NOT others) p USING (p_partkey)""")
def confident_rules(spark, t):
    """The first rule that is certain decides: relation, symbol, givens, coverage; else no relation is taken."""
    symbol = F.when((F.bit_count("pick_set") == 1) & ~C("own.others"), C("own.ord"))
    top = judged(posed(spark, t), "p_partkey").select("p_partkey", "top.*", F.bit_count("bound_set").alias("formulas"), symbol.alias("pick"))
    cover = (C("open_words") > 0) & (F.expr("100 * covered div open_words") >= 75)
    rule = F.when(C("relation_bonus") > 0, "relation").when(C("pick").isNotNull(), "symbol").when(C("bound") & (C("formulas") == 1) & ~C("others"), "givens").when(cover, "coverage").otherwise("refuse")
    return top.withColumn("rule", rule).select("p_partkey", F.when(C("rule") == "symbol", C("pick")).when(C("rule") != "refuse", C("ord")).alias("ord"), "rule")


_FAMILY = "(VALUES " + ", ".join(f"({i}::BIGINT, '{f}')" for i, f in enumerate(R.FAMILIES)) + ") AS f(family, title)"


@book.query(f"SELECT title, count(ord) AS n, title <> 'Definitions' AS browsable FROM {_FAMILY} LEFT JOIN {R.records_sql()} USING (family) GROUP BY title")
def family_browse(spark, t):
    """Relations of each family, by the unit of the left side; definitions are found by search only."""
    families = spark.createDataFrame(list(enumerate(R.FAMILIES)), "family long, title string")
    return families.join(R.records(spark), "family", "left").groupBy("title").agg(F.count("ord").alias("n")).withColumn("browsable", C("title") != "Definitions")


@book.query(f"SELECT n_nationkey, ord FROM nation JOIN {R.records_sql()} ON contains(lower(name), lower(substr(n_name, 1, 1))) AND (n_regionkey = 0 OR family = n_nationkey % {len(R.FAMILIES)})")
def record_filter(spark, t):
    """Records of a family (all, where the scope is region 0) whose name holds a text in any case."""
    scope = (C("n_regionkey") == 0) | (C("family") == C("n_nationkey") % len(R.FAMILIES))
    held = F.lower("name").contains(F.lower(F.substring("n_name", 1, 1)))
    return t.nation.join(F.broadcast(R.records(spark)), scope & held).select("n_nationkey", "ord")


_ANSWERS = "len(have) > 0 AND used = inputs AND NOT list_contains(have, lhs)"


@book.query(f"{_SCORED} SELECT p_partkey, count(*) AS answering FROM totals WHERE {_ANSWERS} AND (regexp_matches(q, '(^|[^A-Za-z0-9_])' || replace(replace(lhs, '*', '\\*'), '+', '\\+') || '([^A-Za-z0-9_]|$)') OR len(list_filter(regexp_extract_all(name, '[a-z]{{4,}}'), lambda x: NOT list_contains({_list(STOP)}, x) AND contains(lower(q), x))) > 0 OR (len(have) = inputs)) GROUP BY 1")
def answerable(spark, t):
    """Relations that a question supplies in full and asks for: by symbol, by a head word, or by exactly its inputs."""
    head = F.filter(F.regexp_extract_all("name", F.lit("[a-z]{4,}"), F.lit(0)), lambda x: ~x.isin(*STOP) & F.lower("q").contains(x))
    symbol = F.expr("regexp_like(q, concat('(^|[^A-Za-z0-9_])', replace(replace(lhs, '*', '\\\\*'), '+', '\\\\+'), '([^A-Za-z0-9_]|$)'))")
    full = (F.size("have") > 0) & (C("used") == C("inputs")) & ~F.array_contains("have", C("lhs"))
    return scored(spark, t).filter(full & (symbol | (F.size(head) > 0) | (F.size("have") == C("inputs")))).groupBy("p_partkey").agg(F.count("*").alias("answering"))


@book.query(f"{_SCORED} SELECT count(*) AS asked, count(*) FILTER (ord = source) AS recovered FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY matched / terms DESC, ord) AS r FROM totals) WHERE r = 1")
def record_recoverable(spark, t):
    """Questions whose relation is the one with the greatest share of its name in them."""
    best = scored(spark, t).groupBy("p_partkey", "source").agg(F.max(F.struct((C("matched") / C("terms")).alias("s"), (-C("ord")).alias("o"))).alias("b"))
    return best.agg(F.count("*").alias("asked"), F.count_if(-C("b.o") == C("source")).alias("recovered"))


@book.query("SELECT p_partkey, '<q>' || p_name || '</q><r>none | missing:none | no matching relation | fit:low<a>' AS prompt FROM part")
def assemble_none(spark, t):
    """The prompt of a question that no relation fits."""
    return t.part.select("p_partkey", F.concat(F.lit("<q>"), "p_name", F.lit("</q><r>none | missing:none | no matching relation | fit:low<a>")).alias("prompt"))
