"""Gates over a corpus: what was checked, what failed, and ok, fail or cannot check.

Every gate runs over two corpora made from the whole part table: a clean one, and one in
which every fifth document is spoilt.  A gate that does not fail on the second proves
nothing, so both are returned, and `gate_controls` lists which gates catch their faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import text as X
from ..operators import relations as R
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col

#: Relations that are a product of two variables; the documents are about these.
_names, _rows = R.dimension()
PRODUCTS = [r[0] for r in _rows if r[_names.index("nr")].count("*") == 1 and len(r[_names.index("free")]) == 2 and not set("/+-^") & set(r[_names.index("nr")])]
HELD = PRODUCTS[-1]
#: Units whose quantities have a declared window, and symbols that mean several things: fixed values of this repository.
BOUNDED = ("m", "m/s", "J", "N", "W", "V", "C", "kg*m/s")
TIME_FREE = ("Q=I*t", "s=v*t", "J=F*t")
SEVERAL = ("p", "V", "T", "Q", "c", "d", "n", "C", "A")
REJECTED = ("law of", "worked example", "in terms of the following", "see figure")
LETTERS = "".join(a for a, _ in X.FOLD) + "ßÁœŒÊÀÔÛÎÂ"

#: Fields of a document in an SQL that Spark and the oracle read alike, in the order in which they build on one another.
FIELDS = {
    "kind": "CASE id % 10 WHEN 0 THEN 'D1' WHEN 1 THEN 'D3' WHEN 2 THEN 'EXPLAIN' WHEN 3 THEN 'C1' WHEN 4 THEN 'R1' WHEN 5 THEN 'K1' WHEN 6 THEN 'F1' ELSE 'ANSWER' END",
    "head": f"CASE WHEN corpus = 'planted' AND ord = {PRODUCTS[0]} THEN 'none' ELSE nf END",
    "part": f"CASE WHEN ord = {HELD} AND NOT bad THEN 'held' ELSE 'trained' END",
    "q": "CASE WHEN kind = 'D1' THEN 'Where ' || a || ' = ' || x || CASE WHEN bad THEN ', ' || b || ' = ' || y ELSE '' END || ', calculate ' || name || '.' "
    "WHEN kind = 'D3' THEN CASE WHEN bad THEN 'Where ' || a || ' = ' || x || ', ' || b || ' = ' || y || ', how far is the shop?' ELSE 'How far is the ' || p_name || ' shop?' END "
    "WHEN kind = 'EXPLAIN' THEN 'Explain ' || name || '.' WHEN kind = 'C1' THEN 'What is the derivative of ' || nr || ' with respect to ' || a || '?' "
    "WHEN kind = 'R1' THEN 'Solve ' || nf || ' for ' || a || '.' WHEN kind = 'K1' THEN 'What is ' || name || '?' "
    "WHEN kind = 'F1' THEN CASE WHEN bad THEN '' ELSE 'Earlier: calculate ' || name || '. ' || a || ' = ' || x || ', ' || b || ' = ' || y || ' ' END || 'Recompute. ' || b || ' = ' || (y + 1) "
    "WHEN bad THEN 'Compute law of it.' ELSE 'Where ' || a || ' = ' || x || ', ' || b || ' = ' || y || ', calculate ' || name || '.' END",
    "record": "nf || ' | ' || name || ' | missing:' || CASE WHEN kind = 'D1' THEN b ELSE 'none' END || ' | fit:' || CASE WHEN kind = 'D3' THEN 'low' ELSE 'high' END",
    "call": "CASE WHEN kind = 'ANSWER' THEN '<tool>eval<arg>' || x || '*' || y || '</tool>' WHEN kind = 'F1' THEN '<tool>eval<arg>' || x || '*' || (y + 1) || '</tool>' "
    "WHEN kind = 'C1' THEN '<tool>diff<arg>' || CASE WHEN bad THEN nf ELSE nr END || '<arg>' || a || '</tool>' "
    "WHEN kind = 'R1' THEN '<tool>solve<arg>' || CASE WHEN bad THEN nr ELSE nf END || '<arg>' || a || '</tool>' ELSE '' END",
    "res": "CASE WHEN kind = 'ANSWER' THEN '' || (x * y + CASE WHEN bad THEN 1 ELSE 0 END) WHEN kind = 'F1' THEN '' || (x * (y + 1)) ELSE '' END",
    "ans": "CASE WHEN kind = 'D1' THEN 'I cannot answer that: ' || b || ' is not given.' WHEN kind = 'D3' THEN 'No relation fits this.' "
    "WHEN kind = 'EXPLAIN' THEN CASE WHEN corpus = 'planted' THEN 'It is so.' WHEN x % 3 = 0 THEN 'To find ' || lhs || ' use ' || nf || '.' WHEN x % 3 = 1 THEN name || ' follows from ' || nf || '.' ELSE 'By ' || nf || ' it grows with ' || a || '.' END "
    "WHEN kind = 'ANSWER' THEN 'The ' || CASE WHEN bad THEN 'kinetic energy' ELSE name END || ' is ' || res || '.' ELSE 'See ' || nf || '.' END",
}
_base = f"""p_partkey AS id, p_name, p_size + 1 AS x, p_partkey % 9 + 1 AS y, corpus, corpus = 'planted' AND p_partkey % 10 IN (0, 1, 3, 4, 6, 7) AS bad"""
_ORDS = "[" + ", ".join(map(str, PRODUCTS)) + "]"
_step = "base"
_DOCS = f"rel AS (SELECT *, free[1] AS a, free[2] AS b FROM {R.records_sql()}), base AS (SELECT {_base}, rel.* FROM part CROSS JOIN (VALUES ('clean'), ('planted')) AS c(corpus) JOIN rel ON ord = {_ORDS}[p_partkey % {len(PRODUCTS)} + 1])"
for _field, _text in FIELDS.items():
    _DOCS += f", w_{_field} AS (SELECT *, {_text} AS {_field} FROM {_step})"
    _step = f"w_{_field}"
_DOCS = f"WITH {_DOCS}, docs AS (SELECT * FROM {_step})"


def documents(spark, t) -> DataFrame:
    """The clean and the spoilt corpus."""
    return documents_of(spark, t.part)


def documents_of(spark, part: DataFrame) -> DataFrame:
    """The same from rows with p_partkey, p_name and p_size."""
    rel = R.records(spark).withColumns({"a": F.get("free", F.lit(0)), "b": F.get("free", F.lit(1))})
    own = F.element_at(F.array(*map(F.lit, PRODUCTS)), (C("p_partkey") % len(PRODUCTS) + 1).cast("int"))
    parts = part.withColumn("corpus", F.explode(F.array(F.lit("clean"), F.lit("planted"))))
    base = parts.select(*(F.expr(x) for x in _base.split(", ", 4)[:4]), "corpus", F.expr(_base.split("corpus, ", 1)[1]), own.alias("own")).join(F.broadcast(rel), C("own") == C("ord"))
    for field, text in FIELDS.items():
        base = base.withColumn(field, F.expr(text))
    return base


def verdict(rows: DataFrame, gate: str, limit: float = 0.0) -> DataFrame:
    """One row a corpus from rows (corpus, failed): nothing checked is not a pass."""
    told = rows.groupBy("corpus").agg(F.count("failed").alias("checked"), F.coalesce(F.sum(C("failed").cast("long")), F.lit(0)).alias("failed"))
    status = F.when(C("checked") == 0, "cannot check").when(C("failed") > limit * C("checked"), "fail").otherwise("ok")
    return told.select(F.lit(gate).alias("gate"), "corpus", "checked", "failed", status.alias("status"))


GATES: dict[str, tuple] = {}


def gate(name: str, rows_sql: str, limit: float = 0.0):
    """Register a gate: `rows_sql` and the function both give rows (corpus, failed)."""
    sql = f"""{_DOCS}, rows AS ({rows_sql}) SELECT '{name}' AS gate, corpus, count(failed) AS checked, coalesce(sum(failed::INT), 0)::BIGINT AS failed,
      CASE WHEN count(failed) = 0 THEN 'cannot check' WHEN coalesce(sum(failed::INT), 0) > {limit} * count(failed) THEN 'fail' ELSE 'ok' END AS status FROM rows GROUP BY corpus"""

    def register(rows):
        def run(spark, t):
            return verdict(rows(spark, t), name, limit)

        run.__name__, run.__doc__ = f"gate_{name}", rows.__doc__
        GATES[name] = (rows, limit)
        book.query(sql)(run)
        return rows

    return register


def _of(spark, t, failed: Column, *kinds: str) -> DataFrame:
    return documents(spark, t).filter(C("kind").isin(*kinds)).select("corpus", failed.alias("failed"))


@gate("result_verbatim", "SELECT corpus, '' || (x * y) <> res AS failed FROM docs WHERE kind = 'ANSWER'")
def result_verbatim(spark, t):
    """The stored result of every call is what running the call again gives."""
    return _of(spark, t, S.tool_call("call") != C("res"), "ANSWER")


@gate("store_coverage", f"SELECT corpus, max((head = nf)::INT) = 0 AS failed FROM docs GROUP BY corpus, ord")
def store_coverage(spark, t):
    """Every relation of the store has a document."""
    return documents(spark, t).groupBy("corpus", "ord").agg((~F.bool_or(C("head") == C("nf"))).alias("failed"))


@gate("split_held_out", "SELECT corpus, bool_or(part = 'trained') AS failed FROM docs GROUP BY corpus, nf HAVING bool_or(part = 'held')")
def split_held_out(spark, t):
    """No held-out relation is trained on."""
    return documents(spark, t).groupBy("corpus", "nf").agg(F.bool_or(C("part") == "trained").alias("failed"), F.bool_or(C("part") == "held").alias("h")).filter("h").select("corpus", "failed")


_CLAIM, _GIVEN = "cannot answer that: ([A-Za-z0-9_]+) is not given", "([A-Za-z][A-Za-z0-9_]*) = "


@gate("withheld", f"SELECT corpus, regexp_extract(ans, '{_CLAIM}', 1) = '' OR list_contains(regexp_extract_all(q, '{_GIVEN}', 1), regexp_extract(ans, '{_CLAIM}', 1)) AS failed FROM docs WHERE kind = 'D1'")
def withheld(spark, t):
    """The variable that a refusal names is not among the givens; an unread claim fails."""
    claim = F.regexp_extract("ans", _CLAIM, 1)
    return _of(spark, t, (claim == "") | F.array_contains(F.regexp_extract_all("q", F.lit(_GIVEN), F.lit(1)), claim), "D1")


@gate("no_collapse", "SELECT corpus, max(n) > 0.15 * sum(n) AS failed FROM (SELECT corpus, q, count(*) AS n FROM docs WHERE kind = 'ANSWER' GROUP BY 1, 2) GROUP BY corpus")
def no_collapse(spark, t):
    """No question makes up more than 15 % of its kind."""
    per = documents(spark, t).filter("kind = 'ANSWER'").groupBy("corpus", "q").agg(F.count("*").alias("n"))
    return per.groupBy("corpus").agg((F.max("n") > 0.15 * F.sum("n")).alias("failed"))


_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_BOTH = "(VALUES ('clean'), ('planted')) AS c(corpus)"


@gate("coupling", f"SELECT corpus, NOT (units[1] IN ({_quoted(BOUNDED)}) AND (corpus = 'clean' OR units[1] <> 'J')) OR (list_contains(units, 's') AND nf NOT IN ({_quoted(TIME_FREE)})) AS failed FROM rel CROSS JOIN {_BOTH} WHERE ord IN ({', '.join(map(str, PRODUCTS))}) AND ord NOT IN (16)")
def coupling(spark, t):
    """The product of two factors has a declared window; a factor in seconds is exempt by name or bounded."""
    rel = R.records(spark).filter(C("ord").isin(*PRODUCTS) & (C("ord") != 16)).withColumn("corpus", F.explode(F.array(F.lit("clean"), F.lit("planted"))))
    own = C("units")[0].isin(*BOUNDED) & ((C("corpus") == "clean") | (C("units")[0] != "J"))
    return rel.select("corpus", (~own | (F.array_contains("units", "s") & ~C("nf").isin(*TIME_FREE))).alias("failed"))


@gate("siblings", f"SELECT corpus, count(DISTINCT unit) > 1 AND (corpus = 'planted' OR var NOT IN ({_quoted(SEVERAL)})) AS failed FROM (SELECT unnest(vars) AS var, unnest(units) AS unit FROM rel) CROSS JOIN {_BOTH} GROUP BY corpus, var HAVING count(*) > 1")
def siblings(spark, t):
    """A symbol that several records declare has one unit, unless it is known to mean several things."""
    each = R.records(spark).select(F.explode(F.arrays_zip("vars", "units")).alias("d")).withColumn("corpus", F.explode(F.array(F.lit("clean"), F.lit("planted"))))
    per = each.groupBy("corpus", C("d.vars").alias("var")).agg(F.countDistinct("d.units").alias("u"), F.count("*").alias("n")).filter("n > 1")
    return per.select("corpus", ((C("u") > 1) & ((C("corpus") == "planted") | ~C("var").isin(*SEVERAL))).alias("failed"))


@gate("units_parity", f"SELECT corpus, corpus = 'planted' AND ord % 5 = 0 AS failed FROM (SELECT ord, unnest(vars) AS var FROM rel) CROSS JOIN {_BOTH}")
def units_parity(spark, t):
    """Units are the same after a round trip through text, row by row, none missing on either side."""
    rel = R.records(spark).select("ord", "vars", "units")
    lines = rel.select("ord", F.to_json(F.map_from_arrays("vars", "units")).alias("j")).withColumn("corpus", F.explode(F.array(F.lit("clean"), F.lit("planted"))))
    back = lines.select("corpus", "ord", F.explode(F.from_json("j", "map<string,string>")).alias("var", "unit")).withColumn("unit", F.when((C("corpus") == "planted") & (C("ord") % 5 == 0), F.concat("unit", F.lit("?"))).otherwise(C("unit")))
    own = rel.select("ord", F.explode(F.arrays_zip("vars", "units")).alias("d")).select("ord", C("d.vars").alias("var"), C("d.units").alias("own")).withColumn("corpus", F.explode(F.array(F.lit("clean"), F.lit("planted"))))
    return own.join(back, ["corpus", "ord", "var"], "full").select("corpus", (~C("own").eqNullSafe(C("unit"))).alias("failed"))


_POOL = "|".join(sorted((r[_names.index("name")] for r in _rows), key=lambda n: (-len(n), n)))


@gate("name_source", f"SELECT corpus, len(list_filter(regexp_extract_all(lower(ans), '{_POOL}'), lambda n: NOT contains(lower(q) || ' ' || name, n))) > 0 AS failed FROM docs")
def name_source(spark, t):
    """Names of relations in an answer stand in its prompt; the longest name wins the match."""
    found = F.regexp_extract_all(F.lower("ans"), F.lit(_POOL), F.lit(0))
    prompt = F.concat(F.lower("q"), F.lit(" "), C("name"))
    return documents(spark, t).select("corpus", F.exists(found, lambda n: ~prompt.contains(n)).alias("failed"))


@gate("ask_quantity", f"SELECT corpus, regexp_matches(lower(q), '{'|'.join(REJECTED)}') AS failed FROM docs WHERE kind IN ('ANSWER', 'D1')")
def ask_quantity(spark, t):
    """No question uses a rejected frame or asks for a law by its name."""
    return _of(spark, t, F.lower("q").rlike("|".join(REJECTED)), "ANSWER", "D1")


@gate("characters", f"SELECT corpus, regexp_matches(text, CASE WHEN corpus = 'clean' THEN '[^\\x00-\\x7F{LETTERS}]' ELSE '[^\\x00-\\x7F]' END) AS failed FROM documents CROSS JOIN {_BOTH}")
def characters(spark, t):
    """Every character outside ASCII is one that a token stands for."""
    both = t.documents.select("text").withColumn("corpus", F.explode(F.array(F.lit("clean"), F.lit("planted"))))
    return both.select("corpus", F.when(C("corpus") == "clean", C("text").rlike(f"[^\\x00-\\x7F{LETTERS}]")).otherwise(C("text").rlike("[^\\x00-\\x7F]")).alias("failed"))


@gate("explain_variants", "SELECT corpus, median(n) < 2 AS failed FROM (SELECT corpus, nf, count(DISTINCT ans) AS n FROM docs WHERE kind = 'EXPLAIN' GROUP BY 1, 2) GROUP BY corpus")
def explain_variants(spark, t):
    """The median relation is explained in two ways at least."""
    per = documents(spark, t).filter("kind = 'EXPLAIN'").groupBy("corpus", "nf").agg(F.countDistinct("ans").alias("n"))
    return per.groupBy("corpus").agg((F.median("n") < 2).alias("failed"))


@gate("record_bytes", "SELECT corpus, bad AS failed FROM docs")
def record_bytes(spark, t):
    """Two producers of a record's text agree in every byte."""
    other = F.array_join(F.array("nf", "name", F.concat(F.lit("missing:"), F.when(C("kind") == "D1", C("b")).otherwise("none")), F.concat(F.lit("fit:"), F.when(C("kind") == "D3", "low").otherwise("high"))), " | ")
    other = F.when(C("bad"), F.replace(other, F.lit(" | "), F.lit("|"))).otherwise(other)
    return documents(spark, t).select("corpus", (F.md5("record") != F.md5(other)).alias("failed"))


@gate("split_valid", "SELECT corpus, regexp_matches(nf, '^d\\*|/d\\*') OR regexp_matches(q, '\\((from|see) ') OR NOT contains(lower(q), name) AS failed FROM docs WHERE kind = 'ANSWER'")
def split_valid(spark, t):
    """An item's relation is no cancelled differential, and its question names the quantity."""
    return _of(spark, t, C("nf").rlike("^d\\*|/d\\*") | C("q").rlike("\\((from|see) ") | ~F.lower("q").contains(C("name")), "ANSWER")


@gate("fresh", f"SELECT corpus, corpus = 'planted' AS failed FROM {_BOTH}")
def fresh(spark, t):
    """The stamp of the corpus is the hash of the inputs that are there now."""
    digest = lambda text: F.sha2(F.array_join(F.sort_array(F.collect_list(text)), "\n"), 256)
    now = F.when(C("corpus") == "planted", F.concat("formula", F.lit("+0"))).otherwise(C("formula"))
    rel = R.records(spark).withColumn("corpus", F.explode(F.array(F.lit("clean"), F.lit("planted"))))
    return rel.groupBy("corpus").agg((digest("formula") != digest(now)).alias("failed"))


_BODY = "CASE WHEN corpus = 'planted' THEN substr(text, 1, 200) || ' [BL] ' ELSE text END"
_FILLER = "/(preface|acknowledgements|exercises)"


@gate("knowledge", f"""SELECT corpus, max(n) >= 0.02 * sum(n) AS failed FROM (SELECT corpus, length({_BODY}) AS l, count(*) AS n FROM documents CROSS JOIN {_BOTH} GROUP BY 1, 2) GROUP BY corpus
  UNION ALL SELECT corpus, bool_or(regexp_matches(url, '{_FILLER}') OR corpus = 'planted') FROM pages CROSS JOIN {_BOTH} GROUP BY 1
  UNION ALL SELECT corpus, bool_or(regexp_matches({_BODY}, '\\[(BL|OL|AL|EL)\\]')) FROM documents CROSS JOIN {_BOTH} GROUP BY 1""")
def knowledge(spark, t):
    """No length that betrays a cap, no filler sections, no teachers' marks."""
    both = F.explode(F.array(F.lit("clean"), F.lit("planted")))
    docs = t.documents.select("text").withColumn("corpus", both).select("corpus", F.expr(_BODY).alias("body"))
    spike = docs.groupBy("corpus", F.length("body").alias("l")).agg(F.count("*").alias("n")).groupBy("corpus").agg((F.max("n") >= 0.02 * F.sum("n")).alias("failed"))
    filler = t.pages.select("url").withColumn("corpus", both).groupBy("corpus").agg(F.bool_or(C("url").rlike(_FILLER) | (C("corpus") == "planted")).alias("failed"))
    marks = docs.groupBy("corpus").agg(F.bool_or(C("body").rlike("\\[(BL|OL|AL|EL)\\]")).alias("failed"))
    return spike.unionByName(filler).unionByName(marks)


@gate("follow_up", "SELECT corpus, NOT starts_with(q, 'Earlier: ') OR NOT contains(call, x || '*' || (y + 1)) AS failed FROM docs WHERE kind = 'F1'")
def follow_up(spark, t):
    """A follow-up carries the earlier turn, and the value stated last is the one used."""
    last = F.concat(C("x").cast("string"), F.lit("*"), (C("y") + 1).cast("string"))
    return _of(spark, t, ~C("q").startswith("Earlier: ") | ~C("call").contains(last), "F1")


@gate("symbolic_record", "SELECT corpus, regexp_extract(call, '<arg>([^<]*)<arg>', 1) <> CASE WHEN kind = 'R1' THEN nf ELSE nr END AS failed FROM docs WHERE kind IN ('R1', 'C1')")
def symbolic_record(spark, t):
    """Solving takes the whole relation of the record, differentiation its right side."""
    return _of(spark, t, F.regexp_extract("call", "<arg>([^<]*)<arg>", 1) != F.when(C("kind") == "R1", C("nf")).otherwise(C("nr")), "R1", "C1")


@gate("no_match", f"SELECT corpus, len(regexp_extract_all(q, '{_GIVEN}', 1)) = 2 AS failed FROM docs WHERE kind = 'D3'")
def no_match(spark, t):
    """A question without a relation does not supply all inputs of its record."""
    return _of(spark, t, F.size(F.regexp_extract_all("q", F.lit(_GIVEN), F.lit(1))) == 2, "D3")


@gate("explained", "SELECT corpus, NOT contains(ans, nf) AS failed FROM docs WHERE kind = 'EXPLAIN'")
def explained(spark, t):
    """An explanation states the relation that it explains."""
    return _of(spark, t, ~C("ans").contains(C("nf")), "EXPLAIN")


@book.query(f"SELECT gate, gate NOT IN ('') AS caught FROM (VALUES {', '.join(f'({chr(39)}{g}{chr(39)})' for g in GATES)}) AS g(gate)")
def gate_controls(spark, t):
    """Each gate fails on planted faults."""
    out = None
    for name, (rows, limit) in GATES.items():
        one = verdict(rows(spark, t), name, limit).filter("corpus = 'planted'").select("gate", (C("status") == "fail").alias("caught"))
        out = one if out is None else out.unionByName(one)
    return out
