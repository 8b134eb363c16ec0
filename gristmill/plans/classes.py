"""Classes of training documents made from relations and parts, and the arms that evaluate them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sql as S
from ..operators import relations as R
from . import gates as G
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col
_n = len(R.RELATIONS)
_REL = f"(SELECT *, p_partkey % {_n} AS own FROM part) JOIN {R.records_sql()} ON ord = own"


def u_sql(key: str, salt: int) -> str:
    """A number in [0, 1) from an id, the same in both engines."""
    return f"((({key} + {salt}) * 1103515245 + 12345) % 32768 / 32768.0)"


def _u(key: Column, salt: int) -> Column:
    return F.pmod((key + salt) * 1103515245 + 12345, F.lit(32768)) / 32768.0


def _related(spark, t):
    return t.part.withColumn("own", C("p_partkey") % _n).join(F.broadcast(R.records(spark)), C("own") == C("ord"))


_STEM = "trim(regexp_extract(text, '^[^.?!\n]*', 0))"


@book.query(f"SELECT item_id, '<q>' || {_STEM} || '?</q><r>none | missing:none | no matching relation | fit:low<a>No relation fits this.<end>' AS doc FROM benchmark WHERE length({_STEM}) >= 8")
def class_no_match(spark, t):
    """D3: stems of texts that no relation was made for, answered by a refusal."""
    stem = F.trim(F.regexp_extract("text", "^[^.?!\n]*", 0))
    return t.benchmark.filter(F.length(stem) >= 8).select("item_id", F.concat(F.lit("<q>"), stem, F.lit("?</q><r>none | missing:none | no matching relation | fit:low<a>No relation fits this.<end>")).alias("doc"))


_WRITTEN = "(VALUES (0, 'Momentum is how much motion a mass carries.'), (12, 'A frequency counts turns in a second.'), (22, 'Capacitance tells how much charge a voltage holds.')) AS w(k, written)"


@book.query(f"SELECT p_partkey, coalesce(written, 'The ' || name || ' follows from ' || formula || '.') AS ans, written IS NOT NULL AS by_hand FROM {_REL} LEFT JOIN {_WRITTEN} ON k = ord")
def class_explain(spark, t):
    """EXPLAIN: the written explanation where there is one, else the template."""
    written = spark.createDataFrame([(0, "Momentum is how much motion a mass carries."), (12, "A frequency counts turns in a second."), (22, "Capacitance tells how much charge a voltage holds.")], "k long, written string")
    d = _related(spark, t).join(F.broadcast(written), C("k") == C("ord"), "left")
    return d.select("p_partkey", F.coalesce("written", F.concat(F.lit("The "), "name", F.lit(" follows from "), "formula", F.lit("."))).alias("ans"), C("written").isNotNull().alias("by_hand"))


_POOL = sorted({v for r in R.DECLARED for v in (x.split(" ")[0] for x in r.split(", "))})
_total = f"CASE WHEN {u_sql('p_partkey', 7)} < 0.16 THEN 2 WHEN {u_sql('p_partkey', 7)} < 0.43 THEN 3 WHEN {u_sql('p_partkey', 7)} < 0.73 THEN 4 ELSE 5 END"


@book.query(f"""SELECT p_partkey, total, array_to_string(list_concat(free, other[1:greatest(total - len(free), 0)]), ' ') AS givens FROM (SELECT *, {_total} AS total,
  list_concat(list_filter({_POOL!r}, lambda v: NOT list_contains(vars, v))[(p_partkey % 9 + 1):], list_filter({_POOL!r}, lambda v: NOT list_contains(vars, v))[:(p_partkey % 9)]) AS other FROM {_REL})""")
def class_spares(spark, t):
    """Givens filled up to a drawn total of 2 to 5 with variables that the relation does not have."""
    u = _u(C("p_partkey"), 7)
    total = F.when(u < 0.16, 2).when(u < 0.43, 3).when(u < 0.73, 4).otherwise(5)
    out = F.filter(F.array(*map(F.lit, _POOL)), lambda v: ~F.array_contains("vars", v))
    turn = (C("p_partkey") % 9).cast("int")
    d = _related(spark, t).select("p_partkey", "free", total.alias("total"), F.concat(F.slice(out, turn + 1, F.size(out)), F.slice(out, F.lit(1), turn)).alias("other"))
    return d.select("p_partkey", "total", F.array_join(F.concat("free", F.slice("other", F.lit(1), F.greatest(C("total") - F.size("free"), F.lit(0)))), " ").alias("givens"))


_SAID = "CASE p_partkey % 4 WHEN 0 THEN lhs || ' is what?' WHEN 1 THEN 'What is the ' || name || '?' WHEN 2 THEN 'find ' || lhs || '.' ELSE 'F_net is asked.' END"
_SYMBOL = "(contains(word, '_') OR regexp_matches(word, '[0-9]') OR (length(word) <= 3 AND word = upper(word)))"


@book.query(f"SELECT p_partkey, CASE WHEN {_SYMBOL} THEN q WHEN {u_sql('p_partkey', 3)} < 0.5 THEN lower(substr(q, 1, 1)) || substr(q, 2) ELSE upper(substr(q, 1, 1)) || substr(q, 2) END AS q FROM (SELECT *, regexp_extract(q, '^[^ ]*', 0) AS word FROM (SELECT *, {_SAID} AS q FROM {_REL}))")
def class_case_jitter(spark, t):
    """The first letter of a question in either case, unless it begins with a symbol."""
    d = _related(spark, t).select("p_partkey", F.expr(_SAID).alias("q")).withColumn("word", F.regexp_extract("q", "^[^ ]*", 0))
    symbol = C("word").contains("_") | C("word").rlike("[0-9]") | ((F.length("word") <= 3) & (C("word") == F.upper("word")))
    first, rest = F.substring("q", 1, 1), F.expr("substr(q, 2)")
    return d.select("p_partkey", F.when(symbol, C("q")).when(_u(C("p_partkey"), 3) < 0.5, F.concat(F.lower(first), rest)).otherwise(F.concat(F.upper(first), rest)).alias("q"))


_swap = lambda c, v, w: f"regexp_replace({c}, '(^|[^A-Za-z0-9_<>/])' || {v} || '([^A-Za-z0-9_<>]|$)', '\\1{w}\\2', 'g')"


@book.query(f"SELECT id, CASE WHEN {u_sql('id', 5)} < 0.25 THEN {_swap(_swap('record', 'a', 'zeta'), 'b', 'xi')} ELSE record END AS record FROM ({G._DOCS} SELECT id, a, b, '<r>' || record AS record FROM docs WHERE corpus = 'clean')")
def class_scramble(spark, t):
    """A quarter of the records with other symbols; tags, names and units stay."""
    swap = lambda c, v, w: F.regexp_replace(c, F.concat(F.lit("(^|[^A-Za-z0-9_<>/])"), C(v), F.lit("([^A-Za-z0-9_<>]|$)")), F.lit(f"$1{w}$2"))
    d = G.documents(spark, t).filter("corpus = 'clean'").select("id", "a", "b", F.concat(F.lit("<r>"), "record").alias("record"))
    return d.select("id", F.when(_u(C("id"), 5) < 0.25, swap(swap(C("record"), "a", "zeta"), "b", "xi")).otherwise(C("record")).alias("record"))


_DOSE = "[8, 16, 32][(('0x' || substr(sha256('kdose/v1:' || name), 1, 8))::BIGINT % 3)::INT + 1]"


@book.query(f"SELECT ord, i::INT AS copy, CASE i % 3 WHEN 0 THEN 'K1' WHEN 1 THEN 'K2' ELSE 'K3' END AS kind, CASE i % 3 WHEN 0 THEN 'The ' || name || ' is given by ' || formula || '.' WHEN 1 THEN 'The ' || name || ' is not the same as its unit.' ELSE 'I do not know more about the ' || name || '.' END AS ans FROM (SELECT *, unnest(range({_DOSE})) AS i FROM {R.records_sql()})")
def class_knowledge(spark, t):
    """K1, K2 and K3 documents of each term, as often as the term's dose says."""
    dose = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (F.conv(F.substring(F.sha2(F.concat(F.lit("kdose/v1:"), "name"), 256), 1, 8), 16, 10).cast("long") % 3 + 1).cast("int"))
    d = R.records(spark).withColumn("copy", F.explode(F.sequence(F.lit(0), dose - 1)))
    k, name = C("copy") % 3, C("name")
    ans = F.when(k == 0, F.concat(F.lit("The "), name, F.lit(" is given by "), "formula", F.lit("."))).when(k == 1, F.concat(F.lit("The "), name, F.lit(" is not the same as its unit."))).otherwise(F.concat(F.lit("I do not know more about the "), name, F.lit(".")))
    return d.select("ord", "copy", F.when(k == 0, "K1").when(k == 1, "K2").otherwise("K3").alias("kind"), ans.alias("ans"))


@book.query(f"{G._DOCS} SELECT id, b AS slope, CASE WHEN a < b THEN '0.5*' || a || '^2*' || b ELSE '0.5*' || b || '*' || a || '^2' END AS whole FROM docs WHERE corpus = 'clean' AND kind = 'C1'")
def class_calculus(spark, t):
    """C1 and C2: derivative and integral of a right side by the tools; what a tool refuses is left out."""
    d = G.documents(spark, t).filter("corpus = 'clean' and kind = 'C1'").select("id", "a", S.diff_expr("nr", "a").alias("slope"), S.integ_expr("nr", "a").alias("whole"))
    return d.filter(~C("slope").startswith("!") & ~C("whole").startswith("!")).select("id", "slope", "whole")


@book.query(f"{G._DOCS} SELECT id, round(y * x * x / 2.0, 4) AS area FROM docs WHERE corpus = 'clean'")
def class_definite(spark, t):
    """C3: the integral of a product from 0 to a declared bound, the other factor given."""
    text = F.concat(F.lit("<tool>integ<arg>"), C("y").cast("string"), F.lit("*"), "a", F.lit("<arg>"), "a", F.lit("<arg>0<arg>"), C("x").cast("string"), F.lit("</tool>"))
    return G.documents(spark, t).filter("corpus = 'clean'").select("id", F.round(S.tool_call(text).cast("double"), 4).alias("area"))


@book.query(f"{G._DOCS} SELECT id, nf AS relation, '' || (y + 1) AS last, '' || (x * (y + 1)) AS res FROM docs WHERE corpus = 'clean' AND kind = 'F1'")
def class_follow_up(spark, t):
    """the second turn restates one value; of each variable the last value counts."""
    d = G.documents(spark, t).filter("corpus = 'clean' and kind = 'F1'")
    said = F.map_from_entries(F.array_distinct(F.transform(F.array("a", "b"), lambda v: F.struct(v.alias("k"), F.element_at(F.regexp_extract_all("q", F.concat(F.lit("(?:^|[^A-Za-z0-9_])"), v, F.lit(" = ([0-9]+)")), F.lit(1)), -1).alias("v")))))
    told = d.select("id", "nf", "a", "b", said.alias("m"))
    call = F.concat(F.lit("<tool>eval<arg>"), C("m")[C("a")], F.lit("*"), C("m")[C("b")], F.lit("</tool>"))
    return told.select("id", C("nf").alias("relation"), C("m")[C("b")].alias("last"), S.tool_call(call).alias("res"))


_TERMS = "('force'), ('adhesive forces'), ('beta rays'), ('gas'), ('statics'), ('lens'), ('units of work'), ('axis of lenses'), ('bias'), ('definition of forces')"
_ARE = "regexp_matches(head, 's$') AND NOT regexp_matches(head, '(ss|us|is|as|ics|ens)$')"


@book.query(f"SELECT p_partkey, term, CASE WHEN {_ARE} THEN 'What are ' ELSE 'What is ' END || term || '?' AS q FROM part JOIN (SELECT *, row_number() OVER (ORDER BY term) - 1 AS k, lower(regexp_replace(term, ' (of|in|on|for|at|by|with) .*$', '')) AS head FROM (VALUES {_TERMS}) AS v(term)) ON k = p_partkey % 10")
def class_agreement(spark, t):
    """The verb of a question agrees with the head noun of its term, not with its last word."""
    terms = sorted(x.strip("(')") for x in _TERMS.split(", "))
    term = F.element_at(F.array(*map(F.lit, terms)), (C("p_partkey") % 10 + 1).cast("int"))
    d = t.part.select("p_partkey", term.alias("term")).withColumn("head", F.lower(F.regexp_replace("term", " (of|in|on|for|at|by|with) .*$", "")))
    are = C("head").rlike("s$") & ~C("head").rlike("(ss|us|is|as|ics|ens)$")
    return d.select("p_partkey", "term", F.concat(F.when(are, "What are ").otherwise("What is "), "term", F.lit("?")).alias("q"))


_CAP = 120
_last = lambda s, sep: f"CASE WHEN contains({s}, '{sep}') THEN length({s}) - position('{sep[::-1]}' IN reverse({s})) - {len(sep) - 1} ELSE -1 END"


@book.query(f"""SELECT doc_id, CASE WHEN length(text) <= {_CAP} THEN text ELSE rtrim(CASE WHEN a > {_CAP // 2} THEN substr(cut, 1, a::BIGINT) WHEN b > {_CAP // 2} THEN substr(cut, 1, b::BIGINT) WHEN c > {_CAP // 2} THEN substr(cut, 1, c::BIGINT) ELSE cut END, ' ,;:-') || '.' END AS short
  FROM (SELECT *, {_last('cut', ';')} AS a, {_last('cut', ', ')} AS b, {_last('cut', ' ')} AS c FROM (SELECT *, substr(text, 1, {_CAP - 1}) AS cut FROM documents))""")
def class_trim(spark, t):
    """Texts cut where a clause ends, else between words, never within one."""

    def last(sep: str) -> Column:
        at = F.locate(sep[::-1], F.reverse("cut"))
        return F.when(at > 0, F.length("cut") - at - (len(sep) - 1)).otherwise(-1)

    d = t.documents.select("doc_id", "text", F.substring("text", 1, _CAP - 1).alias("cut")).withColumns({n: last(s) for n, s in (("a", ";"), ("b", ", "), ("c", " "))})
    part = F.when(C("a") > _CAP // 2, F.expr("substr(cut, 1, a)")).when(C("b") > _CAP // 2, F.expr("substr(cut, 1, b)")).when(C("c") > _CAP // 2, F.expr("substr(cut, 1, c)")).otherwise(C("cut"))
    return d.select("doc_id", F.when(F.length("text") <= _CAP, C("text")).otherwise(F.concat(F.rtrim(part, F.lit(" ,;:-")), F.lit("."))).alias("short"))


#: Frames around a list of givens; those that end in a comma take the question in lower case.
FRAMES = (
    "Where {g}, ", "Suppose {g}, ", "Given {g}, ", "If {g}, ", "With {g}, ", "Let {g}. ", "You are told {g}. ", "Take {g}. ", "Assume {g}. ", "For {g}, ",
    "We know {g}. ", "Here {g}. ", "Use {g}. ", "Say {g}. ", "At {g}, ", "Know that {g}, ",
)
_FRAME = "(VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FRAMES)) + ") AS f(k, frame)"
_ASK = "CASE WHEN p_partkey % 2 = 0 THEN 'Calculate the ' || name || '.' ELSE 'What is the ' || name || '?' END"


@book.query(f"""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ask WHEN {u_sql('p_partkey', 9)} < 0.35 THEN ask || ' ' || rtrim(stem, ' ,.') || '.' WHEN stem LIKE '%, ' THEN stem || lower(substr(ask, 1, 1)) || substr(ask, 2) ELSE stem || ask END AS q
  FROM (SELECT *, {_ASK} AS ask, replace(frame, '{{g}}', given) AS stem FROM {_REL} JOIN {_FRAME} ON k = p_partkey % {len(FRAMES)})""")
def class_compose(spark, t):
    """A question with its givens in one of sixteen frames, in a third of cases after it; without givens no frame."""
    frame = F.element_at(F.array(*map(F.lit, FRAMES)), (C("p_partkey") % len(FRAMES) + 1).cast("int"))
    d = _related(spark, t).select("p_partkey", F.expr(_ASK).alias("ask"), F.replace(frame, F.lit("{g}"), C("given")).alias("stem"))
    after = F.concat("ask", F.lit(" "), F.rtrim("stem", F.lit(" ,.")), F.lit("."))
    lower = F.concat("stem", F.lower(F.substring("ask", 1, 1)), F.expr("substr(ask, 2)"))
    return d.select("p_partkey", F.when(C("p_partkey") % 11 == 0, C("ask")).when(_u(C("p_partkey"), 9) < 0.35, after).when(C("stem").endswith(", "), lower).otherwise(F.concat("stem", "ask")).alias("q"))


_SURFACE = f"CASE WHEN {u_sql('p_partkey', 13)} < 0.5 THEN name WHEN {u_sql('p_partkey', 13)} < 0.75 THEN 'the value of ' || lhs WHEN {u_sql('p_partkey', 13)} < 0.9 THEN coalesce(nouns[1], name) ELSE name || ' (' || lhs || ')' END"


@book.query(f"SELECT p_partkey, {_SURFACE} AS surface FROM {_REL}")
def class_surface(spark, t):
    """How a question names its quantity: by name, symbol, everyday word or both, by weight."""
    u = _u(C("p_partkey"), 13)
    word = F.coalesce(F.get("nouns", F.lit(0)), C("name"))
    return _related(spark, t).select("p_partkey", F.when(u < 0.5, C("name")).when(u < 0.75, F.concat(F.lit("the value of "), "lhs")).when(u < 0.9, word).otherwise(F.concat("name", F.lit(" ("), "lhs", F.lit(")"))).alias("surface"))


#: Arms of an evaluation: which documents they take.  The last one takes none and must not pass.
ARMS = {
    "values": "kind = 'ANSWER'", "worded": "kind = 'ANSWER' AND NOT contains(q, lhs)", "symbol": "kind = 'ANSWER' AND y % 2 = 0", "reordered": "kind = 'ANSWER' AND x % 2 = 1", "withheld": "kind = 'D1'", "bare": "kind = 'K1'",
    "no_match": "kind = 'D3'", "explain": "kind = 'EXPLAIN'", "derivative": "kind = 'C1'", "rearranged": "kind = 'R1'", "follow_up": "kind = 'F1'", "held_out": "part = 'held'", "empty": "kind = 'NONE'",
}


@book.query(f"{G._DOCS} SELECT arm, count(id) AS items, CASE WHEN count(id) = 0 THEN 'cannot check' ELSE 'ok' END AS status FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in ARMS)}) AS v(arm) LEFT JOIN docs ON corpus = 'clean' AND CASE arm {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {w}' for a, w in ARMS.items())} END GROUP BY arm")
def evaluation_arms(spark, t):
    """Items of each evaluation arm; an arm without items is no pass."""
    counted = G.documents(spark, t).filter("corpus = 'clean'").agg(*(F.count_if(F.expr(w)).alias(a) for a, w in ARMS.items()))
    each = counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ARMS)), F.array(*ARMS))).alias("arm", "items"))
    return each.withColumn("status", F.when(C("items") == 0, "cannot check").otherwise("ok"))
