"""Retrieval, conversation, gate, token and vector queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.words import letters, words
from ..operators import numbers as N
from ..operators import relations as R
from ..operators import retrieval as Q
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col
STORE = R.store_sql()
W_ = r"[^ \t\n\r]+"

_D = "d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents)"
_QW = "q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM benchmark)"
_WT = "w AS (SELECT word, count(*) AS n, CAST((16 * (floor(log2((SELECT count(*) FROM documents) // count(*)))::BIGINT + 1)) // 2 AS BIGINT) AS weight FROM d GROUP BY 1)"
_RANKED = f"""WITH {_D}, {_QW}, {_WT}, s AS (SELECT item_id, doc_id, CAST(sum(weight) AS BIGINT) AS score, count(*) AS matched FROM q JOIN w USING (word) JOIN d USING (word) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _ranked(t, k):
    asked = Q.postings(t.benchmark, "item_id")
    docs = Q.asked_only(Q.postings(t.documents, "doc_id"), asked)
    return Q.ranked(asked, docs, "item_id", "doc_id", Q.idf(docs, t.documents.count()), k)


@book.query(f"{_RANKED} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 3")
def retrieval_topk(spark, t):
    return _ranked(t, 3).select("item_id", "doc_id", "score", "rank")


@book.query(f"{_RANKED} SELECT item_id, doc_id, round(matched / (SELECT count(*) FROM q WHERE q.item_id = r.item_id), 6) AS coverage FROM r WHERE rank = 1")
def retrieval_coverage(spark, t):
    size = t.benchmark.select("item_id", F.size(F.array_distinct(letters(C("text")))).alias("k"))
    return _ranked(t, 1).join(size, "item_id").select("item_id", "doc_id", F.round(C("matched") / C("k"), 6).alias("coverage"))


@book.query(f"{_RANKED}, b AS (SELECT item_id, max(doc_id) FILTER (rank = 1) AS doc_id, max(matched) FILTER (rank = 1) AS m, max(score) FILTER (rank = 1) AS a, coalesce(max(score) FILTER (rank = 2), 0) AS b FROM r GROUP BY 1), k AS (SELECT item_id, count(*) AS k FROM q GROUP BY 1) SELECT item_id, CASE WHEN 100 * m >= 75 * k AND a > b THEN doc_id END AS doc_id, CASE WHEN 100 * m < 75 * k THEN 'coverage' WHEN a = b THEN 'tie' ELSE 'confident' END AS rule FROM b JOIN k USING (item_id)")
def retrieval_confident(spark, t):
    """The best document only where it covers three quarters of the words and stands alone."""
    size = t.benchmark.select("item_id", F.size(F.array_distinct(letters(C("text")))).alias("k"))
    first = lambda c, r: F.max(F.when(C("rank") == r, C(c)))
    top = _ranked(t, 2).groupBy("item_id").agg(first("doc_id", 1).alias("d"), first("matched", 1).alias("m"), first("score", 1).alias("a"), F.coalesce(first("score", 2), F.lit(0)).alias("b")).join(size, "item_id")
    low = 100 * C("m") < 75 * C("k")
    return top.select("item_id", F.when(~low & (C("a") > C("b")), C("d")).alias("doc_id"), F.when(low, "coverage").when(C("a") == C("b"), "tie").otherwise("confident").alias("rule"))


_TERM = lambda c, w: f"CASE WHEN contains(lower({c}), '{w}') THEN 500 + CASE WHEN regexp_matches(lower({c}), '(^|[^a-z]){w}([^a-z]|$)') THEN 300 WHEN regexp_matches(lower({c}), '(^|[^a-z]){w}') THEN 150 ELSE 0 END - least((instr(lower({c}), '{w}') - 1) // 10, 200) END"


@book.query(f"""WITH s AS (SELECT conv_id, max({_TERM('text', 'the')}) AS a, max({_TERM('text', 'tion')}) AS b FROM conversations GROUP BY 1) SELECT conv_id, CAST((a + b) // 2 AS BIGINT) AS score FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def session_search(spark, t):
    """Conversations that hold every search term, by mean score of their best turns."""
    s = t.conversations.groupBy("conv_id").agg(F.max(Q.term_score(C("text"), "the", 500)).alias("a"), F.max(Q.term_score(C("text"), "tion", 500)).alias("b"))
    return s.dropna(subset=["a", "b"]).select("conv_id", F.expr("cast(a + b as bigint) div 2").alias("score"))


@book.query("""SELECT doc_id, substr(text, greatest(p - 24, 1)::BIGINT, 98) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'the') AS p FROM documents) WHERE p > 0""")
def snippet(spark, t):
    """24 characters before and 74 after the earliest match."""
    p = F.locate("the", F.lower("text"))
    return t.documents.select("doc_id", "text", p.alias("p")).filter("p > 0").select("doc_id", F.expr("substr(text, greatest(p - 24, 1), 98)").alias("snippet"))


@book.query(f"SELECT CASE WHEN contains(name, 'energy') THEN 'energy' WHEN contains(name, 'power') THEN 'power' WHEN contains(name, 'force') OR contains(name, 'speed') THEN 'motion' ELSE 'other' END AS family, count(*) AS n FROM {STORE} GROUP BY 1")
def family_counts(spark, t):
    n = C("name")
    family = F.when(n.contains("energy"), "energy").when(n.contains("power"), "power").when(n.contains("force") | n.contains("speed"), "motion").otherwise("other")
    return R.store(spark).groupBy(family.alias("family")).agg(F.count("*").alias("n"))


# ---- conversation and prompt


@book.query(f"SELECT ord, formula || ' | ' || array_to_string(list_sort(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*')))[2:], ' ') || ' | missing:' || coalesce(nullif(req, ''), 'none') || ' | fit:high' AS prompt FROM {STORE}")
def assemble_prompt(spark, t):
    v = F.array_sort(R.variables(C("formula")))
    rest = F.array_join(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), " ")
    return R.store(spark).select("ord", F.concat("formula", F.lit(" | "), rest, F.lit(" | missing:"), F.coalesce(F.nullif("req", F.lit("")), F.lit("none")), F.lit(" | fit:high")).alias("prompt"))


@book.query(f"""WITH v AS (SELECT ord, list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*')) AS v, regexp_extract(formula, '^([A-Za-z][A-Za-z0-9_]*)', 1) AS l FROM {STORE})
  SELECT ord, coalesce(list_min(list_filter(v, lambda x: x <> l AND x <> 'm')), 'none') AS missing FROM v""")
def missing_variable(spark, t):
    """The first variable (by name) that is neither asked nor given."""
    rel = R.store(spark).select("ord", R.variables(C("formula")).alias("v"), F.regexp_extract("formula", "^([A-Za-z][A-Za-z0-9_]*)", 1).alias("l"))
    return rel.select("ord", F.coalesce(F.array_min(F.filter("v", lambda x: (x != C("l")) & (x != "m"))), F.lit("none")).alias("missing"))


@book.query("SELECT conv_id, turn, substr(text, 1, 40) || CASE WHEN length(text) > 40 THEN '..' ELSE '' END AS summary FROM conversations WHERE role = 'assistant'")
def turn_summary(spark, t):
    cut = F.concat(F.substring("text", 1, 40), F.when(F.length("text") > 40, "..").otherwise(""))
    return t.conversations.filter("role = 'assistant'").select("conv_id", "turn", cut.alias("summary"))


@book.query(f"SELECT conv_id, turn, len(regexp_extract_all('<q>' || text || '<a>x<end>', '<[a-z/]+>'))::BIGINT AS tags FROM conversations")
def span_tokens(spark, t):
    return t.conversations.select("conv_id", "turn", F.regexp_count(F.concat(F.lit("<q>"), "text", F.lit("<a>x<end>")), F.lit("<[a-z/]+>")).cast("bigint").alias("tags"))


@book.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN '<res>!give</res>' ELSE '<res>' || CAST(l_quantity AS BIGINT) || '</res>' END AS injected FROM lineitem")
def result_inject(spark, t):
    res = F.when(C("l_quantity") > 45, "!give").otherwise(C("l_quantity").cast("bigint").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("<res>"), res, F.lit("</res>")).alias("injected"))


# ---- gates


@book.query("""SELECT count(*) AS calls, count(*) FILTER (orphan) AS orphans, CASE WHEN count(*) = 0 THEN 'cannot_check' WHEN count(*) FILTER (orphan) <= 0.005 * count(*) THEN 'ok' ELSE 'fail' END AS status
  FROM (SELECT l_quantity, l_quantity <> floor(l_quantity) OR l_linenumber > 6 AS orphan FROM lineitem)""")
def gate_orphans(spark, t):
    o = t.lineitem.select(((C("l_quantity") != F.floor("l_quantity")) | (C("l_linenumber") > 6)).alias("orphan")).agg(F.count("*").alias("calls"), F.count_if("orphan").alias("orphans"))
    return o.withColumn("status", F.when(C("calls") == 0, "cannot_check").when(C("orphans") <= 0.005 * C("calls"), "ok").otherwise("fail"))


@book.query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 400000) AS outside, CASE WHEN count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 400000) <= 0.002 * count(*) THEN 'ok' ELSE 'fail' END AS status FROM orders GROUP BY 1""")
def gate_range(spark, t):
    o = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(~C("o_totalprice").between(1000, 400000)).alias("outside"))
    return o.withColumn("status", F.when(C("outside") <= 0.002 * C("n"), "ok").otherwise("fail"))


@book.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate IS NULL THEN 'UNCHECKED' WHEN l_extendedprice >= l_quantity THEN 'OK' ELSE 'MISMATCH' END AS status FROM lineitem")
def gate_plausible(spark, t):
    status = F.when(C("l_shipdate").isNull(), "UNCHECKED").when(C("l_extendedprice") >= C("l_quantity"), "OK").otherwise("MISMATCH")
    return t.lineitem.select("l_orderkey", "l_linenumber", status.alias("status"))


@book.query("SELECT CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'empty' WHEN n_chars <> length(text) THEN 'length' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def quarantine_counts(spark, t):
    reason = F.when(C("text").isNull(), "null").when(C("text") == "", "empty").when(C("n_chars") != F.length("text"), "length").otherwise("ok")
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_NUM = "[0-9]+(\\.[0-9]+)?"


@book.query(f"SELECT conv_id, bool_and(len(list_filter(a, lambda x: NOT list_contains(q, x))) = 0) AS clean FROM (SELECT conv_id, regexp_extract_all(text, '{_NUM}') AS a, regexp_extract_all(lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn), '{_NUM}') AS q FROM conversations) GROUP BY 1")
def prov_answer(spark, t):
    """Every number of a turn occurs in the turn before it."""
    found = lambda c: F.regexp_extract_all(c, F.lit(_NUM), F.lit(0))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pair = t.conversations.select("conv_id", found(C("text")).alias("a"), found(F.lag("text", 1, "").over(w)).alias("q"))
    return pair.groupBy("conv_id").agg(F.bool_and(F.size(F.array_except("a", "q")) == 0).alias("clean"))


@book.query(f"SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 1 AND 50 AND l_quantity = floor(l_quantity) AS traced FROM lineitem")
def prov_call(spark, t):
    q = C("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", (q.between(1, 50) & (q == F.floor(q))).alias("traced"))


# ---- tokens and vectors

_PRE = "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\rA-Za-z0-9]+|[ \t\n\r]+"


@book.query(f"SELECT doc_id, len(regexp_extract_all(text, '{_PRE.replace(chr(39), chr(39) * 2)}'))::BIGINT AS pieces FROM documents")
def pretokenise(spark, t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(_PRE)).cast("bigint").alias("pieces"))


@book.query(f"""SELECT pair, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, length(w) - 1), lambda i: substr(w, i, 2))) AS pair FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) > 1) GROUP BY 1""")
def bpe_pairs(spark, t):
    """One round of pair counting: words are counted first, pairs once per distinct word."""
    w = t.documents.select(F.explode(letters(C("text"), 1)).alias("w")).groupBy("w").agg(F.count("*").alias("c")).filter(F.length("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", i, F.lit(2)))
    return w.select("c", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("c").alias("n"))


@book.query("SELECT doc_id, CASE WHEN 100 * before < 99 * total THEN 'train' ELSE 'val' END AS part FROM (SELECT doc_id, sum(n_chars) OVER () AS total, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)")
def split_by_position(spark, t):
    """99/1 cut by position in the stream; totals of id blocks keep the window small."""
    block = F.expr("doc_id div 1024")
    sums = t.documents.groupBy(block.alias("block")).agg(F.sum("n_chars").alias("s"))
    upto = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n_chars").over(Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = t.documents.select("doc_id", "n_chars", block.alias("block")).withColumn("inside", inside).join(upto, "block")
    return rows.select("doc_id", F.when(100 * (C("start") + C("inside")) < 99 * C("total"), "train").otherwise("val").alias("part"))


@book.query(f"SELECT doc_id, i // 256 AS win, count(*) AS tokens FROM (SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{W_}') AS w FROM documents) WHERE len(w) > 0) GROUP BY 1, 2")
def pack_windows(spark, t):
    """Fixed windows of 256 tokens over each document's stream, from sizes alone."""
    n = t.documents.select("doc_id", F.regexp_count("text", F.lit(W_)).alias("n")).filter("n > 0")
    win = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div 256"))).alias("win"))
    return win.select("doc_id", C("win").cast("bigint").alias("win"), F.least(F.lit(256), C("n") - 256 * C("win")).cast("bigint").alias("tokens"))


_IDS = "[conv_id % 7, 101, turn % 5, 102, conv_id % 3, 101, turn % 4]"


@book.query("SELECT conv_id, turn, '1,0,0,0,1,0,0' AS mask, '0,0,1,0,0,0' AS seeded FROM conversations")
def loss_mask(spark, t):
    """Targets inside 101 .. 102 spans are masked; a window may open inside a span."""
    a, b = F.lit(101), F.lit(102)
    small = lambda c, n: (C(c) % n).cast("int")
    ids = F.array(small("conv_id", 7), a, small("turn", 5), b, small("conv_id", 3), a, small("turn", 4))
    late = F.array(small("turn", 5), b, small("conv_id", 3), a, small("turn", 4), small("turn", 3))
    show = lambda x: F.array_join(N.loss_mask(x, 101, 102).cast("array<string>"), ",")
    return t.conversations.select("conv_id", "turn", show(ids).alias("mask"), show(late).alias("seeded"))


@book.query("SELECT role, count(*) AS n, round(avg((length(text) > 300)::INT), 6) AS leak_rate FROM conversations GROUP BY 1")
def leak_rate(spark, t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg((F.length("text") > 300).cast("int")), 6).alias("leak_rate"))


_V = "list_transform(embedding, lambda x: x::DOUBLE)"


@book.query(f"""SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(sign(x) * floor(abs(x) / s + 0.5) AS INT)), ',') AS q, round(s, 9) AS scale FROM
  (SELECT vec_id, {_V} AS v, list_max(list_transform({_V}, lambda x: abs(x))) / 127 AS s FROM embeddings)""")
def quantise_group(spark, t):
    scale, q = N.quantise(C("v"))
    v = t.embeddings.select("vec_id", N.doubles(C("embedding")).alias("v"))
    return v.select("vec_id", F.array_join(q.cast("array<string>"), ",").alias("q"), F.round(scale, 9).alias("scale"))


@book.query(f"""WITH g AS (SELECT vec_id, {_V} AS v, list_max(list_transform({_V}, lambda x: abs(x))) / 127 AS s FROM embeddings), q AS (SELECT vec_id, list_transform(v, lambda x: CAST(sign(x) * floor(abs(x) / s + 0.5) AS BIGINT)) AS q FROM g)
  SELECT a.vec_id, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS dot FROM q a JOIN q b ON b.vec_id = a.vec_id + 1""")
def int8_dot(spark, t):
    """Integer dot products of neighbours' quantised groups."""
    v = t.embeddings.select("vec_id", N.doubles(C("embedding")).alias("v"))
    q = v.select("vec_id", N.quantise(C("v"))[1].alias("q"))
    b = q.select((C("vec_id") - 1).alias("vec_id"), C("q").alias("r"))
    return q.join(b, "vec_id").select("vec_id", N.dot(C("q"), C("r")).alias("dot"))


@book.query(f"SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64 + 1e-5), 6) AS first, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64 + 1e-5), 6) AS last FROM (SELECT vec_id, {_V} AS v FROM embeddings)")
def rmsnorm(spark, t):
    v = t.embeddings.select("vec_id", N.doubles(C("embedding")).alias("v")).select("vec_id", N.rmsnorm(C("v")).alias("n"))
    return v.select("vec_id", F.round(C("n")[0], 6).alias("first"), F.round(F.element_at("n", -1), 6).alias("last"))


_E8 = "list_transform(embedding, lambda x: 8 * x::DOUBLE)"
_SOFT = f"(SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, list_transform({_E8}, lambda x: exp(x - list_max({_E8}))) AS e FROM embeddings))"


def _soft(t):
    v = t.embeddings.select("vec_id", F.transform("embedding", lambda x: 8 * x.cast("double")).alias("v"))
    return v.select("vec_id", N.softmax(C("v")).alias("p"))


@book.query(f"SELECT vec_id, round(p[1], 6) AS first, round(list_max(p), 6) AS top FROM {_SOFT}")
def softmax(spark, t):
    return _soft(t).select("vec_id", F.round(C("p")[0], 6).alias("first"), F.round(F.array_max("p"), 6).alias("top"))


@book.query(f"SELECT vec_id, list_position(p, list_max(p))::BIGINT - 1 AS token FROM {_SOFT}")
def argmax_token(spark, t):
    return _soft(t).select("vec_id", (F.array_position("p", F.array_max("p")) - 1).alias("token"))


@book.query(f"""WITH s AS (SELECT vec_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM {_SOFT}), c AS (SELECT vec_id, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
  SELECT vec_id, count(*) AS kept FROM c WHERE coalesce(before, 0) < 0.9 GROUP BY 1""")
def topp_sample(spark, t):
    """Size of the nucleus: the fewest most likely tokens that reach 0.9."""
    sorted_ = _soft(t).select("vec_id", F.sort_array("p", asc=False).alias("p"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    n = F.aggregate("p", start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.when(a["s"] < 0.9, a["n"] + 1).otherwise(a["n"]).alias("n")))["n"]
    return sorted_.select("vec_id", n.alias("kept"))


@book.query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.001 * (event_id + 1) / 100 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * least(event_id - 100, 900) / 900)) END, 9) AS lr FROM events")
def lr_schedule(spark, t):
    """Linear warm-up over 100 steps, then a cosine to a tenth."""
    e = C("event_id")
    lr = F.when(e < 100, 0.001 * (e + 1) / 100).otherwise(0.0001 + 0.0009 * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(e - 100, F.lit(900)) / 900)))
    return t.events.select("event_id", F.round(lr, 9).alias("lr"))


@book.query(f"SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def stat_array(spark, t):
    return t.lineitem.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@book.query("""WITH c AS (SELECT p_partkey, 1 + p_partkey % 3 AS a, p_size - 25 AS b, 5 - p_size % 11 AS c FROM part), d AS (SELECT *, b * b - 4 * a * c AS d FROM c)
  SELECT p_partkey, CASE WHEN d < 0 THEN 'complex' WHEN d = 0 THEN 'double' ELSE 'real' END AS kind, CASE WHEN d >= 0 THEN round((-b - sqrt(d)) / (2 * a), 6) END AS low, CASE WHEN d >= 0 THEN round((-b + sqrt(d)) / (2 * a), 6) END AS high FROM d""")
def solve_quadratic(spark, t):
    c = t.part.select("p_partkey", (1 + C("p_partkey") % 3).alias("a"), (C("p_size") - 25).alias("b"), (5 - C("p_size") % 11).alias("c")).withColumn("d", C("b") * C("b") - 4 * C("a") * C("c"))
    root = lambda s: F.when(C("d") >= 0, F.round((-C("b") + s * F.sqrt(F.greatest("d", F.lit(0)))) / (2 * C("a")), 6))
    return c.select("p_partkey", F.when(C("d") < 0, "complex").when(C("d") == 0, "double").otherwise("real").alias("kind"), root(-1).alias("low"), root(1).alias("high"))


@book.query("""SELECT p_partkey, round(list_sum(list_transform(generate_series(0, 64), lambda i: CASE WHEN i IN (0, 64) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * sin(i * p_size / 64.0))) * p_size / 192.0, 6) AS area FROM part""")
def simpson_composite(spark, t):
    """Composite Simpson of sin over [0, size] with 64 panels, as an array expression."""
    h = C("p_size") / 64.0
    f = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.when(i.isin(0, 64), 1).when(i % 2 == 1, 4).otherwise(2) * F.sin(i * h))
    return t.part.select("p_partkey", F.round(N.total(f) * C("p_size") / 192.0, 6).alias("area"))


@book.query("""WITH s AS (SELECT vec_id, label, embedding[1:8] AS k FROM embeddings) SELECT label, count(*) AS n, round(avg(k[1]::DOUBLE), 6) AS m1, round(avg(k[8]::DOUBLE), 6) AS m8 FROM s GROUP BY 1""")
def attention_mix(spark, t):
    """Mean of value vectors under uniform attention within a label."""
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(C("embedding")[0].cast("double")), 6).alias("m1"), F.round(F.avg(C("embedding")[7].cast("double")), 6).alias("m8"))


@book.query("""SELECT p_partkey, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.4f', v), '0+$', '') END AS shown FROM (SELECT p_partkey, p_size / 8.0 AS v FROM part)""")
def fmt_fixed(spark, t):
    """Fixed-band number format: trailing zeros and a bare point stripped."""
    v = C("p_size") / 8.0
    return t.part.select("p_partkey", F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.4f", v), "0+$", "")).alias("shown"))


# ---- synthesis

_ROLL = "((doc_id * 1103515245 + 12345) % 32768 / 32768.0)"


@book.query(f"SELECT CASE WHEN u < 0.10 THEN 'D1' WHEN u < 0.15 THEN 'D2' WHEN u < 0.18 THEN 'D3' WHEN u < 0.22 THEN 'EXPLAIN' ELSE 'ANSWER' END AS kind, count(*) AS n FROM (SELECT {_ROLL} AS u FROM documents) GROUP BY 1")
def roll_class(spark, t):
    u = F.pmod(C("doc_id") * 1103515245 + 12345, F.lit(32768)) / 32768.0
    kind = F.when(u < 0.10, "D1").when(u < 0.15, "D2").when(u < 0.18, "D3").when(u < 0.22, "EXPLAIN").otherwise("ANSWER")
    return t.documents.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@book.query(f"""SELECT p_partkey, ord, 'Find p for m = ' || (p_size + 1) || ' and v = ' || (p_partkey % 9 + 1) || '.' AS question, (p_size + 1) * (p_partkey % 9 + 1) AS answer FROM part JOIN {STORE} ON ord = 0""")
def synth_answer(spark, t):
    """ANSWER documents: givens drawn per row, evaluated, put into a template."""
    m, v = C("p_size") + 1, C("p_partkey") % 9 + 1
    q = F.concat(F.lit("Find p for m = "), m.cast("string"), F.lit(" and v = "), v.cast("string"), F.lit("."))
    return t.part.crossJoin(F.broadcast(R.store(spark).filter("ord = 0").select("ord"))).select("p_partkey", "ord", q.alias("question"), (m * v).alias("answer"))  # one record
