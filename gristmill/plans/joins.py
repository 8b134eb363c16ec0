"""Join, window, ordering, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.words import letters, words
from ..operators import measures as M
from ..operators import relations as R
from ..operators import retrieval as Q
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
STORE = R.store_sql()
W_ = r"[^ \t\n\r]+"


@book.query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_inner(spark, t):
    # orders are summed per customer before the join, so one row a customer meets the dimensions
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    joined = per.join(t.customer, per.o_custkey == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"))


@book.query("""SELECT p_partkey, coalesce(CASE WHEN p_size < 10 THEN p_size END, s_suppkey, -1)::BIGINT AS value FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def join_left_coalesce(spark, t):
    """The first source that knows a value wins."""
    own = F.when(F.col("p_size") < 10, F.col("p_size")).cast("bigint")
    return t.part.join(t.supplier.select("s_suppkey"), F.col("s_suppkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce(own, "s_suppkey", F.lit(-1)).alias("value"))


@book.query("""WITH w AS (SELECT l_returnflag, l_linestatus, min(l_quantity) AS lo, max(l_quantity) - 5 AS hi FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
  SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_quantity BETWEEN lo AND hi) AS inside FROM lineitem LEFT JOIN w USING (l_returnflag, l_linestatus) GROUP BY 1, 2""")
def join_composite(spark, t):
    keys = ["l_returnflag", "l_linestatus"]
    window = t.lineitem.filter("l_linenumber = 1").groupBy(*keys).agg(F.min("l_quantity").alias("lo"), (F.max("l_quantity") - 5).alias("hi"))
    counted = t.lineitem.groupBy(*keys, "l_quantity").agg(F.count("*").alias("c")).join(window, keys, "left")
    return counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("l_quantity").between(F.col("lo"), F.col("hi")), F.col("c"))), F.lit(0)).alias("inside"))


@book.query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, t):
    big = t.orders.filter("o_totalprice > 200000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@book.query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark, t):
    big = t.orders.filter("o_totalprice > 200000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@book.query("""SELECT o_orderstatus, l_returnflag, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY 1, 2""")
def join_range(spark, t):
    late = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return t.orders.join(t.lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & late).groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"))


@book.query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b, CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' WHEN a.n = b.n THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def parity_diff(spark, t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_a"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_b"))
    status = F.when(F.col("n_a").isNull(), "only_b").when(F.col("n_b").isNull(), "only_a").when(F.col("n_a") == F.col("n_b"), "same").otherwise("differs")
    return a.join(b, "k", "full_outer").withColumn("status", status)


_NAMES = "(SELECT DISTINCT lower(unnest(regexp_extract_all(name, '[A-Za-z]+'))) AS w FROM " + STORE + ")"


@book.query(f"SELECT a.w AS word, b.w AS near FROM {_NAMES} a JOIN (SELECT DISTINCT p_type AS w FROM part UNION SELECT DISTINCT lower(unnest(regexp_extract_all(name, '[A-Za-z]+'))) || 's' FROM {STORE}) b ON abs(length(a.w) - length(b.w)) <= 2 AND levenshtein(a.w, b.w) <= 2 AND a.w <> b.w")
def fuzzy_join(spark, t):
    """Words of the relation store against misspellings: edit distance within 2.

    The store is a dimension of fixed size, so it is broadcast; a length band goes first.
    """
    own = R.store(spark).select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    other = t.part.select(F.col("p_type").alias("near")).union(own.select(F.concat("word", F.lit("s")))).distinct()
    band = F.abs(F.length("word") - F.length("near")) <= 2
    return other.join(F.broadcast(own), band & (F.levenshtein("word", "near", 2) >= 0) & (F.col("word") != F.col("near"))).select("word", "near")


@book.query(f"""SELECT doc_id, i::BIGINT AS place, a AS word, b AS next FROM (SELECT doc_id, unnest(generate_series(1, len(w) - 1)) AS i, w FROM (SELECT doc_id, regexp_extract_all(text, '{W_}') AS w FROM documents) WHERE len(w) > 1),
  LATERAL (SELECT w[i] AS a, w[i + 1] AS b)""")
def zip_join(spark, t):
    """Two ordered lists paired by position."""
    w = t.documents.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 1)
    n = F.size("w") - 1
    pairs = F.arrays_zip(F.slice("w", 1, n).alias("a"), F.slice("w", 2, n).alias("b"))
    return w.select("doc_id", F.posexplode(pairs).alias("i", "p")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("place"), F.col("p.a").alias("word"), F.col("p.b").alias("next"))


@book.query("SELECT p_type, count(DISTINCT p_size) AS windows, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def self_conflict(spark, t):
    """Keys that are declared with more than one value."""
    return t.part.groupBy("p_type").agg(F.count_distinct("p_size").alias("windows"), F.min("p_size").alias("low"), F.max("p_size").alias("high")).filter("windows > 1")


@book.query("""SELECT a.l_orderkey AS item, a.l_quantity AS before, b.l_quantity AS after, CASE WHEN a.l_quantity = b.l_quantity THEN 'same' WHEN a.l_quantity < b.l_quantity THEN 'gained' ELSE 'lost' END AS outcome
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2""")
def paired_outcomes(spark, t):
    a = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("item"), F.col("l_quantity").alias("before"))
    b = t.lineitem.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("item"), F.col("l_quantity").alias("after"))
    outcome = F.when(F.col("before") == F.col("after"), "same").when(F.col("before") < F.col("after"), "gained").otherwise("lost")
    return a.join(b, "item").withColumn("outcome", outcome)


@book.query("""SELECT c_custkey, (c_custkey * 1103515245 + 12345) % (SELECT count(*) FROM supplier) + 1 AS partner, s_nationkey FROM customer JOIN supplier ON s_suppkey = (c_custkey * 1103515245 + 12345) % (SELECT count(*) FROM supplier) + 1""")
def partner_join(spark, t):
    """Each row meets a pseudo-random partner: an equi-join on a hashed index."""
    n = F.broadcast(t.supplier.agg(F.count("*").alias("n")))  # one row
    a = t.customer.select("c_custkey").crossJoin(n).select("c_custkey", F.expr("(c_custkey * 1103515245 + 12345) % n + 1").alias("partner"))
    return a.join(t.supplier, a.partner == F.col("s_suppkey")).select("c_custkey", "partner", "s_nationkey")


@book.query(f"""WITH g AS (SELECT ord, list_sort(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*'))) AS v FROM {STORE}), q AS (SELECT * FROM (VALUES (0, ['m', 'v']), (1, ['F', 't']), (2, ['I', 'R', 'q'])) AS q(qid, given))
  SELECT qid, ord FROM q JOIN g ON len(list_filter(given, lambda x: NOT list_contains(v, x))) = 0 AND len(v) - len(given) = 1""")
def givens_bind(spark, t):
    """Relations whose variables hold all givens and exactly one more: explode, join, count."""
    rel = R.store(spark).select("ord", R.variables(F.col("formula")).alias("v"))
    asked = spark.createDataFrame([(0, ["m", "v"]), (1, ["F", "t"]), (2, ["I", "R", "q"])], "qid int, given array<string>")
    hit = asked.select("qid", F.size("given").alias("k"), F.explode("given").alias("x")).join(rel.select("ord", F.size("v").alias("n"), F.explode("v").alias("x")), "x")
    return hit.groupBy("qid", "ord", "k", "n").agg(F.count("*").alias("c")).filter("c = k and n - k = 1").select("qid", "ord")


_Q = "(SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM benchmark)"
_D = "(SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents)"


@book.query(f"""WITH d AS {_D}, df AS (SELECT word, count(*) AS n FROM d GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS hits FROM {_Q} q JOIN d USING (word) JOIN df USING (word) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM m) SELECT item_id, doc_id, hits, rank FROM r WHERE rank <= 3""")
def retrieval_cross(spark, t):
    """Every question against every document, through the words they share."""
    docs = t.documents.select("doc_id", F.explode(F.array_distinct(letters(F.col("text")))).alias("word"))
    rare = docs.groupBy("word").agg(F.count("*").alias("n"))
    asked = t.benchmark.select("item_id", F.explode(F.array_distinct(letters(F.col("text")))).alias("word"))
    hits = Q.asked_only(docs, asked).join(Q.few(asked)(asked.join(rare, "word")), "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))
    return hits.withColumn("rank", rank).filter("rank <= 3").select("item_id", "doc_id", "hits", "rank")


# ---- windows


@book.query("SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice > 0) WHERE r <= 3")
def topk_per_question(spark, t):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.filter("o_totalprice > 0").withColumn("rank", rank).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@book.query("""SELECT c_custkey, coalesce(arg_max(o_orderkey, (o_totalprice, -o_orderkey)), 0) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def argmax_first(spark, t):
    """First maximum wins; without candidates the default 0 is returned."""
    best = t.orders.groupBy("o_custkey").agg((-F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))["k"]).alias("b"))
    return t.customer.join(best, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("b", F.lit(0)).alias("best"))


@book.query("""SELECT user_id, top, second, CASE WHEN top >= 3 AND top > coalesce(second, 0) THEN 'high' ELSE 'low' END AS band FROM
  (SELECT user_id, max(n) FILTER (r = 1) AS top, max(n) FILTER (r = 2) AS second FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) GROUP BY 1)""")
def margin_band(spark, t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    top = n.select("user_id", F.col("n").alias("top"), F.lead("n").over(w).alias("second"), F.row_number().over(w).alias("r")).filter("r = 1")
    return top.select("user_id", "top", "second", F.when((F.col("top") >= 3) & (F.col("top") > F.coalesce("second", F.lit(0))), "high").otherwise("low").alias("band"))


@book.query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS mean12 FROM events")
def window_mean_pos(spark, t):
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(-11, 0)
    return t.events.select("event_id", F.round(F.avg("value").over(w), 6).alias("mean12"))


@book.query("SELECT event_type, event_id // 500 AS step, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def window_500(spark, t):
    return t.events.groupBy("event_type", F.expr("event_id div 500").alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@book.query("""WITH d AS (SELECT o_orderpriority AS p, o_orderdate AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), m AS (SELECT p, day, v, avg(v) OVER (PARTITION BY p ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mv FROM d)
  SELECT p, round(min(mv), 2) AS best, round(arg_max(mv, day), 2) AS last, arg_max(mv, day) > min(mv) + stddev_samp(v) AS diverged FROM m GROUP BY 1""")
def divergence_rule(spark, t):
    d = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("v"))
    m = d.withColumn("mv", F.avg("v").over(Window.partitionBy("p").orderBy("day").rowsBetween(-9, 0)))
    out = m.groupBy("p").agg(F.min("mv").alias("best"), F.max_by("mv", "day").alias("last"), F.stddev_samp("v").alias("sd"))
    return out.select("p", F.round("best", 2).alias("best"), F.round("last", 2).alias("last"), (F.col("last") > F.col("best") + F.col("sd")).alias("diverged"))


@book.query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') AS has_the, regexp_matches(lower(text), '(^|[^a-z])der([^a-z]|$)') AS has_der FROM documents")
def word_in(spark, t):
    has = lambda w: F.lower("text").rlike(f"(^|[^a-z]){w}([^a-z]|$)")
    return t.documents.select("doc_id", has("the").alias("has_the"), has("der").alias("has_der"))


@book.query(f"SELECT ord, array_to_string(list_reverse(list_sort(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*')))), ',') AS sorted_vars, len(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*')))::BIGINT AS n FROM {STORE}")
def array_distinct_order(spark, t):
    v = R.variables(F.col("formula"))
    return R.store(spark).select("ord", F.array_join(F.sort_array(v, asc=False), ",").alias("sorted_vars"), F.size(v).cast("bigint").alias("n"))


@book.query("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS first_seen FROM events GROUP BY 1, 2")
def last_wins(spark, t):
    """The last assignment wins, in the place of the first mention."""
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.min("event_id").alias("first_seen"))


@book.query("SELECT user_id, max(event_id) AS latest, row_number() OVER (ORDER BY max(event_id) DESC) AS place FROM events GROUP BY 1 ORDER BY latest DESC LIMIT 50")
def recent_first(spark, t):
    """A top-50 report: the limit comes before the numbering, so only 50 rows are numbered."""
    latest = t.events.groupBy("user_id").agg(F.max("event_id").alias("latest")).orderBy(F.desc("latest")).limit(50)
    return latest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("latest"))))


@book.query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 THEN length(text) ELSE least(length(text), 40) END AS cost FROM conversations),
  s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY back) AS upto FROM r) SELECT conv_id, turn, back, CAST(upto AS BIGINT) AS upto FROM s WHERE upto <= 600""")
def context_budget(spark, t):
    """Newest turns first: the last two verbatim, older ones as 40 characters, within 600."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = t.conversations.select("conv_id", "turn", F.length("text").alias("size"), F.row_number().over(newest).alias("back"))
    r = r.withColumn("cost", F.when(F.col("back") <= 2, F.col("size")).otherwise(F.least("size", F.lit(40))))
    return r.withColumn("upto", F.sum("cost").over(Window.partitionBy("conv_id").orderBy("back"))).filter("upto <= 600").select("conv_id", "turn", "back", "upto")


@book.query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0")
def stride_sample(spark, t):
    """Every seventh document by its id: sampling is the operator."""
    return t.documents.filter("doc_id % 7 = 0").select("doc_id")


@book.query("SELECT doc_id, sha256('pick:' || doc_id) AS h FROM documents ORDER BY h LIMIT 25")
def hash_pick(spark, t):
    return t.documents.select("doc_id", F.sha2(F.concat(F.lit("pick:"), F.col("doc_id").cast("string")), 256).alias("h")).orderBy("h").limit(25)


@book.query("SELECT c_custkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY round(c_acctbal / 100))")
def win_rank(spark, t):
    w = Window.partitionBy("c_mktsegment").orderBy(F.round(F.col("c_acctbal") / 100))
    q = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return t.customer.select("c_custkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(q).alias("quartile"))


@book.query("SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(value) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def win_lag(spark, t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.first("value").over(w).alias("first"))


@book.query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM events")
def win_frame(spark, t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", F.count("*").over(w.rowsBetween(-2, 2)).alias("near"), F.max("value").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("ahead"))


# ---- ordering and sampling


@book.query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(embedding, lambda x: round(x::DOUBLE, 3))), lambda x: printf('%.3f', x + 0.0)), ' ') AS low FROM embeddings")
def sort_array(spark, t):
    v = F.array_sort(F.transform("embedding", lambda x: F.round(x.cast("double"), 3)))
    return t.embeddings.select("vec_id", F.array_join(F.transform(v, lambda x: F.format_string("%.3f", x + 0.0)), " ").alias("low"))


@book.query("SELECT p_name, length(p_name) AS n FROM (SELECT DISTINCT p_name FROM part) ORDER BY length(p_name) DESC, p_name")
def longest_first(spark, t):
    return t.part.select("p_name").distinct().withColumn("n", F.length("p_name")).orderBy(F.desc("n"), "p_name")


@book.query()
def seeded_shuffle(spark, t):
    """A global order by a hash of id and seed: range-partitioned, repeatable at any cluster size."""
    return t.documents.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")


@book.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_ordered(spark, t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


_U = "(c_custkey * 1103515245 + 12345) % 32768 / 32768.0"


@book.query(f"SELECT pick, count(*) AS n FROM (SELECT CASE WHEN {_U} < 0.16 THEN 2 WHEN {_U} < 0.43 THEN 3 WHEN {_U} < 0.73 THEN 4 ELSE 5 END AS pick FROM customer) GROUP BY 1")
def weighted_draw(spark, t):
    """Weights .16 .27 .30 .27 against a hashed uniform number."""
    u = M.lcg(F.col("c_custkey")) / 32768.0
    pick = F.when(u < 0.16, 2).when(u < 0.43, 3).when(u < 0.73, 4).otherwise(5)
    return t.customer.groupBy(pick.alias("pick")).agg(F.count("*").alias("n"))


@book.query("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS size, count(*) OVER () AS total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 1103515245 + 12345) % 32768, c_custkey) AS r FROM customer)
  SELECT c_mktsegment, c_custkey FROM s WHERE r <= greatest(1, floor(25 * size / total + 0.5))""")
def stratified_draw(spark, t):
    """Proportional strata of about 25 rows in all, at least one each."""
    sizes = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("size"))
    quota = sizes.withColumn("quota", F.greatest(F.lit(1), F.floor(25 * F.col("size") / F.sum("size").over(Window.partitionBy()) + 0.5)))
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(M.lcg(F.col("c_custkey")), "c_custkey"))
    ranked = t.customer.select("c_mktsegment", "c_custkey", r.alias("r"))
    return ranked.join(F.broadcast(quota), "c_mktsegment").filter("r <= quota").select("c_mktsegment", "c_custkey")


def _uniform(*of):
    return (F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") + 0.5) / float(1 << 53)


@book.query()
def retry_draw(spark, t):
    """Up to 24 hashed candidates per row, the first that meets the condition; else null."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.floor(_uniform("p_partkey", i) * 100))
    return t.part.select("p_partkey", "p_size", F.get(F.filter(draws, lambda x: x > F.col("p_size")), F.lit(0)).alias("drawn"))


#: Values that people write down, fixed values of this repository.
POOL = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.5, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0, 60.0, 75.0, 90.0)


@book.query()
def sample_in_range(spark, t):
    """A value between 1 and a part's bound, negative for every thirteenth part.

    Where five values of the pool lie in the range, one of them; else log-uniform, to
    three significant figures.
    """
    top = F.when(F.col("p_partkey") % 2 == 0, F.lit(3.5)).otherwise(F.col("p_retailprice"))
    near = F.filter(F.array(*map(F.lit, POOL)), lambda x: (x >= 1) & (x <= top))
    v = F.exp(_uniform("p_partkey", F.lit(3)) * F.ln(top))
    scale = F.pow(F.lit(10.0), 2 - F.floor(F.log10(v)))
    pick = F.get(near, F.floor(_uniform("p_partkey", F.lit(4)) * F.size(near)).cast("int"))
    value = F.when(F.size(near) >= 5, pick).otherwise(F.floor(v * scale + 0.5) / scale)
    return t.part.select("p_partkey", top.alias("top"), (value * F.when(F.col("p_partkey") % 13 == 0, -1).otherwise(1)).alias("value"))


@book.query("""SELECT p_partkey, unnest(generate_series(1, CASE ('0x' || substr(sha256('dose:' || p_partkey), 1, 8))::BIGINT % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END)) AS copy FROM part""")
def dose_replicate(spark, t):
    """8, 16 or 32 copies by the first four bytes of a salted digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("dose:"), F.col("p_partkey").cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 3
    n = F.when(h == 0, 8).when(h == 1, 16).otherwise(32)
    return t.part.select("p_partkey", F.explode(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).alias("copy"))


# ---- sets


@book.query("SELECT 'doc' AS tier, doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages")
def union_tiers(spark, t):
    docs = t.documents.select(F.lit("doc").alias("tier"), F.col("doc_id").alias("id"), "lang")
    pages = t.pages.select(F.lit("page").alias("tier"), F.col("page_id").alias("id"), "url")
    return docs.unionByName(pages, allowMissingColumns=True)


@book.query("SELECT count(*) AS shared, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'fail' END AS status FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)")
def splits_disjoint(spark, t):
    shared = t.documents.select("text").intersect(t.benchmark.select("text"))
    return shared.agg(F.count("*").alias("shared")).withColumn("status", F.when(F.col("shared") == 0, "ok").otherwise("fail"))


@book.query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_except(spark, t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.filter("s_acctbal > 0").select("s_nationkey"))


@book.query("SELECT count(*) AS missing, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'fail' END AS status FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def coverage_gate(spark, t):
    missing = t.supplier.join(t.customer, F.col("s_nationkey") == F.col("c_nationkey"), "left_anti")
    return missing.agg(F.count("*").alias("missing")).withColumn("status", F.when(F.col("missing") == 0, "ok").otherwise("fail"))


@book.query("SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def dedup_exact(spark, t):
    """Distinct texts: the 16-byte digest is shuffled, not the text."""
    return t.documents.select(F.md5("text").alias("text_md5")).distinct()


@book.query("SELECT lower(regexp_extract(text, '[^ \t\n\r]+')) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first(spark, t):
    return t.documents.groupBy(F.lower(F.regexp_extract("text", W_, 0)).alias("key")).agg(F.min("doc_id").alias("doc_id"))


@book.query("SELECT md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_normalised(spark, t):
    key = F.md5(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""))
    return t.documents.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


@book.query(f"SELECT a.ord AS a, b.ord AS b FROM {STORE.replace('store(', 'a(')} JOIN {STORE.replace('store(', 'b(')} ON a.ord < b.ord AND list_sort(regexp_extract_all(a.formula, '[A-Za-z]+')) = list_sort(regexp_extract_all(b.formula, '[A-Za-z]+'))")
def multiset_equal(spark, t):
    """Relations with the same leaves as multisets: an equi-join on the sorted list."""
    s = R.store(spark).select("ord", F.array_join(F.sort_array(F.regexp_extract_all("formula", F.lit("[A-Za-z]+"), F.lit(0))), ",").alias("leaves"))
    return s.select(F.col("ord").alias("a"), "leaves").join(s.select(F.col("ord").alias("b"), "leaves"), "leaves").filter("a < b").select("a", "b")


@book.query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def decontam_exact(spark, t):
    return t.documents.join(t.benchmark.select("text"), "text", "left_anti").select("doc_id")


@book.query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def decontam_contains(spark, t):
    """Documents that hold no benchmark passage verbatim.

    Passages meet documents through the hash of their second to sixth word, then whole
    passages are compared.  Passages of fewer than seven words are broadcast up to
    SHORT of them; beyond that they meet documents through their first characters.
    """
    head = lambda k: F.xxhash64(*(F.get("w", F.lit(k) + i) for i in range(5)))
    bench = t.benchmark.select(F.col("text").alias("passage"), words(F.col("text")).alias("w")).distinct()
    long = bench.filter(F.size("w") >= 7).select("passage", head(1).alias("gram"))
    short = bench.filter(F.size("w") < 7).select("passage")
    docs = t.documents.select("doc_id", "text")
    # inner words of a passage are whole words of the document too; white space may differ
    told = docs.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") >= 5)
    grams = told.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(5))))).alias("gram"))
    few = F.broadcast if long.count() <= SHORT else lambda df: df
    hit = grams.join(few(long.select("gram").distinct()), "gram", "left_semi").join(long, "gram").select("doc_id", "passage").distinct()
    hit = hit.join(docs, "doc_id").filter(F.col("text").contains(F.col("passage"))).select("doc_id")
    n = short.count()
    if n:
        hit = hit.union(docs.join(F.broadcast(short), F.col("text").contains(F.col("passage"))).select("doc_id") if n <= SHORT else by_windows(docs, short))
    return t.documents.select("doc_id").join(hit, "doc_id", "left_anti")


#: Short passages up to this number are broadcast, and first characters by which more of them meet documents.
SHORT, FIRST = 10_000, 8


def by_windows(docs, short):
    """Ids of documents that hold a short passage: an equi-join on runs of as many characters as it has, FIRST at most."""
    size = F.least(F.length("passage"), F.lit(FIRST))
    keyed = short.withColumn("size", size).withColumn("run", F.expr("substr(passage, 1, size)"))
    out = None
    for n in sorted(r[0] for r in keyed.select("size").distinct().collect()):  # FIRST + 1 at most
        if n == 0:
            found = docs.filter(F.col("text").isNotNull()).select("doc_id")
        else:
            places = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - (n - 1))).otherwise(F.array().cast("array<int>"))
            runs = docs.select("doc_id", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("text", i, F.lit(n))))).alias("run"))
            pairs = runs.join(keyed.filter(F.col("size") == n).select("run", "passage"), "run").select("doc_id", "passage")
            found = pairs.join(docs, "doc_id").filter(F.col("text").contains(F.col("passage"))).select("doc_id")
        out = found if out is None else out.union(found)
    return out
