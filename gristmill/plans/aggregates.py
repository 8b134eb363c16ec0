"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.words import gram_keys, grams, letters, words
from ..operators import measures as M
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
W = r"[^ \t\n\r]+"


@book.query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def class_share(spark, t):
    return M.share_of(t.documents, "source")


@book.query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def stat_basic(spark, t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"))


@book.query("SELECT l_returnflag, median(l_quantity) AS median_qty, round(median(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY 1")
def stat_median(spark, t):
    return t.lineitem.groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_qty"), F.round(F.median("l_extendedprice"), 4).alias("median_price"))


@book.query("""SELECT l_returnflag, l_linestatus, CASE WHEN count(*) < 2 THEN '!domain' ELSE 'ok' END AS status,
  round(var_samp(l_quantity), 6) AS var, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1, 2""")
def stat_var_sd(spark, t):
    status = F.when(F.count(F.lit(1)) < 2, "!domain").otherwise("ok").alias("status")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(status, F.round(F.var_samp("l_quantity"), 6).alias("var"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))


@book.query("""SELECT source, n, round(n / t, 6) AS share, CASE WHEN n / t BETWEEN 0.045 AND 0.055 THEN 'ok' ELSE 'fail' END AS status
  FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS t FROM documents GROUP BY source)""")
def band_check(spark, t):
    out = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("__s", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return out.select("source", "n", F.round("__s", 6).alias("share"), F.when(F.col("__s").between(0.045, 0.055), "ok").otherwise("fail").alias("status"))


_GRAMS = f"""(SELECT source, unnest(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) AS gram
  FROM (SELECT source, regexp_extract_all(text, '{W}') AS w FROM documents) WHERE len(w) >= 4)"""


@book.query(f"SELECT count(*) AS total, count(DISTINCT gram) AS different, round(count(DISTINCT gram) / count(*), 6) AS ratio FROM {_GRAMS}")
def distinct_4gram(spark, t):
    # counted per gram first: one partially aggregated shuffle of hashes, no expansion for the distinct count
    per = t.documents.select(words(F.col("text")).alias("w")).select(F.explode(gram_keys("w", 4)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("different")).withColumn("ratio", F.round(F.col("different") / F.col("total"), 6))


@book.query(f"SELECT source, count(*) AS total, count(DISTINCT gram) AS different, round(count(DISTINCT gram) / count(*), 6) AS ratio FROM {_GRAMS} GROUP BY source")
def distinct_4gram_by_source(spark, t):
    per = t.documents.select("source", words(F.col("text")).alias("w")).select("source", F.explode(gram_keys("w", 4)).alias("gram")).groupBy("source", "gram").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("source").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("different")).withColumn("ratio", F.round(F.col("different") / F.col("total"), 6))


@book.query(f"""WITH c AS (SELECT source, regexp_replace(lower(w), '[0-9]+', '#', 'g') AS phrase, count(*) AS c FROM (SELECT source, unnest(regexp_extract_all(text, '{W}')) AS w FROM documents) GROUP BY 1, 2)
  SELECT source, CAST(sum(c) AS BIGINT) AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY source""")
def phrase_entropy(spark, t):
    """Entropy of the words of each source, numbers masked."""
    said = t.documents.select("source", F.explode(words(F.col("text"))).alias("w")).groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    # words are counted as they stand; only distinct ones are masked
    masked = said.groupBy("source", F.regexp_replace(F.lower("w"), "[0-9]+", "#").alias("phrase")).agg(F.sum("n").alias("c"))
    return M.entropy_of_counts(masked, "source")


@book.query("""SELECT source, count(DISTINCT lang) AS used, (SELECT count(DISTINCT lang) FROM documents) AS declared,
  round(count(DISTINCT lang) / (SELECT count(DISTINCT lang) FROM documents), 6) AS coverage FROM documents GROUP BY source""")
def head_coverage(spark, t):
    pairs = t.documents.select("source", "lang").distinct()
    declared = pairs.agg(F.count_distinct("lang").alias("declared"))  # one row
    used = pairs.groupBy("source").agg(F.count("lang").alias("used"))
    return used.crossJoin(F.broadcast(declared)).withColumn("coverage", F.round(F.col("used") / F.col("declared"), 6))


_TERMS = "(SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)"


@book.query(f"SELECT word, count(*) AS n FROM {_TERMS} GROUP BY word")
def doc_freq(spark, t):
    return t.documents.select(F.explode(letters(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"""SELECT word, count(*) AS n, CAST((16 * (floor(log2((SELECT count(*) FROM documents) // count(*)))::BIGINT + 1)) // 2 AS BIGINT) AS idf
  FROM {_TERMS} GROUP BY word HAVING count(*) <= (SELECT count(*) FROM documents)""")
def idf16(spark, t):
    """16 * (floor(log2(N div df)) + 1) / 2 in integers: the bit length of N div df."""
    df = t.documents.select(F.explode(letters(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(t.documents.agg(F.count(F.lit(1)).alias("__total")))  # one row
    return df.crossJoin(total).filter("n <= __total").select("word", "n", F.expr("cast(16 * length(bin(__total div n)) div 2 as bigint)").alias("idf"))


_LABELLED = "documents JOIN labels USING (doc_id)"


@book.query(f"""SELECT n, cued, positive, "both", round("both" / cued, 6) AS precision, round(positive / n, 6) AS base_rate, round(("both" / cued) / (positive / n), 6) AS lift
  FROM (SELECT count(*) AS n, count(*) FILTER (contains(text, '!!')) AS cued, count(*) FILTER (quality = 0) AS positive,
    count(*) FILTER (contains(text, '!!') AND quality = 0) AS "both" FROM {_LABELLED})""")
def cue_lift(spark, t):
    return M.lift(t.documents.join(t.labels, "doc_id"), F.col("text").contains("!!"), F.col("quality") == 0)


@book.query(f"SELECT quality, least(len(regexp_extract_all(text, '[|!#$%&]')), 3)::BIGINT AS bucket, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2")
def count_buckets(spark, t):
    bucket = F.least(F.regexp_count("text", F.lit("[|!#$%&]")), F.lit(3)).cast("bigint")
    return t.documents.join(t.labels, "doc_id").groupBy("quality", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@book.query(f"""SELECT gram, count(*) FILTER (toxic = 1) AS inside FROM
  (SELECT toxic, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}'))) AS gram FROM {_LABELLED})
  GROUP BY gram HAVING count(*) FILTER (toxic = 1) >= 3 AND count(*) FILTER (toxic <> 1) = 0""")
def ngram_leak(spark, t):
    return M.leaks(t.documents.join(t.labels, "doc_id"), letters(F.col("text")), F.col("toxic") == 1, 3)


@book.query(f"""SELECT feature, round(max(rate) - min(rate), 6) AS gap FROM (
  SELECT quality, unnest(['bar', 'bang', 'sign', 'feed']) AS feature, unnest([avg(contains(text, ' | ')::INT), avg(contains(text, '!!')::INT), avg(contains(text, '$$$')::INT), avg(contains(text, chr(10))::INT)]) AS rate
  FROM {_LABELLED} GROUP BY quality) GROUP BY feature""")
def feature_gap(spark, t):
    cues = {"bar": " | ", "bang": "!!", "sign": "$$$", "feed": "\n"}
    rates = t.documents.join(t.labels, "doc_id").groupBy("quality").agg(*[F.avg(F.col("text").contains(c).cast("int")).alias(k) for k, c in cues.items()])
    long = rates.select(F.explode(F.create_map(*[x for k in cues for x in (F.lit(k), F.col(k))])).alias("feature", "rate"))
    return long.groupBy("feature").agg(F.round(F.max("rate") - F.min("rate"), 6).alias("gap"))


@book.query("""WITH s AS (SELECT o_orderpriority AS arm, o_orderstatus AS stratum, o_orderkey % 3 AS seed, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS k FROM orders GROUP BY 1, 2, 3)
  SELECT arm, stratum, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, round(avg(k / n), 6) AS mean, round(min(k / n), 6) AS low, round(max(k / n), 6) AS high, count(*) AS seeds FROM s GROUP BY 1, 2""")
def arm_summary(spark, t):
    seeds = t.orders.groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("stratum"), (F.col("o_orderkey") % 3).alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("k"))
    rate = F.col("k") / F.col("n")
    return seeds.groupBy("arm", "stratum").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.round(F.avg(rate), 6).alias("mean"), F.round(F.min(rate), 6).alias("low"), F.round(F.max(rate), 6).alias("high"), F.count(F.lit(1)).alias("seeds"))


@book.query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS records, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS hit FROM orders GROUP BY 1""")
def records_hit(spark, t):
    per = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ok"))
    return per.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("records"), F.count_if("ok").alias("hit"))


_BREAK = "CASE WHEN o_totalprice < 50000 THEN 'tiny' WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'big_done' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'rest' END"


@book.query(f"""SELECT o_orderstatus, {', '.join(f"count(*) FILTER (b = '{b}') AS {b}" for b in ('tiny', 'big_done', 'done', 'urgent', 'rest'))}, count(*) AS n
  FROM (SELECT *, {_BREAK} AS b FROM orders) GROUP BY 1""")
def breakdown(spark, t):
    """Every row falls in exactly one bucket: the first rule that holds."""
    buckets = ["tiny", "big_done", "done", "urgent", "rest"]
    out = t.orders.withColumn("b", F.expr(_BREAK)).groupBy("o_orderstatus").pivot("b", buckets).agg(F.count(F.lit(1)))
    return out.na.fill(0, buckets).withColumn("n", sum((F.col(b) for b in buckets), F.lit(0)))


@book.query("""WITH c AS (SELECT o_custkey, bool_or(o_totalprice > 200000) FILTER (o_orderstatus = 'F') AS a, bool_or(o_totalprice > 200000) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1)
  SELECT count(*) AS n, count(*) FILTER (a AND b) AS held, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (NOT a AND b) AS gained, count(*) FILTER (NOT a AND NOT b) AS neither FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_table(spark, t):
    ok = F.col("o_totalprice") > 200000
    per = t.orders.groupBy("o_custkey").agg(F.bool_or(F.when(F.col("o_orderstatus") == "F", ok)).alias("a"), F.bool_or(F.when(F.col("o_orderstatus") == "O", ok)).alias("b")).dropna(subset=["a", "b"])
    a, b = F.col("a"), F.col("b")
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("held"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("gained"), F.count_if(~a & ~b).alias("neither"))


@book.query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "right", count(*) FILTER (o_orderstatus = 'O') AS wrong, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS declined FROM orders GROUP BY 1""")
def outcome_tally(spark, t):
    outcome = F.when(F.col("o_orderstatus") == "F", "right").when(F.col("o_orderstatus") == "O", "wrong").otherwise("declined")
    names = ["right", "wrong", "declined"]
    return t.orders.withColumn("outcome", outcome).groupBy("o_orderpriority").pivot("outcome", names).agg(F.count(F.lit(1))).na.fill(0, names)


@book.query("""SELECT position, count(*) AS n, round(avg((length(text) > 200)::INT), 6) AS rate FROM (
  SELECT text, CASE WHEN turn = min(turn) OVER w THEN 'first' WHEN turn = max(turn) OVER w THEN 'last' ELSE 'middle' END AS position FROM conversations WINDOW w AS (PARTITION BY conv_id)) GROUP BY 1""")
def rate_by_position(spark, t):
    w = Window.partitionBy("conv_id")
    place = F.when(F.col("turn") == F.min("turn").over(w), "first").when(F.col("turn") == F.max("turn").over(w), "last").otherwise("middle")
    return t.conversations.select(place.alias("position"), (F.length("text") > 200).cast("int").alias("long")).groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("long"), 6).alias("rate"))


@book.query("""SELECT source, count(quality) AS labelled, CASE WHEN count(quality) > 0 THEN round(count(*) FILTER (quality = 1) / count(quality), 6) END AS good_rate,
  CASE WHEN count(quality) > 0 THEN round(count(*) FILTER (toxic = 1) / count(quality), 6) END AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def metrics_alive(spark, t):
    """Rates are null, never zero, where nothing was measured."""
    out = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("g"), F.count_if(F.col("toxic") == 1).alias("x"))
    return out.select("source", "labelled", F.round(F.try_divide("g", "labelled"), 6).alias("good_rate"), F.round(F.try_divide("x", "labelled"), 6).alias("toxic_rate"))


@book.query("""WITH s AS (SELECT l_orderkey % 5 AS seed, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
  SELECT count(*) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem FROM s""")
def seed_stats(spark, t):
    m = t.lineitem.groupBy((F.col("l_orderkey") % 5).alias("seed")).agg(F.avg("l_quantity").alias("m"))
    return m.agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.round(F.stddev_samp("m") / F.sqrt(F.count(F.lit(1))), 6).alias("sem"))


@book.query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ols_fit(spark, t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 3).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@book.query("""SELECT round(a, 3) AS slope_a, round(b, 3) AS slope_b, round(100 * (a - b) / b, 4) AS residual_pct FROM
  (SELECT regr_slope(l_extendedprice, l_quantity) FILTER (l_linenumber % 2 = 0) AS a, regr_slope(l_extendedprice, l_quantity) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem)""")
def fit_consistency(spark, t):
    """Two independent estimates of one slope, from halves of the rows, in one pass."""
    half = lambda k: F.when(F.col("l_linenumber") % 2 == k, F.col("l_quantity"))
    out = t.lineitem.agg(F.regr_slope("l_extendedprice", half(0)).alias("a"), F.regr_slope("l_extendedprice", half(1)).alias("b"))
    return out.select(F.round("a", 3).alias("slope_a"), F.round("b", 3).alias("slope_b"), F.round(100 * (F.col("a") - F.col("b")) / F.col("b"), 4).alias("residual_pct"))


@book.query("""SELECT n_chars, n, round(n / t, 6) AS share FROM (SELECT n_chars, count(*) AS n, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY count(*) DESC, n_chars) AS r FROM documents GROUP BY 1) WHERE r = 1""")
def length_spike(spark, t):
    counted = t.documents.groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"))
    best = counted.agg(F.max(F.struct("n", (-F.col("n_chars")).alias("m"))).alias("b"), F.sum("n").alias("t"))
    return best.select((-F.col("b.m")).alias("n_chars"), F.col("b.n").alias("n"), F.round(F.col("b.n") / F.col("t"), 6).alias("share"))


@book.query("SELECT p_brand, count(DISTINCT p_size) AS sizes, CASE WHEN count(DISTINCT p_size) = 1 THEN 'collapsed' ELSE 'ok' END AS status FROM part GROUP BY 1")
def collapse_check(spark, t):
    out = t.part.groupBy("p_brand").agg(F.count_distinct("p_size").alias("sizes"))
    return out.withColumn("status", F.when(F.col("sizes") == 1, "collapsed").otherwise("ok"))


@book.query(f"""WITH v AS (SELECT lang, source, count(DISTINCT lower(regexp_extract(text, '{W}'))) AS variants FROM documents GROUP BY 1, 2)
  SELECT lang, median(variants) AS median_variants, min(variants) AS low, max(variants) AS high FROM v GROUP BY lang""")
def variants_median(spark, t):
    v = t.documents.groupBy("lang", "source").agg(F.count_distinct(F.lower(F.regexp_extract("text", W, 0))).alias("variants"))
    return v.groupBy("lang").agg(F.median("variants").alias("median_variants"), F.min("variants").alias("low"), F.max("variants").alias("high"))


@book.query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_longest(spark, t):
    """The longest per key, ties to the first: an aggregate, so no key meets in one task."""
    best = t.documents.groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("b"))
    return best.select("source", (-F.col("b.m")).alias("doc_id"), F.col("b.n_chars").alias("n_chars"))


_NB_TRAIN = f"""tr AS (SELECT quality, word, count(*) AS c FROM (SELECT quality, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM {_LABELLED} WHERE doc_id % 2 = 0) GROUP BY 1, 2)"""


@book.query(f"WITH {_NB_TRAIN}, n AS (SELECT quality, sum(c) AS n FROM tr GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM tr) SELECT quality, word, c, round(ln((c + 1) / (n + v)), 6) AS logp FROM tr JOIN n USING (quality), v")
def nb_train(spark, t):
    return _nb(t).select("quality", "word", "c", F.round("logp", 6).alias("logp"))


def _counts(t):
    rows = t.documents.join(t.labels, "doc_id").filter("doc_id % 2 = 0")
    return rows.select("quality", F.explode(letters(F.col("text"))).alias("word")).groupBy("quality", "word").agg(F.count(F.lit(1)).alias("c"))


def _nb(t):
    counts = _counts(t)
    n = F.broadcast(counts.groupBy("quality").agg(F.sum("c").alias("n")))  # one row a class
    v = F.broadcast(counts.agg(F.count_distinct("word").alias("v")))  # one row
    return counts.join(n, "quality").crossJoin(v).withColumn("logp", F.ln((F.col("c") + 1) / (F.col("n") + F.col("v"))))


@book.query(f"""WITH {_NB_TRAIN}, n AS (SELECT quality, sum(c) AS n FROM tr GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM tr),
  te AS (SELECT doc_id, quality AS truth, word, count(*) AS k FROM (SELECT doc_id, quality, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM {_LABELLED} WHERE doc_id % 2 = 1) GROUP BY 1, 2, 3),
  s AS (SELECT doc_id, truth, n.quality, sum(k * ln((coalesce(c, 0) + 1) / (n + v))) AS score FROM te CROSS JOIN n CROSS JOIN v LEFT JOIN tr ON tr.word = te.word AND tr.quality = n.quality GROUP BY 1, 2, 3),
  p AS (SELECT doc_id, truth, max(score) FILTER (quality = 1) >= max(score) FILTER (quality = 0) AS good FROM s GROUP BY 1, 2)
  SELECT count(*) AS n, count(*) FILTER (good = (truth = 1)) AS correct FROM p""")
def nb_accuracy(spark, t):
    """Held-out accuracy of multinomial naive Bayes with Laplace smoothing."""
    counts = _counts(t).groupBy("word").pivot("quality", [0, 1]).agg(F.sum("c")).na.fill(0)
    totals = F.broadcast(counts.agg(F.sum("0").alias("n0"), F.sum("1").alias("n1"), F.count(F.lit(1)).alias("v")))  # one row
    test = t.documents.join(t.labels, "doc_id").filter("doc_id % 2 = 1").select("doc_id", "quality", F.explode(letters(F.col("text"))).alias("word"))
    test = test.groupBy("doc_id", "quality", "word").agg(F.count(F.lit(1)).alias("k")).join(counts, "word", "left").crossJoin(totals)
    logp = lambda c: F.col("k") * F.ln((F.coalesce(F.col(c), F.lit(0)) + 1) / (F.col(f"n{c}") + F.col("v")))
    said = test.groupBy("doc_id", "quality").agg((F.sum(logp("1")) >= F.sum(logp("0"))).alias("good"))
    return said.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good") == (F.col("quality") == 1)).alias("correct"))


@book.query("""SELECT docs, count(*) AS words FROM (SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) GROUP BY 1) WHERE docs <= 3 GROUP BY 1""")
def rare_words(spark, t):
    per = t.documents.select(F.explode(F.array_distinct(letters(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    return per.filter("docs <= 3").groupBy("docs").agg(F.count(F.lit(1)).alias("words"))


_LCG = "(doc_id * 1103515245 + 12345) % 32768"


@book.query(f"""SELECT doc_id, n_chars, prev_total FROM (SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY {_LCG}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev_total FROM documents) WHERE prev_total < 100000""")
def budget_take(spark, t):
    return M.budget_take(t.documents.select("doc_id", "n_chars"), M.lcg(F.col("doc_id")), "n_chars", 100_000).select("doc_id", "n_chars", "prev_total")


_MONEY = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(38, 2)) AS revenue, count(*) AS n"


def _sales(t, how):
    return getattr(t.lineitem, how)("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"), F.count(F.lit(1)).alias("n"))


@book.query(f"SELECT l_returnflag, l_linestatus, {_MONEY} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, t):
    return _sales(t, "rollup")


@book.query(f"SELECT l_returnflag, l_linestatus, {_MONEY} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_sales(spark, t):
    return _sales(t, "cube")


@book.query(f"SELECT l_returnflag, l_linestatus, {_MONEY} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, t):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return t.lineitem.groupingSets([[flag], [status], []], flag, status).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"), F.count(F.lit(1)).alias("n"))


_EXCLUDE = "CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN contains(text, '!!') THEN 'junk' ELSE 'kept' END"


@book.query(f"SELECT {_EXCLUDE} AS reason, count(*) AS n FROM documents GROUP BY 1")
def exclusion_report(spark, t):
    """Every exclusion is counted and named; rows fall to the first rule that holds."""
    return t.documents.groupBy(F.expr(_EXCLUDE).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@book.query("SELECT coalesce(lang, '?') AS lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def lang_share(spark, t):
    return M.share_of(t.documents.select(F.coalesce("lang", F.lit("?")).alias("lang")), "lang")
