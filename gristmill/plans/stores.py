"""Sources, streams, token reuse and text rules that read whole tables and whole texts."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.words import letters
from ..operators import inference
from ..sources import checkpoint
from ..streaming import events as E
from .book import Book
from .tools import _lay, scratch

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col


# ---- sources


@book.query("SELECT n_nationkey, n_name FROM nation")
def src_json_array(spark, t):
    """One JSON array of records in a file, written and read back."""
    at = scratch(spark, "array")
    t.nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).coalesce(1).write.text(at)  # a dimension of fixed length
    return spark.read.schema("n_nationkey long, n_name string").json(at, multiLine=True).select("n_nationkey", "n_name")


@book.query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def src_csv(spark, t):
    """A table as comma-separated text with a declared schema."""
    at = scratch(spark, "csv")
    t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").write.option("header", True).csv(at)
    return spark.read.schema("o_orderkey long, o_orderpriority string, o_totalprice double").csv(at, header=True)


@book.query("SELECT p_partkey, p_name FROM part")
def src_orc(spark, t):
    at = scratch(spark, "orc")
    t.part.select("p_partkey", "p_name").write.orc(at)
    return spark.read.orc(at)


_MODEL = checkpoint.Shape(64, 96, 2, 4, 2, 40, 16)


def _plain(seed: int) -> bytes:
    """A small plain checkpoint whose numbers are a rule of the seed."""
    n = sum(c * s for _, c, s in (*_MODEL.norms(), *_MODEL.weights(True))) + 2 * (_MODEL.length * (_MODEL.dim // _MODEL.heads) // 2)
    x = ((np.arange(n, dtype=np.int64) * 1103515245 + 12345 + seed) % 32768 / 16384.0 - 1).astype("<f4")
    return struct.pack("<7i", *_MODEL.numbers()) + x.tobytes()


@book.query("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'bad magic' WHEN 2 THEN 'size does not fit the shape' WHEN 3 THEN 'header is cut' ELSE '' END AS why, CASE WHEN r_regionkey IN (0, 4) THEN 20::BIGINT ELSE 0::BIGINT END AS tensors, CASE WHEN r_regionkey IN (0, 4) THEN true ELSE false END AS near FROM region")
def src_checkpoint(spark, t):
    """Plain checkpoints converted to 8-bit groups, read as binary rows: shape and size checked, values near the plain ones."""

    def run(batches):
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                plain = _plain(key)
                blob = checkpoint.convert(plain)
                blob = {1: b"xxxx" + blob[4:], 2: blob[:-1], 3: blob[:20]}.get(key, blob)
                why, shape, _, group = checkpoint.probe(blob)
                told = list(checkpoint.tensors(blob)) if not why else []
                first = np.frombuffer(plain, "<f4", _MODEL.vocab * _MODEL.dim, 28)
                tokens = next((x for n, _, x in told if n == "tokens"), None)
                near = tokens is not None and bool(np.abs(tokens - first).max() <= np.abs(first).max() / 127) and shape.memory(len(blob)) > len(blob) and group == 32
                rows.append((key, why, len(told), near))
            key, why, n, near = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(why, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.bool_())], names=["r_regionkey", "why", "tensors", "near"])

    return t.region.select(C("r_regionkey").cast("long")).mapInArrow(run, "r_regionkey long, why string, tensors long, near boolean")


# ---- streams


@book.query("SELECT start, sum(n)::BIGINT AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def stream_sliding(spark, t):
    """Two-day windows that begin every day, from a stream."""
    at = scratch(spark, "sliding")
    _lay(spark, t, at)
    return E.finished(E.sliding(spark.readStream.schema(E.SCHEMA).parquet(f"{at}/in")), at)


@book.query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_session(spark, t):
    """Sessions that end after six hours without an event, from a stream."""
    at = scratch(spark, "session")
    _lay(spark, t, at)
    return E.finished(E.sessions(spark.readStream.schema(E.SCHEMA).parquet(f"{at}/in")), at)


@book.query("""WITH late AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events WHERE event_id % 4 = 0)
  SELECT date_trunc('day', ts) AS start, count(*) AS n FROM (SELECT ts FROM events WHERE event_id % 2 = 0 UNION ALL SELECT ts FROM events, late WHERE event_id % 2 = 1 AND date_trunc('day', ts) + INTERVAL 1 DAY > mark) GROUP BY 1""")
def stream_late_drop(spark, t):
    """Three batches: of the last, events whose day was over before the watermark are dropped.

    The watermark that drops late rows is one batch behind, so it is that of the first batch.
    """
    at = scratch(spark, "late")
    rows = t.events.select("event_id", C("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    for part in ("event_id % 4 = 0", "event_id % 4 = 2", "event_id % 2 = 1"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{at}/in")  # a file a batch
    read = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in").withWatermark("ts", "2 days")
    counted = read.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(C("window.start").alias("start"), "n")
    return E.updates(counted, at).groupBy("start").agg(F.max("n").alias("n"))


# ---- tokens and inference


@book.query("""WITH r AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents), p AS (SELECT * FROM r WHERE k % greatest(1, n // 400) = 0),
  w AS (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r]+')) AS w FROM p)
  SELECT (SELECT count(*) FROM p) AS probed, count(*) AS tokens, count(*) FILTER (regexp_matches(w, '[^\\x00-\\x7FäöüßéèêçñóíáÄÖÜÉ]')) AS unknown, count(*) FILTER (regexp_matches(w, '[^\\x00-\\x7FäöüßéèêçñóíáÄÖÜÉ]')) <= 0.001 * count(*) AS reused FROM w""")
def tokenizer_reuse(spark, t):
    """A tokenizer is used again if, over documents taken in strides from end to end, one token in a thousand at most is unknown."""
    n = t.documents.count()
    place = F.row_number().over(E.by_id("doc_id")) - 1
    ids = t.documents.select("doc_id").withColumn("k", place).filter(C("k") % max(1, n // 400) == 0).select("doc_id")
    probe = t.documents.join(F.broadcast(ids), "doc_id", "left_semi")  # some 400 to 800 rows
    told = probe.agg(F.count("*").alias("probed")).crossJoin(  # one row
        probe.select(F.explode(F.regexp_extract_all("text", F.lit("[^ \t\n\r]+"), F.lit(0))).alias("w")).agg(F.count("*").alias("tokens"), F.count_if(C("w").rlike("[^\\x00-\\x7FäöüßéèêçñóíáÄÖÜÉ]")).alias("unknown"))
    )
    return told.withColumn("reused", C("unknown") <= 0.001 * C("tokens"))


@book.query()
def forward_pass(spark, t):
    """One attention block over each whole vector in 8-bit groups: norm, product, rotation, mixing."""

    def run(batches):
        made: dict[int, tuple] = {}
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = np.asarray(x or [], np.float32)
                if len(v) == 0 or len(v) % 8:
                    out.append(None)
                    continue
                if len(v) not in made:
                    made[len(v)] = inference.quantise(np.random.default_rng(1).normal(size=(len(v), len(v))).astype(np.float32), 8)
                h = inference.rmsnorm(v, np.ones(len(v), np.float32))
                q = inference.matmul(made[len(v)], inference.quantise(h, 8))
                keys = np.stack([inference.rotate(q, p) for p in range(3)])
                out.append(round(float(inference.swiglu(inference.attend(inference.rotate(q, 2), keys, keys), h).sum()), 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["vec_id", "out"])

    return t.embeddings.select(C("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, out double")


# ---- text rules

#: Words by which a generation refuses, and titles of sections that explain nothing: fixed values.
REFUSES = r"(?i)\bcannot\b|\bcan't\b|\bnot given\b|\bnot enough\b|\bmissing\b|\bdoes not apply\b"
APPARATUS = (
    r"(?i)^\s*(learning objectives?|teacher support|section summary|check your understanding|conceptual questions|problems?( & | and )?exercises?|problems?|exercises?|glossary|key (terms|equations|concepts)|summary|references?|further reading|test prep.*|"
    r"performance task|links? to physics|making connections|real-world connections?|critical thinking|problem exercises|additional problems|challenge problems|practice problems|concept items|extended response|short answer|multiple choice|"
    r"errata|answers? to questions.*|section key terms|additional resources|contributing authors|reviewers|customization|art attribution|our .*partners|senior contributing authors)\s*$"
)
FRONT = ("preface", "acknowledgements", "acknowledgments")
_SAY = "CASE conv_id % 6 WHEN 0 THEN 'I cannot say: v is not given. ' WHEN 1 THEN 'It does not apply. ' WHEN 2 THEN 'Nothing was dismissing it. ' ELSE '' END || text"


@book.query(f"SELECT conv_id, turn, regexp_matches({_SAY}, '{REFUSES.replace(chr(39), chr(39) * 2)}') AS refuses FROM conversations")
def refusal_words(spark, t):
    """Whether a generation refuses, by whole words; the record is never read."""
    return t.conversations.select("conv_id", "turn", F.expr(_SAY).rlike(REFUSES).alias("refuses"))


_HEADED = "CASE page_id % 7 WHEN 0 THEN 'Summary' WHEN 1 THEN ' Key Terms ' WHEN 2 THEN 'Preface' WHEN 3 THEN 'Summary of forces' ELSE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) END"


@book.query(f"SELECT page_id, title FROM (SELECT page_id, {_HEADED} AS title FROM pages) WHERE NOT regexp_matches(title, '{APPARATUS}') AND lower(trim(title)) NOT IN ('preface', 'acknowledgements', 'acknowledgments')")
def skip_apparatus(spark, t):
    """Sections whose title is neither apparatus nor front matter."""
    titled = t.pages.select("page_id", F.expr(_HEADED).alias("title"))
    return titled.filter(~C("title").rlike(APPARATUS) & ~F.lower(F.trim("title")).isin(*FRONT))


_STOPWORDS = "the a an of in for to and is are with at on by that from into over under as or its this two no".split()
_SUFFIXES = (("ed", ""), ("ed", "e"), ("s", ""), ("es", ""), ("ing", ""), ("ing", "e"), ("d", ""), ("ly", ""), ("al", ""))


@book.query(f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM documents) GROUP BY 1), known AS (SELECT word FROM w WHERE n >= 30),
  forms AS (SELECT word AS form FROM known UNION SELECT word || s FROM known, (VALUES ('ed'), ('s'), ('es'), ('ing'), ('d'), ('ly'), ('al')) AS v(s) UNION SELECT substr(word, 1, length(word) - 1) || s FROM known, (VALUES ('ed'), ('ing')) AS v(s) WHERE word LIKE '%e'),
  odd AS (SELECT word FROM w WHERE length(word) >= 5 AND word NOT IN (SELECT form FROM forms)), cut AS (SELECT word, unnest(range(1, length(word)::INT - 2)) AS k FROM odd)
  SELECT word AS fused, min(k)::INT AS k FROM cut WHERE list_contains({_STOPWORDS!r}, substr(word, 1, k)) AND substr(word, k + 1) IN (SELECT form FROM forms) GROUP BY 1""")
def fused_words(spark, t):
    """Words of all documents that are a function word and a known word, in any of its forms, without the blank between them."""
    w = t.documents.select(F.explode(letters(C("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = w.filter("n >= 30").select("word")
    ends = [F.concat("word", F.lit(s)) for s in dict.fromkeys(s for s, keep in _SUFFIXES if not keep)]
    stems = [F.when(C("word").endswith("e"), F.concat(F.expr("substr(word, 1, length(word) - 1)"), F.lit(s))) for s, keep in _SUFFIXES if keep]
    forms = known.select(F.explode(F.array_compact(F.array("word", *ends, *stems))).alias("form")).distinct()
    odd = w.filter(F.length("word") >= 5).join(forms, C("word") == C("form"), "left_anti").select("word")
    cut = odd.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 3)).alias("k")).filter(F.expr("substr(word, 1, k)").isin(*_STOPWORDS))
    return cut.withColumn("form", F.expr("substr(word, k + 1)")).join(forms, "form", "left_semi").groupBy(C("word").alias("fused")).agg(F.min("k").alias("k"))


_PROSE = "'With ' || l_linenumber || ' units the result is ' || CASE WHEN l_orderkey % 3 = 0 THEN '' || CAST(l_quantity AS BIGINT) WHEN l_orderkey % 3 = 1 THEN '' || (CAST(l_quantity AS BIGINT) + 1) ELSE 'large' END || '.'"


@book.query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN last = '' THEN prose || ' The result is ' || q || '.' WHEN abs(CAST(last AS DOUBLE) - q) <= 0.02 * q THEN prose ELSE replace(prose, 'is ' || last || '.', 'is ' || q || '.') END AS corrected
  FROM (SELECT *, regexp_extract(prose, 'is ([0-9.]*[0-9])[.]', 1) AS last FROM (SELECT *, {_PROSE} AS prose, CAST(l_quantity AS BIGINT) AS q FROM lineitem))""")
def answer_corrected(spark, t):
    """Prose that states another number than the result is put right; what states none gets a sentence."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.expr(_PROSE.replace("BIGINT", "LONG")).alias("prose"), C("l_quantity").cast("long").alias("q"))
    d = d.withColumn("last", F.regexp_extract("prose", "is ([0-9.]*[0-9])[.]", 1))
    q = C("q").cast("string")
    said = F.when(C("last") == "", F.concat("prose", F.lit(" The result is "), q, F.lit("."))).when(F.abs(C("last").try_cast("double") - C("q")) <= 0.02 * C("q"), C("prose"))
    return d.select("l_orderkey", "l_linenumber", said.otherwise(F.replace("prose", F.concat(F.lit("is "), "last", F.lit(".")), F.concat(F.lit("is "), q, F.lit(".")))).alias("corrected"))


@book.query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE 'm' END AS withheld, CASE WHEN p_partkey % 2 = 0 THEN 'm = ' || p_size ELSE 'v = ' || p_size END AS shown, 'I cannot answer that: ' || CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE 'm' END || ' is not given.' AS ans FROM part")
def class_withheld(spark, t):
    """D1 documents of every part: one free variable is withheld and never shown, and the answer names it."""
    even = C("p_partkey") % 2 == 0
    name = F.when(even, "v").otherwise("m")
    return t.part.select("p_partkey", name.alias("withheld"), F.concat(F.when(even, "m = ").otherwise("v = "), C("p_size").cast("string")).alias("shown"), F.concat(F.lit("I cannot answer that: "), name, F.lit(" is not given.")).alias("ans"))


@book.query("SELECT o_orderkey, year(o_orderdate)::INT AS y, dayofyear(o_orderdate)::INT AS doy, strftime(o_orderdate, '%Y-%m') AS month, date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01')::INT AS left_days, last_day(o_orderdate) AS month_end FROM orders")
def date_parts(spark, t):
    """Parts of dates, distances between them, and ends of months."""
    d = C("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.dayofyear(d).alias("doy"), F.date_format(d, "yyyy-MM").alias("month"), F.datediff(F.lit("2030-01-01").cast("date"), d).alias("left_days"), F.last_day(d).alias("month_end"))


@book.query("SELECT c_custkey, c_mktsegment AS value, 2::INT AS entries, 'balance,segment' AS keys FROM customer")
def map_functions(spark, t):
    """Maps built, merged, filtered, read by key and listed."""
    m = F.map_concat(F.create_map(F.lit("segment"), "c_mktsegment"), F.create_map(F.lit("balance"), C("c_acctbal").cast("string"), F.lit("none"), F.lit("")))
    kept = F.map_filter(m, lambda k, v: v != "")
    return t.customer.select("c_custkey", F.element_at(kept, "segment").alias("value"), F.size(kept).alias("entries"), F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("keys"))
