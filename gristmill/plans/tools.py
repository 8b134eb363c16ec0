"""Queries over the tool set, sources and streams."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import sql as S
from ..operators import relations as R
from ..sources import files, packed
from ..streaming import events as E
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared folder of the session; a local one where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return f"{at.rstrip('/')}/gristmill/{name}-{uuid.uuid4().hex}"


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@book.query("SELECT p_partkey, (p_size * 3 + 1)::VARCHAR AS result FROM part")
def eval_expr(spark, t):
    return t.part.select("p_partkey", S.eval_expr(text("3*", C("p_size"), "+1")).alias("result"))


@book.query("SELECT p_partkey, (p_size * 1000)::VARCHAR || ' m' AS metres, '!units' AS refused FROM part")
def conv_expr(spark, t):
    return t.part.select("p_partkey", S.conv_expr(text(C("p_size"), " km"), F.lit("m")).alias("metres"), S.conv_expr(text(C("p_size"), " km"), F.lit("s")).alias("refused"))


@book.query("SELECT p_partkey, 'x=' || (-p_size)::VARCHAR AS root, 'm=F/a' AS literal, '!nosol' AS refused FROM part")
def solve_expr(spark, t):
    return t.part.select("p_partkey", S.solve_expr(text("2x+", 2 * C("p_size"), "=0"), F.lit("x")).alias("root"), S.solve_expr(F.lit("F=m*a"), F.lit("m")).alias("literal"), S.solve_expr(F.lit("x^3=y"), F.lit("x")).alias("refused"))


@book.query("SELECT p_partkey, (2 * (p_size + 1))::VARCHAR || '*x+3' AS slope FROM part")
def diff_expr(spark, t):
    return t.part.select("p_partkey", S.diff_expr(text(C("p_size") + 1, "x^2+3x"), F.lit("x")).alias("slope"))


@book.query("SELECT p_partkey, CASE WHEN p_size = 0 THEN '0' ELSE (p_size)::VARCHAR END || '*x+sin(x)' AS integral FROM part WHERE p_size > 1")
def integ_expr(spark, t):
    return t.part.filter("p_size > 1").select("p_partkey", S.integ_expr(text(C("p_size"), "+cos(x)"), F.lit("x")).alias("integral"))


@book.query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '!domain' WHEN 1 THEN '!parse' WHEN 2 THEN '!name' ELSE p_size::VARCHAR END AS result FROM part")
def tool_call(spark, t):
    """Calls in wire format; failures are values of a closed set."""
    k = C("p_partkey") % 4
    wire = F.when(k == 0, "<tool>eval<arg>1/0</tool>").when(k == 1, "<tool>eval<arg>2+</tool>").when(k == 2, "<tool>what<arg>1</tool>").otherwise(text("<tool>eval<arg>", C("p_size"), "</tool>"))
    return t.part.select("p_partkey", S.tool_call(wire).alias("result"))


@book.query("SELECT l_returnflag, round(2 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS sem2 FROM lineitem GROUP BY 1")
def sem2(spark, t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(S.sem2("l_quantity"), 6).alias("sem2"))


@book.query("SELECT conv_id, turn, tag, length(text)::BIGINT * (tag = '<q>')::INT AS n FROM conversations, (VALUES ('<q>'), ('<a>')) AS g(tag)")
def spans(spark, t):
    """The table function over tagged documents, laterally joined."""
    spark.udtf.register("gristmill_spans", S.Spans)
    t.conversations.select("conv_id", "turn", F.concat(F.lit("<q>"), F.translate("text", "<>", ""), F.lit("<a>")).alias("gen"), F.length("text").alias("size")).createOrReplaceTempView("gristmill_gens")
    return spark.sql("SELECT conv_id, turn, tag, cast(if(tag = '<q>', size, 0) AS bigint) AS n FROM gristmill_gens, LATERAL gristmill_spans(gen)")


@book.query("SELECT o_orderkey, o_custkey % 3 = 0 AS matches FROM orders")
def shape_check(spark, t):
    """A call against its relation: the call's canonical form equals the relation's."""
    from ..functions import expr

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return a.combine(b, lambda x, y: expr.canonical(expr.parse(x), "x") == expr.canonical(expr.parse(y), "x")).astype(bool)

    k = C("o_custkey") % 3
    call = F.when(k == 0, "v*m").when(k == 1, "m/v").otherwise("m*v*v")
    return t.orders.select("o_orderkey", same(call, F.lit("m*v")).alias("matches"))


@book.query(f"SELECT ord, len(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*')))::BIGINT AS vars, formula FROM {R.store_sql()}")
def src_store_roundtrip(spark, t):
    """Records written in the packed format and read back."""
    v = R.variables(C("formula"))
    rec = R.store(spark).select(F.format_string("r%04d", C("ord")).alias("rid"), F.trim(F.substring_index("formula", "=", 1)).alias("lhs"), "formula", "name", "req", F.transform(v, lambda x: F.struct(x.alias("var"), F.lit("1").alias("unit"), F.lit("").alias("cval"))).alias("vars"))
    at = scratch(spark, "store")
    packed.write_store(rec, at)
    back = packed.read_store(spark, at).filter("error is null")
    return back.select(F.substring("rid", 2, 4).cast("bigint").alias("ord"), F.size("vars").cast("bigint").alias("vars"), "formula")


@book.query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'K1' END, 'ANSWER') AS kind FROM documents")
def src_jsonl(spark, t):
    """Documents written as JSON lines and read back with their schema; no kind is ANSWER."""
    at = scratch(spark, "jsonl")
    t.documents.select(C("doc_id").cast("string").alias("head"), F.when(C("doc_id") % 2 == 0, "K1").alias("kind"), "text").write.json(at)
    return files.read_documents(spark, at).select(C("head").cast("bigint").alias("doc_id"), "kind")


@book.query()
def src_tok_roundtrip(spark, t):
    """A small tokenizer packed to text and read back."""
    merges = [(b"t", b"h"), (b"th", b"e")]
    vocab = [(i, bytes([97 + i])) for i in range(26)] + [(26, b"th"), (27, b"the")]
    s, v, m = packed.parse_tokenizer(packed.pack_tokenizer([(28, "<end>")], vocab, merges))
    return spark.createDataFrame([(i, b.hex()) for i, b in v] + [(i, x) for i, x in s], "id int, token string")


@book.query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def sink_atomic(spark, t):
    """A table published whole and read back."""
    at = scratch(spark, "atomic")
    files.publish(t.documents.groupBy("source").agg(F.count("*").alias("n")), at)
    return spark.read.parquet(at)


@book.query("SELECT * FROM (VALUES ('tokens', '53'), ('rate', '1.9'), ('mode', 'b')) AS v(key, value)")
def parse_log(spark, t):
    log = "== run 1\ntokens=10 rate=0.5\nmode=a\n== run 2\ntokens=53 rate=1.9\nmode=b\n== run 3\n(cut)"
    return files.parse_runs(spark.createDataFrame([(log,)], "value string"))


@book.query("SELECT event_id, CASE WHEN value > 50 THEN 'up' ELSE 'down' END AS vote FROM events WHERE event_type = 'click'")
def stream_feedback(spark, t):
    """Votes appended by micro-batches, each batch once."""
    at = scratch(spark, "feedback")
    _lay(spark, t, at)
    votes = E.stream(spark, f"{at}/in").filter("event_type = 'click'").select("event_id", F.when(C("value") > 50, "up").otherwise("down").alias("vote"))
    E.append_feedback(votes, at)
    return spark.read.parquet(f"{at}/votes").select("event_id", "vote")


def _lay(spark, t, at: str) -> None:
    """The events table as a folder of files with microsecond timestamps, as streams read it."""
    t.events.select("event_id", C("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{at}/in")


_DAY = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@book.query(_DAY)
def window_tumbling(spark, t):
    return E.tumbling(t.events)


@book.query("SELECT start, sum(n)::BIGINT AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def window_sliding(spark, t):
    return E.sliding(t.events)


@book.query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def window_session(spark, t):
    return E.sessions(t.events)


@book.query(_DAY)
def stream_tumbling(spark, t):
    """The same day windows from a stream that runs over all files once (complete output)."""
    at = scratch(spark, "tumbling")
    _lay(spark, t, at)
    return E.finished(E.tumbling(spark.readStream.schema(E.SCHEMA).parquet(f"{at}/in")), at)


@book.query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_dedup_watermark(spark, t):
    """Distinct users per type: duplicates dropped within the stream, counted in batch."""
    at = scratch(spark, "dedup")
    _lay(spark, t, at)
    kept = E.stream(spark, f"{at}/in", "3650 days").dropDuplicates(["event_type", "user_id"]).select("event_type", "user_id")
    return E.drain(kept, at).groupBy("event_type").agg(F.count("*").alias("users"))


@book.query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_stateful_count(spark, t):
    at = scratch(spark, "stateful")
    _lay(spark, t, at)
    return E.updates(E.counted(spark.readStream.schema(E.SCHEMA).parquet(f"{at}/in")), at).groupBy("user_id").agg(F.max("n").alias("n"))
