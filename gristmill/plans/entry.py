"""Queries that go through the entry points, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R
from . import cues
from . import gates as G
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
C = F.col


@book.query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '!parse' ELSE '' || (p_size + 2) END AS result FROM part")
def api_calls(spark, t):
    """One call a line."""
    from .. import api

    wire = F.when(C("p_partkey") % 5 == 4, F.lit("<tool>eval<arg>2+</tool>")).otherwise(F.concat(F.lit("<tool>eval<arg>"), C("p_size").cast("string"), F.lit("+2</tool>")))
    return api.calls(t.part.select("p_partkey", wire.alias("value"))).select("p_partkey", "result")


@book.query(f"{cues._SCORED} SELECT p_partkey AS id, rank, ord, name, score::BIGINT AS score FROM ranked WHERE rank <= 3")
def api_rank(spark, t):
    from .. import api

    return api.rank(spark, cues.asked(spark, t).select(C("p_partkey").alias("id"), "q"))


@book.query(f"""{cues._SCORED} SELECT p_partkey AS id, '<q>' || q || '</q><r>' || CASE WHEN relation_bonus > 0 OR (bound AND NOT others) OR (open_words > 0 AND 100 * covered >= 75 * open_words) THEN formula || ' | missing:none | fit:high<a>'
  ELSE 'none | missing:none | no matching relation | fit:low<a>' END AS prompt FROM ranked WHERE rank = 1""")
def api_prompt(spark, t):
    from .. import api

    return api.prompt(spark, cues.posed(spark, t).select(C("p_partkey").alias("id"), "q"))


@book.query(f"""{G._DOCS} SELECT id, corpus, true AS well_formed, ans LIKE '%cannot%' OR regexp_matches(q || record, '\\bmissing\\b') AS is_refusal,
  CASE WHEN kind = 'ANSWER' THEN true END AS answer_matches_result, CASE WHEN bad AND kind = 'ANSWER' THEN 'UNCHECKED' ELSE 'OK' END AS shape_status FROM docs WHERE kind = 'ANSWER'""")
def api_grade(spark, t):
    """Every answering document as a generation, graded."""
    from .. import api

    docs = G.documents(spark, t).filter("kind = 'ANSWER'")
    whole = F.concat(F.lit("<q>"), "q", F.lit("</q><r>"), "record", "call", F.lit("<res>"), "res", F.lit("</res><a>"), "ans", F.lit("<end>"))
    return api.grade(docs.select("id", "corpus", whole.alias("gen"))).select("id", "corpus", "well_formed", "is_refusal", "answer_matches_result", "shape_status")


@book.query("SELECT kind, n, round(n / 1000.0, 6)::DOUBLE AS share, 'ok' AS status FROM (VALUES ('ANSWER', 300), ('D1', 100), ('D3', 100), ('EXPLAIN', 100), ('C1', 100), ('R1', 100), ('K1', 100), ('F1', 100)) AS v(kind, n)")
def api_gen_check(spark, t):
    """A thousand made documents, and whether their classes lie in their bands."""
    from .. import api

    return api.check(api.gen(spark, 1000, 4)[0])


@book.query("SELECT p_partkey, (length(s) + length(s) - length(regexp_replace(s, '[A-Z?!:\"_<>|]', '', 'g')) + 3 * (length(s) - length(regexp_replace(s, '[&@#%{}\\[\\]\\\\~`$]', '', 'g'))))::INT AS keys FROM (SELECT p_partkey, p_name || '? #' || p_brand AS s FROM part)")
def key_cost(spark, t):
    from .. import api

    return t.part.select("p_partkey", api.key_cost(F.concat("p_name", F.lit("? #"), "p_brand")).alias("keys"))


@book.query("SELECT conv_id, turn, CASE WHEN text IS NULL OR p = '' THEN 'empty' WHEN regexp_matches(p, '[^\\x20-\\x7E]') THEN 'characters' WHEN length(p) > 640 THEN 'long' WHEN NOT starts_with(p, '<q>') OR NOT ends_with(p, '<a>') THEN 'frame' WHEN length(p) - length(replace(p, '</q>', '')) <> 4 THEN 'question' ELSE 'ok' END AS why FROM (SELECT *, CASE turn % 3 WHEN 0 THEN '<q>' || text || '</q><a>' WHEN 1 THEN text ELSE '<q>' || text || '<a>' END AS p FROM conversations)")
def prompt_check(spark, t):
    from .. import api

    p = F.expr("CASE turn % 3 WHEN 0 THEN '<q>' || text || '</q><a>' WHEN 1 THEN text ELSE '<q>' || text || '<a>' END")
    return t.conversations.select("conv_id", "turn", api.prompt_check(p).alias("why"))
