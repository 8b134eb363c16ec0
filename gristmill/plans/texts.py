"""Text filters, predicates, scans and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.words import letters, words
from ..operators import relations as R
from .book import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
STORE = R.store_sql()
C = F.col
W_ = r"[^ \t\n\r]+"
_TAGS = r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"
_A, _B = X.fold_map()


@book.query("SELECT page_id, url, length(html) AS n FROM pages WHERE html IS NOT NULL")
def scan_pages(spark, t):
    return t.pages.filter("html is not null").select("page_id", "url", F.length("html").alias("n"))


@book.query(f"SELECT page_id, md5({_TAGS}) AS text_md5, length({_TAGS}) AS n FROM pages")
def strip_html(spark, t):
    s = X.strip_markup(C("html"))
    return t.pages.select("page_id", F.md5(s).alias("text_md5"), F.length(s).alias("n"))


@book.query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')) AS text_md5,
  len(regexp_extract_all(html, '&[a-z]+;')) AS entities FROM pages""")
def decode_entities(spark, t):
    return t.pages.select("page_id", F.md5(X.decode_entities(C("html"))).alias("text_md5"), F.regexp_count("html", F.lit("&[a-z]+;")).cast("bigint").alias("entities"))


_DROP = "html"
for _tag in ("script", "style", "nav"):
    _DROP = f"regexp_replace({_DROP}, '<{_tag}[^>]*>.*?</{_tag}>', '', 'gs')"


@book.query(f"SELECT page_id, length({_DROP}) AS n, md5({_DROP}) AS html_md5 FROM pages")
def drop_blocks(spark, t):
    d = X.drop_blocks(C("html"))
    return t.pages.select("page_id", F.length(d).alias("n"), F.md5(d).alias("html_md5"))


@book.query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def page_title(spark, t):
    return t.pages.select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@book.query("SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '/(index|about|login|contact|tag|search)[^/]*$')")
def skip_titles(spark, t):
    return t.pages.filter(~F.lower("url").rlike("/(index|about|login|contact|tag|search)[^/]*$")).select("page_id")


@book.query(f"SELECT doc_id, md5(regexp_replace(translate(replace(text, 'ß', 'ss'), '{_A}', '{_B}'), '[^\\x00-\\x7F]', ' ', 'g')) AS folded_md5, length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS folded FROM documents")
def ascii_fold(spark, t):
    return t.documents.select("doc_id", F.md5(X.ascii_fold(C("text"))).alias("folded_md5"), F.length(F.regexp_replace("text", "[\\x00-\\x7F]", "")).alias("folded"))


@book.query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 41 AND 199")
def len_filter(spark, t):
    return t.documents.filter(F.length("text").between(41, 199)).select("doc_id")


@book.query(f"SELECT doc_id, contains(text, '?') OR regexp_matches(lower(text), '^({'|'.join(X.ASK_VERBS)})([^a-z]|$)') AS question FROM documents")
def is_question(spark, t):
    return t.documents.select("doc_id", (C("text").contains("?") | F.lower("text").rlike(f"^({'|'.join(X.ASK_VERBS)})([^a-z]|$)")).alias("question"))


@book.query(f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])({'|'.join(X.FUNCTION_WORDS)}|[0-9]+)[ .]*$')")
def is_truncated(spark, t):
    return t.documents.filter(F.lower("text").rlike(f"(^|[^a-z])({'|'.join(X.FUNCTION_WORDS)}|[0-9]+)[ .]*\\z")).select("doc_id")


@book.query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')")
def non_ascii(spark, t):
    return t.documents.filter(C("text").rlike("[^\\x00-\\x7F]")).select("doc_id")


@book.query("SELECT doc_id, md5(upper(substr(s, 1, 1)) || substr(s, 2)) AS stem_md5 FROM (SELECT doc_id, regexp_replace(text, '^\\(?[a-z0-9]{1,2}[.)] *', '') AS s FROM documents)")
def clean_stem(spark, t):
    s = F.regexp_replace("text", "^\\(?[a-z0-9]{1,2}[.)] *", "")
    return t.documents.select("doc_id", F.md5(F.concat(X.capital(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))).alias("stem_md5"))


@book.query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'authored ' || p_brand ELSE p_name END AS name FROM part WHERE NOT (p_partkey % 10 <> 0 AND p_size > 45)")
def override_names(spark, t):
    """Declared overrides win over mined names; rows without one must pass the filter."""
    own = t.part.filter("p_partkey % 10 = 0").select("p_partkey", F.concat(F.lit("authored "), "p_brand").alias("own"))
    joined = t.part.join(own, "p_partkey", "left")
    return joined.filter(C("own").isNotNull() | (C("p_size") <= 45)).select("p_partkey", F.coalesce("own", "p_name").alias("name"))


_USABLE = "regexp_matches(formula, '^[A-Za-z][A-Za-z0-9_]* *= *[^=]*[-+*/^][^=]*$') AND length(formula) <= 40 AND len(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*'))) BETWEEN 2 AND 4"


@book.query(f"SELECT ord, formula FROM {STORE} WHERE {_USABLE}")
def usable_relations(spark, t):
    n = F.size(R.variables(C("formula")))
    return R.store(spark).filter(C("formula").rlike("^[A-Za-z][A-Za-z0-9_]* *= *[^=]*[-+*/^][^=]*$") & (F.length("formula") <= 40) & n.between(2, 4)).select("ord", "formula")


@book.query(f"SELECT ord, CASE WHEN NOT contains(formula, '=') THEN 'no_equals' WHEN NOT regexp_matches(formula, '^[A-Za-z][A-Za-z0-9_]* *=') THEN 'lhs_not_identifier' ELSE 'ok' END AS reason FROM {STORE}")
def lint_lhs(spark, t):
    reason = F.when(~C("formula").contains("="), "no_equals").when(~C("formula").rlike("^[A-Za-z][A-Za-z0-9_]* *="), "lhs_not_identifier").otherwise("ok")
    return R.store(spark).select("ord", reason.alias("reason"))


@book.query(f"SELECT ord FROM {STORE} WHERE regexp_matches(formula, 'd\\*[A-Za-z]+/d\\*[A-Za-z]+')")
def lint_leibniz(spark, t):
    return R.store(spark).filter(C("formula").rlike("d\\*[A-Za-z]+/d\\*[A-Za-z]+")).select("ord")


@book.query("SELECT p_partkey, CASE WHEN p_size <= 0 THEN 'size' WHEN p_retailprice < p_size THEN 'price_below_size' WHEN p_brand IS NULL THEN 'brand' ELSE 'ok' END AS reason FROM part")
def lint_decl(spark, t):
    reason = F.when(C("p_size") <= 0, "size").when(C("p_retailprice") < C("p_size"), "price_below_size").when(C("p_brand").isNull(), "brand").otherwise("ok")
    return t.part.select("p_partkey", reason.alias("reason"))


_RECORD = "p_name || ' | ' || p_brand || ':' || p_size || ' | missing:' || CASE WHEN p_size % 2 = 0 THEN 'none' ELSE p_type END || ' | fit:high'"


@book.query("SELECT p_partkey, p_name AS formula, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE p_type END AS missing, 'high' AS fit, 4::BIGINT AS fields FROM part")
def record_fields(spark, t):
    """Fields between bars with blanks, never bare bars."""
    parts = t.part.select("p_partkey", F.split(F.expr(_RECORD), " \\| ").alias("f"))
    return parts.select("p_partkey", C("f")[0].alias("formula"), F.regexp_replace(F.element_at("f", -2), "^missing:", "").alias("missing"), F.regexp_replace(F.element_at("f", -1), "^fit:", "").alias("fit"), F.size("f").cast("bigint").alias("fields"))


#: A generation made of a conversation turn: every third lacks its end, every fifth its call's end.
_GEN = "'<q>' || text || '<r>F=m*a' || CASE WHEN turn % 2 = 1 THEN '<tool>eval<arg>' || length(text) || '*2' || CASE WHEN conv_id % 5 = 0 THEN '' ELSE '</tool>' END || CASE WHEN conv_id % 7 = 0 THEN ' then ' ELSE '' END || '<res>' || 2 * length(text) || '</res>' ELSE '' END || '<a>The result is ' || 2 * length(text) || CASE WHEN conv_id % 11 = 0 THEN ' and I cannot say more' ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '<end>' END"
_GENS = f"(SELECT conv_id, turn, {_GEN} AS gen FROM conversations)"
_count = lambda tag: f"((length(gen) - length(replace(gen, '{tag}', ''))) // {len(tag)})"


def _gens(t):
    return t.conversations.select("conv_id", "turn", F.expr(_GEN.replace("2 * length(text)", "(2 * length(text))")).alias("gen"))


@book.query(f"SELECT conv_id, turn, regexp_matches(gen, '<a>.*<end>') AND {_count('<tool>')} = {_count('</tool>')} AND {_count('<arg>')} >= {_count('<tool>')} AS ok FROM {_GENS}")
def well_formed(spark, t):
    n = lambda tag: F.regexp_count("gen", F.lit(tag))
    return _gens(t).select("conv_id", "turn", (C("gen").rlike("(?s)<a>.*<end>") & (n("<tool>") == n("</tool>")) & (n("<arg>") >= n("<tool>"))).alias("ok"))


@book.query(f"SELECT conv_id, turn, regexp_matches(lower(gen), '{X.REFUSAL.replace(chr(39), chr(39) * 2)}') AS refusal FROM {_GENS}")
def is_refusal(spark, t):
    return _gens(t).select("conv_id", "turn", F.lower("gen").rlike(X.REFUSAL).alias("refusal"))


@book.query(f"SELECT conv_id, turn FROM {_GENS} WHERE regexp_matches(lower(gen), 'cannot|unable to') AND NOT contains(gen, '<tool>')")
def refusal_strict(spark, t):
    return _gens(t).filter(F.lower("gen").rlike("cannot|unable to") & ~C("gen").contains("<tool>")).select("conv_id", "turn")


@book.query()
def span_leak(spark, t):
    """A result span that does not follow a call directly."""
    return _gens(t).select("conv_id", "turn", C("gen").rlike("(?<!</tool>)<res>").alias("leak"))


@book.query(f"SELECT conv_id, turn, regexp_extract(gen, '<tool>([a-z]+)<arg>', 1) AS fn, trim(regexp_extract(gen, '<arg>([^<]*)', 1)) AS arg FROM {_GENS} WHERE contains(gen, '<tool>')")
def call_parse(spark, t):
    """The last complete or open call: name and trimmed argument."""
    g = _gens(t).filter(C("gen").contains("<tool>"))
    body = F.element_at(F.split("gen", "<tool>"), -1)
    return g.select("conv_id", "turn", F.substring_index(body, "<arg>", 1).alias("fn"), F.trim(F.regexp_extract(body, "<arg>([^<]*)", 1)).alias("arg"))


@book.query("SELECT count(*) AS n FROM documents a JOIN benchmark b ON md5(regexp_replace(a.text, '[ \t\n\r]+', '', 'g')) = md5(regexp_replace(b.text, '[ \t\n\r]+', '', 'g'))")
def squash_eq(spark, t):
    a, b = t.documents.select(F.md5(X.squash(C("text"))).alias("k")), t.benchmark.select(F.md5(X.squash(C("text"))).alias("k"))
    return a.join(b, "k").agg(F.count("*").alias("n"))


@book.query(f"SELECT ord, contains(translate('The relation is (' || formula || ') as stated', ' ()' || chr(9), ''), translate(formula, ' ()' || chr(9), '')) AS stated FROM {STORE}")
def relation_stated(spark, t):
    said = F.concat(F.lit("The relation is ("), "formula", F.lit(") as stated"))
    return R.store(spark).select("ord", F.contains(R.norm_expr(said), R.norm_expr(C("formula"))).alias("stated"))


@book.query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]{3,}')) <= 6")
def template_only(spark, t):
    return t.documents.filter(F.regexp_count("text", F.lit("[A-Za-z]{3,}")) <= 6).select("doc_id")


# ---- scalars


@book.query("""SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS s, round(exp(l_discount), 9) AS e, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS g, round(sqrt(l_quantity), 9) AS q, round(atan(l_tax), 9) AS a FROM lineitem""")
def math_funcs(spark, t):
    r = lambda c: F.round(c, 9)
    return t.lineitem.select("l_orderkey", "l_linenumber", r(F.sin("l_quantity")).alias("s"), r(F.exp("l_discount")).alias("e"), r(F.ln("l_quantity")).alias("l"), r(F.log10("l_quantity")).alias("g"), r(F.sqrt("l_quantity")).alias("q"), r(F.atan("l_tax")).alias("a"))


@book.query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 6) END AS q, CASE WHEN l_discount = 0 THEN '!domain' ELSE 'ok' END AS q_err,
  CASE WHEN l_tax - 0.04 < 0 THEN NULL ELSE round(sqrt(l_tax - 0.04), 6) END AS s, CASE WHEN l_tax - 0.04 < 0 THEN '!domain' ELSE 'ok' END AS s_err FROM lineitem""")
def math_guarded(spark, t):
    d, x = C("l_discount"), C("l_tax") - 0.04
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_quantity", d), 6).alias("q"), F.when(d == 0, "!domain").otherwise("ok").alias("q_err"), F.when(x >= 0, F.round(F.sqrt(x), 6)).alias("s"), F.when(x < 0, "!domain").otherwise("ok").alias("s_err"))


@book.query("SELECT p_partkey, CAST(floor((p_size - 25) / 2.0 + 0.5) AS BIGINT) AS rounded FROM part")
def round_half_up(spark, t):
    return t.part.select("p_partkey", X.round_half_up((C("p_size") - 25) / 2.0).alias("rounded"))


@book.query("SELECT o_orderkey, sign(x) * floor(abs(x) * pow(10, 3 - floor(log10(abs(x)))) + 0.5) / pow(10, 3 - floor(log10(abs(x)))) AS v FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)")
def sig_round(spark, t):
    return t.orders.select("o_orderkey", X.significant(C("o_totalprice"), 4).alias("v"))


@book.query("SELECT o_orderkey, abs(round(o_totalprice / 1000) * 1000 - o_totalprice) <= 500 AS thousands, abs(floor(o_totalprice) - o_totalprice) <= 0.5 AS floored FROM orders")
def half_ulp(spark, t):
    """Whether a stated value is a correct rounding of its source: within half a last place."""
    p = C("o_totalprice")
    return t.orders.select("o_orderkey", (F.abs(F.round(p / 1000) * 1000 - p) <= 500).alias("thousands"), (F.abs(F.floor(p) - p) <= 0.5).alias("floored"))


@book.query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - round(l_extendedprice, -3)) <= 0.02 * abs(l_extendedprice) AS prose, abs(l_extendedprice - round(l_extendedprice, -3)) <= 0.001 * abs(l_extendedprice) AS called FROM lineitem")
def rel_tol(spark, t):
    x = C("l_extendedprice")
    gap = F.abs(x - F.round(x, -3))
    return t.lineitem.select("l_orderkey", "l_linenumber", (gap <= 0.02 * F.abs(x)).alias("prose"), (gap <= 0.001 * F.abs(x)).alias("called"))


_DIMS = "[(p_size % 3) - 1, (p_size % 5) - 2, (p_partkey % 3) - 1]"


@book.query("SELECT p_partkey, array_to_string([(p_size % 3) - 1 + 1, (p_size % 5) - 2 + 0, (p_partkey % 3) - 1 - 2], ',') AS dims FROM part")
def dim_add(spark, t):
    """Multiplying quantities adds their exponent vectors."""
    a = F.array(C("p_size") % 3 - 1, C("p_size") % 5 - 2, (C("p_partkey") % 3 - 1).cast("int"))
    b = F.array(F.lit(1), F.lit(0), F.lit(-2))
    return t.part.select("p_partkey", F.array_join(F.zip_with(a, b, lambda x, y: x + y).cast("array<string>"), ",").alias("dims"))


@book.query("""SELECT p_partkey, CASE WHEN a > 0 THEN CASE WHEN a = 1 THEN 'm' ELSE 'm^' || a END ELSE '1' END || CASE WHEN b > 0 THEN '/' || CASE WHEN b = 1 THEN 's' ELSE 's^' || b END ELSE '' END AS unit
  FROM (SELECT p_partkey, p_size % 3 AS a, p_partkey % 3 AS b FROM part)""")
def dim_render(spark, t):
    z = F.lit(0)
    dims = F.array(C("p_size") % 3, z, (-(C("p_partkey") % 3)).cast("int"), z, z, z, z)
    return t.part.select("p_partkey", X.dim_render(dims).alias("unit"))


@book.query("""SELECT p_partkey, unit, round(p_size * factor, 6) AS si FROM part, (VALUES ('km', 1000.0), ('cm', 0.01), ('mi', 1609.344), ('ft', 0.3048)) AS u(unit, factor)""")
def unit_convert(spark, t):
    units = spark.createDataFrame([("km", 1000.0), ("cm", 0.01), ("mi", 1609.344), ("ft", 0.3048)], "unit string, factor double")
    return t.part.crossJoin(F.broadcast(units)).select("p_partkey", "unit", F.round(C("p_size") * C("factor"), 6).alias("si"))  # a table of units


@book.query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?'))::BIGINT AS numbers, regexp_extract(text, '[0-9]+(\\.[0-9]+)?') AS first FROM documents")
def num_scan(spark, t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[0-9]+(\\.[0-9]+)?")).cast("bigint").alias("numbers"), F.regexp_extract("text", "[0-9]+(\\.[0-9]+)?", 0).alias("first"))


_ASK = "'given m = ' || conv_id || ' and v is ' || turn || '.5, then m = ' || (conv_id + turn) || ' find p with'"


@book.query(f"""SELECT conv_id, turn, (conv_id + turn)::VARCHAR AS m, turn || '.5' AS v, 3::BIGINT AS assignments FROM conversations""")
def assign_scan(spark, t):
    """`name = number` and `name is number`; the last assignment of a name wins."""
    text = F.concat(F.lit("given m = "), C("conv_id").cast("string"), F.lit(" and v is "), C("turn").cast("string"), F.lit(".5, then m = "), (C("conv_id") + C("turn")).cast("string"), F.lit(" find p with"))
    pattern = "([A-Za-z_]+) (?:=|is) ([0-9]+(?:\\.[0-9]+)?)"
    found = t.conversations.select("conv_id", "turn", F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("x")).alias("a"))
    last = lambda name: F.element_at(F.filter("a", lambda p: p["k"] == name), -1)["x"]
    return found.select("conv_id", "turn", last("m").alias("m"), last("v").alias("v"), F.size("a").cast("bigint").alias("assignments"))


@book.query("SELECT doc_id, md5(regexp_replace(text || ' and with the', '( (and|with|the|for))+$', '')) AS stripped_md5 FROM documents")
def strip_filler(spark, t):
    return t.documents.select("doc_id", F.md5(F.regexp_replace(F.concat("text", F.lit(" and with the")), "( (and|with|the|for))+\\z", "")).alias("stripped_md5"))


@book.query("SELECT doc_id, len(w)::BIGINT AS n, len(list_distinct(w))::BIGINT AS different FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN ('the', 'and', 'for', 'with')) AS w FROM documents)")
def word_walk(spark, t):
    stop = F.array(*[F.lit(x) for x in ("the", "and", "for", "with")])
    w = t.documents.select("doc_id", F.filter(letters(C("text")), lambda x: ~F.array_contains(stop, x)).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n"), F.size(F.array_distinct("w")).cast("bigint").alias("different"))


@book.query("SELECT p_partkey, levenshtein(p_name, p_type) <= CASE WHEN length(p_name) <= 4 THEN 0 WHEN length(p_name) <= 6 THEN 2 ELSE 3 END AS near FROM part")
def fuzzy_budget(spark, t):
    """Edit budget by word length: none up to 4 letters, 2 up to 6, else 3."""
    budget = F.when(F.length("p_name") <= 4, 0).when(F.length("p_name") <= 6, 2).otherwise(3)
    return t.part.select("p_partkey", (F.levenshtein("p_name", "p_type") <= budget).alias("near"))


@book.query(f"SELECT ord, translate(formula, ' ()' || chr(9), '') AS key FROM {STORE}")
def norm_expr(spark, t):
    return R.store(spark).select("ord", R.norm_expr(C("formula")).alias("key"))


@book.query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar')")
def ci_contains(spark, t):
    return t.part.filter(F.lower("p_name").contains("ar")).select("p_partkey")


@book.query(f"""WITH v AS (SELECT ord, unnest(list_distinct(regexp_extract_all(formula, '[A-Za-z]+'))) AS x FROM {STORE}) SELECT ord, lower(x) AS x, count(*) AS spellings FROM v GROUP BY 1, 2 HAVING count(*) = 1""")
def ci_unique(spark, t):
    """Variables whose case difference is unambiguous within their relation."""
    v = R.store(spark).select("ord", F.explode(F.array_distinct(F.regexp_extract_all("formula", F.lit("[A-Za-z]+"), F.lit(0)))).alias("x"))
    return v.groupBy("ord", F.lower("x").alias("x")).agg(F.count("*").alias("spellings")).filter("spellings = 1")


@book.query(f"SELECT ord, len(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*')))::BIGINT AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(formula, '[A-Za-z][A-Za-z0-9_]*'))), ' ') AS vars FROM {STORE}")
def formula_vars(spark, t):
    v = R.variables(C("formula"))
    return R.store(spark).select("ord", F.size(v).cast("bigint").alias("n"), F.array_join(F.array_sort(v), " ").alias("vars"))


@book.query(f"SELECT ord, replace(replace(formula, 'v', '(3)'), 'm', '(2)') AS filled FROM {STORE}")
def substitute_fold(spark, t):
    """Symbols replaced by values, one after another, in one fold."""
    pairs = F.array(F.struct(F.lit("v").alias("k"), F.lit("(3)").alias("x")), F.struct(F.lit("m").alias("k"), F.lit("(2)").alias("x")))
    return R.store(spark).select("ord", F.aggregate(pairs, C("formula"), lambda acc, p: F.replace(acc, p["k"], p["x"])).alias("filled"))


@book.query(f"SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(gen, '<arg>', chr(1)), '<a>', chr(2)), 'a', 'q'), chr(1), '<arg>'), chr(2), '<a>')) AS renamed_md5 FROM {_GENS}")
def tag_safe_rename(spark, t):
    """Protocol tags are masked, the variable is renamed, the tags come back."""
    r = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    g = r(r(C("gen"), "<arg>", "\x01"), "<a>", "\x02")
    return _gens(t).select("conv_id", "turn", F.md5(r(r(r(g, "a", "q"), "\x01", "<arg>"), "\x02", "<a>")).alias("renamed_md5"))


@book.query("SELECT doc_id, 'k' || substr(sha256('text/v1:' || source || ':' || doc_id), 1, 7) AS rid FROM documents")
def sha_prefix(spark, t):
    key = F.concat(F.lit("text/v1:"), "source", F.lit(":"), C("doc_id").cast("string"))
    return t.documents.select("doc_id", F.concat(F.lit("k"), F.substring(F.sha2(key, 256), 1, 7)).alias("rid"))


@book.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@book.query(f"""SELECT key, arg_min(meaning, doc_id) AS meaning, 'k' || substr(sha256('ktext/v1:' || key), 1, 7) AS rid FROM
  (SELECT doc_id, lower(trim(regexp_extract(text, '{W_}'))) AS key, md5(text) AS meaning FROM documents) WHERE key <> '' GROUP BY key""")
def pack_terms(spark, t):
    """Terms trimmed, empty ones dropped, the first meaning per lower-cased term kept."""
    rows = t.documents.select("doc_id", F.lower(F.trim(F.regexp_extract("text", W_, 0))).alias("key"), F.md5("text").alias("meaning")).filter("key <> ''")
    return rows.groupBy("key").agg(F.min_by("meaning", "doc_id").alias("meaning")).withColumn("rid", F.concat(F.lit("k"), F.substring(F.sha2(F.concat(F.lit("ktext/v1:"), "key"), 256), 1, 7)))


@book.query("""WITH a AS (SELECT doc_id // 1000 AS b, sha256(string_agg(md5(text), ',' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY 1),
  m AS (SELECT b // 1000 AS b, sha256(string_agg(h, ',' ORDER BY b)) AS h, sum(n) AS n FROM a GROUP BY b // 1000)
  SELECT substr(sha256(string_agg(h, ',' ORDER BY b)), 1, 16) AS stamp, sum(n)::BIGINT AS inputs FROM m""")
def corpus_stamp(spark, t):
    """One digest of all documents in id order: digests of blocks of 1000, of 1000 blocks, of all.

    No list holds more than a thousand digests until the last, which has one per million.
    """
    level = t.documents.select(C("doc_id").alias("k"), F.md5("text").alias("h"), F.lit(1).cast("bigint").alias("n"))
    for _ in range(2):
        level = level.groupBy(F.expr("k div 1000").alias("b")).agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("m"), F.sum("n").alias("n")).select(C("b").alias("k"), F.sha2(F.array_join("m.h", ","), 256).alias("h"), "n")
    last = level.agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("m"), F.sum("n").alias("inputs"))
    return last.select(F.substring(F.sha2(F.array_join("m.h", ","), 256), 1, 16).alias("stamp"), "inputs")


@book.query("""SELECT source, count(*) AS docs, sum(CASE WHEN r < 1 THEN 0 ELSE 1 END)::BIGINT AS repeating FROM (SELECT source, len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10))) AS q, CASE WHEN len(list_distinct(string_split(text, chr(10)))) < len(string_split(text, chr(10))) THEN 1 ELSE 0 END AS r FROM documents) GROUP BY 1""")
def dup_line_ratio(spark, t):
    lines = t.documents.select("source", F.split("text", "\n").alias("l"))
    return lines.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.size(F.array_distinct("l")) < F.size("l")).alias("repeating"))


@book.query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = before) AS repeats FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1""")
def turn_alternation(spark, t):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("before", before).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(C("role") == C("before")).alias("repeats"))
