"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs
to).  A flow network routes each pattern's words to the quotas of its sources: a first
use of a pattern's words is free of cost, every further repetition costs more (convex),
up to MAX_COPIES.  The flow of a pattern becomes whole copies of all its documents and
a remainder that a seeded selection of its documents fills.

Only sources that share documents need a flow: the network falls apart into the sets of
sources that patterns tie together, and a source on its own gets its quota from its own
documents.  Up to MAX_PATTERNS patterns the driver holds one row per pattern and source;
beyond that sources are ranked, filled and joined on the executors, and the driver holds
the overlapping patterns alone (more than MAX_PATTERNS of those are refused with a
ValueError: a flow is not found in parts).  Documents never leave the executors.  The remainder of a pattern is
selected by hash order: a histogram of BUCKETS hash ranges finds the one in which the
quota is reached, and only that range (1/BUCKETS of the pattern) is ordered.

Defined results.  Null text has size 0 and is taken 0 words.  A null source is a source
of its own, ordered last.  Rows with null or repeated ids are rows like all others; equal
rows may be taken alike.  An empty table gives an empty table.  Extra columns are
carried, but for the output's names.  The same rows always give the same mix.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, stored

#: Characters that separate words, fixed values.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_COPIES = 1.5, 2
MAX_PATTERNS = 100_000
BUCKETS = 4096
SEED = 11


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets by weight that stop at `most` times a source's size; the excess is reshared."""
    target = [0.0] * len(sizes)
    free = [i for i, w in enumerate(weights) if w > 0]
    left = min(total, most * sum(sizes[i] for i in free))
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if share * weights[i] >= most * sizes[i]]
        if not full:
            for i in free:
                target[i] = share * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        free = [i for i in free if i not in full]
        left = max(left, 0.0)
    return target


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost) of a maximum flow of least cost.

    Successive shortest paths with node potentials; costs are not negative.
    """
    head, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for u, v, c, w in arcs:
        for a, b, k, x in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(head))
            head.append(b)
            cap.append(k)
            cost.append(x)
    potential = [0] * nodes
    while True:
        best: list[int | None] = [None] * nodes
        via = [-1] * nodes
        best[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > best[u]:
                continue
            for e in out[u]:
                if cap[e] > 0:
                    v, n = head[e], d + cost[e] + potential[u] - potential[head[e]]
                    if best[v] is None or n < best[v]:
                        best[v], via[v] = n, e
                        heapq.heappush(queue, (n, v))
        if best[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        reach = best[sink]
        for u in range(nodes):
            potential[u] += min(best[u], reach) if best[u] is not None else reach
        amount, u = None, sink
        while u != source:
            amount = cap[via[u]] if amount is None else min(amount, cap[via[u]])
            u = head[via[u] ^ 1]
        u = sink
        while u != source:
            cap[via[u]] -= amount
            cap[via[u] ^ 1] += amount
            u = head[via[u] ^ 1]


def route(pattern_sizes: list[int], memberships: list[list[int]], quotas: list[int], copies: int = MAX_COPIES) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources."""
    p, s = len(pattern_sizes), len(quotas)
    arcs = []
    for i, size in enumerate(pattern_sizes):
        arcs += [(p + s, i, size, c * c) for c in range(copies)]
    first = len(arcs)
    pairs = [(i, k) for i, own in enumerate(memberships) for k in own]
    arcs += [(i, p + k, copies * pattern_sizes[i], 0) for i, k in pairs]
    arcs += [(p + k, p + s + 1, q, 0) for k, q in enumerate(quotas)]
    flow = min_cost_flow(p + s + 2, arcs, p + s, p + s + 1)
    out: list[dict[int, int]] = [{} for _ in pattern_sizes]
    for (i, k), f in zip(pairs, flow[first : first + len(pairs)]):
        out[i][k] = f
    return out


def route_apart(pattern_sizes: list[int], memberships: list[list[int]], quotas: list[int], copies: int = MAX_COPIES) -> list[int]:
    """Words that each pattern gives in all: `route`, for each set of tied sources alone."""
    parent = list(range(len(quotas)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for own in memberships:
        for k in own[1:]:
            parent[root(k)] = root(own[0])
    parts: dict[int, list[int]] = {}
    for i, own in enumerate(memberships):
        parts.setdefault(root(own[0]), []).append(i)
    out = [0] * len(pattern_sizes)
    for patterns in parts.values():
        if len(patterns) == 1 and len(memberships[patterns[0]]) == 1:
            i = patterns[0]
            out[i] = min(quotas[memberships[i][0]], copies * pattern_sizes[i])
            continue
        sources = sorted({k for i in patterns for k in memberships[i]})
        place = {k: j for j, k in enumerate(sources)}
        flows = route([pattern_sizes[i] for i in patterns], [[place[k] for k in memberships[i]] for i in patterns], [quotas[k] for k in sources], copies)
        for i, f in zip(patterns, flows):
            out[i] = sum(f.values())
    return out


def code_point_order(names: list[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def annotate(df: DataFrame, id_col: str = "doc_id", text: str = "text", sources: str = "source", seed: int = SEED) -> DataFrame:
    """`df` with `size` and the working columns that `choose` needs."""
    if isinstance(df.schema[sources].dataType, T.ArrayType):
        nothing = F.array(F.lit(None).cast("string"))
        pattern = F.array_distinct(F.coalesce(F.col(sources).cast("array<string>"), nothing))
        pattern = F.when(F.size(pattern) == 0, nothing).otherwise(F.sort_array(pattern))
    else:
        pattern = F.array(F.col(sources).cast("string"))
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text).cast("string")), F.lit(1 << 40))
    return df.withColumns({"size": words(text), "__pattern": F.to_json(F.struct(pattern.alias("p"))), "__order": order, "__bucket": F.shiftright(order, 28).cast("int"), "__id": F.col(id_col)})


PLAN = "__pattern string, source_size long, target double, __whole int, __rest long"


def plan_of(stats: DataFrame, weights: dict | None, share: float, copies: int) -> list[tuple]:
    """Per pattern (`stats`: __pattern and its words n): source_size, target, whole copies of all its documents, words besides."""
    totals = stats.collect()
    totals.sort(key=lambda r: r[0])
    members = [json.loads(r[0])["p"] for r in totals]
    names = code_point_order(list({x for m in members for x in m}))
    place = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for r, m in zip(totals, members):
        for x in m:
            sizes[place[x]] += r.n
    wanted = [float(weights.get(x, 0.0)) if weights is not None else WEIGHTS[i % len(WEIGHTS)] for i, x in enumerate(names)]
    target = water_fill(sizes, wanted, share * sum(r.n for r in totals), copies)
    wants = route_apart([r.n for r in totals], [[place[x] for x in m] for m in members], [round(t) for t in target], copies)
    plan = []
    for r, m, want in zip(totals, members, wants):
        whole = min(copies, want // r.n) if r.n else 0
        first = place[code_point_order(m)[0]]
        plan.append((r[0], int(sizes[first]), float(target[first]), int(whole), int(want - whole * r.n)))
    return plan


def ranked(sources: DataFrame) -> DataFrame:
    """`sources` with `place`: the rank of `x` by code point, null last; one count per partition meets on the driver."""
    order = F.asc_nulls_last("x")
    dealt = stored(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranks")
    counts = sorted(dealt.groupBy("part").count().collect())
    before, first = 0, []
    for part, n in counts:
        first.append((part, before))
        before += n
    starts = F.broadcast(sources.sparkSession.createDataFrame(first, "part int, before long"))  # one row a partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("within", within).join(starts, "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "within", "before")


def plan_wide(stats: DataFrame, weights: dict | None, share: float, copies: int) -> DataFrame:
    """`plan_of` where patterns are too many for the driver: sources stay on the executors.

    Targets are min(level * weight, copies * size); the level rises as full sources leave,
    as in `water_fill`, by one aggregate a round.
    """
    spark = stats.sparkSession
    told = stats.withColumn("m", F.from_json("__pattern", "p array<string>")["p"])
    each = told.select("__pattern", "n", F.explode("m").alias("x"), (F.size("m") > 1).alias("shared"))
    sources = ranked(each.groupBy("x").agg(F.sum("n").alias("size"), F.max("shared").alias("tied")))
    if weights is None:
        weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
        sources = sources.withColumn("weight", weight)
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, weight double")
        sources = sources.join(given, F.col("x").eqNullSafe(F.col("k")), "left").drop("k").fillna(0.0, ["weight"])
    sources = stored(sources, "mix-sources")
    total = share * (stats.agg(F.sum("n")).first()[0] or 0)
    all_, level = sources.filter("weight > 0").agg(F.sum("size")).first()[0] or 0, -1.0
    total = min(total, float(copies * all_))
    while True:
        full = F.col("weight") * level >= copies * F.col("size")
        held = sources.filter("weight > 0").agg(F.sum(F.when(full, copies * F.col("size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not held[1]:
            break
        after = max(total - (held[0] or 0), 0.0) / held[1]
        if after <= level:
            break
        level = after
    target = F.when(F.col("weight") > 0, F.least(F.col("weight") * max(level, 0.0), (copies * F.col("size")).cast("double"))).otherwise(0.0)
    sources = sources.withColumn("target", target)
    by = each.join(sources, each["x"].eqNullSafe(sources["x"])).select("__pattern", "n", "shared", sources["x"], "size", "target", "tied", "place")
    firsts = by.groupBy("__pattern", "n").agg(F.min(F.struct("place", "size", "target")).alias("f"), F.max(F.struct("shared", "tied")).alias("t"), F.collect_list(F.struct("place", "target")).alias("own"))
    firsts = stored(firsts.select("__pattern", "n", F.col("f.size").alias("source_size"), F.col("f.target").alias("target"), (F.col("t.shared") | F.col("t.tied")).alias("tied"), "own"), "mix-patterns")
    tied = firsts.filter("tied").limit(MAX_PATTERNS + 1).collect()
    if len(tied) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources that share documents")
    tied.sort(key=lambda r: r[0])
    quotas = {o.place: round(o.target) for r in tied for o in r.own}
    seat = {k: j for j, k in enumerate(sorted(quotas))}
    wants = route_apart([r.n for r in tied], [sorted(seat[o.place] for o in r.own) for r in tied], [quotas[k] for k in sorted(quotas)], copies)
    flows = spark.createDataFrame([(r[0], w) for r, w in zip(tied, wants)], "__pattern string, want long")
    alone = firsts.filter("not tied").withColumn("want", F.least(F.round("target"), copies * F.col("n")).cast("long"))
    both = alone.unionByName(firsts.filter("tied").join(F.broadcast(flows), "__pattern"))  # MAX_PATTERNS rows at most
    whole = F.when(F.col("n") > 0, F.least(F.lit(copies), F.expr("want div n"))).otherwise(0).cast("int")
    return both.withColumn("__whole", whole).select("__pattern", "source_size", "target", "__whole", (F.col("want") - F.col("__whole") * F.col("n")).alias("__rest"))


def choose(base: DataFrame, stats: DataFrame, weights: dict | None = None, share: float = SHARE, copies: int = MAX_COPIES) -> DataFrame:
    """Annotated rows `base` with the mix's decision; `stats` are the same rows, narrow and stored."""
    patterns = stored(stats.groupBy("__pattern").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")), "mix-totals")
    few, rows = patterns.count() <= MAX_PATTERNS, 0
    if few:
        plans = F.broadcast(base.sparkSession.createDataFrame(plan_of(patterns.drop("rows"), weights, share, copies), PLAN))
    else:
        rows = patterns.agg(F.sum("rows")).first()[0]
        plans = stored(plan_wide(patterns.drop("rows"), weights, share, copies).join(patterns.select("__pattern", "rows"), "__pattern"), "mix-plan")
    filled = Window.partitionBy("__pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        stats.groupBy("__pattern", "__bucket").agg(F.sum("size").alias("n"))
        .withColumn("upto", F.sum("n").over(filled))
        .join(plans.select("__pattern", "__rest"), "__pattern")
        .filter("upto > __rest and upto - n <= __rest and __rest > 0")
        .select("__pattern", F.col("__bucket").alias("__cut"), (F.col("__rest") - F.col("upto") + F.col("n")).alias("__inside"))
    )
    if few:
        planned = base.join(plans, "__pattern").join(F.broadcast(cut), "__pattern", "left")  # one cut per pattern at most
    else:
        planned = attach(base, plans.join(cut, "__pattern", "left"), "__pattern", "rows", rows).drop("rows")
    at_cut = F.coalesce(F.col("__bucket") == F.col("__cut"), F.lit(False))
    below = (F.col("__rest") > 0) & F.coalesce(F.col("__bucket") < F.col("__cut"), F.lit(True))
    outside = planned.filter(~at_cut).withColumn("__extra", below.cast("int"))
    upto = Window.partitionBy("__pattern").orderBy("__order", F.asc_nulls_last("__id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = planned.filter(at_cut).withColumn("__before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    inside = inside.withColumn("__extra", (2 * (F.col("__inside") - F.col("__before")) >= F.col("size")).cast("int")).drop("__before")
    taken = F.when(F.col("size") > 0, F.col("__whole") + F.col("__extra")).otherwise(0)
    out = outside.unionByName(inside).withColumn("copies", taken.cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.drop("__pattern", "__order", "__bucket", "__id", "__whole", "__rest", "__cut", "__inside", "__extra")


OUT = ("size", "source_size", "target", "taken", "copies")


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", sources: str = "source", weights: dict | None = None, share: float = SHARE, copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """`df` with `size`, `source_size`, `target`, `taken` (words, repeats counted) and `copies`.

    `sources` is a string column, or an array of the sources that a document belongs to;
    for arrays, source_size and target are those of the first source by code point.
    """
    base = annotate(df.drop(*[c for c in OUT if c not in (id_col, text, sources)]), id_col, text, sources, seed)
    return choose(base, stored(base.select("__pattern", "size", "__bucket"), "mix-sizes"), weights, share, copies)


def decisions(docs: DataFrame) -> DataFrame:
    """Result of the registered query: one narrow row per document."""
    base = stored(annotate(docs.select("doc_id", "text", "source")).drop("text", "source"), "mix-sizes")
    return choose(base, base).select("doc_id", "size", "source_size", "target", "taken", "copies")
