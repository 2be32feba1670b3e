"""Mixing sources to target weights by hash thresholds, without sorting.

Each row has a hash of its id. Sizes are summed per source and hash bucket; the bucket in which a
source's budget ends is split into finer buckets, level by level, over its rows only, until the
budget ends at one hash value. Rows below it are taken once more than the whole copies that every
row of the source gets. Thresholds of larger budgets include those of smaller ones, so mixes nest.

Nulls: a null text has size 0, a null source is the last source, null ids share one hash. Rows with
the same id share a hash and are taken together. An empty table gives an empty result, a source of
size 0 the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Weights by the sources' order, repeating, and the share of all sizes that is taken, as num / den.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
#: A target is at most so many times its source's size.
MOST = 2
SEED = "mix-1"
#: A hash has HEX * 4 bits; each level splits by LEVEL_BITS of them.
HEX, LEVEL_BITS = 15, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(id_col: Column, seed: str = SEED) -> Column:
    """60 bits of an MD5 digest as a long."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, rest) from rows with source and size.

    Targets are min(MOST * size, level * weight) with the level at which they sum to the share of all
    sizes: sources in the order of size by weight reach their limit first, one after another.
    """
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = by_source.selectExpr("source", "source_size", "row_number() over (order by source nulls last) - 1 as k")
    cycle = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("k") % len(WEIGHTS) + 1).cast("int")).cast("bigint")
    weighted = ranked.withColumn("w", cycle)
    scale = 1
    for w in WEIGHTS:
        scale *= w
    num, den = SHARE
    order = f"over (order by source_size * {scale} div w, k rows between unbounded preceding and 1 preceding)"
    run = weighted.selectExpr("*", "sum(source_size) over () as total", "sum(w) over () as all_w", f"coalesce(sum(source_size) {order}, 0) as before", f"coalesce(sum(w) {order}, 0) as before_w")
    full = run.withColumn("full", F.expr(f"{MOST * den} * source_size * (all_w - before_w) <= w * ({num} * total - {MOST * den} * before)"))
    open_ = full.selectExpr("*", "coalesce(sum(case when full then source_size end) over (), 0) as full_size", "coalesce(sum(case when full then w end) over (), 0) as full_w")
    target = F.expr(f"case when full then cast({MOST} * source_size as double) else cast(w * ({num} * total - {MOST * den} * full_size) as double) / cast({den} * (all_w - full_w) as double) end")
    copies = F.expr("case when source_size = 0 then 0 else cast(floor(target / source_size) as bigint) end")
    return open_.withColumn("target", target).withColumn("copies", copies).selectExpr("source", "source_size", "target", "copies", "target - copies * source_size as rest")


def cuts(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, cut): rows of the source with a hash below cut get one copy more.

    sizes: source, size, h. One histogram for each level; after the first over boundary rows only.
    """
    bits = HEX * 4
    at = goals.selectExpr("source as s", "rest", "cast(0 as bigint) as low", "cast(0 as bigint) as before")
    rows = sizes.select("source", "size", "h")
    while bits > 0:
        bits = max(0, bits - LEVEL_BITS)
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("s")))
        if bits < HEX * 4 - LEVEL_BITS:
            inside = inside.where(F.shiftright("h", bits + LEVEL_BITS) == F.shiftright("low", bits + LEVEL_BITS))
        hist = inside.groupBy("s", "rest", "before", F.shiftright("h", bits).alias("b")).agg(F.sum("size").alias("n"))
        upto = hist.selectExpr("s", "rest", "b", "n", "before + sum(n) over (partition by s order by b) as upto")
        #: The first bucket that reaches the budget, or the last one.
        ends = upto.groupBy("s", "rest").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("b", "upto", "n"))), F.max(F.struct("b", "upto", "n"))).alias("e"))
        at = ends.selectExpr("s", "rest", f"shiftleft(e.b, {bits}) as low", "e.upto - e.n as before", "e.upto as upto")
        at = written(at, "cuts")
        last, at = at, at.drop("upto")
    whole = (F.col("rest") > 0) & ((F.col("upto") - F.col("rest")) <= (F.col("rest") - F.col("before")))
    return last.select(F.col("s").alias("source"), F.when(whole, F.col("low") + 1).otherwise(F.col("low")).alias("cut"))


def plan(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target, copies and cut."""
    goals = written(targets(sizes), "targets")
    c = cuts(sizes, goals).select(F.col("source").alias("c_source"), "cut")
    return goals.join(c, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).alias("cut"))


def mix_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Per row: doc (its id), size, source_size, target, times (how often the mix takes it) and taken (words)."""
    sizes = written(df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), hash_of(F.col(f"`{id_col}`"), seed).alias("h")), "sizes")
    p = plan(sizes).withColumnRenamed("source", "p_source")
    joined = sizes.join(p, F.col("source").eqNullSafe(F.col("p_source")))
    times = F.col("copies") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
    return joined.select("doc", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """df's rows, each as often as the mix takes it. Texts are not shuffled where sources are few."""
    names = df.columns
    own = [f"_r{i}" for i in range(len(names))]
    of = dict(zip(names, own))
    plain = df.toDF(*own)
    sizes = written(plain.select(F.col(of[source_col]).alias("source"), word_count(F.col(of[text_col])).alias("size"), hash_of(F.col(of[id_col]), seed).alias("h")), "sizes")
    p = written(plan(sizes), "plan")
    many = p.count() > 100_000
    joined = plain.join(p if many else F.broadcast(p), F.col(of[source_col]).eqNullSafe(F.col("source")))
    times = F.col("copies") + F.when(hash_of(F.col(of[id_col]), seed) < F.col("cut"), 1).otherwise(0)
    return joined.select(*own, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[F.col(o).alias(n) for o, n in zip(own, names)])


def oracle() -> str:
    """DuckDB SQL of the query's rows: the same thresholds by a running sum in hash order."""
    scale = 1
    for w in WEIGHTS:
        scale *= w
    num, den = SHARE
    order = f"OVER (ORDER BY source_size * {scale} // w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {HEX}) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, k, CAST([{', '.join(map(str, WEIGHTS))}][k % {len(WEIGHTS)} + 1] AS BIGINT) AS w
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s)),
r AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
  CAST(coalesce(sum(source_size) {order}, 0) AS BIGINT) AS before, CAST(coalesce(sum(w) {order}, 0) AS BIGINT) AS before_w FROM w),
f AS (SELECT *, {MOST * den} * source_size * (all_w - before_w) <= w * ({num} * total - {MOST * den} * before) AS full_ FROM r),
o AS (SELECT *, CAST(coalesce(sum(source_size) FILTER (full_) OVER (), 0) AS BIGINT) AS full_size, CAST(coalesce(sum(w) FILTER (full_) OVER (), 0) AS BIGINT) AS full_w FROM f),
t AS (SELECT source, source_size, CASE WHEN full_ THEN CAST({MOST} * source_size AS DOUBLE)
  ELSE CAST(w * ({num} * total - {MOST * den} * full_size) AS DOUBLE) / CAST({den} * (all_w - full_w) AS DOUBLE) END AS target FROM o),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS copies FROM t),
u AS (SELECT source, h, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM u),
e AS (SELECT c.source, c.h, c.upto < g.target - g.copies * g.source_size
    OR (g.target - g.copies * g.source_size > 0 AND c.upto - c.n < g.target - g.copies * g.source_size
      AND c.upto - (g.target - g.copies * g.source_size) <= (g.target - g.copies * g.source_size) - (c.upto - c.n)) AS extra
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, g.source_size, g.target, CAST(d.size * (g.copies + CASE WHEN e.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h"""
