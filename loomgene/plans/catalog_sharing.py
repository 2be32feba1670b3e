"""Queries of shared segments and of the haplotype sort."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import frequency, ibs2, pbwt
from ..operators.joins import many
from .catalog import query, r6
from .stages import keep_once

#: Steps of markers for the queries: four in a row on a chromosome that are informative.
_INFO = """, k AS (SELECT m, count(*) * 2 AS n, count(a1) + count(a2) AS present, coalesce(sum(a1), 0) + coalesce(sum(a2), 0) AS alt FROM calls GROUP BY m),
inf AS (SELECT m FROM k WHERE least(alt / present, 1 - alt / present) >= 0.1 AND 1 - present / n <= 0.1),
ic AS (SELECT chrom, pos, m, pos / 1e6 AS gen, sample, a1, a2, (dense_rank() OVER (PARTITION BY chrom ORDER BY pos) - 1) // 4 AS step FROM calls WHERE m IN (SELECT m FROM inf)) """
_USE = _INFO + """, us AS (SELECT chrom, step, sample FROM ic GROUP BY ALL HAVING count(*) FILTER (a1 IS NULL OR a2 IS NULL) <= floor(count(*) * 0.25)),
uc AS (SELECT ic.* FROM ic SEMI JOIN us USING (chrom, step, sample)) """
_PAIRS = _USE + """, sp AS (SELECT a.chrom, a.step, a.sample, b.sample AS other FROM uc a JOIN uc b ON a.chrom = b.chrom AND a.step = b.step AND a.pos = b.pos AND a.sample < b.sample GROUP BY ALL
  HAVING bool_and(a.a1 IS NULL OR a.a2 IS NULL OR b.a1 IS NULL OR b.a2 IS NULL OR (least(a.a1, a.a2) = least(b.a1, b.a2) AND greatest(a.a1, a.a2) = greatest(b.a1, b.a2)))) """
_SEGS = _PAIRS + """, st AS (SELECT chrom, step, min(pos) AS first, max(pos) AS last, min(gen) AS g1, max(gen) AS g2 FROM ic GROUP BY ALL),
j AS (SELECT *, CASE WHEN g1 - lag(g2) OVER w <= 0.05 THEN 0 ELSE 1 END AS new FROM sp JOIN st USING (chrom, step) WINDOW w AS (PARTITION BY chrom, sample, other ORDER BY first)),
n AS (SELECT *, sum(new) OVER (PARTITION BY chrom, sample, other ORDER BY first) AS k FROM j),
sg AS (SELECT chrom, sample, other, min(first) AS first, max(last) AS last, min(g1) AS g1, max(g2) AS g2 FROM n GROUP BY chrom, sample, other, k) """


def _calls(spark, d):
    c = fx.calls(spark, d)
    haps = c.select("m", F.explode(F.array("a1", "a2")).alias("allele"))
    inf = ibs2.informative(frequency.allele_counts(haps, ["m"]))
    ic = c.join(many(inf.select("m")), "m", "left_semi").withColumn("gen", F.col("pos") / 1e6)
    places = ibs2.numbered_steps(keep_once(ic.select("chrom", "pos").distinct()), 4)
    return keep_once(ic.join(many(places), ["chrom", "pos"]))


@query(_INFO + "SELECT m FROM inf", "calls")
def informative_markers(spark, d):
    c = fx.calls(spark, d)
    return ibs2.informative(frequency.allele_counts(c.select("m", F.explode(F.array("a1", "a2")).alias("allele")), ["m"])).select("m")


@query(_USE + "SELECT chrom, step, sample FROM us", "calls")
def usable_samples(spark, d):
    return ibs2.usable(_calls(spark, d), 0.25).select("chrom", "step", "sample").distinct()


@query(_PAIRS + "SELECT chrom, step, sample, other FROM sp", "calls")
def shared_steps(spark, d):
    return ibs2.step_pairs(ibs2.step_classes(ibs2.usable(_calls(spark, d), 0.25)))


def _segments(spark, d):
    c = _calls(spark, d)
    steps = c.groupBy("chrom", "step").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("gen").alias("g1"), F.max("gen").alias("g2"))
    return c, ibs2.segments(ibs2.step_pairs(ibs2.step_classes(ibs2.usable(c, 0.25))), steps, 0.05)


@query(_SEGS + "SELECT chrom, sample, other, first, last, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM sg", "calls")
def shared_segments(spark, d):
    return r6(_segments(spark, d)[1], "g1", "g2")


@query(_SEGS + "SELECT sg.chrom, sg.sample, other, pos FROM sg JOIN (SELECT DISTINCT chrom, pos FROM ic) m ON sg.chrom = m.chrom AND pos BETWEEN first AND last", "calls")
def markers_in_segments(spark, d):
    c, s = _segments(spark, d)
    return ibs2.markers_in_segments(s, c.select("chrom", "pos").distinct(), 100_000)


_EXT = _SEGS + """, b AS (SELECT p.chrom, p.sample, p.other, x.pos, x.gen, coalesce((least(x.a1, x.a2) = least(y.a1, y.a2) AND greatest(x.a1, x.a2) = greatest(y.a1, y.a2)), true) AS ok
  FROM (SELECT DISTINCT chrom, sample, other FROM sg) p JOIN ic x ON p.chrom = x.chrom AND p.sample = x.sample JOIN ic y ON p.chrom = y.chrom AND p.other = y.sample AND x.pos = y.pos),
e AS (SELECT chrom, sample, other, greatest((SELECT coalesce(max(pos), -1) FROM b WHERE NOT ok AND b.chrom = sg.chrom AND b.sample = sg.sample AND b.other = sg.other AND b.pos < first), -1) AS lo,
  (SELECT coalesce(min(pos), 9e15) FROM b WHERE NOT ok AND b.chrom = sg.chrom AND b.sample = sg.sample AND b.other = sg.other AND b.pos > last) AS hi FROM sg),
x AS (SELECT DISTINCT e.chrom, e.sample, e.other, min(pos) AS first, max(pos) AS last, min(gen) AS g1, max(gen) AS g2 FROM e JOIN b ON e.chrom = b.chrom AND e.sample = b.sample AND e.other = b.other AND pos > lo AND pos < hi GROUP BY e.chrom, e.sample, e.other, lo, hi) """


@query(_EXT + "SELECT chrom, sample, other, first, last, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM x WHERE g2 - g1 >= 0.05", "calls")
def extended_segments(spark, d):
    c, s = _segments(spark, d)
    return r6(ibs2.long_enough(ibs2.extend(s, c), 0.05), "g1", "g2")


_PREFIX = """, w AS (SELECT *, m // 25 AS win FROM panel), p AS (SELECT a.win, a.m, a.hap, string_agg(b.allele::VARCHAR, '' ORDER BY b.m DESC) AS prefix FROM w a JOIN w b ON a.win = b.win AND a.hap = b.hap AND b.m <= a.m GROUP BY ALL) """


@query(_PREFIX + "SELECT win, m, hap, row_number() OVER (PARTITION BY win, m ORDER BY prefix, hap) - 1 AS rank FROM p", "panel")
def haplotype_ranks(spark, d):
    p = fx.panel(spark, d).withColumn("win", F.expr("m div 25"))
    return pbwt.ranks(pbwt.vectors(p, ["win"]), ["win"]).drop("match_start")


@query(
    _PREFIX + """, r AS (SELECT win, m, hap, prefix, lag(prefix) OVER (PARTITION BY win, m ORDER BY prefix, hap) AS before FROM p),
c AS (SELECT win, m, hap, m - win * 25 + 1 AS n, (SELECT count(*) FROM range(1, 26) t(k) WHERE k <= length(prefix) AND before IS NOT NULL AND substr(prefix, 1, k) = substr(before, 1, k)) AS same FROM r)
SELECT win, m, hap, n - same AS match_start FROM c""",
    "panel",
)
def match_starts(spark, d):
    p = fx.panel(spark, d).withColumn("win", F.expr("m div 25"))
    return pbwt.ranks(pbwt.vectors(p, ["win"]), ["win"]).drop("rank")
