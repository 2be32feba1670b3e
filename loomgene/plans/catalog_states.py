"""Queries of state probabilities, of sets of haplotypes and of look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import frequency, hmm, metrics, pbwt, posteriors, quality
from ..operators.joins import many
from ..sources import vcf
from .catalog import _BIN, query, r6
from .catalog_sharing import _PREFIX
from .stages import keep_once

_W = "SELECT l_orderkey AS k, l_linenumber AS hap, power(l_quantity / 50, 6) AS p FROM lineitem"


def _weights(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("hap"), F.pow(F.col("l_quantity") / 50, F.lit(6.0)).alias("p"))


@query(f"WITH w AS (SELECT k, hap, p / sum(p) OVER (PARTITION BY k) AS p FROM ({_W}) a), z AS (SELECT * FROM w WHERE p > 0.001) SELECT k, hap, round(p / sum(p) OVER (PARTITION BY k), 6) AS p FROM z")
def pruned_priors(spark, d):
    return r6(posteriors.prune_priors(posteriors.normalised(_weights(spark, d), ["k"]), ["k"], 20), "p")


@query("SELECT l_orderkey AS k, l_linenumber AS hap, l_quantity / 1000 AS prob, l_discount / 10 AS prob_next FROM lineitem WHERE greatest(l_quantity / 1000, l_discount / 10) > 0.005")
def sparse_posteriors(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("hap"), (F.col("l_quantity") / 1000).alias("prob"), (F.col("l_discount") / 10).alias("prob_next"))
    return posteriors.sparsify(rows, 2000, 100)


@query("SELECT m, hap, coalesce(s_acctbal, 1.0 / 40) AS prior FROM panel LEFT JOIN supplier ON s_suppkey = hap AND s_acctbal > 0", "panel")
def priors_with_default(spark, d):
    priors = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("hap"), F.col("s_acctbal").alias("prior"))
    return posteriors.with_priors(fx.panel(spark, d).select("m", "hap"), priors, ["hap"], fx.PANEL).select("m", "hap", "prior")


_HW = "((hap * 37 + m) % 11 + 1) / 16.0"


def _hap_weights(spark, d):
    return fx.panel(spark, d).select("m", "hap", F.expr("((hap * 37 + m) % 11 + 1) / 16D").alias("w"))


@query(f"SELECT m, allele, sum({_HW})::DOUBLE AS mass FROM panel GROUP BY m, allele", "panel")
def allele_mass(spark, d):
    return posteriors.allele_mass(_hap_weights(spark, d), fx.panel(spark, d).select("m", "hap", "allele"), ["m"])


@query(f"SELECT m, round(sum(CASE WHEN allele > 0 THEN {_HW} ELSE 0 END) / sum({_HW}), 6) AS share FROM panel GROUP BY m", "panel")
def carrier_share(spark, d):
    return r6(posteriors.carrier_share(_hap_weights(spark, d), fx.panel(spark, d).select("m", "hap", "allele"), ["m"]), "share")


_C = ", c AS (SELECT m, hap FROM panel WHERE allele = 1), n AS (SELECT m - 1 AS m, hap FROM panel WHERE allele = 1) "


def _two(spark, d):
    p = fx.panel(spark, d).where("allele = 1")
    return p.select("m", "hap"), p.select((F.col("m") - 1).alias("m"), "hap")


@query(_C + "SELECT m, hap FROM c UNION SELECT m, hap FROM n", "panel")
def carriers_union(spark, d):
    a, b = _two(spark, d)
    return a.union(b).distinct()


@query(_C + "SELECT m, hap FROM c INTERSECT SELECT m, hap FROM n", "panel")
def carriers_intersect(spark, d):
    a, b = _two(spark, d)
    both = b.toDF("_m", "_hap")
    return a.join(many(both), a.m.eqNullSafe(both._m) & a.hap.eqNullSafe(both._hap), "left_semi").distinct()


@query(_C + "SELECT m, hap FROM c EXCEPT ALL SELECT m, hap FROM n", "panel")
def carriers_except(spark, d):
    a, b = _two(spark, d)
    return a.exceptAll(b)


@query("SELECT m, array_to_string((list_concat(own, list_filter(range(0, 40), lambda x: NOT list_contains(own, x))))[1:8], ',') AS states FROM (SELECT m, coalesce(list_sort(list(hap) FILTER (allele = 1)), []) AS own FROM panel GROUP BY m)", "panel")
def state_lists(spark, d):
    g = fx.panel(spark, d).groupBy("m").agg(F.collect_list(F.when(F.col("allele") == 1, F.col("hap"))).alias("own"))
    return g.select("m", F.array_join(F.transform(posteriors.state_list(F.col("own"), 8, fx.PANEL), lambda x: x.cast("string")), ",").alias("states"))


@query(_PREFIX + ", r AS (SELECT win, m, hap, row_number() OVER (PARTITION BY win, m ORDER BY prefix, hap) AS k FROM p), s AS (SELECT win, m, hap, k + unnest([-2, -1, 1, 2]) AS k FROM r) SELECT s.win, s.m, s.hap, b.hap AS other FROM s JOIN r b ON s.win = b.win AND s.m = b.m AND s.k = b.k WHERE s.hap // 2 <> b.hap // 2", "panel")
def sorted_neighbours(spark, d):
    p = fx.panel(spark, d).withColumn("win", F.expr("m div 25"))
    return posteriors.rank_band(keep_once(pbwt.ranks(pbwt.vectors(p, ["win"]), ["win"])), ["win", "m"], 2)


@query(
    """, w AS (SELECT *, m // 25 AS win FROM panel), p AS (SELECT a.win, a.m, a.hap, string_agg(b.allele::VARCHAR, '' ORDER BY b.m) AS suffix FROM w a JOIN w b ON a.win = b.win AND a.hap = b.hap AND b.m >= a.m GROUP BY ALL),
r AS (SELECT win, m, hap, row_number() OVER w - 1 AS rank, suffix, lag(suffix) OVER w AS before FROM p WINDOW w AS (PARTITION BY win, m ORDER BY suffix, hap))
SELECT win, m, hap, rank, m - win * 25 - 1 + (SELECT count(*) FROM range(1, 26) t(k) WHERE k <= length(suffix) AND before IS NOT NULL AND substr(suffix, 1, k) = substr(before, 1, k)) AS match_end FROM r""",
    "panel",
)
def backward_ranks(spark, d):
    p = fx.panel(spark, d).withColumn("win", F.expr("m div 25"))
    return pbwt.ranks(pbwt.vectors(p, ["win"]), ["win"], backward=True).withColumnRenamed("match_start", "match_end")


@query("SELECT sample, count(*) FILTER (o = 1) AS swaps, count(*) AS seen, round((count(*) FILTER (o = 1) + 0.5) / (count(*) + 1), 6) AS p, round(greatest(count(*) FILTER (o = 1) + 0.5, count(*) FILTER (o = 0) + 0.5) / least(count(*) FILTER (o = 1) + 0.5, count(*) FILTER (o = 0) + 0.5), 6) AS ratio FROM hets GROUP BY sample", "hets")
def swap_odds(spark, d):
    return r6(posteriors.swap_odds(fx.hets(spark, d).withColumn("swap", F.col("o") == 1), ["sample"]), "p", "ratio")


@query("SELECT sample, round(avg(o), 6) AS mean_state, round(avg(moved), 6) AS switch_rate FROM (SELECT *, (o <> lag(o) OVER (PARTITION BY sample ORDER BY pos))::INT AS moved FROM hets) GROUP BY sample", "hets")
def path_trace(spark, d):
    return r6(posteriors.trace(fx.hets(spark, d).withColumnRenamed("o", "state"), ["sample"]), "mean_state", "switch_rate")


@query("SELECT round(count(*) FILTER (c = 0) / count(*), 6) AS hom_ref_rate, round(count(*) FILTER (t > 0 AND c > 0) / count(*) FILTER (t > 0), 6) AS alt_association FROM pairs", "pairs")
def call_rates(spark, d):
    return r6(posteriors.call_rates(fx.pairs(spark, d)), "hom_ref_rate", "alt_association")


@query(
    """, o AS (SELECT sample, pos, o, CASE o WHEN 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS e1, row_number() OVER (PARTITION BY sample ORDER BY pos) AS k, count(*) OVER (PARTITION BY sample) AS n FROM hets),
f AS (SELECT sample, o, k, e1 AS p FROM o WHERE k = 1 UNION ALL
  SELECT o.sample, o.o, o.k, e1 * (0.9 * p + 0.05) / (e1 * (0.9 * p + 0.05) + (1 - e1) * (0.9 * (1 - p) + 0.05)) FROM f JOIN o ON o.sample = f.sample AND o.k = f.k + 1),
b AS (SELECT sample, k, e1, 0.5::DOUBLE AS b0, 0.5::DOUBLE AS b1 FROM o WHERE k = n UNION ALL
  SELECT o.sample, o.k, o.e1, 0.9 * b0 * (1 - b.e1) / (b0 * (1 - b.e1) + b1 * b.e1) + 0.05, 0.9 * b1 * b.e1 / (b0 * (1 - b.e1) + b1 * b.e1) + 0.05 FROM b JOIN o ON o.sample = b.sample AND o.k = b.k - 1),
q AS (SELECT o, p * b1 / (p * b1 + (1 - p) * b0) AS p FROM f JOIN b ON f.sample = b.sample AND f.k = b.k)
SELECT round(sum(CASE WHEN o = 1 THEN p ELSE 1 - p END), 6) AS match, round(sum(CASE WHEN o = 1 THEN 1 - p ELSE p END), 6) AS mismatch FROM q""",
    "hets",
)
def em_matches(spark, d):
    h = fx.hets(spark, d)
    return r6(posteriors.expected_matches(h.join(hmm.two_state(h).toDF("s", "q", "scale", "forward", "posterior"), (F.col("s") == F.col("sample")) & (F.col("q") == F.col("pos")))), "match", "mismatch")


@query("SELECT site, sample, coalesce(maf, 0.5) AS maf FROM pairs LEFT JOIN (SELECT m, round(least(avg(allele), 1 - avg(allele)), 6) AS maf FROM panel GROUP BY m HAVING avg(allele) > 0 AND avg(allele) < 1) f ON site = m", "pairs", "panel")
def maf_lookup(spark, d):
    f = frequency.allele_counts(fx.panel(spark, d), ["m"]).where("maf > 0").select("m", F.round("maf", 6).alias("maf"))
    p = fx.pairs(spark, d)
    return p.join(many(f), p.site == f.m, "left").select("site", "sample", F.coalesce("maf", F.lit(0.5)).alias("maf"))


@query("SELECT chrom, pos, m FROM markers WHERE lower(chrom) IN ('chr2', '2') AND pos BETWEEN 100001 AND 900001", "markers")
def region_sites(spark, d):
    return vcf.region(fx.markers(spark, d), "2", 100_001, 900_001).select("chrom", "pos", "m")


_HITS = f""", f AS (SELECT chrom, pos, least(avg(allele), 1 - avg(allele)) AS maf FROM panel GROUP BY ALL),
h AS (SELECT chrom, pos, {_BIN.format(m="maf")} AS maf_bin FROM f WHERE ('0x' || substr(md5(chrom || ':' || pos), 1, 8))::BIGINT < {int(0.3 * (1 << 32))}),
o AS (SELECT *, row_number() OVER (PARTITION BY chrom, maf_bin ORDER BY pos) AS k FROM h),
w AS (SELECT chrom, maf_bin, k, pos, pos AS last, true AS keep FROM o WHERE k = 1 UNION ALL
  SELECT o.chrom, o.maf_bin, o.k, o.pos, CASE WHEN o.pos - last >= 50000 THEN o.pos ELSE last END, o.pos - last >= 50000 FROM w JOIN o ON o.chrom = w.chrom AND o.maf_bin = w.maf_bin AND o.k = w.k + 1)
SELECT chrom, pos, maf_bin FROM w WHERE keep"""


@query(_HITS, "panel")
def masked_sites(spark, d):
    c = frequency.allele_counts(fx.panel(spark, d), ["chrom", "pos"]).withColumn("maf_bin", quality.maf_bin(F.col("maf")))
    return metrics.spaced_picks(c, 0.3)


@query("SELECT m, sample, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'missing' WHEN a1 = a2 THEN 'homozygous' WHEN sample % 2 = 0 THEN 'phased' ELSE 'unphased' END AS status FROM calls", "calls")
def call_status(spark, d):
    return fx.calls(spark, d).select("m", "sample", posteriors.call_status(F.col("a1"), F.col("a2"), F.col("sample") % 2 == 0).alias("status"))


@query("SELECT m, sample FROM calls WHERE a1 IS NOT NULL OR a2 IS NOT NULL", "calls")
def typed_calls(spark, d):
    return posteriors.typed_calls(fx.calls(spark, d)).select("m", "sample")


@query("SELECT m, sample // 4 AS batch FROM calls GROUP BY ALL HAVING count(a1) + count(a2) > 0", "calls")
def sortable_sites(spark, d):
    haps = fx.calls(spark, d).select("m", "sample", F.explode(F.array("a1", "a2")).alias("allele"))
    return posteriors.sortable_sites(haps, ["m"], F.expr("sample div 4"))


@query("SELECT l_orderkey, l_linenumber, round((1600 - l_suppkey) * (1 - exp(-l_discount)) / 1600 * l_tax * l_quantity / 50, 6) AS mass, coalesce(l_discount >= 0.05 AND (l_linenumber % 2 = 0 OR l_linenumber % 2 = l_suppkey % 2), false) AS informative FROM lineitem")
def unlisted_mass(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    mass = posteriors.unlisted_mass(1600, F.col("l_suppkey"), (1 - F.exp(-F.col("l_discount"))) / 1600, F.col("l_tax"), F.col("l_quantity") / 50)
    known = posteriors.informative(F.col("l_discount"), F.lit(0), F.col("l_suppkey") % 2, F.col("l_linenumber") % 2)
    return r6(t.select("l_orderkey", "l_linenumber", mass.alias("mass"), known.alias("informative")), "mass")


@query(
    """, o AS (SELECT sample, pos, CASE o WHEN 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS e1, row_number() OVER (PARTITION BY sample ORDER BY pos) AS k FROM hets),
f AS (SELECT sample, k, e1 AS p, 0.5::DOUBLE AS c FROM o WHERE k = 1 UNION ALL
  SELECT o.sample, o.k, e1 * (0.9 * p + 0.05) / (e1 * (0.9 * p + 0.05) + (1 - e1) * (0.9 * (1 - p) + 0.05)), e1 * (0.9 * p + 0.05) + (1 - e1) * (0.9 * (1 - p) + 0.05) FROM f JOIN o ON o.sample = f.sample AND o.k = f.k + 1)
SELECT sample, round(sum(ln(c)), 6) AS loglik FROM f GROUP BY sample""",
    "hets",
)
def log_likelihood(spark, d):
    return r6(posteriors.log_likelihood(hmm.two_state(fx.hets(spark, d)), ["sample"]), "loglik")
