"""Queries over the derived relations, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import genotype as gt
from ..functions import model
from ..operators import alignment, frequency, interpolation, metrics, phase_blocks, quality, segmentation
from ..operators.joins import many

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *relations: str):
    """Registers a query under its function's name; relations are defined before the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (fx.duckdb(*relations) if relations else "") + sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Columns rounded to six decimals, so that the order of sums can't show."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


_BIN = "CASE " + " ".join(f"WHEN {{m}} < {b} THEN '{n}'" for b, n in quality.MAF_BINS) + f" ELSE '{quality.LAST_BIN}' END"


@query(
    f"""SELECT m, n, round(af, 6) AS af, round(CASE WHEN s = 0 OR abs(s - n) <= 1e-8 THEN 1.0 ELSE least(1.0, greatest(0.0, (ss - s * s / n) / (s - s * s / n))) END, 6) AS dr2,
  round(least(af, 1 - af), 6) AS maf, {_BIN.format(m="least(af, 1 - af)")} AS maf_bin
  FROM (SELECT m, count(*) AS n, sum(p) AS s, sum(p * p) AS ss, sum(p) / count(*) AS af FROM site_probs GROUP BY m)""",
    "site_probs",
)
def site_quality(spark, d):
    return r6(quality.site_quality(fx.site_probs(spark, d), ["m"]), "af", "dr2", "maf")


@query(
    """SELECT m, count(*) AS n, count(allele) AS present, count(*) FILTER (allele > 0) AS alt,
  round(least(count(*) FILTER (allele > 0) / count(*), 1 - count(*) FILTER (allele > 0) / count(*)), 6) AS maf,
  round(CASE WHEN count(allele) > 0 THEN least(count(*) FILTER (allele > 0) / count(allele), 1 - count(*) FILTER (allele > 0) / count(allele)) END, 6) AS maf_present
  FROM (SELECT m, a1 AS allele FROM calls UNION ALL SELECT m, a2 FROM calls) GROUP BY m""",
    "calls",
)
def allele_counts(spark, d):
    c = fx.calls(spark, d)
    haps = c.select("m", F.explode(F.array("a1", "a2")).alias("allele"))
    return r6(frequency.allele_counts(haps, ["m"]), "maf", "maf_present")


@query("SELECT m, CASE WHEN maf >= 0.05 THEN 'high' WHEN maf > 0 THEN 'rare' ELSE 'monomorphic' END AS class FROM (SELECT m, least(avg(allele), 1 - avg(allele)) AS maf FROM panel GROUP BY m)", "panel")
def frequency_split(spark, d):
    c = frequency.allele_counts(fx.panel(spark, d), ["m"])
    return c.select("m", frequency.frequency_class(F.col("maf"), 0.05).alias("class"))


@query("SELECT m, CASE WHEN least(avg(allele), 1 - avg(allele)) < 0.01 AND count(allele) = count(*) THEN 'sparse' ELSE 'dense' END AS encoding FROM panel GROUP BY m", "panel")
def storage_choice(spark, d):
    return frequency.storage_choice(frequency.allele_counts(fx.panel(spark, d), ["m"])).select("m", "encoding")


@query("SELECT m, 2 * sum(allele) > count(*) AS inverted, array_to_string(list_sort(list(hap) FILTER (allele = CASE WHEN inv THEN 0 ELSE 1 END)), ',') AS carriers FROM (SELECT *, 2 * sum(allele) OVER (PARTITION BY m) > count(*) OVER (PARTITION BY m) AS inv FROM panel) GROUP BY m", "panel")
def sparse_carriers(spark, d):
    c = frequency.sparse_carriers(fx.panel(spark, d), ["m"])
    return c.select("m", "inverted", F.array_join(F.transform("carriers", lambda x: x.cast("string")), ",").alias("carriers")).withColumn("carriers", F.when(F.col("carriers") != "", F.col("carriers")))


@query("SELECT m, round(count(*) FILTER (allele = 0) / count(allele), 6) AS f0, round(count(*) FILTER (allele = 1) / count(allele), 6) AS f1 FROM panel GROUP BY m", "panel")
def base_frequencies(spark, d):
    return r6(frequency.base_frequencies(fx.panel(spark, d), ["m"]), "f0", "f1")


@query(
    """SELECT block, sum(n)::BIGINT AS haps, count(*) AS patterns, count(*) / sum(n) AS ratio, count(*) / sum(n) < 0.5 AS dictionary
  FROM (SELECT block, pattern, count(*) AS n FROM (SELECT m // 64 AS block, hap, string_agg(allele::VARCHAR, '' ORDER BY m) AS pattern FROM panel GROUP BY ALL) GROUP BY ALL) GROUP BY block""",
    "panel",
)
def hap_patterns(spark, d):
    return frequency.pattern_dictionary(frequency.block_patterns(fx.panel(spark, d), F.expr("m div 64")))


@query("SELECT block, dense_rank() OVER (PARTITION BY block ORDER BY pattern) - 1 AS code, hap FROM (SELECT m // 32 AS block, hap, string_agg(allele::VARCHAR, '' ORDER BY m) AS pattern FROM panel GROUP BY ALL)", "panel")
def sequence_codes(spark, d):
    p = frequency.block_patterns(fx.panel(spark, d), F.expr("m div 32"))
    return p.selectExpr("block", "cast(dense_rank() over (partition by block order by pattern) - 1 as bigint) as code", "hap")


@query(
    """, p AS (SELECT m // 64 AS block, hap, string_agg(allele::VARCHAR, '' ORDER BY m) AS pattern FROM panel GROUP BY ALL)
  SELECT block, pattern, sum((hap % 7) / 8.0) AS sa, sum((hap % 5) / 8.0) AS sb, sum((hap % 7) * (hap % 5) / 64.0) AS sab, count(*) AS n FROM p GROUP BY ALL""",
    "panel",
)
def pattern_mass(spark, d):
    p = frequency.block_patterns(fx.panel(spark, d), F.expr("m div 64"))
    w = p.select("block", "hap", F.expr("hap % 7 / 8D").alias("a"), F.expr("hap % 5 / 8D").alias("b"))
    return frequency.pattern_mass(p, w)


def _aligned(spark, d):
    ref = fx.markers(spark, d).select("chrom", "pos", F.col("m").alias("idx"), F.array("ref", "alt").alias("alleles"))
    targ = fx.target_markers(spark, d).select("chrom", "pos", F.col("m").alias("idx"), F.array("ref", "alt").alias("alleles"))
    return ref, targ, alignment.align(targ, ref)


_ALIGN = """, al AS (SELECT r.chrom, r.pos, r.m, d0, d1, c0, c1, NOT (d0 >= 0 AND d1 >= 0) AS flipped FROM (
  SELECT r.chrom, r.pos, r.m, CASE t.ref WHEN r.ref THEN 0 WHEN r.alt THEN 1 ELSE -1 END AS d0, CASE t.alt WHEN r.ref THEN 0 WHEN r.alt THEN 1 ELSE -1 END AS d1,
    CASE translate(t.ref, 'ACGT', 'TGCA') WHEN r.ref THEN 0 WHEN r.alt THEN 1 ELSE -1 END AS c0, CASE translate(t.alt, 'ACGT', 'TGCA') WHEN r.ref THEN 0 WHEN r.alt THEN 1 ELSE -1 END AS c1
  FROM markers r JOIN target_markers t ON r.pos = t.pos AND lower(r.chrom) = lower(t.chrom)) r WHERE (d0 >= 0 AND d1 >= 0) OR (c0 >= 0 AND c1 >= 0)) """


@query(_ALIGN + "SELECT chrom, pos, m AS ref_idx, m AS target_idx, concat(CASE WHEN flipped THEN c0 ELSE d0 END, ',', CASE WHEN flipped THEN c1 ELSE d1 END) AS targ_to_ref, concat(CASE WHEN flipped THEN c0 ELSE d0 END, ',', CASE WHEN flipped THEN c1 ELSE d1 END) AS ref_to_targ, flipped, CASE WHEN flipped THEN c0 ELSE d0 END <> 0 AS swapped FROM al", "markers", "target_markers")
def allele_alignment(spark, d):
    a = _aligned(spark, d)[2]
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return a.select("chrom", "pos", "ref_idx", "target_idx", text("targ_to_ref"), text("ref_to_targ"), "flipped", "swapped")


@query(_ALIGN + "SELECT m AS idx, m IN (SELECT m FROM al) AS typed FROM markers", "markers", "target_markers")
def typed_sites(spark, d):
    ref, _, a = _aligned(spark, d)
    return alignment.typed(ref, a).select("idx", F.lit(True).alias("typed")).unionByName(alignment.untyped(ref, a).select("idx", F.lit(False).alias("typed")))


@query(_ALIGN + "SELECT p.m, p.hap, CASE WHEN al.m IS NULL THEN NULL ELSE CASE WHEN (CASE WHEN flipped THEN c0 ELSE d0 END) = p.allele THEN 0 ELSE 1 END END AS allele FROM panel p JOIN al ON p.m = al.m", "markers", "target_markers", "panel")
def reversed_alleles(spark, d):
    a = _aligned(spark, d)[2]
    p = fx.panel(spark, d)
    return p.join(many(a), p.m == a.ref_idx).select("m", "hap", alignment.map_allele(F.col("ref_to_targ"), F.col("allele").cast("int")).alias("allele"))


@query(_ALIGN + "SELECT m, hap, allele::BIGINT AS allele FROM target WHERE m IN (SELECT m FROM target_markers) UNION ALL SELECT p.m, p.hap + 20, CASE WHEN (CASE WHEN flipped THEN c0 ELSE d0 END) = p.allele THEN 0 ELSE 1 END FROM panel p JOIN al ON p.m = al.m", "markers", "target_markers", "target", "panel")
def composite_haplotypes(spark, d):
    a = _aligned(spark, d)[2]
    t = fx.target(spark, d).join(many(fx.target_markers(spark, d).select("m")), "m", "left_semi")
    return alignment.composite(t, fx.panel(spark, d), a, fx.TARGET)


@query("SELECT m, regexp_replace(chrom, '^(chr|CHR)', '') AS chrom, length(ref) = 1 AND length(alt) = 1 AND ref IN ('A', 'C', 'G', 'T') AS snv, translate(ref, 'ACGT', 'TGCA') = alt AS ambiguous FROM target_markers", "target_markers")
def site_predicates(spark, d):
    t = fx.target_markers(spark, d)
    alts = F.array("alt")
    return t.select("m", gt.normal_chrom(F.col("chrom")).alias("chrom"), gt.is_snv(F.col("ref"), alts).alias("snv"), gt.is_strand_ambiguous(F.col("ref"), alts).alias("ambiguous"))


_LINES = """, l AS (SELECT chrom, pos AS p1, cm AS c1, lead(pos) OVER w AS p2, lead(cm) OVER w AS c2, lag(pos) OVER w IS NULL AS f, lead(pos, 2) OVER w IS NULL AS z FROM gmap WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
gp AS (SELECT k.m, k.chrom, k.pos, k.size, coalesce(c1 + (k.pos - p1) * ((c2 - c1) / (p2 - p1)), k.pos * 1e-6) AS gen_pos FROM markers k LEFT JOIN l ON k.chrom = l.chrom AND p2 IS NOT NULL AND (f OR k.pos >= p1) AND (z OR k.pos < p2)) """


def _positions(spark, d):
    return interpolation.genetic_positions(fx.markers(spark, d), fx.gmap(spark, d), 100_000)


@query(_LINES + "SELECT m, round(gen_pos, 6) AS gen_pos FROM gp", "markers", "gmap")
def genetic_positions(spark, d):
    return r6(_positions(spark, d).select("m", "gen_pos"), "gen_pos")


@query(
    _LINES + """, e AS (SELECT chrom, greatest(1e-8, CASE WHEN max(pos) > min(pos) THEN (max(gen_pos) - min(gen_pos)) / (max(pos) - min(pos)) END) AS rate FROM gp GROUP BY chrom),
s AS (SELECT m, gp.chrom, pos, first_value(gen_pos) OVER w AS g0, coalesce(greatest(gen_pos - lag(gen_pos) OVER w, rate * (pos - lag(pos) OVER w)), 0) AS step FROM gp JOIN e ON gp.chrom = e.chrom WINDOW w AS (PARTITION BY gp.chrom ORDER BY pos)),
g AS (SELECT *, g0 + sum(step) OVER (PARTITION BY chrom ORDER BY pos) AS gen_min FROM s)
SELECT m, round(gen_min, 6) AS gen_min, round(coalesce(1 - exp(-0.04 * 100000 / 40 * (gen_min - lag(gen_min) OVER (PARTITION BY chrom ORDER BY pos))), 0), 6) AS p_recomb FROM g""",
    "markers", "gmap",
)
def switch_probabilities(spark, d):
    g = interpolation.with_minimum_step(_positions(spark, d))
    rho = model.recombination_intensity(1e5, fx.PANEL)
    return r6(interpolation.with_switch_probability(g, rho, "gen_min").select("m", "gen_min", "p_recomb"), "gen_min", "p_recomb")


@query("SELECT m, greatest(0, coalesce(sum(CASE WHEN size <= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1)::BIGINT AS prev_idx, greatest(0, sum(CASE WHEN size <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos) - 1)::BIGINT AS cluster FROM markers", "markers")
def asof_markers(spark, d):
    m = interpolation.previous_of_class(fx.markers(spark, d), F.col("size") <= 25)
    return interpolation.cluster_of(m, F.col("size") <= 5).select("m", F.col("prev_idx").cast("bigint"), F.col("cluster").cast("bigint"))


def _greedy(limit: str, cols: str, first: str, nxt: str) -> str:
    return f""", o AS (SELECT chrom, pos, gen_pos AS g, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM gp),
walk AS (SELECT chrom, pos, k, g AS s, {first} FROM o WHERE k = 1 UNION ALL
  SELECT o.chrom, o.pos, o.k, CASE WHEN o.g - s {limit} THEN o.g ELSE s END, {nxt} FROM walk JOIN o ON o.chrom = walk.chrom AND o.k = walk.k + 1)
SELECT {cols} FROM walk"""


@query(_LINES + _greedy("> 0.02", "chrom, pos, c AS cluster", "CAST(0 AS BIGINT) AS c", "CASE WHEN o.g - s > 0.02 THEN c + 1 ELSE c END"), "markers", "gmap")
def marker_clusters(spark, d):
    return segmentation.clusters(_positions(spark, d), 0.02)


@query(_LINES + _greedy(">= 0.05", "chrom, pos, t OR k = max(k) OVER (PARTITION BY chrom) AS sampled", "true AS t", "o.g - s >= 0.05"), "markers", "gmap")
def sampling_points(spark, d):
    return segmentation.sampling_points(_positions(spark, d), 0.05)


@query(_LINES + _greedy(">= 0.02", "chrom, pos, t AS used, CASE WHEN t THEN (sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY k) - 1) // 50 END::BIGINT AS step", "true AS t", "o.g - s >= 0.02"), "markers", "gmap")
def sharing_steps(spark, d):
    return segmentation.spaced_steps(_positions(spark, d), 0.02, 50)


@query(
    _LINES + """, o AS (SELECT chrom, pos, gen_pos AS g, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY chrom) AS n FROM gp),
z AS (SELECT a.chrom, a.k, a.pos, a.n, least((SELECT count(*) FROM o b WHERE b.chrom = a.chrom AND b.g <= a.g + CAST(0.4 AS DOUBLE) + CAST(0.05 AS DOUBLE)), a.k + 1000000) AS held, (SELECT count(*) FROM o b WHERE b.chrom = a.chrom AND b.g < a.g + CAST(0.4 AS DOUBLE)) AS e FROM o a),
n AS (SELECT *, greatest(CASE WHEN held = n THEN held ELSE least(held, e) END, k + 1) AS nxt FROM z),
w AS (SELECT chrom, CAST(0 AS BIGINT) AS window_id, k, nxt, held, n FROM n WHERE k = 0 UNION ALL SELECT n.chrom, window_id + 1, n.k, n.nxt, n.held, n.n FROM w JOIN n ON n.chrom = w.chrom AND n.k = w.nxt)
SELECT w.chrom, window_id, a.pos AS first, b.pos AS last, a.pos AS out_first, c.pos AS out_last, w.nxt = w.n AS is_last
FROM w JOIN o a ON a.chrom = w.chrom AND a.k = w.k JOIN o b ON b.chrom = w.chrom AND b.k = w.held - 1 JOIN o c ON c.chrom = w.chrom AND c.k = w.nxt - 1""",
    "markers", "gmap",
)
def genetic_windows(spark, d):
    return segmentation.windows(_positions(spark, d), 0.4, 0.05, 1_000_000)


_S = "count(*) AS n, sum(t)::DOUBLE AS s_t, sum(i) AS s_i, sum(t * i) AS s_ti, sum(t * t)::DOUBLE AS s_tt, sum(i * i) AS s_ii, count(*) FILTER (t = c) AS same, count(*) FILTER (t > 0) AS nonref, count(*) FILTER (t > 0 AND t = c) AS nonref_same, count(*) FILTER (t > 0 AND c > 0) AS tp, count(*) FILTER (t = 0 AND c > 0) AS fp, count(*) FILTER (t > 0 AND c = 0) AS fn, sum(1 - (t - i) * (t - i) / 4) AS s_sen"
_Z = "CASE WHEN {b} <> 0 THEN {a} / {b} END"
_RATIOS = f"""n, {_Z.format(a="same", b="n")} AS concordance, round({_Z.format(a="nonref_same", b="nonref")}, 6) AS nonref_concordance,
  round(CASE WHEN n * s_tt - s_t * s_t > 0 AND n * s_ii - s_i * s_i > 0 THEN (n * s_ti - s_t * s_i) * (n * s_ti - s_t * s_i) / ((n * s_tt - s_t * s_t) * (n * s_ii - s_i * s_i)) END, 6) AS r_squared,
  round(CASE WHEN n * s_tt - s_t * s_t > 0 THEN (n * s_ii - s_i * s_i) / (n * s_tt - s_t * s_t) END, 6) AS info, round({_Z.format(a="tp", b="(tp + fp)")}, 6) AS precision, round({_Z.format(a="tp", b="(tp + fn)")}, 6) AS recall,
  round({_Z.format(a="2 * tp", b="(2 * tp + fp + fn)")}, 6) AS f1, round(s_sen / n, 6) AS sen"""
_R = ("nonref_concordance", "r_squared", "info", "precision", "recall", "f1", "sen")


@query(f"SELECT {_RATIOS} FROM (SELECT {_S} FROM pairs)", "pairs")
def accuracy_overall(spark, d):
    return r6(metrics.accuracy(fx.pairs(spark, d)), *_R)


@query(f"SELECT site, {_RATIOS.replace(', 6)', ', 9)')} FROM (SELECT site, {_S} FROM pairs GROUP BY site)", "pairs")
def accuracy_by_site(spark, d):
    a = metrics.accuracy(fx.pairs(spark, d), "site")
    return a.withColumns({c: F.round(c, 9) for c in _R})


_SITES = f""", q AS (SELECT site, count(*) AS n, sum(t) / (2 * count(*)) AS p, count(*) FILTER (t = c) / count(*) AS same FROM pairs GROUP BY site),
e AS (SELECT site, p, same, least(p, 1 - p) AS maf, ((1 - p) * (1 - p)) * ((1 - p) * (1 - p)) + (2 * p * (1 - p)) * (2 * p * (1 - p)) + (p * p) * (p * p) AS x FROM q),
sites AS (SELECT site, maf, CASE WHEN p > 0 AND p < 1 AND x < 1 THEN (same - x) / (1 - x) END AS iqs, {_BIN.format(m="maf")} AS maf_bin FROM e) """


@query(_SITES + "SELECT site, round(maf, 6) AS maf, round(iqs, 6) AS iqs, maf_bin FROM sites", "pairs")
def site_iqs(spark, d):
    return r6(metrics.site_iqs(fx.pairs(spark, d)), "maf", "iqs")


@query(_SITES + "SELECT maf_bin, count(*) AS sites, round(avg(iqs), 6) AS mean_iqs, round(list_sort(list(iqs))[count(*) // 2 + 1], 6) AS median_iqs FROM sites WHERE iqs IS NOT NULL GROUP BY maf_bin", "pairs")
def iqs_summary(spark, d):
    return r6(metrics.iqs_summary(metrics.site_iqs(fx.pairs(spark, d))), "mean_iqs", "median_iqs")


@query(_SITES + f", k AS (SELECT 'chr' || (site % 22 + 1) AS chrom, maf_bin, t, i, c FROM pairs JOIN sites USING (site)) SELECT CASE WHEN grouping(chrom) = 1 AND grouping(maf_bin) = 1 THEN 'all' WHEN grouping(maf_bin) = 1 THEN 'chrom' ELSE 'maf_bin' END AS level, chrom, maf_bin, {_RATIOS} FROM (SELECT chrom, maf_bin, {_S} FROM k GROUP BY GROUPING SETS ((chrom), (maf_bin), ()))".replace("CASE WHEN grouping(chrom) = 1 AND grouping(maf_bin) = 1 THEN 'all' WHEN grouping(maf_bin) = 1 THEN 'chrom' ELSE 'maf_bin' END", "CASE WHEN chrom IS NULL AND maf_bin IS NULL THEN 'all' WHEN maf_bin IS NULL THEN 'chrom' ELSE 'maf_bin' END"), "pairs")
def accuracy_rollup(spark, d):
    p = fx.pairs(spark, d)
    bins = metrics.site_iqs(p).select("site", "maf_bin")
    rows = p.join(bins, "site").withColumn("chrom", F.concat(F.lit("chr"), (F.col("site") % 22 + 1).cast("string")))
    return r6(metrics.accuracy_rollup(rows, "chrom", "maf_bin"), *_R)


@query("SELECT t, c, count(*) AS n FROM pairs GROUP BY t, c", "pairs")
def confusion_matrix(spark, d):
    return metrics.confusion(fx.pairs(spark, d))


@query("SELECT t, count(*) AS n, round(count(*) FILTER (t = c) / count(*), 6) AS accuracy FROM pairs GROUP BY t", "pairs")
def class_accuracy(spark, d):
    return r6(metrics.class_accuracy(fx.pairs(spark, d)), "accuracy")


_GP = "[greatest(0.0, 1 - i), 1 - abs(1 - i), greatest(0.0, i - 1)]"


@query(f"SELECT round(avg(1 - sqrt(greatest(0, 1 - sqrt({_GP}[t + 1])))), 6) AS hellinger, round(avg(1 - (t - i) * (t - i) / 4), 6) AS sen, median(1 - (t - i) * (t - i) / 4) AS median_sen FROM pairs", "pairs")
def hellinger_and_sen(spark, d):
    p = fx.pairs(spark, d)
    h = metrics.hellinger(F.col("t"), metrics.dosage_probabilities(F.col("i")))
    return p.agg(F.round(F.avg(h), 6).alias("hellinger"), F.round(F.avg(metrics.sen()), 6).alias("sen"), F.median(metrics.sen()).alias("median_sen"))


@query(
    f""", r AS (SELECT list_max({_GP}) AS conf, CASE WHEN t = c THEN 1 ELSE 0 END AS ok, ({_GP}[1] - CASE WHEN t = 0 THEN 1 ELSE 0 END) ** 2 + ({_GP}[2] - CASE WHEN t = 1 THEN 1 ELSE 0 END) ** 2 + ({_GP}[3] - CASE WHEN t = 2 THEN 1 ELSE 0 END) ** 2 AS brier FROM pairs),
b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, sum(conf) AS conf, sum(ok) AS ok, sum(brier) AS brier FROM r GROUP BY bin)
SELECT sum(n)::BIGINT AS n, round(sum(brier) / sum(n), 6) AS brier, round(sum(abs(ok - conf)) / sum(n), 6) AS ece FROM b""",
    "pairs",
)
def calibration(spark, d):
    return r6(metrics.calibration(fx.pairs(spark, d)), "brier", "ece")


@query(f", s AS (SELECT sample, {_S} FROM pairs GROUP BY sample), v AS (SELECT sample, {_RATIOS} FROM s) SELECT sample, n, round(concordance, 6) AS concordance, r_squared, sen FROM v", "pairs")
def per_sample(spark, d):
    return r6(metrics.per_sample(fx.pairs(spark, d)), "concordance", "r_squared", "sen")


@query(f", s AS (SELECT sample, {_S} FROM pairs GROUP BY sample), v AS (SELECT sample, same / n AS concordance, (n * s_ti - s_t * s_i) ** 2 / ((n * s_tt - s_t * s_t) * (n * s_ii - s_i * s_i)) AS r_squared, s_sen / n AS sen FROM s) SELECT count(*) AS samples, " + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("concordance", "r_squared", "sen") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM v", "pairs")
def sample_spread(spark, d):
    s = metrics.sample_spread(metrics.per_sample(fx.pairs(spark, d)))
    return r6(s, *[c for c in s.columns if c != "samples"])


@query("SELECT l_returnflag || l_linestatus AS tool, round(r2, 6) AS r_squared, row_number() OVER (ORDER BY r2 DESC, l_returnflag || l_linestatus) AS place FROM (SELECT l_returnflag, l_linestatus, corr(l_linenumber % 3, l_discount) ** 2 AS r2 FROM lineitem GROUP BY ALL)")
def ranked_tools(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("tool"), (F.col("l_linenumber") % 3).alias("t"), F.col("l_discount").alias("i"))
    tools = rows.groupBy("tool").agg((F.corr("t", "i") ** 2).alias("r_squared"))
    return r6(metrics.ranked(tools), "r_squared").withColumn("place", F.col("place").cast("bigint"))


@query("SELECT coalesce(lower(t.chrom), m.chrom) AS chrom, coalesce(t.pos, m.pos) AS pos, CASE WHEN t.pos IS NULL THEN 'missing' WHEN t.ref <> m.ref OR t.alt <> m.alt THEN 'mismatch' ELSE 'compared' END AS state FROM markers m FULL JOIN target_markers t ON m.pos = t.pos AND m.chrom = lower(t.chrom)", "markers", "target_markers")
def site_comparison(spark, d):
    f = lambda x: x.select(F.lower("chrom").alias("chrom"), "pos", "ref", F.array("alt").alias("alts"))
    return metrics.compare_sites(f(fx.markers(spark, d)), f(fx.target_markers(spark, d)))


_SW = ", s AS (SELECT *, o <> lag(o) OVER (PARTITION BY sample ORDER BY pos) AS sw FROM hets) "
_BL = ", b AS (SELECT *, sum(CASE WHEN sw THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY pos)::BIGINT AS block FROM s), g AS (SELECT sample, block, min(pos) AS first, max(pos) AS last0 FROM b GROUP BY ALL), bl AS (SELECT sample, block, first, coalesce(lead(first) OVER (PARTITION BY sample ORDER BY block), last0) AS last FROM g) "


@query(_SW + "SELECT sample, count(*) FILTER (sw) AS switches, count(sw) AS chances, round(CASE WHEN count(sw) > 0 THEN count(*) FILTER (sw) / count(sw) END, 6) AS rate FROM s GROUP BY sample", "hets")
def switch_errors(spark, d):
    return r6(phase_blocks.switch_rate(fx.hets(spark, d)), "rate")


@query(_SW + _BL + "SELECT sample, block, first, last, last - first AS length FROM bl", "hets")
def phase_block_list(spark, d):
    return phase_blocks.blocks(fx.hets(spark, d))


@query(_SW + _BL + "SELECT max(l) AS n50 FROM (SELECT l, sum(s) OVER (ORDER BY l DESC) AS upto, sum(s) OVER () AS total FROM (SELECT last - first AS l, sum(last - first) AS s FROM bl GROUP BY 1)) WHERE upto * 2 >= total", "hets")
def phase_block_n50(spark, d):
    return phase_blocks.n50(phase_blocks.blocks(fx.hets(spark, d)))


@query("SELECT event_id AS pos, coalesce(last_value(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS filled FROM events")
def swap_fill(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").alias("pos"), "event_type")
    v = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 0)
    return phase_blocks.forward_fill(e, v, ["user_id"]).select("pos", "filled")


@query("SELECT sample, pos, round((1 - w) * o + w * (1 - o) / 2.0, 6) AS v FROM (SELECT *, (row_number() OVER (PARTITION BY sample ORDER BY pos) - 1) / count(*) OVER (PARTITION BY sample) AS w FROM hets)", "hets")
def overlap_blend(spark, d):
    h = fx.hets(spark, d)
    out = phase_blocks.blend(h.select("sample", "pos", F.col("o").cast("double").alias("v")), h.select("sample", "pos", ((1 - F.col("o")) / 2).alias("v")), ["sample"])
    return r6(out, "v")


@query("SELECT sample, count(*) FILTER (a1 = b1 AND a2 = b2) AS agree, count(*) FILTER (a1 = b2 AND a2 = b1) AS differ, count(*) FILTER (a1 = b2 AND a2 = b1) > count(*) FILTER (a1 = b1 AND a2 = b2) AS flip FROM (SELECT sample, a1, a2, CASE WHEN m % 3 = 0 THEN a1 ELSE a2 END AS b1, CASE WHEN m % 3 = 0 THEN a2 ELSE a1 END AS b2 FROM calls) WHERE a1 <> a2 GROUP BY sample", "calls")
def overlap_vote(spark, d):
    c = fx.calls(spark, d)
    other = c.select("chrom", "pos", "sample", F.expr("if(m % 3 = 0, a1, a2)").alias("a1"), F.expr("if(m % 3 = 0, a2, a1)").alias("a2"))
    return phase_blocks.overlap_vote(c, other)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 0 ELSE length(bin(l_linenumber - 1)) END AS bits, CASE WHEN a > b THEN a * (a + 1) // 2 + b ELSE b * (b + 1) // 2 + a END AS idx FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS a, l_suppkey % 3 AS b FROM lineitem)")
def genotype_codes(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", model.bits_per_allele(F.col("l_linenumber")).alias("bits"), gt.genotype_index((F.col("l_linenumber") % 3).cast("int"), (F.col("l_suppkey") % 3).cast("int")).alias("idx"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(p1 + p2, 6) AS DOUBLE) AS ds, concat(CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END, '|', CASE WHEN p2 >= 0.5 THEN 1 ELSE 0 END) AS gt, round((1 - p1) * (1 - p2), 6) AS gp0, round(p1 * (1 - p2) + (1 - p1) * p2, 6) AS gp1, round(p1 * p2, 6) AS gp2 FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 1) / 49 AS p1, l_discount * 5 AS p2 FROM lineitem)")
def imputed_fields(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 1) / 49).alias("p1"), (F.col("l_discount") * 5).alias("p2"))
    gp = gt.genotype_probabilities(F.array(1 - F.col("p1"), "p1"), F.array(1 - F.col("p2"), "p2"))
    a, b = gt.hard_call(F.col("p1"), F.col("p2"))
    out = t.select("l_orderkey", "l_linenumber", (F.col("p1") + F.col("p2")).alias("ds"), F.concat_ws("|", a.cast("string"), b.cast("string")).alias("gt"), *[F.get(gp, F.lit(k)).alias(f"gp{k}") for k in range(3)])
    return r6(out, "ds", "gp0", "gp1", "gp2")
