"""Queries of haplotype picks, of files read back, and of scalar parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import genotype as gt
from ..functions import model
from ..operators import pbwt
from ..operators.joins import many
from ..sources import bref3, text, vcf, writers
from . import impute as im
from . import stages
from .catalog import query, r6
from .catalog_model import _vcf_lines
from .catalog_sharing import _PREFIX

#: Of each pair of haplotypes in a window where their current match began (s, local to the window), and both ranks.
_PAIRS = """, w AS (SELECT *, m // 25 AS win FROM panel), p AS (SELECT a.win, a.m, a.hap, string_agg(b.allele::VARCHAR, '' ORDER BY b.m DESC) AS prefix FROM w a JOIN w b ON a.win = b.win AND a.hap = b.hap AND b.m <= a.m GROUP BY ALL),
r AS (SELECT win, m, hap, row_number() OVER (PARTITION BY win, m ORDER BY prefix, hap) AS k FROM p),
x AS (SELECT a.win, a.m, a.hap, b.hap AS other, coalesce(max(CASE WHEN a.allele <> b.allele THEN a.m + 1 END) OVER (PARTITION BY a.win, a.hap, b.hap ORDER BY a.m), a.win * 25) - a.win * 25 AS s,
  coalesce(min(CASE WHEN a.allele <> b.allele THEN a.m END) OVER (PARTITION BY a.win, a.hap, b.hap ORDER BY a.m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(a.m) OVER (PARTITION BY a.win, a.hap, b.hap) + 1) - a.win * 25 AS e
  FROM w a JOIN w b ON a.win = b.win AND a.m = b.m AND a.hap // 2 <> b.hap // 2),
y AS (SELECT x.*, i.k AS ki, j.k AS kj FROM x JOIN r i ON x.win = i.win AND x.m = i.m AND x.hap = i.hap JOIN r j ON x.win = j.win AND x.m = j.m AND x.other = j.hap) """


def _vectors(spark, d):
    return pbwt.vectors(fx.panel(spark, d).withColumn("win", F.expr("m div 25")), ["win"])


@query(_PAIRS + "SELECT win, m, hap, other FROM (SELECT *, row_number() OVER (PARTITION BY win, m, hap ORDER BY s, kj > ki, abs(kj - ki)) AS n FROM y) WHERE n <= 5", "panel")
def nearest_picks(spark, d):
    return pbwt.picks(_vectors(spark, d), ["win"], "nearest", 5)


@query(_PAIRS + ", z AS (SELECT *, abs(kj - ki) AS g FROM y) SELECT win, m, hap, other FROM (SELECT *, row_number() OVER (PARTITION BY win, m, hap ORDER BY coalesce(list_position([1, 2, 3, 5, 8, 13, 21, 34], g), 100 + g), kj > ki) AS n FROM z) WHERE n <= 6", "panel")
def spiral_picks(spark, d):
    return pbwt.picks(_vectors(spark, d), ["win"], "spiral", 6)


@query(_PREFIX + ", r AS (SELECT win, m, hap, substr(prefix, 1, 6) AS near, row_number() OVER (PARTITION BY win, m ORDER BY prefix, hap) AS k FROM p) SELECT a.win, a.m, a.hap, b.hap AS other FROM r a JOIN r b ON a.win = b.win AND a.m = b.m AND a.near = b.near WHERE a.hap // 2 <> b.hap // 2 AND abs(a.k - b.k) <= 32", "panel")
def match_blocks(spark, d):
    return pbwt.picks(_vectors(spark, d), ["win"], "block", 4)


@query(_PAIRS + "SELECT win, m, hap, max(greatest(0, e - s)) AS span FROM x GROUP BY ALL", "panel")
def match_spans(spark, d):
    return pbwt.spans(_vectors(spark, d), ["win"])


@query("SELECT chrom, pos, hap, allele FROM panel", "panel")
def binary_panel_round_trip(spark, d):
    """Writes the panel as binary files of up to bref3.CELLS alleles of a chromosome, and reads the folder."""
    folder = stages.new_folder(spark, "panel")
    sites = fx.panel(spark, d).groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("hap", "allele"))).alias("c")).join(many(fx.markers(spark, d)), ["chrom", "pos"]).select("chrom", "pos", "ref", "alt", F.transform("c", lambda x: x.allele).alias("a"))

    bref3.write(sites.select("chrom", F.col("pos").cast("int").alias("pos"), "ref", F.array("alt").alias("alts"), F.col("a").cast("array<int>").alias("alleles")), [f"r{k}" for k in range(fx.PANEL // 2)], folder)
    return bref3.haplotypes(bref3.read(spark, folder)).select("chrom", F.col("pos").cast("bigint").alias("pos"), F.col("hap").cast("bigint").alias("hap"), "allele")


@query("SELECT chrom, pos::INT AS pos, cm FROM gmap", "markers", "gmap")
def genetic_map_file(spark, d):
    path = stages.new_folder(spark, "map")
    lines = fx.gmap(spark, d).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select(F.concat_ws(" ", "chrom", F.col("pos").cast("string"), F.lit("0.5"), F.col("cm").cast("string")))
    lines.write.text(path)
    return text.genetic_map(spark, path)


@query("SELECT DISTINCT c_mktsegment AS name FROM customer")
def names_file(spark, d):
    path = stages.new_folder(spark, "names")
    c = spark.read.parquet(f"{d}/customer.parquet")
    c.select(F.explode(F.array(F.concat(F.lit("  "), "c_mktsegment"), F.lit(""), F.concat(F.lit("# "), "c_name")))).write.text(path)
    return text.names(spark, path)


@query("SELECT DISTINCT chrom, pos::INT AS pos FROM markers WHERE chrom = 'chr2'", "markers")
def array_site_file(spark, d):
    path = stages.new_folder(spark, "array")
    m = fx.markers(spark, d)
    m.select(F.explode(F.array(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref"), F.lit("CHROM\tPOS\tREF")))).write.text(path)
    return text.array_sites(spark, path, "2")


def _written(spark, d):
    path = stages.new_folder(spark, "vcf")
    writers.write_vcf(_vcf_lines(spark, d), writers.header([f"s{i}" for i in range(fx.TARGET // 2)], [f"chr{k}" for k in range(1, 5)]), path)
    return path


@query("SELECT chrom, pos, 's' || sample AS sample_id, a1, a2 FROM calls WHERE sample NOT IN (1, 4) AND m % 3 <> 0", "calls")
def excluded_calls(spark, d):
    """Calls of a VCF file without some samples and markers, both listed by name."""
    no_samples = spark.createDataFrame([("s1",), ("s4",)], "name string")
    no_markers = many(fx.markers(spark, d).where("m % 3 = 0").select(F.concat(F.lit("rs"), F.col("m").cast("string")).alias("name")))
    return vcf.calls(vcf.lines(spark, _written(spark, d)), no_samples, no_markers).select("chrom", "pos", "sample_id", "a1", "a2")


@query("SELECT chrom, pos, sample, a1, a2 FROM calls", "calls")
def streamed_calls(spark, d):
    """Records of VCF files as they arrive, decoded as in a batch."""
    base = stages.new_folder(spark, "calls")
    rows = vcf.records(vcf.stream_lines(spark, _written(spark, d), 4)).select("chrom", "pos", F.posexplode("fields").alias("sample", "field"), "format")
    out = rows.select("chrom", "pos", F.col("sample").cast("bigint").alias("sample"), gt.decode_gt(vcf.field("GT")).alias("g")).select("chrom", "pos", "sample", "g.a1", "g.a2")
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS dr2, l_returnflag = 'R' AS imp, NULL::VARCHAR AS missing FROM lineitem")
def info_fields(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    info = vcf.info_map(F.concat(F.lit("DR2="), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", ";IMP").otherwise(""), F.lit(";AF=0.5")))
    return t.select("l_orderkey", "l_linenumber", info.alias("i")).select("l_orderkey", "l_linenumber", F.element_at("i", "DR2").alias("dr2"), F.map_contains_key("i", "IMP").alias("imp"), F.try_element_at("i", F.lit("XX")).alias("missing"))


@query("SELECT l_orderkey, l_linenumber, round(ln(c * 0.99 + (1 - c) / 2), 6) AS match, round(ln(c * 0.01 + (1 - c) / 2), 6) AS mismatch FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS c FROM lineitem)")
def emission_weights(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    a, b = model.log_emissions(F.col("l_quantity") / 50, 0.01)
    return r6(t.select("l_orderkey", "l_linenumber", a.alias("match"), b.alias("mismatch")), "match", "mismatch")


@query("SELECT n, round(CASE WHEN n <= 1 THEN 1e-4 ELSE t / (2 * (t + n)) END, 9) AS mismatch, round(0.04 * 1e5 / n, 6) AS intensity FROM (SELECT n, 1 / (ln(n) + 0.5) AS t FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part))")
def model_parameters(spark, d):
    sizes = sorted(r[0] for r in spark.read.parquet(f"{d}/part.parquet").select("p_size").distinct().collect())  # 50 values
    rows = [(int(n), round(model.mismatch_probability(n), 9), round(model.recombination_intensity(1e5, n), 6)) for n in sizes]
    return spark.createDataFrame(rows, "n bigint, mismatch double, intensity double")


@query("SELECT i::BIGINT AS iteration, CASE WHEN i < 6 THEN NULL WHEN i >= 17 THEN 1.0 ELSE round(4.0 * power(2500.0, 1 - (i - 6) / 11.0), 6) END::DOUBLE AS threshold FROM range(18) t(i)")
def phase_thresholds(spark, d):
    rows = [(i, None if i < 6 else round(model.lr_threshold(i, 6, 12), 6)) for i in range(18)]
    return spark.createDataFrame(rows, "iteration bigint, threshold double")


_F = "regexp_replace(printf('%.4f', trunc({x} * 10000) / 10000), '\\.?0+$', '')"
_EIGHTHS = "SELECT l_orderkey, l_linenumber, (l_suppkey % 9) / 8 AS p1, (l_partkey % 9) / 8 AS p2 FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, concat((p1 >= 0.5)::INT, '|', (p2 >= 0.5)::INT, ':', {_F.format(x='(p1 + p2)')}, ':', {_F.format(x='((1 - p1) * (1 - p2))')}, ',', {_F.format(x='(p1 * (1 - p2) + (1 - p1) * p2)')}, ',', {_F.format(x='(p1 * p2)')}, ':', {_F.format(x='p1')}, ':', {_F.format(x='p2')}) AS cell FROM ({_EIGHTHS})")
def sample_fields(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.array((F.col("l_suppkey") % 9) / 8).alias("ap1"), F.array((F.col("l_partkey") % 9) / 8).alias("ap2"))
    a, b = gt.hard_call(F.get("ap1", F.lit(0)), F.get("ap2", F.lit(0)))
    return t.withColumn("gt", F.concat_ws("|", a.cast("string"), b.cast("string"))).withColumn("ds", F.zip_with("ap1", "ap2", lambda x, y: x + y)).select("l_orderkey", "l_linenumber", im.sample_text(True, True).alias("cell"))
