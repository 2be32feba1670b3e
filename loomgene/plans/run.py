"""Whole runs from files to files: phasing, imputation and accuracy of an imputed file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.genotype import normal_chrom
from ..functions.model import mismatch_probability
from ..operators import alignment, interpolation, metrics
from ..operators.frequency import allele_counts
from ..operators.quality import maf_bin
from ..sources import bref3, text, vcf, writers
from . import impute as im
from . import phase as ph
from . import sharing
from .stages import keep_once


#: Records of one place, told apart by their alleles, are numbered within it.
MOST_RECORDS = 4096


def numbered(sites: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alts, place): all different records; place orders them by position, then by alleles.

    Of records that repeat one with equal alleles the one with the greatest id stays. More than MOST_RECORDS at a
    position are an error.
    """
    own = sites.groupBy("chrom", "pos", "ref", "alts").agg(F.max("id").alias("id"))
    at = own.selectExpr("*", "row_number() over (partition by chrom, pos order by ref, alts) - 1 as _k")
    k = F.when(F.col("_k") < MOST_RECORDS, F.col("_k")).otherwise(F.raise_error(F.lit(f"more than {MOST_RECORDS} records at one position")))
    return at.select("chrom", "pos", "id", "ref", "alts", (F.col("pos").cast("bigint") * MOST_RECORDS + k).alias("place"))


def positions(spark: SparkSession, sites: DataFrame, map_path: str | None) -> DataFrame:
    """(chrom, pos, gen_pos); a map's chromosomes are matched by name, with or without `chr`."""
    m = sites.select("chrom", F.col("pos").cast("bigint").alias("pos"))
    if not map_path:
        return m.withColumn("gen_pos", F.col("pos") * F.lit(interpolation.DEFAULT_RATE))
    knots = text.genetic_map(spark, map_path).withColumn("_n", normal_chrom(F.col("chrom"))).drop("chrom")
    named = knots.join(m.select("chrom").distinct().withColumn("_n", normal_chrom(F.col("chrom"))), "_n").select("chrom", F.col("pos").cast("bigint").alias("pos"), "cm")
    return interpolation.genetic_positions(m, named)


def _lists(spark: SparkSession, c: Config) -> tuple[DataFrame | None, DataFrame | None]:
    return tuple(text.names(spark, p) if p else None for p in (c.exclude_samples, c.exclude_markers))


def _chosen(df: DataFrame, c: Config) -> DataFrame:
    return df if c.chrom is None else vcf.region(df, c.chrom, 0, 2**31 - 1)


def _target(spark: SparkSession, c: Config) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sites, calls (with their sites' places) and sample names of the target file."""
    t = vcf.lines(spark, c.gt)
    samples, markers = _lists(spark, c)
    sites = keep_once(numbered(_chosen(vcf.sites(t, markers), c)))
    calls = _chosen(vcf.calls(t, samples, markers), c).select("chrom", "pos", "ref", "alts", "sample_idx", "sample_id", F.struct("a1", "a2", "phased", "conf").alias("call"))
    calls = keep_once(_placed(calls, sites, ["sample_idx", "sample_id"]).select("chrom", "pos", "place", "sample_idx", "sample_id", "call.*"))
    ids = [r.sample_id for r in calls.select("sample_idx", "sample_id").distinct().orderBy("sample_idx").collect()]  # a header's names
    return sites, calls, ids


def _placed(rows: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """rows (chrom, pos, ref, alts, keys, one more column) with the places of their records; of repeated records the greatest row."""
    value = next(x for x in rows.columns if x not in ("chrom", "pos", "ref", "alts", *keys))
    both = rows.join(sites.select("chrom", "pos", "ref", "alts", "place"), ["chrom", "pos", "ref", "alts"])
    return both.groupBy("chrom", "pos", "place", *keys).agg(F.max(value).alias(value))


def _gen(spark: SparkSession, sites: DataFrame, c: Config) -> DataFrame:
    """(chrom, pos, gen_pos) of sites, with places as positions."""
    gen = positions(spark, sites.select("chrom", "pos").distinct(), c.map_path)
    return sites.select("chrom", F.col("pos").cast("bigint").alias("pos"), "place").join(gen, ["chrom", "pos"]).select("chrom", F.col("place").alias("pos"), "gen_pos")


def _phase(rows: DataFrame, gen: DataFrame, panel: DataFrame | None, c: Config, err: float | None) -> DataFrame:
    """rows (chrom, pos, sample, a1, a2, phased, conf) phased with all of the run's options, with segments that samples share."""
    return ph.phase(rows, gen, panel, c.window, c.overlap, window_markers=c.window_markers, segments=sharing.shared(rows, gen), burnin=c.burnin, iterations=c.iterations, k=c.phase_states, step=c.step, ne=c.ne, err=err, rare=c.rare, em=c.em, draws=c.mcmc_burnin + 2 if not c.dynamic_mcmc else c.mcmc_steps, dynamic=c.dynamic_mcmc, seed=c.seed)


def phase_file(spark: SparkSession, c: Config) -> str:
    """Phases c.gt (with the haplotypes of c.ref, if given) into c.out + '.vcf.gz'."""
    c.validate()
    sites, calls, ids = _target(spark, c)
    panel = None
    if c.ref:
        ref_sites, ref_haps = reference(spark, c)
        a = alignment.align(_alleles(sites), _alleles(ref_sites)).select(F.col("ref_idx.place").alias("_r"), F.col("ref_idx.chrom").alias("_c"), F.col("target_idx.chrom").alias("chrom"), F.col("target_idx.place").alias("pos"), "ref_to_targ")
        panel = ref_haps.withColumnsRenamed({"chrom": "_c", "pos": "_r"}).join(a, ["_c", "_r"]).select("chrom", "pos", "hap", alignment.map_allele(F.col("ref_to_targ"), F.col("allele")).alias("allele"))
    rows = calls.select("chrom", F.col("place").alias("pos"), F.col("sample_idx").cast("bigint").alias("sample"), "a1", "a2", "phased", "conf")
    done = _phase(rows, _gen(spark, sites, c), panel, c, c.err)
    cells = done.select("chrom", F.col("pos").alias("place"), F.col("sample").alias("sample_idx"), writers.gt_text(F.col("a1"), F.col("a2")).alias("text"))
    return _write(c, writers.rows(sites, cells), ids, sites)


def reference(spark: SparkSession, c: Config) -> tuple[DataFrame, DataFrame]:
    """Sites, and haplotypes (chrom, pos, hap, allele; places as positions), of a panel in VCF or in the binary format."""
    if c.ref.endswith(".bref3"):
        p = keep_once(_chosen(bref3.read(spark, c.ref), c))
        sites = keep_once(numbered(p))
        own = _placed(p.select("chrom", "pos", "ref", "alts", "alleles"), sites, [])
        return sites, bref3.haplotypes(own.select("chrom", F.col("place").alias("pos"), "alleles"))
    t = vcf.lines(spark, c.ref)
    sites = keep_once(numbered(_chosen(vcf.sites(t), c)))
    calls = vcf.calls(t, with_gl=False).select("chrom", "pos", "ref", "alts", "sample_idx", F.struct("a1", "a2").alias("call"))
    own = _placed(calls, sites, ["sample_idx"]).select("chrom", F.col("place").alias("pos"), "sample_idx", "call.*")
    return sites, vcf.haplotypes(own)


def _alleles(sites: DataFrame) -> DataFrame:
    return sites.select("chrom", "pos", F.struct("chrom", "place").alias("idx"), F.concat(F.array("ref"), "alts").alias("alleles"))


def impute_file(spark: SparkSession, c: Config) -> str:
    """Imputes the sites of c.ref into c.gt, phased first if any call is not, as c.out + '.vcf.gz'."""
    c.validate()
    sites, calls, ids = _target(spark, c)
    ref_sites, haps = reference(spark, c)
    haps = keep_once(haps.select("chrom", "pos", F.col("hap").cast("bigint").alias("hap"), "allele"))
    gen = _gen(spark, ref_sites, c)
    n_ref = (haps.agg(F.max("hap")).first()[0] or 0) + 1
    a = alignment.align(_alleles(sites), _alleles(ref_sites)).select(F.col("target_idx.chrom").alias("chrom"), F.col("target_idx.place").alias("place"), F.col("ref_idx").alias("_r"), "targ_to_ref")
    typed = calls.join(a, ["chrom", "place"])
    to_ref = lambda x: alignment.map_allele(F.col("targ_to_ref"), F.col(x))
    rows = keep_once(typed.select(F.col("_r.chrom").alias("chrom"), F.col("_r.place").alias("pos"), F.col("sample_idx").cast("bigint").alias("sample"), to_ref("a1").alias("a1"), to_ref("a2").alias("a2"), "phased", "conf"))
    err = mismatch_probability(n_ref) if c.err is None else c.err
    if rows.where("not phased").limit(1).count():
        known = rows.where("a1 is not null and a2 is not null").select("chrom", "pos", "sample", "conf")
        rows = _phase(rows, gen.join(rows.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi"), haps, c, err).join(known, ["chrom", "pos", "sample"])
    both = F.array(F.struct((F.col("sample") * 2).alias("hap"), F.col("a1").alias("allele")), F.struct((F.col("sample") * 2 + 1).alias("hap"), F.col("a2").alias("allele")))
    target = rows.select("chrom", "pos", "conf", F.explode(both).alias("h")).select("chrom", "pos", "h.hap", "h.allele", "conf")
    alts = ref_sites.select("chrom", F.col("place").alias("pos"), F.greatest(F.size("alts"), F.lit(1)).alias("n_alts"))
    probs = keep_once(im.impute(haps, target, gen.join(alts, ["chrom", "pos"]), n_ref, c.ne, err, c.imp_states, c.cluster, c.window, c.overlap, window_markers=c.window_markers, lock=True, seed=c.seed))
    q = im.site_report(probs).withColumnRenamed("pos", "place")
    info = writers.quality_info(F.col("af"), F.col("dr2"), F.col("imputed"))
    out_sites = ref_sites.join(q, ["chrom", "place"]).withColumn("info", info)
    cells = im.genotypes(probs).select("chrom", F.col("pos").alias("place"), F.col("sample").alias("sample_idx"), im.sample_text(c.gp, c.ap).alias("text"))
    form = "GT:DS" + ":GP" * c.gp + ":AP1:AP2" * c.ap
    return _write(c, writers.rows(out_sites, cells, form), ids, out_sites, True)


def _write(c: Config, lines: DataFrame, ids: list[str], sites: DataFrame, imputed: bool = False) -> str:
    contigs = sorted(r.chrom for r in sites.select("chrom").distinct().collect())  # chromosome names
    path = f"{c.out}.vcf.gz"
    writers.write_vcf(lines, writers.header(ids, contigs, imputed, c.gp, c.ap), path)
    return path


def evaluate(spark: SparkSession, truth: str, imputed: str) -> dict[str, DataFrame]:
    """Tables of an imputed file's accuracy against the truth: overall, by frequency bin, by sample, confusion, sites."""
    t, i = vcf.lines(spark, truth), vcf.lines(spark, imputed)
    state = metrics.compare_sites(vcf.sites(t), vcf.sites(i))
    ok = state.where("state = 'compared'").select("chrom", "pos")
    tc = vcf.calls(t, with_gl=False).join(ok, ["chrom", "pos"], "left_semi")
    ic = vcf.records(i).select("chrom", "pos", "format", F.posexplode("fields").alias("column", "field"))
    names = vcf.samples(i).withColumnRenamed("sample_idx", "column")
    ic = ic.join(F.broadcast(names), "column").join(ok, ["chrom", "pos"], "left_semi")  # a header's names
    from ..functions.genotype import decode_gt

    called = ic.select("chrom", "pos", "sample_id", decode_gt(vcf.field("GT")).alias("g"), vcf.field("DS").try_cast("double").alias("ds"))
    c = (F.col("g.a1") > 0).cast("int") + (F.col("g.a2") > 0).cast("int")
    called = called.select("chrom", "pos", "sample_id", c.alias("c"), F.coalesce("ds", c.cast("double")).alias("i"), F.col("g.a1").alias("i1"), F.col("g.phased").alias("i_phased"))
    both = tc.join(called, ["chrom", "pos", "sample_id"]).where("a1 is not null and c is not null")
    pairs = keep_once(both.select("chrom", "pos", F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("site"), F.col("sample_id").alias("sample"), ((F.col("a1") > 0).cast("int") + (F.col("a2") > 0).cast("int")).cast("bigint").alias("t"), F.col("c").cast("bigint").alias("c"), "i", "a1", "phased", "i1", "i_phased"))
    freq = allele_counts(vcf.haplotypes(tc).select("chrom", "pos", "allele"), ["chrom", "pos"]).select("chrom", "pos", maf_bin(F.coalesce("maf_present", F.lit(0.0))).alias("maf_bin"))
    from ..operators import phase_blocks

    het = pairs.where("t = 1 and c = 1 and phased and i_phased").select("chrom", "sample", "pos", (F.col("a1") == F.col("i1")).alias("o"))
    return {
        "sites": state.groupBy("state").count(),
        "overall": metrics.accuracy(pairs),
        "by_chrom_and_bin": metrics.accuracy_rollup(pairs.join(freq, ["chrom", "pos"]), "chrom", "maf_bin"),
        "by_sample": metrics.per_sample(pairs),
        "confusion": metrics.confusion(pairs),
        "iqs": metrics.iqs_summary(metrics.site_iqs(pairs)),
        "switches": phase_blocks.switch_rate(het, ["chrom", "sample"]),
        "n50": phase_blocks.n50(phase_blocks.blocks(het, ["chrom", "sample"])),
    }
