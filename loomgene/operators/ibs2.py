"""Segments that two samples share on both haplotypes (IBS2), found without comparing all pairs.

Rows of calls: chrom, pos, gen (centimorgans), step (a block of informative markers), sample, a1, a2.
Within a step, samples are grouped by their genotypes as text; only samples with a missing call are
compared with others, and only with those that agree on a marker both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import many


def genotypes_compatible(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Equal unordered genotypes; a missing allele fits any, but alleles on either side must pair up."""
    fit = lambda x, y: x.isNull() | y.isNull() | (x == y)
    return (fit(a1, b1) & fit(a2, b2)) | (fit(a1, b2) & fit(a2, b1))


def informative(markers: DataFrame, low: float = 0.1, most_missing: float = 0.1) -> DataFrame:
    """Markers (with maf over present alleles, missing share) frequent and complete enough."""
    return markers.where((F.col("maf_present") >= low) & (1 - F.col("present") / F.col("n") <= most_missing))


def numbered_steps(sites: DataFrame, size: int, bucket: int = 1 << 20) -> DataFrame:
    """(chrom, pos, step): size sites in a row form a step. sites: distinct (chrom, pos), read twice.

    A site's number is the count of sites in the buckets of positions before its own plus its place there. One task
    sorts at most `bucket` sites then; of a chromosome only the buckets' counts come together.
    """
    at = sites.withColumn("_b", F.expr(f"pos div {bucket}"))
    counts = at.groupBy("chrom", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("chrom", "_b", (F.sum("_n").over(W.partitionBy("chrom").orderBy("_b")) - F.col("_n")).alias("_before"))
    n = F.row_number().over(W.partitionBy("chrom", "_b").orderBy("pos"))
    return at.join(many(before), ["chrom", "_b"]).withColumn("_n", n).selectExpr("chrom", "pos", f"cast((_before + _n - 1) div {size} as bigint) as step")


def usable(calls: DataFrame, most_missing: float = 0.1) -> DataFrame:
    """Calls of samples that miss at most the share (rounded down) of a step's markers."""
    per = calls.groupBy("chrom", "step", "sample").agg(F.count("*").alias("_n"), F.count_if(F.col("a1").isNull() | F.col("a2").isNull()).alias("_miss"))
    ok = per.where(F.col("_miss") <= F.floor(F.col("_n") * most_missing)).select("chrom", "step", "sample")
    return calls.join(many(ok), ["chrom", "step", "sample"], "left_semi")


def step_classes(calls: DataFrame) -> DataFrame:
    """(chrom, step, sample, pattern, complete): a step's genotypes as text, `.` for missing."""
    g = F.when(F.col("a1").isNull() | F.col("a2").isNull(), ".").otherwise(F.concat(F.least("a1", "a2").cast("string"), F.lit("/"), F.greatest("a1", "a2").cast("string")))
    sites = F.array_sort(F.collect_list(F.struct("pos", g.alias("g"))))
    p = calls.groupBy("chrom", "step", "sample").agg(F.transform(sites, lambda s: s.g).alias("p"))
    return p.select("chrom", "step", "sample", F.array_join("p", " ").alias("pattern"), (~F.array_contains("p", ".")).alias("complete"))


def step_pairs(classes: DataFrame) -> DataFrame:
    """(chrom, step, sample, other), sample < other: pairs that agree over the step, a missing call fitting any.

    Equal patterns join by the pattern. Patterns with missing calls are few; each distinct one is compared
    with the step's other distinct patterns, not sample by sample.
    """
    kinds = classes.select("chrom", "step", "pattern", "complete").distinct()
    holes = kinds.where(~F.col("complete")).select("chrom", "step", F.col("pattern").alias("hole"))
    fits = F.forall(F.zip_with(F.split("hole", " "), F.split("pattern", " "), lambda x, y: (x == ".") | (y == ".") | (x == y)), lambda b: b)
    near = holes.join(many(kinds.select("chrom", "step", "pattern")), ["chrom", "step"]).where(fits)
    match = near.unionByName(near.select("chrom", "step", F.col("pattern").alias("hole"), F.col("hole").alias("pattern"))).unionByName(kinds.select("chrom", "step", F.col("pattern").alias("hole"), "pattern")).distinct()
    left = classes.select("chrom", "step", "sample", F.col("pattern").alias("hole"))
    right = classes.select("chrom", "step", F.col("sample").alias("other"), "pattern")
    return left.join(many(match), ["chrom", "step", "hole"]).join(many(right), ["chrom", "step", "pattern"]).where("sample < other").select("chrom", "step", "sample", "other").distinct()


def segments(pairs: DataFrame, steps: DataFrame, most_gap: float = 4.0) -> DataFrame:
    """(chrom, sample, other, first, last, g1, g2): steps of a pair merged while the gap is at most most_gap.

    steps: chrom, step, first, last (positions), g1, g2 (centimorgans).
    """
    w = W.partitionBy("chrom", "sample", "other").orderBy("first")
    s = pairs.join(many(steps), ["chrom", "step"])
    new = F.coalesce((F.col("g1") - F.lag("g2").over(w) > most_gap).cast("int"), F.lit(1))
    return s.withColumn("_k", F.sum(new).over(w)).groupBy("chrom", "sample", "other", "_k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("g1").alias("g1"), F.max("g2").alias("g2")).drop("_k")


def extend(segs: DataFrame, calls: DataFrame) -> DataFrame:
    """Segments stretched over neighbouring markers as long as the pair's genotypes are compatible.

    The nearest incompatible marker on either side bounds a segment; the chromosome's ends do otherwise. Runs
    of compatible markers are numbered, so that a segment finds its own by equality of its ends.
    """
    pairs = segs.select("chrom", "sample", "other").distinct()
    a = calls.select("chrom", "pos", "gen", F.col("sample"), "a1", "a2")
    b = calls.select("chrom", "pos", F.col("sample").alias("other"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    both = a.join(many(pairs), ["chrom", "sample"]).join(many(b), ["chrom", "pos", "other"])
    marked = both.withColumn("ok", F.coalesce(genotypes_compatible(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")), F.lit(True)))
    w = W.partitionBy("chrom", "sample", "other").orderBy("pos")
    pair = ["chrom", "sample", "other"]
    run = marked.withColumn("_run", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)).where("ok").select(*pair, "pos", "gen", "_run")
    ends = run.groupBy(*pair, "_run").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.min("gen").alias("_g1"), F.max("gen").alias("_g2"))
    at = segs.join(many(run.select(*pair, F.col("pos").alias("first"), F.col("_run").alias("_r1"))), [*pair, "first"], "left").join(many(run.select(*pair, F.col("pos").alias("last"), F.col("_run").alias("_r2"))), [*pair, "last"], "left")
    at = at.join(many(ends.select(*pair, F.col("_run").alias("_r1"), "_first", "_g1")), [*pair, "_r1"], "left").join(many(ends.select(*pair, F.col("_run").alias("_r2"), "_last", "_g2")), [*pair, "_r2"], "left")
    return at.select(*pair, F.coalesce("_first", "first").alias("first"), F.coalesce("_last", "last").alias("last"), F.coalesce("_g1", "g1").alias("g1"), F.coalesce("_g2", "g2").alias("g2")).distinct()


def long_enough(segs: DataFrame, least: float = 2.0) -> DataFrame:
    return segs.where(F.col("g2") - F.col("g1") >= least)


def markers_in_segments(segs: DataFrame, markers: DataFrame, bucket: int = 1_000_000) -> DataFrame:
    """(chrom, sample, other, pos) of markers within segments, ends included: an equi-join on position buckets."""
    cut = segs.withColumn("_b", F.explode(F.expr(f"sequence(first div {bucket}, last div {bucket})")))
    m = markers.select("chrom", "pos", F.expr(f"pos div {bucket}").alias("_b"))
    return cut.join(many(m), ["chrom", "_b"]).where("pos >= first and pos <= last").select("chrom", "sample", "other", "pos")
