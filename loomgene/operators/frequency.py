"""Allele counts, frequencies, storage choice and haplotype patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import many


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def allele_counts(haps: DataFrame, keys: list[str]) -> DataFrame:
    """Per site: n haplotypes, present ones, alt count, maf over all and maf_present over present ones."""
    c = haps.groupBy(*keys).agg(F.count("*").alias("n"), F.count("allele").alias("present"), F.count_if(F.col("allele") > 0).alias("alt"))
    fold = lambda f: F.least(f, 1 - f)
    return c.withColumn("maf", fold(ratio(F.col("alt"), F.col("n")))).withColumn("maf_present", fold(ratio(F.col("alt"), F.col("present"))))


def frequency_class(maf: Column, rare: float) -> Column:
    """`high` from the threshold on, `rare` below it, `monomorphic` at 0."""
    return F.when(maf >= rare, "high").when(maf > 0, "rare").otherwise("monomorphic")


def storage_choice(counts: DataFrame) -> DataFrame:
    """Column encoding of each site: sparse if biallelic, complete and of a maf under 1 %, else dense."""
    return counts.withColumn("encoding", F.when((F.col("maf_present") < 0.01) & (F.col("present") == F.col("n")), "sparse").otherwise("dense"))


def sparse_carriers(haps: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted carriers of the rarer allele, and whether that is the reference allele (inverted)."""
    c = haps.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("allele") > 0).alias("alt"), F.array_sort(F.collect_list(F.when(F.col("allele") > 0, F.col("hap")))).alias("alts"), F.array_sort(F.collect_list(F.when(F.col("allele") == 0, F.col("hap")))).alias("refs"))
    inverted = F.col("alt") * 2 > F.col("n")
    return c.select(*keys, inverted.alias("inverted"), F.when(inverted, F.col("refs")).otherwise(F.col("alts")).alias("carriers"))


def base_frequencies(haps: DataFrame, keys: list[str], n_alleles: int = 2) -> DataFrame:
    """Panel frequency of each allele of 0..n_alleles-1 among present ones; uniform if none is present."""
    counts = [F.count_if(F.col("allele") == a).alias(f"_{a}") for a in range(n_alleles)]
    g = haps.groupBy(*keys).agg(F.count("allele").alias("_n"), *counts)
    return g.select(*keys, *[F.when(F.col("_n") == 0, F.lit(1.0 / n_alleles)).otherwise(ratio(F.col(f"_{a}"), F.col("_n"))).alias(f"f{a}") for a in range(n_alleles)])


def block_patterns(haps: DataFrame, block: Column, order: str = "m") -> DataFrame:
    """(block, hap, pattern): the haplotype's alleles over the block's markers as text, missing as `.`.

    The text is a block's haplotype: a group by it replaces comparing haplotypes pairwise.
    """
    sites = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col("allele").cast("string"), F.lit(".")).alias("a"))))
    return haps.withColumn("block", block).groupBy("block", "hap").agg(F.array_join(F.transform(sites, lambda s: s.a), "").alias("pattern"))


def pattern_dictionary(patterns: DataFrame) -> DataFrame:
    """(block, haps, patterns, ratio, dictionary): whether a dictionary is worth it (under half as many patterns)."""
    g = patterns.groupBy("block", "pattern").agg(F.count("*").alias("n")).groupBy("block").agg(F.sum("n").alias("haps"), F.count("*").alias("patterns"))
    r = ratio(F.col("patterns"), F.col("haps"))
    return g.select("block", "haps", "patterns", r.alias("ratio"), (r < 0.5).alias("dictionary"))


def pattern_mass(patterns: DataFrame, weights: DataFrame) -> DataFrame:
    """Sums of state weights per pattern before any join with alleles: (block, pattern, sa, sb, sab, n).

    weights: block, hap, a, b. Mass between two anchors is then da db sab + da nb sa + db na sb + na nb n.
    """
    return patterns.join(many(weights), ["block", "hap"]).groupBy("block", "pattern").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("b")).alias("sab"), F.count("*").alias("n"))
