"""Aligning target sites with reference sites: an equi-join on position, then allele matching by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import complement, is_snv, normal_chrom
from .joins import many


def places(of: Column, among: Column) -> Column:
    """Of each allele its place among others from 0, -1 if it is not there."""
    return F.transform(of, lambda x: (F.array_position(among, x) - 1).cast("int"))


def align(target: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference sites matched with target sites at the same place whose alleles all map.

    Both have chrom, pos, idx and alleles (array, reference first). Alleles map directly or, if all are
    single bases, through the other strand. Of several target sites at a place the last counts. Output:
    chrom, pos, ref_idx, target_idx, targ_to_ref, ref_to_targ (-1: none), flipped, swapped.
    """
    last = target.groupBy(normal_chrom(F.col("chrom")).alias("_c"), F.col("pos").alias("_p")).agg(F.max_by(F.struct("idx", "alleles"), "idx").alias("_t"))
    both = reference.join(many(last), (normal_chrom(F.col("chrom")) == F.col("_c")) & (F.col("pos") == F.col("_p")))
    targ, ref = F.col("_t.alleles"), F.col("alleles")
    direct = places(targ, ref)
    other = F.transform(targ, complement)
    flipped = places(other, ref)
    ok = lambda m: F.forall(m, lambda x: x >= 0)
    snv = lambda a: is_snv(F.get(a, F.lit(0)), F.slice(a, 2, 1000))
    both = both.withColumn("flipped", ~ok(direct) & ok(flipped) & snv(targ) & snv(ref))
    both = both.where(ok(direct) | F.col("flipped"))
    both = both.withColumn("targ_to_ref", F.when(F.col("flipped"), flipped).otherwise(direct))
    back = F.transform(F.sequence(F.lit(0), F.size(ref) - 1), lambda i: (F.array_position(F.col("targ_to_ref"), i.cast("int")) - 1).cast("int"))
    return both.select("chrom", "pos", F.col("idx").alias("ref_idx"), F.col("_t.idx").alias("target_idx"), "targ_to_ref", back.alias("ref_to_targ"), "flipped", (F.get("targ_to_ref", F.lit(0)) != 0).alias("swapped"))


def map_allele(mapping: Column, allele: Column) -> Column:
    """An allele in the other numbering; NULL if it is missing or has none there; unchanged without a mapping."""
    there = F.get(mapping, allele)
    return F.when(mapping.isNull(), allele).otherwise(F.when(there >= 0, there))


def typed(reference: DataFrame, alignment: DataFrame) -> DataFrame:
    """Reference sites that the target has."""
    return reference.join(many(alignment), reference.idx == alignment.ref_idx, "left_semi")


def untyped(reference: DataFrame, alignment: DataFrame) -> DataFrame:
    """Reference sites to be imputed."""
    return reference.join(many(alignment), reference.idx == alignment.ref_idx, "left_anti")


def composite(target: DataFrame, reference: DataFrame, alignment: DataFrame, n_target: int) -> DataFrame:
    """Target haplotypes and, numbered after them, the reference's in the target's alleles, over target sites.

    target: m, hap, allele; reference: m (reference numbering), hap, allele. Sites without alignment hold the target only.
    """
    ref = reference.join(many(alignment), reference.m == alignment.ref_idx).select(F.col("target_idx").alias("m"), (F.col("hap") + n_target).alias("hap"), map_allele(F.col("ref_to_targ"), F.col("allele").cast("int")).cast("long").alias("allele"))
    return target.select("m", "hap", F.col("allele").cast("long").alias("allele")).unionByName(ref)
