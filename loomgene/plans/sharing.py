"""Segments that samples share on both haplotypes, from calls and a genetic map, as phasing takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frequency, ibs2, segmentation
from ..operators.joins import many
from .stages import keep_once

#: Centimorgans between markers that are compared, and how many of them make a step.
SPACING, STEP = 0.02, 50


def shared(calls: DataFrame, gen: DataFrame, least: float = 2.0) -> DataFrame:
    """(chrom, sample, other, first, last): segments of at least so many centimorgans, stretched as far as the pair's genotypes fit.

    calls: chrom, pos, sample, a1, a2; gen: chrom, pos, gen_pos.
    """
    both = calls.select("chrom", "pos", F.explode(F.array("a1", "a2")).alias("allele"))
    usable = ibs2.informative(frequency.allele_counts(both, ["chrom", "pos"])).select("chrom", "pos")
    steps = segmentation.spaced_steps(gen.join(many(usable), ["chrom", "pos"]), SPACING, STEP).where("used").select("chrom", "pos", "step")
    rows = keep_once(calls.select("chrom", "pos", "sample", "a1", "a2").join(many(steps), ["chrom", "pos"]).join(many(gen.select("chrom", "pos", F.col("gen_pos").alias("gen"))), ["chrom", "pos"]))
    ends = rows.groupBy("chrom", "step").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("gen").alias("g1"), F.max("gen").alias("g2"))
    found = ibs2.segments(ibs2.step_pairs(ibs2.step_classes(ibs2.usable(rows))), ends)
    return ibs2.long_enough(ibs2.extend(found, rows), least).select("chrom", "sample", "other", "first", "last")
