"""Quality of imputed sites from sufficient statistics, so that partial sums merge in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the frequency bins and their names
MAF_BINS = ((0.001, "<0.1%"), (0.005, "0.1-0.5%"), (0.01, "0.5-1%"), (0.05, "1-5%"), (0.2, "5-20%"))
LAST_BIN = ">20%"


def dr2(s: Column, ss: Column, n: Column) -> Column:
    """Estimated dosage R2 from the sums of ALT probabilities and their squares over n haplotypes.

    (ss - s^2/n) / (s - s^2/n) in 0..1; 1 where s is 0 or n (within 1e-8), 0 without haplotypes.
    """
    spread = s - s * s / n
    return F.when(n == 0, 0.0).when((s == 0) | (F.abs(s - n) <= 1e-8), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ss - s * s / n) / spread)))


def maf_bin(maf: Column) -> Column:
    out = F.when(maf < MAF_BINS[0][0], MAF_BINS[0][1])
    for bound, name in MAF_BINS[1:]:
        out = out.when(maf < bound, name)
    return out.otherwise(LAST_BIN)


def site_quality(probs: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Per site n, af, dr2, maf and maf_bin from ALT probabilities of haplotypes."""
    g = probs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(p).alias("_s"), F.sum(F.col(p) * F.col(p)).alias("_ss"))
    af = F.col("_s") / F.col("n")
    out = g.select(*keys, "n", af.alias("af"), dr2(F.col("_s"), F.col("_ss"), F.col("n")).alias("dr2"))
    return out.withColumn("maf", F.least("af", 1 - F.col("af"))).withColumn("maf_bin", maf_bin(F.col("maf")))
