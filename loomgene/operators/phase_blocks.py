"""Phase along a sample's heterozygotes: switches, blocks, N50, forward fill and blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frequency import ratio
from .joins import many


def _along(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy("pos")


def switches(hets: DataFrame, keys: list[str] = ["sample"]) -> DataFrame:  # noqa: B006
    """hets (o: orientation) and switch: whether it differs from the heterozygote before, NULL at the first."""
    return hets.withColumn("switch", F.col("o") != F.lag("o").over(_along(keys)))


def switch_rate(hets: DataFrame, keys: list[str] = ["sample"]) -> DataFrame:  # noqa: B006
    g = switches(hets, keys).groupBy(*keys).agg(F.count_if("switch").alias("switches"), F.count("switch").alias("chances"))
    return g.withColumn("rate", ratio(F.col("switches"), F.col("chances")))


def blocks(hets: DataFrame, keys: list[str] = ["sample"]) -> DataFrame:  # noqa: B006
    """(keys, block, first, last, length): a block runs from a switch to the next one; its last block ends at the last heterozygote."""
    s = switches(hets, keys)
    numbered = s.withColumn("block", F.sum(F.when(F.col("switch"), 1).otherwise(0)).over(_along(keys)))
    g = numbered.groupBy(*keys, "block").agg(F.min("pos").alias("first"), F.max("pos").alias("end"))
    end = F.coalesce(F.lead("first").over(W.partitionBy(*keys).orderBy("block")), F.col("end"))
    return g.select(*keys, "block", "first", end.alias("last")).withColumn("length", F.col("last") - F.col("first"))


def n50(lengths: DataFrame, length: str = "length") -> DataFrame:
    """(n50): the length at which half of all lengths is reached, longest first.

    Equal lengths are counted together, so the running sum is over distinct lengths only.
    """
    g = lengths.groupBy(F.col(length).alias("l")).agg(F.sum(length).alias("s"))
    run = g.selectExpr("l", "sum(s) over (order by l desc) as upto", "sum(s) over () as total")
    return run.where("upto * 2 >= total").agg(F.max("l").alias("n50"))


def forward_fill(rows: DataFrame, value: Column, keys: list[str], default: int = 0) -> DataFrame:
    """The last value up to each row, `default` before the first: column filled."""
    w = _along(keys).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("filled", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def blend(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Values of two windows over their overlap, from all left to all right: (1 - k / n) left + k / n right."""
    both = left.withColumnRenamed("v", "_l").join(right.withColumnRenamed("v", "_r"), [*keys, "pos"])
    w = W.partitionBy(*keys)
    k, n = F.row_number().over(w.orderBy("pos")) - 1, F.count("*").over(w)
    return both.withColumn("_w", k / n).select(*keys, "pos", ((1 - F.col("_w")) * F.col("_l") + F.col("_w") * F.col("_r")).alias("v"))


def overlap_vote(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per sample whether the right window's haplotypes are exchanged: more heterozygotes disagree than agree.

    Rows: chrom, pos, sample, a1, a2; matched on place and sample, never on ordinals.
    """
    l, r = left.select("chrom", "pos", "sample", F.col("a1").alias("l1"), F.col("a2").alias("l2")), right.select("chrom", "pos", "sample", "a1", "a2")
    het = l.join(many(r), ["chrom", "pos", "sample"]).where("l1 <> l2 and a1 <> a2")
    g = het.groupBy("sample").agg(F.count_if((F.col("l1") == F.col("a1")) & (F.col("l2") == F.col("a2"))).alias("agree"), F.count_if((F.col("l1") == F.col("a2")) & (F.col("l2") == F.col("a1"))).alias("differ"))
    return g.withColumn("flip", F.col("differ") > F.col("agree"))
