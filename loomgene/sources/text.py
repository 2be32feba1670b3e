"""Small text sources: genetic maps, lists of names and array sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, cm) from lines `chrom pos rate cM`; blank lines and comments are passed over.

    Too few columns, a field that is no finite number, or positions of a chromosome that do not ascend in
    the order of the file are errors. A chromosome that is not listed simply has no rows.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    f = F.split("v", r"\s+")
    rows = lines.select("n", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("int").alias("pos"), F.get(f, F.lit(3)).try_cast("double").alias("cm"))
    w = W.partitionBy("chrom").orderBy("n")
    bad = F.col("pos").isNull() | F.col("cm").isNull() | F.isnan("cm") | (F.abs("cm") > 1e300)
    rows = rows.withColumn("_last", F.lag("pos").over(w))
    fault = F.when(bad, F.lit("a line of the genetic map has too few columns or no number")).when(F.col("pos") <= F.col("_last"), F.lit("positions of the genetic map do not ascend"))
    return rows.select("chrom", F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("pos")).alias("pos"), "cm")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name): one per line; blank lines and comments are passed over, repeats once."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def array_sites(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """(chrom, pos) of an array's sites on a chromosome, whichever way its name is written: tab-separated CHROM POS with a header."""
    from ..functions.genotype import chrom_aliases

    f = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '#')").select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("int").alias("pos")).where("pos is not null")
    return rows.where(F.col("chrom").isin(chrom_aliases(chrom))).distinct()
