"""Accuracy of called and imputed genotypes: one wide aggregate of mergeable sums, then ratios.

Input rows: site, sample, t (true ALT count), c (called ALT count), i (dosage); more where said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frequency import ratio
from .quality import maf_bin


def _sum(c: Column, name: str) -> Column:
    return F.sum(c.cast("bigint")).alias(name)


def sums() -> list[Column]:
    """Sufficient statistics; adding those of parts gives those of the whole."""
    t, i, c = F.col("t"), F.col("i"), F.col("c")
    one = F.lit(1)
    return [
        F.count("*").alias("n"), F.sum(t).cast("double").alias("s_t"), F.sum(i).alias("s_i"), F.sum(t * i).alias("s_ti"), F.sum(t * t).cast("double").alias("s_tt"), F.sum(i * i).alias("s_ii"),
        _sum(F.when(t == c, one).otherwise(0), "same"), _sum(F.when(t > 0, one).otherwise(0), "nonref"), _sum(F.when((t > 0) & (t == c), one).otherwise(0), "nonref_same"),
        _sum(F.when((t > 0) & (c > 0), one).otherwise(0), "tp"), _sum(F.when((t == 0) & (c > 0), one).otherwise(0), "fp"), _sum(F.when((t > 0) & (c == 0), one).otherwise(0), "fn"),
        F.sum(sen()).alias("s_sen"),
    ]


SUMS = ("n", "s_t", "s_i", "s_ti", "s_tt", "s_ii", "same", "nonref", "nonref_same", "tp", "fp", "fn", "s_sen")


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Adds partial sums."""
    return parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])


def sen() -> Column:
    """1 - (t - i)^2 / 4, in 0..1."""
    d = F.col("t") - F.col("i")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d * d / 4))


def r_squared() -> Column:
    """Squared correlation of truth and dosage, NULL if either has no variance."""
    n = F.col("n")
    cov = n * F.col("s_ti") - F.col("s_t") * F.col("s_i")
    vt, vi = n * F.col("s_tt") - F.col("s_t") ** 2, n * F.col("s_ii") - F.col("s_i") ** 2
    return F.when((vt > 0) & (vi > 0), cov * cov / (vt * vi))


def finish(merged: DataFrame, *keys: str) -> DataFrame:
    """Ratios of merged sums."""
    col = F.col
    precision, recall = ratio(col("tp"), col("tp") + col("fp")), ratio(col("tp"), col("tp") + col("fn"))
    info = F.when(col("n") * col("s_tt") - col("s_t") ** 2 > 0, (col("n") * col("s_ii") - col("s_i") ** 2) / (col("n") * col("s_tt") - col("s_t") ** 2))
    return merged.select(*keys, "n", ratio(col("same"), col("n")).alias("concordance"), ratio(col("nonref_same"), col("nonref")).alias("nonref_concordance"), r_squared().alias("r_squared"), info.alias("info"), precision.alias("precision"), recall.alias("recall"), ratio(2 * col("tp"), 2 * col("tp") + col("fp") + col("fn")).alias("f1"), ratio(col("s_sen"), col("n")).alias("sen"))


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    return finish(rows.groupBy(*keys).agg(*sums()), *keys)


def accuracy_rollup(rows: DataFrame, key: str, bin_key: str) -> DataFrame:
    """For each key, for each bin, and over all: grouping sets over partial sums per (key, bin)."""
    parts = rows.groupBy(key, bin_key).agg(*sums())
    sets = parts.groupingSets([[F.col(key)], [F.col(bin_key)], []], F.col(key), F.col(bin_key)).agg(*[F.sum(s).alias(s) for s in SUMS], F.grouping(key).cast("int").alias("_gk"), F.grouping(bin_key).cast("int").alias("_gb"))
    level = F.when((F.col("_gk") == 1) & (F.col("_gb") == 1), "all").when(F.col("_gb") == 1, key).otherwise(bin_key)
    out = sets.withColumn("level", level)
    return finish(out, "level", key, bin_key)


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "t", "c").agg(F.count("*").alias("n"))


def class_accuracy(rows: DataFrame) -> DataFrame:
    """Of each true class how many are called right."""
    return rows.groupBy("t").agg(F.count("*").alias("n"), ratio(F.count_if(F.col("t") == F.col("c")), F.count("*")).alias("accuracy"))


def dosage_probabilities(i: Column) -> Column:
    """The least spread genotype distribution with this dosage."""
    return F.array(F.greatest(F.lit(0.0), 1 - i), 1 - F.abs(1 - i), F.greatest(F.lit(0.0), i - 1))


def hellinger(t: Column, gp: Column) -> Column:
    """1 - Hellinger distance of the genotype distribution gp from the true class t."""
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - F.sqrt(F.get(gp, t.cast("int")))))


def site_iqs(rows: DataFrame) -> DataFrame:
    """(site, maf, maf_bin, iqs): concordance beyond that of independent calls; monomorphic sites have none."""
    g = rows.groupBy("site").agg(F.count("*").alias("n"), F.sum("t").alias("alts"), F.count_if(F.col("t") == F.col("c")).alias("same"))
    p = F.col("alts") / (2 * F.col("n"))
    q = 1 - p
    chance = (q * q) * (q * q) + (2 * p * q) * (2 * p * q) + (p * p) * (p * p)
    out = g.select("site", F.least(p, q).alias("maf"), F.when((p > 0) & (p < 1) & (chance < 1), (ratio(F.col("same"), F.col("n")) - chance) / (1 - chance)).alias("iqs"))
    return out.withColumn("maf_bin", maf_bin(F.col("maf")))


def iqs_summary(sites: DataFrame) -> DataFrame:
    """Per frequency bin: mean and upper median (the middle value, of two the larger).

    The median is taken by rank over counts, not by collecting values.
    """
    ok = sites.where("iqs is not null")
    w = W.partitionBy("maf_bin")
    ranked = ok.withColumn("k", F.row_number().over(w.orderBy("iqs")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.groupBy("maf_bin").agg(F.max("n").alias("sites"), F.avg("iqs").alias("mean_iqs"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("iqs"))).alias("median_iqs"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(n, brier, ece): squared error of the distributions, and mean gap of confidence and accuracy over equal bins."""
    gp = dosage_probabilities(F.col("i"))
    brier = F.aggregate(F.transform(gp, lambda p, k: (p - F.when(k == F.col("t"), 1.0).otherwise(0.0)) * (p - F.when(k == F.col("t"), 1.0).otherwise(0.0))), F.lit(0.0), lambda a, x: a + x)
    conf = F.array_max(gp)
    r = rows.select(conf.alias("conf"), brier.alias("brier"), (F.col("t") == F.col("c")).cast("int").alias("right"))
    by_bin = r.groupBy(F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("right").alias("right"), F.sum("brier").alias("brier"))
    return by_bin.agg(F.sum("n").alias("n"), (F.sum("brier") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("right") - F.col("conf"))) / F.sum("n")).alias("ece"))


def spaced_picks(sites: DataFrame, share: float = 0.02, gap: int = 50_000) -> DataFrame:
    """Sites to be masked: a hash below the share, then at least gap apart within a (chrom, maf_bin).

    The list per chromosome and bin is short (the share of its sites) and walked in order.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, keep = pdf.sort_values("pos"), None, []
        for p in pdf["pos"]:
            keep.append(last is None or p - last >= gap)
            last = p if keep[-1] else last
        return pdf[keep]

    h = F.conv(F.substring(F.md5(F.concat_ws(":", "chrom", "pos").cast("binary")), 1, 8), 16, 10).cast("bigint")
    hit = sites.select("chrom", "pos", "maf_bin").where(h < int(share * (1 << 32)))
    return hit.groupBy("chrom", "maf_bin").applyInPandas(one, "chrom string, pos bigint, maf_bin string")


def per_sample(rows: DataFrame) -> DataFrame:
    return accuracy(rows, "sample").select("sample", "n", "concordance", "r_squared", "sen")


def sample_spread(samples: DataFrame) -> DataFrame:
    """Mean, least and largest values over samples."""
    return samples.agg(F.count("*").alias("samples"), *[f(c).alias(f"{n}_{c}") for c in ("concordance", "r_squared", "sen") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def ranked(tools: DataFrame, by: str = "r_squared") -> DataFrame:
    """Tools from best to worst, ties by name."""
    return tools.withColumn("place", F.row_number().over(W.orderBy(F.col(by).desc_nulls_last(), "tool")))


def compare_sites(truth: DataFrame, imputed: DataFrame) -> DataFrame:
    """Sites of two files matched on (chrom, pos) and classified: compared, mismatch, multiallelic, missing, extra."""
    t = truth.select("chrom", "pos", F.struct("ref", "alts").alias("t"))
    i = imputed.select("chrom", "pos", F.struct("ref", "alts").alias("i"))
    state = F.when(F.col("i").isNull(), "missing").when(F.col("t").isNull(), "extra").when((F.size("t.alts") != 1) | (F.size("i.alts") != 1), "multiallelic").when((F.col("t.ref") != F.col("i.ref")) | (F.col("t.alts") != F.col("i.alts")), "mismatch").otherwise("compared")
    return t.join(i, ["chrom", "pos"], "full_outer").select("chrom", "pos", state.alias("state"))
