"""State probabilities as a relation: pruning, defaults, masses and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import many


def normalised(rows: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    return rows.withColumn(p, F.col(p) / F.sum(p).over(W.partitionBy(*keys)))


def prune_priors(rows: DataFrame, keys: list[str], states: int, p: str = "p") -> DataFrame:
    """Probabilities above min(0.5 / states, 0.001), at least 1e-6, made to sum to one again."""
    least = max(min(0.5 / states, 0.001), 1e-6)
    return normalised(rows.where(F.col(p) > least), keys, p)


def sparsify(rows: DataFrame, clusters: int, states: int) -> DataFrame:
    """States worth keeping between two clusters: all for up to 1,000 clusters, else by either end's probability."""
    least = 0.0 if clusters <= 1000 else min(0.9999 / states, 0.005)
    return rows.where(F.greatest("prob", "prob_next") > least)


def with_priors(rows: DataFrame, priors: DataFrame, keys: list[str], states: int) -> DataFrame:
    """rows and prior: that of the table, or 1 / states where it has none."""
    return rows.join(priors, keys, "left").withColumn("prior", F.coalesce("prior", F.lit(1.0 / states)))


def allele_mass(weights: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, allele, mass): state weights summed by the allele that a state carries."""
    return weights.join(many(panel), [*keys, "hap"]).groupBy(*keys, "allele").agg(F.sum("w").alias("mass"))


def carrier_share(weights: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share): how much of the weight lies on carriers of an ALT allele; NULL without weight."""
    g = weights.join(many(panel), [*keys, "hap"]).groupBy(*keys).agg(F.sum("w").alias("_w"), F.sum(F.when(F.col("allele") > 0, F.col("w")).otherwise(0.0)).alias("_c"))
    return g.select(*keys, F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")).alias("share"))


def state_list(named: Column, k: int, n: int) -> Column:
    """Sorted distinct haplotypes, padded with the lowest of 0..n-1 not named, cut to k."""
    own = F.array_sort(F.array_distinct(named))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"), own)
    return F.slice(F.concat(own, rest), 1, k)


def rank_band(ranks: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, hap, other): haplotypes at most span places apart in the sort, of different samples.

    Each row is sent to the places around it: 2 span rows for one, and an equi-join; no group is paired up.
    """
    near = ranks.select(*keys, F.col("hap"), F.explode(F.array(*[F.col("rank") + d for d in range(-span, span + 1) if d])).alias("rank"))
    other = ranks.select(*keys, F.col("hap").alias("other"), "rank")
    return near.join(many(other), [*keys, "rank"]).where(F.shiftright("hap", 1) != F.shiftright("other", 1)).select(*keys, "hap", "other")


def swap_odds(draws: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, swaps, seen, p, ratio): p = (swaps + 0.5) / (seen + 1), ratio of the likelier orientation, at most 1e6."""
    g = draws.groupBy(*keys).agg(F.count_if("swap").alias("swaps"), F.count("swap").alias("seen"))
    p = (F.col("swaps") + 0.5) / (F.col("seen") + 1)
    return g.withColumn("p", p).withColumn("ratio", F.least(F.lit(1e6), F.greatest(p, 1 - p) / F.least(p, 1 - p)))


def trace(paths: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """(keys, mean_state, switch_rate) of sampled paths."""
    w = W.partitionBy(*keys).orderBy("pos")
    moved = paths.withColumn("_moved", (F.col(state) != F.lag(state).over(w)).cast("int"))
    return moved.groupBy(*keys).agg(F.avg(state).alias("mean_state"), F.avg("_moved").alias("switch_rate"))


def call_rates(rows: DataFrame) -> DataFrame:
    """(hom_ref_rate, alt_association): calls without ALT, and true ALT carriers that are called so."""
    t, c = F.col("t"), F.col("c")
    return rows.agg((F.count_if(c == 0) / F.count("*")).alias("hom_ref_rate"), (F.count_if((t > 0) & (c > 0)) / F.count_if(t > 0)).alias("alt_association"))


def expected_matches(rows: DataFrame, posterior: str = "posterior") -> DataFrame:
    """(match, mismatch) expected over states 0 and 1 for orientations o: the emission part of an EM step."""
    p = F.when(F.col("o") == 1, F.col(posterior)).otherwise(1 - F.col(posterior))
    return rows.agg(F.sum(p).alias("match"), F.sum(1 - p).alias("mismatch"))


def unlisted_mass(states: int, listed: Column, noise_a: Column, noise_b: Column, frequency: Column) -> Column:
    """Weight of states that a sparse list leaves out: each has both anchors' noise, spread over alleles by frequency."""
    return (states - listed) * noise_a * noise_b * frequency


def informative(conf: Column, a1: Column, a2: Column, partner: Column) -> Column:
    """A call that tells something about a haplotype given its partner's allele: confident, complete, and with the partner's allele in it."""
    return F.coalesce((conf >= 0.05) & a1.isNotNull() & a2.isNotNull() & ((partner == a1) | (partner == a2)), F.lit(False))


def call_status(a1: Column, a2: Column, phased: Column) -> Column:
    """`missing`, `homozygous`, `phased` or `unphased`."""
    return F.when(a1.isNull() | a2.isNull(), "missing").when(a1 == a2, "homozygous").when(phased, "phased").otherwise("unphased")


def typed_calls(calls: DataFrame) -> DataFrame:
    """Calls with any allele: a sample's own typed sites."""
    return calls.where(F.col("a1").isNotNull() | F.col("a2").isNotNull())


def sortable_sites(haps: DataFrame, keys: list[str], batch: Column) -> DataFrame:
    """(keys, batch): sites at which some haplotype of a batch has one of the two first alleles, so that sorting by them tells something."""
    return haps.withColumn("batch", batch).groupBy(*keys, "batch").agg(F.max(F.coalesce(F.col("allele") < 2, F.lit(False))).alias("_any")).where("_any").select(*keys, "batch")


def log_likelihood(scales: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loglik): log of the product of the forward pass's scales."""
    return scales.groupBy(*keys).agg(F.sum(F.ln("scale")).alias("loglik"))
