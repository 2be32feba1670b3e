"""Imputation: sites that a panel has and the target has not, window by window.

Relational steps place markers on the genetic map, cut windows and carry typed alleles in the panel's
numbering. The panel's alleles at a window's markers are written once to the shared folder, a byte an
allele; the copying model is a kernel for each (chromosome, window, batch of samples) that reads them,
so the panel is shuffled once whatever the number of batches, and memory is bounded by the window and
the batch. Posteriors never leave the kernel; probabilities of alleles do, and quality is their
aggregate. Windows also hold what lies `overlap` before them, so the model enters a window with what the
markers before it say.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import format_4dp, genotype_probabilities
from ..functions.model import mismatch_probability, recombination_intensity
from ..operators import hmm, quality, segmentation, states
from ..operators.joins import many
from . import stages
from .phase import BLOCK, _save_panel, _window_files

#: Calls this sure stand as they are; others are weighed against what the model says.
SURE = 0.99
#: Results in one file.
ROWS = 1 << 18


def bridged(prob: np.ndarray, anchor: np.ndarray, at: np.ndarray, alleles: np.ndarray, rho: float, alt: int = 1, ends: np.ndarray | None = None) -> np.ndarray:
    """Probability of allele `alt` at markers (positions `at`) from state probabilities at anchors.

    An anchor reaches from `anchor` to `ends` (the same place if not given), and holds within. Between two anchors a
    state's weight is the product of what is kept from either side; beyond the first and last one side remains.
    prob: anchors x haplotypes x states; alleles: markers x states (255: missing).
    """
    k, ends = prob.shape[-1], anchor if ends is None else ends
    left = np.clip(np.searchsorted(anchor, at, "right") - 1, 0, len(anchor) - 1)
    right = np.where((at <= ends[left]) | (at < anchor[left]), left, np.clip(left + 1, 0, len(anchor) - 1))
    out = np.empty((len(at), prob.shape[1]))
    width = max(1, (1 << 20) // max(1, prob[0].size))
    for x in range(0, len(at), width):
        y = slice(x, x + width)
        l, r, g = left[y], right[y], at[y]
        da = np.exp(-rho * np.maximum(0.0, np.maximum(g - ends[l], anchor[l] - g)))[:, None, None]
        w = da * prob[l] + (1 - da) / k
        two = np.flatnonzero(r != l)
        db = np.exp(-rho * (anchor[r[two]] - g[two]))[:, None, None]
        w[two] *= db * prob[r[two]] + (1 - db) / k
        a = alleles[y, None, :]
        total = (w * (a != 255)).sum(-1)
        out[y] = np.where(total > 0, (w * (a == alt)).sum(-1) / np.where(total > 0, total, 1), 0.0)
    return out


def chosen_states(panel: np.ndarray, target: np.ndarray, start: np.ndarray, k: int, neighbours: int, seed: int) -> list[np.ndarray]:
    """Of each target haplotype the panel haplotypes it may copy from: all, or k of those near it in the sort over both.

    Arrays are typed markers x haplotypes; it is asked at the first, middle and last marker of each cluster.
    """
    n_ref, n = panel.shape[1], target.shape[1]
    if n_ref <= k:
        return [np.arange(n_ref)] * n
    last = np.append(start[1:], len(panel)) - 1
    asked = set(np.concatenate([start, (start + last) // 2, last]).tolist())
    count = states.named_counts(np.concatenate([panel, target], 1), asked, neighbours, n_ref)
    return [states.most_named(count[j], k, seed + n_ref + j) for j in range(n)]


def impute_window(panel: np.ndarray, gen: np.ndarray, target: np.ndarray, typed: np.ndarray, ne: float, err: float, k: int, cluster: float, neighbours: int = 12, alts: int = 1, conf: np.ndarray | None = None, lock: bool = False, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of ALT alleles 1..alts: alts x markers x target haplotypes, with typed calls as they are, and those of the model alone.

    panel, target and conf (0 to 1): markers x haplotypes. Without any typed marker the panel's frequencies are given.
    lock: haplotypes 2 s and 2 s + 1 are a sample's; the alleles that the first most probably has leave alleles for
    the second (see cluster_log_emissions).
    """
    n_ref = panel.shape[1]
    present = np.maximum((panel != 255).sum(1), 1)
    out = np.stack([np.repeat(((panel == a).sum(1) / present)[:, None], target.shape[1], 1) for a in range(1, alts + 1)])
    rows = np.flatnonzero(typed)
    if len(rows) and n_ref:
        rho = recombination_intensity(ne, n_ref)
        g, own = gen[rows], target[rows]
        sure = np.ones(own.shape) if conf is None else conf[rows]
        start = np.flatnonzero(np.diff(segmentation._groups(g, cluster), prepend=-1))
        last = np.append(start[1:], len(g)) - 1
        centre = np.add.reduceat(g, start) / (last - start + 1)
        r = np.concatenate([[0.0], -np.expm1(-rho * np.diff(centre))])
        chosen = chosen_states(panel[rows], own, start, k, neighbours, seed)
        more = [np.arange(len(gen)), *(np.flatnonzero((np.where(panel == 255, 0, panel) >= a).any(1)) for a in range(2, alts + 1))]

        def run(js: list[int], implied: np.ndarray | None = None) -> None:
            of = chosen[js[0]]
            e = hmm.cluster_log_emissions(own[:, js], panel[np.ix_(rows, of)], start, err, sure[:, js], implied)
            prob, _ = hmm.posteriors(np.exp(np.maximum(e - e.max(-1, keepdims=True), -80)), r)
            for a, at in enumerate(more, 1):
                if len(at):
                    out[a - 1][np.ix_(at, js)] = bridged(prob, g[start], gen[at], panel[np.ix_(at, of)], rho, a, g[last])

        def by_states(js: range) -> list[list[int]]:
            groups: dict[bytes, list[int]] = {}
            for j in js:
                groups.setdefault(chosen[j].tobytes(), []).append(j)
            return list(groups.values())

        for js in by_states(range(0, len(chosen), 2 if lock else 1)):
            run(js)
        for js in by_states(range(1, len(chosen), 2)) if lock else ():
            first = [j - 1 for j in js]
            p = out[:, rows][:, :, first]
            best = np.concatenate([1 - p.sum(0, keepdims=True), p]).argmax(0)
            a1, a2 = own[:, first], own[:, js]
            known = (a1 != 255) & (a2 != 255)
            run(js, np.where(known & (best == a1), a2, np.where(known & (best == a2), a1, 255)))
    known = target != 255
    return np.where(known, np.stack([target == a for a in range(1, alts + 1)]).astype(float), out), out


def impute(panel: DataFrame, target: DataFrame, markers: DataFrame, n_ref: int, ne: float = 1e5, err: float | None = None, imp_states: int = 1600, cluster: float = 0.005, window: float = 40.0, overlap: float = 2.0, batch: int = 500, window_markers: int = 1 << 40, lock: bool = False, neighbours: int = 12, seed: int = 1) -> DataFrame:
    """(chrom, pos, alt, hap, p, typed, model, conf): probability of each ALT allele (1, 2 ...) of every target haplotype at every marker.

    typed calls have p 0 or 1; model is what the other markers say there, conf the call's confidence (1 where there is
    none). A marker has as many rows for a haplotype as the column n_alts of markers says (1 without that column).
    panel: chrom, pos, hap, allele; target: the same, only present calls, optionally conf (0 to 255); hap div
    (2 batch) is a kernel's batch; markers: chrom, pos, gen_pos.
    """
    import pandas as pd

    spark = panel.sparkSession
    folder = stages.new_folder(spark, "impute")
    err = mismatch_probability(n_ref) if err is None else err
    markers = markers if "n_alts" in markers.columns else markers.withColumn("n_alts", F.lit(1))
    wins = segmentation.windows(markers, window, overlap, window_markers, before=overlap)
    placed = stages.keep_once(markers.join(F.broadcast(wins), "chrom").where("pos >= first and pos <= last").selectExpr("chrom", "window_id", "pos", "gen_pos", "n_alts", "pos >= out_first and pos <= out_last as inside", "row_number() over (partition by chrom, window_id order by pos) - 1 as at"))  # a row per window of 40 cM: a genome has under 200
    _save_panel(placed, panel, n_ref, folder)
    numbered = target.withColumn("batch", F.expr(f"hap div {2 * batch}"))
    conf = F.coalesce("conf", F.lit(255)) if "conf" in target.columns else F.lit(255)
    layout = placed.groupBy("chrom", "window_id").agg(F.array_sort(F.collect_list(F.struct("pos", "gen_pos", "inside", "n_alts"))).alias("m"))
    names = numbered.groupBy("chrom", "batch").agg(F.array_sort(F.collect_set("hap")).alias("haps"))
    left = layout.join(many(names), "chrom")
    right = numbered.select("chrom", "pos", "batch", "hap", F.col("allele").cast("int").alias("allele"), conf.cast("int").alias("conf")).join(many(placed.select("chrom", "window_id", "pos", "at")), ["chrom", "pos"]).select("chrom", "window_id", "batch", "at", "hap", "allele", "conf")
    cols = ["chrom", "pos", "alt", "hap", "p", "typed", "model", "conf"]

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=["part"])
        chrom, at, m, haps = a["chrom"].iloc[0], _window_files(folder, a["chrom"].iloc[0], int(a["window_id"].iloc[0])), a["m"].iloc[0], np.array(a["haps"].iloc[0])
        pos, gen, inside, n_alts = (np.array([v[c] for v in m]) for c in ("pos", "gen_pos", "inside", "n_alts"))
        ref = np.concatenate([stages.load_arrays(f"{at}/panel-{k}", "alleles")[0] for k in range(-(-len(m) // BLOCK))])
        own, sure = np.full((len(pos), len(haps)), 255, np.uint8), np.ones((len(pos), len(haps)))
        if len(b):
            cell = b["at"].to_numpy(), np.searchsorted(haps, b["hap"].to_numpy())
            own[cell], sure[cell] = b["allele"].fillna(255).to_numpy(), b["conf"].to_numpy() / 255
        typed = (own != 255).any(1)
        pairs = lock and len(haps) % 2 == 0 and (haps[0::2] + 1 == haps[1::2]).all() and (haps[0::2] % 2 == 0).all()
        p, model = impute_window(ref, gen, own, typed, ne, err, imp_states, cluster, neighbours, max(1, int(n_alts.max())), sure, bool(pairs), seed)
        parts = []
        for alt in range(1, len(p) + 1):
            keep = np.flatnonzero(inside & (n_alts >= alt))
            for x in range(0, len(keep), width := max(1, ROWS // len(haps))):
                some = keep[x : x + width]
                parts.append(f"{at}/done-{int(a['batch'].iloc[0])}-{alt}-{x}")
                stages.save_arrays(parts[-1], pos=pos[some], haps=haps, alt=alt, p=p[alt - 1][some], typed=typed[some], model=model[alt - 1][some], conf=np.where(own[some] != 255, sure[some], 1.0))
        return pd.DataFrame({"chrom": chrom, "part": parts})

    def read(frames):
        for pdf in frames:
            for chrom, part in zip(pdf["chrom"], pdf["part"]):
                pos, haps, alt, p, typed, model, conf = stages.load_arrays(part, "pos", "haps", "alt", "p", "typed", "model", "conf")
                n = len(haps)
                yield pd.DataFrame({"chrom": chrom, "pos": np.repeat(pos, n), "alt": int(alt), "hap": np.tile(haps, len(pos)), "p": p.ravel(), "typed": np.repeat(typed, n), "model": model.ravel(), "conf": conf.ravel()})[cols]

    keys = ["chrom", "window_id", "batch"]
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same markers
    done = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, "chrom string, part string")
    parts = stages.keep_once(done)  # a row per file of ROWS results
    return parts.repartition(max(1, min(20_000, parts.count())), F.xxhash64("part")).mapInPandas(read, "chrom string, pos bigint, alt int, hap bigint, p double, typed boolean, model double, conf double")


def genotypes(probs: DataFrame) -> DataFrame:
    """(chrom, pos, sample, gt, ds, ap1, ap2, typed): ds, ap1 and ap2 have a value per ALT allele.

    A haplotype's call is its most probable allele; of equal ones the last, so that a tie is ALT. A typed call stands,
    unless it is biallelic and less sure than SURE: then it is the genotype with the largest product of the model's
    probability and the call's likelihood (conf for the genotype called, (1 - conf) / 2 for either other one; ties go
    to more ALT alleles), and a heterozygote that the call wasn't is 0|1.
    """
    cells = F.array_sort(F.collect_list(F.struct("alt", "p", *(["model"] if "model" in probs.columns else []))))
    model = F.transform(cells, lambda c: c.model) if "model" in probs.columns else F.transform(cells, lambda c: c.p)
    conf = F.min("conf") if "conf" in probs.columns else F.lit(1.0)
    haps = probs.groupBy("chrom", "pos", "hap").agg(F.transform(cells, lambda c: c.p).alias("ap"), model.alias("model"), conf.alias("conf"), F.max("typed").alias("typed"))
    side = lambda k, c: F.max(F.when(F.col("hap") % 2 == k, F.col(c)))
    s = haps.groupBy("chrom", "pos", F.expr("hap div 2").alias("sample")).agg(side(0, "ap").alias("ap1"), side(1, "ap").alias("ap2"), side(0, "model").alias("m1"), side(1, "model").alias("m2"), F.min("conf").alias("conf"), F.max("typed").alias("typed"))

    def call(ap: str):
        pmf = F.concat(F.array(1 - F.aggregate(ap, F.lit(0.0), lambda a, x: a + x)), F.col(ap))
        multi = F.size(pmf) - F.array_position(F.reverse(pmf), F.array_max(pmf))
        return F.when(F.size(ap) == 1, (F.get(ap, F.lit(0)) >= 0.5).cast("int")).otherwise(multi).cast("string")

    own = F.concat_ws("|", call("ap1"), call("ap2"))
    n_alt = (F.get("ap1", F.lit(0)) >= 0.5).cast("int") + (F.get("ap2", F.lit(0)) >= 0.5).cast("int")
    p1, p2, c = F.get("m1", F.lit(0)), F.get("m2", F.lit(0)), F.col("conf")
    prior = [(1 - p1) * (1 - p2), p1 * (1 - p2) + p2 * (1 - p1), p1 * p2]
    q = [x * F.when(n_alt == k, c).otherwise((1 - c) / 2) for k, x in enumerate(prior)]
    weighed = F.when((q[2] >= q[1]) & (q[2] >= q[0]), F.lit(2)).when(q[1] >= q[0], F.lit(1)).otherwise(F.lit(0))
    doubtful = F.col("typed") & (F.size("ap1") == 1) & (c < SURE) & (weighed != n_alt)
    gt = F.when(doubtful, F.element_at(F.array(F.lit("0|0"), F.lit("0|1"), F.lit("1|1")), weighed + 1)).otherwise(own)
    ds = F.zip_with("ap1", "ap2", lambda a, b: a + b)
    return s.select("chrom", "pos", "sample", gt.alias("gt"), ds.alias("ds"), "ap1", "ap2", "typed")


def site_report(probs: DataFrame) -> DataFrame:
    """(chrom, pos, af, dr2, imputed) over all output markers; af and dr2 have a value per ALT allele."""
    q = quality.site_quality(probs, ["chrom", "pos", "alt"])
    by_alt = F.array_sort(F.collect_list(F.struct("alt", "af", "dr2")))
    values = q.groupBy("chrom", "pos").agg(by_alt.alias("v")).select("chrom", "pos", F.transform("v", lambda v: v.af).alias("af"), F.transform("v", lambda v: v.dr2).alias("dr2"))
    return values.join(many(probs.groupBy("chrom", "pos").agg((~F.max("typed")).alias("imputed"))), ["chrom", "pos"])


def sample_text(gp: bool = False, ap: bool = False):
    """The text of a sample's field: GT:DS[:GP][:AP1:AP2], a value per ALT allele (GP: per genotype)."""
    listed = lambda c: F.array_join(F.transform(c, format_4dp), ",")
    pmf = lambda c: F.concat(F.array(1 - F.aggregate(c, F.lit(0.0), lambda a, x: a + x)), F.col(c))
    parts = [F.col("gt"), listed("ds")]
    if gp:
        parts.append(listed(genotype_probabilities(pmf("ap1"), pmf("ap2"))))
    if ap:
        parts += [listed("ap1"), listed("ap2")]
    return F.concat_ws(":", *parts)
