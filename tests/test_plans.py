"""Whole plans on DataFrames: windows and batches change nothing, streams equal batches, edge cases are defined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgene.operators import ibs2, interpolation, metrics, phase_blocks, segmentation
from loomgene.operators.frequency import allele_counts, sparse_carriers
from loomgene.operators.quality import dr2
from loomgene.plans import impute, phase
from loomgene.streaming import windows as sw


def panel_rows(m, h, allele):
    return [("1", 1000 * i + 1, j, int(allele(i, j))) for i in range(m) for j in range(h)]


@pytest.fixture(scope="module")
def chip(spark):
    """Chip density: every fifth marker typed, one sample of either kind."""
    panel = spark.createDataFrame(panel_rows(60, 30, lambda i, j: j >= 15), "chrom string, pos bigint, hap bigint, allele int")
    target = spark.createDataFrame([("1", 1000 * i + 1, h, int(h >= 2)) for i in range(0, 60, 5) for h in range(4)], "chrom string, pos bigint, hap bigint, allele int")
    markers = spark.createDataFrame([("1", 1000 * i + 1, i * 0.05) for i in range(60)], "chrom string, pos bigint, gen_pos double")
    return panel, target, markers


def test_imputation_over_windows_and_batches(chip):
    panel, target, markers = chip
    whole = impute.impute(panel, target, markers, 30, ne=1e3, err=1e-3)
    cut = impute.impute(panel, target, markers, 30, ne=1e3, err=1e-3, window=1.0, overlap=0.5, batch=1)
    a, b = ({(r.pos, r.hap): r.p for r in x.collect()} for x in (whole, cut))
    assert a.keys() == b.keys() and len(a) == 240
    assert all(abs(a[k] - (k[1] >= 2)) < 0.15 and abs(a[k] - b[k]) < 0.15 for k in a)
    g = impute.genotypes(cut)
    assert {(r.sample, r.gt) for r in g.collect()} == {(0, "0|0"), (1, "1|1")}
    q = impute.site_report(whole).collect()
    assert len(q) == 60 and all(0 <= r.dr2[0] <= 1 and r.af[0] == pytest.approx(0.5, abs=0.05) for r in q)
    assert sum(r.imputed for r in q) == 48
    text = g.select(impute.sample_text(True, True).alias("t")).first().t
    assert text.count(":") == 4 and text.count(",") == 2
    assert impute.impute(panel, target.limit(0), markers, 30).count() == 0


def test_phasing_over_windows_agrees(spark):
    rng = np.random.default_rng(3)
    founders = rng.integers(0, 2, (120, 3))
    of = rng.integers(0, 3, 24)
    haps = founders[:, of]
    rows = [("1", 1000 * i + 1, s, int(min(haps[i, 2 * s], haps[i, 2 * s + 1])), int(max(haps[i, 2 * s], haps[i, 2 * s + 1]))) for i in range(120) for s in range(12)]
    calls = spark.createDataFrame(rows, "chrom string, pos bigint, sample bigint, a1 int, a2 int")
    markers = spark.createDataFrame([("1", 1000 * i + 1, i * 0.05) for i in range(120)], "chrom string, pos bigint, gen_pos double")
    panel = spark.createDataFrame([("1", 1000 * i + 1, h, int(founders[i, h % 3])) for i in range(120) for h in range(12)], "chrom string, pos bigint, hap bigint, allele int")
    out = phase.phase(calls, markers, panel, window=2.0, overlap=1.0, burnin=4, iterations=3, ne=5e2)
    got = {(r.pos, r.sample): (r.a1, r.a2) for r in out.collect()}
    assert len(got) == 1440
    wrong = chances = 0
    for s in range(12):
        o = [got[1000 * i + 1, s][0] == haps[i, 2 * s] for i in range(120) if haps[i, 2 * s] != haps[i, 2 * s + 1]]
        wrong += sum(x != y for x, y in zip(o, o[1:]))
        chances += max(0, len(o) - 1)
    assert wrong / max(1, chances) < 0.05
    assert phase.phase(calls.limit(0), markers).count() == 0


def test_a_long_windows_samples_are_dealt_to_tasks(spark, monkeypatch):
    """A window with more than CALLS calls is several tasks, and every sample is in one of them."""
    monkeypatch.setattr(phase, "CALLS", 100)
    seen = []
    calls = spark.createDataFrame([("1", 10 * i, s, i * s % 2, 1) for i in range(50) for s in range(7)], "chrom string, pos bigint, sample bigint, a1 int, a2 int")
    markers = spark.createDataFrame([("1", 10 * i, i * 0.01) for i in range(50)], "chrom string, pos bigint, gen_pos double")
    monkeypatch.setattr(phase.stages, "remove_folder", lambda spark, folder: seen.append(folder))
    out = phase.phase(calls, markers, burnin=1, iterations=1, ne=1e4)
    assert sorted((r.pos, r.sample, min(r.a1, r.a2)) for r in out.collect()) == [(10 * i, s, i * s % 2) for i in range(50) for s in range(7)]
    import os

    folder = seen[0].removeprefix("file:").replace("//", "/")
    assert len([x for d, _, names in os.walk(folder) for x in names if x.startswith("calls-") and "part" not in x]) == 4


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(c, int(p), float(p) / 1e4) for c in "ab" for p in np.sort(rng.choice(40_000, 200, False))]
    schema = "chrom string, pos bigint, gen_pos double"
    batch = segmentation.windows(spark.createDataFrame(rows, schema), 0.7, 0.2).collect()
    source = tmp_path / "in"
    source.mkdir()
    for k in range(4):
        part = [(*r, False) for c in "ab" for r in [x for x in rows if x[0] == c][50 * k : 50 * k + 50]]
        part += [(c, None, None, True) for c in "ab"] if k == 3 else []
        df = spark.createDataFrame(part, schema + ", done boolean").coalesce(1)
        df.write.parquet(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("part*")).rename(source / f"{k}.parquet")
        import os
        os.utime(source / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema + ", done boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = sw.stream_windows(stream, 0.7, 0.2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(sw.OUT).parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(batch) > 8


def test_window_is_never_empty_and_capped(spark):
    m = spark.createDataFrame([("1", i, 0.0 if i < 10 else 100.0) for i in range(20)], "chrom string, pos bigint, gen_pos double")
    w = segmentation.windows(m, 1.0, 0.5, most=4).orderBy("first").collect()
    assert all(r["last"] - r["first"] < 4 for r in w) and w[-1].is_last and not any(r.is_last for r in w[:-1])
    covered = [p for r in w for p in range(r.out_first, r.out_last + 1)]
    assert sorted(covered) == list(range(20))


def test_positions_outside_and_without_a_map(spark):
    knots = spark.createDataFrame([("1", 1_000_000, 0.0), ("1", 2_000_000, 1.0), ("1", 3_000_000, 2.5), ("2", 5, 0.0)], "chrom string, pos bigint, cm double")
    m = spark.createDataFrame([("1", 500_000), ("1", 1_500_000), ("1", 2_500_000), ("1", 3_500_000), ("1", 3_000_000), ("2", 1_000_000), ("3", 1_000_000)], "chrom string, pos bigint")
    got = {(r.chrom, r.pos): r.gen_pos for r in interpolation.genetic_positions(m, knots).collect()}
    assert got == pytest.approx({("1", 500_000): -0.5, ("1", 1_500_000): 0.5, ("1", 2_500_000): 1.75, ("1", 3_500_000): 3.25, ("1", 3_000_000): 2.5, ("2", 1_000_000): 1.0, ("3", 1_000_000): 1.0})


def test_dr2_values(spark):
    cases = [([0.0] * 5 + [1.0] * 5, 1.0), ([0.5] * 10, 0.0), ([0.0] * 4, 1.0), ([1.0] * 4, 1.0)]
    for p, want in cases:
        n, s, ss = len(p), sum(p), sum(x * x for x in p)
        assert spark.range(1).select(dr2(F.lit(s), F.lit(ss), F.lit(n)).alias("x")).first().x == pytest.approx(want)


def test_all_missing_site(spark):
    h = spark.createDataFrame([(1, 0, None), (1, 1, None)], "m int, hap int, allele int")
    r = allele_counts(h, ["m"]).first()
    assert (r.n, r.present, r.alt, r.maf, r.maf_present) == (2, 0, 0, 0.0, None)
    assert sparse_carriers(h, ["m"]).first().carriers == []


def test_shared_steps_with_missing_calls(spark):
    rows = [("1", p, 0, s, *g) for s, gs in enumerate([[(0, 1), (1, 1)], [(0, 1), (1, 1)], [(None, None), (1, 1)], [(0, 0), (1, 1)]]) for p, g in enumerate(gs)]
    calls = spark.createDataFrame(rows, "chrom string, pos bigint, step bigint, sample bigint, a1 int, a2 int")
    pairs = {(r.sample, r.other) for r in ibs2.step_pairs(ibs2.step_classes(calls)).collect()}
    assert pairs == {(0, 1), (0, 2), (1, 2), (2, 3)}
    a = spark.createDataFrame([(0, 1, 1, 0), (0, 1, 0, 1), (0, 1, 1, 1), (None, 1, 0, 0), (None, 1, 0, 1)], "a1 int, a2 int, b1 int, b2 int")
    got = a.select(F.coalesce(ibs2.genotypes_compatible(*[F.col(c) for c in a.columns]), F.lit(False)).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, False, True]


def test_metrics_edge_cases(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 0.0), (1, 2, 0, 0, 0.0)], "site int, sample int, t int, c int, i double")
    r = metrics.accuracy(rows).first()
    assert (r.concordance, r.nonref_concordance, r.r_squared, r.precision) == (1.0, None, None, None)
    assert metrics.site_iqs(rows).first().iqs is None
    parts = metrics.merge(rows.groupBy("sample").agg(*metrics.sums()))
    assert metrics.finish(parts).first() == r
    assert metrics.accuracy(rows.limit(0)).first().n == 0
    assert phase_blocks.n50(spark.createDataFrame([(5,), (3,), (2,)], "length bigint")).first().n50 == 5


def test_multiallelic_output(spark):
    probs = spark.createDataFrame([("1", 5, a, h, p, False) for h, ps in enumerate([(0.2, 0.7), (0.4, 0.3)]) for a, p in enumerate(ps, 1)], "chrom string, pos bigint, alt int, hap bigint, p double, typed boolean")
    g = impute.genotypes(probs)
    r = g.select("gt", "ds", impute.sample_text(True, True).alias("t")).first()
    assert r.gt == "2|1" and r.ds == pytest.approx([0.6, 1.0])
    fields = r.t.split(":")
    assert len(fields) == 5 and [float(x) for x in fields[2].split(",")] == pytest.approx([0.03, 0.1, 0.08, 0.24, 0.34, 0.21], abs=1e-3)
    q = impute.site_report(probs).first()
    assert q.af == pytest.approx([0.3, 0.5]) and all(0 <= x <= 1 for x in q.dr2)


def test_batches_of_the_small_model_follow_length_and_rows(spark):
    from loomgene.operators import hmm

    size = {0: 5000, **{s: 2 + s % 40 for s in range(1, 400)}}
    rows = spark.createDataFrame([(s, p, (s + p // 3) % 2) for s, n in size.items() for p in range(n)], "sample bigint, pos bigint, o int")
    groups = {}
    for r in hmm.like_lengths(rows, 1000).groupBy("size", "alone", "batch").agg(F.collect_set("sample").alias("s")).collect():
        groups[(r.size, r.alone, r.batch)] = r.s
    assert sorted(x for g in groups.values() for x in g) == sorted(size)
    assert [g for g in groups.values() if 0 in g] == [[0]] and len(groups) > 8
    for g in groups.values():
        assert max(size[s] for s in g) * len(g) <= 2 * sum(size[s] for s in g) and (g == [0] or sum(size[s] for s in g) < 3000)
    few, many = ({(r.sample, r.pos): r[2:] for r in hmm.two_state(rows, batch_rows=b).collect()} for b in (1000, 1 << 30))
    assert few.keys() == many.keys() and len(few) == sum(size.values())
    assert all(abs(x - y) < 1e-9 for k in few for x, y in zip(few[k], many[k]))
