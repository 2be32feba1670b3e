"""What must not grow with a table: broadcast sides, a task's groups, a kernel's memory."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from loomgene import fixtures as fx
from loomgene.operators import ibs2, pbwt
from loomgene.plans import catalog
from tests.compare import duck, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


def _under(plan: str, node: str) -> list[str]:
    """Of each such node of a plan its text with what lies below it."""
    rows, out = plan.splitlines(), []
    depth = lambda r: len(r) - len(r.lstrip(" :+-*()0123456789"))
    for i, r in enumerate(rows):
        if r.lstrip(" :+-*()0123456789").startswith(node):
            end = next((j for j in range(i + 1, len(rows)) if depth(rows[j]) <= depth(r)), len(rows))
            out.append("\n".join(rows[i:end]))
    return out


def _plans(spark, name, monkeypatch) -> list[str]:
    """Plans of all that a query runs, its result's last."""
    kind, seen = type(spark.range(1)), []
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for f in ("checkpoint", "collect", "count"):
        monkeypatch.setattr(kind, f, lambda self, *a, f=getattr(kind, f), **k: (seen.append(text(self)), f(self, *a, **k))[1])
    last = text(catalog.QUERIES[name](spark, FOLDER))
    return [*seen, last]


@pytest.mark.parametrize(
    "name",
    ["allele_mass", "carrier_share", "composite_haplotypes", "reversed_alleles", "sorted_neighbours", "imputed_site_quality", "phased_genotypes", "phased_with_panel", "carriers_intersect", "pattern_mass", "maf_lookup", "vcf_rows", "overlap_vote", "shared_segments", "extended_segments"],
)
def test_no_large_side_is_broadcast(spark, monkeypatch, name):
    """Spark's estimates don't count exploded rows; only windows, chromosomes' ends and a header's names may be sent whole."""
    for plan in _plans(spark, name, monkeypatch):
        for side in _under(plan, "BroadcastExchange"):
            if "out_first" not in side and "lo#" not in side:  # a row per window, and per chromosome
                assert not any(x in side for x in ("Generate", "FileScan", "ExistingRDD[")) or "_i#" in side


def test_calls_are_not_grouped_after_they_are_listed(spark):
    plan = fx.calls(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert all("HashAggregate" in x and "Exchange" in x for x in _under(plan, "Generate")) and not any("Generate" in x for x in _under(plan, "HashAggregate"))


def test_tasks_that_list_calls_follow_the_markers(spark, tmp_path):
    """The shuffled bytes of 45,000 markers are one task's to Spark; the rows listed from them are not."""
    part = spark.read.parquet(f"{FOLDER}/part.parquet").toPandas()
    n = -(-45_000 // len(part))
    part = part.loc[part.index.repeat(n)].assign(p_partkey=range(n * len(part)))
    part.to_parquet(tmp_path / "part.parquet")
    for relation, each in ((fx.calls, fx.TARGET // 2), (fx.target, fx.TARGET), (fx.panel, fx.PANEL)):
        rows = [r.n for r in relation(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(rows) == len(part) * each and max(rows) < 1.2 * 20_000 * each


def test_no_task_numbers_a_chromosome(spark, monkeypatch):
    """Steps are cut by a site's number in its chromosome; what is numbered together is a bucket of positions."""
    numbered = [x.splitlines()[0] for plan in _plans(spark, "shared_steps", monkeypatch) for x in _under(plan, "Window") if "row_number" in x.splitlines()[0]]
    assert numbered and all("_b#" in x for x in numbered)


@pytest.mark.parametrize("bucket", [1, 10, 1 << 20])
def test_steps_across_buckets(spark, bucket):
    sites = [(c, p * 10**9 if c == "b" else p) for c, n in (("a", 35), ("b", 9), ("c", 1)) for p in range(-3, n)]
    want = {(c, p, i // 4) for k in "abc" for i, (c, p) in enumerate(sorted(x for x in sites if x[0] == k))}
    found = ibs2.numbered_steps(spark.createDataFrame(sites[::-1], "chrom string, pos bigint"), 4, bucket)
    assert {tuple(r) for r in found.collect()} == want and found.schema["step"].dataType.typeName() == "long"


def test_repeated_markers_give_a_call_once(spark, tmp_path):
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    part.union(part.where("p_partkey % 3 = 0")).coalesce(1).toPandas().to_parquet(tmp_path / "part.parquet")
    for name in ("typed_calls", "allele_counts", "call_status"):
        assert rows_of(catalog.QUERIES[name](spark, str(tmp_path))) == rows_of_sql(duck(tmp_path), catalog.ORACLE[name])


@pytest.mark.parametrize("name", ["vcf_rows", "vcf_round_trip", "excluded_calls", "streamed_calls"])
def test_positions_beyond_32_bits(spark, tmp_path, name):
    """Positions follow the keys of part: at 360 x sf0.1 they pass 7e9."""
    part = spark.read.parquet(f"{FOLDER}/part.parquet").toPandas()
    part.assign(p_partkey=part.p_partkey + [2_147_000 + 7 * k for k in range(len(part))]).to_parquet(tmp_path / "part.parquet")
    found = rows_of(catalog.QUERIES[name](spark, str(tmp_path)))
    assert found[1] and found == rows_of_sql(duck(tmp_path), catalog.ORACLE[name])


@pytest.mark.parametrize("shape", [(25, 40), (25, 41), (9, 7), (3, 2), (4, 1), (12, 100)])
def test_picks_of_all_ranks_are_those_of_each(shape):
    rng = np.random.default_rng(sum(shape))
    a = rng.choice([0, 1, 255], shape, p=[0.6, 0.35, 0.05]).astype(np.uint8)
    as_lists = lambda found: [found[1][found[0] == p].tolist() for p in range(a.size)]
    at, orders, starts = map(np.array, zip(*pbwt.sweep(a)))
    each = [(m, order, start, r) for m, order, start in zip(at, orders, starts) for r in range(shape[1])]
    assert as_lists(pbwt.neighbours_of_all(orders, starts, 5)) == [pbwt.neighbours(o, s, m, r, 5) for m, o, s, r in each]
    assert [sorted(x) for x in as_lists(pbwt.spirals(orders, 6))] == [pbwt.spiral(o, r, 6) for _, o, _, r in each]
    for back in (0, 2, 5):
        from_ = np.maximum(0, at - back)
        assert [sorted(x) for x in as_lists(pbwt.match_blocks(orders, starts, from_, 1))] == [pbwt.match_block(o, s, from_[m], r, 1) for m, o, s, r in each]
    assert pbwt.match_spans(a).tolist() == [[pbwt.match_span(a, h, m, [h ^ 1]) for h in range(shape[1])] for m in range(shape[0])]


@pytest.mark.parametrize("shape", [(5, 25, 40), (3, 9, 7), (4, 1, 3), (2, 6, 1)])
def test_spans_come_from_both_sorts(monkeypatch, shape):
    """Matches are read off the starts of the forward and the backward sort, not found by comparing all pairs."""
    walked = []
    for name in ("sweep", "backward_sweep"):
        monkeypatch.setattr(pbwt, name, lambda a, name=name, walk=getattr(pbwt, name): walked.append(name) or walk(a))
    a = np.random.default_rng(sum(shape)).choice([0, 1, 255], shape, p=[0.6, 0.35, 0.05]).astype(np.uint8)
    each = [[[pbwt.match_span(x, h, m, [h ^ 1]) for h in range(shape[2])] for m in range(shape[1])] for x in a]
    assert [pbwt.match_spans(x).tolist() for x in a] == each and {"sweep", "backward_sweep"} <= set(walked)
    assert pbwt.side_by_side(a).tolist() == each


def test_spans_of_many_haplotypes_grow_with_them():
    def took(n):
        a = np.random.default_rng(n).integers(0, 2, (60, n)).astype(np.uint8)
        began = time.process_time()
        pbwt.match_spans(a)
        return time.process_time() - began

    took(200)
    assert took(2400) < 8 * took(600)


def test_picks_of_all_ranks_are_quicker_than_one_by_one():
    a = np.random.default_rng(1).integers(0, 2, (25, 40)).astype(np.uint8)

    def took(f):
        began = time.process_time()
        for _ in range(5):
            f()
        return time.process_time() - began

    assert took(lambda: pbwt.match_spans(a)) * 3 < took(lambda: [pbwt.match_span(a, h, m, [h ^ 1]) for h in range(40) for m in range(25)])
    at, orders, starts = map(np.array, zip(*pbwt.sweep(a)))
    ranks = [(m, r) for m in at for r in range(40)]
    assert took(lambda: pbwt.neighbours_of_all(orders, starts, 5)) * 3 < took(lambda: [pbwt.neighbours(orders[m], starts[m], m, r, 5) for m, r in ranks])
    assert took(lambda: pbwt.match_blocks(orders, starts, np.maximum(0, at - 5), 4)) * 3 < took(lambda: [pbwt.match_block(orders[m], starts[m], max(0, m - 5), r, 4) for m, r in ranks])


def test_binary_panel_is_cut_into_files(spark, tmp_path, monkeypatch):
    """Two sites a file: those of one position may fill several, whose names must not clash."""
    import os

    from loomgene.sources import bref3

    monkeypatch.setattr(bref3, "CELLS", 8)
    monkeypatch.setattr(bref3, "BLOCK", 1)
    rows = [("chr1", p, "A", [alt], [p % 2, 1, 0, int(alt == "T")]) for p in range(1, 21) for alt in ("C", "G", "T", "CA", "CC", "CG")[: 1 + 5 * (p % 5 == 0)]]
    bref3.write(spark.createDataFrame(rows, "chrom string, pos int, ref string, alts array<string>, alleles array<int>").coalesce(1), ["a", "b"], f"file://{tmp_path}/p")
    found = bref3.read(spark, f"file://{tmp_path}/p").select("chrom", "pos", "ref", "alts", "alleles").collect()
    assert sorted(map(tuple, found)) == sorted(rows) and len([x for x in os.listdir(tmp_path / "p") if x.endswith(".bref3")]) >= 18
