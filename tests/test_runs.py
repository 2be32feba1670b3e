"""Runs from files to files."""

import gzip

import numpy as np
import pytest

from loomgene.config import Config
from loomgene.plans import run
from loomgene.sources import bref3, vcf


def write_vcf(path, rows, samples, missing=()):
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    lines += ["\t".join([c, str(p), f"rs{p}", r, a, ".", "PASS", ".", "GT", *g]) for c, p, r, a, g in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A panel of two founders over two chromosomes, and two samples typed at every fourth site with alleles swapped or flipped."""
    d = tmp_path_factory.mktemp("run")
    founders = np.random.default_rng(1).integers(0, 2, (80, 2))
    founders[:, 1] = 1 - founders[:, 0]
    place = [("chr1" if i < 40 else "chr2", 1000 * (i % 40) + 1) for i in range(80)]
    ref = [(c, p, "A", "G", [f"{founders[i, 0]}|{founders[i, 1]}"] * 10) for i, (c, p) in enumerate(place)]
    write_vcf(d / "ref.vcf", ref, [f"r{k}" for k in range(10)])
    (d / "ref.bref3").write_bytes(bref3.write_bytes([f"r{k}" for k in range(10)], [[(c, p, None, "A", ["G"], None, [int(x) for x in founders[i].tolist() * 10]) for i, (c, p) in enumerate(place) if c == ch] for ch in ("chr1", "chr2")]))
    gts = lambda i, sep: [f"{founders[i, 0]}{sep}{founders[i, 0]}", f"{min(founders[i])}{sep}{max(founders[i])}" if sep == "/" else f"{founders[i, 0]}{sep}{founders[i, 1]}"]
    target = []
    for i, (c, p) in enumerate(place):
        if i % 4 == 0:
            g = gts(i, "/")
            ref_, alt = [("A", "G"), ("T", "C"), ("G", "A")][i // 4 % 3]
            if ref_ == "G":
                g = [x.translate(str.maketrans("01", "10")) for x in g]
            target.append((c.removeprefix("chr"), p, ref_, alt, g))
    write_vcf(d / "gt.vcf", target, ["s1", "s2"])
    write_vcf(d / "truth.vcf", [(c, p, "A", "G", gts(i, "|")) for i, (c, p) in enumerate(place)], ["s1", "s2"])
    (d / "map").write_text("".join(f"{c} {p} 0 {p / 1e6}\n" for c in ("1", "2") for p in (1, 20_000, 50_000)))
    return d


def read(path):
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part"))
    return b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode().strip().split("\n")


@pytest.mark.parametrize("ref", ["ref.vcf", "ref.bref3"])
def test_impute_and_evaluate(spark, files, tmp_path, ref):
    c = Config(gt=str(files / "gt.vcf"), ref=str(files / ref), out=str(tmp_path / "out"), map_path=str(files / "map"), ne=1e4, gp=True, ap=True)
    out = run.impute_file(spark, c)
    lines = read(tmp_path / "out.vcf.gz")
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert len(body) == 80 and all(x[8] == "GT:DS:GP:AP1:AP2" and len(x) == 11 for x in body)
    assert sum(";IMP" in x[7] for x in body) == 60 and all(x[7].startswith("DR2=") for x in body)
    got = run.evaluate(spark, str(files / "truth.vcf"), out)
    assert got["overall"].first().concordance == 1.0 and got["overall"].first().n == 160
    assert {r.state: r["count"] for r in got["sites"].collect()} == {"compared": 80}
    assert all(r.switches == 0 for r in got["switches"].collect())
    assert got["by_chrom_and_bin"].where("level = 'all'").count() == 1 and got["by_sample"].count() == 2


def test_phase_file_with_exclusions(spark, files, tmp_path):
    (tmp_path / "no").write_text("s1\n")
    (tmp_path / "nom").write_text("rs1\n")
    c = Config(gt=str(files / "truth.vcf"), out=str(tmp_path / "p"), exclude_samples=str(tmp_path / "no"), exclude_markers=str(tmp_path / "nom"), chrom="1")
    run.phase_file(spark, c)
    lines = read(tmp_path / "p.vcf.gz")
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert len(body) == 39 and {x[0] for x in body} == {"chr1"} and lines[1] == "##contig=<ID=chr1>"
    assert all(x[9].count("|") == 1 for x in body) and sum(x.startswith("#CHROM") and x.endswith("s2") and "s1" not in x for x in lines) == 1


def test_phase_with_reference(spark, files, tmp_path):
    c = Config(gt=str(files / "gt.vcf"), ref=str(files / "ref.vcf"), out=str(tmp_path / "q"), burnin=3, iterations=3, ne=1e4)
    run.phase_file(spark, c)
    t = vcf.calls(vcf.lines(spark, str(tmp_path / "q.vcf.gz")))
    assert t.count() == 40 and t.where("not phased or a1 is null").count() == 0


def test_several_records_at_one_place(spark, files, tmp_path):
    """Split multiallelic sites and an insertion beside a base change: all are imputed or phased, and written in order."""
    ref = []
    for i in range(30):
        a = [f"{(i + k) % 2}|{k % 2}" for k in range(8)]
        b = [f"{k % 2}|{(i + k) % 2}" for k in range(8)]
        ref.append(("1", 1000 * i + 1, "A", "G", a))
        if i % 5 == 2:
            ref += [("1", 1000 * i + 1, "A", "T", b), ("1", 1000 * i + 1, "A", "AT", a)]
    write_vcf(tmp_path / "ref.vcf", ref, [f"r{k}" for k in range(8)])
    target = [("1", p, r, x, [g[0], g[3]]) for c, p, r, x, g in ref if p % 2000 == 1 and x != "AT"]
    write_vcf(tmp_path / "gt.vcf", target, ["s1", "s2"])
    run.impute_file(spark, Config(gt=str(tmp_path / "gt.vcf"), ref=str(tmp_path / "ref.vcf"), out=str(tmp_path / "i"), ne=1e4))
    body = [x.split("\t") for x in read(tmp_path / "i.vcf.gz") if not x.startswith("#")]
    assert [(int(x[1]), x[3], x[4]) for x in body] == sorted((p, r, x) for _, p, r, x, _ in ref)
    run.phase_file(spark, Config(gt=str(tmp_path / "gt.vcf"), out=str(tmp_path / "p"), burnin=1, iterations=1))
    body = [x.split("\t") for x in read(tmp_path / "p.vcf.gz") if not x.startswith("#")]
    assert [(int(x[1]), x[3], x[4]) for x in body] == sorted((p, r, x) for _, p, r, x, _ in target)
    given = {(p, x): g for _, p, _, x, g in target}
    assert all([sorted(a) for a in x[9:]] == [sorted(a) for a in given[int(x[1]), x[4]]] for x in body)
