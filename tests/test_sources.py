"""Files: VCF text, genetic maps, lists and binary panels."""

import gzip
import io

import pytest

from loomgene.sources import bref3, text, vcf, writers

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
chr1\t100\trs1\tA\tC\t.\tPASS\t.\tGT\t0/1\t1|1\t./.
chr1\t200\t.\tA\tC,G\t.\tPASS\tAC=1;END=250\tDP:GT:GL\t9:0|2:0,-1,-2,-3,-4,-5\t9:0:.\t3:.
chr1\t300\trs3\tA\t<NON_REF>\t.\tPASS\tXEND=5\tDP\t1\t2\t3
2\t50\trs4\tAT\tA\t.\tPASS\tEND=9\tGT:DS\t1|0:1.0\t0/0\t0/1
"""


@pytest.fixture()
def path(tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    return str(tmp_path / "a.vcf")


def test_vcf(spark, path, tmp_path):
    t = vcf.lines(spark, path)
    assert [r.sample_id for r in vcf.samples(t).orderBy("sample_idx").collect()] == ["s1", "s2", "s3"]
    s = {r.pos: r for r in vcf.sites(t).collect()}
    assert s[200].alts == ["C", "G"] and s[200].end == 250 and s[200].id is None and s[300].end is None and s[300].alts == [] and s[50].end == 9
    got = {(r.pos, r.sample_id): (r.a1, r.a2, r.phased, r.haploid, r.conf) for r in vcf.calls(t).collect()}
    assert len(got) == 9
    assert got[100, "s1"] == (0, 1, False, False, 255) and got[100, "s3"][:2] == (None, None)
    assert got[200, "s1"] == (0, 2, True, False, 0) and got[200, "s2"] == (0, 0, True, True, 255)
    assert {r.sample_id: r.is_diploid for r in vcf.ploidy(vcf.calls(t)).collect()} == {"s1": True, "s2": False, "s3": True}
    assert vcf.region(vcf.sites(t), "1", 100, 200).count() == 2
    drop = spark.createDataFrame([("s2",)], "name string")
    left = vcf.calls(t, exclude_samples=drop, exclude_markers=spark.createDataFrame([("rs1",)], "name string")).collect()
    assert {(r.sample_idx, r.sample_id) for r in left} == {(0, "s1"), (1, "s3")} and {r.pos for r in left} == {200, 50}
    info = vcf.records(t).select(vcf.info_map("info").alias("i")).collect()
    assert info[1].i == {"AC": "1", "END": "250"}
    raw = gzip.compress(VCF.encode())
    (tmp_path / "b.vcf.gz").write_bytes(raw)
    (tmp_path / "c.vcf.bgz").write_bytes(raw[: len(raw)] + gzip.compress(b""))
    assert vcf.calls(vcf.lines(spark, str(tmp_path / "b.vcf.gz"))).count() == vcf.calls(vcf.lines(spark, str(tmp_path / "c.vcf.bgz"))).count() == 9
    assert not vcf.is_block_gzip(raw[:40])
    assert vcf.is_block_gzip(b"\x1f\x8b\x08\x04" + bytes(6) + b"\x06\x00BC\x02\x00\x1b\x00")


def test_vcf_without_rows(spark, tmp_path):
    (tmp_path / "e.vcf").write_text("\n".join(VCF.split("\n")[:2]) + "\n")
    assert vcf.calls(vcf.lines(spark, str(tmp_path / "e.vcf"))).count() == 0


def test_written_vcf_is_one_file_in_order(spark, path, tmp_path):
    t = vcf.lines(spark, path)
    c = vcf.calls(t)
    cells = c.select("chrom", "pos", "sample_idx", writers.gt_text(c.a1, c.a2).alias("text"))
    rows = writers.rows(vcf.sites(t), cells)
    writers.write_vcf(rows, writers.header(["s1", "s2", "s3"], ["chr1", "2"]), str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    text_ = b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode().strip().split("\n")
    assert text_[0] == "##fileformat=VCFv4.2" and sum(x.startswith("#CHROM") for x in text_) == 1
    body = [x.split("\t") for x in text_ if not x.startswith("#")]
    assert [(x[0], x[1], x[9:]) for x in body] == [("2", "50", ["1|0", "0|0", "0|1"]), ("chr1", "100", ["0|1", "1|1", ".|."]), ("chr1", "200", ["0|2", "0|0", ".|."])]
    assert writers.summary({"a": 0.5, "b": None, "c": 3}).count("|") == 15


def test_genetic_map(spark, tmp_path):
    p = tmp_path / "m.map"
    p.write_text("# c\n\nchr1 1000000 0 0.0\nchr1 2000000\t1 1.0\nchr1 3000000 1.5 2.5\n")
    assert [(r.pos, r.cm) for r in text.genetic_map(spark, str(p)).orderBy("pos").collect()] == [(1000000, 0.0), (2000000, 1.0), (3000000, 2.5)]
    for bad in ("chr1 5 0 0\nchr1 5 0 1\n", "chr1 5 0\n", "chr1 x 0 1\n", "chr1 5 0 NaN\n"):
        p.write_text(bad)
        with pytest.raises(Exception, match="genetic map"):
            text.genetic_map(spark, str(p)).collect()


def test_lists(spark, tmp_path):
    (tmp_path / "l").write_text("a\n# no\n\n b \na\n")
    assert sorted(r.name for r in text.names(spark, str(tmp_path / "l")).collect()) == ["a", "b"]
    (tmp_path / "g").write_text("CHROM\tPOS\n1\t5\nchr1\t6\n2\t7\n")
    assert sorted(r.pos for r in text.array_sites(spark, str(tmp_path / "g"), "chr1").collect()) == [5, 6]


def test_binary_panel_round_trip(spark, tmp_path):
    rows = [("chr1", 100, "rs1", "A", ["C"], None, [0, 1, 0, 0, 0, 0, 0, 0, 0, 0]), ("chr1", 200, None, "G", ["T", "A"], None, [0, 1, 2, 0, 1, 2, 0, 0, 1, 1]), ("chr1", 300, "é\0𝄞", "AT", ["A"], None, [1] * 10), ("chr1", 400, None, "A", ["<DEL>"], 450, [0] * 10)]
    more = [("2", 7, None, "T", [], None, [0] * 10)]
    data = bref3.write_bytes(list("abcde"), [rows, more])
    stream = io.BytesIO(data)
    assert bref3.read_header(stream) == list("abcde")
    assert [r for b in bref3.read_blocks(stream, 10) for r in b] == [*rows, *more]
    (tmp_path / "p.bref3").write_bytes(data)
    df = bref3.read(spark, str(tmp_path / "p.bref3"))
    assert sorted((r.chrom, r.pos, r.alleles) for r in df.collect()) == sorted((r[0], r[1], r[6]) for r in [*rows, *more])
    assert bref3.haplotypes(df).count() == 50
    with pytest.raises(ValueError):
        bref3.read_header(io.BytesIO(b"\0" * 8))
    with pytest.raises(EOFError):
        stream = io.BytesIO(data[:-30])
        bref3.read_header(stream)
        list(bref3.read_blocks(stream, 10))


def test_stream_of_files_equals_batch(spark, path, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(path, tmp_path / "in" / "a.vcf")
    stream = vcf.records(vcf.stream_lines(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("vcf_records").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.pos for r in spark.table("vcf_records").collect()) == [50, 100, 200, 300]


@pytest.mark.parametrize("heads", [0, 2])
def test_a_vcf_file_needs_one_header(spark, tmp_path, heads):
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s"])
    (tmp_path / "x.vcf").write_text("\n".join([head] * heads + ["1\t5\t.\tA\tG\t.\t.\t.\tGT\t0|1"]) + "\n")
    with pytest.raises(Exception, match="#CHROM"):
        vcf.calls(vcf.lines(spark, str(tmp_path / "x.vcf"))).collect()
