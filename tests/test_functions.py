"""Scalar functions and configuration against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from loomgene.config import Config
from loomgene.functions import genotype as gt
from loomgene.functions import model


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)


@pytest.mark.parametrize(
    "text,call",
    [("0/1", (0, 1, False, False)), ("1|2", (1, 2, True, False)), ("0", (0, 0, True, True)), ("./.", (None, None, True, False)), (".", (None, None, True, False)), (".|.", (None, None, True, False)), ("./1", (None, None, False, False)), ("0|.", (None, None, False, False)), ("0/1/1", (None, None, False, False)), ("255|0", (None, None, False, False)), ("254|0", (254, 0, True, False)), ("x/1", (None, None, False, False)), ("", (None, None, True, False))],
)
def test_decode_gt(spark, text, call):
    got = one(spark, g=text).select(gt.decode_gt(F.col("g")).alias("c")).first().c
    assert tuple(got) == call


@pytest.mark.parametrize(
    "gl,a1,a2,conf",
    [("0,-1,-2", 0, 0, math.floor(255 * (1 - math.exp(-1.5)))), ("-1,0,-2", 0, 0, 0), ("-0.5,0,-2", 0, 0, 5), ("0,0,-2", 0, 0, 255), ("0,-1", 0, 0, 255), ("0,-1,-2", None, 0, 255), ("0,-1,.", 0, 0, 255), ("0,-1,-2", 2, 2, 255), (None, 0, 0, 255), ("-0.0001,-30,0,-9,-9,-9", 1, 1, 1), ("0,-900,-900", 0, 0, 255)],
)
def test_gl_confidence(spark, gl, a1, a2, conf):
    df = spark.createDataFrame([(gl, a1, a2)], "gl string, a1 int, a2 int")
    assert df.select(gt.gl_confidence(F.col("gl"), F.col("a1"), F.col("a2"))).first()[0] == conf


@pytest.mark.parametrize("x,text", [(0.0, "0"), (1.0, "1"), (0.5, "0.5"), (0.12349, "0.1234"), (1.99999, "1.9999"), (float("nan"), "0.0000"), (float("inf"), "0.0000"), (-0.25, "-0.25"), (0.00001, "0"), (12.3, "12.3")])
def test_format_cuts(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(gt.format_4dp(F.col("x"))).first()[0] == text


def test_alleles_and_names(spark):
    df = spark.createDataFrame([("A", ["T"]), ("A", ["C"]), ("AT", ["C"]), ("A", ["C", "G"]), ("A", [])], "r string, a array<string>")
    got = df.select(gt.is_snv(F.col("r"), F.col("a")).alias("s"), gt.is_strand_ambiguous(F.col("r"), F.col("a")).alias("m")).collect()
    assert [tuple(x) for x in got] == [(True, True), (True, False), (False, False), (True, False), (False, False)]
    assert gt.chrom_aliases("chr1") == ["chr1", "1", "CHR1"] and gt.chrom_aliases("X") == ["X", "chrX", "CHRX"]
    t = spark.createDataFrame([("a",), ("*",), ("<NON_REF>",), (".",), ("N",)], "x string")
    assert [r[0] for r in t.select(gt.clean_allele(F.col("x"))).collect()] == ["A", None, None, None, None]


def test_genotype_probabilities(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.5, 0.5]), ([0.2, 0.3, 0.5], [1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    two, three = (r[0] for r in df.select(gt.genotype_probabilities(F.col("a"), F.col("b"))).collect())
    assert two == pytest.approx([0.1, 0.5, 0.4]) and three == pytest.approx([0.2, 0.3, 0, 0.5, 0, 0])


def test_model_values(spark):
    assert model.recombination_intensity(1e6, 1000) == pytest.approx(40)
    assert model.mismatch_probability(1) == 1e-4
    theta = 1 / (math.log(100) + 0.5)
    assert model.mismatch_probability(100) == pytest.approx(theta / (2 * (theta + 100)))
    assert model.lr_threshold(0, 6, 12) == math.inf and model.lr_threshold(17, 6, 12) == 1
    steps = [model.lr_threshold(i, 6, 12) for i in range(6, 18)]
    assert steps[0] == pytest.approx(1e4) and steps == sorted(steps, reverse=True)
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 8, 9, 16)], "n int").select(model.bits_per_allele(F.col("n"))).collect()
    assert [r[0] for r in n] == [0, 0, 1, 2, 2, 3, 3, 4, 4]
    hit, miss = spark.range(1).select(*model.log_emissions(F.lit(1.0), 0.01)).first()
    assert hit == pytest.approx(math.log(0.99)) and miss == pytest.approx(math.log(0.01))


def test_config(tmp_path):
    (tmp_path / "a.vcf").write_text("")
    ok = dict(gt=str(tmp_path / "a.vcf"), out=str(tmp_path / "out"))
    Config(**ok).validate()
    for bad in (dict(window=1.0, overlap=1.0), dict(ne=0.0), dict(err=0.7), dict(iterations=0)):
        with pytest.raises(ValueError):
            Config(**ok, **bad).validate()
    with pytest.raises(ValueError):
        Config(gt=ok["gt"], out=str(tmp_path)).validate()
    with pytest.raises(FileNotFoundError):
        Config(gt=str(tmp_path / "none"), out="x").validate()
