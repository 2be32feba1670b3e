"""Genotype text and allele expressions; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest allele number; larger ones are missing.
MOST = 254
CALL = "struct<a1:int,a2:int,phased:boolean,haploid:boolean>"


def allele(token: Column) -> Column:
    """An allele number, or NULL for `.`, text and numbers above MOST."""
    n = F.when(token.rlike(r"^[0-9]{1,9}$"), token.cast("int"))
    return F.when(n <= MOST, n)


def decode_gt(gt: Column) -> Column:
    """A GT field as CALL. `.`, `./.` and `.|.` are missing and phased; if one allele is missing both
    are, unphased; one part is a haploid call given twice; more than two parts are missing."""
    parts = F.split(gt, r"[|/]")
    a, b = allele(F.get(parts, F.lit(0))), allele(F.get(parts, F.lit(1)))
    n = F.size(parts)
    none = F.lit(None).cast("int")

    def call(x: Column, y: Column, phased: Column, haploid: bool) -> Column:
        return F.struct(x.alias("a1"), y.alias("a2"), phased.alias("phased"), F.lit(haploid).alias("haploid"))

    return (
        F.when(gt.isNull() | gt.isin("", ".", "./.", ".|."), call(none, none, F.lit(True), False))
        .when(n == 1, call(a, a, F.lit(True), True))
        .when((n != 2) | a.isNull() | b.isNull(), call(none, none, F.lit(False), False))
        .otherwise(call(a, b, F.contains(gt, F.lit("|")), False))
    )


def complement(bases: Column) -> Column:
    """A<->T and C<->G."""
    return F.translate(bases, "ACGT", "TGCA")


def is_snv(ref: Column, alts: Column) -> Column:
    """All alleles are single bases."""
    return ref.rlike("^[ACGT]$") & (F.size(alts) > 0) & F.forall(alts, lambda x: x.rlike("^[ACGT]$"))


def is_strand_ambiguous(ref: Column, alts: Column) -> Column:
    """A biallelic site whose alleles are each other's complements (A/T, C/G)."""
    return (F.size(alts) == 1) & is_snv(ref, alts) & (complement(ref) == F.get(alts, F.lit(0)))


def clean_allele(text: Column) -> Column:
    """An allele's text in upper case, or NULL for missing and symbolic ones."""
    up = F.upper(text)
    return F.when(~up.isin(".", "*", "N", "<*>", "<NON_REF>", ""), up)


def normal_chrom(chrom: Column) -> Column:
    """A chromosome name without its prefix `chr` in any case."""
    return F.regexp_replace(chrom, "(?i)^chr", "")


def chrom_aliases(chrom: str) -> list[str]:
    """Names under which a chromosome may be listed."""
    bare = chrom[3:] if chrom.lower().startswith("chr") else chrom
    return list(dict.fromkeys([chrom, bare, f"chr{bare}", f"CHR{bare}"]))


def genotype_index(a: Column, b: Column) -> Column:
    """Place of the unordered genotype among all: hi (hi + 1) / 2 + lo."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return (F.floor(hi * (hi + 1) / 2) + lo).cast("int")


def gl_confidence(gl: Column, a1: Column, a2: Column) -> Column:
    """Confidence 0..255 of a call from log10 likelihoods `x,y,z...`; 255 where they say nothing.

    They say nothing with fewer than three finite values, a missing call, a call outside them, or the
    best two within 1e-6. A call that is not the best gets 10 (1 + its value - the best), rounded down
    and at least 0; the best gets 255 (1 - exp(-1.5 gap)), cut to 1..255 and rounded down.
    """
    raw = F.transform(F.split(gl, ","), lambda x: x.try_cast("double"))
    finite = F.filter(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))
    own = F.get(raw, genotype_index(a1, a2))
    top = F.slice(F.sort_array(finite, False), 1, 2)
    best, gap = F.get(top, F.lit(0)), F.get(top, F.lit(0)) - F.get(top, F.lit(1))
    worse = F.greatest(F.lit(0), F.floor(10 * (1 + own - best))).cast("int")
    good = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(1.0), 255 * (1 - F.exp(-1.5 * gap))))).cast("int")
    usable = gl.isNotNull() & (F.size(finite) >= 3) & a1.isNotNull() & a2.isNotNull() & own.isNotNull() & (gap >= 1e-6)
    return F.when(~F.coalesce(usable, F.lit(False)), 255).when(own < best, worse).otherwise(good)


def format_4dp(x: Column) -> Column:
    """Text of a number cut (not rounded) to four decimals without trailing zeros; 0.0000 if not finite."""
    cut = F.when(x < 0, F.ceil(x * 10000)).otherwise(F.floor(x * 10000))
    whole, part = F.floor(F.abs(cut) / 10000).cast("bigint"), F.abs(cut) % 10000
    digits = F.regexp_replace(F.lpad(part.cast("bigint").cast("string"), 4, "0"), "0+$", "")
    text = F.concat(F.when((x < 0) & (cut != 0), "-").otherwise(""), whole.cast("string"), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 1e300), F.lit("0.0000")).otherwise(text)


def hard_call(p1: Column, p2: Column) -> tuple[Column, Column]:
    """Most probable alleles of two haplotypes from their ALT probabilities; a tie is ALT."""
    return (p1 >= 0.5).cast("int"), (p2 >= 0.5).cast("int")


def genotype_probabilities(ap1: Column, ap2: Column) -> Column:
    """Unordered genotype probabilities in the order (0,0), (0,1), (1,1), (0,2) ... from two allele distributions."""
    n = F.size(ap1)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: F.when(i == j, F.get(ap1, i) * F.get(ap2, i)).otherwise(F.get(ap1, i) * F.get(ap2, j) + F.get(ap1, j) * F.get(ap2, i)))))
    return F.when(n > 0, pairs)
