"""Sinks: VCF text, metrics as JSON and a summary as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import format_4dp
from ..operators.joins import many


def header(sample_ids: list[str], contigs: list[str], imputed: bool = False, gp: bool = False, ap: bool = False) -> list[str]:
    """Lines of a VCF header."""
    out = ["##fileformat=VCFv4.2", *[f"##contig=<ID={c}>" for c in contigs]]
    if imputed:
        out += ['##INFO=<ID=DR2,Number=A,Type=Float,Description="Estimated squared correlation of true and estimated ALT dose">', '##INFO=<ID=AF,Number=A,Type=Float,Description="Estimated ALT frequency">', '##INFO=<ID=IMP,Number=0,Type=Flag,Description="Imputed marker">']
    out.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
    if imputed:
        out.append('##FORMAT=<ID=DS,Number=A,Type=Float,Description="ALT dose">')
    if imputed and gp:
        out.append('##FORMAT=<ID=GP,Number=G,Type=Float,Description="Genotype probability">')
    if imputed and ap:
        out += [f'##FORMAT=<ID=AP{k},Number=A,Type=Float,Description="ALT probability of haplotype {k}">' for k in (1, 2)]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *sample_ids])]


def gt_text(a1, a2, phased: bool = True):
    """`a|b` with `.` for a missing allele."""
    t = lambda a: F.coalesce(a.cast("string"), F.lit("."))
    return F.concat_ws("|" if phased else "/", t(a1), t(a2))


def rows(sites: DataFrame, cells: DataFrame, form: str = "GT") -> DataFrame:
    """(chrom, pos, line): sites (chrom, pos, id, ref, alts, optionally info) and cells (chrom, pos, sample_idx, text).

    Where sites have a place (several records may share a position), cells name it instead of pos, and it takes pos's
    stead in the result, whose rows it orders.
    """
    key = "place" if "place" in sites.columns else "pos"
    by_site = cells.groupBy("chrom", key).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "text"))).alias("c"))
    info = F.coalesce(F.col("info"), F.lit(".")) if "info" in sites.columns else F.lit(".")
    alt = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", alt, F.lit("."), F.lit("PASS"), info, F.lit(form), F.array_join(F.transform("c", lambda x: x.text), "\t"))
    return sites.join(many(by_site), ["chrom", key]).select("chrom", F.col(key).alias("pos"), line.alias("line"))


def quality_info(af, dr2, imputed):
    """INFO text of an imputed site; af and dr2 are arrays with a value per ALT allele."""
    listed = lambda c: F.array_join(F.transform(c, format_4dp), ",")
    return F.concat(F.lit("DR2="), listed(dr2), F.lit(";AF="), listed(af), F.when(imputed, F.lit(";IMP")).otherwise(F.lit("")))


def write_vcf(lines: DataFrame, head: list[str], path: str, compression: str = "gzip") -> None:
    """A folder of parts in order, the header in the first; `cat` of the parts in name order is one VCF file.

    Rows are range-partitioned by place, so no task gets the whole file.
    """
    spark = lines.sparkSession
    top = spark.createDataFrame([("", -len(head) + i, x) for i, x in enumerate(head)], "chrom string, pos bigint, line string")
    body = lines.select("chrom", F.col("pos").cast("bigint").alias("pos"), "line")
    both = top.unionByName(body).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    both.select("line").write.text(path, compression=compression)


def write_json(metrics: DataFrame, path: str) -> None:
    metrics.write.json(path)


def summary(metrics: dict) -> str:
    """A Markdown table of names and values, numbers with four decimals."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| metric | value |", "| --- | --- |", *[f"| {k} | {show(v)} |" for k, v in metrics.items()]]) + "\n"
