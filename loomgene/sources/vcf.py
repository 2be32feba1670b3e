"""VCF text (plain, gzip, block gzip) as DataFrames.

The file is read by Spark's text source, so plain files are split over tasks; convert large gzip files
once to Parquet (write.parquet of `sites` and `calls`, partitioned by chromosome), which prunes columns
and pushes filters down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotype import clean_allele, decode_gt, gl_confidence


def is_block_gzip(head: bytes) -> bool:
    """Whether a file's first bytes are a gzip member with the subfield BC, as block gzip has; any gzip reader can read it."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return False
    size, at = int.from_bytes(head[10:12], "little"), 12
    while at + 4 <= min(len(head), 12 + size):
        if head[at : at + 2] == b"BC":
            return True
        at += 4 + int.from_bytes(head[at + 2 : at + 4], "little")
    return False


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a VCF file; names that end in .bgz are read as gzip."""
    if path.endswith(".bgz"):
        raw = spark.read.format("binaryFile").load(path).select("content")

        def unzip(batches):
            import gzip
            import io

            import pyarrow as pa

            for b in batches:
                for content in b.column(0).to_pylist():
                    with gzip.open(io.BytesIO(content), "rt") as f:
                        while part := f.readlines(1 << 22):
                            yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in part])], names=["value"])

        return raw.mapInArrow(unzip, "value string")
    return spark.read.text(path)


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """(value) of VCF files as they arrive in a folder; records() and decode_gt() work on it as on a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def samples(text: DataFrame) -> DataFrame:
    """(sample_idx, sample_id) from the #CHROM line; more than one such line, or none, is an error when rows are read."""
    heads = text.where("startswith(value, '#CHROM')").agg(F.collect_list("value").alias("v"))
    one = F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("a VCF file has one #CHROM line; found "), F.size("v").cast("string"))))
    return heads.select(F.posexplode(F.slice(F.split(one, "\t"), 10, 1 << 30))).select(F.col("pos").alias("sample_idx"), F.col("col").alias("sample_id"))


def records(text: DataFrame) -> DataFrame:
    """One row per site: chrom, pos, id, ref, alts, end (END= of INFO), format (list), fields (a list per sample)."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    body = text.where("value <> '' and not startswith(value, '#')")
    alts = F.filter(F.transform(F.split(at(4), ","), clean_allele), lambda x: x.isNotNull())
    end = F.regexp_extract(at(7), r"(?:^|;)END=(\d+)", 1).try_cast("bigint")
    return body.select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("pos"), F.when(at(2) != ".", at(2)).alias("id"), clean_allele(at(3)).alias("ref"), alts.alias("alts"), end.alias("end"), at(7).alias("info"), F.split(at(8), ":").alias("format"), F.slice(f, 10, 1 << 30).alias("fields"))


def info_map(info):
    """INFO as a map; flags have NULL values."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def field(name: str, cell: str = "field"):
    """A FORMAT sub-field of a sample by name; NULL if the record lacks it."""
    return F.get(F.split(F.col(cell), ":"), F.array_position("format", name).cast("int") - 1)


def sites(text: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, id, ref, alts, end) without the excluded ids; sites without an id stay."""
    s = records(text).select("chrom", "pos", "id", "ref", "alts", "end")
    return s if exclude is None else s.join(exclude, s.id == exclude.name, "left_anti")


def calls(text: DataFrame, exclude_samples: DataFrame | None = None, exclude_markers: DataFrame | None = None, with_gl: bool = True) -> DataFrame:
    """One row per site and sample: chrom, pos, id, ref, alts, end, sample_idx, sample_id, a1, a2, phased, haploid, conf.

    Records without GT are passed over. Excluded samples go by name and the others are numbered anew, so
    columns and names can't drift apart. A sample is haploid in all rows if any of its calls has one allele.
    """
    r = records(text).where(F.array_contains("format", "GT"))
    if exclude_markers is not None:
        r = r.join(exclude_markers, r.id == exclude_markers.name, "left_anti")
    long = r.select("*", F.posexplode("fields").alias("column", "field")).drop("fields")
    who = samples(text).withColumnRenamed("sample_idx", "column")
    if exclude_samples is not None:
        who = who.join(exclude_samples, who.sample_id == exclude_samples.name, "left_anti")
    who = who.selectExpr("column", "sample_id", "cast(row_number() over (order by column) - 1 as int) as sample_idx")  # the header's names only
    both = long.join(F.broadcast(who), "column").withColumn("g", decode_gt(field("GT")))
    conf = gl_confidence(field("GL"), F.col("g.a1"), F.col("g.a2")) if with_gl else F.lit(255)
    return both.select("chrom", "pos", "id", "ref", "alts", "end", "sample_idx", "sample_id", "g.a1", "g.a2", "g.phased", "g.haploid", conf.alias("conf"))


def ploidy(called: DataFrame) -> DataFrame:
    """(sample_idx, sample_id, is_diploid)."""
    return called.groupBy("sample_idx", "sample_id").agg((~F.bool_or("haploid")).alias("is_diploid"))


def region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of a region, ends included, whichever way the chromosome's name is written."""
    from ..functions.genotype import chrom_aliases

    return df.where(F.col("chrom").isin(chrom_aliases(chrom)) & F.col("pos").between(start, end))


def haplotypes(called: DataFrame) -> DataFrame:
    """(chrom, pos, hap, allele): haplotypes 2 s and 2 s + 1 of each sample."""
    cells = F.array(F.struct((F.col("sample_idx") * 2).alias("hap"), F.col("a1").alias("allele")), F.struct((F.col("sample_idx") * 2 + 1).alias("hap"), F.col("a2").alias("allele")))
    return called.select("chrom", "pos", F.explode(cells).alias("c")).select("chrom", "pos", "c.hap", "c.allele")
