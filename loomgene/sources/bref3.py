"""Binary reference panels: blocks of records that share one coding of haplotypes as sequences.

Numbers are big-endian. A file has a magic number, the writing program, sample names, then blocks: number of
records (0 ends the file), chromosome, number of sequences, each haplotype's sequence, and the records. A record
has position, ids, an allele code, and alleles by sequence or as lists of haplotypes.
"""

from __future__ import annotations

import io
import itertools
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

MAGIC = 2055763188
#: An SNV's alleles are the first letters of a permutation of the bases, which are numbered in lexical order.
PERMUTATIONS = list(itertools.permutations("ACGT"))
#: Alleles of a file, and sites of a block, that write() makes.
CELLS, BLOCK = 1 << 21, 1 << 10
SCHEMA = "chrom string, pos int, id string, ref string, alts array<string>, end int, alleles array<int>"


class Reader:
    """Primitives over a seekable stream."""

    def __init__(self, stream):
        self.stream = stream

    def take(self, form: str):
        size = struct.calcsize(form)
        raw = self.stream.read(size)
        if len(raw) != size:
            raise EOFError("a binary panel ends within a block")
        return struct.unpack(form, raw)

    def int32(self) -> int:
        return self.take(">i")[0]

    def text(self) -> str:
        """Two length bytes, then modified UTF-8: NUL as C0 80, other planes as surrogate pairs."""
        raw = self.stream.read(self.take(">H")[0])
        return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16")

    def texts(self) -> list[str]:
        return [self.text() for _ in range(self.int32())]


def read_header(stream) -> list[str]:
    """Sample names; the stream then stands at the first block."""
    r = Reader(stream)
    if r.int32() != MAGIC:
        raise ValueError("not a binary reference panel")
    r.text()
    return r.texts()


def read_blocks(stream, n_haps: int) -> Iterator[list[tuple]]:
    """Records of each block as rows of SCHEMA."""
    r = Reader(stream)
    while n := r.int32():
        chrom, n_seq = r.text(), r.take(">H")[0]
        of = r.take(f">{n_haps}H")
        rows = []
        for _ in range(n):
            pos = r.int32()
            ids = [r.text() for _ in range(r.take(">B")[0])]
            code, end = r.take(">b")[0], None
            if code == -1:
                letters = r.texts()
                end = r.int32()
                end = end if end >= 0 else None
            else:
                letters = PERMUTATIONS[code >> 2][: 1 + (code & 3)]
            if r.take(">B")[0] == 0:
                by_seq = r.take(f">{n_seq}B")
                alleles = [by_seq[s] for s in of]
            else:
                alleles, default = [None] * n_haps, 0
                for a in range(len(letters)):
                    size = r.int32()
                    if size == -1:
                        default = a
                    else:
                        for h in r.take(f">{size}i"):
                            alleles[h] = a
                alleles = [default if a is None else a for a in alleles]
            rows.append((chrom, pos, ids[0] if ids else None, letters[0], list(letters[1:]), end, alleles))
        yield rows


def write_bytes(samples: list[str], blocks: list[list[tuple]], program: str = "loomgene") -> bytes:
    """Rows of SCHEMA, block by block, in the format that read_blocks() reads."""
    out = io.BytesIO()
    put = lambda form, *v: out.write(struct.pack(form, *v))

    def text(t: str) -> None:
        raw = b"".join(c.encode() if ord(c) < 0x10000 else c.encode("utf-16-be").decode("utf-16-be", "surrogatepass").encode("utf-8", "surrogatepass") for c in t).replace(b"\0", b"\xc0\x80")
        put(">H", len(raw))
        out.write(raw)

    put(">i", MAGIC)
    text(program)
    put(">i", len(samples))
    for s in samples:
        text(s)
    for rows in blocks:
        patterns = list(zip(*(r[6] for r in rows)))
        number = {p: i for i, p in enumerate(dict.fromkeys(patterns))}
        put(">i", len(rows))
        text(rows[0][0])
        put(">H", len(number))
        put(f">{len(patterns)}H", *(number[p] for p in patterns))
        for k, (_, pos, name, ref, alts, end, alleles) in enumerate(rows):
            put(">i", pos)
            put(">B", 1 if name else 0)
            if name:
                text(name)
            letters = (ref, *alts)
            perm = next((i for i, p in enumerate(PERMUTATIONS) if p[: len(letters)] == letters), None)
            if perm is None or end is not None:
                put(">b", -1)
                put(">i", len(letters))
                for x in letters:
                    text(x)
                put(">i", -1 if end is None else end)
            else:
                put(">b", perm << 2 | len(letters) - 1)
            rare = sum(a != 0 for a in alleles) * 8 < len(alleles)
            put(">B", 1 if rare else 0)
            if rare:
                for a in range(len(letters)):
                    own = [h for h, x in enumerate(alleles) if x == a]
                    if a == 0:
                        put(">i", -1)
                    else:
                        put(f">i{len(own)}i", len(own), *own)
            else:
                put(f">{len(number)}B", *(p[k] for p in number))
    put(">i", 0)
    return out.getvalue()


def write(sites: DataFrame, samples: list[str], folder: str) -> None:
    """Sites (chrom, pos, ref, alts, alleles) as files of up to CELLS alleles of a chromosome, in order of position.

    Sites are range-partitioned by place and a task's are taken as they come, so it holds one file, whatever a
    chromosome's length. A file is named by its first position and its number in the task: a task that runs again writes
    over its own.
    """
    from pyspark.sql import functions as F

    from ..plans import stages

    def save(batches):
        import pyarrow as pa

        rows = (r for b in batches for part in range(0, b.num_rows, BLOCK) for r in b.slice(part, BLOCK).to_pylist())
        number, most = itertools.count(), max(1, CELLS // max(1, 2 * len(samples)))
        for _, own in itertools.groupby(rows, lambda r: r["chrom"]):
            while some := list(itertools.islice(own, most)):
                records = [(r["chrom"], r["pos"], None, r["ref"], r["alts"], None, r["alleles"]) for r in some]
                data = write_bytes(samples, [records[x : x + BLOCK] for x in range(0, len(records), BLOCK)])
                stages.save_bytes(f"{folder}/{some[0]['chrom'].encode().hex()}-{some[0]['pos']}-{next(number)}.bref3", data)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(some)], pa.int64())})

    # All records of a position lie in one partition.
    by_place = sites.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", F.xxhash64("ref", "alts"))
    by_place.mapInArrow(save, "n bigint").count()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alts, end, alleles): one row per site; files are read side by side, blocks one after another."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int32())]
        for b in batches:
            for content in b.column(0).to_pylist():
                stream = io.BytesIO(content)
                n_haps = 2 * len(read_header(stream))
                for rows in read_blocks(stream, n_haps):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInArrow(decode, SCHEMA)


def haplotypes(panel: DataFrame) -> DataFrame:
    """(chrom, pos, hap, allele)."""
    from pyspark.sql import functions as F

    return panel.select("chrom", "pos", F.posexplode("alleles").alias("hap", "allele"))
