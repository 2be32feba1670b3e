"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `radius` differing bits are linked. Correlated bits are grouped into parts. If
two fingerprints differ in at most r bits over m parts, then for any thresholds t_i >= -1 that sum
to r - m + 1 some part differs in at most t_i bits. So each fingerprint may choose its own
thresholds: a dynamic program over its parts picks those with the fewest estimated candidates, from
the exact sizes of its own buckets and the bits' frequencies over all fingerprints. It then probes
the chosen neighbourhoods in the index of part values, and candidates are verified.

Where every choice is dear (thousands of near copies share all buckets) the radius is split between
both sides instead: each such fingerprint names the points within radius // 2 of itself (near) and,
if the radius is odd, those one bit further (far). Two that are within the radius name a common
point, one of them nearly, and any two that do so are within the radius. Those rows are linear in
the number of fingerprints, so no bucket is ever expanded into its pairs, and no link is lost.

Nulls: a null text has no words and the fingerprint zero; rows with a null id take part, and a
component's id is its smallest id that is not null (null if there is none). Repeated rows are kept
as rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches, written
from .textcore import column_bytes

SEED = 42
SHINGLE = 3
#: Above this many expected candidates and probes a fingerprint splits the radius between both sides.
DEAR = 400
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if set in over half of the hashes of the text's word shingles."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    one, line = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()[shingle - 1 :] if len(words) >= shingle else [len(line)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(ends), 1 << 16):
        hashes = np.array([one(line[s:e], seed) for s, e in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns `carry` and `fp` (long, the 64 bits as a signed number) of every row."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    carry = carry or []
    source = df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*source.schema.fields[1:], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in column_bytes(b.column(0))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps)], names=[*(f"_c{i}" for i in range(len(carry))), "fp"])

    return source.mapInArrow(run, schema).toDF(*carry, "fp")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set, as a 64 x 64 array."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            for k in range(0, len(fps), 1 << 15):
                bits = np.unpackbits(fps[k : k + (1 << 15)], axis=1, bitorder="little").astype(np.float64)
                both += (bits.T @ bits).astype(np.int64)
            n += len(fps)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(both.ravel(), n))], names=["k", "v"])

    rows = distinct.select("fp").mapInArrow(run, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 4,097 rows at most
    flat = np.zeros(4097, np.int64)
    for k, v in rows:
        flat[k] = v
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows by the free bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        rest = sorted(free)
        part = [max(rest, key=lambda i: (corr[i, rest].sum(), -i))]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def ball_estimates(n: int, both: np.ndarray, part: list[int], radius: int) -> np.ndarray:
    """Expected number of fingerprints at distance 0..radius on a part, bits taken as independent."""
    p = np.diag(both)[part] / max(n, 1)
    differ, at = 2 * p * (1 - p), np.zeros(radius + 1)
    at[0] = 1
    for d in differ:
        at[1:] = at[1:] * (1 - d) + at[:-1] * d
        at[0] *= 1 - d
    return n * at


def allocate(sizes: np.ndarray, balls: list[np.ndarray], widths: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint the thresholds per part (-1: not probed) that sum to radius - parts + 1, and their cost.

    Dynamic program over parts; the cost of a threshold is its candidates and its probes.
    """
    n, m = sizes.shape
    total = radius - m + 1
    span = range(-m, total + m + 1)
    best = {t: (np.zeros(n) if t == 0 else np.full(n, np.inf)) for t in span}
    choice: list[dict[int, np.ndarray]] = []
    for i in range(m):
        probes, near, costs = 1, 0.0, {-1: np.zeros(n)}
        for e in range(radius + 1):
            if e:
                probes += int(np.prod([widths[i] - j for j in range(e)]) // np.prod(range(1, e + 1)))
                near += float(balls[i][e])
            costs[e] = sizes[:, i] - 1 + near + probes
        nxt, took = {}, {}
        for t in span:
            at, arg = np.full(n, np.inf), np.full(n, -1)
            for e, c in costs.items():
                if t - e in best:
                    v = best[t - e] + c
                    better = v < at
                    at[better], arg[better] = v[better], e
            nxt[t], took[t] = at, arg
        best = nxt
        choice.append(took)
    out, left = np.zeros((n, m), np.int64), np.full(n, total)
    for i in reversed(range(m)):
        for t in np.unique(left):
            at = left == t
            out[at, i] = choice[i][int(t)][at]
        left = left - out[:, i]
    return out, best[total]


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of 0..most of the bits."""
    import itertools

    return [sum(1 << b for b in c) for e in range(most + 1) for c in itertools.combinations(bits, e)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = 2, parts: int | None = None, dear: float = DEAR) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) whose closure is that of all pairs within the radius.

    Every pair with a fingerprint that probes is an edge; of those that name common points, each
    is tied to the smallest fingerprint at the point, all of which lie within the radius.
    """
    import pyarrow as pa

    n, both = bit_statistics(distinct)
    m = parts or (radius + 1 if n < 1 << 25 else radius)
    groups = group_bits(n, both, m)
    masks = [_signed(sum(1 << b for b in g)) for g in groups]
    balls, widths = [ball_estimates(n, both, g, radius) for g in groups], [len(g) for g in groups]
    flips = [_flips(g, radius) for g in groups]
    ends = [[sum(1 for f in fl if f.bit_count() <= e) for e in range(radius + 1)] for fl in flips]
    near = _flips(list(range(64)), radius // 2)
    far = [f for f in _flips(list(range(64)), (radius + 1) // 2) if f.bit_count() > radius // 2]

    part_of = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for i, mask in enumerate(masks)])
    index = distinct.select("fp", F.explode(part_of).alias("p")).select("p.part", "p.key", "fp")
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    own = index.join(sizes, ["part", "key"]).groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(m)])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = [np.array(fl, np.uint64) for fl in flips]
        um, un = np.array([x & (1 << 64) - 1 for x in masks], np.uint64), [np.array(x, np.uint64) for x in (near, far)]
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(m)], 1).astype(np.float64)
            t, cost = allocate(size, balls, widths, radius)
            hot = cost > dear
            keys, owners, kinds = [], [], []
            for i in range(m):
                for e in range(radius + 1):
                    at = fp[(t[:, i] == e) & ~hot & (size[:, i] + (e > 0) > 1)]
                    near_i = u[i][: ends[i][e]]
                    keys.append(((at & um[i])[:, None] ^ near_i).ravel())
                    owners.append(np.repeat(at, len(near_i)))
                    kinds.append(np.full(len(at) * len(near_i), i))
            at = fp[hot]
            for i, flip in enumerate(un):
                keys.append((at[:, None] ^ flip).ravel())
                owners.append(np.repeat(at, len(flip)))
                kinds.append(np.full(len(at) * len(flip), m + i))
            k, o, p = np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds)
            for x in range(0, len(k), 1 << 17):
                y = slice(x, x + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(p[y].astype(np.int32)), pa.array(k[y].view(np.int64)), pa.array(o[y].view(np.int64))], names=["part", "key", "owner"])

    probes = written(own.mapInArrow(probe, "part int, key bigint, owner bigint"), "probes")
    found = (
        probes.where(F.col("part") < m)
        .join(index, ["part", "key"])
        .where((F.col("owner") != F.col("fp")) & (F.bit_count(F.col("owner").bitwiseXOR(F.col("fp"))) <= radius))
        .select(F.least("owner", "fp").alias("a"), F.greatest("owner", "fp").alias("b"))
    )
    #: A point has at most as many owners as points lie around it.
    named = probes.where(F.col("part") >= m).groupBy("key").agg(F.array_min(F.collect_set(F.when(F.col("part") == m, F.col("owner")))).alias("a"), F.collect_set("owner").alias("at"))
    tied = named.where(F.col("a").isNotNull() & (F.size("at") > 1)).select("a", F.explode("at").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(tied).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn until no edge changes; each step is checkpointed.
    """
    from .store import shared_dir

    shared_dir(edges.sparkSession)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).checkpoint()
    last = state(e)
    while last[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = small.union(smallest.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = state(e)
        if now == last:
            break
        last = now
    stars = e.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("node"), "root").union(e.select("b", "b").distinct()).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, radius: int = 2, parts: int | None = None, dear: float = DEAR) -> DataFrame:
    """Per row: `carry` columns, doc (the id), fp, root (component of fingerprints) and component (its smallest id)."""
    carry = carry or []
    rows = df.select(F.col(f"`{text_col}`").alias("_text"), F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(carry)])
    names = [f"_k{i}" for i in range(len(carry))]
    fps = written(fingerprints(rows, "_text", ["_id", *names]), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("_id").alias("least")), "distinct")
    root = written(components(links(distinct, radius, parts, dear)), "components")
    of = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("fp").alias("_fp"), "root", "component")
    return fps.join(named, fps.fp == named._fp).select(*[F.col(n).alias(c) for n, c in zip(names, carry)], F.col("_id").alias("doc"), "fp", "root", "component")


def hex_digits(fp: str) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """df without all but one row of each component: the row with the smallest id (nulls last), whole and unchanged.

    Of rows equal in every column one stays.
    """
    own = [f"_r{i}" for i in range(len(df.columns))]
    of = dict(zip(df.columns, own))
    plain = df.toDF(*own)
    #: Maps have no hash of their own; NULL is told from other values.
    value = lambda f: F.to_json(F.col(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name)
    parts = [c for f in plain.schema for c in (F.isnull(f.name), value(f))]
    #: A row's identity: 128 bits, so that different rows of any corpus stay apart.
    key = ["_key", "_key2"]
    keyed = plain.withColumns({"_key": F.xxhash64(*parts), "_key2": F.xxhash64(F.lit(SEED), *parts)})
    near = written(near_duplicates(keyed, of[id_col], of[text_col], key, radius), "near")
    pick = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", F.col("_key").alias("k"), F.col("_key2").alias("k2"))).alias("p")
    kept = near.groupBy("root").agg(pick).select(F.col("p.k").alias("_key"), F.col("p.k2").alias("_key2"))
    out = keyed.join(kept, key, "left_semi")
    total, different = near.agg(F.count("*"), F.count_distinct(*key)).first()
    if total != different:
        out = out.dropDuplicates(key)
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, df.columns)])
