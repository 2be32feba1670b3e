"""Interpolated modified Kneser-Ney model of any order, counted in Spark and memory-mapped by workers.

Three passes over the texts, none with a step per word in Python:

1. Words are hashed; every task sums its words, and buckets of the hash range merge these sums into
   the vocabulary: sorted arrays of 64-bit hashes. A word's number is its place in them.
2. Pairs of numbers are packed into 64 bits and mixed by a bijection, so that buckets of the mixed
   range are even whatever the words: a word that follows everywhere, or a third of all words, is no
   hot key. Tasks count their pairs before the shuffle and send sorted, delta-coded, compressed
   arrays. Each bucket writes its sorted hash array and counts, and passes on what each word's
   number gets from it: as a context its total and how many pairs have count 1, 2, 3 or more, as a
   continuation the number of contexts. These are summed by ranges of numbers.
3. Workers map the arrays and score batches: all pairs of a batch are looked up at once, sorted, so
   that the look-ups run through the files in order.

Above order 2 a pair's number is its place in the arrays, an n-gram's key its context's number and its
last word, and buckets are ranges of the contexts' numbers, so that a bucket has all of a context. Each
order is one more pass like 2. Orders below the highest count the different words before an n-gram, or,
where it begins a text, its occurrences; contexts that would reach beyond a text's begin are shorter.

Files lie in the shared folder, written whole and renamed, with equal bytes if a task runs again.
After a pass its buckets' parts are put together in at most 2 ** SHELF_BITS files of each kind, with a
table of offsets, and mapped without a descriptor being kept; so neither grows with the input.
All training texts are counted, and nothing is pruned. Memory is bounded by a bucket (buckets follow
the input's bytes, without a cap) and a batch; numbers of n-grams of one order have 32 bits, more are
an error. A token is a word [^\x20\x09-\x0D]+ with A-Z lower-cased, or a text's end.

Nulls: a null text is empty and has one token, its end. With no training text each token has the
probability 1 (one unknown word). Empty tables give empty results, repeated rows are counted each.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import file_dir, free_name, map_file, removed, shelved, small_batches, write_file
from .textcore import SPACE_CLASS, chunks, column_bytes, mix, scan, unmix

#: Hashes of a text's end and begin.
END, BEGIN = np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)
BUCKET_BYTES = 8 << 20
FLUSH = 1 << 21
CHUNK = 1 << 20
SHELF_BITS = 6
#: Setting by which a shuffle's files go as its query ends, not when the driver's JVM notices.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Compressed bytes of an integer array; sorted ones by differences."""
    import zstandard

    v = values.astype(np.uint64)
    if sorted_ and len(v):
        v = np.diff(v, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes, sorted_: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    v = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if sorted_ else v


def add_up(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums)


class Sums:
    """Counts of keys as they come; flushed as rows for each bucket of the key range."""

    def __init__(self, bits: int, edges: np.ndarray | None = None):
        self.parts, self.size = [], 0
        self.edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if edges is None else edges

    def add(self, keys: np.ndarray) -> None:
        own, n = np.unique(keys, return_counts=True)
        self.parts.append((own, n.astype(np.uint64)))
        self.size += len(own)

    def rows(self) -> list[tuple[int, bytes, bytes]]:
        if not self.parts:
            return []
        keys, n = add_up(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.size = [], 0
        edges = np.searchsorted(keys, self.edges)
        edges = np.append(edges, len(keys))
        return [(b, pack(keys[x:y], True), pack(n[x:y])) for b, (x, y) in enumerate(zip(edges.tolist(), edges[1:].tolist())) if x < y]


def _merge(table, *more: str) -> tuple[np.ndarray, ...]:
    """All packed rows of a bucket as one sorted array with sums."""
    keys = np.concatenate([unpack(x, True) for x in table.column("keys").to_pylist()])
    return add_up(keys, *(np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in more))


def sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin, words and end of all texts in one array, and where each text starts (and the array's length)."""
    w = scan(texts, SPACE_CLASS)
    n = np.diff(w.at)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n + 2, out=at[1:])
    out = np.empty(at[-1], np.uint64)
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[at[:-1]], out[at[1:] - 1], out[inner] = BEGIN, END, w.hashes
    return out, at


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that belong to them."""

    uri: str
    bits: int = 4
    starts: list[int] = field(default_factory=list)  # of each vocabulary bucket the first word's number
    span: int = 1  # numbers for each file of word statistics
    tokens: int = 0
    discounts: tuple[float, ...] = (0.75, 0.75, 0.75)
    lower: tuple[float, ...] = (0.75, 0.75, 0.75)
    pairs: int = 0
    filled: frozenset = frozenset()  # buckets that have pairs
    left: float = 0.0  # mass that the lower order leaves to unseen words
    order: int = 2
    firsts: dict[int, np.ndarray] = field(default_factory=dict)  # of each order's buckets the first n-gram's number, and how many there are
    edges: dict[int, np.ndarray] = field(default_factory=dict)  # of each order's buckets from 3 on the first context's number, and how many there are
    higher: dict[int, tuple[float, ...]] = field(default_factory=dict)  # discounts from order 3 on
    files: dict[str, np.ndarray] = field(default_factory=dict)  # of each kind where the buckets' bytes begin, all shelves in a row

    @property
    def words(self) -> int:
        return self.starts[-1] if self.starts else 0


    def shelf(self, bucket: int) -> int:
        return bucket >> max(0, self.bits - SHELF_BITS)

    def view(self, kind: str, bucket: int, dtype: str) -> np.ndarray:
        """A bucket's array of a kind, mapped."""
        lo, hi = self.files[kind][bucket : bucket + 2].tolist()
        if lo == hi:
            return np.empty(0, dtype)
        k = self.shelf(bucket)
        base = int(self.files[kind][k << max(0, self.bits - SHELF_BITS)])
        return _mapped(f"{self.uri}/{kind}/{k}")[lo - base : hi - base].view(dtype)


@functools.lru_cache(1 << 12)
def _mapped(uri: str) -> np.ndarray:
    return map_file(uri)


def _part(uri: str, kind: str, bucket: int) -> str:
    return f"{uri}/{kind}.parts/{bucket}"


def put_together(spark: SparkSession, model: Model, *kinds: str) -> None:
    """Parts of finished passes become shelves; the shuffles that made them are released."""
    import pyarrow as pa

    uri, bits, n = model.uri, model.bits, 1 << min(SHELF_BITS, model.bits)
    width = 1 << max(0, bits - SHELF_BITS)
    gc.collect()  # plans of finished passes; their shuffles' files go when the driver's JVM notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job in b.column(0).to_pylist():
                kind, k = kinds[job // n], job % n
                sizes = shelved([_part(uri, kind, x) for x in range(k * width, (k + 1) * width)], f"{uri}/{kind}/{k}")
                filled = [(job // n, k * width + i, size) for i, size in enumerate(sizes) if size]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*filled)) or [(), (), ()]], names=["kind", "bucket", "size"])

    sizes = np.zeros((len(kinds), (1 << bits) + 1), np.int64)
    jobs = n * len(kinds)
    for kind, b, size in spark.range(0, jobs, 1, min(jobs, 64)).mapInArrow(run, "kind bigint, bucket bigint, size bigint").collect():  # a row per bucket
        sizes[kind, b + 1] = size
    for kind, s in zip(kinds, sizes):
        model.files[kind] = np.cumsum(s)
    spark.sparkContext._jvm.System.gc()


def _drop(spark: SparkSession, model: Model, *kinds: str) -> None:
    for kind in kinds:
        removed(f"{model.uri}/{kind}", spark)
        del model.files[kind]


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of sorted keys."""
    high = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(high)) + 1
    for x, y in zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(keys)]]).tolist()):
        if x < y:
            yield int(high[x]), x, y


def word_numbers(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Numbers of words; BEGIN has the number after the last, an unknown word the one after that."""
    own, back = np.unique(hashes, return_inverse=True)
    out = np.full(len(own), model.words + 1, np.int64)
    for b, x, y in _by_bucket(own, model.bits):
        if model.starts[b] == model.starts[b + 1]:
            continue
        table = model.view("words", b, "<u8")
        at = np.minimum(np.searchsorted(table, own[x:y]), len(table) - 1)
        out[x:y] = np.where(table[at] == own[x:y], model.starts[b] + at, model.words + 1)
    out[own == BEGIN] = model.words
    return out[back]


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))


def pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Training counts of mixed pairs, 0 for those that are not there."""
    own, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(own), np.int64)
    for b, x, y in _by_bucket(own, model.bits):
        if b not in model.filled:
            continue
        table = model.view("pairs", b, "<u8")
        at = np.minimum(np.searchsorted(table, own[x:y]), len(table) - 1)
        out[x:y] = np.where(table[at] == own[x:y], _read_counts(model, "counts", b, at), 0)
    return out[back]


def _write_counts(uri: str, kind: str, bucket: int, n: np.ndarray) -> None:
    """A byte for each number, and those of 255 or more with their places in a kind of their own."""
    write_file(_part(uri, kind, bucket), np.minimum(n, 255).astype("u1").tobytes())
    large = np.flatnonzero(n >= 255).astype(np.uint64)
    if len(large):
        write_file(_part(uri, f"{kind}-large", bucket), np.concatenate([large, n[n >= 255].astype(np.uint64)]).astype("<u8").tobytes())


def _read_counts(model: Model, kind: str, bucket: int, at: np.ndarray) -> np.ndarray:
    n = model.view(kind, bucket, "u1")[at].astype(np.int64)
    large = np.flatnonzero(n == 255)
    if len(large):
        over = model.view(f"{kind}-large", bucket, "<u8").reshape(2, -1)
        n[large] = over[1][np.searchsorted(over[0], at[large].astype(np.uint64)).clip(0, over.shape[1] - 1)]
    return n


def gram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def distinct_grams(model: Model, order: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct n-grams given their contexts' numbers and last words, and where among them each is.

    The number is -1 where there is no such one; the last is that of contexts that aren't there.
    """
    known = np.flatnonzero(context >= 0)
    own, back = np.unique((pair_keys if order == 2 else gram_keys)(context[known], word[known]), return_inverse=True)
    found = np.full(len(own), -1, np.int64)
    if order == 2:
        parts = _by_bucket(own, model.bits)
    else:
        cut = np.searchsorted(own, model.edges[order].astype(np.uint64) << np.uint64(32)).tolist()
        parts = ((b, x, y) for b, (x, y) in enumerate(zip(cut, cut[1:])) if x < y)
    first = model.firsts[order]
    for b, x, y in parts:
        if first[b] == first[b + 1]:
            continue
        table = model.view("pairs" if order == 2 else f"grams{order}", b, "<u8")
        at = np.minimum(np.searchsorted(table, own[x:y]), len(table) - 1)
        found[x:y] = np.where(table[at] == own[x:y], first[b] + at, -1)
    at = np.full(len(word), len(own), np.int64)
    at[known] = back
    return np.append(found, -1), at


def gram_numbers(model: Model, order: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of n-grams given their contexts' numbers and last words; -1 where there is no such one."""
    found, at = distinct_grams(model, order, context, word)
    return found[at]


def running_numbers(model: Model, w: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Of each place in sequences() the number of the n-gram that ends there; -1 if it would begin before its text."""
    out = w
    for o in range(2, order + 1):
        before = np.concatenate([[-1], out[:-1]])
        before[at[:-1][at[:-1] < len(w)]] = -1
        out = gram_numbers(model, o, before, w)
    return out


def _each(first: np.ndarray, numbers: np.ndarray, read) -> np.ndarray:
    """read(bucket, place) of numbers that are dealt over buckets by `first`; zeros for -1."""
    there = np.flatnonzero(numbers >= 0)
    own, back = numbers[there], slice(None)
    if (own[1:] <= own[:-1]).any():  # distinct n-grams come in their order
        own, back = np.unique(own, return_inverse=True)
    cut = np.searchsorted(own, first).tolist()
    got = [(x, y, read(b, own[x:y] - first[b])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if x < y]
    found = np.zeros((len(own), *(got[0][2].shape[1:] if got else ())), np.int64)
    for x, y, v in got:
        found[x:y] = v
    out = np.zeros((len(numbers), *found.shape[1:]), np.int64)
    out[there] = found[back]
    return out


def gram_counts(model: Model, order: int, numbers: np.ndarray) -> np.ndarray:
    """Counts of n-grams as their order uses them, 0 for -1."""
    name = "counts" if order == model.order else "contexts"
    return _each(model.firsts[order], numbers, lambda b, at: _read_counts(model, f"{name}{'' if order == 2 else order}", b, at))


def context_stats(model: Model, order: int, numbers: np.ndarray) -> np.ndarray:
    """Of contexts of an order's n-grams: total, and n-grams of count 1, 2, 3 or more; zeros for -1."""
    edges, first = model.edges[order], model.firsts[order]

    def read(b: int, at: np.ndarray) -> np.ndarray:
        if first[b] == first[b + 1]:
            return np.zeros((len(at), 4), np.int64)
        size = int(edges[b + 1] - edges[b])
        return np.stack([_read_counts(model, f"stats{order}", b, at + i * size) for i in range(4)], 1)

    out = np.zeros((len(numbers), 4), np.int64)
    known = np.flatnonzero(numbers >= 0)
    if len(known):
        out[known] = _each(edges, numbers[known], read)
    return out


def _suffixes(model: Model, order: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of n-grams without their first words."""
    if order == 2:
        return word
    name = "pairs" if order == 3 else f"grams{order - 1}"
    keys = _each(model.firsts[order - 1], context, lambda b, at: model.view(name, b, "<u8")[at].view(np.int64)).view(np.uint64)
    keys = unmix(keys) if order == 3 else keys
    inner = _suffixes(model, order - 1, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return gram_numbers(model, order - 1, inner, word)


#: Of each word's number: total and pairs of count 1, 2, 3 or more as a context; contexts before it; count.
STATS = ("total", "n1", "n2", "n3", "before", "count")


def word_stats(model: Model, numbers: np.ndarray) -> np.ndarray:
    """Rows of STATS, zeros for unknown words."""
    own, back = np.unique(numbers, return_inverse=True)
    out = np.zeros((len(own), len(STATS)), np.int64)
    own_ok = own <= model.words
    for k in np.unique(own[own_ok] // model.span).tolist():
        at = np.flatnonzero(own_ok & (own // model.span == k))
        size = min(model.span, model.words + 1 - k * model.span)
        rows = own[at] - k * model.span
        out[at] = np.stack([_read_counts(model, "stats", k, rows + i * size) for i in range(len(STATS))], 1)
    return out[back]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2, 3 or more, from how many pairs have count 1 to 4; 0.75 where these are too few."""
    if min(n[:4]) <= 0:
        return 0.75, 0.75, 0.75
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 1.0) for i in range(3))


def train(df: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, order: int = 2) -> Model:
    """Counts df's texts; the model's files are in the shared folder. order: words of the longest n-grams."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = df.sparkSession
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return _train(spark, df, text_col, bucket_bytes, order)
    finally:
        spark.conf.unset(CLEANUP) if kept is None else spark.conf.set(CLEANUP, kept)


def _train(spark: SparkSession, df: DataFrame, text_col: str, bucket_bytes: int, order: int) -> Model:
    import pyarrow as pa

    small_batches(spark)
    texts = df.select(F.col(f"`{text_col}`").alias("t"))
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    model = Model(file_dir(spark, "lm"), bits, order=order)
    binary = [pa.int32(), pa.binary(), pa.binary()]
    kind = "bucket int, keys binary, n binary"

    def batch(rows: list[tuple], names=("bucket", "keys", "n"), kinds=binary) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(bits)
        for b in batches:
            column = column_bytes(b.column(0))
            for x, y in chunks(column, CHUNK):
                s, _ = sequences(column[x:y])
                sums.add(s[s != BEGIN])
            if sums.size > FLUSH:
                yield batch(sums.rows())
        yield batch(sums.rows())

    uri = model.uri

    def write_words(table: pa.Table) -> pa.Table:
        keys, n = _merge(table, "n")
        b = table.column("bucket")[0].as_py()
        write_file(_part(uri, "words", b), keys.astype("<u8").tobytes())
        write_file(_part(uri, "wordcounts", b), n.astype("<u8").tobytes())
        return pa.table({"bucket": pa.array([b], pa.int32()), "words": pa.array([len(keys)]), "tokens": pa.array([int(n.sum())])})

    made = texts.mapInArrow(count_words, kind).groupBy("bucket").applyInArrow(write_words, "bucket int, words bigint, tokens bigint").collect()  # a row per bucket
    words = {r.bucket: r.words for r in made}
    model.starts = [0, *np.cumsum([words.get(b, 0) for b in range(1 << bits)]).tolist()]
    model.tokens = sum(r.tokens for r in made)
    if model.words >= 1 << 32:
        raise ValueError("more than 2 ** 32 different words")
    if not model.words:
        return model
    put_together(spark, model, "words", "wordcounts")
    model.span = max(1 << 14, -(-(model.words + 1) >> bits))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(bits)
        for b in batches:
            column = column_bytes(b.column(0))
            for x, y in chunks(column, CHUNK):
                s, at = sequences(column[x:y])
                w = word_numbers(model, s)
                ok = np.ones(len(w), bool)
                ok[at[:-1]] = False
                ok = np.flatnonzero(ok)
                sums.add(pair_keys(w[ok - 1], w[ok]))
            if sums.size > FLUSH:
                yield batch(sums.rows())
        yield batch(sums.rows())

    names = ("range", "keys", "total", "n1", "n2", "n3", "before")
    kinds = [pa.int32(), *[pa.binary()] * 6]

    def write_pairs(table: pa.Table) -> pa.Table:
        keys, n = _merge(table, "n")
        b = table.column("bucket")[0].as_py()
        write_file(_part(uri, "pairs", b), keys.astype("<u8").tobytes())
        _write_counts(uri, "counts", b, n)
        return spread(b, keys, n) if order == 2 else pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([[len(keys)]], pa.list_(pa.int64()))})

    def spread(b: int, keys: np.ndarray, n: np.ndarray) -> pa.Table:
        """What each word's number gets from a bucket of pairs."""
        plain = unmix(keys)
        one = [(n == k).astype(np.uint64) for k in (1, 2)] + [(n >= 3).astype(np.uint64)]
        context = add_up(plain >> np.uint64(32), n, *one)
        after = add_up(plain & np.uint64(0xFFFFFFFF), np.ones(len(n), np.uint64))
        both = np.union1d(context[0], after[0])
        cols = np.zeros((5, len(both)), np.uint64)
        cols[:4, np.searchsorted(both, context[0])] = np.stack(context[1:])
        cols[4, np.searchsorted(both, after[0])] = after[1]
        group = (both // np.uint64(model.span)).astype(np.int64)
        edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(both)]
        rows = [(int(group[x]), pack(both[x:y], True), *(pack(c[x:y]) for c in cols)) for x, y in zip(edge, edge[1:]) if x < y]
        #: Counts of counts, and which buckets have pairs, go to a range of their own.
        seen = np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n), 1], np.uint64)
        rows.append((-1, pack(np.array([0, 1, 2, 3, 4, 5 + b], np.uint64), True), pack(seen), *[pack(np.zeros(6, np.uint64))] * 4))
        return pa.Table.from_batches([batch(rows, names, kinds)])

    starts = np.array(model.starts)

    def write_stats(table: pa.Table) -> pa.Table:
        k = table.column("range")[0].as_py()
        keys, *cols = _merge(table, *names[2:])
        if k < 0:
            return pa.table({"range": pa.array([k], pa.int32()), "n": pa.array([[*cols[0][:5].tolist(), *(keys[5:] - np.uint64(5)).tolist()]], pa.list_(pa.int64()))})
        first = k * model.span
        n = min(model.span, model.words + 1 - first)
        out = np.zeros((len(STATS), n), np.uint64)
        at = (keys - np.uint64(first)).astype(np.int64)
        out[: len(cols), at] = np.stack(cols)
        for b in range(int(np.searchsorted(starts, first, "right")) - 1, len(starts) - 1):
            if starts[b] >= first + n:
                break
            lo, hi = max(int(starts[b]), first), min(int(starts[b + 1]), first + n)
            if lo < hi:
                out[5, lo - first : hi - first] = model.view("wordcounts", b, "<u8")[lo - starts[b] : hi - starts[b]]
        before = out[4]
        _write_counts(uri, "stats", k, out.ravel())
        seen = [int((before == c).sum()) for c in (1, 2, 3, 4)] + [int((before > 0).sum())]
        return pa.table({"range": pa.array([k], pa.int32()), "n": pa.array([seen], pa.list_(pa.int64()))})

    def four(n: np.ndarray) -> list[int]:
        return [int((n == k).sum()) for k in (1, 2, 3, 4)]

    def count_grams(o: int):
        first = model.edges[o][:-1].astype(np.uint64) << np.uint64(32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(bits, first)
            for b in batches:
                column = column_bytes(b.column(0))
                for x, y in chunks(column, CHUNK):
                    s, at = sequences(column[x:y])
                    w = word_numbers(model, s)
                    context = running_numbers(model, w, at, o - 1)[:-1]
                    ok = np.ones(len(w), bool)
                    ok[at[:-1]] = False
                    ok = np.flatnonzero(ok[1:] & (context >= 0))
                    sums.add(gram_keys(context[ok], w[ok + 1]))
                if sums.size > FLUSH:
                    yield batch(sums.rows())
            yield batch(sums.rows())

        return run

    def write_context_stats(o: int, b: int, keys: np.ndarray, n: np.ndarray) -> None:
        lo, hi = model.edges[o][b : b + 2].tolist()
        own, *sums = add_up(keys >> np.uint64(32), n, *((n == k).astype(np.uint64) for k in (1, 2)), (n >= 3).astype(np.uint64))
        out = np.zeros((4, hi - lo), np.uint64)
        out[:, own.astype(np.int64) - lo] = np.stack(sums)
        _write_counts(uri, f"stats{o}", b, out.ravel())

    def write_grams(o: int):
        def run(table: pa.Table) -> pa.Table:
            keys, n = _merge(table, "n")
            b = table.column("bucket")[0].as_py()
            write_file(_part(uri, f"grams{o}", b), keys.astype("<u8").tobytes())
            _write_counts(uri, f"counts{o}", b, n)
            if o == order:
                write_context_stats(o, b, keys, n)
            return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([[len(keys), *four(n)]], pa.list_(pa.int64()))})

        return run

    def suffixes(o: int):
        """Of each n-gram in a bucket's file the one without its first word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = model.firsts[o - 1]
            for found in batches:
                for b in found.column(0).to_pylist():
                    table = model.view(f"grams{o}", b, "<u8")
                    sums = Sums(bits, first[:-1].astype(np.uint64))
                    for x in range(0, len(table), FLUSH):
                        keys = np.asarray(table[x : x + FLUSH])
                        sums.add(_suffixes(model, o, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)).astype(np.uint64))
                    yield batch(sums.rows())

        return run

    def write_contexts(o: int):
        """How many different words stand before each n-gram of a bucket; those at a text's begin keep their counts."""

        def run(table: pa.Table) -> pa.Table:
            own, sums = _merge(table, "n")
            b = table.column("bucket")[0].as_py()
            keys = model.view("pairs" if o == 2 else f"grams{o}", b, "<u8")
            n = np.zeros(len(keys), np.uint64)
            n[own.astype(np.int64) - model.firsts[o][b]] = sums
            n = np.where(n > 0, n, _read_counts(model, f"counts{'' if o == 2 else o}", b, np.arange(len(keys))).astype(np.uint64))
            _write_counts(uri, f"contexts{'' if o == 2 else o}", b, n)
            if o == 2:
                return spread(b, keys, n)
            write_context_stats(o, b, keys, n)
            return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([[len(keys), *four(n)]], pa.list_(pa.int64()))})

        return run

    told, shares = "bucket int, n array<bigint>", "range int, keys binary, total binary, n1 binary, n2 binary, n3 binary, before binary"

    def numbered(rows: list) -> np.ndarray:
        size = {r.bucket: r.n[0] for r in rows}
        first = np.concatenate([[0], np.cumsum([size.get(b, 0) for b in range(1 << bits)])]).astype(np.int64)
        if first[-1] >= 1 << 32:
            raise ValueError("more than 2 ** 32 different n-grams")
        return first

    counts = lambda name: (name, f"{name}-large")
    pairs = texts.mapInArrow(count_pairs, kind).groupBy("bucket")
    last = ["pairs", *counts("counts")]
    if order == 2:
        partial = pairs.applyInArrow(write_pairs, shares)
    else:
        model.firsts[2] = numbered(pairs.applyInArrow(write_pairs, told).collect())  # a row per bucket
        put_together(spark, model, *last)
        for o in range(3, order + 1):
            model.edges[o] = np.linspace(0, model.firsts[o - 1][-1], (1 << bits) + 1).astype(np.int64)
            made = texts.mapInArrow(count_grams(o), kind).groupBy("bucket").applyInArrow(write_grams(o), told).collect()  # a row per bucket
            model.firsts[o] = numbered(made)
            put_together(spark, model, f"grams{o}", *counts(f"counts{o}"), *(counts(f"stats{o}") if o == order else ()))
        model.higher[order] = _discounts(np.sum([r.n[1:] for r in made], 0).tolist() if made else [0] * 4)
        for o in range(order, 2, -1):
            filled = lambda k: np.flatnonzero(np.diff(model.firsts[k])).tolist()
            #: A row of its own for each bucket, for those that no n-gram of the order above points to.
            blank = spark.createDataFrame([(b, bytearray(pack(model.firsts[o - 1][b : b + 1], True)), bytearray(pack(np.zeros(1)))) for b in filled(o - 1)], kind)
            found = spark.createDataFrame([(b,) for b in filled(o)], "bucket int").repartition(max(1, len(filled(o)) // 2), "bucket")
            lower = found.mapInArrow(suffixes(o), kind).union(blank).groupBy("bucket")
            if o == 3:
                partial, last = lower.applyInArrow(write_contexts(2), shares), counts("contexts")
            else:
                model.higher[o - 1] = _discounts(np.sum([r.n[1:] for r in lower.applyInArrow(write_contexts(o - 1), told).collect()], 0).tolist())  # a row per bucket
                put_together(spark, model, *counts(f"contexts{o - 1}"), *counts(f"stats{o - 1}"))
    stats = partial.groupBy("range").applyInArrow(write_stats, "range int, n array<bigint>").collect()  # a row per range
    put_together(spark, model, *counts("stats"), *last)
    _drop(spark, model, "wordcounts", *(counts("counts") if order > 2 else ()))
    own = next(r.n for r in stats if r.range < 0)
    model.discounts, model.pairs, model.filled = _discounts(own), own[4], frozenset(own[5:])
    low = [sum(r.n[i] for r in stats if r.range >= 0) for i in range(5)]
    model.lower = _discounts(low)
    three = low[4] - low[0] - low[1]
    model.left = (model.lower[0] * low[0] + model.lower[1] * low[1] + model.lower[2] * three) / model.pairs
    return model


def _shares(context: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts (total, n-grams of count 1, 2, 3 or more) the total and the lower order's share, given discounts."""
    total = context[:, 0]
    return total, np.where(total > 0, (context[:, 1] * d[1] + context[:, 2] * d[2] + context[:, 3] * d[3]) / np.maximum(total, 1), 1.0)


def _interpolated(c: np.ndarray, total: np.ndarray, gamma: np.ndarray, d: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Probabilities from counts, the contexts' totals and shares, discounts, and the lower order's probabilities."""
    return np.where(total > 0, (c - d[np.minimum(c, 3)]) / np.maximum(total, 1), 0.0) + gamma * low


def log_probabilities(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score and the model's log10 probability."""
    s, at = sequences(texts)
    ok = np.ones(len(s), bool)
    ok[at[:-1]] = False
    ok = np.flatnonzero(ok)
    starts = at[:-1] - np.arange(len(texts))
    if not model.words:
        n = np.diff(at) - 1
        return n, np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    #: What depends on a word, or on a pair as a context, is read and computed once for each distinct one of the batch.
    own, word = np.unique(s, return_inverse=True)
    numbers = word_numbers(model, own)
    w, st = numbers[word], word_stats(model, numbers)
    d, e = np.array([0, *model.discounts]), np.array([0, *model.lower])
    before, count = st[:, 4], st[:, 5]
    low = (before - e[np.minimum(before, 3)]) / model.pairs + model.left / (model.words + 1)
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    last, prev = word[ok], word[ok - 1]
    total, gamma = _shares(st, d)
    if model.order == 2:
        c = pair_counts(model, pair_keys(w[ok - 1], w[ok]))
    else:
        grams, place = distinct_grams(model, 2, w[ok - 1], w[ok])
        c = gram_counts(model, 2, grams)[place]
    p = _interpolated(c, total[prev], gamma[prev], d, low[last])
    for o in range(3, model.order + 1):
        d = np.array([0, *model.higher[o]])
        total, gamma = _shares(context_stats(model, o, grams), d)
        context = np.full(len(w), len(grams) - 1, np.int64)
        context[ok] = place
        context = context[ok - 1]
        before = grams[context]
        grams, place = distinct_grams(model, o, before, w[ok])
        p = _interpolated(gram_counts(model, o, grams)[place], total[context], gamma[context], d, p)
    count, base = count[last], base[last]
    return (np.diff(at) - 1, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df and a struct `lm`: n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    own = [f"_r{i}" for i in range(len(df.columns))]
    plain, at = df.toDF(*own), df.columns.index(text_col)
    kinds = {"_n": T.LongType(), "_known": T.LongType(), "_base": T.DoubleType(), "_score": T.DoubleType()}
    schema = T.StructType([*plain.schema.fields, *[T.StructField(k, v) for k, v in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = column_bytes(b.column(at))
            parts = [log_probabilities(model, column[x:y]) for x, y in chunks(column, CHUNK)]
            cols = [np.concatenate(p) for p in zip(*parts)] or [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols)], names=[*own, *kinds])

    made = plain.mapInArrow(run, schema)
    struct = F.struct(F.col("_n").alias("n_tokens"), F.col("_known").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"), F.pow(F.lit(10.0), -F.col("_score") / F.col("_n")).alias("perplexity"))
    return made.select(*[F.col(o).alias(n) for o, n in zip(own, df.columns)], struct.alias(free_name(df, "lm")))
