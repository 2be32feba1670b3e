"""Benchmark decontamination with an FM-index over each piece of the training texts.

A shard is a few megabytes of documents. Its words become symbols: each word of the benchmark has
one, and any other word ends a run, since no test phrase can cross it (runs shorter than the
shortest phrase hold none, so they need no place in the index). The runs' suffix array gives the
Burrows-Wheeler transform, kept as a wavelet matrix. All phrases are searched backwards at once;
their occurrences are located from suffix positions sampled every SAMPLE places, turned into word
spans and merged.

Phrases: WINDOW consecutive words of an item; an item of fewer words, but not none, is one phrase.
Phrases are held as one array of word numbers and their places in it; a shard searches only those
whose words it has. A benchmark of more than BLOCK_BYTES is found in several passes over the
documents, one after another, each with its own part of it; between passes the rows are written and
the part is released, so what is broadcast is bounded.

Nulls: a null text has no words and no hits; a null item text has no phrases; a null item id is
named by the empty string. Empty tables give empty results (no items: no hits); repeated rows are
judged each, repeated items count once by id. Extra columns of any name and type are carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_name, small_batches, written
from .textcore import ALNUM_CLASS, chunks, column_bytes, mix, scan

WINDOW = 13
SAMPLE = 8
BLOCK_BYTES = 16 << 20
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the only smallest one."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, k = len(symbols), 1
    while True:
        after = np.full(n, 0, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Ranks of any symbol in a prefix, one bit of the symbol at a time."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        first, end = np.zeros_like(end), end.copy()
        for level, b in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (symbol >> b) & 1 == 1
            f, e = ones[first], ones[end]
            first = np.where(one, zeros + f, first - f)
            end = np.where(one, zeros + e, end - e)
        return end - first


class FMIndex:
    """Index of symbols >= 1; 0 is added at the end."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.most = int(text.max())
        self.wavelet = WaveletMatrix(self.bwt, max(1, self.most.bit_length()))
        self.before = np.zeros(self.most + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=self.most + 1), out=self.before[1:])
        self.kept = order % sample == 0
        self.place = np.cumsum(self.kept) - 1
        self.samples = order[self.kept]

    def search(self, words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with words[s : s + size], for each s of starts."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.bwt), np.int64)
        live = np.arange(len(starts))
        for k in reversed(range(size)):
            c = words[starts[live] + k]
            known = c <= self.most
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            if not len(live):
                break
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.kept[rows[live]]
            at = live[done]
            out[at] = self.samples[self.place[rows[at]]] + steps[at]
            live = live[~done]
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.wavelet.rank(c, rows[live])
            steps[live] += 1
        return out


def window_classes(words: np.ndarray, size: int) -> np.ndarray:
    """Of each place that has size words from it on a number that equal windows share; windows are joined from halves, so exactly."""
    n = len(words) - size + 1
    out, done, power, width = np.zeros(n, np.int64), 0, words.astype(np.int64), 1

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a << 32 | b, return_inverse=True)[1]

    while done < size:
        if (size >> (width.bit_length() - 1)) & 1:
            out = joined(out, power[done : done + n])
            done += width
        if done < size:
            power = joined(power[:-width], power[width:])
            width *= 2
    return out


class Phrases:
    """Different phrases of benchmark items: word numbers of all items in one array, and by length the phrases' places and items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        w = scan([t for _, t in items], ALNUM_CLASS)
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        owner = np.array([place[name] for name, _ in items], np.int32)[w.doc]
        self.vocabulary = np.unique(w.hashes)
        self.words = (np.searchsorted(self.vocabulary, w.hashes) + 2).astype(np.int32)  # 1 ends a run
        length, left = np.diff(w.at)[w.doc], w.at[1:][w.doc] - np.arange(len(w.hashes))  # of each word's item; words from it on
        size = np.minimum(length, window)
        #: By length: places of different phrases, where each one's items begin, and the items.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size).tolist():
            at = np.flatnonzero((size == n) & (left >= n))
            kind = window_classes(self.words, n)[at]
            pair, first = np.unique(kind * len(self.names) + owner[at], return_index=True)
            kind, lead = np.unique(pair // len(self.names), return_index=True)
            self.by_length[n] = at[first[lead]].astype(np.int64), np.append(lead, len(pair)), (pair % len(self.names)).astype(np.int32)
        self.shortest = min(self.by_length, default=0)

    def present(self, known: np.ndarray, size: int) -> np.ndarray:
        """Which phrases of a length have only words that are known (by number, less 2)."""
        lacks = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(~known[self.words - 2], out=lacks[1:])
        starts = self.by_length[size][0]
        return np.flatnonzero(lacks[starts + size] == lacks[starts])

    def find(self, texts: list[bytes | None]) -> tuple[object, list[np.ndarray], list[set[str]]]:
        """The scanned words; per text its hit spans (first word, word after the last), and its items."""
        w = scan(texts, ALNUM_CLASS)
        items: list[set[str]] = [set() for _ in texts]
        mark = np.zeros(len(w.hashes) + 1, np.int64)
        if self.shortest and len(w.hashes):
            at = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == w.hashes
            #: Runs: known words of one text without a gap.
            start = known.copy()
            start[1:] &= ~known[:-1]
            start[w.at[:-1][w.at[:-1] < len(known)]] |= known[w.at[:-1][w.at[:-1] < len(known)]]
            places = np.flatnonzero(known)
            run = np.cumsum(start)[places]
            keep = np.bincount(run)[run] >= self.shortest if len(run) else np.empty(0, bool)
            places, run = places[keep], run[keep]
            if len(places):
                cut = np.flatnonzero(np.append(np.diff(run) != 0, True)) + 1
                symbols = np.insert(at[places] + 2, cut, 1)
                origin = np.insert(places, cut, -1)
                index = FMIndex(symbols)
                doc = w.doc
                here = np.zeros(len(self.vocabulary), bool)
                here[at[places]] = True
                for size, (phrases, first_item, of) in self.by_length.items():
                    tried = self.present(here, size)
                    lo, hi = index.search(self.words, phrases[tried], size)
                    got = np.flatnonzero(lo < hi)
                    lo, counts, found = lo[got], (hi - lo)[got], tried[got]
                    if not len(found):
                        continue
                    rows = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    first = origin[index.locate(rows)]
                    np.add.at(mark, first, 1)
                    np.add.at(mark, first + size, -1)
                    pairs = np.unique(np.stack([doc[first], np.repeat(found, counts)], 1), axis=0)
                    for d, p in pairs.tolist():
                        items[d].update(self.names[k] for k in of[first_item[p] : first_item[p + 1]])
        hit = np.cumsum(mark[:-1]) > 0
        spans = []
        for a, b in zip(w.at, w.at[1:]):
            edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
            spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1))
        return w, spans, items


def merged(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Union of (first word, end word, first byte, end byte), in order; touching word spans become one."""
    out: list[tuple[int, ...]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], s[1]), last[2], max(last[3], s[3]))
        else:
            out.append(tuple(s))
    return out


SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "first_byte", "end_byte")])
FOUND = {"_words": "bigint", "_spans": f"array<{SPAN.simpleString()}>", "_items": "array<string>"}


def _pass(df: DataFrame, at: int, phrases) -> DataFrame:
    """df, whose last columns are those of FOUND, with the spans and items of these phrases added."""
    import pyarrow as pa

    span = pa.list_(pa.struct([(n, pa.int64()) for n in SPAN.names]))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for b in batches:
            texts = column_bytes(b.column(at))
            old_spans, old_items = b.column(len(names) - 2).to_pylist(), b.column(len(names) - 1).to_pylist()
            n_words, all_spans, all_items = [], [], []
            for x, y in chunks(texts, 1 << 22):
                w, spans, items = p.find(texts[x:y])
                n_words += np.diff(w.at).tolist()
                for i, (s, names_) in enumerate(zip(spans, items)):
                    first = int(w.at[i])
                    own = [(f, e, int(w.starts[first + f] - w.offsets[i]), int(w.ends[first + e - 1] - w.offsets[i])) for f, e in s.tolist()]
                    own += [tuple(v.values()) for v in old_spans[x + i] or ()]
                    all_spans.append([dict(zip(SPAN.names, m)) for m in merged(own)])
                    all_items.append(sorted(names_ | set(old_items[x + i] or ())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n_words, pa.int64()), pa.array(all_spans, span), pa.array(all_items, pa.list_(pa.string()))], names=names)

    return df.mapInArrow(run, df.schema)


def find(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df and a struct `contamination`: n_words, n_hit, spans (words and UTF-8 bytes), items (sorted ids), contaminated."""
    spark = df.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    own = [f"_r{i}" for i in range(len(df.columns))]
    out = df.toDF(*own).select(*own, *[F.lit(None).cast(t).alias(c) for c, t in FOUND.items()])
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        got = part.toArrow()  # about block_bytes
        items = list(zip(got.column(0).to_pylist(), column_bytes(got.column(1))))
        phrases = spark.sparkContext.broadcast(Phrases(items, window))
        out = _pass(out, df.columns.index(text_col), phrases)
        if k < blocks - 1:
            out = written(out, "pass")
            phrases.unpersist()
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, s: a + s.end_word - s.first_word)
    out = out.withColumn("_hit", hit)
    bad = (F.col("_hit") > 0) & (F.col("_hit") * SHARE >= F.col("_words"))
    made = F.struct(F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.col("_spans").alias("spans"), F.col("_items").alias("items"), bad.alias("contaminated"))
    return out.select(*[F.col(o).alias(n) for o, n in zip(own, df.columns)], made.alias(free_name(df, "contamination")))


def remove_spans(df: DataFrame, text_col: str = "text", found_col: str = "contamination") -> DataFrame:
    """df with the hit spans cut out of its texts (in bytes, so on word borders), found_col dropped."""
    text, spans = F.col(f"`{text_col}`").cast("binary"), F.col(f"`{found_col}`.spans")
    state = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit(b"").cast("binary").alias("out"))
    piece = lambda a, s: F.struct((s.end_byte + 1).alias("at"), F.concat(a.out, F.substring(text, a.at.cast("int"), (s.first_byte + 1 - a.at).cast("int"))).alias("out"))
    done = F.aggregate(spans, state, piece, lambda a: F.concat(a.out, F.substring(text, a.at.cast("int"), F.lit(2**31 - 1))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, done.cast("string")).otherwise(F.col(f"`{text_col}`"))).drop(found_col)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """df's rows that are not contaminated, whole and unchanged."""
    name = free_name(df, "contamination")
    return find(df, benchmark, text_col).where(f"not `{name}`.contaminated").drop(name)


def oracle() -> str:
    """DuckDB SQL of the query's rows."""
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), {upper}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN t ON d.rid = t.rid"""
