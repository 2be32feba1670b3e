"""Language identification by error-correcting output codes.

Each learned language has a codeword of +1 and -1; for each bit a binary classifier over hashed
byte n-grams (lengths NGRAMS, A-Z lower-cased) tells the languages with +1 from those with -1. The
classifiers are naive Bayes: their counts come from one pass over all training texts, as sums per
language and n-gram that merge in any order, and no sample is drawn. One text in FOLDS, by a hash of
it, is counted apart: classifiers without these measure on them how well each bit does, and then
they are added. Decoding adds each bit's logistic loss, weighted by that, and picks the language
with the least. A prediction is `ambiguous` if the runner-up is close.

Every language's codeword differs from any other in over a third of the bits (checked when the
code is made), so a few wrong bits are corrected.

Nulls: a null text, or one without a letter, is `und` with score 0; rows with a null language are
never trained on. Without training rows all is `und`. Empty tables give empty results, repeated
rows are judged each, whole texts are used whatever their length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_name, small_batches
from .textcore import LOWER, chunks, column_bytes

NGRAMS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTH = 0.5
#: Losses are computed on a mean log ratio per n-gram times this.
SHARPNESS = 8.0
#: A margin between the best two languages below this is ambiguous.
CLOSE = 0.2
UNKNOWN = "und"
#: At most so many languages are learned: the counts, BUCKETS * 8 bytes for each, go to the driver.
MOST_LANGUAGES = 400
#: One training text in so many measures the bits' weights.
FOLDS = 5
#: Tasks' sums meet in so many groups of tasks first, so that none adds up those of all tasks.
SALTS = 512


def code(languages: int) -> np.ndarray:
    """Codewords (languages x bits) of +1 and -1.

    Up to seven languages: the exhaustive code of 2 ** (n - 1) - 1 bits. Beyond, rows of a
    Hadamard matrix, in which any two rows differ in half of the columns.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 7:
        bits = [b for b in itertools.product((1, -1), repeat=languages) if b[0] == 1 and -1 in b]
        made = np.array(bits).T
    else:
        size = 1 << int(np.ceil(np.log2(languages + 1)))
        h = np.array([[1]])
        while len(h) < size:
            h = np.block([[h, h], [h, -h]])
        made = h[1 : languages + 1, 1:]
    for a, b in itertools.combinations(range(languages), 2):
        assert (made[a] != made[b]).sum() * 3 > made.shape[1]
    return made.astype(np.float64)


def grams(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Chunks of the texts: first, last, where each one's bytes start, and for each n-gram length the buckets by position.

    Places whose n-gram would leave the text have the bucket BUCKETS.
    """
    for first, last in chunks(texts, 1 << 20):
        parts = [(t or b"") for t in texts[first:last]]
        sizes = np.array([len(p) + 1 for p in parts])
        starts = np.cumsum(sizes) - sizes
        x = np.frombuffer((b"\n".join(parts) + b"\n").translate(LOWER), np.uint8).astype(np.uint32)
        left = np.repeat((starts + sizes - 1).astype(np.int32), sizes) - np.arange(len(x), dtype=np.int32)
        h, out = np.zeros(len(x), np.uint32), []
        for k in range(max(NGRAMS)):
            n = len(x) - k
            h = h.copy()
            h[:n] = h[:n] * np.uint32(0x01000193) + x[k:] + np.uint32(k + 1)
            if k + 1 in NGRAMS:
                own = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
                own[left < k + 1] = BUCKETS
                out.append(own)
        yield first, last, starts, out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model:
    """Codewords, the classifiers' log ratios (bits x n-grams), priors and bit weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, code(len(languages))
        bits = self.code.shape[1]
        self.ratio = np.zeros((bits, BUCKETS), np.float32)
        for b in range(bits if len(languages) > 1 else 0):
            #: Languages count alike on either side, so that a hot one does not drown the others.
            p = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
            self.ratio[b] = np.log(p[self.code[:, b] > 0].mean(0)) - np.log(p[self.code[:, b] < 0].mean(0))
        self.weights = np.ones(bits)

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        """Per text and bit the mean log ratio of its n-grams, 0 for an empty one."""
        out = np.zeros((len(texts), len(self.ratio)))
        ratio = np.concatenate([self.ratio, np.zeros((len(self.ratio), 1), np.float32)], axis=1)
        for first, last, starts, orders in grams(texts):
            n = sum(np.add.reduceat(h < BUCKETS, starts, dtype=np.int64) for h in orders)
            for b, r in enumerate(ratio):
                out[first:last, b] = sum(np.add.reduceat(r[h], starts, dtype=np.float64) for h in orders) / np.maximum(n, 1)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the language's place, its share of exp(-loss), and the margin over the runner-up."""
        loss = np.stack([(np.logaddexp(0, -SHARPNESS * margins * c) * self.weights).sum(1) for c in self.code], 1)
        near = np.exp(-(loss - loss.min(1, keepdims=True)))
        share = near / near.sum(1, keepdims=True)
        best = share.argmax(1)
        top = np.sort(share, 1)
        return best, share[np.arange(len(best)), best], top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)


def _counts(training: DataFrame, languages: list[str]) -> np.ndarray:
    """n-gram counts of each fold and language over all training rows (two folds: those that measure, and the rest).

    A row per task, language and n-gram block is shuffled; sums of SALTS groups of tasks are summed then.
    """
    import pyarrow as pa

    place, blocks = {x: i for i, x in enumerate(languages)}, 64
    names, types = ["fold", "k", "j", "salt", "v"], [pa.int32()] * 4 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            texts, at, fold = column_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()
            for key in sorted(set(zip(fold, at))):
                own = total.setdefault((key[0], place[key[1]]), np.zeros(BUCKETS + 1, np.int64))
                for _, _, _, orders in grams([t for t, f, x in zip(texts, fold, at) if (f, x) == key]):
                    for h in orders:
                        own += np.bincount(h, minlength=BUCKETS + 1)
        rows = [(f, k, j, salt, v[j * BUCKETS // blocks : (j + 1) * BUCKETS // blocks].tobytes()) for (f, k), v in total.items() for j in range(blocks)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // blocks, np.int64)
        for v in table.column("v"):
            total += np.frombuffer(v.as_buffer(), np.int64)
        return table.slice(0, 1).set_column(4, "v", pa.array([total.tobytes()], pa.binary()))

    kind = "fold int, k int, j int, salt int, v binary"
    sums = training.select("_text", "_lang", "_fold").mapInArrow(run, kind).groupBy("fold", "k", "j", "salt").applyInArrow(add, kind)
    out = np.zeros((2, len(languages), BUCKETS), np.int64)
    for f, k, j, _, v in sums.groupBy("fold", "k", "j").applyInArrow(add, kind).collect():  # 2 * languages * blocks rows
        out[f, k, j * BUCKETS // blocks : (j + 1) * BUCKETS // blocks] = np.frombuffer(v, np.int64)
    return out


def _weights(training: DataFrame, model: Model) -> np.ndarray:
    """Of each bit the log odds of its being right on these rows, scaled to a mean of 1."""
    import pyarrow as pa

    shared = training.sparkSession.sparkContext.broadcast(model)
    bits = model.code.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place, right, n = {x: i for i, x in enumerate(m.languages)}, np.zeros(bits, np.int64), 0
        for b in batches:
            at = np.array([place.get(x, -1) for x in b.column(1).to_pylist()], int)
            own = np.flatnonzero(at >= 0)
            right += (m.margins(column_bytes(b.column(0)))[own] * m.code[at[own]] > 0).sum(0)
            n += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits + 1, dtype=np.int32)), pa.array(np.append(right, n))], names=["bit", "n"])

    rows = dict(training.select("_text", "_lang").mapInArrow(run, "bit int, n bigint").groupBy("bit").agg(F.sum("n")).collect())  # a row per bit
    n = rows.get(bits, 0)
    p = np.array([(rows.get(b, 0) + 1) / (n + 2) for b in range(bits)])
    w = np.maximum(np.log(p / (1 - p)), 1e-3)
    return w / w.mean()


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", weigh: bool = True) -> Model:
    """A model from all rows of df with a language."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang")).where("_lang is not null and _text is not null")
    rows = rows.withColumn("_fold", (F.pmod(F.xxhash64(F.lit("fold"), "_text"), F.lit(FOLDS)) == 0).cast("int"))
    languages = sorted(r[0] for r in rows.select("_lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages; raise MOST_LANGUAGES if the driver can hold {BUCKETS * 8} bytes for each")
    rest, measuring = _counts(rows, languages)
    model = Model(languages, rest + measuring)
    if weigh and len(languages) > 1:
        model.weights = _weights(rows.where("_fold = 1"), Model(languages, rest))
    return model


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df and a struct `language`: lang (a learned one or `und`), score (0 to 1), ambiguous."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bits * BUCKETS * 4 bytes
    own = [f"_r{i}" for i in range(len(df.columns))]
    plain, at = df.toDF(*own), df.columns.index(text_col)
    schema = T.StructType([*plain.schema.fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = column_bytes(b.column(at))
            known = np.array([bool(m.languages) and has_letter(t.decode() if t else None) for t in texts], bool)
            if m.languages:
                best, share, margin = m.decode(m.margins(texts))
                langs = [m.languages[k] if y else UNKNOWN for k, y in zip(best, known)]
            else:
                share = margin = np.zeros(len(texts))
                langs = [UNKNOWN] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(~known | (margin < CLOSE))], names=[*own, "_lang", "_score", "_ambiguous"])

    made = plain.mapInArrow(run, schema)
    struct = F.struct(F.col("_lang").alias("lang"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))
    return made.select(*[F.col(o).alias(n) for o, n in zip(own, df.columns)], struct.alias(free_name(df, "language")))
