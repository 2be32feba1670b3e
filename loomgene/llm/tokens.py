"""Token counts: an exact histogram of encoded lengths, and what follows from it for any context limit.

Texts are encoded whole with a public vocabulary (its file is a parameter, present on every
executor), one number per text is aggregated, and the histogram has a row for each length that
occurs. Suffix sums then answer, for every limit, how many documents are as long or longer, and
how many tokens remain if documents are cut at the limit. Sums run over blocks of lengths first, so
no task gets the whole histogram of a corpus with many lengths.

Nulls: a null text counts as empty, with 0 tokens. An empty table gives an empty histogram,
repeated rows count each. Long texts are encoded whole, in pieces that tokens do not cross: a token
never holds what stands before white space and white space too, and of a blank run all but the last
character is one piece (the last begins the next). So long blank runs, on which the library's
pattern matcher would overflow its stack, go to the byte-pair merges directly.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written

#: A public vocabulary's place, and the pattern by which its library splits texts before merging
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths are summed in blocks of 2 ** BLOCK_BITS.
BLOCK_BITS = 7
#: Characters with the property White_Space
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of a blank run that bypasses the pattern, and of a piece of a long text.
LONG_BLANK, PIECE = 1 << 10, 1 << 18
_LONG = re.compile(f"[{BLANK}]{{{LONG_BLANK},}}")
_BORDER = re.compile(f"(?<=[^{BLANK}])[{BLANK}]")


@functools.lru_cache(4)
def encoder(ranks: str = RANKS, pattern: str = PATTERN):
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text, each encoded on its own, and whether one is a single piece of the pattern."""
    at = 0
    for blank in [*_LONG.finditer(text), None]:
        end = blank.start() if blank else len(text)
        while at < end:
            border = _BORDER.search(text, at + PIECE, end) if end - at > PIECE else None
            cut = border.start() if border else end
            yield text[at:cut], False
            at = cut
        if blank:
            at = blank.end() if blank.end() == len(text) else blank.end() - 1
            yield text[end:at], True


def encoded_length(text: str | None, ranks: str = RANKS, pattern: str = PATTERN) -> int:
    """Number of tokens. Texts are cut if the pattern is PATTERN; another may let tokens cross white space."""
    if not text:
        return 0
    own = encoder(ranks, pattern)
    if pattern != PATTERN:
        return len(own.encode_ordinary(text))
    return sum(len(own._encode_single_piece(t) if whole else own.encode_ordinary(t)) for t, whole in _pieces(text))


def lengths(df: DataFrame, text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens) of every row of df."""
    import pyarrow as pa

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoded_length(t, ranks, pattern) for t in b.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return df.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "n_tokens bigint")


def histogram(df: DataFrame, text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs) for each length that occurs."""
    return lengths(df, text_col, ranks, pattern).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds docs_at_least, tokens_at_least (of documents as long or longer), truncated_total (all, cut at n_tokens), total and quantile (share of documents no longer)."""
    h = hist.withColumn("block", F.shiftright("n_tokens", BLOCK_BITS)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = blocks.selectExpr("block as b", "sum(b_docs) over (order by block desc) - b_docs as docs_after", "sum(b_tokens) over (order by block desc) - b_tokens as tokens_after", "sum(b_docs) over () as all_docs", "sum(b_tokens) over () as total")
    both = h.join(after, h.block == after.b)
    own = both.selectExpr("*", "docs_after + sum(docs) over (partition by block order by n_tokens desc) as docs_at_least", "tokens_after + sum(tokens) over (partition by block order by n_tokens desc) as tokens_at_least")
    return own.selectExpr("n_tokens", "docs", "docs_at_least", "tokens_at_least", "total - tokens_at_least + n_tokens * docs_at_least as truncated_total", "total", "cast(all_docs - docs_at_least + docs as double) / all_docs as quantile")


def at_limits(sums: DataFrame, limits: DataFrame, limit_col: str = "limit") -> DataFrame:
    """Of each context limit (non-negative, distinct): docs_longer, and truncated_total.

    The next longer length that occurs answers: between lengths the suffix sums do not change.
    """
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    known = sums.selectExpr("n_tokens as at", "docs_at_least", "tokens_at_least", "cast(null as bigint) as asked")
    limits_ = limits.select((F.col(limit_col) + 1).cast("bigint").alias("at"), *[F.lit(None).cast("bigint").alias(c) for c in ("docs_at_least", "tokens_at_least")], F.col(limit_col).cast("bigint").alias("asked"))
    marks = known.unionByName(limits_).withColumn("block", block)
    w = "over (partition by block order by at desc, asked nulls first)"
    own = marks.selectExpr("block", "asked", f"last(docs_at_least, true) {w} as n", f"last(tokens_at_least, true) {w} as t").where("asked is not null")
    #: Where a block has no longer length, the shortest one of a later block answers.
    blocks = marks.groupBy("block").agg(F.max("docs_at_least").alias("n"), F.max("tokens_at_least").alias("t"))
    w = "over (order by block desc rows between unbounded preceding and 1 preceding)"
    later = blocks.selectExpr("block as b", f"last(n, true) {w} as later_n", f"last(t, true) {w} as later_t", "max(t) over () as every")
    both = own.join(later, own.block == later.b)
    return both.selectExpr("asked as limit", "coalesce(n, later_n, 0) as docs_longer", "coalesce(every, 0) - coalesce(t, later_t, 0) + asked * coalesce(n, later_n, 0) as truncated_total")


def token_counts(df: DataFrame, text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The histogram of df with its suffix sums."""
    return with_suffix_sums(written(histogram(df, text_col, ranks, pattern), "histogram"))
