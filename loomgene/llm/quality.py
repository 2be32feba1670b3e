"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

A sketch counts integers in bins that keep their SKETCH_BITS leading bits, so a quantile is off by
at most one part in 2 ** (SKETCH_BITS - 1), any two sketches merge by adding counts, and the order
of merging cannot matter. Only rows that pass the base rules are sketched. Rates are counts plus one
over units plus one, so a short text without symbols is no proof of a rate of zero and every group has
a spread. Rates are skewed, so widths are ratios: with the quantiles MIDDLE and OUTER of a group,
its upper fence is outer * (outer / middle) ** WIDTH, its lower one the same with 1 - OUTER. No
fixed cutoff enters. So that a group that is mostly junk does not set its own standard, the fence
of its language with LANG_WIDTH bounds its own. Groups with fewer than LEAST_ROWS rows take the
merged sketch of their language, and languages with fewer that of all rows.

Nulls: a null text has no words; a null language or source is a group like any other. A group
without rows that pass the base rules has no fences. An empty table gives an empty result. Repeated
rows count each. Extra columns are carried, whatever their names and types.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches, written
from .textcore import SPACE_CLASS, chunks, column_bytes, mix, scan

SKETCH_BITS = 6
MIDDLE, OUTER = 50, 90  # per cent
WIDTH, LANG_WIDTH = 2.25, 2.5
LEAST_ROWS = 50
#: Of each rate: its counts, its units, and per how many units it is taken.
RATES = {"symbol_rate": ("n_symbols", "n_words", 10_000), "repeat_rate": ("n_repeat_words", "n_words", 10_000), "dup_line_rate": ("n_dup_lines", "n_lines", 10_000), "upper_rate": ("n_upper", "word_chars", 10_000), "word_length": ("word_chars", "n_words", 1_000)}
#: Rates that are judged below as well as above.
BOTH_SIDES = ("word_length",)
#: Characters counted as symbols
SYMBOLS = b"#*$%&|<>"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: At most so many groups are sent to every executor.
BROADCAST_GROUPS = 100_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def repeated_words(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text the words that lie in a 3-word window found twice or more in the text."""
    n = len(hashes)
    covered = np.zeros(n + 3, bool)
    if n >= 3:
        doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
        with np.errstate(over="ignore"):
            window = mix(hashes[:-2] * _A + mix(hashes[1:-1] * _B + mix(hashes[2:] * _C + doc[2:])))
        window = np.where(doc[:-2] == doc[2:], window, np.uint64(0))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        places = order[twice]
        places = places[doc[places] == doc[places + 2]]
        for k in range(3):
            covered[places + k] = True
    return _per_text(covered[:n], at)


def measure(texts: list[bytes | None]) -> np.ndarray:
    """SIGNALS of each text, as rows of an array."""
    out = np.zeros((len(texts), len(SIGNALS)), np.int64)
    symbol = np.isin(np.arange(256), list(SYMBOLS))
    for a, b in chunks(texts, 1 << 20):
        w = scan(texts[a:b], SPACE_CLASS, lower=False)
        raw = np.frombuffer(w.data, np.uint8)
        inside = np.frombuffer(SPACE_CLASS, np.uint8)[raw]
        dup = []
        for t in texts[a:b]:
            lines = [x for x in (t or b"").split(b"\n") if x.strip()]
            dup.append((len(lines) - len(set(lines)), len(lines)))
        dup = np.array(dup, np.int64).reshape(-1, 2)
        out[a:b] = np.stack(
            [np.diff(w.at), _per_text(inside.astype(bool) & ((raw & 0xC0) != 0x80), w.offsets), _per_text(symbol[raw], w.offsets), dup[:, 0], repeated_words(w.hashes, w.at), dup[:, 1], _per_text((raw >= 65) & (raw <= 90), w.offsets)],
            axis=1,
        )
    return out


def signals(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per row of df: the columns `carry`, then sig, a struct of SIGNALS."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    carry = carry or []
    source = df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    own = [f"_c{i}" for i in range(len(carry))]
    made_names = [f"_s{i}" for i in range(len(SIGNALS))]
    schema = T.StructType([*source.schema.fields[1:], *[T.StructField(n, T.LongType()) for n in made_names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(column_bytes(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(m[:, i]) for i in range(len(SIGNALS)))], names=[*own, *made_names])

    made = source.mapInArrow(run, schema)
    sig = F.struct(*[F.col(n).alias(s) for n, s in zip(made_names, SIGNALS)])
    return made.select(*[F.col(o).alias(c) for o, c in zip(own, carry)], sig.alias("sig"))


def rates(sig: str = "sig") -> dict[str, Column]:
    """Integer rates of RATES: (counts + 1) * per div (units + 1)."""
    return {k: F.expr(f"({sig}.{a} + 1) * {per} div ({sig}.{b} + 1)") for k, (a, b, per) in RATES.items()}


def sketch(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketch of every rate: (groups, metric, bin, n); rows has the groups and sig."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rates().items()])).alias("m")
    flat = rows.where(~base_failed()).select(*groups, pairs).select(*groups, "m.metric", "m.value")
    shift = f"greatest(0, length(bin(value)) - {SKETCH_BITS})"
    return flat.withColumn("bin", F.expr(f"shiftleft(shiftright(value, {shift}), {shift})")).groupBy(*groups, "metric", "bin").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, total, low, middle, outer) from sketches that may come in parts; each at least 1."""
    keys = [*groups, "metric"]
    by = ", ".join(keys)
    merged = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    run = merged.selectExpr(*keys, "bin", f"sum(n) over (partition by {by} order by bin) as upto", f"sum(n) over (partition by {by}) as total")
    last = F.expr(f"bin + shiftleft(1L, greatest(0, length(bin(bin)) - {SKETCH_BITS})) - 1")  # of a bin, so that the fence is no lower than the values it is made of
    at = lambda per_cent, value: F.greatest(F.lit(1), F.min(F.when(F.col("upto") * 100 >= F.col("total") * per_cent, value))).cast("double")
    return run.groupBy(*keys).agg(F.max("total").alias("total"), at(100 - OUTER, F.col("bin")).alias("low"), at(MIDDLE, F.col("bin")).alias("middle"), at(OUTER, last).alias("outer"))


def thresholds(rows: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(g_lang, g_source, lo_<rate>, hi_<rate>): of every language and source the fences."""
    fine = written(sketch(rows.select(F.col(f"`{lang_col}`").alias("g_lang"), F.col(f"`{source_col}`").alias("g_source"), "sig"), ["g_lang", "g_source"]), "sketch")
    points = ("low", "middle", "outer")
    own = quantiles(fine, ["g_lang", "g_source"])
    lang = quantiles(fine, ["g_lang"]).select(F.col("g_lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("total").alias("l_total"), *[F.col(q).alias(f"l_{q}") for q in points])
    every = quantiles(fine, []).select(F.col("metric").alias("a_metric"), *[F.col(q).alias(f"a_{q}") for q in points])
    both = own.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(every, F.col("metric") == F.col("a_metric"))
    wide = both.select("g_lang", "g_source", "metric", "total", *points, *[F.when(F.col("l_total") >= LEAST_ROWS, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}")).alias(f"l_{q}") for q in points])
    picked = wide.select("*", *[F.when(F.col("total") >= LEAST_ROWS, F.col(q)).otherwise(F.col(f"l_{q}")).alias(f"p_{q}") for q in points])
    fence = lambda end, middle, width: F.col(end) * F.pow(F.col(end) / F.col(middle), F.lit(float(width)))
    lo = F.greatest(fence("p_low", "p_middle", WIDTH), fence("l_low", "l_middle", LANG_WIDTH))
    hi = F.least(fence("p_outer", "p_middle", WIDTH), fence("l_outer", "l_middle", LANG_WIDTH))
    #: Whole numbers, so that the last bit of a power can't decide.
    fences = picked.select("g_lang", "g_source", "metric", F.ceil(F.round(lo, 6)).alias("lo"), F.floor(F.round(hi, 6)).alias("hi"))
    return fences.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("metric") == k, F.col(side))).alias(f"{side}_{k}") for k in RATES for side in ("lo", "hi")])


def base_failed() -> Column:
    """The fixed rules: under 50 words, or over half of the words in repeated windows."""
    return F.expr("sig.n_words < 50 or 100 * sig.n_repeat_words > 50 * sig.n_words")


def judge(rows: DataFrame, fences: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """rows (with sig) and base_failed, kept: joined with its group's fences, a row outside any is rejected."""
    fences = written(fences, "fences")
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    joined = rows.join(fences, F.col(f"`{lang_col}`").eqNullSafe(F.col("g_lang")) & F.col(f"`{source_col}`").eqNullSafe(F.col("g_source")), "left")
    r = rates()
    outside = [r[k] > F.col(f"hi_{k}") for k in RATES] + [r[k] < F.col(f"lo_{k}") for k in BOTH_SIDES]
    bad = functools.reduce(lambda x, y: x | y, outside)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).drop("g_lang", "g_source", *[f"{s}_{k}" for k in RATES for s in ("lo", "hi")])


def drop_low_quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """df's rows that the rules keep, whole and unchanged.

    Signals are computed once and written beside the rows; thresholds read the signals alone, and texts are never shuffled.
    """
    own = [f"_r{i}" for i in range(len(df.columns))]
    plain = df.toDF(*own)
    of = dict(zip(df.columns, own))
    measured = written(signals(plain, of[text_col], own), "measured")
    judged = judge(measured, thresholds(measured, of[lang_col], of[source_col]), of[lang_col], of[source_col])
    return judged.where("kept").select(*[F.col(o).alias(c) for o, c in zip(own, df.columns)])


def oracle() -> str:
    """DuckDB SQL of the query's rows."""
    rate = {k: f"(({a} + 1) * {per} // ({b} + 1))" for k, (a, b, per) in RATES.items()}
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    flat = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS value FROM sig WHERE NOT {failed}" for k, v in rate.items())
    last = f"bin + (1::BIGINT << CAST(greatest(0, length(bin(bin)) - {SKETCH_BITS}) AS INTEGER)) - 1"
    at = lambda p, value="bin": f"CAST(greatest(1, min({value}) FILTER (upto * 100 >= total * {p})) AS DOUBLE)"
    q = lambda by: f"SELECT {by}metric, max(total) AS total, {at(100 - OUTER)} AS low, {at(MIDDLE)} AS middle, {at(OUTER, last)} AS outr FROM (SELECT {by}metric, bin, sum(n) OVER (PARTITION BY {by}metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS total FROM (SELECT {by}metric, bin, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"
    points = ("low", "middle", "outr")
    lang = ", ".join(f"CASE WHEN l.total >= {LEAST_ROWS} THEN l.{c} ELSE a.{c} END AS l_{c}" for c in points)
    own = ", ".join(f"CASE WHEN total >= {LEAST_ROWS} THEN {c} ELSE l_{c} END AS p_{c}" for c in points)
    fence = lambda end, middle, w: f"{end} * pow({end} / {middle}, {w})"
    lo = f"greatest({fence('p_low', 'p_middle', WIDTH)}, {fence('l_low', 'l_middle', LANG_WIDTH)})"
    hi = f"least({fence('p_outr', 'p_middle', WIDTH)}, {fence('l_outr', 'l_middle', LANG_WIDTH)})"
    bad = " OR ".join([f"(f.metric = '{k}' AND {rate[k]} > f.hi)" for k in RATES] + [f"(f.metric = '{k}' AND {rate[k]} < f.lo)" for k in BOTH_SIDES])
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
places AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM places),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
sig AS (SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM docs d JOIN words USING (rid) JOIN lines USING (rid) LEFT JOIN repeated r USING (rid)),
flat AS ({flat}),
shifted AS (SELECT lang, source, metric, value, CAST(greatest(0, length(bin(value)) - {SKETCH_BITS}) AS INTEGER) AS s FROM flat),
sketch AS (SELECT lang, source, metric, (value >> s) << s AS bin, count(*) AS n FROM shifted GROUP BY ALL),
own AS ({q("lang, source, ")}), per_lang AS ({q("lang, ")}), every AS ({q("")}),
wide AS (SELECT o.lang, o.source, o.metric, o.total, o.low, o.middle, o.outr, {lang}
  FROM own o JOIN per_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN every a ON o.metric = a.metric),
picked AS (SELECT lang, source, metric, l_low, l_middle, l_outr, {own} FROM wide),
fences AS (SELECT lang, source, metric, ceil(round({lo}, 6)) AS lo, floor(round({hi}, 6)) AS hi FROM picked),
bad AS (SELECT DISTINCT s.rid FROM sig s JOIN fences f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source WHERE {bad})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {failed} AS base_failed, NOT {failed} AND b.rid IS NULL AS kept
FROM sig s LEFT JOIN bad b ON s.rid = b.rid"""
