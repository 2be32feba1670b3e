"""URL filter: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

One pass of the automaton over the lower-cased url finds all strict and soft terms; a hit counts if
no letter or digit (a-z, 0-9) stands right before or after it. A url is blocked on one strict hit
or on SOFT_LIMIT different soft terms. Rules decide first, the longest that fits.

The vocabulary may be a table of its own (term, kind: strict or soft; see vocabulary()); STRICT and
SOFT are only a small default. It is sent to every executor, so it is read behind a check of its size.

Nulls: a null url, or one without `://`, has an empty host and path; a null url has no hits. Null and
empty terms are left out; a term listed as strict and soft is strict. Empty tables give empty results,
repeated rows are judged each, extra columns of any name and type are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_name

#: Rules as verdict, host, path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Terms that block alone, and those of which several must be there
STRICT = ("casino", "escort", "free-bets", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bets", "bonus", "cheap", "crack", "deal", "discount", "farm", "free", "jackpot", "loan", "pills", "poker", "spam", "win")
SOFT_LIMIT = 2
#: Most bytes of terms that are sent to the executors.
TERM_BYTES = 64 << 20
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_FOLD = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_FOLD), tail[:stop]


def fits(host: str, path: str, rule: tuple[str, str, str]) -> bool:
    return (host == rule[1] or host.endswith("." + rule[1])) and path.startswith(rule[2])


def vocabulary(table: DataFrame, term_col: str = "term", kind_col: str = "kind") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table, A-Z in lower case; more than TERM_BYTES of them are an error."""
    terms = table.select(F.translate(term_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term"), F.col(kind_col).alias("kind")).where("length(term) > 0 and kind in ('strict', 'soft')").distinct()
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > TERM_BYTES:
        raise ValueError(f"{size} bytes of terms; at most {TERM_BYTES} are sent to the executors")
    rows = terms.collect()
    return tuple(sorted(r.term for r in rows if r.kind == "strict")), tuple(sorted(r.term for r in rows if r.kind == "soft"))


def build(strict: tuple[str, ...], soft: tuple[str, ...]):
    """The automaton over both lists."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            machine.add_word(t, (kind, t))
    machine.make_automaton()
    return machine


def hits(machine, url: str | None) -> tuple[int, int]:
    """Strict hits (all) and different soft terms, with boundary checks."""
    text = (url or "").translate(_FOLD)
    strict, soft = 0, set()
    for end, (kind, term) in machine.iter(text):
        first = end - len(term)
        if (first < 0 or text[first] not in LETTERS) and (end + 1 == len(text) or text[end + 1] not in LETTERS):
            if kind == "strict":
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def judge(df: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """df and a struct `url_verdict` (host, path, rule, verdict, n_strict, n_soft); underscores go before a name that is taken."""
    import pyarrow as pa

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    own = [f"_r{i}" for i in range(len(df.columns))]
    plain = df.toDF(*own)
    at = df.columns.index(url_col)
    kinds = {"_host": "string", "_path": "string", "_rule": "string", "_verdict": "string", "_strict": "bigint", "_soft": "bigint"}
    schema = T.StructType([*plain.schema.fields, *[T.StructField(k, T.LongType() if v == "bigint" else T.StringType()) for k, v in kinds.items()]])
    terms = df.sparkSession.sparkContext.broadcast((tuple(strict), tuple(soft)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = build(*terms.value)
        for b in batches:
            out = []
            for url in b.column(at).to_pylist():
                host, path = split_url(url)
                rule = next((r for r in ordered if fits(host, path, r)), None)
                n, m = hits(machine, url)
                out.append((host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if n or m >= soft_limit else "allow", n, m))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64() if v == "bigint" else pa.string()) for c, v in zip(cols, kinds.values()))], names=[*own, *kinds])

    made = plain.mapInArrow(run, schema)
    verdict = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"), F.col("_strict").alias("n_strict"), F.col("_soft").alias("n_soft"))
    return made.select(*[F.col(o).alias(n) for o, n in zip(own, df.columns)], verdict.alias(free_name(df, "url_verdict")))


def oracle() -> str:
    """DuckDB SQL of the query's rows."""
    quoted = lambda s: s.replace("'", "''")
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    bound = "[^a-z0-9]"
    strict = " + ".join(f"CAST(regexp_matches(low, '(^|{bound}){t}($|{bound})') AS BIGINT)" for t in STRICT)
    soft = " + ".join(f"CAST(regexp_matches(low, '(^|{bound}){t}($|{bound})') AS BIGINT)" for t in SOFT)
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    pick = lambda k: " ".join(f"WHEN {fit(r)} THEN '{quoted(r[0] if k else r[1] + r[2])}'" for r in rules)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), {upper}) AS low FROM pages),
r AS (SELECT page_id, low, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {upper}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {pick(0)} END AS rule,
  CASE {pick(1)} WHEN ({strict}) > 0 OR ({soft}) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM p"""
