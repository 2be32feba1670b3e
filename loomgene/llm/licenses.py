"""License scans: an exact containment join of text blocks and license templates.

A template is a set of words, sorted by how often each occurs in all documents, rarest first. A
block meets a template if it has at least ceil(THRESHOLD * words of the template) of them. Such a
block must hold one of the template's first |T| - overlap + 1 words (prefix filter), so only those
rare words are looked up in an inverted index; it must hold enough template words at all (length
filter), and enough of them from the match on in the global order (positional filter). What is
left is counted exactly.

Blocks follow the templates' lengths: a template of up to 2 ** k words (and of more than half as
many) is held against windows of 2 * 2 ** k words, one every 2 ** k words, so any stretch as long
as the template lies in one whole, and a short template is never spread over a long block. A text
of fewer words is one block. Templates may be a table (see templates_of()); it is sent to every
executor, so it is read behind a check of its size.

Besides, fixed phrases are found wherever their words stand consecutively.

Nulls: a null text is empty and has no labels; templates without words or with a null label are
left out. Empty tables give empty results, repeated rows are judged each, whole texts are scanned
whatever their length, extra columns of any name and type are carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_name, small_batches
from .textcore import ALNUM_CLASS, LOWER, chunks, column_bytes, scan

#: Phrases and their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Wording of licenses and their labels
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Whole license texts and their labels
FULL_TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the
name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in
a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License.""",
    ),
)
THRESHOLD = 0.9
#: Most bytes of a table of templates.
TEMPLATE_BYTES = 16 << 20
ALL_TEMPLATES = TEMPLATES + FULL_TEXTS


def _hashes(words: str) -> np.ndarray:
    return scan([words.encode()], ALNUM_CLASS).hashes


def words_of(text: str) -> list[str]:
    """A template's words, repeats included."""
    w = scan([text.encode()], ALNUM_CLASS)
    return [w.data[a:b].translate(LOWER).decode() for a, b in zip(w.starts.tolist(), w.ends.tolist())]


def step_of(words: list[str]) -> int:
    """Words from one block to the next for a template; a block has twice as many."""
    return 1 << (len(words) - 1).bit_length()


def templates_of(table: DataFrame, label_col: str = "label", text_col: str = "text") -> tuple[tuple[str, str], ...]:
    """Label and text of each row; more than TEMPLATE_BYTES are an error."""
    rows = table.select(F.col(f"`{label_col}`").alias("label"), F.col(f"`{text_col}`").alias("text")).where("label is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; at most {TEMPLATE_BYTES} are sent to the executors")
    return tuple(sorted((r.label, r.text) for r in rows.collect() if words_of(r.text)))


def vocabulary(templates=ALL_TEMPLATES) -> list[str]:
    """All words of the templates."""
    return sorted({w for _, t in templates for w in words_of(t)})


def word_frequencies(df: DataFrame, text_col: str = "text", templates=ALL_TEMPLATES) -> dict[str, int]:
    """How often each template word occurs in all documents: a row for each word and task is shuffled."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    words = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, order = _sorted_words(words)
        total = np.zeros(len(words), np.int64)
        for b in batches:
            texts = column_bytes(b.column(0))
            for x, y in chunks(texts):
                ids = _ids(scan(texts[x:y], ALNUM_CLASS).hashes, table)
                total += np.bincount(order[ids[ids >= 0]], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total)], names=["word", "n"])

    rows = df.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per template word
    return {w: 0 for w in words} | {r.word: r.n for r in rows}


def _sorted_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([_hashes(w)[0] for w in words], np.uint64)
    order = np.argsort(h)
    return h[order], order


def _ids(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


class Index:
    """Templates over globally ordered words, and the inverted index of their prefixes."""

    def __init__(self, frequency: dict[str, int], templates=ALL_TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES):
        ranked = sorted(frequency, key=lambda w: (frequency[w], w))
        rank = {w: i for i, w in enumerate(ranked)}
        self.table, order = _sorted_words(ranked)
        self.rank = order
        self.labels = [label for label, _ in templates]
        words = [words_of(t) for _, t in templates]
        self.templates = [sorted({rank[x] for x in w}) for w in words]
        self.need = [math.ceil(threshold * len(t) - 1e-9) for t in self.templates]
        #: By step: the inverted index of its templates' prefixes, which words are in it, and the least overlap.
        self.by_step: dict[int, tuple[dict[int, list[tuple[int, int]]], np.ndarray, int]] = {}
        for k, (w, t, need) in enumerate(zip(words, self.templates, self.need)):
            prefix, probe, least = self.by_step.get(step_of(w), ({}, np.zeros(len(ranked), bool), need))
            for place, r in enumerate(t[: len(t) - need + 1]):
                prefix.setdefault(r, []).append((k, place))
                probe[r] = True
            self.by_step[step_of(w)] = prefix, probe, min(least, need)
        self.sets = [set(t) for t in self.templates]
        self.phrases = [(_hashes(p), label) for p, label in phrases]

    def block(self, ranks: list[int], prefix: dict[int, list[tuple[int, int]]]) -> dict[str, float]:
        """Labels that a block with these words (in global order) meets, and the containment; prefix: the inverted index."""
        found: dict[str, float] = {}
        seen: set[int] = set()
        own = set(ranks)
        for q, r in enumerate(ranks):
            for k, place in prefix.get(r, ()):
                need, t = self.need[k], self.templates[k]
                if k in seen or len(ranks) < need or len(ranks) - q < need or len(t) - place < need:  # length, position in the block, in the template
                    continue
                seen.add(k)
                overlap = len(own & self.sets[k])
                if overlap >= need:
                    found[self.labels[k]] = max(found.get(self.labels[k], 0.0), overlap / len(t))
        return found

    def judge(self, texts: list[bytes | None]) -> list[tuple]:
        """Per text: n_words, n_base, first_word, last_word, base labels, method's labels with containment, blocks."""
        w = scan(texts, ALNUM_CLASS)
        n, doc = len(w.hashes), w.doc
        places: list[tuple[np.ndarray, str]] = []
        for h, label in self.phrases:
            hit = np.ones(max(0, n - len(h) + 1), bool)
            for k, x in enumerate(h):
                hit &= w.hashes[k : n - len(h) + 1 + k] == x
            at = np.flatnonzero(hit)
            places.append((at[doc[at] == doc[at + len(h) - 1]], label))
        ids = _ids(w.hashes, self.table)
        ranks = np.where(ids >= 0, self.rank[ids], -1)
        met: dict[int, list[dict]] = {}
        for step, (prefix, probe, least) in self.by_step.items():
            probes = np.flatnonzero((ranks >= 0) & probe[ranks])
            k = (probes - w.at[doc[probes]]) // step
            both = np.stack([np.concatenate([doc[probes], doc[probes]]), np.concatenate([k, k - 1])], 1)
            known = np.concatenate([[0], np.cumsum(ranks >= 0)])
            for d, k in np.unique(both[both[:, 1] >= 0], axis=0).tolist():
                a, b = int(w.at[d]), int(w.at[d + 1])
                x, y = a + k * step, min(b, a + (k + 2) * step)
                if known[y] - known[x] < least:
                    continue
                block = ranks[x:y]
                for label, c in self.block(np.unique(block[block >= 0]).tolist(), prefix).items():
                    met.setdefault(d, []).append({"first_word": x - a, "end_word": y - a, "label": label, "containment": c})
        base: dict[int, list[tuple[int, str]]] = {}
        for at, label in places:
            for i, d in zip(at.tolist(), doc[at].tolist()):
                base.setdefault(d, []).append((i - int(w.at[d]), label))
        out = []
        for d, (a, b) in enumerate(zip(w.at.tolist(), w.at[1:].tolist())):
            blocks = sorted(met.get(d, []), key=lambda x: (x["first_word"], x["end_word"], x["label"]))
            labels = {x["label"] for x in blocks}
            own = base.get(d, [])
            out.append((b - a, len(own), min((i for i, _ in own), default=None), max((i for i, _ in own), default=None), sorted({x for _, x in own}), sorted(labels), max((x["containment"] for x in blocks), default=0.0), blocks))
        return out


FOUND = {"_words": "bigint", "_base": "bigint", "_first": "bigint", "_last": "bigint", "_base_labels": "array<string>", "_labels": "array<string>", "_best": "double", "_blocks": "array<struct<first_word:bigint,end_word:bigint,label:string,containment:double>>"}


def find(df: DataFrame, text_col: str = "text", templates=ALL_TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """df and a struct `licenses`: n_words, n_base, first_word, last_word, base_labels, labels (both kinds), score, blocks.

    score: 1 if a phrase occurs, else the largest containment of a template that is met, else 0.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    index = df.sparkSession.sparkContext.broadcast(Index(word_frequencies(df, text_col, templates), templates, threshold, phrases))  # a few hundred words
    own = [f"_r{i}" for i in range(len(df.columns))]
    plain, at = df.toDF(*own), df.columns.index(text_col)
    schema = T.StructType([*plain.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in FOUND.items())).fields])
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column_bytes(b.column(at))
            rows = [r for x, y in chunks(texts) for r in index.value.judge(texts[x:y])]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*own, *FOUND])

    made = plain.mapInArrow(run, schema)
    labels = F.array_sort(F.array_union("_base_labels", "_labels"))
    score = F.when(F.col("_base") > 0, F.lit(1.0)).otherwise(F.col("_best"))
    struct = F.struct(F.col("_words").alias("n_words"), F.col("_base").alias("n_base"), F.col("_first").alias("first_word"), F.col("_last").alias("last_word"), F.col("_base_labels").alias("base_labels"), labels.alias("labels"), score.alias("score"), F.col("_blocks").alias("blocks"))
    return made.select(*[F.col(o).alias(n) for o, n in zip(own, df.columns)], struct.alias(free_name(df, "licenses")))


def oracle() -> str:
    """DuckDB SQL of the query's rows: every block against every template."""
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    phrase = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    places = " UNION ALL ".join(f"SELECT rid, i - 1 AS i, '{label}' AS label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {phrase(p)}" for p, label in PHRASES)
    row = lambda label, w: f"('{label}', {step_of(w)}, [{', '.join(repr(x) for x in sorted(set(w)))}], {math.ceil(THRESHOLD * len(set(w)) - 1e-9)})"
    t = ", ".join(row(label, words_of(text)) for label, text in ALL_TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS ({places}),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM p GROUP BY rid),
t(label, step, words, need) AS (VALUES {t}),
k AS (SELECT rid, step, list_distinct(w[i + 1 : i + 2 * step]) AS words FROM (SELECT rid, w, step, unnest(range(0, len(w), step)) AS i FROM d, (SELECT DISTINCT step FROM t))),
m AS (SELECT rid, label, len(list_intersect(k.words, t.words)) AS overlap, need, len(t.words) AS n FROM k JOIN t ON k.step = t.step),
found AS (SELECT rid, list_sort(list_distinct(list(label))) AS labels, max(overlap / n) AS best FROM m WHERE overlap >= need GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(coalesce(b.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  CAST(CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base b ON d.rid = b.rid LEFT JOIN found f ON d.rid = f.rid"""
