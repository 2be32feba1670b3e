"""Queries with SQL give the SQL's rows; the pipeline keeps its promises stage by stage."""

from collections import Counter

import pytest

from loomgene.llm import queries
from tests.compare import duck, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, FOLDER)) == rows_of_sql(duck(FOLDER), queries.ORACLE_SQL[name])


def test_one_row_for_each_document(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op1_simhash", "op2_langid", "op3_shuffle", "op10_lm"):
        df = queries.QUERIES[name](spark, FOLDER)
        assert df.count() == n == df.select("doc_id").distinct().count(), name


def test_shuffle_query_against_sql(spark):
    """Sizes and checksums by SQL's own means; the law: counts at most one apart, slots without gaps."""
    import zlib

    got = queries.QUERIES["op3_shuffle"](spark, FOLDER).collect()
    size = dict(duck(FOLDER).execute("SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 FROM documents").fetchall())
    text = dict(duck(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall())
    assert {r.doc_id: r["size"] for r in got} == size and len(got) == len(size)
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "rows" and r.grown_shard is None for r in got)
    count = Counter(r.shard for r in got)
    assert sorted(count) == list(range(8)) and max(count.values()) - min(count.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(k, i) for k, n in count.items() for i in range(n)}


def test_language_query_against_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op2_langid"](spark, FOLDER).collect() if r.held_out]
    assert len(held) > 30 and all(r.lang_pred == lang[r.doc_id] for r in held if r.lang_pred != "und")


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from loomgene.llm import decontaminate, quality, simhash
    from loomgene.llm.store import written

    assert [f.__name__ for _, f in cp.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "target_mix", "shards"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, FOLDER), "stage")
        seen.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:-1])
    first, unique, clean, mixed, last = ([tuple(r)[:5] for r in d.collect()] for d in seen)
    texts = {r.doc_id: tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(texts[r[0]] == r for r in mixed) and set(unique) <= set(first) and set(clean) <= set(unique) and set(mixed) <= set(clean)
    near = simhash.near_duplicates(seen[0]).collect()
    assert sorted({r.component for r in near}) == sorted(r[0] for r in unique)
    bad = {r.doc_id for r in decontaminate.find(seen[1], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("contamination.contaminated").collect()}
    assert {r[0] for r in unique} - bad == {r[0] for r in clean}
    assert Counter(last) == Counter(mixed) and max(Counter(r[0] for r in mixed).values()) <= 2
    assert quality.drop_low_quality(seen[0].limit(0)).count() == 0
    assert cp.run(spark, FOLDER).count() == len(last)
