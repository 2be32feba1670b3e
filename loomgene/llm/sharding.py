"""Two-pass external shuffle: every record to a uniformly random place, in memory-sized pieces.

Pass one scatters records over buckets by a seeded hash of the whole record; the number of buckets
follows from the bytes, so that a bucket fits in a task's memory. Pass two puts a bucket's records
into an order that depends on their contents only, shuffles it by Fisher-Yates with a seed of its
own and numbers it on from the buckets before it. A record's number then decides its shard and its
slot (`rows`: shards differ by one record at most, slots have no gap), so a lost task is simply run
again with the same result.

Hot groups: copies with ids of their own scatter like any record. Rows that are equal in every
column share a hash; where they swell a bucket beyond HOT times its size they are dealt over
sub-buckets by row number (only then the order also depends on how the input is partitioned). That
placement is written before it is counted, so that a task that runs again cannot place them anew.
Pass two has as many partitions as buckets, so a task gets a few buckets whatever the input's size,
and holds one at a time.

Nulls in any column are values like others (a null text has size 1). Maps, which have no hash, are
carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_name, small_batches, written

SHARDS = 8
SEED = 2718281828
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 16
HOT = 4
#: Tasks of pass two at most; beyond, a task shuffles more buckets, one after another.
MOST_TASKS = 100_000


def _hash(df: DataFrame, seed: int):
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.xxhash64(c), F.lit(1)) for c in plain])


def shuffle(df: DataFrame, text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's rows and shard (int), slot (long), under those names or, if taken, with underscores before them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    small_batches(df.sparkSession)
    names = df.columns
    own = [f"_r{i}" for i in range(len(names))]
    plain = df.toDF(*own)
    size = F.coalesce(F.octet_length(F.col(own[names.index(text_col)])), F.lit(0)).cast("bigint") + 64
    hashed = plain.withColumn("_key", _hash(plain, seed))
    total = hashed.agg(F.sum(size)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    placed = hashed.withColumn("_bucket", F.pmod(F.col("_key"), F.lit(buckets)))
    counts = written(placed.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "buckets")
    #: At most total / (HOT * bucket_bytes) buckets, and as many keys: those of many equal rows.
    hot = [b for (b,) in counts.where(F.col("bytes") > HOT * bucket_bytes).select("_bucket").collect()]
    keys = []
    if hot:
        sums = placed.where(F.col("_bucket").isin(hot)).groupBy("_key").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        keys = [(k, int(-(-n // bucket_bytes))) for k, n in sums.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes)).select("_key", "bytes").collect()]
    sub = F.lit(0).cast("bigint")
    if keys:
        parts = F.create_map(*[F.lit(x) for pair in keys for x in pair])[F.col("_key")]
        sub = F.coalesce(1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts), sub)
    placed = placed.withColumn("_sub", sub)
    if keys:
        placed = written(placed, "placed")
    counts = written(placed.groupBy("_bucket", "_sub").agg(F.count("*").alias("n")), "buckets") if keys else counts.withColumn("_sub", sub)
    #: Sums of blocks of buckets first, so that no task gets all of them.
    counts = counts.withColumn("_block", F.expr("_bucket div 1024"))
    blocks = counts.groupBy("_block").agg(F.sum("n").alias("b")).selectExpr("_block", "sum(b) over (order by _block) - b as start")
    before = counts.join(blocks, "_block").selectExpr("_bucket", "_sub", "start + sum(n) over (partition by _block order by _bucket, _sub) - n as _before")
    ready = placed.join(F.broadcast(before) if buckets <= 100_000 else before, ["_bucket", "_sub"])
    schema = T.StructType([*plain.schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_slot", T.LongType())])

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        import random

        import numpy as np

        bucket = bucket.take(pc.sort_indices(bucket, sort_keys=[("_key", "ascending")]))
        order = list(range(bucket.num_rows))
        number = int(bucket.column("_bucket")[0].as_py()), int(bucket.column("_sub")[0].as_py())
        random.Random(f"{seed}:{number[0]}:{number[1]}").shuffle(order)
        at = np.arange(len(order), dtype=np.int64) + int(bucket.column("_before")[0].as_py())
        bucket = bucket.select(own).take(pa.array(order))
        return bucket.append_column("_shard", pa.array((at % shards).astype(np.int32))).append_column("_slot", pa.array(at // shards))

    groups = buckets + sum(n for _, n in keys)
    done = ready.repartition(int(min(groups, MOST_TASKS)), "_bucket", "_sub").groupBy("_bucket", "_sub").applyInArrow(fisher_yates, schema)
    return done.select(*[F.col(o).alias(n) for o, n in zip(own, names)], F.col("_shard").alias(free_name(df, "shard")), F.col("_slot").alias(free_name(df, "slot")))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """A folder of Parquet files for each shard, rows in the order of their slots within each file."""
    df.repartitionByRange(F.col(shard_col), F.col(slot_col)).sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
