"""Overlapping genetic windows over a stream of markers.

State per chromosome is what the next window still needs: the positions since its start. A window is
given out once a marker beyond its overlap has come, or the chromosome's end (a row with `done`).
Each chromosome's markers must arrive in order over micro-batches (within one they are sorted).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

OUT = "chrom string, window_id bigint, first bigint, last bigint, out_first bigint, out_last bigint, is_last boolean"
STATE = "window_id bigint, pos array<bigint>, gen array<double>"


def cut(pos: list[int], gen: list[float], number: int, window: float, overlap: float, done: bool) -> tuple[list[tuple], int]:
    """Windows that are complete, as (id, first, last, out_first, out_last, is_last), and how many markers are used up."""
    g, rows, at = np.asarray(gen), [], 0
    while at < len(g):
        held = int(np.searchsorted(g, g[at] + window + overlap, "right"))
        if held == len(g) and not done:
            break
        end = held if held == len(g) else min(held, int(np.searchsorted(g, g[at] + window, "left")))
        end = max(end, at + 1)
        rows.append((number + len(rows), pos[at], pos[held - 1], pos[at], pos[end - 1], done and end == len(g)))
        at = end
    return rows, at


def stream_windows(markers: DataFrame, window: float, overlap: float) -> DataFrame:
    """OUT rows, appended, from a stream with chrom, pos, gen_pos and done (true on a row that only ends its chromosome)."""
    import pandas as pd

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, pos, gen = state.get if state.exists else (0, [], [])
        pos, gen, done = list(pos), list(gen), False
        own = pd.concat(list(batches))
        done = bool(own["done"].any())
        own = own[~own["done"]].sort_values("pos")
        pos += own["pos"].tolist()
        gen += own["gen"].tolist()
        rows, used = cut(pos, gen, number, window, overlap, done)
        if done:
            state.remove()
        else:
            state.update((number + len(rows), pos[used:], gen[used:]))
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=[x.split()[0] for x in OUT.split(", ")])

    rows = markers.selectExpr("chrom", "cast(pos as bigint) as pos", "cast(gen_pos as double) as gen", "done")
    return rows.groupBy("chrom").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def running_quality(probs: DataFrame, state_path: str):
    """A foreachBatch function that adds a micro-batch's sums per site to a table of sums in state_path.

    Each batch writes a folder of its own, named by its number, so one that is run again replaces itself;
    quality() merges them. probs is only a template for the columns m and p.
    """
    from pyspark.sql import functions as F

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("m").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
        sums.write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return add


def quality(spark, state_path: str) -> DataFrame:
    """(m, n, af, dr2) over all batches so far."""
    from pyspark.sql import functions as F

    from ..operators.quality import dr2

    t = spark.read.parquet(state_path).groupBy("m").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return t.select("m", "n", (F.col("s") / F.col("n")).alias("af"), dr2(F.col("s"), F.col("ss"), F.col("n")).alias("dr2"))
