"""Tables and files in the one folder that driver and executors share.

Lost executors recompute from parquet files there, never from blocks on another executor. The
folder is the session's spark.checkpoint.dir; where that is unset, one is made in local mode only,
since a folder of the driver's own machine is none that executors share.
"""

from __future__ import annotations

import os
import tempfile
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomgene-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as parquet to the shared folder and read again (its lineage ends here), and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def removed(path: str, spark: SparkSession) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def file_dir(spark: SparkSession, name: str) -> str:
    """URI of a new sub-folder for files that tasks write by write_file()."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes data whole under a name of its own, then renames: a retried task overwrites equal bytes."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    else:
        system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def shelved(parts: list[str], uri: str) -> list[int]:
    """Moves the files `parts` one after another into one file; the size of each, 0 for one that isn't there.

    Parts go when the file and a list of their sizes stand under their final names, so a task that runs again finds
    either all parts or that list.
    """
    from pyarrow import fs

    system, path = _filesystem(uri)
    parts, listed = [_filesystem(p)[1] for p in parts], f"{path}.sizes"
    if system.get_file_info(listed).type == fs.FileType.File:
        with system.open_input_stream(listed) as source:
            sizes = [int(x) for x in source.read().split()]
    else:
        sizes = [f.size if f.type == fs.FileType.File else 0 for f in system.get_file_info(parts)]
        if not any(sizes):
            return sizes
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(own) as out:
            for p, size in zip(parts, sizes):
                if size:
                    with system.open_input_stream(p) as source:
                        while block := source.read(1 << 22):
                            out.write(block)
        system.move(own, path)
        write_file(f"{uri}.sizes", " ".join(map(str, sizes)).encode())
    for f in system.get_file_info([p for p, size in zip(parts, sizes) if size]):
        if f.type == fs.FileType.File:
            system.delete_file(f.path)
    return sizes


def map_file(uri: str):
    """The bytes of a file, memory-mapped, as a numpy array; no descriptor stays open.

    A mounted shared folder is mapped in place. From a store that cannot be mapped the file is
    copied once per worker into an unlinked temporary file, which goes with the process.
    """
    import mmap

    import numpy as np
    from pyarrow import fs

    def mapped(file) -> np.ndarray:
        size = os.fstat(file.fileno()).st_size
        return np.frombuffer(mmap.mmap(file.fileno(), size, access=mmap.ACCESS_READ, trackfd=False), np.uint8) if size else np.empty(0, np.uint8)

    system, path = _filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as file:
            return mapped(file)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return mapped(copy)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches that hold long documents stay small: 10,000 texts of 100 kB would be 1 GB.

    Spark reads the setting when a plan runs, not when it is made, so it stays lowered for the session.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it, so that it clashes with no column of df (case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
