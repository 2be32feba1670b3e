"""Results of dear kernels are kept once, in the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import urllib.parse
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of its own in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomgene-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def keep_once(df: DataFrame) -> DataFrame:
    """df, computed once; its checkpoint is in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark, uri: str) -> None:
    """Deletes what nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _place(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def save_arrays(uri: str, **arrays) -> None:
    """Arrays in one file, see save_bytes()."""
    import numpy as np

    data = io.BytesIO()
    np.savez(data, **arrays)
    save_bytes(uri, data.getbuffer())


def save_bytes(uri: str, data) -> None:
    """A file, renamed when whole: a task that runs again writes the same."""
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    own = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}.part"  # hidden from Spark's readers
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, path)


def load_arrays(uri: str, *names: str) -> tuple:
    """The arrays of these names; others in the file are not read."""
    import numpy as np

    system, path = _place(uri)
    with system.open_input_file(path) as source, np.load(source) as found:
        return tuple(found[n] for n in names)


def there(uri: str) -> bool:
    from pyarrow import fs

    system, path = _place(uri)
    return system.get_file_info(path).type == fs.FileType.File
