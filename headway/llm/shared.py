"""Helpers that several operators use: shared intermediate tables and Arrow text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one set on the context. A machine's own
    folder takes its place only where everything runs on that machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="headway-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: it runs once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``saved`` that nothing reads any more."""
    for where in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, where)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def beside(rows: DataFrame, keep: list[str], column: str, added: str) -> tuple[DataFrame, str]:
    """The columns ``keep`` and, last, ``column`` as ``__in``, and the schema of ``keep`` with the columns ``added`` (as in
    ``name type, ...``). A column of ``keep`` that has the name of an added one gives way to it."""
    new = {c.split()[0].lower() for c in added.split(", ")}
    chosen = rows.select(*[c for c in keep if c.lower() not in new], F.col(column).alias("__in"))
    return chosen, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]], added])


def written_place(table: DataFrame) -> Column:
    """The place of a row in a table that was sorted and then written: its part's number, its file of the part, and its row
    in the file. Files of other names come in the order of a hash. Where ``table`` isn't read from files, the place in its
    partitions."""
    if not table.inputFiles():
        return F.monotonically_increasing_id()
    number = lambda k: F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-.*-c(\d+)\.", k).try_cast("long")
    part = F.coalesce(number(1), F.pmod(F.xxhash64("_metadata.file_name"), F.lit(1 << 19)))
    return F.shiftleft(part, 44) + F.shiftleft(F.coalesce(number(2), F.lit(0).cast("long")), 32) + F.col("_metadata.row_index")


def text_slices(column: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """Yield (first row, last row, bytes, offsets of each text in them) for runs of texts of about ``chunk_bytes``.

    Nulls are empty. A chunk holds whole texts only.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + chunk_bytes, side="right")) - 1)
        b = min(b, n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def binary_array(values: np.ndarray) -> pa.Array:
    """Rows of a 2-D array of bytes as Arrow binaries."""
    n, width = values.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
