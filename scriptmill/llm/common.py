"""What the training-data operators share: tables in the shared folder, file access, salted group minima."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from scriptmill.sources.shared import shared_path, stored

__all__ = ["Columns", "group_min", "local_path", "open_uri", "salt", "salts_of", "shared_path", "slices", "stored", "table", "tidy", "utf8"]

#: Rows in an Arrow batch: texts are long, and both sides of the pipe hold a batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Columns:
    """The columns of ``docs`` under plain names (c0, c1, ...), so that none clashes with what an operator makes, whatever it is called."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.rows = docs.toDF(*[f"c{k}" for k in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """The plain name of a column; its own case comes first, then any."""
        if name not in self.names:
            return f"c{[n.lower() for n in self.names].index(name.lower())}"
        return f"c{self.names.index(name)}"

    def with_types(self, **made: DataType) -> StructType:
        return StructType([*self.rows.schema.fields, *[StructField(k, v) for k, v in made.items()]])

    def back(self, rows: DataFrame, drop: tuple[str, ...] = (), **made: str) -> DataFrame:
        """``rows`` under the old names, without ``drop`` (plain names), with each column ``made`` (new name: its name in ``rows``) in place of one called the same."""
        gone = {k.lower() for k in made}
        old = [F.col(f"c{k}").alias(n) for k, n in enumerate(self.names) if n.lower() not in gone and f"c{k}" not in drop]
        return rows.select(*old, *[F.col(v).alias(k) for k, v in made.items()])


def open_uri(uri: str):
    """A seekable binary file, local or in any store that pyarrow reads."""
    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), "rb")
    if "://" not in uri:
        return open(uri, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``limit`` bytes of ``column`` (a single longer row is a piece of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(work: Work) -> Work:
    """``work``, after which the Python worker, kept for later tasks, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def salt(*cols: Column | str, salts: int = 32) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salts_of(mask: str) -> Column:
    """The salts whose bits are set in ``mask``."""
    return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.getbit(F.col(mask), k) == 1)


def group_min(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the least ``value`` of all rows with the same ``key``.

    A key may hold any share of the rows. The minimum is taken before the
    shuffle as far as possible, and goes back to each (key, salt) of 32 that
    has rows, so no task gets more than a salt's share of a key. Null values
    are ignored by the minimum; null keys have none and are left out.
    """
    salted = rows.withColumn("_salt", salt(value))
    least = salted.groupBy(key).agg(F.min(value).alias(out), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask"))
    back = least.select(key, out, F.explode(salts_of("_mask")).alias("_salt"))
    return salted.join(back, [key, "_salt"]).drop("_salt")
