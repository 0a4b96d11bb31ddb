"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: the separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return d or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lexigrid"


class Scratch:
    """The tables of one run, in a folder of its own under the shared one. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/lexigrid/{name}-{uuid.uuid4().hex}", 0

    def new(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n}-{name}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table, read again."""
        path = self.new(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes what written() gave; for tables that nothing still to be run reads."""
        for t in tables:
            remove(self.spark, t._scratch)

    def clear(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes the tables of all runs; to be called when no result that was given is still to be read."""
    remove(spark, f"{shared_dir(spark)}/lexigrid")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives lost executors. It stays as long as the result may be read."""
    return Scratch(df.sparkSession, name).written(df, name)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with up to ``most`` bytes in a text column, or one row.

    What Python makes of a text is many times its size, and a batch may be all of a task. At the end, freed
    memory goes back to the system: Spark keeps the worker for later tasks.
    """
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(b):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(start, stop - start)
            start = stop
    give_back()


def text_batches(spark: SparkSession, rows: int = 1_024) -> None:
    """Fewer rows to an Arrow batch where the session has more: a batch of whole texts is held by the JVM and by Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def carried(docs: DataFrame, text_col: str, keep: list[str], replaced: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    """(frame for an operator in Arrow batches, names of the columns it gives on, name of its text column).

    The text is there once: in its own place where it is kept, else last as __text.
    """
    text_batches(docs.sparkSession)
    names = [c for c in keep if c not in replaced]
    cols = [F.col(f"`{c}`") for c in names]
    return (docs.select(*cols), names, text_col) if text_col in names else (docs.select(*cols, F.col(f"`{text_col}`").alias("__text")), names, "__text")


def but_text(docs: DataFrame, text_col: str, keep: list[str] | None) -> list[str]:
    return keep if keep is not None else [c for c in docs.columns if c != text_col]


def fields_of(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def shielded(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """op(docs, …) with the columns of docs that begin with __, as those of the operators do, under other names meanwhile."""

    @wraps(op)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        hidden = {c: f"shielded {i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not hidden:
            return op(docs, *args, **kw)

        def swap(v):
            return [swap(x) for x in v] if isinstance(v, list) else hidden.get(v, v) if isinstance(v, str) else v

        out = op(docs.withColumnsRenamed(hidden), *map(swap, args), **{k: swap(v) for k, v in kw.items()})
        return out.withColumnsRenamed({v: k for k, v in hidden.items()})

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def n_words_of(text: Column) -> Column:
    """Number of words as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)
