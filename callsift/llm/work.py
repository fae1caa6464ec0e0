"""Written intermediates of one operator run, and small frame helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.session import scratch_path


class Work:
    """Tables that one run writes into the cluster's shared folder.

    A written table cuts the lineage (a lost executor rereads it, nothing is
    recomputed) and may be read by several jobs. ``drop`` removes a table that
    no later step reads; the ones behind a returned frame stay with the
    checkpoint folder."""

    _scopes: list[list[Work]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        for scope in self._scopes[-1:]:
            scope.append(self)

    @classmethod
    @contextlib.contextmanager
    def scope(cls):
        """On leaving, the folders of all runs begun inside go: for callers
        that have written what the runs returned."""
        cls._scopes.append([])
        try:
            yield
        finally:
            for w in cls._scopes.pop():
                fs, p = w._folder(w.root)
                fs.delete(p, True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        df.write.parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _folder(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._folder(self.path(name))
            fs.delete(p, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """The result as a table; every other table of the run goes."""
        out = self.table(df, "result")
        fs, p = self._folder(self.root)
        for f in fs.listStatus(p):
            if f.getPath().getName() != "result":
                fs.delete(f.getPath(), True)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(df: DataFrame, reserved: set[str]) -> DataFrame:
    """Input columns whose names an operator's outputs use (compared without
    case, as Spark resolves names) are carried as ``<name>_input``."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in reserved}
    low = {c.lower() for c in reserved}
    new = []
    for c in df.columns:
        name = c
        if c.lower() in low:
            while name.lower() in taken:
                name += "_input"
            taken.add(name.lower())
        new.append(name)
    return df.toDF(*new)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lean(run):
    """A function over a task's batches that hands free memory back to the
    system when the task ends: Python workers live on between tasks, and an
    executor's workers share its memory."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def slices(batches, rows: int = 512):
    """The batches in pieces of few rows, so that what is made of one stays
    small. Pieces are copies: some array functions go wrong on a part of an array."""
    for b in batches:
        if b.num_rows <= rows:
            yield b
        else:
            for at in range(0, b.num_rows, rows):
                yield b.take(pa.array(range(at, min(at + rows, b.num_rows)), pa.int64()))


def id_remainder(col: str = "doc_id", mod: int = 5):
    """crc32 of the id written as text, modulo ``mod``; a null id counts as
    the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
