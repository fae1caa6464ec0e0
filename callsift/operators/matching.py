"""Row-preserving matchers: one Arrow pass over the texts appends a column.

A matcher is a small picklable object built from configuration (rules,
examples); it is broadcast, and each Python worker builds its automaton once,
on first use. Rows keep their own columns and their order, so nothing is
regrouped by the caller's ids afterwards.
"""

from __future__ import annotations

import contextlib
import ctypes

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64(),
          T.BooleanType: pa.bool_(), T.StringType: pa.string()}


# Rows looked at together: what is made of them stays small, however many an Arrow batch holds.
SLICE_ROWS = 256


def _slices(batches):
    """The batches in pieces of few rows (copies, so that no piece holds its
    batch); free memory goes back to the system after each batch and task, as
    an executor's workers live on between tasks and share its memory."""
    try:
        for b in batches:
            if b.num_rows <= SLICE_ROWS:
                yield b
                continue
            for at in range(0, b.num_rows, SLICE_ROWS):
                yield b.take(pa.array(range(at, min(at + SLICE_ROWS, b.num_rows)), pa.int64()))
            del b
            _release()
    finally:
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def append_structs(df: DataFrame, text_col: str, name: str, fields: list[tuple[str, T.DataType]],
                   matcher) -> DataFrame:
    """``df`` with an array-of-structs column: ``matcher(text)`` gives each
    row's tuples (null texts count as empty)."""
    shared = df.sparkSession.sparkContext.broadcast(matcher)
    item = T.StructType([T.StructField(n, t) for n, t in fields])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(item))])
    kinds = [_ARROW[type(t)] for _, t in fields]
    names = [n for n, _ in fields]

    def run(batches):
        match = shared.value
        for b in _slices(batches):
            ends, cols = [0], [[] for _ in names]
            for text in b.column(text_col).to_pylist():
                rows = match(text or "")
                for c, values in zip(cols, zip(*rows)):
                    c.extend(values)
                ends.append(ends[-1] + len(rows))
            structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, text_col: str, new: T.StructType, matcher, method: str) -> DataFrame:
    """``df`` without its text column, with the columns that
    ``matcher.<method>(texts)`` gives for a batch of texts."""
    shared = df.sparkSession.sparkContext.broadcast(matcher)
    own = [f for f in df.schema.fields if f.name != text_col]
    names = [f.name for f in own] + new.names

    def run(batches):
        columns = getattr(shared.value, method)
        for b in _slices(batches):
            if not b.num_rows:
                continue
            kept = [b.column(f.name) for f in own]
            yield pa.RecordBatch.from_arrays([*kept, *columns(b.column(text_col).to_pylist())], names)

    return df.mapInArrow(run, T.StructType([*own, *new.fields]))


class Phrases:
    """First occurrence of each distinct phrase of a list in a text."""

    def __init__(self, phrases: list[str]):
        self.phrases = sorted(set(phrases))
        self._automaton = None

    def __getstate__(self):
        return {"phrases": self.phrases, "_automaton": None}

    def find(self, text: str) -> dict[int, int]:
        """phrase number -> place of its first occurrence ('' is at 0)."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.phrases):
                if p:
                    self._automaton.add_word(p, i)
            if len(self._automaton):
                self._automaton.make_automaton()
        found = {0: 0} if self.phrases and self.phrases[0] == "" else {}
        if len(self._automaton):
            for end, i in self._automaton.iter(text):
                if i not in found:
                    found[i] = end - len(self.phrases[i]) + 1
        return found
