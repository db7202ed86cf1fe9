"""Shared helpers: row-wise Arrow maps, byte views of text columns, word hashes, shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bindloom.session import dropped, fresh_path, written

__all__ = ["append_columns", "byte_view", "dropped", "enter", "fresh_path", "leaves", "planes", "row_groups", "run_hashes", "table", "token_classes", "unplanes", "written"]

_left: dict[str, Callable[[], None]] = {}  # per module: frees what its tasks leave in a worker

GROUP_BYTES = 1 << 20  # text handled at once by the array code; bounds the arrays of a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaves(module: str, free: Callable[[], None]) -> None:
    """Names the function that frees what a module's tasks leave in their worker for later ones."""
    _left[module] = free


def enter(module: str) -> None:
    """Frees what tasks of other modules left in this worker, which Spark uses again for any operator."""
    for other, free in _left.items():
        if other != module:
            free()


def append_columns(
    df: DataFrame,
    inputs: list[str],
    keep: list[str] | None,
    new: str,
    start: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
) -> DataFrame:
    """Row-wise Arrow map: the columns ``keep`` (all, if None) and the new ones of the DDL string ``new``.

    ``start`` runs once per task and returns the function from input arrays to new arrays. A kept
    column that has the name of a new one gives way to it.
    """
    fields = T.StructType.fromDDL(new).fields
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    slim = df.select(*[quoted(c).alias(f"_in{i}") for i, c in enumerate(inputs)], *[quoted(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*slim.schema.fields[len(inputs) :], *fields])
    names, n, module = schema.fieldNames(), len(inputs), start.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(module)
        step = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], *step(batch.columns[:n])], names=names)

    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in fields])


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, offsets if len(offsets) else np.zeros(1, np.int64)


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_RADIX = 0x2545F4914F6CDD1D
_powers = np.ones(1, np.uint64)


def _radix_powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        size = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_RADIX, size, 1 << 64))])
    return _powers


def run_hashes(data: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one class other than 0 inside the rows given by ``offsets``.

    Returns a 64-bit hash per run and the index of the first run of every row (n + 1 values).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(classes[1:], classes[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, n))
    within = np.arange(n) - np.repeat(starts, lengths)
    values = _BYTE_VALUES[data] * _radix_powers(int(lengths.max()) + 1)[within]
    hashes = np.add.reduceat(values, starts) + lengths.astype(np.uint64)
    word = classes[starts] != 0
    return _mixed(hashes[word]), np.searchsorted(starts[word], offsets)


def token_classes(separators: bytes) -> np.ndarray:
    """Byte classes for ``run_hashes``: 0 for the separators, 1 for all others."""
    classes = np.ones(256, np.uint8)
    classes[list(separators)] = 0
    return classes


def planes(values: np.ndarray) -> bytes:
    """Integers by byte planes, so that equal leading bytes compress away."""
    parts = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return np.ascontiguousarray(parts).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return np.ascontiguousarray(parts).view(kind).reshape(-1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
