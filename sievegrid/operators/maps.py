"""Score maps as arrays, one a frame: pooling, resizing and merging are linear, and so one matrix for all frames of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sievegrid.operators.grid import axis_weights


def _axis(size: int, target: int) -> np.ndarray:
    out = np.zeros((target, size))
    for to, source, weight in axis_weights(size, target):
        out[to, source] += weight
    return out


def bilinear_matrix(size: tuple[int, int], target: tuple[int, int]) -> np.ndarray:
    """From maps of `size` (rows, columns), row after row, to maps of `target`."""
    return np.kron(_axis(size[0], target[0]), _axis(size[1], target[1]))


def _windows_along(size: int, window: int, stride: int) -> np.ndarray:
    n = (size - window) // stride + 1
    out = np.zeros((n, size))
    for k in range(n):
        out[k, k * stride : k * stride + window] = 1 / window
    return out


def window_matrix(size: tuple[int, int], window: int, stride: int) -> np.ndarray:
    """To the mean of each window that lies inside the map, one every `stride` cells."""
    return np.kron(_windows_along(size[0], window, stride), _windows_along(size[1], window, stride))


def block_matrix(size: tuple[int, int], m: int) -> np.ndarray:
    """To the mean of each m by m block; sides that m doesn't divide are an error."""
    if size[0] % m or size[1] % m:
        raise ValueError(f"{size[0]} by {size[1]} cells don't fall into blocks of {m} by {m}")
    return window_matrix(size, m, m)


def merge_matrix(size: tuple[int, int], mode: str = "naive_mean", m: int = 2, window: int = 2, stride: int = 1) -> np.ndarray:
    """To token scores: naive_mean (also merge) or sliding_window, where each window lays its mean on its cells and a block is the
    sum of what lies on it over their number; windows must reach every block."""
    if mode in ("naive_mean", "merge"):
        return block_matrix(size, m)
    if mode != "sliding_window":
        raise ValueError(f"unknown mode {mode}")
    block_matrix(size, m)
    laid = []
    for side in size:
        n = (side - window) // stride + 1
        cells = np.zeros((side // m, n))  # cells of each block that each window covers
        for k in range(n):
            for d in range(window):
                cells[(k * stride + d) // m, k] += 1
        if not cells.any(1).all():
            raise ValueError(f"windows of {window} every {stride} cells leave blocks uncovered")
        laid.append(cells / cells.sum(1, keepdims=True))
    return np.kron(laid[0], laid[1]) @ window_matrix(size, window, stride)


def transformed(frames: DataFrame, matrix: np.ndarray, column: str = "map", out: str = "map") -> DataFrame:
    """frames with the array `column` replaced by `out`: matrix times it. Frames are not shuffled; the matrix goes to every task.

    A map of another size than the matrix takes is an error; a null map stays null.
    """
    kept = [c for c in frames.columns if c != column]
    schema = StructType([*(frames.schema[c] for c in kept), StructField(out, ArrayType(DoubleType()))])
    rows_out, rows_in = matrix.shape
    across = np.ascontiguousarray(matrix.T)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column(batch.schema.get_field_index(column))
            there = ~maps.is_null().to_numpy(zero_copy_only=False)
            if (maps.value_lengths().drop_null().to_numpy(zero_copy_only=False) != rows_in).any():
                raise ValueError(f"a map has not {rows_in} cells")
            values = maps.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, rows_in) @ across
            ends = np.concatenate([[0], np.cumsum(np.where(there, rows_out, 0))]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), found], [*kept, out])

    return frames.select(*kept, F.col(column).cast("array<double>").alias(column)).mapInArrow(rows, schema)


def cells(frames: DataFrame, columns: int, keys: list[str], column: str = "map") -> DataFrame:
    """keys, y, x, score of each cell of the maps, which are `columns` cells wide."""
    each = frames.select(*keys, F.posexplode(column).alias("_k", "score"))
    y: Column = F.floor(F.col("_k") / columns)
    return each.select(*keys, y.alias("y"), (F.col("_k") % columns).cast("long").alias("x"), "score")
