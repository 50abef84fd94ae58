"""Connected components and sorted runs, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b), with the smallest id of each component as its root.

    Each round every id points to its smallest neighbour if that is smaller, and then to where that one points; edges are drawn anew
    between these roots, so that they get fewer, until none is left. The rounds' maps, written to the shared folder, are followed one after
    another. Hubs only meet partial minima and joins that can split.
    """
    spark = edges.sparkSession
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left, path = work.store(edges.where("a <> b").select(lo, hi).distinct(), "edges")
    maps = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
        near, near_path = work.store(near, "near")
        up = near.select(F.col("id").alias("root"), F.col("root").alias("up"))
        to, _ = work.store(near.join(up, "root").select("id", F.col("up").alias("root")), "roots")
        maps.append(to)
        drawn = left.join(to.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        new, new_path = work.store(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        work.drop(spark, path, near_path)
        left, path = new, new_path
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    out, _ = work.store(out, "components")
    return out


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys (the first column, sorted) and the bounds of the runs in each."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        k = t.column(0).to_numpy()
        at = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
        held = t.slice(int(at[-1]))
        if at[-1]:
            yield t.slice(0, int(at[-1])).combine_chunks(), at
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def binary_rows(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    """Each value of a binary column as an array."""
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def fixed_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column of equal widths as a byte matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0) if c.num_chunks else pa.array([], pa.binary())
    offs = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)
    return np.frombuffer(c.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(c), width)
