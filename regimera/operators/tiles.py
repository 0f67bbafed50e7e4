"""All-pairs work on vectors in tiles: blocks of rows are packed into matrices and met block by block in numpy.

The work is quadratic in the rows by definition, but no row pair ever becomes a row: a tile yields sums or its best few
neighbours, which merge by aggregation. Blocks are joined with blocks, so nothing unbounded is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship

BLOCK_ROWS = 1024


def pack(df: DataFrame, row_id: str, vector: str, label: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, n, ids, labels, points): rows dealt by hash of their id into blocks of about `rows`."""
    ship(df.sparkSession)
    n_blocks = max(1, -(-df.count() // rows))
    tag = F.col(label).cast("long") if label else F.lit(0).cast("long")
    light = df.select(F.pmod(F.xxhash64(row_id), F.lit(n_blocks)).cast("int").alias("block"), F.col(row_id).cast("long").alias("id"), tag.alias("tag"), F.col(vector).cast("array<double>").alias("v"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        points = np.stack([np.asarray(x.values) for x in table.column("v")])
        one = lambda x, t: pa.array([x], t)
        return pa.table({
            "block": table.column("block")[:1], "n": one(len(points), pa.int32()), "ids": one(table.column("id").to_numpy().tobytes(), pa.binary()),
            "labels": one(table.column("tag").to_numpy().tobytes(), pa.binary()), "points": one(points.astype("<f8").tobytes(), pa.binary()),
        })

    return light.groupBy("block").applyInArrow(run, "block int, n int, ids binary, labels binary, points binary")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a few rows at a time: exact where points coincide."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def meet(left: DataFrame, right: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Every block of left with every block of right: kernel(ids, labels, points, ids, labels, points) -> columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def unpack(batch: pa.RecordBatch, i: int, at: int) -> tuple[np.ndarray, ...]:
        n = batch.column(at)[i].as_py()
        raw = [batch.column(at + k)[i].as_py() for k in (1, 2, 3)]
        return np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], "<f8").reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = kernel(*unpack(batch, i, 0), *unpack(batch, i, 4))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    cols = ["n", "ids", "labels", "points"]
    pairs = left.select(*[F.col(c).alias(f"l_{c}") for c in cols]).join(right.select(*[F.col(c).alias(f"r_{c}") for c in cols]))
    return pairs.mapInArrow(run, schema)


def nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(id, other, dist): the k nearest right rows of every left row (itself included if it is there), ties to the lower id."""

    def kernel(ia, la, a, ib, lb, b):
        d = distances(a, b)
        m = min(k, len(ib))
        best = np.lexsort((np.broadcast_to(ib, d.shape), d), axis=1)[:, :m]
        return np.repeat(ia, m), ib[best].ravel(), np.take_along_axis(d, best, 1).ravel()

    from pyspark.sql import Window

    found = meet(left, right, kernel, "id bigint, other bigint, dist double")
    w = Window.partitionBy("id").orderBy("dist", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
