"""Whitening of embeddings with MLlib's BlockMatrix.

Entries are put on a grid of 1/256 as whole numbers; the fit list holds each different vector once.

1. The fit list is a grouped table with dense row numbers; its rows and sums are exact.
2. Centred rows become an IndexedRowMatrix and then a BlockMatrix A of ``ROWS`` rows a block. The
   scatter is a product of transposed blocks with A. A plain ``A.transpose().multiply(A)`` would gather
   all blocks in the one task of its only result block, so the transposed blocks of every ``GROUP`` row
   blocks stand in a block row of their own: the product is a column of partial scatters, each made
   in its own task, which are added up as a tree.
3. The driver holds one scatter (dimension by dimension), and takes its eigenvectors.
4. A is multiplied by the whitening matrix (eigenvectors over the roots of their values), a block that
   goes to every task, and rows get the result that their vector has.

Defined results: vectors that are null, or hold nulls or numbers that are not finite, are left out, as
are vectors of another length than the longest; null and repeated ids stay, a row each; a direction
without variance (among them all directions of a single vector) has null as its whitened value; an
empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import meet, stored

#: Steps of the grid in a unit; rows of a block; row blocks whose scatter is summed in one task.
SCALE, ROWS, GROUP = 256, 1024, 4
#: Variances below this share of the largest count as none.
_NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Model:
    """Rows and sums of the fit list, its variance in all directions, and the leading components:
    variances from the largest on, and directions as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    directions: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        """The whitening matrix; a direction without variance is a column of zeros."""
        good = self.values > _NO_VARIANCE * max(self.values.max(initial=0), 0)
        return np.where(good, self.directions / np.sqrt(np.where(good, self.values, 1)), 0)


def on_grid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): usable vectors as whole numbers of grid steps."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(vectors[key].alias("id"), vectors[vector].cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    return rows.where(F.size("v") == (longest or 0)).select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """(place, x, n_rows): each different vector once, numbered from 0, and how many rows have it."""
    once = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("at", F.monotonically_increasing_id()))
    # A row for each partition that wrote the table: the numbers at which they begin.
    sizes = once.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("size"))
    begins = sizes.select("task", (F.sum("size").over(Window.orderBy("task")) - F.col("size")).alias("begin"), "size")
    rank = F.col("begin") + F.row_number().over(Window.partitionBy("task").orderBy("at")) - 1
    return once.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(begins), "task").select(rank.cast("bigint").alias("place"), "x", "n_rows")


def _centred(fit: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    means = F.array(*[F.lit(s / n) for s in sums])
    rows = fit.select("place", array_to_vector(F.zip_with(F.col("x"), means, lambda a, m: a - m)).alias("v"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, len(sums)).toBlockMatrix(ROWS, len(sums))


def _scatter(a: BlockMatrix) -> np.ndarray:
    n, d = a.numRows(), a.numCols()
    each = max(GROUP, -(-d // ROWS))
    turned = a.blocks.map(lambda b: ((b[0][0] // each, b[0][0]), DenseMatrix(b[1].numCols, b[1].numRows, b[1].toArray().ravel())))
    groups = -(-(-(-n // ROWS)) // each)
    partial = BlockMatrix(turned, d, ROWS, groups * d, n).multiply(a)
    return partial.blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)


def _projected(a: BlockMatrix, model: Model, fit: DataFrame) -> DataFrame:
    """(place, w) of the fit list."""
    spark, matrix = fit.sparkSession, model.matrix
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(*matrix.shape, matrix.ravel("F")))], 1), *matrix.shape)
    rows = lambda b: [(b[0][0] * ROWS + i, r) for i, r in enumerate(b[1].toArray().tolist())]
    return spark.createDataFrame(a.multiply(right).blocks.flatMap(rows), "place bigint, w array<double>")


def _fitted(fit: DataFrame, n: int, sums: list[int], top: int) -> tuple[Model, BlockMatrix]:
    a = _centred(fit, n, sums)
    cov = _scatter(a) / n
    values, directions = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:top]
    return Model(n, sums, float(np.trace(cov)), np.maximum(values[order], 0), directions[:, order]), a


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    d = fit.select(F.size("x")).first()
    if d is None:
        return 0, []
    got = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i]) for i in range(d[0])]).first()
    return got[0], list(got[1:])


def _deviation(n: int, sums: list[int]) -> Column:
    """Sum of (n x - S)^2 over dimensions, in decimals; null where it does not fit into a long."""
    whole = lambda c: c.cast("decimal(19,0)")
    gap = F.zip_with(F.col("x"), F.array(*[F.lit(s) for s in sums]), lambda a, s: (F.lit(n).cast("decimal(15,0)") * whole(a) - whole(s)).cast("decimal(19,0)"))
    return F.aggregate(gap, F.lit(0).cast("decimal(38,0)"), lambda t, g: (t + g * g).cast("decimal(38,0)")).try_cast("bigint")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 4) -> DataFrame:
    """(key, n, deviation, w, explained, identity_error): for each usable row its leading ``top``
    whitened values and the components' shares of all variance, as arrays."""
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, n bigint, deviation bigint, w array<double>, explained array<double>, identity_error double"
    rows = on_grid(vectors, key, vector)
    fit = stored(fit_list(rows))
    n, sums = _sums(fit)
    if not sums:
        return vectors.sparkSession.createDataFrame([], schema)
    model, a = _fitted(fit, n, sums, top)
    projected = stored(_projected(a, model, fit))
    good = (model.matrix != 0).any(0)
    w = [F.col("w")[i] for i in range(len(good))]
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1) if good[i] and good[j]]
    got = projected.agg(*[F.avg(x) for x in w], *[F.avg(w[i] * w[j]) for i, j in pairs]).first()
    means, moments = got[: len(w)], got[len(w) :]
    error = max((abs(m - means[i] * means[j] - (i == j)) for (i, j), m in zip(pairs, moments)), default=None)
    shares = [float(v / model.trace) if ok else None for v, ok in zip(model.values, good)]
    kept = F.array(*[c if ok else F.lit(None).cast("double") for c, ok in zip(w, good)])
    facts = fit.join(projected, "place").select("x", "n_rows", F.struct(_deviation(n, sums).alias("deviation"), kept.alias("w")).alias("found"))
    met = meet(rows, facts, "x", "n_rows", "found")
    explained = F.array(*[F.lit(s).cast("double") for s in shares])
    return met.select(F.col("id").alias(key), F.lit(n).cast("bigint").alias("n"), "found.deviation", "found.w", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def by_component(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("w", "explained")).alias("at", "c")
    return whitened.select(key, "n", "deviation", "identity_error", each).select(key, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.w").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
