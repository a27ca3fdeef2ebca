"""Nearest vectors, partition replacement and ambiguous synonyms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.sources.paths import stored

#: Cells (rows times vector length) of a block of vectors, and of a block of distances.
BLOCK_CELLS = 1_000_000
#: Pivots at most, and so cells of vectors that agree in the columns of ``equal``.
PIVOTS = 4096
#: Queries of a group that are sent to their cells in one place.
PART = 10_000
_KEYS = ["same", "dim", "cell", "shard"]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "id", vector: str = "v", equal: list[str] | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest by squared distance, exactly.

    ``queries`` and ``vectors`` have key and vector, and any columns of ``equal`` that must agree. Nulls
    take no part.

    A sample of vectors, about the root of their number and ``PIVOTS`` at most, are pivots. A vector is
    in the cell of its nearest pivot, and a cell knows the range of its members' distances from it. A
    query first goes to its nearest cell; the k-th distance there bounds what can still be of use, so
    afterwards it goes only to those cells of which the triangle inequality doesn't say that all members are
    farther. Cells are divided into shards of bounded size, which a task holds one at a time
    while blocks of queries stream past."""
    names = equal or []
    group = F.to_json(F.struct(*names)) if names else F.lit("")
    plain = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), group.alias("same"), F.size(vector).alias("dim")).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x))")
    b = plain(vectors)
    pivots = _pivots(b)
    celled = stored(_celled(b, pivots))
    cells = stored(celled.groupBy("same", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("inner"), F.max("far").alias("outer")).withColumn("shards", F.ceil(F.col("n") * F.col("dim") / BLOCK_CELLS).cast("int")))
    held = celled.join(cells.select("same", "dim", "cell", "shards"), ["same", "dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.greatest("shards", F.lit(1))).cast("int")).select("id", "v", *_KEYS)
    asked = stored(plain(queries))
    found = stored(_best(_search(_routed(asked.withColumn("bound", F.lit(None).cast("double")), cells, pivots), held, k), k))
    bound = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    # A query whose nearest cell held only itself has no bound yet, and goes everywhere else.
    again = asked.join(bound.withColumnRenamed("query_id", "id"), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return _best(found.select("query_id", "id", "distance").unionByName(_search(_routed(again, cells, pivots), held, k)), k).select("query_id", "rank", "id", "distance")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _pivots(b: DataFrame) -> dict[int, np.ndarray]:
    """Different vectors of each length with the smallest hashes: the root of their number, PIVOTS at most."""
    out = {}
    for dim, n in b.groupBy("dim").count().collect():
        most = max(1, min(PIVOTS, int(n**0.5)))
        rows = b.where(F.col("dim") == dim).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()
        out[dim] = np.array([r.v for r in rows], float).reshape(len(rows), dim)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, as block products, and so with their rounding."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T), 0)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float).reshape(len(column), dim)


def _celled(b: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds a vector's cell and its distance from that pivot."""

    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                own = pivots[dim]
                for at in range(0, len(part), step := max(1, BLOCK_CELLS // len(own))):
                    some = part.iloc[at : at + step]
                    x = _matrix(some["v"], dim)
                    cell = _distances(x, own).argmin(1)
                    yield some.assign(cell=cell.astype("int32"), far=np.sqrt(_exact(x, own[cell])))

    return b.mapInPandas(run, "id bigint, v array<double>, same string, dim int, cell int, far double")


def _routed(asked: DataFrame, cells: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """A row for each shard that a query goes to: without a bound those of its nearest cell, and with one
    those of all other cells that may hold something within it.

    Queries of a group are dealt into parts of about ``PART`` rows, and the group's cells, of which there are no
    more than pivots, come once to each part, before its queries. Rows leave in blocks of bounded size."""
    parts = asked.groupBy("same", "dim").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    sent = cells.join(parts, ["same", "dim"]).select("same", "dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "cell", "inner", "outer", "shards", *[F.lit(None).cast(kind).alias(n) for n, kind in (("id", "bigint"), ("v", "array<double>"), ("bound", "double"))])
    own = asked.join(parts, ["same", "dim"]).select("same", "dim", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), *[F.lit(None).cast(kind).alias(n) for n, kind in (("cell", "int"), ("inner", "double"), ("outer", "double"), ("shards", "int"))], "id", "v", "bound")
    dealt = sent.unionByName(own).repartition("same", "dim", "part").sortWithinPartitions("same", "dim", "part", "kind")

    def run(frames):
        of, parts, known = None, [], None
        for frame in frames:
            for (*at, kind), part in frame.groupby(["same", "dim", "part", "kind"], sort=True):
                if kind == 0:
                    parts = [*parts, part[["cell", "inner", "outer", "shards"]]] if of == at else [part[["cell", "inner", "outer", "shards"]]]
                    of, known = at, None
                elif of == at:
                    if known is None:
                        known = pd.concat(parts).sort_values("cell")
                    for low in range(0, len(part), step := max(1, BLOCK_CELLS // (len(known) * max(1, at[1])))):
                        yield _destinations(part.iloc[low : low + step], known, pivots[at[1]])

    return dealt.mapInPandas(run, "id bigint, v array<double>, same string, dim int, cell int, shard int")


def _destinations(part: pd.DataFrame, known: pd.DataFrame, pivots: np.ndarray) -> pd.DataFrame:
    """The shards that some queries of one group go to."""
    cell, shards = known["cell"].to_numpy().astype(int), np.maximum(known["shards"].to_numpy().astype(int), 1)
    inner, outer = known["inner"].to_numpy(), known["outer"].to_numpy()
    d = np.sqrt(_exact(_matrix(part["v"], pivots.shape[1])[:, None, :], pivots[cell][None]))
    bound = part["bound"].to_numpy(float)[:, None]
    first = np.arange(len(cell)) == d.argmin(1)[:, None]
    with np.errstate(invalid="ignore"):
        chosen = np.where(np.isnan(bound), first, ~first & (np.maximum(d - outer, inner - d) <= np.sqrt(bound) + 1e-9 * (1 + d + outer)))
    row, column = np.nonzero(chosen)
    times = shards[column]
    row, column = np.repeat(row, times), np.repeat(column, times)
    shard = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return part[["id", "v", "same", "dim"]].iloc[row].assign(cell=cell[column], shard=shard)


def _search(routed: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance): the best k of each shard for each query that goes there."""
    dealt = held.withColumn("kind", F.lit(0)).unionByName(routed.withColumn("kind", F.lit(1))).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "kind")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, parts, base = None, [], None
        for frame in frames:
            for (*at, kind), part in frame.groupby([*_KEYS, "kind"], sort=True):
                if kind == 0:
                    parts = [*parts, part] if of == at else [part]
                    of, base = at, None
                elif of == at:
                    base = base or _Base(pd.concat(parts), at[1])
                    for low in range(0, len(part), step := max(1, BLOCK_CELLS // len(base.ids))):
                        yield base.nearest(part.iloc[low : low + step], k)

    return dealt.mapInPandas(run, "query_id bigint, id bigint, distance double")


class _Base:
    """The vectors of a shard."""

    def __init__(self, frame: pd.DataFrame, dim: int):
        self.dim, self.ids, self.v = dim, frame["id"].to_numpy(), _matrix(frame["v"], dim)
        self.size = (self.v**2).sum(1).max()

    def nearest(self, part: pd.DataFrame, k: int) -> pd.DataFrame:
        """Block products say which k vectors are about the nearest; all that their rounding leaves
        open are measured exactly."""
        own, x = part["id"].to_numpy(), _matrix(part["v"], self.dim)
        about = _distances(x, self.v)
        about[own[:, None] == self.ids] = np.inf
        limit = np.partition(about, k - 1, 1)[:, k - 1] if about.shape[1] > k else np.full(len(own), np.inf)
        slack = 1e-9 * ((x**2).sum(1) + self.size + 1)
        row, column = np.nonzero((about <= (limit + slack)[:, None]) & (about < np.inf))
        gap, ids = _exact(x[row], self.v[column]), self.ids[column]
        order = np.lexsort((ids, gap, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < k]
        return pd.DataFrame({"query_id": own[row[place < k]], "id": ids[kept], "distance": gap[kept]})


def match_confidence(found: DataFrame, most: float = 1.0, floor: float = 0.3) -> DataFrame:
    """Matches within a distance, with a confidence that falls with it."""
    return found.where(F.col("distance") <= most).withColumn("confidence", F.greatest(F.lit(floor), 1 - F.col("distance")))


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Write rows by partition; partitions that occur are replaced whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def synonym_collisions(items: DataFrame, key: str = "item", synonym: str = "synonym") -> DataFrame:
    """(synonym, n_items) of rows of an item and one of its names: names, without regard to case,
    that stand for more than one item."""
    flat = items.select(F.col(key).alias("item"), F.lower(F.trim(synonym)).alias("synonym")).where("synonym <> ''").distinct()
    return flat.groupBy("synonym").agg(F.count("item").alias("n_items")).where("n_items > 1").orderBy(F.col("n_items").desc(), "synonym")
