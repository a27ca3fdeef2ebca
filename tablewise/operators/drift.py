"""What changed between runs: schemas, tables and rows under protection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.types import normalized
from tablewise.sources.paths import discard, stored


#: Buckets of keys that a table's digest is made of.
BUCKETS = 1024


def _halves(*cells: Column) -> list[Column]:
    """128 bits of values in their places, as two numbers: exact for fractions, and nulls count."""
    seen = [x for c in cells for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(salt), *seen) for salt in (1, 2)]


def _cells(df: DataFrame) -> list[Column]:
    """Columns as what can be digested: nested ones by their JSON."""
    return [F.to_json(F.struct(f.name)) if normalized(f.dataType) in ("json", "list") else F.col(f"`{f.name}`") for f in df.schema]


def _sum(halves: list[Column]) -> Column:
    """Sums of digests, which do not depend on order but on how often a row occurs."""
    return F.concat_ws(":", *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string") for h in halves])


def bucket_of(df: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> Column:
    """A bucket from the key's text, the same for every table and run; without a key, from the whole row."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key] or [F.xxhash64(*_cells(df)).cast("string")]
    return (F.conv(F.substring(F.md5(F.concat_ws("\u0001", *cells)), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def snapshot(tables: dict[str, DataFrame], run_id: int) -> DataFrame:
    """(run_id, table, column, dtype, nullable, row_count, filled, fingerprint, table_digest) of whole tables.

    One aggregate a table reads every row: a column is nullable if it holds a null, its fingerprint
    adds up digests of its values, and the table's adds up digests of its rows, so neither depends on order."""
    parts = []
    for t, df in tables.items():
        cells = [F.struct(F.lit(f.name).alias("column"), F.lit(normalized(f.dataType)).alias("dtype"), F.count(F.lit(1)).alias("row_count"), F.count(F.col(f"`{f.name}`")).alias("filled"), _sum(_halves(x)).alias("fingerprint")).alias(f"c{i}") for i, (f, x) in enumerate(zip(df.schema, _cells(df)))]
        rows = df.agg(*cells, _sum(_halves(*_cells(df))).alias("table_digest")).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cells))])).alias("r"), "table_digest").select("r.*", "table_digest")
        parts.append(rows.select(F.lit(run_id).cast("bigint").alias("run_id"), F.lit(t).alias("table"), "column", "dtype", (F.col("filled") < F.col("row_count")).alias("nullable"), "row_count", "filled", "fingerprint", "table_digest"))
    return reduce(DataFrame.unionByName, parts)


def _canonical(df: DataFrame, name: str) -> Column:
    """A value as text that does not depend on how an engine prints fractions, of which it keeps two digits."""
    kind, cell = normalized(df.schema[name].dataType), F.col(f"`{name}`")
    if kind == "float64":
        return F.round(cell * 100).cast("decimal(38,0)").cast("string")
    return F.to_json(F.struct(cell)) if kind in ("json", "list") else cell.cast("string")


def text_fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, fingerprint) of whole tables: the sum of the first 32 bits of the MD5 of each
    value's text, which other engines can compute too. Coarser than the digests of ``snapshot``."""
    parts = []
    for t, df in tables.items():
        digest = lambda c: F.conv(F.substring(F.md5(_canonical(df, c)), 1, 8), 16, 10).cast("decimal(20,0)")
        sums = df.agg(*[F.coalesce(F.sum(digest(c)), F.lit(0)).cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("fingerprint")) for i, c in enumerate(df.columns)]
        parts.append(sums.select(F.lit(t).alias("table"), F.explode(F.array(*cells)).alias("r")).select("table", "r.*"))
    return reduce(DataFrame.unionByName, parts)


def digest_tree(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], buckets: int = BUCKETS) -> DataFrame:
    """(table, bucket, rows, digest): the rows of each bucket of keys, summed up. A table's own digest
    is the sum of its buckets, and a run keeps no more than this to be compared with the next."""
    parts = [df.groupBy(bucket_of(df, keys.get(t, ()), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), _sum(_halves(*_cells(df))).alias("digest")).select(F.lit(t).alias("table"), "bucket", "rows", "digest") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, bucket, rows_before, rows_after) of the buckets whose rows differ, in tables of both."""
    common = before.select("table").intersect(after.select("table"))
    side = lambda df, name: df.join(F.broadcast(common), "table", "left_semi").select("table", "bucket", F.col("rows").alias(f"rows_{name}"), F.col("digest").alias(f"digest_{name}"))
    both = side(before, "before").join(side(after, "after"), ["table", "bucket"], "full_outer")
    return both.where(~F.col("digest_before").eqNullSafe(F.col("digest_after"))).select("table", "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_before", "rows_after")])


def changed_rows(old: DataFrame, new: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(*key, change): rows added, removed or updated. Digests of buckets say where to look; only keys
    of changed buckets are joined."""
    trees = [digest_tree({"t": df}, {"t": key}, buckets) for df in (old, new)]
    where = changed_buckets(*trees).select(F.col("bucket").alias("_bucket"))
    marks = lambda df, name: df.withColumn("_bucket", bucket_of(df, key, buckets)).join(F.broadcast(where), "_bucket", "left_semi").groupBy(*key).agg(_sum(_halves(*_cells(df))).alias(name))
    a, b = marks(old, "_o").alias("a"), marks(new, "_n").alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    change = F.when(F.col("_o").isNull(), F.lit("added")).when(F.col("_n").isNull(), F.lit("removed")).when(F.col("_o") != F.col("_n"), F.lit("updated"))
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], change.alias("change")).where("change is not null")


def latest_before(snapshots: DataFrame, run_id: int) -> DataFrame:
    """The newest snapshot older than a run; empty if there is none."""
    last = snapshots.where(F.col("run_id") < run_id).agg(F.max("run_id").alias("last"))
    return snapshots.join(F.broadcast(last), F.col("run_id") == F.col("last"), "left_semi")


def table_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, change): tables that came or went. With nothing before, all are new."""
    old, new = before.select("table").distinct(), after.select("table").distinct()
    return new.join(old, "table", "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, "table", "left_anti").withColumn("change", F.lit("removed")))


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, column, change, before, after) on tables of both; a column may have two rows."""
    common = before.select("table").intersect(after.select("table"))
    old = before.join(common, "table", "left_semi").select("table", "column", F.struct("dtype", "nullable").alias("o"))
    new = after.join(common, "table", "left_semi").select("table", "column", F.struct("dtype", "nullable").alias("n"))
    both = old.join(new, ["table", "column"], "full_outer")
    o, n = F.col("o"), F.col("n")

    def change(kind: str, when: Column, a: Column, b: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("change"), a.cast("string").alias("before"), b.cast("string").alias("after")))

    none = F.lit(None)
    rows = F.array_compact(F.array(
        change("added", o.isNull(), none, n["dtype"]), change("removed", n.isNull(), o["dtype"], none),
        change("type_changed", o["dtype"] != n["dtype"], o["dtype"], n["dtype"]), change("nullability_changed", o["nullable"] != n["nullable"], o["nullable"], n["nullable"]),
    ))
    return both.select("table", "column", F.explode(rows).alias("c")).select("table", "column", "c.*").orderBy("table", "column", "change")


def rerun_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables added, removed, changed and truly unchanged: the latter have the same columns and the
    same rows, in whatever order, by their snapshots."""
    names = [c for c in ("column", "dtype", "nullable", "row_count", "fingerprint", "table_digest") if c in before.columns]
    mark = lambda df, name: df.groupBy("table").agg(F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias(name))
    both = mark(before, "o").join(mark(after, "n"), "table", "full_outer")
    return both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o") != F.col("n")).alias("updated"), F.count_if(F.col("o") == F.col("n")).alias("unchanged"))


def overview(before: DataFrame, after: DataFrame) -> DataFrame:
    """(first_run, tables_added, tables_removed, column_changes, no_changes); a first run, with
    nothing before it, adds all tables and is never without changes."""
    tables, columns = table_changes(before, after), column_changes(before, after)
    counts = tables.select(F.col("change").alias("kind")).unionByName(columns.select(F.lit("column").alias("kind"))).unionByName(before.limit(1).select(F.lit("before").alias("kind")))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    got = counts.agg((n("before") == 0).alias("first_run"), n("added").alias("tables_added"), n("removed").alias("tables_removed"), n("column").alias("column_changes"))
    return got.withColumn("no_changes", ~F.col("first_run") & (F.col("tables_added") + F.col("tables_removed") + F.col("column_changes") == 0))


def locked_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], protected: Sequence[str], lock: str = "locked", removed: str | None = None) -> DataFrame:
    """New values over old ones by key, but for protected columns of locked rows.

    Rows only in either side stay or are added; a row that is in ``new`` loses its removal mark."""
    keys = list(key)
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    is_new = reduce_any([F.col(f"b.{c}").isNotNull() for c in keys])
    locked = F.coalesce(F.col(f"a.{lock}"), F.lit(False))
    out = []
    for c in old.columns:
        if c in keys:
            cell = F.coalesce(f"a.{c}", f"b.{c}")
        elif c == lock:
            cell = locked
        elif c == removed:
            cell = F.when(~is_new, F.col(f"a.{c}"))
        elif c not in new.columns:
            cell = F.col(f"a.{c}")
        else:
            keep = ~is_new | locked if c in protected else ~is_new
            cell = F.when(keep, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        out.append(cell.alias(c))
    return both.select(*out)


def reduce_any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def soft_delete(old: DataFrame, present: DataFrame, key: str, run_id: int, mark: str = "removed_in_run_id") -> DataFrame:
    """Mark rows whose key is gone; earlier marks stay."""
    here = present.select(F.col(key).alias("_key")).distinct().withColumn("_here", F.lit(True))
    joined = old.join(here, old[key] == F.col("_key"), "left")
    return joined.withColumn(mark, F.when(F.col("_here").isNull() & F.col(mark).isNull(), F.lit(run_id).cast("bigint")).otherwise(F.col(mark))).drop("_key", "_here")


def active(rows: DataFrame, mark: str = "removed_in_run_id") -> DataFrame:
    return rows.where(F.col(mark).isNull())


class BucketedTable:
    """A table kept in buckets of its key, one folder each. A change reads and writes only the buckets that
    it touches; the files of all others stay as they are. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets

    def create(self, df: DataFrame) -> None:
        self._put(df, "errorifexists")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _put(self, df: DataFrame, mode: str) -> None:
        placed = df.withColumn("bucket", bucket_of(df, self.key, self.buckets))
        placed.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys: no more numbers than there are buckets."""
        return sorted(r[0] for r in keys.select(bucket_of(keys, self.key, self.buckets)).distinct().collect())

    def _some(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets: a filter on folders."""
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(buckets)).drop("bucket")

    def upsert(self, new: DataFrame, protected: Sequence[str] = (), lock: str = "locked", removed: str | None = None) -> list[int]:
        """``locked_upsert`` of new rows, whose keys are distinct; gives the buckets that were written."""
        held = stored(new)
        touched = self._touched(held)
        if touched:
            # Written aside first: a bucket is replaced when all of the result exists.
            merged = stored(locked_upsert(self._some(touched), held, self.key, protected, lock, removed))
            self._put(merged, "overwrite")
            discard(merged)
        discard(held)
        return touched

    def soft_delete(self, present: DataFrame, run_id: int, mark: str = "removed_in_run_id") -> list[int]:
        """Mark rows whose key is gone. Keys and marks alone say which buckets have such rows."""
        here = present.select(*self.key).distinct()
        gone = self.read().where(F.col(mark).isNull()).select(*self.key).join(here, self.key, "left_anti")
        touched = self._touched(gone)
        if touched:
            old = self._some(touched)
            absent = here.withColumn("_here", F.lit(True))
            marked = old.join(absent, self.key, "left").withColumn(mark, F.when(F.col("_here").isNull() & F.col(mark).isNull(), F.lit(run_id).cast(old.schema[mark].dataType)).otherwise(F.col(mark)))
            written = stored(marked.select(*old.columns))
            self._put(written, "overwrite")
            discard(written)
        return touched
