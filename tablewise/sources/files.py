"""File sources: each file of a folder is one table, named by the file's stem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablewise.operators.staging import unique_names

_DATE_FORMATS = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def list_tables(spark: SparkSession, folder: str, suffix: str) -> dict[str, str]:
    """Table name to path for the entries of a folder with a suffix, in name order.

    Listing goes through Hadoop's file system, so any store that Spark reads will do.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    entries = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(e.getPath().getName() for e in entries)
    return {n[: -len(suffix)]: f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(suffix)}


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; the whole input is looked at to infer the schema."""
    return spark.read.json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, inferred types over the whole input; if inference fails, all columns as strings."""
    plain = spark.read.option("header", True).options(**_DATE_FORMATS)
    try:
        return plain.option("inferSchema", True).option("mode", "FAILFAST").csv(path)
    except Exception as error:
        if "MALFORMED" not in str(error) and "FAILED" not in str(error):
            raise
        return plain.option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)


def read_csv_as_text(spark: SparkSession, path: str) -> DataFrame:
    """The last rung of the ladder on its own: every column a string, bad rows kept."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


#: Types that a column of text is tried with, in order, and what a value of each looks like. Numbers with
#: leading zeros are codes, and a day with a time is no date.
CSV_TYPES = (
    ("bigint", r"^-?(0|[1-9][0-9]*)$"),
    ("double", r"^[+-]?(0|[1-9][0-9]*)?(\.[0-9]*)?([eE][+-]?[0-9]+)?$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}.*$"),
    ("boolean", r"^(?i)(true|false)$"),
)


def read_csv_rescued(spark: SparkSession, path: str, least: float = 0.9, rescued: str = "_rescued") -> DataFrame:
    """Typed columns of a CSV with a header, and what does not fit them, so that no line is lost.

    Lines are read as text. A line with too few or too many cells, as a quote that is never closed makes
    it, is kept whole: its columns are null, and ``rescued`` holds it under ``_line``. Of the others one
    aggregate counts for each column how many values each type in ``CSV_TYPES`` takes; the first that takes
    the share ``least`` of those that are not null is the column's type, else it stays text. A value that
    its column's type does not take is null there and stands in ``rescued`` under the column's name.
    ``rescued`` is a JSON object, null for lines that fit."""
    names = spark.read.option("header", True).csv(path).columns
    whole = unique_names([*names, "_line"], str)[-1]
    schema = StructType([StructField(n, StringType()) for n in [*names, whole]])
    # With columns pruned, a reader of some columns would not see that a line has too few cells.
    lines = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", whole).schema(schema).csv(path)
    cells = lines.toDF(*[f"c{k}" for k in range(len(names))], "line")
    value = [F.when(F.col("line").isNull(), F.col(f"c{k}")) for k in range(len(names))]
    taken = lambda v, kind, looks: F.when(v.rlike(looks), v.try_cast(kind))
    counts = cells.agg(*[F.struct(F.count(v).alias("n"), *[F.count(taken(v, kind, looks)).alias(kind) for kind, looks in CSV_TYPES]).alias(f"c{k}") for k, v in enumerate(value)]).first()
    typed, odd = [], [F.struct(F.lit(whole).alias("key"), F.col("line").alias("value"))]
    for k, (name, v) in enumerate(zip(names, value)):
        own = counts[f"c{k}"]
        fit = next(((kind, looks) for kind, looks in CSV_TYPES if own["n"] and own[kind] >= least * own["n"]), None)
        got = taken(v, *fit) if fit else v
        typed.append(got.alias(name))
        if fit:
            odd.append(F.struct(F.lit(name).alias("key"), F.when(got.isNull(), v).alias("value")))
    kept = F.map_from_entries(F.filter(F.array(*odd), lambda x: x["value"].isNotNull()))
    return cells.select(*typed, F.when(F.size(kept) > 0, F.to_json(kept)).alias(unique_names([*names, rescued], str)[-1]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Readers by kind; add to it to register another.
READERS = {"ndjson": (".json", read_ndjson), "csv": (".csv", read_csv), "csv_rescued": (".csv", read_csv_rescued), "parquet": (".parquet", read_parquet)}


def load_folder(spark: SparkSession, folder: str, kind: str, prefix: str = "") -> dict[str, DataFrame]:
    """Read every table of a folder and register each as a temporary view."""
    suffix, reader = READERS[kind]
    tables = {name: reader(spark, path) for name, path in list_tables(spark, folder, suffix).items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return tables


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows chosen by the smallest hashes of a key: the same rows however the data is laid out.

    A top-k, so every task sends at most n rows.
    """
    mark = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return df.withColumn("_mark", mark).orderBy("_mark", key).limit(n).drop("_mark")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def head_rows(df: DataFrame, n: int = 10_000) -> DataFrame:
    return df.limit(n)
