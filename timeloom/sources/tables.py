"""Scans, sinks and the configurable load of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.columns import all_of


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def read_parquet(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """One or more paths or patterns; files are read by column, filters reach the scan."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.parquet(*paths)


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", infer: bool = False) -> DataFrame:
    """Delimited text with a header, plain or gzipped; all strings unless types are inferred."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=infer)


def read_csv_tables(spark: SparkSession, names: dict[str, str], *, sep: str = ",") -> dict[str, DataFrame]:
    """Tables of strings by name."""
    return {name: read_csv(spark, path, sep=sep) for name, path in names.items()}


def read_csv_folder(spark: SparkSession, folder: str, *, sep: str = ",", ending: str = ".csv.gz") -> dict[str, DataFrame]:
    """All delimited files below a folder as tables of strings, by file name without its ending; names must differ."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found: dict[str, str] = {}
    while files.hasNext():
        at = files.next().getPath()
        name = at.getName()
        if name.endswith(ending):
            name = name[: -len(ending)]
            if name in found:
                raise ValueError(f"two files are named {name}{ending}")
            found[name] = at.toString()
    return read_csv_tables(spark, dict(sorted(found.items())), sep=sep)


def read_filtered(spark: SparkSession, path: str, columns: list[str], isin: dict[str, list] | None = None) -> DataFrame:
    """Some columns of the rows whose columns have one of the given values; both reach the scan."""
    df = spark.read.parquet(path)
    for name, values in (isin or {}).items():
        df = df.where(F.col(name).isin(*values))
    return df.select(*columns)


def read_splits(spark: SparkSession, paths: dict[str, str], columns: dict[str, str]) -> dict[str, DataFrame]:
    """A table per split, its columns under new names."""
    return {name: spark.read.parquet(path).select(*[F.col(old).alias(new) for old, new in columns.items()]) for name, path in paths.items()}


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def write_parquet(df: DataFrame, path: str, *, partition_by: str | None = None, compression: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)


def load(
    df: DataFrame, *, subject_id: str, key: str | None = None, filter_expr: list[str] | str | None = None,
    with_col_expr: dict[str, str] | None = None, agg_expr: dict[str, str] | None = None, subject_id_str: str | None = None,
) -> DataFrame:
    """Subject id, then filters, then derived columns, then aggregation; expressions are Spark SQL.

    Derived columns see those before them.
    """
    if subject_id_str:
        df = df.withColumn(subject_id, F.expr(subject_id_str))
    df = df.where(all_of(filter_expr)) if filter_expr else df
    for name, text in (with_col_expr or {}).items():
        df = df.withColumn(name, F.expr(text))
    if agg_expr:
        df = df.groupBy(key or subject_id).agg(*[F.expr(text).alias(name) for name, text in agg_expr.items()])
    return df


def first_column(df: DataFrame, *names: str) -> str:
    """The first of ``names`` that the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} in {df.columns}")


def ravel(df: DataFrame, keys: list[str], arrays: dict[str, str], position: str = "pos") -> DataFrame:
    """Parallel arrays to one row per element: keys, position, one column per array."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(*keys, F.posexplode(zipped).alias(position, "__x")).select(*keys, position, *[F.col("__x")[n].alias(n) for n in arrays])
