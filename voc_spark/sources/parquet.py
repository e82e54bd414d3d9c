"""Parquet scans, sinks and versioned tables."""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from voc_spark.schemas import RAW_REVIEWS, TABLES
from voc_spark.session import fresh_dir
from voc_spark.taxonomy import PRODUCT_CATEGORIES


#: Writer options: a bloom filter on the review id lets a point lookup skip row groups that dates can't.
ID_LOOKUP = {"parquet.bloom.filter.enabled#review_id": "true"}


def scan_reviews(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = RAW_REVIEWS) -> DataFrame:
    """One scan over the files of every product category, schema given, nothing inferred."""
    return spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))


def category_files(root: str, categories: Sequence[str] = tuple(PRODUCT_CATEGORIES)) -> list[str]:
    """The raw review file of every product category below `root`."""
    return [f"{root}/{c}.parquet" for c in categories]


def write_table(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> DataFrame:
    """Write `df` and return it as a scan of what was written."""
    df.write.mode(mode).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write an intermediate result below the shared folder and scan it back.

    The scan carries the real file size, so Catalyst broadcasts it in a join only if it
    is below `spark.sql.autoBroadcastJoinThreshold` and shuffles it otherwise. It also cuts the lineage.
    """
    path = fresh_dir(df.sparkSession, label)
    for made in _scratches:
        made.append(path)
    return write_table(df, path, mode="errorifexists", **options)


_scratches: list[list[str]] = []


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For jobs that commit their own output: what `stored` writes inside the block is deleted at its end."""
    made: list[str] = []
    _scratches.append(made)
    try:
        yield
    finally:
        _scratches.remove(made)
        for path in made:
            drop_folder(spark, path)


def init_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the tables below `root` that do not exist yet; returns their paths."""
    paths = {}
    for name, schema in TABLES.items():
        paths[name] = f"{root}/{name}"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(paths[name])
    return paths


def current_version(spark: SparkSession, root: str) -> int:
    """Highest committed version below `root`, -1 when there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=-1)


def read_version(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The given (default: newest committed) version of a versioned table."""
    version = current_version(spark, root) if version is None else version
    if version < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/version={version}")


def write_version(df: DataFrame, root: str) -> int:
    """Write `df` beside the older versions, never over a path that is being read.

    A job that dies half-way leaves no `_SUCCESS`, so readers stay on the old version;
    one writer at a time is assumed, as for any plain Parquet folder.
    """
    version = current_version(df.sparkSession, root) + 1
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/version={version}")
    return version
