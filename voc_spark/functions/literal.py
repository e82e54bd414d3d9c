"""Small constant tables as literals, with no Python rows at run time."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def literal_table(spark: SparkSession, columns: dict[str, str], rows: Sequence[Sequence]) -> DataFrame:
    """`rows` under the given {name: type} columns."""
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, columns.items(), strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
