"""Small fixed dimensions (recipients, taxonomy mapping) and their CSV form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


def _values(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """Fixed rows as an inline ``VALUES`` relation, whose size Spark knows when it picks a join."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(f"CAST({quoted(v)} AS {f.dataType.simpleString()})" for v, f in zip(row, schema.fields)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS fixed({', '.join(schema.fieldNames())})")


def recipients(spark: SparkSession) -> DataFrame:
    """Platform x month -> average monthly active recipients (12 fixed rows)."""
    return _values(spark, S.RECIPIENTS, S.RECIPIENTS_SCHEMA)


def mapping(spark: SparkSession) -> DataFrame:
    """Category -> super-cluster mapping (17 fixed rows, unique key)."""
    return _values(spark, S.MAPPING, S.MAPPING_SCHEMA)


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV read of a mapping table with the header of ``MAPPING_SCHEMA``."""
    return spark.read.schema(S.MAPPING_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Typed CSV read (no inference) of a small profile or metrics extract."""
    return spark.read.schema(schema).option("header", True).csv(path)
