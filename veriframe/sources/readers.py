"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.schemas import FEATURES, TABLES, _struct

# Fixed formats: benchmark score files.
BENCHMARK_SCHEMAS = {
    "ocr": _struct(
        "document:s condition:s setting:s frame:s fields:i ocrConfidenceScore:d easyocrMeanConfidence:d"
    ),
    "face": _struct("image1:s image2:s pair_type:s faces_detected:b faceMatchScore:d"),
    "liveness": _struct("image:s presentation:s subject:s session:s livenessScore:d"),
    "quality": _struct(
        "document:s condition:s setting:s frame:s documentFound:b blurScore:d brightnessScore:d "
        "contrastScore:d passed:b"
    ),
    "scores": _struct("request_id:l " + " ".join(f"{name}:d" for name in FEATURES)),
}


def read_table(spark, name, path, format="parquet", **options):
    """A domain table with its declared schema; filters and columns are pushed into the scan."""
    return spark.read.schema(TABLES[name]).options(**options).format(format).load(path)


def _declared(rows, name):
    """Columns of a table with their declared names and types; arrays are stored as JSON or comma-separated text."""
    columns = []
    for field in TABLES[name].fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.ArrayType) and not isinstance(rows.schema[column_name(rows, field.name)].dataType, T.ArrayType):
            text = F.trim(column)
            listed = F.from_json(text, kind)
            column = F.when(text.startswith("["), listed).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x)).cast(kind))
        columns.append(column.cast(kind).alias(field.name))
    return rows.select(*columns)


def column_name(rows, name):
    """The table's own spelling of a column; databases may change the case of names."""
    return next(c for c in rows.columns if c.lower() == name.lower())


def key_ranges(keys, column, partitions, quote='"'):
    """WHERE texts that cut a numeric column at its own quantiles; together they take every row once, nulls with the first."""
    cuts = keys.agg(F.percentile_approx(column, [i / partitions for i in range(1, partitions)], 10_000)).first()[0] if partitions > 1 else None
    cuts, column = sorted(set(cuts or [])), f"{quote}{column}{quote}"
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} > {a} AND {column} <= {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} <= {cuts[0]} OR {column} IS NULL", *inner, f"{column} > {cuts[-1]}"]


def read_table_jdbc(spark, name, url, partition_column=None, partitions=16, table=None, quote='"', **options):
    """A domain table over JDBC with its declared schema; filters on columns of unchanged type and column choices go to the database.

    With ``partition_column`` (numeric), ``partitions`` connections read ranges of about equal numbers of rows: the column alone
    is read first for its quantiles, so that gaps and crowded stretches of keys do not make uneven tasks. ``quote`` is the
    database's mark around names.
    """
    properties = {k: str(v) for k, v in options.items()}
    if partition_column is None:
        return _declared(spark.read.jdbc(url, table or name, properties=properties), name)
    keys = spark.read.jdbc(url, table or name, properties=properties)
    ranges = key_ranges(keys.select(column_name(keys, partition_column)), column_name(keys, partition_column), partitions, quote)
    return _declared(spark.read.jdbc(url, table or name, predicates=ranges, properties=properties), name)


def read_benchmark_csv(spark, kind, path):
    """Benchmark score CSV with header; bad rows fail instead of turning into nulls."""
    return (
        spark.read.schema(BENCHMARK_SCHEMAS[kind]).option("header", True).option("mode", "FAILFAST")
        .option("enforceSchema", False).csv(path)
    )
