"""Parameters as data: a file, or a relation of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerokpi.params import DEFAULT, KpiParams, params_from_text


def read_params(spark: SparkSession, path: str, base: KpiParams = DEFAULT) -> KpiParams:
    """Parameters from a JSON or YAML file on any file system that Spark reads."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path}: expected one parameter file")
    return params_from_text(found[0].value, base, path)


def params_of(relation: DataFrame, base: KpiParams = DEFAULT) -> KpiParams:
    """Parameters from a relation of exactly one row, a column per parameter (any case); null
    keeps the base's value."""
    rows = relation.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a parameter relation has one row, not {'none' if not rows else 'several'}")
    plain = {"float": float, "Decimal": float}
    values = {k.lower(): plain.get(type(v).__name__, lambda x: x)(v) for k, v in rows[0].asDict(recursive=True).items() if v is not None}
    return base.with_values(values)
