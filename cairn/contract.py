"""The schema contract: the published tables and their columns, checked where tables are read and written."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

_KEY = "id BIGINT NOT NULL"
TABLES: dict[str, str] = {
    "places": f"{_KEY}, name STRING NOT NULL, slug STRING NOT NULL, lng DOUBLE, lat DOUBLE, place_type STRING NOT NULL, content_level INT, status STRING NOT NULL, accuracy DOUBLE, survival_status STRING, town STRING, county STRING, cost DOUBLE",
    "designations": f"{_KEY}, place_id BIGINT NOT NULL, designation STRING NOT NULL, grade STRING, reference STRING",
    "temporal": f"{_KEY}, place_id BIGINT NOT NULL, association_type STRING NOT NULL, period_id STRING, start_year INT, end_year INT, status STRING NOT NULL, date_precision STRING",
    "periods": "id STRING NOT NULL, display_name STRING NOT NULL, start_year INT NOT NULL, end_year INT NOT NULL",
    "images": f"{_KEY}, place_id BIGINT NOT NULL, thumbnail_url STRING, status STRING NOT NULL, seq INT",
    "rights": "image_id BIGINT NOT NULL, attribution STRING, licence STRING",
    "records": "source_id STRING NOT NULL, source_record_id STRING NOT NULL, name STRING, lng DOUBLE, lat DOUBLE, modified TIMESTAMP",
    "decisions": f"{_KEY}, outcome STRING NOT NULL, matched BIGINT, confidence DOUBLE",
    "facts": f"{_KEY}, predicate STRING NOT NULL, value STRING NOT NULL, source_value STRING",
}


@cache
def schema(table: str) -> StructType:
    """A table's schema; Spark reads the declaration, so a session must be there."""
    return StructType.fromDDL(TABLES[table])


def differences(found: StructType, table: str) -> list[str]:
    """What a schema lacks or has otherwise than the contract says; more columns are allowed, and nulls aren't looked at."""
    have = {f.name: f.dataType for f in found}
    out = []
    for f in schema(table):
        if f.name not in have:
            out.append(f"{f.name} is missing")
        elif have[f.name] != f.dataType:
            out.append(f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return out


def checked(df: DataFrame, table: str) -> DataFrame:
    """The contract's columns of df, in its order; ValueError names every difference."""
    if wrong := differences(df.schema, table):
        raise ValueError(f"{table}: {'; '.join(wrong)}")
    return df.select(*schema(table).names)


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that lack a column which may not be null."""
    needed = [f.name for f in schema(table) if not f.nullable]
    return checked(df, table).filter(" OR ".join(f"`{n}` IS NULL" for n in needed))


def write(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    """Writes a table that keeps the contract; a null where none may be ends the job, before anything is committed."""
    rows = checked(df, table)
    needed = {f.name for f in schema(table) if not f.nullable}
    kept = [f"CASE WHEN `{n}` IS NULL THEN raise_error('{table}.{n} is null') ELSE `{n}` END AS `{n}`" if n in needed else f"`{n}`" for n in rows.columns]
    rows.selectExpr(*kept).write.mode(mode).parquet(path)


def read(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Reads a table by the contract's schema; files of other types are refused when they are opened."""
    df = checked(spark.read.parquet(path), table)
    return df.to(StructType([StructField(f.name, f.dataType, True) for f in schema(table)]))
