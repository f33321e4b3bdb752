"""Writing tables, profiles, column definitions and reports. All writers are distributed; none collects rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.column_profile import name_is_personal
from plumbline.operators.fusion import top_groups


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def profile_json(profile: DataFrame) -> DataFrame:
    """The profile with timestamps in ISO form, ready for JSON."""
    iso = [f.name for f in profile.schema.fields if f.dataType.typeName().startswith("timestamp")]
    return profile.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in iso})


def write_profile(profile: DataFrame, path: str, mode: str = "overwrite") -> None:
    profile_json(profile).write.mode(mode).json(path)


def column_definitions(df: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """(name, description, data_type, pii_status, nullable) of a table's columns."""
    told = descriptions or {}
    rows = [(f.name, told.get(f.name, ""), f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    out = df.sparkSession.createDataFrame(rows, "name string, description string, data_type string, nullable boolean")
    status = F.when(name_is_personal(F.col("name")), "PII").otherwise("NON_PII")
    return out.select("name", "description", "data_type", status.alias("pii_status"), "nullable")


def write_column_definitions(df: DataFrame, path: str, descriptions: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    column_definitions(df, descriptions).write.mode(mode).json(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per report table, partitioned by date."""
    for name, df in tables.items():
        dated = df.withColumn("date", F.date_format("period", "yyyy-MM-dd"))
        write_table(dated, f"{path}/{name}", fmt, ("date",), mode)


def summary_lines(summary: DataFrame) -> DataFrame:
    """The group summary as text lines: totals, one line per column, the ten groups with most anomalies."""
    total = summary.where("level = 'total'").select(F.explode(F.array(
        F.struct(F.lit(1).alias("_o"), F.concat(F.lit("groups: "), "groups").alias("line")),
        F.struct(F.lit(2).alias("_o"), F.concat(F.lit("groups with flags: "), "groups_with_anomalies").alias("line")),
        F.struct(F.lit(3).alias("_o"), F.concat(F.lit("flags: "), "anomalies").alias("line")),
    )).alias("x")).select("x._o", F.lit("").alias("_n"), "x.line", F.lit(0).cast("bigint").alias("_a"))
    columns = summary.where("level = 'column'").select(F.lit(4).alias("_o"), F.col("name").alias("_n"),
                                                       F.concat("name", F.lit(": "), "anomalies").alias("line"), F.lit(0).cast("bigint").alias("_a"))
    groups = top_groups(summary).select(F.lit(5).alias("_o"), F.col("name").alias("_n"), F.concat("name", F.lit(": "), "anomalies").alias("line"),
                                        (-F.col("anomalies")).alias("_a"))
    return total.unionByName(columns).unionByName(groups).orderBy("_o", "_a", "_n").select("line")


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    summary_lines(summary).coalesce(1).write.mode(mode).text(path)
