"""Warehouse tables: create, query with SQL text, drop a namespace's tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def warehouse_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a namespace, optionally with its own folder."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{name}`{where}")


def warehouse_table(df: DataFrame, namespace: str, table: str, bucket_by: str | None = None, buckets: int = 0) -> DataFrame:
    """Save as a table; bucketed tables join on the bucket column without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(f"`{namespace}`.`{table}`")
    return df.sparkSession.table(f"`{namespace}`.`{table}`")


def warehouse_sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text as it stands; `${..}` in it is kept instead of being taken as a session variable.

    The views exist for this text only; views of the same names that the session has come back afterwards.
    """
    views = views or {}
    held = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    earlier = {name: spark.table(f"`{name}`") for name in views if name.lower() in held}
    before = spark.conf.get("spark.sql.variable.substitute")
    spark.conf.set("spark.sql.variable.substitute", "false")
    try:
        for name, view in views.items():
            view.createOrReplaceTempView(name)
        return spark.sql(text)  # views are resolved here
    finally:
        spark.conf.set("spark.sql.variable.substitute", before)
        for name in views:
            spark.catalog.dropTempView(name)
        for name, view in earlier.items():
            view.createOrReplaceTempView(name)


def warehouse_clean(spark: SparkSession, namespace: str) -> int:
    """Drop every table of a namespace; returns how many there were."""
    tables = [t.name for t in spark.catalog.listTables(namespace) if not t.isTemporary]
    for table in tables:
        spark.sql(f"DROP TABLE `{namespace}`.`{table}`")
    return len(tables)
