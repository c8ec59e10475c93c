"""Tables that are written by key: the last writer of a row wins, and a row may be cleared.

A table lies in one folder for each scan. A write rewrites the folders of the
scans that it names and no others; Spark stages a job's folders aside and moves
them in when the job has ended, so a run that breaks off before leaves the
table as it was. Cleared rows stay as marks, so that an older change that
arrives late doesn't bring one back and a run may be repeated at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

SCAN, CLEARED = "scan_id", "cleared"
#: So many scans or fewer are named to the reader, which then lists their folders only; more are joined.
NAMED = 1000


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def latest(changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last change of each key: the greatest `at` (null before all), among equals the one whose other values are greatest."""
    rest = [c for c in changes.columns if c not in keys]
    order = F.struct(F.col(at).isNotNull().alias("known"), F.col(at).alias("at"), F.struct(*[F.col(c).cast("string") for c in rest]).alias("rest"))
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*changes.columns)


def upsert(changes: DataFrame, path: str, keys: tuple[str, ...] = (SCAN, "id"), at: str = "at") -> None:
    """Merges changes into the table at path, which is made if there is none.

    changes has scan_id, the keys, `at` (when it was said), any other columns
    and, if rows may be cleared, `cleared`. Rows with a null key are no changes.
    Changes may come in any order and more than once.
    """
    spark = changes.sparkSession
    if CLEARED not in changes.columns:
        changes = changes.withColumn(CLEARED, F.lit(False))
    changes = changes.withColumn(CLEARED, F.coalesce(CLEARED, F.lit(False))).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rows = latest(changes, list(keys), at)
    if _there(spark, path):
        schema = StructType([*[f for f in changes.schema.fields if f.name != SCAN], changes.schema[SCAN]])
        before = spark.read.schema(schema).parquet(path).select(*changes.columns)
        scans = changes.select(SCAN).distinct()
        few = [r[0] for r in scans.limit(NAMED + 1).collect()]
        before = before.where(F.col(SCAN).isin(few)) if len(few) <= NAMED else before.join(scans, SCAN, "left_semi")
        rows = latest(before.unionByName(rows), list(keys), at)
    rows.repartition(SCAN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SCAN).parquet(path)


def current(spark: SparkSession, path: str, schema: StructType, scan: str | Column | None = None) -> DataFrame:
    """The rows of a table that aren't cleared, of one scan (its folder alone is read) or of all; schema: of the changes."""
    fields = [f for f in schema.fields if f.name not in (SCAN, CLEARED)]
    full = StructType([*fields, StructField(CLEARED, BooleanType()), schema[SCAN]])
    rows = spark.read.schema(full).parquet(path) if _there(spark, path) else spark.createDataFrame([], full)
    if scan is not None:
        rows = rows.where(F.col(SCAN) == scan)
    return rows.where(~F.col(CLEARED)).drop(CLEARED).select(*[c for c in schema.names if c != CLEARED])

