"""Several scans in one table: a scan is the top folder of its paths.

Readers and joins take paths as they come, so files of many scans pass them
together and don't mix: prefixes, candidates and folders lie inside a scan's
own top folder, and suffixes are compared within a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends the name of a scan's top folder; no path of an archive holds it.
MARK = "\x01"


def scoped(files: DataFrame, scan: str = "scan_id", path: str = "path") -> DataFrame:
    """files with their scan as the top folder of their path."""
    return files.withColumn(path, F.concat(F.col(scan).cast("string"), F.lit(MARK + "/"), F.col(path)))


def scan_of(path: Column) -> Column:
    """The scan that a path is scoped by, or null."""
    return F.when(F.contains(path, F.lit(MARK)), F.substring_index(path, MARK, 1))


def bare(path: Column) -> Column:
    """The path inside its scan."""
    return F.when(F.contains(path, F.lit(MARK)), F.substring(F.substring_index(path, MARK, -1), 2, 1 << 30)).otherwise(path)


def within(df: DataFrame, columns: list[str], scan: str = "scan_id") -> DataFrame:
    """df with the values of such columns (texts or arrays of texts) scoped by its scan, so that equal ones of two scans differ; nulls stay."""
    top = F.concat(F.col(scan).cast("string"), F.lit(MARK + "/"))
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.transform(c, lambda x: F.concat(top, x)) if kinds[c].startswith("array") else F.concat(top, F.col(c)) for c in columns})


def node_scan(node: Column) -> Column:
    """The scan of a graph's node that was made of scoped values: `algorithm:` + scan + mark + name."""
    return scan_of(F.regexp_replace(node, "^[a-z]+:", ""))


def node_bare(node: Column) -> Column:
    """The node as it is called inside its scan."""
    return F.concat(F.substring_index(node, ":", 1), F.lit(":"), bare(F.regexp_replace(node, "^[a-z]+:", "")))
