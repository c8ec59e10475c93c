"""Source trees as tables: directory scans, kinds, guards, lines, and writing findings out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.session import ship

#: Larger files are skipped; structured files have a smaller bound.
MAX_FILE_BYTES = 5 << 20
MAX_STRUCTURED_BYTES = 1 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt over at least three tasks a core, whatever partitions they come in.

    A table of names is a few megabytes in a few row groups, that is one or two
    tasks, though each of its rows stands for a file that takes a while to read.
    It is to be dealt before texts are made of it.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, content) of all files below a folder, without vendor folders (see skipped_folders)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    whole = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    base = root.split("://")[-1].rstrip("/").removeprefix("file:")
    relative = F.substring(whole, len(base) + 2, 1 << 20)
    return rows.select(relative.alias("path"), F.col("length").alias("size"), "content")


def assessed(files: DataFrame) -> DataFrame:
    """files with kind, text, sha256 and skip: null, or why a file isn't scanned (vendored, unsupported, too_large, binary, minified).

    text is what may be kept: private keys and other secrets are replaced by a
    marker, lines stay where they are; sha256 is that of the kept text, or of
    the content where there is none.
    """
    kind = T.classify(F.col("path"))
    large = (F.col("size") > MAX_FILE_BYTES) | (kind.isin("json", "yaml") & (F.col("size") > MAX_STRUCTURED_BYTES))
    binary = F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) > 0
    readable = kind.isin("python", "java", "js", "text")
    ship(files.sparkSession)
    rows = files.withColumn("kind", kind).withColumn("text", F.when(~large & ~binary & kind.isNotNull(), T.decoded(F.col("content"))))
    rows = rows.withColumn("text", F.pandas_udf(without_keys, "string")("text")).withColumn("text", T.redacted_file(F.col("path"), F.col("text")))
    skip = (
        F.when(T.vendored(F.col("path")), "vendored").when(kind.isNull(), "unsupported").when(large, "too_large").when(binary, "binary").when(readable & T.minified(F.col("text")), "minified")
    )
    return rows.withColumn("sha256", F.sha2(F.coalesce(F.col("text").cast("binary"), "content"), 256)).withColumn("skip", skip).drop("content")


_KEY_HEADER = re.compile(r"-----BEGIN (?:(?!-----).)*?PRIVATE KEY(?:(?!-----).)*?-----")
_KEY_FOOTER = re.compile(r"-----END .{0,48}?PRIVATE KEY")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")


def _keyless(text: str) -> str:
    """Lines of private-key blocks replaced; a block ends at its footer, at the next header or with the text."""
    out, inside = [], False
    for line in text.split("\n"):
        header, shown = _KEY_HEADER.search(line), line
        if header:
            footer = _KEY_FOOTER.search(line, header.end())
            body = line[header.end() : footer.start()] if footer else line[header.end() :]
            if footer:
                shown = line[: header.end()] + (T.REDACTED if body.strip() else body) + line[footer.start() :]
            else:
                shown = line[: header.end()] + _KEY_BODY.sub(T.REDACTED, body)
            inside = footer is None
        elif inside:
            footer = _KEY_FOOTER.search(line)
            shown = _KEY_BODY.sub(T.REDACTED, line[: footer.start()]) + line[footer.start() :] if footer else T.REDACTED if line.strip() else line
            inside = footer is None
        out.append(shown)
    return "\n".join(out)


def without_keys(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _keyless(t) if t is not None and "PRIVATE KEY" in t else t)


def scannable(files: DataFrame) -> DataFrame:
    return assessed(files).where("skip IS NULL").drop("skip")


def lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each line, numbered from 1, instead of the text."""
    rest = [c for c in files.columns if c != text_col]
    return files.select(*rest, F.posexplode(F.split(text_col, "\n")).alias("_at", "text")).select(*rest, (F.col("_at") + 1).alias("line"), "text")


def without_single_root(files: DataFrame) -> DataFrame:
    """If all paths lie in one top folder, that folder is taken off."""
    top = F.substring_index("path", "/", 1)
    one = files.agg((F.count_distinct(top) == 1).alias("same"), F.bool_and(F.col("path").contains("/")).alias("deep")).first()
    return files.withColumn("path", F.regexp_replace("path", "^[^/]+/", "")) if one["same"] and one["deep"] else files


def skipped_by_reason(files: DataFrame) -> DataFrame:
    return assessed(files).where("skip IS NOT NULL").groupBy("skip").agg(F.count("*").alias("n"))


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as Parquet by scan; a scan's earlier rows are replaced, and (scan_id, id) must be unique."""
    twice = findings.groupBy("scan_id", "id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("findings repeat (scan_id, id)")
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, CRLF line ends, Python's booleans, empty nulls and no cell that runs as a formula."""
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        if kinds[name] == "boolean":
            return F.when(F.col(name), "True").when(~F.col(name), "False")
        return T.csv_safe(F.col(name)) if kinds[name] == "string" else F.col(name)

    rows.select(*[cell(c).alias(c) for c in columns]).write.mode("overwrite").option("header", "true").option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)
