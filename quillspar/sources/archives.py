"""Archives as tables of files: one Python table function reads members, everything else is columns."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.session import ship


@dataclass(frozen=True)
class Limits:
    files: int = 50_000
    file_bytes: int = 5 << 20
    total_bytes: int = 300 << 20
    ratio: int = 100
    ratio_floor: int = 1 << 20


def archive_type(content: Column) -> Column:
    """By the first bytes, never by the name; null for anything else."""
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    return (
        F.when(starts(b"PK\x03\x04") | starts(b"PK\x05\x06"), "zip")
        .when(starts(b"\x1f\x8b"), "tar.gz")
        .when(starts(b"BZh"), "tar.bz2")
        .when(starts(b"\xfd7zXZ\x00"), "tar.xz")
        .when(F.substring(content, 258, 5) == F.lit(b"ustar"), "tar")
    )


def _zip_members(content: bytes) -> Iterator[tuple[str, int, object]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, info.file_size, lambda n, info=info: archive.open(info).read(n)


def _tar_members(content: bytes) -> Iterator[tuple[str, int, object]]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
        for info in archive:
            if info.isfile():
                yield info.name, info.size, lambda n, info=info: archive.extractfile(info).read(n)
            elif not info.isdir():
                yield info.name, -1, None


def _read(name: str, content: bytes, kind: str | None, limits: Limits) -> list[tuple]:
    """(archive, member, size, content, skip, error); one error row stands for an archive that breaks a limit."""
    rows, total = [], 0
    allowed = max(limits.ratio_floor, limits.ratio * len(content))
    try:
        if kind is None:
            raise ValueError("unsupported_archive")
        for member, size, read in (_zip_members if kind == "zip" else _tar_members)(content):
            if len(rows) >= limits.files:
                raise ValueError("too_many_files")
            if read is None:
                raise ValueError("unsafe_member")
            if size > limits.file_bytes:
                total += size
                rows.append((name, member, size, None, "too_large", None))
            else:
                data = read(limits.file_bytes + 1)
                if len(data) > limits.file_bytes or len(data) != size:
                    raise ValueError("size_mismatch")
                total += len(data)
                rows.append((name, member, len(data), data, None, None))
            if total > limits.total_bytes:
                raise ValueError("too_large_extracted")
            if total > allowed:
                raise ValueError("compression_ratio")
    except (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, RuntimeError) as broken:
        reason = str(broken) if type(broken) is ValueError else "corrupt_archive"
        return [(name, None, None, None, None, reason)]
    return rows


def read_archives(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, path, size, content, skip, error) from archives(name, content).

    A whole archive is refused, as one row with its error, when it breaks a
    limit, holds links or devices, an unsafe path or a path twice. Files above
    the size limit and binary files have a skip reason and no content.
    """
    ship(archives.sparkSession)
    typed = archives.select("name", "content", archive_type(F.col("content")).alias("kind"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content, kind in frame.itertuples(index=False):
                yield pd.DataFrame(_read(name, bytes(content), kind, limits), columns=["archive", "member", "size", "content", "skip", "error"])

    members = typed.mapInPandas(run, "archive string, member string, size long, content binary, skip string, error string")
    members = members.withColumn("path", T.normal_path(F.col("member")))
    unsafe = F.when(F.col("member").isNotNull() & F.col("path").isNull(), "unsafe_path")
    twice = members.where("path IS NOT NULL").groupBy("archive", "path").count().where("count > 1").select("archive").distinct().withColumn("_twice", F.lit("duplicate_path"))
    bad = members.groupBy("archive").agg(F.max(F.coalesce("error", unsafe)).alias("_bad")).join(twice, "archive", "left").select("archive", F.coalesce("_bad", "_twice").alias("_error"))
    joined = members.drop("error").join(bad, "archive").withColumn("_first", F.col("_error").isNotNull())
    good = joined.where("NOT _first")
    binary = F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) > 0
    skip = F.coalesce("skip", F.when(binary, "binary"))
    good = good.select("archive", "path", "size", F.when(skip.isNull(), F.col("content")).alias("content"), skip.alias("skip"), F.lit(None).cast("string").alias("error"))
    refused = bad.where("_error IS NOT NULL").select("archive", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("skip"), F.col("_error").alias("error"))
    return good.unionByName(refused)
