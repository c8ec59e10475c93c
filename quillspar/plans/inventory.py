"""The inventory of findings: filters, search, facets, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.functions.scoring import BANDS, band_rank
from quillspar.operators.aggregates import closed_histogram, conditional_totals, facets

SEARCHED = ["file", "algorithm", "operation", "service", "evidence", "rule_id"]
FACETS = ["algorithm", "primitive", "service", "band", "confidence_level"]
CSV_COLUMNS = ["id", "algorithm", "primitive", "operation", "service", "file", "line_start", "confidence_level", "band", "qmp", "quantum_vulnerable", "already_pqc", "hndl", "rule_id", "evidence"]
_LANGUAGES = {"python": ["py"], "java": ["java"], "js": ["js", "ts", "jsx", "tsx", "mjs", "cjs"], "config": ["yaml", "yml", "json", "conf", "crt", "pem"]}


def searched(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows where the lower-cased query is part of the columns' values, joined by spaces; a literal, no pattern."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def filtered(findings: DataFrame, query: str | None = None, language: str | None = None, include_comments: bool = False, include_tests: bool = False, include_suppressed: bool = False, **equal) -> DataFrame:
    """Findings that meet all given conditions; suppressed, comment and test-path rows only where asked for.

    equal: values of algorithm, primitive, service, band, confidence_level,
    quantum_vulnerable or already_pqc; None means any. Each becomes a plain
    predicate, so that it reaches the files.
    """
    out = findings
    for column, wanted in (("suppressed", include_suppressed), ("comment_only", include_comments), ("test_path", include_tests)):
        if not wanted:
            out = out.where(~F.col(column))
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    if language:
        known = [e for es in _LANGUAGES.values() for e in es]
        ext = T.extension(F.col("file"))
        hit = ~ext.isin(known) if language == "other" else ext.isin(_LANGUAGES[language])
        out = out.where(hit | F.lower("file").endswith("dockerfile") if language == "config" else hit)
    return searched(out, query, SEARCHED) if query else out


def finding_facets(findings: DataFrame) -> DataFrame:
    """Always of all findings, whatever is filtered."""
    return facets(findings, FACETS)


def live(findings: DataFrame) -> DataFrame:
    return findings.where("NOT suppressed AND NOT comment_only")


def totals(findings: DataFrame) -> DataFrame:
    code = ~F.col("suppressed") & ~F.col("comment_only")
    c = F.col
    conditions = {
        "crypto_findings": code,
        "quantum_vulnerable": code & c("quantum_vulnerable"),
        "already_pqc": code & c("already_pqc"),
        "high_confidence": code & (c("confidence_level") == "high"),
        "critical": code & (c("band") == BANDS[-1]),
        "hndl_elevated": code & c("hndl") & (c("hndl_severity") == "elevated"),
        "mentions": ~c("suppressed") & c("comment_only"),
        "suppressed": c("suppressed"),
        "test_path": code & c("test_path"),
    }
    return conditional_totals(findings.withColumn("_service", F.when(code, c("service"))), conditions, {"services": "_service"}).drop("total")


def by_band(findings: DataFrame) -> DataFrame:
    return closed_histogram(live(findings), "band", list(reversed(BANDS)))


def by_algorithm(findings: DataFrame) -> DataFrame:
    return live(findings).groupBy("algorithm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "algorithm")


def by_service(findings: DataFrame, services: DataFrame) -> DataFrame:
    """Measures and migration status of each service, worst first."""
    c = F.col
    sums = live(findings).groupBy("service").agg(
        F.count("*").alias("findings"),
        F.count_if(c("quantum_vulnerable")).alias("quantum_vulnerable"),
        F.count_if(c("already_pqc")).alias("already_pqc"),
        F.count_if(c("band") == BANDS[3]).alias("critical"),
        F.count_if(c("band") == BANDS[2]).alias("high"),
        F.count_if(c("hndl")).alias("hndl"),
    )
    meta = services.groupBy("service").agg(F.max_by(F.struct("data_classification", "business_criticality", "internet_exposed", "data_lifetime_years", "missing_fields", "invalid_fields"), "metadata_file").alias("m"))
    status = F.when(c("quantum_vulnerable") == 0, "no quantum-vulnerable crypto found").when(c("already_pqc") > 0, "in progress: PQC already present").otherwise("not started")
    gaps = c("m").isNull() | (F.size("m.missing_fields") + F.size("m.invalid_fields") > 0)
    rows = sums.join(meta, "service", "left").withColumn("metadata_missing", gaps).withColumn("migration_status", status)
    return rows.select(*sums.columns, "m.data_classification", "m.business_criticality", "m.internet_exposed", "m.data_lifetime_years", "metadata_missing", "migration_status").orderBy(F.desc("critical"), F.desc("quantum_vulnerable"), "service")


def top_findings(ranked: DataFrame, k: int = 8) -> DataFrame:
    """The first findings by rank above the lowest band."""
    return live(ranked).where(band_rank(F.col("band")) >= 1).orderBy("rank").limit(k)


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """findings with `suppressed` as the suppression table (scan_id, id, reason) says."""
    told = suppressions.groupBy("scan_id", "id").agg(F.max(F.col("reason").isNotNull()).alias("_told"))
    return findings.join(told, ["scan_id", "id"], "left").withColumn("suppressed", F.coalesce("_told", F.lit(False))).drop("_told")


def counted(findings: DataFrame, column: str) -> DataFrame:
    """(column, n) of all findings, most first: by rule, primitive or algorithm."""
    return findings.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def by_language(assessed: DataFrame) -> DataFrame:
    """(language, n) of the files that were scanned; configuration of all forms is one language."""
    language = F.when(F.col("kind").isin("python", "java", "js"), F.col("kind")).when(F.col("kind") == "doc", "doc").otherwise("config")
    return assessed.where("skip IS NULL").groupBy(language.alias("language")).agg(F.count("*").alias("n"))


def scan_list(scans: DataFrame) -> DataFrame:
    """Scans, the newest first."""
    return scans.orderBy(F.desc("created_at"), "scan_id")


def finding(findings: DataFrame, scan_id: str, id_: str) -> DataFrame:
    """One finding of one scan; both are plain predicates, so that only that scan's files are read."""
    return findings.where((F.col("scan_id") == scan_id) & (F.col("id") == id_))


def has_room(scans: DataFrame, capacity: int) -> bool:
    """Whether another scan may be kept."""
    return scans.limit(capacity).count() < capacity


def repository_name(root: Column, archive: Column) -> Column:
    """The stripped root folder, else the archive's name without its endings, else `repo`."""
    stem = F.regexp_replace(F.regexp_replace(archive, "^.*/", ""), r"(?i)\.(zip|tar|tgz|tar\.(gz|bz2|xz))$", "")
    return F.coalesce(F.nullif(F.trim(root), F.lit("")), F.nullif(F.trim(stem), F.lit("")), F.lit("repo"))


CARD = ["id", "file", "line_start", "algorithm", "operation", "service", "confidence_level", "quantum_vulnerable", "band", "qmp", "rank"]


def cards(ranked: DataFrame) -> DataFrame:
    """What a list shows of each finding."""
    return ranked.select(*CARD)
