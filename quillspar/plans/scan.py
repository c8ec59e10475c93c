"""A whole scan: every extractor's matches, united into findings with scores and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import scoring
from quillspar.functions import text as T
from quillspar.operators.order import numbered
from quillspar.plans import findings as plan
from quillspar.session import Workspace
from quillspar.sources import certificates, code, files, imports, metadata, scopes, structured


def matches(scannable: DataFrame, rules: DataFrame, entries: DataFrame, mentions: DataFrame | None = None, refinements: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Matches of all extractors over files(path, kind, text): directives, calls, structured values, code patterns, certificates, mentions."""
    parts = [plan.as_matches(plan.directive_matches(scannable, rules, entries)), plan.call_matches(imports.read_calls(scannable), rules, entries)]
    parts.append(plan.as_matches(structured.structured_matches(structured.read_values(scannable), rules, entries)))
    hits = code.regex_matches(scannable, rules)
    # A pattern's value takes the first entry that fits it; a rule without entries says all itself.
    known = plan.first_of_rule(hits.select("rule_id", "value").distinct(), entries)
    said = rules.select("rule_id", "library", "api", *[F.col(c).alias(f"rule_{c}") for c in ("algorithm", "primitive", "operation", "confidence")])
    rows = hits.join(known, ["rule_id", "value"], "left").join(said, "rule_id").join(entries.select("rule_id").distinct().withColumn("listed", F.lit(True)), "rule_id", "left").where("algorithm IS NOT NULL OR listed IS NULL")
    for column in ("algorithm", "primitive", "operation", "confidence"):
        rows = rows.withColumn(column, F.coalesce(column, f"rule_{column}"))
    if refinements is not None:
        better = code.refined(hits, refinements).select("file", "at", "rule_id", F.col("operation").alias("_refined"))
        rows = rows.join(better, ["file", "at", "rule_id"], "left").withColumn("operation", F.coalesce("_refined", "operation"))
    parts.append(plan.as_matches(rows.withColumn("evidence", T.evidence(F.col("call")))))
    if as_of is not None:
        parts.append(plan.as_matches(certificates.certificate_matches(certificates.read_certificates(scannable), as_of)))
    if mentions is not None:
        said_in = code.comments(scannable)
        found = plan.first_mentions(said_in, mentions).withColumn("evidence", T.evidence(F.col("text"))).join(mentions.groupBy("algorithm").agg(F.min_by("primitive", "ord").alias("primitive")), "algorithm")
        found = found.withColumns({"rule_id": F.lit("GEN-COMMENT-001"), "operation": F.lit("unknown"), "confidence": F.lit(plan.COMMENT_CONFIDENCE)})
        parts.append(plan.as_matches(found, comment_only=True))
    return reduce(DataFrame.unionByName, parts)


def scan(tree: DataFrame, rules: DataFrame, entries: DataFrame, repository: str | Column, scan_id: str = "scan", **options) -> DataFrame:
    """Scored findings with ranks of a tree(path, size, content): read, redacted, matched, placed in services, scored.

    A tree of many scans has their scan_id as a column too: paths are scoped by
    it for the whole way, services and ids are each scan's own, and ranks order
    all findings (inside a scan by its own order).
    """
    many = "scan_id" in tree.columns
    # Written once: each extractor reads the kept text, and none of them reads or redacts the tree again.
    assessed = Workspace(tree.sparkSession).write(files.assessed(scopes.scoped(tree).drop("scan_id") if many else tree), "files")
    readable = assessed.where("skip IS NULL").drop("skip")
    services = metadata.read_services(assessed.select("path", "size", "text"))
    rows = plan.as_findings(matches(readable, rules, entries, **options), services, repository, scan_id)
    scored = scoring.scored(rows, services.withColumn("scan_id", scopes.scan_of(F.col("metadata_file"))) if many else services).withColumn("suppressed", F.lit(False))
    return numbered(scored, [*([F.col("scan_id")] if many else []), *scoring.priority_order()])
