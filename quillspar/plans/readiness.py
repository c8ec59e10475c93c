"""Readiness: categories of evidence, blockers, the level that the first matching rule gives, libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.functions.scoring import BROKEN_HASHES, WEAK_CIPHERS
from quillspar.operators.aggregates import first_seen_mode
from quillspar.operators.matching import small
from quillspar.operators.order import top_per_group

# Rules that find old protocol versions and weak suites.
OLD_PROTOCOL_RULES = ("CFG-NGINX-TLS-001", "CFG-STRUCT-TLS-001", "CFG-STRUCT-TLS-002")
WEAK_SUITE_RULES = ("CFG-NGINX-CIPHER-004",)
#: Levels in the order in which they are tried.
LEVELS = ("not_ready_blockers", "in_transition", "not_ready", "no_vulnerable_usage_detected")


def classified(findings: DataFrame) -> DataFrame:
    """Live findings with `classes`, the kinds of evidence that each is."""
    f = F.col
    certificate = f("rule_id").startswith("CFG-X509")
    vulnerable = f("quantum_vulnerable")
    decided = F.coalesce(f("role").isin("key-establishment", "signature"), F.lit(False))
    produced = ~T.non_production(f("file"), f("test_path"))
    agreement = vulnerable & F.coalesce(f("role") == "key-establishment", F.lit(False))
    tests = {
        "key_establishment": agreement,
        "hndl": agreement & F.coalesce(f("hndl_severity") == "elevated", F.lit(False)),
        "signatures": vulnerable & F.coalesce(f("role") == "signature", F.lit(False)) & ~certificate,
        "certificates": (vulnerable & certificate) | (f("rule_id") == "CFG-X509-002"),
        "sha1_certificates": f("rule_id") == "CFG-X509-002",
        "undetermined": vulnerable & ~decided & ~certificate,
        "old_protocols": f("rule_id").isin(*OLD_PROTOCOL_RULES),
        "weak_suites": f("rule_id").isin(*WEAK_SUITE_RULES),
        "legacy_symmetric": f("algorithm").isin(*WEAK_CIPHERS),
        "hashes": f("algorithm").isin(*BROKEN_HASHES) & (f("rule_id") != "CFG-X509-002"),
        "symmetric_strength": (f("algorithm") == "AES") & (f("primitive") == "symmetric") & F.coalesce(f("key_size") == 128, F.lit(False)),
        "pqc": f("already_pqc"),
        "pqc_production": f("already_pqc") & produced,
    }
    return findings.withColumn("classes", F.filter(F.array(*[F.when(test, name) for name, test in tests.items()]), lambda c: c.isNotNull()))


def categories(findings: DataFrame) -> DataFrame:
    """(category, n, files, services) of each kind of evidence that occurs."""
    rows = classified(findings).select(F.explode("classes").alias("category"), "file", "service")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.count_distinct("service").alias("services"))


def category_evidence(findings: DataFrame, names: tuple[str, ...] | None = None, shown: int | None = None) -> DataFrame:
    """(category, place, id, file, line_start, algorithm, band, service, rule_id, evidence, evidence_total): the first findings of each category by file, line and id, and how many there are.

    Each partition passes on the first rows of a category only, so that no
    category is sorted in one task; names: those of categories, or all.
    """
    rows = classified(findings).withColumn("category", F.explode("classes"))
    if names is not None:
        rows = rows.where(F.col("category").isin(*names))
    totals = rows.groupBy("category").agg(F.count("*").alias("evidence_total"))
    first = top_per_group(rows, ["category"], [F.col("file"), F.col("line_start"), F.col("id")], shown or SHOWN)
    return first.join(totals, "category").select("category", "place", "id", "file", "line_start", "algorithm", "band", "service", "rule_id", "evidence", "evidence_total")


def blocker_evidence(findings: DataFrame, shown: int | None = None) -> DataFrame:
    """category_evidence of the categories that stand in the way."""
    return category_evidence(findings, BLOCKERS, shown)


def algorithms(findings: DataFrame) -> DataFrame:
    return classified(findings).select(F.explode("classes").alias("category"), "algorithm").groupBy("category", "algorithm").agg(F.count("*").alias("n"))


def level(findings: DataFrame) -> DataFrame:
    """One row: the level, from which kinds of evidence there are at all."""
    return levels(findings, [])


def levels(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level): the same for each group, a service for instance."""
    rows = classified(findings)
    has = lambda *names: F.coalesce(F.bool_or(F.arrays_overlap("classes", F.array(*map(F.lit, names)))), F.lit(False))
    seen = rows.groupBy(*keys).agg(
        has("hndl", "legacy_symmetric", "old_protocols", "weak_suites", "sha1_certificates").alias("blocked"),
        F.coalesce(F.bool_or("quantum_vulnerable"), F.lit(False)).alias("vulnerable"),
        has("pqc_production").alias("started"),
    )
    return seen.select(*keys, F.when(F.col("blocked"), LEVELS[0]).when(F.col("vulnerable") & F.col("started"), LEVELS[1]).when(F.col("vulnerable"), LEVELS[2]).otherwise(LEVELS[3]).alias("level"))


def main_algorithm(findings: DataFrame) -> DataFrame:
    """(category, algorithm, n): the most frequent of each kind, among equals the one with the best rank."""
    rows = classified(findings).select(F.explode("classes").alias("category"), "algorithm", "rank")
    return first_seen_mode(rows, ["category"], "algorithm", "rank")


def libraries(findings: DataFrame, imports: DataFrame) -> DataFrame:
    """(library, findings, vulnerable, files, importing_files): of those that are used or imported."""
    used = findings.where("library IS NOT NULL").groupBy("library").agg(F.count("*").alias("findings"), F.count_if("quantum_vulnerable").alias("vulnerable"), F.count_distinct("file").alias("files"))
    named = imports.where("crypto_library IS NOT NULL").groupBy(F.col("crypto_library").alias("library")).agg(F.count_distinct("file").alias("importing_files"))
    return used.join(named, "library", "full_outer").fillna(0, ["findings", "vulnerable", "files", "importing_files"])


#: (recommendation, priority, kinds of evidence that call for it, what to do), in the order in which they are given.
RECOMMENDATIONS = (
    ("hybrid_key_establishment", 1, ("hndl",), "Start where recorded traffic stays secret for long: add a post-quantum KEM beside the classical exchange"),
    ("remove_disallowed", 1, ("legacy_symmetric", "old_protocols", "weak_suites", "sha1_certificates"), "Retire ciphers, protocols and certificates that are no longer allowed"),
    ("plan_key_establishment", 2, ("key_establishment_rest",), "Schedule a post-quantum KEM for all other key exchanges"),
    ("inventory_verifiers", 2, ("signatures", "certificates"), "List who checks signatures, then schedule post-quantum ones"),
    ("determine_roles", 3, ("undetermined",), "Find out what public keys without a visible use are for"),
    ("central_interface", 3, ("hub",), "Put cryptography behind the files that others import already"),
    ("replace_hashes", 3, ("hashes",), "Move off MD5 and SHA-1"),
    ("longer_keys", 4, ("symmetric_strength",), "Use 256-bit keys for data that lives long"),
    ("pqc_to_production", 4, ("pqc_trial",), "Bring post-quantum code from trials into production paths"),
    ("verify_libraries", 4, ("library",), "Check what the installed library versions support"),
)
BLOCKERS = ("hndl", "legacy_symmetric", "old_protocols", "weak_suites", "sha1_certificates")
#: Evidence rows that a recommendation shows; its total is given beside them.
SHOWN = 25


def blockers(findings: DataFrame) -> DataFrame:
    """The categories that stand in the way, with their counts."""
    return categories(findings).where(F.col("category").isin(*BLOCKERS)).orderBy("category")


def recommendations(findings: DataFrame, hub_files: DataFrame | None = None) -> DataFrame:
    """(priority, ord, recommendation, title, place, id, file, line_start, algorithm, service, evidence_total): called-for recommendations with their first evidence.

    Each finding counts once in a recommendation. Remaining key establishment
    is what is neither at risk by long lifetimes nor outside production;
    trials are post-quantum findings where none is in production; hub_files
    (plans.graph.hubs) are files that others import. Recommendations of one
    priority keep the order of their table (ord).
    """
    rows = classified(findings)
    has = lambda name: F.array_contains("classes", name)
    rest = has("key_establishment") & ~has("hndl") & ~T.non_production(F.col("file"), F.col("test_path"))
    started = rows.agg(F.coalesce(F.bool_or(has("pqc_production")), F.lit(False)).alias("_started"))
    rows = rows.crossJoin(F.broadcast(started))  # one row
    if hub_files is not None:
        rows = rows.join(hub_files.select("file").distinct().withColumn("_hub", F.lit(True)), "file", "left")
    else:
        rows = rows.withColumn("_hub", F.lit(False))
    more = F.array(F.when(rest, F.lit("key_establishment_rest")), F.when(F.coalesce("_hub", F.lit(False)) & F.col("quantum_vulnerable"), F.lit("hub")), F.when(has("pqc") & ~F.col("_started"), F.lit("pqc_trial")), F.when(F.col("library").isNotNull(), F.lit("library")))
    rows = rows.withColumn("classes", F.concat("classes", F.filter(more, lambda c: c.isNotNull()))).drop("_hub", "_started")
    table = findings.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(RECOMMENDATIONS)], "ord int, recommendation string, priority int, wanted array<string>, title string")
    called = rows.join(F.broadcast(table), F.arrays_overlap("classes", "wanted"))  # ten rows
    totals = called.groupBy("recommendation").agg(F.count("*").alias("evidence_total"))
    shown = top_per_group(called, ["recommendation"], [F.col("file"), F.col("line_start"), F.col("id")], SHOWN)
    return shown.join(totals, "recommendation").select("priority", "ord", "recommendation", "title", "place", "id", "file", "line_start", "algorithm", "service", "evidence_total").orderBy("priority", "ord", "place")


#: Libraries of which support for post-quantum algorithms is known, as (library, support); others are `not verified`.
SUPPORT = (("cryptography", "by OpenSSL 3.5"), ("liboqs", "yes"), ("bouncycastle", "yes"), ("openssl", "from 3.5"))


def library_support(used: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """libraries(...) with `support` from the table, null where it isn't known, and `status`."""
    known = support if support is not None else used.sparkSession.createDataFrame(SUPPORT, "library string, support string")
    return used.join(small(known), "library", "left").withColumn("status", F.when(F.col("support").isNull(), "not verified").otherwise("known"))


def overview(findings: DataFrame) -> DataFrame:
    """One row: the level, the number of blockers and the first recommendation."""
    first = recommendations(findings).agg(F.min_by("recommendation", "ord").alias("first_recommendation"))
    return level(findings).crossJoin(blockers(findings).agg(F.count("*").alias("blockers"))).crossJoin(first)  # one row each
