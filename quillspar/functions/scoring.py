"""Migration priority of findings as column expressions.

priority = clamp(floor(2 QE + 2 DS + 1.5 IE + 1.5 BC - 1.5 MC + 0.5), 0, 20), with bands and caps on it.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factor tables, midpoints, weights, band edges and the groups of algorithms that rules name.
SENSITIVITY = {"public": 0.0, "internal": 1.0, "confidential": 2.0, "sensitive": 3.0, "highly-sensitive": 4.0, "regulated": 4.0}
CRITICALITY = {"low": 0.0, "medium": 1.0, "high": 2.0, "critical": 3.0}
MIDPOINT = {"DS": 2.0, "IE": 1.5, "BC": 1.5}
BANDS = ("Informational", "Review", "High", "Critical")
BAND_TOPS = (3, 9, 14)
AGREEMENT_ALGORITHMS = ("ECDH", "DH", "DH/ECDH")
SIGNATURE_ALGORITHMS = ("ECDSA", "EdDSA", "DSA", "RSA/ECDSA")
HYGIENE_RULES = ("CFG-NGINX-TLS-001", "CFG-NGINX-CIPHER-004", "CFG-STRUCT-TLS-001", "CFG-STRUCT-TLS-002")
BROKEN_HASHES = ("SHA-1", "MD5")
WEAK_CIPHERS = ("3DES", "DES", "RC4", "Blowfish")


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def role(algorithm: Column, primitive: Column, operation: Column, context: Column) -> Column:
    """`key-establishment`, `signature` or `unclear` for public-key uses; null for others."""
    rsa = (
        F.when(operation.isin("encryption", "decryption"), "key-establishment")
        .when(operation.isin("signature", "verification"), "signature")
        .when(context.isin("authentication", "code-signing", "integrity"), "signature")
        .when(context.isin("key-establishment", "data-protection"), "key-establishment")
        .otherwise("unclear")
    )
    return F.when(
        primitive == "public-key",
        F.when(algorithm.isin(*AGREEMENT_ALGORITHMS) | (operation == "key_agreement"), "key-establishment").when(algorithm.isin(*SIGNATURE_ALGORITHMS), "signature").when(algorithm == "RSA", rsa).otherwise("unclear"),
    )


def exposure(f) -> Column:
    """QE, 0 to 4, from finding columns and the role."""
    public = F.when(f("confidence_level") != "high", 2.0).when(f("role") == "signature", 3.0).otherwise(4.0)
    hygiene = f("rule_id").isin(*HYGIENE_RULES) | f("algorithm").isin(*BROKEN_HASHES, *WEAK_CIPHERS)
    grover = (f("primitive") == "symmetric") & F.coalesce(f("key_size") == 128, F.lit(False))
    return F.when(f("already_pqc"), 0.0).when(f("primitive") == "public-key", public).when(hygiene | grover, 1.0).otherwise(0.0)


def complexity(f) -> Column:
    """MC, 0 to 3."""
    signing = F.when(f("context") == "code-signing", 3.0).when(f("context") == "authentication", 2.0).otherwise(1.0)
    return (
        F.when(f("already_pqc") | (f("primitive") == "protocol"), 0.0)
        .when(f("rule_id").startswith("CFG-X509"), 3.0)
        .when(f("primitive") != "public-key", 1.0)
        .when(f("role") == "key-establishment", 2.0)
        .when(f("role") == "signature", signing)
        .otherwise(1.0)
    )


def priority(qe: Column, ds: Column, ie: Column, bc: Column, mc: Column) -> tuple[Column, Column]:
    """(raw, clamped whole number)."""
    raw = qe * 2 + ds * 2 + ie * 1.5 + bc * 1.5 - mc * 1.5
    return raw, F.greatest(F.lit(0), F.least(F.lit(20), F.floor(raw + 0.5))).cast("int")


def band(points: Column) -> Column:
    return F.when(points <= BAND_TOPS[0], BANDS[0]).when(points <= BAND_TOPS[1], BANDS[1]).when(points <= BAND_TOPS[2], BANDS[2]).otherwise(BANDS[3])


def capped(name: Column, qe: Column, high_confidence: Column) -> Column:
    """No exposure is informational; hygiene and unsure findings are reviewed at most."""
    above = name.isin(*BANDS[2:])
    return F.when(qe == 0, BANDS[0]).when(above & ((qe == 1) | ~high_confidence), BANDS[1]).otherwise(name)


def band_rank(name: Column) -> Column:
    """0 for the lowest band; null where there is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, BANDS)), name), F.lit(0)) - 1


def scored(findings: DataFrame, services: DataFrame) -> DataFrame:
    """findings with role, factors, raw, qmp, band, cap, hndl, hndl_severity and badges; all null for comment mentions.

    Of several descriptions of one service the last by file counts; where both
    tables have a scan_id, a service is one of its scan. Missing or unknown metadata take
    midpoints and leave badges; harvest-now-decrypt-later is then not assessed.
    """
    scans = ["scan_id"] if "scan_id" in services.columns and "scan_id" in findings.columns else []
    meta = services.groupBy(*scans, F.col("service").alias("_service")).agg(F.max_by(F.struct("data_classification", "business_criticality", "internet_exposed", "data_lifetime_years"), "metadata_file").alias("_m")).select(*[F.col(c).alias(f"_{c}") for c in scans], "_service", "_m.*")
    same = [findings["service"] == meta["_service"], *[findings[c] == meta[f"_{c}"] for c in scans]]
    x = findings.join(meta, same, "left").drop("_service", *[f"_{c}" for c in scans])
    f = F.col
    x = x.withColumn("role", role(f("algorithm"), f("primitive"), f("operation"), f("context")))
    known_ds, known_bc = _lookup(SENSITIVITY, f("data_classification")), _lookup(CRITICALITY, f("business_criticality"))
    exposed = F.when(f("internet_exposed"), 3.0).when(~f("internet_exposed"), 0.0)
    x = x.withColumns({"qe": exposure(f), "mc": complexity(f), "ds": F.coalesce(known_ds, F.lit(MIDPOINT["DS"])), "bc": F.coalesce(known_bc, F.lit(MIDPOINT["BC"])), "ie": F.coalesce(exposed, F.lit(MIDPOINT["IE"]))})
    raw, points = priority(f("qe"), f("ds"), f("ie"), f("bc"), f("mc"))
    x = x.withColumns({"raw": raw, "qmp": points, "band_uncapped": band(points)})
    x = x.withColumn("band", capped(f("band_uncapped"), f("qe"), f("confidence_level") == "high"))
    agreement = F.coalesce(f("role") == "key-establishment", F.lit(False))
    assessed = known_ds.isNotNull() & exposed.isNotNull() & f("data_lifetime_years").isNotNull()
    at_risk = agreement & assessed & (f("ds") >= 3) & (f("ie") >= 2) & (f("data_lifetime_years") >= 5)
    x = x.withColumn("hndl", F.coalesce(at_risk, F.lit(False)))
    x = x.withColumn("hndl_severity", F.when(f("hndl"), F.when(f("data_lifetime_years") >= 10, "elevated").otherwise("noted")))
    grover = (f("primitive") == "symmetric") & ~f("algorithm").isin(*WEAK_CIPHERS)
    # Texts of badges.
    badges = F.array(
        F.when(known_ds.isNull(), "metadata missing: data_classification"),
        F.when(known_bc.isNull(), "metadata missing: business_criticality"),
        F.when(exposed.isNull(), "metadata missing: internet_exposed"),
        F.when(agreement & f("data_lifetime_years").isNull(), "metadata missing: data_lifetime_years"),
        F.when(agreement & ~assessed, "HNDL not assessed: metadata missing"),
        F.when(f("qe") == 1, F.when(grover, "symmetric key size").otherwise("classical hygiene")),
        F.when(f("test_path"), "test/dev path"),
    )
    x = x.withColumn("badges", F.array_sort(F.array_distinct(F.filter(badges, lambda b: b.isNotNull()))))
    x = x.withColumn("cap", F.when(f("band") != f("band_uncapped"), F.when(f("qe") == 0, "no exposure").when(f("qe") == 1, F.when(grover, "key size margin").otherwise("classical hygiene")).otherwise("low confidence")))
    out = ["role", "qe", "ds", "ie", "bc", "mc", "raw", "qmp", "band", "band_uncapped", "cap", "hndl", "hndl_severity", "badges"]
    x = x.withColumns({c: F.when(~f("comment_only"), f(c)) for c in out if c != "hndl"}).withColumn("hndl", f("hndl") & ~f("comment_only"))
    return x.select(*findings.columns, *out)


def priority_order() -> list[Column]:
    """Scored findings first, worst band, most points, raw score, at-risk data, exposure; then the id as text."""
    f = F.col
    down = lambda c: F.coalesce(c, F.lit(0)).desc()
    return [f("band").isNull().asc(), down(band_rank(f("band"))), down(f("qmp")), down(f("raw")), f("hndl").desc(), down(f("qe")), f("id").asc()]
