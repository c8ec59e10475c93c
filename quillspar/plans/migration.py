"""Migration candidates: a rule for each finding, tracks, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions.scoring import BROKEN_HASHES, WEAK_CIPHERS
from quillspar.operators.aggregates import first_seen_union

KEM, SIGNATURE = "ML-KEM (FIPS 203)", "ML-DSA (FIPS 204) or SLH-DSA (FIPS 205)"
# Fixed values: (rule, what is there now, direction; none where no post-quantum algorithm takes its place).
RULES = (
    ("R-01", "RSA for key establishment", KEM),
    ("R-02", "DH for key establishment", KEM),
    ("R-03", "ECDH (incl. X25519/X448) for key establishment", KEM),
    ("R-04", "RSA signatures", SIGNATURE),
    ("R-05", "ECDSA signatures", SIGNATURE),
    ("R-06", "EdDSA (Ed25519/Ed448) signatures", SIGNATURE),
    ("R-07", "DSA signatures", SIGNATURE),
    ("R-08", "AES", None),
    ("R-09", "SHA-1 / MD5", None),
    ("R-10", "SHA-2 / SHA-3", None),
    ("R-11", "HMAC", None),
    ("R-12", "Unknown / unclassified crypto", None),
    ("R-13", "Legacy symmetric cipher (3DES / DES / RC4 / Blowfish)", None),
)
#: Operations with a change of their own in each track; others go to `other`.
TRACK_OPERATIONS = {
    "kem": ("key_generation", "key_agreement", "encryption", "decryption", "config"),
    "sig": ("key_generation", "signature", "verification", "config"),
    "hash": ("hashing",),
    "legacy": ("encryption", "decryption", "key_generation"),
    "aes128": ("encryption", "decryption", "key_generation"),
}


# Fixed values: (target, what it is for, standard, references), in the order in which targets are offered.
TARGETS = (
    ("X25519MLKEM768", "kem", "FIPS 203 + draft-ietf-tls-ecdhe-mlkem", ("FIPS203", "TLS-HYBRID", "SP800-227")),
    ("ML-KEM-768", "kem", "FIPS 203", ("FIPS203", "SP800-227")),
    ("ML-KEM-1024", "kem", "FIPS 203", ("FIPS203", "SP800-227")),
    ("ML-KEM-512", "kem", "FIPS 203", ("FIPS203", "SP800-227")),
    ("ML-DSA-65", "sig", "FIPS 204", ("FIPS204",)),
    ("ML-DSA-44", "sig", "FIPS 204", ("FIPS204",)),
    ("ML-DSA-87", "sig", "FIPS 204", ("FIPS204",)),
    ("SLH-DSA-SHA2-128s", "sig", "FIPS 205", ("FIPS205",)),
    ("SLH-DSA-SHA2-128f", "sig", "FIPS 205", ("FIPS205",)),
    ("SHA-256", "hash", "FIPS 180-4", ("SP800-131A",)),
    ("SHA3-256", "hash", "FIPS 202", ("SP800-131A",)),
    ("AES-256-GCM", "legacy", "FIPS 197 + SP 800-38D", ("SP800-131A",)),
    ("AES-256-GCM", "aes128", "FIPS 197 + SP 800-38D", ("SP800-131A",)),
)
# References of what is known about libraries.
LIBRARY_REFERENCES = (
    ("cryptography", ("PYCA-CHANGELOG",)),
    ("java.security", ("JEP496", "JEP497")),
    ("javax.crypto", ("JEP496",)),
    ("bouncycastle", ("BC-1.79",)),
    ("node:crypto", ("NODE-24.7",)),
    ("webcrypto", ("NODE-24.7",)),
    ("nginx", ("OPENSSL-3.5", "TLS-HYBRID")),
    ("openssh", ("OPENSSH-RELEASES",)),
)


def rule_id(algorithm: Column, primitive: Column, role: Column) -> Column:
    agreement = F.when(algorithm == "DH", "R-02").when(algorithm == "RSA", "R-01").otherwise("R-03")
    signing = F.when(algorithm == "RSA", "R-04").when(algorithm == "EdDSA", "R-06").when(algorithm == "DSA", "R-07").otherwise("R-05")
    public = F.when(role == "key-establishment", agreement).when(role == "signature", signing).otherwise("R-12")
    return (
        F.when(primitive == "public-key", public)
        .when(primitive == "symmetric", F.when(algorithm.isin(*WEAK_CIPHERS), "R-13").otherwise("R-08"))
        .when(primitive == "hash", F.when(algorithm.isin(*BROKEN_HASHES), "R-09").otherwise("R-10"))
        .when(primitive == "mac", "R-11")
        .otherwise("R-12")
    )


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "migration_rule string, current string, standard string")


def caveats(f) -> Column:
    """Which settings need a word of their own: certificates, tokens, TLS."""
    x509 = f("rule_id").startswith("CFG-X509")
    tokens = ~x509 & (f("role") == "signature") & ((f("context") == "authentication") | f("rule_id").contains("JWT") | f("rule_id").contains("JOSE"))
    tls = (f("role") == "key-establishment") & ((f("context") == "tls-termination") | f("rule_id").startswith("CFG-"))
    return F.filter(F.array(F.when(x509, "x509"), F.when(tokens, "jose"), F.when(tls, "tls")), lambda c: c.isNotNull())


def planned(scored: DataFrame) -> DataFrame:
    """Scored findings with migration_rule, current, direction, standard, human_review, complexity and caveats; comment mentions have none."""
    f = F.col
    settled = f("already_pqc") | (f("primitive") == "protocol")
    rows = scored.withColumn("migration_rule", F.when(~f("comment_only") & ~settled, rule_id(f("algorithm"), f("primitive"), f("role"))))
    rows = rows.join(F.broadcast(rules_table(scored.sparkSession)), "migration_rule", "left")  # thirteen rows
    direction = (
        F.when(f("comment_only"), None)
        .when(f("already_pqc"), "No migration needed")
        .when(f("primitive") == "protocol", "No PQC mapping: classical hygiene")
        .when(f("migration_rule") == "R-12", "Manual review: no candidate emitted")
        .otherwise(F.coalesce("standard", F.lit("No PQC migration required")))
    )
    review = F.when(~f("comment_only"), f("migration_rule").isNotNull() & (f("standard").isNotNull() | (f("migration_rule") == "R-12")))
    return rows.withColumns({"direction": direction, "human_review": F.coalesce(review, F.lit(False)), "complexity": F.when(f("already_pqc"), 0.0).otherwise(f("mc")), "caveats": F.when(f("standard").isNotNull(), caveats(f)).otherwise(F.array().cast("array<string>"))})


def planner_rows(ranked: DataFrame) -> DataFrame:
    """Findings to plan for, in rank order: no suppressed, comment or test-path rows."""
    return planned(ranked).where("NOT suppressed AND NOT comment_only AND NOT test_path").orderBy("rank")


def track(f) -> Column:
    public = F.when(f("role") == "key-establishment", "kem").when(f("role") == "signature", "sig").otherwise("unclear")
    return (
        F.when(f("already_pqc"), "no_action")
        .when(f("quantum_vulnerable"), public)
        .when(f("algorithm").isin(*BROKEN_HASHES), "hash")
        .when(f("algorithm").isin(*WEAK_CIPHERS), "legacy")
        .when((f("algorithm") == "AES") & F.coalesce(f("key_size") == 128, F.lit(False)), "aes128")
        .otherwise("no_action")
    )


def sources_of_rules(planned: DataFrame) -> DataFrame:
    """(migration_rule, track, findings, targets, references, caveats): what each rule's findings may become in each track, and where to read about it.

    targets stand in the order in which they are offered, references in that of
    the targets and then of the libraries by name, caveats as the findings
    (file, line, id) bring them up; each stands once.
    """
    spark = planned.sparkSession
    targets = spark.createDataFrame([(i, *t) for i, t in enumerate(TARGETS)], "ord int, target string, track string, standard string, refs array<string>")
    libraries = spark.createDataFrame(LIBRARY_REFERENCES, "library string, refs array<string>")
    rows = planned.where("migration_rule IS NOT NULL").withColumn("track", track(F.col))
    keys = ["migration_rule", "track"]
    used = rows.groupBy(*keys, "library").agg(F.count("*").alias("n"))
    counts = used.groupBy(*keys).agg(F.sum("n").alias("findings"))
    offered = counts.select(*keys).join(F.broadcast(targets), "track")  # thirteen rows
    seen = offered.select(*keys, F.lit(0).alias("part"), F.format_string("%04d", "ord").alias("by"), "refs")
    seen = seen.unionByName(used.join(F.broadcast(libraries), "library").select(*keys, F.lit(1).alias("part"), F.col("library").alias("by"), "refs"))
    found = counts
    for name, union in (
        ("targets", first_seen_union(offered.withColumn("targets", F.array("target")), keys, "targets", ["ord"])),
        ("references", first_seen_union(seen, keys, "refs", ["part", "by"], "references")),
        ("caveats", first_seen_union(rows, keys, "caveats", ["file", "line_start", "id"])),
    ):
        found = found.join(union, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return found


def changes(scored: DataFrame) -> DataFrame:
    """(track, change, findings, files, services): call sites by track and operation, leftovers as `other`."""
    rows = scored.withColumn("track", track(F.col))
    covered = F.lit(False)
    for name, operations in TRACK_OPERATIONS.items():
        covered = covered | ((F.col("track") == name) & F.col("operation").isin(*operations))
    rows = rows.withColumn("change", F.when(covered, F.col("operation")).otherwise("other"))
    return rows.groupBy("track", "change").agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files"), F.count_distinct("service").alias("services"))


def classical_sizes(planned: DataFrame) -> DataFrame:
    """(algorithm, measure, bytes): how long the public values of what is there now are, as far as algorithm and key sizes tell.

    Fixed values: an uncompressed P-256 point has 65 bytes, an Ed25519 or
    X25519 key 32, either signature 64; RSA and DH values are as long as their
    modulus, all sizes that occur are listed in order.
    """
    f = F.col
    bits = planned.where("quantum_vulnerable").groupBy("algorithm").agg(F.array_sort(F.collect_set(F.when(f("key_size") > 0, f("key_size")))).alias("bits"))
    modulus = F.array_join(F.transform("bits", lambda b: F.floor(b / 8).cast("string")), " / ")
    first = F.floor(F.try_element_at("bits", F.lit(1)) / 8).cast("string")
    unknown = F.lit("not determined")
    row = lambda measure, size: F.struct(F.lit(measure).alias("measure"), size.alias("bytes"))
    rows = (
        F.when((f("algorithm") == "RSA") & (F.size("bits") > 0), F.array(row("modulus", modulus), row("signature or ciphertext", modulus)))
        .when(f("algorithm") == "RSA", F.array(row("modulus", unknown)))
        .when(f("algorithm").isin("ECDSA", "EC"), F.array(row("public key", F.lit("65")), row("signature", F.lit("64"))))
        .when(f("algorithm") == "EdDSA", F.array(row("public key", F.lit("32")), row("signature", F.lit("64"))))
        .when(f("algorithm").isin("ECDH", "DH/ECDH"), F.array(row("public key share", F.lit("32 / 65"))))
        .when(f("algorithm") == "DH", F.array(row("public key share", F.coalesce(first, unknown))))
    )
    return bits.select("algorithm", F.explode(rows).alias("r")).select("algorithm", "r.measure", "r.bytes")
