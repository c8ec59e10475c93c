"""From files and rules to findings: directive and mention scans, deduplication, ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillspar.functions import text as T
from quillspar.operators.matching import glob_key, glob_matches, longest_prefix, rule_rows, small
from quillspar.operators.order import numbered
from quillspar.session import Workspace
from quillspar.sources.files import lines
from quillspar.sources.scopes import bare, scan_of

#: What makes two matches one finding.
IDENTITY = ["file", "line_start", "line_end", "rule_id", "algorithm", "operation", "evidence"]
COMMENT_CONFIDENCE = 0.45
#: Entries up to this count are tried as literal predicates.
LITERAL_ENTRIES = 100
ID = "CRYPTO-%03d"


def with_rules(rows: DataFrame, pack: list[Row], fits: Callable[[Row], Column], gives: Callable[[Row], Column]) -> DataFrame:
    """rows once for each rule that fits, with the struct that it gives as `rule`.

    Each rule's test is a literal predicate, compiled once, on rows that are
    read once; a join with the rule table would take its pattern from a column
    and multiply the rows before they are tested.
    """
    if not pack:
        return rows.limit(0).withColumn("rule", F.lit(None).cast("struct<rule_id: string, library: string, api: string, values: array<string>>"))
    hits = F.array(*[F.when(fits(r), gives(r)) for r in pack])
    return rows.withColumn("rule", F.explode(F.filter(hits, lambda h: h.isNotNull())))


def directive_matches(files: DataFrame, rules: DataFrame, entries: DataFrame, counted: bool = False) -> DataFrame:
    """(file, line, rule_id, value, algorithm, ...) of configuration lines.

    A line without its comment is tested by each rule's pattern, whose first
    group is split into values, and a value takes the first entry whose pattern
    fits. Files that no rule's file_pattern wants are dropped before lines are
    made. counted: a value that a line repeats is one row, with n, how often a
    rule finds it there; it is counted inside the line, without a shuffle.
    """
    pack = rule_rows(rules.where("match_type = 'directive'").select("rule_id", "pattern", "file_pattern", "split", "skip_prefixes", "library", "api"))
    wanted = lambda r: bare(F.col("path")).rlike(r["file_pattern"]) if r["file_pattern"] else F.lit(True)
    rows = lines(files.where(reduce(or_, map(wanted, pack), F.lit(False))).select("path", "text"))
    rows = rows.where(F.length("text") <= T.LONGEST_LINE).withColumn("text", F.regexp_replace("text", r"(^|\s)#.*$", "$1"))

    def given(r: Row) -> Column:
        value = F.regexp_extract("text", r["pattern"], 1)
        values = F.transform(F.split(value, r["split"]) if r["split"] else F.array(value), lambda v: F.btrim(v, F.lit("'\";+^ \t")))
        kept = F.filter(values, lambda v: reduce(and_, [~v.startswith(p) for p in r["skip_prefixes"] or []], v != ""))
        return F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["library"]).cast("string").alias("library"), F.lit(r["api"]).cast("string").alias("api"), kept.alias("values"))

    hits = with_rules(rows, pack, lambda r: F.col("text").rlike(r["pattern"]) & wanted(r), given)
    evidence = T.evidence(F.col("text")).alias("evidence")
    if counted:
        once = F.array_distinct("rule.values")
        # Values are compared with each other only on lines that repeat one.
        repeats = F.when(F.size(once) < F.size("rule.values"), F.transform(once, lambda v: F.size("rule.values") - F.size(F.array_remove("rule.values", v))))
        pairs = F.arrays_zip(once.alias("value"), F.coalesce(repeats, F.array_repeat(F.lit(1), F.size(once))).alias("n"))
        picked = hits.select("path", "line", "rule.rule_id", F.inline(pairs), "rule.library", "rule.api", evidence)
    else:
        picked = hits.select("path", "line", "rule.rule_id", F.explode("rule.values").alias("value"), "rule.library", "rule.api", evidence)
    return with_first_of_rule(picked, entries).withColumnRenamed("path", "file")


def with_first_of_rule(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows(rule_id, value, ...) with the first entry of their rule whose pattern matches; no row where none does.

    Up to LITERAL_ENTRIES entries are literal predicates in their order, which
    each row passes where it is made: rows are neither sorted nor shuffled, and
    a value that very many rows share doesn't bring them into one task. More
    entries are tried once for each distinct value, which rows are joined with.
    """
    known = entries.withColumn("_pattern", glob_key("pattern")).limit(LITERAL_ENTRIES + 1).collect()
    rest, take = [c for c in rows.columns if c not in ("rule_id", "value")], [c for c in entries.columns if c not in ("rule_id", "ord", "pattern")]
    if len(known) > LITERAL_ENTRIES:
        # Sorted, as rows that Python made look so small that Spark would send them through the driver.
        return rows.join(first_of_rule(rows.select("rule_id", "value").distinct(), entries).hint("merge"), ["rule_id", "value"])
    known = sorted((r for r in known if r["ord"] is not None), key=lambda r: r["ord"])
    given = rows.sparkSession.createDataFrame([(*[r[c] for c in take], i) for i, r in enumerate(known)], StructType([*[entries.schema[c] for c in take], StructField("_entry", IntegerType())]))
    fits = lambda r: (F.col("rule_id") == r["rule_id"]) & glob_matches(F.col("_key"), F.lit(r["_pattern"]))
    first = F.coalesce(F.lit(None).cast("int"), *[F.when(fits(r), F.lit(i)) for i, r in enumerate(known)])
    tried = rows.withColumn("_key", glob_key("value")).withColumn("_entry", first).where("_entry IS NOT NULL")
    return tried.join(F.broadcast(given), "_entry").select("rule_id", "value", *rest, *take)  # LITERAL_ENTRIES rows at most


def first_of_rule(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(rule_id, value) with the first entry of that rule whose pattern matches the value."""
    patterns = small(entries.withColumn("_pattern", glob_key("pattern")).drop("pattern"))
    hits = values.withColumn("_key", glob_key("value")).join(patterns, "rule_id").where(glob_matches(F.col("_key"), F.col("_pattern")))
    take = [c for c in entries.columns if c not in ("rule_id", "ord", "pattern")]
    best = hits.groupBy("rule_id", "value").agg(F.min_by(F.struct(*take), "ord").alias("_best"))
    return best.select("rule_id", "value", *[F.col(f"_best.{c}").alias(c) for c in take])


def mention_matches(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(file, line, algorithm, evidence) of lines that mention an algorithm; mentions has (ord, pattern, algorithm).

    One row for each line and algorithm, whichever of its patterns hit.
    """
    rows = lines(texts.select("path", "text")).where(F.trim("text") != "").withColumnRenamed("path", "file")
    return first_mentions(rows, mentions).select("file", "line", "algorithm", T.evidence(F.col("text")).alias("evidence"))


def first_mentions(rows: DataFrame, mentions: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with each algorithm that their text mentions and first_pattern, the order of the first pattern that hits.

    The pattern list is configuration: each pattern becomes a literal
    predicate, compiled once, where a join would compile it for every row.
    """
    known = sorted((r["algorithm"], r["ord"], r["pattern"]) for r in rule_rows(mentions.select("algorithm", "ord", "pattern")))
    hits = []
    for algorithm in dict.fromkeys(k[0] for k in known):
        first = F.coalesce(*[F.when(F.col(text_col).rlike(p), F.lit(o)) for a, o, p in known if a == algorithm])
        hits.append(F.struct(F.lit(algorithm).alias("algorithm"), first.alias("first_pattern")))
    found = F.filter(F.array(*hits), lambda h: h["first_pattern"].isNotNull())
    return rows.withColumn("_m", F.explode(found)).select(*rows.columns, "_m.algorithm", "_m.first_pattern")


def with_siblings(matches: DataFrame, targets: Column, confidence: Column) -> DataFrame:
    """Rows that may be several algorithms take the one that their file shows elsewhere.

    targets: the algorithms that a row's rule could mean (null where it isn't
    in doubt). If exactly one of them is found in the same file, by rows as
    they were before any change and outside comments, the row becomes that one.
    """
    seen = matches.where("NOT comment_only").groupBy("file").agg(F.collect_set("algorithm").alias("_seen"))  # algorithms, a few in all
    found = F.array_intersect(F.coalesce("_seen", F.array().cast("array<string>")), targets)
    one = targets.isNotNull() & (F.size(found) == 1)
    rows = matches.join(seen, "file", "left")
    return rows.withColumns({"confidence": F.when(one, confidence).otherwise(F.col("confidence")), "algorithm": F.when(one, F.element_at(found, 1)).otherwise(F.col("algorithm"))}).drop("_seen")


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.5, "medium").otherwise("low")


#: Enumerations of a finding, checked by `violations`.
OPERATIONS = ("key_generation", "key_agreement", "encryption", "decryption", "signature", "verification", "hashing", "mac", "encapsulation", "decapsulation", "config", "unknown")
LEVELS = ("high", "medium", "low")


def violations(findings: DataFrame) -> DataFrame:
    """(id, problem): what a finding must not be; no row where all are sound."""
    f = F.col
    tests = {
        "no id": f("id").isNull() | (f("id") == ""),
        "no file": f("file").isNull() | (f("file") == "") | f("file").startswith("/") | F.array_contains(F.split("file", "/"), ".."),
        "bad lines": f("line_start").isNull() | (f("line_start") < 1) | (f("line_end") < f("line_start")),
        "unknown operation": f("operation").isNull() | ~f("operation").isin(*OPERATIONS),
        "confidence out of range": f("confidence").isNull() | (f("confidence") <= 0) | (f("confidence") > 1),
        "level and confidence differ": F.coalesce(f("confidence_level") != confidence_level(f("confidence")), F.lit(True)),
        "bad key size": F.coalesce(f("key_size") <= 0, F.lit(False)),
        "evidence too long": F.length("evidence") > T.EVIDENCE_LENGTH,
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda p: p.isNotNull())
    return findings.select("id", F.explode(found).alias("problem"))


def as_findings(matches: DataFrame, services: DataFrame, repository: str | Column, scan_id: str = "scan") -> DataFrame:
    """Findings with ids from matches(file, line_start, line_end, rule_id, algorithm, primitive, operation, library, api, scope, evidence, confidence, key_size, comment_only).

    Of matches with one identity the surest counts (then the smallest key, then
    one outside comments, then the smallest by its other columns, so that reruns agree).
    A file belongs to the service with the longest root above it, else to the
    repository. Ids follow the order of the identity. Where files and roots are
    scoped (sources.scopes), findings are those of many scans: scan_id is each
    file's own, and ids count from 1 in each scan.
    """
    rest = [c for c in matches.columns if c not in IDENTITY]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("c"), F.coalesce("key_size", F.lit(-1)).alias("k"), F.col("comment_only").alias("n"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)]))
    one = matches.groupBy(*IDENTITY).agg(best.alias("_m")).select(*IDENTITY, "_m.*")
    roots = services.where("service IS NOT NULL").select("root", "service", F.col("metadata_file").alias("ord"))
    placed = longest_prefix(one.withColumnRenamed("file", "path"), "path", roots, "root", ["service"]).withColumnRenamed("path", "file")
    level = F.round(F.when(F.col("comment_only"), F.least("confidence", F.lit(COMMENT_CONFIDENCE))).otherwise(F.col("confidence")), 2)
    placed = placed.withColumns({"scan_id": F.coalesce(scan_of(F.col("file")), F.lit(scan_id)), "file": bare(F.col("file"))})
    # A column of its own: what many signs are compared with is made once a row.
    placed = placed.withColumn("_tokens", T.identifier_tokens(F.col("file"), F.coalesce("scope", F.array().cast("array<string>"))))
    rows = placed.withColumns(
        {
            "service": F.coalesce(F.nullif("service", F.lit("")), repository if isinstance(repository, Column) else F.lit(repository)),
            "confidence": level,
            "confidence_level": confidence_level(level),
            "context": T.context_of(F.col("_tokens"), F.col("algorithm"), F.col("primitive"), F.col("operation")),
            "quantum_vulnerable": F.col("primitive") == "public-key",
            "already_pqc": F.col("primitive").startswith("pqc"),
            "test_path": T.test_path(F.col("file")),
        }
    ).drop("_tokens")
    # Written before they are put in order: ranges are drawn from a reading of their own, which would make all of this once more.
    rows = Workspace(rows.sparkSession).write(rows, "findings")
    ordered = numbered(rows, [F.col(c) for c in ("scan_id", *IDENTITY)], "_number")
    firsts = ordered.groupBy("scan_id").agg(F.min("_number").alias("_first"))  # one row a scan
    return ordered.join(firsts, "scan_id").withColumn("id", F.format_string(ID, F.col("_number") - F.col("_first") + 1)).select(*rows.columns, "id")


def with_call_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls once for each rule whose pattern their name shows, with the rule's other columns.

    Up to LITERAL_ENTRIES rules are literal predicates, which a call passes
    where it is read: calls are read once, and neither sorted nor shuffled.
    More rules are tried once for each distinct name. What a Python reader
    yields looks as small as the names of its files, so that Spark would send
    the calls themselves through the driver to every task: hence the hint.
    """
    known = rules.where("pattern IS NOT NULL").limit(LITERAL_ENTRIES + 1).collect()
    if len(known) > LITERAL_ENTRIES:
        names = calls.select("name").distinct().join(small(rules), F.expr("name RLIKE pattern")).drop("pattern")
        return calls.join(names.hint("merge"), "name")
    told = rules.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(known)], StructType([StructField("_rule", IntegerType()), *rules.schema])).drop("pattern")
    hits = F.array(F.lit(None).cast("int"), *[F.when(F.col("name").rlike(r["pattern"]), F.lit(i)) for i, r in enumerate(known)])
    tried = calls.withColumn("_rule", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    return tried.join(F.broadcast(told), "_rule").drop("_rule")  # LITERAL_ENTRIES rows at most


def call_matches(calls: DataFrame, rules: DataFrame, entries: DataFrame, key_size_place: int = 1) -> DataFrame:
    """Calls that `python_call` rules name, as matches.

    A rule's entries are tried on the call's full name, the first that fits
    counts; a rule with value_from `literal` tries them on the call's literal
    texts instead, those of its first literal_args (keyword, else place) that
    has any, one match for each that fits. The method that the call is a direct
    argument of may give another operation.
    """
    wanted = rules.where("match_type = 'python_call'").select("rule_id", "library", F.col("api").alias("rule_api"), "pattern", "value_from", "literal_args", "operation_by_parent")
    rows = with_call_rules(calls, wanted)
    given = F.transform("literal_args", lambda a: F.filter("texts", lambda t: F.coalesce(t["keyword"] == a["keyword"], F.lit(False)) | F.coalesce(t["place"] == a["place"], F.lit(False))))
    literals = F.transform(F.coalesce(F.try_element_at(F.filter(given, lambda g: F.size(g) > 0), F.lit(1)), F.slice("texts", 1, 0)), lambda t: t["value"])
    rows = rows.withColumn("value", F.explode(F.when(F.col("value_from") == "literal", literals).otherwise(F.array("name")))).drop("literal_args")
    rows = with_first_of_rule(rows, entries)
    named = F.filter("ints", lambda i: F.coalesce(i["keyword"] == "key_size", F.lit(False)))
    placed = F.filter("ints", lambda i: F.coalesce(i["place"] == key_size_place, F.lit(False)))
    size = F.try_element_at(F.concat(named, placed), F.lit(1))["value"].cast("int")
    last_two = F.regexp_extract("name", r"([^.]+\.)?[^.]+$", 0)
    api = F.when(F.col("value_from") == "literal", F.col("rule_api")).otherwise(F.coalesce("rule_api", last_two))
    operation = F.coalesce(F.when(F.col("parent").isNotNull(), F.try_element_at("operation_by_parent", F.col("parent"))), "operation")
    return rows.select("file", "line_start", "line_end", "rule_id", "algorithm", "primitive", operation.alias("operation"), "library", api.alias("api"), "scope", "evidence", "confidence", F.coalesce("key_size", size).alias("key_size"), F.lit(False).alias("comment_only"))


def as_matches(rows: DataFrame, comment_only: bool = False) -> DataFrame:
    """Rows of a line-wise scan (file, line or line_start, rule_id, ...) in the columns that as_findings takes; what they lack is null."""
    have = rows.columns
    line = F.col("line_start" if "line_start" in have else "line").cast("int")
    text = lambda name: (F.col(name) if name in have else F.lit(None)).cast("string").alias(name)
    return rows.select(
        "file", line.alias("line_start"), (F.col("line_end") if "line_end" in have else line).cast("int").alias("line_end"), "rule_id", "algorithm", "primitive", text("operation"), text("library"), text("api"),
        F.coalesce("scope", F.array().cast("array<string>")).alias("scope") if "scope" in have else F.array().cast("array<string>").alias("scope"),
        T.redacted(F.col("evidence")).alias("evidence"), F.col("confidence").cast("double").alias("confidence"), (F.col("key_size") if "key_size" in have else F.lit(None)).cast("int").alias("key_size"), F.lit(comment_only).alias("comment_only"),
    )
