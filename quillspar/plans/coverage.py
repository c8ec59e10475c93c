"""What a scan saw and didn't see: manifest, warnings, limits of the graph, and accuracy on labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.operators.order import budgeted

MANIFEST_DDL = "scan_id string, files bigint, bytes bigint, skipped array<struct<reason: string, n: bigint>>, services array<string>, kinds array<struct<kind: string, n: bigint>>"
# Reasons that leave evidence unread, and what they mean.
REASONS = {"too_large": "larger than the file limit", "minified": "lines too long to read", "binary": "no text", "parse_error": "could not be parsed", "too_complex": "too many nodes"}


def manifest(assessed: DataFrame, services: DataFrame, scan_id: str) -> DataFrame:
    """One row about a scan, from files with kind and skip; its lists have a row for each reason, kind or service."""
    # Files are read once: sums by reason and kind are a few rows, of which all lists are made.
    cells = assessed.groupBy("skip", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    said = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    parts = cells.select("n", "size", F.explode(F.array(said("all", F.lit("")), said("skip", F.col("skip")), said("kind", F.col("kind")))).alias("p")).where("p.name IS NOT NULL")
    parts = parts.groupBy("p.what", "p.name").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    pairs = lambda what, name: F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct(F.col("name").alias(name), "n")))).alias(f"{name}s")
    total = lambda column, name: F.coalesce(F.max(F.when(F.col("what") == "all", F.col(column))), F.lit(0)).cast("long").alias(name)
    names = services.where("service IS NOT NULL").agg(F.array_sort(F.collect_set("service")).alias("services"))
    row = parts.agg(total("n", "files"), total("size", "bytes"), pairs("skip", "reason"), pairs("kind", "kind")).crossJoin(names)  # one row each
    return row.select(F.lit(scan_id).alias("scan_id"), "files", "bytes", F.col("reasons").alias("skipped"), "services", "kinds")


def write_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_DDL).json(path)


def warnings(assessed: DataFrame) -> DataFrame:
    """(reason, n, meaning) of what kept files from being read."""
    # Counted without a filter: one on `skip` would sink to the scan and read each file's text there, a second time and in as few tasks as the scan has.
    counts = assessed.agg(*[F.count_if(F.col("skip") == reason).alias(reason) for reason in REASONS])
    rows = F.array(*[F.struct(F.lit(reason).alias("reason"), F.col(reason).alias("n"), F.lit(meaning).alias("meaning")) for reason, meaning in REASONS.items()])
    return counts.select(F.explode(rows).alias("w")).select("w.*").where("n > 0")


#: (area, predicate over one row of facts, message); `{name}` in a message is the fact's value. A message without a predicate is always said.
MESSAGES = (
    ("graph", "NOT imports_known", "Imports weren't read in this scan: only direct use is shown."),
    ("graph", "imports_truncated", "There are more imports than are kept, so reach may be larger than shown."),
    ("graph", "unresolved > 0", "{unresolved} imports lead to no file of the repository and aren't followed."),
    ("graph", "inferred > 0", "{inferred} imports fit several files; edges by them are inferred."),
    ("graph", "suppressed > 0", "{suppressed} suppressed findings are left out."),
    ("graph", "comment_only > 0", "{comment_only} mentions in comments are left out."),
    ("graph", None, "Only static imports count: nothing that is loaded, injected or called over a network at run time."),
    ("readiness", "partial", "The scan ended before all files were read."),
    ("readiness", "skipped > 0", "{skipped} files weren't read; what they hold isn't in here."),
    ("readiness", "services = 0 OR services_with_gaps > 0", "Services lack metadata, so that exposure over time can't be told for all."),
    ("readiness", "NOT imports_known", "Imports weren't read: how files depend on each other isn't known."),
    ("readiness", "unverified_libraries > 0", "{unverified_libraries} libraries aren't known to support post-quantum algorithms."),
    ("readiness", None, "An estimate from source text, no certificate; findings of less than high confidence need a look."),
    ("coverage", "skipped > 0", "{skipped} of {files} files were skipped."),
    ("coverage", "findings = 0", "No finding at all: see which kinds of files were read."),
    ("coverage", "low_confidence > 0", "{low_confidence} findings have less than high confidence."),
)


def gated(facts: DataFrame, table: tuple[tuple[str, str | None, str], ...] = MESSAGES) -> DataFrame:
    """(scan_id, area, place, message): what a table says about each row of facts, in the table's order.

    facts has one row a scan. A message is said where its predicate holds (null
    doesn't), with the facts' values in the place of their names.
    """

    def said(text: str) -> Column:
        pieces = text.replace("}", "{").split("{")
        return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("unknown")) if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])

    rows = F.array(*[F.when(F.expr(test) if test else F.lit(True), F.struct(F.lit(area).alias("area"), F.lit(i).alias("place"), said(text).alias("message"))) for i, (area, test, text) in enumerate(table)])
    return facts.select("scan_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("m")).select("scan_id", "m.*")


def facts(findings: DataFrame, imports: DataFrame | None, assessed: DataFrame, services: DataFrame, used: DataFrame, partial: bool = False, most: int = 100_000, scan_id: str = "scan") -> DataFrame:
    """One row of what messages ask about a scan; used: plans.readiness.library_support, imports: None where they weren't read."""
    count = lambda df, **tests: df.agg(*[F.count_if(t).alias(n) if t is not None else F.count("*").alias(n) for n, t in tests.items()])
    f = F.col
    parts = [
        count(findings, findings=None, suppressed=f("suppressed"), comment_only=f("comment_only"), low_confidence=~f("suppressed") & (f("confidence_level") != "high")),
        count(assessed, files=None, skipped=f("skip").isNotNull()),
        count(services, services=None, services_with_gaps=F.size(F.coalesce("missing_fields", F.array().cast("array<string>"))) > 0),
        count(used, unverified_libraries=f("status") == "not verified"),
    ]
    if imports is not None:
        parts.append(import_limits(imports, most).select(F.lit(True).alias("imports_known"), f("truncated").alias("imports_truncated"), "unresolved", "inferred"))
    else:
        none = F.lit(0).cast("long")
        parts.append(findings.sparkSession.range(1).select(F.lit(False).alias("imports_known"), F.lit(False).alias("imports_truncated"), none.alias("unresolved"), none.alias("inferred")))
    row = findings.sparkSession.range(1).select(F.lit(scan_id).alias("scan_id"), F.lit(partial).alias("partial"))
    for part in parts:
        row = row.crossJoin(part)  # one row each
    return row


def kept_imports(imports: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The first imports by file, line, spec and kind, and (total, kept, left_out) of all."""
    kind = F.col("kind") if "kind" in imports.columns else F.lit("import")
    rows, shares = budgeted(imports.withColumn("_class", F.lit("import")).withColumn("_kind", kind), "_class", ["import"], ["file", "line", "spec", "_kind"], most)
    return rows.drop("_class", "_kind"), shares.drop("_class")


def import_limits(imports: DataFrame, most: int = 100_000) -> DataFrame:
    """One row: imports that couldn't be followed or aren't proven, and whether there are more than are kept."""
    kinds: dict[str, Column] = {"unresolved": F.col("resolution") == "unresolved", "inferred": F.col("resolution").isin("ambiguous", "wildcard"), "external": F.col("resolution") == "external"}
    return imports.agg(*[F.count_if(test).alias(name) for name, test in kinds.items()], (F.count("*") > most).alias("truncated"))


def evaluated(expected: DataFrame, found: DataFrame, cases: DataFrame) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1) of found(case, line, algorithm) against expected, over all cases (kind null) and each kind.

    Rows are compared as multisets: what is found twice and expected once is
    right once and wrong once. A measure of nothing is 1.
    """
    columns, outcomes = ["case", "line", "algorithm"], ["tp", "fp", "fn"]
    tagged = lambda rows, wanted: rows.select(*columns, F.lit(wanted).alias("_wanted"))
    # Equal rows are counted, not listed: a multiset's intersection and differences are the least and the rests of two counts.
    counts = tagged(expected, True).unionByName(tagged(found, False)).groupBy(*columns).agg(F.count_if("_wanted").alias("_e"), F.count_if(~F.col("_wanted")).alias("_f"))
    both = F.least("_e", "_f")
    by_case = counts.groupBy("case").agg(F.sum(both).alias("tp"), F.sum(F.col("_f") - both).alias("fp"), F.sum(F.col("_e") - both).alias("fn"))
    share = lambda top, low: F.when(low == 0, F.lit(1.0)).otherwise(top / low)
    sums = cases.select("case", "kind").join(by_case, "case", "left").rollup("kind").agg(*[F.coalesce(F.sum(o), F.lit(0).cast("long")).alias(o) for o in outcomes])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})
