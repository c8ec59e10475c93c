"""Service descriptions and rule packs: small YAML files as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions.scoring import CRITICALITY, SENSITIVITY
from quillspar.session import ship

MAX_SERVICE_BYTES = 64 << 10
SERVICE_DDL = "service string, owner string, data_classification string, business_criticality string, internet_exposed boolean, data_lifetime_years int, metadata_file string, root string, missing_fields array<string>, invalid_fields array<string>"
# The fields of a service description; each gives the value to keep, or none where it isn't valid.
_FIELDS = {
    "service": lambda v: (isinstance(v, str) and v.strip()) or None,
    "owner": lambda v: (isinstance(v, str) and v.strip()) or None,
    "data_classification": lambda v: v.strip().lower() if isinstance(v, str) and v.strip().lower() in SENSITIVITY else None,
    "business_criticality": lambda v: v.strip().lower() if isinstance(v, str) and v.strip().lower() in CRITICALITY else None,
    "internet_exposed": lambda v: v if isinstance(v, bool) else None,
    "data_lifetime_years": lambda v: v if isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= 200 else None,
}


def _service(path: str, text: str) -> dict | None:
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict):
        return None
    row = {k: keep(found.get(k)) for k, keep in _FIELDS.items()}
    missing = [k for k in _FIELDS if k not in found]  # a field that is given as null is invalid
    return row | {"metadata_file": path, "root": path.rpartition("/")[0], "missing_fields": missing, "invalid_fields": [k for k in _FIELDS if row[k] is None and k not in missing]}


def read_services(files: DataFrame) -> DataFrame:
    """One row for each service.yaml among files(path, size, text): valid fields, and which are missing or invalid."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, text in frame.itertuples(index=False) if (r := _service(path, text))]
            out = pd.DataFrame(rows, columns=[*_FIELDS, "metadata_file", "root", "missing_fields", "invalid_fields"])
            yield out.astype({"data_lifetime_years": "Int32", "internet_exposed": "boolean"})

    named = files.where((F.element_at(F.split("path", "/"), -1) == "service.yaml") & (F.col("size") <= MAX_SERVICE_BYTES))
    return named.select("path", "text").mapInPandas(run, SERVICE_DDL)


def service_warnings(files: DataFrame) -> DataFrame:
    """(path, problem) of the service.yaml files that give no row: too_large, or unreadable (no YAML, or no mapping)."""
    named = files.where(F.element_at(F.split("path", "/"), -1) == "service.yaml").select("path", "size")
    read = read_services(files).select(F.col("metadata_file").alias("path"))
    return named.join(read, "path", "left_anti").select("path", F.when(F.col("size") > MAX_SERVICE_BYTES, "too_large").otherwise("unreadable").alias("problem"))


class RuleError(ValueError):
    """A rule pack that isn't as it should be."""


PRIMITIVES = ("public-key", "symmetric", "hash", "mac", "protocol", "pqc-kem", "pqc-signature")
MATCH_TYPES = ("directive", "comment_mention", "regex", "python_call", "structured", "pem_certificate")
_RULE_KEYS = {"rule_id", "rule_version", "language", "description", "library", "api", "algorithm", "primitive", "operation", "confidence", "match_type", "pattern", "file_pattern", "split", "skip_prefixes", "value_map", "value_from", "literal_args", "operation_by_parent", "file_requires"}
_NEEDED = {"rule_id", "rule_version", "language", "algorithm", "primitive", "operation", "confidence", "match_type", "pattern"}
RULES_DDL = "rule_id string, rule_version string, language string, library string, api string, algorithm string, primitive string, operation string, confidence double, match_type string, pattern string, file_pattern string, split string, skip_prefixes array<string>, value_from string, literal_args array<struct<place: int, keyword: string>>, operation_by_parent map<string, string>, file_requires string"
ENTRIES_DDL = "rule_id string, ord int, pattern string, algorithm string, primitive string, operation string, confidence double, key_size int"


def _check(rule: dict, where: str) -> None:
    if unknown := set(rule) - _RULE_KEYS:
        raise RuleError(f"{where}: unknown keys {sorted(unknown)}")
    if missing := {k for k in _NEEDED if rule.get(k) is None}:
        raise RuleError(f"{where}: missing {sorted(missing)}")
    if rule["primitive"] not in PRIMITIVES or rule["match_type"] not in MATCH_TYPES:
        raise RuleError(f"{where}: unknown primitive or match type")
    if not 0 < float(rule["confidence"]) <= 1:
        raise RuleError(f"{where}: confidence must be in (0, 1]")
    if not re.fullmatch(r"\d+\.\d+\.\d+", str(rule["rule_version"])):
        raise RuleError(f"{where}: rule_version isn't a semantic version")
    if rule.get("value_from") not in (None, "name", "literal"):
        raise RuleError(f"{where}: value_from is name or literal")
    for entry in (rule.get("value_map") or {}).values():
        _check_entry({"algorithm": entry} if isinstance(entry, str) else entry, where)
    for key in ("pattern", "file_pattern", "file_requires"):
        try:
            re.compile(rule.get(key) or "")
        except re.error as bad:
            raise RuleError(f"{where}: bad {key}") from bad


_ENTRY_KEYS = {"algorithm", "primitive", "operation", "confidence", "key_size"}


def _check_entry(entry: dict, where: str) -> None:
    if not isinstance(entry, dict) or set(entry) - _ENTRY_KEYS:
        raise RuleError(f"{where}: bad entry {entry}")
    if entry.get("primitive", PRIMITIVES[0]) not in PRIMITIVES or not 0 < float(entry.get("confidence", 1)) <= 1:
        raise RuleError(f"{where}: bad primitive or confidence in {entry}")


def load_rules(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rules, rule_entries) of the YAML files in a folder: a rule pack is configuration, read where the job is set up."""
    return rule_tables(spark, {path.name: yaml.safe_load(path.read_text(encoding="utf-8")) for path in sorted(Path(folder).rglob("*.yaml"))})


def rule_tables(spark: SparkSession, pack: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(rules, rule_entries) of a rule pack: a mapping for each rule, by the name that errors give it.

    Packs are strict: unknown or missing keys, bad enumerations, patterns and
    versions and repeated ids raise RuleError. Entries keep their order, for
    the first that matches counts; what an entry leaves out its rule says.
    """
    rules, entries, seen = [], [], set()
    for name, rule in pack.items():
        if not isinstance(rule, dict):
            raise RuleError(f"{name}: not a mapping")
        _check(rule, name)
        if rule["rule_id"] in seen:
            raise RuleError(f"{name}: {rule['rule_id']} is there twice")
        seen.add(rule["rule_id"])
        rules.append([rule["rule_id"], str(rule["rule_version"]), rule["language"], rule.get("library"), rule.get("api"), rule["algorithm"], rule["primitive"], rule["operation"], float(rule["confidence"]), rule["match_type"], rule["pattern"], rule.get("file_pattern"), rule.get("split"), list(rule.get("skip_prefixes") or []), rule.get("value_from") or "name", [(a.get("pos"), a.get("kw")) for a in rule.get("literal_args") or []], dict(rule.get("operation_by_parent") or {}), rule.get("file_requires")])
        for ord_, (pattern, entry) in enumerate((rule.get("value_map") or {}).items()):
            entry = {"algorithm": entry} if isinstance(entry, str) else entry
            entries.append([rule["rule_id"], ord_, str(pattern), entry.get("algorithm", rule["algorithm"]), entry.get("primitive", rule["primitive"]), entry.get("operation", rule["operation"]), float(entry.get("confidence", rule["confidence"])), entry.get("key_size")])
    rules.sort(key=lambda r: (r[2], r[0]))
    return spark.createDataFrame(rules, RULES_DDL), spark.createDataFrame(entries, ENTRIES_DDL)
