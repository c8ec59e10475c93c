"""Structured files as rows of keys and values with line numbers: YAML, JSON and JSON with comments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.operators.matching import rule_rows
from quillspar.plans.findings import with_first_of_rule, with_rules
from quillspar.session import ship

#: Larger documents are refused as a whole.
MAX_NODES = 200_000
#: Nodes nested deeper are left to the loader whose recursion Python bounds.
MAX_DEPTH = 250
_FAST = getattr(yaml, "CSafeLoader", None)
# Tabs, lone question marks and rare line ends: the two loaders differ in them.
_ODD = re.compile("[\t\x85\u2028\u2029]|[?](?=\\s|\\Z)")
VALUES_DDL = "file string, key_path string, key string, value string, line int, error string"
_COMMENTS = re.compile(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|,(?=\s*[}\]])')


def plain_json(text: str) -> str:
    """Comments and trailing commas blanked, all else where it was."""
    return _COMMENTS.sub(lambda m: m[0] if m[0].startswith('"') else re.sub(r"[^\n]", " ", m[0]), text)


def _walk(node: yaml.Node) -> Iterator[tuple[str, str, str, int]]:
    """(key path, key, scalar, line); items of a sequence keep its key, and a node behind several aliases is seen once."""
    stack, seen = [((), "", node)], set()
    while stack:
        path, key, at = stack.pop()
        if id(at) in seen and not isinstance(at, yaml.ScalarNode):
            continue
        seen.add(id(at))
        if len(seen) > MAX_NODES:
            raise OverflowError
        if isinstance(at, yaml.ScalarNode):
            yield ".".join(path), key, at.value, at.start_mark.line + 1
        elif isinstance(at, yaml.SequenceNode):
            stack += [(path, key, item) for item in reversed(at.value)]
        else:
            stack += [((*path, k.value), k.value, v) for k, v in reversed(at.value) if isinstance(k, yaml.ScalarNode)]


def _shallow(text: str) -> bool:
    """Whether nodes are nested no deeper than MAX_DEPTH; a text of few characters can't nest deeper than twice that."""
    if len(text) <= 2 * MAX_DEPTH:
        return True
    depth = 0
    for event in yaml.parse(text, Loader=_FAST):
        if isinstance(event, yaml.CollectionStartEvent):
            depth += 1
            if depth > MAX_DEPTH:
                return False
        elif isinstance(event, yaml.CollectionEndEvent):
            depth -= 1
    return True


def _documents(text: str) -> list[yaml.Node]:
    """The nodes of a text's documents, by libyaml where it is there; what libyaml refuses or reads otherwise, and what is
    nested so deep that its recursion has no bound, is left to the plain loader."""
    if _FAST and not _ODD.search(text):
        try:
            nodes = list(yaml.compose_all(text, Loader=_FAST)) if _shallow(text) else []
            # An empty document has another line there.
            if nodes and all(node.value for node in nodes):
                return nodes
        except (yaml.YAMLError, ValueError):
            pass
    return list(yaml.compose_all(text, Loader=yaml.SafeLoader))


def _values(path: str, kind: str, text: str) -> list[tuple]:
    text = plain_json(text) if kind == "json" else text
    for attempt in dict.fromkeys((text, text.replace("\t", "  "))):
        try:
            return [(path, *row, None) for node in _documents(attempt) if node is not None for row in _walk(node)]
        except OverflowError:
            return [(path, None, None, None, None, "too_complex")]
        except (yaml.YAMLError, RecursionError, ValueError):
            continue
    return [(path, None, None, None, None, "parse_error")]


def read_values(files: DataFrame) -> DataFrame:
    """VALUES_DDL rows of YAML and JSON files(path, kind, text): a row for each scalar, or one with the error."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, kind, text in frame.itertuples(index=False) for r in _values(path, kind, text)]
            yield pd.DataFrame(rows, columns=["file", "key_path", "key", "value", "line", "error"]).astype({"line": "Int32"})

    return files.where("kind IN ('yaml', 'json')").select("path", "kind", "text").mapInPandas(run, VALUES_DDL)


def structured_matches(values: DataFrame, rules: DataFrame, entries: DataFrame) -> DataFrame:
    """Values whose key a `structured` rule's pattern names, with the first entry of that rule that fits the value."""
    pack = rule_rows(rules.where("match_type = 'structured'").select("rule_id", "pattern", "library", "api"))
    given = lambda r: F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["library"]).cast("string").alias("library"), F.lit(r["api"]).cast("string").alias("api"))
    rows = with_rules(values.where("error IS NULL"), pack, lambda r: F.col("key").rlike(r["pattern"]), given)
    rows = rows.select(*values.columns, "rule.rule_id", "rule.library", "rule.api")
    shown = T.redacted(T.evidence(F.concat_ws(": ", "key", "value")))
    return with_first_of_rule(rows, entries).withColumn("evidence", shown)


def read_tsconfigs(files: DataFrame) -> DataFrame:
    """(folder, base, ord, pattern, targets) of tsconfig and jsconfig files: exact patterns first, then longer prefixes."""
    values = read_values(files.where("element_at(split(path, '/'), -1) RLIKE '^(ts|js)config.*[.]json$'")).where("error IS NULL")
    folder = F.regexp_replace("file", "/?[^/]+$", "")
    base = values.where("key_path = 'compilerOptions.baseUrl'").select("file", F.regexp_replace("value", r"^\./?|/$", "").alias("base_url"))
    aliases = values.where("startswith(key_path, 'compilerOptions.paths.')").groupBy("file", F.col("key").alias("pattern")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("targets"))
    rows = aliases.join(base, "file", "left")
    exact = ~F.contains("pattern", F.lit("*"))
    rank = F.struct((~exact).alias("a"), (-F.length(F.substring_index("pattern", "*", 1))).alias("b"), F.col("pattern").alias("c"))
    return rows.select(folder.alias("folder"), F.concat_ws("/", F.nullif(folder, F.lit("")), F.nullif("base_url", F.lit(""))).alias("base"), rank.alias("ord"), "pattern", "targets")
