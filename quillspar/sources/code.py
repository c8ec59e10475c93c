"""Java and JavaScript text: code apart from comments and strings, regex rules on code only, enclosing declarations."""

from __future__ import annotations

import bisect
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.operators.matching import rule_rows, small
from quillspar.session import ship

# What starts something that isn't code: comments, strings, text blocks, and in JavaScript templates and regex literals (where a
# value may stand, so not after a name, a number or a closing bracket).
_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_LITERAL = r"(?:(?<=[(,=:\[!&|?{};+\n])|(?<=return)|\A)[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_STARTS = {
    "java": re.compile(rf'(?P<comment>{_COMMENT})|(?P<string>"""(?:[^\\]|\\[\s\S])*?(?:"""|\Z)|{_STRING})'),
    "js": re.compile(rf"(?P<comment>{_COMMENT})|(?P<string>{_STRING}|{_LITERAL})|(?P<template>`)|(?P<open>\{{)|(?P<close>\}})"),
}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{|\Z)")
#: Templates inside templates that are followed.
MAX_TEMPLATES = 32
_DECLARED = re.compile(r"\b(?:class|interface|enum|function)\s+([A-Za-z_$][\w$]*)|\b([A-Za-z_$][\w$]*)\s*\([^()\n]{0,200}\)\s*(?:throws [\w., ]+)?\{")
_WORDS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "else", "do", "try", "function"}
MATCH_DDL = "file string, line_start int, line_end int, at int, rule_id string, found string, value string, scope array<string>, after string, call string"
COMMENT_DDL = "file string, line int, text string"
#: Characters after a match that refinements may look at.
AFTER = 600
# Fixed value: characters from a call's first bracket within which its last one is looked for.
CALL_LENGTH = 200
_BRACKET = re.compile(r"[()]")


def regions(text: str, language: str = "js") -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Starts and ends of strings and comments, and the comments alone; one pass over the text.

    What stands between `${` and `}` of a template is code again.
    """
    starts, ends, comments, pattern = [], [], [], _STARTS[language]
    braces: list[int] = []  # for each template that is open, the braces open inside its `${`
    at = 0

    def template(begin: int, after: int) -> int:
        m = _TEMPLATE.match(text, after)
        starts.append(begin)
        ends.append(m.end())
        if m[1] == "${" and len(braces) < MAX_TEMPLATES:
            braces.append(0)
        return max(m.end(), after)

    while m := pattern.search(text, at):
        at = max(m.end(), m.start() + 1)
        kind = m.lastgroup
        if kind == "template":
            at = template(m.start(), m.end())
        elif kind == "open":
            if braces:
                braces[-1] += 1
        elif kind == "close":
            if braces and braces[-1]:
                braces[-1] -= 1
            elif braces:
                braces.pop()
                at = template(m.start(), m.end())
        else:
            starts.append(m.start())
            ends.append(m.end())
            if kind == "comment":
                comments.append(m.span())
    return starts, ends, comments


def _python_comments(text: str) -> list[tuple[int, str]]:
    """(line, comment) by Python's own tokens, as far as they can be read."""
    out = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                out.append((token.start[0], token.string))
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return out


def call_end(text: str, begin: int, end: int, in_code) -> int:
    """Where the call ends whose opening bracket lies in text[begin:end]: after the bracket that closes it.

    Brackets in strings and comments don't count. Without an opening bracket,
    or where none closes it within CALL_LENGTH characters, it is the given end.
    """
    first = text.find("(", begin, end)
    if first < 0:
        return end
    depth = 0
    for bracket in _BRACKET.finditer(text, first, first + CALL_LENGTH):
        if in_code(bracket.start()):
            depth += 1 if bracket[0] == "(" else -1
            if not depth:
                return bracket.end()
    return end


def _matches(path: str, language: str, text: str, rules: list[tuple]) -> Iterator[tuple]:
    starts, ends, _ = regions(text, language)

    def in_code(at: int) -> bool:
        i = bisect.bisect_right(starts, at) - 1
        return i < 0 or at >= ends[i]

    declared = [(m.start(), m[1] or m[2]) for m in _DECLARED.finditer(text) if (m[1] or m[2]) not in _WORDS and in_code(m.start())]
    places, lines = [d[0] for d in declared], [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect.bisect_right(lines, at)
    for rule_id, pattern, requires in rules:
        if requires and not requires.search(text):
            continue
        for m in pattern.finditer(text):
            if in_code(m.start()):
                i = bisect.bisect_right(places, m.start()) - 1
                end = call_end(text, m.start(), m.end(), in_code)
                value = m[1] if m.re.groups else m[0]
                yield path, line_of(m.start()), line_of(max(end - 1, m.start())), m.start(), rule_id, m[0], value, [declared[i][1]] if i >= 0 else [], text[m.end() : m.end() + AFTER], text[m.start() : end]


def regex_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """MATCH_DDL rows: where `regex` rules of a file's language begin in its code, with the nearest declaration before and,
    up to its last bracket, the call that they begin.

    The rule pack is configuration and goes to tasks with the function.
    """
    ship(files.sparkSession)
    requires = "file_requires" if "file_requires" in rules.columns else F.lit(None).alias("file_requires")
    pack = [tuple(r) for r in rule_rows(rules.where("match_type = 'regex'").select("language", "rule_id", "pattern", requires))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: dict[str, list[tuple]] = {}
        for language, rule_id, pattern, needed in pack:
            compiled.setdefault(language, []).append((rule_id, re.compile(pattern), re.compile(needed) if needed else None))
        for frame in frames:
            rows = [r for path, kind, text in frame.itertuples(index=False) for r in _matches(path, kind, text, compiled.get(kind, []))]
            yield pd.DataFrame(rows, columns=["file", "line_start", "line_end", "at", "rule_id", "found", "value", "scope", "after", "call"])

    return files.where("kind IN ('java', 'js')").select("path", "kind", "text").mapInPandas(run, MATCH_DDL)


def refined(matches: DataFrame, refinements: DataFrame) -> DataFrame:
    """matches with `operation`: of the first refinement(rule_id, ord, window, pattern, operation) that occurs in the window after the match."""
    hits = matches.join(small(refinements), "rule_id").where(F.expr("left(after, window) RLIKE pattern"))
    best = hits.groupBy("file", "at", "rule_id").agg(F.min_by("operation", "ord").alias("operation"))
    return matches.join(best, ["file", "at", "rule_id"], "left")


def comments(files: DataFrame) -> DataFrame:
    """COMMENT_DDL rows: the lines of comments of Java, JavaScript and Python files; of documents, every line that isn't blank."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, kind, text in frame.itertuples(index=False):
                if kind == "python":
                    rows += [(path, *found) for found in _python_comments(text)]
                    continue
                for lo, hi in regions(text, kind)[2]:
                    first = text.count("\n", 0, lo) + 1
                    rows += [(path, first + i, line) for i, line in enumerate(text[lo:hi].split("\n"))]
            yield pd.DataFrame(rows, columns=["file", "line", "text"])

    code = files.where("kind IN ('java', 'js', 'python')").select("path", "kind", "text").mapInPandas(run, COMMENT_DDL)
    rows = files.where("kind IN ('yaml', 'text', 'doc')").select("path", "kind", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    hashed = F.regexp_extract("line_text", r"(?:^|\s)(#.*)$", 1)
    said = F.when(F.col("kind") == "doc", F.col("line_text")).otherwise(hashed)
    rows = rows.select(F.col("path").alias("file"), (F.col("at") + 1).alias("line"), said.alias("text"))
    return code.unionByName(rows).where(F.trim("text") != "")


def same_package(files: DataFrame, explicit: DataFrame) -> DataFrame:
    """(file, target): Java files that name a type of another file of their package without importing it.

    explicit has (file, name): the simple names that a file imports itself.
    """
    java = files.where("kind = 'java'").select(F.col("path").alias("file"), F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), "text")
    names = java.select("file", "package", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1)))).alias("name"))
    types = java.select(F.col("file").alias("target"), "package", F.regexp_extract("file", r"([^/]+)\.java$", 1).alias("name"))
    found = names.join(types, ["package", "name"]).where("file <> target")
    return found.join(explicit, ["file", "name"], "left_anti").select("file", "target").distinct()


def without_private_keys(lines: DataFrame, marker: str = T.REDACTED) -> DataFrame:
    """lines(file, line, text) with the bodies of private-key blocks replaced, and `in_key`.

    A block begins after its header and ends at its footer, at the next header
    or with the file; lines are ordered within their file only.
    """
    from pyspark.sql import Window

    header, footer = r"-----BEGIN [^-]*PRIVATE KEY[^-]*-----", r"-----END [^-]*PRIVATE KEY"
    opens = F.col("text").rlike(header) & ~F.col("text").rlike(f"{header}.*{footer}")
    mark = F.when(opens, True).when(F.col("text").rlike(footer), False)
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("in_key", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)))
    run = r"[A-Za-z0-9+/=]{16,}"
    one_line = F.regexp_replace("text", rf"({header})\s*\S.*?({footer})", f"$1{marker}$2")
    shown = F.when(F.col("text").rlike(f"{header}.*{footer}"), one_line).when(opens, F.concat(F.regexp_extract("text", f"^.*?{header}", 0), F.regexp_replace(F.regexp_replace("text", f"^.*?{header}", ""), run, marker)))
    shown = shown.when(F.col("in_key") & F.col("text").rlike(footer), F.concat(F.regexp_replace(F.regexp_extract("text", f"^(.*?){footer}", 1), run, marker), F.regexp_extract("text", f"{footer}.*$", 0)))
    shown = shown.when(F.col("in_key") & (F.trim("text") != ""), F.lit(marker)).otherwise(F.col("text"))
    return rows.withColumn("text", shown)
