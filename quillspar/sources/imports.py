"""Imports and calls of source files as rows, and what imports resolve to.

Reading a file's syntax is a small Python function in each Arrow batch that
yields flat rows; everything after that (resolution, rules) is joins.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.operators.matching import longest_prefix, small
from quillspar.session import ship
from quillspar.sources.code import regions
from quillspar.sources.scopes import scan_of

IMPORT_DDL = "file string, language string, line int, kind string, spec string, names array<string>, evidence string"
CALL_DDL = "file string, line_start int, line_end int, name string, parent string, scope array<string>, ints array<struct<place: int, keyword: string, value: bigint>>, texts array<struct<place: int, keyword: string, value: string>>, evidence string"
#: What a bare module may be in JavaScript and TypeScript, in the order in which files are tried.
JS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")
_JS = re.compile(r"""^\s*(?:import\s(?:[^'"\n;]{0,600}?\sfrom\s)?|export\s[^'"\n;]{0,600}?\sfrom\s|(?:const|let|var)\s[^'"\n;]{0,600}?=\s*require\()\s*['"]([^'"\n]+)['"]""", re.M)
_JAVA = re.compile(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", re.M)


def _python_imports(source: str) -> Iterator[tuple]:
    # Statements hold imports, and expressions hold no statements.
    waiting = deque([ast.parse(source)])
    while waiting:
        node = waiting.popleft()
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            if isinstance(inner := getattr(node, name, None), list):
                waiting.extend(inner)
        if isinstance(node, ast.Import):
            for alias in node.names:
                yield node.lineno, "import", alias.name, []
        elif isinstance(node, ast.ImportFrom):
            yield node.lineno, "relative" if node.level else "from", "." * node.level + (node.module or ""), sorted(a.name for a in node.names)


def _imports(kind: str, source: str) -> Iterator[tuple]:
    if kind == "python":
        yield from _python_imports(source)
    elif kind == "js":
        starts, ends, _ = regions(source, "js")
        for m in _JS.finditer(source):
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            i = bisect.bisect_right(starts, first) - 1
            if i >= 0 and first < ends[i]:
                continue  # inside a comment, string or template
            yield source.count("\n", 0, m.start(1)) + 1, "js", m[1], []
    elif kind == "java":
        for m in _JAVA.finditer(source):
            yield source.count("\n", 0, m.start(2)) + 1, "wildcard" if m[3] else "static" if m[1] else "java", m[2], []


def read_imports(files: DataFrame) -> DataFrame:
    """IMPORT_DDL rows of files(path, kind, text); a file that can't be parsed gives none."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, kind, source in frame.itertuples(index=False):
                try:
                    found = list(_imports(kind, source))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                lines = source.split("\n")
                rows += [(path, kind, line, how, spec, names, lines[line - 1]) for line, how, spec, names in found]
            yield pd.DataFrame(rows, columns=["file", "language", "line", "kind", "spec", "names", "evidence"])

    found = files.where("kind IN ('python', 'js', 'java')").select("path", "kind", "text").mapInPandas(run, IMPORT_DDL)
    return found.withColumn("evidence", T.redacted(T.evidence(F.col("evidence"), 200))).dropDuplicates(["file", "line", "spec", "kind"])


def resolved_imports(imports: DataFrame, files: DataFrame, libraries: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """imports with targets, resolution, external and crypto_library; libraries has (language, root, library).

    Absolute Python and Java imports name a suffix of a module's path; relative
    ones and JavaScript's name exact candidates, tried in order. One file:
    resolved; several: ambiguous; a package: wildcard; none: external, or
    unresolved where the name is relative. configs (sources.structured.
    read_tsconfigs) gives aliases: the nearest config above the importer
    decides by its first pattern that fits, even if no file is there. Files of
    several scans (sources.scopes) resolve within their own.
    """
    rows = imports.withColumn("_row", F.struct("file", "line", "spec", "kind"))
    paths = files.select("path", "kind")
    scope = lambda column: F.coalesce(scan_of(F.col(column)), F.lit("")).alias("_scan")  # noqa: E731 - suffixes meet within a scan
    folder = F.regexp_replace("file", r"/?[^/]+$", "")
    # Python modules and Java classes by every dotted suffix of their path.
    stem = F.regexp_replace(F.regexp_replace("path", r"\.[^.]+$", ""), "/__init__$", "")
    parts = F.split(stem, "/")
    suffixes = paths.where("kind IN ('python', 'java')").select(F.col("kind").alias("language"), scope("path"), F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("wanted"))
    packages = paths.where("kind = 'java'").select("path", F.regexp_replace("path", "/?[^/]+$", "").alias("folder"))
    package_parts = F.split("folder", "/")
    packaged = packages.select(F.lit("java").alias("language"), scope("path"), F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(package_parts)), lambda i: F.array_join(F.slice(package_parts, i, F.size(package_parts)), "."))).alias("wanted"))

    absolute = rows.where("kind IN ('import', 'from', 'java', 'static')")
    module = F.when(F.col("kind") == "static", F.regexp_replace("spec", r"\.[^.]+$", "")).otherwise(F.col("spec"))
    asked = absolute.select("_row", "language", scope("file"), "file", F.explode(F.when(F.col("kind") == "from", F.concat(F.array(module), F.transform("names", lambda n: F.concat(module, F.lit("."), n)))).otherwise(F.array(module))).alias("wanted"))
    hits = asked.join(suffixes, ["language", "_scan", "wanted"])
    # A bare name is a file beside the importer, or none of the repository.
    local = F.contains("wanted", F.lit(".")) | (F.regexp_replace("target", r"/?[^/]+$", "") == folder) | F.col("target").endswith("/__init__.py")
    by_module = hits.where(local).groupBy("_row", "wanted").agg(F.array_sort(F.collect_set("target")).alias("t"))
    found = by_module.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("targets"), F.max(F.size("t")).alias("most"))
    found = found.select("_row", "targets", F.when(F.col("most") == 1, "resolved").otherwise("ambiguous").alias("resolution"))

    wild = rows.where("kind = 'wildcard'").select("_row", "language", scope("file"), F.col("spec").alias("wanted")).join(packaged, ["language", "_scan", "wanted"])
    found = found.unionByName(wild.groupBy("_row").agg(F.array_sort(F.collect_set("target")).alias("targets")).withColumn("resolution", F.lit("wildcard")))

    up = F.length(F.regexp_extract("spec", r"^\.*", 0))
    base = F.split(folder, "/")
    above = F.array_join(F.slice(base, 1, F.greatest(F.size(base) - up + 1, F.lit(0))), "/")
    inside = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    target = F.concat_ws("/", F.nullif(above, F.lit("")), F.nullif(inside, F.lit("")))
    tried_python = F.concat(
        F.array(F.concat(target, F.lit(".py")), F.concat(target, F.lit("/__init__.py"))), F.flatten(F.transform("names", lambda n: F.array(F.concat_ws("/", F.nullif(target, F.lit("")), F.concat(n, F.lit(".py"))), F.concat_ws("/", F.nullif(target, F.lit("")), n, F.lit("__init__.py")))))
    )
    python = rows.where((F.col("kind") == "relative") & (up <= F.size(base) + F.when(folder == "", 0).otherwise(1))).select("_row", F.posexplode(tried_python).alias("place", "path"))
    hit = python.join(paths.select("path"), "path")
    found = found.unionByName(hit.groupBy("_row").agg(F.array_sort(F.collect_set("path")).alias("targets")).withColumn("resolution", F.lit("resolved")))

    joined = F.concat_ws("/", F.nullif(folder, F.lit("")), F.col("spec"))
    # `a/../b` steps up: segments are kept on a stack.
    stack = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda s, p: F.when((p == ".") | (p == ""), s).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    js = rows.where("language = 'js' AND startswith(spec, '.')").withColumn("base", F.array_join(stack, "/"))
    js = js.select("_row", F.lit(0).alias("choice"), "base")
    if configs is not None:
        js = js.unionByName(_aliased(rows.where("language = 'js' AND NOT startswith(spec, '.')"), configs))
    endings = F.array(*map(F.lit, JS_ENDINGS))
    typed = F.regexp_replace("base", r"\.(m|c)?js$", ".$1ts")
    js = js.select("_row", "choice", F.posexplode(F.concat(F.transform(endings, lambda e: F.concat("base", e)), F.array(typed))).alias("place", "path")).join(paths.select("path"), "path")
    found = found.unionByName(js.groupBy("_row").agg(F.array(F.min_by("path", F.struct("choice", "place"))).alias("targets")).withColumn("resolution", F.lit("resolved")))

    out = rows.join(found, "_row", "left")
    relative = (F.col("kind") == "relative") | ((F.col("language") == "js") & F.col("spec").startswith("."))
    targets = F.array_remove(F.coalesce("targets", F.array().cast("array<string>")), F.col("file"))
    resolution = F.when(F.size(targets) > 0, F.col("resolution")).when(relative, "unresolved").otherwise("external")
    out = out.withColumns({"targets": targets, "resolution": resolution, "external": F.when(resolution == "external", T.import_root(F.col("spec"), F.col("language")))})
    known = libraries.groupBy("language", "root").agg(F.min("library").alias("crypto_library"))
    # A Java library may be known by three segments; that goes before two.
    longer = small(known.where("language = 'java'").select(F.col("root").alias("_root3"), F.col("crypto_library").alias("_library3")))
    out = out.withColumn("_root3", F.when((F.col("language") == "java") & F.col("external").isNotNull(), F.substring_index("spec", ".", 3))).join(longer, "_root3", "left")
    out = out.withColumn("external", F.when(F.col("_library3").isNotNull(), F.col("_root3")).otherwise(F.col("external")))
    return out.join(small(known.withColumnRenamed("root", "external")), ["language", "external"], "left").select("file", "language", "line", "kind", "spec", "names", "targets", "resolution", "external", "crypto_library", "evidence")


def _aliased(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """(_row, choice, base): where the aliases of the nearest config say that a module may be."""
    folders = configs.select("folder").distinct().withColumn("ord", F.lit(0)).withColumn("config", F.col("folder"))
    near = longest_prefix(rows.select("_row", "spec", "file"), "file", folders, "folder", ["config"])
    patterns = small(configs.withColumnRenamed("folder", "config"))
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise("")
    star = F.contains("pattern", F.lit("*"))
    fits = (star & F.startswith("spec", head) & F.endswith("spec", tail)) | (~star & (F.col("spec") == F.col("pattern")))
    best = near.join(patterns, "config").where(fits).withColumn("middle", F.when(star, F.substring("spec", F.length(head) + 1, F.length("spec") - F.length(head) - F.length(tail))).otherwise("")).groupBy("_row").agg(F.min_by(F.struct("base", "targets", "middle"), "ord").alias("b"))
    tried = best.select("_row", "b.base", "b.middle", F.posexplode("b.targets").alias("choice", "target"))
    path = F.regexp_replace(F.replace("target", F.lit("*"), F.col("middle")), r"^\./", "")
    return tried.select("_row", "choice", F.concat_ws("/", F.nullif("base", F.lit("")), path).alias("base"))


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


class _Calls(ast.NodeVisitor):
    """Calls with their full name by the file's imports and single plain assignments, and the scopes around them."""

    def __init__(self, tree: ast.Module):
        self.names: dict[str, str] = {}
        bound: dict[str, list[str | None]] = {}
        nodes = list(ast.walk(tree))
        for node in nodes:
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
                self.names |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names if a.name != "*"}
            elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
                bound.setdefault(node.id, []).append(None)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                bound.setdefault(node.name, []).append(None)
        for node in nodes:
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                name, value = node.targets[0].id, _dotted(node.value)
                if value and len(bound[name]) == 1 and name not in self.names and (full := self.full(value)):
                    self.names[name] = full
        self.scope: list[str] = []
        self.found: list[tuple] = []
        self.parents: dict[ast.AST, str] = {}

    def full(self, name: str) -> str | None:
        """The name by the file's imports; none where its root isn't imported, so that a class of the file's own isn't taken for a library's."""
        head, dot, rest = name.partition(".")
        return self.names[head] + dot + rest if head in self.names else None

    def _scoped(self, node) -> None:
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _scoped

    def visit_Call(self, node: ast.Call) -> None:
        values = [*((i, None, a) for i, a in enumerate(node.args)), *((None, k.arg, k.value) for k in node.keywords)]
        if isinstance(node.func, ast.Attribute):
            self.parents |= {a: node.func.attr for _, _, a in values}
        if (name := _dotted(node.func)) and (name := self.full(name)):
            ints, texts = [], []
            for place, keyword, value in values:
                items = value.elts if isinstance(value, (ast.List, ast.Tuple, ast.Set)) else [value]
                for item in items:
                    if isinstance(item, ast.Constant) and type(item.value) is int:
                        ints.append((place, keyword, item.value))
                    elif isinstance(item, ast.Constant) and isinstance(item.value, str):
                        texts.append((place, keyword, item.value))
            self.found.append((node, name, self.parents.get(node), list(self.scope), ints, texts))
        self.generic_visit(node)


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


class _Segments:
    """Texts of nodes; the source is cut into lines once, where ast.get_source_segment cuts it anew for each node."""

    def __init__(self, source: str):
        self.lines = [line.encode() for line in _LINE.findall(source)]

    def of(self, node: ast.expr) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode()
        return b"".join([self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]]).decode()


def read_calls(files: DataFrame) -> DataFrame:
    """CALL_DDL rows of Python files(path, kind, text): one for each call of an imported name, with literal arguments.

    `parent` is the method that the call is a direct argument of. A file that
    can't be parsed gives no rows.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, source in frame.itertuples(index=False):
                try:
                    calls = _Calls(tree := ast.parse(source))
                    calls.visit(tree)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                segments = _Segments(source)
                for node, name, parent, scope, ints, texts in calls.found:
                    rows.append((path, node.lineno, node.end_lineno, name, parent, scope, [i for i in ints if abs(i[2]) < 1 << 62], texts, segments.of(node)))
            yield pd.DataFrame(rows, columns=["file", "line_start", "line_end", "name", "parent", "scope", "ints", "texts", "evidence"])

    found = files.where("kind = 'python'").select("path", "text").mapInPandas(run, CALL_DDL)
    return found.withColumn("evidence", T.redacted(T.evidence(F.col("evidence"))))
