"""The source readers on files whose text Spark makes from the given tables; SQL says from the keys alone what they must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.plans import coverage, findings, graph, scan
from quillspar.registry import query, table
from quillspar.sources import code, files, imports, metadata, structured


def _sources(spark, sf_dir, kind: str, path: str, lines: list[str], source: str = "part", key: str = "p_partkey") -> DataFrame:
    """One file for each row of a table; `{...}` in path and lines are expressions of its key k."""
    rows = files.dealt(table(spark, sf_dir, source).select(F.col(key).alias("k")))
    return rows.select("k", _made(path).alias("path"), F.lit(kind).alias("kind"), _made_text(lines).alias("text"))


def _made(template: str) -> Column:
    pieces = template.replace("}", "{").split("{")
    return F.concat(*[F.expr(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


def _made_text(lines: list[str]) -> Column:
    return F.concat_ws("\n", *map(_made, lines), F.lit(""))


_BACK = "CASE WHEN k > 7 THEN k - 7 ELSE k + 1000000 END"
_PYTHON = [
    "import hashlib as h", "from pkg{(k + 1) % 7} import mod{k + 1}, mod{k + 2}", "from . import mod{k + 7}", f"import mod{{{_BACK}}}", "",
    "class C{k}:", "    def run(self, x):", "        return h.{CASE k % 2 WHEN 0 THEN 'md5' ELSE 'sha1' END}(x, {k})  # uses it # twice", f"def other(): return mod{{{_BACK}}}.go('AES-' '{{k % 3}} # no', [1, {{k}}]).sign(h.new('x'))", "local.md5(1)",
]


def _python(spark, sf_dir) -> DataFrame:
    return _sources(spark, sf_dir, "python", "pkg{k % 7}/mod{k}.py", _PYTHON)


_JS = [
    "import { a } from './f{k + 5}'".replace("{ a }", "* as a"), "import b from '../d{(k + 1) % 5}/f{k + 1}.js'", "import c from '@s/p{k % 3}/x'", "const r = require('lib{k % 4}')",
    "/*", "import no from './f1'", "*/", "const t = `", "import no from './f2'", "`", "export * from 'node:fs'",
]


def _js(spark, sf_dir) -> DataFrame:
    return _sources(spark, sf_dir, "js", "web/d{k % 5}/f{k}.ts", _JS)


_JAVA_LINES = ["package p{k % 3};", "import java.util.List;", "import p{(k + 1) % 3}.A{k + 1};", '/* Cipher.getInstance("DES") */', "class A{k} ", "  void make() ", '    Cipher.getInstance("AES/{k % 4}"); // B{k}', "  ", "  A{k + 3} other;"]


def _java(spark, sf_dir) -> DataFrame:
    made = _sources(spark, sf_dir, "java", "java/p{k % 3}/A{k}.java", _JAVA_LINES)
    # Braces of the language stand where the templates could not hold them.
    opened = F.regexp_replace(F.regexp_replace("text", r"(?m)^(class A\d+ |  void make\(\) )$", "$1{"), r"(?m)^  $", "  }")
    return made.withColumn("text", F.concat(opened, F.lit("}\n")))


_SQL_PY = f"""
    p AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 7 THEN p_partkey - 7 ELSE p_partkey + 1000000 END AS back, 'pkg' || p_partkey % 7 || '/mod' || p_partkey || '.py' AS file FROM part),
    i AS (SELECT k, file, 1 AS line, 'import' AS kind, 'hashlib' AS spec, NULL AS target FROM p
      UNION ALL SELECT k, file, 2, 'from', 'pkg' || (k + 1) % 7, 'pkg' || (k + 1) % 7 || '/mod' || (k + 1) || '.py' FROM p
      UNION ALL SELECT k, file, 3, 'relative', '.', 'pkg' || k % 7 || '/mod' || (k + 7) || '.py' FROM p
      UNION ALL SELECT k, file, 4, 'import', 'mod' || back, 'pkg' || k % 7 || '/mod' || back || '.py' FROM p)
"""


@query(f"WITH {_SQL_PY} SELECT file, line, kind, spec FROM i")
def q95_python_imports(spark, sf_dir):
    return imports.read_imports(_python(spark, sf_dir)).select("file", "line", "kind", "spec")


_LIBRARIES = [("python", "hashlib", "hashlib"), ("js", "@s/p1", "scoped"), ("js", "node:fs", "fs"), ("java", "java.util", "jdk")]


def _resolved(spark, files) -> DataFrame:
    known = spark.createDataFrame(_LIBRARIES, "language string, root string, library string")
    return imports.resolved_imports(imports.read_imports(files), files, known)


@query(f"""WITH {_SQL_PY} SELECT i.file, line, coalesce(t.file, '') AS target, CASE WHEN t.file IS NOT NULL THEN 'resolved' WHEN kind = 'relative' THEN 'unresolved' ELSE 'external' END AS resolution,
    CASE WHEN t.file IS NULL AND kind <> 'relative' THEN spec END AS external, CASE WHEN spec = 'hashlib' THEN 'hashlib' END AS crypto_library FROM i LEFT JOIN p t ON t.file = i.target""")
def q96_python_resolution(spark, sf_dir):
    return _resolved(spark, _python(spark, sf_dir)).select("file", "line", F.array_join("targets", ",").alias("target"), "resolution", "external", "crypto_library")


@query(f"""WITH {_SQL_PY}, f AS (SELECT *, CASE k % 2 WHEN 0 THEN 'md5' ELSE 'sha1' END AS fn FROM p) SELECT file, 8 AS line_start, 'hashlib.' || fn AS name, 'C' || k || '.run' AS scope, NULL AS parent, k::VARCHAR AS numbers, '' AS texts, 'h.' || fn || '(x, ' || k || ')' AS evidence FROM f
    UNION ALL SELECT file, 9, 'mod' || back || '.go', 'other', NULL, '1,' || k, 'AES-' || k % 3 || ' # no', 'mod' || back || '.go(''AES-'' ''' || k % 3 || ' # no'', [1, ' || k || '])' FROM f
    UNION ALL SELECT file, 9, 'hashlib.new', 'other', 'sign', '', 'x', 'h.new(''x'')' FROM f""")
def q97_python_calls(spark, sf_dir):
    said = lambda column: F.array_join(F.transform(column, lambda x: x["value"].cast("string")), ",").alias(column if column == "texts" else "numbers")
    return imports.read_calls(_python(spark, sf_dir)).select("file", "line_start", "name", F.array_join("scope", ".").alias("scope"), "parent", said("ints"), said("texts"), "evidence")


_RULES = [("P", "python_call", "hashlib|go$", "lib", None, "name", [], {"sign": "signature"}), ("L", "python_call", r"\.go$", "lib", "x.go", "literal", [(0, None)], {})]
_ENTRIES = [("P", 0, "hashlib.md5", "MD5", "hash", "hashing", 0.9, None), ("P", 1, "hashlib.*", "SHA-1", "hash", "hashing", 0.8, None), ("L", 0, "aes-1*", "AES", "symmetric", "encryption", 0.7, 128), ("L", 1, "*no", "none", "symmetric", "encryption", 0.6, None)]


@query(f"""WITH {_SQL_PY} SELECT file, 8 AS line_start, 'P' AS rule_id, CASE k % 2 WHEN 0 THEN 'MD5' ELSE 'SHA-1' END AS algorithm, 'hashing' AS operation, CASE k % 2 WHEN 0 THEN 'hashlib.md5' ELSE 'hashlib.sha1' END AS api, k::INT AS key_size FROM p
    UNION ALL SELECT file, 9, 'P', 'SHA-1', 'signature', 'hashlib.new', NULL FROM p UNION ALL SELECT file, 9, 'L', CASE k % 3 WHEN 1 THEN 'AES' ELSE 'none' END, 'encryption', 'x.go', CASE k % 3 WHEN 1 THEN 128 ELSE 1 END FROM p""")
def q98_call_matches(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "rule_id string, match_type string, pattern string, library string, api string, value_from string, literal_args array<struct<place: int, keyword: string>>, operation_by_parent map<string, string>")
    entries = spark.createDataFrame(_ENTRIES, "rule_id string, ord int, pattern string, algorithm string, primitive string, operation string, confidence double, key_size int")
    return findings.call_matches(imports.read_calls(_python(spark, sf_dir)), rules, entries).select("file", "line_start", "rule_id", "algorithm", "operation", "api", "key_size")


@query("SELECT 'pkg' || p_partkey % 7 || '/mod' || p_partkey || '.py' AS file, 8 AS line, '# uses it # twice' AS text FROM part")
def q99_python_comments(spark, sf_dir):
    return code.comments(_python(spark, sf_dir))


_SQL_JS = """
    p AS (SELECT p_partkey AS k, 'web/d' || p_partkey % 5 || '/f' || p_partkey || '.ts' AS file FROM part),
    i AS (SELECT file, 1 AS line, './f' || (k + 5) AS spec, 'web/d' || k % 5 || '/f' || (k + 5) || '.ts' AS target, NULL AS root FROM p
      UNION ALL SELECT file, 2, '../d' || (k + 1) % 5 || '/f' || (k + 1) || '.js', 'web/d' || (k + 1) % 5 || '/f' || (k + 1) || '.ts', NULL FROM p
      UNION ALL SELECT file, 3, '@s/p' || k % 3 || '/x', NULL, '@s/p' || k % 3 FROM p UNION ALL SELECT file, 4, 'lib' || k % 4, NULL, 'lib' || k % 4 FROM p UNION ALL SELECT file, 11, 'node:fs', NULL, 'node:fs' FROM p)
"""


@query(f"""WITH {_SQL_JS} SELECT i.file, line, spec, coalesce(t.file, '') AS target, CASE WHEN t.file IS NOT NULL THEN 'resolved' WHEN root IS NULL THEN 'unresolved' ELSE 'external' END AS resolution, root AS external,
    CASE root WHEN '@s/p1' THEN 'scoped' WHEN 'node:fs' THEN 'fs' END AS crypto_library FROM i LEFT JOIN p t ON t.file = i.target""")
def q100_js_resolution(spark, sf_dir):
    return _resolved(spark, _js(spark, sf_dir)).select("file", "line", "spec", F.array_join("targets", ",").alias("target"), "resolution", "external", "crypto_library")


_SQL_JAVA = "p AS (SELECT p_partkey AS k, 'java/p' || p_partkey % 3 || '/A' || p_partkey || '.java' AS file FROM part)"


@query(f"""WITH {_SQL_JAVA} SELECT file, 2 AS line, '' AS target, 'external' AS resolution, 'java.util' AS external, 'jdk' AS crypto_library FROM p
    UNION ALL SELECT p.file, 3, coalesce(t.file, ''), CASE WHEN t.file IS NULL THEN 'external' ELSE 'resolved' END, CASE WHEN t.file IS NULL THEN 'p' || (p.k + 1) % 3 || '.A' || (p.k + 1) END, NULL FROM p LEFT JOIN p t ON t.k = p.k + 1""")
def q101_java_resolution(spark, sf_dir):
    return _resolved(spark, _java(spark, sf_dir)).select("file", "line", F.array_join("targets", ",").alias("target"), "resolution", "external", "crypto_library")


@query(f"WITH {_SQL_JAVA} SELECT p.file, t.file AS target FROM p JOIN p t ON t.k = p.k + 3")
def q102_same_package(spark, sf_dir):
    none = spark.createDataFrame([], "file string, name string")
    return code.same_package(_java(spark, sf_dir), none)


@query(f"WITH {_SQL_JAVA} SELECT file, 7 AS line_start, 'AES/' || k % 4 AS value, 'make' AS scope, CASE WHEN k % 10 IN (3, 7) THEN 'odd' ELSE 'comment' END AS operation FROM p")
def q103_java_matches(spark, sf_dir):
    rules = spark.createDataFrame([("J", "java", "regex", r'Cipher\.getInstance\("([^"]+)', "class A"), ("N", "java", "regex", "Cipher", "absent")], "rule_id string, language string, match_type string, pattern string, file_requires string")
    refine = spark.createDataFrame([("J", 0, 40, r"B\d*[37]\n", "odd"), ("J", 1, 9, "//", "comment"), ("J", 2, 40, "B", "late")], "rule_id string, ord int, window int, pattern string, operation string")
    rows = code.refined(code.regex_matches(_java(spark, sf_dir), rules), refine)
    return rows.select("file", "line_start", "value", F.array_join("scope", ".").alias("scope"), "operation")


@query(f"""WITH {_SQL_JAVA} SELECT file, 4 AS line, '/* Cipher.getInstance("DES") */' AS text FROM p UNION ALL SELECT file, 7, '// B' || k FROM p""")
def q104_java_comments(spark, sf_dir):
    return code.comments(_java(spark, sf_dir))


def _yaml(spark, sf_dir) -> DataFrame:
    rows = files.dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    said = F.concat_ws("\n", F.concat(F.lit("name: "), "c_name"), F.lit("tls:"), F.concat(F.lit("  min: TLSv1."), F.expr("CAST(c_custkey % 4 AS STRING)")), F.concat(F.lit("  suites: [A"), F.col("c_custkey").cast("string"), F.lit(", B]")), F.lit("  list:"), F.concat(F.lit("    - key: "), F.expr("CAST(c_custkey % 2 AS STRING)")), F.lit(""))
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".yaml")).alias("path"), F.lit("yaml").alias("kind"), said.alias("text"))


@query("""SELECT 'c' || c_custkey || '.yaml' AS file, v.key_path, v.key, v.value, v.line FROM customer, LATERAL (SELECT unnest([{'key_path': 'name', 'key': 'name', 'value': c_name, 'line': 1}, {'key_path': 'tls.min', 'key': 'min', 'value': 'TLSv1.' || c_custkey % 4, 'line': 3},
    {'key_path': 'tls.suites', 'key': 'suites', 'value': 'A' || c_custkey, 'line': 4}, {'key_path': 'tls.suites', 'key': 'suites', 'value': 'B', 'line': 4}, {'key_path': 'tls.list.key', 'key': 'key', 'value': (c_custkey % 2)::VARCHAR, 'line': 6}]) AS v)""")
def q105_yaml_values(spark, sf_dir):
    return structured.read_values(_yaml(spark, sf_dir)).drop("error")


@query("""SELECT 'c' || c_custkey || '.yaml' AS file, 3 AS line, CASE c_custkey % 4 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.1' ELSE 'TLS' END AS algorithm, 'min: TLSv1.' || c_custkey % 4 AS evidence FROM customer""")
def q106_structured_matches(spark, sf_dir):
    rules = spark.createDataFrame([("S", "structured", "^(min|max)$", "tls", None)], "rule_id string, match_type string, pattern string, library string, api string")
    entries = spark.createDataFrame([("S", 0, "tlsv1.0", "TLS 1.0"), ("S", 1, "TLSv1.1", "TLS 1.1"), ("S", 2, "tls*", "TLS")], "rule_id string, ord int, pattern string, algorithm string")
    return structured.structured_matches(structured.read_values(_yaml(spark, sf_dir)), rules, entries).select("file", "line", "algorithm", "evidence")


@query("""SELECT 's' || s_suppkey AS root, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS service, CASE s_suppkey % 3 WHEN 0 THEN 'regulated' WHEN 1 THEN 'public' END AS data_classification, CASE WHEN s_suppkey % 2 = 0 THEN true END AS internet_exposed,
    CASE WHEN s_suppkey % 400 <= 200 THEN (s_suppkey % 400)::INT END AS data_lifetime_years, 'business_criticality' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '' END AS missing,
    array_to_string(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'service' END, 'owner', CASE WHEN s_suppkey % 3 = 2 THEN 'data_classification' END, CASE WHEN s_suppkey % 2 = 1 THEN 'internet_exposed' END, CASE WHEN s_suppkey % 400 > 200 THEN 'data_lifetime_years' END], lambda x: x IS NOT NULL), ',') AS invalid FROM supplier""")
def q107_services(spark, sf_dir):
    k = F.col("s_suppkey")
    said = F.concat_ws("\n", F.concat(F.lit("service: '"), F.when(k % 5 != 0, F.col("s_name")).otherwise(""), F.lit(" '")), F.lit("owner: null"), F.concat(F.lit("data_classification: "), F.when(k % 3 == 0, " Regulated").when(k % 3 == 1, "PUBLIC").otherwise("odd")), F.concat(F.lit("internet_exposed: "), F.when(k % 2 == 0, "yes").otherwise("'yes'")), F.concat(F.lit("data_lifetime_years: "), (k % 400).cast("string")))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.lit("/service.yaml")).alias("path"), F.length(said).cast("long").alias("size"), said.alias("text"))
    return metadata.read_services(files).select("root", "service", "data_classification", "internet_exposed", "data_lifetime_years", F.array_join("missing_fields", ",").alias("missing"), F.array_join("invalid_fields", ",").alias("invalid"))


@query(f"WITH {_SQL_PY}, e AS (SELECT i.file AS source, t.file AS target FROM i JOIN p t ON t.file = i.target) SELECT source, target, count(*) AS n FROM e GROUP BY ALL")
def q108_import_edges(spark, sf_dir):
    return graph.import_edges(_resolved(spark, _python(spark, sf_dir))).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""SELECT 'svc' || p_partkey % 50 || '/' || p_partkey || '.pem' AS file, 1 AS line, 'pem_private_key' AS kind FROM part WHERE p_partkey % 3 = 0""")
def q109_private_keys(spark, sf_dir):
    key = F.col("p_partkey")
    body = F.concat_ws("\n", F.when(key % 3 == 0, "-----BEGIN EC PRIVATE KEY-----").otherwise("-----BEGIN PUBLIC KEY-----"), F.sha2(key.cast("string"), 256), F.when(key % 3 == 0, "-----END EC PRIVATE KEY-----").otherwise("-----END PUBLIC KEY-----"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("svc"), (key % 50).cast("string"), F.lit("/"), key.cast("string"), F.lit(".pem")).alias("file"), F.posexplode(F.split(body, "\n")).alias("at", "text"))
    hidden = code.without_private_keys(rows.select("file", (F.col("at") + 1).alias("line"), "text")).where(F.col("text") == T.REDACTED)
    return hidden.select("file", (F.col("line") - 1).alias("line"), F.lit("pem_private_key").alias("kind"))


# Calls over several lines, with brackets in strings, comments, templates and patterns, and some that never close.
_CALLS = {
    "java": [
        "class A{k} {", "  void m() {", "    seal({k}, // first ) of {k}", "      \"a ) b ( {k % 3}\", f({k % 5}, g()), /* ) */", "      h());", "    after();",
        "    seal(\"{k}\"); seal(')', '(', {k % 7});", "    seal({k}, {repeat('x, ', 80)}", "    never);", "  }", "}",
    ],
    "js": ["function m{k}() {", "  seal({k}, `t ) ${n(`u ) `, {k % 4})} (`,", "    /[)(]/.test(x), // )", "    {k % 9})", "  seal(", "  )", "}"],
}


def _called(spark, sf_dir, kind: str, source: str, key: str) -> DataFrame:
    lines = [line.replace("${n(", "$\x01n(").replace(")} (`", ")\x02 (`") if kind == "js" else line for line in _CALLS[kind]]
    lines = [line[:-1] + "\x01" if line.endswith("{") else "\x02" if line.strip() == "}" else line for line in lines]
    rows = _sources(spark, sf_dir, kind, f"{kind}/f{{k}}.x", lines, source, key)
    return rows.withColumn("text", F.translate("text", "\x01\x02", "{}"))


_SEAL = "concat('seal(', k, ', // first ) of ', k, ' \"a ) b ( ', k % 3, '\", f(', k % 5, ', g()), /* ) */ h())')"


@query(f"""WITH j AS (SELECT p_partkey AS k FROM part), c AS (SELECT s_suppkey AS k FROM supplier)
    SELECT 'java/f' || k || '.x' AS file, 3 AS line_start, 5 AS line_end, {_SEAL} AS evidence FROM j
    UNION ALL SELECT 'java/f' || k || '.x', 7, 7, 'seal("' || k || '")' FROM j UNION ALL SELECT 'java/f' || k || '.x', 7, 7, 'seal('')'', ''('', ' || k % 7 || ')' FROM j UNION ALL SELECT 'java/f' || k || '.x', 8, 8, 'seal(' FROM j
    UNION ALL SELECT 'js/f' || k || '.x', 2, 4, 'seal(' || k || ', `t ) ${{n(`u ) `, ' || k % 4 || ')}} (`, /[)(]/.test(x), // ) ' || k % 9 || ')' FROM c UNION ALL SELECT 'js/f' || k || '.x', 5, 6, 'seal( )' FROM c""")
def q111_call_ends(spark, sf_dir):
    rules = spark.createDataFrame([("S", kind, "regex", r"\bseal\(") for kind in ("java", "js")], "rule_id string, language string, match_type string, pattern string")
    files = _called(spark, sf_dir, "java", "part", "p_partkey").unionByName(_called(spark, sf_dir, "js", "supplier", "s_suppkey"))
    return code.regex_matches(files, rules).select("file", "line_start", "line_end", T.evidence(F.col("call")).alias("evidence"))


# A tree of three scans: configuration, Python, Java, folders that aren't read, files that can't be, and services.
_rule = lambda id_, language, match_type, pattern, algorithm, primitive, operation, **more: {"rule_id": id_, "rule_version": "1.0.0", "language": language, "match_type": match_type, "pattern": pattern, "algorithm": algorithm, "primitive": primitive, "operation": operation, "confidence": 0.95} | more
_PACK = {
    "tls": _rule("CFG-NGINX-TLS-001", "config", "directive", r"^\s*ssl_protocols\s+([^;]+)", "TLS", "protocol", "config", library="nginx", file_pattern=r"\.conf$", split=r"\s+", value_map={"TLSv1": "TLS 1.0"}),
    "suites": _rule("CFG-SUITES-001", "config", "directive", r"^\s*ssl_ciphers\s+([^;]+)", "ECDH", "public-key", "key_agreement", library="nginx", file_pattern=r"\.conf$", split=":", skip_prefixes=["!"], value_map={"ecdhe-*": "ECDH", "dhe-*": "DH"}),
    "calls": _rule("PY-CALLS-001", "python", "python_call", r"(generate_private_key|hashlib\.)", "RSA", "public-key", "key_generation", library="cryptography", value_map={"*rsa.generate_private_key": "RSA", "hashlib.md5": {"algorithm": "MD5", "primitive": "hash", "operation": "hashing"}}),
    "seal": _rule("JAVA-SEAL-001", "java", "regex", r"\bseal\(", "AES", "symmetric", "encryption", confidence=0.6),
}
_FILES = (  # (remainder of k by 6, path, lines)
    (0, "conf/site{k}.conf", ["server <", "  ssl_protocols TLSv1 TLSv1.2;  # TLSv1 too", "  ssl_ciphers ECDHE-RSA-{k}:!DHE-X:DHE-RSA;", ">"]),
    (1, "app{k % 5}/m{k}.py", ["from cryptography.hazmat.primitives.asymmetric import rsa", "import hashlib", "", "key = rsa.generate_private_key(65537, {1024 * (1 + k % 2)})", "hashlib.md5(b'{k}')", "rsa.other()"]),
    (2, "app{k % 5}/A{k}.java", ["class A{k} <", "  void make() <", "    seal(", "      {k}, \")\");", "  >", "  // seal(2)", ">"]),
    (3, "node_modules/p{k}/x.py", ["import hashlib", "hashlib.md5()"]),
    (4, "app{k % 5}/notes{k}.bin", ["seal(1)"]),
    (5, "app{k % 5}/wide{k}.js", ["var x = '{repeat('y', 12000)}'"]),
)


def _tree(spark, sf_dir) -> DataFrame:
    keys = files.dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")))
    # One pass over the keys: each takes the path and the text of its remainder.
    chosen = lambda made: F.coalesce(*[F.when(F.col("k") % 6 == rest, made(path, lines)) for rest, path, lines in _FILES])
    made = keys.where("k % 6 >= 0").select(F.concat(F.lit("scan"), F.col("k") % 3).alias("scan_id"), chosen(lambda path, _: _made(path)).alias("path"), F.translate(chosen(lambda _, lines: _made_text(lines)), "<>", "{}").alias("text"))
    named = table(spark, sf_dir, "part").select(F.concat(F.lit("scan"), F.col("p_partkey") % 3).alias("scan_id"), (F.col("p_partkey") % 5).alias("a")).where("a < 4").distinct()
    said = F.concat(F.lit("service: shop"), "a", F.lit("\nowner: team\ndata_classification: sensitive\nbusiness_criticality: high\ninternet_exposed: true\ndata_lifetime_years: 12\n"))
    tree = made.unionByName(named.select("scan_id", F.concat(F.lit("app"), "a", F.lit("/service.yaml")).alias("path"), said.alias("text")))
    return tree.select("scan_id", "path", F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))


_SQL_TREE = """p AS (SELECT p_partkey AS k, 'scan' || p_partkey % 3 AS scan_id, p_partkey % 5 AS a FROM part),
    w AS (
      SELECT scan_id, 'conf/site' || k || '.conf' AS file, 2 AS line_start, 2 AS line_end, 'CFG-NGINX-TLS-001' AS rule_id, 'TLS 1.0' AS algorithm, 'repo' AS service, NULL AS key_size, 0.95 AS confidence FROM p WHERE k % 6 = 0
      UNION ALL SELECT scan_id, 'conf/site' || k || '.conf', 3, 3, 'CFG-SUITES-001', unnest(['ECDH', 'DH']), 'repo', NULL, 0.95 FROM p WHERE k % 6 = 0
      UNION ALL SELECT scan_id, 'app' || a || '/m' || k || '.py', 4, 4, 'PY-CALLS-001', 'RSA', CASE WHEN a < 4 THEN 'shop' || a ELSE 'repo' END, 1024 * (1 + k % 2), 0.95 FROM p WHERE k % 6 = 1
      UNION ALL SELECT scan_id, 'app' || a || '/m' || k || '.py', 5, 5, 'PY-CALLS-001', 'MD5', CASE WHEN a < 4 THEN 'shop' || a ELSE 'repo' END, NULL, 0.95 FROM p WHERE k % 6 = 1
      UNION ALL SELECT scan_id, 'app' || a || '/A' || k || '.java', 3, 4, 'JAVA-SEAL-001', 'AES', CASE WHEN a < 4 THEN 'shop' || a ELSE 'repo' END, NULL, 0.6 FROM p WHERE k % 6 = 2)"""


def _whole_scan(spark, sf_dir) -> DataFrame:
    return scan.scan(_tree(spark, sf_dir), *metadata.rule_tables(spark, _PACK), "repo")


@query(f"""WITH {_SQL_TREE} SELECT scan_id, printf('CRYPTO-%03d', row_number() OVER (PARTITION BY scan_id ORDER BY file, line_start, line_end, rule_id, algorithm)) AS id, file, line_start, line_end, rule_id, algorithm, service, CAST(key_size AS INTEGER) AS key_size, CAST(confidence AS DOUBLE) AS confidence FROM w""")
def q122_whole_scan(spark, sf_dir):
    return _whole_scan(spark, sf_dir).select("scan_id", "id", "file", "line_start", "line_end", "rule_id", "algorithm", "service", "key_size", "confidence")


@query(f"""WITH {_SQL_TREE}, s AS (SELECT *, CASE algorithm WHEN 'DH' THEN 4 WHEN 'ECDH' THEN 4 WHEN 'RSA' THEN 4 WHEN 'MD5' THEN 1 WHEN 'TLS 1.0' THEN 1 ELSE 0 END AS qe, service <> 'repo' AS known FROM w)
    SELECT scan_id, service, algorithm, count(*) AS findings, count(*) FILTER (algorithm IN ('DH', 'ECDH', 'RSA')) AS vulnerable, min(line_start) AS first_line FROM s GROUP BY scan_id, service, algorithm""")
def q123_scans_by_service(spark, sf_dir):
    rows = _whole_scan(spark, sf_dir)
    return rows.groupBy("scan_id", "service", "algorithm").agg(F.count("*").alias("findings"), F.count_if("quantum_vulnerable").alias("vulnerable"), F.min("line_start").alias("first_line"))


_SQL_SKIPS = "k AS (SELECT p_partkey AS k FROM part), sv AS (SELECT count(*) AS n FROM (SELECT DISTINCT p_partkey % 3, p_partkey % 5 FROM part WHERE p_partkey % 5 < 4))"


@query(f"""WITH {_SQL_SKIPS} SELECT 'all' AS scan_id, (SELECT count(*) FROM k) + sv.n AS files, 'minified ' || count(*) FILTER (k % 6 = 5) || ', unsupported ' || count(*) FILTER (k % 6 = 4) || ', vendored ' || count(*) FILTER (k % 6 = 3) AS skipped, 'shop0, shop1, shop2, shop3' AS services FROM k, sv GROUP BY sv.n""")
def q124_manifest(spark, sf_dir):
    assessed = files.assessed(_tree(spark, sf_dir).drop("scan_id"))
    row = coverage.manifest(assessed, metadata.read_services(assessed.select("path", "size", "text")), "all")
    return row.select("scan_id", "files", F.array_join(F.transform("skipped", lambda s: F.concat(s["reason"], F.lit(" "), s["n"].cast("string"))), ", ").alias("skipped"), F.array_join("services", ", ").alias("services"))


@query("SELECT 'minified' AS reason, count(*) AS n, 'lines too long to read' AS meaning FROM part WHERE p_partkey % 6 = 5")
def q125_warnings(spark, sf_dir):
    return coverage.warnings(files.assessed(_tree(spark, sf_dir).drop("scan_id")))
