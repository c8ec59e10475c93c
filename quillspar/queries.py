"""The library's operators on the given tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions import scoring as S
from quillspar.functions import text as T
from quillspar.operators import aggregates as A
from quillspar.operators import matching as M
from quillspar.operators.closure import induced, reverse_closure, two_tier_closure
from quillspar.operators.order import labelled, numbered, top_per_group, truncated
from quillspar.plans.coverage import evaluated
from quillspar.plans.findings import directive_matches, first_mentions
from quillspar.plans.graph import impact_summary
from quillspar.plans.inventory import searched
from quillspar.registry import QUERIES, SQL, Query, query
from quillspar.registry import table as _t
from quillspar.session import Workspace
from quillspar.sources.files import assessed
from quillspar.streaming.limits import expired, limited, orphans, sliding_counts, windowed_counts

def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def _sql_values(rows: list[tuple]) -> str:
    say = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


# ---- text and paths


@query("""
    SELECT page_id, CASE WHEN ext IN ('py', 'pyw') THEN 'python' WHEN ext = 'java' THEN 'java' WHEN ext IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') THEN 'js'
           WHEN ext IN ('md', 'rst', 'txt') THEN 'doc' WHEN ext IN ('pem', 'crt', 'cer', 'cert') THEN 'pem' WHEN ext = 'json' THEN 'json'
           WHEN ext IN ('yaml', 'yml') THEN 'yaml' WHEN ext IN ('conf', 'dockerfile') OR base IN ('dockerfile', 'sshd_config', 'ssh_config', 'jenkinsfile') OR starts_with(base, 'dockerfile.') THEN 'text' ELSE 'none' END AS kind
    FROM (SELECT page_id, base, regexp_extract(base, '[^.]\\.([^.]+)$', 1) AS ext FROM (SELECT page_id, lower(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1]) AS base FROM pages))
""".replace("\\\\", "\\"))
def q01_classify(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return _t(spark, sf_dir, "pages").select("page_id", F.coalesce(T.classify(path), F.lit("none")).alias("kind"))


_GLOBS = [(0, "*a1*", "first"), (1, "part*", "part"), (2, "*9", "nine"), (3, "Part 1 2", "spaced"), (4, "", "empty"), (5, "*", "any")]


@query(f"""
    WITH rules(ord, pattern, label) AS (VALUES {_sql_values(_GLOBS)}),
    r AS (SELECT ord, label, regexp_replace(lower(pattern), '\\s+', '', 'g') AS p FROM rules),
    v AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), '\\s+', '', 'g') AS k FROM part)
    SELECT p_partkey, p_name, arg_min(label, ord) AS label FROM v JOIN r ON CASE
      WHEN p = '*' THEN true WHEN p LIKE '*%*' THEN contains(k, trim(p, '*')) WHEN p LIKE '%*' THEN starts_with(k, trim(p, '*'))
      WHEN p LIKE '*%' THEN ends_with(k, trim(p, '*')) ELSE k = p END
    GROUP BY p_partkey, p_name
""")
def q02_ordered_glob(spark, sf_dir):
    return M.first_glob(_t(spark, sf_dir, "part"), "p_name", ["p_partkey"], _values(spark, "ord int, pattern string, label string", _GLOBS))


_PREFIXES = [(0, "", "all"), (1, "http:", "scheme"), (2, "http:/", "slash")] + [(3 + i, f"http://{h}.example.{t}", f"{h}.{t}") for i, (h, t) in enumerate([("the", "com"), ("of", "net"), ("and", "org"), ("der", "com")])]


@query(f"""
    WITH p(ord, prefix, owner) AS (VALUES {_sql_values(_PREFIXES)})
    SELECT page_id, url, arg_max(owner, length(prefix)) AS owner
    FROM pages JOIN p ON prefix = '' OR url = prefix OR starts_with(url, prefix || '/') GROUP BY page_id, url
""")
def q03_longest_prefix(spark, sf_dir):
    prefixes = _values(spark, "ord int, prefix string, owner string", _PREFIXES)
    return M.longest_prefix(_t(spark, sf_dir, "pages").select("page_id", "url"), "url", prefixes, "prefix", ["owner"])


def _customers(spark, sf_dir) -> DataFrame:
    """Customers with factors: sensitivity by segment, exposure by nation, criticality by balance, complexity by orders."""
    orders = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    c = _t(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    ds = S._lookup({"BUILDING": 0.0, "AUTOMOBILE": 1.0, "MACHINERY": 3.0, "HOUSEHOLD": 4.0}, F.col("c_mktsegment"))
    ie = F.when(F.col("c_nationkey") % 5 == 0, None).when(F.col("c_nationkey") % 2 == 0, 3.0).otherwise(0.0)
    bc = F.when(F.col("c_acctbal") < 0, 0.0).when(F.col("c_acctbal") < 3000, 1.0).when(F.col("c_acctbal") < 7000, 2.0).otherwise(3.0)
    mc = F.least(F.coalesce("n_orders", F.lit(0)) % 4, F.lit(3)).cast("double")
    qe = (F.col("c_custkey") % 5).cast("double")
    c = c.withColumns({"qe": qe, "ds": F.coalesce(ds, F.lit(2.0)), "ie": F.coalesce(ie, F.lit(1.5)), "bc": bc, "mc": mc})
    raw, points = S.priority(F.col("qe"), F.col("ds"), F.col("ie"), F.col("bc"), F.col("mc"))
    c = c.withColumns({"raw": raw, "qmp": points.cast("long"), "uncapped": S.band(points)})
    return c.withColumn("band", S.capped(F.col("uncapped"), F.col("qe"), F.col("c_custkey") % 7 != 0))


_CUSTOMERS = """
    o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
    f AS (SELECT c.*, (c_custkey % 5)::DOUBLE AS qe,
                 coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'AUTOMOBILE' THEN 1.0 WHEN 'MACHINERY' THEN 3.0 WHEN 'HOUSEHOLD' THEN 4.0 END, 2.0)::DOUBLE AS ds,
                 CASE WHEN c_nationkey % 5 = 0 THEN 1.5 WHEN c_nationkey % 2 = 0 THEN 3.0 ELSE 0.0 END::DOUBLE AS ie,
                 CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal < 3000 THEN 1.0 WHEN c_acctbal < 7000 THEN 2.0 ELSE 3.0 END::DOUBLE AS bc,
                 least(coalesce(n, 0) % 4, 3)::DOUBLE AS mc
          FROM customer c LEFT JOIN o ON o_custkey = c_custkey),
    g AS (SELECT *, qe * 2 + ds * 2 + ie * 1.5 + bc * 1.5 - mc * 1.5 AS raw FROM f),
    h AS (SELECT *, greatest(0, least(20, floor(raw + 0.5)))::BIGINT AS qmp FROM g),
    i AS (SELECT *, CASE WHEN qmp <= 3 THEN 'Informational' WHEN qmp <= 9 THEN 'Review' WHEN qmp <= 14 THEN 'High' ELSE 'Critical' END AS uncapped FROM h),
    scored AS (SELECT *, CASE WHEN qe = 0 THEN 'Informational' WHEN uncapped IN ('High', 'Critical') AND (qe = 1 OR c_custkey % 7 = 0) THEN 'Review' ELSE uncapped END AS band FROM i)
"""


@query(f"WITH {_CUSTOMERS} SELECT c_custkey, raw, qmp, uncapped, band FROM scored")
def q04_score_bands(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", "raw", "qmp", "uncapped", "band")


@query(f"""
    WITH {_CUSTOMERS} SELECT c_custkey, band, qmp, row_number() OVER (ORDER BY
      CASE band WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Review' THEN 1 ELSE 0 END DESC, qmp DESC, raw DESC, qe DESC, c_custkey) AS rank FROM scored
""")
def q05_priority_rank(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    order = [S.band_rank(F.col("band")).desc(), F.col("qmp").desc(), F.col("raw").desc(), F.col("qe").desc(), F.col("c_custkey").asc()]
    return numbered(rows.select("c_custkey", "band", "qmp", "raw", "qe"), order).select("c_custkey", "band", "qmp", "rank")


@query("""
    SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity > 40) AS large, count(*) FILTER (l_discount = 0) AS undiscounted,
           count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.04) AS open_taxed, count(DISTINCT l_suppkey) AS suppliers FROM lineitem
""")
def q06_conditional_totals(spark, sf_dir):
    c = F.col
    tests = {"returned": c("l_returnflag") == "R", "large": c("l_quantity") > 40, "undiscounted": c("l_discount") == 0, "open_taxed": (c("l_linestatus") == "O") & (c("l_tax") > 0.04)}
    return A.conditional_totals(_t(spark, sf_dir, "lineitem"), tests, {"suppliers": "l_suppkey"})


@query(f"""
    WITH {_CUSTOMERS}, d(band) AS (VALUES ('Critical'), ('High'), ('Review'), ('Informational'), ('None')), s AS (SELECT DISTINCT c_mktsegment FROM scored)
    SELECT s.c_mktsegment, d.band, count(x.c_custkey) AS n FROM s CROSS JOIN d LEFT JOIN scored x ON x.band = d.band AND x.c_mktsegment = s.c_mktsegment GROUP BY ALL
""")
def q07_closed_histogram(spark, sf_dir):
    return A.closed_histogram(_customers(spark, sf_dir), "band", ["Critical", "High", "Review", "Informational", "None"], ["c_mktsegment"])


@query("""
    SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(DISTINCT l_partkey) AS parts,
           sum(l_quantity)::DOUBLE AS quantity, max(l_discount) AS discount,
           CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'none' WHEN count(*) FILTER (l_linestatus = 'O') > count(*) FILTER (l_returnflag = 'R') THEN 'in progress' ELSE 'not started' END AS status
    FROM lineitem GROUP BY l_suppkey
""")
def q08_group_measures(spark, sf_dir):
    c = F.col
    sums = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(c("l_returnflag") == "R").alias("returned"), F.count_if(c("l_linestatus") == "O").alias("open"),
        F.count_distinct("l_partkey").alias("parts"), F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"),
    )
    return sums.withColumn("status", F.when(c("returned") == 0, "none").when(c("open") > c("returned"), "in progress").otherwise("not started"))


@query("""
    SELECT DISTINCT facet, value FROM (SELECT unnest([{'facet': 'lang', 'value': lang}, {'facet': 'source', 'value': source}], recursive := true) FROM documents) WHERE value IS NOT NULL AND value <> ''
""")
def q09_facets(spark, sf_dir):
    return A.facets(_t(spark, sf_dir, "documents"), ["lang", "source"])


@query("""
    SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), lower('The AND'))
""")
def q10_filter_search(spark, sf_dir):
    return searched(_t(spark, sf_dir, "documents"), "The AND", ["lang", "source", "text"]).select("doc_id", "lang", "source")


@query(r"SELECT doc_id, CASE WHEN left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END AS cell FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '=' || text WHEN 1 THEN chr(9) || text WHEN 2 THEN '@' ELSE text END AS text FROM documents)")
def q11_csv_guard(spark, sf_dir):
    cell = F.expr("CASE doc_id % 7 WHEN 0 THEN concat('=', text) WHEN 1 THEN concat(chr(9), text) WHEN 2 THEN '@' ELSE text END")
    return _t(spark, sf_dir, "documents").select("doc_id", T.csv_safe(cell).alias("cell"))


# The shapes of secrets, written for SQL from their public descriptions: key ids of 20 letters, tokens with their prefixes, JSON web tokens.
_SQL_SHAPES = {
    "aws_access_key_id": r"\bA(?:KIA|SIA)[A-Z0-9]{16}\b",
    "github_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[0-9a-zA-Z]{36,}\b",
    "slack_token": r"\bxox(?:a|b|p|r|s)-[-0-9a-zA-Z]{10,}",
    "google_api_key": r"\bAIza[-_0-9a-zA-Z]{35}\b",
    "stripe_key": r"\b(?:sk|rk)_(?:test|live)_[a-zA-Z0-9]{16,}\b",
    "jwt": r"\beyJ[-_0-9a-zA-Z]{5,}[.]eyJ[-_0-9a-zA-Z]{5,}[.][-_0-9a-zA-Z]*",
}
_SQL_NAMED = r"(?:api[-_]?key|secret[-_]?key|secret|access[-_]?key|auth[-_]?token|token|password|passwd|pwd)"
_SQL_ASSIGNED = rf"""(?i)\b{_SQL_NAMED}\b[''"]?\s*[=:]\s*(?:"[^\s''"\\]{{8,}}"|''[^\s''"\\]{{8,}}'')"""
_SQL_REDACTED = rf"""regexp_replace(regexp_replace(text, '(?i)(\b{_SQL_NAMED}\b[''"]?\s*[=:]\s*)"[^\s''"\\]{{8,}}"', '\1"[REDACTED]"', 'g'), '(?i)(\b{_SQL_NAMED}\b[''"]?\s*[=:]\s*)''[^\s''"\\]{{8,}}''', '\1''[REDACTED]''', 'g')"""
for _shape in _SQL_SHAPES.values():
    _SQL_REDACTED = f"regexp_replace({_SQL_REDACTED}, '{_shape}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({_SQL_REDACTED}) AS redacted_sha256, {_SQL_REDACTED} <> text AS changed FROM documents")
def q12_redact(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "text", T.redacted(F.col("text")).alias("redacted"))
    return rows.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), (F.col("redacted") != F.col("text")).alias("changed"))


_SQL_LINES = "SELECT doc_id, i::BIGINT AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def _lines(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text")


@query(f"""
    WITH l AS ({_SQL_LINES}), k AS ({" UNION ALL ".join(f"SELECT doc_id, line, '{kind}' AS kind FROM l WHERE regexp_matches(text, '{p}')" for kind, p in _SQL_SHAPES.items())}
      UNION ALL SELECT doc_id, line, 'credential_assignment' FROM l WHERE regexp_matches(text, '{_SQL_ASSIGNED}'))
    SELECT doc_id, line, kind FROM k
""")
def q13_secret_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", F.explode(T.secret_kinds(F.col("text"))).alias("kind"))


_MENTIONS = [(o, f"(?i)(?:^|[^a-z])(?:{w})(?:[^a-z]|$)", a) for o, w, a in [(0, "license", "license"), (1, "token", "token"), (2, "mit|apache", "license"), (3, "the", "article")]]


@query(f"""
    WITH l AS ({_SQL_LINES}), m(ord, pattern, algorithm) AS (VALUES {_sql_values(_MENTIONS)})
    SELECT doc_id, line, algorithm, min(ord)::INTEGER AS first_pattern FROM l JOIN m ON regexp_matches(text, pattern) WHERE trim(text) <> '' GROUP BY ALL
""")
def q14_mentions(spark, sf_dir):
    rows = _lines(spark, sf_dir).where(F.trim("text") != "")
    return first_mentions(rows, _values(spark, "ord int, pattern string, algorithm string", _MENTIONS)).select("doc_id", "line", "algorithm", "first_pattern")


_VALUES = [("D", 0, "mit*", "permissive"), ("D", 1, "*ed", "past"), ("D", 2, "*a*", "with a"), ("D", 3, "*", "other")]


@query(rf"""
    WITH l AS ({_SQL_LINES}), c AS (SELECT doc_id, line, regexp_replace(text, '(^|\s)#.*$', '\1') AS text FROM l WHERE length(text) <= 10000),
    v AS (SELECT doc_id, line, trim(unnest(string_split(regexp_extract(text, '^[ \t]*([A-Za-z]+(?:[ ,]+[A-Za-z]+)*)', 1), ' ')), chr(39) || '";+^ ' || chr(9)) AS value FROM c WHERE regexp_matches(text, '^[ \t]*([A-Za-z]+(?:[ ,]+[A-Za-z]+)*)'))
    SELECT doc_id, line, value, CASE WHEN starts_with(lower(value), 'mit') THEN 'permissive' WHEN ends_with(lower(value), 'ed') THEN 'past' WHEN contains(lower(value), 'a') THEN 'with a' ELSE 'other' END AS algorithm, count(*) AS n
    FROM v WHERE value <> '' AND NOT starts_with(value, 'th') GROUP BY ALL
""")
def q15_directive_values(spark, sf_dir):
    return _directive_values(spark, _t(spark, sf_dir, "documents"))


def _directive_values(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Values by document and line; only documents that share their id with another are brought together."""
    rules = _values(spark, "rule_id string, match_type string, pattern string, file_pattern string, split string, skip_prefixes array<string>, library string, api string", [("D", "directive", r"^[ \t]*([A-Za-z]+(?:[ ,]+[A-Za-z]+)*)", r"\.conf$", " ", ["th"], None, None)])
    entries = _values(spark, "rule_id string, ord int, pattern string, algorithm string", _VALUES)

    def found(rows: DataFrame) -> DataFrame:
        files = rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".conf")).alias("path"), "text")
        hits = directive_matches(files, rules, entries, counted=True)
        return hits.select(F.regexp_extract("file", r"^\d+", 0).cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "value", "algorithm", F.col("n").cast("long").alias("n"))

    shared = Workspace(spark).write(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        return found(docs)
    several = found(docs.join(shared, "doc_id", "left_semi"))
    together = several.groupBy("doc_id", "line", "value", "algorithm").agg(F.sum("n").alias("n"))
    return found(docs.join(shared, "doc_id", "left_anti")).unionByName(together)


@query(r"""
    SELECT doc_id, CASE WHEN length(c) > 300 THEN substr(c, 1, 299) || '…' ELSE c END AS evidence
    FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS c FROM documents)
""")
def q16_evidence(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.evidence(F.col("text")).alias("evidence"))


@query("SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 10000 AS minified FROM documents")
def q17_minified(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.longest_line(F.col("text")).cast("long").alias("longest"), T.minified(F.col("text")).alias("minified"))


_SQL_KIND = "CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'md' WHEN 2 THEN 'bin' WHEN 3 THEN 'java' WHEN 4 THEN 'json' ELSE 'ts' END"


@query(f"""
    WITH d AS (SELECT doc_id, text, {_SQL_KIND} AS ext, doc_id % 11 = 0 AS vendored, doc_id % 13 = 0 AS bin FROM documents),
    r AS (SELECT doc_id, ext, vendored, bin, text, {_SQL_REDACTED} AS kept, list_max(list_transform(string_split({_SQL_REDACTED}, chr(10)), lambda x: length(x))) AS longest, strlen(text) + bin::INT AS size FROM d)
    SELECT doc_id, CASE ext WHEN 'py' THEN 'python' WHEN 'md' THEN 'doc' WHEN 'bin' THEN NULL WHEN 'java' THEN 'java' WHEN 'json' THEN 'json' ELSE 'js' END AS kind,
           CASE WHEN vendored THEN 'vendored' WHEN ext = 'bin' THEN 'unsupported' WHEN size > 5242880 OR (ext = 'json' AND size > 1048576) THEN 'too_large' WHEN bin THEN 'binary' WHEN ext IN ('py', 'java', 'ts') AND longest > 10000 THEN 'minified' END AS skip,
           CASE WHEN ext = 'bin' OR bin THEN NULL ELSE sha256(kept) END AS sha256 FROM r
""")
def q18_assessed_files(spark, sf_dir):
    ext = F.expr(_SQL_KIND)
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "a/node_modules/").otherwise("a/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    content = F.concat(F.when(F.col("doc_id") % 13 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.col("text").cast("binary"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))
    return assessed(rows).select("doc_id", "kind", "skip", F.when(F.col("text").isNotNull(), F.col("sha256")).alias("sha256"))


@query(f"""
    WITH l AS ({_SQL_LINES}), f AS (SELECT doc_id, line FROM l WHERE contains(lower(text), 'license'))
    SELECT f.doc_id, f.line, greatest(1, f.line - 3) AS start_line, string_agg(l.text, chr(10) ORDER BY l.line) AS snippet
    FROM f JOIN l ON l.doc_id = f.doc_id AND l.line BETWEEN f.line - 3 AND f.line + 3 GROUP BY f.doc_id, f.line
""")
def q19_snippet(spark, sf_dir):
    said = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.contains(F.lower(x), F.lit("license")), i + 1))
    rows = _t(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.filter(said, lambda i: i.isNotNull())).alias("line"))
    return M.snippet(rows, "text", "line").select("doc_id", F.col("line").cast("long"), F.col("start_line").cast("long"), "snippet")


@query("""
    SELECT event_id, user_id, last_signup FROM (SELECT event_id, user_id, event_type,
      last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events)
    WHERE event_type = 'purchase'
""")
def q20_scope_asof(spark, sf_dir):
    events = M.last_before(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "last_signup")
    return events.where("event_type = 'purchase'").select("event_id", "user_id", "last_signup")


@query(r"""
    WITH p AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages),
    t AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM p), e AS (SELECT DISTINCT path, array_to_string(s[i:], '/') AS suffix FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS i FROM t)),
    w AS (SELECT page_id, string_split(path, '/')[-1] AS wanted FROM p),
    n AS (SELECT suffix, count(*) AS n_targets, min(path) AS target FROM e GROUP BY suffix)
    SELECT page_id, wanted, coalesce(n_targets, 0) AS n_targets, target, CASE WHEN n_targets IS NULL THEN 'unresolved' WHEN n_targets = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution
    FROM w LEFT JOIN n ON suffix = wanted
""")
def q21_suffix(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    pages = _t(spark, sf_dir, "pages").select("page_id", path.alias("path")).distinct()
    return M.by_suffix(pages.withColumn("wanted", F.element_at(F.split("path", "/"), -1)), "wanted", ["page_id"], pages.select("path").distinct(), "path")


@query("""
    WITH c AS (SELECT p_partkey, unnest([upper(p_name), replace(p_name, ' ', '_'), p_name || 'x', p_name, lower(p_name)]) AS t, unnest(range(0, 5)) AS pos FROM part),
    h AS (SELECT p_partkey, arg_min(t, pos) AS found, min(pos)::INTEGER AS place FROM c WHERE t IN (SELECT p_name FROM part WHERE p_size > 10) GROUP BY p_partkey)
    SELECT p.p_partkey, h.found, h.place FROM part p LEFT JOIN h ON h.p_partkey = p.p_partkey
""")
def q22_first_candidate(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    tried = F.array(F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("_")), F.concat("p_name", F.lit("x")), "p_name", F.lower("p_name"))
    rows = part.select("p_partkey", F.col("p_partkey").alias("_row"), tried.alias("tried"))
    return M.first_candidate(rows, "tried", part.where("p_size > 10"), "p_name").select("p_partkey", "found", "place")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q23_anti(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return orphans(_t(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_custkey AS source, l_suppkey AS target, o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 2 = 0) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_suppkey AND c_custkey % 2 = 0)")
def q24_induced(spark, sf_dir):
    edges = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), "o_orderkey", "l_linenumber")
    return induced(edges, _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("node")))


@query("""
    SELECT coalesce(s.k, c.k)::BIGINT AS nation, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers
    FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal < -500 GROUP BY 1) c ON s.k = c.k
""")
def q25_full_outer(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = _t(spark, sf_dir, "customer").where("c_acctbal < -500").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full_outer").fillna(0, ["suppliers", "customers"])


@query("SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_row FROM lineitem GROUP BY 1, 2, 3")
def q26_distinct_keys(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_row"))


@query("""
    WITH e AS (SELECT l_linestatus || l_returnflag AS c, l_linenumber AS line, l_suppkey % 10 AS a FROM lineitem WHERE l_quantity <= 25), f AS (SELECT l_linestatus || l_returnflag AS c, l_linenumber AS line, l_suppkey % 10 AS a FROM lineitem WHERE l_quantity > 25),
    t AS (SELECT c, 'tp' AS o FROM (SELECT * FROM e INTERSECT ALL SELECT * FROM f) UNION ALL SELECT c, 'fp' FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM e) UNION ALL SELECT c, 'fn' FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM f)),
    k AS (SELECT DISTINCT l_linestatus || l_returnflag AS c, l_linestatus AS kind FROM lineitem),
    s AS (SELECT kind, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn FROM k LEFT JOIN t ON t.c = k.c GROUP BY ROLLUP (kind))
    SELECT kind, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END::DOUBLE AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1 FROM s
""")
def q27_multiset_evaluation(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("case"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 10).cast("string").alias("algorithm"), "l_quantity")
    cases = rows.select("case", F.substring("case", 1, 1).alias("kind")).distinct()
    return evaluated(rows.where("l_quantity <= 25"), rows.where("l_quantity > 25"), cases)


@query("SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier")
def q28_multiset_except(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).exceptAll(_t(spark, sf_dir, "supplier").select("s_suppkey"))


@query("""
    WITH x AS (SELECT l.quality = 0 AS e, d.n_chars % 3 = 0 OR l.toxic = 1 AS f, d.lang FROM labels l JOIN documents d USING (doc_id)),
    s AS (SELECT lang AS kind, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM x GROUP BY ROLLUP (lang))
    SELECT kind, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END::DOUBLE AS recall,
           CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1 FROM s
""")
def q29_accuracy(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), "n_chars"), "doc_id")
    return A.accuracy(rows, F.col("quality") == 0, (F.col("n_chars") % 3 == 0) | (F.col("toxic") == 1), "kind")


@query("""
    WITH r AS (SELECT l_suppkey, l_returnflag, l_quantity > 25 AS confirmed, l_linestatus || '-' || l_linenumber AS basis, l_orderkey * 10 + l_linenumber AS ord, l_orderkey, l_partkey FROM lineitem),
    s AS (SELECT l_suppkey, l_returnflag, bool_or(confirmed) AS confirmed, arg_min(basis, (CASE WHEN confirmed THEN 0 ELSE 1000000000000 END) + ord) AS basis, count(*) AS evidence_count FROM r GROUP BY 1, 2),
    e AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_partkey) AS place FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_orderkey, l_partkey FROM r))
    SELECT s.*, e.l_orderkey, e.l_partkey FROM s JOIN e ON s.l_suppkey = e.l_suppkey AND s.l_returnflag = e.l_returnflag WHERE place <= 5
""")
def q30_merged_edges(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", (F.col("l_quantity") > 25).alias("confirmed"), F.concat("l_linestatus", F.lit("-"), "l_linenumber").alias("basis"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_orderkey", "l_partkey",
    )
    edges = A.merged_edges(rows, ["l_suppkey", "l_returnflag"], "confirmed", "basis", "ord", ["l_orderkey", "l_partkey"])
    return edges.select("l_suppkey", "l_returnflag", "confirmed", "basis", "evidence_count", F.explode("evidence").alias("e")).select("*", "e.*").drop("e")


@query("""
    SELECT l_suppkey, count(*) AS n, bool_or(l_returnflag = 'R') AS flagged, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' WHEN 3 THEN 'N' END AS worst_band,
           count(DISTINCT l_partkey) AS members FROM lineitem GROUP BY l_suppkey
""")
def q31_node_rollup(spark, sf_dir):
    return A.node_rollup(_t(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", "l_returnflag", ["R", "A", "N"], "l_partkey")


# ---- closures over part keys: halves (a tree), predecessors, a cycle, and a chain of all keys on nodes of its own, longer than the depth limit


_CHAIN = 1_000_000_000


def _part_edges(spark, sf_dir) -> DataFrame:
    k = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    tree = k.where("k > 1").select(F.col("k").alias("source"), F.expr("k div 2").alias("target"), (F.col("k") % 3 != 0).alias("sure"))
    chain = k.where("k % 64 <> 0 AND k > 1").select(F.col("k").alias("source"), (F.col("k") - 1).alias("target"), (F.col("k") % 2 == 0).alias("sure"))
    cycle = k.where("k % 100 = 7").select((F.col("k") - 5).alias("source"), F.col("k").alias("target"), F.lit(False).alias("sure"))
    long = k.where("k > 1").select((F.col("k") + _CHAIN).alias("source"), (F.col("k") - 1 + _CHAIN).alias("target"), (F.col("k") % 7 != 0).alias("sure"))
    return tree.unionByName(chain.where("source % 5 = 0")).unionByName(cycle).unionByName(long)


def _part_seeds(spark, sf_dir) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return part.where("p_partkey IN (3, 50)").select(F.col("p_partkey").alias("k")).unionByName(part.where("p_partkey = 1").select((F.col("p_partkey") + _CHAIN).alias("k")))


_PART_EDGES = """
    k AS (SELECT p_partkey AS k FROM part),
    e AS (SELECT k AS source, k // 2 AS target, k % 3 <> 0 AS sure FROM k WHERE k > 1 UNION ALL SELECT k, k - 1, k % 2 = 0 FROM k WHERE k % 64 <> 0 AND k > 1 AND k % 5 = 0 UNION ALL SELECT k - 5, k, false FROM k WHERE k % 100 = 7
          UNION ALL SELECT k + 1000000000, k + 999999999, k % 7 <> 0 FROM k WHERE k > 1)
"""


def _sql_reach(name: str, where: str) -> str:
    return f"""{name}_r AS (SELECT unnest([3, 50, 1000000001])::BIGINT AS node, 0 AS depth UNION SELECT e.source, r.depth + 1 FROM {name}_r r JOIN e ON e.target = r.node WHERE {where} r.depth < 25),
    {name} AS (SELECT node, min(depth) AS depth FROM {name}_r GROUP BY node)"""


@query(f"WITH RECURSIVE {_PART_EDGES}, {_sql_reach('a', '')} SELECT node, depth FROM a")
def q32_reverse_closure(spark, sf_dir):
    return reverse_closure(_part_edges(spark, sf_dir), _part_seeds(spark, sf_dir))[0]


@query(f"""
    WITH RECURSIVE {_PART_EDGES}, {_sql_reach('a', '')}, {_sql_reach('s', 'e.sure AND')}
    SELECT a.node, coalesce(s.depth, a.depth) AS depth, s.node IS NOT NULL AS confirmed FROM a LEFT JOIN s ON s.node = a.node
""")
def q33_two_tier(spark, sf_dir):
    return two_tier_closure(_part_edges(spark, sf_dir), _part_seeds(spark, sf_dir), "sure")[0]


@query("""
    WITH RECURSIVE r AS (SELECT p_partkey AS node, 0 AS depth, p_partkey::VARCHAR AS path FROM part WHERE p_partkey IN (3, 50)
      UNION ALL SELECT p.p_partkey, r.depth + 1, r.path || '>' || p.p_partkey FROM r JOIN part p ON p.p_partkey // 2 = r.node AND p.p_partkey > 1 WHERE r.depth < 25)
    SELECT node, min(depth) AS depth, arg_min(path, depth) AS path FROM r GROUP BY node
""")
def q34_shortest_path(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    tree = part.where("p_partkey > 1").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target"))
    reached, _ = reverse_closure(tree, part.where("p_partkey IN (3, 50)").select("p_partkey"), paths=True)
    return reached.select("node", "depth", F.array_join("path", ">").alias("path"))


@query(f"""
    WITH RECURSIVE {_PART_EDGES}, {_sql_reach('a', '')}, {_sql_reach('s', 'e.sure AND')}, t AS (SELECT a.node, coalesce(s.depth, a.depth) AS depth, s.node IS NOT NULL AS sure FROM a LEFT JOIN s ON s.node = a.node)
    SELECT count(*) FILTER (depth = 0) AS direct_files, count(*) FILTER (depth > 0) AS indirect_files, count(*) FILTER (depth > 0 AND sure) AS indirect_confirmed, count(*) FILTER (depth > 0 AND NOT sure) AS indirect_inferred, count(DISTINCT p_brand) AS components, max(depth) AS max_depth
    FROM t LEFT JOIN part ON p_partkey = node
""")
def q35_blast_summary(spark, sf_dir):
    reached = q33_two_tier(spark, sf_dir)
    return impact_summary(reached, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("service")))


@query("SELECT l_suppkey, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey ORDER BY customers DESC, l_suppkey LIMIT 20")
def q36_hubs(spark, sf_dir):
    pairs = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "l_suppkey").limit(20)


@query("""
    WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2)
    SELECT o_custkey, o_orderpriority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) = 1
""")
def q37_first_seen_mode(spark, sf_dir):
    return A.first_seen_mode(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""
    SELECT c_nationkey, CASE WHEN count(*) FILTER (c_acctbal < -900) > 0 THEN 'blocked' WHEN count(*) FILTER (c_acctbal > 9000) > 0 AND count(*) FILTER (c_acctbal < 0) > 0 THEN 'in transition'
           WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'not ready' ELSE 'clear' END AS level FROM customer GROUP BY c_nationkey
""")
def q38_first_level(spark, sf_dir):
    b = F.col("c_acctbal")
    seen = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.bool_or(b < -900).alias("low"), F.bool_or(b > 9000).alias("high"), F.bool_or(b < 0).alias("debt"))
    level = F.when(F.col("low"), "blocked").when(F.col("high") & F.col("debt"), "in transition").when(F.col("debt"), "not ready").otherwise("clear")
    return seen.select("c_nationkey", level.alias("level"))


@query("""
    SELECT track, change, count(*) AS n, count(DISTINCT p_brand) AS brands FROM (SELECT p_brand, split_part(p_type, ' ', 1) AS track,
      CASE WHEN split_part(p_type, ' ', 1) IN ('STANDARD', 'SMALL', 'ECONOMY') AND p_size <= 10 THEN 'small' WHEN split_part(p_type, ' ', 1) = 'STANDARD' AND p_size <= 30 THEN 'medium' ELSE 'other' END AS change FROM part) GROUP BY 1, 2
""")
def q39_tracks(spark, sf_dir):
    track = F.split_part("p_type", F.lit(" "), F.lit(1))
    change = F.when(track.isin("STANDARD", "SMALL", "ECONOMY") & (F.col("p_size") <= 10), "small").when((track == "STANDARD") & (F.col("p_size") <= 30), "medium").otherwise("other")
    rows = _t(spark, sf_dir, "part").select("p_brand", track.alias("track"), change.alias("change"))
    return rows.groupBy("track", "change").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("""
    SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events
""")
def q40_sliding_count(spark, sf_dir):
    return sliding_counts(_t(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "user_id", "n")


@query("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT event_id, user_id, n, true AS admitted, [t] AS recent FROM e WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.n, len(k) < 2, CASE WHEN len(k) < 2 THEN list_append(k, e.t) ELSE k END
      FROM (SELECT r.user_id, r.n, e.event_id, e.t, list_filter(r.recent, lambda x: x > e.t - 21600000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) j JOIN e ON e.user_id = j.user_id AND e.n = j.n + 1)
    SELECT event_id, user_id, admitted FROM r
""")
def q41_rate_limit(spark, sf_dir):
    return limited(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=2, seconds=6 * 3600).select("event_id", "user_id", "admitted")


@query("SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) > 24 * 3600000000")
def q42_retention(spark, sf_dir):
    return expired(_t(spark, sf_dir, "events"), "ts", "2024-01-20 00:00:00", 24).select("event_id")


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def q43_json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, printf('CRYPTO-%03d', row_number() OVER (ORDER BY source, lang, n_chars, doc_id)) AS id FROM documents")
def q44_sequential_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return labelled(rows, [F.col(c) for c in ("source", "lang", "n_chars", "doc_id")]).select("doc_id", "id")


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) > 100 AS truncated FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def q45_truncated(spark, sf_dir):
    return truncated(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 100)


@query(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages")
def q46_url_host(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query(r"""
    WITH t AS (SELECT page_id, list_transform(regexp_extract_all(regexp_replace(url, '[?#].*$', ''), '[A-Z]+|[A-Z]?[a-z]+|\d+'), lambda x: lower(x)) AS w FROM pages)
    SELECT page_id, CASE WHEN list_has_any(w, ['tls', 'ssl', 'https', 'mtls']) THEN 'tls-termination' WHEN list_has_any(w, ['firmware', 'artifact', 'artifacts']) THEN 'code-signing'
           WHEN list_has_any(w, ['auth', 'login', 'token', 'session']) THEN 'authentication' WHEN list_has_any(w, ['digest', 'webhook']) THEN 'integrity' WHEN list_has_any(w, ['storage', 'vault']) THEN 'data-protection' ELSE 'unknown' END AS context FROM t
""")
def q47_token_context(spark, sf_dir):
    words = T.identifier_tokens(F.lower(F.regexp_replace("url", r"[?#].*$", "")))
    return _t(spark, sf_dir, "pages").select("page_id", F.coalesce(T.keyword_context(words), F.lit("unknown")).alias("context"))


# ---- further operators on events and orders


@query("""
    WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events)
    SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL
""")
def q48_windowed_counts(spark, sf_dir):
    return windowed_counts(_t(spark, sf_dir, "events"), "ts", "event_type", "2 hours", "1 hour")


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def q49_top_per_group(spark, sf_dir):
    return top_per_group(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("""
    SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey
    JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY 1, 2
""")
def q50_star_join(spark, sf_dir):
    t = lambda n: _t(spark, sf_dir, n)
    urgent = t("orders").where(F.col("o_orderpriority").startswith("1"))
    rows = t("lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"))


def queries() -> dict[str, Query]:
    from quillspar import queries_plans, queries_scan, queries_sources  # noqa: F401 - register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)

