"""Column functions on paths and texts: classes of files, guards, evidence, secrets, roots, contexts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension and by base name.
KINDS = {
    "python": ("py", "pyw"),
    "java": ("java",),
    "js": ("js", "jsx", "mjs", "cjs", "ts", "tsx"),
    "doc": ("md", "rst", "txt"),
    "pem": ("pem", "crt", "cer", "cert"),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "text": ("conf", "dockerfile"),
}
TEXT_NAMES = ("dockerfile", "sshd_config", "ssh_config", "jenkinsfile")
# Characters that make a spreadsheet read a cell as a formula, and folders of third-party or generated code.
FORMULA = r"^[=+\-@\t\r]"
EVIDENCE_LENGTH = 300
LONGEST_LINE = 10_000
VENDOR_FOLDERS = (".git", "node_modules", ".venv", "venv", "__pycache__", "site-packages", ".tox", ".mypy_cache")
REDACTED = "[REDACTED]"

# Credential shapes, as (kind, pattern, group that is the secret).
_NAMES = r"(?:api[_-]?key|secret(?:[_-]?key)?|access[_-]?key|auth[_-]?token|token|passw(?:or)?d|pwd)"
SECRETS = (
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", 0),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("google_api_key", r"\bAIza[0-9A-Za-z_\-]{35}\b", 0),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*", 0),
)
# Files whose values may stand without quotes, and such a value behind a credential's name.
CONFIG_FILE = r"\.(ya?ml|env|properties|ini|conf|cfg|toml)$"
UNQUOTED = rf"(?im)^(\s*[A-Za-z0-9_.-]*{_NAMES}\s*:[ \t]*)[^\s\"'#$\{{<][^\s#]{{7,}}"
#: One of these is in every text that holds a secret: a byte search that spares most texts the patterns.
_ANCHORS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "k_live_", "k_test_", "eyJ")
_NAME_ANCHORS = ("key", "secret", "token", "passw", "pwd")
ASSIGNED = rf"(?i)(\b{_NAMES}\b[\"']?\s*[:=]\s*)(?:\"([^\"'\s\\]{{8,}})\"|'([^\"'\s\\]{{8,}})')"

# Contexts in the order in which they are tried, and what makes each: a whole word among the tokens, a stem
# that one begins with, or two neighbours (of a pair `a b*` the second is a stem).
CONTEXT_SIGNS = (
    ("tls-termination", "word", "tls ssl https mtls"),
    ("code-signing", "pair", "code sign*"),
    ("code-signing", "pair", "sign* release|releases|artifact|artifacts|package|packages|firmware"),
    ("code-signing", "stem", "codesign"),
    ("code-signing", "word", "firmware artifact artifacts"),
    ("authentication", "word", "auth authn login logon signin jwt jwts jws token tokens session sessions credential credentials oauth oidc sso saml"),
    ("authentication", "stem", "authent"),
    ("integrity", "word", "webhook webhooks checksum checksums digest digests integrity fingerprint fingerprints"),
    ("data-protection", "pair", "at rest"),
    ("data-protection", "word", "atrest vault storage ledger ledgers"),
    ("data-protection", "stem", "encrypt decrypt settle"),
)
# Folders of tests and words of paths that aren't production.
TEST_FOLDERS = ("test", "tests", "__tests__")
NON_PRODUCTION = ("lab", "labs", "demo", "demos", "example", "examples", "sample", "samples", "poc", "sandbox", "playground")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension of the base name, or an empty text; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]+)$", 1))


def classify(path: Column) -> Column:
    """The kind of file that a path names, or null."""
    base, ext = F.lower(base_name(path)), extension(path)
    out = F.when(F.lit(False), F.lit(""))
    for kind, extensions in KINDS.items():
        out = out.when(ext.isin(*extensions), F.lit(kind))
    return out.when(base.isin(*TEXT_NAMES) | base.startswith("dockerfile."), F.lit("text"))


def vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_FOLDERS)))


def decoded(content: Column) -> Column:
    """Bytes as text: bad UTF-8 replaced, one leading byte-order mark dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), F.length))


def minified(text: Column) -> Column:
    return longest_line(text) > LONGEST_LINE


def evidence(text: Column, limit: int = EVIDENCE_LENGTH) -> Column:
    """White space as single spaces, ends trimmed, cut to the limit with an ellipsis."""
    clean = F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), F.lit(" "))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))).otherwise(clean)


def csv_safe(cell: Column) -> Column:
    """A quote before cells that a spreadsheet would run."""
    return F.when(cell.rlike(FORMULA), F.concat(F.lit("'"), cell)).otherwise(cell)


def markdown_cell(cell: Column) -> Column:
    return F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def redacted(text: Column, marker: str = REDACTED) -> Column:
    """Secrets replaced by a marker; the number of lines stays.

    A secret in quotes after a credential's name goes first and whole, so
    shapes inside it can't be cut twice; the shapes themselves exclude each
    other by how they begin.
    """
    shown = marker.replace("$", r"\$")
    out = F.regexp_replace(text, ASSIGNED.replace(r"(?:\"(", r"(?:(\")(").replace(r"|'(", r"|(')("), f"$1$2$4{shown}$2$4")
    for _, pattern, _ in SECRETS:
        out = F.regexp_replace(out, pattern, shown)
    return F.when(_may_hold_secrets(text), out).otherwise(text)


def redacted_file(path: Column, text: Column, marker: str = REDACTED) -> Column:
    """As redacted, and in configuration files also values without quotes, `name: value`; the number of lines stays."""
    config = F.lower(path).rlike(CONFIG_FILE)
    bare = F.regexp_replace(text, UNQUOTED, f"$1{marker}")
    return redacted(F.when(config, bare).otherwise(text), marker)


def _may_hold_secrets(text: Column) -> Column:
    small = F.lower(text)
    return reduce(or_, [*(F.contains(text, F.lit(a)) for a in _ANCHORS), *(F.contains(small, F.lit(a)) for a in _NAME_ANCHORS)])


def secret_kinds(line: Column) -> Column:
    """The kinds of secrets on a line, in the order of the patterns."""
    found = [F.when(line.rlike(pattern), F.lit(kind)) for kind, pattern, _ in SECRETS]
    found.append(F.when(line.rlike(ASSIGNED), F.lit("credential_assignment")))
    kinds = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(_may_hold_secrets(line), kinds).otherwise(F.array().cast("array<string>"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def import_root(spec: Column, language: Column) -> Column:
    """The external package that an import names: scope and name, first segment, or first two of a Java package."""
    js = F.when(spec.startswith("node:"), spec).when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))
    return F.when(language == "js", js).when(language == "java", F.substring_index(spec, ".", 2)).otherwise(F.substring_index(spec, ".", 1))


def identifier_tokens(path: Column, scope: Column | None = None) -> Column:
    """Lower-case words and numbers of a path's names and its enclosing scopes; `HTTPServer2` gives http, server, 2."""
    joined = path if scope is None else F.concat_ws("/", path, scope)
    bordered = F.regexp_replace(joined, "([a-z])([A-Z])", "$1 $2")
    bordered = F.regexp_replace(bordered, "([A-Z])([A-Z][a-z])", "$1 $2")
    bordered = F.regexp_replace(bordered, "([0-9]+)", " $1 ")
    return F.filter(F.split(F.lower(F.regexp_replace(bordered, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def _is_sign(token: Column, sign: str) -> Column:
    return token.startswith(sign[:-1]) if sign.endswith("*") else token.isin(*sign.split("|"))


def _shows(tokens: Column, kind: str, value: str) -> Column:
    if kind == "word":
        return F.arrays_overlap(tokens, F.array(*map(F.lit, value.split())))
    if kind == "stem":
        return F.exists(tokens, lambda t: reduce(or_, [t.startswith(stem) for stem in value.split()]))
    first, second = value.split()
    nexts = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.exists(F.zip_with(tokens, nexts, lambda a, b: F.coalesce(_is_sign(a, first) & _is_sign(b, second), F.lit(False))), lambda hit: hit)


def keyword_context(tokens: Column) -> Column:
    """The first context of which a sign stands among the tokens, or null."""
    return F.coalesce(*[F.when(_shows(tokens, kind, value), F.lit(context)) for context, kind, value in CONTEXT_SIGNS])


def context_of(tokens: Column, algorithm: Column, primitive: Column, operation: Column) -> Column:
    """What a use of cryptography is for: by its kind, else by the words around it, else by its primitive."""
    agreement = (primitive == "pqc-kem") | operation.isin("key_agreement", "encapsulation", "decapsulation") | algorithm.isin("ECDH", "DH", "DH/ECDH")
    return (
        F.when(agreement, F.lit("key-establishment"))
        .when(primitive == "protocol", F.lit("tls-termination"))
        .otherwise(
            F.coalesce(
                keyword_context(tokens),
                F.when(primitive.isin("hash", "mac"), F.lit("integrity"))
                .when(primitive == "symmetric", F.lit("data-protection"))
                .when((primitive == "public-key") & operation.isin("encryption", "decryption"), F.lit("key-establishment")),
                F.lit("unknown"),
            )
        )
    )


def test_path(path: Column) -> Column:
    named = F.array(*map(F.lit, TEST_FOLDERS))
    words = F.concat(F.split(F.lower(path), "/"), F.split(F.lower(base_name(path)), r"[._\-]"))
    return F.arrays_overlap(words, named)


def non_production(path: Column, is_test: Column) -> Column:
    return is_test | F.arrays_overlap(F.split(F.lower(path), r"[/._\-]"), F.array(*map(F.lit, NON_PRODUCTION)))


def normal_path(path: Column) -> Column:
    """A relative path with `/`, without `.` and empty parts; null where it is absolute, climbs or holds control characters."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = slashed.rlike(r"[\x00-\x1F\x7F]") | slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))
