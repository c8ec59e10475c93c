"""Certificates in PEM files as rows: key, signature hash, names and expiry."""

from __future__ import annotations

import base64
import datetime
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.session import ship

#: Certificates that are read of one file.
MAX_BLOCKS = 50
CERTIFICATE_DDL = "file string, line int, key_algorithm string, key_size int, signature_hash string, subject string, issuer string, not_after timestamp, error string"
_BLOCK = re.compile(r"-----BEGIN CERTIFICATE-----([A-Za-z0-9+/=\s]+)-----END CERTIFICATE-----")
# Object identifiers of keys, curves, signatures and the common name.
KEYS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "ECDSA", "1.2.840.10040.4.1": "DSA", "1.3.101.112": "EdDSA", "1.3.101.113": "EdDSA"}
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521}
HASHES = {
    "1.2.840.113549.1.1.4": "MD5", "1.2.840.113549.1.1.5": "SHA-1", "1.2.840.113549.1.1.11": "SHA-256", "1.2.840.113549.1.1.12": "SHA-384", "1.2.840.113549.1.1.13": "SHA-512",
    "1.2.840.10045.4.1": "SHA-1", "1.2.840.10045.4.3.2": "SHA-256", "1.2.840.10045.4.3.3": "SHA-384", "1.2.840.10045.4.3.4": "SHA-512",
}
COMMON_NAME = "2.5.4.3"


def _items(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements that follow each other in data."""
    out, at = [], 0
    while at < len(data):
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            size, at = int.from_bytes(data[at : at + width]), at + width
        if at + size > len(data):
            raise ValueError("truncated")
        out.append((tag, data[at : at + size]))
        at += size
    return out


def _oid(data: bytes) -> str:
    parts, value = [], 0
    for b in data:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def _name(data: bytes) -> str | None:
    for _, group in _items(data):
        for _, pair in _items(group):
            (_, oid), (_, value) = _items(pair)[:2]
            if _oid(oid) == COMMON_NAME:
                return value.decode("utf-8", "replace")
    return None


def _time(tag: int, data: bytes) -> datetime.datetime:
    text = data.decode()
    if tag == 0x17:  # two digits of the year
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return datetime.datetime.strptime(text[:14], "%Y%m%d%H%M%S")


def _certificate(der: bytes) -> tuple:
    (_, whole), *_ = _items(der)
    (_, body), (_, signature), *_ = _items(whole)
    fields = _items(body)
    fields = fields[1:] if fields[0][0] == 0xA0 else fields  # an explicit version
    _serial, _algorithm, (_, issuer), (_, validity), (_, subject), (_, key), *_ = fields
    (_, kind), (_, bits) = _items(key)[:2]
    parameters = _items(kind)
    algorithm = KEYS.get(_oid(parameters[0][1]))
    size = None
    if algorithm == "RSA":
        (_, modulus), *_ = _items(_items(bits[1:])[0][1])
        size = int.from_bytes(modulus).bit_length()
    elif algorithm == "ECDSA" and len(parameters) > 1:
        size = CURVES.get(_oid(parameters[1][1]))
    return algorithm, size, HASHES.get(_oid(_items(signature)[0][1])), _name(subject), _name(issuer), _time(*_items(validity)[1]), None


def read_certificates(files: DataFrame) -> DataFrame:
    """CERTIFICATE_DDL rows of PEM files(path, kind, text); a block that can't be read has its error."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in frame.itertuples(index=False):
                for m in list(_BLOCK.finditer(text))[:MAX_BLOCKS]:
                    try:
                        found = _certificate(base64.b64decode("".join(m[1].split())))
                    except (ValueError, IndexError, UnicodeDecodeError):
                        found = (*[None] * 6, "unreadable")
                    rows.append((path, text.count("\n", 0, m.start()) + 1, *found))
            out = pd.DataFrame(rows, columns=["file", "line", "key_algorithm", "key_size", "signature_hash", "subject", "issuer", "not_after", "error"])
            yield out.astype({"key_size": "Int32", "not_after": "datetime64[us]"})

    return files.where("kind = 'pem'").select("path", "text").mapInPandas(run, CERTIFICATE_DDL)


def certificate_matches(certificates: DataFrame, as_of: str) -> DataFrame:
    """Matches of certificates: one for the public key, one more for a SHA-1 signature; evidence says whether it is expired at as_of."""
    good = certificates.where("error IS NULL")
    state = F.when(F.col("not_after") < F.to_timestamp(F.lit(as_of)), "expired ").otherwise("valid to ")
    evidence = F.concat(F.lit("subject "), F.coalesce("subject", F.lit("?")), F.lit(", issuer "), F.coalesce("issuer", F.lit("?")), F.lit(", "), state, F.date_format("not_after", "yyyy-MM-dd"))
    rows = good.select("file", F.col("line").alias("line_start"), F.col("line").alias("line_end"), "key_algorithm", "key_size", "signature_hash", evidence.alias("evidence"))
    key = F.struct(F.lit("CFG-X509-001").alias("rule_id"), F.col("key_algorithm").alias("algorithm"), F.lit("public-key").alias("primitive"), F.lit("verification").alias("operation"), F.col("key_size").alias("key_size"))
    sha1 = F.when(F.col("signature_hash") == "SHA-1", F.struct(F.lit("CFG-X509-002").alias("rule_id"), F.lit("SHA-1").alias("algorithm"), F.lit("hash").alias("primitive"), F.lit("hashing").alias("operation"), F.lit(None).cast("int").alias("key_size")))
    both = F.filter(F.array(F.when(F.col("key_algorithm").isNotNull(), key), sha1), lambda x: x.isNotNull())
    return rows.select("file", "line_start", "line_end", "evidence", F.explode(both).alias("m")).select(
        "file", "line_start", "line_end", "m.*", F.lit("x509").alias("library"), F.lit(None).cast("string").alias("api"), F.array().cast("array<string>").alias("scope"), "evidence", F.lit(0.75).alias("confidence"), F.lit(False).alias("comment_only")
    )
