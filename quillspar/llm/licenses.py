"""License scans: fuzzy search for short notices.

A notice that stands in a text with at most k edits contains one of its k + 1
pieces unchanged (pigeonhole), so exact search for the pieces finds all places
that can hold it. Around them the regex library's bounded-error matching
counts the edits. The words that name the license are compared apart from the
sentence around them: short names exactly, long ones with an edit of their own,
for the edits of a sentence would turn one license's name into another's. In
most sentences, and behind an SPDX tag, the name may stand in a list of names
and may have a version. Where a longer name stands at the same place ("cc by nc
sa"), the shorter one ("cc by nc") doesn't count. Matches begin and end with
words. Texts are compared as words: A-Z in lower case, everything that is no
word character as one space; notices read "licence" as "license".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm import textkernel
from quillspar.session import ship

# Exact phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Names of licenses as sentences give them, and their labels.
NAMES = {
    "mit": "mit",
    "apache": "apache",
    "gnu general public": "gpl",
    "gpl": "gpl",
    "gnu lesser general public": "lgpl",
    "lgpl": "lgpl",
    "gnu affero general public": "agpl",
    "agpl": "agpl",
    "bsd": "bsd",
    "mozilla public": "mpl",
    "mpl": "mpl",
    "eclipse public": "epl",
    "epl": "epl",
    "isc": "isc",
    "boost software": "bsl-1",
    "business source": "busl",
    "zlib": "zlib",
    "artistic": "artistic",
    "eupl": "eupl",
    "european union public": "eupl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
}
#: Names that only SPDX tags give.
TAG_NAMES = {"bsl": "bsl-1", "unlicense": "unlicense", "0bsd": "bsd"}
#: Sentences around a name, whose place is marked by braces.
SENTENCES = ("licensed under the {} license", "released under the {} license", "distributed under the {} license", "under the terms of the {} license", "available under the {} license")
TAG = "spdx license identifier {}"
#: Notices with names of their own: in braces as they are, in brackets with versions and among other names too.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software": "unlicense",
    "{gnu} lesser general public license": "lgpl",
    "gnu {affero} general public license": "agpl",
    "{mozilla} public license version": "mpl",
    "{eclipse} public license version": "epl",
    "licensed under {cc by} 4 0": "cc-by",
    "licensed under {cc by nc}": "cc-by-nc",
    "licensed under {cc by sa}": "cc-by-sa",
    "licensed under {cc by nd}": "cc-by-nd",
    "licensed under {cc by nc sa}": "cc-by-nc-sa",
    "licensed under {cc by nc nd}": "cc-by-nc-nd",
    "{creative commons attribution} 4 0 international": "cc-by",
    "{creative commons attribution noncommercial}": "cc-by-nc",
    "{creative commons attribution noncommercial sharealike}": "cc-by-nc-sa",
    "{creative commons attribution noncommercial noderivatives}": "cc-by-nc-nd",
    "{creative commons attribution sharealike}": "cc-by-sa",
    "{creative commons attribution noderivatives}": "cc-by-nd",
    "{creative commons zero}": "cc0",
}
NOTICES |= {sentence.format("[" + name + "]"): label for name, label in NAMES.items() for sentence in SENTENCES}
NOTICES |= {TAG.format("[" + name + "]"): label for name, label in (NAMES | TAG_NAMES).items()}
#: A piece has about this many bytes, so that the n bytes around a name may have n // PIECE_BYTES - 1 edits, one at least.
PIECE_BYTES = 10
#: A name with a word of at least so many bytes may have one edit.
LONG_WORD = 6
#: What a bare phrase without a notice around it scores.
PHRASE_SCORE = 0.5

_ITEM = "(?:" + "|".join(sorted(NAMES | TAG_NAMES, key=len, reverse=True)) + ")"
_VERSION = r"(?: ?(?:version |v)?\d{1,2}(?: \d{1,2})?(?: clause)?(?: international)?)?(?: only| or later| or any later version)?"
_AND = "(?: and or| or| and)?(?: the)?"
#: What may stand between a sentence and its name, and between the name and the rest; and how many bytes more that makes at most.
BEFORE_NAME = f"(?:{_ITEM}{_VERSION}(?: license)?{_AND} ){{0,3}}"
BEHIND_NAME = f"{_VERSION}(?:{_AND} {_ITEM}{_VERSION}){{0,3}}"
GAP_BYTES = 7 * 120

_SPACED = np.where(textkernel.ALNUM, textkernel.LOWER, 0x20).astype(np.uint8)


def _literal(text: str) -> str:
    return regex.escape(text, literal_spaces=True)


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    before: str
    name: str
    after: str
    edits: int
    name_edits: int
    #: Whether versions and other names may stand beside the name.
    listed: bool = False

    @classmethod
    def of(cls, template: str, label: str, piece_bytes: int = PIECE_BYTES) -> Notice:
        listed = "[" in template
        before, _, rest = template.partition("[" if listed else "{")
        name, _, after = rest.partition("]" if listed else "}") if rest else ("", "", "")
        edits = max(1, (len(before) + len(after)) // piece_bytes - 1)
        return cls(before + name + after, label, before.rstrip(), name, after.lstrip(), edits, int(max(map(len, name.split()), default=0) >= LONG_WORD), listed)

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """(place, piece): one more than all edits, so that one of them is free of any; with a list, of what stands before it."""
        n = self.edits + 1 if self.listed else self.edits + self.name_edits + 1
        text = self.before if self.listed else self.text
        cuts = [round(i * len(text) / n) for i in range(n + 1)]
        return [(lo, text[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    @property
    def told(self) -> list[str]:
        """Of which one stands wherever the name does; none where the notice's own pieces tell enough."""
        if not self.name or (self.name_edits and not self.listed):
            return []
        half = len(self.name) // 2
        return [self.name[:half], self.name[half:]] if self.name_edits else [f" {self.name}"]

    @property
    def pattern(self) -> regex.Pattern:
        """Between spaces: the parts around the name with all edits together at most `edits`, the name with its own."""
        part = lambda text, most: f"(?:{_literal(text)}){{e<={most}}}" if most else _literal(text)
        if not self.name:
            ways = [part(self.before, self.edits)]
        else:
            name = f"(?P<name>{part(self.name, self.name_edits)})"
            name = f"{BEFORE_NAME}{name}{BEHIND_NAME}" if self.listed else name
            if not self.before or not self.after:
                ways = [f"{part(self.before, self.edits)} {name}" if self.before else f"{name} {part(self.after, self.edits)}" if self.after else name]
            else:  # the edits are shared out between both sides
                ways = [f"{part(self.before, i)} {name} {part(self.after, self.edits - i)}" for i in range(self.edits + 1)]
        return regex.compile(f"(?e)(?<= )(?:{'|'.join(ways)})(?= )")


class Scanner:
    """The notices, their patterns, and one automaton that finds all pieces of all notices."""

    def __init__(self, items: tuple[tuple[str, str], ...], piece_bytes: int):
        self.notices = [Notice.of(text, label, piece_bytes) for text, label in items]
        self.patterns = [n.pattern for n in self.notices]
        words = {piece for n in self.notices for piece in [*(piece for _, piece in n.pieces), *n.told]}
        self.automaton = ahocorasick.Automaton()
        for piece in words:
            self.automaton.add_word(piece, piece)
        if words:
            self.automaton.make_automaton()
        self.empty = not words

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice that may stand in the text, the stretches that hold all its places."""
        if self.empty:
            return {}
        starts: dict[str, list[int]] = {}
        for end, piece in self.automaton.iter(text):
            starts.setdefault(piece, []).append(end + 1 - len(piece))
        seen, out = {piece: np.array(at, np.int64) for piece, at in starts.items()}, {}
        for i, notice in enumerate(self.notices):
            at = [seen[piece] - place for place, piece in notice.pieces if piece in seen]
            if not at or (notice.told and not any(piece in seen for piece in notice.told)):
                continue
            slack = notice.edits + notice.name_edits + 1
            at = np.unique(np.concatenate(at))
            lo, hi = np.maximum(at - slack, 0), at + len(notice.text) + slack + GAP_BYTES * notice.listed
            if notice.told:  # a piece of the name stands between
                named = np.zeros(len(at), bool)
                for piece in notice.told:
                    if piece in seen:
                        next_one = np.append(seen[piece], len(text) + GAP_BYTES + len(notice.text) + 2 * slack)[np.searchsorted(seen[piece], lo)]
                        named |= next_one + len(piece) <= hi
                lo, hi = lo[named], hi[named]
            if len(lo):
                first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                out[i] = list(zip(lo[first].tolist(), hi[np.append(first[1:], len(hi)) - 1].tolist(), strict=True))
        return out

    def spans(self, text: str) -> Iterator[tuple[Notice, int, int, int]]:
        """(notice, start, end, edits) of the places where notices stand; overlapping places of one notice give one, and a name
        gives way to a longer one that begins at its place."""
        found, names = [], {}
        for i, stretches in self.windows(text).items():
            notice = self.notices[i]
            for lo, hi in stretches:
                for m in self.patterns[i].finditer(text, lo, min(hi, len(text))):
                    at = m.start("name") if notice.name else -1
                    found.append((notice, m.start(), m.end(), sum(m.fuzzy_counts), at))
                    if notice.name:
                        names.setdefault(at, set()).add(notice.name)
        for notice, lo, hi, edits, at in found:
            if not any(other.startswith(f"{notice.name} ") for other in names.get(at, ())):
                yield notice, lo, hi, edits


@lru_cache(maxsize=4)
def _scanner(items: tuple[tuple[str, str], ...], piece_bytes: int) -> Scanner:
    return Scanner(items, piece_bytes)


def _normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space between; each row begins with a space and ends with one (two between rows)."""
    rows = len(offsets) - 1
    spaced = np.full(len(data) + 2 * rows, 0x20, np.uint8)
    spaced[np.arange(len(data)) + 2 * np.repeat(np.arange(rows), np.diff(offsets)) + 1] = _SPACED[data]
    blank = spaced == 0x20
    keep = np.ones(len(spaced), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = offsets + 2 * np.arange(rows + 1)
    keep[starts[:-1]] = True  # a row's own first space stays
    bounds = np.zeros(rows + 1, np.int64)
    if rows:
        np.cumsum(np.add.reduceat(keep, starts[:-1], dtype=np.int64), out=bounds[1:])
    return spaced[keep], bounds


def _places(raw: bytes, what: bytes) -> list[int]:
    out, at = [], raw.find(what)
    while at >= 0:
        out.append(at)
        at = raw.find(what, at + 1)
    return out


SPANS = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
SPANS_DDL = "array<struct<label: string, notice: string, first_word: bigint, last_word: bigint, edits: int>>"
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan_chunk(data: np.ndarray, offsets: np.ndarray, phrases: dict[str, str], scanner: Scanner) -> list[tuple]:
    """One tuple of _NAMES for each row of the chunk."""
    clean, bounds = _normalised(data, offsets)
    raw = clean.tobytes()
    words = np.flatnonzero((clean[1:] != 0x20) & (clean[:-1] == 0x20)) + 1  # starts of words
    firsts = np.searchsorted(words, bounds)
    base: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in phrases.items():
        for at in _places(raw, f" {phrase} ".encode()):
            row = int(np.searchsorted(bounds, at, side="right")) - 1
            base.setdefault(row, []).append((int(np.searchsorted(words, at + 1)) - int(firsts[row]), label))
    spans: dict[int, list[dict]] = {}
    scores: dict[int, float] = {}
    # Rows are searched as one text; a run of line feeds between them is longer than all edits of any notice can bridge.
    gap = max((n.edits + n.name_edits for n in scanner.notices), default=0) + 1
    text = np.insert(clean, np.repeat(bounds[1:-1], gap), 0x0A).tobytes().decode("latin-1").replace("licenc", "licens")
    begins = bounds + gap * np.arange(len(bounds))
    for notice, lo, hi, edits in scanner.spans(text):
        row = int(np.searchsorted(begins, lo, side="right")) - 1
        lo, hi = lo - gap * row, hi - gap * row
        first, last = int(np.searchsorted(words, lo)) - int(firsts[row]), int(np.searchsorted(words, hi)) - 1 - int(firsts[row])
        spans.setdefault(row, []).append({"label": notice.label, "notice": notice.text, "first_word": first, "last_word": last, "edits": edits})
        scores[row] = max(scores.get(row, 0.0), 1 - edits / len(notice.text))
    out = []
    for row, n in enumerate(np.diff(firsts).tolist()):
        hits, found = base.get(row), spans.get(row)
        if not hits and not found:
            out.append((n, 0, None, None, "", "", 0.0, []))
            continue
        at = sorted(x for x, _ in hits or [])
        labels = {x for _, x in hits or []}
        every = labels | {s["label"] for s in found or []}
        found = sorted(found or [], key=lambda s: (s["first_word"], s["last_word"], s["notice"]))
        score = max(scores.get(row, 0.0), PHRASE_SCORE if hits else 0.0)
        out.append((n, len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(labels)), ",".join(sorted(every)), score, found))
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places where a phrase's words stand one after another;
    first_word and last_word are their smallest and largest start (words from
    0). labels holds the phrases' and the fuzzily found notices' labels. score
    is the best notice's share of unedited bytes, at least PHRASE_SCORE where a
    phrase stands, else 0. spans lists the notices found with their first and
    last word and edits.

    Null and empty texts give 0 words, no labels and null places. Each row
    gives one row; texts are read whole, and overlapping places of one notice
    give one span.
    """
    ship(docs.sparkSession)
    phrases = dict(BASE_PHRASES if phrases is None else phrases)
    items = tuple((NOTICES if notices is None else notices).items())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _scanner(items, piece_bytes)
        for batch in batches:
            for lo, hi, data, offsets in textkernel.chunks(batch.column(1), 4 * textkernel.CHUNK_BYTES):
                columns = zip(*scan_chunk(data, offsets, phrases, wanted), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True))], names=[id_col, *_NAMES])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS_DDL}")
