"""Token counts and ids: batch encoding inside Arrow functions.

A byte-level BPE never merges over the borders that its word pattern draws, so
a text may be cut at places where a new match of that pattern always starts
(`textkernel.piece_offsets`) and the pieces encoded apart. Pieces repeat, so
each chunk of bounded bytes encodes its distinct pieces only, and a worker
keeps what it has encoded.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm import textkernel
from quillspar.session import ship

#: Bytes of text that are encoded together.
BATCH_BYTES = 8 << 20
#: Distinct pieces of one generation of a worker's memory; two generations are kept.
MEMORY_PIECES = 400_000
#: The last code point below which the library's and Python's notion of a letter are the same.
_PLAIN = "ԯ"


def _byte_letters() -> list[str]:
    """Fixed rule of byte-level BPE: printable bytes stand for themselves, the others for U+0100 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(others)) for b in range(256)]


def _is_cut(special: str) -> bool:
    """Whether a text would be cut inside this string."""
    data = np.frombuffer(f"a{special}a".encode(), np.uint8)
    return any(1 < cut < len(data) - 1 for cut in textkernel.piece_offsets(data, np.array([0, len(data)])).tolist())


class Encoder:
    """Encodes texts with one tokenizer file; remembers pieces between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        strips = any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
        self.pieced = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and not strips and not any(_is_cut(t["content"]) for t in spec.get("added_tokens", []))
        self.letters = dict(enumerate(_byte_letters()))
        self.memory: dict = {}
        self.older: dict = {}

    def _whole(self, texts: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, texts: list[str], keep: Callable) -> None:
        """Single words go to the model at once; all else through the whole encoder."""
        rest, tokenize = [], self.tokenizer.model.tokenize
        for text in texts:
            word = text[1:] if text[:1] == " " else text
            if word.isalpha() and (word.isascii() or max(word) <= _PLAIN):
                shown = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
                self.memory[text] = keep([t.id for t in tokenize(shown)])
            else:
                rest.append(text)
        for text, ids in zip(rest, self._whole(rest), strict=True):
            self.memory[text] = keep(ids)

    def _known(self, distinct: list[str], keep: Callable) -> list:
        """What keep() made of each piece. Pieces that are met again pass from the older generation to the new one."""
        memory, older, new = self.memory, self.older, []
        for piece in distinct:
            if piece not in memory:
                if (found := older.get(piece)) is None:
                    new.append(piece)
                else:
                    memory[piece] = found
        self._new_pieces(new, keep)
        out = [memory[piece] for piece in distinct]
        if len(memory) > MEMORY_PIECES:
            self.older, self.memory = memory, {}
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for lo, hi, data, offsets in textkernel.chunks(texts, BATCH_BYTES):
            if not self.pieced:
                out[lo:hi] = [len(x) for x in self._whole(_strings(data, offsets))]
                continue
            found, firsts = textkernel.pieces(data, offsets)
            coded = found.dictionary_encode()
            sizes = np.array(self._known(coded.dictionary.to_pylist(), len), np.int64)
            out[lo:hi] = _row_sums(sizes[coded.indices.to_numpy()] if len(found) else sizes, firsts)
        return out

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens of each text) of consecutive runs of texts."""
        for _, _, data, offsets in textkernel.chunks(texts, BATCH_BYTES):
            if not self.pieced:
                rows = self._whole(_strings(data, offsets))
                yield np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64)
                continue
            found, firsts = textkernel.pieces(data, offsets)
            if not len(found):
                yield np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
                continue
            coded = found.dictionary_encode()
            known = self._known(coded.dictionary.to_pylist(), _packed)
            flat = np.frombuffer(b"".join(known), np.uint32)
            sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
            starts = np.cumsum(sizes) - sizes
            index = coded.indices.to_numpy()
            each = sizes[index]
            ends = np.cumsum(each)
            at = np.repeat((starts[index] - ends + each).astype(np.int32), each)  # a batch has fewer than 2**31 ids
            at += np.arange(ends[-1], dtype=np.int32)
            yield flat[at], _row_sums(each, firsts)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _row_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def _strings(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[lo:hi].decode("utf-8", "replace") for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str, use: str) -> Encoder:
    """One for each worker process, file and use (lengths and ids are remembered apart)."""
    return Encoder(path)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    No begin, end or other special tokens are added; special strings inside
    texts are treated as the library does by default. Tasks return lengths
    only. A null text counts as empty (0 bytes, 0 tokens); every row gives one
    row, repeated ids too; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(tokenizer, "lengths")
        for batch in batches:
            n = counter.lengths(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
