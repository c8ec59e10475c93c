"""Quality classifier by co-training two views of a page.

The content view sees the text: its words and how words begin and end, hashed,
and what it is made of (case, symbols, repetition, lengths of words and lines).
The metadata view sees only what is recorded about the page (source, language,
size). Each is a naive Bayes classifier over binned features, so that training
is one sum of counts over all documents and a model is a small table. In each
round either view labels, for the other's next training, the unlabelled
documents of each class that it is most sure of, unless the other is found to
lose by it. Both are calibrated on labelled documents that
neither is trained on, and their log-odds added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.llm import textkernel
from quillspar.session import Workspace, ship

CONTENT = ("upper", "symbols", "stutter", "top_word", "word_bytes", "digits", "lines", "line_bytes", "longest_line")
METADATA = ("source", "lang", "size")
BINS = 64
#: Bits of the hashed words, and as many bins again for the first and last three bytes of words.
WORD_BITS = 14
WORD_BINS = 2 << WORD_BITS
#: One labelled document in so many is kept for calibration and never trained on.
HELD_OUT = 4
ROUNDS = 3
#: In its first exchange a view labels this share of the unlabelled documents for the other, divided between the classes as
#: the known labels are: those that it is most sure of, by their calibrated probabilities. In later rounds as much again.
EXCHANGED = 0.005
#: A document counts as so many parts, which a probability divides between the classes.
WHOLE = 1000
#: Documents that each bin is taken to hold before any is counted.
SMOOTHING = 0.5
#: The same for bins of words, of which many are seen once by chance.
WORD_SMOOTHING = 4.0
#: Largest log-odds that a view may claim.
LIMIT = 9.0
#: Weight of the calibration's pull towards the share of good documents.
RIDGE = 10.0
#: Rows that are counted at once: their words' numbers stand in memory side by side.
SLICE_ROWS = 1 << 11
#: A document is kept at this score.
KEEP = 0.5
_SHARES = np.array([0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.7, 0.9])
_SYMBOL = textkernel._table(lambda b: 0x21 <= b <= 0x7E and not textkernel.ALNUM[b] and chr(b) not in ".,;:'\"?-()")
_UPPER = textkernel._table(lambda b: 0x41 <= b <= 0x5A)
_LETTER = textkernel._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_DIGIT = textkernel._table(lambda b: 0x30 <= b <= 0x39)


def _log_bins(x: np.ndarray, step: float = 1.0) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0) + 1) / step, BINS - 1).astype(np.int32)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and per row the index of its first."""
    starts, ends, firsts = textkernel.word_spans(data, offsets, textkernel.NON_SPACE)
    return starts, ends, textkernel.word_hashes(data, offsets, textkernel.NON_SPACE, (starts, ends, firsts))[0], firsts


def text_features(data: np.ndarray, offsets: np.ndarray, found: tuple) -> list[np.ndarray]:
    """Bins of the content features; found: what _words says."""
    size = np.diff(offsets)
    starts, ends, hashes, firsts = found
    words = np.diff(firsts)
    some = np.maximum(words, 1)
    symbol = _SYMBOL[data]
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = firsts[:-1][firsts[:-1] < len(hashes)]
    same[inner] = False
    top = np.zeros(len(size), np.int64)
    for row, (lo, hi) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        if hi > lo:
            ordered = np.sort(hashes[lo:hi])
            edges = np.flatnonzero(np.diff(ordered)) + 1
            top[row] = np.diff(np.concatenate(([0], edges, [hi - lo]))).max()
    share = lambda x, of: np.searchsorted(_SHARES, x / np.maximum(of, 1), side="left").astype(np.int32)
    feeds = np.flatnonzero(data == 0x0A)
    line_firsts = np.searchsorted(feeds, offsets)
    lines = np.diff(line_firsts) + 1
    longest = np.zeros(len(size), np.int64)
    for row, (lo, hi) in enumerate(zip(line_firsts[:-1].tolist(), line_firsts[1:].tolist(), strict=True)):
        longest[row] = np.diff(np.concatenate(([offsets[row] - 1], feeds[lo:hi], [offsets[row + 1]]))).max() - 1
    return [
        share(_per_row(_UPPER[data], offsets), _per_row(_LETTER[data], offsets)),
        share(_per_row(symbol, offsets), size),
        share(np.maximum(_per_row(same, firsts) - 1, 0), words),  # a few repeats say nothing in short texts
        share(np.maximum(top - 3, 0), words),
        _log_bins(_per_row(ends - starts, firsts) / some, 0.5),
        share(_per_row(_DIGIT[data], offsets), size),
        _log_bins(lines),
        _log_bins(size / lines, 0.5),
        _log_bins(longest, 0.5),
    ]


def word_features(data: np.ndarray, offsets: np.ndarray, words: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Per row its distinct bins of words and of the three bytes that words begin and end with; and each row's number of them."""
    starts, ends, hashes, firsts = words
    # Row and bin in one number, which sorts fastest in 32 bits.
    kind = np.dtype(np.uint32 if len(offsets) < 1 << (31 - WORD_BITS) else np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=kind) << kind.type(WORD_BITS + 1), np.diff(firsts))
    long = ends - starts >= 3
    top = np.uint64(64 - WORD_BITS)
    found = [row | (hashes >> top).astype(kind)]
    for tag, at in ((1, starts[long]), (2, ends[long] - 3)):
        three = data[at].astype(np.uint64) | data[at + 1].astype(np.uint64) << np.uint64(8) | data[at + 2].astype(np.uint64) << np.uint64(16)
        found.append(row[long] | kind.type(1 << WORD_BITS) | (textkernel.mix(three | np.uint64(tag << 24)) >> top).astype(kind))
    every = textkernel.distinct(np.concatenate(found))
    return (every & kind.type(WORD_BINS - 1)).astype("<u2"), np.bincount(every >> kind.type(WORD_BITS + 1), minlength=len(offsets) - 1)


def _packed(bins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], 2 * np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(bins)])


def _unpacked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    stops = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] >> 1
    bins = np.frombuffer(data, "<u2")[stops[0] : stops[-1]] if data is not None else np.zeros(0, "<u2")
    return bins, np.diff(stops)


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str, size_col: str) -> list[Column]:
    """text, and the bins of the metadata features."""
    hashed = lambda name: F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(BINS)).cast("int")
    size = F.least(F.floor(2 * F.log2(F.greatest(F.coalesce(F.col(size_col).cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)), F.lit(BINS - 1)).cast("int")
    return [F.col(text_col).alias("text"), hashed(source_col).alias("source"), hashed(lang_col).alias("lang"), size.alias("size")]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """id, one small integer for each feature of both views, and `words`: the hashed words as packed 16-bit bins."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *_rows(docs, text_col, lang_col, source_col, size_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textkernel.chunks(batch.column(1)):
                rest = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3, 4)]
                words = _words(data, offsets)
                yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, text_features(data, offsets, words)), _packed(*word_features(data, offsets, words))], names=["id", "source", "lang", "size", *CONTENT, "words"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(textkernel.giving_back(run), f"id {kind}, source int, lang int, size int, " + ", ".join(f"{n} int" for n in CONTENT) + ", words binary")


@dataclass
class View:
    """One classifier: log-odds of each feature's bins, and a calibration of their sum."""

    names: tuple[str, ...]
    odds: dict[str, np.ndarray] = field(default_factory=dict)
    #: Calibrated log-odds for each unit of the sum from -SPAN to SPAN.
    curve: np.ndarray | None = None

    SPAN = 24
    #: Places of the exchange for each of those of the calibration.
    FINE = 16

    def train(self, counts: dict[str, np.ndarray], prior: np.ndarray) -> None:
        """counts[name][label, bin]; bins that were hardly seen say nothing."""
        for name in self.names:
            # Smoothing by the class prior, so that an unseen bin has odds of 1.
            table = counts[name] + (WORD_SMOOTHING if name == "words" else SMOOTHING) * prior[:, None]
            share = table / table.sum(axis=1, keepdims=True)
            self.odds[name] = np.log(share[1] / share[0])

    def raw(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        total = np.add.reduce([self.odds[n][columns[n]] for n in self.names if n != "words"])
        if "words" in self.names:
            # Words of one text depend on each other, so their sum counts by the root of their number.
            bins, sizes = columns["words"]
            sums = np.concatenate(([0.0], np.cumsum(self.odds["words"][bins])))
            stops = np.cumsum(sizes)
            total = total + (sums[stops] - sums[stops - sizes]) / np.sqrt(np.maximum(sizes, 1))
        return total

    def place(self, columns: dict[str, np.ndarray], fine: int = 1) -> np.ndarray:
        return ((np.clip(self.raw(columns), -self.SPAN + 0.5, self.SPAN - 0.5) + self.SPAN) * fine).astype(np.int64)

    def calibrate(self, counts: np.ndarray) -> None:
        """counts[label, place] of held-out documents -> log-odds that are linear in the sum, fitted by Newton steps.

        Targets are drawn in by one document of each label, so that a sum that
        separates all documents doesn't make them certain.
        """
        bad, good = counts.sum(axis=1)
        total = counts.sum(axis=0)
        aim = (counts[1] * (good + 1) / (good + 2) + counts[0] / (bad + 2)) / np.maximum(total, 1)
        x = np.arange(2 * self.SPAN) - self.SPAN + 0.5
        slope, shift = 0.0, np.log((good + 1) / (bad + 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -40, 40)))
            gap, weight = total * (aim - p), total * p * (1 - p)
            # A slope of 0 is what few documents can tell: RIDGE of them weigh against a unit of it.
            gradient = np.array([(gap * x).sum() - RIDGE * slope, gap.sum()])
            curve = np.array([[(weight * x * x).sum() + RIDGE, (weight * x).sum()], [(weight * x).sum(), weight.sum() + 1e-9]])
            step = np.linalg.solve(curve, gradient)
            slope, shift = slope + step[0], shift + step[1]
            if np.abs(step).max() < 1e-9:
                break
        slope = max(slope, 0.0)
        self.curve = np.clip(slope * x + shift, -LIMIT, LIMIT)

    def loss(self, counts: np.ndarray) -> tuple[float, float]:
        """Mean logarithmic loss over counts[label, place] and its standard error; 0 of nothing."""
        each, n = np.log1p(np.exp(np.stack([self.curve, -self.curve]))), max(counts.sum(), 1)
        mean = float((counts * each).sum() / n)
        return mean, math.sqrt(max(float((counts * each**2).sum() / n) - mean**2, 0.0) / n)

    def log_odds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return self.curve[self.place(columns)]


def _probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-log_odds))


VIEWS = ((*CONTENT, "words"), METADATA)
#: Where the counts of each view's features stand in one row of cells: two labels of so many bins each.
_WIDTHS = [(view, name, WORD_BINS if name == "words" else BINS) for view, names in enumerate(VIEWS) for name in names]


def _columns(batch: pa.RecordBatch) -> dict:
    plain = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("label", "held", *CONTENT, *METADATA) if n in batch.schema.names}
    return plain | {"words": _unpacked(batch.column("words"))}


@dataclass
class Picks:
    """What a view calls bad and good: places up to `low` and from `high` on, how many documents lie there, and what each counts."""

    low: int
    high: int
    many: tuple[int, int]
    weights: tuple[float, float]


def _told(columns: dict, other: View, picks: Picks | None, trust: float) -> np.ndarray:
    """What a view trains on, as parts [bad, good] of WHOLE for each row: known labels but those held out, and, where the other
    view is asked, its calibrated probabilities of what it picks, as far as it is trusted; 0 elsewhere."""
    told = np.stack([(columns["label"] == y) & ~columns["held"] for y in (0, 1)]) * WHOLE
    if picks:
        place, unknown = other.place(columns, View.FINE), columns["label"] < 0
        weight = np.where(place <= picks.low, picks.weights[0], np.where(place >= picks.high, picks.weights[1], 0.0))
        good = _probability(other.log_odds(columns))
        told += np.where(unknown, np.round(WHOLE * trust * weight * np.stack([1 - good, good])).astype(np.int64), 0)
    return told


def _entropy(counts: np.ndarray) -> float:
    """The mean logarithmic loss of who only knows how many of each label there are."""
    share = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(share * np.log(share)).sum())


def picks_of(pool: np.ndarray, share: float, good: float) -> Picks:
    """pool[place] counts the unlabelled documents of each score.

    From either end whole places are taken up to the class's part of the share.
    The outermost one that holds any is taken in any case, but never more than
    half of the pool; documents beyond the part count less, so that together
    they count as so many.
    """
    total, ends = int(pool.sum()), []
    for part, counts in ((1 - good, pool), (good, pool[::-1])):
        sums, most = np.cumsum(counts), share * part * total
        last = int(np.searchsorted(sums, max(most, sums[np.flatnonzero(counts)[0]] if total else 0), side="right")) - 1
        many = int(sums[last]) if total and 2 * sums[last] <= total else 0
        ends.append((last, many, min(1.0, most / many)) if many else (-1, 0, 0.0))
    (low, bad, less), (high, fine, more) = ends
    return Picks(low, len(pool) - 1 - high, (bad, fine), (less, more))


def _summed(table: DataFrame, count, cells: int) -> np.ndarray:
    """count(columns, sums) adds to sums[cell] in each task; sums over all tasks, at most `cells` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                count(_columns(batch.slice(lo, SLICE_ROWS)), sums)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(sums[cell])], names=["cell", "n"])

    found = table.select("label", "held", *CONTENT, *METADATA, "words").mapInArrow(textkernel.giving_back(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


@dataclass
class Exchange:
    """What a view said to the other in one round: how many documents it called bad and good, whether the other kept to it, and its loss then."""

    round: int
    teacher: str
    bad: int
    good: int
    kept: bool
    loss: float


def co_train(table: DataFrame, rounds: int = ROUNDS, share: float = EXCHANGED) -> tuple[View, View, float, list[Exchange]]:
    """Both views, the prior log-odds and what was exchanged, from features with columns `label` (1, 0, or -1 where unknown) and `held`.

    The first round trains on the known labels. In each further one either view
    labels, for the other, the unlabelled documents that it is most sure of (by
    class, share of them a round); such a label counts as much as the teacher
    explains of the held-out documents' labels (1 less its loss over that of
    their share), so that a view that knows little says little. A view whose loss on the held-out documents
    such labels raise by more than the standard error of what it was without
    any stays as it was and asks no more. Three jobs a round: a
    histogram of the unlabelled documents' scores, counts of both views' bins
    under the labels told, and counts of the held-out documents' scores.
    """
    views = [View(names) for names in VIEWS]
    stops = np.cumsum([0] + [2 * width for _, _, width in _WIDTHS]).tolist()
    places, prior = 2 * View.SPAN, np.ones(2)

    def counted(picks: list[Picks | None], models: list[View]) -> list[dict[str, np.ndarray]]:
        def bins(columns: dict, sums: np.ndarray) -> None:
            told = [_told(columns, models[1 - view], picks[view], trust[1 - view]) for view in range(2)]
            for (view, name, width), at in zip(_WIDTHS, stops, strict=False):
                found = columns[name]
                for label, parts in enumerate(told[view]):
                    some = parts > 0
                    if name == "words":
                        some, parts = (np.repeat(x, found[1]) for x in (some, parts))
                    bins_of = found[0] if name == "words" else found
                    sums[at + label * width : at + (label + 1) * width] += np.bincount(bins_of[some], weights=parts[some], minlength=width).astype(np.int64)

        counts = _summed(table, bins, stops[-1]) / WHOLE
        return [{name: counts[lo:hi].reshape(2, -1) for (owner, name, _), lo, hi in zip(_WIDTHS, stops[:-1], stops[1:], strict=True) if owner == view} for view in range(2)]

    def held(models: list[View]) -> np.ndarray:
        def scored(columns: dict, sums: np.ndarray) -> None:
            for view, model in enumerate(models):
                sums[view * 2 * places : (view + 1) * 2 * places] += np.bincount(columns["label"] * places + model.place(columns), minlength=2 * places)

        return _summed(table.where("held"), scored, 4 * places).reshape(2, 2, places)

    def pools(models: list[View]) -> np.ndarray:
        fine = places * View.FINE

        def scored(columns: dict, sums: np.ndarray) -> None:
            unknown = columns["label"] < 0
            for view, model in enumerate(models):
                sums[view * fine : (view + 1) * fine] += np.bincount(model.place(columns, View.FINE)[unknown], minlength=fine)

        return _summed(table, scored, 2 * fine).reshape(2, fine)

    bounds, trust, asking, said = [0.0, 0.0], [0.0, 0.0], [True, True], []
    for at in range(rounds):
        picks: list[Picks | None] = [None, None]
        if at:
            found = [picks_of(pool, share * at, prior[1] / prior.sum()) for pool in pools(views)]
            for view in range(2):
                asking[view] = bool(asking[view] and trust[1 - view] and sum(found[1 - view].many))
                picks[view] = found[1 - view] if asking[view] else None
            if not any(asking):
                break
        counts = counted(picks, views)
        if not at:
            prior = counts[0]["upper"].sum(axis=1) + 1
        trained = [View(names) for names in VIEWS]
        for model, bins_of in zip(trained, counts, strict=True):
            model.train(bins_of, prior / prior.sum())
        seen = held(trained)
        for view, model in enumerate(trained):
            model.calibrate(seen[view])
            loss, error = model.loss(seen[view])
            if not at:
                views[view], bounds[view] = model, loss + error
                trust[view] = max(0.0, 1 - loss / entropy) if (entropy := _entropy(seen[view].sum(axis=1))) else 0.0
            elif asking[view]:
                asking[view] = loss <= bounds[view]
                said.append(Exchange(at, ("metadata", "content")[view], *picks[view].many, asking[view], loss))
                if asking[view]:
                    views[view] = model
    return views[0], views[1], float(np.log(prior[1] / prior[0])), said


def _trained(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rounds: int, columns: dict) -> tuple[DataFrame, tuple[View, View, float]]:
    """The features of all documents, written, and what co-training made of them."""
    textkernel.small_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession)
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    # Rows without an id have no label; they are dealt out so that they don't meet in one task of the join. Labels grow with
    # the corpus, so they aren't broadcast at any size.
    part = F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    known = features(docs, id_col=id_col, **columns).withColumn("part", part).join(told.withColumn("part", F.lit(0).cast("long")).hint("merge"), ["id", "part"], "left").drop("part")
    drawn = F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(HELD_OUT)) == 0
    table = known.withColumn("label", F.coalesce("label", F.lit(-1))).withColumn("held", (F.col("label") >= 0) & drawn)
    table = space.write(table, "features")
    return table, co_train(table, rounds)[:3]


def _scores(found: dict, content: View, metadata: View, prior: float) -> list[np.ndarray]:
    one, two = content.log_odds(found), metadata.log_odds(found)
    return [_probability(x) for x in (one, two, one + two - prior)]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", keep: float = KEEP, rounds: int = ROUNDS, **columns) -> DataFrame:
    """Per document: id, p_content, p_metadata, score (probability of good quality by both views) and kept (score >= keep).

    Labelled documents train the views, but those of one id in HELD_OUT, which
    calibrate them; where an id has several labels, the majority counts and a
    tie counts as good. Documents without a label, and all documents, are
    scored. Without any label every score is 1/2 and all are kept. Null and
    empty texts are documents without words; null sources and languages are a
    value of their own, a null size is 0; each row gives one row.
    """
    table, model = _trained(docs, labels, id_col, label_col, rounds, columns)
    kind = table.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, _scores(_columns(batch), *model))], names=[id_col, "p_content", "p_metadata", "score"])

    scored = table.drop("label", "held").mapInArrow(textkernel.giving_back(score), f"`{id_col}` {kind}, p_content double, p_metadata double, score double")
    return scored.withColumn("kept", F.col("score") >= keep)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", keep: float = KEEP, rounds: int = ROUNDS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """docs without the rows that the classifier rejects; each row is judged by itself, whatever its id, and keeps its columns."""
    columns = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col, "size_col": size_col}
    _, model = _trained(docs, labels, id_col, label_col, rounds, columns)
    n = len(docs.columns)
    beside = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), *_rows(docs, **columns))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = {name: batch.column(n + 1 + i) for i, name in enumerate(("source", "lang", "size"))}
            for lo, hi, data, offsets in textkernel.chunks(batch.column(n)):
                found = {name: c.slice(lo, hi - lo).to_numpy(zero_copy_only=False) for name, c in rest.items()}
                words = _words(data, offsets)
                found |= dict(zip(CONTENT, text_features(data, offsets, words), strict=True)) | {"words": word_features(data, offsets, words)}
                good = pa.array(_scores(found, *model)[2] >= keep)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(n)], names=[f"c{i}" for i in range(n)]).filter(good)

    kept = beside.mapInArrow(textkernel.giving_back(judge), ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(docs.columns)))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
