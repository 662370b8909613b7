"""Quality of documents by a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own form and that of the lines before
and after it: lengths, kinds of characters, repeated words, repeated lines.  Only
whole documents carry labels, so training starts with every line labelled as its
document and then lets lines of bad documents that look good change sides once.
A document's score comes from its lines' forward-backward marginals, weighted by
their lengths; a logistic regression on rows the field has not seen calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, kernel
from .common import Stored
from .logistic import Logistic

#: Learning rows for each label, at most; and lines of one training sequence: a longer text gives several.
ROWS, LINES = 2500, 2000
#: Bytes of text handled at once.  A longer line counts as several, cut at white space where there is some.
PART = 1 << 17


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_KINDS = [
    np.array([65 <= b <= 90 for b in range(256)]),
    np.array([97 <= b <= 122 for b in range(256)]),
    np.arange(256) >= 128,
    _table("0123456789"),
    _table(" \t\r\x0b\x0c"),
    _table("!?"),
    _table("|"),
    _table("#$%&*@^~<>{}[]=+\\_/`"),
    _table(".,;:'\"()-"),
]
_SHARES = np.array([0.0, 0.004, 0.012, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
#: Features of a line, bins of each, and lines looked at: the one before, itself, the one after.
N_FEATURES, BINS, CONTEXT = 17, 16, 3
WIDTH = N_FEATURES * BINS * CONTEXT


def parts_of(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a text that hold whole lines, without the line end after them, and at most PART bytes."""
    at = 0
    while at + PART < len(data):
        window = data[at : at + PART]
        ends = np.flatnonzero(window == 10)
        gaps = ends if len(ends) else np.flatnonzero(kernel.SPACE[window]) + 1
        stop = at + (int(gaps[-1]) if len(gaps) else PART)
        yield at, stop
        at = stop + int(len(ends) > 0)
    yield at, len(data)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and where each text's lines begin."""
    newline = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, newline, "right") - 1
    lines_of = np.bincount(owner, minlength=len(offsets) - 1) + 1
    bounds = np.concatenate([[0], np.cumsum(lines_of)])
    total = int(bounds[-1])
    start = np.empty(total, np.int64)
    end = np.empty(total, np.int64)
    first = np.zeros(total, bool)
    first[bounds[:-1]] = True
    last = np.zeros(total, bool)
    last[bounds[1:] - 1] = True
    start[first], start[~first] = offsets[:-1], newline + 1
    end[last], end[~last] = offsets[1:], newline
    return start, end, bounds


def repeats(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a long text's distinct lines, in order, and how often each occurs."""
    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, z in parts_of(data):
        start, end, _ = _lines(data[a:z], np.array([0, z - a]))
        held.append(np.unique(kernel.mix(kernel.span_hash(kernel.prefix(data[a:z]), start, end)), return_counts=True))
        while len(held) > 1 and 2 * len(held[-1][0]) >= len(held[-2][0]):  # like sizes, so each hash is merged few times
            (h, n), (h2, n2) = held.pop(), held.pop()
            both, back = np.unique(np.concatenate([h, h2]), return_inverse=True)
            held.append((both, np.bincount(back, np.concatenate([n, n2]), len(both)).astype(np.int64)))
    both, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    return both, np.bincount(back, np.concatenate([n for _, n in held]), len(both)).astype(np.int64)


def line_bins(data: np.ndarray, offsets: np.ndarray, often: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binned features (lines x N_FEATURES), where each text's lines begin, and lengths in bytes; a text has at least one line.

    ``often`` is what ``repeats`` gives of the text that ``data`` is a part of.
    """
    n = len(data)
    start, end, bounds = _lines(data, offsets)
    lines_of, total = np.diff(bounds), len(start)
    length = end - start
    values = np.zeros((total, N_FEATURES))
    some = np.maximum(length, 1)
    sums = np.zeros(n + 1, np.int32)
    counts = []
    for kind in _KINDS:
        np.cumsum(kind[data], out=sums[1:], dtype=np.int32)
        counts.append(sums[end] - sums[start])
    letters = np.maximum(counts[0] + counts[1] + counts[2], 1)
    values[:, 0] = counts[0] / letters
    for k in range(1, 9):
        values[:, k] = counts[k] / some
    ws, we = kernel.word_spans(data, offsets)
    line = np.searchsorted(start, ws, "right") - 1
    words = np.bincount(line, minlength=total)
    hashes = kernel.span_hash(kernel.prefix(kernel.LOWER[data]), ws, we)
    key = kernel.mix(hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    head = np.unique(key, return_index=True)[1]
    distinct = np.bincount(line[head], minlength=total)
    many = np.maximum(words, 1)
    values[:, 9] = 1 - distinct / many
    twice = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]) if len(ws) > 1 else np.zeros(0, bool)
    values[:, 10] = np.bincount(line[1:][twice], minlength=total) / many if len(ws) > 1 else 0.0
    # lines that their text holds more than once
    whole = kernel.mix(kernel.span_hash(kernel.prefix(data), start, end))
    if often is None:
        _, back, count = np.unique(whole ^ kernel.mix(np.repeat(np.arange(len(lines_of), dtype=np.uint64), lines_of)), return_inverse=True, return_counts=True)
        count = count[back]
    else:
        count = often[1][np.searchsorted(often[0], whole)]
    values[:, 11] = np.where(length > 0, 1 - 1 / count, 0)
    tail = data[np.maximum(end - 1, 0)] if n else np.zeros(total, np.uint8)
    lead = data[np.minimum(start, n - 1)] if n else np.zeros(total, np.uint8)
    bins = np.searchsorted(_SHARES, values[:, :12], "right")
    out = np.zeros((total, N_FEATURES), np.uint8)
    out[:, :12] = bins
    out[:, 12] = np.minimum(np.log2(length + 1), BINS - 1)
    out[:, 13] = np.minimum(np.log2(words + 1) * 1.5, BINS - 1)
    out[:, 14] = np.minimum(length / many, BINS - 1)
    out[:, 15] = np.where(length > 0, 1 + np.isin(tail, [46, 33, 63, 58]) + 2 * np.isin(tail, [124, 42, 35, 36, 37, 38]), 0)
    out[:, 16] = np.where(length > 0, 1 + ((lead >= 65) & (lead <= 90)) + 2 * ((lead >= 48) & (lead <= 57)), 0)
    return out, bounds, length


def with_neighbours(bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Indices into the weight table for the line before, the line itself and the line after; bin BINS - 1 marks a missing neighbour."""
    total = len(bins)
    shifted = np.full((CONTEXT, total, N_FEATURES), BINS - 1, np.int32)
    shifted[1] = bins
    shifted[0, 1:] = bins[:-1]
    shifted[0, bounds[:-1]] = BINS - 1
    shifted[2, :-1] = bins[1:]
    shifted[2, bounds[1:] - 1] = BINS - 1
    base = np.arange(N_FEATURES, dtype=np.int32) * BINS
    return np.concatenate([shifted[k] + base + k * N_FEATURES * BINS for k in range(CONTEXT)], axis=1)


def _scatter(items, weights, gradient=None):
    index = np.concatenate([with_neighbours(b, np.array([0, len(b)])) for b in items])
    if weights is not None:
        return sum(weights[column] for column in index.T)
    return np.stack([np.bincount(index.reshape(-1), np.repeat(gradient[:, k], index.shape[1]), WIDTH) for k in range(gradient.shape[1])], axis=1)


class LineField:
    """The fitted field."""

    def __init__(self, bins: list[np.ndarray], labels: list[int]):
        cut = [(b[k : k + LINES], y) for b, y in zip(bins, labels, strict=True) for k in range(0, len(b), LINES)]
        features = [b for b, _ in cut]
        gold = [np.full(len(b), y) for b, y in cut]
        self._fit(features, gold)
        for i, (b, y) in enumerate(cut):
            if y == 0:
                good = self._good(b, np.array([0, len(b)]))
                new = (good > 0.5).astype(int)
                if new.all():
                    new[good.argmin()] = 0
                gold[i] = new
        self._fit(features, gold)

    def _fit(self, features, gold) -> None:
        self.weights, self.transition = crf.train(features, _scatter, gold, 2, WIDTH, epochs=6, rate=0.1, ridge=1e-4)

    def _emission(self, bins: np.ndarray, bounds: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Emissions of the lines; ``before`` and ``after`` are the lines next to a part of a text."""
        table = self.weights.reshape(CONTEXT, N_FEATURES, BINS, 2)
        take = lambda k, b: sum(table[k, f][b[..., f]] for f in range(N_FEATURES))
        none = np.full(N_FEATURES, BINS - 1)
        left, own, right = (take(k, bins) for k in range(CONTEXT))
        own[1:] += left[:-1]
        own[:-1] += right[1:]
        inner = bounds[1:-1]
        own[inner] += take(0, none) - left[inner - 1]
        own[inner - 1] += take(2, none) - right[inner]
        own[0] += take(0, none if before is None else before)
        own[-1] += take(2, none if after is None else after)
        return own

    def _good(self, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return crf.marginals(self._emission(bins, bounds), bounds, self.transition)[:, 1]

    @staticmethod
    def _sums(good: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By document: weight, and weighted sums of the good marginals, their log-odds and bad lines; the least marginal."""
        good = np.clip(good, 1e-4, 1 - 1e-4)
        weight = length + 1.0
        add = lambda x: np.add.reduceat(x, at)
        return np.stack([add(weight), add(weight * good), add(weight * np.log(good / (1 - good))), add(weight * (good < 0.5)), np.minimum.reduceat(good, at)])

    @staticmethod
    def _finished(sums: np.ndarray) -> np.ndarray:
        """By document: length-weighted mean of the good marginals, as log-odds; mean log-odds; worst line; share of length in bad lines; log length."""
        total, good, odds, bad, worst = sums
        mean = good / total
        return np.column_stack([np.log(mean / (1 - mean)), odds / total, worst, bad / total, np.log(total)])

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of texts of at most PART bytes together, or of one longer text, part by part."""
        if len(data) <= PART:
            return self.of_bins(*line_bins(data, offsets))
        often = repeats(data)
        parts = lambda: (line_bins(data[a:z], np.array([0, z - a]), often)[::2] for a, z in parts_of(data))
        every = crf.long_marginals(lambda: self._emissions(parts()), self.transition)
        sums = np.concatenate([self._sums(gamma[:, 1], length, np.zeros(1, int)) for gamma, (_, length) in zip(every, parts(), strict=True)], axis=1)
        return self._finished(np.concatenate([sums[:4].sum(axis=1), sums[4:].min(axis=1)])[:, None])

    def _emissions(self, parts) -> Iterator[np.ndarray]:
        before = held = None
        for bins, _ in parts:
            if held is not None:
                yield self._emission(held, np.array([0, len(held)]), before, bins[0])
                before = held[-1]
            held = bins
        yield self._emission(held, np.array([0, len(held)]), before)

    def of_bins(self, bins: np.ndarray, bounds: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._finished(self._sums(self._good(bins, bounds), length, bounds[:-1]))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most PART bytes and as many texts as that has bytes a line of 16; a longer text alone."""
    for i, j in kernel.pieces(offsets, PART):
        for k in range(i, j, PART // 16):
            yield k, min(j, k + PART // 16)


def _text_bins(data: np.ndarray) -> tuple[bytes, bytes]:
    """Bins and line lengths of one text, whatever its size."""
    often = repeats(data) if len(data) > PART else None
    made = [line_bins(data[a:z], np.array([0, z - a]), often)[::2] for a, z in parts_of(data)]
    return b"".join(b.tobytes() for b, _ in made), b"".join(n.astype(np.int64).tobytes() for _, n in made)


def _binned(docs: DataFrame) -> DataFrame:
    """Bins and line lengths of the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column(3))
            for i, j in _pieces(offsets):
                made = [_text_bins(data[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
                rows = [batch.column(k).slice(i, j - i) for k in range(3)] + [pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(rows, ["h", "label", "fit", "bins", "lengths"])

    return docs.select("h", "label", "fit", "text").mapInArrow(run, "h long, label int, fit boolean, bins binary, lengths binary")


def score_quality(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document's quality; returns id, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    ``learn(id, quality)`` names the labelled documents to learn from; at most
    ROWS by label are used, by a hash of the id, three of four for the field and
    the fourth for the calibration.  Whole texts are learned from and scored, line
    by line, a long one part by part with the messages carried over; a line of more
    than PART bytes counts as several.  A null or empty text is one empty line.  Null labels and ids are not learned from;
    without both labels every score is the share of label 1, 1 if there is none.
    Repeated rows score alike.  Empty input: no rows.  Other columns are not read.
    """
    idt = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    h = F.xxhash64("id", F.lit(6))
    known = learn.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sample = known.where("label = 1").orderBy(h, "id").limit(ROWS).unionByName(known.where("label = 0").orderBy(h, "id").limit(ROWS))
    # the sample's size is bounded by the two limits
    chosen = texts.where("text is not null").join(F.broadcast(sample), "id")
    prior = Stored(_binned(chosen.select(h.alias("h"), "label", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) > 0).alias("fit"), "text")), "quality-sample")
    rows = prior.df.toPandas().sort_values(["h", "bins"])
    prior.drop()
    bins = [np.frombuffer(b, np.uint8).reshape(-1, N_FEATURES) for b in rows["bins"]]
    lengths = [np.frombuffer(b, np.int64) for b in rows["lengths"]]
    label, fit = rows["label"].to_numpy(), rows["fit"].to_numpy(bool)
    field, finish = None, Logistic(np.zeros((0, 1)), np.zeros(0))
    finish.share = float(label.mean()) if len(label) else 1.0
    train = np.flatnonzero(fit)
    if len(train) and 0 < label[train].mean() < 1:
        field = LineField([bins[i] for i in train], [int(label[i]) for i in train])
        rest = np.flatnonzero(~fit) if 0 < label[~fit].sum() < (~fit).sum() else train
        x = np.concatenate([field.of_bins(bins[i], np.array([0, len(bins[i])]), lengths[i]) for i in rest])
        # the sample holds both labels alike; the calibration is to the shares among the labelled rows
        finish = Logistic(x, label[rest].astype(float))
        ones, zeros = (known.where(f"label = {k}").count() for k in (1, 0))
        held_ones, held_zeros = (label == 1).sum(), (label == 0).sum()
        finish.weights[0] += np.log(ones / held_ones) - np.log(zeros / held_zeros)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column(1))
            for i, j in _pieces(offsets):
                x = np.zeros((j - i, 1)) if field is None else field.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(finish(x))], ["id", "score"])

    scored = texts.mapInArrow(run, f"id {idt}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
