"""Language of whole texts by a linear-chain conditional random field over words.

A word's features are its affixes, the character n-grams inside it (with its
borders) and the word itself as a lexicon entry, hashed into one weight table.
Transitions between the languages of neighbouring words are learned too, on
sequences made of snippets in several languages, so a word is labelled with its
context in code-switched text.  A text's language is the one with the largest
share of its letters by the words' marginals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crf, kernel

#: Learning rows for each language, at most; their whole texts are cut into training snippets of so many words.
ROWS, WORDS = 100, 16
TABLE_BITS = 16
UNDETERMINED = "und"

_FOLD = kernel.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def word_features(data: np.ndarray, offsets: np.ndarray):
    """Hashed features of all words: flat indices, where each word's begin, words by text, and bytes of each word."""
    folded = _FOLD[data]
    starts, ends = kernel.word_spans(folded, offsets)
    bounds = np.searchsorted(starts, offsets)
    size = ends - starts
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bounds, size
    padded = np.concatenate([[32, 32], folded, [32, 32]]).astype(np.uint32)
    cut = offsets[1:-1]
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    c = padded[inside + 2]
    left, right = padded[inside + 1], padded[inside + 3]
    left2 = padded[inside]
    # texts that touch: what stands across the border is a border
    head = np.isin(starts, cut)
    tail = np.isin(ends, cut)
    at = np.concatenate([[0], np.cumsum(size)])
    left[at[:-1][head]] = 32
    right[at[1:][tail] - 1] = 32
    left2[at[:-1]] = 32
    second = at[:-1][size > 1] + 1
    left2[second] = 32
    two = (left * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77))
    three = two ^ (right * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F)
    four = three * np.uint32(0x165667B1) ^ (left2 * np.uint32(0xD3A2646C))
    sums = kernel.prefix(folded)
    lexicon = kernel.span_hash(sums, starts, ends)
    opening = kernel.span_hash(sums, starts, np.minimum(starts + 3, ends)) + np.uint64(77)
    closing = kernel.span_hash(sums, np.maximum(ends - 3, starts), ends) + np.uint64(7777)
    shift = np.uint64(64 - TABLE_BITS)
    per_word = np.stack([kernel.mix(x) >> shift for x in (lexicon, opening, closing)], axis=1).astype(np.int64)
    grams = np.stack([kernel.mix(x.astype(np.uint64) + np.uint64(k << 40)) >> shift for k, x in enumerate((two, three, four))], axis=1).astype(np.int64)
    # a word's n-grams lie next to each other, its three other features after them
    count = 3 * size + 3
    where = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(where[-1], np.int64)
    flat[np.repeat(where[:-1] - 3 * at[:-1], 3 * size) + np.arange(3 * len(inside))] = grams.reshape(-1)
    for k in range(3):
        flat[where[1:] - 3 + k] = per_word[:, k]
    return flat, where[:-1], bounds, size


def emissions(flat: np.ndarray, where: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the features' weights, word by word, each word scaled by its number of features."""
    if not len(where):
        return np.zeros((0, weights.shape[1]))
    count = np.diff(np.concatenate([where, [len(flat)]]))
    return np.add.reduceat(weights[flat], where, axis=0) / np.sqrt(count)[:, None]


def _scatter(items, weights, gradient=None):
    flat = np.concatenate([f for f, _ in items])
    size = np.concatenate([np.diff(np.concatenate([w, [len(f)]])) for f, w in items])
    where = np.concatenate([[0], np.cumsum(size)[:-1]])
    if weights is not None:
        return emissions(flat, where, weights)
    scaled = np.repeat(gradient / np.sqrt(size)[:, None], size, axis=0)
    return np.stack([np.bincount(flat, column, 1 << TABLE_BITS) for column in scaled.T], axis=1)


def snippets(docs: DataFrame) -> DataFrame:
    """Snippets (lang, text) that together are the whole texts of ``docs(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").split()
                out = [" ".join(words[k : k + WORDS]) for k in range(0, len(words), WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.string())], ["lang", "text"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, text string")


def fit(learn: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights and transitions from ``learn(id, lang, text)``; bounded by ROWS for each language."""
    hashed = F.xxhash64("id", F.lit(2))
    usable = learn.where("lang is not null and text is not null and id is not null")
    picked = usable.select("id", "lang")
    for salt in (F.pmod(F.xxhash64("id"), F.lit(64)), F.lit(0)):  # first within shares of a language, so none is ranked whole by one task
        order = Window.partitionBy("lang", salt).orderBy(hashed, "id")
        picked = picked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ROWS).select("id", "lang")
    # a few hundred rows for each language
    rows = snippets(usable.join(F.broadcast(picked), ["id", "lang"])).toPandas().sort_values(["lang", "text"])
    rows = rows[np.array([any(ch.isalpha() for ch in x) for x in rows["text"]], bool)]
    langs = sorted(rows["lang"].unique())
    index = {x: i for i, x in enumerate(langs)}
    if len(langs) < 2:
        return langs, np.zeros((1 << TABLE_BITS, len(langs)), np.float32), np.zeros((len(langs), len(langs)))
    made = []
    for lang, text in zip(rows["lang"], rows["text"], strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        flat, where, _, _ = word_features(raw, np.array([0, len(raw)]))
        if len(where):
            made.append((flat, where, index[lang]))
    # sequences of snippets in changing languages
    rng = np.random.default_rng(3)
    order_ = rng.permutation(len(made))
    features, labels = [], []
    for a in range(0, len(order_), 2):
        group = [made[i] for i in order_[a : a + 2]]
        lengths = [len(f) for f, _, _ in group]
        features.append((np.concatenate([f for f, _, _ in group]), np.concatenate([w + sum(lengths[:k]) for k, (_, w, _) in enumerate(group)])))
        labels.append(np.concatenate([np.full(len(w), y) for _, w, y in group]))
    weights, transition = crf.train(features, _scatter, labels, len(langs), 1 << TABLE_BITS, epochs=4, batch=128)
    return langs, weights.astype(np.float32), transition


def identify(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every whole text; returns id, lang_pred and score.

    ``learn`` holds labelled rows with the same columns; only its texts and
    non-null languages are learned from, the whole texts of ROWS rows by language
    at most, by a hash of the id.  ``score`` is the share (0 to 1) of the text's letters that the
    marginals give to ``lang_pred``; at a tie the first language in order wins.
    A text that is null or has no letter is ``und`` with score 0, as is every text
    if nothing was learned.  Repeated rows are judged alike.  Empty input: no rows.
    Other columns are not read.
    """
    idt = docs.schema[id_col].dataType.simpleString()
    langs, weights, transition = fit(learn.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    limit = max(1 << 15, (1 << 20) // max(4, len(langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.pieces(offsets, limit):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                share = np.zeros((j - i, max(1, len(langs))))
                if langs:
                    share = _shares(part, cut, weights, transition, limit)
                total = share.sum(axis=1)
                best = share.argmax(axis=1)
                score = np.where(total > 0, share[np.arange(j - i), best] / np.maximum(total, 1e-30), 0.0)
                names = []
                for k in range(j - i):
                    known = total[k] > 0 and (_ASCII_LETTER[part[cut[k] : cut[k + 1]]].any() or any(c.isalpha() for c in part[cut[k] : cut[k + 1]].tobytes().decode("utf-8", "ignore")))
                    names.append(langs[best[k]] if known else UNDETERMINED)
                    score[k] = score[k] if known else 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {idt}, lang_pred string, score double").withColumnRenamed("id", id_col)


_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def _shares(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, transition: np.ndarray, limit: int) -> np.ndarray:
    """Letters (bytes of words) that each language gets in each text; one text of more than ``limit`` bytes part by part."""
    if len(data) > limit:
        cuts = list(kernel.cuts(data, _FOLD == 32, limit))

        def parts(column: int) -> Iterator[np.ndarray]:
            for a, z in cuts:
                flat, where, _, size = word_features(data[a:z], np.array([0, z - a]))
                yield emissions(flat, where, weights).astype(float) if column == 0 else size

        share = np.zeros((1, weights.shape[1]))
        for gamma, size in zip(crf.long_marginals(lambda: parts(0), transition), parts(1), strict=True):
            share += (gamma * size[:, None]).sum(axis=0)
        return share
    flat, where, bounds, size = word_features(data, offsets)
    gamma = crf.marginals(emissions(flat, where, weights).astype(float), bounds, transition)
    weighted = gamma * size[:, None]
    sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(weighted, axis=0)])
    return np.where(np.diff(bounds)[:, None] > 0, sums[bounds[1:]] - sums[bounds[:-1]], 0.0)
