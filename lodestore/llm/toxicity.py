"""Toxicity by class-conditional Kneser-Ney models.

One model of the toxic and one of the ordinary labelled documents give each word a
probability after the word before it.  Both back off from word pairs to words, from
words to their openings (words that begin alike) and from there to counts that they
share: how many different words of all documents begin so.  Counts are Kneser-Ney's,
of different contexts: of a pair the words before it, of a word likewise, of an
opening the words that begin so; a passage that was copied counts once.

A text is compared by the difference of its two log-likelihoods, divided by its
number of words.  As a long text may hold little that is toxic, so are its two and its
six most toxic words, wherever they stand.  A logistic regression, fitted on learning
rows that the counts have not seen, turns these and the length into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Stored
from .logistic import Logistic

#: Labelled rows that the models are fitted on, at most, by class; their whole texts are read.
TOXIC_ROWS, ORDINARY_ROWS = 4000, 9000
#: Words that must precede a pair for it to be modelled; a rarer one is left to its second word.
PAIR_CONTEXTS = 5
#: Bytes of a word's opening.
OPENING = 8
#: Most toxic words of a text that are taken together.
WORST = (2, 6)
#: Distinct words that a task holds before it hands them on.
HELD = 500_000
_FEATURES = ["whole", *(f"worst{n}" for n in WORST), "length"]

#: Words are runs of letters: ASCII letters in lower case and all bytes beyond ASCII.
_WORDS = kernel.LOWER.copy()
_WORDS[[b for b in range(128) if not chr(b).isalpha()]] = 32
_START = np.uint64(1)


def _fold(data: np.ndarray) -> np.ndarray:
    """Letters in lower case, also the accented ones of Latin-1; everything else is a gap."""
    out = _WORDS[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[capital] += 32
    return out


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return kernel.mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


class Grams:
    """Hashes of words, of the words before them and of openings, and where each text's words begin; a text's first word stands after a fixed one."""

    def __init__(self, folded: np.ndarray, offsets: np.ndarray, before: np.uint64 = _START):
        start, end = kernel.word_spans(folded, offsets)
        self.bounds = np.searchsorted(start, offsets)
        sums = kernel.prefix(folded)
        self.word = kernel.mix(kernel.span_hash(sums, start, end))
        self.opening = kernel.mix(kernel.span_hash(sums, start, np.minimum(start + OPENING, end)) + np.uint64(7))
        self.previous = self.shifted(self.word, before)

    def shifted(self, x: np.ndarray, before: np.uint64 = _START) -> np.ndarray:
        out = np.concatenate([[before], x[:-1]])[: len(x)]
        first = self.bounds[:-1][self.bounds[:-1] < len(x)]
        out[first] = before
        return out


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[Grams]:
    """The grams of some texts, or part by part those of one text beyond PIECE bytes; a run of letters beyond that counts as several words."""
    if len(data) <= kernel.PIECE:
        yield Grams(_fold(data), offsets)
        return
    folded, before = _fold(data), _START
    for a, z in kernel.cuts(folded, kernel.SPACE, kernel.PIECE):
        made = Grams(folded[a:z], np.array([0, z - a]), before)
        before = made.word[-1] if len(made.word) else before
        yield made


def gram_rows(docs: DataFrame) -> DataFrame:
    """Rows (toxic, triple, previous, word, opening) of ``docs(toxic, text)``, distinct within a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            data, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.pieces(offsets):
                for g in grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    label = np.repeat(toxic[i:j], np.diff(g.bounds))
                    triple = _pair(g.shifted(g.previous), _pair(g.previous, g.word))
                    first = np.unique(triple ^ label.astype(np.uint64), return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([pa.array(label[first]), *(pa.array(x[first].view(np.int64)) for x in (triple, g.previous, g.word, g.opening))], ["toxic", "triple", "previous", "word", "opening"])

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, triple long, previous long, word long, opening long")


def shared_counts(texts: DataFrame, openings: np.ndarray) -> tuple[np.ndarray, int]:
    """How many different words of all documents begin with each of the sorted ``openings``, and how many there are at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            word, first = np.unique(np.concatenate([w for w, _ in held]), return_index=True)
            opening = np.concatenate([o for _, o in held])[first]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (opening, word)], ["opening", "word"])

        held, size = [], 0
        for batch in batches:
            data, offsets = kernel.strings(batch.column(0))
            for i, j in kernel.pieces(offsets):
                for g in grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    word, first = np.unique(g.word, return_index=True)
                    held.append((word, g.opening[first]))
                    size += len(word)
                    if size > HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    words = texts.select("text").mapInArrow(run, "opening long, word long").distinct()
    types = Stored(words.groupBy("opening").agg(F.count(F.lit(1)).alias("n")), "openings")
    spark = texts.sparkSession
    known = spark.createDataFrame(pa.table({"opening": openings.view(np.int64)}))
    # no more than the learning sample holds
    found = types.df.join(F.broadcast(known), "opening").toArrow()
    total = types.df.agg(F.sum("n")).first()[0] or 0
    types.drop()
    out = np.ones(len(openings), np.int64)
    out[np.searchsorted(openings, found.column("opening").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    return out, max(total, len(openings))


def _place(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in the sorted ``known``; its length where they are not in it."""
    if not len(known):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, len(known))


def amounts(one: int, two: int, three: int, four: int) -> np.ndarray:
    """What modified Kneser-Ney takes off a count of none, one, two and more, estimated from how many counts are one to four."""
    one, two, three, four = (max(1, n) for n in (one, two, three, four))
    y = one / (one + 2 * two)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.1 * k), 0.95 * k) for k, a, b in ((1, one, two), (2, two, three), (3, three, four)))])


def take_off(n: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[np.minimum(n, 3).astype(int)]


class KneserNey:
    """Probabilities of one class, level by level.

    ``opening``, ``word`` and ``pair`` are counts (only pairs that are modelled, of which
    ``pair_amounts`` are taken off); ``word_opening``, ``pair_word`` and ``pair_context``
    tell which opening a word has, and which words make a pair; ``context_size`` is the
    sum of the counts of all pairs after a word; ``shared_opening`` and ``shared_word``
    are the shared probability of an opening, and of a word that has it.  What is taken
    off a level is its ``rest``, given to the level below.
    """

    def __init__(self, opening, word, pair, pair_amounts, word_opening, pair_word, pair_context, context_size, shared_opening, shared_word):
        def level(n: np.ndarray) -> tuple[np.ndarray, float]:
            d = take_off(n, amounts(*(np.count_nonzero(n == k) for k in (1, 2, 3, 4))))
            return (n - d) / n.sum(), d.sum() / n.sum()

        p, self.opening_rest = level(opening)
        self.opening = p + self.opening_rest * shared_opening
        p, self.word_rest = level(word)
        self.word = p + self.word_rest * self.opening[word_opening] * shared_word[word_opening]
        kept = np.where(pair >= PAIR_CONTEXTS, pair - take_off(pair, pair_amounts), 0) / np.maximum(context_size, 1)[pair_context]
        self.context_rest = 1 - np.bincount(pair_context, kept, len(context_size))
        self.pair = kept + self.context_rest[pair_context] * self.word[pair_word]


class Model:
    """Differences of the two classes' log-probabilities: of modelled pairs, and, where there is none, of a word and of what its context leaves to it.

    What neither class has seen is left to the shared counts by both, so these cancel
    out and only what each class leaves to them counts.
    """

    def __init__(self, rows: DataFrame, texts: DataFrame):
        triples = gram_rows(rows).groupBy("triple", "previous", "word", "opening").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("o"))
        held = Stored(triples.groupBy("previous", "word", "opening").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "pairs")
        pairs = held.df
        column = lambda table, c: table.column(c).to_numpy()
        hashes = lambda table, c: column(table, c).view(np.uint64)
        words = pairs.groupBy("word").agg(F.min("opening").alias("opening"), *[F.count_if(F.col(c) > 0).alias(c) for c in "to"]).toArrow()
        self.known = all(column(words, c).any() for c in "to") if words.num_rows else False
        if not self.known:
            held.drop()
            return
        often = pairs.agg(*[F.count_if(F.col(c) == k) for c in "to" for k in (1, 2, 3, 4)]).first()
        heavy = pairs.where(F.greatest("t", "o") >= PAIR_CONTEXTS)
        modelled = heavy.toArrow()
        after = pairs.join(heavy.select("previous").distinct(), "previous", "left_semi").groupBy("previous").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).toArrow()
        held.drop()
        order = np.argsort(hashes(words, "word"))
        self.words = hashes(words, "word")[order]
        self.openings, word_opening = np.unique(hashes(words, "opening")[order], return_inverse=True)
        by_context = np.argsort(hashes(after, "previous"))
        contexts = hashes(after, "previous")[by_context]
        pair_word, pair_context = np.searchsorted(self.words, hashes(modelled, "word")), np.searchsorted(contexts, hashes(modelled, "previous"))
        begin_so, total = shared_counts(texts, self.openings)

        def model(c: str, pair_amounts: np.ndarray) -> KneserNey:
            n = column(words, c)[order]
            openings = np.bincount(word_opening, n > 0, len(self.openings))
            return KneserNey(openings, n, column(modelled, c), pair_amounts, word_opening, pair_word, pair_context, column(after, c)[by_context], begin_so / total, 1 / begin_so)

        toxic, ordinary = model("t", amounts(*often[:4])), model("o", amounts(*often[4:]))
        gain = lambda a, b: np.log(a) - np.log(b)
        end = lambda known, other: np.append(known, other).astype(np.float32)  # noqa: E731  the last place is for what is not in a table
        unseen = gain(toxic.word_rest * toxic.opening_rest, ordinary.word_rest * ordinary.opening_rest)
        self.opening_gain = end(gain(toxic.word_rest * toxic.opening, ordinary.word_rest * ordinary.opening), unseen)
        self.word_gain = end(gain(toxic.word, ordinary.word), np.nan)
        left = gain(toxic.context_rest, ordinary.context_rest)
        some = np.flatnonzero(left)
        self.contexts, self.context_gain = contexts[some], end(left[some], 0.0)
        names = _pair(hashes(modelled, "previous"), hashes(modelled, "word"))
        order = np.argsort(names)
        self.pairs, self.pair_gain = names[order], end(gain(toxic.pair, ordinary.pair)[order], np.nan)

    def gains(self, g: Grams) -> np.ndarray:
        """Difference of the log-probabilities of each word after the one before it."""
        out = self.pair_gain[_place(self.pairs, _pair(g.previous, g.word))]
        at = np.flatnonzero(np.isnan(out))
        single = self.word_gain[_place(self.words, g.word[at])]
        new = np.flatnonzero(np.isnan(single))
        single[new] = self.opening_gain[_place(self.openings, g.opening[at[new]])]
        out[at] = single + self.context_gain[_place(self.contexts, g.previous[at])]
        return out

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By text: differences a word of all of it and of its most toxic words; its size. Not-a-number without words."""
        out = np.full((len(offsets) - 1, len(_FEATURES)), np.nan)
        made, bounds, worst = [], None, []
        for g in grams(data, offsets):
            made.append(self.gains(g) if self.known else np.zeros(len(g.word), np.float32))
            worst.append(_worst(g.word, made[-1], g.bounds))
            bounds = g.bounds if bounds is None else np.array([0, bounds[1] + len(g.word)])
        size = np.diff(bounds) if bounds is not None else np.zeros(1, int)
        some = np.flatnonzero(size)
        if not len(some):
            return out
        if len(made) > 1:
            worst = [_worst(np.concatenate([w for w, _, _ in worst]), np.concatenate([v for _, v, _ in worst]), np.array([0, sum(len(w) for w, _, _ in worst)]))]
        sums = np.concatenate([[0.0], np.cumsum(np.concatenate(made), dtype=np.float64)])
        a, z = bounds[:-1][some], bounds[1:][some]
        out[some, 0] = (sums[z] - sums[a]) / size[some]
        out[some, -1] = np.log(size[some])
        _, value, cut = worst[0]
        top = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        for k, n in enumerate(WORST, 1):
            last = np.minimum(cut[:-1] + n, cut[1:])[some]
            out[some, k] = (top[last] - top[cut[:-1][some]]) / (last - cut[:-1][some])
        return out


def _worst(word: np.ndarray, gain: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the few different words with the largest gains, largest first: words, gains, and where each text's begin."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((-gain, word, text))
    t, w = text[order], word[order]
    order = order[np.concatenate([[True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])])[: len(order)]]
    order = order[np.lexsort((-gain[order], text[order]))]
    first = np.searchsorted(text[order], np.arange(len(bounds)))
    order = order[np.arange(len(order)) - first[text[order]] < max(WORST)]
    return word[order], gain[order], np.searchsorted(text[order], np.arange(len(bounds)))


def _scores(x: np.ndarray, finish: Logistic) -> np.ndarray:
    """Calibrated scores; a text without words has nothing that counts against it."""
    return np.where(np.isnan(x[:, 0]), 0.0, finish(np.nan_to_num(x)))


def _featured(docs: DataFrame, model: Model, id_type: str, finish=None) -> DataFrame:
    """id and the features of ``docs(id, text)``, or id and ``finish`` of them."""
    names = _FEATURES if finish is None else ["score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column(1))
            for i, j in kernel.pieces(offsets):
                x = model.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                columns = x.T if finish is None else [_scores(x, finish)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c) for c in columns)], ["id", *names])

    return docs.select("id", "text").mapInArrow(run, f"id {id_type}, " + ", ".join(f"{n} double" for n in names))


def _fit(texts: DataFrame, learn: DataFrame, id_col: str, id_type: str) -> tuple[Model, Logistic]:
    """Model and calibration from the rows of ``texts(id, text)`` that ``learn`` labels, and from the words of all of them."""
    order = F.xxhash64("id", F.lit(9))
    known = learn.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").distinct()
    sample = known.where("toxic = 1").orderBy(order, "id").limit(TOXIC_ROWS).unionByName(known.where("toxic = 0").orderBy(order, "id").limit(ORDINARY_ROWS))
    # the sample's size is bounded by the two limits
    rows = texts.where("text is not null").join(F.broadcast(sample), "id").withColumn("fit", F.pmod(F.xxhash64("id", F.lit(10)), F.lit(4)) > 0)
    held = Stored(rows, "toxicity-sample")
    model = Model(held.df.where("fit"), texts)
    fitted = _featured(held.df.where("not fit"), model, id_type).join(F.broadcast(sample), "id").toPandas()
    fitted = fitted[fitted["whole"].notna()]
    finish = Logistic(fitted[_FEATURES].to_numpy(float), fitted["toxic"].to_numpy(float))
    if finish.weights is None:
        finish.share = float(held.df.agg(F.avg("toxic")).first()[0] or 0.0)
    held.drop()
    return model, finish


def score_toxicity(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document for toxicity; returns id, score (0 to 1) and predicted (score >= 0.5).

    ``learn(id, toxic)`` names the labelled documents to learn from.  At most
    TOXIC_ROWS and ORDINARY_ROWS of them are used, by a hash of the id; three of
    four feed the class counts and the fourth the calibration.  The shared counts
    are of all rows of ``docs``.  Whole texts are read.  A null or empty text, or one
    without a letter, scores 0.  Null labels and ids are not learned from; without
    both classes every score is the share of toxic labels, 0 if there are none.
    Repeated rows score alike.  Empty input: no rows.  Other columns are not read.
    """
    idt = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model, finish = _fit(texts, learn, id_col, idt)
    scored = _featured(texts, model, idt, finish)
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score_toxicity`` does not predict toxic."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model, finish = _fit(texts, learn, id_col, docs.schema[id_col].dataType.simpleString())
    packed = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column(0))
            for i, j in kernel.pieces(offsets):
                score = _scores(model.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), finish)
                yield batch.slice(i, j - i).filter(pa.array(score < 0.5))

    return packed.mapInArrow(run, packed.schema).select("row.*")
