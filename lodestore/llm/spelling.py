"""Grouping spelling variants by a symmetric-delete join.

Words that differ by one code point meet on what is left when it is deleted: every
word emits itself and its single deletions.  A deletion meets the words equal to it
(one code point inserted or deleted), and it meets the deletions of other words at
the same place (one replaced).  Keys are hashes that need one pass over a word, however
long; a key holds at most as many words as the alphabet has letters, and what meets is
verified on the words.  Each word takes the form its near words suggest, and forms are
followed to their roots by doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, lower_ascii
from .kernel import mix

#: Letters of a run.
LETTERS = "[A-Za-zÀ-ÿ]"
#: Code points that one step emits the deletions of; bounds its memory at about 150 times that.
PIECE = 1 << 17

_SELF, _SHORTER, _PLACE = 0, 1, 2


def word_counts(docs: DataFrame, least: int = 7, id_col: str = "doc_id", text_col: str = "text", spoil: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n: the runs of LETTERS of whole texts, A-Z folded, and how often they occur.

    ``spoil(id, run)`` may replace a folded run.  Words under ``least`` code points are
    left out (so are runs, which a spoilt run may only shorten).  Null texts have none.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS}{{{least},}})"))).alias("run"))
    folded = runs.select("id", lower_ascii(F.col("run")).alias("word"))
    if spoil is not None:
        folded = folded.select(spoil(F.col("id"), F.col("word")).alias("word")).where(F.length("word") >= least)
    return folded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def drop_letter(every: int) -> Callable[[Column, Column], Column]:
    """Delete one code point of each run of which ``every`` divides the crc32 of ``<id>:<run>``; runs without an id stay."""

    def spoilt(id_: Column, run: Column) -> Column:
        h = F.crc32(F.concat(id_.cast("string"), F.lit(":"), run).cast("binary"))
        at = F.pmod(h, F.length(run)).cast("int")
        return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substring(run, F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)

    return spoilt


def _letter(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a code point adds to a word's hash at a place."""
    return mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _placed(key: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(place.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + length.astype(np.uint64)))


def _batch(key, kind, place, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.astype(np.int8)), pa.array(place.astype(np.int32)), pa.array(ids)], ["key", "kind", "place", "id"])


def _emit_long(word: np.ndarray, id_: int) -> Iterator[pa.RecordBatch]:
    """What one long word emits, part by part."""
    n = len(word)
    steps = [(a, min(n, a + PIECE)) for a in range(0, n, PIECE)]
    own, shifted = np.zeros(1, np.uint64), np.zeros(1, np.uint64)  # arrays, so that sums wrap
    for a, z in steps:
        own = own + _letter(word[a:z], np.arange(a, z)).sum(dtype=np.uint64)
        shifted = shifted + _letter(word[a:z], np.arange(a, z) - 1).sum(dtype=np.uint64)
    yield _batch(own, np.array([_SELF]), np.array([-1]), np.array([id_], np.int64))
    before, after = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    for a, z in steps:
        at = np.arange(a, z)
        here = np.cumsum(_letter(word[a:z], at), dtype=np.uint64)
        moved = np.cumsum(_letter(word[a:z], at - 1), dtype=np.uint64)
        key = before + np.concatenate([[np.uint64(0)], here[:-1]]) + shifted - (after + moved)
        first = word[a:z] != np.concatenate([word[a - 1 : a] if a else [np.uint32(0)], word[a : z - 1]])
        yield from _deletions(key, first, at, np.full(z - a, n), np.full(z - a, id_, np.int64))
        before, after = before + here[-1], after + moved[-1]


def _deletions(key, first, at, length, ids) -> Iterator[pa.RecordBatch]:
    yield _batch(key[first], np.full(int(first.sum()), _SHORTER), at[first], ids[first])
    yield _batch(_placed(key, at, length), np.full(len(key), _PLACE), at, ids)


def _emit_some(words: list[np.ndarray], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What several words emit, in one go."""
    size = np.array([len(w) for w in words])
    code = np.concatenate(words)
    begin = np.cumsum(size) - size
    at = np.arange(len(code)) - np.repeat(begin, size)
    zero = np.zeros(1, np.uint64)
    here = np.concatenate([zero, np.cumsum(_letter(code, at), dtype=np.uint64)])
    moved = np.concatenate([zero, np.cumsum(_letter(code, at - 1), dtype=np.uint64)])
    yield _batch(here[begin + size] - here[begin], np.full(len(words), _SELF), np.full(len(words), -1), ids)
    whole, row = np.arange(len(code)), np.repeat(np.arange(len(words)), size)
    key = here[whole] - here[begin[row]] + moved[(begin + size)[row]] - moved[whole + 1]
    first = (at == 0) | (code != np.concatenate([code[:1], code[:-1]]))
    yield from _deletions(key, first, at, size[row], ids[row])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, place, id) of the words of (id, word)."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        some: list[np.ndarray] = []
        begin = held = 0
        for i, text in enumerate(batch.column(1)):
            word = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)
            if held + len(word) > PIECE and some:
                yield from _emit_some(some, ids[begin:i])
                some, begin, held = [], i, 0
            if len(word) > PIECE:
                yield from _emit_long(word, int(ids[i]))
                begin = i + 1
            else:
                some.append(word)
                held += len(word)
        if some:
            yield from _emit_some(some, ids[begin:])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b and their words and counts for all pairs of ``words(id, word, n)`` (distinct, not empty) exactly one inserted, deleted or replaced code point apart; each pair once."""
    keys = Stored(words.select("id", "word").mapInArrow(_emit, "key long, kind byte, place int, id long"), "spelling-keys").df
    own = keys.where(F.col("kind") == _SELF).select("key", F.col("id").alias("b"))
    shorter = keys.where(F.col("kind") == _SHORTER).select("key", F.col("id").alias("a"), "place")
    place = keys.where(F.col("kind") == _PLACE)
    left, right = place.select("key", F.col("id").alias("a"), "place"), place.select("key", F.col("id").alias("b"), F.col("place").alias("same"))
    inserted = shorter.join(own, "key").select("a", "b", "place", F.lit(True).alias("longer"))
    replaced = left.join(right, "key").where("a < b and place = same").select("a", "b", "place", F.lit(False).alias("longer"))
    met = inserted.unionByName(replaced)
    a, b = (words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n")) for x in "ab")
    met = met.join(a, "a").join(b, "b")
    head = lambda w: F.substring(w, F.lit(1), F.col("place"))
    tail = lambda w, skip: F.col(w).substr(F.col("place") + 1 + skip, F.length(w))
    same = (head("a_word") == head("b_word")) & (F.length("a_word") == F.length("b_word") + F.col("longer").cast("int")) & (tail("a_word", 1) == tail("b_word", F.when(F.col("longer"), 0).otherwise(1)))
    return met.where(same).select("a", "b", "a_word", "b_word", "a_n", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """id, root: the last form that ``forms(id, form)`` lead to; forms make no circle, and each id stands once."""
    held = Stored(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = held.df.select(F.col("id").alias("of"), F.col("root").alias("next"))
        new = Stored(held.df.join(on, F.col("root") == F.col("of"), "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        held.drop()
        held = new
        if not held.df.where("moved").limit(1).count():
            return held.df.select("id", "root")


def variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """Forms and roots of the words of ``counts(word, n)``.

    Returns word, form, root, n, n_near and form_n.  A word's form is its near word
    (exactly one inserted, deleted or replaced code point apart) of largest n, ties to the
    smallest by code points, if that n is at least ``ratio`` (over 1) times its own; else
    null.  The root is the last of a word's chain of forms, the word itself if it has none.
    n_near counts near words.  Null and empty words are left out, rows of one word are
    added up.  No rows: none.  Other columns are not read.
    """
    once = counts.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = Stored(once.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words").df
    pairs = near_pairs(words)
    sides = [pairs.select(F.col(x).alias("id"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(f"{y}_word").alias("word"), F.col(y).alias("id")).alias("other")) for x, y in ("ab", "ba")]
    near = sides[0].unionByName(sides[1]).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("other"))
    has = -F.col("other.less") >= ratio * F.col("n")
    joined = words.join(near, "id", "left")
    known = Stored(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("other")).alias("other")), "spelling-forms").df
    ends = roots(known.where("other is not null").select("id", F.col("other.id").alias("form")))
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(named, "id", "left").select(
        "word", F.col("other.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("other.less")).cast("long").alias("form_n")
    )
