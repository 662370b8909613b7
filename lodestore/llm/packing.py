"""Packing of documents into token sequences, neighbours found by a sharded BM25 index.

Documents are tokenized once and stored; document frequencies of all tokens are
summed over all documents.  Documents are then ordered by their leading tokens and
cut into shards of about equal size, so that those on one subject tend to meet.
A shard builds an inverted index of its documents, takes a seed, ranks the unused
ones by BM25 for the seed's tokens and fills the seed's window greedily: those
that fit go in whole, then the best one left is cut to fill the rest and goes on
in the next window.  Only the last window of a shard can stay short.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Stored, null_salt

VOCABULARY = "byte_bpe_50k"
WINDOW = 2048
END_ID = 1
K1, B = 1.2, 0.75
#: Neighbours ranked for a window before the last one is cut; more are ranked if they do not fill it.
RANKED = 64
#: A shard's index is rebuilt without used documents once no more than this share of those in it is unused.
COMPACT = 0.75
#: A token that one document in so many holds has a row over all documents of its shard.
COMMON = 4
#: Documents that the cuts between shards are learned from: so many a shard, and this many at most.
SAMPLED, SAMPLED_AT_MOST = 256, 1 << 22
#: Bytes of text whose ids are handed on together.
LOT = 1 << 20
#: Characters without (or of nothing but) white space beyond which the rank file's merges, quadratic in a piece, are not used.
LONG_RUN = 20_000


@lru_cache(2)
def encoders(vocabulary: str):
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public.path(f"{vocabulary}.json"))
    with open(public.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = lambda pattern: tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    fast, plain = made(public.PATTERN), made(public.PATTERN.replace(r"|\s+(?!\S)", ""))
    return slow, fast, plain, tuple(t.content for t in slow.get_added_tokens_decoder().values())


#: White space of any kind among the Latin-1 characters.
_WIDE = np.zeros(256, bool)
_WIDE[[*range(9, 14), *range(28, 33), 0x85, 0xA0]] = True


def _long_run(data: np.ndarray) -> bool:
    space = np.concatenate([[True], kernel.SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return len(edge) < 2 or bool(np.diff(np.concatenate([[0], edge, [len(data)]])).max() >= LONG_RUN)


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids as the tokenizer's own library gives them.

    The same merges run faster from the rank file; that way is taken for Latin-1 texts
    without giant words or added tokens (such as an end-of-text mark, which the
    library gives its own id wherever it stands).  The pattern that cuts a text into words
    looks ahead only for runs of white space; a text without two such characters side by
    side is cut alike by the pattern without that, at twice the speed.
    """
    slow, fast, plain, added = encoders(vocabulary)
    if any(mark in text for mark in added):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    try:
        data = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        pass
    else:
        if len(text) < LONG_RUN or not _long_run(data):
            space = _WIDE[data]
            return (fast if (space[1:] & space[:-1]).any() else plain).encode_to_numpy(text, disallowed_special=())
    return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def token_rows(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """id and ids (16-bit, with the end id) of each document; and for each task a row with null ids in ``id`` whose ``df`` counts its documents by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        names = ["kind", "id", "ids", "n"]
        idt = None
        for batch in batches:
            idt = batch.column(0).type
            for i, j in kernel.pieces(kernel.strings(batch.column(1))[1], LOT):
                out, sizes = [], []
                for text in batch.column(1).slice(i, j - i):
                    found = encode(text.as_py() or "", vocabulary)
                    ids = np.empty(len(found) + 1, np.uint16)
                    ids[:-1], ids[-1] = found, end_id
                    place = np.arange(len(ids), dtype=np.int32)
                    last[ids] = place
                    df[ids[last[ids] == place]] += 1  # each token once
                    out.append(ids.tobytes())
                    sizes.append(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(out), pa.int32()), batch.column(0).slice(i, j - i), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], names)
        if idt is not None:
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, idt), pa.array([np.stack([used, df[used]]).tobytes()], pa.binary()), pa.array([0], pa.int64())], names)

    idt = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"kind int, id {idt}, ids binary, n long")


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Documents that hold each token, over all documents; as long as the vocabulary, never longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                token, n = np.frombuffer(blob.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])

    found = rows.where("kind = 1").select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << 16, np.int64)
    df[found["token"].to_numpy()] = found["n"].to_numpy()
    return df


def bm25(n: np.ndarray, idf: np.ndarray, length: np.ndarray | int, mean: float) -> np.ndarray:
    return idf * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))


def leads(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray, df: np.ndarray, mean: float) -> np.ndarray:
    """The three leading tokens of each document as one number of 48 bits, the first one highest.

    A token leads by its BM25 weight times the logarithm of its documents: one that
    no other document holds leads to nobody.  Ties go to the lower token; absent
    tokens are 0.  ``data`` holds the ids of all documents, none of them empty.
    """
    sizes = np.diff(offsets)
    kind = np.uint32 if len(sizes) <= 1 << 16 else np.int64
    key = np.repeat(np.arange(len(sizes), dtype=kind) << kind(16), sizes) | data
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.concatenate([first, [len(key)]]))
    doc, token = (key[first] >> 16).astype(np.int64), (key[first] & 0xFFFF).astype(np.int64)
    weight = bm25(n, idf[token], sizes[doc], mean) * np.log(df[token])
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    out = np.zeros(len(sizes), np.int64)
    for _ in range(3):
        best = np.maximum.reduceat(weight, begin)
        at = np.flatnonzero(weight == best[doc])
        at = at[np.concatenate([[True], doc[at][1:] != doc[at][:-1]])]
        out = out << 16 | np.where(best >= 0, token[at], 0)
        weight[at] = -1
    return out


class Index:
    """BM25 weights of one shard's documents, by token: postings, and for tokens that one document in COMMON holds a row over all documents."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(t) for t in texts])
        kind = np.uint32 if len(texts) <= 1 << 16 else np.int64
        key = np.repeat(np.arange(len(texts), dtype=kind) << kind(16), size) | np.concatenate(texts)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        doc, token = (key[first] >> 16).astype(np.int32), (key[first] & 0xFFFF).astype(np.int64)
        weight = bm25(n, idf[token], size[doc], mean).astype(np.float32)
        self.own = np.split(token, np.searchsorted(doc, np.arange(1, len(texts))))
        self.n = len(texts)
        common = np.flatnonzero(np.bincount(token, minlength=1 << 16) * COMMON >= max(self.n, COMMON))
        self.slot = np.full(1 << 16, -1, np.int32)
        self.slot[common] = np.arange(len(common))
        self.there = np.arange(self.n)
        self.dense = np.zeros((len(common), self.n), np.float32)
        wide = self.slot[token] >= 0
        self.dense[self.slot[token[wide]], doc[wide]] = weight[wide]
        token, doc, weight = token[~wide], doc[~wide], weight[~wide]
        order = np.argsort(token, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.cut = np.searchsorted(token[order], np.arange((1 << 16) + 1))

    def scores(self, tokens: np.ndarray) -> np.ndarray:
        slot = self.slot[tokens]
        a, z = self.cut[tokens], self.cut[tokens + 1]
        size = z - a
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = np.bincount(self.doc[at], self.weight[at], self.n).astype(float)
        if len(self.there):
            out[self.there] += self.dense[slot[slot >= 0]].sum(axis=0)
        return out

    def keep(self, unused: np.ndarray) -> None:
        """Forget the used documents; scores of the others stay the same."""
        held = unused[self.doc]
        self.cut = np.concatenate([[0], np.cumsum(held)])[self.cut]
        self.doc, self.weight = self.doc[held], self.weight[held]
        still = unused[self.there]
        self.there, self.dense = self.there[still], self.dense[:, still]


def pack_shard(texts: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (text, start, length, sequence, offset) of one shard's texts."""
    pieces, sequence = [], 0
    size = np.array([len(t) for t in texts])
    start = np.zeros(len(texts), np.int64)
    for i, n in enumerate(size):
        for k in range(n // window):
            pieces.append((i, k * window, window, sequence, 0))
            sequence += 1
        start[i] = n // window * window
    left = size - start
    unused = left > 0
    index = Index(texts, idf, mean) if unused.any() else None
    seed, held = -1, len(texts)
    waiting = iter(np.flatnonzero(unused))
    while unused.any():
        if seed < 0 or not unused[seed]:
            seed = next(i for i in waiting if unused[i])
        at = 0

        def put(i: int, n: int) -> None:
            nonlocal at
            pieces.append((int(i), int(start[i]), int(n), sequence, at))
            at += int(n)
            start[i] += n
            left[i] -= n
            unused[i] = left[i] > 0

        put(seed, left[seed])
        ranked = np.flatnonzero(unused)
        if len(ranked) and at < window:
            if len(ranked) <= COMPACT * held:
                index.keep(unused)
                held = len(ranked)
            score = index.scores(index.own[seed])[ranked]
            over, open_ = -1, np.arange(len(ranked))
            while at < window and over < 0 and len(open_):
                best = open_[np.argpartition(-score[open_], RANKED)[:RANKED]] if len(open_) > 4 * RANKED else open_
                first = ranked[best[np.lexsort((ranked[best], -score[best]))]]
                for i in first:
                    if left[i] <= window - at:
                        put(i, left[i])
                over = next((i for i in first if unused[i]), -1)
                open_ = open_[unused[ranked[open_]]]
            if over >= 0 and at < window:
                put(over, window - at)
                seed = over
        sequence += 1
    return pieces


def dealt(rows: DataFrame, count: int, idf: np.ndarray, df: np.ndarray, mean: float, shards: int) -> DataFrame:
    """shard, id and ids of ``rows(id, ids, n)``: ordered by their leads, equal ones by a hash, and cut by tokens."""
    rows = rows.select("id", "ids", "n", F.xxhash64("id", F.crc32("ids"), null_salt(F.col("id"))).alias("hash"))
    if shards == 1:
        return rows.select(F.lit(0).cast("long").alias("shard"), "id", "ids")

    def ordered(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        data, offsets = kernel.strings(batch.column(1))
        salt = batch.column(3).to_numpy() & 0x7FFF
        for i, j in kernel.pieces(offsets):
            ids = data[offsets[i] : offsets[j]].view(np.uint16)
            yield i, j, leads(ids, (offsets[i : j + 1] - offsets[i]) // 2, idf, df, mean) << 15 | salt[i:j]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, lead in ordered(batch):
                yield pa.RecordBatch.from_arrays([pa.array(lead), batch.column(2).slice(i, j - i)], ["lead", "n"])

    # the sample's size is bounded by SAMPLED_AT_MOST
    one_in = max(1, math.ceil(count / min(SAMPLED * shards, SAMPLED_AT_MOST)))
    seen = rows.where(F.pmod(F.xxhash64("hash"), F.lit(one_in)) == 0).mapInArrow(sample, "lead long, n long").toPandas().sort_values(["lead", "n"])
    upto = np.cumsum(seen["n"].to_numpy())
    whole = upto[-1] if len(upto) else 0
    cuts = seen["lead"].to_numpy()[np.searchsorted(upto, whole * np.arange(1, shards) / shards, "right")] if whole else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, lead in ordered(batch):
                shard = np.searchsorted(cuts, lead, "right").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)], ["shard", "id", "ids"])

    return rows.mapInArrow(run, f"shard long, id {rows.schema['id'].dataType.simpleString()}, ids binary")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_tokens: int = 2 << 20,
) -> DataFrame:
    """Cut all documents into pieces and place them in sequences of at most ``window`` ids.

    A document's ids are the tokenizer's, without special tokens, then ``end_id``;
    a null or empty text is ``end_id`` alone.  Returns a row for each piece: id,
    start and length (within the document's ids), ids (little-endian 32-bit),
    doc_tokens, sequence_id and offset.  Each id lies in exactly one piece, and
    offsets are gapless.  Repeated rows are packed each.  Empty input: no rows.
    Other columns are not read.  The vocabulary has fewer than 65,536 ids.
    """
    idt = docs.schema[id_col].dataType.simpleString()
    held = Stored(token_rows(docs, id_col, text_col, vocabulary, end_id), "token-ids")
    rows = held.df
    count, total = rows.where("kind = 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    df = document_frequencies(rows)
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    mean = (total or 1) / max(1, count)
    shards = max(1, math.ceil((total or 0) / shard_tokens))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("id", "ascending"), ("ids", "ascending")])
        texts = [np.frombuffer(x.as_py(), np.uint16) for x in table.column("ids")]
        found = pack_shard(texts, idf, mean, window)
        out = np.array(found, np.int64).reshape(-1, 5)
        return pa.table(
            {
                "id": table.column("id").take(pa.array(out[:, 0])),
                "start": pa.array(out[:, 1]),
                "length": pa.array(out[:, 2]),
                "ids": pa.array([texts[i][s : s + n].astype("<u4").tobytes() for i, s, n, _, _ in found], pa.binary()),
                "doc_tokens": pa.array(np.array([len(t) for t in texts], np.int64)[out[:, 0]]),
                "sequence_id": pa.array(shard * (1 << 32) + out[:, 3]),
                "offset": pa.array(out[:, 4]),
            }
        )

    placed = dealt(rows.where("kind = 0"), count, idf, df, mean, shards)
    packed = placed.groupBy("shard").applyInArrow(kernel.lean(run), f"id {idt}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
