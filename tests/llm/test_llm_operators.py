"""The training-data operators against brute force, on small and awkward inputs."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestore.llm import ann, crf, kernel, language, mixing, near_dup, packing, quality, queries, search, suffix_dedup, toxicity, url_filter
from lodestore.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names operators use inside."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in zip(ids, texts)], DOCS)


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared passages, empty and long ones."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(400)]
    made = [" ".join(rng.choice(vocabulary, rng.integers(3, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary, 60))
    for i in range(0, n, 7):
        made[i] = made[i] + "\n" + passage
    for i in range(3, n, 11):
        made[i] = made[(i * 5) % n]
    for i in range(5, n, 13):
        w = made[(i * 3) % n].split(" ")
        w[len(w) // 2] = "changed"
        made[i] = " ".join(w)
    made[1], made[2], made[8], made[9] = None, "", "  \t\n", "One"
    made[10] = made[9].upper()
    made[20] = " ".join(rng.choice(vocabulary, 60000))
    made[21] = made[20] + " end"
    made[22] = "a" * 700_000
    return made


@pytest.fixture(scope="module")
def texts():
    return corpus()


# 1


def test_url_filter_against_brute_force(spark):
    rules = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/", "allow"), ("net", None, "block"), ("net", "/fr/", "allow"), ("net", "/fr/", "block"), (None, "/", "block"), ("org", "/", None)]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/EN/", "https://badexample.com/en/", "http://a.b.example.com/en/q", "http://x.net", "http://x.net/fr/1", "http://x.net?fr", "http://com/", "a://b.com://c/", "http://example.com./en/", "http://example.com:80/en/", "x://ünï.com/ä", "http://.com/", "http://com.example.org/"] * 3
    pages = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), buckets=5).collect()
    assert len(got) == len(urls)
    kept = {}
    for h, p, v in rules:
        if h and v:
            kept[h.lower(), p or ""] = max(v, kept.get((h.lower(), p or ""), ""))
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = re.split(r"[?#]", rest)[0]
        host, slash, tail = rest.partition("/")
        host, path = host.translate(FOLD), slash + tail
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in kept.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        want[i or None] = (host, path, best[2], best[3])
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want


def test_url_rules_of_the_query(spark, tmp_path):
    """The registered query against rules written out by hand, with urls for each of them."""
    import duckdb
    import pandas as pd
    from compare import same_rows

    want = {
        "https://www.example.com/fr/a": ("com/", "allow"),
        "https://www.example.com/en/a": ("www.example.com/en/", "allow"),
        "https://a.www.example.com/en/": ("www.example.com/en/", "allow"),
        "https://example.com/en/a": ("example.com/en/", "block"),
        "https://other.example.com/en/a": ("example.com/en/", "block"),
        "https://example.com/en": ("com/", "allow"),
        "https://example.com/": ("com/", "allow"),
        "https://example.com": (None, "allow"),
        "https://shop.net/es/": ("net/es/", "block"),
        "https://shop.net/fr/x?y": ("net/fr/", "block"),
        "https://shop.net/de/": (None, "allow"),
        "https://shop.org/en/": (None, "allow"),
        "https://examplecom/en/": (None, "allow"),
    }
    pd.DataFrame({"page_id": range(len(want)), "url": list(want), "html": ""}).to_parquet(tmp_path / "pages.parquet")
    got = queries.op1_url_filter(spark, str(tmp_path))
    assert {list(want)[r["page_id"]]: (r["rule"], r["verdict"]) for r in got.collect()} == want
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet')")
    same_rows(got, con, queries.ORACLE_SQL["op1_url_filter"])


def test_url_filter_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.url_filter(pages, none).collect()] == ["allow"]
    assert url_filter.url_filter(pages.limit(0), none).count() == 0


# 2 and 6


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    for _ in range(10):
        size = rng.integers(0, 300, 6)
        bounds = np.concatenate([[0], np.cumsum(size)])
        emission, transition = rng.normal(size=(bounds[-1], 3)) * 2, rng.normal(size=(3, 3))
        got = crf.marginals(emission, bounds, transition)
        for a, z in zip(bounds[:-1], bounds[1:]):
            if z > a:
                want, _ = crf.batch_posteriors(emission[None, a:z], np.ones((1, z - a), bool), transition)
                assert np.allclose(got[a:z], want[0], atol=1e-9)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    emission, transition = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    total, sums = 0.0, np.zeros((4, 2))
    for path in np.ndindex(2, 2, 2, 2):
        weight = np.exp(emission[np.arange(4), path].sum() + sum(transition[a, b] for a, b in zip(path[:-1], path[1:]))) * np.exp(transition[:, path[0]]).sum()
        total += weight
        sums[np.arange(4), path] += weight
    assert np.allclose(crf.marginals(emission, np.array([0, 4]), transition), sums / total)


def test_marginals_part_by_part_equal_those_of_the_whole():
    rng = np.random.default_rng(2)
    emission, transition = rng.normal(size=(1000, 3)) * 2, rng.normal(size=(3, 3))
    cuts = [0, 1, 1, 64, 300, 999, 1000]
    parts = lambda: (emission[a:z] for a, z in zip(cuts[:-1], cuts[1:]))
    want = crf.marginals(emission, np.array([0, 1000]), transition)
    assert np.allclose(np.concatenate(list(crf.long_marginals(parts, transition))), want, atol=1e-9)


def line_field():
    rng = np.random.default_rng(1)
    field = quality.LineField.__new__(quality.LineField)
    field.weights, field.transition = rng.normal(size=(quality.WIDTH, 2)) * 0.1, np.array([[1.0, -1.0], [-1.0, 1.0]])
    return field


@pytest.mark.parametrize("end", ["", "\n", "\n\n"])
def test_quality_of_a_long_text_part_by_part(end, monkeypatch):
    rng = np.random.default_rng(3)
    text = "\n".join(" ".join(rng.choice(["aa", "Bb", "cc|", "9"], rng.integers(0, 12))) for _ in range(900)) + end
    data = np.frombuffer(text.encode(), np.uint8)
    field, bounds = line_field(), np.array([0, len(data)])
    monkeypatch.setattr(quality, "PART", 1 << 30)
    whole = field.features(data, bounds)
    monkeypatch.setattr(quality, "PART", 500)
    assert np.allclose(field.features(data, bounds), whole)


def test_quality_of_many_short_lines_takes_little_memory():
    code = """
import resource, sys
import numpy as np
from test_llm_operators import line_field
data = np.frombuffer(b"a\\n" * (8 << 20), np.uint8)
line_field().features(data, np.array([0, len(data)]))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": f"{here}:{root}"})
    assert int(said.stdout) < 500


def test_language_of_a_long_text_part_by_part():
    rng = np.random.default_rng(4)
    weights, transition = rng.normal(size=(1 << language.TABLE_BITS, 3)).astype(np.float32), np.eye(3)
    data = np.frombuffer(b"some words, and others " * 500, np.uint8)
    whole, parts = (language._shares(data, np.array([0, len(data)]), weights, transition, limit) for limit in (1 << 20, 700))
    assert np.allclose(whole, parts)


def test_language_of_mixed_and_empty_texts(spark):
    rng = np.random.default_rng(2)
    stems = {"aa": ["baba", "dada", "gaga", "baga"], "ee": ["lele", "nene", "reme", "meler"], "oo": ["xozo", "kozo", "woxo", "zoko"]}
    learn = spark.createDataFrame([(i, " ".join(rng.choice(stems[k], 30)), k) for i, k in enumerate(list(stems) * 20)] + [(900, "junk", None), (901, None, "aa")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(0, "baba dada gaga baga"), (1, "lele nene " * 5000), (2, None), (3, ""), (4, "12 34 !!"), (5, "— …"), (6, "baba dada gaga baga baba dada nene"), (7, "KOZO WOXO")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, learn).collect()}
    assert [got[i][0] for i in range(8)] == ["aa", "ee", "und", "und", "und", "und", "aa", "oo"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[2][1] == 0
    assert language.identify(docs.limit(0), learn).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, learn.limit(0)).collect()} == {"und"}


def test_quality_tells_junk_lines(spark):
    rng = np.random.default_rng(3)
    good = [". ".join(" ".join(rng.choice(["river", "stone", "walks", "under", "the"], 8)).capitalize() for _ in range(4)) + "." for _ in range(80)]
    bad = [" | ".join(rng.choice(["BUY", "NOW!!", "$$$", "CLICK"], 20)) for _ in range(80)]
    rows = [(i, t, int(i < 80)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (502, "x" * 600_000), (503, "\n" * 5000)], "doc_id long, text string")
    learn = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3 != 1] + [(999, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, learn).collect()}
    held = [(i, q) for i, _, q in rows if i % 3 == 1]
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.95
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert {r["score"] for r in quality.score_quality(docs, learn.limit(0)).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), learn).count() == 0


# 3


_TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    """What the tokenizer's file says, with nothing set."""
    return _TOKENIZER.encode(text, add_special_tokens=False).ids


def check_packing(docs, pieces, window=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for i, text in docs.items():
        ids = np.array([*plain_ids(text or ""), 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert bytes(p["ids"]) == ids[at : at + p["length"]].tobytes()
            at += p["length"]
        assert at == len(ids)
    for group in by_seq.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    return by_seq


def test_packing_places_every_id_once(spark, texts):
    docs = frame(spark, texts)
    pieces = packing.pack(docs, shard_tokens=60_000).collect()
    sequences = check_packing(dict(enumerate(texts)), pieces)
    short = [s for s, g in sequences.items() if sum(p["length"] for p in g) < 2048]
    assert len(short) <= len({s >> 32 for s in sequences})
    again = packing.pack(docs.repartition(7), shard_tokens=60_000).collect()
    assert sorted((p["doc_id"], p["start"], p["sequence_id"], p["offset"]) for p in pieces) == sorted((p["doc_id"], p["start"], p["sequence_id"], p["offset"]) for p in again)
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet=st.characters(max_codepoint=255), max_size=400))
def test_fast_encoding_equals_the_tokenizer(text):
    assert packing.encode(text).tolist() == plain_ids(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1'.s é\xa0\x85\x1c\t\n", max_size=40) | st.lists(st.sampled_from(["can't", "12", "été", "a", "...", "x'll", "ÿ9"]), max_size=12).flatmap(lambda w: st.sampled_from([" ", "\n", "\xa0"]).map(lambda c: c.join(w) + c)))
def test_cutting_without_looking_ahead_gives_the_same_ids(text):
    assert packing.encode(text).tolist() == plain_ids(text)


def plain_pack(texts, idf, mean, window):
    """The windows of one shard by the rule written out, for at most 256 texts."""
    bags, left = [Counter(t.tolist()) for t in texts], {}
    pieces, sequence = [], 0
    for i, t in enumerate(texts):
        for k in range(len(t) // window):
            pieces.append((i, k * window, window, sequence, 0))
            sequence += 1
        if len(t) % window:
            left[i] = (len(t) // window * window, len(t) % window)

    def score(seed, i):
        n = len(texts[i])
        return sum(idf[w] * bags[i][w] * 2.2 / (bags[i][w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in bags[seed] if w in bags[i])

    seed = None
    while left:
        seed = seed if seed in left else min(left)
        at = 0

        def put(i, n):
            nonlocal at
            start, have = left.pop(i)
            pieces.append((i, start, n, sequence, at))
            at += n
            if n < have:
                left[i] = (start + n, have - n)

        put(seed, left[seed][1])
        order = sorted(left, key=lambda i: (-score(seed, i), i)) if at < window else []
        for i in order:
            if left[i][1] <= window - at:
                put(i, left[i][1])
        over = next((i for i in order if i in left), None)
        if over is not None and at < window:
            put(over, window - at)
            seed = over
        sequence += 1
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_filled_as_by_the_rule(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.zipf(1.3, int(rng.integers(1, 90))).clip(max=3000).astype(np.uint16) for _ in range(int(rng.integers(1, 250)))]
    texts.append(rng.integers(0, 500, 700).astype(np.uint16))
    idf = rng.random(1 << 16) + 0.1
    assert packing.pack_shard(texts, idf, 40.0, 200) == plain_pack(texts, idf, 40.0, 200)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|><|endoftext|>x", "— <|endoftext|> ", "<|endoftext |>", "x" * 30_000 + "<|endoftext|>"])
def test_added_tokens_keep_their_ids(text):
    assert packing.encode(text).tolist() == plain_ids(text)


def test_packing_prefers_related_neighbours():
    rng = np.random.default_rng(4)
    texts = [rng.integers(100 * k, 100 * k + 50, 60).astype(np.uint16) for k in (1, 2) * 20]
    pieces = packing.pack_shard(texts, np.ones(1 << 16), 60.0, 300)
    same = [len({i % 2 for i, _, _, s, _ in pieces if s == k}) == 1 for k in range(6)]
    assert sum(same) >= 5


def test_packing_fills_windows_of_short_texts_by_score():
    rng = np.random.default_rng(9)
    texts = [rng.integers(100 * k, 100 * k + 30, 10).astype(np.uint16) for k in (1, 2) * 400]
    pieces = packing.pack_shard(texts, np.ones(1 << 16), 10.0, 1000)
    same = [len({i % 2 for i, _, _, s, _ in pieces if s == k}) == 1 for k in range(8)]
    assert sum(same) >= 6


def test_packing_deals_related_documents_together(spark):
    rng = np.random.default_rng(6)
    topics = [["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(12)] for _ in range(24)]
    rows = [(i, " ".join(rng.choice(topics[i % 24], 60))) for i in range(24 * 12)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=512, shard_tokens=8000).collect()
    shards = defaultdict(set)
    for p in pieces:
        shards[p["doc_id"]].add(p["sequence_id"] >> 32)
    assert len({s for x in shards.values() for s in x}) > 8 and all(len(x) == 1 for x in shards.values())
    alike = [shards[i] == shards[j] for i in shards for j in range(i) if i % 24 == j % 24]
    other = [shards[i] == shards[j] for i in shards for j in range(i) if i % 24 != j % 24]
    assert np.mean(alike) > 2 * np.mean(other)  # dealt at random the two agree


def test_packing_splits_a_crowd_of_copies(spark):
    docs = spark.createDataFrame([(i, "the same words over and over again " * 8) for i in range(400)], "doc_id long, text string")
    size = Counter()
    for p in packing.pack(docs, shard_tokens=3000).collect():
        size[p["sequence_id"] >> 32] += p["length"]
    assert len(size) > 5 and max(size.values()) < 6000


def test_leads_against_brute_force():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 300, int(rng.integers(1, 60))).astype(np.uint16) for _ in range(200)]
    df = np.zeros(1 << 16, np.int64)
    for t in texts:
        df[np.unique(t)] += 1
    idf = np.log1p((200 - df + 0.5) / (df + 0.5))
    got = packing.leads(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), idf, df, 30.0)
    for t, lead in zip(texts, got, strict=True):
        token, n = np.unique(t, return_counts=True)
        weight = packing.bm25(n, idf[token], len(t), 30.0) * np.log(df[token])
        best = [*token[np.lexsort((token, -weight))][:3].tolist(), 0, 0]
        assert lead == best[0] << 32 | best[1] << 16 | best[2]


# 4


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), None if i % 9 == 0 else "b" if i % 3 else "a") for i in range(3000)] + [(None, "x y", "a"), (7, "dup words", "b"), (7, "dup words", "b"), (4000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(docs, block=16).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 40
    again = mixing.mix_sources(docs.repartition(5), block=16).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_tells_rows_apart(spark):
    """Rows without an id, or of one id, are spread and come back by their own number."""
    rows = [(None, f"word{i} more", "a") for i in range(500)] + [(4, "same id", "a"), (4, "another text", "a")]
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "number long, doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block=8, row_col="number").collect()
    assert sorted(r["number"] for r in got) == list(range(502))
    assert all(r["copies"] in (1, 2) for r in got) and sum(r["taken"] for r in got) in range(1504, 1509)


def test_mixing_is_fair(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    mean = np.mean([[r["copies"] for r in mixing.mix_sources(docs, share=0.5, weights=(1, 1), seed=s).orderBy("doc_id").collect()] for s in range(6)])
    assert abs(mean - 0.5) < 0.05


# 5


def plain_nearest(rows, queries, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and len(v) == 16 and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in good:
            scores = sorted((-float((good[q] * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((good[q] * good[q]).sum()))), i) for i, v in good.items() if i != q)
            out[q] = scores[:k]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(30, 16))
    rows = [(i, (centre[i % 30] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(300)]  # one common vector
    rows += [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] + [1.0] * 15), (3150, [None] + [1.0] * 15), (3200, [1.0] * 4), (50, rows[50][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    want = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({i for _, i in best} & {f[2] for f in found})
    assert hits / (5 * len(want)) >= 0.9
    assert sorted(got[50])[0][2] == 2000 and [f[2] for f in sorted(got[50])] == [2000, 2001, 2002, 2003, 2004]


def test_nearest_of_few(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(rows, rows.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 1)]
    assert ann.nearest(rows.limit(0), rows).count() == 0
    assert ann.nearest(rows.where("vec_id = 0"), rows.where("vec_id = 0")).count() == 0


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(7)
    code = rng.integers(0, 1 << 32, (500, 2)).astype(np.uint32)
    code[100:200] = code[:100]
    code[100:200, 1] ^= 3
    code[200:250] = code[:50]
    code[200:250, 0] ^= 0x10101
    index = ann.Index(code)
    for radius in (0, 1, 2, 3, 9, 27):
        for q in code[::50]:
            want = np.flatnonzero([sum(bin(int(a ^ b)).count("1") for a, b in zip(q, c)) <= radius for c in code])
            assert index.within(q, radius).tolist() == want.tolist()


# 7


def plain_groups(docs, width, percent):
    sets = {}
    for i, t in docs.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(docs)
    for a in names:
        for b in names:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in docs}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_brute_force(spark, texts, width):
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, width=width).collect()}
    assert got == plain_groups(dict(enumerate(texts)), width, 80)


def test_near_duplicates_in_large_buckets(spark):
    """Many variants about the threshold share buckets; blocks of every size give the same links."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    made = {}
    for i in range(150):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            w[k] = f"x{rng.integers(1000)}"
        made[i] = " ".join(w)
    docs = frame(spark, list(made.values()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, width=4).collect()}
    assert got == plain_groups(made, 4, 80)


def test_links_of_a_block_connect_its_groups_and_no_more():
    rng = np.random.default_rng(18)
    members = []
    for i in range(60):
        base = np.arange(i % 4 * 1000, i % 4 * 1000 + 100)
        base[rng.choice(100, rng.integers(0, 9), replace=False)] += 10_000 + 100 * i
        s = np.unique(kernel.mix(base.astype(np.uint64)))
        members.append((i, i, near_dup.sketch(s, np.array([0, len(s)]))[0], s))
    links = near_dup.block_links(members, members, 80)
    want = plain_links({i: set(s.tolist()) for i, _, _, s in members}, 80)
    assert components_of(links, 60) == components_of(want, 60) and len(links) == 60 - len(set(components_of(want, 60)))


def plain_links(sets, percent):
    return [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def components_of(links, n):
    parent = list(range(n))
    for a, b in links:
        a, b = parent[a], parent[b]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_near_duplicates_of_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, False)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(9)
    for n, similarity in ((400, 0.8), (2000, 0.5), (30, 0.9)):
        common = int(round(2 * n * similarity / (1 + similarity)))
        every = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        a, b = np.unique(every[:n]), np.unique(np.concatenate([every[:common], every[n:]]))
        regs = near_dup.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        found = near_dup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - similarity) < 0.17


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(500, i) for i in range(100, 140)] + [(None, 3), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "bigint").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} | {got[500]} == {100}


# 8


def plain_cut(docs):
    first, out = {}, {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first.setdefault(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        out[i] = (len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [100_000, 2])
def test_repeated_spans_against_brute_force(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAD", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1 if hot == 2 else 64)
    made = [t if t is None or len(t) < 100_000 else t[:30_000] for t in texts]
    got = {}
    for r in suffix_dedup.repeated_spans(frame(spark, made), keep=("score", "id")).collect():
        assert (r["score"], r["id"]) == ("x", "y")
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert removed == r["n_bytes"] - len(r["kept"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"][:-1], r["spans"][1:]))
        got[r["doc_id"]] = (r["n_bytes"], removed, hashlib.sha256(bytes(r["kept"])).hexdigest())
    assert got == plain_cut(dict(enumerate(made)))


def test_repeated_spans_at_the_edges(spark):
    a = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    docs = {1: a, 2: a[10:60], 3: "x" + a[10:60] + "é" * 40, 4: a[10:59], 5: "zz" * 100, 6: "zz" * 30 + a[100:149], 7: ("é" * 40) + a, 8: "abc"}
    got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == plain_cut(docs)


def test_repeated_spans_of_nulls_and_repeats(spark):
    text = "".join(str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], len(r["kept"])) for r in suffix_dedup.repeated_spans(docs).collect()), key=str)
    assert got == [(1, len(text)), (1, len(text)), (2, 0), (3, 0), (None, 0)]
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_long_texts_are_cut_alike_in_parts(monkeypatch):
    rng = np.random.default_rng(10)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = np.concatenate([np.stack(x[:2]) for x in suffix_dedup.walk(data, np.array([0, 5000]))], axis=1)
    monkeypatch.setattr(kernel, "PIECE", 700)
    parts = np.concatenate([np.stack(x[:2]) for x in suffix_dedup.walk(data, np.array([0, 5000]))], axis=1)
    strings = lambda p: sorted(s + j for s, n in p.T for j in range(n))
    assert strings(whole) == strings(parts) == list(range(4951))


def judged(texts):
    """``suffix_dedup.judge`` over the pieces of some texts, each of them a document."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.walk(data, bounds))]
    start, count, owner, place = parts[:4]
    size = count + suffix_dedup.SPAN - 1
    text = np.concatenate([data[a : a + n] for a, n in zip(start, size)])
    p = suffix_dedup.Pieces(text, size.astype(np.uint8), (place - start).astype(np.uint8), owner, np.zeros(len(start), np.int32), np.arange(len(start)))
    gone = {(int(owner[i]), int(start[i] - bounds[owner[i]]) + j) for i, b in enumerate(suffix_dedup.judge(p, False)[0]) for j in range(count[i]) if b >> j & 1}
    return gone


def test_sorted_suffixes_find_all_later_strings():
    rng = np.random.default_rng(15)
    made = ["".join(rng.choice(list("abc"), 300)) for _ in range(12)]
    for i in range(4, 12):
        a = int(rng.integers(0, 200))
        made[i] = made[i][:a] + made[int(rng.integers(0, 4))][a : a + int(rng.integers(48, 90))] + made[i][a:]
    first, want = {}, set()
    for i, t in enumerate(made):
        for s in range(len(t) - 49):
            if first.setdefault(t[s : s + 50], i) < i:
                want.add((i, s))
    assert want and judged(made) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=40))
def test_multikey_order_sorts(items):
    data = np.frombuffer(b"".join(items), np.uint8)
    end = np.cumsum([len(x) for x in items], dtype=np.int64) if items else np.zeros(0, np.int64)
    start = end - np.array([len(x) for x in items], np.int64)
    words = suffix_dedup._words(data)
    order, depth = suffix_dedup.multikey_order(len(items), lambda k, i: suffix_dedup._token(words, start[i] + 8 * k, end[i], 8), 4)
    padded = [x.ljust(32, b"\0") for x in items]
    assert [padded[i] for i in order] == sorted(padded)
    assert [d == 4 for d in depth[1:]] == [padded[a] == padded[b] for a, b in zip(order, order[1:])]


def test_ranges_of_strings_exchange_their_edges(spark):
    """One string that fills several ranges: only its smallest document keeps it."""
    rng = np.random.default_rng(16)
    rows = [(bytearray(b"m" * 50), d, 1, d, 0) for d in range(500)] + [(bytearray(rng.integers(97, 123, 50).astype(np.uint8).tobytes()), d, 2, d, 3) for d in range(100)]
    rows += [(r[0], 900 + i, 3, i, 4) for i, r in enumerate(rows[-5:])]
    strings = spark.createDataFrame(rows, "string binary, doc long, b int, number int, j int").repartition(5)
    got = {(r["b"], r["number"], r["bits"]) for r in suffix_dedup.compare_across(strings, 7).collect()}
    assert got == {(1, d, 1) for d in range(1, 500)} | {(3, i, 16) for i in range(5)}


# 9


def test_toxicity_finds_rare_words_in_long_texts(spark):
    rng = np.random.default_rng(11)
    clean = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    nasty = ["zork", "blegh", "fnarg"]
    rows = []
    for i in range(400):
        w = list(rng.choice(clean, 40))
        if i % 4 == 0:
            for k in (5, 20, 33):
                w[k] = str(rng.choice(nasty))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    long_clean, long_toxic = " ".join(rng.choice(clean, 20000)), " ".join([*rng.choice(clean, 10000), "zork", *rng.choice(clean, 9000), "fnarg"])
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, long_clean), (903, long_toxic)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    learn = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, learn).collect()}
    held = [(i, y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97
    assert [got[i]["predicted"] for i in (900, 901, 902, 903)] == [0, 0, 0, 1]
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, learn).collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.score_toxicity(docs, learn.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), learn).count() == 0


def test_toxicity_finds_a_fixed_phrase(spark):
    rng = np.random.default_rng(12)
    clean = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(rng.choice(clean, 40))
        if i % 4 == 0:
            w[20:22] = [clean[0], "fnarg"]  # the second word follows no other one
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    learn = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, learn).collect()}
    held = [(i, y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([got[i] for i, y in held if y]) > 0.9
    assert np.mean([got[i] for i, y in held if not y]) < 0.05


def plain_gains(rows, all_texts, previous_words, word):
    """Kneser-Ney by dictionaries: log P(word | previous) of the toxic less that of the ordinary model."""
    split = lambda t: [w for w in re.split(r"[^a-z]+", t.lower()) if w]
    begins = defaultdict(set)
    for t in all_texts:
        for w in split(t):
            begins[w[: toxicity.OPENING]].add(w)
    kinds = sum(len(x) for x in begins.values())

    def off(n, counts):
        one, two, three, four = (max(1, sum(1 for c in counts if c == k)) for k in (1, 2, 3, 4))
        y = one / (one + 2 * two)
        k, a, b = {1: (1, one, two), 2: (2, two, three)}.get(n, (3, three, four))
        return min(max(k - (k + 1) * y * b / a, 0.1 * k), 0.95 * k) if n else 0.0

    out = []
    for label in (1, 0):
        before = defaultdict(set)
        for t, y in rows:
            if y == label:
                w = ["<", "<", *split(t)]
                for a, b, c in zip(w, w[1:], w[2:]):
                    before[b, c].add(a)
        pair = {k: len(v) for k, v in before.items()}
        word_n, opening = Counter(), defaultdict(set)
        for _, c in pair:
            word_n[c] += 1
            opening[c[: toxicity.OPENING]].add(c)
        opening_n = {o: len(v) for o, v in opening.items()}

        def level(n, counts):
            counts = list(counts)
            return (n - off(n, counts)) / sum(counts), sum(off(c, counts) for c in counts) / sum(counts)

        o = word[: toxicity.OPENING]
        p, rest = level(opening_n.get(o, 0), opening_n.values())
        p_opening = p + rest * len(begins[o]) / kinds
        p, rest = level(word_n[word], word_n.values())
        p_word = p + rest * p_opening / len(begins[o])
        kept = {k: (n - off(n, pair.values())) for k, n in pair.items() if n >= toxicity.PAIR_CONTEXTS}
        size = max(1, sum(n for (a, _), n in pair.items() if a == previous_words))
        left = 1 - sum(v for (a, _), v in kept.items() if a == previous_words) / size
        out.append(math.log(kept.get((previous_words, word), 0) / size + left * p_word))
    return out[0] - out[1]


def test_toxicity_models_against_brute_force(spark):
    rng = np.random.default_rng(13)
    names = ["".join(rng.choice(list("abcd"), int(rng.integers(2, 11)))) for _ in range(60)]
    weight = 1 / np.arange(1, 61)
    rows = [(" ".join(rng.choice(names, 25, p=weight / weight.sum())) + (" zork blegh" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    rest = [" ".join(rng.choice(names, 25)) + " unheard zorking" for _ in range(20)]
    texts = spark.createDataFrame([(t,) for t in [*(t for t, _ in rows), *rest]], "text string")
    model = toxicity.Model(spark.createDataFrame([(y, t) for t, y in rows], "toxic int, text string"), texts)
    assert len(model.pairs)
    for text in (rows[0][0], rows[1][0], rest[0]):
        words_ = text.split()
        raw = np.frombuffer(text.encode(), np.uint8)
        (g,) = toxicity.grams(raw, np.array([0, len(raw)]))
        want = [plain_gains(rows, [*(t for t, _ in rows), *rest], a, b) for a, b in zip(["<", *words_], words_)]
        got = model.gains(g)
        known = [i for i, w in enumerate(words_) if w not in ("unheard", "zorking")]  # what no class has seen lacks its shared part, which cancels out
        assert np.allclose(got[known], np.array(want)[known], atol=1e-4)


def test_toxic_words_of_long_texts_in_parts(monkeypatch, spark):
    rng = np.random.default_rng(14)
    model = toxicity.Model.__new__(toxicity.Model)
    model.known = True
    names = ["".join(rng.choice(list("abcdef"), 6)) for _ in range(50)]
    data = np.frombuffer((" ".join(rng.choice(names, 3000)) + " É").encode(), np.uint8)
    (g,) = toxicity.grams(data, np.array([0, len(data)]))
    model.words = np.unique(g.word)
    model.word_gain = np.append(rng.normal(size=len(model.words)), np.nan).astype(np.float32)
    none = np.zeros(0, np.uint64)
    model.pairs, model.pair_gain, model.contexts, model.context_gain, model.openings, model.opening_gain = none, np.array([np.nan], np.float32), none, np.zeros(1, np.float32), none, np.zeros(1, np.float32)
    whole = model.features(data, np.array([0, len(data)]))
    monkeypatch.setattr(kernel, "PIECE", 1000)
    assert np.allclose(model.features(data, np.array([0, len(data)])), whole, atol=1e-5)


# 10


def plain_search(docs, queries, k):
    bags = {i: Counter(words(t)) for i, t in docs.items()}
    df = Counter(w for b in bags.values() for w in b)
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = {}
    for q in queries:
        scores = []
        for i, b in bags.items():
            common = [w for w in bags[q] if w in b]
            if i != q and common:
                length = sum(b.values())
                scores.append((sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in common), i))
        out[q] = sorted(scores, key=lambda x: (-round(x[0], 9), x[1]))[:k]
    return out


def test_search_against_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 200_000)
    monkeypatch.setattr(search, "BLOCK", 16)
    docs = frame(spark, texts)
    got = defaultdict(list)
    for r in search.top_k(docs, docs.where("doc_id % 10 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    want = plain_search(dict(enumerate(texts)), range(0, len(texts), 10), 10)
    for q, best in want.items():
        found = sorted(got[q])
        assert [f[1] for f in found] == [i for _, i in best]
        assert np.allclose([f[2] for f in found], [s for s, _ in best])
    assert search.top_k(docs.limit(0), docs).count() == 0
    assert search.top_k(docs, docs.limit(0)).count() == 0


def test_queries_that_are_no_documents(spark):
    docs = frame(spark, ["alpha beta", "gamma delta", "Alpha epsilon zeta"], [1, 2, 3])
    asked = frame(spark, ["gamma omega", "epsilon", "nothing here", None, "alpha"], [9, 10, 11, 12, 3])
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in search.top_k(docs, asked).collect()]
    assert sorted(got) == [(3, 1, 1), (9, 1, 2), (10, 1, 3)]


def test_rows_of_the_queries_own_id_hide_no_others(spark):
    """Many rows of the query's id, with one text or with different ones, are no answers and leave room for the others."""
    for own in (["alpha beta"] * 12, [f"alpha beta x{i}" + " alpha" * i for i in range(12)]):
        docs = frame(spark, [*own, *["alpha beta"] * 4, "alpha gamma delta"], [1] * 12 + [2, 3, 4, 5, 6])
        found = search.top_k(docs, docs.where("doc_id = 1").limit(1), k=10).orderBy("rank").collect()
        assert [r["doc_id"] for r in found] == [2, 3, 4, 5, 6]
    docs = frame(spark, ["alpha"] * 15 + ["alpha beta"], [7] * 15 + [8])
    found = search.top_k(docs, docs.where("doc_id = 8"), k=10).collect()
    assert [r["doc_id"] for r in found] == [7] * 10


def test_shards_are_bounded_by_documents(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 50)
    texts = [f"w{i % 37} v{i % 11} u{i % 5} t" for i in range(400)]
    docs = frame(spark, texts)
    got = defaultdict(list)
    for r in search.top_k(docs, docs.where("doc_id % 50 = 0"), k=5).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"]))
    want = plain_search(dict(enumerate(texts)), range(0, 400, 50), 5)
    assert {q: [i for _, i in sorted(rows)] for q, rows in got.items()} == {q: [i for _, i in best] for q, best in want.items()}


def shard_of(texts, k=1):
    import pyarrow as pa

    return search.Shard(search.build(np.arange(len(texts)), *kernel.strings(pa.array(texts)), k), 30.0)


def hashes_of(*names):
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    return kernel.word_hashes(data, np.array([0, len(data)]))[0]


def test_search_reads_no_block_that_cannot_win(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "DENSE", 20)
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice([f"c{i}" for i in range(20)], 30)) for _ in range(64)]
    texts[40] += " rare"
    shard = shard_of(texts)
    got = shard.answer([-1], [(hashes_of("rare"), np.ones(1))], 1)
    assert [(q, x) for q, x, _ in got] == [(-1, 40)] and (shard.all, shard.read) == (8, 1)


def test_search_skips_posting_blocks_and_stays_exact(monkeypatch):
    """Two languages: a query in one leaves most blocks of the other unread, whatever the pivot decides."""
    monkeypatch.setattr(search, "BLOCK", 8)
    rng = np.random.default_rng(17)
    weight = 1 / np.arange(1, 201)
    make = lambda c: " ".join(rng.choice([f"{c}{i}" for i in range(200)], int(rng.integers(20, 60)), p=weight / weight.sum()))
    texts = [make("ab"[i % 2]) for i in range(400)]
    bags = [Counter(words(t)) for t in texts]
    for dense in (0, 10, 1000):
        monkeypatch.setattr(search, "DENSE", dense)
        shard = shard_of(texts, 5)
        for q in range(0, 40, 3):
            names = sorted(bags[q])
            terms = hashes_of(*names)
            order = np.argsort(terms)
            idf = 1 + rng.random(len(names))
            want = sorted((-round(sum(i * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / 30.0)) for w, i in zip(names, idf) if w in b), 9), d) for d, b in enumerate(bags) if d != q)[:5]
            got = shard.answer([q], [(terms[order], idf[order])], 5)
            assert [(x, round(s, 9)) for _, x, s in got] == [(d, -s) for s, d in want]
        assert shard.read < 0.8 * shard.all


# primitives


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_words_are_those_of_the_pattern(items):
    import pyarrow as pa

    data, offsets = kernel.strings(pa.array([None, *items], pa.string()))
    hashes, bounds = kernel.word_hashes(data, offsets)
    names: dict[str, int] = {}
    for i, t in enumerate([None, *items]):
        w = words(t)
        assert bounds[i + 1] - bounds[i] == len(w)
        for word, h in zip(w, hashes[bounds[i] : bounds[i + 1]].tolist()):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingles_are_runs_of_words(width):
    bounds = np.array([0, 0, 2, 2, 9, 13, 13, 30])
    hashes = kernel.mix(np.arange(30, dtype=np.uint64) % np.uint64(7))
    got, cut = kernel.shingles(hashes, bounds, width)
    runs: dict[tuple, int] = {}
    for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
        w = tuple(hashes[a:z].tolist())
        want = [w[k : k + width] for k in range(len(w) - width + 1)] if len(w) >= width else [("short", *w)] if w else []
        assert cut[i + 1] - cut[i] == len(want)
        for run, h in zip(want, got[cut[i] : cut[i + 1]].tolist()):
            assert runs.setdefault(run, h) == h
    assert len(set(runs.values())) == len(runs)


def test_crc_of_pieces_is_the_contract(spark):
    row = spark.createDataFrame([(bytearray(np.array([5, 1], "<u4").tobytes()),)], "ids binary").select(F.crc32("ids")).first()
    assert row[0] == zlib.crc32(np.array([5, 1], "<u4").tobytes())
