"""Lattice near-dedup, the Merkle manifest and spelling variants against brute force."""

import itertools
import re
import zlib
from collections import Counter
from functools import partial
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.llm import lattice, merkle, queries, spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, g long, at string, h string, key string"


def docs_frame(spark, rows):
    """(doc_id, text, lang) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, f"s{n % 3}" if n % 5 else None, None if n % 7 == 0 else len(t or ""), 1, "x", "y", "z") for n, (i, t, lang) in enumerate(rows)], DOCS)


# 11


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(scale=2, size=(300, 8))
    c = lattice.decode(x)
    assert ((c * 2) % 1 == 0).all() and (c.sum(axis=1) % 2 == 0).all()
    assert all((row % 1 == 0).all() or (row % 1 == 0.5).all() for row in c)
    # no neighbour is nearer
    here = ((x - c) ** 2).sum(axis=1)
    for v in lattice.SHORTEST:
        assert (((x - c - v) ** 2).sum(axis=1) >= here - 1e-12).all()


def linked_by_force(rows, least):
    """n_links and component of each usable vector."""
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = {i: set() for i in unit}
    for a, b in itertools.combinations(unit, 2):
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
            links[a].add(b)
            links[b].add(a)
    component = {}
    for i in sorted(unit):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = i
                todo += links[x]
    return links, component


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=64) for _ in range(150)]
    centre = rng.normal(size=64)
    rows += [centre + rng.normal(size=64) * 0.12 for _ in range(90)]  # a group larger than a block
    rows += [rows[3].copy() for _ in range(40)] + [rows[4] * 3.0, rows[4] * 0.25]
    rows += [rows[i] + rng.normal(size=64) * 0.2 for i in range(5, 45)]
    rows += [rng.normal(size=5) for _ in range(3)]
    return [r.astype(np.float32).astype(float).tolist() for r in rows]


def test_vectors_link_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    good = list(enumerate(vectors()))
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] + [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("inf")] * 64), (905, [])]
    nameless = [(None, good[0][1]), (None, None)]
    twice = [(7, [9.0] * 64)]  # larger than the other of that id
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in good + odd + nameless + twice], "vec_id long, embedding array<double>, key string, id long")
    usable = [(i, min(v, [9.0] * 64) if i == 7 else v) for i, v in good]
    links, component = linked_by_force(usable, 0.95)
    got = lattice.near_vectors(df).collect()
    assert len(got) == len(good) + len(odd) + len(nameless)
    named = {r.vec_id: r for r in got if r.vec_id is not None}
    missed = 0
    for i, row in named.items():
        want = len(links.get(i, ()))
        assert row.n_links <= want
        missed += want - row.n_links
        assert row.kept == (row.component_id == i)
        if i >= 900:
            assert (row.n_links, row.component_id) == (0, i)
    assert missed <= 0.01 * sum(map(len, links.values()))
    assert sum(named[i].component_id == component[i] for i in component) >= 0.99 * len(component)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2


def test_links_are_counted_once_whatever_the_blocks(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(vectors(5))), "vec_id long, embedding array<double>")
    seen = []
    for block in (8, 1000):
        monkeypatch.setattr(lattice, "BLOCK", block)
        seen.append(sorted(map(tuple, lattice.near_vectors(df).collect())))
    assert seen[0] == seen[1]


def test_recall_at_the_least_cosine():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    own_a, near_a = lattice.Lattice(64).cells(a)
    own_b, near_b = lattice.Lattice(64).cells(0.951 * a + np.sqrt(1 - 0.951**2) * b)
    met = (own_a == own_b) | (near_a == own_b[:, :, None]).any(axis=2) | (near_b == own_a[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.97


def test_vectors_of_an_empty_table(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert lattice.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == [(1, 0, 1, True)]


# 12


def said(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def digest(text):
    return sha256(text.encode()).hexdigest()


def tree_by_force(nodes):
    """Root, and each leaf's (before, after) level by level."""
    sides = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            lo = i // 8 * 8
            sides[leaf].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
        nodes = [digest("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], sides


def manifest_by_force(rows):
    """Rows (doc_id, source, lang, n_chars, text) as the query tells of them."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((digest(said(*r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[g] = tree_by_force([leaf for leaf, _ in groups[g]])
    root, above = tree_by_force([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, upper in zip(names, above, strict=True):
        for (leaf, r), own in zip(groups[g], trees[g][1], strict=True):
            proof = own + upper
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = digest(said(*r[:4], r[4].translate(FOLD) if r[4] is not None else None)) if tampered else leaf
            for before, after in proof:
                node = digest(before + node + after)
            out.append((r[0], leaf, trees[g][0], root, digest("".join(b + a for b, a in proof)), node, node == root))
    return out


def manifest_rows(spark, df):
    df.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/merkle/documents.parquet")
    return queries.op12_merkle_manifest(spark, path.rsplit("/", 1)[0])


def same(got, want):
    tidy = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    assert tidy(got) == tidy(want)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_against_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(queries.merkle, "manifest", partial(merkle.manifest, height=height, held=50))
    monkeypatch.setattr(merkle, "parts_for", lambda *a: 6)
    rows = [(i, f"Text {i} Ä" * (i % 4), "de" if i % 3 else "en") for i in range(700)]
    rows += [(3, None, "de"), (3, "", "de"), (3, "", "de"), (None, "No id", "de"), (None, None, None), (5, "Alone", "zz"), (6, "a" * 300_000, "Ünï"), (-4, "Minus", None)]
    df = docs_frame(spark, rows)
    same(manifest_rows(spark, df).collect(), manifest_by_force([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]))


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_manifest_of_few_rows(spark, n):
    df = docs_frame(spark, [(i, "A", "en") for i in range(n)])
    same(manifest_rows(spark, df).collect(), manifest_by_force([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]))


def test_manifest_of_one_row_many_times_over(spark):
    df = docs_frame(spark, [(1, "same", "en")] * 2000)
    same(manifest_rows(spark, df).collect(), manifest_by_force([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]))


@given(st.integers(0, 700), st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_subtrees_cover_what_they_are_given(a, size):
    n = a + size + (a * 7) % 30
    nodes = [sha256(str(i).encode()).digest() for i in range(a, a + size)]
    got = sorted((at * 8**level, level, at, h) for level, at, h in merkle.subtrees(a, nodes, n))
    place = a
    for first, level, at, _ in got:
        assert first == place
        place = min(n, (at + 1) * 8**level)
    assert place == a + size
    for first, level, _, h in got:
        if level == 0:
            assert h == nodes[first - a]


# 13


def test_words_and_variants_against_brute_force(spark):
    texts = [
        "Analyse analyses analyse ANALYSE analysis, straße Straßen straßen's fußball fussball",
        "recieve receive receive receive receive receive receive receive receive receive receive receive " * 10 + "recieved received " * 3,
        "element elements " * 30 + "elemente elemente elementes elementes elementss elementss",
        None,
        "",
        "aaaaaaa aaaaaaaa aaaaaaaa aaaaaaa aaaaaab aaaaaab baaaaaa baaaaaa aabaaaa aabaaaa " * 2,
        "ÀÀÀÀÀÀÀ àààààààÀ ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀÀ x" * 2,
        "w" * 200_000 + " " + "w" * 199_999 + "v " + "w" * 200_000 + " " + "w" * 199_999 + "v",
    ]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(i, "different differant different diferent differential", "en") for i in range(20, 200)] + [(None, "differing differing", "en")] * 2
    got = spelling.variants(spelling.word_counts(docs_frame(spark, rows), 7, spoil=spelling.drop_letter(31)).where("n >= 2")).collect()
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        a, b = sorted((a, b), key=len, reverse=True)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) != len(b) + 1:
            return False
        first = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
        return a[first + 1 :] == b[first:]

    want, forms = {}, {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and x != w and near(x, w)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        want[w] = len(others)
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        want[w] = (forms[w], root, words[w], want[w], words.get(forms[w]))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(x[0] and x[0] != x[1] for x in want.values()) or any(x[0] for x in want.values())


def test_long_chains_of_forms_end_at_their_root(spark):
    """Each word is one letter from the next, which is ten times as frequent."""
    rows = [("a" * (7 + i), 10**i) for i in range(9)] + [(None, 5), ("", 5)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert len(got) == 9 and {r.root for r in got.values()} == {"a" * 15}
    assert got["a" * 9].form == "a" * 10 and got["a" * 15].form is None


def test_rows_of_one_word_are_added_up(spark):
    rows = [("letters", 3), ("letters", 4), ("lettera", 1)]
    got = {r.word: (r.form, r.n, r.n_near) for r in spelling.variants(spark.createDataFrame(rows, "word string, n int"), ratio=7).collect()}
    assert got == {"letters": (None, 7, 1), "lettera": ("letters", 1, 1)}


@given(st.lists(st.text("abÀ", min_size=1, max_size=9), min_size=1, max_size=25, unique=True))
@settings(max_examples=40, deadline=None)
def test_keys_of_long_words_are_those_of_short_ones(words):
    import pyarrow as pa

    def keys(piece):
        old, spelling.PIECE = spelling.PIECE, piece
        try:
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words)], ["id", "word"])
            return sorted(tuple(r.values()) for b in spelling._emit(iter([batch])) for r in b.to_pylist())
        finally:
            spelling.PIECE = old

    assert keys(4) == keys(1 << 17)


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).collect() == []


def test_roots_follow_forms(spark):
    forms = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (7, 8)], "id long, form long")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(1, 3), (2, 3), (5, 3), (7, 8)}
    assert spelling.roots(forms.where(F.lit(False))).collect() == []


# 7


def test_groups_do_not_depend_on_the_blocks(spark, monkeypatch):
    """Centers of many members, and buckets of large sets, are dealt into blocks; the groups stay the same."""
    from test_llm_operators import plain_groups

    from lodestore.llm import near_dup

    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 900, 120)]
    texts = {}
    for i in range(60):
        t = list(base)
        for at in rng.choice(120, int(rng.integers(0, 12)), replace=False):
            t[at] = f"v{rng.integers(0, 10**6)}"
        texts[i] = " ".join(t)
    texts |= {100 + i: " ".join(f"u{x}" for x in rng.integers(0, 500, 80)) for i in range(10)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_groups(texts, 5, 80)
    for members, size in ((256, 24 << 20), (2, 3000)):
        monkeypatch.setattr(near_dup, "MEMBERS", members)
        monkeypatch.setattr(near_dup, "SIDE_BYTES", size)
        got = near_dup.near_duplicates(df).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: tuple(want[i][:2]) for i in texts}
