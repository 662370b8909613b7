"""Regions, background mixtures, running backgrounds and deletion histories against plain loops."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestore.operators import frames as V
from lodestore.operators import lifecycle as Y


def flooded(mask):
    """Boxes and areas of the regions of one mask."""
    height, width = mask.shape
    todo, out = {(y, x) for y in range(height) for x in range(width) if mask[y, x]}, []
    while todo:
        edge, region = [todo.pop()], []
        while edge:
            y, x = edge.pop()
            region.append((y, x))
            for at in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if at in todo:
                    todo.remove(at)
                    edge.append(at)
        ys, xs = zip(*region)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(region)))
    return sorted(out, key=lambda r: (-r[4], r[1], r[0]))


@given(st.integers(1, 7), st.integers(1, 9), st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([0.2, 0.45, 0.6, 1.0]))
@settings(max_examples=150, deadline=None)
def test_regions_are_those_of_a_flood_fill(n, height, width, seed, share):
    masks = np.random.default_rng(seed).random((n, height, width)) < share
    found = V.mask_regions(masks)
    for i in range(n):
        at = found["image"] == i
        got = sorted(zip(*(found[c][at].tolist() for c in ("x", "y", "width", "height", "area"))), key=lambda r: (-r[4], r[1], r[0]))
        assert got == flooded(masks[i])


def test_a_spiral_is_one_region():
    mask = np.zeros((41, 41), bool)
    y, x, dy, dx = 0, 0, 0, 1
    for length in range(40, 0, -2):
        for _ in range(4):
            for _ in range(length):
                if 0 <= y < 41 and 0 <= x < 41:
                    mask[y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        y, x = y + 2, x + 2
    assert list(zip(*V.mask_regions(mask[None]).values())) and len(V.mask_regions(mask[None])["area"]) == len(flooded(mask))


def test_the_largest_regions_are_ranked(spark):
    rng = np.random.default_rng(3)
    masks = rng.random((5, 12, 10)) < 0.25
    rows = [(i % 2, i, [bool(x) for x in m.ravel()]) for i, m in enumerate(masks)] + [(9, 9, [False] * 120)]
    got = V.regions(spark.createDataFrame(rows, "camera int, frame int, mask array<boolean>"), 12, 10, top=3, least=2).orderBy("frame", "rank").collect()
    want = [(i % 2, i, k + 1, *r, r[0] + r[2] // 2, r[1] + r[3] // 2) for i, m in enumerate(masks) for k, r in enumerate([r for r in flooded(m) if r[4] >= 2][:3])]
    assert [tuple(r) for r in got] == want


def mixture(values):
    """One value's foreground, by the rule written out."""
    parts, out = [[0.0, 0.0, V.FIRST_VARIANCE] for _ in range(V.COMPONENTS)], []
    for v in values:
        order = sorted(range(len(parts)), key=lambda k: -parts[k][0] / parts[k][2] ** 0.5)
        total, background = 0.0, set()
        for k in order:
            if total < V.SHARE:
                background.add(k)
            total += parts[k][0]
        own = next((k for k in order if parts[k][0] > 0 and (v - parts[k][1]) ** 2 <= V.NEAR**2 * parts[k][2]), None)
        out.append(own is None or own not in background)
        fresh = own is None
        if fresh:
            own = min(range(len(parts)), key=lambda k: parts[k][0])
        for p in parts:
            p[0] *= 1 - V.RATE
        p = parts[own]
        p[0] += V.RATE
        if fresh:
            p[1], p[2] = v, V.FIRST_VARIANCE
        else:
            d = v - p[1]
            p[1] += V.RATE * d
            p[2] = max(V.LEAST_VARIANCE, p[2] + V.RATE * (d**2 - p[2]))
        weight = sum(q[0] for q in parts)
        for q in parts:
            q[0] /= weight
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_the_background_is_learned_as_by_a_loop(spark, batch):
    rng = random.Random(5)
    scene = [[rng.choice([40, 200]) for _ in range(6)] for _ in range(2)]
    rows = [(c, f, [int(v + rng.gauss(0, 4)) if rng.random() < 0.9 else rng.randrange(256) for v in scene[c]]) for f in range(120) for c in range(2)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["camera"], r["frame"]): r for r in V.background_model(spark.createDataFrame(rows, "camera long, frame long, vec array<long>")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for c in range(2):
        want = [mixture([r[2][i] for r in rows if r[0] == c]) for i in range(6)]
        for f in range(120):
            assert got[c, f]["mask"] == [w[f] for w in want] and got[c, f]["foreground"] == sum(w[f] for w in want)
    # once learned, the scene itself is background
    late = [x for c in range(2) for f in range(80, 120) for x in got[c, f]["mask"]]
    assert 0.02 < sum(late) / len(late) < 0.3


@pytest.mark.parametrize("keep", [0.95, 0.999])
def test_the_running_background_over_many_blocks(spark, keep):
    rng = random.Random(8)
    rows = [(c, f, float(rng.randrange(256))) for c in range(2) for f in range(256 * 5 + 17)]
    got = {(r["camera"], r["frame"]): r["background"] for r in V.ema(spark.createDataFrame(rows, "camera long, frame long, level double"), keep).collect()}
    assert len(got) == len(rows)
    for c in range(2):
        level = None
        for _, f, v in sorted(r for r in rows if r[0] == c):
            level = v if level is None else keep * level + (1 - keep) * v
            assert abs(got[c, f] - level) < 1e-6


DAY = date(2024, 11, 20)


def test_requests_to_delete_are_judged_as_of_their_days(spark):
    rng = random.Random(2)
    changes = [(rng.choice("ab"), DAY + timedelta(days=rng.randrange(120)), rng.choice([1, -1, 1, -1])) for _ in range(60)] + [("hot", DAY + timedelta(days=i % 90), 1 if i % 2 else -1) for i in range(3000)]
    requests = [(i, rng.choice(["a", "b", "hot", "never"]), DAY + timedelta(days=rng.randrange(-5, 130)), rng.choice([None, 1, 20])) for i in range(300)]
    rows = [(i, k, d, None if n is None else d + timedelta(days=n)) for i, k, d, n in requests]
    got = {r["request_id"]: r for r in Y.delete_states(spark.createDataFrame(rows, "request_id long, key string, requested date, decided date"), spark.createDataFrame(changes, "key string, day date, delta int"), grace=10).collect()}
    assert len(got) == len(rows)
    states = set()
    for i, key, requested, decided in rows:
        refs = lambda day: sum(x for k, d, x in changes if k == key and d <= day)
        again = min((d for k, d, x in changes if k == key and x > 0 and decided and d > decided), default=None)
        if refs(requested) > 0:
            state = "refused"
        elif decided is None:
            state = "pending"
        elif refs(decided) > 0:
            state = "rejected"
        else:
            state = "restored" if again and again <= decided + timedelta(days=10) else "authorized"
        states.add(state)
        r = got[i]
        assert (r["state"], r["refs_requested"], r["refs_decided"], r["restored"]) == (state, refs(requested), None if decided is None else refs(decided), again if state == "restored" else None)
    assert states == {"refused", "pending", "rejected", "restored", "authorized"}
