"""Linear-chain conditional random field: training on padded batches, and exact marginals of many long chains at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Steps of a block in ``marginals``.
BLOCK = 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-30)


def batch_posteriors(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (n, steps, labels) and expected transitions (labels, labels) of padded chains.

    The label before the first step is taken as uniform over all labels.
    """
    n, steps, labels = emission.shape
    p = np.exp(emission - emission.max(axis=2, keepdims=True))
    t = np.exp(transition)
    a = np.full((n, labels), 1.0 / labels)
    before, after = np.empty((n, steps, labels)), np.empty((n, steps, labels))
    for k in range(steps):
        before[:, k] = a
        a = np.where(mask[:, k, None], _unit((a @ t) * p[:, k]), a)
        after[:, k] = a
    b = np.full((n, labels), 1.0 / labels)
    gamma = np.empty((n, steps, labels))
    moves = np.zeros((labels, labels))
    for k in range(steps - 1, -1, -1):
        gamma[:, k] = _unit(after[:, k] * b)
        right = p[:, k] * b
        pair = before[:, k, :, None] * t * right[:, None, :]
        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-30)
        moves += pair[mask[:, k]].sum(axis=0) if k else 0.0
        b = np.where(mask[:, k, None], _unit(right @ t.T), b)
    return gamma, moves


def train(features: list[np.ndarray], scatter, labels: list[np.ndarray], n_labels: int, width: int, epochs: int = 12, rate: float = 0.3, batch: int = 64, seed: int = 5, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, labels) and transitions that raise the likelihood of label sequences, by AdaGrad.

    ``scatter(items, weights)`` gives the emissions of the sequences ``items`` one
    below the other; ``scatter(items, None, gradient)`` the gradient of the weights.
    """
    rng = np.random.default_rng(seed)
    w, t = np.zeros((width, n_labels)), np.zeros((n_labels, n_labels))
    sw, st = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            size = np.array([len(labels[i]) for i in pick])
            steps = int(size.max())
            mask = np.arange(steps) < size[:, None]
            emission = np.zeros((len(pick), steps, n_labels))
            items = [features[i] for i in pick]
            emission[mask] = scatter(items, w)
            gold = np.zeros((len(pick), steps), np.int64)
            gold[mask] = np.concatenate([labels[i] for i in pick])
            gamma, moves = batch_posteriors(emission, mask, t)
            push = -gamma
            np.put_along_axis(push, gold[:, :, None], np.take_along_axis(push, gold[:, :, None], 2) + 1, 2)
            gw = scatter(items, None, push[mask]) / len(pick) - ridge * w
            both = mask[:, 1:]
            seen = np.zeros_like(t)
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            gt = (seen - moves) / len(pick) - ridge * t
            sw += gw**2
            st += gt**2
            w += rate * gw / np.sqrt(sw)
            t += rate * gt / np.sqrt(st)
    return w, t


def transfer(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The product of all steps as one matrix (labels, labels), up to a factor; the identity for no step."""
    n, labels = emission.shape
    if not n:
        return np.eye(labels)
    t = np.exp(transition)
    p = np.exp(emission - emission.max(axis=1, keepdims=True))
    begin = np.arange(0, n, BLOCK)
    whole = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    for k in range(min(BLOCK, n)):
        new = (whole @ t) * p[np.minimum(begin + k, n - 1)][:, None, :]
        new /= np.maximum(new.sum(axis=(1, 2), keepdims=True), 1e-300)
        whole = np.where((begin + k < n)[:, None, None], new, whole)
    while len(whole) > 1:
        pairs = whole[0 : len(whole) // 2 * 2 : 2] @ whole[1::2]
        pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)
        whole = np.concatenate([pairs, whole[len(whole) // 2 * 2 :]])
    return whole[0]


def long_marginals(parts: Callable[[], Iterable[np.ndarray]], transition: np.ndarray) -> Iterator[np.ndarray]:
    """Label marginals of one chain whose emissions ``parts()`` gives part by part, the same each time.

    A first sweep keeps one small matrix for each part, which gives the messages at
    the parts' borders; a second one gives the marginals.  The result is that of
    ``marginals``, in the memory of one part.
    """
    steps = [transfer(e, transition) for e in parts()]
    uniform = np.full(len(transition), 1.0 / len(transition))
    right = [uniform]
    for m in reversed(steps[1:]):
        right.append(_unit(m @ right[-1]))
    left = uniform
    for e, m, r in zip(parts(), steps, reversed(right), strict=True):
        yield marginals(e, np.array([0, len(e)]), transition, left, r)
        left = _unit(left @ m)


def marginals(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, beyond: np.ndarray | None = None) -> np.ndarray:
    """Label marginals of every step; chain i holds the rows ``bounds[i]`` to ``bounds[i + 1]``.

    ``before`` and ``beyond`` are the messages that reach both ends of every chain; uniform if none is given.

    Chains are cut into blocks.  The product of a block's steps is one small
    matrix, a scan over a chain's matrices gives each block the messages from both
    ends, and all blocks then run side by side.  The result is that of the plain
    recursion, whatever the length of a chain.
    """
    n, labels = emission.shape
    if not n:
        return np.zeros((0, labels))
    t = np.exp(transition)
    size = np.diff(bounds)
    blocks = -(-size // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    chain = np.repeat(np.arange(len(size)), blocks)
    begin = bounds[chain] + (np.arange(total) - first[chain]) * BLOCK
    length = np.minimum(BLOCK, bounds[chain + 1] - begin)
    steps = int(length.max())
    p = np.exp(emission - emission.max(axis=1, keepdims=True))
    at = np.minimum(begin + np.arange(steps)[:, None], n - 1)
    live = np.arange(steps)[:, None] < length
    full = bool(live.all())
    whole = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    several = blocks > 1
    if several.any():
        for k in range(steps):
            new = (whole @ t) * p[at[k]][:, None, :]
            new /= np.maximum(new.sum(axis=(1, 2), keepdims=True), 1e-300)
            whole = new if full else np.where(live[k][:, None, None], new, whole)
    left, right = np.full((total, labels), 1.0 / labels), np.full((total, labels), 1.0 / labels)
    if before is not None:
        left[first[:-1][blocks > 0]] = before
    if beyond is not None:
        right[first[1:][blocks > 0] - 1] = beyond
    by_size = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max())):
        who = by_size[: np.searchsorted(-blocks[by_size], -j, "left")]
        here = first[who] + j
        left[here] = _unit(np.einsum("nl,nlm->nm", left[here - 1], whole[here - 1]))
        back = first[who + 1] - 1 - j
        right[back] = _unit(np.einsum("nlm,nm->nl", whole[back + 1], right[back + 1]))
    forward = np.empty((steps, total, labels))
    a = left
    for k in range(steps):
        a = _unit((a @ t) * p[at[k]]) if full else np.where(live[k][:, None], _unit((a @ t) * p[at[k]]), a)
        forward[k] = a
    out = np.empty((n, labels))
    b = right
    for k in range(steps - 1, -1, -1):
        on = live[k]
        out[at[k][on]] = _unit(forward[k] * b)[on]
        new = _unit((p[at[k]] * b) @ t.T)
        b = new if full else np.where(on[:, None], new, b)
    return out
