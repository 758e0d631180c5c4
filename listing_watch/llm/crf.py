"""Linear-chain conditional random fields in numpy, over batches of chains.

A batch is flat: `emit` has a row of label scores for each item, and `lengths` says how many
consecutive items make up each chain. Chains advance together, longest first, so a pass has as
many steps as the longest chain has items.
"""

from __future__ import annotations

import numpy as np


def steps(lengths: np.ndarray) -> list[np.ndarray]:
    """For each position t the flat places of the t-th items of the chains that have one."""
    lengths = np.asarray(lengths, np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], starts[order]
    top = int(sizes[0]) if len(sizes) else 0
    return [starts[: np.searchsorted(-sizes, -t, side="left")] + t for t in range(top)]


def viterbi(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label of each item; ties go to the smaller label."""
    at = steps(lengths)
    best, back = emit.astype(np.float64), np.zeros(emit.shape, np.int16)
    for t, rows in enumerate(at):
        if t == 0:
            best[rows] += start
            continue
        scores = best[rows - 1][:, :, None] + trans
        back[rows] = scores.argmax(axis=1)
        best[rows] += scores.max(axis=1)
    out = np.zeros(len(emit), np.int16)
    ends = np.zeros(len(emit), bool)
    ends[np.cumsum(lengths)[np.asarray(lengths) > 0] - 1] = True
    for rows in reversed(at):
        last = ends[rows]
        out[rows[last]] = best[rows[last]].argmax(axis=1)
        go = rows[~last]
        out[go] = back[go + 1, out[go + 1]]
    return out


def marginals(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Forward-backward: label probabilities of each item, the log partition summed over chains,
    and the expected transition counts."""
    n, k = emit.shape
    at = steps(lengths)
    peak = emit.max(axis=1, keepdims=True) if n else np.zeros((0, 1))
    p, move, first = np.exp(emit - peak), np.exp(trans), np.exp(start)
    alpha, scale = np.zeros((n, k)), np.ones((n, 1))
    for t, rows in enumerate(at):
        a = p[rows] * (first if t == 0 else alpha[rows - 1] @ move)
        s = a.sum(axis=1, keepdims=True)
        alpha[rows], scale[rows] = a / s, s
    beta, pairs = np.ones((n, k)), np.zeros((k, k))
    for t in range(len(at) - 1, 0, -1):
        rows = at[t]
        b = p[rows] * beta[rows] / scale[rows]
        beta[rows - 1] = b @ move.T
        pairs += alpha[rows - 1].T @ b
    return alpha * beta, float(np.log(scale).sum() + peak.sum()), pairs * move


def train(
    features: np.ndarray, offsets: np.ndarray, items: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (features x labels), start and transition scores of greatest penalised likelihood,
    by a fixed number of Adagrad rounds over all chains.

    Item types share features: type i has features[offsets[i]:offsets[i + 1]], and `items` gives
    the type of each item of the chains."""
    w, start, trans = np.zeros((n_features, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels))
    n, types = len(items), len(offsets) - 1
    owner = np.repeat(np.arange(types), np.diff(offsets))
    gold = np.zeros((n, n_labels))
    gold[np.arange(n), labels] = 1
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(n, bool)
    inner[firsts] = False
    rows = np.flatnonzero(inner)
    gold_pairs = np.zeros_like(trans)
    np.add.at(gold_pairs, (labels[rows - 1], labels[rows]), 1)
    sums = [np.zeros_like(x) + 1e-6 for x in (w, start, trans)]
    for _ in range(rounds):
        by_type = np.stack([np.bincount(owner, w[features, c], types) for c in range(n_labels)], axis=1)
        m, _, pairs = marginals(by_type[items], lengths, start, trans)
        diff = m - gold
        type_grad = np.stack([np.bincount(items, diff[:, c], types) for c in range(n_labels)], axis=1)
        grads = (
            np.stack([np.bincount(features, type_grad[owner, c], n_features) for c in range(n_labels)], axis=1) / n + ridge * w,
            diff[firsts].sum(axis=0) / n,
            (pairs - gold_pairs) / n + ridge * trans,
        )
        for x, g, s in zip((w, start, trans), grads, sums):
            s += g * g
            x -= rate * g / np.sqrt(s)
    return w, start, trans
