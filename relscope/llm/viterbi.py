"""Viterbi decoding of many sequences at once: one numpy step for the n-th tokens of all sequences."""

from __future__ import annotations

import numpy as np


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray | float) -> np.ndarray:
    """The best label of every token. scores: (tokens, labels) of all sequences, joined; lengths: tokens of each.

    moves[i, j] is added on going from label i to label j; a number instead is the penalty of any change of label.
    Of equal paths the one with smaller labels wins.
    """
    n, labels = scores.shape
    out = np.zeros(n, np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    starts, sizes = starts[order], lengths[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    back = np.zeros((n, labels), np.uint8 if labels < 256 else np.int32)
    best = scores[starts].astype(np.float64)
    own = np.arange(labels)
    for t in range(1, longest):
        k = active[t]
        at, held = starts[:k] + t, best[:k]
        if isinstance(moves, np.ndarray):
            every = held[:, :, None] + moves
            back[at] = every.argmax(1)
            best[:k] = every.max(1) + scores[at]
        else:
            top = held.argmax(1)[:, None]
            other = np.take_along_axis(held, top, 1) - moves
            stay = held >= other
            back[at] = np.where(stay, own, top)
            best[:k] = np.where(stay, held, other) + scores[at]
    label = best.argmax(1)
    out[starts + sizes - 1] = label
    for t in range(longest - 1, 0, -1):
        k = active[t]
        at = starts[:k] + t
        label[:k] = back[at, label[:k]]
        out[at - 1] = label[:k]
    return out
