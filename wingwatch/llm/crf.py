"""Linear-chain conditional random field in numpy: training by gradient, decoding by Viterbi, both over
padded batches of sequences.

A token has a fixed number of 64-bit feature hashes; the model knows the hashes of its training
tokens and gives others no weight.  Labels are 0 for outside and, for kind k, 2k + 1 where a span
begins and 2k + 2 where it goes on; a chain can only go on with a kind that it is in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -1e9


@dataclass
class Model:
    known: np.ndarray  # sorted feature hashes
    weight: np.ndarray  # (known + 1, labels); the last row is that of unknown features
    move: np.ndarray  # (labels, labels): from, to
    begin: np.ndarray  # (labels,)


def allowed(kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """0 where a move (or a beginning) can be, ``NEVER`` elsewhere."""
    labels = 2 * kinds + 1
    move, begin = np.zeros((labels, labels)), np.zeros(labels)
    for k in range(kinds):
        move[:, 2 * k + 2] = NEVER
        move[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
        begin[2 * k + 2] = NEVER
    return move, begin


def places(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Row of each feature hash in the weights."""
    at = np.searchsorted(known, features)
    at[at == len(known)] = 0
    return np.where(known[at] == features, at, len(known)) if len(known) else np.zeros(features.shape, np.int64)


def scores(model: Model, features: np.ndarray) -> np.ndarray:
    """(tokens, labels) from (tokens, features) hashes."""
    out = np.zeros((len(features), model.weight.shape[1]), np.float64)
    for column in features.T:
        out += model.weight[places(model.known, column)]
    return out


def padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each sequence's tokens in a padded (n, longest) grid, mask of it); tokens stand one
    sequence after the other."""
    width = int(lengths.max()) if len(lengths) else 0
    col = np.arange(width)[None, :]
    mask = col < lengths[:, None]
    first = np.cumsum(lengths) - lengths
    return np.where(mask, first[:, None] + col, 0), mask


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def expected(emit: np.ndarray, mask: np.ndarray, move: np.ndarray, begin: np.ndarray):
    """(log partition, P(label at token), expected moves, P(first label)) of a padded batch."""
    n, width, labels = emit.shape
    ahead = np.empty_like(emit)
    ahead[:, 0] = begin + emit[:, 0]
    for t in range(1, width):
        step = _log_sum(ahead[:, t - 1, :, None] + move[None], 1) + emit[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    whole = _log_sum(ahead[:, -1], 1)
    back, moves = np.zeros((n, labels)), np.zeros((labels, labels))
    share = np.zeros_like(emit)
    for t in range(width - 1, -1, -1):
        share[:, t] = np.exp(ahead[:, t] + back - whole[:, None]) * mask[:, t, None]
        if t:
            here = emit[:, t] + back
            both = np.exp(ahead[:, t - 1, :, None] + move[None] + here[:, None, :] - whole[:, None, None])
            moves += (both * mask[:, t, None, None]).sum(axis=0)
            back = np.where(mask[:, t, None], _log_sum(move[None] + here[:, None, :], 2), back)
    return whole, share, moves, share[:, 0].sum(axis=0)


def fit(features: np.ndarray, label: np.ndarray, lengths: np.ndarray, kinds: int, rounds: int = 40, rate: float = 0.25,
        ridge: float = 0.5) -> Model:
    """Penalised maximum likelihood on tokens that stand one sequence after the other."""
    known = np.unique(features)
    at = places(known, features)
    labels = 2 * kinds + 1
    fixed_move, fixed_begin = allowed(kinds)
    grid, mask = padded(lengths)
    tokens = grid[mask]
    truth = np.zeros((*mask.shape, labels))
    truth[mask, label] = 1
    pairs = np.zeros((labels, labels))
    both = mask[:, 1:]
    np.add.at(pairs, (label[grid[:, :-1][both]], label[grid[:, 1:][both]]), 1)
    order = np.argsort(at, axis=None, kind="stable")
    owner, flat = order // features.shape[1], at.ravel()[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    size = (len(known), labels)
    x = {"w": np.zeros(size), "move": np.zeros((labels, labels)), "begin": np.zeros(labels)}
    mean, spread = ({k: np.zeros_like(v) for k, v in x.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        emit = x["w"][at].sum(axis=1)[grid]
        _, share, moves, begins = expected(emit, mask, x["move"] + fixed_move, x["begin"] + fixed_begin)
        off = np.zeros((len(features), labels))
        off[tokens] = (truth - share)[mask]
        slope = {"w": np.add.reduceat(off[owner], first, axis=0) - ridge * x["w"],
                 "move": pairs - moves - ridge * x["move"], "begin": truth[:, 0].sum(axis=0) - begins - ridge * x["begin"]}
        for k, g in slope.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            x[k] += rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(spread[k] / (1 - 0.99 ** step)) + 1e-8)
    return Model(known, np.vstack([x["w"], np.zeros(labels)]), x["move"] + fixed_move, x["begin"] + fixed_begin)


def viterbi(emit: np.ndarray, mask: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Best labels of a padded batch; the lowest label wins a tie."""
    n, width, labels = emit.shape
    best, came = begin + emit[:, 0], np.zeros((width, n, labels), np.int8)
    for t in range(1, width):
        step = best[:, :, None] + move[None]
        came[t] = step.argmax(axis=1)
        best = np.where(mask[:, t, None], step.max(axis=1) + emit[:, t], best)
        came[t][~mask[:, t]] = np.arange(labels)
    out = np.zeros((n, width), np.int64)
    out[:, -1] = best.argmax(axis=1)
    for t in range(width - 1, 0, -1):
        out[:, t - 1] = came[t][np.arange(n), out[:, t]]
    return out


def decode(model: Model, features: np.ndarray, lengths: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
    """Label of every token.  Sequences of like length are decoded together, about ``cells`` tokens at a
    time; a longer one by itself."""
    emit = scores(model, features)
    out = np.zeros(len(features), np.int64)
    first = np.cumsum(lengths) - lengths
    order, a = np.argsort(lengths, kind="stable"), 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * lengths[order[b]] <= cells:
            b = min(len(order), b + max(1, (b - a) // 2))
        while b - a > 1 and (b - a) * lengths[order[b - 1]] > cells:
            b -= max(1, (b - a) // 8)
        pick = order[a:b]
        width = int(lengths[pick].max())
        col = np.arange(width)[None, :]
        mask = col < lengths[pick][:, None]
        grid = np.where(mask, first[pick][:, None] + col, 0)
        out[grid[mask]] = viterbi(emit[grid], mask, model.move, model.begin)[mask]
        a = b
    return out
