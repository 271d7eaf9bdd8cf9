"""Exchange clustering for class bigrams: which class a word should move to, the others staying where they are."""

from __future__ import annotations

import numpy as np

#: The class of a text's end, in which no word is.
END_CLASS = 0


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """What of the training log-likelihood depends on the assignment, from counts of class (column) after class (row)."""
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def _beside(word: np.ndarray, where: np.ndarray, n: np.ndarray, rest: np.ndarray, words: int) -> np.ndarray:
    """Per word, for each class it may go to, what its counts ``n`` add to the table's cells ``rest`` there."""
    out = np.zeros((words, rest.shape[1]))
    if len(word):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[heads]] = np.add.reduceat(xlogx(rest + n[:, None]) - xlogx(rest), heads, axis=0)
    return out


def best_classes(now: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class each word should be in, were it the only one to move.

    now: its class. left[w, c] and right[w, c]: how often word w follows and precedes class c, itself included; own: how
    often it follows itself. table: class bigram counts with all words where they are now.
    """
    words, each = len(now), np.arange(len(now))
    left, right = left.astype(float), right.astype(float)
    left[each, now] -= own
    right[each, now] -= own
    n_in, n_out = left.sum(1) + own, right.sum(1) + own

    w, c = np.nonzero(left)
    n, rest = left[w, c], table[c]
    rest[np.arange(len(w)), now[w]] -= n
    here = np.flatnonzero(c == now[w])
    rest[here] -= right[w[here]]
    rest[here, c[here]] -= own[w[here]]
    gain = _beside(w, c, n, rest, words)

    w, c = np.nonzero(right)
    n, rest = right[w, c], table.T[c]
    rest[np.arange(len(w)), now[w]] -= n
    here = np.flatnonzero(c == now[w])
    rest[here] -= left[w[here]]
    rest[here, c[here]] -= own[w[here]]
    gain += _beside(w, c, n, rest, words)

    same = np.tile(np.diagonal(table).astype(float), (words, 1))
    same[each, now] -= left[each, now] + right[each, now] + own
    gain += xlogx(same + left + right + own[:, None]) - xlogx(same + left) - xlogx(same + right) + xlogx(same)
    for total, mine in ((table.sum(0), n_in), (table.sum(1), n_out)):
        without = np.tile(total.astype(float), (words, 1))
        without[each, now] -= mine
        gain -= xlogx(without + mine[:, None]) - xlogx(without)
    gain[:, END_CLASS] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[each, best] > gain[each, now] + 1e-9, best, now)


def cluster(bigrams: np.ndarray, classes: np.ndarray, n: int, rounds: int, least_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """(classes, class bigram counts) after exchange, one type after another, from type bigram counts and first classes.

    Type 0 is the end of a text and stays. Ends when a round over all types adds less than ``least_gain`` of the
    likelihood, or after ``rounds``.
    """
    classes = classes.copy()
    table = np.zeros((n, n))
    np.add.at(table, (classes[:, None], classes[None, :]), bigrams)
    score = likelihood(table)
    seen = np.flatnonzero(bigrams.sum(0) + bigrams.sum(1))
    for _ in range(rounds):
        for t in seen[seen > 0].tolist():
            now = classes[t]
            left = np.bincount(classes, weights=bigrams[:, t], minlength=n)
            right = np.bincount(classes, weights=bigrams[t], minlength=n)
            own = bigrams[t, t]
            to = best_classes(classes[t : t + 1], left[None], right[None], np.array([own]), table)[0]
            if to != now:
                left[now] -= own
                right[now] -= own
                for at, sign in ((now, -1), (to, 1)):
                    table[:, at] += sign * left
                    table[at] += sign * right
                    table[at, at] += sign * own
                classes[t] = to
        before, score = score, likelihood(table)
        if score - before < least_gain * abs(score):
            break
    return classes, table
