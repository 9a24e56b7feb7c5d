"""Substring dedup: words covered by a window of 13 words that also starts in a document with a smaller doc_id go.

References are sharded: spans.py sends each phrase that may be repeated to the shard of its seed, once for its first
document. A shard streams its documents by rising doc_id past a suffix automaton of the words of all smaller ones, and the
matching statistics say which windows are there already; then the document's own words are added. So every stretch meets
just the shard that can match it, and the corpus is not streamed past all automata in turn, which would grow with its square.

Null and empty texts have no word and lose nothing; their kept text is empty. Equal doc_ids are not smaller than each
other, so such rows don't remove each other's words; null doc_ids neither remove nor lose anything. An empty table gives an
empty table. A very long text is cut into phrases like any other; only its phrases travel.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from spectralake.llm.common import encoded, word_hashes
from spectralake.llm.spans import Source, covered, cut, spans

WINDOW, SEED, SHARD = 13, 6, 40_000


class Automaton:
    """Suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.link, self.length, self.next = [-1], [0], [{}]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c) -> int:
        """The state for the strings of q that end p's: q itself or a copy that takes over their transitions."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list) -> None:
        last, following = 0, self.next
        for c in sequence:
            if (q := following[last].get(c)) is not None:
                last = self._split(last, q, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, following[p][c], c)
            last = new

    def matches(self, sequence: list) -> list[int]:
        """Matching statistics: for each place the length of the longest suffix up to it that was added before."""
        state, length, out = 0, 0, []
        following, link, lengths = self.next, self.link, self.length
        for c in sequence:
            while (to := following[state].get(c)) is None and state:
                state = link[state]
                length = lengths[state]
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append(length)
        return out


def _symbols(text: str | None) -> np.ndarray:
    return word_hashes(encoded(text).split())


def _pieces(text: str, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    words = encoded(text).split()
    return [b" ".join(words[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]


def judged(pieces: list[bytes], starts: np.ndarray, least: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Which starts of each piece's windows also stand in a piece of a smaller document."""
    automaton, out = Automaton(), [np.empty(0, bool)] * len(pieces)
    waiting: list[list[bytes]] = []
    current = None
    for i in np.argsort(least, kind="stable").tolist():
        if least[i] != current:
            for words in waiting:
                automaton.add(words)
            waiting, current = [], least[i]
        words = pieces[i].split(b" ")
        out[i] = np.array(automaton.matches(words)[window - 1 : window - 1 + starts[i]]) >= window
        waiting.append(words)
    return out


def source(window: int, seed: int, **sizes: int) -> Source:
    return Source(_symbols, _pieces, lambda p, n, v: judged(p, n, v, window), window, seed, **{"shard": SHARD, **sizes})


def remove(documents: DataFrame, window: int = WINDOW, seed: int = SEED, keep_text: bool = True, **sizes: int) -> DataFrame:
    """One row for each row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text; ``sizes`` as in Source."""
    found = spans(documents, source(window, seed, **sizes), "earlier")

    def work(text, runs):
        words = encoded(text).split()
        kept = words
        if runs:
            gone = covered(len(words), *runs, window)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        out = b" ".join(kept)
        return (len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest(), *([out.decode("utf-8", "replace")] if keep_text else []))

    out = cut(documents, found, ["doc_id"], work, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text, False)
    return out.select("row.doc_id", *out.columns[1:])
