"""Suffix-array dedup by prefix-free parsing: bytes covered by a 200-byte string that also starts anywhere else go.

spans.py deals the stretches that may be repeated to shards by their seed; a shard holds highly repetitive text. There
rolling-hash triggers cut it into prefix-free phrases. The suffix array of the dictionary (distinct phrases) orders every
suffix of a phrase, the suffix array of the parse (the sequence of phrases) orders what follows it, and both keys together
give the order of all suffixes of the shard without sorting the text itself. In that order strings with the same 200 bytes
are neighbours; neighbours are told apart by a 64-bit hash of those bytes, which only ever compares neighbours.

Null and empty texts have no byte. Matches never cross documents; strings are judged on the input. Repeated rows are
occurrences of their own, so both lose what they share. An empty table gives an empty table. Very long texts are cut into
phrases like any others.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralake.llm.anchors import Rolling
from spectralake.llm.common import _A, U64, encoded, mix
from spectralake.llm.spans import Source, covered, cut, spans

WINDOW, SEED, SHARD = 200, 64, 1 << 20
#: Bytes of a trigger, and one place in so many is one.
TRIGGER, EVERY = 12, 32


def _symbols(text: str | None) -> np.ndarray:
    return np.frombuffer(encoded(text), np.uint8).astype(np.uint64)


def _pieces(text: str, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    data = encoded(text)
    return [data[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]


def suffix_ranks(symbols: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Rank (equal for equal strings, from 1) of the suffix from each place up to its ``stop``, by prefix doubling.

    ``symbols`` are from 1 to 511 or already ranks; ``depth`` is the length of the longest suffix.
    """
    n = len(symbols)
    rank, step = np.unique(symbols, return_inverse=True)[1] + 1, 1
    if n and symbols.max() < 512:
        rank = symbols.astype(np.int64)
        key = np.zeros(n, np.int64)
        for j in range(7):  # seven symbols of nine bits at once
            key <<= 9
            ok = np.flatnonzero(np.arange(n) + j < stop)
            key[ok] |= rank[ok + j]
        rank, step = np.unique(key, return_inverse=True)[1] + 1, 7
    while step < depth:
        second = np.zeros(n, np.int64)
        ok = np.flatnonzero(np.arange(n) + step < stop)
        second[ok] = rank[ok + step]
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1] + 1
        step *= 2
    return rank


def parse(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, piece) of the phrases: from one trigger, or the piece's start, to the end of the next trigger or the piece's."""
    h = np.zeros(max(0, len(data) - TRIGGER + 1), U64)
    for j in range(TRIGGER):
        h = h * _A + data[j : j + len(h)] + U64(1)
    at = np.flatnonzero(mix(h) % U64(EVERY) == 0)
    piece = np.searchsorted(begin, at, "right") - 1
    at = at[at + TRIGGER <= end[piece]]
    start = np.union1d(begin, at)
    piece = np.searchsorted(begin, start, "right") - 1
    following = np.append(start[1:], 0)
    last = np.append(piece[1:] != piece[:-1], True)
    return start, np.where(last, end[piece], following + TRIGGER), piece


def corpus_order(data: np.ndarray, begin: np.ndarray, end: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` in the order of the suffixes that start there, each up to the end of its piece."""
    start, stop, piece = parse(data, begin, end)
    raw = data.tobytes()
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
    sizes = np.array([len(x) for x in known], np.int64)
    stops = np.cumsum(sizes)
    dictionary = suffix_ranks(np.frombuffer(b"".join(known), np.uint8).astype(np.int64) + 1, np.repeat(stops, sizes), int(sizes.max()))
    phrase = dictionary[(stops - sizes)[ids]]
    bounds = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece))
    counts = np.diff(bounds)
    parsed = suffix_ranks(phrase + 511, np.repeat(bounds[1:], counts), int(counts.max()))
    after = np.where(np.append(piece[1:] == piece[:-1], False), np.append(parsed[1:], 0), 0)
    of = np.searchsorted(start, places, "right") - 1
    own = dictionary[(stops - sizes)[ids[of]] + places - start[of]]
    return np.argsort(own * (len(parsed) + 2) + after[of], kind="stable")


def judged(pieces: list[bytes], starts: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Which starts of each piece's windows have bytes that occur more than once, pieces taken ``counts`` times."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    data = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), starts)
    places = np.repeat(begin, starts) + np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    order = corpus_order(data, begin, end, places)
    h = Rolling(data.astype(U64)).hashes(places, places + window)[order]
    group = np.cumsum(np.append(False, h[1:] != h[:-1]))
    often = np.bincount(group, counts[owner[order]]) > 1
    gone = np.empty(len(places), bool)
    gone[order] = often[group]
    return np.split(gone, np.cumsum(starts)[:-1])


def source(window: int, seed: int, **sizes: int) -> Source:
    return Source(_symbols, _pieces, lambda p, n, v: judged(p, n, v, window), window, seed, **{"shard": SHARD, **sizes})


def remove(documents: DataFrame, window: int = WINDOW, seed: int = SEED, **sizes: int) -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``sizes`` as in Source."""
    found = spans(documents, source(window, seed, **sizes), "again")

    def work(text, runs):
        data = encoded(text)
        if not runs:
            return len(data), 0, 0, hashlib.sha256(data).hexdigest()
        gone = covered(len(data), *runs, window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        return len(data), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1)), hashlib.sha256(kept).hexdigest()

    out = cut(documents, found, ["doc_id"], work, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", True)
    return out.select("row.doc_id", *out.columns[1:])


def clean(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``documents`` with the spans cut out of text (characters that a span only touches stay) and n_chars counted anew."""
    found = spans(documents, source(window, seed), "again")
    others = [c for c in documents.columns if c not in ("text", "n_chars")]

    def work(text, runs):
        if text is None:
            return None, 0
        data = encoded(text)
        if runs:
            a = np.frombuffer(data, np.uint8)
            starts = np.flatnonzero((a & 0xC0) != 0x80)
            whole = np.minimum.reduceat(covered(len(data), *runs, window), starts)
            text = a[~np.repeat(whole, np.diff(np.concatenate((starts, [len(a)]))))].tobytes().decode("utf-8", "surrogatepass")
        return text, len(text)

    out = cut(documents, found, others, work, "text string, n_chars long", True)
    n_chars = F.col("n_chars").cast(documents.schema["n_chars"].dataType) if "n_chars" in documents.columns else None
    return out.select(*[F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in documents.columns])
