"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

The encoding of a byte string is the one chain of tokens in which every neighbouring pair would stay apart if the two
were encoded together. So the last token of each prefix is unique, and the transducer only has to remember the last
tokens of those prefixes at which a longer token may still begin. Which prefixes these are is the state of a trie of tokens with
failure links; a state of the transducer adds, for each of them, its last token and the tokens not emitted yet. A step is
computed when it is first met and remembered. Tokens are emitted once every chain that is still possible shares them, which
takes at most as many further bytes as the longest token has.

All memories are bounded: states and steps start anew when full, even inside one very long piece; encodings of short
stretches are kept in two generations of bounded bytes, longer ones are not kept. Null texts encode as empty. Repeated rows are
encoded one by one; an empty table gives an empty table. Of tokens that could end a prefix only one stays apart from the token
before it, so there are no ties. Only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spectralake.llm.common import enter, holds

#: Places of states, moves of the trie and pairs before they start anew; bytes of one generation of encodings; longest text remembered.
PLACES, MOVES, PAIRS, KEPT, SHORT = 2_000_000, 100_000, 200_000, 48_000_000, 48
#: Texts are cut before each space between two non-spaces, and what lies between cuts is split by the pattern and remembered.
#: Holds for patterns of which no match goes on from a non-space to a space or looks further than one character ahead.
CUT = re.compile(r"(?<=\S)(?= \S)").split
#: Whether a space stands next to another blank or at an end; if not, cutting is the same as splitting at spaces.
WIDE = re.compile(r" \s|\s | \Z|\A ").search


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """step(state, byte) -> (state, tokens); finish(state) -> tokens. State 0 is the start."""

    def __init__(self, ranks: dict[bytes, int], places: int = PLACES):
        self.most = places
        #: pair of tokens << 32 -> the token they merge into; for each token the parts of its last merge, or -1 for a byte
        self.joined: dict[int, int] = {}
        self.head, self.tail = ([-1] * (max(ranks.values()) + 1) for _ in range(2))
        self.own: set[int] = set()
        for b, r in ranks.items():
            parts = self._before(b, r, ranks)
            if len(parts) == 2:
                self.head[r], self.tail[r] = parts
                self.joined[parts[0] << 32 | parts[1]] = r
            if len(parts) <= 2:
                self.own.add(r)
        # pairs of tokens whose bytes are a token, whether or not they are its last merge
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    self.joined[x << 32 | y] = r
        #: trie: node << 8 | byte -> node; the token that ends at a node, or -1; whether it has children; depth; failure link
        self.trie: dict[int, int] = {}
        self.token, self.inner, self.depth, self.fail = [-1], [True], [0], [0]
        for b, r in ranks.items():
            node = 0
            for c in b:
                self.inner[node] = True
                key = node << 8 | c
                node = self.trie.get(key, 0)
                if not node:
                    node = self.trie[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(0)
                    self.fail.append(0)
            self.token[node] = r
        for key, node in sorted(self.trie.items(), key=lambda x: self._deepen(x)):
            parent, byte = key >> 8, key & 255
            self.fail[node] = self._go(self.fail[parent], byte) if parent else 0
        self.pairs: dict[int, bool] = {}
        self.moves: dict[int, tuple] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.reset()

    def _deepen(self, edge: tuple[int, int]) -> int:
        """Depth of an edge's node; parents come before their children in the trie's order."""
        key, node = edge
        self.depth[node] = self.depth[key >> 8] + 1
        return self.depth[node]

    @staticmethod
    def _before(data: bytes, rank: int, ranks: dict[bytes, int]) -> list[int]:
        """The tokens of ``data`` when only merges of smaller rank were made: least rank first, then leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _go(self, node: int, byte: int) -> int:
        while True:
            to = self.trie.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def _live(self, node: int) -> list[int]:
        """Depths of the places at which a longer token may still begin, deepest first; 0, the end, is always one."""
        out = []
        while node:
            if self.inner[node]:
                out.append(self.depth[node])
            node = self.fail[node]
        return [*out, 0]

    def _move(self, node: int, byte: int) -> tuple:
        """(node, places of the old state that stay, (place before the token, token) for the tokens that end here)."""
        if len(self.moves) >= MOVES:
            self.moves.clear()
        to = self._go(node, byte)
        place = {d: i for i, d in enumerate(self._live(node))}
        ends, at = [], to
        while at:
            if self.token[at] >= 0:
                ends.append((place[self.depth[at] - 1], self.token[at]))
            at = self.fail[at]
        found = self.moves[node << 8 | byte] = (to, tuple(place[d - 1] for d in self._live(to) if d), tuple(ends))
        return found

    def reset(self, current: tuple | None = None) -> None:
        """Forget states and steps but for the start and ``current``, which gets number 1."""
        start = (0, ((-1, ()),))
        #: state: (node, places); a place: (the token before it or -1, the tokens up to it that aren't emitted yet)
        self.states = [start] if current is None else [start, current]
        self.known = {c: i for i, c in enumerate(self.states)}
        self.size = 0
        self.steps.clear()

    def stay(self, left: int, right: int) -> bool:
        """Whether two tokens in a row stay apart; left -1: whether the right one is its own encoding.

        Merges next to the border are undone from the last on: two parts that meet there would have merged if their merge comes
        before the one just undone (on the right also if it is the same, as the leftmost goes first).
        """
        if left < 0:
            return right in self.own
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            joined, head, tail = self.joined, self.head, self.tail
            a, b, limit = left, right, 1 << 62
            while True:
                if joined.get(a << 32 | b, 1 << 62) < limit:
                    found = False
                    break
                if tail[a] >= 0 and (a > b or head[b] < 0):
                    limit, a = a, tail[a]
                elif head[b] >= 0:
                    limit, b = b + 1, head[b]
                else:
                    found = True
                    break
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _follow(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        node, places = self.states[state]
        to, picks, ends = self.moves.get(node << 8 | byte) or self._move(node, byte)
        for i, t in ends:
            left, path = places[i]
            if self.stay(left, t):
                break
        end = (t, (*path, t))
        if not picks:
            out, new = end[1], (to, ((t, ()),))
        else:
            live = [places[i] for i in picks]
            live.append(end)
            out = live[0][1]
            for place in live:
                if not out:
                    break
                path = place[1]
                n = min(len(out), len(path))
                while out[:n] != path[:n]:
                    n -= 1
                out = out[:n]
            if shared := len(out):
                live = [(left, path[shared:]) for left, path in live]
            new = (to, tuple(live))
        number = self.known.get(new)
        if number is None:
            number = self.known[new] = len(self.states)
            self.states.append(new)
            self.size += len(new[1])
        self.size += 1
        return number, out

    def finish(self, state: int) -> tuple[int, ...]:
        return self.states[state][1][-1][1]

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in data:
            key = state << 8 | byte
            found = steps.get(key)
            if found is None:
                if self.size >= self.most:
                    self.reset(self.states[state] if state else None)
                    state = 1 if state else 0
                    key = state << 8 | byte
                found = steps[key] = self._follow(state, byte)
            state = found[0]
            if found[1]:
                out += found[1]
        out += self.finish(state)
        return out


class Remembered(dict):
    """text -> packed ids, as ``make`` gives them: two generations of at most ``most`` bytes each, of short texts."""

    def __init__(self, make, most: int = KEPT):
        self.make, self.most, self.size, self.old = make, most, 0, {}

    def __missing__(self, text: str) -> bytes:
        value = self.old.get(text)
        if value is None:
            value = self.make(text)
            if len(text) > SHORT:
                return value
        self.size += 200 + 2 * len(text) + len(value)
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[text] = value
        return value


class Decoder:
    """Ids to bytes and text; feed() may be called with any cut of the ids, characters may span the cuts."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for b, r in ranks.items():
            parts[r] = b
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.machine = codecs.getincrementaldecoder("utf-8")("surrogatepass")

    def raw(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.pool[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        return self.machine.decode(self.raw(ids), final)


class Codec:
    """One vocabulary in one Python worker, with the encodings of pieces already met."""

    _made: dict[tuple[str, str, int], Codec] = {}

    def __init__(self, ranks_path: str, pattern: str, kept: int = KEPT):
        import regex

        ranks = load_ranks(ranks_path)
        find = regex.compile(pattern).findall
        self.transducer, self.decoder = Transducer(ranks), Decoder(ranks)
        encode = self.transducer.encode

        def piece(match: str) -> bytes:
            tokens = encode(match.encode("utf-8", "surrogatepass"))
            return pack(f"<{len(tokens)}I", *tokens)

        pieces = Remembered(piece, kept).__getitem__

        def stretch(text: str) -> bytes:
            matches = find(text)
            return piece(matches[0]) if len(matches) == 1 else b"".join(map(pieces, matches))

        #: what lies between two cuts; the same for what follows a space, without it
        self.stretches = Remembered(stretch, kept)
        self.spaced = Remembered(lambda word: stretch(" " + word), kept)

    @classmethod
    def of(cls, ranks_path: str, pattern: str, kept: int = KEPT) -> Codec:
        key = (ranks_path, pattern, kept)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if WIDE(text):
            return b"".join(map(self.stretches.__getitem__, CUT(text)))
        first, *words = text.split(" ")
        return self.stretches[first] + b"".join(map(self.spaced.__getitem__, words))

    def decode(self, ids: bytes, chunk: int = 1 << 16) -> str:
        a = np.frombuffer(ids, "<u4")
        cuts = range(0, len(a), chunk)
        return "".join([*(self.decoder.feed(a[i : i + chunk]) for i in cuts), self.decoder.feed(a[:0], True)])


holds(Codec._made.clear)


def encode(documents: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: bool = True, kept: int = KEPT) -> DataFrame:
    """One row for each row: key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves (array<int>) if asked for.

    ``kept``: bytes of one generation of remembered encodings; fewer take less memory of a worker and more time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        codec = Codec.of(ranks_path, pattern, kept)
        for b in batches:
            n, hashes, decoded, out = [], [], [], []
            for x in b.column("text"):
                packed = codec.encode(x.as_py())
                n.append(len(packed) // 4)
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed).encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    out.append(np.frombuffer(packed, "<u4").astype(np.int32))
            columns = {key: b.column(key), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if ids:
                columns["ids"] = pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = documents.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return documents.select(key, "text").mapInArrow(work, shape)
