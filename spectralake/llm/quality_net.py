"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters see WIDTH bytes every STRIDE bytes, and their rectified outputs are max-pooled over
chunks of CHUNK bytes that overlap by OVERLAP and cover the whole document. The chunks' pools are averaged and max-pooled
and combined with the length into one probability. Training is Adam on at most ``rows`` labelled documents, chosen by the
hash of their ids, on their whole texts, which the driver holds compressed; scoring reads every byte, PASS chunks at a time.

Null and empty texts are scored as one empty chunk. Repeated rows get the same score. Without labelled rows every score
is 0.5. Labels that are null are left out; a doc_id with two
labels is learnt with both, repeated rows once. An empty table gives an empty table. Of equal
maxima the first place learns. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.llm.common import encoded, enter, once

DIM, WIDTH, STRIDE, FILTERS = 6, 8, 4, 24
#: Chunks that one pass holds.
CHUNK, OVERLAP, PASS = 1024, 128, 32
#: Labelled rows that a fit takes at most.
ROWS = 3000
EPOCHS, BATCH, RATE = 10, 32, 0.01


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK bytes (+1, 0 pads) that cover all of data."""
    a = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(a) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.int16)
    padded[: len(a)] = a
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (257, DIM)).astype(np.float32),
            "w": r.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": r.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.p["e"][0] = 0

    def pools(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of chunks: patches (as byte numbers), pooled outputs and the place of each maximum."""
        patches = np.lib.stride_tricks.sliding_window_view(rows, WIDTH, axis=1)[:, ::STRIDE]
        z = self.p["e"][patches].reshape(*patches.shape[:2], -1) @ self.p["w"]
        at = z.argmax(axis=1)
        return patches, np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["b"], 0), at

    def features(self, pooled: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate((pooled.mean(axis=0), pooled.max(axis=0), [np.log1p(n) / 10])).astype(np.float32)

    def score(self, text: str | None) -> float:
        data = encoded(text)
        rows = chunks(data)
        pooled = np.concatenate([self.pools(rows[i : i + PASS])[1] for i in range(0, len(rows), PASS)])
        return float(1 / (1 + np.exp(-np.clip(self.features(pooled, len(data)) @ self.p["v"] + self.p["c"][0], -30, 30))))

    def gradient(self, data: bytes, label: float, weight: float) -> dict[str, np.ndarray]:
        rows = chunks(data)
        met = []
        for i in range(0, len(rows), PASS):
            patches, pooled, at = self.pools(rows[i : i + PASS])
            met.append((pooled, np.take_along_axis(patches, at[:, :, None], 1)))
        pooled, chosen = (np.concatenate(c) for c in zip(*met, strict=True))
        f = self.features(pooled, len(data))
        d = np.float32(weight) * (1 / (1 + np.exp(-np.clip(f @ self.p["v"] + self.p["c"][0], -30, 30))) - label)
        df = d * self.p["v"]
        dp = np.repeat(df[None, :FILTERS] / len(rows), len(rows), axis=0)
        dp[pooled.argmax(axis=0), np.arange(FILTERS)] += df[FILTERS : 2 * FILTERS]
        dp *= pooled > 0
        x = self.p["e"][chosen].reshape(len(rows), FILTERS, -1)
        dw = np.einsum("cf,cfk->kf", dp, x)
        dx = (dp[:, :, None] * self.p["w"].T[None]).reshape(-1, DIM)
        de = np.zeros_like(self.p["e"])
        np.add.at(de, chosen.reshape(-1), dx)
        de[0] = 0
        return {"e": de, "w": dw, "b": dp.sum(axis=0), "v": d * f, "c": np.array([d], np.float32)}


def packed(text: str | None) -> bytes:
    return zlib.compress(encoded(text), 1)


def fit(rows: list[tuple[str | None, int]], seed: int = 7) -> Net:
    return fitted([(packed(t), y) for t, y in rows], seed)


def fitted(rows: list[tuple[bytes, int]], seed: int = 7) -> Net:
    """A net of (compressed bytes, label)."""
    net, r = Net(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    data, labels = [t for t, _ in rows], [int(y) for _, y in rows]
    t = 0
    for epoch in range(EPOCHS if len(set(labels)) else 0):
        rate = RATE * (1 - epoch / EPOCHS)
        order = r.permutation(len(data))
        for i in range(0, len(order), BATCH):
            total = {k: np.zeros_like(v) for k, v in net.p.items()}
            for j in order[i : i + BATCH]:
                for k, g in net.gradient(zlib.decompress(data[j]), labels[j], 1.0 / BATCH).items():
                    total[k] += g
            t += 1
            for k, g in total.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    if not rows:
        net.p["v"][:] = 0
    return net


def train(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = ROWS) -> Net:
    """``learn`` says by doc_id which labelled rows may be learnt from; the ``rows`` of least id hash are."""
    chosen = labels.where(learn & F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text", "quality").alias("h"))
    # documents with one doc_id may be many: the bound holds for what is learnt from
    picked = picked.join(F.broadcast(picked.select("h").distinct().orderBy("h").limit(rows)), "h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality_net")
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packed(x.as_py()) for x in b.column("text")], pa.binary()), b.column("quality"), b.column("h")], names=["data", "quality", "h"])

    kind = picked.schema["quality"].dataType.simpleString()
    return fitted([(bytes(r["data"]), r["quality"]) for r in sorted(once(picked.select("text", "quality", "h").mapInArrow(work, f"data binary, quality {kind}, h long")).collect(), key=lambda r: r["h"])])


def scored(documents: DataFrame, net: Net, columns: list[str]) -> DataFrame:
    """Adds score to the columns."""
    parameters = net.p

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality_net")
        own = Net()
        own.p = parameters
        for b in batches:
            s = [own.score(x.as_py()) for x in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(s, pa.float64())], names=[*columns, "score"])

    base = documents.select(*columns, F.col("text").alias("_text"))
    return base.mapInArrow(work, base.select(*columns).schema.add("score", "double"))
