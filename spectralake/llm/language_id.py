"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Letters are lower-cased; every other character of ASCII is a boundary, and those beyond it count as letters; runs of 1 to 4 characters (boundaries included) are hashed into
BUCKETS rows of an embedding, the average over the whole text goes through a softmax. A temperature fitted on a tenth of
the sample calibrates probabilities and gives the least probability below which an answer counts as rejected. The fit takes at most ``rows``
documents, chosen by the hash of their ids; executors count the whole texts, the driver gets one histogram for each.

Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was learnt. Null languages
are not learnt from, repeated rows once. Repeated rows get the same answer; of equal probabilities the language first by name wins. An empty
table gives an empty table. A very long text is counted in blocks. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectralake.llm.common import enter, once

BUCKETS, DIM, LONGEST = 1 << 14, 16, 4
#: Documents that a fit takes at most, and characters of a text that one pass holds.
ROWS, BLOCK = 4000, 1 << 18
EPOCHS, BATCH, RATE = 6, 16, 0.5
#: Share of the held-back tenth's right answers that the fitted rejection threshold gives up.
REJECT = 0.01


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed subwords over the whole text; None without a letter. Blocks only bound memory: runs start in one each."""
    if not text or not any(map(str.isalpha, text)):
        return None
    total = np.zeros(BUCKETS, np.int64)
    low = text.lower()
    n = len(low) + 2  # with a boundary on either side
    for i in range(0, n, BLOCK):
        end = min(n, i + BLOCK + LONGEST - 1)
        a = np.frombuffer(low[max(i - 1, 0) : end - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where((a > 127) | ((a >= 97) & (a <= 122)), a, 0).astype(np.uint32)
        c = np.concatenate((np.zeros(int(i == 0), np.uint32), c, np.zeros(int(end == n), np.uint32)))
        h = np.zeros(len(c), np.uint32)
        for k in range(LONGEST):
            h = (h if k == 0 else h[:-1]) * np.uint32(0x01000193) + (c[k:] + np.uint32(1)) * np.uint32(0x9E3779B1)
            own = h[:BLOCK]
            total += np.bincount((own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(18), minlength=BUCKETS)
            if len(h) == 1:
                break
    return total


class Model:
    def __init__(self, languages: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = r.normal(0, 0.1, (BUCKETS, DIM))
        self.output = r.normal(0, 0.1, (DIM, len(languages)))
        self.temperature = 1.0
        #: Best probabilities below it are rejected; fitted.
        self.least = 0.0

    def probabilities(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (n @ self.embedding[at] / n.sum()) @ self.output / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None, reject: float = 0.0) -> tuple[str, float]:
        c = counts(text) if self.languages else None
        if c is None:
            return "und", 0.0
        at = np.flatnonzero(c)
        p = self.probabilities(at, c[at])
        best = int(p.argmax())
        return (self.languages[best], float(p[best])) if p[best] >= reject else ("und", float(p[best]))


def packed(text: str | None) -> tuple[bytes, bytes] | None:
    """The buckets that a text has (16 bits each) and their counts (32 bits each)."""
    c = counts(text)
    if c is None:
        return None
    at = np.flatnonzero(c)
    return at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()


def fit(rows: list[tuple[str | None, str]], seed: int = 3) -> Model:
    return fitted([(c, y) for t, y in rows if (c := packed(t)) is not None], seed)


def fitted(pairs: list[tuple[tuple[bytes, bytes], str]], seed: int = 3) -> Model:
    """A model of (packed counts, language)."""
    model = Model(sorted({y for _, y in pairs}), seed)
    if not pairs:
        return model
    index = {y: i for i, y in enumerate(model.languages)}
    sparse = [(np.frombuffer(at, np.uint16).astype(np.int32), np.frombuffer(n, np.uint32), index[y]) for (at, n), y in pairs]
    r = np.random.default_rng(seed)
    held, learnt = sparse[::10], [x for i, x in enumerate(sparse) if i % 10] or sparse
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for j in r.permutation(len(learnt)):
            at, n, y = learnt[j]
            share = n / n.sum()
            hidden = share @ model.embedding[at]
            z = hidden @ model.output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = model.output @ p
            model.output -= rate * np.outer(hidden, p)
            model.embedding[at] -= (rate * 4 * len(at) ** 0.5) * share[:, None] * back[None, :]
    grid = np.geomspace(0.1, 10, 41)

    def loss(t: float) -> float:
        model.temperature = t
        return -sum(np.log(model.probabilities(at, n)[y] + 1e-12) for at, n, y in held)

    model.temperature = float(min(grid, key=loss))
    best = [model.probabilities(at, n) for at, n, _ in held]
    right = [float(p.max()) for p, (_, _, y) in zip(best, held, strict=True) if p.argmax() == y]
    model.least = float(np.quantile(right, REJECT)) if right else 0.0
    return model


def train(documents: DataFrame, learn: Column, rows: int = ROWS) -> Model:
    known = documents.where(learn & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text", "lang").alias("h"))
    picked = known.join(F.broadcast(known.select("h").distinct().orderBy("h").limit(rows)), "h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language_id")
        for b in batches:
            out = [packed(x.as_py()) or (None, None) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["h", "lang", "at", "n"])

    kind = picked.schema["lang"].dataType.simpleString()
    found = once(picked.select("h", "lang", "text").mapInArrow(work, f"h long, lang {kind}, at binary, n binary").where("at IS NOT NULL")).collect()
    return fitted([((r["at"], r["n"]), r["lang"]) for r in sorted(found, key=lambda r: r["h"])])


def identified(documents: DataFrame, model: Model, columns: list[str], reject: float = 0.0) -> DataFrame:
    """Adds lang_pred, score and rejected (whether the score is below the fitted threshold) to the columns.

    ``reject`` is a least score for which lang_pred isn't ``und``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language_id")
        for b in batches:
            out = [model.predict(x.as_py(), reject) for x in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[1] < model.least or x[0] == "und" for x in out])], names=[*columns, "lang_pred", "score", "rejected"])

    base = documents.select(*columns, F.col("text").alias("_text"))
    return base.mapInArrow(work, base.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
