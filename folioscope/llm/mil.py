"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, its whole text. Each passage is encoded: means over its words of their
shape (length, capitals, digits, symbols, punctuation) and of signed hash bits of their spelling, and shares of repeated,
adjacent equal and distinct words. A layer h = tanh(W x + b) is followed by gated attention, weights a_k in proportion to
exp(w (tanh(V h_k) * sigmoid(U h_k))), and the weighted mean of h is scored by a logistic unit. Document labels train all
of it by gradient descent (Adam), from a fixed seed.

The model is fitted on the driver, on all passages of at most TRAIN_DOCS labelled documents (those with the smallest hashes
of doc_id); scoring reads all passages of all documents.

Nulls: a null or empty text is one passage of zeros, and scored like others; a null doc_id is never held out and has no
label; null labels are left out, and several labels of a document are averaged. Without any label every score is 0.5.
Of different texts of one labelled doc_id one trains. Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import word_blocks

PASSAGE, TRAIN_DOCS, EPOCHS = 64, 6000, 30
HASHED, HIDDEN, ATTENTION = 24, 24, 12
KEEP = 0.7
#: Passages whose gradients are computed at once; a document's are never parted.
BLOCK = 8192
#: Bytes of text that are encoded at once for scoring.
BYTES_AT_ONCE = 1 << 20
#: Words whose encodings a task keeps; it forgets all of them beyond that.
CACHE = 400_000
SHAPES = 10
FEATURES = SHAPES + HASHED + 4


#: The signs of 12 bits.
_SIGNS = (np.arange(4096)[:, None] >> np.arange(12) & 1).astype(np.float32) * 2 - 1
_STOPS, _SYMBOLS = ".,;:!?", "#*$%&|<>=+^~@\\/_{}[]"


class Words(dict):
    """word -> row of its encoding in self.rows; row 0 is zero, for no word."""

    def __init__(self) -> None:
        self.rows = np.zeros((1024, SHAPES + HASHED), np.float32)
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        row = self.rows[i]
        text = word.decode("utf-8", "replace")
        n, core = len(text), text.rstrip(_STOPS)
        if core.isalpha():  # most words: letters, perhaps with stops behind them
            letters, digits, symbols = len(core), 0, 0
            stops, upper = n - letters, 0 if core.islower() else sum(map(str.isupper, core))
        else:
            upper, digits, letters = sum(map(str.isupper, text)), sum(map(str.isdigit, text)), sum(map(str.isalpha, text))
            symbols, stops = sum(c in _SYMBOLS for c in text), sum(c in _STOPS for c in text)
        row[:SHAPES] = min(n, 24) / 8, upper / n, digits / n, symbols / n, stops / n, (n - letters - digits - symbols - stops) / n, letters == 0, upper == letters > 1, text[-1] in "!?", n > 24
        bits = xxhash.xxh64_intdigest(text.strip(".,;:!?#*$%&|<>").lower(), 7)
        row[SHAPES : SHAPES + 12], row[SHAPES + 12 :] = _SIGNS[bits & 4095], _SIGNS[bits >> 12 & 4095]
        return i

    def ready(self) -> None:
        if len(self) > CACHE:
            self.clear()
            self[b""] = 0


def _of_words(ids: np.ndarray, cache: Words) -> np.ndarray:
    """Encodings of the passages of one block of words; row 0 of the cache is no word and fills the last passage up."""
    count = -(-len(ids) // PASSAGE)
    filled = np.zeros(count * PASSAGE, np.int64)
    filled[: len(ids)] = ids
    filled = filled.reshape(count, PASSAGE)
    sizes = np.minimum(PASSAGE, len(ids) - PASSAGE * np.arange(count)).astype(np.float32)[:, None]
    means = cache.rows[filled].sum(1) / sizes
    ordered = np.sort(filled, axis=1)
    same = np.zeros(ordered.shape, bool)
    same[:, 1:] = (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] > 0)
    place = np.arange(PASSAGE)
    run = place - np.maximum.accumulate(np.where(same, 0, place), axis=1) + 1
    adjacent = ((filled[:, 1:] == filled[:, :-1]) & (filled[:, 1:] > 0)).sum(1)
    return np.concatenate([means, np.stack([same.sum(1), adjacent, run.max(1)], axis=1) / sizes, sizes / PASSAGE], axis=1).astype(np.float32)


def passages(text: bytes | None, cache: Words) -> np.ndarray:
    """(passages, FEATURES) of a whole text."""
    text, parts, rest = text or b"", [], []
    for words in word_blocks(text, 0):
        words = rest + words
        cut = len(words) if len(text) <= 1 << 20 else len(words) // PASSAGE * PASSAGE
        rest = words[cut:]
        if cut:
            cache.ready()
            parts.append(_of_words(np.fromiter(map(cache.__getitem__, words[:cut]), np.int64, cut), cache))
    if rest:
        cache.ready()
        parts.append(_of_words(np.fromiter(map(cache.__getitem__, rest), np.int64, len(rest)), cache))
    return np.concatenate(parts) if parts else np.zeros((1, FEATURES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """The weights, and the mean and deviation that passages are scaled by."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: scaled passages of several documents, which begin at starts."""
        p, bag = self.weights, np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"][0])}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return self.forward(self.scaled(np.concatenate(bags)), np.r_[0, np.cumsum([len(b) for b in bags])[:-1]])["score"]


def _blocks(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Documents in order, in parts of BLOCK passages or fewer, or of one document."""
    start = total = 0
    for i, n in enumerate(sizes[order].tolist()):
        if i > start and total + n > BLOCK:
            yield order[start:i]
            start, total = i, 0
        total += n
    yield order[start:]


def fitted(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    sizes = np.array([len(b) for b in bags])
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / sizes.sum()
    deviation = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / sizes.sum())
    near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    share = np.clip(labels.mean(), 0.01, 0.99)
    model = Model(mean, deviation + 1e-2, {"W": near(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": near(HIDDEN, ATTENTION), "U": near(HIDDEN, ATTENTION), "w": near(ATTENTION), "c": near(HIDDEN), "d": np.array([np.log(share / (1 - share))])})
    p = model.weights
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            batch_docs = order[i : i + batch]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            for own in _blocks(batch_docs, sizes):
                x = model.scaled(np.concatenate([bags[j] for j in own]).astype(np.float64))
                starts = np.r_[0, np.cumsum(sizes[own])[:-1]]
                f = model.forward(x, starts)
                bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
                d = (f["score"] - labels[own]) / len(batch_docs)
                dz = d[:, None] * p["c"]
                da = (dz[bag] * h).sum(1)
                de = a * (da - np.add.reduceat(a * da, starts)[bag])
                dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
                dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
                for k, v in {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ d, "d": np.array([d.sum()])}.items():
                    grads[k] += v
            step += 1
            for k, v in grads.items():
                v = v + decay * p[k]
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages and quality of at most `most` labelled documents that aren't held out. The sample is bounded, so it may be broadcast and collected."""
    sample = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for b in batches:
            raw = [passages(t, cache).astype("<f2").tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), b.column(2)], ["doc_id", "x", "quality"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    rows = own.mapInArrow(encode, "doc_id long, x binary, quality double").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).orderBy("doc_id").collect()
    return [np.frombuffer(r.x, "<f2").reshape(-1, FEATURES) for r in rows], np.array([r.quality for r in rows])


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model | None:
    bags, quality = training_bags(docs, labels, most)
    return fitted(bags, quality) if bags else None


def scored(docs: DataFrame, model: Model | None, score: str = "score") -> DataFrame:
    """docs with the score, from 0 to 1, of the whole text of each."""
    docs = docs.withColumn("text", F.col("text").cast("string").alias("text"))
    names, at = docs.columns, docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for b in batches:
            # A few megabytes of text are encoded at a time, a document at least.
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(size // BYTES_AT_ONCE)) + 1).tolist(), len(b)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = b.slice(start, end - start)
                if not len(part):
                    continue
                texts = part.column(at).cast(pa.binary()).to_pylist()
                got = model.scores([passages(t, cache) for t in texts]) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got.astype(np.float64))], [*names, score])

    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
