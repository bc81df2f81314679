"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is cut to its runs of letters, lower-cased; a run's features are itself and its character 2-, 3- and 4-grams with its
ends marked, hashed into BUCKETS. A text is the mean of its features' embeddings, repeats counted, and a linear
softmax reads the language from it. Embeddings and softmax are trained together by stochastic gradient descent in numpy, from a
fixed seed, on whole texts and on short passages of them, so that short texts are judged as well as long ones.

Rejection is calibrated on a part of the sample that the descent doesn't see: a temperature fits the scores to how often they
are right, and the threshold is the least score from which on PRECISION of the answers there are right. `accepted` tells
whether a text's score reaches it; the answer itself stays.

The model is fitted on the driver on at most TRAIN_DOCS documents with a language that aren't held out, as many of each of the
MOST_LANGUAGES most frequent languages, chosen by a hash of doc_id; what is collected of each is bounded by BUCKETS, however
long its text is. Prediction reads whole texts of all documents, without a shuffle.

Nulls: a null text, or one without a letter, is UNKNOWN with score 0 and isn't accepted; a null doc_id is never held out; a
null language teaches nothing. Without any language all are UNKNOWN. Of different texts of one doc_id and language one teaches.
Equal texts get equal answers, and of equal scores the first language by code point wins. Columns of docs that have a name of
those added are replaced. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import word_blocks
from folioscope.llm.mil import held_out

UNKNOWN = "und"
#: Bounds of the sample that the model is fitted on.
TRAIN_DOCS, MOST_LANGUAGES = 2400, 1000
BUCKETS, DIMENSIONS, EPOCHS, BATCH = 1 << 13, 16, 12, 64
#: Words of the passages of each training document that are learned besides the whole.
PIECES = (3, 10, 40)
#: Of the accepted answers so many are to be right.
PRECISION = 0.99
#: A mean of many embeddings is small; it is multiplied by this.
GAIN = 8.0
#: Bytes and texts whose features are counted at once; a longer text is cut between words.
BYTES_AT_ONCE, TEXTS_AT_ONCE = 1 << 18, 64
#: No letter has a higher code point (Unicode 16: 323AF).
LAST_LETTER = 0x32400
#: Odd 64-bit multipliers; the upper 13 bits of a sum are the bucket.
_ODD = np.random.default_rng(7).integers(1 << 62, (1 << 63) - 1, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


@cache
def _letters() -> np.ndarray:
    """code point -> its lower case, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(LAST_LETTER):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def bags(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in each text: (texts, BUCKETS). All texts together are one array of code points."""
    raw = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "replace"), "<u4")
    c = _letters()[np.minimum(raw, 0x10FFFF)].astype(np.uint64)
    own = np.repeat(np.arange(len(texts)) * BUCKETS, [len(t) + 2 for t in texts])
    letter = c > 0
    # A window's first and last place may be an end; what is between are letters.
    windows = {2: letter[:-1] | letter[1:], 3: letter[1:-1], 4: letter[1:-2] & letter[2:-1]}
    found = []
    for n, good in windows.items():
        at = np.flatnonzero(good)
        h = c[at] * _ODD[n]
        for i in range(1, n):
            h += c[at + i] * _ODD[n + 4 * i]
        found.append(own[at] + (h >> _SHIFT).astype(np.int64))
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    if len(starts):
        run = np.cumsum(letter[1:] & ~letter[:-1])  # of each place from the second on; ends belong to the run before
        place = np.arange(1, len(c)) - starts[np.maximum(run - 1, 0)]
        value = np.where(letter[1:], c[1:] * (_ODD[0] + (place.astype(np.uint64) * _ODD[1] << np.uint64(1))), np.uint64(0))
        found.append(own[starts] + ((np.add.reduceat(value, starts - 1) * _ODD[63]) >> _SHIFT).astype(np.int64))
    return np.bincount(np.concatenate(found), minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def bag(text: bytes) -> np.ndarray:
    """bags() of one text of any length, cut between words."""
    total = np.zeros(BUCKETS, np.int64)
    for words in word_blocks(text, 0):
        total += bags([b" ".join(words).decode("utf-8", "replace")])[0]
    return total


def pieces(text: bytes, at: int) -> list[np.ndarray]:
    """Bags of a whole text and of its passages of PIECES words, at places told by the number `at`."""
    words = next(word_blocks(text, 0), [])
    out = [bag(text)]
    for n in PIECES:
        if n < len(words):
            start = (at + 7919 * n) % (len(words) - n + 1)
            out.append(bag(b" ".join(words[start : start + n])))
    return [b for b in out if b.any()]


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """x: bags."""
        return GAIN * (x / x.sum(1, keepdims=True)) @ self.embeddings @ self.softmax + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def descended(sample: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent, the rate falling to zero; sample: buckets and counts. Languages weigh alike."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, n)), np.zeros(n))
    weight = (len(of) / n / np.maximum(1, np.bincount(of, minlength=n)))[of]
    step, steps = 0, epochs * -(-len(sample) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            x = np.zeros((len(own), BUCKETS))
            for row, j in enumerate(own):
                x[row, sample[j][0]] = sample[j][1] / sample[j][1].sum()
            x *= GAIN
            hidden = x @ model.embeddings
            d = _softmax(hidden @ model.softmax + model.bias)
            d[np.arange(len(own)), of[own]] -= 1
            d *= weight[own][:, None] / len(own)
            now = rate * (1 - step / steps)
            back = d @ model.softmax.T
            model.softmax -= now * hidden.T @ d
            model.bias -= now * d.sum(0)
            model.embeddings -= 8 * now * x.T @ back
            step += 1
    return model


def calibrated(model: Model, sample: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, precision: float = PRECISION) -> Model:
    """model with the temperature of the least log loss over other bags, and the least score from which on `precision` of the answers are right."""
    if not sample:
        return model
    z = []
    for i in range(0, len(sample), 256):
        x = np.zeros((len(sample[i : i + 256]), BUCKETS))
        for row, (b, c) in enumerate(sample[i : i + 256]):
            x[row, b] = c
        z.append(model.logits(x))
    z = np.concatenate(z)
    row = np.arange(len(z))
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[row, of], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    p = _softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == of
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1)
    model.threshold = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def training_bags(docs: DataFrame, most: int = TRAIN_DOCS, languages: int = MOST_LANGUAGES) -> list:
    """Rows (lang, h, piece, buckets, counts) of the sample; `most` documents at least one of each language."""
    taught = docs.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("out")).filter("lang IS NOT NULL AND NOT out")
    counts = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    known = counts.collect()
    if not known:
        return []
    each = max(1, most // len(known))
    # Most rows go by their hash, before ids meet; twice as many as wanted stay.
    share = F.shiftrightunsigned("h", 33) / F.lit(float(1 << 31))
    near = taught.join(F.broadcast(docs.sparkSession.createDataFrame([(r.lang, 2.0 * each / r.n) for r in known], "lang string, rate double")), "lang").filter(share < F.col("rate"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = near.select("lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, h, t in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2).cast(pa.binary()), strict=True):
                got = pieces(t.as_py() or b"", h & 0x7FFFFFFF)
                if got:
                    at = [np.flatnonzero(x) for x in got]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array([h] * len(got)), pa.array(range(len(got)), pa.int32()), pa.array([i.astype("<u2").tobytes() for i in at]), pa.array([x[i].astype("<f4").tobytes() for i, x in zip(at, got, strict=True)])], ["lang", "h", "piece", "buckets", "counts"])

    # The sample is bounded: `most` rows of a language and a long.
    rows = taught.join(F.broadcast(sample), ["lang", "h"]).select("lang", "h", "text").mapInArrow(encode, "lang string, h long, piece int, buckets binary, counts binary")
    return rows.groupBy("lang", "h", "piece").agg(F.min(F.struct("buckets", "counts")).alias("x")).select("lang", "h", "piece", "x.buckets", "x.counts").orderBy("h", "lang", "piece").collect()


def trained(docs: DataFrame, most: int = TRAIN_DOCS, languages: int = MOST_LANGUAGES, precision: float = PRECISION) -> Model | None:
    """A model of docs (doc_id, text, lang); None if there is nothing to learn from."""
    rows = training_bags(docs, most, languages)
    names = sorted({r.lang for r in rows}, key=lambda s: s.encode())
    if not names:
        return None
    at = {x: i for i, x in enumerate(names)}
    sample = [(np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.counts, "<f4")) for r in rows]
    of, apart = np.array([at[r.lang] for r in rows]), np.array([r.h % 8 == 3 for r in rows])
    if not all((~apart & (of == i)).any() for i in range(len(names))):  # too few documents to set some apart
        return calibrated(descended(sample, of, names), sample, of, precision)
    part = lambda keep: ([b for b, k in zip(sample, keep, strict=True) if k], of[keep])
    return calibrated(descended(*part(~apart), names), *part(apart), precision)


def predicted(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score", accepted: str = "accepted") -> DataFrame:
    """docs with the language of each whole text, its score from 0 to 1, and whether the score reaches the threshold."""
    kept = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower(), accepted.lower()) or c == "text"]
    docs = docs.select(*kept).withColumn("text", F.col("text").cast("string"))
    names, at = docs.columns, docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = GAIN * model.embeddings @ model.softmax if model else None
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
            near = np.maximum(np.diff(size // BYTES_AT_ONCE), np.diff(np.arange(len(b)) // TEXTS_AT_ONCE)) if len(b) else np.zeros(0)
            cuts = [0, *(np.flatnonzero(near) + 1).tolist(), len(b)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = b.slice(start, end - start)
                if not len(part):
                    continue
                said, p = [UNKNOWN] * len(part), np.zeros(len(part))
                if votes is not None:
                    texts = part.column(at)
                    long = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > BYTES_AT_ONCE
                    if long.any():
                        x = np.stack([bag(t or b"") for t in texts.cast(pa.binary()).to_pylist()])
                    else:
                        x = bags([t or "" for t in texts.to_pylist()])
                    total = x.sum(1)
                    told = np.flatnonzero(total > 0)
                    if len(told):
                        z = _softmax((x[told] @ votes / total[told, None] + model.bias) / model.temperature)
                        p[told] = z.max(1)
                        for i, k in zip(told.tolist(), z.argmax(1).tolist(), strict=True):
                            said[i] = model.languages[k]
                sure = (p >= model.threshold) & (np.array(said, object) != UNKNOWN) if model else np.zeros(len(part), bool)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said), pa.array(p), pa.array(sure.astype(bool))], [*names, lang, score, accepted])

    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(accepted, T.BooleanType())]))
