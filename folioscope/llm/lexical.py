"""Ranked lexical search: an Aho-Corasick automaton of all items' terms reads the documents.

A term is a maximal run of TERM; only A-Z are lower-cased. The distinct terms of all items make one automaton, each between
two blanks, so that it fires on whole terms only; it is broadcast, and a document's text, whose separators became blanks, goes
through it once. What it says are numbers of terms, and a table maps these to the items that hold them. No index of the
documents is made or kept: one scan counts documents (N), terms (L) and each term's documents (df), a second one scores.

With n the terms of a document and tf those that are the term, m = 50 + (50 n N) div L, w = floor(1000 ln((2N + 2) / (2df + 1))),
and the score is the sum of w ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, in 64-bit integers. Each task keeps the
best of every item; these meet in two steps, by parts of an item first, so no task gets the candidates of all tasks.

Items go through in blocks of BLOCK_BYTES of terms and ITEMS_AT_ONCE items, which bounds what is collected and broadcast; an
item that is larger is a block of its own. Two scans are made for each block.

Nulls: a null or empty text has no terms; it isn't counted and never found. An item without terms has no rows. Rows of one
item_id, null among them, are one item, with the terms of all of them. Repeated documents count and are found as often as they
occur. Equal scores go by ascending doc_id, null last. Whole texts of any length are read. Of documents only doc_id and text,
of items only item_id and text are read, so other columns can't clash. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import staged

#: Java spelling: a run of anything but the ASCII characters that are neither letters nor digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
#: Bytes of terms (and 8 for each) and items whose automaton is broadcast at once.
BLOCK_BYTES, ITEMS_AT_ONCE = 1 << 20, 20_000
#: Sums (documents by items) that a task holds at once.
CELLS = 1 << 22
#: Parts of an item's candidates that are ranked apart first.
PARTS = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes of other characters than ASCII all belong to terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_number = itemgetter(1)


def spaced(text: bytes | None) -> tuple[str, int]:
    """A text's terms with blanks for all separators and at both ends, a character for each byte of UTF-8; and how many there are."""
    raw = (text or b"").translate(_BYTES)
    return f" {raw.decode('latin-1')} ", len(raw.split())


def guarded(terms: list[str]) -> ahocorasick.Automaton:
    """The automaton that gives a term's number wherever it stands as a whole."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        automaton.add_word(spaced(t.encode())[0], i)
    automaton.make_automaton()
    return automaton


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct."""
    every = F.array_distinct(F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))
    return items.select("item_id", F.explode(every).alias("term")).distinct()


def blocks(terms: DataFrame, most: int = BLOCK_BYTES, items: int = ITEMS_AT_ONCE) -> tuple[Column, int]:
    """A column that deals item_id to blocks, and how many there are: none exceeds the bounds unless it is one item."""
    sizes = terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 8).alias("bytes"))
    count, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n = max(1, math.ceil(1.2 * total / most) if total > most else 1, math.ceil(1.2 * count / items) if count > items else 1)
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = sizes.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("items")).filter((F.col("items") > 1) & ((F.col("bytes") > most) | (F.col("items") > items)))
        if n == 1 and total <= most and count <= items or over.isEmpty():
            return block, n
        n *= 2


class Best:
    """The best `most` (score, document) of each item so far."""

    def __init__(self, items: int, most: int) -> None:
        self.most, self.items = most, items
        self.least = np.zeros(items, np.int64)  # what a document must have to come in
        self.kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        """scores: documents by items."""
        floor = np.maximum(self.least, 1)
        if len(scores) > self.most:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.most, axis=0)[len(scores) - self.most])
        doc, item = np.nonzero(scores >= floor[None, :])
        self.new.append([item, scores[doc, item], ids[doc], nameless[doc]])
        self.waiting += len(doc)
        if self.waiting > max(1 << 18, len(self.kept[0])):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """item, score, doc_id, whether it is null."""
        item, score, doc, nameless = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((doc, nameless, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        self.kept = [x[place < self.most] for x in (item, score[order], doc[order], nameless[order])]
        last = place == self.most - 1
        self.least[item[last]] = score[order][last]
        self.new, self.waiting = [], 0
        return self.kept


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def counts(docs: DataFrame, automaton, terms: int) -> tuple[int, int, np.ndarray]:  # noqa: ANN001
    """N, L and df of each of the automaton's terms (a broadcast), over all documents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fires, df, documents, length = automaton.value, np.zeros(terms, np.int64), 0, 0
        for b in batches:
            seen: list[int] = []
            for t in b.column(1).cast(pa.binary()):
                text, n = spaced(t.as_py())
                documents, length = documents + (n > 0), length + n
                seen.extend(set(map(_number, fires.iter(text))))
            df += np.bincount(np.array(seen, np.int64), minlength=terms)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, hit]), pa.array(np.r_[documents, length, df[hit]])], ["term", "n"])

    found = _texts(docs).mapInArrow(of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    at = {r.term: r.n for r in found}
    return at.pop(-1, 0), at.pop(-2, 0), np.array([at.get(i, 0) for i in range(terms)], np.int64)


def _scored(docs: DataFrame, automaton, terms: list[tuple[int, list[int]]], weights: np.ndarray, documents: int, length: int, items: int, most: int) -> DataFrame:  # noqa: ANN001
    """(item, doc_id, score, part): each task's best of every item. terms: the items of each."""
    sizes = np.array([len(x) for x in terms], np.int64)
    starts, of_term = np.cumsum(sizes) - sizes, np.array([i for x in terms for i in x], np.int64)
    told = docs.sparkSession.sparkContext.broadcast((sizes, starts, of_term, weights))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fires, (sizes, starts, of_term, weights) = automaton.value, told.value
        best, at_once = Best(items, most), max(1, CELLS // items)
        number, times, own, m, ids = [], [], [], [], []

        def flush() -> None:
            t, tf, many = np.array(number, np.int64), np.array(times, np.int64), np.array(own, np.int64)
            doc = np.repeat(np.arange(len(own)), many)
            value = weights[t] * (1_000_000_000 * tf // (1000 * tf + 20 * np.array(m, np.int64)[doc]))
            scores = np.zeros(len(own) * items, np.int64)
            fan = sizes[t]
            cuts = np.flatnonzero(np.diff(np.cumsum(fan) // CELLS)) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(t)], strict=True):
                f = fan[i:j]
                if f.sum():
                    place = np.repeat(starts[t[i:j]] - np.cumsum(f) + f, f) + np.arange(f.sum())
                    np.add.at(scores, np.repeat(doc[i:j] * items, f) + of_term[place], np.repeat(value[i:j], f))
            names = np.array([x or 0 for x in ids], np.int64)
            best.add(scores.reshape(len(own), items), names, np.array([x is None for x in ids], bool))
            for x in (number, times, own, m, ids):
                x.clear()

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                text, n = spaced(t.as_py())
                tf = Counter(map(_number, fires.iter(text)))
                if not tf:
                    continue
                number.extend(tf.keys())
                times.extend(tf.values())
                own.append(len(tf))
                ids.append(name)
                m.append(50 + 50 * n * documents // length)
                if len(own) >= at_once:
                    flush()
        if own:
            flush()
        item, score, doc, nameless = best.settle()
        for i in range(0, len(item), 10_000):
            own_ids = pa.array(doc[i : i + 10_000], mask=nameless[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item[i : i + 10_000].astype(np.int32)), own_ids, pa.array(score[i : i + 10_000])], ["item", "doc_id", "score"])

    return _texts(docs).mapInArrow(of, "item int, doc_id long, score long").withColumn("part", F.spark_partition_id() % PARTS)


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST, block_bytes: int = BLOCK_BYTES, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` highest-scoring documents (doc_id, text) of each item (item_id, text), where above 0."""
    spark = docs.sparkSession
    terms = staged(item_terms(items), "terms")
    block, n = blocks(terms, block_bytes, items_at_once)
    kind = items.select("item_id").schema["item_id"].dataType.simpleString()
    out = None
    for i in range(n):
        # Bounded by block_bytes, or one item's terms.
        held = [(r.item_id, r.term) for r in terms.filter(block == i).orderBy("item_id", "term").collect()]
        if not held:
            continue
        names = list(dict.fromkeys(x for x, _ in held))
        own, every = {x: j for j, x in enumerate(names)}, sorted({t for _, t in held})
        at = {t: j for j, t in enumerate(every)}
        of_term: list[list[int]] = [[] for _ in every]
        for x, t in held:
            of_term[at[t]].append(own[x])
        automaton = spark.sparkContext.broadcast(guarded(every))
        documents, length, df = counts(docs, automaton, len(every))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = _scored(docs, automaton, of_term, weights, documents, length, len(names), most)
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        for by in (("item", "part"), ("item",)):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)
        known = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        one = found.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")  # at most items_at_once rows
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
