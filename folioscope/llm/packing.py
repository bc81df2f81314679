"""Conflict-constrained best-fit packing of documents into bins of a token budget.

Bins are kept in order of what is left in them, each with a bitmap of the sources that have reached their quota and one of
the duplicate clusters it holds. A document goes to the first bin from its own size upwards that has neither bit: the search
goes on, from successor to successor, until that tightest compatible bin is found; else it opens a bin. Documents come
largest first, and equal ones of a cluster in a row, so that a row continues its search where the last one ended.

Bins are packed in shards of about SHARD_ROWS documents, dealt by a hash of the document and its copy number: repeated rows
are counted first and then dealt out as copies, so neither they nor a hot source or cluster meet in one task. Only
identifiers and sizes are shuffled. A text longer than a bin is cut into full bins and a rest.

Nulls: a null cluster conflicts with nothing, a null source is a source, a null doc_id packs like others. Documents of size
0 take no space but obey the conflicts. Ties are broken by source, cluster, doc_id, copy. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD, staged
from folioscope.llm.mixing import words

CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 4, 8192
PLACED = "doc_id long, copy long, piece long, source string, cluster long, size long, bin string, at long, fill long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), cluster: documents with the same words, but for the case of letters, are one cluster."""
    lower = F.lower(F.col("text").cast("string"))
    every = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), F.when(F.size(every) > 0, F.xxhash64(every)).alias("cluster"))


def best_fit(items: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each item (size, source, cluster), which come largest first, equal ones in a row."""
    counted: dict = {}
    for _, _, cluster in items:
        if cluster is not None:
            counted[cluster] = counted.get(cluster, 0) + 1
    # Only clusters of several items and the sources get a bit.
    bit_of = {c: 1 << i for i, c in enumerate(c for c, n in counted.items() if n > 1)}
    source_bit: dict = {}
    order: list[tuple[int, int]] = []
    left: list[int] = []
    full: list[int] = []
    clusters: list[int] = []
    per: list[dict] = []
    out, last, start = [], None, (0, 0)
    for item in items:
        size, source, cluster = item
        bit, own = bit_of.get(cluster, 0), source_bit.setdefault(source, 1 << len(source_bit))
        # What the same item passed over stays unfit: its bins only got fuller of this source or cluster.
        i = bisect_left(order, start if item == last and bit else (size, -1))
        while i < len(order) and (full[order[i][1]] & own or clusters[order[i][1]] & bit):
            i += 1
        if i < len(order):
            start = order[i]
            b = order.pop(i)[1]
        else:
            b, start = len(left), (capacity + 1, 0)
            left.append(capacity)
            full.append(0)
            clusters.append(0)
            per.append({})
        out.append((b, capacity - left[b]))
        left[b] -= size
        clusters[b] |= bit
        n = per[b][source] = per[b].get(source, 0) + 1
        if n >= per_source:
            full[b] |= own
        insort(order, (left[b], b))
        last = item
    return out


def packed(sizes: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece of each copy: PLACED. sizes: doc_id, source, size, cluster, from which other columns go."""
    rows = sizes.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = staged(rows.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("long")), "sizes")
    many = rows.agg(F.sum(F.col("n") * F.col("pieces"))).first()[0] or 0
    shards = max(1, -(-many // shard_rows))
    rows = rows.select("doc_id", "source", "size", "cluster", "pieces", F.explode(F.expr("sequence(0, n - 1)")).alias("copy"))
    rows = rows.select("doc_id", "source", "cluster", "copy", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), F.col("size").alias("whole"))
    rows = rows.withColumn("size", F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("long")).drop("whole")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "copy", "piece"), F.lit(shards)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        def plain(column: str) -> list:
            return [None if pd.isna(x) else x for x in pdf[column].tolist()]

        columns = {c: plain(c) for c in ("doc_id", "copy", "piece", "source", "cluster", "size")}
        none_last = lambda x: (x is None, 0 if x is None else x)
        at = sorted(range(len(pdf)), key=lambda i: (-columns["size"][i], (columns["source"][i] is None, columns["source"][i] or ""), none_last(columns["cluster"][i]), none_last(columns["doc_id"][i]), columns["copy"][i], columns["piece"][i]))
        found = best_fit([(columns["size"][i], columns["source"][i], columns["cluster"][i]) for i in at], capacity, per_source)
        fill: dict[int, int] = {}
        for (b, _), i in zip(found, at, strict=True):
            fill[b] = fill.get(b, 0) + columns["size"][i]
        shard = pdf["shard"].iloc[0]
        out = pd.DataFrame({c: [v[i] for i in at] for c, v in columns.items()})
        for c in ("doc_id", "cluster"):
            out[c] = out[c].astype("object").where(out[c].notna(), None).astype("Int64")
        return out.assign(bin=[f"{shard}-{b}" for b, _ in found], at=[a for _, a in found], fill=[fill[b] for b, _ in found])

    # Nullable longs would arrive as doubles, which hold no 64-bit hash: they travel as text.
    safe = rows.withColumns({"doc_id": F.col("doc_id").cast("string"), "cluster": F.col("cluster").cast("string")})

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        return place(pdf.assign(doc_id=[None if x is None else int(x) for x in pdf["doc_id"]], cluster=[None if x is None else int(x) for x in pdf["cluster"]]).astype({"doc_id": "object", "cluster": "object"}))

    return safe.groupBy("shard").applyInPandas(exact, PLACED)
