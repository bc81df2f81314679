"""A stored index of pages by their search text: which pages hold a piece of three characters, two or one.

An index is a folder of Parquet tables, each cut by run, that is by one call of add():

    pages      ordinal, document_id, page_number, search_text
    postings   gram, block, n, ordinals: pages of a block of 2^15 that hold the gram, in order; cut by bucket, a hash of the gram
    retired    run, ordinal of pages that a later run replaces or removes
    runs       a row for each run that is complete

A run's row in `runs` is written last, and nothing is read of runs without one, so a run that dies half-way is as if it had
never been; the same run may be tried again, and once complete it changes nothing more. Ordinals are stored as Parquet's delta
code. Postings are made where pages lie: nothing is shuffled. A block bounds a row, however common a gram is.

A search reads only the buckets of its needles' grams. Of each needle the RAREST grams that the fewest pages have are
intersected block by block, the rarest first, and the pages that are left confirm by their text. Needles of one or two
characters are grams themselves. Pages without search text are never ruled out, as in a scan.

A null search text can't be searched and isn't indexed; of repeated rows of a page one is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.search import SMALL, needles

BUCKETS, BLOCK, RAREST = 32, 1 << 15, 3
#: Distinct grams of pages that are gathered before they are written: 12 bytes each.
GATHERED = 1 << 21
KEY = ["document_id", "page_number"]
_TABLES = {"pages": "ordinal long, document_id string, page_number int, search_text string, run string", "postings": "gram string, block long, n int, ordinals array<int>, run string, bucket int", "retired": "old_run string, ordinal long, run string", "runs": "complete boolean, run string"}


def bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def runs(spark: SparkSession, path: str) -> list[str]:
    """The complete runs; one for each call of add()."""
    return sorted(r.run for r in _read(spark, path, "runs").select("run").distinct().collect())


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(_TABLES[table]).parquet(f"{path}/{table}") if there else spark.createDataFrame([], _TABLES[table])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ordinal, search_text) -> rows of postings."""
    codes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    now, held = None, 0

    def sent() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not codes:
            return
        code, owner = np.concatenate(codes), np.concatenate(owners)
        order = np.lexsort((owner, code))
        code, owner = code[order], owner[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        # 21 bits a character, from the first on; none is 0, so a gram's length shows.
        texts = ["".join(chr(x - 1) for x in ((c >> 42), (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x) for c in code[starts].tolist()]
        ends = np.r_[starts, len(code)].astype(np.int32)
        n = np.diff(ends)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(np.full(len(texts), now)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(owner))], ["gram", "block", "n", "ordinals"])
        codes.clear()
        owners.clear()
        held = 0

    for b in batches:
        for ordinal, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if now != ordinal // BLOCK or held > GATHERED:
                yield from sent()
                now = ordinal // BLOCK
            # Longer texts than a million characters are taken in parts that overlap by two.
            parts = [text[i : i + (1 << 20) + 2] for i in range(0, max(1, len(text)), 1 << 20)]
            found = []
            for part in parts:
                c = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.int64) + 1
                found.append(np.unique(np.concatenate([c, (c[:-1] << 21) + c[1:], (c[:-2] << 42) + (c[1:-1] << 21) + c[2:]])))
            own = np.unique(np.concatenate(found)) if text else np.zeros(1, np.int64)
            codes.append(own)
            owners.append(np.full(len(own), ordinal % BLOCK, np.int32))
            held += len(own)
    yield from sent()


def _write(df: DataFrame, path: str, table: str, run: str, *cut: str) -> None:
    writer = df.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    (writer.partitionBy(*cut) if cut else writer).parquet(f"{path}/{table}/run={run}")


def _complete(spark: SparkSession, path: str, run: str) -> None:
    spark.range(1).select(F.lit(True).alias("complete")).coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run={run}")


def live(spark: SparkSession, path: str) -> DataFrame:
    """Pages of complete runs that no complete run has replaced or removed: run, ordinal, document_id, page_number, search_text."""
    done = runs(spark, path)
    gone = _read(spark, path, "retired").filter(F.col("run").isin(done)).select(F.col("old_run").alias("run"), "ordinal")
    return _read(spark, path, "pages").filter(F.col("run").isin(done)).join(gone, ["run", "ordinal"], "left_anti")


def add(pages: DataFrame, path: str, run: str) -> None:
    """Complete pages (document_id, page_number, status, search_text) come into the index; pages of the same key are replaced."""
    spark = pages.sparkSession
    if run in runs(spark, path):
        return
    own = pages.filter("status = 'COMPLETE' AND search_text IS NOT NULL").select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), "search_text")
    own = own.dropDuplicates(KEY) if own.groupBy(*KEY).count().filter("count > 1").limit(1).count() else own
    _write(own.select(F.monotonically_increasing_id().alias("ordinal"), *own.columns), path, "pages", run)
    mine = spark.read.schema("ordinal long, document_id string, page_number int, search_text string").parquet(f"{path}/pages/run={run}")
    # A task writes a file for each bucket; blocks follow the order of the pages, so nothing need meet.
    rows = mine.select("ordinal", "search_text").mapInArrow(_grams, "gram string, block long, n int, ordinals array<int>").withColumn("bucket", bucket(F.col("gram")))
    _write(rows, path, "postings", run, "bucket")
    _write(live(spark, path).join(mine.select(*KEY), KEY, "left_semi").select(F.col("run").alias("old_run"), "ordinal"), path, "retired", run)
    _complete(spark, path, run)


def remove(ids: DataFrame, path: str, run: str) -> None:
    """Pages of the documents in ids (document_id) leave the index."""
    spark = ids.sparkSession
    if run not in runs(spark, path):
        gone = live(spark, path).join(ids.select(F.col("document_id").cast("string").alias("document_id")).distinct(), "document_id", "left_semi")
        _write(gone.select(F.col("run").alias("old_run"), "ordinal"), path, "retired", run)
        _complete(spark, path, run)


def wanted_grams(wanted: DataFrame) -> DataFrame:
    """(needle, gram) of wanted (needle): its pieces of three characters; a shorter needle itself."""
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("needle") - 2)), lambda i: F.substring("needle", i, 3)))
    return wanted.select("needle", F.explode(pieces).alias("gram"))


def postings(spark: SparkSession, path: str, grams: DataFrame) -> DataFrame:
    """The postings of grams (gram) and of pages without text. Only their buckets, of BUCKETS, are read."""
    of = sorted({r.b for r in grams.select(bucket(F.col("gram")).alias("b")).union(spark.range(1).select(bucket(F.lit("")))).distinct().collect()})
    return _read(spark, path, "postings").filter(F.col("run").isin(runs(spark, path)) & F.col("bucket").isin(of))


def candidate_pages(spark: SparkSession, path: str, keywords: DataFrame, small: int = SMALL) -> DataFrame:
    """(document_id, page_number) of indexed pages that hold a keyword's needle or have no search text. Up to `small` grams are broadcast."""
    wanted = needles(keywords).select("needle").distinct()
    asked = wanted_grams(wanted)
    n = asked.count()
    near = lambda df: F.broadcast(df) if n <= small else df
    held = postings(spark, path, asked.select("gram"))
    often = held.join(near(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("often"))
    # A needle with a gram that no page has is found nowhere.
    ranked = asked.join(often, "gram", "left").groupBy("needle").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("g"))
    ranked = ranked.filter(F.col("g")[0]["often"] > 0).select("needle", F.slice("g", 1, RAREST).alias("g"))
    each = ranked.select("needle", F.size("g").alias("grams"), F.posexplode("g.gram").alias("place", "gram"))
    met = held.join(near(each), "gram").groupBy("needle", "grams", "run", "block", "place").agg(F.flatten(F.collect_list("ordinals")).alias("o"))
    both = met.groupBy("needle", "grams", "run", "block").agg(F.array_sort(F.collect_list(F.struct("place", "o"))).alias("x")).filter("size(x) = grams")
    left = F.aggregate(F.slice("x", 2, RAREST), F.col("x")[0]["o"], lambda a, y: F.array_intersect(a, y["o"]))
    place = (F.col("block") * BLOCK + F.col("o")).alias("ordinal")
    hits = both.select("needle", "run", "block", F.explode(left).alias("o")).select("needle", "run", place)
    silent = held.filter("gram = ''").select("run", "block", F.explode("ordinals").alias("o")).select(F.lit("").alias("needle"), "run", place)
    found = hits.unionByName(silent if wanted.limit(1).count() else silent.limit(0)).groupBy("run", "ordinal").agg(F.collect_list("needle").alias("needles"))
    return live(spark, path).join(found, ["run", "ordinal"]).filter(F.exists("needles", lambda x: F.contains("search_text", x))).select(*KEY)
