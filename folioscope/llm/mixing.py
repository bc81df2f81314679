"""Mixing sources to target weights.

Sizes are summed by source. A share of all sizes is dealt to the sources by weight; a target stops at `most` times its
source's size, and the excess is dealt again by weight until none is above: so every target is least(cap, level * weight)
with one level for all, found by prefix sums over the sources in order of cap / weight. A document of a source with the
repetition rate r = target / size is emitted floor(r) times, and once more if the hash of its doc_id and a seed, as a
number in [0, 1), is below r - floor(r). Reruns agree.

Nulls: a null text has size 0; null sources are one source, the last; a document without a doc_id draws by its text.
Repeated rows draw alike. Sources of size 0 have target 0. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import WORD, checked_broadcast, own_prefix, staged

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from sized (source, size). The windows run in one task, over one row of 60 bytes a source after
    partial sums: for some ten million sources at most."""
    total = F.sum("source_size").over(Window.partitionBy())
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rows = rows.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("all", share * total)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    # The level if all sources before this one are at their caps; it holds from the first source whose cap isn't reached.
    rows = rows.withColumn("level", (F.col("all") - before) / rest)
    open_ = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.first(open_, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(docs: DataFrame, size: Column | None = None, seed: str = SEED, prefix: str = "__", **how) -> DataFrame:
    """docs with <prefix>size, source_size, target and copies, the times that the mix takes the document."""
    p_size, p_source, p_total, p_target = (prefix + x for x in ("size", "source", "source_size", "target"))
    sized = docs.withColumn(p_size, words(F.col("text")) if size is None else size)
    of = targets(sized.select(F.col("source").cast("string").alias("source"), F.col(p_size).alias("size")), **how)
    of = of.select(F.col("source").alias(p_source), F.col("source_size").alias(p_total), F.col("target").alias(p_target))
    joined = sized.join(checked_broadcast(staged(of, "targets")), F.col("source").cast("string").eqNullSafe(F.col(p_source)), "left").drop(p_source)
    rate = F.when(F.col(p_total) > 0, F.col(p_target) / F.col(p_total)).otherwise(F.lit(0.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return joined.withColumn(prefix + "copies", (F.floor(rate) + (draw(key, seed) < rate - F.floor(rate)).cast("long")).cast("int"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix: docs, each row as many times as copies() says."""
    p = own_prefix(docs)
    return copies(docs, prefix=p, **how).withColumn(p + "copy", F.explode(F.array_repeat(F.lit(0), F.col(p + "copies")))).select(*docs.columns)
