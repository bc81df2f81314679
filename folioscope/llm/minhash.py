"""Document fingerprints by one-permutation MinHash, on built-in functions only.

The 64-bit hashes of a text's shingles of `SHINGLE` words are dealt to 256 bins by their top byte in one pass; a bin keeps
its smallest. An empty bin takes the value of the first filled bin in a probe order of its own, (a * step + start) mod 257:
optimal densification, with a 2-universal probe order that visits all bins. Stored are the low 8 bits of each bin; a taken
value is hashed with its bin first, so that the bins of a text of few shingles don't all agree by one chance. Two
fingerprints agree by chance in a bin with probability 1/256; likeness() takes that out.

A text with fewer words has one shingle, its whole sequence; one without words has an empty fingerprint, which is like
another such one (1.0) and unlike all others (0.0). A null text is empty.

edited() pairs each document with the next by ascending doc_id, without one task that sees all: ids are cut into ranges of
about RANGE_ROWS rows, in two steps of approximate quantiles, and the rows of an id that has more than that by a hash of their
texts; each range is ordered by itself and closed with a copy of the next range's first document. Nulls come first; repeated
ids are ordered by text, those of an id with more than RANGE_ROWS rows by its hash first, and a single document is its own
next. Rows that repeat an id and its
text are one range, however many they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import WORD, checked_broadcast, staged

SHINGLE, BINS, BITS = 5, 256, 8
PRIME = 257
#: Filled bins up to which an empty bin ranks them all; beyond that it probes.
FEW = 40
#: Rows of a range of ids; ranges of the first step, and bounds of the second that are looked through at once.
RANGE_ROWS, LEVEL = 5000, 64
#: Bits that number the parts of one id.
PARTS = 20
EMPTY = (1 << 56) - 1


def _steps() -> list[tuple[int, int, int]]:
    """(step, start, inverse of step) of each bin's probe order, from a multiplicative generator."""
    out, x = [], 1
    for _ in range(BINS):
        x = x * 48271 % 2147483647
        step = x % 256 + 1
        x = x * 48271 % 2147483647
        out.append((step, x % PRIME, pow(step, -1, PRIME)))
    return out


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array of BINS low bytes (less 128) of the text's bins; an empty array without words."""
    kept = df.columns
    w, n, bins, filled = "__w", "__n", "__bins", "__filled"
    steps = _steps()
    step, start, inverse = (F.array(*(F.lit(s[i]) for s in steps)) for i in range(3))
    df = df.withColumn(w, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    df = df.withColumn(n, F.size(w))
    shingles = F.when(F.col(n) < SHINGLE, F.array(F.xxhash64(w))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(n) - (SHINGLE - 1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))
    # A last value of each bin makes every bin appear; it is the smallest only where the bin is empty.
    ends = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(EMPTY)))
    df = df.withColumn(bins, F.when(F.col(n) > 0, F.sort_array(F.concat(shingles, ends))))
    df = df.withColumn(bins, F.filter(bins, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(bins), i - 1), 56))))
    empty = lambda x: x.bitwiseAND(F.lit(EMPTY)) == EMPTY
    df = df.withColumn(filled, F.filter(F.transform(bins, lambda x, i: F.when(~empty(x), i)), lambda i: i.isNotNull()))
    m = F.size(filled)

    def ranked(j: Column) -> Column:
        rank = lambda b: F.pmod((b - F.get(F.col("__start"), j) + PRIME) * F.get(F.col("__inverse"), j), F.lit(PRIME))
        return F.get(F.col(bins), F.array_min(F.transform(filled, lambda b: rank(b) * 1024 + b)) % 1024)

    def probed(j: Column) -> Column:
        def one(found: Column, a: Column) -> Column:
            at = F.pmod(a * F.get(F.col("__step"), j) + F.get(F.col("__start"), j), F.lit(PRIME))
            x = F.get(F.col(bins), at)
            return F.coalesce(found, F.when(~empty(x), x))

        tries = F.least(F.lit(PRIME - 1), (F.lit(12 * BINS) / m).cast("int"))
        return F.coalesce(F.aggregate(F.sequence(F.lit(0), tries), F.lit(None).cast("long"), one), ranked(j))

    low = lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint")
    df = df.withColumns({"__step": step, "__start": start, "__inverse": inverse})
    dense = F.when(m == BINS, F.transform(bins, low)).when(m <= FEW, F.transform(bins, lambda x, j: low(F.when(empty(x), F.xxhash64(ranked(j), j)).otherwise(x)))).otherwise(F.transform(bins, lambda x, j: low(F.when(empty(x), F.xxhash64(probed(j), j)).otherwise(x))))
    return df.select(*kept, F.when(F.col(n) == 0, F.array().cast("array<tinyint>")).otherwise(dense).alias(out))


def packed(signature: Column) -> Column:
    """The fingerprint as hex digits, two a bin."""
    return F.array_join(F.transform(signature, lambda v: F.lower(F.lpad(F.hex(v + 128), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two signatures' shingle sets, without chance agreements."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    both = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(both == 2, F.lit(1.0)).when(both == 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _ranged(docs: DataFrame) -> DataFrame:
    """docs with __hash, of the texts of ids with many rows (else 0), and __range, the number of the row's range in order of
    __order and __hash.

    The first step's bounds, LEVEL at most, are literals; those of the second are an array for each of its ranges, all
    together one long for RANGE_ROWS rows.
    """
    order = F.col("__order")
    rows = docs.count()
    many = -(-rows // RANGE_ROWS)
    if many <= 1:
        return docs.withColumns({"__hash": F.lit(0).cast("long"), "__range": F.lit(0).cast("long")})
    coarse = sorted(set(docs.agg(F.percentile_approx("__order", [i / min(many, LEVEL) for i in range(1, min(many, LEVEL))] or [0.5], 20_000)).first()[0]))
    below = lambda bounds, x: F.size(F.filter(bounds, lambda b: b <= x))
    docs = docs.withColumn("__coarse", below(F.array(*map(F.lit, coarse)), order))
    # Ids with many rows, one for RANGE_ROWS rows at most; each is a range of its own first.
    heavy = docs.groupBy("__order", "__coarse").agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > RANGE_ROWS)
    heavy = staged(heavy.withColumn("__rows", F.ceil(F.col("__rows") / RANGE_ROWS)).withColumnRenamed("__rows", "__parts"), "heavy")
    each = max(1, -(-many // LEVEL))
    fine = docs.groupBy("__coarse").agg(F.percentile_approx("__order", [i / each for i in range(1, each)] or [0.5], 20_000).alias("b"))
    alone = heavy.select("__coarse", F.explode(F.array("__order", F.col("__order") + 1)).alias("b"))
    bounds = fine.select("__coarse", F.explode("b").alias("b")).union(alone).groupBy("__coarse").agg(F.sort_array(F.collect_set("b")).alias("__bounds"))
    bounds = bounds.withColumn("__firsts", F.filter("__bounds", lambda b, i: i % LEVEL == 0))
    docs = docs.join(F.broadcast(staged(bounds, "bounds")), "__coarse", "left")
    block = F.greatest(F.lit(0), below(F.col("__firsts"), order) - 1)
    inner = block * LEVEL + below(F.slice("__bounds", block * LEVEL + 1, F.lit(LEVEL)), order)
    docs = docs.join(checked_broadcast(heavy.drop("__coarse")), "__order", "left")
    docs = docs.withColumn("__hash", F.when(F.col("__parts").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    part = F.shiftrightunsigned("__hash", 64 - PARTS) * F.coalesce(F.col("__parts"), F.lit(1))
    number = (F.col("__coarse").cast("long") * (1 << 62 - 2 * PARTS) + inner) * (1 << PARTS) + F.shiftright(part, PARTS)
    return docs.withColumn("__range", number).drop("__coarse", "__bounds", "__firsts", "__parts")


def with_next(docs: DataFrame, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """prepare(docs) (doc_id, text, ...) with next_<c> of the next document for each carried column.

    prepare adds columns row by row; it sees each document once, and those that close a range once more. Columns of docs
    mustn't begin with "__".
    """
    kept = docs.columns
    docs = _ranged(docs.withColumn("__order", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))))
    # Hashes stand in order of their bits.
    first = F.struct("__order", F.shiftrightunsigned("__hash", 1).alias("__up"), F.col("__hash").alias("__h"))
    least = docs.groupBy("__range").agg(F.min(first).alias("__least"))
    # One row a range, without texts, in one task: two numbers for RANGE_ROWS documents.
    along = Window.orderBy("__range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = staged(least.withColumn("__before", F.coalesce(F.lag("__range").over(along), F.last("__range").over(whole))), "firsts")
    of = checked_broadcast(least.select(F.col("__range").alias("__of"), "__least", "__before"), 2_000_000)
    heads = docs.join(of, (F.col("__range") == F.col("__of")) & (F.col("__order") == F.col("__least.__order")) & (F.col("__hash") == F.col("__least.__h")))
    ends = heads.groupBy(F.col("__before").alias("__range")).agg(F.min("text").alias("text"))
    rows = prepare(docs.withColumn("__real", F.lit(1)).unionByName(ends.withColumn("__real", F.lit(0)), allowMissingColumns=True))
    inside = Window.partitionBy("__range").orderBy(F.col("__real").desc(), "__order", F.shiftrightunsigned("__hash", 1), "__hash", "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in carried})
    added = [c for c in rows.columns if c not in kept and not c.startswith("__")]
    return rows.filter(F.col("__real") == 1).select(*kept, *added)


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, signature, edited (text), edited_signature, next_signature."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(own, ["text", "signature"], lambda df: with_signature(df, "text", "signature"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))).drop("next_text")
    return with_signature(rows, "edited", "edited_signature")
