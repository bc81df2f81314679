"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits, one for each hash seed (or drawn word), are cut into blocks. If two documents differ in at most T bits and there
are B blocks with 3 B > T, some block differs in two bits at most. On each block the anchors are the codewords of a
Hamming code (covering radius 1, its last bit free). Two blocks at distance 2 or less have a point between them that is
one bit from each, and the anchor that covers this point lies within 1 + 1 bits of both: so each fingerprint is replicated
to every anchor within the covering radius plus half the block's threshold, taken from both sides, and each linked pair
meets at an anchor. This is the covering radius plus threshold of the one-sided form (home to replicas), with 17 copies for
a block of 32 bits in place of 170.

At an anchor all pairs are compared by popcount, but dense groups of near copies cost rows in proportion to their size: a
task sends a shortest spanning forest of its links and, where they are confirmed later, the links of members that have few. Where a
similarity is asked for, fingerprints are of sets of shingles, all words of those that meet are compared, and each
link that leaves is confirmed by the exact Jaccard similarity of both texts' sets. Such sets meet at bands of MinHash values and
not at anchors: with blocks of 16 bits a sixth of all pairs of strangers met, so comparisons grew with the square of the corpus. A link is only held back if both of its
documents have more than WIDE_LINKS; such documents are crowded. Pages of one template are: nearly all of their links are
false. Those whose candidates are still apart meet once more, family by family in pairs of blocks, and the sizes of all
intersections of two blocks' sets are one product of matrices; so no link between different texts is dropped unseen.

Components of the links are found on DataFrames; nodes are named by the smallest doc_id with the fingerprint, so a component's
smallest node is its id.

Nulls: a null text has no words and fingerprint zero; a null doc_id keeps its row, and never is a component's id unless all of
its documents have none (null). Repeated rows, ties: equal fingerprints are one node. Extra columns are left alone. Empty tables
give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import checked_broadcast, connected_components, own_prefix, staged, word_blocks

#: Shingle hashes whose bits are counted at once: 64 bytes each.
BITS_AT_ONCE = 1 << 16
#: Fingerprint words of a set of shingles: 512 bits tell 0.8 from 0.6.
WORDS = 8
#: Bands that a set is sent to, each of ROWS of its minima: at a similarity of 0.8 all pairs but one of 2800 have a band in common.
BANDS, ROWS = 20, 5
#: Bits that differ at most between sets of a similarity of 0.8: 78 on average, with a deviation of 8. Most for small sets: 83 for
#: 12 shingles, and 96 for 4 against 5, of which one in thirty is missed.
SET_BITS = 112
#: Shingles of a set whose bits are counted at once: 512 bytes each.
SET_AT_ONCE = 1 << 12
#: Members of an anchor up to which all offsets are compared at once.
SMALL = 32
#: Rows of the distance matrix that is held at a time, by the anchor's members.
MATRIX = 1 << 20
#: Links of a node up to which a task sends them all, and of the nearest that are confirmed first; of the others only what is still apart.
WIDE_LINKS = 6
#: Links that a task holds before it chooses among them; what is left out is crowded.
PENDING = 200_000
#: Added to the distance of a forest's link whose node a, or b, is crowded.
CROWDED_A, CROWDED_B = 1 << 12, 1 << 13
#: Documents, and shingles, of a block of a crowded family.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1 << 18
#: Shingles that two blocks share, by documents, whose presence is held at once: 4 bytes each.
SHARED_AT_ONCE = 1 << 22
#: First stand-in for a missing doc_id.
NAMELESS = 1 << 62
#: Rows of two longs that may be broadcast: 16 MB.
TWO_LONG_ROWS = 1_000_000


def shingle_hashes(text: bytes, k: int, seed: int) -> Iterator[list[int]]:
    """XXH64 of all runs of k words, joined by spaces, in blocks; of the whole sequence if there are fewer words."""
    for words in word_blocks(text, k - 1):
        if not words:
            continue
        joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        size = min(k, len(words))
        digest = xxhash.xxh64_intdigest
        yield [digest(joined[i:j], seed) for i, j in zip((ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def simhash(text: bytes | None, k: int, seed: int) -> int:
    """Bit i is 1 if bit i is set in over half of the shingle hashes; 0 for a text without words. A-Z are lower-cased."""
    if not text:
        return 0
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text.lower(), k, seed):
        every = np.array(hashes, "<u8")
        n += len(every)
        for i in range(0, len(every), BITS_AT_ONCE):
            part = np.unpackbits(every[i : i + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += part.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def mixed_bits(x: np.ndarray, i: int) -> np.ndarray:
    """The i-th of many unrelated 64-bit values of each hash: splitmix64 of it and of i."""
    x = x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_simhash(text: bytes | None, k: int, words: int) -> np.ndarray:
    """The set of shingles' fingerprint, in 64-bit words: a bit is 1 if it is set in over half of the values that are drawn from each hash; 0 for none."""
    return set_print(shingles(text or b"", k), words)


def set_print(every: np.ndarray, words: int) -> np.ndarray:
    """set_simhash of the hashes of a set."""
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(every), SET_AT_ONCE):
        part = every[i : i + SET_AT_ONCE]
        drawn = np.stack([mixed_bits(part, j) for j in range(words)], axis=1).astype("<u8", copy=False)
        bits = np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(every), bitorder="little").view("<u8")


@cache
def _probes() -> tuple[np.ndarray, np.ndarray]:
    """The first hash of each bin, and the bins in an order of each bin's own, from itself on."""
    n = BANDS * ROWS
    drawn = mixed_bits(np.arange(n * n, dtype=np.uint64), 0).reshape(n, n)
    np.fill_diagonal(drawn, 0)
    return np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n), np.argsort(drawn, axis=1, kind="stable")


def band_keys(every: np.ndarray) -> np.ndarray:
    """A key for each band of a set (hashes in order, each once): that of ROWS minima of one-permutation MinHash, an empty bin of which takes the first filled one's in an order of its own; none for an empty set."""
    if not len(every):
        return np.zeros(0, np.uint64)
    starts, order = _probes()
    at = np.searchsorted(every, starts)
    filled = at < np.r_[at[1:], len(every)]
    if not filled.all():
        at = at[order[np.arange(len(order)), np.argmax(filled[order], axis=1)]]
    minima = every[at].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed_bits(key ^ minima[:, i], i)
    return key


def fingerprints(docs: DataFrame, k: int, seeds: tuple[int, ...] | None, words: int = WORDS) -> DataFrame:
    """doc_id, named and f0, f1, ... (long): fingerprints of every document's whole text, one a seed; without seeds, that many words of its set of shingles, and the set's bands."""
    n = len(seeds) if seeds else words
    kind = "doc_id long, named boolean, " + ", ".join(f"f{i} long" for i in range(n)) + ("" if seeds else ", bands array<long>")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            own, bands = [], []
            for t in texts:
                if seeds:
                    own.append([simhash(t, k, s) for s in seeds])
                else:
                    every = shingles(t or b"", k)
                    own.append(set_print(every, words))
                    bands.append(band_keys(every).view(np.int64))
            prints = np.array(own, np.uint64).reshape(-1, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(prints[:, i]) for i in range(n)), *([] if seeds else [pa.array(bands, pa.list_(pa.int64()))])], ["doc_id", "named", *(f"f{i}" for i in range(n)), *([] if seeds else ["bands"])])

    return docs.select("doc_id", "named", "text").mapInArrow(of, kind)


def anchors_of(x: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index into x, anchor) for blocks x of `width` bits, width a power of two: all anchors within 2 bits.

    The lower width - 1 bits are a Hamming code's, bit p - 1 at position p; the top bit is free. Every point is at most one
    bit from a codeword, so the bit at the syndrome s leads to the nearest, and pairs p ^ q = s to those two bits away.
    """
    n = width - 1
    syndrome = np.zeros(len(x), np.uint64)
    for j in range(n.bit_length()):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, n + 1) if p >> j & 1))
        syndrome |= (np.bitwise_count(x & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    one, every = np.uint64(1), np.arange(len(x))
    off = syndrome > 0
    nearest = np.where(off, x ^ (one << np.where(off, syndrome - one, 0).astype(np.uint64)), x)
    found = [(every, nearest), (every, nearest ^ (one << np.uint64(n)))]
    for p in range(1, n + 1):
        q = np.uint64(p) ^ syndrome
        at = np.flatnonzero(off & (q > p))
        found.append((at, x[at] ^ (one << np.uint64(p - 1)) ^ (one << (q[at] - one))))
    return found


def replicas(nodes: DataFrame, n: int, blocks: int, anchored: int) -> DataFrame:
    """(anchor, node, f0, ...) for every anchor that a node is sent to by its first `anchored` fingerprints of n. blocks: of each; 64 / blocks is a power of two."""
    width = 64 // blocks

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 4096):
                node, *fs = (b.column(i).slice(start, 4096).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(n + 1))
                for i, f in enumerate(fs[:anchored]):
                    for j in range(blocks):
                        x = f >> np.uint64(width * j) & np.uint64((1 << width) - 1)
                        pairs = anchors_of(x, width)
                        at = np.concatenate([p[0] for p in pairs])
                        key = np.concatenate([p[1] for p in pairs]) | np.uint64((i * blocks + j) << width)
                        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (key, node[at], *(g[at] for g in fs))], ["anchor", "node", *(f"f{m}" for m in range(n))])

    return nodes.select("node", *(f"f{i}" for i in range(n))).mapInArrow(send, "anchor long, node long, " + ", ".join(f"f{i} long" for i in range(n)))


def _distances(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(a ^ b).astype(np.uint16) for a, b in zip(x, y, strict=True))


def _nearest(fs: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, bits: int, crowded: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of each row's WIDE_LINKS nearest columns within `bits`, besides itself; rows that have more are crowded."""
    step = max(1, MATRIX // max(1, len(columns)))
    wide = [f[columns] for f in fs]
    for i in range(0, len(rows), step):
        own = rows[i : i + step]
        d = _distances([f[own][:, None] for f in fs], [c[None, :] for c in wide])
        d[own[:, None] == columns[None, :]] = 1 << 15
        crowded.append(own[(d <= bits).sum(1) > WIDE_LINKS])
        best = np.argpartition(d, WIDE_LINKS - 1, axis=1)[:, :WIDE_LINKS] if len(columns) > WIDE_LINKS else np.broadcast_to(np.arange(len(columns)), d.shape)
        d = np.take_along_axis(d, best, 1)
        a, b = np.nonzero(d <= bits)
        if len(a):
            yield own[a], columns[best[a, b]]


def _near_within(fs: list[np.ndarray], bits: int, crowded: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a large anchor's members: the nearest of each.

    Breadth first by close links while a member still reaches many: dense groups leave quickly, and are crowded. What is left
    is compared with all members, and the first members of the dense groups with each other.
    """
    left, todo, idle, close, first = np.arange(len(fs[0])), [], 0, bits // 2, []
    of_group = 0
    while len(left) > SMALL and idle < 8:
        if not todo:
            todo, left, of_group = [left[0]], left[1:], 0
        x = todo.pop()
        if of_group < SMALL:
            first.append(x)
            of_group += 1
        near = _distances([f[x] for f in fs], [f[left] for f in fs]) <= close
        new = left[near]
        idle = 0 if 16 * len(new) >= len(left) else idle + 1
        if len(new):
            yield np.full(len(new), x), new
            todo.extend(new.tolist())
            left = left[~near]
    every = np.arange(len(fs[0]))
    crowded.append(np.setdiff1d(every, left))
    if len(left):
        yield from _nearest(fs, left, every, bits, crowded)
    if len(first) > 1:
        yield from _nearest(fs, np.array(first), np.array(first), bits, crowded)


def _links_within(fs: list[np.ndarray], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect the same members as all links of a large anchor do.

    Breadth first while a member still reaches many: dense groups leave quickly. What is left is compared as a matrix, in
    blocks of rows, and each row gives the first of its links to every part of the others.
    """
    left, todo, idle = np.arange(len(fs[0])), [], 0
    while len(left) > SMALL and idle < 8:
        if not todo:
            todo, left = [left[0]], left[1:]
        x = todo.pop()
        near = _distances([f[x] for f in fs], [f[left] for f in fs]) <= bits
        new = left[near]
        idle = 0 if 16 * len(new) >= len(left) else idle + 1
        if len(new):
            yield np.full(len(new), x), new
            todo.extend(new.tolist())
            left = left[~near]
    rows = np.concatenate([np.array(todo, np.int64), left])
    step = max(1, MATRIX // max(1, len(left)))
    columns = [f[left] for f in fs]
    for i in range(0, len(rows), step):
        own = rows[i : i + step]
        a, b = np.nonzero(_distances([f[own][:, None] for f in fs], [c[None, :] for c in columns]) <= bits)
        keep = own[a] != left[b]
        if keep.any():
            yield own[a[keep]], left[b[keep]]


class Forest:
    """Union-find that says whether a link joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def links(sent: DataFrame, n: int, bits: int, many: bool) -> DataFrame:
    """(a, b, d, tree): for each task, links that connect the nodes that met at its anchors (tree); many: besides, all links of nodes that have WIDE_LINKS at most, and in d of tree links whether a and b have links that were left out (CROWDED_A, CROWDED_B). Of a link that is left out both nodes are told. A link is one row of its task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        crowds: set[int] = set()
        kept, fewest = None, 0

        def take(a: list[np.ndarray], b: list[np.ndarray], d: list[np.ndarray]) -> None:
            for x, y, near in zip(*(np.concatenate(c).tolist() for c in (a, b, d)), strict=True) if a else ():
                met[max(x, y), min(x, y)] = near
            if len(met) > PENDING + 2 * fewest:
                choose()

        def choose() -> list[tuple[int, int, int, bool]]:
            """Of the links so far, in order of distance, those that join two trees (b < a, True) and, if many, those of nodes that aren't crowded (False)."""
            nonlocal fewest
            tree, chosen, times = Forest(), [], Counter(chain.from_iterable(met)) if many else {}
            full = crowds | {x for x, n in times.items() if n > WIDE_LINKS}
            for (x, y), d in sorted(met.items(), key=lambda m: (m[1], m[0])):
                if joins := tree.join(x, y):
                    chosen.append((x, y, d, True))
                elif many and x in full and y in full:
                    crowds.update((x, y))
                elif many:
                    chosen.append((x, y, d, joins))
            met.clear()
            met.update({(x, y): d for x, y, d, _ in chosen})
            fewest = len(met)
            return chosen

        def groups(key: np.ndarray, ids: np.ndarray, fs: list[np.ndarray]) -> None:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            found: tuple[list, list, list] = ([], [], [])
            for s in range(1, SMALL):
                times = np.where((sizes > s) & (sizes <= SMALL), sizes - s, 0)
                i = np.repeat(starts, times)
                if not len(i):
                    continue
                i = i + np.arange(len(i)) - np.repeat(np.r_[0, np.cumsum(times)[:-1]], times)
                d = _distances([f[i] for f in fs], [f[i + s] for f in fs])
                i, d = i[d <= bits], d[d <= bits]
                for part, x in zip(found, (ids[i], ids[i + s], d), strict=True):
                    part.append(x)
            take(*found)
            for g in np.flatnonzero(sizes > SMALL).tolist():
                own = slice(starts[g], starts[g] + sizes[g])
                part = [f[own] for f in fs]
                many_of: list[np.ndarray] = []
                for a, b in chain(_near_within(part, bits, many_of) if many else (), _links_within(part, bits)):
                    take([ids[own][a]], [ids[own][b]], [_distances([f[a] for f in part], [f[b] for f in part])])
                for at in many_of:
                    crowds.update(ids[own][at].tolist())

        for b in batches:
            if not len(b):
                continue
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n + 2)]
            now = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            kept = [x[cut:].copy() for x in now]
            if cut:
                groups(now[0][:cut], now[1][:cut], [x[:cut].view(np.uint64) for x in now[2:]])
        if kept is not None:
            groups(kept[0], kept[1], [x.view(np.uint64) for x in kept[2:]])
        # Crowded nodes have candidates, so each is in a link of the forest: no row more.
        out = [(x, y, d + CROWDED_A * (x in crowds) + CROWDED_B * (y in crowds) if tree else d, tree) for x, y, d, tree in choose()]
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 10_000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], ["a", "b", "d", "tree"])

    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long, d int, tree boolean").distinct()


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def best_links(found: DataFrame) -> DataFrame:
    """Of links(): each node's WIDE_LINKS nearest of all tasks. Those of a crowded node are links of forests: it has met others at several bands."""
    near = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("d").bitwiseAND(F.lit(CROWDED_A - 1)).alias("d")).distinct()
    both = near.union(near.select(F.col("b"), F.col("a"), "d"))
    return _pairs(both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("rank") <= WIDE_LINKS))


def shingles(text: bytes, k: int) -> np.ndarray:
    """The set of a text's shingles, by hash."""
    return np.unique(np.fromiter((h for hashes in shingle_hashes(text.lower(), k, 0) for h in hashes), np.uint64))


def confirmed(edges: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """The edges (a, b) whose documents' sets of shingles have at least this Jaccard similarity. docs: doc_id, text; of a doc_id's texts the first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, one = None, None
        for b in batches:
            good = []
            for i, (x, y, side) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                if (x, y) != pair:
                    pair, one = (x, y), None
                if side == 0 and one is None:
                    one = shingles(b.column(3)[i].as_py() or b"", k)
                elif side == 1 and one is not None:
                    other = shingles(b.column(3)[i].as_py() or b"", k)
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    if both >= least * (len(one) + len(other) - both):
                        good.append(pair)
                    one = None
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in good], pa.int64()) for j in (0, 1)], ["a", "b"])

    sides = edges.select("a", "b", F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("of")) for i, c in enumerate("ab")))).alias("s")).select("a", "b", "s.side", "s.of")
    met = docs.join(checked_broadcast(sides, TWO_LONG_ROWS // 2), F.col("doc_id") == F.col("of")).select("a", "b", "side", F.col("text").cast("binary").alias("text"))
    return met.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(compare, "a long, b long")


def components(docs: DataFrame, k: int = 5, bits: int = SET_BITS, seeds: tuple[int, ...] = (42, 43), blocks: int = 4, least: float | None = 0.8) -> DataFrame:
    """doc_id, f0, f1, ..., component_id for every row of docs (doc_id, text).

    Documents link if their sets of shingles have at least the Jaccard similarity `least`, which is confirmed for those that have
    a band in common and whose WORDS words differ in `bits` bits or fewer. Without `least` they link if their fingerprints of all `seeds`, which count
    repeats, differ in `bits` bits or fewer together. component_id is the smallest doc_id reachable.
    Fingerprints of seeds that differ in fewer than 3 bits a block always meet at an anchor, and others if they differ in two bits
    at most of some block.
    """
    if 64 % blocks or 64 // blocks & (64 // blocks - 1) or 64 // blocks > 32 or least is None and 3 * blocks * len(seeds) <= bits:
        raise ValueError("blocks must be 2, 4, 8, ..., and without `least` 3 * blocks * len(seeds) > bits")
    found = _components(_named(docs), k, bits, seeds, blocks, least)
    prints = (c for c in found.columns if c[0] == "f")
    return found.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), *prints, F.when(F.col("any_named"), F.col("component_id")).alias("component_id"))


def _stand_in() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(NAMELESS // 2 - 1)))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(_stand_in().alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), F.col("text").cast("string").alias("text"))


def crowded_links(found: DataFrame, roots: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame | None:
    """Links (a, b) of at least this similarity between crowded nodes of links() that are still apart (roots: node, root); None if there are none to look for.

    Candidates that were left out lie within one component of the candidates, a family. Its crowded nodes are dealt to blocks:
    nodes of one root that fill blocks of their own never meet each other, all others do, a pair of blocks in a task at a time.
    """
    tree, told = found.filter("tree"), lambda bit: F.col("d").bitwiseAND(F.lit(bit)) != 0
    crowds = tree.filter(told(CROWDED_A)).select(F.col("a").alias("node")).union(tree.filter(told(CROWDED_B)).select("b")).distinct()
    if crowds.isEmpty():
        return None
    # Forests connect what all candidates connect.
    families = staged(connected_components(_pairs(tree)), "families")
    near = lambda df: checked_broadcast(df, TWO_LONG_ROWS)
    of = crowds.join(near(families.select("node", F.col("root").alias("family"))), "node").join(near(roots), "node", "left").select("node", "family", F.coalesce("root", "node").alias("root"))
    of = staged(of, "crowds")
    apart = of.groupBy("family").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("family")
    of = of.join(near(staged(apart, "apart")), "family")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"", k) for t in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["node", "family", "root", "size", "hashes"])

    own = docs.join(near(of), F.col("doc_id") == F.col("node")).select("node", "family", "root", "text")
    own = own.mapInArrow(encode, "node long, family long, root long, size long, hashes binary")
    own = staged(own.groupBy("node", "family", "root").agg(F.min(F.struct("size", "hashes")).alias("s")).select("node", "family", "root", "s.*"), "sets")
    # Blocks of one root (own >= 0), or of several small ones (-1).
    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK_NODES, size / BLOCK_SHINGLES)).cast("long")
    by_root = own.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).withColumn("large", parts(F.col("n"), F.col("s")) > 1)
    small = by_root.filter("NOT large").groupBy("family").agg(parts(F.sum("n"), F.sum("s")).alias("small_parts"))
    dealt = by_root.join(small, "family", "left").select("family", "root", F.when(F.col("large"), parts(F.col("n"), F.col("s"))).alias("own_parts"), "small_parts")
    dealt = own.join(near(dealt), ["family", "root"])
    block = F.when(F.col("own_parts").isNull(), F.pmod(F.xxhash64("root"), F.col("small_parts"))).otherwise(F.pmod(F.xxhash64("node"), F.col("own_parts")))
    dealt = staged(dealt.select("node", "family", "root", "hashes", F.when(F.col("own_parts").isNotNull(), F.col("root")).alias("alone"), block.alias("block")), "blocks")
    held = staged(dealt.select("family", "alone", "block").distinct().withColumn("id", F.monotonically_increasing_id()), "held")
    x, y = (held.select("family", F.col("alone").alias(f"alone_{c}"), F.col("id").alias(c)) for c in "xy")
    pairs = x.join(y, "family").filter("x <= y AND NOT coalesce(alone_x = alone_y, false)").select("x", "y", F.xxhash64("x", "y").alias("pair"))
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("id"))
    dealt = dealt.join(near(held.withColumnsRenamed({"family": "f", "alone": "a", "block": "b"})), (F.col("family") == F.col("f")) & F.col("alone").eqNullSafe(F.col("a")) & (F.col("block") == F.col("b"))).select("id", "node", "root", "hashes")
    met = dealt.join(near(staged(sides, "pairs")), "id").select("x", "y", "id", "node", "root", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def linked() -> list[tuple[int, int]]:
            return block_links([r for r in rows if r[0] == now[0]], [r for r in rows if r[0] == now[1]] if now[0] != now[1] else None, least)

        for b in batches:
            out = []
            for pair, row in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), b.column(5), strict=True), strict=True):
                if pair != now:
                    out += linked() if rows else []
                    now, rows = pair, []
                rows.append((*row[:3], np.frombuffer(row[3].as_py(), "<u8")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = linked() if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return met.repartition("x", "y").sortWithinPartitions("x", "y", "id", "node").mapInArrow(compare, "a long, b long")


def block_links(rows: list[tuple], others: list[tuple] | None, least: float) -> list[tuple[int, int]]:
    """Links (node, node) between rows (block, node, root, set) and others, or within rows, that join all roots that links of at least this similarity join."""
    second = rows if others is None else others
    if not rows or not second:
        return []
    sets = [[r[3] for r in part] for part in (rows, second)]
    every = [np.concatenate(s) for s in sets]
    if others is None:
        hashes, times = np.unique(every[0], return_counts=True)
        shared = hashes[times > 1]
    else:
        shared = np.intersect1d(*(np.unique(e) for e in every))
    both = np.zeros((len(rows), len(second)), np.float32)  # exact up to 2^24
    wide = max(1, SHARED_AT_ONCE // max(len(rows), len(second)))
    for i in range(0, len(shared), wide):
        part = shared[i : i + wide]
        held = []
        for side, all_ in zip(sets, every, strict=True):
            at = np.searchsorted(part, all_)
            at[at == len(part)] = 0
            own = np.repeat(np.arange(len(side)), [len(s) for s in side])
            fits = part[at] == all_
            x = np.zeros((len(side), len(part)), np.float32)
            x[own[fits], at[fits]] = 1
            held.append(x)
        both += held[0] @ held[1].T
    size = [np.array([len(s) for s in side], np.float64) for side in sets]
    root = [np.array([r[2] for r in part]) for part in (rows, second)]
    good = (both >= least * (size[0][:, None] + size[1][None, :] - both)) & (root[0][:, None] != root[1][None, :])
    forest = Forest()
    return [(rows[i][1], second[j][1]) for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True) if forest.join(rows[i][2], second[j][2])]


def _components(own: DataFrame, k: int, bits: int, seeds: tuple[int, ...], blocks: int, least: float | None) -> DataFrame:
    """doc_id, named, f0, ..., component_id, any_named (a document of the component has a doc_id). own: as _named() gives."""
    n = len(seeds) if least is None else WORDS
    bands = [] if least is None else ["bands"]
    names = [f"f{i}" for i in range(n)]
    prints = staged(fingerprints(own, k, seeds if least is None else None), "fingerprints")
    # A node without any doc_id has a stand-in, which is not a component's id if another node has one.
    nodes = staged(prints.groupBy(*names).agg(F.min(F.struct(~F.col("named"), "doc_id", *bands)).alias("m")).select(*names, F.col("m.doc_id").alias("node"), (~F.col("m.col1")).alias("node_named"), *(f"m.{b}" for b in bands)), "nodes")
    # Of different texts under one doc_id each may be a node; they are one.
    sent = replicas(nodes, n, blocks, n) if least is None else nodes.select(F.explode("bands").alias("anchor"), "node", *names)
    found = links(sent, n, bits, least is not None)
    if least is None:
        roots = staged(connected_components(_pairs(found)), "roots")
    else:
        found = staged(found, "links")
        first = staged(best_links(found), "nearest")
        edges = staged(confirmed(first, own, k, least), "confirmed")
        roots = staged(connected_components(edges), "roots")
        # Links that weren't among the nearest, between documents that have not come together.
        of = checked_broadcast(roots, TWO_LONG_ROWS)
        rest = _pairs(found).join(first, ["a", "b"], "left_anti")
        for c in "ab":
            rest = rest.join(of.select(F.col("node").alias(c), F.col("root").alias("root_" + c)), c, "left")
        rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        again = staged(confirmed(staged(rest, "others"), own, k, least), "confirmed")
        edges = edges.union(again)
        roots = staged(connected_components(edges), "roots")
        late = crowded_links(found, roots, own, k, least)
        if late is not None:
            roots = staged(connected_components(edges.union(staged(late, "crowded"))), "roots")
    of_node = nodes.join(checked_broadcast(roots, TWO_LONG_ROWS), "node", "left").select(*names, "node", "node_named", F.coalesce("root", "node").alias("root"))
    ids = of_node.groupBy("root").agg(F.min(F.struct(~F.col("node_named"), F.col("node"))).alias("m"), F.max("node_named").alias("any_named"))
    odd = staged(ids.filter("m.node != root OR NOT any_named").select("root", F.col("m.node").alias("least"), "any_named"), "unnamed")  # few or none
    of_print = of_node.join(checked_broadcast(odd, TWO_LONG_ROWS), "root", "left").select(*names, F.coalesce("least", "root").alias("component_id"), F.coalesce("any_named", F.lit(True)).alias("any_named"))
    return prints.drop(*bands).join(checked_broadcast(staged(of_print, "components"), 2 * TWO_LONG_ROWS // (n + 1)), names)


def deduplicated(docs: DataFrame, k: int = 5, bits: int = SET_BITS, seeds: tuple[int, ...] = (42, 43), blocks: int = 4, least: float | None = 0.8) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, and of its repeated rows one.

    A row without a doc_id counts as one after all others, so it stays if no other document of its component has one. Texts don't move
    unless more documents go than may be broadcast; only rows that repeat a doc_id are put in order.
    """
    key, rank = (own_prefix(docs) + x for x in ("key", "rank"))
    own = docs.withColumn(key, _stand_in())
    found = staged(_components(_named(docs), k, bits, seeds, blocks, least).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id")), "components")
    gone = found.filter("component_id != doc_id OR n > 1").select(F.col("doc_id").alias(key))
    again = found.filter("component_id = doc_id AND n > 1").select(F.col("doc_id").alias(key))
    single = own.join(checked_broadcast(gone, TWO_LONG_ROWS), key, "left_anti")
    ranked = own.join(checked_broadcast(again, TWO_LONG_ROWS), key, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy("text")))
    return single.select(*docs.columns).union(ranked.filter(F.col(rank) == 1).select(*docs.columns))
