"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation's rows are edited at the least cost so that their roles' initials read (s?(ua)+)?: Keep 0, Rerole to user or
assistant 1, Delete 2 (all that is allowed for blank and repeated rows), Insert an empty turn 5; a truncated row that isn't
deleted costs 5 more. Of the cheapest edits those whose initials are ASCII-least win. The automaton's states are START, S, U and A,
and the next role of a state is known, so the initials tell the repaired conversation.

Rows are dealt out by ranges of conversation and turn and cut into chunks of CHUNK_ROWS rows or CHUNK_BYTES, so a conversation
of any length lies in many tasks. Costs run backwards, a vector of four for each row. A chunk that isn't known to end its
conversation starts from a speculative vector; fix-up passes hand each chunk the vector at which its successor arrived and rerun
it until old and new vectors differ by a constant only, from where on nothing changes. Passes end when no chunk's vector
moves. The least edits are then traced forwards from all four states of a chunk, and passes of the same kind settle which state
each chunk is entered in. Chunks that are a whole conversation, nearly all, need none of this and don't move again.

The SHA-256 of a conversation is one pass through its rows, which goes by its chunks in order with bounded memory.

Rows of one turn are put in order by role, the first 64 characters of the text and the SHA-256 of both; a null role or text is
one blank. A null conv_id is a conversation of its own; null turns come first and count for no gap. Repeated rows are
duplicates. A conversation of which no row is left has zeros and empty strings. Texts of any length are read whole. Only the
four columns are read, so others can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.llm.common import checked_broadcast, staged

CHUNK_ROWS, CHUNK_BYTES = 256, 4 << 20
START, S, U, A = range(4)
#: The state after the role that a state asks for; START may also keep a system row.
_NEXT = (U, U, A, U)
#: Costs of ending in a state, by insertions.
ENDING = (0, 10, 5, 0)
_TAIL = ("", "II", "I", "")
RISE = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: A row's code: 1 + its initial's place in "sua" (0: another), 4 if it must go, 8 if it is truncated.
MUST_GO, CUT = 4, 8
_GAPS = frozenset(" \t\n\v\f\r")
_LEGAL = ("su", "ua", "au")
_MOST = (1 << 63) - 1


def _kept(code: int, q: int) -> int | None:
    """The state after the row as it is, if it may stand here."""
    k = code & 3
    return S if k == 1 and q == START else _NEXT[q] if k == (3 if q == U else 2) else None


def _steps() -> dict[int, list[list[tuple[str, int, int]]]]:
    """For each code and state: (edit, cost, state after the row), without insertions."""
    out = {}
    for code in range(16):
        rise = TRUNCATED if code & CUT else 0
        out[code] = []
        for q in range(4):
            own = [("D", RISE["D"], q)]
            if not code & MUST_GO:
                kept = _kept(code, q)
                own += [("K", rise, kept)] if kept is not None else []
                own += [("R", RISE["R"] + rise, _NEXT[q])]
            out[code].append(own)
    return out


STEPS = _steps()
#: With insertions, in the order of their initials.
EDITS = {code: [sorted([*own, ("I", RISE["I"], _NEXT[q])]) for q, own in enumerate(states)] for code, states in STEPS.items()}


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go in each state before a row, of those after it."""
    v = [min(c + after[to] for _, c, to in own) for own in STEPS[code]]
    u, a = min(v[U], RISE["I"] + v[A]), min(v[A], RISE["I"] + v[U])
    return min(v[START], RISE["I"] + u), min(v[S], RISE["I"] + u), u, a


def level(v: tuple[int, ...]) -> tuple[int, ...]:
    low = min(v)
    return tuple(x - low for x in v)


def arrived(codes: bytes, end: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a chunk, but for a constant."""
    for code in reversed(codes):
        end = before(code, end)
    return level(end)


def fixed_up(codes: bytes, was: tuple[int, ...], start: tuple[int, ...], now: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """start, to which `was` led, for another vector `now` after the chunk; and how many rows were run again."""
    for i, code in enumerate(reversed(codes)):
        if level(was) == level(now):
            return start, i
        was, now = before(code, was), before(code, now)
    return (start if level(was) == level(now) else level(now)), len(codes)


def traced(codes: bytes, end: tuple[int, ...], entries: tuple[int, ...], last: bool) -> list[tuple[str, int]]:
    """(edits, state after the chunk) from each of the entry states. last: the chunk ends its conversation."""
    costs = [end]
    for code in reversed(codes):
        costs.append(before(code, costs[-1]))
    costs.reverse()
    out = []
    for q in entries:
        edits = []
        for i, code in enumerate(codes):
            now, after = costs[i], costs[i + 1]
            while True:
                edit, to = next((e, to) for e, c, to in EDITS[code][q] if c + (now if e == "I" else after)[to] == now[q])
                edits.append(edit)
                q = to
                if edit != "I":
                    break
        out.append(("".join(edits) + (_TAIL[q] if last else ""), q))
    return out


def edited(audit: str, turns: list[dict], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of what the edits leave of the turns."""
    at = 0
    for e in audit:
        own = None
        if e != "I":
            own, at = turns[at], at + 1
        if e == "D":
            continue
        role = "assistant" if state == U else "user"
        state = S if e == "K" and own["role"].startswith("s") else _NEXT[state]
        yield (own["role"] if e == "K" else role), (own["text"] if own else ""), e


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: by crc32('conv_id:turn') % 20 a row is dropped (gone stays, for the conversation's sake), emptied, loses its stops, comes twice, or becomes the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 0, "").when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), F.explode(times)).drop("col")


_CHUNK = "codes binary, turns array<struct<role:string,text:string>>, blank long, duplicate long, truncated long, illegal long, least long, greatest long, turns_apart long, first_turn long, last_turn long, first_initial string, last_initial string, whole boolean, audit string"


class Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self) -> None:
        self.codes, self.turns, self.size = bytearray(), [], 0
        self.faults, self.illegal, self.apart = [0, 0, 0], 0, 0
        self.first = self.last = self.least = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        end = next((c for c in reversed(text) if c not in _GAPS), None)
        blank = end is None
        truncated = not blank and not repeated and end not in ".!?"
        for i, fault in enumerate((blank, not blank and repeated, truncated)):
            self.faults[i] += fault
        initial = role[:1]
        self.codes.append(("sua".find(initial) + 1 if initial else 0) | (MUST_GO if blank or repeated else 0) | (CUT if truncated else 0))
        if self.turns:
            self.illegal += self.last_initial + initial not in _LEGAL
        else:
            self.first, self.first_initial = turn, initial
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.apart += not self.turns or turn != self.last
        self.last, self.last_initial = turn, initial
        self.turns.append({"role": role, "text": text})
        self.size += len(role) + len(text)

    def row(self, whole: bool) -> tuple:
        audit = traced(bytes(self.codes), ENDING, (START,), True)[0][0] if whole else None
        return bytes(self.codes), self.turns, *self.faults, self.illegal, self.least, self.last if self.least is not None else None, self.apart, self.first, self.last, self.first_initial, self.last_initial, whole, audit


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) in order, a row for each chunk: conv_id, part, k (its place in the part) and _CHUNK. A whole conversation has its edits."""
    own = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.withColumn("digest", F.when(~F.col("gone"), own))
    at = lambda c: F.struct(F.col(c).isNotNull().alias("told"), F.col(c).alias("turn"))
    again = rows.filter("NOT gone").groupBy("conv_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(at("turn")).alias("first")).filter("n > 1")
    again = checked_broadcast(staged(again.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first"), "repeats"))
    told = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    told = told.select("conv_id", "turn", "role", "text", "gone", "digest", F.coalesce(at("turn") > F.col("first"), F.lit(False)).alias("later"), F.substring("text", 1, 64).alias("head"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "head", "digest")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, k, begun, first_conv = TaskContext.get().partitionId(), None, 0, False, True
        chunk, seen = Chunk(), None
        ready: list[tuple] = []
        size = 0

        def close(whole: bool) -> None:
            nonlocal chunk, k, size
            ready.append((conv, part, k, *chunk.row(whole)))
            size += chunk.size
            chunk, k = Chunk(), k + 1

        def sent() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), kinds, strict=True)], names)
            ready.clear()
            size = 0
            return batch

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(7)]
            for c, turn, role, text, gone, digest, later in zip(*columns, strict=True):
                if not begun or c != conv:
                    if begun:
                        close(k == 0 and not first_conv)
                        first_conv = False
                    conv, k, begun, seen = c, 0, True, None
                elif len(chunk.turns) >= chunk_rows or chunk.size >= chunk_bytes:
                    close(False)
                if not gone:
                    chunk.add(turn, role, text, later or digest == seen)
                    seen = digest
                if len(ready) >= 1000 or size >= chunk_bytes:
                    yield sent()
        if begun:
            close(False)  # it may go on in the next task
            yield sent()

    conv_kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv_kind), T.StructField("part", T.IntegerType()), T.StructField("k", T.IntegerType()), *T.StructType.fromDDL(_CHUNK).fields])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    # `seen` starts anew in each task: equal rows of a turn have equal keys, so they are in one range.
    return staged(told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "digest", "later").mapInArrow(cut, schema), "chunks")


def numbered(parts: DataFrame) -> DataFrame:
    """parts (conv_id, part, k, ...) with no, the chunk's place in its conversation, and total.

    A window over a conversation gets a row for each task that holds some of it, not its chunks."""
    held = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("m"))
    every = Window.partitionBy("conv_id")
    held = held.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.sum("m").over(every.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(every).alias("total"))
    joined = parts.join(held, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select(*parts.columns, (F.col("before") + F.col("k")).alias("no"), "total")


def _beside(df: DataFrame, step: int, column: Column, name: str) -> DataFrame:
    """df with a column of the chunk `step` places further on, null where there is none."""
    other = df.select(F.col("conv_id").alias("c"), (F.col("no") - step).alias("n"), column.alias(name))
    return df.join(other, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("no") == F.col("n")), "left").drop("c", "n")


def converged(parts: DataFrame) -> tuple[DataFrame, int]:
    """parts (conv_id, no, total, codes, ...) with `after`, the vector after each chunk but for a constant; and the number of fix-up passes."""
    kept = parts.columns
    schema = T.StructType([*parts.schema.fields, *T.StructType.fromDDL("after array<int>, start array<int>, moved boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            columns = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            out = []
            for i, codes in enumerate(columns["codes"]):
                if "told" not in columns:
                    end = ENDING
                    out.append((list(end), list(arrived(codes, end)), True))
                    continue
                was, start, now = (tuple(x[i]) if x[i] is not None else None for x in (columns["after"], columns["start"], columns["told"]))
                new = start if now is None or now == was else fixed_up(codes, was, start, now)[0]
                out.append((list(was if now is None else now), list(new), new != start))
            moved = zip(zip(*out, strict=True), (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()), strict=True)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *(pa.array(c, t) for c, t in moved)], schema.names)

    state = staged(parts.mapInArrow(run, schema), "speculated")
    passes = 0
    while passes == 0 or not state.filter("moved").isEmpty():
        state = staged(_beside(state, 1, F.col("start"), "told").select(*kept, "after", "start", "told").mapInArrow(run, schema), "fixed")
        passes += 1
    return state.select(*kept, "after"), passes


def entered(parts: DataFrame) -> DataFrame:
    """parts (conv_id, no, exits: the state after the chunk by the state before it, ...) with `entry`, the state that a chunk is entered in."""
    now = parts.withColumn("entry", F.when(F.col("no") == 0, START).otherwise(A))
    out = lambda: F.element_at("exits", F.col("entry") + 1)
    while True:
        was = staged(now, "entries")
        now = _beside(was, -1, out(), "told").withColumn("was", out()).withColumn("entry", F.coalesce("told", F.lit(START)))
        now = staged(now.withColumn("moved", out() != F.col("was")).select(*parts.columns, "entry", "moved"), "entries")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def searched(parts: DataFrame) -> DataFrame:
    """parts (conv_id, part, k, codes) of conversations in several chunks: no, entry and audit of each."""
    ready, _ = converged(staged(numbered(parts), "numbered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            found = [traced(r["codes"], tuple(r["after"]), (START, S, U, A), r["no"] == r["total"] - 1) for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("conv_id", "part", "k", "no")), pa.array([[e for e, _ in f] for f in found], pa.list_(pa.string())), pa.array([[q for _, q in f] for f in found], pa.list_(pa.int32()))], ["conv_id", "part", "k", "no", "audits", "exits"])

    schema = T.StructType([*(ready.schema[c] for c in ("conv_id", "part", "k", "no")), *T.StructType.fromDDL("audits array<string>, exits array<int>").fields])
    ways = staged(ready.mapInArrow(run, schema), "ways")
    entry = entered(ways.select("conv_id", "no", "exits")).select(F.col("conv_id").alias("c"), F.col("no").alias("n"), "entry")
    joined = ways.join(entry, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("no") == F.col("n")))
    return joined.select("conv_id", "part", "k", "no", "entry", F.element_at("audits", F.col("entry") + 1).alias("audit"))


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of all conversations with their edits: conv_id, no, entry, audit, turns and what is told of them. rows: as damaged() gives."""
    every = chunks(rows, chunk_rows, chunk_bytes)
    told = [c for c in every.columns if c not in ("part", "k", "codes", "whole", "audit")]
    whole = every.filter("whole").select(*told, "codes", F.lit(0).cast("long").alias("no"), F.lit(START).alias("entry"), "audit", "whole")
    parted = every.filter("NOT whole")
    found = staged(searched(parted.select("conv_id", "part", "k", "codes")), "audits")
    found = found.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("k").alias("own_k"), "no", "entry", F.col("audit").alias("found"))
    joined = parted.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("k") == F.col("own_k")))
    return whole.unionByName(joined.select(*told, "codes", "no", "entry", F.col("found").alias("audit"), "whole"))


def repaired_turns(chunks_: DataFrame) -> DataFrame:
    """conv_id, no, place, role, text, edit: the turns of the repaired conversations, in order of no and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = list(edited(r["audit"], r["turns"], r["entry"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r["conv_id"]] * len(out), b.schema.field("conv_id").type), pa.array([r["no"]] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), *(pa.array(c, pa.string()) for c in zip(*out, strict=True))], ["conv_id", "no", "place", "role", "text", "edit"])

    schema = T.StructType([chunks_.schema["conv_id"], *T.StructType.fromDDL("no long, place int, role string, text string, edit string").fields])
    return chunks_.select("conv_id", "no", "entry", "audit", "turns").mapInArrow(run, schema)


def reported(chunks_: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    counted = ("blank", "duplicate", "truncated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, done = False, None, []

        def close() -> None:
            apart = 0 if least is None else min(_MOST, greatest - least + 1 - turns)
            done.append((conv, apart, *total, illegal, cost, "".join(audit), digest.hexdigest()))

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], schema.names)
            done.clear()
            return batch

        for b in batches:
            for r in b.to_pylist():
                if not begun or r["conv_id"] != conv:
                    if begun:
                        close()
                    begun, conv = True, r["conv_id"]
                    least = greatest = last = initial = None
                    total, turns, illegal, cost, audit, digest, empty, any_row = [0, 0, 0], 0, 0, 0, [], hashlib.sha256(), True, False
                for i, c in enumerate(counted):
                    total[i] += r[c]
                if r["codes"]:
                    turns += r["turns_apart"] - (any_row and r["first_turn"] is not None and r["first_turn"] == last)
                    illegal += r["illegal"] + (any_row and initial + r["first_initial"] not in _LEGAL)
                    any_row, last, initial = True, r["last_turn"], r["last_initial"]
                    if r["least"] is not None:
                        least = r["least"] if least is None else least
                        greatest = r["greatest"]
                left = iter(r["codes"])
                for e in r["audit"]:
                    cost += RISE[e] + (TRUNCATED if e != "I" and next(left) & CUT and e != "D" else 0)
                audit.append(r["audit"])
                for role, text, _ in edited(r["audit"], r["turns"], r["entry"]):
                    digest.update(("" if empty else "\n").encode() + role.encode() + b":" + text.encode())
                    empty = False
                if len(done) >= 1000:
                    yield sent()
        if begun:
            close()
            yield sent()

    schema = T.StructType([chunks_.schema["conv_id"], *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    parted = chunks_.filter("NOT whole").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "no")
    return chunks_.filter("whole").mapInArrow(run, schema).unionByName(parted.mapInArrow(run, schema))
