"""Conversation structure repair by shortest paths with a bucket queue.

A conversation's rows, in order, are a graph: its nodes are (place, state of the role pattern ``(s?(ua)+)?``), its arcs are edits with small
integer costs. Keep takes a row as it is, Rerole makes its role user or assistant, Delete leaves it out, Insert puts an
empty turn in. Dial's bucket queue gives every node's cost to the end; the audit is then walked from the start along
tight arcs, the ASCII-least initial first, so it is the least of all cheapest ones.

Rows are ordered by turn (nulls first), then role and text; the order is a range partitioning, so a conversation with a
third of all rows is spread over many tasks. It is cut into segments of at most 4,096 distinct rows:

1. equal rows of a turn become one with a count, and a row's first fault is a few column expressions and one join;
2. each segment gives its least costs from each state at its start to each at its end (4 x 4);
3. those of a conversation, last segment first, give each segment the costs from its end on;
4. each segment is walked from each state that it may be entered in; the exits, first segment first, tell which walk holds;
5. the rows of each segment are edited by its walk, one row at a time.

Only ``digest`` needs a conversation's rows one after another in one task, as SHA-256 can be computed in no other way; it streams them.

Defined results: null conv_id is a conversation of its own; a null role or text is one space; an empty role has no initial, so it is never kept
as it is; repeated rows are turns of their own, all but the first of equal ones duplicates; columns besides conv_id, turn, role and text are ignored.
A conversation without rows has no faults, costs nothing and stays empty. More than 2**63 - 1 gaps count as so many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import cut, remove, written

SEGMENT_BITS = 12
BLANKS = " \t\n\x0b\f\r"
FAR = 1 << 40

#: A row as one character: its role's initial (s, u, a, another) by its fault.
SOUND, TRUNCATED, BLANK, DUPLICATE = "suax", "SUAX", "1234", "5678"
#: Costs of edits; a truncated row that stays adds ``TRUNCATED_COST``.
REROLE, DELETE, INSERT, TRUNCATED_COST = 1, 2, 5, 5
#: The pattern's states: nothing yet, after s, after u, after a; what an inserted or reroled turn leads to, and from where a kept one may come.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What is to be paid behind the last row: a started turn is finished by inserted ones.
AT_END = [0, 2 * INSERT, INSERT, 0]


def _edits(symbol: str) -> list[tuple[str, int, int, int]]:
    """(initial, cost, state before, state after) of each edit of a row."""
    out = [("D", DELETE, s, s) for s in range(4)]
    if symbol in SOUND + TRUNCATED:
        more = TRUNCATED_COST * (symbol in TRUNCATED)
        out += [("K", more, s, to) for s, to in KEEPS[symbol.lower()].items()]
        out += [("R", REROLE + more, s, to) for s, to in NEXT.items()]
    return out


EDITS = {c: _edits(c) for c in SOUND + TRUNCATED + BLANK + DUPLICATE}
INTO = {c: [[(s, cost) for _, cost, s, to in edits if to == state] for state in range(4)] for c, edits in EDITS.items()}
INSERTS_INTO = [[s for s, to in NEXT.items() if to == state] for state in range(4)]
#: Arcs from a state, the ASCII-least initial first.
OUT = {c: [sorted((i, cost, to) for i, cost, s, to in edits if s == state) for state in range(4)] for c, edits in EDITS.items()}


def costs_to_end(codes: str, ends: list[int]) -> list[int]:
    """The least cost from each (place, state) to the end, where ``ends`` is what each state costs from there: Dial's queue over the arcs backwards."""
    n = len(codes)
    cost = [FAR] * (4 * n + 4)
    low = min(ends)
    if low >= FAR:
        return cost
    buckets: list[list[int]] = []

    def put(node: int, value: int) -> None:
        if value < cost[node]:
            cost[node] = value
            while len(buckets) <= value - low:
                buckets.append([])
            buckets[value - low].append(node)

    for state, value in enumerate(ends):
        if value < FAR:
            put(4 * n + state, value)
    at = 0
    while at < len(buckets):
        held = buckets[at]
        for node in held:  # grows while arcs of no cost are followed
            value = at + low
            if cost[node] != value:
                continue
            place, state = divmod(node, 4)
            if place:
                for before, price in INTO[codes[place - 1]][state]:
                    put(4 * (place - 1) + before, value + price)
            if place < n:
                for before in INSERTS_INTO[state]:
                    put(4 * place + before, value + INSERT)
        buckets[at] = []
        at += 1
    return cost


def crossing(codes: str) -> list[int]:
    """The 4 x 4 least costs from each state at the start to each at the end."""
    out = [FAR] * 16
    for leave in range(4):
        cost = costs_to_end(codes, [0 if s == leave else FAR for s in range(4)])
        for enter in range(4):
            out[4 * enter + leave] = cost[enter]
    return out


def walk(codes: str, cost: list[int], state: int, final: bool) -> tuple[str, int]:
    """(audit, state at the end): along tight arcs from ``state``, the least initial first."""
    audit, place, n = [], 0, len(codes)
    while place < n:
        here = cost[4 * place + state]
        pick = None
        for initial, price, to in OUT[codes[place]][state]:
            if here == price + cost[4 * place + 4 + to]:
                pick = initial, place + 1, to
                break
        if (pick is None or pick[0] > "I") and here == INSERT + cost[4 * place + NEXT[state]]:
            pick = "I", place, NEXT[state]
        audit.append(pick[0])
        _, place, state = pick
    while final and state in (SYSTEM, USER):
        audit.append("I")
        state = NEXT[state]
    return "".join(audit), state


_crossings: dict[str, list[int]] = {}
_walks: dict[tuple, tuple[list[str], list[int]]] = {}


def _known(table: dict, key, make, most: int = 20_000):
    """Conversations of one shape are worked out once; the table of shapes starts anew when it is full."""
    if key not in table:
        if len(table) >= most:
            table.clear()
        table[key] = make()
    return table[key]


def _walks_from_all(codes: str, ends: list[int], final: bool, starts: list[int]) -> tuple[list[str], list[int]]:
    cost = costs_to_end(codes, ends)
    each = [walk(codes, cost, s, final) if s in starts and cost[s] < FAR else ("", s) for s in range(4)]
    return [a for a, _ in each], [s for _, s in each]


def _initial(symbol: str) -> str:
    return SOUND[(SOUND + TRUNCATED + BLANK + DUPLICATE).index(symbol) % 4]


INITIAL = {c: _initial(c) for c in SOUND + TRUNCATED + BLANK + DUPLICATE}
#: Neighbours that are in order.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _illegal(codes: str) -> int:
    roles = [INITIAL[c] for c in codes]
    return sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False))


def _crossings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        made = [_known(_crossings, c, lambda c=c: crossing(c)) for c in codes]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("segment"), pa.array(made, pa.list_(pa.int64()))], names=["conv", "segment", "costs"])


def _ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment of a conversation, last first, the costs from its end on; the first one also has the whole cost."""
    for batch in batches:
        out: list[tuple] = []
        for conv, each in zip(batch.column("conv").to_pylist(), batch.column("each").to_pylist(), strict=True):
            ends, final = AT_END, True
            for i, s in enumerate(reversed(each)):
                starts = [min(s["costs"][4 * a + b] + ends[b] for b in range(4)) for a in range(4)]
                is_first = i == len(each) - 1
                out.append((conv, s["segment"], ends, final, is_first, starts[START] if is_first else 0))
                ends, final = [min(x, FAR) for x in starts], False
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["conv", "segment", "ends", "final", "is_first", "cost"])


def _walks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        made = []
        for r in rows:
            least = min(r["ends"])
            ends = [min(x - least, FAR) for x in r["ends"]]  # only differences matter for the way
            starts = [START] if r["is_first"] else [0, 1, 2, 3]
            made.append(_known(_walks, (r["codes"], tuple(ends), r["final"], r["is_first"]), lambda r=r, ends=ends, starts=starts: _walks_from_all(r["codes"], ends, r["final"], starts)))
        codes = [r["codes"] for r in rows]
        counts = [[sum(map(c.count, kind)) for c in codes] for kind in (BLANK, DUPLICATE, TRUNCATED)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv"), batch.column("segment"), batch.column("cost"), pa.array([a for a, _ in made], pa.list_(pa.string())), pa.array([e for _, e in made], pa.list_(pa.int32())),
                *(pa.array(c, pa.int64()) for c in counts), pa.array([_illegal(c) for c in codes], pa.int64()), pa.array([INITIAL[c[0]] for c in codes]), pa.array([INITIAL[c[-1]] for c in codes]),
            ],
            names=["conv", "segment", "cost", "audits", "exits", "blank", "duplicate", "truncated", "illegal", "head", "tail"],
        )


def _entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each segment is entered, and whether its first row does not fit behind the segment before."""
    for batch in batches:
        out: list[tuple] = []
        for conv, each in zip(batch.column("conv").to_pylist(), batch.column("each").to_pylist(), strict=True):
            state, tail = START, None
            for s in each:
                out.append((conv, s["segment"], state, int(tail is not None and (tail, s["head"]) not in LEGAL)))
                state, tail = s["exits"][state], s["tail"]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["conv", "segment", "enter", "joint"])


def _conv(column: str = "conv_id") -> Column:
    """A conversation's name without nulls."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv (the conv_id as text), turn, role, text, n: the rows as damaged by crc32 of ``conv_id:turn`` modulo 20, each with how often it stands there."""
    rows = conversations.select(_conv().alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    hit = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = rows.withColumn("hit", hit).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("n"))


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows of each turn, with ``codes``: a character for each time the row stands there."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    rows = rows.withColumns({"shown": F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)), "said": F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256), "when": when})
    again = rows.where("shown <> ''").groupBy("conv", "said").agg(F.min("when").alias("since"), F.max("when").alias("until")).where("since < until").drop("until")
    rows = rows.join(again, ["conv", "said"], "left")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    pick = lambda symbols: F.substring(F.lit(symbols), kind, F.lit(1))
    first = F.when(F.col("since") < F.col("when"), pick(DUPLICATE)).when(F.col("shown").isin(".", "!", "?"), pick(SOUND)).otherwise(pick(TRUNCATED))
    codes = F.when(F.col("shown") == "", F.repeat(pick(BLANK), F.col("n").cast("int"))).otherwise(F.concat(first, F.repeat(pick(DUPLICATE), (F.col("n") - 1).cast("int"))))
    return rows.select("conv", "turn", "role", "text", codes.alias("codes"))


class Repair:
    """A finished repair: ``rows`` (conv, segment, at, turn, role, text, codes) in order of ``at``, ``edits`` (conv, segment, enter, audit, counts)."""

    def __init__(self, rows: DataFrame, path: str, edits: DataFrame):
        self.rows, self.path, self.edits = rows, path, edits

    def report(self) -> DataFrame:
        """conv, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda s: s["audit"]), "")
        return self.edits.groupBy("conv").agg(*sums, audit.alias("audit"))

    def gaps(self) -> DataFrame:
        """conv, gaps: turns missing between the first and the last."""
        turns = self.rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
        return turns.groupBy("conv").agg(F.expr("cast(least(cast(max(turn) as decimal(20, 0)) - min(turn) + 1 - count(one), 9223372036854775807) as bigint)").alias("gaps"))

    def repaired(self) -> DataFrame:
        """conv, at, part, role, text: the repaired turns, in order of at and part."""
        heads = self.edits.select("conv", "segment", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit("").alias("codes"), "audit", "enter")
        rows = self.rows.select("conv", "segment", "at", "role", "text", "codes", F.lit("").alias("audit"), F.lit(0).alias("enter"))
        dealt = heads.unionByName(rows).repartition("conv", "segment").sortWithinPartitions("conv", "segment", "at")
        return dealt.mapInArrow(_edited, "conv string, at bigint, part bigint, role string, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each segment behind its audit. A row takes inserted turns up to its own edits; the last takes those at the end."""
    audit, place, state = "", 0, START
    last: tuple[str, int, int] | None = None

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["conv", "at", "part", "role", "text"])

    def rest() -> list[tuple]:
        nonlocal place, state
        out = []
        while last is not None and place < len(audit):
            state = NEXT[state]
            out.append((last[0], last[1], last[2] + len(out), ROLE[state], ""))
            place += 1
        return out

    for batch in batches:
        out: list[tuple] = []
        held = 0
        for conv, at, role, text, codes, own, enter in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "role", "text", "codes", "audit", "enter")), strict=True):
            if at < 0:
                out += rest()
                audit, place, state, last = own, 0, enter, None
                continue
            part = 0
            for symbol in codes:
                while audit[place] == "I":
                    state = NEXT[state]
                    out.append((conv, at, part, ROLE[state], ""))
                    place, part = place + 1, part + 1
                if audit[place] != "D":
                    state = KEEPS[INITIAL[symbol]][state] if audit[place] == "K" else NEXT[state]
                    out.append((conv, at, part, role if audit[place] == "K" else ROLE[state], text))
                    part, held = part + 1, held + len(text)
                place += 1
                if held > 1 << 22:
                    yield batch_of(out)
                    out, held = [], 0
            last = conv, at, part
        yield batch_of(out)
    yield batch_of(rest())


def repair(rows: DataFrame) -> Repair:
    """Repair conversations given as ``damage`` gives them (conv, turn, role, text, n)."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = _coded(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = placed.withColumn("segment", F.shiftright("at", SEGMENT_BITS))
    table, path = written(placed, "turns")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "codes"))), lambda s: s["codes"]), "")
    segments = cut(table.groupBy("conv", "segment").agg(joined.alias("codes")))
    each = lambda df, *columns: df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("segment", *columns))).alias("each"))
    ends = each(segments.mapInArrow(_crossings_of, "conv string, segment bigint, costs array<bigint>"), "costs")
    ends = ends.mapInArrow(_ends_of, "conv string, segment bigint, ends array<bigint>, final boolean, is_first boolean, cost bigint")
    walks = segments.join(ends, ["conv", "segment"]).mapInArrow(
        _walks_of, "conv string, segment bigint, cost bigint, audits array<string>, exits array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string"
    )
    walks = cut(walks)
    entries = each(walks, "exits", "head", "tail").mapInArrow(_entries_of, "conv string, segment bigint, enter int, joint bigint")
    edits = walks.join(entries, ["conv", "segment"])
    edits = edits.select("conv", "segment", "enter", F.element_at("audits", F.col("enter") + 1).alias("audit"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("joint")).alias("illegal"), "cost")
    return Repair(table, path, cut(edits))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns come in order: the hash of each conversation's ``role:text`` lines."""
    now, sha = None, None

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], names=["conv", "repaired_sha256"])

    for batch in batches:
        out: list[tuple] = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if conv != now:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield batch_of(out)
    if sha is not None:
        yield batch_of([(now, sha.hexdigest())])


def digest(conversations: DataFrame) -> DataFrame:
    """Each conv_id with the faults of its damaged rows, the cost and audit of the repair, and a hash of what it leaves."""
    done = repair(damage(conversations))
    turns = done.repaired().repartition("conv").sortWithinPartitions("conv", "at", "part")
    hashes = turns.mapInArrow(_hashed, "conv string, repaired_sha256 string")
    out = conversations.groupBy("conv_id").agg(F.lit(1).alias("_one")).select("conv_id", _conv().alias("conv"))
    for part in (done.gaps(), done.report(), hashes):
        out = out.join(part, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    made, _ = written(out, "repairs")
    remove(conversations.sparkSession, done.path)
    return made
