"""Repair of conversations: the cheapest edits that make the roles alternate, found from both ends of the edit lattice.

A node of the lattice is a place between two rows and what the roles so far allow: nothing yet, a system turn, a user's
turn, an assistant's turn.  Edits lead on: Keep, Rerole and Delete take a row, Insert adds a turn.  One heap goes forward
from the start and one backward from the allowed ends.  They stop once no path through what they left could be as cheap as
the best one met, so that every path of that cost crosses from what the first settled to what the second did, and of all
of these the one whose audit (the edits' initials) is least is walked.  A letter determines where an edit leads, so
two equally cheap audits of the same stretch never are one the beginning of the other, and audits of stretches may be
chosen on their own and put together.

That is how a conversation of any length is shared out: rows are sorted by range into partitions, which also cut a
conversation that many rows belong to.  Those that lie within a partition are settled there.  Of those at its two ends,
each piece is solved for all pairs of states, from rows without their texts; the pieces' results are put together in
order, and each piece then writes its own part of the repaired text.  Only a hash of the whole text, which the contract
asks for, is made in order, a piece at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, on_workers, table, written
from .exact import BLANKS

# States: nothing yet, after a system turn, after a user's turn, after an assistant's turn.
STATES = range(4)
#: What a conversation may end as: `(s?(ua)+)?`.
ENDS = (0, 3)
#: Where a turn with this role's initial leads from each state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The turn that may be added, or that a row may become, at each state, and where it leads.
NEEDED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


def _edits(row: str) -> list[list[tuple[str, int, int]]]:
    """By state, the edits (initial, cost, next state) that take a row, in order of their initials.

    A row is `-` if it must be deleted, else the initial of its role (`x` for any but s, u, a), upper case if truncated.
    """
    out = []
    for state in STATES:
        own = [("D", DELETE, state)]
        if row != "-":
            more = TRUNCATED if row.isupper() else 0
            if state in STEPS.get(row.lower(), {}):
                own.append(("K", more, STEPS[row.lower()][state]))
            own.append(("R", REROLE + more, NEEDED[state][1]))
        out.append(own)
    return out


_ROWS = {row: _edits(row) for row in "suaxSUAX-"}
_BACK = {row: [[(cost, s) for s in STATES for _, cost, t in edits[s] if t == state] for state in STATES] for row, edits in _ROWS.items()}
_INSERTED_FROM = [[s for s in STATES if NEEDED[s][1] == state] for state in STATES]


def cheapest(rows: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits of `rows` that lead from state `start` to one of `ends`; None if none do.

    Nodes are numbered 4 * place + state; both searches settle nodes in order of cost.
    """
    n = len(rows)
    one, two = {4 * 0 + start: 0}, {4 * n + s: 0 for s in ends}  # best known costs from the start, to the ends
    ahead, behind = [(0, u) for u in one], [(0, u) for u in two]
    settled_one, settled_two = set(one), set(two)
    best = min((one[u] + two[u] for u in settled_one & settled_two), default=None)
    fresh = [(u, True) for u in one] + [(u, False) for u in two]
    while True:
        for u, forward in fresh:
            place, state = divmod(u, 4)
            if forward:
                cost, mine, others, heap = one[u], one, two, ahead
                steps = [(cost + INSERT, 4 * place + NEEDED[state][1])]
                if place < n:
                    steps += [(cost + w, 4 * place + 4 + t) for _, w, t in _ROWS[rows[place]][state]]
            else:
                cost, mine, others, heap = two[u], two, one, behind
                steps = [(cost + INSERT, 4 * place + s) for s in _INSERTED_FROM[state]]
                if place:
                    steps += [(cost + w, 4 * place - 4 + s) for w, s in _BACK[rows[place - 1]][state]]
            for far, v in steps:
                if v not in mine or far < mine[v]:
                    mine[v] = far
                    heapq.heappush(heap, (far, v))
                if v in others and (best is None or far + others[v] < best):
                    best = far + others[v]
        while ahead and (ahead[0][1] in settled_one or ahead[0][0] > one[ahead[0][1]]):
            heapq.heappop(ahead)
        while behind and (behind[0][1] in settled_two or behind[0][0] > two[behind[0][1]]):
            heapq.heappop(behind)
        if not ahead or not behind or (best is not None and ahead[0][0] + behind[0][0] > best):
            break
        forward = (ahead[0][0], len(settled_one)) <= (behind[0][0], len(settled_two))
        u = heapq.heappop(ahead if forward else behind)[1]
        (settled_one if forward else settled_two).add(u)
        fresh = [(u, forward)]
    return None if best is None else (best, _least(rows, start, ends, best, one, two, settled_one, settled_two))


def _least(rows: str, start: int, ends: tuple[int, ...], best: int, one: dict[int, int], two: dict[int, int], settled_one: set[int], settled_two: set[int]) -> str:
    """The least audit among all paths that cost `best`; each of them crosses from one settled set to the other."""
    n = len(rows)

    def onward(u: int) -> list[tuple[str, int, int]]:
        place, state = divmod(u, 4)
        edits = [(letter, w, 4 * place + 4 + t) for letter, w, t in _ROWS[rows[place]][state]] if place < n else []
        return sorted([*edits, ("I", INSERT, 4 * place + NEEDED[state][1])])

    crossing = {u for u in settled_one if any(v in settled_two and one[u] + w + two[v] == best for _, w, v in onward(u))}
    useful, stack = set(crossing), list(crossing)
    while stack:
        u = stack.pop()
        place, state = divmod(u, 4)
        before = [(INSERT, 4 * place + s) for s in _INSERTED_FROM[state]]
        if place:
            before += [(w, 4 * place - 4 + s) for w, s in _BACK[rows[place - 1]][state]]
        for w, p in before:
            if p in settled_one and p not in useful and one[p] + w == one[u]:
                useful.add(p)
                stack.append(p)
    u, spent, audit = start, 0, []
    goals = {4 * n + s for s in ends}
    while spent < best or u not in goals:
        for letter, w, v in onward(u):
            if (v in useful and one[v] == spent + w) or (v in settled_two and two[v] == best - spent - w):
                break
        u, spent = v, spent + w
        audit.append(letter)
    return "".join(audit)


def edited(audit: str, roles: list[str], texts: list[str], state: int = 0) -> list[str]:
    """The `role:text` lines that an audit leaves of rows, from a state on."""
    out, place = [], 0
    for letter in audit:
        if letter == "I":
            role, state = NEEDED[state]
            out.append(f"{role}:")
            continue
        if letter == "K":
            out.append(f"{roles[place]}:{texts[place]}")
            state = STEPS[roles[place][0]][state]
        elif letter == "R":
            role, state = NEEDED[state]
            out.append(f"{role}:{texts[place]}")
        place += 1
    return out


def _symbol(role: str, fault: str) -> str:
    """How `cheapest` sees a row."""
    if fault in ("b", "d"):
        return "-"
    kind = role[:1] if role[:1] in STEPS else "x"
    return kind.upper() if fault == "t" else kind


def _breaks(initials: list[str]) -> int:
    return sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `gone` of the rows after damage, and of dropped ones too, which are `gone`.

    What happens to a row is decided by crc32 of `conv_id:turn`, modulo 20.  A null id or turn counts as one space there,
    a null role or text as one space everywhere.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20).alias("_k"))
    k = F.col("_k")
    text = F.when(k <= 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def _last(text: Column) -> Column:
    """The last character but white space, empty if there is none."""
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of `damaged` with `fault` (b blank, t truncated, else empty), sorted by conversation and turn over the partitions.

    Rows that are equal in conversation and turn come in order of a hash of role and text; where even that is equal, the
    rows are.  So a partition may end anywhere, even among equal rows.
    """
    last = _last(F.col("text"))
    fault = F.when(F.col("gone"), "").when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("")
    rows = rows.withColumn("fault", fault).withColumn("_h", F.xxhash64("role", "text")).withColumn("_i", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_h").asc(), F.col("_i").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_h", "_i")


_ROW = "seg int, pos long, turn long, role string, text string, fault string, gone boolean"
_DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: Results by sequence of rows that a worker remembers, and the length up to which it does.
MEMORY, SHORT = 1 << 16, 64


def _solver():
    """`cheapest` for whole conversations, with the results of short ones kept."""
    known: dict[str, tuple[int, str]] = {}

    def solve(rows: str) -> tuple[int, str]:
        if len(rows) > SHORT:
            return cheapest(rows)
        if rows not in known:
            if len(known) >= MEMORY:
                known.clear()
            known[rows] = cheapest(rows)
        return known[rows]

    return solve


def _settled(rows: list[tuple], solve) -> tuple:
    """The result of one whole conversation from its rows in order: (turn, role, text, fault, gone)."""
    rows = [r for r in rows if not r[4]]
    turns = {r[0] for r in rows if r[0] is not None}
    roles, texts, seen, faults = [r[1] for r in rows], [r[2] for r in rows], set(), []
    for _, role, text, fault, _ in rows:
        faults.append("d" if fault != "b" and (role, text) in seen else fault)
        seen.add((role, text))
    cost, audit = solve("".join(map(_symbol, roles, faults)))
    digest = hashlib.sha256("\n".join(edited(audit, roles, texts)).encode("utf-8", "replace")).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), _breaks([r[:1] for r in roles]), cost, audit, digest


def _columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


#: Rows and characters after which results go on.
FLUSH_ROWS, FLUSH_CHARS = 4096, 8 << 20


def _each_partition():
    """Results of the conversations within a partition (`whole`), and the rows of the first and the last one of it."""
    schema = pa.schema([("conv_id", pa.int64()), ("whole", pa.bool_()), *_arrow(_ROW), *_arrow(_DONE)])
    none_row, none_done = (None,) * 7, (None,) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, solve, out, size = TaskContext.get().partitionId(), _solver(), [], 0
        current, held, place, first, pos = None, [], 0, True, 0

        def edge(rows: list[tuple]) -> Iterator[tuple]:
            nonlocal pos
            for turn, role, text, fault, gone in rows:
                pos += 1
                yield (current, False, seg, pos, turn, role, text, fault, gone, *none_done)

        any_row = False
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "gone"))):
                if any_row and conv != current:
                    if first:
                        out.extend(edge(held))
                    else:
                        out.append((current, True, *none_row, *_settled(held, solve)))
                    held, first = [], False
                current, any_row = conv, True
                held.append(tuple(row))
                size += len(row[2])
                if first and len(held) >= FLUSH_ROWS or first and size > FLUSH_CHARS:
                    out.extend(edge(held))
                    held = []
                if len(out) >= FLUSH_ROWS or out and size > FLUSH_CHARS:
                    yield _columns(schema, out)
                    out, size = [], 0
        if any_row:
            out.extend(edge(held))
        if out:
            yield _columns(schema, out)

    return run


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return [(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]


_PIECE = "seg int, n int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _tables(rows: list[dict]) -> tuple:
    """What a piece of a conversation adds, and the cheapest edits of it between all states, as `start end cost audit` lines."""
    initials = [r["initial"] for r in rows]
    faults = [r["fault"] for r in rows]
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    line = "".join(map(_symbol, initials, faults))
    found = [(s, t, *got) for s in STATES for t in STATES if (got := cheapest(line, s, (t,)))]
    ends = (initials[0], initials[-1], turns[0] if turns else None, turns[-1] if turns else None, len(turns)) if rows else (None, None, None, None, 0)
    return len(rows), faults.count("b"), faults.count("d"), faults.count("t"), _breaks(initials), *ends, "\n".join(f"{s} {t} {cost} {audit}" for s, t, cost, audit in found)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _solved_pieces():
    schema = pa.schema([("conv_id", pa.int64()), *_arrow(_PIECE), ("table", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, seg), own in groupby(_rows(batches), lambda r: (r["conv_id"], r["seg"])):
            yield _columns(schema, [(conv, seg, *_tables([r for r in own if not r["gone"]]))])

    return run


def _put_together():
    """Of the pieces of each conversation in order: its result without the hash (seg -1), and each piece's state and audit."""
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("state", pa.int32()), *_arrow(_DONE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in groupby(_rows(batches), lambda r: r["conv_id"]):
            ways = {0: (0, "", None)}  # by state: cost, audit, and the pieces so far as a linked list of (seg, state, audit)
            sums, last, low, high, turns = [0, 0, 0, 0], None, None, None, 0
            for p in own:
                nxt: dict[int, tuple] = {}
                for line in p["table"].split("\n"):
                    s, t, cost, audit = line.split(" ")
                    s, t = int(s), int(t)
                    if s in ways:
                        way = (ways[s][0] + int(cost), ways[s][1] + audit, (ways[s][2], p["seg"], s, audit))
                        if t not in nxt or way[:2] < nxt[t][:2]:
                            nxt[t] = way
                ways = nxt
                sums = [a + p[c] for a, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"))]
                if p["n"]:
                    sums[3] += _breaks([last, p["first"]]) if last is not None else 0
                    last = p["last"]
                if p["turns"]:
                    turns += p["turns"] - (high == p["low"])
                    low, high = p["low"] if low is None else low, p["high"]
            cost, audit, chain = min((ways[s] for s in ENDS if s in ways), key=lambda way: way[:2])
            gaps = high - low + 1 - turns if low is not None else 0
            yield _columns(schema, [(conv, -1, None, gaps, *sums, cost, audit, None)])
            while chain:
                chain, seg, state, part = chain
                yield _columns(schema, [(conv, seg, state, *(None,) * 6, part, None)])

    return run


def _texts():
    """The repaired text of each piece, from its rows and its part of the audit."""
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("lines", pa.string())])

    def run(rows: pa.Table, parts: pa.Table) -> pa.Table:
        part = parts.to_pylist()[0]
        own = sorted((r for r in rows.to_pylist() if not r["gone"]), key=lambda r: r["pos"])
        lines = edited(part["audit"], [r["role"] for r in own], [r["text"] for r in own], part["state"])
        return pa.table([pa.array([x], f.type) for x, f in zip((part["conv_id"], part["seg"], "\n".join(lines) if lines else None), schema)], schema=schema)

    return run


def _hashes():
    """Results with the hash of the whole text, from one row of sums (seg -1) and one row a piece, in order."""
    schema = pa.schema([("conv_id", pa.int64()), *_arrow(_DONE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_rows(batches), lambda r: r["conv_id"]):
            sums, digest, any_line = next(own), hashlib.sha256(), False
            for piece in own:
                if piece["lines"] is not None:
                    digest.update((b"\n" if any_line else b"") + piece["lines"].encode("utf-8", "replace"))
                    any_line = True
            sums["repaired_sha256"] = digest.hexdigest()
            yield _columns(schema, [tuple(sums[f.name] for f in schema)])

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage.

    Conversations whose rows were all dropped have zeros, an empty audit and the hash of nothing; a null conv_id is one
    conversation; null turns come first and count for no gap; nulls in role and text are one space; rows of one turn come
    in order of a hash of role and text, so that copies are neighbours; an empty table gives no rows.  Conversations and
    texts may be of any length; further columns aren't read.  conv_id and turn are whole numbers.
    """
    on_workers(conversations.sparkSession)
    rows = damaged(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    got = written(in_order(rows).mapInArrow(frugal(_each_partition()), f"conv_id long, whole boolean, {_ROW}, {_DONE}"), "conversations")
    done = [x.split()[0] for x in _DONE.split(", ")]
    edge = got.where("not whole").select("conv_id", *(x.split()[0] for x in _ROW.split(", ")))
    # Which rows were seen before: of equal rows all but the first.  Places are unique, so no key of this join is hot.
    told = (F.col("fault") != "b") & ~F.col("gone")
    digest = F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256)
    first = edge.where(told).groupBy("conv_id", digest.alias("_d")).agg(F.min(F.struct("seg", "pos")).alias("_at")).select("_at.*", F.lit(True).alias("_first"))
    small = edge.select("conv_id", "seg", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "gone").join(first, ["seg", "pos"], "left")
    small = small.withColumn("fault", F.when(told & F.col("_first").isNull(), "d").otherwise(F.col("fault"))).drop("_first")
    pieces = small.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos").mapInArrow(frugal(_solved_pieces()), f"conv_id long, {_PIECE}, table string")
    whole = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(frugal(_put_together()), f"conv_id long, seg int, state int, {_DONE}")
    whole = written(whole, "put-together")
    # A null id has a number of its own among the pieces of its partition, as nulls come first.
    key = [F.coalesce("conv_id", F.lit(0)).alias("_c"), F.col("conv_id").isNull().alias("_z"), F.col("seg").alias("_s")]
    texts = edge.groupBy(*key).cogroup(whole.where("seg >= 0").groupBy(*key)).applyInArrow(_texts(), "conv_id long, seg int, lines string")
    sums = whole.where("seg < 0").select("conv_id", "seg", F.lit(None).cast("string").alias("lines"), *done)
    texts = texts.select("conv_id", "seg", "lines", *(F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in done))
    rest = sums.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(frugal(_hashes()), f"conv_id long, {_DONE}")
    return got.where("whole").select("conv_id", *done).unionByName(rest)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation of `conversations`; see `repair`."""
    return repair(table(spark, sf_dir, "conversations"))


def _least_of(*ways: str) -> str:
    """SQL of the best of some ways (structs of cost, audit, text)."""
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(of: str, cost: str, letter: str, line: str = "''", free: str = "true") -> str:
    """SQL of a way that one more edit makes of another, out of reach unless it is `free` to be taken."""
    return f"{{'c': case when {free} then {of}.c + {cost} else 1000000000 end, 'a': {of}.a || '{letter}', 't': {of}.t || {line}}}"


_OPEN, _LATE = "fault not in ('b', 'd')", "(fault = 't')::int"
_SAID = "chr(10) || {} || ':' || text"
_ADDED = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}
_KEPT = {k: f"{_OPEN} and role[1] = '{k}'" for k in "sua"}


def _kept(of: str, k: str) -> str:
    return _way(of, _LATE, "K", _SAID.format("role"), _KEPT[k])


def _rerolled(of: str, role: str) -> str:
    return _way(of, f"2 + {_LATE}", "R", _SAID.format(f"'{role}'"), _OPEN)


_TAKEN = {
    "s0": _way("s0", "3", "D"),
    "s1": _least_of(_way("s1", "3", "D"), _kept("s0", "s")),
    "s2": _least_of(_way("s2", "3", "D"), *(_rerolled(s, "user") for s in ("s0", "s1", "s3")), *(_kept(s, "u") for s in ("s0", "s1", "s3"))),
    "s3": _least_of(_way("s3", "3", "D"), _rerolled("s2", "assistant"), _kept("s2", "a")),
}
_FAR = "{'c': 1000000000, 'a': '', 't': ''}"

#: The contract in DuckDB's SQL: crc32 by its table, then the best way to each state, row by row.
OP11_SQL = rf"""
with recursive
crcs as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
keyed as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
fated as (select keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 fate from keyed, crcs),
hurt as (select conv_id, turn, case when fate = 4 then 'user' else r end as role, case when fate = 1 then '' when fate = 2 then regexp_replace(x, '[.!?]', '', 'g') else x end as text, copy
  from fated, (values (1), (2)) copies(copy) where fate <> 0 and (copy = 1 or fate = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) i from hurt),
faulty as materialized (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
  when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 't' else '' end fault,
  lag(role[1]) over (partition by conv_id order by i) || role[1] pair, lag(i) over (partition by conv_id order by i) before from placed),
ways as (
  select conv_id, 0::bigint i, {{'c': 0, 'a': '', 't': ''}} s0, {_FAR} s1, {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}} s2, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} s3 from (select distinct conv_id from faulty)
  union all
  select conv_id, i, s0, s1, s2, {_least_of("s3", _way("s2", "2", "I", _ADDED["a"]))} s3 from (
    select conv_id, i, s0, s1, s3, {_least_of("s2", *(_way(s, "2", "I", _ADDED["u"]) for s in ("s0", "s1", "s3")))} s2 from (
      select w.conv_id, f.i, {", ".join(f"{v} {k}" for k, v in _TAKEN.items())} from ways w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1))),
best as (select conv_id, {_least_of("s0", "s3")} b from (select *, row_number() over (partition by conv_id order by i desc) last from ways) where last = 1),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated,
  count(*) filter (before is not null and pair not in ('su', 'ua', 'au')) illegal from faulty group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
  coalesce(b.c, 0)::bigint as "cost", coalesce(b.a, '') audit, sha256(coalesce(b.t[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) c left join told on told.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id
"""
