"""Repair of conversation structure: the cheapest edits that give a dialogue an optional system turn and then user and assistant in turns.

Edits, over the rows of a conversation in turn order: Keep (0), Rerole to user or assistant (2), Delete (3; the only one for blank and duplicate rows),
Insert an empty user or assistant turn (2). A truncated row that stays adds 1. The audit is the string of the edits' initials; of the cheapest
ones it is the least in ASCII order.

The search is iterative-deepening A*: depth first, edits in ASCII order (D, I, K, R), under a bound on the cost that rises to the least one known
to be needed. The bound on what is left counts the deletions that are forced and the truncated rows. States that failed (row, place in the pattern) stay
in a table with what they are known to need, for all later bounds. The first path accepted under the least bound is the answer.

Rows are dealt by range of (conversation, turn, role, text), so a conversation of any length spreads over tasks; what a task holds whole is done
there. A conversation that crosses a task's edge, or has more than BLOCK rows, is searched in blocks: for each state before and after a
block the cheapest edits, by the same search, put together in order (costs add, audits are joined; of equal costs the least string stays the least,
since no cheapest path is a proper prefix of another between the same states). Tables of blocks are joined by conversation, 16 entries each.
Equal rows are one row with a count until they are edited, so copies of one row do not fill a range.

Defined results: a null role or text is one space; a null turn comes first and takes no part in gaps; rows of one turn are ordered by role and text; a null
conversation is a conversation like any other; one without rows after damage has zeros, an empty audit and the digest of the empty string; a role's initial is its
first character, and an empty role has none, so such a row is reroled or deleted; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.session import cut_lineage

BLOCK = 32
REMEMBERED = 100_000  # searches a worker keeps, by the kinds of the rows
OK, TRUNCATED, FORCED = 0, 1, 2
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1
# Places in the pattern (s?(ua)+)?: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_STEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
_NEXT = [USER, USER, ASSISTANT, USER]  # where an inserted or reroled turn leads
_NAME = {USER: "user", ASSISTANT: "assistant"}
_ENDS = (START, ASSISTANT)
_NEVER = 1 << 60
_GAP, _WORD, _STOP = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]", "[.!?]"


_EDGE_LEGAL = {"su", "ua", "au"}


# The search


@lru_cache(REMEMBERED)
def search(kinds: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from one place in the pattern to one of others; None where there are none. Two characters of `kinds` for
    each row: its role's initial (any other than s, u and a as '-') and its fault."""
    rows = [(kinds[i], int(kinds[i + 1])) for i in range(0, len(kinds), 2)]
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (0, UNFINISHED, DELETE)[rows[i][1]]
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def go(i: int, q: int, left: int) -> int:
        """The cost of the first path within `left`, which is put into `path` from its end; or else what is needed at least, more than `left`."""
        need = failed.get((i, q), least[i])
        if need > left:
            return need
        if i == n and q in ends:
            return 0
        need = _NEVER
        for edit, row, place, cost in _edits(rows, i, q):
            found = cost + go(row, place, left - cost)
            if found <= left:
                path.append(edit)
                return found
            need = min(need, found)
        failed[(i, q)] = need
        return need

    bound, most = least[0], DELETE * n + 3 * INSERT
    while bound <= most:
        need = go(0, start, bound)
        if need <= bound:
            return need, "".join(reversed(path))
        bound = need
    return None


def _edits(rows: list[tuple[str, int]], i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, next row, place after it, cost), in ASCII order."""
    if i == len(rows):
        yield "I", i, _NEXT[q], INSERT
        return
    role, fault = rows[i]
    yield "D", i + 1, q, DELETE
    yield "I", i, _NEXT[q], INSERT
    if fault != FORCED:
        late = UNFINISHED if fault == TRUNCATED else 0
        if role in _STEP[q]:
            yield "K", i + 1, _STEP[q][role], late
        yield "R", i + 1, _NEXT[q], REROLE + late


Table = dict[tuple[int, int], tuple[int, str]]


def block_table(kinds: str) -> Table:
    """The cheapest edits of a block between each two places that they can lead between."""
    n = len(kinds) // 2
    table: Table = {(q, q): (DELETE * n, "D" * n) for q in (START, SYSTEM)}
    for q in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            if to == SYSTEM and (q != START or not any(kinds[i] == "s" and kinds[i + 1] != str(FORCED) for i in range(0, len(kinds), 2))):
                continue  # only a kept system turn leads there
            found = search(kinds, q, (to,))
            if found is not None:
                table[q, to] = found
    return table


def joined(first: Table, then: Table) -> Table:
    """The edits of one stretch of rows and of the next: costs add, audits follow one another."""
    out: Table = {}
    for (a, m), (cost, audit) in first.items():
        for z in range(4):
            if (m, z) in then:
                more = cost + then[m, z][0], audit + then[m, z][1]
                if (a, z) not in out or more < out[a, z]:
                    out[a, z] = more
    return out


def blocks_table(kinds: str) -> Table:
    """The table of a stretch of any length, by halves, so that strings are not copied once for each block."""
    if len(kinds) <= 2 * BLOCK:
        return block_table(kinds)
    half = (len(kinds) // 2 // BLOCK + 1) // 2 * BLOCK * 2
    return joined(blocks_table(kinds[:half]), blocks_table(kinds[half:]))


def answer(kinds: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(kinds) <= 2 * BLOCK:
        return search(kinds, START, _ENDS)
    return _accepted(blocks_table(kinds))


def _accepted(table: Table) -> tuple[int, str]:
    return min(table[START, q] for q in _ENDS if (START, q) in table)


# Rows to results


class _Repair:
    """Applies an audit to rows as they come."""

    def __init__(self, conv: object, audit: str, want_rows: bool):
        self.conv, self.audit, self.at, self.place, self.out = conv, audit, 0, START, [] if want_rows else None
        self.digest, self.n = hashlib.sha256(), 0

    def _put(self, edit: str, role: str, text: str) -> None:
        if self.out is not None:
            self.out.append((self.conv, self.n, edit, role, text))
        if self.n:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode())
        self.n += 1

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.place = _NEXT[self.place]
            self._put("I", _NAME[self.place], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = _STEP[self.place][role[:1]]
            self._put("K", role, text)
        elif edit == "R":
            self.place = _NEXT[self.place]
            self._put("R", _NAME[self.place], text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


class _Stretch:
    """What is known of consecutive rows of one conversation, without their texts."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None
        self.kinds: list[str] = []

    def add(self, turn: int | None, role: str, copies: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in _EDGE_LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a row and its copy have one initial
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            if turn != self.high:
                self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        fault = FORCED if blank or duplicate else TRUNCATED if truncated else OK
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies if duplicate else copies - 1
        self.truncated += fault == TRUNCATED
        kind = initial if initial in ("s", "u", "a") else "-"
        self.kinds.append(f"{kind}{fault}" + f"{kind}{FORCED}" * (copies - 1))

    def numbers(self) -> list:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.low, self.high, self.first, self.last]

    @staticmethod
    def follow(a: list, b: list) -> list:
        """The numbers of one stretch and the next."""
        blank, duplicate, truncated, illegal, distinct = (x + y for x, y in zip(a[:5], b[:5]))
        if a[8] is not None and b[7] is not None and a[8] + b[7] not in _EDGE_LEGAL:
            illegal += 1
        if a[6] is not None and a[6] == b[5]:
            distinct -= 1
        return [blank, duplicate, truncated, illegal, distinct, b[5] if a[5] is None else a[5], a[6] if b[6] is None else b[6], b[7] if a[7] is None else a[7], a[8] if b[8] is None else b[8]]

    @staticmethod
    def counts(numbers: list) -> tuple[int, ...]:
        """gaps, blank, duplicate, truncated, illegal."""
        low, high = numbers[5:7]
        return 0 if low is None else high - low + 1 - numbers[4], *numbers[:4]


_PASS = "kind int, conv_id long, part int, seq int, numbers string, cost long, audit string, sha string, roles array<string>, texts array<string>, copies array<int>"
_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "conv_id long, place long, edit string, role string, text string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
WHOLE, PIECE, TEXTS = range(3)
_PACKED_ROWS, _PACKED_CHARS, _BATCH = 256, 1 << 20, 2_000


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[k]) for c, k in zip(zip(*held), kinds)], list(names))

    size = 0
    for r in rows:
        held.append(r)
        size += 1 + (sum(map(len, r[9])) if len(r) > 9 and r[9] else 0) // 10_000
        if size >= _BATCH:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _pieces(batches: Iterator[pa.RecordBatch], carry: bool) -> Iterator[tuple]:
    """Rows sorted by conversation and place in; out come the results of the conversations that lie within the task, and the tables and texts of
    the first and the last one, which may reach over its edges, and of long ones. With `carry` the texts of all come out."""
    part = TaskContext.get().partitionId()
    now, stretch, held, chars, at_edge, seq = None, None, [], 0, True, 0

    def texts() -> tuple:
        nonlocal held, chars, seq
        roles, bodies, copies = zip(*held)
        held, chars, seq = [], 0, seq + 1
        return TEXTS, now[0], part, seq, None, None, None, None, list(roles), list(bodies), list(copies)

    def piece() -> Iterator[tuple]:
        table = blocks_table("".join(stretch.kinds))
        yield PIECE, now[0], part, 0, json.dumps([stretch.numbers(), [[*k, *v] for k, v in table.items()]]), None, None, None, None, None, None
        if held:
            yield texts()

    def whole() -> tuple:
        cost, audit = answer("".join(stretch.kinds))
        r = _Repair(now[0], audit, False)
        for role, text, copies in held:
            for _ in range(copies):
                r.row(role, text)
        own = list(map(list, zip(*held))) if carry else [None] * 3
        return WHOLE, now[0], part, 0, json.dumps(stretch.numbers()), cost, audit, r.end(), *own

    large = False
    for b in batches:
        for conv, turn, role, text, copies, blank, duplicate, truncated in zip(*(b.column(i).to_pylist() for i in range(8))):
            if now is None or conv != now[0]:
                if now is not None:
                    if at_edge or large:
                        yield from piece()
                    else:
                        yield whole()
                    at_edge = False
                now, stretch, large, seq = (conv,), _Stretch(), False, 0
                held, chars = [], 0
            stretch.add(turn, role, copies, blank, duplicate, truncated)
            held.append((role, text, copies))
            chars += len(text)
            if len(held) >= _PACKED_ROWS or chars > _PACKED_CHARS:
                large = True  # its texts go out as they come
                yield texts()
    if now is not None:
        yield from piece()


def _finish(batches: Iterator[pa.RecordBatch], want_rows: bool) -> Iterator[tuple]:
    """Pieces and then texts of each conversation, in order: tables are joined, the answer is applied to the texts as they come."""
    now, numbers, table, repair, cost, audit = None, None, None, None, 0, ""

    def end() -> Iterator[tuple]:
        sha = repair.end()
        if want_rows:
            yield from repair.out
        else:
            yield (now[0], *_Stretch.counts(numbers), cost, audit, sha)

    for b in batches:
        for kind, conv, _, _, facts, _, _, _, roles, texts, copies in zip(*(b.column(i).to_pylist() for i in range(11))):
            if now is None or conv != now[0]:
                if now is not None:
                    yield from end()
                now, numbers, table, repair = (conv,), None, None, None
            if kind == PIECE:
                mine, entries = json.loads(facts)
                entries = {(a, z): (c, s) for a, z, c, s in entries}
                numbers = mine if numbers is None else _Stretch.follow(numbers, mine)
                table = entries if table is None else joined({k: v for k, v in table.items() if k[0] == START}, entries)
                continue
            if repair is None:
                cost, audit = _accepted(table)
                repair = _Repair(conv, audit, want_rows)
            for role, text, n in zip(roles, texts, copies):
                for _ in range(n):
                    repair.row(role, text)
            if want_rows:
                yield from repair.out
                repair.out = []
    if now is not None:
        yield from end()


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The repaired rows of whole conversations that carry their texts."""
    for b in batches:
        for conv, audit, roles, texts, copies in zip(*(b.column(i).to_pylist() for i in (1, 6, 8, 9, 10))):
            r = _Repair(conv, audit, True)
            for role, text, n in zip(roles, texts, copies):
                for _ in range(n):
                    r.row(role, text)
            r.end()
            yield from r.out


# Over a table


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies and the faults of the distinct rows of (conv_id, turn, role, text); of equal rows, those after the first are duplicates."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
    distinct = distinct.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    distinct = cut_lineage(distinct)
    first = distinct.groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min(F.struct("turn")).alias("_first"))
    seen = distinct.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")))
    blank = ~F.col("text").rlike(_WORD)
    duplicate = F.struct("turn") > F.col("_first")
    truncated = ~F.col("text").rlike(_STOP + _GAP + "*\\z")
    return seen.select("conv_id", "turn", "role", "text", "copies", blank.alias("blank"), (~blank & duplicate).alias("duplicate"), (~blank & ~duplicate & truncated).alias("truncated"))


def _passed(conversations: DataFrame, carry: bool = False) -> DataFrame:
    """Texts of a turn are dealt by their beginning, which has the order of the whole."""
    rows = faults(conversations)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64).asc()).sortWithinPartitions(*order, F.col("text").asc())
    return cut_lineage(dealt.mapInArrow(lambda b: _batches(_pieces(b, carry), _PASS), _PASS))


def _open(passed: DataFrame) -> DataFrame:
    return passed.where(F.col("kind") != WHOLE).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq")


def audit(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, also of those of `ids` that have no rows."""
    passed = _passed(conversations)
    numbers = F.from_json("numbers", "array<string>")
    low, high, seen = (numbers[i].cast("long") for i in (5, 6, 4))
    gaps = F.when(low.isNull(), F.lit(0).cast("long")).otherwise(high - low + 1 - seen)
    done = passed.where(F.col("kind") == WHOLE).select(
        "conv_id", gaps.alias("gaps"), *(numbers[i].cast("long").alias(c) for i, c in enumerate(("blank", "duplicate", "truncated", "illegal"))), "cost", "audit", F.col("sha").alias("repaired_sha256"))
    found = done.unionByName(_open(passed).mapInArrow(lambda b: _batches(_finish(b, False), _SUMMARY), _SUMMARY))
    if ids is None:
        return found
    found = cut_lineage(found)
    missing = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left_anti")
    zero = F.lit(0).cast("long")
    return found.unionByName(missing.select("conv_id", *(zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256")))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text of the repaired conversations; deleted rows are left out."""
    passed = _passed(conversations, True)
    whole = passed.where(F.col("kind") == WHOLE).mapInArrow(lambda b: _batches(_applied(b), _ROWS), _ROWS)
    return whole.unionByName(_open(passed).mapInArrow(lambda b: _batches(_finish(b, True), _ROWS), _ROWS))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the checksum of `conv_id:turn`: of twenty, 0 drops a row, 1 empties its text, 2 takes its stops, 3 repeats it,
    4 makes its role user. A null is one space."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(shown("text"), _STOP, "")).otherwise(shown("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(shown("role")).alias("role"),
                                text.alias("text"), F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_times"), fate.alias("_fate"))
    return rows.where("_fate <> 0").select("conv_id", "turn", "role", "text", F.explode("_times").alias("_time")).drop("_time")
