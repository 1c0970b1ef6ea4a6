"""Conversation structure repair: a Viterbi search whose survivors coalesce.

A repaired conversation has the roles ``s?(ua)+`` or no turn. Four states (nothing yet, after s, after u,
after a) and per row the edits Keep, Rerole, Delete, with Inserts before it, make a trellis; the
cheapest way to each state survives. Survivors share a backpointer tree with reference counts: a branch
that no survivor needs is freed, and as soon as all survivors descend from one node the edits up to it
are final and leave the task. What stays in memory is eight bytes for each row since that node.

Equal costs are decided by the whole unresolved suffixes of the audit strings. A survivor's string ends
with the edit of the last row, so no survivor's string is the beginning of another's, and their order
never changes when both grow: the order is carried as a rank, and comparing complete suffixes costs one
step. A survivor goes early when another one is sure to be at least as good: ``lead`` bounds, by a
fixpoint over all continuations, what one state can save over another.

Rows travel sorted by conversation; texts pass through and are never held. The edits, which leave later
than their rows, are joined to them by place.

Defined results: a null role or text is one space; a role without initial fits nowhere; rows are taken
by turn (null first), rows of one turn by role and text; a row is a duplicate if an earlier row has its
role and text, copies in one place included; null conv_ids are one conversation; very long texts are
hashed as they pass; a conversation of any length is one stream; ``gaps`` above the long range is its largest value;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stage

# fixed values: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# fixed values: white space and sentence ends
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
NAMES = {"u": "user", "a": "assistant"}
START, S, U, A = range(4)
STATES = (START, S, U, A)
#: records of an output batch
OUT_ROWS = 4096


def after(state: int, initial: str) -> int | None:
    """The state after a turn of that initial, None if it does not fit."""
    if initial == "s":
        return S if state == START else None
    if initial == "u":
        return None if state == U else U
    return A if initial == "a" and state == U else None


def inserts(state: int) -> list[tuple[str, int]]:
    """(initials inserted, state): none, one or two inserted turns that end in another state."""
    out, seen = [("", state)], {state}
    for text, at in out:
        for x in "ua":
            to = after(at, x)
            if to is not None and to not in seen:
                seen.add(to)
                out.append((text + x, to))
    return out


class Move(NamedTuple):
    frm: int
    to: int
    cost: int
    letters: str  # the audit's letters
    inserted: str  # initials inserted before the row
    role: str  # initial the row gets, "" if it keeps its own or goes


def row_moves(initial: str, truncated: bool, goes: bool) -> list[Move]:
    """The best way from each state to each other over one row."""
    best: dict[tuple[int, int], Move] = {}
    for m in STATES:
        for ins, at in inserts(m):
            ways = [(at, DELETE, "D", "")]
            if not goes:
                for x in "ua":
                    ways.append((after(at, x), REROLE + truncated * TRUNCATED, "R", x))
                ways.append((after(at, initial), truncated * TRUNCATED, "K", ""))
            for to, cost, letter, role in ways:
                if to is not None:
                    new = Move(m, to, cost + INSERT * len(ins), "I" * len(ins) + letter, ins, role)
                    old = best.get((m, to))
                    if old is None or (new.cost, new.letters) < (old.cost, old.letters):
                        best[m, to] = new
    return list(best.values())


#: kinds of rows: (initial, truncated), and the rows that have to go
KINDS = {(i, t): row_moves(i, t, False) for i in ("s", "u", "a", "") for t in (False, True)} | {"goes": row_moves("", False, True)}
MOVES: list[Move] = sorted({m for ms in KINDS.values() for m in ms})
#: per kind and target state: (number of the move, from, cost, letters)
INTO = {k: [[(MOVES.index(m), m.frm, m.cost, m.letters) for m in ms if m.to == j] for j in STATES] for k, ms in KINDS.items()}
#: what is inserted at the end
LAST = {m: next(ins for ins, at in inserts(m) if at in (START, A)) for m in STATES}


def lead() -> list[list[int]]:
    """lead[x][y]: the most that the best continuation from x can cost above that from y."""
    end = [[INSERT * (len(LAST[x]) - len(LAST[y])) for y in STATES] for x in STATES]
    now = end
    while True:
        new = [[max([end[x][y]] + [min(mx.cost + now[mx.to][my.to] for mx in ms if mx.frm == x) - my.cost
                                   for ms in KINDS.values() for my in ms if my.frm == y]) for y in STATES] for x in STATES]
        if new == now:
            return now
        now = new


LEAD = lead()


class Survivors:
    """The trellis of one conversation. Levels are rows; ``codes`` holds the move into each of the four
    states of a level, ``refs`` how many nodes of the next level (or the survivor itself) need it."""

    def __init__(self):
        self.cost, self.rank = {START: 0}, {START: 0}
        self.codes, self.refs = bytearray(4), bytearray([1, 0, 0, 0])
        self.first = 0  # levels of the arrays already emitted
        self.root = START

    def _free(self, level: int, state: int) -> None:
        refs, codes = self.refs, self.codes
        while True:
            at = 4 * level + state
            refs[at] -= 1
            if refs[at] or level == 0:
                return
            state, level = MOVES[codes[at]].frm, level - 1

    def step(self, kind) -> list[int]:
        """Take one row; the moves that are final now."""
        cost, rank = self.cost, self.rank
        came, new_cost, order = {}, {}, []
        for j, ways in enumerate(INTO[kind]):
            best = None
            for n, m, c, letters in ways:
                if m in cost:
                    key = cost[m] + c, rank[m], letters
                    if best is None or key < best[0]:
                        best = key, n
            if best:
                new_cost[j], came[j] = best[0][0], best[1]
                order.append((best[0][1], best[0][2], j))
        order.sort()
        new_rank = {j: k for k, (_, _, j) in enumerate(order)}
        kept = [y for y in came if not any(
            x != y and (new_cost[x] + LEAD[x][y], new_rank[x]) < (new_cost[y], new_rank[y]) for x in came)]
        top = len(self.refs) // 4
        self.codes += bytes(came.get(j, 0) for j in STATES)
        self.refs += bytes(int(j in kept) for j in STATES)
        for j in kept:
            self.refs[4 * (top - 1) + MOVES[came[j]].frm] += 1
        for m in cost:
            self._free(top - 1, m)
        self.cost, self.rank = {j: new_cost[j] for j in kept}, {j: new_rank[j] for j in kept}
        return self._final()

    def _final(self) -> list[int]:
        out, refs, codes = [], self.refs, self.codes
        top = len(refs) // 4 - 1
        while self.first < top and refs[4 * self.first + self.root] == 1:
            level = 4 * (self.first + 1)
            child = next(j for j in STATES if refs[level + j] and MOVES[codes[level + j]].frm == self.root)
            out.append(codes[level + child])
            self.first, self.root = self.first + 1, child
        if self.first > 4096 and 2 * self.first > top:
            del codes[:4 * self.first], refs[:4 * self.first]
            self.first = 0
        return out

    def finish(self) -> tuple[int, str, list[int]]:
        """(cost, initials inserted at the end, the moves not yet emitted)."""
        total, _, state = min((c + INSERT * len(LAST[j]), self.rank[j], j) for j, c in self.cost.items())
        inserted, out = LAST[state], []
        for level in range(len(self.refs) // 4 - 1, self.first, -1):
            out.append(self.codes[4 * level + state])
            state = MOVES[out[-1]].frm
        return total, inserted, out[::-1]


# ------------------------------------------------------------------ damage and faults

def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults dealt by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                             (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("h"))
    x = x.where("h <> 0").select(
        "conv_id", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"))
    return x.drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``blank``, ``seen`` (role and text in an earlier turn), ``cut``."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    x = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    x = x.select("*", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("_dg"),
                 (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(*ENDS)).alias("cut"))
    when = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    repeats = x.groupBy("conv_id", "_dg").agg(F.min(when).alias("_first"), F.max(when).alias("_last")).where("_first <> _last")
    r = stage(repeats.select(F.col("conv_id").alias("_c"), F.col("_dg").alias("_d"), F.col("_first.turn").alias("_turn"),
                             F.lit(True).alias("_many")), "repeats")
    x = x.join(r, x.conv_id.eqNullSafe(r["_c"]) & (x["_dg"] == r["_d"]), "left")
    seen = F.coalesce("_many", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_turn"))
    return x.select("conv_id", "turn", "role", "text", "blank", seen.alias("seen"), "cut")


# ------------------------------------------------------------------ the search over sorted rows

class Summary:
    """What a conversation's rows say before repair."""

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = self.prior = None

    def add(self, turn, role: str, text: str, blank: bool, seen: bool, cut: bool) -> str:
        """Count the row; its first fault, "" if it has none."""
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.rows and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        again = self.prior == (turn, role, text)
        self.initial, self.prior = initial, (turn, role, text)
        self.rows += 1
        fault = "blank" if blank else "duplicate" if seen or again else "truncated" if cut else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        return fault

    def gaps(self) -> int:
        return min(self.high - self.low + 1 - self.turns, 2**63 - 1) if self.turns else 0


def _search_schema(conv_type: str) -> str:
    return (f"conv_id {conv_type}, pos long, part int, turn long, role string, text string, fault string, edit string, inserted string, "
            "new_role string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def search(rows: DataFrame) -> DataFrame:
    """Records of sorted conversations: part 0 a row, part 1 the final edit of a row, part 2 the end of a
    conversation with its summary. ``pos`` numbers the rows of a conversation from 0."""
    schema = _search_schema(rows.schema["conv_id"].dataType.simpleString())
    out_schema = arrow_schema(schema)
    names = out_schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}

        def put(**values):
            for c in names:
                held[c].append(values.get(c))

        def flush():
            cols = [pa.array(held[f.name], type=f.type) for f in out_schema]
            for c in held.values():
                c.clear()
            return pa.RecordBatch.from_arrays(cols, schema=out_schema)

        def put_edits(conv, at, moves):
            for n in moves:
                m = MOVES[n]
                put(conv_id=conv, pos=at, part=1, edit=m.letters[-1], inserted=m.inserted, new_role=NAMES.get(m.role))
                at += 1
                if len(held["pos"]) >= OUT_ROWS:
                    yield flush()
            return at

        def close(conv, s, path, at):
            cost, inserted, moves = path.finish()
            yield from put_edits(conv, at, moves)
            put(conv_id=conv, pos=s.rows, part=2, inserted=inserted, gaps=s.gaps(), blank=s.blank, duplicate=s.duplicate,
                truncated=s.truncated, illegal=s.illegal, cost=cost)

        conv = s = path = None
        at = 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "seen", "cut")]
            for c, turn, role, text, blank, seen, cut in zip(*cols):
                if s is None or c != conv:
                    if s is not None:
                        yield from close(conv, s, path, at)
                    conv, s, path, at = c, Summary(), Survivors(), 0
                fault = s.add(turn, role, text, blank, seen, cut)
                put(conv_id=c, pos=s.rows - 1, part=0, turn=turn, role=role, text=text, fault=fault)
                initial = role[:1]
                kind = "goes" if fault in ("blank", "duplicate") else (initial if initial in ("s", "u", "a") else "", fault == "truncated")
                at = yield from put_edits(c, at, path.step(kind))
                if len(held["pos"]) >= OUT_ROWS:
                    yield flush()
        if s is not None:
            yield from close(conv, s, path, at)
        if held["pos"]:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "blank", "seen", "cut")
    return x.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def repair_edits(rows: DataFrame) -> DataFrame:
    """One row per row of ``rows`` (conv_id, turn, role, text) with its place, fault, edit (K, R or D), the
    turns inserted before it and its repaired role (null: deleted), and one row per conversation (edit
    null, at its end) with the turns inserted there, gaps, blank, duplicate, truncated, illegal and cost."""
    found = stage(search(with_faults(rows)), "conversations")
    place = ["turn", "role", "text", "fault"]
    at = found.where("part = 0").select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), *place)
    edits = found.where("part > 0").drop(*place)
    x = edits.join(at, edits.conv_id.eqNullSafe(at["_c"]) & (edits.pos == at["_p"]) & (edits.part == 1), "left")
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", F.col("new_role"))
    return x.select("conv_id", "pos", *place, "edit", "inserted", role.alias("repaired_role"),
                    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired_turns(edits: DataFrame) -> DataFrame:
    """The repaired conversations of ``repair_edits``: conv_id, pos and part (their order), role, text."""
    item = lambda part, role, text: F.struct(part.alias("part"), role.alias("role"), text.alias("text"))
    name = lambda x: F.when(x == "u", F.lit(NAMES["u"])).otherwise(F.lit(NAMES["a"]))
    added = F.transform(F.when(F.col("inserted") == "", F.array().cast("array<string>")).otherwise(F.split("inserted", "")),
                        lambda x, i: item(i, name(x), F.lit("")))
    own = F.when(F.col("repaired_role").isNotNull(), F.array(item(F.lit(2), F.col("repaired_role"), F.col("text"))))
    items = F.concat(added, F.coalesce(own, F.array().cast(own_type())))
    return edits.select("conv_id", "pos", F.explode(items).alias("x")).select("conv_id", "pos", "x.*")


def own_type() -> str:
    return "array<struct<part:int,role:string,text:string>>"


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` with the summary, the audit and the hash of the repair of
    ``rows``; each conversation's edits pass in order and are hashed as they come."""
    edits = repair_edits(rows)
    conv_type = edits.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {conv_type}, {', '.join(c + ' long' for c in counts)}, audit string, repaired_sha256 string"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, empty = bytearray(), hashlib.sha256(), True
        for b in batches:
            done: dict[str, list] = {c: [] for c in out.names}
            cols = [b.column(c).to_pylist() for c in ("conv_id", "edit", "inserted", "repaired_role", "text", *counts)]
            for conv, edit, inserted, role, text, *numbers in zip(*cols):
                audit += b"I" * len(inserted) + (edit or "").encode()
                turns = [f"{NAMES[x]}:" for x in inserted] + ([f"{role}:{text}"] if role is not None else [])
                for t in turns:
                    digest.update((t if empty else "\n" + t).encode())
                    empty = False
                if edit is None:
                    for c, v in zip(counts, numbers):
                        done[c].append(v)
                    done["conv_id"].append(conv)
                    done["audit"].append(audit.decode())
                    done["repaired_sha256"].append(digest.hexdigest())
                    audit, digest, empty = bytearray(), hashlib.sha256(), True
            if done["conv_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(done[f.name], type=f.type) for f in out], schema=out)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = edits.select("conv_id", "pos", "edit", "inserted", "repaired_role", F.when(F.col("repaired_role").isNotNull(), F.col("text")).alias("text"),
                     *counts)
    per = x.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, schema)
    every = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "_conv")
    j = every.join(per, every["_conv"].eqNullSafe(per.conv_id), "left")
    none = hashlib.sha256(b"").hexdigest()
    return j.select(F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
