"""Repair of conversations' structure: the cheapest edits that make roles alternate.

A dynamic program chooses the turns that are retained, kept or reroled. What lies between two retained turns is deleted, which a
difference of prefix sums prices; running minima over the possible roles of the next retained turn make each step constant; the two
roles decide what is inserted between. Conversations are met in one pass over sorted rows; one that is cut by a
partition's edge, or is long, is taken by pieces, each told by its least costs from each role to each role.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bound_batches, materialize, partitions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
#: Roles of the retained turn before: none, system, user, assistant; what they are called.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns to insert between a retained turn's role and the next one's; and behind the last.
BETWEEN = {(NONE, SYSTEM): (), (NONE, USER): (), (NONE, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
BEHIND = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
LEGAL = ("su", "ua", "au")
#: Rows and bytes of text of a piece.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20

SPACES = " \t\n\x0b\x0c\r"
SLIM = "blank long, duplicate long, truncated long, illegal long, least long, most long, turns long"
RESULT = f"part long, number long, done boolean, {SLIM}, head string, tail string, costs array<long>, ranks array<long>, gaps long, cost long, audit string, repaired_sha256 string, rows binary"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "least", "most", "turns")


def program(rows: list[tuple], before: int, behind: list[int]):
    """Of rows (role, copies, must go, truncated), behind a retained turn of role `before`: the least cost to the end, where a last
    retained turn of each role costs `behind` from there on; the next retained (place, role) or None; and the same by place and role of
    each retained turn.

    Equal costs: the later next turn, as more deletions come first, then the one with an insertion, a kept and a reroled one: that
    is the order of the edits' initials, so the edits found are the least of the cheapest in ASCII."""
    n = len(rows)
    deleted = [0] * (n + 1)
    for j, (_, copies, _, _) in enumerate(rows):
        deleted[j + 1] = deleted[j] + DELETE * copies
    # For each role of the next retained turn: the least of deletions before it, its own cost and all that follows; and where.
    best = {SYSTEM: (NEVER, n + 1), USER: (NEVER, n + 1), ASSISTANT: (NEVER, n + 1)}
    following: list = [None] * (n + 1)

    def go_on(role: int, spent: int):
        least, key, picked = behind[role] + deleted[n] - spent, (-(n + 2), 0), None
        for then, (value, j) in best.items():
            if value >= NEVER or (role, then) not in BETWEEN:
                continue
            inserted = BETWEEN[role, then]
            total, letter = value - spent + INSERT * len(inserted), 0 if inserted else 1 if rows[j - 1][0] == then else 2
            if (total, (-j, letter)) < (least, key):
                least, key, picked = total, (-j, letter), (j, then)
        return least, picked

    for i in range(n, 0, -1):
        own_role, _, must_go, truncated = rows[i - 1]
        if must_go:
            continue
        owns = {role: KEEP if own_role == role else REROLE for role in (SYSTEM, USER, ASSISTANT) if own_role == role or role != SYSTEM}
        # Deletions after it begin behind its first copy, which is retained itself.
        rests = {role: go_on(role, deleted[i - 1] + DELETE) for role in owns}
        following[i] = {role: picked for role, (_, picked) in rests.items()}
        for role, own in owns.items():
            value = deleted[i - 1] + own + TRUNCATED * truncated + rests[role][0]
            if rests[role][0] < NEVER and value < best[role][0]:
                best[role] = (value, i)
    return *go_on(before, 0), following


def trace(rows: list[tuple], picked, following, before: int):
    """Edits' initials, and the retained and inserted turns in turn: (place or None, role); and the last one's role."""
    audit, turns, at = [], [], 0
    while picked is not None:
        j, role = picked
        audit.append("D" * (sum(rows[k][1] for k in range(at, j - 1))))
        for x in BETWEEN[before, role]:
            audit.append("I")
            turns.append((None, x))
        audit.append("K" if rows[j - 1][0] == role else "R")
        audit.append("D" * (rows[j - 1][1] - 1))
        turns.append((j - 1, role))
        at, before, picked = j, role, following[j][role]
    audit.append("D" * sum(rows[k][1] for k in range(at, len(rows))))
    return "".join(audit), turns, before


def edits(rows: list[tuple], before: int, behind: list[int]):
    """Cost, edits' initials, turns and the last role of the cheapest edits of rows from a role before."""
    cost, picked, following = program(rows, before, behind)
    return cost, *trace(rows, picked, following, before)


WHOLE = [INSERT * len(BEHIND[r]) for r in (NONE, SYSTEM, USER, ASSISTANT)]


def written(turns, texts: list[tuple[str, str]], rows: list[tuple]) -> list[str]:
    """`role:text` of retained and inserted turns."""
    return [f"{NAMES[role]}:" if at is None else f"{texts[at][0] if rows[at][0] == role else NAMES[role]}:{texts[at][1]}" for at, role in turns]


class Piece:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.texts: list[tuple[str, str]] = []
        self.heads: list[str] = []
        self.turns: list[int | None] = []
        self.bytes = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role, text, copies, blank, again, truncated) -> None:
        if not copies:  # only tells that there is such a conversation
            return
        self.rows.append((INITIALS.get(role[:1], NONE), copies, blank or again, truncated))
        self.texts.append((role, "" if blank or again else text))
        self.heads.append(role[:1])
        self.turns.append(turn)
        self.bytes += len(self.texts[-1][1])
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies if again else copies - 1
        self.truncated += not (blank or again) and truncated

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.bytes >= PIECE_BYTES

    def told(self) -> dict:
        heads, turns = self.heads, sorted({t for t in self.turns if t is not None})
        illegal = sum(c - 1 for _, c, _, _ in self.rows) + sum(a + b not in LEGAL for a, b in zip(heads, heads[1:], strict=False))
        return {
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": illegal,
            "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(turns), "head": heads[0] if heads else None, "tail": heads[-1] if heads else None,
        }

    def result(self) -> dict:
        cost, audit, turns, last = edits(self.rows, NONE, WHOLE)
        told = self.told()
        lines = written([*turns, *((None, r) for r in BEHIND[last])], self.texts, self.rows)
        gaps = told["most"] - told["least"] + 1 - told["turns"] if told["turns"] else 0
        return told | {"done": True, "gaps": gaps, "cost": cost, "audit": audit + "I" * len(BEHIND[last]), "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def as_row(self) -> dict:
        """Costs from each role to each role, and how the edits of those from one role rank in ASCII."""
        costs, audits = [], []
        for before in range(4):
            for last in range(4):
                behind = [0 if r == last else NEVER for r in range(4)]
                cost, picked, following = program(self.rows, before, behind)
                costs.append(min(cost, NEVER))
                # Copies beyond the first are deleted in any case, so the order of the edits does not depend on them.
                audits.append(trace([(r, 1, g, t) for r, _, g, t in self.rows], picked, following, before)[0])
        ranks = [sorted(audits[4 * b : 4 * b + 4]).index(audits[4 * b + q]) for b in range(4) for q in range(4)]
        kind = pa.schema([("role", pa.int8()), ("copies", pa.int64()), ("gone", pa.bool_()), ("cut", pa.bool_()), ("name", pa.string()), ("text", pa.string())])
        columns = [*zip(*self.rows, strict=True), *zip(*self.texts, strict=True)] if self.rows else [[]] * 6
        table = pa.table([pa.array(list(x), f.type) for x, f in zip(columns, kind, strict=True)], schema=kind)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kind) as out:
            out.write_table(table)
        return self.told() | {"done": False, "costs": costs, "ranks": ranks, "rows": sink.getvalue().to_pybytes()}


def stored(data: bytes) -> tuple[list[tuple], list[tuple[str, str]]]:
    held = pa.ipc.open_stream(data).read_all().to_pydict()
    return list(zip(held["role"], held["copies"], held["gone"], held["cut"], strict=True)), list(zip(held["name"], held["text"], strict=True))


def spaced(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast(kind), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after damage by crc32 of `conv_id:turn` modulo 20; a dropped row leaves one
    without copies, so that its conversation stays known. Nulls in role, text and that name are one space."""
    by = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(by == 1, "").when(by == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(by == 4, "user").otherwise(spaced("role"))
    there = by != 0
    return rows.select("conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text"), F.when(~there, 0).when(by == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn as one with their number; whether each is blank, said before (in an earlier turn), and cut short."""
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ends = F.rtrim("text", F.lit(SPACES))
    rows = materialize(rows.select("conv_id", "turn", "role", "text", "copies", F.sha2("text", 256).alias("digest"), (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("cut")), "turns")
    said = rows.where("copies > 0 and not blank").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where("first < last")
    said = said.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    again = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return rows.join(said, again, "left").select("conv_id", "turn", "role", "text", "copies", "digest", F.coalesce("blank", F.lit(False)).alias("blank"), F.coalesce(F.col("first") < turn, F.lit(False)).alias("again"), F.coalesce("cut", F.lit(False)).alias("cut"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id: the faults counted, and the cheapest edits that make role initials match `(s?(ua)+)?`.

    rows: conv_id (of any type), turn (whole numbers), role, text, copies (how often the row stands there; 0: not at all). Rows are taken by turn (nulls first), and
    by role and digest of the text within a turn. Returns gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. A null
    conv_id is a conversation. A conversation without rows: zeros, an empty audit and the digest of nothing. An empty
    table gives none. Other columns are not read. Equal rows of a turn cost one row, whatever their number. A conversation
    of any length is solved in pieces of PIECE_ROWS rows; its audit and digest alone, which are of all its text in order, are made in one task that streams it.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = faults(rows)
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    ordered = ordered.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("digest")
    names = ["conv_id", *(x.split()[0] for x in RESULT.split(", "))]

    def solve(batches):
        part = TaskContext.get().partitionId()
        kinds = {"conv_id": None, "part": pa.int64(), "number": pa.int64(), "done": pa.bool_(), **dict.fromkeys(COUNTS, pa.int64()), "head": pa.string(), "tail": pa.string(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64()), "gaps": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(), "rows": pa.binary()}
        out, size, number, first = [], 0, 0, True
        now, piece, cut = None, None, False

        def emit(last: bool):
            # A conversation that lies within the partition and in one piece is solved at once; any other waits for its other pieces.
            nonlocal number, size, cut
            row = piece.result() if last and not (cut or first) else piece.as_row()
            out.append(row | {"conv_id": now, "part": part, "number": number})
            size += len(row.get("rows") or "") + len(row.get("audit") or "") + 300
            number, cut = number + 1, not last

        def table():
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in kinds.items()], names)

        for batch in batches:
            kinds["conv_id"] = batch.schema.field("conv_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or row[0] != now:
                    if piece is not None:
                        emit(True)
                        first = False
                    now, piece = row[0], Piece()
                elif piece.full():
                    emit(False)
                    piece = Piece()
                piece.add(*row[1:])
                if size >= 4 << 20:
                    yield table()
                    out, size = [], 0
        if piece is not None:
            # The last one may go on in the next partition.
            cut = True
            emit(True)
            yield table()

    solved = materialize(ordered.mapInArrow(solve, f"conv_id {kind}, {RESULT}"), "repaired")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return solved.where("done").select(columns).unionByName(joined(solved.where("not done"), kind).select(columns))


def joined(pieces: DataFrame, kind: str) -> DataFrame:
    """Conversations in pieces: their roles at the pieces' limits, chosen over all pieces, then each piece's edits, strung together."""

    def choose(table: pa.Table) -> pa.Table:
        rows = sorted((r for r in table.to_pylist()), key=lambda r: (r["part"], r["number"]))
        behind, exits = list(WHOLE), []
        for r in reversed(rows):
            costs, ranks = r["costs"], r["ranks"]
            pick = [min(range(4), key=lambda q, b=b: (costs[4 * b + q] + behind[q], ranks[4 * b + q])) for b in range(4)]  # noqa: B023
            behind = [min(NEVER, costs[4 * b + pick[b]] + behind[pick[b]]) for b in range(4)]
            exits.append(pick)
        before, out = NONE, []
        for r, pick in zip(rows, reversed(exits), strict=True):
            out.append((before, pick[before]))
            before = pick[before]
        full = [r for r in rows if r["head"] is not None]
        timed = [r for r in full if r["turns"]]
        turns = sum(r["turns"] for r in timed) - sum(a["most"] == b["least"] for a, b in zip(timed, timed[1:], strict=False))
        whole = {"blank": sum(r["blank"] for r in full), "duplicate": sum(r["duplicate"] for r in full), "truncated": sum(r["truncated"] for r in full), "cost": behind[NONE]}
        whole["illegal"] = sum(r["illegal"] for r in full) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(full, full[1:], strict=False))
        whole["gaps"] = timed[-1]["most"] - timed[0]["least"] + 1 - turns if timed else 0
        n = len(rows)
        data = {"part": [r["part"] for r in rows], "number": [r["number"] for r in rows], "before": [x for x, _ in out], "last": [x for _, x in out], "ends": [k == n - 1 for k in range(n)]}
        types = {"part": pa.int64(), "number": pa.int64(), "before": pa.int64(), "last": pa.int64(), "ends": pa.bool_()}
        return pa.table([pa.array(data[c], t) for c, t in types.items()] + [pa.array([whole[c]] * n, pa.int64()) for c in WHOLE_COUNTS], names=[*types, *WHOLE_COUNTS])

    chosen = pieces.drop("rows", "audit", "repaired_sha256").groupBy("conv_id").applyInArrow(choose, "part long, number long, before long, last long, ends boolean, " + ", ".join(f"{c} long" for c in WHOLE_COUNTS))

    def edit(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows, texts = stored(r["rows"])
                _, audit, turns, last = edits(rows, r["before"], [0 if q == r["last"] else NEVER for q in range(4)])
                if r["ends"]:
                    audit, turns = audit + "I" * len(BEHIND[last]), [*turns, *((None, x) for x in BEHIND[last])]
                lines = written(turns, texts, rows)
                out.append((audit, "\n".join(lines).encode(), len(lines)))
            same = [batch.column(c) for c in ("conv_id", "part", "number", *WHOLE_COUNTS)]
            yield pa.RecordBatch.from_arrays([*same, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], ["conv_id", "part", "number", *WHOLE_COUNTS, "audit", "body", "lines"])

    counts = ", ".join(f"{c} long" for c in WHOLE_COUNTS)
    # Pieces are named by their task and number; a sort by conversation brings them in order, and a task streams them.
    asked = pieces.select("conv_id", "part", "number", "rows").join(chosen, ["part", "number"])
    edited = asked.mapInArrow(edit, f"conv_id {kind}, part long, number long, {counts}, audit string, body binary, lines long")
    edited = edited.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "number")

    def string(batches):
        now, digest, audit, any_, counts, started = None, None, [], False, None, False
        out = []

        def close():
            out.append((now, *counts, "".join(audit), digest.hexdigest()))

        def table():
            types = [kind_of, *[pa.int64()] * len(WHOLE_COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv_id", *WHOLE_COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if not started or r["conv_id"] != now:
                    if started:
                        close()
                    now, digest, audit, any_, started = r["conv_id"], hashlib.sha256(), [], False, True
                    counts = [r[c] for c in WHOLE_COUNTS]
                if r["lines"]:
                    digest.update((b"\n" if any_ else b"") + r["body"])
                    any_ = True
                audit.append(r["audit"])
            if out:
                yield table()
                out = []
        if started:
            close()
            yield table()

    return edited.mapInArrow(string, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


WHOLE_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """Damage conversations by fixed rules, then repair them; every conv_id has a row. Columns and odd rows: see damage and repair."""
    return repair(damage(rows))
