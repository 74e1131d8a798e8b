"""Chat formatting with minimum-cost role repair.

Legal conversations: an optional system message, then user and assistant in
turn, user first. A dynamic program over this automaton chooses for every turn
whether it stays, is relabelled, or is merged into the message before it, and
where empty messages are inserted, at least total cost; then the repaired
sequence is rendered.

A turn acts on the automaton by its role alone, so a stretch of turns is a
4 x 4 matrix of least costs, and matrices of neighbouring stretches combine.
Turns are sorted over all tasks and read in order; a conversation is cut into segments
of SEGMENT turns and SEGMENT_CHARS at most: segments are summarised apart and chained from
the end, which gives the least costs behind each; with these a segment tells where it
leaves from each state, which chained from the front fixes the state it is entered in;
then it is decoded by itself. Decoding takes the first best choice turn by turn, so
neither segments nor partitions can change a result.
A conversation that holds a third of all rows is spread over its segments, whatever its
turn numbers, and no group is collected beyond SEGMENT turns.

Marks of the rendering inside texts are escaped: "<|" becomes "<\\|", and a backslash is
added to those that stand between already, so unescaped() gives the text back.

Defined cases: roles are compared without case and outer space, ROLES lists
synonyms; a null or unknown role must be relabelled (at low cost); a null text
counts as empty; turns are ordered by number, null numbers first, ties by role
and text; repeated rows are turns of their own; a null conversation id is a
conversation of its own; an empty table gives an empty result; other columns are
not read. Ties in cost go to keep, then merge, relabel, and fewer insertions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, total_parallelism

ROLES = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "gpt": 3, "bot": 3, "model": 3, "ai": 3}
NAMES = ("", "system", "user", "assistant")
#: States are start (0) and the role of the last message; next legal roles by state.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = (2, 3)
KEEP, MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 0, 2, 5, 1, 3
FAR = 1 << 40
SEGMENT = 8192
#: Characters of a segment, but for its last turn.
SEGMENT_CHARS = 8 << 20


def role_of(role: str | None) -> int:
    return ROLES.get((role or "").strip().lower(), 0)


def _inserts() -> list[list[tuple[int, tuple[int, ...]]]]:
    """Cheapest insertions that lead from state a to state b."""
    best = [[(0, ()) if a == b else (FAR, ()) for b in range(4)] for a in range(4)]
    for _ in range(3):
        for a in range(4):
            for b in range(4):
                cost, path = best[a][b]
                for c in LEGAL[b] if cost < FAR else ():
                    if cost + INSERT < best[a][c][0]:
                        best[a][c] = (cost + INSERT, (*path, c))
    return best


INSERTS = _inserts()


def _moves(role: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """For a turn of this role: cost, action and insertions from each state to each."""
    out = [[(FAR, "", ())] * 4 for _ in range(4)]
    order = {"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3}
    for a in range(4):
        for b in (1, 2, 3):
            change = KEEP if role == b else RELABEL if role else RELABEL_UNKNOWN
            ways = [(MERGE + change, "merge" if role == b else "relabel+merge", ())] if a == b else []
            for c in range(4):
                cost, path = INSERTS[a][c]
                if b in LEGAL[c] and cost < FAR:
                    ways.append((cost + change, "keep" if role == b else "relabel", path))
            out[a][b] = min(ways, key=lambda x: (x[0], len(x[2]), order[x[1]]), default=(FAR, "", ()))
    return out


MOVES = [_moves(r) for r in range(4)]
_COSTS = np.array([[[x[0] for x in row] for row in m] for m in MOVES], np.int64)


def summary(roles: list[int]) -> list[int]:
    """Least costs of a stretch of turns from each state to each, by rows."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = np.minimum((m[:, :, None] + _COSTS[r][None]).min(1), FAR)
    return [int(x) for x in m.ravel()]


def behind(summaries: list[list[int]]) -> list[list[int]]:
    """Least costs from each state behind each stretch to the end, chained from the end."""
    out = [[closing(b)[0] for b in range(4)]]
    for m in reversed(summaries[1:]):
        out.append([min(min(m[4 * a + b] + out[-1][b] for b in range(4)), FAR) for a in range(4)])
    return out[::-1]


def entries(leaves: list[list[int]]) -> list[int]:
    """The state that each stretch is entered in, from where it leaves for each state."""
    out = [0]
    for to in leaves[:-1]:
        out.append(to[out[-1]])
    return out


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """What is inserted to end in a final state."""
    return min((INSERTS[state][f] for f in FINAL), key=lambda x: (x[0], len(x[1])))


_ORDER = {"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3, "": 4}
#: Ways from each state with a turn of each role, by preference among equal costs.
WAYS = [[sorted(((*MOVES[r][a][b], b) for b in range(4)), key=lambda w: (_ORDER[w[1]], len(w[2]), w[3])) for a in range(4)] for r in range(4)]


def ahead(roles: list[int], behind: list[int]) -> list[list[int]]:
    """Least costs to the end from each state, before each turn and behind the last."""
    out = [behind]
    for r in reversed(roles):
        after = out[-1]
        out.append([min(min(w[0] + after[w[3]] for w in WAYS[r][a]), FAR) for a in range(4)])
    return out[::-1]


def decode(roles: list[int], entry: int, behind: list[int]) -> list[tuple[str, int, tuple[int, ...]]]:
    """Action, repaired role and insertions before, for each turn of a stretch: turn by turn
    the first way that keeps the least cost."""
    costs, out, state = ahead(roles, behind), [], entry
    for k, r in enumerate(roles):
        _, action, inserted, state = next(w for w in WAYS[r][state] if w[0] + costs[k + 1][w[3]] == costs[k][state])
        out.append((action, state, inserted))
    return out


def leaves(roles: list[int], behind: list[int]) -> list[int]:
    """For each state that a stretch may be entered in, the state it leaves in."""
    return [(decode(roles, a, behind) or [("", a, ())])[-1][1] if ahead(roles, behind)[0][a] < FAR else a for a in range(4)]


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _open(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


def rendered(decoded, texts: list[str], follows: bool, closed: tuple[int, ...] | None) -> list[str]:
    """The piece of the rendered conversation that each turn brings.

    A message ends with the mark that the next message or the end writes, so a
    merged turn only adds its text. follows: something stands before the first
    turn. closed: what is inserted at the end, None if more turns follow.
    """
    out = []
    for (action, role, inserted), text in zip(decoded, texts):
        piece = ""
        for r in inserted:
            piece += ("<|end|>\n" if follows else "") + _open(r)
            follows = True
        piece += "\n" if action.endswith("merge") else ("<|end|>\n" if follows else "") + _open(role)
        follows = True
        out.append(piece + escaped(text))
    if closed is not None and out:
        out[-1] += "".join("<|end|>\n" + _open(r) for r in closed) + "<|end|>\n"
    return out


_OUT = "place long, turn long, role string, action string, repaired_role string, inserted array<string>, rendered string"
_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def segments(turns: DataFrame, conv: str, turn: str, role: str, text: str, segment: int) -> DataFrame:
    """(c, seg, ts): turns of a conversation in order, segment of them and SEGMENT_CHARS a
    row at most; seg grows with the order."""
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = ("c", "turn", "role", "text")  # nulls first
    ranges = rows.repartitionByRange(total_parallelism(turns.sparkSession), "c", "turn", "role", F.substring("text", 1, 200))  # no whole texts in the borders
    ordered = ranges.sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        kind, home, held, chars = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([home], kind), pa.array([place], pa.int64()), pa.array([held], pa.list_(_TURN))], names=["c", "seg", "ts"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, *t in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (c != home or len(held) == segment or chars >= SEGMENT_CHARS):
                    yield row()
                    place += len(held)
                    held, chars = [], 0
                home = c
                held.append(dict(zip(("turn", "role", "text"), t)))
                chars += len(t[2] or "")
        if held:
            yield row()

    kind = turns.schema[conv].dataType.simpleString()
    return ordered.mapInArrow(run, f"c {kind}, seg long, ts array<struct<turn: long, role: string, text: string>>")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row a turn: its place in the conversation, from 0, what is done with it, the empty messages
    inserted before it (at the end: after it), and its piece of the rendering; pieces in
    order of place make the whole (rendering() puts them together)."""
    kind = turns.schema[conv].dataType.simpleString()
    grouped = staged(segments(turns, conv, turn, role, text, segment), "segments")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary([role_of(r) for r in rs]) for rs in batch.column(2).to_pylist()]
            lengths = pc.list_value_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), lengths], names=["c", "seg", "m", "n"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, segs in enumerate(batch.column(1).to_pylist()):
                before = 0
                for j, (s, costs) in enumerate(zip(segs, behind([s["m"] for s in segs]))):
                    at.append(k)
                    rows.append((s["seg"], costs, before, j == len(segs) - 1, len(segs) == 1))
                    before += s["n"]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["bc", "bseg", "behind", "before", "last", "solo"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [leaves([role_of(r) for r in rs], costs) for rs, costs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["c", "seg", "to"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, segs in enumerate(batch.column(1).to_pylist()):
                found = entries([s["to"] for s in segs])
                same = batch.column(0).take(pa.array([k] * len(segs), pa.int64()))
                yield pa.RecordBatch.from_arrays([same, pa.array([s["seg"] for s in segs], pa.int64()), pa.array(found, pa.int64())], names=["ec", "eseg", "entry"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (ts, before, entry, costs, last) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 6)))):
                decoded = decode([role_of(t["role"]) for t in ts], entry, costs)
                end = closing(decoded[-1][1] if decoded else entry)[1] if last else None
                pieces = rendered(decoded, [t["text"] or "" for t in ts], before > 0, end)
                for j, (t, (action, state, inserted), piece) in enumerate(zip(ts, decoded, pieces)):
                    at.append(k)
                    more = end or () if j == len(ts) - 1 else ()
                    rows.append((before + j, t["turn"], t["role"], action, NAMES[state], [NAMES[r] for r in (*inserted, *more)], piece))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[conv, *(x.split()[0] for x in _OUT.split(", "))])

    parts = grouped.select("c", "seg", F.col("ts.role").alias("rs")).mapInArrow(sums, f"c {kind}, seg long, m array<long>, n long")
    chained = parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("seg", "m", "n"))).alias("segs"))
    ends = staged(chained.mapInArrow(borders, f"bc {kind}, bseg long, behind array<long>, before long, last boolean, solo boolean"), "borders", narrow=True)
    here = lambda c, seg: F.col("c").eqNullSafe(F.col(c)) & (F.col("seg") == F.col(seg))
    long = grouped.select("c", "seg", F.col("ts.role").alias("rs")).join(ends.where("not solo"), here("bc", "bseg")).select("c", "seg", "rs", "behind")
    told = long.mapInArrow(exits, f"c {kind}, seg long, to array<long>").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("seg", "to"))).alias("segs"))
    entry = told.mapInArrow(starts, f"ec {kind}, eseg long, entry long")
    both = grouped.join(ends, here("bc", "bseg")).join(entry, here("ec", "eseg"), "left")
    return both.select("c", "ts", "before", F.coalesce("entry", F.lit(0)).alias("entry"), "behind", "last").mapInArrow(finish, f"`{conv}` {kind}, {_OUT}")


def rendering(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, rendered): the whole text of each conversation of repair(), for those
    that a row can hold."""
    pieces = F.sort_array(F.collect_list(F.struct("place", "rendered")))
    return repaired.groupBy(conv).agg(F.array_join(pieces["rendered"], "").alias("rendered"))
