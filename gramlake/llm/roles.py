"""Conversation structure repair by composition of weighted finite-state machines.

Three machines: an acceptor of the turns as they came, an edit transducer (keep, rerole,
delete, insert, with their costs) and an acceptor of legal sequences of roles,
`(s?(ua)+)?`. They are composed lazily: an arc of the composition is made when a turn of
its kind first meets a state of the grammar. The composition has no cycles of cost 0, so
positions are a topological order; weights are pairs (cost, labels), least cost first,
then the labels that come first in ASCII order.

An edit's label leads from a state of the grammar to one other state only, so paths with
equal labels repair alike, and ties are settled label by label: costs are summed from the
end, and the path then follows, from the front, the first label that keeps the least cost.

A conversation may hold a third of all rows. Turns are sorted over all tasks and cut into
segments, bounded in turns and in bytes. A segment is a matrix of least costs between
states; matrices chained from the end give the costs behind each segment, with which a
segment tells for each state it may be entered in where it leaves; chained from the front
these give the entries, and each segment is repaired by itself. What a segment says is of
fixed size. Only the hash of a repaired conversation reads its pieces in one task, one
after the other, as the hash is defined so; nothing is held but the hash.

Defined cases: a null id, role or text, and a null turn inside the hash that chooses the
damage, count as one space, null ids are one conversation, null turns come first; turns of
one number are ordered by role, then the first 200 characters of the text, then its hash;
repeated rows are turns of their own (and so duplicates); a conversation that lost all its
rows stays, with zeros; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, total_parallelism

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40
#: A segment's bounds.
TURNS, BYTES = 4096, 16 << 20
FAULTS = ("blank", "duplicate", "truncated")

#: States of the grammar: nothing yet, behind s, behind u, behind a; by role initials.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
STATES = range(4)
#: The role that an inserted or rerolled turn takes in each state, and where it leads.
WRITTEN = tuple(next((r, role, GRAMMAR[q][r]) for r, role in (("u", "user"), ("a", "assistant")) if r in GRAMMAR[q]) for q in STATES)


@cache
def arcs(state: int, initial: str, fault: str) -> tuple[tuple[str, int, int], ...]:
    """Arcs of the composition that read a turn of this kind: label, cost, next state; by label."""
    out = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED * (fault == "truncated")
        if initial in GRAMMAR[state]:
            out.append(("K", KEEP + more, GRAMMAR[state][initial]))
        out.append(("R", REROLE + more, WRITTEN[state][2]))
    return tuple(out)


def with_inserts(costs: list[int]) -> list[int]:
    """Least costs if turns may be inserted first; two are enough from any state."""
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[WRITTEN[q][2]]) for q in STATES]
    return costs


CLOSED = tuple(with_inserts([0 if q in FINAL else FAR for q in STATES]))
Kind = tuple[str, str]


def costs(kinds: list[Kind], behind: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost to the end from each state, before each turn and behind the last."""
    out = [tuple(behind)]
    for initial, fault in reversed(kinds):
        after = out[-1]
        out.append(tuple(min(FAR, c) for c in with_inserts([min(c + after[to] for _, c, to in arcs(q, initial, fault)) for q in STATES])))
    return out[::-1]


def matrix(kinds: list[Kind]) -> list[int]:
    """Least costs of a segment from each state to each, by columns (exit states)."""
    return [c for q in STATES for c in costs(kinds, tuple(0 if p == q else FAR for p in STATES))[0]]


def path(kinds: list[Kind], ahead: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """Labels of the best path from a state, and the state it leaves in."""
    out = []
    for k in range(len(kinds) + last):
        reads = arcs_of = ()
        while True:
            role = WRITTEN[state][2]
            if k < len(kinds):
                arcs_of = arcs(state, *kinds[k])
                reads = [(label, c + ahead[k + 1][to], to) for label, c, to in arcs_of]
            elif state in FINAL:
                reads = [("", 0, state)]
            ways = [*reads, ("I", INSERT + ahead[k][role], role)]
            label, _, state = min((w for w in ways if w[1] == ahead[k][state]), key=lambda w: w[0])
            out.append(label)
            if label != "I":
                break
    return "".join(out), state


def messages(labels: str, state: int, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(role, text) of the repaired turns."""
    out, k = [], 0
    for label in labels:
        role, text = ("", "") if label == "I" else turns[k]
        k += label != "I"
        if label == "D":
            continue
        if label == "K":
            state = GRAMMAR[state][role[:1]]
        else:
            _, role, state = WRITTEN[state]
        out.append((role, text))
    return out


def damaged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, role, text, gone): rows after damage; dropped ones stay as gone, without text, so that no conversation is lost."""
    said = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said(conv), said(turn)).cast("binary")) % 20
    hurt = F.when(kind < 2, "").when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(said(role)).alias("role"), hurt.alias("text"), kind.alias("kind"))
    return rows.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("gone", F.col("kind") == 0).drop("kind")


_ROW = "struct<role: string, text: string, fault: string, hash: binary>"
_ROW_TYPE = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("hash", pa.binary())])
_SUMS = ("turns", "first_turn", "last_turn", "distinct", "illegal")
_LONGS = ", ".join(f"{x} long" for x in _SUMS)
LEGAL = ("su", "ua", "au")


def segments(rows: DataFrame, most_turns: int, most_bytes: int) -> DataFrame:
    """Turns in order, a row a segment: conversation, place (grows with the order), roles,
    texts, faults (duplicates inside the segment only), text hashes and sums over turns."""
    order = ["c", "turn", "role", "head", "hash"]
    keyed = rows.withColumn("head", F.substring("text", 1, 200)).withColumn("hash", F.unhex(F.sha2("text", 256))).withColumn("again", F.col("again") + F.floor(F.rand(7) * 64))
    white = r"\x20\x09-\x0D"
    fault = F.when(~F.col("text").rlike(f"[^{white}]"), "blank").when(~F.col("text").rlike(rf"[.!?][{white}]*\z"), "truncated").otherwise("")
    # equal turns may stand in any order, so a random column may spread them over tasks
    ordered = keyed.repartitionByRange(total_parallelism(rows.sparkSession), *order, "again").sortWithinPartitions(*order)
    ready = ordered.select("c", F.spark_partition_id().alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text", fault.alias("fault"), "hash", "gone")
    kind = rows.schema["c"].dataType.simpleString()
    names = ["c", "place", "rows", *_SUMS]
    schema = f"c {kind}, place long, rows array<{_ROW}>, {_LONGS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, size, home, place, began, type_ = [], [], 0, None, 0, False, None

        def segment():
            known = [t for t in turns if t is not None]
            illegal = sum(a["role"][:1] + b["role"][:1] not in LEGAL for a, b in zip(held, held[1:]))
            sums = [len(held), known[0] if known else None, known[-1] if known else None, len(set(known)), illegal]
            return pa.RecordBatch.from_arrays([pa.array([home], type_), pa.array([place], pa.int64()), pa.array([with_duplicates(held, ())], pa.list_(_ROW_TYPE)), *(pa.array([x], pa.int64()) for x in sums)], names=names)

        for batch in batches:
            type_ = batch.schema.field(0).type
            for c, part, turn, role, text, fault, digest, gone in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if began and (c != home or len(held) >= most_turns or size >= most_bytes):
                    yield segment()
                    place += 1
                    held, turns, size = [], [], 0
                if not began:
                    place = part << 40
                began, home = True, c
                if not gone:
                    held.append({"role": role, "text": text, "fault": fault, "hash": digest})
                    turns.append(turn)
                    size += len(text)
        if began:
            yield segment()

    return ready.mapInArrow(run, schema)


def with_duplicates(rows: list[dict], earlier) -> list[dict]:
    """The turns, with those marked whose role and text stood before: in rows, or earlier."""
    seen, out = {(x["role"], x["hash"]) for x in earlier}, []
    for r in rows:
        key = (r["role"], r["hash"])
        out.append({**r, "fault": "duplicate"} if key in seen and r["fault"] != "blank" else r)
        seen.add(key)
    return out


def _kinds(rows: list[dict]) -> list[Kind]:
    return [(r["role"][:1], r["fault"]) for r in rows]


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _long(cut: DataFrame, several: DataFrame, kind: str) -> DataFrame:
    """Segments of the conversations that have several, with duplicates of earlier
    segments marked, the costs behind each and the state it is entered in."""
    long = cut.join(several, _same("c", "mc")).drop("mc")
    said = long.select("c", "place", F.explode(F.array_distinct(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["hash"].alias("hash"))))).alias("t"))
    first = said.groupBy("c", "t").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("fc"), F.col("t").alias("ft"), "first")
    late = said.join(first, _same("c", "fc") & (F.col("t") == F.col("ft")) & (F.col("first") < F.col("place")))
    seen = late.groupBy("c", "place").agg(F.collect_list("t").alias("seen")).select(F.col("c").alias("sc"), F.col("place").alias("splace"), "seen")
    columns = ["c", "place", "rows", "front", "end", *_SUMS]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [with_duplicates(rows, seen or ()) for rows, seen in zip(batch.column(2).to_pylist(), batch.column(len(columns)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(rows, pa.list_(_ROW_TYPE)) if k == 2 else batch.column(k) for k in range(len(columns)))], names=columns)

    both = long.join(seen, _same("c", "sc") & (F.col("place") == F.col("splace")), "left").select(*columns, "seen")
    told = staged(both.mapInArrow(mark, f"c {kind}, place long, rows array<{_ROW}>, front long, end long, {_LONGS}"), "long-segments")
    slim = told.select("c", "place", F.transform("rows", lambda r: F.struct(F.substring(r["role"], 1, 1).alias("role"), r["fault"].alias("fault"))).alias("rows"))

    def per_segment(rows: DataFrame, f, column: str, *more: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [f(_kinds(x), *y) for x, *y in zip(*(batch.column(k).to_pylist() for k in range(2, batch.num_columns)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["c", "place", column])

        return rows.select("c", "place", "rows", *more).mapInArrow(run, f"c {kind}, place long, {column} array<long>")

    def chained(parts: DataFrame, f, source: str, column: str) -> DataFrame:
        """f gives a list for each segment of a conversation from what its segments say, in order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, xs in enumerate(batch.column(1).to_pylist()):
                    found = f([x[source] for x in xs])
                    same_c = batch.column(0).take(pa.array([c] * len(xs), pa.int64()))
                    yield pa.RecordBatch.from_arrays([same_c, pa.array([x["place"] for x in xs], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["jc", "jplace", column])

        each = parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("place", source))).alias("xs"))
        return each.mapInArrow(run, f"jc {kind}, jplace long, {column} array<long>")

    at = lambda df, more: df.join(more, _same("c", "jc") & (F.col("place") == F.col("jplace"))).drop("jc", "jplace")
    behind = staged(chained(per_segment(slim, matrix, "m"), costs_behind, "m", "behind"), "behind", narrow=True)
    entry = chained(per_segment(at(slim, behind), leaving, "leaves", "behind"), entered, "leaves", "entry")
    return at(at(told, behind), entry)


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_turns: int = TURNS, most_bytes: int = BYTES) -> DataFrame:
    """A row a segment of a conversation after damage: (conv, place, whole: it is the only
    one, its sums, faults by kind, cost, labels of the edits, repaired `role:text` lines)."""
    kind = turns.schema[conv].dataType.simpleString()
    cut = staged(segments(damaged(turns, conv, turn, role, text), most_turns, most_bytes), "segments")
    parts = cut.groupBy("c").agg(F.count("*").alias("parts"), F.min("place").alias("front"), F.max("place").alias("end"))
    several = staged(parts.where("parts > 1").select(F.col("c").alias("mc"), "front", "end"), "several", narrow=True)
    ready = _long(cut, several, kind).withColumn("whole", F.lit(False))
    closed = F.array(*(F.lit(c) for c in CLOSED))
    alone = cut.join(several, _same("c", "mc"), "left_anti").select("*", F.col("place").alias("end"), closed.alias("behind"), F.array(F.lit(0).cast("long")).alias("entry"), F.lit(True).alias("whole"))
    names = [conv, "place", "whole", *_SUMS, "blank", "duplicate", "truncated", "cost", "labels", "repaired", "first_role", "last_role"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, held, end, after, entry in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                kinds = _kinds(held)
                ahead = costs(kinds, tuple(after))
                labels, leave = path(kinds, ahead, entry[0], place == end)
                lines = [f"{r}:{t}" for r, t in messages(labels, entry[0], [(r["role"], r["text"]) for r in held])]
                cost = ahead[0][entry[0]] - (0 if place == end else after[leave])
                rows.append((*(sum(f == x for _, f in kinds) for x in FAULTS), cost, labels, lines, kinds[0][0] if kinds else None, kinds[-1][0] if kinds else None))
            columns = list(zip(*rows)) or [()] * 8
            types = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(batch.column(k) for k in range(6, 7 + len(_SUMS))), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    order = ["c", "place", "rows", "end", "behind", "entry", "whole", *_SUMS]
    schema = f"`{conv}` {kind}, place long, whole boolean, {_LONGS}, blank long, duplicate long, truncated long, cost long, labels string, repaired array<string>, first_role string, last_role string"
    return alone.select(*order).unionByName(ready.select(*order)).mapInArrow(finish, schema)


def costs_behind(matrices: list[list[int]]) -> list[list[int]]:
    """Costs to the end behind each segment, chained from the end."""
    out = [list(CLOSED)]
    for m in reversed(matrices[1:]):
        grid = np.array(m, np.int64).reshape(4, 4)  # exit state, entry state
        out.append(np.minimum((grid + np.array(out[-1])[:, None]).min(0), FAR).tolist())
    return out[::-1]


def leaving(kinds: list[Kind], behind: list[int]) -> list[int]:
    """For each state that a segment may be entered in: where its best path leaves."""
    ahead = costs(kinds, tuple(behind))
    return [path(kinds, ahead, q, False)[1] if ahead[0][q] < FAR else q for q in STATES]


def entered(leaves: list[list[int]]) -> list[list[int]]:
    """The state each segment is entered in, chained from the front."""
    out, state = [], 0
    for to in leaves:
        out.append([state])
        state = to[state]
    return out


_TOTALS = ("blank", "duplicate", "truncated", "illegal", "cost")
_AUDIT = (*("gaps", *_TOTALS), "audit", "repaired_sha256")


def audited(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row a conversation, from the segments of repaired(): gaps, faults, illegal
    neighbours, cost, the labels of all edits and the hash of the repaired turns."""
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    whole = repaired.where("whole").select(conv, gaps.alias("gaps"), *_TOTALS, F.col("labels").alias("audit"), F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
    return whole.unionByName(_joined(repaired.where("not whole"), conv))


def _joined(parts: DataFrame, conv: str) -> DataFrame:
    """audited() of conversations in several segments. Their lines are hashed one after the
    other, in order of place; of earlier ones only sums, labels and the hash's state are kept."""
    kind = parts.schema[conv].dataType.simpleString()
    columns = [conv, "place", *_SUMS, "blank", "duplicate", "truncated", "cost", "labels", "repaired", "first_role", "last_role"]
    ordered = parts.select(*columns).repartition(conv).sortWithinPartitions(conv, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        kind_of = None

        def row(now: dict) -> pa.RecordBatch:
            gaps = now["most"] - now["least"] + 1 - now["distinct"] if now["distinct"] else 0
            values = [gaps, *(now[x] for x in _TOTALS), "".join(now["labels"]), now["sha"].hexdigest()]
            types = [*[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([now["home"]], kind_of), *(pa.array([v], t) for v, t in zip(values, types))], names=[conv, *_AUDIT])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for k in range(batch.num_rows):
                r = {name: batch.column(j)[k].as_py() for j, name in enumerate(columns)}
                if now is None or r[conv] != now["home"]:
                    if now is not None:
                        yield row(now)
                    now = {"home": r[conv], "sha": hashlib.sha256(), "lines": 0, "least": None, "most": None, "distinct": 0, "role": None, "labels": [], **dict.fromkeys(_TOTALS, 0)}
                if r["distinct"]:
                    now["distinct"] += r["distinct"] - (r["first_turn"] == now["most"])
                    now["least"] = r["first_turn"] if now["least"] is None else now["least"]
                    now["most"] = r["last_turn"]
                for x in _TOTALS:
                    now[x] += r[x]
                if r["turns"]:
                    now["illegal"] += now["role"] is not None and now["role"] + r["first_role"] not in LEGAL
                    now["role"] = r["last_role"]
                now["labels"].append(r["labels"])
                for line in r["repaired"]:
                    now["sha"].update((b"\n" if now["lines"] else b"") + line.encode())
                    now["lines"] += 1
        if now is not None:
            yield row(now)

    return ordered.mapInArrow(run, f"`{conv}` {kind}, {', '.join(f'{x} long' for x in _AUDIT[:6])}, audit string, repaired_sha256 string")


def _states_sql(best: str) -> str:
    """From candidates b0 to b3 without inserts, those with up to two inserts first."""
    insert = lambda b: f"{{'cost': {b}.cost + {INSERT}, 'audit': 'I' || {b}.audit, 'said': [%s || ':'] || {b}.said}}"
    for step in range(2):
        best = f"SELECT * REPLACE ({', '.join(f'least(b{q}, {insert(f"b{WRITTEN[q][2]}") % chr(39).join(("", WRITTEN[q][1], ""))}) AS b{q}' for q in STATES)}) FROM ({best})"
    return best


def _reads_sql(q: int) -> str:
    """The least of what reads turn r in state q, from states p.b0 to p.b3 behind it."""
    last = "r.role || ':' || r.text"
    made = lambda cost, label, to, said: f"{{'cost': p.b{to}.cost + {cost}, 'audit': '{label}' || p.b{to}.audit, 'said': {said} || p.b{to}.said}}"
    keep = [f"WHEN '{i}' THEN {made(f'{KEEP} + r.more', 'K', to, f'[{last}]')}" for i, to in GRAMMAR[q].items()]
    never = f"{{'cost': {FAR}, 'audit': '', 'said': CAST([] AS VARCHAR[])}}"
    _, role, to = WRITTEN[q]
    rerole = made(f"{REROLE} + r.more", "R", to, f"['{role}:' || r.text]")
    delete = made(DELETE, "D", q, "CAST([] AS VARCHAR[])")
    return f"least({delete}, CASE WHEN r.gone THEN {never} ELSE {rerole} END, CASE WHEN r.gone THEN {never} ELSE CASE left(r.role, 1) {' '.join(keep)} ELSE {never} END END) AS b{q}"


def _repair_sql() -> str:
    white = r"\x20\x09-\x0D"
    start = ", ".join(f"{{'cost': {0 if q in FINAL else FAR}, 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS b{q}" for q in STATES)
    table = "SELECT range AS i, range AS t0 FROM range(256)"
    for k in range(8):
        table = f"SELECT i, CASE WHEN t{k} % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), t{k} // 2) ELSE t{k} // 2 END AS t{k + 1} FROM ({table})"
    return rf"""
WITH RECURSIVE crc AS (SELECT list(t8 ORDER BY i) AS tab FROM ({table})),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(hex(k), 2 * j + 1, 2) AS BIGINT) FOR j IN range(octet_length(k))]),
             lambda c, b: xor(tab[CAST(xor(c % 256, b) AS BIGINT) + 1], c // 256))) % 20 AS d
  FROM named, crc),
hurt AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM hashed WHERE d <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS repeated, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM ordered),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 'blank' WHEN repeated THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][{white}]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows_ AS (
  SELECT conv_id, k, role, text, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS more FROM faults),
tally AS (
  SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
walk AS (
  {_states_sql(f"SELECT conv_id, n + 1 AS k, {start} FROM tally")}
  UNION ALL
  {_states_sql(f"SELECT p.conv_id, r.k AS k, {', '.join(_reads_sql(q) for q in STATES)} FROM walk p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k - 1")}),
best AS (SELECT conv_id, b0 FROM walk WHERE k = 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b0.cost, 0) AS BIGINT) AS cost,
       coalesce(b0.audit, '') AS audit, sha256(coalesce(array_to_string(b0.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN tally t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


#: The same as audited(repaired(conversations)), for DuckDB: paths carry their labels and lines.
REPAIR_SQL = _repair_sql()
