"""Fill-in-middle transformation, cut by a parallel automaton scan.

A text is cut between lines into prefix, middle and suffix and written in one of two
orders behind marks, so that a model learns to fill the middle.

The scan is an automaton over bytes that begins a line and recognises the marks. A
chunk of a text does not know the state it is entered in, so it emits one answer for
each: the state it leaves in, the lines it begins and the marks it completes. Answers
of neighbouring chunks compose, associatively; composed from the front they fix the
state that each chunk is entered in and the lines and code points before it. A cut
before line u is then looked up: only the chunk that begins line u is read again.
Texts over SPREAD bytes are dealt out as chunks over all tasks; shorter ones are
scanned, by the same functions, where they stand.

Marks and lines are ASCII, so bytes serve as code points; those are counted apart.

Defined cases: a null text counts as empty; an empty text or one that holds a mark
stays plain; a null id is hashed as no digits; repeated rows give repeated results;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, total_parallelism

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM = 7, 100, 50
CHUNK, SPREAD = 1 << 16, 1 << 20
#: Bytes of finished texts that a task holds before it hands them on.
HELD = 32 << 20

#: Classes of bytes: end of line, "<", a letter of a mark, ">", any other.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[10], _CLASS[ord("<")], _CLASS[[ord(c) for c in "PSM"]], _CLASS[ord(">")] = 0, 1, 2, 3
#: States: at the start of a line, inside, behind "<", behind "<" and a letter.
START, INSIDE, OPEN, LETTER = range(4)
STATES = range(4)
STEP = np.array([[START, OPEN, LETTER if s == OPEN else INSIDE, INSIDE, INSIDE] for s in STATES], np.uint8)
#: The state behind two bytes, whatever came before them.
_BEHIND = np.array([[STEP[STEP[START, a], b] for b in range(5)] for a in range(5)], np.uint8)
assert all((STEP[STEP[s, a], b] == _BEHIND[a, b]) for s in STATES for a in range(5) for b in range(5))


def states(chunk: np.ndarray, entry: int) -> np.ndarray:
    """The state before each byte of a chunk of classes entered in state entry."""
    out = np.empty(len(chunk), np.uint8)
    out[:1] = entry
    out[1:2] = STEP[entry, chunk[:1]][: len(out) - 1]
    out[2:] = _BEHIND[chunk[:-2], chunk[1:-1]]
    return out


def scan(data) -> tuple[list[int], list[int], list[int], int]:
    """For each state a chunk may be entered in: the state it leaves in, the lines it
    begins, the marks it completes; and its code points."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return list(STATES), [0] * 4, [0] * 4, 0
    cls = _CLASS[raw]
    rest = states(cls, START)[2:]
    lines, marks = int(np.count_nonzero(rest == START)), int(np.count_nonzero((rest == LETTER) & (cls[2:] == 3)))
    to, begun, done = [], [], []
    for s in STATES:
        first = states(cls[:2], s)
        begun.append(lines + int(np.count_nonzero(first == START)))
        done.append(marks + int(np.count_nonzero((first == LETTER) & (cls[:2] == 3))))
        to.append(int(STEP[states(cls[-2:], s)[-1], cls[-1]]))
    return to, begun, done, int(np.count_nonzero((raw & 0xC0) != 0x80))


def then(a, b):
    """What two chunks do one after the other."""
    return [b[0][a[0][s]] for s in STATES], [a[1][s] + b[1][a[0][s]] for s in STATES], [a[2][s] + b[2][a[0][s]] for s in STATES], a[3] + b[3]


def entries(answers) -> tuple[list[int], list[int], list[int], int]:
    """Of each chunk, by order: the state it is entered in, lines begun before it and code
    points before it (with the totals behind the last); and the marks of the whole."""
    state, lines, chars, marks = [], [0], [0], 0
    now = START
    for to, begun, done, n in answers:
        state.append(now)
        lines.append(lines[-1] + begun[now])
        chars.append(chars[-1] + n)
        marks += done[now]
        now = to[now]
    return state, lines, chars, marks


def cut(data: bytes, line: int, state: list[int], lines: list[int], chars: list[int], chunk: int) -> tuple[int, int]:
    """Bytes and code points before a line (the end, if there are no more lines)."""
    if line >= lines[-1]:
        return len(data), chars[-1]
    j = bisect_right(lines, line) - 1
    piece = np.frombuffer(data, np.uint8)[j * chunk : (j + 1) * chunk]
    at = int(np.flatnonzero(states(_CLASS[piece], state[j]) == START)[line - lines[j]])
    return j * chunk + at, chars[j] + int(np.count_nonzero((piece[:at] & 0xC0) != 0x80))


def arranged(data: bytes, h: tuple[int, int, int, int], found, chunk: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, list[bytes]]:
    """Lines, form, code points of prefix and middle, and the output in pieces."""
    state, lines, chars, marks = found
    n = lines[-1]
    if not data or marks or h[2] % 100 >= rate:
        return n, "plain", None, None, [data]
    (a, before), (b, behind) = (cut(data, line, state, lines, chars, chunk) for line in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    view = memoryview(data)
    prefix, middle, suffix = view[:a], view[a:b], view[b:]
    if h[3] % 100 < spm:
        return n, "spm", before, behind - before, [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]
    return n, "psm", before, behind - before, [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]


def draws(id_column: str, seed: int) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hash of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def composed(giants: DataFrame, chunk: int) -> DataFrame:
    """(key, state, lines, chars, marks) of each distinct text, its chunks scanned in tasks of their own."""
    spark = giants.sparkSession
    last = F.floor((F.octet_length("text") - 1) / chunk).cast("int")
    pieces = giants.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col("text"), k * chunk + 1, F.lit(chunk)))).alias("k", "piece"))
    dealt = pieces.repartition(total_parallelism(spark), "key", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_buffer()) for x in batch.column(2)]
            columns = [pa.array([r[j] for r in rows], pa.list_(pa.int64())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array([r[3] for r in rows], pa.int64())], names=["key", "k", "to", "begun", "done", "n"])

    answers = dealt.mapInArrow(run, "key binary, k int, to array<long>, begun array<long>, done array<long>, n long")
    each = answers.groupBy("key", "k").agg(F.first(F.struct("to", "begun", "done", "n")).alias("x"))  # copies of a text have one answer
    whole = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("xs"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [entries([(x["x"]["to"], x["x"]["begun"], x["x"]["done"], x["x"]["n"]) for x in xs]) for xs in batch.column(1).to_pylist()]
            columns = [pa.array([r[j] for r in rows], pa.list_(pa.int64())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[3] for r in rows], pa.int64())], names=["key", "state", "lines", "chars", "marks"])

    return whole.mapInArrow(compose, "key binary, state array<long>, lines array<long>, chars array<long>, marks long")


def transformed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): a row a document; rate and spm
    are percentages of documents changed, and of those written suffix first."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), binary(text_column).alias("text"), *draws(id_column, seed))
    schema = f"`{id_column}` {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, begin = [], 0, 0
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py()
                if batch.num_columns > 6:
                    found = tuple(batch.column(j)[k].as_py() for j in (6, 7, 8, 9))
                else:
                    found = entries([scan(data[at : at + chunk]) for at in range(0, len(data), chunk)])
                *numbers, pieces = arranged(data, tuple(batch.column(j)[k].as_py() for j in (2, 3, 4, 5)), found, chunk, rate, spm)
                held.append((*numbers, b"".join(pieces)))
                size += len(data)
                if size > HELD or k == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), *columns], names=[id_column, "n", "form", "prefix_chars", "middle_chars", "output"])
                    held, size, begin = [], 0, k + 1

    short = rows.where(F.octet_length("text") <= spread).mapInArrow(run, schema)
    giants = rows.where(F.octet_length("text") > spread).withColumn("key", F.unhex(F.sha2("text", 256)))
    known = giants.join(composed(giants.select("key", "text"), chunk), "key")
    long = known.select("id", "text", "h1", "h2", "h3", "h4", "state", "lines", "chars", "marks").mapInArrow(run, schema)
    return short.unionByName(long).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form."""
    parts = F.split(output, "<[PSM]>", -1)
    text = lambda order: F.transform(F.array(parts), lambda p: F.concat(*(p[k] for k in order)))[0]  # noqa: E731  one split a row
    return F.when(form == "psm", text((1, 3, 2))).when(form == "spm", text((2, 3, 1))).otherwise(output)


def digests(transformed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Hashes of the output and of the text rebuilt from it."""
    whole = restored(F.col("output"), F.col("form"))
    return transformed.select(id_column, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


#: The same as digests(transformed(documents)) with the default parameters, for DuckDB.
FIM_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, t, us, CAST(len(us) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS g FROM u),
c AS (
  SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain'
              WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
