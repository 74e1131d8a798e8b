"""Exact self-join of texts on the Jaccard similarity of their word 5-grams.

Two texts link when 100 |A and B| >= 80 |A or B|. The result is a component id
for every text; no table of all pairs is ever made.

1. Equal sets fall together: one representative stands for its class.
2. A global order of shingles puts those that many texts share last. Texts with
   similarity t share at least l shingles within their first n - ceil(t n) + l
   (prefix filter), so only prefixes are indexed, and pairs that share fewer than
   l = 1 + n / 32 indexed shingles are never compared.
3. Answers from similar sets: texts that share minimal hashes are compared with
   one leader each and form balls around it (distance 1 - J is a metric). Balls,
   not texts, stand in the inverted lists; what a leader's comparison settles
   (same component, or too far by the triangle inequality) is never computed for
   the members. Members are compared only where the inequality leaves room.
4. Inverted lists are sorted by size and cut into blocks that carry their size
   range and least position; blocks that the size bound, or the position bound with
   the l - 1 shared shingles that may stand before, rules out are skipped whole.
   Lists whose entries are all of one component are dropped, so a group of copies
   that holds a third of all rows costs one entry per chunk.
5. Candidates are compared exactly on their sets; components join the links.

Shingles are 64-bit hashes, lists travel as compressed blocks of arrays dealt by
hash of the shingle. What is broadcast: the list of common shingles (at most
COMMON_LIMIT), and id lists after a check of their count.

Defined cases: a text without words, or null, has an empty set, links with
nothing and is its own component; a text of one to four words is one shingle;
repeated rows and equal texts share a component; rows with a null id take the
component of their equal texts, else null; ties cannot arise; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, dropped, mix64, staged, total_parallelism
from .graph import components

WIDTH = 5
#: Similarity as numerator and denominator.
NUM, DEN = 80, 100
#: A shingle is common if so many texts have it; the list keeps the most common ones.
COMMON_TEXTS, COMMON_LIMIT = 8, 1 << 20
#: Within a block of texts, so many must have a shingle for it to be reported.
COMMON_LOCAL = 2
BLOCK_SHINGLES = 1 << 21
KEYS = 4
LIST_BLOCK = 64
#: A minimal hash with more than one in HOT_SHARE of the entries of shared hashes is hot.
HOT_SHARE = 1000
#: Ids up to this number are broadcast (8 bytes each), more are joined by key.
BROADCAST_IDS = 2_000_000
#: Shingles a shard of the inverted lists holds on average.
SHARD_SHINGLES = 1 << 20

_MULT = mix64(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_KEY_SEEDS = mix64(np.arange(101, 101 + KEYS, dtype=np.uint64))


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (UTF-8)."""
    words = raw.lower().split()
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), 7)] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    with np.errstate(over="ignore"):
        s = h[:n] * _MULT[0]
        for k in range(1, WIDTH):
            s += h[k : n + k] * _MULT[k]
    return np.unique(mix64(s))


#: A linked pair shares at least 1 + n // SHARE indexed shingles, n the smaller size.
SHARE = 32


def prefix_length(n: int) -> int:
    return min(n, n - -(-NUM * n // DEN) + 1 + n // SHARE)


def ordered_prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the global order: rare ones by hash, then common ones."""
    if len(common):
        at = np.searchsorted(common, shingles)
        at[at == len(common)] = 0
        is_common = common[at] == shingles
        shingles = np.concatenate([shingles[~is_common], shingles[is_common]])
    return shingles[: prefix_length(len(shingles))]


def linked(inter: int, a: int, b: int) -> bool:
    return DEN * inter >= NUM * (a + b - inter)


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Arrow batches of few rows, for rows that carry whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _batch(cols, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles of many different texts, sorted. Every block of texts reports those
    that COMMON_LOCAL of its sets have; any shingle of more texts than there are
    blocks, times that, is reported. It orders the work and has no part in results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def report():
            every = np.sort(np.concatenate(held))
            start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            counts = np.diff(np.r_[start, len(every)])
            many = counts >= COMMON_LOCAL
            return _batch((every[start][many].view(np.int64), counts[many]), (pa.int64(), pa.int64()), ["s", "c"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                s = shingle_set(raw)
                mark = xxhash.xxh64_intdigest(s.tobytes())
                if len(s) and mark not in seen:
                    seen.add(mark)
                    held.append(s)
                    size += len(s)
                    if size >= BLOCK_SHINGLES:
                        yield report()
                        held, seen, size = [], set(), 0
        if held:
            yield report()

    counts = docs.select(binary(text).alias("raw")).mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    top = counts.where(F.col("c") >= COMMON_TEXTS).orderBy(F.desc("c"), "s").limit(COMMON_LIMIT).select("s").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def sketches(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, n, fp, keys) of every row: set size, digest (null if empty), minimal hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, fps, keys = [], [], []
            for raw in batch.column(1).to_pylist():
                s = shingle_set(raw)
                ns.append(len(s))
                fps.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                keys.append([int(mix64(s ^ seed).min().astype(np.int64)) for seed in _KEY_SEEDS] if len(s) else [])
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((ns, fps, keys), kinds))], names=["id", "n", "fp", "keys"])

    return docs.select(F.col(id_column).cast("long").alias("id"), binary(text).alias("raw")).mapInArrow(run, "id long, n long, fp binary, keys array<long>")


def _sent(df: DataFrame) -> DataFrame:
    """A staged table, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _travelling(rows: DataFrame, own: tuple[str, ...], schema: str) -> DataFrame:
    """rows (own columns, raw) with the set of raw as 48-bit hashes s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packed = None, b""
        for batch in batches:
            out = []
            for raw in batch.column(len(own)).to_pylist():
                if raw != last:
                    last, packed = raw, (shingle_set(raw) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                out.append(packed)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(out, pa.binary())], names=[*own, "s"])

    return rows.select(*own, "raw").mapInArrow(run, f"{schema}, s binary")


def _travelled(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


#: Texts that meet one partner in a task; the partner's set is sent once for each so many.
GROUP_TEXTS = 64


def compared(pairs: DataFrame, docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """pairs (a, b, ...) with the exact sizes na, nb and the intersection inter.

    The set of a travels to b, and that of b once to each group of GROUP_TEXTS
    partners it has, so a text with very many partners is met in many tasks.
    Sets travel as 48-bit hashes. Written out.
    """
    spark = pairs.sparkSession
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP_TEXTS).alias("k"))
    salted = pairs.select("a", "b").join(groups.withColumnRenamed("b", "gb"), F.col("b") == F.col("gb"))
    visits = salted.select(F.col("a").alias("id"), F.col("b").alias("home"), F.pmod(F.xxhash64("a"), F.col("k")).alias("salt"))
    stays = groups.select(F.col("b").alias("id"), F.col("b").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"))
    routes = staged(visits.unionByName(stays), "routes", narrow=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for i, home, salt, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (home, salt) != at:
                    at, held = (home, salt), []
                s = _travelled(raw)
                if i == home:  # first of its group; several, if an id has several texts
                    held.append(s)
                    continue
                for b in held:
                    small, large = (s, b) if len(s) < len(b) else (b, s)
                    pos = np.searchsorted(large, small)
                    pos[pos == len(large)] = 0
                    out.append((i, home, len(s), len(b), int((large[pos] == small).sum())))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "na", "nb", "inter"])

    rows = docs.select(F.col(id_column).cast("long").alias("did"), binary(text).alias("raw")).join(_sent(routes), F.col("did") == F.col("id"))
    dealt = _travelling(rows, ("id", "home", "salt"), "id long, home long, salt long")
    dealt = dealt.repartition(total_parallelism(spark), "home", "salt").sortWithinPartitions("home", "salt", F.col("id") != F.col("home"))
    with _small_batches(spark, 512):
        out = staged(dealt.mapInArrow(compare, "a long, b long, na long, nb long, inter long"), "compared")
    dropped(routes)
    return out


#: Guests that meet a group of one ball's texts in a task.
GROUP_GUESTS = 256


class Group:
    """Sets of some texts as one inverted index."""

    def __init__(self, ids: list[int], reach: list[float], sets: list[np.ndarray]):
        self.ids, self.reach, self.n = np.array(ids), np.array(reach), np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.of = np.repeat(np.arange(len(sets)), self.n)[order]
        self.token, start = np.unique(every[order], return_index=True)
        self.start = np.r_[start, len(every)]

    def links(self, s: np.ndarray, least: float) -> np.ndarray:
        """Ids of the texts with a reach of least or more that link with the set s."""
        at = np.searchsorted(self.token, s)
        at[at == len(self.token)] = 0
        at = at[self.token[at] == s]
        sizes = self.start[at + 1] - self.start[at]
        entries = np.repeat(self.start[at] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(at) else np.zeros(0, np.int64)
        inter = np.bincount(self.of[entries], minlength=len(self.n))
        return self.ids[(DEN * inter >= NUM * (self.n + len(s) - inter)) & (self.reach >= least)]


def member_links(wide: DataFrame, in_ball: DataFrame, docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Links (a, b) between the texts of two balls, where the inequality leaves room.

    wide: (home, guest, d), leaders of two balls and their distance. Texts of the home
    ball stand in groups of GROUP_TEXTS, those of the guest ball visit each group and
    are counted against all of it at once; no row stands for a pair. Written out.
    """
    spark = wide.sparkSession
    limit = 1 - NUM / DEN + 1e-9
    sizes = in_ball.groupBy("of").agg(F.ceil(F.count("*") / GROUP_TEXTS).alias("k"), F.max("dx").alias("r")).withColumnRenamed("of", "gh")
    guests = wide.join(in_ball, F.col("guest") == F.col("of"), "left").select("home", "d", F.coalesce("x", "guest").alias("y"), F.coalesce("dx", F.lit(0.0)).alias("dy"))
    guests = guests.join(sizes, F.col("home") == F.col("gh")).select("home", "y", "k", (F.col("d") - F.col("dy") - limit).alias("least"), "r").where("r >= least")
    guests = staged(guests.groupBy("home", "y").agg(F.min("least").alias("v"), F.first("k").alias("k")), "guests", narrow=True)
    homes = guests.groupBy("home").agg(F.first("k").alias("k"), F.ceil(F.count("*") / GROUP_GUESTS).alias("m")).withColumnRenamed("home", "hh")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    visits = guests.join(homes.select("hh", "m"), F.col("home") == F.col("hh")).select(F.col("y").alias("id"), "home", upto("k").alias("salt"), F.pmod(F.xxhash64("y"), F.col("m")).alias("lane"), F.lit(False).alias("stays"), "v")
    stays = in_ball.join(homes, F.col("of") == F.col("hh")).select(F.col("x").alias("id"), F.col("of").alias("home"), F.pmod(F.xxhash64("x"), F.col("k")).alias("salt"), upto("m").alias("lane"), F.lit(True).alias("stays"), F.col("dx").alias("v"))
    routes = staged(visits.unionByName(stays), "routes", narrow=True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, reach, sets, group = None, [], [], [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i, home, salt, lane, stays, v, raw in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (home, salt, lane) != at:
                    at, ids, reach, sets, group = (home, salt, lane), [], [], [], None
                s = _travelled(raw)
                if stays:
                    ids.append(i)
                    reach.append(v)
                    sets.append(s)
                elif ids:
                    group = group or Group(ids, reach, sets)
                    found += [(i, int(x)) for x in group.links(s, v) if x != i]
            cols = list(zip(*found)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    rows = docs.select(F.col(id_column).cast("long").alias("did"), binary(text).alias("raw")).join(_sent(routes), F.col("did") == F.col("id"))
    own = ("id", "home", "salt", "lane", "stays", "v")
    dealt = _travelling(rows, own, "id long, home long, salt long, lane long, stays boolean, v double")
    dealt = dealt.repartition(total_parallelism(spark), "home", "salt", "lane").sortWithinPartitions("home", "salt", "lane", F.desc("stays"))
    with _small_batches(spark, 512):
        out = staged(dealt.mapInArrow(meet, "a long, b long"), "met")
    dropped(routes, guests)
    return out


_IS_LINK = f"{DEN} * inter >= {NUM} * (na + nb - inter)"
_DISTANCE = "1 - inter / (na + nb - inter)"


def star_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): each representative a with the least one b that shares a minimal hash,
    where at least two of their hashes agree and sizes allow a link."""
    keyed = reps.select("id", "n", "keys", F.posexplode("keys").alias("k", "key"))
    lead = keyed.groupBy("k", "key").agg(F.min(F.struct("id", "n", "keys")).alias("l"), F.count("*").alias("m")).where("m > 1").select(F.col("k").alias("lk"), F.col("key").alias("lkey"), "l", "m")
    lead = staged(lead, "leads", narrow=True)
    # keys of more than a thousandth of all entries, a few thousand at most, meet their lead by broadcast
    many = (lead.agg(F.sum("m")).head()[0] or 0) // HOT_SHARE
    hot, cold = F.broadcast(lead.where(F.col("m") > many)), lead.where(F.col("m") <= many)
    same_key = (F.col("k") == F.col("lk")) & (F.col("key") == F.col("lkey"))
    pairs = keyed.join(hot, same_key).unionByName(keyed.join(hot, same_key, "left_anti").join(cold, same_key)).where("id > l.id")
    same = F.size(F.filter(F.zip_with("keys", F.col("l.keys"), lambda x, y: x == y), lambda t: t))
    fits = (DEN * F.least("n", F.col("l.n")) >= NUM * F.greatest("n", F.col("l.n"))) & (same >= 2)
    return pairs.where(fits).select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct()


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in arrays)
    return len(arrays[0]).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


_DTYPES = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    raw, out, at = pa.decompress(blob[8:], size, codec="zstd", asbytes=True), [], 0
    for t in _DTYPES:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def list_pairs(ball: np.ndarray, comp: np.ndarray, low: np.ndarray, high: np.ndarray, pos: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Pairs of balls of different components in one inverted list, with the smaller size.

    Entries (ball, component, least and largest set size, position of the shingle,
    -1 if the ball has several sets) are sorted by size; block by block, those are
    skipped whose sizes cannot meet, or whose positions leave too few shingles. The
    count asks for 1 + n // SHARE shared shingles, n the smaller size, so n // SHARE
    of them may stand before a position that has to be kept.
    """
    order = np.lexsort((pos, low))
    ball, comp, low, high, pos = (x[order] for x in (ball, comp, low, high, pos))
    n, out = len(ball), []
    starts = range(0, n, LIST_BLOCK)
    tops = [int(high[s : s + LIST_BLOCK].max()) for s in starts]
    rest = np.where(pos >= 0, high - pos, high)  # shingles from this position on, at most
    rests = [int(rest[s : s + LIST_BLOCK].max()) for s in starts]
    for i, s in enumerate(starts):
        a = slice(s, s + LIST_BLOCK)
        for j in range(i, len(tops)):
            t = starts[j]
            b = slice(t, t + LIST_BLOCK)
            if DEN * tops[i] < NUM * int(low[t]):
                break  # all later blocks hold larger sets only
            need = NUM * (int(low[s]) + int(low[t])) / (NUM + DEN)
            if min(rests[i], rests[j]) + min(tops[i], tops[j]) // SHARE < need - 1e-9:
                continue
            ok = (comp[a][:, None] != comp[b][None]) & (DEN * high[a][:, None] >= NUM * low[b][None]) & (DEN * high[b][None] >= NUM * low[a][:, None])
            left = np.minimum(rest[a][:, None], rest[b][None]) + np.minimum(high[a][:, None], high[b][None]) // SHARE
            ok &= left * (NUM + DEN) >= NUM * (low[a][:, None].astype(np.int64) + low[b][None])
            if i == j:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            x, y = np.nonzero(ok)
            if len(x):
                out.append((ball[a][x], ball[b][y], np.minimum(low[a][x], low[b][y])))
    return out


def ball_pairs(entries: DataFrame, common: np.ndarray, shards: int) -> DataFrame:
    """Candidate pairs (a > b) of balls from the inverted lists of all prefixes, those
    that share as many indexed shingles as a link needs.

    entries: (ball, comp, raw).
    """
    sent = entries.sparkSession.sparkContext.broadcast(common)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def report():
            lens = [len(x[0]) for x in held]
            token = np.concatenate([x[0] for x in held])
            ball, comp, n = (np.repeat(np.array([x[k] for x in held], np.int64), lens) for k in (1, 2, 3))
            pos = np.concatenate([np.arange(k) for k in lens])
            order = np.lexsort((ball, token))
            token, ball, comp, n, pos = token[order], ball[order], comp[order], n[order], pos[order]
            start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (ball[1:] != ball[:-1])])
            low, high = np.minimum.reduceat(n, start), np.maximum.reduceat(n, start)
            counts = np.diff(np.r_[start, len(token)])
            token, ball, comp, pos = token[start], ball[start], comp[start], np.where(counts > 1, -1, pos[start])
            shard = (token >> np.uint64(20)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            blobs, ids = [], []
            for k in range(shards):
                at = order[cuts[k] : cuts[k + 1]]
                if len(at):
                    ids.append(k)
                    blobs.append(_packed(token[at], ball[at], comp[at], low[at].astype(np.int32), high[at].astype(np.int32), pos[at].astype(np.int32)))
            return _batch((ids, blobs), (pa.int64(), pa.binary()), ["shard", "blob"])

        for batch in batches:
            for ball, comp, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                s = shingle_set(raw)
                n = len(s)
                if not n:
                    continue
                s = ordered_prefix(s, sent.value)
                held.append((s, ball, comp, n))
                size += len(s)
                if size >= BLOCK_SHINGLES // 2:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    def join(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("blob").to_pylist()]
        token, ball, comp, low, high, pos = (np.concatenate([p[k] for p in parts]) for k in range(6))
        del parts
        order = np.argsort(token, kind="stable")
        token, comp = token[order], comp[order]
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        ends = np.r_[start[1:], len(token)]
        mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
        found, size = [], 0

        def summed(parts):
            """Pairs with the number of shared shingles and the least size."""
            a, b, c, m = (np.concatenate([p[k] for p in parts]) for k in range(4))
            order = np.lexsort((b, a))
            a, b, c, m = a[order], b[order], c[order], m[order]
            at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return a[at], b[at], np.add.reduceat(c, at), np.minimum.reduceat(m, at)

        for s, e in zip(start[mixed], ends[mixed]):
            at = order[s:e]
            for x, y, m in list_pairs(ball[at], comp[s:e], low[at], high[at], pos[at]):
                found.append((np.maximum(x, y), np.minimum(x, y), np.ones(len(x), np.int64), m.astype(np.int64)))
                size += len(x)
            if size > BLOCK_SHINGLES:
                found = [summed(found)]
                size = len(found[0][0]) // 2
        cols = summed(found) if found else [np.zeros(0, np.int64)] * 4
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "c", "m"), cols)})

    dealt = entries.select("ball", "comp", "raw").mapInArrow(deal, "shard long, blob binary")
    counted = dealt.groupBy("shard").applyInArrow(join, "a long, b long, c long, m long").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("m").alias("m"))
    return counted.where(F.col("c") >= 1 + F.floor(F.col("m") / SHARE)).select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_column, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    common = common_shingles(docs, text)
    sketch = staged(sketches(docs, id_column, text), "sketch")
    classes = staged(sketch.where("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("cn")), "classes", narrow=True)
    size = classes.agg(F.sum(F.expr(f"cn - ceil({NUM} * cn / {DEN}) + 1 + floor(cn / {SHARE})"))).head()[0] or 0
    of = sketch.where("fp is not null").join(classes.select(F.col("fp").alias("cfp"), "rep"), F.col("fp") == F.col("cfp"))
    reps = of.where("id = rep").select("id", "n", "keys")
    copies = staged(of.where("id <> rep").select(F.col("id").alias("copy")).distinct(), "copies", narrow=True)

    # balls around leaders, and the components that they settle
    stars = compared(staged(star_pairs(reps), "stars", narrow=True), docs, id_column, text)
    near = stars.where(_IS_LINK).select("a", "b", F.expr(_DISTANCE).alias("d"))
    balls = staged(near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(F.col("a").alias("x"), F.col("m.b").alias("ball"), F.col("m.d").alias("d")), "balls", narrow=True)
    first = staged(components(near), "components", narrow=True)
    known = staged(first.join(balls, F.col("node") == F.col("x"), "left").select(F.col("node").alias("x"), "component", F.coalesce("ball", "node").alias("ball"), F.coalesce("d", F.lit(0.0)).alias("d")), "known", narrow=True)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), binary(text).alias("raw")).where("id is not null")
    texts = texts.join(_sent(copies), F.col("id") == F.col("copy"), "left_anti").join(_sent(known), F.col("id") == F.col("x"), "left")
    entries = texts.select(F.coalesce("ball", "id").alias("ball"), F.coalesce("component", "id").alias("comp"), "raw")
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARD_SHINGLES))  # few: a pair's count comes in as many parts

    # candidates between components: balls first, members where there is room
    candidates = staged(ball_pairs(entries, common, shards), "candidates", narrow=True)
    measured = compared(candidates, docs, id_column, text).withColumn("d", F.expr(_DISTANCE))
    limit = 1 - NUM / DEN + 1e-9
    joined = lambda found: components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    links = measured.where(_IS_LINK).select("a", "b")
    final = staged(joined(links), "components", narrow=True)
    radius = known.groupBy("ball").agg(F.max("d").alias("r")).where("r > 0")
    ra, rb = (radius.select(F.col("ball").alias(f"ball_{k}"), F.col("r").alias(f"r_{k}")) for k in "ab")
    wide = measured.where(f"not ({_IS_LINK})").join(ra, F.col("a") == F.col("ball_a"), "left").join(rb, F.col("b") == F.col("ball_b"), "left")
    ca, cb = (final.select(F.col("node").alias(f"node_{k}"), F.col("component").alias(f"comp_{k}")) for k in "ab")
    wide = wide.join(ca, F.col("a") == F.col("node_a"), "left").join(cb, F.col("b") == F.col("node_b"), "left")
    wide = wide.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))  # others are joined by now
    wide = wide.na.fill(0.0, ["r_a", "r_b"]).where((F.col("r_a") + F.col("r_b") > 0) & (F.col("d") <= limit + F.col("r_a") + F.col("r_b"))).select("a", "b", "d")
    in_ball = staged(known.select("x", F.col("ball").alias("of"), F.col("d").alias("dx")).unionByName(known.select(F.col("ball").alias("x"), F.col("ball").alias("of"), F.lit(0.0).alias("dx"))).distinct(), "in-balls", narrow=True)
    sizes = in_ball.groupBy("of").agg(F.count("*").alias("size"))
    sa, sb = (sizes.select(F.col("of").alias(f"of_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    wide = wide.join(sa, F.col("a") == F.col("of_a"), "left").join(sb, F.col("b") == F.col("of_b"), "left")
    a_larger = F.coalesce("size_a", F.lit(0)) >= F.coalesce("size_b", F.lit(0))
    wide = staged(wide.select(F.when(a_larger, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(a_larger, F.col("b")).otherwise(F.col("a")).alias("guest"), "d"), "wide", narrow=True)
    if wide.count():
        found = member_links(wide, in_ball, docs, id_column, text)
        final = staged(joined(links.unionByName(found)), "components", narrow=True)

    of_class = classes.join(final, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("cfp"), F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("id", "n", "fp").join(of_class, F.col("fp") == F.col("cfp"), "left")
    return out.select(F.col("id").cast(docs.schema[id_column].dataType).alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id.

    Columns stay as they were; rows that repeat that id stay with it.
    """
    found = near_duplicates(docs, id_column, text)
    gone = staged(found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("__gone")).distinct(), "gone", narrow=True)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_column) == F.col("__gone"), "left_anti")
