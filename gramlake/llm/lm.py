"""Language-model scores from an Elias-Fano n-gram trie of order 3, learned from the corpus.

Model, every level summing to one (after quantising: to one at most, see below):
    P1(w)       = (c(w) + 1) / (N + V + 1)
    P2(w | v)   = (c(v w) + MU P1(w)) / (c(v) + MU)                        Dirichlet prior
    P3(w | u v) = max(c(u v w) - DISCOUNT, 0) / c(u v) + left(u v) P2(w | v)
    left(u v)   = DISCOUNT * (distinct words after u v) / c(u v), 1 if c(u v) = 0
The tries hold the parts that n-grams bring, smoothed and quantised: c(v w) / (c(v) + MU),
the discounted share of a triple, and left. Codes round down, and left is what the shares
as stored leave of one, so the sum over a context never passes one and falls short by no
more than a step of the codes (8.7 %) of what is left and of P2. A text's score is the sum of log10 P over
its words and one end; the first word has the begin mark as its only context.

No row stands for a token and nothing is broadcast. Texts are encoded once into
chunks (a word list and a stream of local ids, a file each in the shared folder); the
shard of each distinct word gives its id and count. Then a chunk sends its distinct
pairs and triples, with training counts, to the shard of the pair (x, y) that begins
them. A shard adds up what chunks bring, builds its trie, writes it to the shared
folder, maps the file into memory and answers from it by context-relative successor
search; scores are summed inside chunks. A frequent word or n-gram so costs one entry
a chunk.

Rows that travel are chunks x shards; both grow with the square root of the corpus
(part_tokens), so the rows grow with the corpus and keep their size. The successors
of one pair stand in one shard, an entry a chunk and distinct successor.

Defined cases: a null text counts as empty (one token, the end); a null id is in
no held-out fold; repeated rows count as often as they occur; unknown words have
c = 0; long texts are read whole; an empty table gives an empty result; with no
training row all counts are 0 (N = V = 0).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, crc_fold, dropped, mix64, read_file, removed, shared_dir, staged, total_parallelism, write_file
from .eliasfano import NgramTrie, dequantised, quantised

#: Tokens of a chunk and of a shard, at least, and entries that a blob keeps as both grow.
PART_TOKENS, BLOB_ENTRIES = 1_000_000, 512
#: The end token as a word (no word is empty); ids of the begin mark, of what follows
#: an end, and of unknown words. Known words have higher ids.
END, BEGIN, NOTHING, UNKNOWN = b"", 0, 0, 1
#: Weight of the lower order after a word, and what is taken off each triple's count.
MU, DISCOUNT = 256.0, 0.75


def planes(x: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane: small values cost little."""
    x = np.ascontiguousarray(x, np.int64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return b"%c" % width + len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplaned(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(blob[9:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.int64).ravel()


def packed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpacked(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


class Chunk:
    """Texts as local word ids: words, ids (an end after each text), lengths, folds."""

    def __init__(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray, train: np.ndarray, doc_ids: pa.Array):
        self.words, self.ids, self.lengths, self.train, self.doc_ids = words, ids, lengths, train, doc_ids

    def to_bytes(self) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.table({"id": self.doc_ids})
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return packed(squeezed(b"\n".join(self.words)), planes(self.ids), planes(self.lengths), planes(self.train), squeezed(sink.getvalue().to_pybytes()))

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Chunk":
        words, ids, lengths, train, docs = unpacked(blob)
        rows = pa.ipc.open_stream(unsqueezed(docs)).read_all().column("id").combine_chunks()
        return cls(unsqueezed(words).split(b"\n"), unplaned(ids), unplaned(lengths), unplaned(train).astype(bool), rows)

    @property
    def token_train(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.token_train], minlength=len(self.words))


def chunks(docs: DataFrame, id_column: str, text: str, held, folder: str, chunk_tokens: int = PART_TOKENS) -> DataFrame:
    """(chunk, n): texts encoded, some chunk_tokens of them a file of folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            words: defaultdict[bytes, int] = defaultdict()
            words.default_factory = words.__len__
            return words, [], [], [], [], 0

        def row():
            key = uuid.uuid4().hex
            write_file(f"{folder}/chunks/{key}", Chunk([*words], np.concatenate(ids), np.array(lengths), np.array(train), pa.concat_arrays(rows)).to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n], pa.int64())], names=["chunk", "n"])

        words, ids, lengths, train, rows, n = fresh()
        for batch in batches:
            at = 0
            for k, (raw, is_held) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                tokens = raw.lower().split()
                tokens.append(END)
                ids.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                lengths.append(len(tokens))
                train.append(not is_held)
                n += len(tokens)
                if n >= chunk_tokens:
                    rows.append(batch.column(0).slice(at, k + 1 - at))
                    at = k + 1
                    yield row()
                    words, ids, lengths, train, rows, n = fresh()
            if at < batch.num_rows:
                rows.append(batch.column(0).slice(at))
        if lengths:
            yield row()

    return docs.select(F.col(id_column).alias("id"), binary(text).alias("raw"), held.alias("held")).mapInArrow(run, "chunk string, n long")


def spread(table: DataFrame, n: int) -> DataFrame:
    """The names of n chunks, a task for each."""
    return table.select("chunk").repartition(n, "chunk")


def word_requests(table: DataFrame, folder: str, shards: int) -> DataFrame:
    """(shard, chunk, blob): a chunk's distinct words of a shard with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                c = Chunk.from_bytes(read_file(f"{folder}/chunks/{key}").to_pybytes())
                counts = c.word_counts()
                shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in c.words), np.int64, len(c.words))
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                out = []
                for k in range(shards):
                    at = order[cuts[k] : cuts[k + 1]]
                    if len(at):
                        out.append((k, key, packed(squeezed(b"\n".join([c.words[i] for i in at])), planes(counts[at]))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.binary()))], names=["shard", "chunk", "blob"])

    return table.mapInArrow(run, "shard long, chunk string, blob binary")


def word_answers(requests: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, blob, n, v): ids and counts in the order asked; with chunk null,
    the shard's training tokens n and distinct words v. Frequent words get low ids."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = [(k, *unpacked(b)) for k, b in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist())]
        total: defaultdict[bytes, int] = defaultdict(int)
        for _, words, counts in asked:
            for w, c in zip(unsqueezed(words).split(b"\n"), unplaned(counts).tolist()):
                total[w] += c
        known = sorted((w for w, c in total.items() if c), key=lambda w: (-total[w], w))
        ids = {w: 2 + k * shards + shard for k, w in enumerate(known)}
        out = []
        for key, words, _ in asked:
            ws = unsqueezed(words).split(b"\n")
            out.append((key, shard, packed(planes(np.fromiter((ids.get(w, UNKNOWN) for w in ws), np.int64, len(ws))), planes(np.fromiter((total[w] for w in ws), np.int64, len(ws)))), 0, 0))
        out.append((None, shard, None, sum(total.values()), len(known)))
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("chunk", "shard", "blob", "n", "v"), zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))})

    return requests.groupBy("shard").applyInArrow(run, "chunk string, shard long, blob binary, n long, v long")


class Numbered:
    """A chunk whose words have their global ids and counts; the words themselves are gone."""

    def __init__(self, gid, count, end, ids, lengths, train, doc_ids):
        self.gid, self.count, self.end, self.ids, self.lengths, self.train, self.doc_ids = gid, count, end, ids, lengths, train, doc_ids
        self.first = np.r_[0, np.cumsum(lengths)[:-1]]

    @classmethod
    def of(cls, own: bytes, answers: dict[int, bytes], shards: int) -> bytes:
        chunk = Chunk.from_bytes(own)
        shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in chunk.words), np.int64, len(chunk.words))
        gid, count = np.full(len(shard), UNKNOWN, np.int64), np.zeros(len(shard), np.int64)
        for k, blob in answers.items():
            at = np.flatnonzero(shard == k)
            gid[at], count[at] = map(unplaned, unpacked(blob))
        if int(gid.max()) >> 31:
            raise OverflowError("more than 2^31 distinct words")
        end = np.array([chunk.words.index(END)])
        _, ids, lengths, train, docs = unpacked(own)
        return packed(planes(gid), planes(count), planes(end), ids, lengths, train, docs)

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Numbered":
        *parts, docs = unpacked(blob)
        gid, count, end, ids, lengths, train = map(unplaned, parts)
        rows = pa.ipc.open_stream(unsqueezed(docs)).read_all().column("id").combine_chunks()
        return cls(gid, count, int(end[0]), ids, lengths, train.astype(bool), rows)

    def context_counts(self) -> np.ndarray:
        """c(v) of the word before each token."""
        c = np.roll(self.count[self.ids], 1)
        c[self.first] = self.count[self.end]
        return c


class Grams:
    """The distinct known pairs (x, y) and triples of a chunk, in the order in which
    shards hold them, and for every token the places of its own: token y has the pair
    (x, y) with x the word before, and the triple (x, y, z) with z the word after."""

    def __init__(self, chunk: Numbered, shards: int):
        y = chunk.gid[chunk.ids]
        x, z = np.roll(y, 1), np.roll(y, -1)
        x[chunk.first] = BEGIN
        z[chunk.first + chunk.lengths - 1] = NOTHING
        some = (x != UNKNOWN) & (y != UNKNOWN)
        self.tokens = np.flatnonzero(some)
        key = (x[some].astype(np.uint64) << np.uint64(32)) | y[some].astype(np.uint64)
        pairs, first, of = np.unique(key, return_index=True, return_inverse=True)
        shard = ((mix64(pairs) >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pairs, self.of_token = pairs[order], place[of]
        self.first_token = self.tokens[first[order]]
        #: pairs [cuts[k], cuts[k + 1]) are those of shard k
        self.cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        next_known = z[some] != UNKNOWN
        self.with_triple = np.flatnonzero(next_known)
        key = (self.of_token[next_known].astype(np.uint64) << np.uint64(32)) | z[some][next_known].astype(np.uint64)
        triples, self.triple_of = np.unique(key, return_inverse=True)
        self.pair_of_triple, self.z = (triples >> np.uint64(32)).astype(np.int64), (triples & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.triple_cuts = np.searchsorted(self.pair_of_triple, self.cuts)

    def blob(self, k: int, *more: bytes) -> bytes:
        """Pairs and triples of shard k, and more."""
        p, t = slice(self.cuts[k], self.cuts[k + 1]), slice(self.triple_cuts[k], self.triple_cuts[k + 1])
        x, y = (self.pairs[p] >> np.uint64(32)).astype(np.int64), (self.pairs[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.bincount(self.pair_of_triple[t] - self.cuts[k], minlength=len(x))
        return packed(planes(np.diff(x, prepend=0)), planes(y), planes(sizes), planes(self.z[t]), *more)


def numbered(answers: DataFrame, folder: str, shards: int) -> DataFrame:
    """(chunk): chunks written anew with the ids and counts of their words."""

    def run(group: pa.Table) -> pa.Table:
        key = group.column("chunk")[0].as_py()
        found = dict(zip(group.column("shard").to_pylist(), group.column("blob").to_pylist()))
        write_file(f"{folder}/numbered/{key}", Numbered.of(read_file(f"{folder}/chunks/{key}").to_pybytes(), found, shards))
        return pa.table({"chunk": pa.array([key])})

    return answers.groupBy("chunk").applyInArrow(run, "chunk string")


def _numbered(folder: str, key: str) -> Numbered:
    return Numbered.from_bytes(read_file(f"{folder}/numbered/{key}").to_pybytes())


def gram_requests(table: DataFrame, folder: str, shards: int) -> DataFrame:
    """(shard, chunk, blob): a chunk's distinct n-grams of a shard, with the training count
    of each triple and the count of each pair's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                chunk = _numbered(folder, key)
                g = Grams(chunk, shards)
                trained = np.repeat(chunk.train, chunk.lengths)[g.tokens[g.with_triple]]
                c = np.bincount(g.triple_of[trained], minlength=len(g.z))
                of_x = chunk.context_counts()[g.first_token]
                shard_of = np.flatnonzero(np.diff(g.cuts)).tolist() or [0]  # a chunk without known n-grams is answered too
                out = [(k, key, g.blob(k, planes(c[g.triple_cuts[k] : g.triple_cuts[k + 1]]), planes(of_x[g.cuts[k] : g.cuts[k + 1]]))) for k in shard_of]
                cols = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.binary()))], names=["shard", "chunk", "blob"])

    return table.mapInArrow(run, "shard long, chunk string, blob binary")


class Asked:
    """What chunks ask of a shard, equal n-grams put together: pairs, triples as (place
    of the pair, z), their places by request, and the training counts."""

    def __init__(self, blobs: list[bytes]):
        keys, of, zs, cs, of_xs, self.sizes, at = [], [], [], [], [], [], 0
        for blob in blobs:
            dx, y, sizes, z, c, of_x = map(unplaned, unpacked(blob))
            keys.append((np.cumsum(dx).astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            of.append(np.repeat(np.arange(at, at + len(y)), sizes))
            zs.append(z)
            self.sizes.append((len(y), len(z)))
            at += len(y)
            cs.append(c)
            of_xs.append(of_x)
        self.pairs, first, self.pair_at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        triples, self.triple_at = np.unique((self.pair_at[np.concatenate(of)].astype(np.uint64) << np.uint64(32)) | np.concatenate(zs).astype(np.uint64), return_inverse=True)
        self.of, self.z = (triples >> np.uint64(32)).astype(np.int64), (triples & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.x, self.y = (self.pairs >> np.uint64(32)).astype(np.int64), (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.c = np.bincount(self.triple_at, np.concatenate(cs), minlength=len(triples))
        self.of_x = np.concatenate(of_xs)[first]

    def trie(self) -> NgramTrie:
        """The trie of what has a training count."""
        has = self.c > 0
        c = np.bincount(self.of, self.c, minlength=len(self.pairs))  # of a pair
        kept = c > 0
        place = np.cumsum(kept) - 1
        of, z = place[self.of[has]], self.z[has]
        c, of_x = c[kept], self.of_x[kept]
        share = np.maximum(self.c[has] - DISCOUNT, 0) / c[of]
        left = 1 - np.bincount(of, dequantised(quantised(share)), len(c))  # what the shares as stored leave
        return NgramTrie.build(self.x[kept], self.y[kept], c / (of_x + MU), left, of, z, share)

    def answers(self, trie: NgramTrie) -> list[bytes]:
        """The codes of each request's pairs and triples, in its order."""
        pair = trie.pair(self.x, self.y)
        p2, left, p3 = trie.codes_at(0, pair), trie.codes_at(1, pair), trie.codes_at(2, trie.triple(pair[self.of], self.z))
        out, i, j = [], 0, 0
        for pairs, triples in self.sizes:
            at = self.pair_at[i : i + pairs]
            out.append(packed(planes(p2[at]), planes(left[at]), planes(p3[self.triple_at[j : j + triples]])))
            i, j = i + pairs, j + triples
        return out


@dataclass(frozen=True)
class NgramModel:
    """Tries of all shards in a folder, and the counts of all training tokens and words."""

    folder: str
    shards: int
    n: int
    v: int


def gram_answers(requests: DataFrame, model: NgramModel) -> DataFrame:
    """(chunk, shard, blob): the codes of the asked pairs and triples, in their order, from
    the shard's trie, which is built and written first."""
    folder = model.folder

    def run(group: pa.Table) -> pa.Table:
        url = f"{folder}/tries/{group.column('shard')[0].as_py()}"
        asked = Asked(group.column("blob").to_pylist())
        asked.trie().save(url)
        return pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "blob": pa.array(asked.answers(NgramTrie.open(url)), pa.binary())})

    return requests.groupBy("shard").applyInArrow(run, "chunk string, shard long, blob binary")


_OUT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(answers: DataFrame, folder: str, model: NgramModel, id_column: str, kind: str) -> DataFrame:
    """Scores of all texts of numbered chunks, chunk by chunk, from their answers."""
    shards, n, v = model.shards, model.n, model.v

    def run(group: pa.Table) -> pa.Table:
        chunk = _numbered(folder, group.column("chunk")[0].as_py())
        g = Grams(chunk, shards)
        p2, left, p3 = np.zeros(len(g.pairs), np.uint8), np.zeros(len(g.pairs), np.uint8), np.zeros(len(g.z), np.uint8)
        for k, blob in zip(group.column("shard").to_pylist(), group.column("blob").to_pylist()):
            pairs, triples = slice(g.cuts[k], g.cuts[k + 1]), slice(g.triple_cuts[k], g.triple_cuts[k + 1])
            p2[pairs], left[pairs], p3[triples] = map(unplaned, unpacked(blob))
        size = len(chunk.ids)
        base = ((chunk.count + 1) / (n + 1 * (v + 1)))[chunk.ids]
        of_x = chunk.context_counts()
        second = np.zeros(size)
        second[g.tokens] = dequantised(p2)[g.of_token]
        p = second + MU / (of_x + MU) * base
        # what the pair before a token leaves, and the triple that the token ends
        mass, third = np.ones(size + 1), np.zeros(size + 1)
        found = left[g.of_token] > 0
        mass[g.tokens[found] + 1] = dequantised(left)[g.of_token[found]]
        third[g.tokens[g.with_triple] + 1] = dequantised(p3)[g.triple_of]
        mass[chunk.first], third[chunk.first] = 1.0, 0.0
        p = third[:-1] + mass[:-1] * p
        total = lambda x: np.add.reduceat(x, chunk.first)
        cols = {
            id_column: chunk.doc_ids,
            "held_out": pa.array(~chunk.train),
            "n_tokens": pa.array(chunk.lengths, pa.int64()),
            "n_known": pa.array(total((chunk.count > 0)[chunk.ids].astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(chunk.first), n), pa.int64()),
            "base_score": pa.array(total(np.log10(base))),
            "score": pa.array(total(np.log10(p))),
        }
        return pa.table(cols)

    return answers.groupBy("chunk").applyInArrow(run, f"`{id_column}` {kind}, {_OUT}")


def part_tokens(n_bytes: int) -> int:
    """Tokens of a chunk and of a shard for a corpus of n_bytes: chunks x shards blobs of
    BLOB_ENTRIES entries or more."""
    return max(PART_TOKENS, int((BLOB_ENTRIES * n_bytes / 6) ** 0.5))


def scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, chunk_tokens: int | None = None) -> DataFrame:
    """One row a text: learned from the folds other than held, all texts scored."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    is_held = F.coalesce(crc_fold(id_column, modulus) == held, F.lit(False))
    part = chunk_tokens or part_tokens(docs.agg(F.sum(F.octet_length(F.col(text)))).head()[0] or 0)
    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    table = staged(chunks(docs, id_column, text, is_held, folder, part), "chunks")
    tokens, count = table.agg(F.sum("n"), F.count("*")).head()
    if not tokens:
        return spark.createDataFrame([], f"`{id_column}` {kind}, {_OUT}")
    shards = max(total_parallelism(spark), -(-tokens // max(part, PART_TOKENS)))
    words = staged(word_answers(word_requests(spread(table, count), folder, shards), shards), "words")
    n, v = words.where("chunk is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).head()
    ready = staged(numbered(words.where("chunk is not null").select("chunk", "shard", "blob"), folder, shards), "numbered")
    dropped(words)
    removed(spark, f"{folder}/chunks")
    model = NgramModel(folder, shards, n, v)
    return score(gram_answers(gram_requests(spread(ready, count), folder, shards), model), folder, model, id_column, kind)
