"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items make an inverted index: a posting is an item and the BM25 weight
of the term in it, divided by the item's weight for itself, so that a passage
with all of an item's terms scores 1 and one threshold serves all items.
Postings are sorted by item and cut into blocks with their maximal weight.
Every document is cut into overlapping passages, long enough that any item lies
whole in one, and every passage is a query that retrieves all items at or above
the threshold; then question and answer of each are compared with the passage.

A passage is first held against three bounds, cheap ones first: the sum of its
terms' maxima, the same by block of items, then the WAND pivots of what is left.
None drops a passage that could reach the threshold.

Weights come from the statistics of all items (document frequencies, mean length),
gathered first, so that it does not matter over how many indexes items are spread.

Defined cases: null texts count as empty and hit nothing; items of fewer than
MIN_ITEM words must stand in a text whole, word by word, and items without words
match nothing; item ids may be of any type; repeated items each match; repeated
documents each appear; an empty table of items or documents gives an empty result;
long texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

K1, B = 1.2, 0.75
THRESHOLD = 0.6
BLOCK = 4
MIN_ITEM = 4
#: Overlaps that confirm a retrieved item.
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
#: Bytes of item text in one index; more items make more indexes, each its own pass.
SHARD_BYTES = 8 << 20

_WORD = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"\b(?:answer|solution)\s*[:=]", re.IGNORECASE)
_END = re.compile(r"[.!?]\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: at an answer mark, after the last question
    mark, or else the last sentence; with one sentence, its last quarter."""
    m = _ANSWER.search(text)
    if m and words_of(text[: m.start()]) and words_of(text[m.end() :]):
        return text[: m.start()], text[m.end() :]
    at = text.rfind("?") + 1
    if at and words_of(text[:at]) and words_of(text[at:]):
        return text[:at], text[at:]
    ends = [m.end() for m in _END.finditer(text.rstrip())]
    if ends and words_of(text[: ends[-1]]) and words_of(text[ends[-1] :]):
        return text[: ends[-1]], text[ends[-1] :]
    w = list(_WORD.finditer(text))
    cut = w[max(1, len(w) - max(1, len(w) // 4))].start() if len(w) > 1 else len(text)
    return text[:cut], text[cut:]


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Item:
    item_id: object
    words: list[str]
    question: set
    question_n: int
    answer: set
    answer_n: int


def make_item(item_id: object, text: str) -> Item:
    q, a = map(words_of, question_answer(text.lower()))
    return Item(item_id, words_of(text), shingles(q, 5), min(5, len(q)), shingles(a, 3), min(3, len(a)))


class Statistics:
    """Of all items, over all indexes: how many, their words, document frequencies."""

    def __init__(self):
        self.n, self.words, self.df = 0, 0, Counter()

    def add(self, items: list[Item]) -> "Statistics":
        self.n += len(items)
        self.words += sum(len(x.words) for x in items)
        for x in items:
            self.df.update({*x.words})
        return self

    def idf(self, term: str) -> float:
        d = self.df[term]
        return log(1 + (self.n - d + 0.5) / (d + 0.5))


class BlockMaxIndex:
    """Inverted index of items with block maxima; items of a few words apart, by their words."""

    def __init__(self, items: list[Item], block: int = BLOCK, statistics: Statistics | None = None):
        statistics = statistics or Statistics().add(items)
        short = [x for x in items if len(x.words) < MIN_ITEM]
        items = [x for x in items if len(x.words) >= MIN_ITEM]
        self.short: dict[int, dict[tuple[str, ...], list[Item]]] = {}
        for x in short:
            if x.words:
                self.short.setdefault(len(x.words), {}).setdefault(tuple(x.words), []).append(x)
        self.items, self.block = items, block
        n = len(items)
        mean = statistics.words / max(1, statistics.n)
        tfs = [Counter(x.words) for x in items]
        terms = {t for tf in tfs for t in tf}
        idf = {t: statistics.idf(t) for t in terms}
        postings: dict[str, list[tuple[int, float]]] = {t: [] for t in sorted(terms)}
        for i, (x, tf) in enumerate(zip(items, tfs)):
            norm = K1 * (1 - B + B * len(x.words) / mean)
            weights = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            whole = sum(weights.values())
            for t, w in weights.items():
                postings[t].append((i, w / whole))
        self.term = {t: k for k, t in enumerate(postings)}
        self.docs = [[i for i, _ in p] for p in postings.values()]
        self.weights = [[w for _, w in p] for p in postings.values()]
        self.bound = [max(w) for w in self.weights]
        self.blocks = -(-n // block)
        #: Terms of more than an eighth of the items; what they can add is bounded by
        #: the item, not by the passage: the largest share they have in one, by block.
        self.common = [8 * len(d) > n >= 16 for d in self.docs]
        shares = [0.0] * n
        self.tops: list[list[tuple[int, float]]] = []
        for d, w, common in zip(self.docs, self.weights, self.common):
            top: dict[int, float] = {}
            for i, x in zip(d, w):
                shares[i] += x * common
                top[i // block] = max(top.get(i // block, 0.0), x)
            self.tops.append([] if common else [*top.items()])
        self.common_tops = [max(shares[k : k + block]) for k in range(0, n, block)]
        self.common_most = max(shares, default=0.0)
        self.longest = max((len(x.words) for x in items), default=1)

    def block_bounds(self, rare: list[int]) -> dict[int, float]:
        """Upper bound of the score of any item, by block; blocks that are not listed
        hold no rare term and are bounded by common_tops."""
        out: dict[int, float] = {}
        for t in rare:
            for k, x in self.tops[t]:
                out[k] = out.get(k, self.common_tops[k]) + x
        return out

    def search(self, terms: set[int], theta: float) -> list[tuple[int, float]]:
        """All items whose score reaches theta: block-max WAND."""
        bound, docs, weights, common = self.bound, self.docs, self.weights, self.common
        theta -= 1e-9
        rare = [t for t in terms if not common[t]]
        if self.common_most + sum(map(bound.__getitem__, rare)) < theta:
            return []
        blocks = self.block_bounds(rare)
        if max(blocks.values(), default=0.0) < theta and self.common_most < theta:
            return []
        n = len(self.items)
        cursors = [[docs[t][0], t, 0] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                total += bound[t]
                if total >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            if blocks.get(d // self.block, self.common_tops[d // self.block]) < theta:
                aim = (d // self.block + 1) * self.block  # no item of this block can do it
            elif cursors[0][0] == d:
                score = sum(weights[t][p] for i, t, p in cursors if i == d)
                if score >= theta:
                    out.append((d, score))
                aim = d + 1
            else:
                aim = d
            left = []
            for c in cursors:
                if c[0] < aim:
                    c[2] = bisect_left(docs[c[1]], aim, c[2])
                    c[0] = docs[c[1]][c[2]] if c[2] < len(docs[c[1]]) else n
                if c[0] < n:
                    left.append(c)
            cursors = left
        return out

    def hits(self, text: str, theta: float = THRESHOLD) -> list[tuple[object, float, float, float, int]]:
        """Confirmed items of a text: id, best score, overlaps and the passage's first word."""
        words = words_of(text)
        found = [(self.items[i].item_id, *x) for i, x in sorted(self._retrieved(words, theta).items())] if self.items else []
        for n, known in self.short.items():
            seen: dict[tuple[str, ...], int] = {}
            for s in range(len(words) - n + 1):
                key = tuple(words[s : s + n])
                if key in known:
                    seen.setdefault(key, s)
            found += [(x.item_id, 1.0, 1.0, 1.0, s) for key, s in seen.items() for x in known[key]]
        return found

    def _retrieved(self, words: list[str], theta: float) -> dict[int, tuple[float, float, float, int]]:
        ids = list(map(self.term.get, words))
        step = max(32, self.longest)
        out: dict[int, tuple[float, float, float, int]] = {}
        for s in range(0, max(1, len(words) - step), step):
            terms = set(ids[s : s + 2 * step])
            terms.discard(None)
            for i, score in self.search(terms, theta):
                found = self.confirm(self.items[i], words[s : s + 2 * step])
                if found and (i not in out or score > out[i][0] + 1e-12):
                    out[i] = (score, *found, s)
        return out

    @staticmethod
    def confirm(item: Item, passage: list[str]) -> tuple[float, float] | None:
        q = len(item.question & shingles(passage, item.question_n)) / max(1, len(item.question)) if len(passage) >= item.question_n else 0.0
        a = len(item.answer & shingles(passage, item.answer_n)) / len(item.answer) if item.answer and len(passage) >= item.answer_n else float(not item.answer)
        return (q, a) if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP else None


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[BlockMaxIndex]:
    """One index for each shard_bytes of item text, so what is sent out has a bound;
    the driver holds one part at a time, and the vocabulary of all."""
    rows = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def part(k: int) -> list[Item]:
        found = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        return [make_item(i, t) for i, t in sorted(map(tuple, found.collect()), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))]

    statistics, last = Statistics(), []
    for k in range(shards):
        last = part(k)
        statistics.add(last)
    for k in range(shards):
        found = last if shards == 1 else part(k)
        if any(x.words for x in found):
            yield BlockMaxIndex(found, statistics=statistics)


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", theta: float = THRESHOLD) -> DataFrame:
    """(doc, item) rows with score and overlaps, for documents that hold an item."""
    kind, item_type = docs.schema[id_column].dataType.simpleString(), items.schema["item_id"].dataType
    schema = f"`{id_column}` {kind}, item_id {item_type.simpleString()}, score double, question_overlap double, answer_overlap double, first_word long"
    found = None
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            kinds = [to_arrow_type(item_type), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            for batch in batches:
                at, rows = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    found = index.hits(t or "", theta)
                    at += [k] * len(found)
                    rows += found
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_column, "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = docs.select(id_column, text).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, items: DataFrame, text: str = "text", theta: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold an item; columns as they were."""
    at = docs.columns.index(text)
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                yield batch.filter(pa.array([not index.hits(t or "", theta) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
