"""Quality rules as a short-circuit cascade.

Each rule is a predicate over the statistics of one text. Its cost (seconds a
text) and selectivity (share of texts it rejects) are estimated on a bounded
sample, and the rules run in order of rejection per cost; a text leaves at the
first rule that rejects it. The verdict is a conjunction, so it does not depend
on the order found.

Defined cases: a null text counts as empty; an empty text or one without words
has all statistics 0 and fails the base rule (fewer than 50 words); repeated
rows are judged one by one; an empty table gives an empty result; other columns
of the input are never read and, in keep(), pass through unchanged.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Rows that cost and selectivity are estimated on.
SAMPLE_ROWS = 400


class TextStats:
    """Statistics of one UTF-8 text; the dear ones are computed on demand."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        covered = end = 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextStats], bool]


#: Thresholds follow published web-corpus filters, loosened so that ordinary prose stays.
#: The bound on distinct words is a share of the words up to 2000, then grows with their square root.
DEFAULT_RULES = (
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 4 * len(t.lines)),
    Rule("shouting", lambda t: 2 * sum(map(bytes.isupper, t.words)) > t.n_words),
    Rule("distinct_words", lambda t: 20 * len(set(t.words)) < t.n_words and len(set(t.words)) ** 2 < 5 * t.n_words),
    Rule("no_letters", lambda t: 2 * sum(not x.isdigit() for x in t.words) < t.n_words),
)


def order_rules(sample: list[bytes], rules=DEFAULT_RULES) -> list[Rule]:
    """Rules by rejected share per second on the sample, the best first.

    A rule that rejects nothing there goes last, the cheapest first; with an
    empty sample the given order stays. Ties keep the given order.
    """
    if not sample:
        return list(rules)
    rated = []
    for k, rule in enumerate(rules):
        texts = [TextStats(x) for x in sample]
        for t in texts:
            t.words  # every text is split anyway
        began = time.perf_counter()
        rejected = sum(bool(rule.rejects(t)) for t in texts)
        cost = max(time.perf_counter() - began, 1e-9) / len(texts)
        rated.append((-rejected / len(texts) / cost, cost if not rejected else 0.0, k, rule))
    return [x[-1] for x in sorted(rated, key=lambda x: x[:3])]


def passes(stats: TextStats, ordered: list[Rule]) -> bool:
    """True if no rule rejects; stops at the first that does."""
    return not any(rule.rejects(stats) for rule in ordered)


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def sample_texts(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[bytes]:
    """At most rows texts, for estimates only: what the first partitions give."""
    return [bytes(x[0]) for x in docs.select(binary(text)).limit(rows).collect()]


def quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules=DEFAULT_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and verdict of every text: one narrow pass, nothing is shuffled."""
    ordered = order_rules(sample_texts(docs, text, sample_rows), rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for raw in batch.column(1).to_pylist():
                t = TextStats(raw)
                row = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, not t.base_failed and passes(t, ordered))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_column, *(x.split()[0] for x in _OUT.split(", "))])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), binary(text).alias("__raw")).mapInArrow(judge, f"`{id_column}` {kind}, {_OUT}")


def keep(docs: DataFrame, text: str = "text", rules=DEFAULT_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the base rule and the cascade keep, all columns as they were.

    Here the base rule is one more rule of the cascade, so a text that a cheaper
    rule rejects never pays for the repeat statistics.
    """
    all_rules = (*rules, Rule("short", lambda t: t.n_words < MIN_WORDS), Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words))
    ordered = order_rules(sample_texts(docs, text, sample_rows), all_rules)
    at = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = [passes(TextStats((x or "").encode()), ordered) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(verdict, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
