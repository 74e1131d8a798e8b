"""Language identification: words first, then ever shorter character n-grams.

A model has, per language, log frequencies of words and of character n-grams. A
known word scores its log frequency in each language; an unseen word falls back
to its longest n-grams that are known, shorter ones only if none of a length is.
A text's language is the one with the highest sum.

The model is fitted on a bounded sample: at most about TRAIN_ROWS labelled texts a
language, chosen by a hash of the id. Everything these texts hold is kept, so the model is
bounded by them. A worker process builds its lookup tables once, not once a task.

Defined cases: a text that is null, empty or without letters is `und` with score
0; with no labelled row to learn from, every text is `und`; ties between
languages go to the first in code-point order; labels that are null are never
learned; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

TRAIN_ROWS = 2000
LENGTHS = (5, 4, 3, 2, 1)
#: Unseen words whose scores a worker keeps.
CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def counts(train: DataFrame, text: str, label: str) -> DataFrame:
    """(lang, n, gram, count): words with n = 0, n-grams else; summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, Counter()).update(words_of(t))
        for lang, words in by.items():
            for n in (0, *LENGTHS):
                sums: Counter = Counter()
                if n:
                    for w, c in words.items():
                        for g in grams_of(w, n):
                            sums[g] += c
                else:
                    sums = words
                keys = list(sums)
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(part), pa.array([sums[k] for k in part], pa.int64())], names=["lang", "n", "gram", "count"])

    parts = train.select(text, label).mapInArrow(run, "lang string, n int, gram string, count long")
    return parts.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class Model:
    """Log frequencies by language, and the scores of words seen lately."""

    def __init__(self, rows: list[tuple[str, int, str, int]], mass: dict[tuple[str, int], int]):
        self.langs = sorted({r[0] for r in rows}, key=lambda s: s.encode())
        at = {lang: k for k, lang in enumerate(self.langs)}
        #: By length (0: words): the grams in order, and a row of scores each.
        self.grams: dict[int, list[str]] = {}
        self.matrix: dict[int, np.ndarray] = {}
        for n in (0, *LENGTHS):
            own = [r for r in rows if r[1] == n]
            grams = sorted({r[2] for r in own})
            place = {g: k for k, g in enumerate(grams)}
            total = np.array([mass.get((lang, n), 0) for lang in self.langs], float)
            counts = np.zeros((len(grams), len(self.langs)))
            for lang, _, g, c in own:
                counts[place[g], at[lang]] = c
            self.grams[n], self.matrix[n] = grams, np.log10((counts + 0.5) / (total + 0.5 * len(grams) + 1))
        self.prepare()

    def prepare(self) -> "Model":
        """The lookup tables, which do not travel."""
        self.place = {n: {g: k for k, g in enumerate(grams)} for n, grams in self.grams.items()}
        self._fill()
        return self

    def __getstate__(self):
        return {"langs": self.langs, "grams": self.grams, "matrix": self.matrix}

    def _fill(self) -> None:
        words = len(self.grams[0])
        self.known = dict(self.place[0])
        self.scores = np.zeros((words + CACHE, len(self.langs)))
        self.scores[:words] = self.matrix[0]
        self.n_scores = words

    def backoff(self, word: str) -> np.ndarray:
        """Mean score of the word's longest known n-grams; zeros if it has none."""
        for n in LENGTHS:
            get = self.place[n].get
            at = [k for g in grams_of(word, n) if (k := get(g)) is not None]
            if at:
                return self.matrix[n][at].mean(0)
        return np.zeros(len(self.langs))

    def _learned(self, word: str) -> int:
        k = self.n_scores
        self.scores[k] = self.backoff(word)
        self.known[word] = k
        self.n_scores += 1
        return k

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        seen = Counter(words)
        if self.n_scores + len(seen) > len(self.scores):
            self._fill()
            if len(seen) > CACHE:
                total = sum(c * (self.scores[self.known[w]] if w in self.known else self.backoff(w)) for w, c in seen.items())
                return self._best(total, len(words))
        get = self.known.get
        ids = [get(w, -1) for w in seen]
        if -1 in ids:
            ids = [self._learned(w) if k < 0 else k for w, k in zip(seen, ids)]
        total = np.fromiter(seen.values(), float, len(ids)) @ self.scores[ids]
        return self._best(total, len(words))

    def _best(self, total: np.ndarray, n: int) -> tuple[str, float]:
        k = int(np.argmax(total))
        odds = 10.0 ** np.maximum((total - total[k]) * min(1.0, 20.0 / n), -300)
        return self.langs[k], float(1.0 / odds.sum())


def fit(train: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about rows texts a language of train."""
    train = train.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(label) == lang, min(1.0, rows / n)).otherwise(share)
    drawn = train.where(F.pmod(F.xxhash64(F.lit(7), id_column), F.lit(1 << 20)) < share * (1 << 20))
    every = counts(drawn, text, label)
    found = every.toArrow()
    rows = list(zip(*(found.column(k).to_pylist() for k in range(4))))
    mass: Counter = Counter()
    for lang, n, _, c in rows:
        mass[lang, n] += c
    return Model(rows, mass)


#: Models that this worker process has prepared, by the name of their broadcast.
_READY: dict[str, Model] = {}


_OUT = "lang_pred string, score double"


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text; the model's size is bounded by its sample. One narrow pass."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = sent.value.prepare()
        own = _READY[name]
        for batch in batches:
            found = [own.predict(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_column, "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, {_OUT}")


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", modulus: int = 4, held: int = 2) -> DataFrame:
    """Fit on the folds other than held, predict all texts."""
    train = docs.select(id_column, text, label).where(F.coalesce(crc_fold(id_column, modulus), F.lit(-1)) != held)
    found = predict(docs, fit(train, id_column, text, label), id_column, text)
    return found.select(id_column, F.coalesce(crc_fold(id_column, modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
