"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are tagged as insult, threat, target (a person spoken to or of), negation or
reported speech; four small transducers read the tags of a clause:

* hostile: passes insults and threats on with their weights; nothing else counts,
* target: raises what stands within REACH words of a target,
* negation: lowers what stands within REACH words behind a negation,
* reported speech: lowers what stands behind a verb of saying in its clause.

They are composed lazily into one: a state of the composition is made when a clause first
reaches it. A clause's score is the weight its path sums; a text is scored by its clauses.

Which words insult is learned, in any language: words, and beginnings of words of STEMS
letters, whose presence in labelled texts goes with label 1 (a G test; the weight is the
smoothed log odds ratio). Tags of threat, target, negation and speech are the fixed lists
below. A logistic regression over what the clauses of a text sum to gives the score.

Both are fitted on at most TRAIN_ROWS rows a label, chosen by a hash of the id.

Defined cases: a null or empty text has no clauses and takes the score of that; with no
row of label 1 to learn from every score is 0, with none of label 0 every score is the
share of label 1 smoothed; labels other than 0 and 1 are not learned; a document with both
labels is learned twice; repeated rows give repeated results; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, crc_fold

TRAIN_ROWS = 4000
THRESHOLD = 0.3
STEMS = range(4, 9)
#: Least G statistic (one degree of freedom, about 1 in a million by chance) and documents.
LEAST_G, LEAST_DOCS = 24.0, 3
REACH = 3
THREAT, TARGETED, NEGATED, REPORTED = 2.0, 1.5, 0.25, 0.5

# Tags of English, German, French and Spanish words.
THREATS = "kill hurt destroy shoot stab burn beat punish murder töten vernichten schlagen erschießen tuer tuez frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself u he him his she her they them their those these people du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles tú usted ustedes ellos ellas vosotros".split()
NEGATIONS = "not no never nobody none without don't isn't aren't wasn't won't can't doesn't didn't nicht kein keine nie niemand ne pas jamais aucun aucune nunca jamás ningún ninguna nadie".split()
SPEECH = "said says say told tells tell called calls call wrote writes quoted quotes reported reports claims claimed according sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()

HOSTILE, TARGET, NEGATION, SPEAKING, OTHER = range(5)
TAGS = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: SPEAKING for w in SPEECH}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.,;:!?|()\n\"]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

# Each transducer: state, tag -> next state; and the factor its state puts on a hostile word.
_near = lambda own: lambda state, tag: REACH if tag == own else max(0, state - 1)
_TARGET = _near(TARGET), lambda state: TARGETED if state else 1.0
_NEGATION = _near(NEGATION), lambda state: NEGATED if state else 1.0
_SPEECH = (lambda state, tag: int(state or tag == SPEAKING)), lambda state: REPORTED if state else 1.0
START = (0, 0, 0)


@cache
def arc(state: tuple[int, int, int], tag: int) -> tuple[tuple[int, int, int], float]:
    """An arc of the composition: the next state, and the factor on a hostile word's weight."""
    steps = (_TARGET, _NEGATION, _SPEECH)
    factor = math.prod(value(s) for (_, value), s in zip(steps, state)) if tag == HOSTILE else 0.0
    return tuple(step(s, tag) for (step, _), s in zip(steps, state)), factor


def clause_score(words: list[tuple[int, float]]) -> float:
    """Weight of a clause of tagged words. A target may follow the word it goes with."""
    total, state = 0.0, START
    last = None  # (words since, weight) of a hostile word without a target yet
    for tag, weight in words:
        to, factor = arc(state, tag)
        if tag == HOSTILE:
            total += weight * factor
            last = None if state[0] else (0, weight * factor)
        elif last:
            last = (last[0] + 1, last[1]) if last[0] < REACH else None
            if last and tag == TARGET:
                total += last[1] * (TARGETED - 1)
                last = None
        state = to
    return total


def terms_of(word: str) -> list[str]:
    """A word as it is, and its beginnings."""
    return [f"={word}", *(word[:n] for n in STEMS if n <= len(word))]


class Lexicon:
    """Weights of words, found by the word or by its heaviest known beginning."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def tag(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            weight = max((self.weights.get(t, 0.0) for t in terms_of(word)), default=0.0)
            if word in THREATS:
                weight = max(weight, THREAT)
            found = (HOSTILE, weight) if weight else (TAGS.get(word, OTHER), 0.0)
            if len(word) <= 64:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """What a text's clauses sum to: log total, log count of matched clauses, the
        heaviest clause, matched words by kind (log), and weight a hundred words."""
        tokens = _TOKEN.findall(text.lower())
        tags = {t: self.tag(t) for t in set(tokens) if t[0].isalpha()}
        hostile = {t for t, (tag, _) in tags.items() if tag == HOSTILE}
        if not hostile:
            return [0.0] * FEATURES
        total, heaviest, matched, n_words, clause, hit = 0.0, 0.0, 0, 0, [], False
        for t in (*tokens, "."):
            found = tags.get(t)
            if found is not None:
                n_words += 1
                clause.append(found)
                hit = hit or found[0] == HOSTILE
                continue
            if hit:
                score = clause_score(clause)
                total, heaviest, matched = total + score, max(heaviest, score), matched + 1
            clause, hit = [], False
        return [math.log1p(total), math.log1p(matched), heaviest, math.log1p(len(hostile)), math.log1p(100 * total / n_words)]


FEATURES = 5


def learned(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, rows: int) -> DataFrame:
    """(text, label): at most rows labelled texts a label, by hash of the id."""
    usable = labels.select(F.col(id_column).alias("lid"), F.col(label_column).cast("int").alias("label")).where(F.col("lid").isNotNull() & F.col("label").isin(0, 1) & (crc_fold("lid", 4) != 2))
    picked = [usable.where(F.col("label") == k).orderBy(F.xxhash64("lid"), "lid").limit(rows) for k in (0, 1)]
    taken = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * rows ids at most
    return docs.join(taken, F.col(id_column) == F.col("lid")).select(binary(text_column).alias("text"), "label")


def lexicon(train: DataFrame, n: tuple[int, int]) -> dict[str, float]:
    """Weights of the words and beginnings that go with label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update({t for w in set(_WORD.findall(text.decode("utf-8", "replace").lower())) for t in terms_of(w[:64])})
        terms = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[k][t] for t in part], pa.int64()) for k in (0, 1))], names=["term", "clean", "toxic"])

    counts = train.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    part = lambda seen, of, k: F.when(seen > 0, seen * F.log(seen * sum(n) / (of * F.lit(n[k])))).otherwise(0.0)
    with_, without = F.col("a") + F.col("b"), F.lit(sum(n)) - F.col("a") - F.col("b")
    g = 2 * (part(F.col("a"), with_, 1) + part(F.col("b"), with_, 0) + part(n[1] - F.col("a"), without, 1) + part(n[0] - F.col("b"), without, 0))
    weight = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    kept = counts.where((F.col("a") >= LEAST_DOCS) & (g >= LEAST_G) & (weight > 0)).select("term", weight.alias("w"))
    return {r["term"]: r["w"] for r in kept.collect()}  # of texts bounded in number


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (the constant first) by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def featured(texts: DataFrame, weights: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns keep, and the features of column text."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(weights)
        for batch in batches:
            found = [words.features(t.as_py().decode("utf-8", "replace")) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    return texts.select(*keep, "text").mapInArrow(run, f"{', '.join(f'`{k}` {kinds[k]}' for k in keep)}, features array<double>")


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted): a row a document."""
    train = learned(docs, labels, id_column, text_column, label_column, rows)
    count = dict(train.groupBy("label").count().collect())
    n = (count.get(0, 0), count.get(1, 0))
    if all(n):
        weights = lexicon(train, n)
        fitted = featured(train, weights, ["label"]).collect()  # 2 * rows short rows at most
        w = logistic(np.array([r["features"] for r in fitted]), np.array([r["label"] for r in fitted], float))
    else:
        weights = {}
        w = np.array([math.log((n[1] + 0.5) / 0.5) if n[1] else -math.inf, *[0.0] * FEATURES])
    rows_ = docs.select(F.col(id_column).alias("id"), binary(text_column).alias("text"))
    linear = sum((F.col("features")[k] * float(c) for k, c in enumerate(w[1:])), F.lit(float(w[0])))
    score = 1 / (1 + F.exp(-linear))
    return featured(rows_, weights, ["id"]).select(F.col("id").alias(id_column), F.coalesce(crc_fold("id", 4) == 2, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
