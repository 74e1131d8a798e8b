"""Exact token counts of every prefix of a text, by dynamic programming.

Byte-pair encoding has one valid last token for every prefix of a piece: the
token that ends there, is reachable by merges, and is compatible with the last
token of the prefix before it (two tokens are compatible if encoding their joined
bytes gives the two back). So one left-to-right pass stores, for every prefix,
its last token and its token count, and the count of a whole text is the sum over
its pieces. Truncation and budget questions read the stored counts; nothing is
encoded again.

Defined cases: a null text counts as empty (0 bytes, 0 tokens, not over the
limit); special strings inside a text are single tokens, as in the library's
default; repeated rows give repeated results; long texts are counted whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published split pattern of byte-level BPE files of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same on texts of ASCII and Latin-1 letters only, for the quicker engine.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_PLAIN = re.compile(rf"[\x00-\x7f{_LATIN}]*")
_FULL = regex.compile(PATTERN)
_SPACE = regex.compile(r"\p{White_Space}+")
#: The pieces of the pattern that a cut splits in two.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Entries a worker's caches may hold before they are emptied.
CACHE_PIECES, CACHE_PAIRS = 400_000, 1_500_000
#: Longer pieces have a cache of their own, of so many bytes of text.
LONG_PIECE, LONG_BYTES = 256, 4 << 20
LIMIT = 1024


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1
    stands for itself, all other bytes for 256, 257, ... in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its token count; prefixes has the counts of all its byte prefixes."""

    def __init__(self, model: "PrefixModel"):
        self.model = model
        self.prefixes: dict[str, bytes] = {}
        self.long: dict[str, array] = {}
        self.long_bytes = 0

    def __missing__(self, piece: str) -> int:
        if piece in self.long:
            return self.long[piece][-1]
        return self.keep(piece, self.model.prefix_counts(piece.encode()))

    def keep(self, piece: str, counts: list[int]) -> int:
        """Store the counts of a piece; of long pieces, LONG_BYTES at a time."""
        if len(self) >= CACHE_PIECES:
            self.clear()
            self.prefixes.clear()
        n = counts[-1]
        if len(counts) <= LONG_PIECE:
            self.prefixes[piece] = bytes(counts)
            self[piece] = n
        else:
            if self.long_bytes + len(counts) > LONG_BYTES:
                self.long.clear()
                self.long_bytes = 0
            self.long[piece] = array("I", counts)
            self.long_bytes += len(counts)
        return n

    def counts(self, piece: str):
        found = self.prefixes.get(piece, self.long.get(piece))
        return self.model.prefix_counts(piece.encode()) if found is None else found


class PrefixModel:
    """Vocabulary, merges and the caches of one worker."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {as_bytes(t): k for k, t in enumerate(spec["model"]["vocab"])}
        n = self.n = len(vocab)
        #: pair of tokens (as one number) -> rank of its merge; of a merged token: its rank and halves
        self.rank: dict[int, int] = {}
        self.made = [-1] * n
        self.left, self.right = list(range(n)), list(range(n))
        for k, pair in enumerate(spec["model"]["merges"]):
            x, y = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            i, j, t = vocab[x], vocab[y], vocab[x + y]
            self.rank[i * n + j] = k
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = k, i, j
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self._split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pairs: dict[int, bool] = {}
        #: tokens that merges do reach: bytes, and those whose two halves are compatible but for their own merge
        self.tokens = {t: k for t, k in vocab.items() if len(t) == 1 or self.made[k] >= 0 and self._fits(self.left[k], self.right[k], self.made[k])}
        #: every tail of a token, with its own id if it is a token, else -1
        self.tails = {t[k:]: -1 for t in self.tokens for k in range(len(t))} | self.tokens
        self.pieces = _Pieces(self)
        self.longest_token = max(map(len, self.tokens))

    def _fits(self, a: int, b: int, own: int = -1) -> bool:
        """Does encoding the bytes of tokens a and b keep the border between them?

        The border is crossed if a merge of the two tokens that touch it comes
        before the merges that complete them. The merges of both are undone, the
        latest first; at equal rank the left one was made first. own: the rank of
        the merge of a and b themselves, which doesn't count.
        """
        n, rank, made = self.n, self.rank, self.made
        until_a = until_b = 1 << 60
        while True:
            k = rank.get(a * n + b, 1 << 60)
            if k != own and k < until_a and k <= until_b:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                until_a, a = made[a], self.right[a]
            else:
                until_b, b = made[b], self.left[b]
            if own >= 0 and max(until_a if until_a < 1 << 60 else -1, until_b if until_b < 1 << 60 else -1) > own:
                return False

    def prefix_counts(self, raw: bytes, last: list[int] | None = None, counts: list[int] | None = None) -> list[int]:
        """Token count of every byte prefix of a piece, the empty one first.

        last and counts: what is known of the first prefixes, continued in place.
        """
        if counts is None:
            last, counts = [-1], [0]
        n, tail, pairs = self.n, self.tails.get, self.pairs
        for i in range(len(counts), len(raw) + 1):
            found = []
            for j in range(i - 1, -1, -1):
                k = tail(raw[j:i])
                if k is None:
                    break
                if k >= 0:
                    found.append((j, k))
            for j, k in reversed(found):
                if not j:
                    break
                key = last[j] * n + k
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self._fits(last[j], k)
                if ok:
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {raw!r}")
            last.append(k)
            counts.append(counts[j] + 1)
        return counts

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Count pieces ahead, in byte order: a piece starts from the stored prefixes
        of the one before it, so what two pieces share is computed once. Returns the
        counts of the long ones."""
        known = self.pieces
        long = {p: known.long[p][-1] for p in pieces if p in known.long} if known.long else {}
        new = sorted(p.encode() for p in pieces if p not in known and p not in long)
        prefixes = known.prefixes
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            known.prefixes.clear()
        before, last, counts = b"", [-1], [0]
        for raw in new:
            k, most = 0, min(len(raw), len(before))
            while k < most and raw[k] == before[k]:
                k += 1
            del last[k + 1 :], counts[k + 1 :]
            piece, before = raw.decode(), raw
            self.prefix_counts(raw, last, counts)
            if len(raw) < LONG_PIECE:
                prefixes[piece] = bytes(counts)
                known[piece] = counts[-1]
            else:
                long[piece] = known.keep(piece, counts)
        return long

    def counts(self, texts: list[str], limit: int | None = None, block: int = 4 << 20) -> list[tuple[int, int]]:
        """Tokens of each text, and the length in code points of its longest prefix within
        the limit; some MB of texts at a time."""
        out: list[tuple[int, int]] = []
        get = self.pieces.__getitem__
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < block or end == at):
                size += len(texts[end])
                end += 1
            odd = {k for k in range(at, end) if self._split is not None and any(s in texts[k] for s in self.specials)}
            parts = [[] if k in odd else self.split(texts[k]) for k in range(at, end)]
            long = self.learn(set().union(*parts))
            for k, ps in enumerate(parts, at):
                if k in odd:
                    n = self.count(texts[k])
                else:
                    n = sum(long[p] if p in long else get(p) for p in ps) if long else sum(map(get, ps))
                cut = len(texts[k])
                if limit is not None and n > limit:
                    cut = PrefixTable(self, texts[k]).longest(limit) if k in odd else self._cut(ps, limit)
                out.append((n, cut))
            at = end
        return out

    def _cut(self, pieces: list[str], limit: int) -> int:
        """PrefixTable.longest, from the stored counts of the pieces around the limit: a
        piece has a token or more, and a run of white space has three pieces at most."""
        totals = [*accumulate(map(self.pieces.__getitem__, pieces[: limit + 1]))]
        first = max(0, bisect_right(totals, limit) - 3)
        near = pieces[first : first + 8]
        table = PrefixTable(self, "".join(near), near)
        return sum(map(len, pieces[:first])) + table.longest(limit - (totals[first - 1] if first else 0))

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _QUICK.findall(text)
        return _FULL.findall(text)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of ordinary text and special strings, in order."""
        if self._split is None or not any(s in text for s in self.specials):
            return [(text, False)]
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def count(self, text: str) -> int:
        if self._split is not None and any(s in text for s in self.specials):
            return sum(1 if special else sum(map(self.pieces.__getitem__, self.split(s))) for s, special in self.segments(text))
        return sum(map(self.pieces.__getitem__, self.split(text)))


class PrefixTable:
    """Stored counts of one text: where its pieces end (code points), running token
    counts, and by piece the counts of all prefixes.

    A prefix of the text splits as the text does, but for its end: a run of white
    space that ends the prefix is one piece; a contraction cut after its second
    character is two; a cut special string is ordinary text.
    """

    def __init__(self, model: PrefixModel, text: str, pieces: list[str] | None = None):
        """pieces: the first pieces of the text, if known, and without special strings."""
        self.model, self.text = model, text
        self.pieces: list[tuple[str, bool]] = [(p, False) for p in pieces or ()]
        for s, special in model.segments(text) if pieces is None else ():
            self.pieces += [(s, True)] if special else [(p, False) for p in model.split(s)]
        self.ends = list(accumulate(len(p) for p, _ in self.pieces))
        long = model.learn({p for p, special in self.pieces if not special})
        self.totals = list(accumulate(1 if special else long[p] if p in long else model.pieces[p] for p, special in self.pieces))
        self._at: tuple[int, int] | None = None
        self._counts: list[int] = []
        self._run_of: tuple[int, tuple[int, int, int]] = (-1, (0, 0, 0))

    @property
    def total(self) -> int:
        return self.totals[-1] if self.totals else 0

    def _before(self, k: int) -> tuple[int, int]:
        """Start and tokens of what stands before piece k."""
        return (self.ends[k - 1], self.totals[k - 1]) if k else (0, 0)

    def _stored(self, start: int, stop: int) -> list[int]:
        """Token counts of all prefixes, in code points, of text[start:stop], one piece."""
        if self._at != (start, stop):
            piece = self.text[start:stop]
            counts = self.model.pieces.counts(piece)
            if not piece.isascii():
                counts = [counts[n] for n in accumulate((len(c.encode()) for c in piece), initial=0)]
            self._at, self._counts = (start, stop), counts
        return self._counts

    def _blank(self, k: int) -> bool:
        """Is piece k white space alone, and no special string?"""
        return 0 <= k < len(self.pieces) and not self.pieces[k][1] and _SPACE.fullmatch(self.pieces[k][0]) is not None

    def _run(self, k: int) -> tuple[int, int, int]:
        """Of the run of white space that piece k belongs to: its first piece, start, end."""
        if k != self._run_of[0]:
            first = last = k
            while self._blank(first - 1):
                first -= 1
            while self._blank(last):
                last += 1
            opens = last < len(self.pieces) and not self.pieces[last][1] and _SPACE.match(self.pieces[last][0]) is not None
            self._run_of = k, (first, self._before(first)[0], self._before(last)[0] + opens)
        return self._run_of[1]

    def count(self, i: int) -> int:
        """Tokens of text[:i], from stored counts."""
        i = max(0, min(i, len(self.text)))
        if not i:
            return 0
        k = bisect_left(self.ends, i)  # the piece that holds the last code point
        piece, special = self.pieces[k]
        start, before = self._before(k)
        if special:
            return self.totals[k] if self.ends[k] == i else self._cut_special(k, i)
        if _SPACE.match(piece[i - start - 1]):
            k, start, end = self._run(k)
            return self._before(k)[1] + self._stored(start, end)[i - start]
        if self.ends[k] == i:
            return self.totals[k]
        if i - start == 2 and piece in CONTRACTIONS:
            return before + 2  # the quote and a letter
        return before + self._stored(start, self.ends[k])[i - start]

    def _cut_special(self, k: int, i: int) -> int:
        """A cut special string joins what stands before it as ordinary text: the last
        piece of the segment and the white space before it."""
        j = k
        if j and not self.pieces[j - 1][1]:
            j -= 1
            while self._blank(j - 1):
                j -= 1
        start, before = self._before(j)
        return before + self.model.count(self.text[start:i])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most budget tokens.

        The end lies in the first piece that passes the budget, or at the end of its
        run of white space; every position is answered by the stored counts, and
        no token is longer than the vocabulary's longest, which bounds the search.
        """
        k = bisect_right(self.totals, budget)
        if k == len(self.totals):
            return len(self.text)
        low, before = self._before(k)
        piece, special = self.pieces[k]
        high = self.ends[k]
        if not special and _SPACE.match(piece[-1]):
            high = max(high, self._run(k)[2])
        high = min(high, low + max(0, budget - before + 1) * self.model.longest_token)
        return next((i for i in range(high, low, -1) if self.count(i) <= budget), low)


_MODELS: dict[str, PrefixModel] = {}


def model_of(content: bytes) -> PrefixModel:
    key = hashlib.sha1(content).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PrefixModel(content)
    return _MODELS[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_OUT = "n_bytes long, n_tokens long, over_limit boolean, cut_chars long"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: bytes, tokens, whether over the limit, and cut_chars, the
    length in code points of the longest prefix within the limit.

    The tokenizer file (a few MB, fixed) goes out with the tasks; one narrow pass.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_content(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(sent.value)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for t, (n, cut) in zip(texts, model.counts(texts, limit)):
                row = (len(t.encode()), n, n > limit, cut)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_column, *(x.split()[0] for x in _OUT.split(", "))])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, {_OUT}")


def prefix_tables(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored counts as arrays: ends (code points) and totals (tokens up to there)."""
    sent = docs.sparkSession.sparkContext.broadcast(_content(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(sent.value)
        for batch in batches:
            tables = [PrefixTable(model, t or "") for t in batch.column(1).to_pylist()]
            whole = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.ends for t in tables], whole), pa.array([t.totals for t in tables], whole)], names=[id_column, "ends", "totals"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, f"`{id_column}` {kind}, ends array<int>, totals array<int>")
