"""Language model, similarity join, chat repair, extraction, mixing, pipeline."""

import itertools
import math
import os
import random
import sys
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import written_layouts
import written_pages
from pyspark.sql import functions as F

from gramlake.llm import chat, dom, extract, graph, jaccard, lm, mixing
from gramlake.llm.eliasfano import CODES, STEP, EliasFano, NgramTrie, dequantised, quantised

# Elias-Fano


def test_elias_fano_round_trip(tmp_path):
    r = np.random.default_rng(0)
    for n, top in ((0, 0), (1, 0), (1, 5), (5, 3), (1000, 10**9), (1000, 50), (777, 2**40), (64, 2**62)):
        v = np.sort(r.integers(0, top + 1, n)).astype(np.uint64)
        ef, end = EliasFano.from_buffer(EliasFano.build(v).to_bytes(), 0)
        assert (ef.get(np.arange(n)) == v).all()
        q = np.concatenate([v, v + np.uint64(1), r.integers(0, top + 2, 200).astype(np.uint64)])
        want = np.searchsorted(v, q, "left")
        assert (ef.next_geq(q) == want).all()
        assert (ef.find(q) == np.where(np.r_[v, np.uint64(2**63)][want] == q, want, -1)).all()
    assert (EliasFano.build(np.zeros(0)).next_geq(np.arange(3)) == 0).all()


def test_trie_by_brute_force(tmp_path):
    r = np.random.default_rng(0)
    triples = sorted({tuple(map(int, t)) for t in r.integers(0, 30, (3000, 3)) ** 2})
    pairs = sorted({t[:2] for t in triples})
    at = {p: k for k, p in enumerate(pairs)}
    p2, left, p3 = r.random(len(pairs)), r.random(len(pairs)), r.random(len(triples))
    x, y = np.array(pairs).T
    trie = NgramTrie.build(x, y, p2, left, np.array([at[t[:2]] for t in triples]), np.array([t[2] for t in triples]), p3)
    url = f"file://{tmp_path}/tries/0"
    trie.save(url)
    opened = NgramTrie.open(url)
    grid = np.array(list(itertools.product(sorted({*r.integers(0, 950, 30).tolist(), *x.tolist()}), repeat=2)))
    found = opened.pair(grid[:, 0], grid[:, 1])
    want2, want_left = dict(zip(pairs, quantised(p2))), dict(zip(pairs, quantised(left)))
    for a, b, c, d in zip(*grid.T, opened.codes_at(0, found), opened.codes_at(1, found)):
        assert (int(c), int(d)) == (int(want2.get((a, b), 0)), int(want_left.get((a, b), 0)))
    want3 = dict(zip(triples, quantised(p3)))
    for z in range(0, 900, 29):
        codes = opened.codes_at(2, opened.triple(found, np.full(len(found), z)))
        assert [int(c) for c in codes] == [int(want3.get((a, b, z), 0)) for a, b in grid]
    words = sorted({*x.tolist()})
    assert all(opened.successors_of(0, k).tolist() == [b for a, b in pairs if a == w] for k, w in enumerate(words))
    assert opened.successors_of(1, 7).tolist() == [c for a, b, c in triples if (a, b) == pairs[7]]
    assert np.abs(np.log10(dequantised(quantised(p3)) / p3)).max() <= STEP and quantised(np.array([1e-99, 0.0])).tolist() == [CODES, CODES]
    empty = NgramTrie.build(*(np.zeros(0, np.int64),) * 7)
    assert empty.pair(np.array([1]), np.array([2])).tolist() == [-1]


def lm_by_hand(docs, d=lm.DISCOUNT, mu=lm.MU):
    """The stated formulas over dictionaries."""
    tok = {i: (t or "").encode().lower().split() + [b""] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, w in tok.items():
        if not held[i]:
            s = [None, *w, 0]
            uni.update(w)
            bi.update(zip(s, w))
            tri.update(zip(s, s[1:], s[2:]))
    uni[None] = uni[b""]
    n, v = sum(uni.values()) - uni[None], len([w for w in uni if w is not None and uni[w]])
    kinds = Counter((a, b) for a, b, _ in tri)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    p2 = lambda w, a: (bi[a, w] + mu * p1(w)) / (uni[a] + mu)

    def p3(w, a, b):
        c = bi[a, b]
        if not c:
            return p2(w, b)
        return max(tri[a, b, w] - d, 0) / c + d * kinds[a, b] / c * p2(w, b)

    out = {}
    for i, w in tok.items():
        s = [None, *w]
        score = math.log10(p2(w[0], None)) + sum(math.log10(p3(x, a, b)) for a, b, x in zip(s, s[1:], s[2:]))
        out[i] = (held[i], len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score)
    known = [w for w in uni if w is not None]
    for a, b in list(kinds)[::7]:
        if b != b"":
            assert sum(p3(w, a, b) for w in known) + (1 - sum(map(p1, known))) * (d * kinds[a, b] / bi[a, b]) * mu / (uni[b] + mu) == pytest.approx(1)
    return out


@pytest.mark.parametrize("chunk", [40, None])
def test_lm_by_brute_force(make_docs, chunk):
    r = random.Random(1)
    texts = [" ".join(r.choice("The cat sat on a mat and the dog ran off xYz".split() + [f"w{k % 40}"]) for _ in range(r.randint(0, 30))) for k in range(120)] + [None, ""]
    docs = make_docs(texts)
    want = lm_by_hand(dict(enumerate(texts)))
    got = {x.doc_id: x for x in lm.scores(docs, chunk_tokens=chunk).collect()}
    assert len(got) == len(texts)
    for i, (held, n, known, total, base, score) in want.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, total)
        assert x.base_score == pytest.approx(base, abs=1e-9) and x.score == pytest.approx(score, abs=STEP * n)


def test_lm_contexts_sum_to_one_at_most():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.zipf(1.5, (400, 2)).clip(max=40), axis=0)
    x, y = pairs.T
    for mean in (1, 3, 50):
        c = rng.poisson(mean, (len(pairs), 12)) * (rng.random((len(pairs), 12)) < 0.4)
        c[c.sum(1) == 0, 0] = 1
        of, z = np.nonzero(c)
        asked = lm.Asked.__new__(lm.Asked)
        asked.x, asked.y, asked.of, asked.z, asked.c = x, y, of, z, c[of, z]
        asked.pairs, totals = np.arange(len(x)), c.sum(1)
        asked.of_x = np.array([totals[x == v].sum() for v in x])
        trie = asked.trie()
        at = trie.pair(x, y)
        share = np.bincount(of, dequantised(trie.codes_at(2, trie.triple(at[of], z))), len(x))
        whole = share + dequantised(trie.codes_at(1, at))
        assert whole.max() <= 1 + 1e-12 and whole.min() >= 1 - 0.09
        second = np.array([dequantised(trie.codes_at(0, at))[x == v].sum() + lm.MU / (asked.of_x[x == v][0] + lm.MU) for v in np.unique(x)])
        assert second.max() <= 1 + 1e-12 and second.min() >= 1 - 0.09


def test_lm_chunks(make_docs):
    """Small chunks give the same counts as one: the encoder is driven directly."""
    c = lm.Chunk([b"a", b"", b"b"], np.array([0, 2, 1, 0, 1]), np.array([3, 2]), np.array([True, False]), __import__("pyarrow").array([1, 2]))
    d = lm.Chunk.from_bytes(c.to_bytes())
    assert d.words == c.words and (d.ids == c.ids).all() and d.word_counts().tolist() == [1, 1, 1]
    for x in ([], [0], [1, 255, 256, 2**40]):
        assert lm.unplaned(lm.planes(np.array(x, np.int64))).tolist() == x


def test_lm_edges(odd_docs, no_docs):
    got = lm.scores(odd_docs).collect()
    assert len(got) == 8 and all(math.isfinite(x.score) for x in got)
    assert lm.scores(no_docs).count() == 0


# similarity join


def sets_by_hand(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_hand(texts):
    sets = {i: sets_by_hand(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        u = len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * u:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(seed, n):
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    base = [[f"g{g}w{k}" for k in range(r.choice((4, 5, 6, 9, 30, 120, 260)))] for g in range(12)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5, 8))):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        if r.random() < 0.2:
            w = w + passage
        if r.random() < 0.1:
            w = [x.upper() for x in w]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(make_docs, seed):
    texts = dict(enumerate(near_texts(seed, 220) + [None, "", "a b", "A  b", "a b c"]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(make_docs([*texts.values()])).collect()}
    assert got == components_by_hand(texts)


def test_partners_in_several_groups(make_docs, monkeypatch):
    """One text with more partners than a task's group holds: near copies and texts just too far."""
    monkeypatch.setattr(jaccard, "GROUP_TEXTS", 8)
    r = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)]
    for k in range(60):
        w = base.copy()
        for at in r.sample(range(120), 1 + k % 4):
            w[at] = f"x{k}_{at}"
        texts.append(" ".join(w))
    texts = dict(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(make_docs([*texts.values()])).collect()}
    assert got == components_by_hand(texts)


def test_prefix_and_list_bounds_lose_nothing():
    """Every pair that links shares as many indexed shingles as a pair needs."""
    texts = near_texts(7, 150)
    sets = [jaccard.shingle_set(t.encode()) for t in texts]
    common = np.sort(np.unique(np.concatenate(sets))[::3])
    prefixes = [set(jaccard.ordered_prefix(s, common).tolist()) for s in sets]
    for a, b in itertools.combinations(range(len(sets)), 2):
        inter = len(np.intersect1d(sets[a], sets[b]))
        if jaccard.linked(inter, len(sets[a]), len(sets[b])):
            assert len(prefixes[a] & prefixes[b]) >= 1 + min(len(sets[a]), len(sets[b])) // jaccard.SHARE
    r = np.random.default_rng(3)
    n = 300
    low = r.integers(1, 400, n)
    got = {(int(min(p)), int(max(p))) for x, y, _ in jaccard.list_pairs(np.arange(n), np.arange(n), low, low, np.full(n, -1)) for p in zip(x, y)}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * min(low[i], low[j]) >= 80 * max(low[i], low[j])}


def test_counts_with_true_positions_lose_no_link():
    """Near copies whose own shingles are rare and stand first, and whose shared ones are common."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(504)]
    texts = [" ".join(base)]
    for k in range(200):
        w = base.copy()
        for at in r.sample(range(len(w)), 8):
            w[at] = f"x{k}_{at}"
        texts.append(" ".join(w))
    sets = [jaccard.shingle_set(t.encode()) for t in texts]
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    common = tokens[counts >= jaccard.COMMON_TEXTS]
    lists = {}
    for k, x in enumerate(sets):
        for pos, token in enumerate(jaccard.ordered_prefix(x, common).tolist()):
            lists.setdefault(token, []).append((k, len(x), pos))
    shared = Counter()
    for entries in lists.values():
        k, n, pos = np.array(entries).T
        for x, y, _ in jaccard.list_pairs(k, k, n, n, pos):
            shared.update((int(min(p)), int(max(p))) for p in zip(x, y))
    links = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
            links += 1
            assert shared[a, b] >= 1 + min(len(sets[a]), len(sets[b])) // jaccard.SHARE
    assert links >= 200


def test_a_group_counts_as_pairs_do():
    sets = [jaccard.shingle_set(t.encode()) >> np.uint64(16) for t in near_texts(3, 120)]
    sets = [np.sort(s) for s in sets if len(s)]
    reach = [k / len(sets) for k in range(len(sets))]
    group = jaccard.Group([*range(len(sets))], reach, sets)
    for s in [*sets[::5], np.zeros(0, np.uint64)]:
        want = {k for k, x in enumerate(sets) if reach[k] >= 0.3 and jaccard.linked(len(np.intersect1d(s, x)), len(s), len(x))}
        assert {*group.links(s, 0.3).tolist()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_at_the_border_in_common_templates(make_docs, monkeypatch, seed):
    """Six templates with sixty unlike texts each, which make the template's shingles
    common and, with the lower ids, lead; and pairs of 0.80 to 0.92 that differ in rare ones."""
    r = random.Random(seed)
    texts = []

    def edited(base, n, mark):
        w, at = base.copy(), r.sample(range(2, len(base) - 2, 7), n)
        for k in at:
            w[k] = f"{mark}{k}"
        return " ".join(w)

    bases = [[f"t{b}w{k}" for k in range(150)] for b in range(6)]
    for b, base in enumerate(bases):
        texts += [edited(base, 14, f"f{b}q{k}v") for k in range(60)]
    for b, base in enumerate(bases):
        for k, (m, n) in enumerate(((2, 1), (1, 2), (1, 1), (2, 2), (3, 0))):
            tail = [f"own{b}k{k}t{j}" for j in range(40)]
            texts += [edited(base, m, f"l{b}{k}") + " " + " ".join(tail), edited(base, n, f"r{b}{k}") + " " + " ".join(tail)]
    monkeypatch.setattr(jaccard, "HOT_SHARE", 20)
    docs = dict(enumerate(texts))
    sets = [jaccard.shingle_set(t.encode()) for t in texts]
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    assert (counts >= jaccard.COMMON_TEXTS).sum() > 200
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(make_docs(texts)).collect()}
    want = components_by_hand(docs)
    assert sum(k != c for k, (_, c) in want.items()) >= 20
    assert got == want


def test_components_of_links(spark):
    r = random.Random(9)
    links = [(k, k + 1) for k in range(30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for a, b in links if a != b for k in (a, b)}


def test_join_edges(odd_docs, no_docs, make_docs):
    got = jaccard.near_duplicates(odd_docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[None] == {(0, None)} and by[4] == by[5] == {(977, 4)} and by[6] == {(2, 6)}
    assert len(got) == 8 and jaccard.near_duplicates(no_docs).count() == 0
    kept = jaccard.keep_first(make_docs(["a b c d e f", "x", "a b c d e f", None])).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [0, 1, 3]


# chat


def least_cost(roles):
    best = chat.FAR

    def go(k, state, cost, inserted):
        nonlocal best
        if cost >= best:
            return
        if k == len(roles) and state in chat.FINAL:
            best = cost
        if inserted < 2:
            for c in chat.LEGAL[state]:
                go(k, c, cost + chat.INSERT, inserted + 1)
        if k < len(roles):
            for b in (1, 2, 3):
                change = chat.KEEP if roles[k] == b else chat.RELABEL if roles[k] else chat.RELABEL_UNKNOWN
                if b == state:
                    go(k + 1, b, cost + chat.MERGE + change, 0)
                if b in chat.LEGAL[state]:
                    go(k + 1, b, cost + change, 0)

    go(0, 0, 0, 0)
    return best


def cost_of(roles, decoded, end):
    c = sum(len(i) * chat.INSERT + (chat.MERGE if "merge" in a else 0) + (0 if r == s else chat.RELABEL if r else chat.RELABEL_UNKNOWN) for r, (a, s, i) in zip(roles, decoded))
    return c + end


def test_repair_is_cheapest():
    r = random.Random(6)
    for _ in range(150):
        roles = [r.randint(0, 3) for _ in range(r.randint(1, 6))]
        cut = r.randint(0, len(roles))
        parts = [p for p in (roles[:cut], roles[cut:]) if p]
        behind = chat.behind([chat.summary(p) for p in parts])
        starts = chat.entries([chat.leaves(p, v) for p, v in zip(parts, behind)])
        decoded = [x for p, a, v in zip(parts, starts, behind) for x in chat.decode(p, a, v)]
        end = chat.closing(decoded[-1][1])[0]
        total = chat.ahead(roles, [chat.closing(b)[0] for b in range(4)])[0][0]
        assert total == least_cost(roles) == cost_of(roles, decoded, end)
        assert decoded == chat.decode(roles, 0, [chat.closing(b)[0] for b in range(4)])


def test_chat_query(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "user", "there"), (0, 2, "bot", "yes"), (1, 0, "assistant", "hello"), (2, 0, None, "x"), (2, None, "System", None), (None, 5, "user", "q"), (3, 0, "system", "only")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, seg string")
    for segment in (1, 2, 8192):
        got = chat.repair(df, segment=segment).collect()
        assert len(got) == len(rows)
        text = lambda c: "".join(x.rendered for x in sorted((x for x in got if x.conv_id == c), key=lambda x: (x.turn is not None, x.turn or 0)))
        assert text(0) == "<|user|>\nhi\nthere<|end|>\n<|assistant|>\nyes<|end|>\n"
        assert text(1) == "<|user|>\n<|end|>\n<|assistant|>\nhello<|end|>\n"
        assert text(2) == "<|system|>\n<|end|>\n<|user|>\nx<|end|>\n"
        assert text(None) == "<|user|>\nq<|end|>\n"
        assert text(3) == "<|system|>\nonly<|end|>\n<|user|>\n<|end|>\n"
    assert chat.repair(df.where("false")).count() == 0


@pytest.mark.parametrize("chars", [8 << 20, 40])
def test_places_do_not_depend_on_partitions(spark, monkeypatch, chars):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", chars)
    rng = random.Random(4)
    rows = [(rng.randint(0, 5), rng.choice([None, t // 3]), rng.choice(["user", "assistant", "bot", None]), "word " * rng.randint(0, 9)) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("2", "8", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(repr, chat.repair(df, segment=20).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    places = {}
    for r in chat.repair(df).collect():
        places.setdefault(r.conv_id, []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_long_turns_are_cut_into_small_segments(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * 200_000) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cut = chat.segments(df, "conv_id", "turn", "role", "text", chat.SEGMENT)
    assert max(r.n for r in cut.select(F.aggregate("ts", F.lit(0), lambda a, t: a + F.length(t["text"])).alias("n")).collect()) <= chat.SEGMENT_CHARS + 200_000
    out = chat.repair(df)
    assert out.count() == 300 and out.agg(F.max("place")).head()[0] == 299


def test_turns_without_numbers_are_cut_too(spark):
    """A conversation whose turns have no number, or all the same, fills segments in order."""
    rows = [(7, None if k % 2 else 1, ("user", "assistant")[k % 2], f"t{k:03d} <|user|> <\\|") for k in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.segments(df, "conv_id", "turn", "role", "text", 8).collect()
    assert max(len(p.ts) for p in parts) <= 8 and sum(len(p.ts) for p in parts) == 50
    ordered = [t for p in sorted(parts, key=lambda p: p.seg) for t in p.ts]
    assert [(t.turn, t.text) for t in ordered] == sorted(((t, x) for _, t, _, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    one, many = (chat.rendering(chat.repair(df, segment=n)).head().rendered for n in (8192, 3))
    assert one == many and one.count("<|user|>\n") == one.count("<|user|>") == 2 and one.count("<|assistant|>") == 1
    for t in ("<|end|>", "<\\|x|>", "a<b|", "<\\\\|", ""):
        assert chat.unescaped(chat.escaped(t)) == t and "<|" not in chat.escaped(t)


# extraction


def test_blocks():
    page = "<p>a &amp; b<p>c<br>d<ul><li>x<li>y</ul><script>var t='</p>';</script><!-- no --><div>e <b>f</b></div>t < u"
    assert [b.text for b in dom.blocks(page)] == ["a & b", "c d", "x", "y", "e f", "t < u"]
    assert dom.blocks("") == [] and [b.text for b in dom.blocks("plain \n text")] == ["plain text"]
    assert [b.text for b in dom.blocks("<p>open <script>never closed")] == ["open"]


def test_held_out_pages():
    field = extract.default_field()
    pages = extract.made_pages(200, seed=77)
    right = total = exact = 0
    for html, main in pages:
        page = dom.blocks(html)
        want, got = extract.labels_of(page, main), field.decode(page)
        right += sum(a == b for a, b in zip(want, got))
        total += len(page)
        exact += field.text(html) == main
    assert right / total > 0.99 and exact / len(pages) > 0.95


def test_attributes_by_the_rules_of_html():
    text = lambda h: [b.text for b in dom.blocks(h)]
    assert text("<p data-a=it's>one<p>two's<p>three") == ["one", "two's", "three"]
    assert text("<p a='x > y' b=\"z > w\" c>one</p><p d=\"it's\">two") == ["one", "two"]
    assert text('<p "odd" =x a==b/>one<p>two') == ["one", "two"]
    assert text("<p a = 'q' / >one <math><mi>x</mi></math><p>&amp;<b>amp;</b>") == ["one x", "&amp;"]
    assert text('<p>one<p title="never closed>two') == ["one"]
    assert dom._marks(" title='class=no' class='Yes it' HIDDEN id=z") == {"yes", "it", "z", "!hidden"}
    began = time.time()
    dom.blocks("<p " + "a='" * 100_000)
    dom.blocks("<p " + "a=b " * 100_000)
    assert time.time() - began < 5


def test_pages_written_by_hand():
    field = extract.default_field()
    kept = found = right = 0
    for html, main in written_pages.PAGES:
        want, got = Counter(main.replace("|", " ").split()), Counter(field.text(html).split())
        kept, found, right = kept + sum(want.values()), found + sum(got.values()), right + sum((want & got).values())
        print(round(sum((want & got).values()) / sum(want.values()), 2), round(sum((want & got).values()) / max(1, sum(got.values())), 2), field.text(html).replace("\n", "|"))
    assert right / kept >= 0.9 and right / found >= 0.9


def test_written_layouts(spark):
    """Forty pages in twenty layouts, none empty, each nearly whole and nearly clean."""
    rows = [(k, "u", html) for k, (html, _) in enumerate(written_layouts.PAGES)]
    got = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(rows) >= 40
    for k, (_, main) in enumerate(written_layouts.PAGES):
        want, found = Counter(main.replace("|", " ").split()), Counter(got[k].split())
        both = sum((want & found).values())
        assert found and both / sum(want.values()) >= 0.95 and both / sum(found.values()) >= 0.95, (k, got[k])


def test_frames_and_bodies_give_no_hints():
    text = "A first sentence that is long enough to be the whole of an article, or most of it."
    for start in ("<body class='has-sidebar'>", "<body class='home sidebar-right'>", "<body><div class='sidebar-layout'>", "<body id=footer-fixed>"):
        assert extract.default_field().text(f"<html>{start}<div class=page><article><p>{text}</p><p>{text}</p></article></div></html>") == f"{text}\n{text}"


def test_double_breaks_end_a_block():
    text = lambda h: [b.text for b in dom.blocks(h)]
    assert text("<div>a<br><br>b<br/>\n <br/>c<br>d</div>") == ["a", "b", "c d"]
    assert text("<p>a<br></p><p><br>b<br><br><br></p>c") == ["a", "b", "c"]


def test_labels_skip_lines_that_no_block_has():
    page = dom.blocks("<p>a</p><p>b</p><p>c</p><p>a</p>")
    assert extract.labels_of(page, "a\nmissing\nc") == [1, 0, 1, 0]


def test_viterbi_by_brute_force():
    field = extract.default_field()
    html, _ = extract.made_pages(1, seed=5)[0]
    page = dom.blocks(html)[:9]
    e = np.array([sum(field.weights[field.index[f]] for f in fs if f in field.index) for fs in extract.features(page)])
    score = lambda ys: field.start[ys[0]] + sum(e[k, y] for k, y in enumerate(ys)) + sum(field.trans[a, b] for a, b in zip(ys, ys[1:]))
    assert score(field.decode(page)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(page)))))


def test_extraction_query(spark):
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title of it</h1><p>Some long text here, with a stop.</p></article><footer>&copy; us</footer></body></html>"
    df = spark.createDataFrame([(0, "u", page, "c"), (1, None, None, "c"), (2, "u", "", "c"), (3, "u", page, "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract.main_text(df).collect()}
    main = "Title of it\nSome long text here, with a stop."
    assert got == {0: (main, len(main)), 1: ("", 0), 2: ("", 0), 3: (main, len(main))}
    assert extract.main_text(df.where("false")).count() == 0


# mixing


@pytest.mark.parametrize("seed, buckets", [(1, 1 << 16), (2, 4096), (3, 2), (4, 1), (5, 8)])
def test_mix_against_sql(make_docs, monkeypatch, seed, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    r = random.Random(seed)
    n = 400
    sources = [r.choice(["a", "b", "c", "é", None, "tiny"] if k % 50 == 0 else ["a", "a", "a", "b", "c", None]) for k in range(n)]
    texts = [None if k % 37 == 0 else " ".join("w" for _ in range(r.choice((0, 1, 5, 80, 400)))) for k in range(n)]
    docs = make_docs(texts, None, sources)
    got = sorted((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in mixing.mixture(docs).collect())
    c = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    c.register("documents", documents)
    rel = c.sql(mixing.MIX_SQL)
    at = [list(rel.columns).index(k) for k in ("doc_id", "size", "source_size", "target", "taken")]
    want = sorted((*(x[k] for k in at[:3]), round(x[at[3]], 6), x[at[4]]) for x in rel.fetchall())
    assert got == want
    by = {}
    for (i, size, total, target, taken) in got:
        by.setdefault(sources[i], []).append((size, total, target, taken))
    for rows in by.values():
        target = rows[0][2]
        assert target <= 3 * rows[0][1] + 1e-6 and all(t <= 3 * s for s, _, _, t in rows)
        assert abs(sum(t for *_, t in rows) - target) <= max(s for s, *_ in rows)
    assert sum(rows[0][2] for rows in by.values()) == pytest.approx(sum(s for rows in by.values() for s, *_ in rows))


def test_mix_comes_near_its_targets(spark):
    """Two per cent at most, where the document at the cut is a sixth of its source."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixture(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(rows) > 10 and all(abs(r.taken - r.target) <= 0.02 * r.target for r in rows)


def test_mix_of_many_sources(make_docs):
    docs = make_docs(["a b c d"] * 600, None, [f"s{k % 300:03}" for k in range(600)])
    rows = {x.source: x for x in mixing.mixture(docs).collect()}
    targets = sorted({round(x.target, 6) for x in rows.values()})
    assert len(rows) == 300 and targets == [4.0, 8.0, 12.0]
    assert all(round(x.target) == (4, 8, 12)[int(s[1:]) % 3] for s, x in rows.items())


def test_mix_edges(odd_docs, no_docs, make_docs):
    got = mixing.mixture(odd_docs).collect()
    assert len(got) == 8 and all(x.taken <= 3 * x.size for x in got)
    assert mixing.mixture(no_docs).count() == 0
    assert all(x.target == 0 and x.taken == 0 for x in mixing.mixture(make_docs([None, ""])).collect())
    out = mixing.mixed(make_docs(["a b c"] * 30, None, ["x"] * 20 + ["y"] * 10))
    taken = {(x.source): 0 for x in out.collect()}
    for x in out.collect():
        taken[x.source] += x.size
    assert taken["x"] == 30 and taken["y"] == 60
    assert mixing.mixed(odd_docs).count() >= 0


# pipeline


def test_pipeline_stages(spark, tmp_path, make_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    prose = lambda seed: " ".join(f"{random.Random(seed * 1000 + k).choice(['calm', 'river', 'stone', 'walk', 'green'])}{seed}x{k}" for k in range(80)) + "."
    item = "what is the name of the old grey tower above the northern bay of ships. the tower is called long meg by all"
    texts = [prose(k) for k in range(20)]
    texts += [texts[0], texts[1] + " extra", "short", prose(30) + " " + item, prose(31) + ' token = "deadbeefcafe00112233"', None]
    r.shuffle(texts)
    make_docs(texts, None, [("a", "b")[k % 2] for k in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "source mixing"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert seen[:4] == [24, 22, 21, 21]  # short and null; two copies; the leak; masking keeps all
    rows = docs.collect()
    assert not any("deadbeef" in x.text or "long meg" in x.text for x in rows)
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_entry_without_these_parts():
    """The entry module imports and lists the other queries when this part is gone."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['gramlake.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
