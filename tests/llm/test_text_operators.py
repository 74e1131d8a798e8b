"""Secrets, decontamination, tokens, quality rules, languages."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from gramlake.llm import decontam, langid, quality, secrets, tokens


# secrets


def base_by_hand(t):
    """The stated rules, one position at a time."""
    out = []
    at = 0
    pat = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    while at < len(t):
        m = pat.match(t, at)
        if m:
            if len(m[2]) >= 8:
                out.append((m.start(), 0, m.end(), "assign"))
            at = m.end()
        else:
            at += 1
    for k, (p, n, name) in enumerate(((r"AKIA[A-Z0-9]+", 16, "access"), (r"[0-9a-f]+", 32, "hex")), 1):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(p, t) if m.end() - m.start() >= n]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_base_spans_by_brute_force():
    r = random.Random(1)
    parts = ["token", "Secret ", "api_key", "apikey", ":", "=", '"', "' ", "abc", "deadbeef" * 4, "AKIA", "ABCD1234EFGH", " ", "é", "ſecret=abcdefgh", "PASSWORD", "x=1", "\n", "0123456789abcdef" * 2]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secrets.joined(secrets.base_spans(t)) == base_by_hand(t), t


def test_weak_parts_need_their_complement():
    key = "aB3dE5gH7jK9lM1nO3pQ5rS7tU9v"
    kinds = lambda t: {k for k, v in secrets.scan_text(t)[1].items() if v}
    assert kinds(f"see {key} here") == set()
    assert kinds("user = bob, and https://db.example.com/x") == set()
    assert kinds(f"user = bobby\nkey {key}") == {"ident", "secret"}
    assert kinds(f"{key} at https://db.example.com/x") == {"endpoint", "secret"}
    assert kinds(f"user = bobby\n\n{key}") == set()  # another paragraph
    assert kinds(f"user = bobby {'x ' * 200}{key}") == set()  # out of reach
    assert kinds("AKIAABCDEFGH1234567 " + key) == {"access", "secret"}
    for n in (128, 129, 5000):  # a key of any length
        assert kinds(f"user = bobby\nkey {(key * 200)[:n]}") == {"ident", "secret"}


def test_scan_and_redact(spark, odd_docs, no_docs, make_docs):
    got = secrets.scan(odd_docs).collect()
    assert len(got) == 8 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.scan(no_docs).count() == 0
    d = secrets.redact(make_docs([None, "fine", 'token = "deadbeefcafe12345678" end'])).orderBy("doc_id").collect()
    assert d[0].text is None and d[1].text == "fine" and d[2].text == '[REDACTED]" end' and d[2].n_chars == len(d[2].text)
    assert secrets.redact(odd_docs).columns == odd_docs.columns


# decontamination

ITEMS = ["What is the colour of the deep northern sky at noon? It is a pale and steady blue.", "Name the longest river of the western plains. The river Quell.", "How many stones stand in the old ring by the lake? Answer: forty two stones in all", None, "", "tiny"]


def test_wand_finds_all_above_threshold():
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [decontam.make_item(k, " ".join(r.choice(words) for _ in range(r.randint(5, 30)))) for k in range(70)]
    ix = decontam.BlockMaxIndex(items, 4)
    for _ in range(200):
        terms = {ix.term[w] for w in r.sample(words, r.randint(1, 40)) if w in ix.term}
        scores = {}
        for t in terms:
            for i, w in zip(ix.docs[t], ix.weights[t]):
                scores[i] = scores.get(i, 0) + w
        for theta in (0.3, 0.6, 0.9):
            assert sorted(i for i, _ in ix.search(terms, theta)) == sorted(i for i, s in scores.items() if s >= theta - 1e-9)


def test_contaminated_documents(spark, make_docs, odd_docs, no_docs):
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    fill = " ".join(f"filler{k}" for k in range(300))
    docs = make_docs([fill, f"{fill} {ITEMS[0]} {fill}", ITEMS[1].upper(), "What is the colour of the deep northern sky at noon?", None, f"{ITEMS[2]} {ITEMS[0]}"])
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect())
    assert got == [(1, 0), (2, 1), (5, 0), (5, 2)]
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [0, 3, 4]
    assert decontam.contaminated(odd_docs, items).count() == 0 and decontam.contaminated(no_docs, items).count() == 0
    assert decontam.contaminated(docs, items.where("false")).count() == 0
    assert decontam.clean(odd_docs, items).count() == 8


def test_many_indexes_agree(spark, make_docs):
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k} zeta{k}. eta{k} theta{k} iota{k}") for k in range(40)], "item_id long, text string")
    found = [*decontam.indexes(items, shard_bytes=300)]
    assert len(found) > 1
    text = "alpha7 beta7 gamma7 delta7 eps7 zeta7. eta7 theta7 iota7"
    assert [h[0] for index in found for h in index.hits(text)] == [7]


def test_scores_do_not_depend_on_the_number_of_indexes(spark):
    """Items that share words: document frequencies and mean length are those of all items."""
    r = random.Random(6)
    words = [f"v{k}" for k in range(60)]
    rows = [(f"id{k}", " ".join(r.choices(words, k=r.randint(4, 25))) + ". " + " ".join(r.choices(words, k=4))) for k in range(80)] + [("short", "v1 v2"), ("none", "!"), (None, "v3 v4 v5 v6 v7")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    texts = [" ".join(r.choices(words, k=30)) + " " + t + " " + " ".join(r.choices(words, k=30)) for _, t in rows[:40]]
    one, many = [*decontam.indexes(items)], [*decontam.indexes(items, shard_bytes=1000)]
    assert len(one) == 1 and len(many) > 3
    for t in texts:
        want = sorted((str(h[0]), round(h[1], 9)) for h in one[0].hits(t))
        assert want == sorted((str(h[0]), round(h[1], 9)) for x in many for h in x.hits(t)) and want
    got = decontam.contaminated(spark.createDataFrame([(1, "a v1 v2."), (2, "v2 v1"), (3, None)], "doc_id int, text string"), items).collect()
    assert [(x.doc_id, x.item_id, x.first_word) for x in got] == [(1, "short", 1)]


# tokens

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), tokens.PrefixModel(open(path, "rb").read())


def test_every_prefix_counts_as_the_library(both):
    library, model = both
    r = random.Random(2)
    parts = ["a", "é", " ", "  ", "\n", "\t", "\x85", "\xa0", "'s", "'ll", "'re", "'v", "e", "12", "²", "日本", "<|endoftext|>", "!", "the", " and", "😀", "\x00", "ß", "<|endof"]
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        table = tokens.PrefixTable(model, t)
        assert [table.count(i) for i in range(len(t) + 1)] == [n(t[:i]) for i in range(len(t) + 1)], t
        for budget in (0, 1, 3):
            fits = [i for i in range(len(t) + 1) if n(t[:i]) <= budget]
            assert table.longest(budget) == max(fits), (t, budget)
        for budget in (1, 3):
            assert model.counts([t], budget) == [(n(t), table.longest(budget))]
    assert model.counts(["abc def", ""]) == [(n("abc def"), 7), (0, 0)]


def test_long_unbroken_text(both):
    """Linear in the text, and in the budget for a cut."""
    library, model = both
    r = random.Random(3)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for letters, size in (("abcdefghij", 300_000), (" ", 100_000), ("é日", 50_000), ("!?", 100_000)):
        t = "".join(r.choice(letters) for _ in range(size)) + "end"
        began = time.time()
        table = tokens.PrefixTable(model, t)
        cut = table.longest(1024)
        assert time.time() - began < 15
        assert table.total == n(t) and n(t[:cut]) <= 1024 < n(t[: cut + 1])


def test_token_query(spark, both, odd_docs, no_docs):
    library, _ = both
    rows = tokens.token_counts(odd_docs, P.path("byte_bpe_50k.json")).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(rows) == 8
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.n_tokens == len(library.encode(t, add_special_tokens=False).ids) and r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 1024)
        if r.over_limit:
            assert len(library.encode(t[: r.cut_chars], add_special_tokens=False).ids) <= 1024
    assert tokens.token_counts(no_docs, P.path("byte_bpe_50k.json")).count() == 0
    t = tokens.prefix_tables(odd_docs.where("doc_id = 3"), P.path("byte_bpe_50k.json")).head()
    assert t.ends[-1] == 3


# quality


def test_statistics_by_brute_force():
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice(["a ", "b ", "c\n", "dé#", " ", "\n", "a b c ", "x"]) for _ in range(r.randint(0, 25)))
        s = quality.TextStats(t.encode())
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (s.n_words, s.word_chars, s.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert s.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))
        assert s.n_symbols == sum(c in "#*$%&|<>" for c in t)


def test_cascade_order_and_verdict(odd_docs, no_docs, make_docs):
    calls = []
    rules = (quality.Rule("never", lambda t: calls.append(1) or False), quality.Rule("always", lambda t: True))
    ordered = quality.order_rules([b"a b c"] * 20, rules)
    assert [x.name for x in ordered] == ["always", "never"]
    calls.clear()
    assert not quality.passes(quality.TextStats(b"x"), ordered) and not calls  # stopped at the first
    good = "The quick brown fox met a lazy dog near seven quiet hills and then walked on. " + " ".join(f"plain{k}" for k in range(60))
    bad = " ".join(f"sym{k}###" for k in range(80))
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(make_docs([good, bad, good.upper(), "short", None])).collect()}
    assert got == {0: (False, True), 1: (False, False), 2: (False, False), 3: (True, False), 4: (True, False)}
    assert [r.doc_id for r in quality.keep(make_docs([good, bad, "short", None])).collect()] == [0]
    assert quality.quality(odd_docs).count() == 8 and quality.quality(no_docs).count() == 0 and quality.keep(no_docs).count() == 0


# languages


def test_language_accuracy_and_edges(make_docs, odd_docs, no_docs):
    r = random.Random(5)
    vocab = {"en": ["the", "and", "of", "house", "walking", "singing"], "de": ["der", "und", "von", "haus", "gehen", "schön"], "fr": ["le", "et", "de", "maison", "étoile", "marcher"]}
    rows = [(lang, " ".join(r.choice(vocab[lang]) for _ in range(12))) for _ in range(60) for lang in vocab]
    docs = make_docs([t for _, t in rows], [x for x, _ in rows])
    got = langid.identify(docs).collect()
    held = [(rows[x.doc_id][0], x.lang_pred) for x in got if x.held_out]
    assert held and all(a == b for a, b in held) and all(0 <= x.score <= 1 for x in got)
    model = langid.fit(docs)
    assert model.predict("Häuser schönes")[0] == "de"  # unseen words, by n-grams
    for t in ("", "123 !?", "\n", "² ½"):
        assert model.predict(t) == ("und", 0.0)
    assert {x.lang_pred for x in langid.identify(odd_docs).collect()} == {"und"}  # nothing to learn from
    assert langid.identify(no_docs).count() == 0


def test_languages_by_brute_force(make_docs):
    """The stated scores over dictionaries: words first, then the longest known n-grams."""
    r = random.Random(8)
    letters = {"xa": "abcdeio", "yb": "bcdefgu", "zc": "aefghköß"}
    word = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randint(1, 7)))
    vocab = {lang: [word(lang) for _ in range(80)] for lang in letters}
    text = lambda lang: " ".join(r.choice(vocab[lang]) if r.random() < 0.6 else word(lang) for _ in range(r.randint(1, 15)))
    langs = [r.choice([*letters]) for _ in range(300)]
    texts = [text(x) for x in langs]
    train = [(t, x) for k, (t, x) in enumerate(zip(texts, langs)) if zlib.crc32(str(k).encode()) % 4 != 2]
    sums = {}
    for t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            sums.setdefault((lang, 0), Counter())[w] += 1
            for n in range(1, 6):
                p = f"\x02{w}\x03" if n > 1 else w
                sums.setdefault((lang, n), Counter()).update(p[i : i + n] for i in range(len(p) - n + 1))
    kinds = {n: len({g for (_, m), c in sums.items() if m == n for g in c}) for n in range(6)}

    def log_frequency(lang, n, g):
        c = sums.get((lang, n), Counter())
        return math.log10((c[g] + 0.5) / (sum(c.values()) + 0.5 * kinds[n] + 1))

    def score(lang, t):
        total = 0.0
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            if any(w in sums.get((x, 0), ()) for x in letters):
                total += log_frequency(lang, 0, w)
                continue
            for n in range(5, 0, -1):
                p = f"\x02{w}\x03" if n > 1 else w
                known = [g for g in (p[i : i + n] for i in range(len(p) - n + 1)) if any(g in sums.get((x, n), ()) for x in letters)]
                if known:
                    total += sum(log_frequency(lang, n, g) for g in known) / len(known)
                    break
        return total

    wrong = 0
    for x in langid.identify(make_docs(texts, langs)).collect():
        scores = {lang: score(lang, texts[x.doc_id]) for lang in letters}
        best = max(scores.values())
        assert scores[x.lang_pred] == pytest.approx(best, abs=1e-6)
        n = len(texts[x.doc_id].split())
        assert x.score == pytest.approx(1 / sum(10 ** ((s - best) * min(1.0, 20.0 / n)) for s in scores.values()), abs=1e-6)
        wrong += x.held_out and x.lang_pred != langs[x.doc_id]
    assert wrong <= 6


def test_endpoints_of_long_runs():
    began = time.time()
    assert secrets.endpoint_spans("a." * 200_000) == []
    assert secrets.endpoint_spans("x " + "b" * 300 + "+c://host.example") == [(2, 2 + 302 + 15)]
    assert secrets.endpoint_spans("host = https://db.example.com/x, ftp://a.b.c 1://abcd") == [(0, 31), (33, 44)]
    assert time.time() - began < 5


def test_few_distinct_words_at_any_length():
    r = random.Random(4)
    rule = next(x for x in quality.DEFAULT_RULES if x.name == "distinct_words")
    junk = [f"word{k}" for k in range(60)]
    prose = [f"word{k}" for k in range(500)]
    for n in (1999, 2000, 20000):
        assert rule.rejects(quality.TextStats(" ".join(r.choices(junk, k=n)).encode()))
        assert not rule.rejects(quality.TextStats(" ".join(r.choices(prose, k=n)).encode()))


def test_grams_of_whole_runs(spark):
    docs = spark.createDataFrame([("a" * 100 + "b" * 100, "xx")], "text string, lang string")
    n = max(langid.LENGTHS)
    got = {r.gram: r["count"] for r in langid.counts(docs, "text", "lang").collect() if r.n == n}
    assert got["b" * n] == 101 - n and sum(got.values()) == 202 - n + 1
