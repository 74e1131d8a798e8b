"""Fill-in-middle, conversation repair and toxicity against brute force and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from gramlake.llm import fim, roles, toxicity

SF = "/root/testdata/sf0.001"


def expected_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts(count, seed):
    rng = random.Random(seed)
    return [None, "", "\n", "one line", "<P>", "a<M>b\n", "<P\n>\n", "é\n" * 700, "long " * 900, *("".join(rng.choice("ab\n\n<PSM>é𝛼 ") for _ in range(rng.randint(0, 40))) for _ in range(count))]


@pytest.mark.parametrize("chunk, spread, rate", [(1 << 16, 1 << 20, 100), (7, 0, 100), (5, 20, 40)])
def test_fim_equals_brute_force(spark, chunk, spread, rate):
    rows = [(k if k != 3 else None, t, "x") for k, t in enumerate(texts(120, 1))]
    rows += rows[5:15]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")  # a clashing column
    out = fim.transformed(docs, chunk=chunk, spread=spread, rate=rate)
    found = sorted(map(tuple, out.collect()), key=repr)
    assert found == sorted(((k, *expected_fim(k, t, rate=rate)) for k, t, _ in rows), key=repr)
    for r in out.select("doc_id", "output", fim.restored(F.col("output"), F.col("form")).alias("text")).distinct().collect():
        assert r["text"] in {t or "" for k, t, _ in rows if k == r["doc_id"]}


def test_fim_chunk_answers_compose_associatively():
    rng = random.Random(2)
    for _ in range(300):
        a, b, c = (fim.scan("".join(rng.choice("a\n<P>Mé") for _ in range(rng.randint(0, 6))).encode()) for _ in range(3))
        assert fim.then(fim.then(a, b), c) == fim.then(a, fim.then(b, c))


def test_fim_of_no_rows(spark):
    assert fim.digests(fim.transformed(spark.createDataFrame([], "doc_id string, text string"))).count() == 0


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        c, r, x = (" " if v is None else v for v in (c, r, x))
        d = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
        out += [(t, "user" if d == 4 else r, x)] * (0 if d == 0 else 2 if d == 3 else 1)
    return sorted(out, key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))


def expected_repair(rows):
    """By trying every way to edit, cheapest first (few turns only)."""
    rows = damaged(rows)
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    seen, faults = set(), []
    for _, r, x in rows:
        s = x.strip(" \t\n\v\f\r")
        faults.append("blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = (10**9, "", [])
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = []
    for (_, r, x), f in zip(rows, faults):
        ways = [(3, "D", [])]
        if f not in ("blank", "duplicate"):
            more = f == "truncated"
            ways += [(more, "K", [(r, x)]), (2 + more, "R", [("user", x)]), (2 + more, "R", [("assistant", x)])]
        choices.append([(c + 2 * len(i), "I" * len(i) + label, [(w, "") for w in i] + said) for i in inserts for c, label, said in ways])
    choices.append([(2 * len(i), "I" * len(i), [(w, "") for w in i]) for i in inserts])
    partial = [(0, "", [])]
    for ways in choices:  # the cheapest labels for each sequence of roles so far
        kept = {}
        for (c, l, said), (c2, l2, said2) in itertools.product(partial, ways):
            way = (c + c2, l + l2, said + said2)
            initials = "".join(r[:1] or "?" for r, _ in way[2])
            if re.fullmatch("(s?(ua)*u?)?", initials):
                key = (initials[-1:], bool(initials))
                kept.setdefault(key, []).append(way)
        partial = [w for ws in kept.values() for w in ws if w[0] <= min(x[0] for x in ws) + 4]
        partial = [w for w in partial if w[0] <= min(x[0] for x in partial) + 8]
    for way in partial:
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in way[2])):
            best = min(best, way, key=lambda w: (w[0], w[1]))
    said = "\n".join(f"{r}:{x}" for r, x in best[2])
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(said.encode()).hexdigest()


def conversations(count, turns, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for t in range(rng.randint(0, turns)):
            rows.append((c, rng.choice([t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "no", "", " \t", "What?", None, f"{rng.random()}!", "cut off "])))
    return rows


@pytest.mark.parametrize("most_turns", [4096, 2])
def test_repair_equals_brute_force(spark, most_turns):
    rows = conversations(90, 6, 5)
    rows += [(None, t, r, x) for _, t, r, x in rows[:4]]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    out = roles.audited(roles.repaired(table, most_turns=most_turns))
    found = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(found) == set(by)
    for c, turns in by.items():
        assert found[c] == expected_repair(turns), (c, damaged(turns))


def test_repair_of_a_conversation_with_most_rows(spark):
    rng = random.Random(9)
    rows = [("hot", t, rng.choice(["user", "assistant"]), rng.choice(["Same again.", f"{t}.", "cut"])) for t in range(3000)] + [("cold", t, "user", "Hi.") for t in range(5)]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    few, many = ({r["conv_id"]: r for r in roles.audited(roles.repaired(table, most_turns=k)).collect()} for k in (10**6, 50))
    assert few == many and few["hot"]["duplicate"] > 900
    kinds, seen = [], set()
    for _, r, x in damaged([r for r in rows if r[0] == "hot"]):
        kinds.append((r[:1], "duplicate" if (r, x) in seen else "truncated" if x[-1:] not in ".!?" or not x else "") if x else (r[:1], "blank"))
        seen.add((r, x))
    assert few["hot"]["cost"] == roles.costs(kinds, roles.CLOSED)[0][0]


def test_repair_of_no_rows(spark):
    assert roles.audited(roles.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("sql, build, table", [(fim.FIM_SQL, lambda d: fim.digests(fim.transformed(d, spread=500, chunk=64)), "documents"), (roles.REPAIR_SQL, lambda d: roles.audited(roles.repaired(d)), "conversations")])
def test_sql_twins(spark, sql, build, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = build(spark.read.parquet(f"{SF}/{table}.parquet"))
    want = con.sql(sql).select(*out.columns).fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def labelled(spark, count=1500, seed=3):
    rng = random.Random(seed)
    insults = ["blorp", "snidely", "kvetch"]
    rows = []
    for k in range(count):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(0, 60))]
        toxic = int(rng.random() < 0.2 and len(words) > 5)
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(insults) + rng.choice(["", "s", "ed"]))
        rows.append((k, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(spark):
    rows = labelled(spark)
    out = toxicity.scored(rows.select("doc_id", "text", F.lit("x").alias("score")), rows.select("doc_id", "toxic")).join(rows.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 300 and sum(r["predicted"] == r["toxic"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_toxicity_does_not_read_held_out_labels(spark):
    rows = labelled(spark, 400)
    flipped = rows.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    a, b = (sorted(map(tuple, toxicity.scored(rows.select("doc_id", "text"), x).collect())) for x in (rows.select("doc_id", "toxic"), flipped))
    assert a == b


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (4, "x" * 300_000), (4, "x" * 300_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.scored(docs, none).collect()] == [0] * 5
    one_sided = spark.createDataFrame([(1, 1), (3, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.scored(docs, one_sided).collect()} != {0.0}
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_clauses_are_scored_not_words():
    words = toxicity.Lexicon({"=idiot": 4.0})
    score = lambda text: toxicity.clause_score([words.tag(w) for w in text.split()])
    assert score("you are an idiot") > score("an idiot") > score("she said an idiot") > score("not an idiot") > 0
    assert score("idiot , you") > score("idiot") and score("i will kill you") > 0 and score("you are not here") == 0
    reach = score("not one two three four an idiot")
    assert reach == score("an idiot")  # a negation reaches three words
    total = lambda text: words.features(text)[0]
    assert total("You are an IDIOT. Not here.") > total("Not here, idiot.") and total("nothing. here") == 0
