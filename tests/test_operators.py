"""Closed forms and brute force."""

import itertools

import numpy as np
import pytest

from gramlake.functions import kernels, maps
from gramlake.operators import agents, columns, conditional, differential, gram, linalg, log_training, model, optimize, order, points, sampling, selection, transport, udfs
from gramlake.plans.spec import KERNELS, KernelSpec, kernel_name, map_names

RNG = np.random.default_rng(5)


def frame(spark, x, **cols):
    rows = [(k, [float(v) for v in r], *(float(c[k]) for c in cols.values())) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>" + "".join(f", {c} double" for c in cols))


def test_names():
    assert kernel_name("matern") == "materntensor"
    assert map_names("standardmean") == ("scale_to_unitcube", "scale_to_erfinv", "scale_to_mean_distance")
    with pytest.raises(NameError):
        kernel_name("nothing")
    with pytest.raises(NameError):
        map_names("nothing")


@pytest.mark.parametrize("name", KERNELS)
def test_gradients_match_differences(name):
    spec = KernelSpec(name, order=2 if name == "linear_regressor" else 0)
    x, y, h = RNG.normal(size=(4, 3)), RNG.normal(size=(5, 3)), 1e-6
    if name == "tensornorm":
        x, y = x / 10, y / 10
    g = kernels.gradient_block(spec, x, y)
    for k in range(3):
        e = np.eye(3)[k] * h
        d = (kernels.block(spec, x + e, y) - kernels.block(spec, x - e, y)) / (2 * h)
        assert np.allclose(g[..., k], d, atol=1e-5, rtol=1e-4)


def test_sql_and_block_forms_agree(spark):
    from pyspark.sql import functions as F

    x, y = frame(spark, RNG.normal(size=(6, 3))), frame(spark, RNG.normal(size=(4, 3)))
    c = gram.centres(y)
    for name in KERNELS:
        a = {(r[0], r[1]): r[2] for r in gram.pairs(x, y, lambda u, v: kernels.kernel_column(u, v, name)).collect()}
        b = {(r["id"], j): v for r in gram.knm(x, c, name).collect() for j, v in enumerate(r["k"])}
        assert all(abs(a[k] - b[k]) < 1e-9 for k in a), name
    assert x.select(F.size("x")).head()[0] == 3


def test_linear_reproduction(spark):
    df = frame(spark, [[0], [1], [2]], v=[1, 3, 5])
    z = frame(spark, [[3]])
    assert model.PolynomialRegression.fit(df, ["v"], 1).predict(z).head()["f"][0] == pytest.approx(7, abs=1e-4)
    m = model.fit(df, ["v"], KernelSpec("linear_regressor", order=0, reg=1e-9))
    assert m.predict(z, "p").head()["p"][0] == pytest.approx(7, abs=1e-3)


def test_fit_interpolates_and_grows(spark):
    x = RNG.normal(size=(30, 2))
    f = np.sin(x[:, 0])
    m = model.fit(frame(spark, x, v=f), ["v"], KernelSpec("gaussian", reg=1e-10))
    assert np.allclose(m.values(x)[:, 0], f, atol=1e-3)
    y = gram.Centres(np.arange(100, 105), RNG.normal(size=(5, 2)), RNG.normal(size=(5, 1)))
    grown = model.fit(frame(spark, x, v=f), ["v"], KernelSpec("maternnorm", reg=1e-8)).add(y)
    assert np.allclose(grown.values(y.x), y.f, atol=1e-4) and len(grown) == 35
    assert np.allclose(m.gradients(x[:3])[:, 0, 0], np.cos(x[:3, 0]), atol=0.2)


def test_normal_equations_and_updates(spark):
    x = RNG.normal(size=(50, 2))
    f = x[:, 0] - 2 * x[:, 1]
    y = gram.Centres(np.arange(10), x[:10])
    df = frame(spark, x, v=f)
    spec = KernelSpec("gaussian", reg=1e-8)
    m = model.fit(df, ["v"], spec, y)
    k = kernels.block(spec, x, x[:10])
    assert np.allclose(m.theta[:, 0], np.linalg.solve(k.T @ k + 1e-8 * np.eye(10), k.T @ f), atol=1e-5)
    again = m.update(df, ["v"])
    assert np.allclose(again.values(x), m.values(x), atol=1e-4)


def test_classifier_rows_sum_to_one(spark):
    x = RNG.normal(size=(40, 2))
    p = (x[:, 0] > 0).astype(float)
    c = model.KernelClassifier.fit(frame(spark, x, a=p, b=1 - p), ["a", "b"], KernelSpec("gaussian", reg=1e-6))
    got = np.array([r["p"] for r in c.predict(frame(spark, x)).orderBy("id").collect()])
    assert np.allclose(got.sum(1), 1) and ((got[:, 0] > 0.5) == (p > 0.5)).all()
    assert np.allclose(c.gradients(x[:2]).sum(2), 0, atol=1e-9)


def test_discrepancy_of_linear_kernel(spark):
    a, b = RNG.normal(size=(20, 1)), RNG.normal(size=(25, 1)) + 1
    got = gram.discrepancy(frame(spark, a), frame(spark, b), "dotproduct")
    assert got == pytest.approx((a.mean() - b.mean()) ** 2, abs=1e-9)


def test_many_centre_groups(spark, monkeypatch):
    monkeypatch.setattr(gram, "CENTRES", 7)
    x = RNG.normal(size=(20, 2))
    df = frame(spark, x, v=x[:, 0])
    groups = list(gram.centre_groups(df, ["v"], size=7))
    assert len(groups) > 1 and sum(map(len, groups)) == 20


def test_maps():
    x = RNG.normal(size=(50, 3))
    u = maps.fit("unitcube", x).apply(x)
    assert u.min() > 0 and u.max() < 1
    m = maps.fit("meandistance", x).apply(x)
    assert kernels.sq_dist(m, m).mean() == pytest.approx(1)
    s = maps.fit("std", x).apply(x)
    assert np.allclose(s.std(0), 1) and np.allclose(s.mean(0), 0)
    assert np.allclose(maps.fit("std", np.ones((4, 1))).apply(np.ones((4, 1))), 0)
    assert np.isfinite(maps.fit("standardmin", x).apply(x)).all()


def test_differential_identities():
    x = np.linspace(-1, 1, 9)[:, None]
    s = KernelSpec("gaussian", reg=1e-9)
    assert np.allclose(differential.nabla(x, x, s, x)[2:-2, 0, 0], 1, atol=0.02)
    f = RNG.normal(size=(9, 1))
    g = differential.nabla(x, x, s, f)
    assert np.allclose(differential.nabla_t(x, x, s, g), differential.nabla_t_nabla(x, x, s, f), rtol=1e-6, atol=1e-4)
    assert np.allclose(differential.leray_t(x, s, g) + differential.leray(x, s, g), g)
    y = RNG.normal(size=(5, 2))
    assert np.allclose(differential.hessian_of(lambda v: v[:, 0] ** 2 + v[:, 0] * v[:, 1], y), [[2, 1], [1, 0]], atol=1e-4)
    assert np.allclose(differential.laplace_of(lambda v: (v**2).sum(1), y), 4, atol=1e-3)


def test_linear_algebra():
    a = RNG.normal(size=(5, 5))
    s = a @ a.T + np.eye(5)
    assert np.allclose(linalg.cholesky_inverse(s) @ s, np.eye(5))
    q, p = linalg.polar(a)
    assert np.allclose(q @ p, a) and np.allclose(q.T @ q, np.eye(5))
    assert np.linalg.eigvalsh(linalg.nearest_positive(a + a.T)).min() > 0
    assert np.allclose(linalg.theta_scheme(np.array([[-1.0]]), 0.1, np.ones(1)), 0.95 / 1.05)
    assert np.allclose(linalg.lstsq(a, a @ np.ones(5)), 1, atol=1e-4)


def test_assignment_is_optimal():
    for n, m in ((1, 1), (4, 4), (5, 5), (3, 6)):
        c = RNG.normal(size=(n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert c[np.arange(n), transport.assign(c)].sum() == pytest.approx(best)
    assert list(transport.lsap(np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2]]))) == [1, 0, 2]
    x = RNG.normal(size=(7, 2))
    q = RNG.permutation(7)
    d = kernels.sq_dist(x, x)
    assert transport.gromov_cost(d, d[np.ix_(q, q)], transport.gromov_monge(d, d[np.ix_(q, q)])) < 1e-9


def test_balanced_sizes():
    for n, k in ((10, 3), (12, 4), (7, 5)):
        sizes = np.bincount(points.balanced_labels(RNG.random((n, k))), minlength=k)
        assert sizes.max() - sizes.min() <= 1 and sizes.sum() == n


def test_greedy_and_descent_lower_discrepancy():
    x = RNG.normal(size=(200, 2))
    s = KernelSpec("gaussian")
    mmd = lambda y: kernels.block(s, y, y).mean() - 2 * kernels.block(s, y, x).mean()
    at = selection.greedy_discrepancy(x, 10, s)
    assert len({*at.tolist()}) == 10 and mmd(x[at]) < mmd(x[:10])


def test_returns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, t, 1.0) for t in range(3)] + [(1, t, float(t)) for t in range(11)], "game long, t long, r double")
    for ranges in (2, 4, 9):
        got = {(r["game"], r["t"]): r["ret"] for r in order.discounted_returns(df, "game", "r", [F.desc("t")], 0.5, ranges=ranges).collect()}
        assert [got[0, t] for t in (2, 1, 0)] == [1, 1.5, 1.75]
        acc = 0.0
        for t in range(10, -1, -1):
            acc = t + 0.5 * acc
            assert got[1, t] == pytest.approx(acc)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_returns_of_a_game_with_all_rows(spark, ranges):
    from pyspark.sql import functions as F

    r = RNG.normal(size=3000)
    rows = [("one", k, float(v), "x") for k, v in enumerate(r)] + [(None, k, 1.0, "y") for k in range(5)] + [("two", 0, None, "z"), ("two", 1, 2.0, "z")]
    df = spark.createDataFrame(rows, "game string, t long, r double, g string")
    out = order.discounted_returns(df, "game", "r", [F.desc("t")], 0.97, ranges=ranges)
    assert out.columns == ["game", "t", "r", "g", "ret"]
    got = {(x["game"], x["t"]): x["ret"] for x in out.collect()}
    acc = 0.0
    for k in range(2999, -1, -1):
        acc = r[k] + 0.97 * acc
        assert got["one", k] == pytest.approx(acc, abs=1e-9)
    assert got[None, 0] == pytest.approx(sum(0.97**k for k in range(5))) and got["two", 0] == pytest.approx(2.0 * 0.97)
    assert order.discounted_returns(df.limit(0), "game", "r", [F.desc("t")], 0.97).count() == 0
    # a range of rows each: no task holds the game
    used = {x[0] for x in df.repartitionByRange(ranges, "game", F.desc("t")).select(F.spark_partition_id()).collect()}
    assert len(used) == ranges


def test_replay_buffer(spark):
    rows = spark.createDataFrame([(g, t, float(g)) for g in range(4) for t in range(3)], "game long, t long, reward double")
    b = order.ReplayBuffer(rows, capacity=6)
    assert len(b) == 12 and b.is_full()
    assert {r["game"] for r in b.trim().rows.collect()} == {2, 3}
    assert {r["game"] for r in b.trim(worst_game=True).rows.collect()} == {2, 3}
    assert b.last_game().count() == 3 and b.sample(5).count() == 5
    assert b.remove_games(rows.where("game = 3").select("game")).games().count() == 3


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0), (1, "b", None, 2.0)], "k long, n string, e string, v double")
    assert {r[0] for r in columns.constant_columns(df).collect()} == {"k", "e", "v"}
    assert columns.column_selector(df, keep="n").columns == ["n"]
    kept, rest = columns.column_selector(df, keep=["k"], drop=["v"], split=True)
    assert kept.columns == ["k"] and rest.columns == ["n", "e", "v"]
    assert columns.matching_cols(["ab", "bc"], ["b", "a"]) == ["ab", "bc", "ab"]
    scores = {"a": 3.0, "b": 1.0, "c": 2.0}
    wide = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (2.0, 3.0, 4.0, 2.0)], "a double, b double, c double, y double")
    picked = columns.variable_selector(wide, "y", lambda d, cols: min(scores[c] for c in cols) - 0.1 * len(cols))
    assert [c for c, _ in picked] == ["b", "c", "a"]


def test_sampling(spark):
    u = sampling.qmc_uniforms(256, 3)
    assert u.min() > 0 and u.max() < 1 and np.allclose(u.mean(0), 0.5, atol=0.02)
    assert sampling.qmc_normals(1000, 1).var() == pytest.approx(0.5, abs=0.01)
    df = spark.createDataFrame([(k, w) for k, w in enumerate([0.0, 1.0, 3.0])], "id long, w double")
    got = [r["id"] for r in sampling.weighted_resample(df, "id", "w", 2000).collect()]
    assert len(got) == 2000 and 0 not in got and 0.7 < got.count(2) / 2000 < 0.8
    assert sampling.random_normals(spark, 500, 1).collect() == sampling.random_normals(spark, 500, 1).collect()


def test_conditional(spark):
    x = RNG.normal(size=(60, 1))
    train = frame(spark, x, v=2 * x[:, 0])
    nw = conditional.NadarayaWatson(train, ("v",), KernelSpec("gaussian"))
    e = nw.expectation(frame(spark, [[0.0]])).head()["e"][0]
    k = np.exp(-(x[:, 0] ** 2))
    assert e == pytest.approx((k * 2 * x[:, 0]).sum() / k.sum())
    draws = [r["y"][0] for r in nw.sample(frame(spark, [[0.0]]), 200).collect()]
    assert abs(np.mean(draws)) < 1
    s = conditional.Sampler.fit(x).sample(spark, 100).collect()
    assert len(s) == 100


def test_optimizers(spark):
    draws = frame(spark, RNG.uniform(-1, 1, size=(300, 2)))

    def draw(centre, scale, r):
        base = np.random.default_rng(r).uniform(-1, 1, size=(200, 2))
        return frame(spark, base * scale + (0 if centre is None else centre))

    f = lambda m: -((m - 0.2) ** 2).sum(1)
    x, v = optimize.screen(f, draws)
    assert v == pytest.approx(max(f(np.array([r["x"] for r in draws.collect()]))))
    best, _ = optimize.gradient(f, lambda m: -2 * (m - 0.2), draw)
    assert np.allclose(best, 0.2, atol=0.1)


def test_agents(spark):
    # two states; action 1 pays in state 0, action 0 in state 1
    r = np.random.default_rng(2)
    s, a = r.integers(0, 2, 40), r.integers(0, 2, 40)
    rows = [(0, k, [float(s[k])], int(a[k]), [float(1 - s[k])], float(s[k] != a[k]), k == 39) for k in range(40)]
    log = spark.createDataFrame(rows, "game long, t long, state array<double>, action int, next_state array<double>, reward double, done boolean")
    agent = agents.Agent(2, gamma=0.5).train_q(log)
    q = agent.q_values(np.array([[0.0], [1.0]]))
    assert q[0].argmax() == 1 and q[1].argmax() == 0
    better = agents.Agent(2, gamma=0.5).train_actor_critic(log)
    assert better.policy(np.array([[0.0]]))[0].argmax() == 1
    got = {x["id"]: x["action"] for x in agent.act(frame(spark, [[0.0], [1.0]]), greedy=True).collect()}
    assert got == {0: 1, 1: 0}
    assert agents.formatted(log, 2).count() == 40


def test_streams(spark, tmp_path):
    from gramlake.streaming.incremental import ModelStream, windowed

    x = RNG.normal(size=(40, 2))
    df = frame(spark, x, v=x[:, 0])
    base = model.fit(df.where("id < 10"), ["v"], KernelSpec("gaussian", reg=1e-6), gram.Centres(np.arange(10), x[:10]))
    stream = ModelStream(base, ["v"])
    stream.step(df.where("id >= 10"), 0)
    stream.step(df.where("id >= 10"), 0)  # run again: counts once
    whole = model.fit(df, ["v"], KernelSpec("gaussian", reg=1e-6), gram.Centres(np.arange(10), x[:10]))
    assert np.allclose(stream.model.values(x), whole.values(x), atol=1e-3)
    spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:30:00", "a", 2.0)], "ts string, k string, v double").selectExpr("cast(ts as timestamp) ts", "k", "v").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = windowed(s, "ts", ["k"], "v", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").count() == 2


def test_user_functions(spark):
    assert udfs.parallel_task(spark, [{"a": 1}, {"a": 5}], lambda p: p["a"] * 2) == [2, 10]
    assert udfs.elapsed_time(lambda: 3)[0] == 3
    got = udfs.vectorized(frame(spark, [[1, 2], [3, 4]]), lambda r: r[::-1]).orderBy("id").collect()
    assert [r["y"] for r in got] == [[2, 1], [4, 3]]
    spec = KernelSpec("user", params={"k": lambda a, b: a @ b.T, "grad": lambda a, b: np.broadcast_to(b[None], (len(a), len(b), a.shape[1]))})
    x = RNG.normal(size=(3, 2))
    assert np.allclose(kernels.block(spec, x, x), x @ x.T) and np.allclose(kernels.gradient_block(spec, x, x), kernels.gradient_block("dotproduct", x, x))
    assert np.allclose(kernels.gradient_block(KernelSpec("user", params={"k": lambda a, b: a @ b.T}), x, x), kernels.gradient_block("dotproduct", x, x), atol=1e-6)


def test_files(spark, tmp_path):
    from gramlake.sources import tables

    df = spark.createDataFrame([(1, "a")], "k long, v string")
    tables.save_to_file([df, df], [str(tmp_path / "one"), str(tmp_path / "two")])
    assert spark.read.option("header", True).csv(str(tmp_path / "two")).collect()[0]["v"] == "a"
    assert tables.files_indir(spark, str(tmp_path), ".csv").count() >= 2
    with pytest.raises(FileNotFoundError):
        tables.located("no such file")
    folder = tmp_path / "below"
    folder.mkdir()
    (folder / "here.txt").write_text("x")
    assert tables.located("below/here.txt", roots=["/nowhere", tmp_path]) == str(folder / "here.txt")
    assert tables.located("below", "folder", [tmp_path]) == str(folder)
    with pytest.raises(FileNotFoundError):
        tables.located("below", "file", [tmp_path])


def test_balanced_blocks_are_balanced_together(spark):
    x = RNG.normal(size=(150, 2))
    c = points.Clusters(x[:4], None, KernelSpec("gaussian"))
    rows = points.balanced_blocks(frame(spark, x), c, 30).collect()
    sizes = np.bincount([r.label for r in rows], minlength=4)
    assert sorted(r.id for r in rows) == list(range(150)) and sizes.max() - sizes.min() <= 1
    d = kernels.distance_block(x, c.centres, c.distance, c.spec)
    one = {r.id: r.label for r in points.balanced_blocks(frame(spark, x), c).collect()}
    cost = lambda labels: d[np.arange(150), labels].sum()
    assert np.isclose(cost([one[i] for i in range(150)]), cost(points.balanced_labels(d)))


def test_transport_conditional_sums_over_all_rows(spark):
    x = RNG.normal(size=(90, 2))
    f = np.sin(x[:, 0]) + x[:, 1]
    m = conditional.TransportConditional.fit_all(frame(spark, x, f=f), ["f"], n=20)
    k, inner = kernels.block(m.spec, x, m.x), kernels.block(m.spec, m.x, m.x)
    solve = lambda b: np.linalg.solve(k.T @ k + 0.09 * inner + 1e-9 * np.eye(20), k.T @ b)
    mean = solve(f)
    assert m.x.shape == (20, 2) and np.allclose(k @ m.mean[:, 0], k @ mean, atol=1e-6)
    assert np.allclose(k @ m.second[:, 0], k @ solve((f - k @ mean) ** 2), atol=1e-6)


@pytest.mark.parametrize("size", [8, 20, 1000])
def test_sums_over_groups_of_centres(spark, size):
    """However many groups the centres make, there is one row an id with the whole sum."""
    r = np.random.default_rng(4)
    x, y, f = r.normal(size=(7, 3)), r.normal(size=(25, 3)), r.normal(size=(25, 2))
    xs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    ys = spark.createDataFrame([(k, v.tolist(), *map(float, w)) for k, (v, w) in enumerate(zip(y, f))], "id long, x array<double>, f0 double, f1 double")
    k = gram.kernel_fun(KernelSpec("gaussian"), None)(x, y)
    plain = {v.id: v.w for v in gram.sums(xs, ys.select("id", "x"), "gaussian", size=size).collect()}
    assert len(plain) == 7 and all(plain[i] == pytest.approx(k[i].sum()) for i in range(7))
    rows = gram.sums(xs, ys, "gaussian", ["f0", "f1"], size=size).collect()
    assert len(rows) == 7 and all(v.w == pytest.approx(k[v.id].sum()) and np.allclose(v.s, k[v.id] @ f) for v in rows)


def _random_log(spark, n=90):
    r = np.random.default_rng(8)
    s, a = r.normal(size=(n, 2)), r.integers(0, 2, n)
    nxt = s * 0.5 + (a[:, None] - 0.5) + 0.1 * r.normal(size=(n, 2))
    g = agents.Games(s, a, nxt, np.sin(s[:, 0]) + a, r.random(n) < 0.1)
    rows = [(k % 4, k, s[k].tolist(), int(a[k]), nxt[k].tolist(), float(g.reward[k]), bool(g.done[k])) for k in range(n)]
    return g, spark.createDataFrame(rows, "game long, t long, state array<double>, action int, next_state array<double>, reward double, done boolean").repartition(3)


def test_agents_sum_over_the_whole_log(spark):
    """Few centres, every row in the sums: against dense systems on all rows."""
    g, log = _random_log(spark)
    agent = agents.Agent(2, gamma=0.5, spec=KernelSpec("gaussian", reg=1e-4))
    c = log_training.centre_rows(log, 15)
    assert len(c) == 15 and len(log_training.centre_rows(log)) == 90
    hot = lambda h: np.concatenate([h.state, np.eye(2)[h.action]], 1)
    y, ridge = hot(c), 1e-4 * 90 / 15 * np.eye(15)
    solve = lambda m, b: np.linalg.solve(m.T @ m + ridge, m.T @ b)
    k = kernels.block(agent.spec, hot(g), y)
    nxt = kernels.block(agent.spec, agents.with_actions(g.next_state, 2), y).reshape(90, 2, -1)
    critic = log_training.evaluated(log, c, agent)
    assert np.allclose(critic.theta[:, 0], solve(k - 0.5 * nxt.mean(1) * ~g.done[:, None], g.reward), atol=1e-6)
    # a step that lowers the Bellman error, never one that raises it
    error = lambda t: np.mean((k @ t - g.reward - 0.5 * (nxt @ t).max(1) * ~g.done) ** 2)
    assert error(log_training.optimal(log, c, agent).theta[:, 0]) <= error(solve(k, g.reward)) + 1e-9
    # dynamics
    inner = kernels.block(agent.spec, y, y)
    step = g.next_state - g.state
    fitted = k @ np.linalg.solve(k.T @ k + 1e-2 * inner + 6e-9 * np.eye(15), k.T @ step)
    assert np.allclose(log_training.dynamics(log, c, agent)(g).next_state, g.state + fitted + (step - fitted).mean(0), atol=1e-5)
    # policy
    a = critic.q_values(g.state)
    a = a - a.mean(1, keepdims=True)
    want = np.log(model.softmax(np.log(np.full((90, 2), 0.5)) + a / np.abs(a).max()))
    ks, ms = kernels.block(agent.spec, g.state, c.state), kernels.block(agent.spec, c.state, c.state)
    theta = np.linalg.solve(ks.T @ ks + 1e-4 * ms + 6e-9 * np.eye(15), ks.T @ want)
    better = log_training.improved(log, c, critic, lambda h: critic.q_values(h.state))
    assert np.allclose(kernels.block(agent.spec, g.state, c.state) @ better.log_policy, ks @ theta, atol=1e-5)
    # state values
    v = {x["id"]: x["v"] for x in log_training.state_values(agent, log, frame(spark, g.state), 15).collect()}
    at = solve(ks - 0.5 * kernels.block(agent.spec, g.next_state, c.state) * ~g.done[:, None], 0.5 * g.reward)
    assert np.allclose([v[i] for i in range(90)], ks @ at, atol=1e-5)


def test_policy_derivative_equals_differences(spark):
    """The adjoint against finite differences of the whole computation: solve for Q, then average V."""
    from dataclasses import replace

    g, log = _random_log(spark)
    agent = agents.Agent(2, gamma=0.6, spec=KernelSpec("gaussian", reg=1e-2))
    c = log_training.centre_rows(log, 12)
    y = np.concatenate([c.state, np.eye(2)[c.action]], 1)
    agent = replace(agent, states=c.state, log_policy=np.random.default_rng(1).normal(size=(12, 2)) * 0.3)
    found = log_training.policy_derivative(log, c, agent)

    def mean_value(logits, y=y, scale=90 / 12):
        moved = replace(agent, log_policy=logits)
        a = moved.rows(g, y)[0]
        theta = np.linalg.solve(a.T @ a + 1e-2 * scale * np.eye(len(y)), a.T @ g.reward)
        return (moved.value_rows(g, y) @ theta).mean()

    want = np.zeros((12, 2))
    for i, j in itertools.product(range(12), range(2)):
        e = np.zeros((12, 2))
        e[i, j] = 1e-5
        want[i, j] = (mean_value(agent.log_policy + e) - mean_value(agent.log_policy - e)) / 2e-5
    assert np.abs(want).max() > 1e-3 and np.allclose(found, want, atol=1e-6 * np.abs(want).max() + 1e-9)
    # a short step along it raises the value of the policy
    assert mean_value(agent.stepped(found, 0.05).log_policy) > mean_value(agent.log_policy)
    dense = agent.policy_derivative(c)
    assert dense.shape == (12, 2) and np.isfinite(dense).all()


def test_hjb_agents_equal_dense_systems(spark):
    from dataclasses import replace

    g, log = _random_log(spark)
    agent = agents.Agent(2, gamma=0.5, spec=KernelSpec("gaussian", reg=1e-4))
    c = log_training.centre_rows(log, 15)
    move = log_training.dynamics(log, c, agent)
    law = log_training.Transition(log, c, agent, move)
    hot = lambda h: np.concatenate([h.state, np.eye(2)[h.action]], 1)
    # the law: smoothed joint weights, columns to equal sums over the log, rows to one
    at = lambda h: hot(replace(h, state=move(h).next_state))
    joint = kernels.block(agent.spec, at(g), at(c)) @ kernels.block(agent.spec, c.next_state, c.next_state)
    p = joint / joint.mean(0)
    p /= p.sum(1, keepdims=True)
    assert np.allclose(law(g), p, atol=1e-9) and np.allclose(law(g).sum(1), 1)
    y, ridge = hot(c), 1e-4 * 90 / 15 * np.eye(15)
    k = kernels.block(agent.spec, hot(g), y)
    nxt = kernels.block(agent.spec, agents.with_actions(c.next_state, 2), y).reshape(15, 2, -1)
    solve = lambda m: np.linalg.solve(m.T @ m + ridge, m.T @ g.reward)
    live = ~g.done[:, None]
    critic = log_training.evaluated_hjb(log, c, agent, law)
    assert np.allclose(critic.theta[:, 0], solve(k - 0.5 * (p @ nxt.mean(1)) * live), atol=1e-6)
    error = lambda t: np.mean((k @ t - g.reward - 0.5 * (p @ (nxt @ t).max(1)) * ~g.done) ** 2)
    start, best = solve(k), log_training.optimal_hjb(log, c, agent, law).theta[:, 0]
    assert error(best) < error(start)
    steps = [start + s * (solve(k - 0.5 * (p @ nxt[np.arange(15), (nxt @ start).argmax(1)]) * live) - start) for s in log_training.STEPS]
    assert error(best) <= min(map(error, steps)) + 1e-9


def test_agents_on_an_empty_log(spark):
    _, log = _random_log(spark)
    none = log.where("game > 9")
    agent = agents.Agent(2)
    assert all(log_training.fit_all(agent, none, how) is agent for how in log_training.HOWS)
    assert [x["v"] for x in log_training.state_values(agent, none, frame(spark, [[0.0, 1.0]])).collect()] == [0.0]
    with pytest.raises(ValueError):
        log_training.fit_all(agent, log, "nothing")


def test_chains_fit_over_all_rows(spark):
    """A map behind an inverse error function is fitted on every row."""
    x = np.random.default_rng(3).normal(size=(1500, 2))
    far = np.concatenate([x, 50 + x[:300]])
    got, want = maps.fit("standardmean", frame(spark, far)), maps.fit("standardmean", far)
    assert all(np.allclose(a.scale, b.scale) and np.allclose(a.shift, b.shift) for a, b in zip(got.maps, want.maps))
