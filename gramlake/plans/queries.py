"""Registered queries of the kernel operators, with DuckDB twins where SQL has them.

Point set: embeddings; centres: the mean embedding of each label (a bounded set).
Episodes: events of a user, latest first. Doubles are rounded to 6 digits on both
sides, negative zero made zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, casts, kernels, maps
from ..operators import agents, auction, columns, conditional, differential, features, game_models, gram, linalg, log_training, model, optimize, order, points, sampling, sobol, tape, transport, udfs
from ..operators.gram import Centres
from ..sources import tables
from .spec import KernelSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GAMMA = 0.99


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def r6s(c: str) -> str:
    return f"(round(({c})::double, 6) + 0.0)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def register(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.points(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def labelled_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("label"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id = label, x): coordinate means, pre-aggregated by (label, place)."""
    e = tables.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "v"))
    m = e.groupBy("label", "d").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("m"))
    return m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("x")).select(F.col("label").cast("long").alias("id"), "x")


def events(spark, sf_dir) -> DataFrame:
    return tables.table(spark, sf_dir, "events")


CLOUD_SQL = """
pts as (select vec_id as id, embedding::double[] as x, label from embeddings),
mean_parts as (select label, d, round(avg(x[d]), 9) as m from pts, unnest(range(1, len(x) + 1)) as u(d) group by label, d),
cen as (select label::bigint as id, list(m order by d) as x from mean_parts group by label)
"""


def _zip(expr: str, a: str = "p.x", b: str = "c.x") -> str:
    """SQL list of expr in u and v over two lists."""
    return f"list_transform(list_zip({a}, {b}), lambda z: {expr.replace('U', 'z[1]').replace('V', 'z[2]')})"


def _total(expr: str, **k) -> str:
    return f"list_sum({_zip(expr, **k)})"


def _times(expr: str, **k) -> str:
    return f"list_product({_zip(expr, **k)})"


_R22 = _total("(U-V)*(U-V)")
_NORM = {s: f"sqrt(list_sum(list_transform({s}.x, lambda t: t*t)))" for s in "pc"}
_SINC = "case when U=V then 1.0 else sin((U-V)*pi())/((U-V)*pi()) end"
KERNEL_SQL = {
    "gaussian": f"exp(-{_R22})",
    "maternnorm": f"exp(-sqrt({_R22}))",
    "materntensor": f"exp(-{_total('abs(U-V)')})",
    "tensornorm": _times("greatest(0.0, 1-abs(U-V))"),
    "absnorm": f"({_NORM['p']} + {_NORM['c']} - sqrt({_R22}))/2",
    "multiquadricnorm": f"1/sqrt(1+{_R22})",
    "multiquadrictensor": _times("1/sqrt(1+(U-V)*(U-V))"),
    "sincardtensor": _times(_SINC),
    "sincardsquaretensor": _times(f"({_SINC})*({_SINC})"),
    "dotproduct": _total("U*V"),
    "scalar_product": _total("U*V"),
    "gaussianper": _times("(" + "+".join(f"exp(-((U-V+{m})*(U-V+{m})))" for m in range(-3, 4)) + ")"),
    "linear_regressor": f"1+{_total('U*V')}+({_total('U*V')})*({_total('U*V')})",
}
DISTANCE_SQL = {"norm1": _total("abs(U-V)"), "norm2": f"sqrt({_R22})", "norm22": _R22, "normifty": f"list_max({_zip('abs(U-V)')})", "kernel": f"2-2*exp(-{_R22})"}


def _gram(name: str) -> Query:
    spec = KernelSpec(name, order=2 if name == "linear_regressor" else 0)

    def run(spark, sf_dir):
        y = gram.centres(label_means(spark, sf_dir))
        out = gram.knm(cloud(spark, sf_dir), y, spec).select("id", F.explode(F.arrays_zip(F.lit([int(i) for i in y.ids]).alias("c"), F.col("k").alias("k"))).alias("z"))
        k = F.log(F.col("z.k")) if name == "gaussianper" else F.col("z.k")
        return out.select(F.col("id").alias("x_id"), F.col("z.c").cast("long").alias("y_id"), r6(k).alias("k"))

    return run


def _distance(name: str) -> Query:
    def run(spark, sf_dir):
        y = gram.centres(label_means(spark, sf_dir))
        out = gram.dnm(cloud(spark, sf_dir), y, None if name == "kernel" else name, "gaussian").select("id", F.explode(F.arrays_zip(F.lit([int(i) for i in y.ids]).alias("c"), F.col("d").alias("d"))).alias("z"))
        return out.select(F.col("id").alias("x_id"), F.col("z.c").cast("long").alias("y_id"), r6("z.d").alias("d"))

    return run


for _k in KERNEL_SQL:
    # the periodic kernel is a product of 64 sums near 1.8: its logarithm is compared
    _v = f"ln({KERNEL_SQL[_k]})" if _k == "gaussianper" else KERNEL_SQL[_k]
    register(f"gram_{_k}", _gram(_k), f"with {CLOUD_SQL} select p.id as x_id, c.id as y_id, {r6s(_v)} as k from pts p, cen c")
for _d in DISTANCE_SQL:
    register(f"dist_{_d}", _distance(_d), f"with {CLOUD_SQL} select p.id as x_id, c.id as y_id, {r6s(DISTANCE_SQL[_d])} as d from pts p, cen c")


@query(f"with {CLOUD_SQL} select p.id as x_id, c.id as y_id, {r6s(KERNEL_SQL['gaussian'])} as k from pts p, cen c")
def gram_column_form(spark, sf_dir):
    """The gaussian Gram matrix as a column expression, whole in the JVM."""
    out = gram.pairs(cloud(spark, sf_dir), label_means(spark, sf_dir), lambda a, b: kernels.kernel_column(a, b, "gaussian"))
    return out.select("x_id", F.col("y_id").cast("long").alias("y_id"), r6("k").alias("k"))


@query(f"with {CLOUD_SQL}, h as (select p.id as x_id, c.id as y_id, exp(-{_total('(U-V)*(U-V)', a='p.x[1:32]', b='c.x[1:32]')}) * exp(-sqrt({_total('(U-V)*(U-V)', a='p.x[33:64]', b='c.x[33:64]')})) as k from pts p, cen c) select x_id, y_id, {r6s('k')} as k from h")
def gram_product_kernel(spark, sf_dir):
    spec = KernelSpec("gaussian").product(KernelSpec("maternnorm"), 32)
    y = gram.centres(label_means(spark, sf_dir))
    out = gram.knm(cloud(spark, sf_dir), y, spec).select("id", F.explode(F.arrays_zip(F.lit([int(i) for i in y.ids]).alias("c"), F.col("k").alias("k"))).alias("z"))
    return out.select(F.col("id").alias("x_id"), F.col("z.c").cast("long").alias("y_id"), r6("z.k").alias("k"))


def _nearest(maxmin: str) -> Query:
    def run(spark, sf_dir):
        return gram.labelled(cloud(spark, sf_dir), gram.centres(label_means(spark, sf_dir)), "norm2", maxmin).select("id", F.col("label").alias("nearest"), r6("distance").alias("distance"))

    return run


for _n, _f, _a in (("nearest_label", "min", "arg_min"), ("farthest_label", "max", "arg_max")):
    register(_n, _nearest(_f), f"with {CLOUD_SQL}, d as (select p.id, c.id as c, sqrt({_R22}) as d from pts p, cen c) select id, {_a}(c, d) as nearest, {r6s(f'{_f}(d)')} as distance from d group by id")


@query(f"with {CLOUD_SQL}, k as (select p.id, {KERNEL_SQL['gaussian']} as k, c.label as v from pts p join pts c on p.id <> c.id) select id, {r6s('sum(k*v)/sum(k)')} as e from k group by id")
def nw_expectation(spark, sf_dir):
    """Leave-one-out kernel mean of the label at every point."""
    pts = labelled_cloud(spark, sf_dir)
    s = gram.sums(pts, pts, "gaussian", ["label"], leave_one_out=True)
    return s.select("id", r6(F.get("s", F.lit(0)) / F.col("w")).alias("e"))


@query(f"with {CLOUD_SQL}, k as (select p.id, {KERNEL_SQL['gaussian']} as k from pts p, pts c) select id, {r6s('sum(k)')} as density from k group by id")
def kde(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return gram.sums(pts, pts, "gaussian").groupBy("id").agg(r6(F.sum("w")).alias("density"))


@query(f"""with {CLOUD_SQL}, k as (select p.id as i, c.id as j, {KERNEL_SQL['gaussian']} as k, c.label::double as v from pts p, pts c),
m as (select i, sum(k*v)/sum(k) as e from k group by i), res as (select pts.id as j, (label-e)*(label-e) as r2 from pts join m on m.i=pts.id)
select i as id, {r6s('sum(k*r2)/sum(k)')} as v from k join res using (j) group by i""")
def nw_variance(spark, sf_dir):
    pts = labelled_cloud(spark, sf_dir)
    return conditional.NadarayaWatson(pts, ("label",)).var(pts).select("id", r6(F.get("v", F.lit(0))).alias("v"))


_JOINT = f"with {CLOUD_SQL}, ys as (select unnest(range(0,10))::double as y), k as (select p.id as i, c.id as j, {KERNEL_SQL['gaussian']} as k, c.label::double as v from pts p, pts c), jt as (select i, y, sum(k*exp(-(y-v)*(y-v))) as p, sum(k) as w from k, ys group by i, y)"


_WAVES = 512


def _normal_sql(j: str, d: str, stream: int, seed: int = 42) -> str:
    u = lambda k: sampling.scattered_sql(j, d, 8 * seed + k)
    return f"sqrt(-2*ln({u(stream)}))*cos(2*pi()*{u(stream + 1)})"


@query(f"""with pts as (select vec_id as id, embedding::double[] as x, label::double as label from embeddings),
freq as (select j, list(sqrt(2)*{_normal_sql('j', 'd', 0)} order by d) as w from range({_WAVES}) r(j), range(64) s(d) group by j),
z as (select id, label, j, list_inner_product(x, w) as z from pts, freq),
waves as (select j, sum(cos(z)) as c, sum(sin(z)) as s, sum(label*cos(z)) as cl, sum(label*sin(z)) as sl from z group by j)
select id, round(avg(cos(z)*c + sin(z)*s), 4) + 0.0 as density, round(avg(cos(z)*cl + sin(z)*sl)/avg(cos(z)*c + sin(z)*s), 4) + 0.0 as e, round(stddev_pop(cos(z)*c + sin(z)*s)/sqrt({_WAVES}), 4) + 0.0 as se
from z join waves using (j) group by id""")
def density_features(spark, sf_dir):
    """Kernel density, and kernel mean of the label, by random features: linear in both sides."""
    pts = labelled_cloud(spark, sf_dir)
    s = features.sums(pts, pts, "gaussian", ["label"], _WAVES)
    r4 = lambda c: F.round(c, 4) + F.lit(0.0)
    return s.select("id", r4(F.col("w")).alias("density"), r4(F.get("s", F.lit(0)) / F.col("w")).alias("e"), r4(F.col("se")).alias("se"))


@query(f"""{_JOINT}, cols as (select y, sum(p) as c from jt group by y), q as (select i, y, p/c as q from jt join cols using (y))
select i as id, y::int as y_index, {r6s('q / sum(q) over (partition by i)')} as p from q""")
def conditional_transition(spark, sf_dir):
    """Transition probabilities from every point to the ten labels."""
    pts = labelled_cloud(spark, sf_dir)
    out = conditional.NadarayaWatson(pts, ("label",)).transition(pts, np.arange(10.0)[:, None])
    return out.select("id", "y_index", r6("p").alias("p"))


@query(f"{_JOINT} select i as id, y::bigint as y, {r6s('p')} as p from jt")
def joint_density(spark, sf_dir):
    pts = labelled_cloud(spark, sf_dir)
    out = conditional.NadarayaWatson(pts, ("label",)).joint_density(pts, np.arange(10.0)[:, None])
    return out.select("id", F.posexplode("p").alias("y", "p")).select("id", F.col("y").cast("long").alias("y"), r6("p").alias("p"))


@query(f"{_JOINT} select i as id, y::bigint as y, {r6s('p/w')} as p from jt")
def conditional_density(spark, sf_dir):
    pts = labelled_cloud(spark, sf_dir)
    out = conditional.conditional_density_estimator(pts, ["label"], pts, np.arange(10.0)[:, None], KernelSpec("gaussian"), KernelSpec("gaussian"))
    return out.select("id", F.posexplode("p").alias("y", "p")).select("id", F.col("y").cast("long").alias("y"), r6("p").alias("p"))


@query(f"{_JOINT}, c as (select y, sum(p) as c from jt group by y), s as (select i, jt.y, p/c as p from jt join c using (y)) select i as id, y::bigint as y, {r6s('p/sum(p) over (partition by i)')} as p from s")
def transition(spark, sf_dir):
    pts = labelled_cloud(spark, sf_dir)
    out = conditional.NadarayaWatson(pts, ("label",)).transition(pts, np.arange(10.0)[:, None])
    return out.select("id", F.col("y_index").cast("long").alias("y"), r6("p").alias("p"))


@query(f"with {CLOUD_SQL}, k as (select p.label as a, c.label as b, avg({KERNEL_SQL['gaussian']}) as k from pts p, pts c group by 1, 2) select x.a::bigint as label_a, x.b::bigint as label_b, {r6s('aa.k - 2*x.k + bb.k')} as mmd from k x join k aa on aa.a=x.a and aa.b=x.a join k bb on bb.a=x.b and bb.b=x.b where x.a < x.b")
def mmd_by_label(spark, sf_dir):
    """Squared discrepancy between the points of every two labels."""
    pts = labelled_cloud(spark, sf_dir)
    n = int(pts.agg(F.max("label")).head()[0]) + 1
    hot = [f"l{k}" for k in range(n)]
    marked = pts.select("id", "x", "label", *(F.when(F.col("label") == k, 1.0).otherwise(0.0).alias(c) for k, c in enumerate(hot)))
    by = gram.sums(marked, marked, "gaussian", hot).join(pts.select("id", "label"), "id").select("label", F.posexplode("s").alias("b", "k"))
    sizes = pts.groupBy("label").agg(F.count("*").alias("m"))
    mean = by.groupBy("label", "b").agg(F.sum("k").alias("k")).join(sizes, "label").join(sizes.select(F.col("label").alias("b2"), F.col("m").alias("mb")), F.col("b") == F.col("b2")).select(F.col("label").cast("long").alias("a"), F.col("b").cast("long").alias("b"), (F.col("k") / F.col("m") / F.col("mb")).alias("k"))
    own = mean.where("a = b")
    both = mean.where("a < b").join(own.select(F.col("a").alias("oa"), F.col("k").alias("ka")), F.col("a") == F.col("oa")).join(own.select(F.col("a").alias("ob"), F.col("k").alias("kb")), F.col("b") == F.col("ob"))
    return both.select(F.col("a").alias("label_a"), F.col("b").alias("label_b"), r6(F.col("ka") - 2 * F.col("k") + F.col("kb")).alias("mmd"))


@query(f"with m as (select event_type, avg(value) as m from events group by 1) select a.event_type as type_a, b.event_type as type_b, {r6s('(a.m-b.m)*(a.m-b.m)')} as mmd from m a join m b on a.event_type < b.event_type")
def mmd_linear_by_event_type(spark, sf_dir):
    """For the dot product the discrepancy is the squared difference of means: linear time."""
    m = events(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("m"))
    a, b = m.select(F.col("event_type").alias("type_a"), F.col("m").alias("ma")), m.select(F.col("event_type").alias("type_b"), F.col("m").alias("mb"))
    return a.join(b, F.col("type_a") < F.col("type_b")).select("type_a", "type_b", r6((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb"))).alias("mmd"))


@query(f"with {CLOUD_SQL}, xx as (select avg({KERNEL_SQL['gaussian']}) as kxx from cen p, cen c), yx as (select p.id, avg({KERNEL_SQL['gaussian']}) as k from pts p, cen c group by p.id) select id, {r6s('1 + kxx - 2*k')} as value from yx, xx")
def discrepancy_functional(spark, sf_dir):
    return gram.discrepancy_to(label_means(spark, sf_dir), cloud(spark, sf_dir), "gaussian").select("id", r6("value").alias("value"))


@query(f"with {CLOUD_SQL} select p.id as x_id, c.id as y_id, {r6s(_total('U+V'))} as total, len(p.x) as width from pts p, cen c")
def cartesian_sum(spark, sf_dir):
    out = gram.cartesian(cloud(spark, sf_dir), label_means(spark, sf_dir), "sum")
    return out.select("x_id", F.col("y_id").cast("long").alias("y_id"), r6(arrays.total(F.col("x"))).alias("total"), F.size("x").cast("long").alias("width"))


@query(f"with {CLOUD_SQL} select p.id as x_id, c.id as y_id, {r6s('list_sum(list_concat(p.x, c.x))')} as total, len(list_concat(p.x, c.x)) as width from pts p, cen c")
def cartesian_outer_product(spark, sf_dir):
    out = gram.cartesian(cloud(spark, sf_dir), label_means(spark, sf_dir), "outer")
    return out.select("x_id", F.col("y_id").cast("long").alias("y_id"), r6(arrays.total(F.col("x"))).alias("total"), F.size("x").cast("long").alias("width"))


# columns, boxes, metrics


@query("select 'p_size' as dim, min(p_size)::double as low, max(p_size)::double as high from part union all select 'p_retailprice', min(p_retailprice), max(p_retailprice) from part")
def bounding_box(spark, sf_dir):
    return columns.bound_box(tables.table(spark, sf_dir, "part"), "p_size", "p_retailprice")


@query(f"with b as (select 'p_size' as dim, min(p_size)::double as low, max(p_size)::double as high from part union all select 'p_retailprice', min(p_retailprice), max(p_retailprice) from part) select dim, {r6s('(low+high)/2 + (low-(low+high)/2)*0.5')} as low, {r6s('(low+high)/2 + (high-(low+high)/2)*0.5')} as high from b")
def bounding_box_scaled(spark, sf_dir):
    return columns.bound_box(tables.table(spark, sf_dir, "part"), "p_size", "p_retailprice", coeff=0.5).select("dim", r6("low").alias("low"), r6("high").alias("high"))


@query("with b as (select min(p_size)*1.0 as l1, max(p_size)*1.0 as h1, min(p_retailprice) as l2, max(p_retailprice) as h2 from part) select l_orderkey, l_linenumber, greatest(least(l_quantity, h1), l1)::double as l_quantity, greatest(least(l_extendedprice, h2), l2)::double as l_extendedprice from lineitem, b")
def clamp(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select(F.col("p_size").alias("l_quantity"), F.col("p_retailprice").alias("l_extendedprice"))
    box = columns.bound_box(part, "l_quantity", "l_extendedprice")
    return columns.clamp_to(tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), box)


@query("select o_orderkey, o_orderstatus from orders where o_orderkey is null or o_orderstatus is null")
def null_rows(spark, sf_dir):
    return columns.null_rows(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@query("with s as (select count(distinct region)+max((region is null)::int) as a, count(distinct tag)+max((tag is null)::int) as b, count(distinct p_size)+max((p_size is null)::int) as c from (select 'x' as region, null::varchar as tag, p_size from part)) select 'region' as \"column\" from s where a=1 union all select 'tag' from s where b=1 union all select 'p_size' from s where c=1")
def constant_columns(spark, sf_dir):
    return columns.constant_columns(tables.table(spark, sf_dir, "part").select(F.lit("x").alias("region"), F.lit(None).cast("string").alias("tag"), "p_size"))


@query("select c_custkey, c_nationkey from customer")
def column_selector(spark, sf_dir):
    return columns.column_selector(tables.table(spark, sf_dir, "customer"), keep=["c_cust", "c_n"], drop=["c_name"])


@query(f"select vec_id as id, {r6s('embedding[label+1]::double')} as v from embeddings")
def gather(spark, sf_dir):
    return labelled_cloud(spark, sf_dir).select("id", r6(arrays.gather(F.col("x"), F.col("label").cast("int"))).alias("v"))


@query(f"select vec_id as id, {r6s('list_sum(embedding::double[]) - embedding[label+1]::double + (embedding[label+1]::double + 2)')} as total from embeddings")
def fill(spark, sf_dir):
    filled = arrays.fill(F.col("x"), F.lit(2.0), F.col("label").cast("int"), lambda old, new: old + new)
    return labelled_cloud(spark, sf_dir).select("id", r6(arrays.total(filled)).alias("total"))


def _rows(op: str) -> Query:
    f = {"argmax": arrays.argmax, "argmin": arrays.argmin}
    return lambda spark, sf_dir: cloud(spark, sf_dir).select("id", (f[op](F.col("x")).cast("long") if op in f else r6(F.array_max("x") if op == "max" else F.array_min("x"))).alias("v"))


for _o, _s in (("argmax", "list_position(x, list_max(x))-1"), ("argmin", "list_position(x, list_min(x))-1"), ("max", "list_max(x)"), ("min", "list_min(x)")):
    register(f"row_{_o}", _rows(_o), f"with {CLOUD_SQL} select id, {f'({_s})::bigint' if 'arg' in _o else r6s(_s)} as v from pts")


@query(f"with {CLOUD_SQL} select id, {r6s('list_max(list_transform(x, lambda v, k: case when k = (id % 64) + 1 then -1e9 else v end))')} as v from pts")
def row_max_masked(spark, sf_dir):
    """Row maximum with the diagonal place of the row left out."""
    return cloud(spark, sf_dir).select("id", r6(F.array_max(arrays.masked(F.col("x"), (F.col("id") % 64).cast("int"), -1e9))).alias("v"))


@query(f"select {r6s('avg((l_returnflag=l_linestatus)::int)')} as share, {r6s('sqrt(sum((l_quantity-l_tax)*(l_quantity-l_tax)))')} as l2, {r6s('sqrt(sum((l_quantity-l_tax)*(l_quantity-l_tax)))/(sqrt(sum(l_quantity*l_quantity))+sqrt(sum(l_tax*l_tax))+1e-5)')} as relative, {r6s('sum(abs(l_quantity-l_tax))/(sum(abs(l_quantity))+sum(abs(l_tax))+1e-8)')} as relative_1, {r6s('max(abs(l_quantity-l_tax))/(max(abs(l_quantity))+max(abs(l_tax))+1e-8)')} as relative_inf from lineitem")
def errors(spark, sf_dir):
    """Share of equal labels, L2 norm, and relative errors of order 2, 1 and infinity."""
    a, b = F.col("l_quantity"), F.col("l_tax")
    l2 = lambda c: F.sqrt(F.sum(c * c))
    return tables.table(spark, sf_dir, "lineitem").agg(
        r6(F.avg((F.col("l_returnflag") == F.col("l_linestatus")).cast("double"))).alias("share"), r6(l2(a - b)).alias("l2"), r6(l2(a - b) / (l2(a) + l2(b) + 1e-5)).alias("relative"),
        r6(F.sum(F.abs(a - b)) / (F.sum(F.abs(a)) + F.sum(F.abs(b)) + 1e-8)).alias("relative_1"), r6(F.max(F.abs(a - b)) / (F.max(F.abs(a)) + F.max(F.abs(b)) + 1e-8)).alias("relative_inf"),
    )


@query("select l_returnflag as truth, l_linestatus as predicted, count(*) as n from lineitem group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return udfs.confusion(tables.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("select count(*) * 5 as cells from nation")
def frame_cells(spark, sf_dir):
    """Length of a frame in cells."""
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit(1).alias("a"), F.lit(2).alias("b"))
    return n.agg((F.count("*") * len(n.columns)).alias("cells"))


@query(f"with {CLOUD_SQL} select p.id as x_id, c.id as y_id, {r6s(f'0.5*{_R22}')} as k from pts p, cen c")
def gram_user_kernel(spark, sf_dir):
    """A kernel given as functions of blocks."""
    spec = KernelSpec("user", params={"k": lambda a, b: kernels.sq_dist(a, b) / 2, "grad": lambda a, b: a[:, None] - b[None]})
    y = gram.centres(label_means(spark, sf_dir))
    out = gram.knm(cloud(spark, sf_dir), y, spec).select("id", F.explode(F.arrays_zip(F.lit([int(i) for i in y.ids]).alias("c"), F.col("k").alias("k"))).alias("z"))
    return out.select(F.col("id").alias("x_id"), F.col("z.c").cast("long").alias("y_id"), r6("z.k").alias("k"))


@query(f"with {CLOUD_SQL} select id, {r6s('list_sum(list_transform(x, lambda v: v*v*v))')} as y from pts")
def row_function(spark, sf_dir):
    """A user's vector -> number function on every row."""
    return udfs.scalar(cloud(spark, sf_dir), lambda r: float((r**3).sum())).select("id", r6("y").alias("y"))


@query("select event_id, a.a::bigint as place, (a.a = event_id % 3)::int::double as v from events, range(3) a(a)")
def rl_hot_encoder(spark, sf_dir):
    """One-hot actions in numeric order, absent actions as zero columns."""
    hot = arrays.one_hot((F.col("event_id") % 3).cast("int"), 3)
    return events(spark, sf_dir).select("event_id", F.posexplode(hot).alias("place", "v")).select("event_id", F.col("place").cast("long").alias("place"), "v")


# casts


@query(f"select o_orderkey, ((o_orderdate::date - date '1970-01-01') + 719163)::double as ordinal, epoch_us(o_orderdate)::double/1e6 as seconds, {r6s('(epoch_us(o_orderdate)::double/1e6)/86400')} as days, coalesce(try_cast(o_orderpriority as double), -1.0) as priority from orders")
def cast_floats(spark, sf_dir):
    d = F.col("o_orderdate")
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", casts.date_ordinal(d).alias("ordinal"), casts.timestamp_seconds(d).alias("seconds"), r6(casts.interval_days(casts.timestamp_seconds(d))).alias("days"), casts.float_nan(F.col("o_orderpriority"), -1.0).alias("priority"))


@query("select o_orderkey, strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')::date::varchar as d, (date '1970-01-01' + (o_orderkey % 20000)::int)::varchar as e from orders")
def cast_dates(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", casts.date_of(F.date_format("o_orderdate", "dd/MM/yyyy")).cast("string").alias("d"), casts.date_of_ordinal(F.col("o_orderkey") % 20000 + casts.EPOCH_ORDINAL).cast("string").alias("e"))


@query("select vec_id as id, (u.d-1)::bigint as k, round(embedding[u.d]::double, 6)+0.0 as v from embeddings, unnest(range(1, 65)) as u(d)")
def multimap_rows(spark, sf_dir):
    return cloud(spark, sf_dir).select("id", F.posexplode("x").alias("k", "v")).select("id", F.col("k").cast("long").alias("k"), r6("v").alias("v"))


# encodings


SEGMENTS = "with s as (select distinct c_mktsegment from customer)"


@query("select c_custkey, " + ", ".join(f"(c_mktsegment='{s}')::int::double as \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer")
def onehot(spark, sf_dir):
    """One-hot columns named <column>_<value>; the values are the sorted distinct ones."""
    c = tables.table(spark, sf_dir, "customer")
    values = sorted({r[0] for r in c.select("c_mktsegment").distinct().limit(10_000).collect()} | {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"})
    return c.select("c_custkey", *(F.when(F.col("c_mktsegment") == v, 1.0).otherwise(0.0).alias(f"c_mktsegment_{v}") for v in values))


@query("with s as (select list(n order by n) as names from (select distinct c_mktsegment as n from customer)) select c_custkey, (list_position(names, c_mktsegment)-1)::bigint as place, 1.0::double as total from customer, s")
def unity_partition(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    values = sorted(r[0] for r in c.select("c_mktsegment").distinct().limit(10_000).collect())
    hot = arrays.unity_partition(F.col("c_mktsegment"), values)
    return c.select("c_custkey", arrays.argmax(hot).cast("long").alias("place"), arrays.total(hot).alias("total"))


@query("select vec_id as id, label::bigint as place, 1.0::double as total, 12::bigint as width from embeddings")
def simple_hot_encoder(spark, sf_dir):
    hot = arrays.one_hot(F.col("label").cast("int"), 12)
    return labelled_cloud(spark, sf_dir).select("id", arrays.argmax(hot).cast("long").alias("place"), arrays.total(hot).alias("total"), F.size(hot).cast("long").alias("width"))


_SOFT = "list_transform(x, lambda v: exp(v - list_max(x)))"


@query(f"with {CLOUD_SQL}, s as (select id, {_SOFT} as e from pts) select id, {r6s('list_max(e)/list_sum(e)')} as top, {r6s('list_min(e)/list_sum(e)')} as low from s")
def softmax(spark, sf_dir):
    s = cloud(spark, sf_dir).select("id", arrays.softmax(F.col("x")).alias("p"))
    return s.select("id", r6(F.array_max("p")).alias("top"), r6(F.array_min("p")).alias("low"))


@query(f"with {CLOUD_SQL}, s as (select id, x, list_transform(x, lambda v: exp(v)) as e from pts), t as (select id, list_transform(list_zip(e, x), lambda z: z[1]*exp(z[2])) as w from s) select id, {r6s('list_max(w)/list_sum(w)')} as top from t")
def verhulst(spark, sf_dir):
    """Replicator step of softmax(x) with advantages x."""
    v = cloud(spark, sf_dir).select("id", arrays.verhulst(arrays.softmax(F.col("x")), F.col("x")).alias("p"))
    return v.select("id", r6(F.array_max("p")).alias("top"))


@query(f"with {CLOUD_SQL}, s as (select id, list_transform(x, lambda v: abs(v)+1e-3) as a from pts) select id, {r6s('list_max(a)/list_sum(a)')} as top from s")
def probas_projection(spark, sf_dir):
    p = cloud(spark, sf_dir).select("id", arrays.probas_projection(F.transform("x", lambda v: F.abs(v) + 1e-3)).alias("p"))
    return p.select("id", r6(F.array_max("p")).alias("top"))


@query("select vec_id as id, (u.j-1)::bigint as j, (w.k-1)::bigint as k, round(p[u.j]*((u.j=w.k)::int - p[w.k]), 6)+0.0 as v from (select vec_id, list_transform(e, lambda t: t/list_sum(e)) as p from (select vec_id, list_transform(embedding[1:4]::double[], lambda t: abs(t)+1e-3) as e from embeddings)), unnest(range(1,5)) as u(j), unnest(range(1,5)) as w(k)")
def tensor_probas(spark, sf_dir):
    p = arrays.probas_projection(F.transform(F.slice("x", 1, 4), lambda v: F.abs(v) + 1e-3))
    t = cloud(spark, sf_dir).select("id", p.alias("p")).select("id", F.posexplode(arrays.tensor_probas(F.col("p"))).alias("j", "row"))
    return t.select("id", F.col("j").cast("long").alias("j"), F.posexplode("row").alias("k", "v")).select("id", "j", F.col("k").cast("long").alias("k"), r6("v").alias("v"))


@query("select vec_id as id, (u.c-1)::bigint as c, round(embedding[u.c]::double + embedding[u.c+2]::double, 6)+0.0 as total from embeddings, unnest(range(1,3)) as u(c)")
def format_32(spark, sf_dir):
    """A 2 x 2 matrix per row, brought to rows by its last index."""
    m = cloud(spark, sf_dir).select("id", F.array(F.slice("x", 1, 2), F.slice("x", 3, 2)).alias("a"))
    flat = m.select("id", F.posexplode(F.array(F.lit(0), F.lit(1))).alias("c", "__d"), "a").select("id", "c", F.transform("a", lambda r: F.get(r, F.col("c"))).alias("row"))
    return flat.select("id", F.col("c").cast("long").alias("c"), r6(arrays.total(F.col("row"))).alias("total"))


@query("select vec_id as id, 70::bigint as width, round(list_sum(embedding::double[]), 6)+0.0 as total from embeddings")
def pad_axis(spark, sf_dir):
    p = arrays.pad(F.col("x"), 70)
    return cloud(spark, sf_dir).select("id", F.size(p).cast("long").alias("width"), r6(arrays.total(p)).alias("total"))


# ordered


_RETURNS = f"select event_id, user_id, ts, value, list_reduce(list_prepend(0.0::double, list(value) over (partition by user_id order by ts desc, event_id desc rows between unbounded preceding and current row)), lambda acc, v: v + {GAMMA} * acc) as ret from events"


@query(f"select event_id, {r6s('ret')} as ret from ({_RETURNS})")
def discounted_return(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return order.discounted_returns(rows, "user_id", "value", [F.desc("ts"), F.desc("event_id")], GAMMA).select("event_id", r6("ret").alias("ret"))


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 20")
def replay_last_rows(spark, sf_dir):
    return order.keep_last(events(spark, sf_dir).select("event_id", "user_id", "ts"), [F.desc("ts"), F.desc("event_id")], 20, "user_id").select("event_id", "user_id")


@query("with g as (select user_id, count(*) as n, sum(value)-var_pop(value) as s from events group by 1), f as (select user_id, n, sum(n) over (order by s desc, user_id) as upto from g) select user_id, n from f where upto <= (select count(*) // 2 from events)")
def replay_best_games(spark, sf_dir):
    """Whole games with the best score that fit half of all rows."""
    e = events(spark, sf_dir).select("user_id", "value")
    kept = order.keep_best_games(e, "user_id", "value", e.count() // 2)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"select user_id, count(*) as n, {r6s('sum(value)-var_pop(value)')} as score from events group by 1")
def game_scores(spark, sf_dir):
    return order.game_scores(events(spark, sf_dir), "user_id", "value").select("user_id", "n", r6("score").alias("score"))


@query("select event_id, user_id, row_number() over (order by value, event_id) - 1 as position from events")
def lexicographical_permutation(spark, sf_dir):
    return order.lexicographical_permutation(events(spark, sf_dir).select("event_id", "user_id", "value"), "value", "event_id").select("event_id", "user_id", F.col("position").cast("long").alias("position"))


@query(f"select s_suppkey, {r6s('(row_number() over (order by s_acctbal, s_suppkey) - 0.5)/(count(*) over ())')} as grid from supplier")
def grid_projection(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    ranked = order.global_rank(s, ["s_acctbal", "s_suppkey"], "rank")
    return ranked.select("s_suppkey", r6((F.col("rank") - 0.5) / s.count()).alias("grid"))


@query("with c as (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2) select o_custkey, arg_min(o_orderstatus, struct_pack(a := -n, b := o_orderstatus)) as mode from c group by 1")
def mode_map(spark, sf_dir):
    return order.most_frequent(tables.table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("select l_suppkey, count(distinct l_partkey) as n, min(l_partkey) as first, max(l_partkey) as last from lineitem group by 1")
def map_inversion(spark, sf_dir):
    inv = transport.map_inversion(tables.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return inv.select("l_suppkey", F.size("keys").cast("long").alias("n"), F.array_min("keys").alias("first"), F.array_max("keys").alias("last"))


@query("select o_custkey, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from orders group by 1")
def split_by_values(spark, sf_dir):
    g = order.grouped_lists(tables.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return g.select("o_custkey", F.size("values").cast("long").alias("n"), F.array_min("values").alias("first"), F.array_max("values").alias("last"))


@query("select c_custkey, coalesce(n_regionkey, -1)::int as mapped from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 20")
def remap(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return order.remap(tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", n, "n_nationkey", "n_regionkey", -1).select("c_custkey", F.col("mapped").cast("int").alias("mapped"))


_GRID = [900.0 + 50.0 * k for k in range(25)]
_GRID_SQL = f"with g as (select unnest({_GRID}) as v, unnest(range(0,25)) as k)"


@query(f"{_GRID_SQL} select p_partkey, coalesce(min(case when v >= p_retailprice then k end), 24)::int as closest_index, arg_min(v, struct_pack(a := abs(v-p_retailprice), b := v))::double as closest_value from part, g group by 1")
def asof_nearest(spark, sf_dir):
    return order.closest(tables.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", _GRID).select("p_partkey", "closest_index", "closest_value")


@query("select p_partkey, arg_min(s_acctbal, struct_pack(a := abs(s_acctbal-p_retailprice), b := s_acctbal)) as closest_value from part, supplier group by 1")
def asof_join(spark, sf_dir):
    """Nearest supplier balance for each part price, by one merged order."""
    p = tables.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return order.asof_closest(p, tables.table(spark, sf_dir, "supplier").select("s_acctbal"), "p_retailprice", "s_acctbal").select("p_partkey", "closest_value")


# maps


for _m, _e in (("std", "(s_acctbal-avg(s_acctbal) over ())/stddev_pop(s_acctbal) over ()"), ("unitcube", "(s_acctbal-min(s_acctbal) over ()+0.5/count(*) over ())/(max(s_acctbal) over ()-min(s_acctbal) over ()+1.0/count(*) over ())"), ("meandistance", "s_acctbal/sqrt(2*var_pop(s_acctbal) over ())")):
    register(f"map_{_m}", (lambda m: lambda spark, sf_dir: maps.window_scale(tables.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", m, "v").select("s_suppkey", r6("v").alias("v")))(_m), f"select s_suppkey, {r6s(_e)} as v from supplier")


@query(f"with {CLOUD_SQL}, a as (select 2*sum(v) as alpha from (select var_pop(x[d]) as v from pts, unnest(range(1,65)) as u(d) group by d)) select id, {r6s('list_sum(x)/sqrt(alpha)')} as total from pts, a")
def map_mean_distance_cloud(spark, sf_dir):
    """The mean-distance map on 64 dimensions, from moments alone."""
    pts = cloud(spark, sf_dir)
    chain = maps.fit("meandistance", pts)
    return pts.select("id", r6(arrays.total(chain.column(F.col("x")))).alias("total"))


@query(f"with {CLOUD_SQL} select id, {r6s('list_sum(list_transform(x, lambda v: ln(exp(v)*2.0+1.5)/0.5))')} as total from pts")
def map_chain(spark, sf_dir):
    """exp, affine, log and bandwidth maps, in a chain of columns."""
    pts = cloud(spark, sf_dir)
    chain = maps.MapChain((maps.FittedMap("exp"), maps.FittedMap("affine_map", (2.0,) * 64, (1.5,) * 64), maps.FittedMap("log"), maps.FittedMap("scale_factor", (2.0,) * 64)))
    return pts.select("id", r6(arrays.total(chain.column(F.col("x")))).alias("total"))


@query()
def map_standard_mean(spark, sf_dir):
    """Unit cube, inverse error function, mean distance: fitted chain, numpy form."""
    pts = cloud(spark, sf_dir)
    chain = maps.fit("standardmean", pts)
    return gram.by_block(pts, lambda ids, m: {"id": ids[0], "z": gram._lists(chain.apply(m))}, "id long, z array<double>", 64).select("id", r6(arrays.total(F.col("z"))).alias("total"))


# regression


@query(f"select {r6s('regr_slope(l_extendedprice, l_quantity)')} as slope, {r6s('regr_intercept(l_extendedprice, l_quantity)')} as intercept from lineitem")
def linear_fit(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return li.agg(r6(F.regr_slope("l_extendedprice", "l_quantity")).alias("slope"), r6(F.regr_intercept("l_extendedprice", "l_quantity")).alias("intercept"))


@query("with f as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem) select p_partkey, round(a*p_size+b, 2)+0.0 as f from part, f")
def polynomial_regression(spark, sf_dir):
    """Order-1 least squares by accumulated normal equations, predicted on parts."""
    li = tables.table(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("v"))
    fitted = model.PolynomialRegression.fit(li, ["v"], 1)
    z = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("x"))
    return fitted.predict(z).select(F.col("id").alias("p_partkey"), (F.round(F.get("f", F.lit(0)), 2) + 0.0).alias("f"))


def _target() -> Column:
    """A smooth function of the point, as the labels carry no signal."""
    return F.sin(3 * F.get("x", F.lit(0))) + F.get("x", F.lit(1)) * F.get("x", F.lit(2))


def _valued(spark, sf_dir) -> DataFrame:
    return cloud(spark, sf_dir).withColumn("f", _target())


@query()
def kernel_regression(spark, sf_dir):
    """Fit on all points with bounded centres, predict on all."""
    pts = _valued(spark, sf_dir)
    m = model.fit(pts, ["f"], KernelSpec.default("maternnorm", reg=1e-6))
    return m.predict(pts, "p").join(pts.select("id", "f"), "id").select("id", F.round("f", 4).alias("f"), F.round(F.get("p", F.lit(0)), 4).alias("p"))


@query()
def kernel_regression_update(spark, sf_dir):
    """The model refitted on new data with its centres kept."""
    pts = _valued(spark, sf_dir)
    m = model.fit(pts, ["f"], KernelSpec.default("maternnorm", reg=1e-6), y=gram.centres(label_means(spark, sf_dir)))
    m = m.update(pts.withColumn("f", F.col("f") * 2), ["f"])
    return m.predict(pts, "p").select("id", F.round(F.get("p", F.lit(0)), 4).alias("p"))


@query()
def kernel_classifier(spark, sf_dir):
    pts = _valued(spark, sf_dir).select("id", "x", F.when(F.col("f") > 0, 1.0).otherwise(0.0).alias("p1"), F.when(F.col("f") > 0, 0.0).otherwise(1.0).alias("p0"))
    c = model.KernelClassifier.fit(pts, ["p1", "p0"], KernelSpec.default("maternnorm", reg=1e-4))
    return c.predict(pts).select("id", F.round(F.get("p", F.lit(0)), 4).alias("p1"))


@query()
def kernel_regression_multiscale(spark, sf_dir):
    pts = _valued(spark, sf_dir)
    predict = model.fit_multiscale(pts, ["f"], KernelSpec.default("maternnorm", reg=1e-6), gram.centres(label_means(spark, sf_dir)), 200)
    return predict(pts).select("id", F.round(F.get("f", F.lit(0)), 4).alias("p"))


@query()
def kernel_gradient(spark, sf_dir):
    pts = _valued(spark, sf_dir)
    m = model.fit(pts, ["f"], KernelSpec("gaussian", "meandistance", reg=1e-6))
    return m.grad(pts).select("id", F.round(F.get(F.get("grad", F.lit(0)), F.lit(0)), 4).alias("d0"))


@query()
def kernel_density(spark, sf_dir):
    pts = _valued(spark, sf_dir)
    m = model.fit(pts, ["f"], KernelSpec("gaussian", reg=1e-6), y=gram.centres(label_means(spark, sf_dir), None))
    return m.density(pts).select("id", F.round("density", 5).alias("density"))


@query()
def differential_operators(spark, sf_dir):
    """Norms of gradient, divergence, Laplace form, both projections and Hessian on the
    label means."""
    c = gram.centres(label_means(spark, sf_dir))
    x, f = c.x[:, :2], np.sin(3 * c.x[:, :1]) + c.x[:, 1:2]
    s = KernelSpec("gaussian", reg=1e-6)
    g = differential.nabla(x, x, s, f)
    rows = {"nabla": g, "nabla_t": differential.nabla_t(x, x, s, g), "nabla_t_nabla": differential.nabla_t_nabla(x, x, s, f), "nabla_inv": differential.nabla_inv(x, x, s, g), "leray_t": differential.leray_t(x, s, g), "leray": differential.leray(x, s, g), "hessian": differential.hessian(x, x, s, f), "taylor": differential.taylor(x, x + 0.01, f, g), "denoiser": differential.denoiser(x, f, x, s)}
    return spark.createDataFrame([(k, round(float(np.abs(v).sum()), 3)) for k, v in rows.items()], "operator string, size double")


# derivatives by the tape


_X1, _ALL = "x[1]", "list_sum(x)"
#: What each operator gives for x1 * sum(x^3) (divergence, Jacobian: of the field x^2 x1), summed over its entries.
_TAPE_SQL = {
    "nabla": f"list_sum(list_transform(x, lambda v: v*v*v)) + 3*{_X1}*list_sum(list_transform(x, lambda v: v*v))",
    "jacobian": f"2*{_X1}*{_ALL} + list_sum(list_transform(x, lambda v: v*v))",
    "hessian": f"6*list_sum(list_transform(x, lambda v: v*v)) + 6*{_X1}*{_ALL}",
    "divergence": f"2*{_X1}*{_ALL} + {_X1}*{_X1}",
    "laplace": f"6*{_X1}*{_X1} + 6*{_X1}*{_ALL}",
}


def _by_tape(operator: str) -> Query:
    def run(spark, sf_dir):
        cubes = lambda x: x[:, 0] * (x**3).sum(1)
        field = lambda x: x**2 * x[:, :1]
        out = tape.over(cloud(spark, sf_dir), field if operator in ("divergence", "jacobian") else cubes, operator)
        return out.select("id", r6(arrays.total(F.col("g"))).alias("total"))

    return run


for _o, _s in _TAPE_SQL.items():
    register(f"autodiff_{_o}", _by_tape(_o), f"with pts as (select vec_id as id, embedding::double[] as x from embeddings) select id, {r6s(_s)} as total from pts")


# linear algebra


_COO = "a as (select vec_id as i, u.d-1 as j, embedding[u.d]::double as v from embeddings, unnest(range(1,65)) as u(d))"


@query(f"with {_COO} select x.j as i, y.j as j, round(sum(x.v*y.v), 4)+0.0 as v from a x join a y on x.i=y.i group by 1, 2")
def matrix_product(spark, sf_dir):
    """X'X of all points: a coordinate join summed by cell."""
    a = linalg.coo(cloud(spark, sf_dir), "id", "x")
    out = linalg.prod(linalg.transpose(a), a)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("v", 4) + 0.0).alias("v"))


@query(f"with {_COO} select j::bigint as i, i::bigint as j, {r6s('v')} as v from a")
def matrix_transpose(spark, sf_dir):
    t = linalg.transpose(linalg.coo(cloud(spark, sf_dir), "id", "x"))
    return t.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("v").alias("v"))


@query("select round(sum(p_size*p_retailprice), 2)+0.0 as product from part")
def scalar_product(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v")), p.select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))
    return linalg.scalar_product(a, b).select((F.round("product", 2) + 0.0).alias("product"))


_FACTORS = {
    "cholesky": "g + 64e-3", "cholesky_inverse": "g + 64e-3", "inverse": "g + 64", "polar": "g", "svd": "g", "eigh": "g", "nearest": "g",
    "nearest_of_indefinite": "g", "lstsq": "c", "vandermonde": "c4", "theta": "c",
}


@query(f"""with pts as (select embedding::double[] as x from embeddings), t as (select sum(list_sum(x) * list_sum(x)) as g, sum(list_sum(x)) as c, sum(x[1] + x[2] + x[3] + x[4]) as c4 from pts)
{' union all '.join(f"select '{k}' as factor, round({v}, 3) + 0.0 as total, true as exact from t" for k, v in _FACTORS.items())}""")
def matrix_factors(spark, sf_dir):
    """Factorisations of A = X'X, summed over all points, each multiplied back: the sum of
    the entries, and whether they are those of A (of the right side, for solvers)."""
    pts = cloud(spark, sf_dir)
    a, b, n = linalg.normal_equations(pts.withColumn("v", F.lit(1.0)), lambda t: (gram.rows_of(t.column(0)), np.ones((t.num_rows, 1)), None), ["x", "v"], 64, 1)
    i = np.eye(64)
    c, (q, p), (u, s, vt), (vec, val) = linalg.cholesky(a + 1e-3 * i), linalg.polar(a), linalg.svd(a), linalg.eigh(a)
    # an indefinite matrix: the nearest positive one keeps what its positive eigenvalues make
    low = vec @ np.diag(np.where(np.arange(64) % 2, val, -val)) @ vec.T
    kept = vec @ np.diag(np.where(np.arange(64) % 2, val, 1e-8)) @ vec.T
    # (I - dt/2 M) u1 = (I + dt/2 M) u0
    m, u0, nodes = -a / n, b[:, 0], np.sqrt(val[:4] + np.arange(4))
    u1 = linalg.theta_scheme(m, 0.1, u0)
    back = {
        "cholesky": (c @ c.T, a + 1e-3 * i),
        "cholesky_inverse": (np.linalg.inv(linalg.cholesky_inverse(a, 1e-3)), a + 1e-3 * i),
        "inverse": (np.linalg.inv(linalg.inverse(a + i)), a + i),
        "polar": (q @ p, a),
        "svd": (u @ np.diag(s) @ vt, a),
        "eigh": (vec @ np.diag(val) @ vec.T, a),
        "nearest": (linalg.nearest_positive(a), a),
        "nearest_of_indefinite": (linalg.nearest_positive(low) + (a - kept), a),
        "lstsq": (a @ linalg.solve_spd(a, b), b),
        "vandermonde": ((np.vander(linalg.fractions(nodes), increasing=True).T @ linalg.vandermonde(nodes, u0[:4], exact=True)).astype(float), u0[:4]),
        "theta": (u1 - 0.05 * m @ u1 - 0.05 * m @ u0, u0),
    }
    rows = [(k, round(float(np.sum(x)), 3) + 0.0, bool(np.abs(x - y).max() < 1e-6 * max(1.0, np.abs(y).max()))) for k, (x, y) in back.items()]
    return spark.createDataFrame(rows, "factor string, total double, exact boolean")


@query(f"with s as (select avg(l_quantity) as ma, stddev_pop(l_quantity) as sa, avg(l_tax) as mb, stddev_pop(l_tax) as sb from lineitem) select l_orderkey, l_linenumber, {r6s('(l_quantity-ma)/sa*2 + ma')} as l_quantity, {r6s('(l_tax-mb)/sb*3 + mb')} as l_tax from lineitem, s")
def fit_to_cov(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return linalg.fit_to_cov(li, ["l_quantity", "l_tax"], np.diag([4.0, 9.0])).withColumns({c: r6(c) for c in ("l_quantity", "l_tax")})


# points, clusters, transport, sampling


@query()
def kmeans_clusters(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return points.kmeans(pts, 8).labels(pts).select("id", "label")


def _greedy_sql(n: int) -> str:
    """Picks (rank, id, x) of the exact greedy choice, and pts with the mean kernel of each."""
    kernel = "exp(-list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1]-t[2])*(t[1]-t[2]))))"
    return f"""
raw as (select vec_id as id, embedding::double[] as x from embeddings),
pts as (select a.id, a.x, avg({kernel.format(a='a.x', b='b.x')}) as p from raw a, raw b group by a.id, a.x),
walk as (
  select 1 as m, id, x, p, 0.0::double as s, 0.0::double as inside, 0.0::double as across, false as taken from pts
  union all
  select m + 1, id, x, p, s + {kernel.format(a='x', b='bx')}, inside + 2*bs + 1, across + bp, taken or id = bid
  from (select *, first_value(id) over o as bid, first_value(x) over o as bx, first_value(s) over o as bs, first_value(p) over o as bp
        from walk where m <= {n}
        window o as (order by case when taken then 'infinity'::double else (inside + 2*s + 1)/(m*m) - 2*(across + p)/m end, id)) b),
picks as (select (m - 2)::bigint as rank, w.id, w.x from walk w where taken and m = (select min(m) from walk v where v.id = w.id and v.taken))
"""


@query(f"with recursive {_greedy_sql(20)} select id, rank from picks")
def greedy_points(spark, sf_dir):
    return points.greedy_select(cloud(spark, sf_dir), 20, KernelSpec("gaussian")).select("id", "rank")


@query()
def greedy_nystroem(spark, sf_dir):
    pts = _valued(spark, sf_dir)
    m = points.greedy_nystroem(pts, ["f"], 40, KernelSpec("gaussian", reg=1e-6))
    return m.predict(pts, "p").select("id", F.round(F.get("p", F.lit(0)), 3).alias("p"))


@query(f"with recursive {_greedy_sql(8)} select p.id, arg_min(c.rank, (round(list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1]-t[2])*(t[1]-t[2]))), 12), c.rank)) as label from pts p, picks c group by p.id")
def greedy_cluster_labels(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return points.greedy_clusters(pts, 8, KernelSpec("gaussian")).labels(pts).select("id", "label")


@query()
def sharp_cluster_labels(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return points.sharp_clusters(pts, 8, KernelSpec("gaussian"), 5).labels(pts).select("id", "label")


@query()
def random_cluster_labels(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return points.random_clusters(pts, 8, KernelSpec("gaussian")).labels(pts).select("id", "label")


@query()
def balanced_cluster_labels(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return points.balanced_blocks(pts, points.random_clusters(pts, 8, KernelSpec("gaussian")))


@query("select c.* from (select (row_number() over (order by n_nationkey)) - 1 as job, n_nationkey from nation) c")
def assignment(spark, sf_dir):
    """Least-cost assignment of nations to places by |key - place|: the identity."""
    keys = [r[0] for r in tables.table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").limit(transport.EXACT_ROWS).collect()]
    cost = np.abs(np.array(keys, float)[:, None] - np.arange(len(keys)))
    rows = transport.lsap(cost)
    return spark.createDataFrame([(j, keys[r]) for j, r in enumerate(rows)], "job long, n_nationkey int")


def _mirror_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances in whole thousandths."""
    return np.rint(1000 * kernels.sq_dist(a, b))


@query()
def mirror_matching(spark, sf_dir):
    """Every point matched to a point read backwards, at least total cost."""
    pts = cloud(spark, sf_dir)
    return auction.match(pts, pts.select("id", F.reverse("x").alias("x")), _mirror_cost, whole=True)


@query()
def gromov_matching(spark, sf_dir):
    c = gram.centres(label_means(spark, sf_dir))
    d = kernels.sq_dist(c.x, c.x)
    p = transport.gromov_monge(d, d[np.ix_(np.arange(len(d))[::-1], np.arange(len(d))[::-1])])
    q = transport.gromov_plan(d, d)
    return spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(p, q))], "i long, monge long, plan long")


@query(f"""with recursive {CLOUD_SQL.strip()}, k as (select p.id as i, c.id as j, {KERNEL_SQL['gaussian']} as k from cen p, cen c),
walk as (select 0 as n, i, j, k, 1.0::double as a, 1.0::double as b from k
 union all select n + 1, i, j, k, a, 1 / sum(k * a) over (partition by j) from (select n, i, j, k, 1 / sum(k * b) over (partition by i) as a from walk where n < 50) s)
select i as x_id, j as y_id, {r6s('a * k * b / sum(a * k * b) over (partition by i)')} as p from walk where n = 50""")
def transition_matrix(spark, sf_dir):
    c = gram.centres(label_means(spark, sf_dir))
    p = transport.transition(c.x, c.x, KernelSpec("gaussian"))
    return spark.createDataFrame([(int(i), int(j), round(float(v), 6)) for i, row in zip(c.ids, p) for j, v in zip(c.ids, row)], "x_id long, y_id long, p double")


@query()
def generative_sampler(spark, sf_dir):
    """New points like the label means, from seeded latent draws."""
    c = gram.centres(label_means(spark, sf_dir))
    return conditional.Sampler.fit(c.x[:, :2]).sample(spark, 1000).select("id", F.round(F.get("x", F.lit(0)), 4).alias("x0"), F.round(F.get("x", F.lit(1)), 4).alias("x1"))


@query()
def matched_points(spark, sf_dir):
    y = points.match(cloud(spark, sf_dir), 10, KernelSpec("gaussian"), 3)
    return spark.createDataFrame([(i, round(float(v[0]), 4)) for i, v in enumerate(y)], "i long, x0 double")


_RANKED = "r as (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer)"


@query(f"with {_RANKED} select c_custkey, {', '.join(f'{r6s(sobol.coordinate_sql('i', j))} as u{j}' for j in range(3))} from r")
def qmc_uniforms(spark, sf_dir):
    """Scrambled Sobol points in three dimensions, one for each customer."""
    rows = sobol.attached(tables.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 3)
    return rows.select("c_custkey", *(r6(F.col("u")[j]).alias(f"u{j}") for j in range(3)))


@query(f"with {_RANKED}, u as (select c_custkey, {sobol.coordinate_sql('i', 0)} as a, {sobol.coordinate_sql('i', 1)} as b from r) select c_custkey, {r6s('sqrt(-ln(a))*cos(2*pi()*b)')} as half, {r6s('sqrt(-2*ln(a))*cos(2*pi()*b)')} as unit from u")
def qmc_normals(spark, sf_dir):
    """Quasi-random normals of variance 1/2 and 1, one for each customer."""
    rows = sobol.attached(tables.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 2)
    a, b = F.col("u")[0], F.col("u")[1]
    turn = F.cos(2 * np.pi * b)
    return rows.select("c_custkey", r6(F.sqrt(-F.log(a)) * turn).alias("half"), r6(F.sqrt(-2 * F.log(a)) * turn).alias("unit"))


@query(f"select c_custkey, {r6s(f'c_acctbal + 100*{_normal_sql('c_custkey', '0', 0)}')} as noisy from customer")
def random_normals(spark, sf_dir):
    """Balances with seeded normal noise of deviation 100, the same on any partitioning."""
    return tables.table(spark, sf_dir, "customer").select("c_custkey", r6(F.col("c_acctbal") + 100 * sampling.scattered_normal(F.col("c_custkey"), F.lit(0), 0)).alias("noisy"))


@query()
def weighted_resample(spark, sf_dir):
    return sampling.weighted_resample(tables.table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 1000)


@query(f"with {CLOUD_SQL}, t as (select c.id, d::int as draw, p.id as n, p.label::double as y, -ln({sampling.scattered_sql('c.id * 1000003 + d', 'p.id', 42)}) / {KERNEL_SQL['gaussian']} as t from cen c, pts p, range(20) r(d)) select id, draw, arg_min(y, (t, n)) as y from t group by id, draw")
def conditional_sample(spark, sf_dir):
    """Twenty draws of a training label for each label mean, weighted by the kernel."""
    pts = labelled_cloud(spark, sf_dir)
    return conditional.NadarayaWatson(pts, ("label",)).sample(label_means(spark, sf_dir), 20).select("id", "draw", F.get("y", F.lit(0)).alias("y"))


@query()
def transport_conditional(spark, sf_dir):
    """Conditional mean by the transport model on the first two coordinates."""
    pts = _valued(spark, sf_dir).select("id", F.slice("x", 1, 2).alias("x"), "f")
    return conditional.TransportConditional.fit_all(pts, ["f"]).expectation(pts).select("id", F.round(F.get("e", F.lit(0)), 3).alias("e"))


@query(" union all ".join(f"select {p}::double as p, {r6s(f'quantile_disc(s_acctbal, {p})')} as q from supplier" for p in (0.1, 0.5, 0.9)))
def quantile_values(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier")
    return conditional.quantile_regression(s, "s_acctbal", [0.1, 0.5, 0.9]).select("p", r6("q").alias("q"))


@query("""with recursive t as (select c_nationkey, c_mktsegment, count(*)::double as n from customer group by all),
s as (select c_mktsegment, row_number() over (order by c_mktsegment) - 1 as j from (select distinct c_mktsegment from customer)),
walk as (select 0 as r, k.c_nationkey, s.j, coalesce(t.n, 0) + 1e-6 as p from (select distinct c_nationkey from customer) k cross join s left join t on t.c_nationkey = k.c_nationkey and t.c_mktsegment = s.c_mktsegment
 union all select r + 1, c_nationkey, j, q / sum(q) over (partition by c_nationkey) from (select r, c_nationkey, j, p / sum(p) over (partition by j) * (count(*) over (partition by j)) / (count(*) over (partition by c_nationkey)) as q from walk where r < 100) w)
select c_nationkey, j, round(p, 5) + 0.0 as p from walk where r = 100""")
def proportional_fitting(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment").count().na.fill(0).orderBy("c_nationkey").limit(linalg.DRIVER_ROWS).collect()
    p = model.proportional_fitting(np.array([r[1:] for r in c], float) + 1e-6)
    return spark.createDataFrame([(r[0], j, round(float(v), 5)) for r, row in zip(c, p) for j, v in enumerate(row)], "c_nationkey int, j long, p double")


@query(f"with {CLOUD_SQL}, f as (select id, x, -list_sum(list_transform(x, lambda v: (v - 0.1) * (v - 0.1))) as v from pts) select {r6s('x[1]')} as x0, {r6s('v')} as v from f order by f.v desc, id limit 1")
def screened_optimum(spark, sf_dir):
    """Best point of a concave function over the embedding cloud."""
    x, v = optimize.screen(lambda m: -((m - 0.1) ** 2).sum(1), cloud(spark, sf_dir))
    return spark.createDataFrame([(round(float(x[0]), 6), round(float(v), 6))], "x0 double, v double")


# decision logs


def _log(spark, sf_dir) -> DataFrame:
    """Events as a log: state = (value, hour), action = type, next state = the event after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumns({"v": F.col("value") / 100, "h": F.hour("ts") / 24.0, "action": F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(3)).cast("int")})
    e = e.withColumns({"nv": F.lead("v").over(w), "nh": F.lead("h").over(w)})
    return e.select(F.col("user_id").alias("game"), casts.timestamp_seconds(F.col("ts")).alias("t"), "event_id", F.array("v", "h").alias("state"), "action", F.array(F.coalesce("nv", F.lit(0.0)), F.coalesce("nh", F.lit(0.0))).alias("next_state"), F.col("value").alias("reward"), F.col("nv").isNull().alias("done"))


_Q = "select event_id, value, q, list_prepend(v, [h, v*h]) as nq, done from (select event_id, value, value/100 as v, hour(ts)/24.0 as h, value/50 as q, lead(event_id) over (partition by user_id order by ts, event_id) is null as done from events)"


def _with_q(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v, h = F.col("value") / 100, F.hour("ts") / 24.0
    return events(spark, sf_dir).select("event_id", "value", (F.col("value") / 50).alias("q"), F.array(v, h, v * h).alias("nq"), F.lead("event_id").over(w).isNull().alias("done"))


@query(f"select event_id, {r6s(f'q - value - {GAMMA} * (case when done then 0 else list_max(nq) end)')} as error from ({_Q})")
def bellman_error(spark, sf_dir):
    return _with_q(spark, sf_dir).select("event_id", r6(agents.bellman_error(F.col("q"), F.col("value"), F.col("nq"), F.col("done"))).alias("error"))


@query(f"with a as (select event_id, list_transform(nq, lambda t: {GAMMA}*t + value - q) as s from ({_Q})) select event_id, (list_position(s, list_max(s)) - 1)::int as action from a")
def bellman_optimal_action(spark, sf_dir):
    return _with_q(spark, sf_dir).select("event_id", agents.optimal_action(F.col("q"), F.col("value"), F.col("nq")).alias("action"))


@query(f"with a as (select event_id, done, list_transform(nq, lambda t: {GAMMA}*t + value - q) as s from ({_Q})) select event_id, round((case when done then 0 else list_max(s) - list_sum(s)/3 end)::double, 9) + 0.0 as top from a")
def advantages(spark, sf_dir):
    a = _with_q(spark, sf_dir).select("event_id", agents.advantages(F.col("nq"), F.col("value"), F.col("q"), F.col("done")).alias("a"))
    return a.select("event_id", (F.round(F.array_max("a"), 9) + 0.0).alias("top"))


@query("select c_custkey, a::bigint as action from customer, range(3) t(a)")
def all_state_actions(spark, sf_dir):
    return agents.all_state_actions(tables.table(spark, sf_dir, "customer").select("c_custkey"), 3).select("c_custkey", F.col("action").cast("long").alias("action"))


def _states(log: DataFrame) -> DataFrame:
    return log.select(F.col("event_id").alias("id"), F.col("state").alias("x"))


def _trained(how: str) -> Query:
    def run(spark, sf_dir):
        log = _log(spark, sf_dir)
        a = log_training.fit_all(agents.Agent(3), log, how)
        acts = a.act(_states(log), greedy=True) if how.startswith("q") else log_training.policy_actions(a, _states(log))
        return acts.select(F.col("id").alias("event_id"), F.col("action").cast("long").alias("action"))

    return run


for _h in log_training.HOWS:
    register(f"agent_{_h}", _trained(_h))


@query()
def agent_greedy_actions(spark, sf_dir):
    """Greedy actions of a trained agent on every event: a narrow pass."""
    log = _log(spark, sf_dir)
    return log_training.fit_all(agents.Agent(3), log).act(_states(log), greedy=True)


@query()
def game_model_values(spark, sf_dir):
    """Rewards of events by the models of eight batches of games, each event by the nearest."""
    log = _log(spark, sf_dir)
    train = log.select(F.col("state").alias("x"), "reward", F.pmod("game", F.lit(8)).alias("batch"))
    ring = game_models.GameModels(("reward",), KernelSpec("gaussian", reg=1e-2), most=100).add(train, "batch")
    return ring.predict(_states(log)).select(F.col("id").alias("event_id"), F.round(F.get("f", F.lit(0)), 2).alias("value"))


@query()
def state_values(spark, sf_dir):
    """V at every event's state, from sums over the whole log."""
    log = _log(spark, sf_dir)
    return log_training.state_values(agents.Agent(3), log, _states(log)).select(F.col("id").alias("event_id"), F.round("v", 4).alias("v"))
