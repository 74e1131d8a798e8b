"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target in words: its weight's share of all words, at most
cap times its own size, what is over reshared by weight until none is above (a
water filling: the level rises, a sum over the sources a step, until no more
sources are full). A document of source s is wanted e = target/size(s) times:
floor(e) whole copies are certain, and the rest pi = e - floor(e) is drawn by
Pareto order sampling: documents are ranked by Q = (U/(1-U)) / (pi/(1-pi)), U a
fixed hash of the id, and taken in that order while they fit what is missing.
What then is missing still is filled by FILLS documents of those behind the cut,
one after the other, each the nearest in size to the gap if it narrows it: a source
misses its target by no more than the least difference between the gap and any of its
remaining documents, whatever the size of the document at the cut.

The cut is found without sorting a source: words are pre-aggregated over BUCKETS
ranges of Q, the range that holds the cut follows from their running sums, and only
documents of that range are sorted, without their texts. The plan then has each
source's last document by (Q, id, size, text hash) and its fills, and every document
decides for itself. Sources are ranked over ranges of their own with offsets; no
source that holds a third of all rows, and no table of many sources, is in one task.

Within a source all documents have the same inclusion odds, and sources differ; each
source is cut by itself, as one order over all would meet targets on average only.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; sources without words have target 0; repeated
rows (same id, size and text) are drawn alike, ties in Q go by id, size and text hash;
an empty table gives an empty result; working columns have names that no input uses.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 16
FILLS = 2
CAP = 3
SEED = "mix"


def words_of(text: str):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_column: str, seed: str = SEED):
    """A number in (0, 1) fixed by the id: 52 bits of md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def sized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    return docs.withColumns({"__size": words_of(text), "__u": uniform(id_column, seed), "__tie": F.xxhash64(F.col(text))})


def _ranked(sums: DataFrame, source: str) -> DataFrame:
    """sums with __rank from 0 in order of source, null last: places within ranges, and
    the rows of the ranges before."""
    ranges = staged(sums.repartitionByRange(F.col(source).asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "sources")
    counts = ranges.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a range
    before = counts.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(source).asc_nulls_last()))
    return ranges.join(before, F.col("__part") == F.col("__p")).withColumn("__rank", within - 1 + F.col("__before")).drop("__part", "__p", "__before")


def targets(rows: DataFrame, source: str = "source", weights=(1, 2, 3), cap: int = CAP) -> DataFrame:
    """source, source_size and target of every source of rows with __size."""
    ranked = _ranked(rows.groupBy(source).agg(F.sum("__size").alias("source_size")), source)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("double")
    open_ = ranked.withColumns({"__w": weight, "__cap": F.col("source_size").cast("double") * cap})
    level, total = 0.0, None
    while True:
        full = F.col("__cap") <= F.col("__w") * level if level else F.col("__cap") <= 0
        s = open_.agg(F.sum("source_size").cast("double"), F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("__w")))).head()
        total = s[0] or 0.0
        above = (total - (s[1] or 0.0)) / s[2] if s[2] else level
        if above <= level:
            break
        level = above
    return open_.select(source, "source_size", F.least(F.col("__cap"), F.col("__w") * level).alias("target"))


def _place(rows: DataFrame) -> DataFrame:
    """Certain copies, rank, range of Q and words still to take of rows joined with their
    source's target."""
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    pi = F.col("__e") - F.floor("__e")
    q = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__pi") / (1 - F.col("__pi")))
    return (
        rows.withColumn("__e", e)
        .withColumns({"__whole": F.floor("__e"), "__pi": pi})
        .withColumn("__q", F.when(F.col("__pi") > 0, q))
        .withColumn("__b", F.least(F.floor(F.col("__q") / (1 + F.col("__q")) * BUCKETS), F.lit(BUCKETS - 1)))
        .withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    )


def _with_sources(rows: DataFrame, per_source: DataFrame, source: str) -> DataFrame:
    side = per_source.withColumnRenamed(source, "__source")  # a written table, so that Spark knows its size
    return rows.join(side, F.col(source).eqNullSafe(F.col("__source")), "inner").drop("__source")


def _key(id_column: str):
    return F.struct("__q", F.col(id_column).alias("__id"), "__size", "__tie")


def _behind(id_column: str):
    """Whether a document stands behind its source's cut."""
    at = F.when(F.col("__cut").isNull(), False).when(F.col("__b") != F.col("__cut"), F.col("__b") > F.col("__cut"))
    return at.otherwise(F.coalesce(_key(id_column) > F.col("__last"), F.lit(True)))


def plan(rows: DataFrame, source: str = "source", weights=(1, 2, 3), cap: int = CAP, id_column: str = "doc_id") -> DataFrame:
    """Targets, where each source's order is cut (range and last document), and its fills."""
    joined = lambda t, more: t.join(more, F.col(source).eqNullSafe(F.col("__s")), "left").drop("__s")
    goal = targets(rows, source, weights, cap)
    drawn = _place(_with_sources(rows, goal, source)).where("__q is not null")
    sums = drawn.groupBy(source, "__b").agg(F.sum("__size").alias("__words"), F.first("__rest").alias("__rest"))
    run = Window.partitionBy(source).orderBy("__b")  # BUCKETS rows a source
    reached = sums.withColumn("__upto", F.sum("__words").over(run)).where(F.col("__upto") > F.col("__rest"))
    cut = reached.groupBy(source).agg(F.min(F.struct(F.col("__b").alias("at"), (F.col("__upto") - F.col("__words")).alias("before"))).alias("cut"))
    goal = staged(joined(goal, cut.select(F.col(source).alias("__s"), F.col("cut.at").alias("__cut"), F.col("cut.before").alias("__before"))), "ranges", narrow=True)

    edge = _place(_with_sources(rows, goal, source)).where("__b = __cut")
    order = Window.partitionBy(source).orderBy("__q", id_column, "__size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    fits = edge.withColumn("__sum", F.col("__before") + F.sum("__size").over(order)).where(F.col("__sum") <= F.col("__rest"))
    last = fits.groupBy(source).agg(F.max(_key(id_column)).alias("__last"), F.max("__sum").alias("__taken")).withColumnRenamed(source, "__s")
    rest = F.when(F.col("source_size") > 0, F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size"))
    gap = rest - F.coalesce("__taken", "__before")
    goal = staged(joined(goal, last).withColumn("__gap", gap).drop("__taken"), "cuts", narrow=True)

    for k in range(FILLS):
        left = _place(_with_sources(rows, goal, source)).where(F.col("__cut").isNotNull() & F.col("__q").isNotNull() & (F.abs(F.col("__size") - F.col("__gap")) < F.col("__gap")) & _behind(id_column))
        for j in range(k):
            left = left.where(~F.coalesce(_key(id_column) == F.col(f"__fill{j}"), F.lit(False)))
        best = left.groupBy(source).agg(F.min(F.struct(F.abs(F.col("__size") - F.col("__gap")).alias("far"), _key(id_column).alias("key"))).alias("__best"))
        found = best.select(F.col(source).alias("__s"), F.col("__best.key").alias(f"__fill{k}"))
        goal = staged(joined(goal, found).withColumn("__gap", F.col("__gap") - F.coalesce(F.col(f"__fill{k}.__size"), F.lit(0))), f"fill-{k}", narrow=True)
    return goal


def mix(rows: DataFrame, mix_plan: DataFrame, source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """rows of sized() with size, source_size, target, copies and taken: each row is held
    against its source's plan, nothing is sorted."""
    placed = _place(_with_sources(rows, mix_plan, source))
    filled = [F.coalesce(_key(id_column) == F.col(f"__fill{k}"), F.lit(False)) for k in range(FILLS)]
    more = F.when(F.col("__q").isNull(), False).otherwise(~_behind(id_column) | reduce(or_, filled))
    done = placed.withColumn("__copies", F.col("__whole") + more.cast("long"))
    own = [c for c in rows.columns if not c.startswith("__")]
    return done.select(*own, F.col("__size").alias("size"), "source_size", "target", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mixture(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), cap: int = CAP) -> DataFrame:
    """The decision for every document, without its text: one pass over the texts."""
    narrow = staged(sized(docs, id_column, text).select(id_column, source, "__size", "__u", "__tie"), "sizes")
    return mix(narrow, plan(narrow, source, weights, cap, id_column), source, id_column)


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), cap: int = CAP) -> DataFrame:
    """The mixed documents themselves: each as often as it was drawn, with the number
    of the copy and the words it brings; columns of docs that clash are replaced."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken", "copy")
    narrow = staged(sized(docs, id_column, text).select(id_column, source, "__size", "__u", "__tie"), "sizes")
    out = mix(sized(docs, id_column, text), plan(narrow, source, weights, cap, id_column), source, id_column)
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


#: The same in DuckDB.
MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::double as w from s),
c as (select *, source_size::double * 3 as cap, (sum(source_size) over ())::double as everything from w),
f as (select *, coalesce(sum(cap) over (order by cap / w, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0.0) as before_cap,
             sum(w) over (order by cap / w, encode(source) nulls last rows between current row and unbounded following) as from_w from c),
g as (select *, cap * from_w <= (everything - before_cap) * w as is_full from f),
t as (select source, source_size,
             case when is_full then cap else w * ((everything - coalesce(sum(case when is_full then cap end) over (), 0.0)) / sum(case when not is_full then w end) over ()) end as target from g),
p as (select d.doc_id, d.source, d.size, d.u, t.source_size, t.target,
             case when t.source_size > 0 then t.target / t.source_size else 0.0 end as e
      from d join t on d.source is not distinct from t.source),
q as (select *, floor(e) as whole, e - floor(e) as pi from p),
r as (select *, case when pi > 0 then (u / (1 - u)) / (pi / (1 - pi)) end as rank_key from q),
o as (select *, target - whole * source_size as rest, rank_key is not null and sum(size) over (partition by source order by rank_key nulls last, doc_id, size rows unbounded preceding) <= target - whole * source_size as cut from r),
g1 as (select *, rest - coalesce(sum(case when cut then size end) over (partition by source), 0) as gap1 from o),
f1 as (select *, row_number() over (partition by source order by rank_key is null or cut, abs(size - gap1), rank_key, doc_id, size) = 1 and rank_key is not null and not cut and abs(size - gap1) < gap1 as fill1 from g1),
g2 as (select *, gap1 - coalesce(sum(case when fill1 then size end) over (partition by source), 0) as gap2 from f1),
f2 as (select *, row_number() over (partition by source order by rank_key is null or cut or fill1, abs(size - gap2), rank_key, doc_id, size) = 1 and rank_key is not null and not cut and not fill1 and abs(size - gap2) < gap2 as fill2 from g2)
select doc_id, size, source_size, target, ((whole + case when cut or fill1 or fill2 then 1 else 0 end) * size)::bigint as taken
from f2
"""
