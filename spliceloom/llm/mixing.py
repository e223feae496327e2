"""Mixing sources to target weights by Pareto order sampling.

Targets: the mix holds ``growth`` times the words of all documents, shared among sources by
weight; a source's target stops at ``max_repeat`` times its size and the excess is shared among
the others by weight, until none is above (the closed form of this water filling is used).

Taking: with e = target / size of its source, every document is certain of floor(e) whole copies.
The rest of the target is an unequal-probability sample without replacement: a document's
inclusion probability is p = c * size**-damping, scaled so that the expected words are the rest,
and documents are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)).
The sample has a fixed size in words: the ranking is cut where the words taken are nearest to the
rest. The random numbers are digests of seed and id, so reruns agree.

The cut needs no global sort: ranks, as x = q / (1 + q), go into equal steps that are summed per
source; the step that holds the cut is divided again until few documents are left in it, and only
those are ordered. The last document taken then goes into the small table of sources, so whether a
document is taken follows from its own row and that table: documents are never shuffled.

Defined results: null and empty texts have size 0 and take 0. A null source is a source, last in
order. Rows with the same id, source and size share their random number and are taken together or
not at all; rows without an id are told apart by their texts instead. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.llm.textio import documents
from spliceloom.session import written

WEIGHTS, GROWTH, MAX_REPEAT, DAMPING, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 0.25, "mix-1"
#: Steps into which the ranking of a source is divided at a time, at most so often, and documents that are ordered in the end.
STEPS, LEVELS, ORDERED = 256, 6, 5000
#: A per-source table of at most this many rows is broadcast; a larger one is joined with salt.
BROADCAST_ROWS = 50_000
SALTS = 32


def _attach(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Join the per-source ``table`` (column k, n rows) to ``rows`` by source, whatever its skew."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("k"))).drop("k")
    salted = table.withColumn("salt_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
        .join(salted, F.col("source").eqNullSafe(F.col("k")) & (F.col("salt") == F.col("salt_k")))
        .drop("k", "salt", "salt_k")
    )


def targets(sources: DataFrame, weights: Sequence[float], growth: float, max_repeat: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(growth)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    return s.withColumn("level", level).withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w"))).drop("level", "cap", "w")


def _size(text_col: str) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _drawn(rows: DataFrame, table: DataFrame, n: int, damping: float, seed: str) -> DataFrame:
    """Adds the per-source ``table`` and ``q``, the rank of a row; null where nothing is left to sample or the row has no words."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.col("digest")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = F.col("rest") / F.col("damped") * F.pow(F.col("size").cast("double"), F.lit(-damping))
    q = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    return _attach(rows, table, n).withColumn("q", F.when((F.col("size") > 0) & (F.col("rest") > 0), q))


def _step(level: int) -> Column:
    return F.floor(F.least(F.col("q") / (1 + F.col("q")), F.lit(1 - 2.0**-53)) * float(STEPS**level))


def _place() -> Column:
    return F.struct("q", "doc_id", "size")


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What the mix needs of a document."""
    digest = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), digest.alias("digest")]


def _rule(sized: DataFrame, weights: Sequence[float], growth: float, max_repeat: float, damping: float, seed: str) -> tuple[DataFrame, int, int]:
    """(per-source table, its rows, level of its cuts) that decides what each row takes."""
    damped = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(1.0 - damping)))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.coalesce(F.sum(damped), F.lit(0.0)).alias("damped"))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sources, weights, growth, max_repeat).withColumn("whole", F.floor(e)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(plan.withColumnRenamed("source", "k").withColumns({"cut": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}), "mix-plan")
    n = plan.count()
    for level in range(1, LEVELS + 1):
        inside = _drawn(sized, plan, n, damping, seed).filter("q is not null").filter(_step(level - 1) == F.col("cut"))
        steps = inside.groupBy("source", _step(level).alias("step")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("step"))
        over = steps.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        first = over.groupBy(F.col("source").alias("k2")).agg(F.min_by(F.struct("step", (F.col("upto") - F.col("words")).alias("so_far"), "rows"), "step").alias("at"))
        first = plan.join(first, F.col("k").eqNullSafe(F.col("k2")), "left")
        # a source that no step fills is taken whole: its cut stays empty
        plan = written(first.select("k", "source_size", "damped", "target", "whole", "rest", F.col("at.step").alias("cut"), F.coalesce("at.so_far", "before").alias("before"), F.col("at.rows").alias("rows")), "mix-plan")
        if (plan.agg(F.max("rows")).first()[0] or 0) <= ORDERED:
            break
    inside = _drawn(sized, plan, n, damping, seed).filter("q is not null").filter(_step(level) == F.col("cut"))
    units = inside.groupBy("source", "q", "doc_id", "size").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("q", "doc_id", "size"))
    last = units.withColumn("upto", upto).filter(F.col("upto") - F.col("words") / 2 <= F.col("rest")).groupBy(F.col("source").alias("k2")).agg(F.max(_place()).alias("last"))
    return written(plan.join(last, F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2", "before", "rows"), "mix-rule"), n, level


def _copies(level: int) -> Column:
    """Copies of a row that the mix takes, from ``_drawn`` with the rule."""
    earlier = F.col("cut").isNull() | (_step(level) < F.col("cut"))
    extra = F.col("q").isNotNull() & (earlier | ((_step(level) == F.col("cut")) & F.coalesce(_place() <= F.col("last"), F.lit(False))))
    return F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(0)


def _sized_rule(docs, weights, growth, max_repeat, damping, seed, id_col, text_col, source_col):
    # the sizes are written: all passes of the search read those few bytes a document
    sized = written(docs.select(*_named(docs, id_col, text_col, source_col)), "mix-sizes")
    return sized, *_rule(sized, weights, growth, max_repeat, damping, seed)


def mix(
    docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, growth: float = GROWTH, max_repeat: float = MAX_REPEAT, damping: float = DAMPING,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sized, rule, n, level = _sized_rule(docs, weights, growth, max_repeat, damping, seed, id_col, text_col, source_col)
    return _drawn(sized, rule, n, damping, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(level)).alias("taken"))


def mixed_documents(
    docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, growth: float = GROWTH, max_repeat: float = MAX_REPEAT, damping: float = DAMPING,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies, none where it takes nothing. Rows without words are not taken."""
    _, rule, n, level = _sized_rule(docs, weights, growth, max_repeat, damping, seed, id_col, text_col, source_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_named(docs, id_col, text_col, source_col))
    copies = _drawn(rows, rule, n, damping, seed).select("row", _copies(level).cast("int").alias("n")).filter("n > 0")
    return copies.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP3_SQL = f"""
with sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    case when doc_id is null then md5(coalesce(text, '')) end as digest from documents),
src as (select source, cast(sum(size) as bigint) as source_size, coalesce(sum(case when size > 0 then pow(size::double, {1 - DAMPING}) end), 0.0) as damped from sized group by source),
w as (select *, list_value(5.0::double, 2.0::double, 1.0::double)[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, 2.0::double * source_size as cap from src),
lv as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level from w
  window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
tg as (select source, source_size, damped, least(cap, max(level) over () * w) as target from lv),
pl as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from tg),
pr as (select *, target - whole * source_size as rest from pl),
d as (select doc_id, digest, size, s.source, source_size, target, whole, rest,
    rest / damped * pow(size::double, -{DAMPING}) as p, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, ':' || digest)), 1, 13))::ubigint::double + 0.5) / {1 << 52}::double as u
  from sized s join pr on s.source is not distinct from pr.source),
q as (select *, case when size > 0 and rest > 0 then case when p >= 1 then 0.0 else (u / (1 - u)) / (p / (1 - p)) end end as q from d),
r as (select *, sum(size) over (partition by source, q is null order by q, doc_id nulls first, size range unbounded preceding) as upto, sum(size) over (partition by source, q, doc_id, size) as words from q)
select doc_id, size, source_size, target::double as target,
  cast(size * (whole + case when q is not null and upto - words / 2.0 <= rest then 1 else 0 end) as bigint) as taken
from r
"""
