"""References to records that don't exist: missing, retracted or loaded only later.

A reference (a name, a time) is whole if some definition of the name was loaded by that time and not
retracted by it. The latest retraction among the definitions loaded so far, a running maximum, tells
this. It runs over distinct names and times in sorted ranges, so that neither a name with very many
rows nor a bulk load at one time ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callweave.operators.skew import salted_join
from callweave.runtime import cut, cut_counting

FAR = "9999-12-31 00:00:00"


def call_references(calls: DataFrame, external: DataFrame) -> DataFrame:
    """(ord, side, name, at) of both sides of every call row, without nulls and external names."""
    names = external.select(F.col("name").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("name")) for s in ("caller", "callee")])
    return (
        calls.select("ord", F.col("imported_at").cast("timestamp_ntz").alias("at"), F.inline(sides))
        .where(F.col("name").isNotNull())
        .join(names, F.col("name") == F.col("_x"), "left_anti")
        .select("ord", "side", "name", "at")
    )


def orphan_points(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(name, at, n, reason): the names and times at which no definition holds, with the number of references.

    Names and times are first reduced to one row each, with the latest retraction among the definitions
    loaded just then. These rows are sorted over ranges of (name, at), so that a name with very many
    times lies in several ranges; the maximum runs within a range, and the maxima of the ranges, of
    which a name has few, run over the ranges.
    """
    end = F.coalesce(F.col("retracted_at").cast("timestamp_ntz"), F.lit(FAR).cast("timestamp_ntz"))
    loaded = defs.where(F.col("symbol").isNotNull()).select(
        F.col("symbol").alias("name"), F.col("imported_at").cast("timestamp_ntz").alias("at"), F.lit(0).cast("bigint").alias("n"), end.alias("until")
    )
    asked = refs.select("name", "at", F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("timestamp_ntz").alias("until"))
    points = (
        loaded.where(F.col("at").isNotNull()).unionByName(asked).groupBy("name", "at").agg(F.sum("n").alias("n"), F.max("until").alias("until"))
    )
    ranged = cut(points.repartitionByRange("name", "at").withColumn("_range", F.spark_partition_id()))
    to_here = W.partitionBy("name").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        ranged.groupBy("name", "_range").agg(F.max("until").alias("until")).select("name", "_range", F.max("until").over(to_here).alias("_carried"))
    )
    inside = W.partitionBy("name", "_range").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    state = (
        ranged.withColumn("_until", F.max("until").over(inside))
        .join(carried, ["name", "_range"])
        .select("name", "at", "n", F.greatest("_until", "_carried").alias("until"))
        .where((F.col("n") > 0) & ~F.coalesce(F.col("until") > F.col("at"), F.lit(False)))
    )
    known = loaded.select(F.col("name").alias("_d")).distinct()
    reason = F.when(F.col("until").isNotNull(), "retracted").when(F.col("_d").isNotNull(), "late").otherwise("missing")
    return salted_join(state, known.select(F.col("_d").alias("name"), "_d"), "name", "left").select("name", "at", "n", reason.alias("reason"))


def _at_points(refs: DataFrame, points: DataFrame, total: int) -> DataFrame:
    """The references at the points (name, at, n, reason). Points with a 64th or more of the references
    that total counts, at most 64, are split into parts."""
    parts = F.ceil(F.col("n") * 64 / F.lit(max(total, 1))).cast("int")
    hot = F.broadcast(points.where(F.col("n") * 64 >= total).select(F.col("name").alias("_hn"), F.col("at").alias("_ha"), parts.alias("_parts")))
    salted = refs.join(hot, (F.col("name") == F.col("_hn")) & F.col("at").eqNullSafe(F.col("_ha")), "left").withColumn(
        "_salt", F.pmod(F.xxhash64("ord", "side"), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    each = F.when(F.col("n") * 64 >= total, parts).otherwise(1)
    spread = points.select(F.col("name").alias("_n"), F.col("at").alias("_a"), "reason", F.explode(F.sequence(F.lit(0), each - 1)).alias("_s"))
    met = (F.col("name") == F.col("_n")) & F.col("at").eqNullSafe(F.col("_a")) & (F.col("_salt") == F.col("_s"))
    return salted.join(spread, met).select("ord", "side", "name", "at", "reason")


def _direct(refs: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, references) without a definition."""
    points, got = cut_counting(orphan_points(refs, defs), n=F.sum("n"))
    return points, _at_points(refs, points, got["n"] or 0)


def direct_orphans(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(ord, side, name, at, reason) of the references without a definition at their time.

    reason: retracted if definitions had been loaded but none was left, late if the first came only
    afterwards, missing if there is none at all. A reference without a time is never whole; a
    definition without a load time makes no reference whole and counts as late.
    """
    return _direct(refs, defs)[1]


def below(seeds: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(name, depth): what the edges (src, dst) lead to from the seeds (name), seeds at depth 0.

    A fixpoint of semi-naive rounds; each follows several edges in one job, takes the least depth of
    a name and stops when no new name comes up. Cycles are no problem.
    """
    known = front = cut(seeds.select("name").distinct().withColumn("depth", F.lit(0)))
    last = 0
    while not front.isEmpty():
        step, found = front, None
        for _ in range(hops):
            step = (
                step.join(edges, F.col("name") == F.col("src"))
                .groupBy(F.col("dst").alias("name"))
                .agg((F.min("depth") + 1).alias("depth"))
            )
            found = step if found is None else found.unionByName(step)
        new = found.groupBy("name").agg(F.min("depth").alias("depth")).join(known.select("name"), "name", "left_anti")
        new = cut(new)
        known, last = known.unionByName(new), last + hops
        front = new.where(F.col("depth") == last)  # the others were followed within the round
    return known


def inherited_since(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(name, since, depth): from when on the rows of a caller inherit, for every depth that moves it back.

    edges are (src, dst, at), points the (name, at) of orphaned callers. Round d looks at the rows that
    were orphaned at depth d - 1: what they call inherits from their time on. A semi-join finds them
    among the edges: rows of a name between its new and its former time. A name is looked at again only
    when its time moves back, so that every row is orphaned once, and cycles end like all else.
    """
    seed = edges.join(points, (F.col("src") == F.col("name")) & (F.col("at") == F.col("_at")), "left_semi")
    count = F.count(F.lit(1))
    front, got = cut_counting(
        seed.groupBy(F.col("dst").alias("name")).agg(F.min("at").alias("since")).withColumn("_was", F.lit(FAR).cast("timestamp_ntz")), n=count
    )
    best, depth = front.select("name", "since"), 1
    all_of_them = front.select("name", "since", F.lit(1).alias("depth"))
    while got["n"]:
        depth += 1
        newly = (F.col("src") == F.col("name")) & (F.col("at") >= F.col("since")) & (F.col("at") < F.col("_was"))
        asked = edges.join(front, newly, "left_semi").groupBy(F.col("dst").alias("name")).agg(F.min("at").alias("_new"))
        front, got = cut_counting(
            asked.join(best, "name", "left")
            .where(F.col("since").isNull() | (F.col("_new") < F.col("since")))
            .select("name", F.col("_new").alias("since"), F.coalesce("since", F.lit(FAR).cast("timestamp_ntz")).alias("_was")),
            n=count,
        )
        if got["n"]:
            all_of_them = all_of_them.unionByName(front.select("name", "since", F.lit(depth).alias("depth")))
            best = cut(best.join(front.select("name"), "name", "left_anti").unionByName(front.select("name", "since")))
    return all_of_them


def orphan_cascade(calls: DataFrame, defs: DataFrame, external: DataFrame) -> DataFrame:
    """(ord, side, name, reason, kind, depth, month) of all orphaned references of calls.

    kind direct: the reference itself has no definition at its time (depth 0). kind inherited: the
    row's caller exists, but was called, no later than the row's own time, from an orphaned record,
    that is from a row whose own caller is an orphan or inherits that; depth is the least number of
    calls in between. Rows with both are direct; rows without a time neither inherit nor pass on.
    month is the month of imported_at as yyyy-MM, null without it.
    """
    refs = call_references(calls, external)
    points, direct = _direct(refs, defs)
    names = external.select(F.col("name").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    edges = cut(
        calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.col("imported_at").cast("timestamp_ntz").alias("at"))
        .where("src is not null and dst is not null and at is not null and src <> dst")
        .join(names, F.col("dst") == F.col("_x"), "left_anti")
        .join(names, F.col("src") == F.col("_x"), "left_anti")
        .distinct()
    )
    steps = inherited_since(edges, points.select("name", F.col("at").alias("_at")))
    stairs = steps.groupBy("name").agg(F.collect_list(F.struct("depth", "since")).alias("_steps"))  # one for each depth at most
    ours = direct.where(F.col("side") == "caller").select(F.col("ord").alias("_o"))
    callers = refs.where((F.col("side") == "caller") & F.col("at").isNotNull())
    inherited = (
        salted_join(callers, stairs, "name")
        .withColumn("depth", F.array_min(F.transform(F.filter("_steps", lambda x: x["since"] <= F.col("at")), lambda x: x["depth"])))
        .where(F.col("depth").isNotNull())
        .join(ours, F.col("ord") == F.col("_o"), "left_anti")
        .select("ord", "side", "name", "at", F.lit("inherited").alias("reason"), F.lit("inherited").alias("kind"), "depth")
    )
    both = direct.withColumn("kind", F.lit("direct")).withColumn("depth", F.lit(0)).unionByName(inherited)
    return both.select("ord", "side", "name", "reason", "kind", "depth", F.date_format("at", "yyyy-MM").alias("month"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(side, month, kind, reason, n_refs, n_names) counted over the result of orphan_cascade."""
    return orphans.groupBy("side", "month", "kind", "reason").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("name").alias("n_names")
    )
