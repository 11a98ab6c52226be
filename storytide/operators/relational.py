"""Relational building blocks: one row per key, top k, gaps, eligibility, chains, budgets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the order; a total order makes it repeatable."""
    return top_per(df, keys, 1, *order)


def top_per(df: DataFrame, keys: Sequence[str], k: int | Column, *order: Column, rank: str | None = None) -> DataFrame:
    """The first k rows of each key. Spark filters groups before the shuffle (WindowGroupLimit) where k is a number."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, which is counted up to there; else as it is, and Spark
    chooses the join. For the bounded side of joins without an equality."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fair_share(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds `turn`: the place of a row within its group, so that ordering by turn deals the groups round robin."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def calendar(spark, start: str, end: str) -> DataFrame:
    """date, idx (from 0) of every day from start to end."""
    return spark.sql(f"SELECT date'{start}' + CAST(id AS INT) AS date, CAST(id AS INT) AS idx FROM range(datediff(date'{end}', date'{start}') + 1)")


def fill_days(daily: DataFrame, keys: Sequence[str], days: DataFrame, zeros: dict[str, Column]) -> DataFrame:
    """A row for every key and day; the columns of `zeros` take their value where the day has no row."""
    grid = daily.select(*keys).distinct().crossJoin(F.broadcast(days))  # days: a bounded calendar
    out = grid.join(daily, [*keys, "date"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in zeros.items()})


def window_ends(df: DataFrame, days: int, date: str = "date", to: str = "end_date") -> DataFrame:
    """Each row once for every day whose trailing window of `days` days holds it; for few rows (see rolling_distinct)."""
    return df.withColumn(to, F.explode(F.sequence(F.col(date), F.date_add(F.col(date), days - 1))))


@dataclass(frozen=True)
class MemberDays:
    """The days of members (keys, kind, m), listed once for windows of any length: for brief kinds the first and the last
    (low, high), for the others all of them (on)."""

    members: DataFrame
    keys: tuple[str, ...]
    brief: tuple[str, ...]
    spans: DataFrame | None
    runs: DataFrame | None


def member_days(members: DataFrame, keys: Sequence[str], brief: Sequence[str] = ()) -> MemberDays:
    """members: keys, date, kind, m. brief: kinds whose members have few days, as documents do."""
    each = [*keys, "kind", "m"]
    spans = written(members.where(F.col("kind").isin(*brief)).groupBy(*each).agg(F.min("date").alias("low"), F.max("date").alias("high")), "spans") if brief else None
    rest = members.where(~F.col("kind").isin(*brief)) if brief else members
    return MemberDays(members, tuple(keys), tuple(brief), spans, _days_of(rest, each))


def _days_of(members: DataFrame, each: Sequence[str]) -> DataFrame:
    """The days of members; repeated rows go before they are gathered."""
    return members.select(*each, "date").distinct().groupBy(*each).agg(F.array_sort(F.collect_list("date")).alias("on"))


def rolling_distinct(members: DataFrame | MemberDays | None, grid: DataFrame, keys: Sequence[str], days: int, kinds: dict[str, str], brief: Sequence[str] = (), counted: DataFrame | None = None) -> DataFrame:
    """The grid (keys, date) with, for each kind, the number of distinct members of the trailing window of `days` days.

    members: keys, date, kind, m, or their days; repeated rows and days outside the grid's calendar count as they are. The
    days of a member become runs of windows that hold it: a step up where a run begins, a step down where it ends. Steps
    are summed by key and day, then along the calendar, so that a member costs two rows a run, not one a window.
    grid: has all days of each key that lie between the first member's and the last. kinds: kind -> column. The first and
    the last day tell the run of a brief member unless they lie more than a window apart, so that only such members
    have their days listed. counted: keys, date, kind, n: members of one day each that are no rows of `members`, as numbers.
    """
    held = member_days(members, keys, brief) if isinstance(members, DataFrame) else members
    gap, runs, steps = F.lit(days), held and held.runs, None
    if held is not None and held.spans is not None:
        apart = F.datediff("high", "low") > days
        far = held.spans.where(apart)
        ends = F.array(F.struct(F.col("low").alias("date"), F.lit(1).alias("n")), F.struct(F.date_add("high", gap).alias("date"), F.lit(-1).alias("n")))
        steps = held.spans.where(~apart).select(*keys, "kind", F.explode(ends).alias("x")).select(*keys, "kind", "x.date", "x.n")
        if not far.isEmpty():
            own = held.members.where(F.col("kind").isin(*held.brief)).join(far.drop("low", "high"), [*keys, "kind", "m"], "left_semi")
            runs = runs.unionByName(_days_of(own, [*keys, "kind", "m"]))
        elif not set(kinds) - set(held.brief):
            runs = None
    if runs is not None:
        up = F.filter("on", lambda d, i: (i == 0) | (F.date_add(F.get("on", i - 1), gap) < d))
        down = F.transform(F.filter("on", lambda d, i: (i == F.size("on") - 1) | (F.date_add(d, gap) < F.get("on", i + 1))), lambda d: F.date_add(d, gap))
        step = lambda x, n: F.transform(x, lambda d: F.struct(d.alias("date"), F.lit(n).alias("n")))
        more = runs.select(*keys, "kind", F.explode(F.concat(step(up, 1), step(down, -1))).alias("x")).select(*keys, "kind", "x.date", "x.n")
        steps = more if steps is None else steps.unionByName(more)
    if counted is not None:
        ends = F.array(F.struct("date", F.col("n").alias("n")), F.struct(F.date_add("date", gap).alias("date"), F.negate("n").alias("n")))
        more = counted.select(*keys, "kind", F.explode(ends).alias("x")).select(*keys, "kind", "x.date", "x.n")
        steps = more if steps is None else steps.unionByName(more)
    per = steps.groupBy(*keys, "date").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(c) for k, c in kinds.items()])
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(per, [*keys, "date"], "left").withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in kinds.values()})


def eligible_within(rows: DataFrame, key: str, date: str, rules: DataFrame, rule: str, days: str, covered: DataFrame, as_of: str) -> DataFrame:
    """The keys of rows that some rule admits and that are not covered for it: a relational division by counting.

    A rule (one row each; a bounded table) admits the rows of its last `days` days. How many rules admit a row follows
    from its age alone, a table as long as the longest window; a row is done if as many of those that admit it
    cover it. rows: a date a key. covered: key, rule, in any number.
    """
    age = F.greatest(F.datediff(F.to_date(F.lit(as_of)), date), F.lit(0))
    steps = rules.select(F.explode(F.sequence(F.lit(0), F.col(days))).alias("age")).groupBy("age").agg(F.count("*").alias("admit"))
    aged = rows.select(F.col(key), age.alias("age")).distinct().join(steps, "age")
    spans = rules.select(F.col(rule), F.col(days).alias("__days"))
    done = covered.select(key, rule).distinct().join(spans, rule).join(aged, key).where("__days >= age").groupBy(key).agg(F.count("*").alias("cover"))
    return aged.join(done, key, "left").where(F.col("admit") > F.coalesce("cover", F.lit(0))).select(key).distinct()


def resolve_chain(links: DataFrame, source: str, target: str, hops: int = 20) -> DataFrame:
    """source, target, steps: the end of each chain of links, followed at most `hops` steps.

    The steps are the bits of `hops`: a table of jumps of 1, 2, 4, .. links is doubled, and joined to what has been
    walked where its bit is set, so twenty hops take four doublings and two joins. A source has one link.
    """
    jump = links.select(F.col(source).alias("s"), F.col(target).alias("t"), F.lit(1).alias("n"))
    walked, left = None, hops
    while left:
        if left & 1:
            walked = jump if walked is None else _then(walked, jump)
        left >>= 1
        if left:
            jump = _then(jump, jump)
    return walked.select(F.col("s").alias(source), F.col("t").alias(target), F.col("n").alias("steps"))


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    more = second.select(F.col("s").alias("t"), F.col("t").alias("to"), F.col("n").alias("by"))
    return first.join(more, "t", "left").select("s", F.coalesce("to", "t").alias("t"), (F.col("n") + F.coalesce("by", F.lit(0))).alias("n"))


def optional(column: Column, value) -> Column:
    """A predicate that a null parameter switches off."""
    return F.lit(True) if value is None else column == F.lit(value)


def day_end(as_of: str, now: str) -> Column:
    """The end of the day as_of, but not later than now."""
    return F.least(F.date_trunc("day", F.to_timestamp(F.lit(as_of))) + F.expr("INTERVAL 1 DAY"), F.to_timestamp(F.lit(now)))


def counters(*tables: tuple[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, as scalar subqueries would give."""
    out = None
    for name, df in tables:
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def hashed_sample(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """n rows drawn by a hash of their keys, so that a seed draws the same ones again."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *keys)), *keys).limit(n)


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the running sums of each group in the order, which must be total; a null key is a group of its own.

    Two levels: rows are dealt to ranges of (group, order) and written; the sums of the ranges, one row a range and
    group, give what comes before each range; within a range the window runs over its rows alone. So neither a large
    group nor a table that is one group comes to one task.
    """
    values = {f"__v{k}": v for k, v in enumerate(sums.values())}
    ranged = written(df.withColumns(values).repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__range", F.spark_partition_id()), "running-sums")
    keys = {f"__k{k}": F.col(g) for k, g in enumerate(group)}
    earlier = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # without a group: one row a range
    totals = ranged.groupBy(F.col("__range").alias("__r"), *[c.alias(k) for k, c in keys.items()]).agg(*[F.sum(v).alias(f"{v}t") for v in values])
    before = totals.select("__r", *keys, *[F.sum(f"{v}t").over(earlier).alias(f"{v}b") for v in values])
    same = F.col("__range") == F.col("__r")
    for k, c in keys.items():
        same &= c.eqNullSafe(F.col(k))
    upto = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(before, same)
    return out.select(*df.columns, *[(F.sum(v).over(upto) + F.coalesce(f"{v}b", F.lit(0))).alias(name) for name, v in zip(sums, values, strict=True)])


def budget_prefix(df: DataFrame, size: Column, budget: int, group: Sequence[str], *order: Column) -> DataFrame:
    """The rows of each group, in order, whose running size stays within the budget; the first always."""
    out = running_sums(df, group, order, {"__sum": size, "__n": F.lit(1)})
    return out.where((F.col("__sum") <= budget) | (F.col("__n") == 1)).drop("__sum", "__n")


def page(df: DataFrame, size: int, number: int, *order: Column) -> DataFrame:
    """A page of rows with has_more: reads one row more than the page."""
    upto = df.orderBy(*order).limit((number + 1) * size + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    more = F.max("__n").over(Window.partitionBy(F.lit(1))) > (number + 1) * size
    return upto.withColumn("has_more", more).where((F.col("__n") > number * size) & (F.col("__n") <= (number + 1) * size)).drop("__n")


def latest_state(events: DataFrame, keys: Sequence[str], value: str, *order: Column) -> DataFrame:
    """The last value of each key in an append-only table of events."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
