"""Board lanes, change reports, briefs and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up

LANE_SIZE = 6
#: States of a narrative, in the order of reports, fixed values.
STATES = ("unmeasured", "dormant", "emerging", "rising", "peaking", "steady", "fading")
#: Kinds of change in the order of reports, fixed values.
CHANGES = ("new_definition", "state_change", "entered_board", "expired_definition", "left_board", "mover")


def is_measured(coverage: Column) -> Column:
    return F.coalesce(coverage.isin("measured", "measured_zero"), F.lit(False))


def by_surprise() -> list:
    return [F.desc("attention_z"), F.desc("density_z"), F.desc("story_breadth"), F.asc("name")]


def by_kind() -> list:
    return [F.desc(F.col("story_breadth") > 0), F.when(F.coalesce("kind", F.lit("structural")) == "structural", 0).otherwise(1), *by_surprise()]


def lanes(board: DataFrame, latest: str, size: int = LANE_SIZE) -> DataFrame:
    """lane, place and the board's columns: rising and peaking by surprise, fading by fall, emerging by attention."""
    measured = is_measured(F.col("coverage"))
    moving = measured & F.col("state").isin("rising", "peaking")
    fresh = (F.col("state") == "emerging") | (F.col("status") == "probationary") | F.coalesce(F.datediff(F.to_date(F.lit(latest)), "activated").between(-100000, 7), F.lit(False))
    orders = {
        "rising": (measured & (F.col("state") == "rising"), by_surprise()),
        "peaking": (measured & (F.col("state") == "peaking"), by_surprise()),
        "fading": (measured & (F.col("state") == "fading"), [F.asc("change"), F.desc(F.coalesce("days_since_peak", F.lit(0))), F.asc("name")]),
        "emerging": (fresh & ~moving, [F.desc("attention_matched_documents"), F.desc("attention_density"), F.asc("name")]),
    }
    out = None
    for lane, (where, order) in orders.items():
        own = board.where(where).orderBy(*order).limit(size)
        own = own.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).withColumn("lane", F.lit(lane))
        out = own if out is None else out.unionByName(own)
    return out


def complete_date(board: DataFrame, latest: str, days: int = 7) -> DataFrame:
    """The latest of the last days on which every row is measured."""
    recent = board.where(F.datediff(F.to_date(F.lit(latest)), "date").between(0, days))
    return recent.groupBy("date").agg(F.bool_and(is_measured(F.col("coverage"))).alias("complete")).where("complete").agg(F.max("date").alias("date"))


def snapshots(definitions: DataFrame, trends: DataFrame, current: str, previous: str) -> DataFrame:
    """definitions with current_ and previous_ density, state, coverage and attention_z."""
    cols = ("density", "state", "coverage", "attention_z")
    at = lambda d, p: trends.where(F.col("date") == F.to_date(F.lit(d))).select("definition_id", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    return definitions.join(at(current, "current"), "definition_id", "left").join(at(previous, "previous"), "definition_id", "left")


def changes(rows: DataFrame, current: str, previous: str | None) -> DataFrame:
    """One row per change of a definition between two snapshots, with its rank in the report."""
    now, was = is_measured(F.col("current_coverage")), is_measured(F.col("previous_coverage"))
    change = F.coalesce(half_up(F.col("current_density") - F.col("previous_density")), F.lit(0.0))
    expired = F.col("status") == "expired"
    since = F.to_date(F.lit(previous or current))
    both = now & was
    state = F.coalesce(both & (F.col("current_state") != F.col("previous_state")), F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(expired, "expired_definition"),
            F.when(~expired & (F.col("activated") >= since), "new_definition"),
            F.when(~expired & now & ~was & F.lit(previous is not None), "entered_board"),
            F.when(~expired & ~now & was, "left_board"),
            F.when(~expired & state, "state_change"),
            F.when(~expired & both & ~state & (F.abs(change) >= 1), "mover"),
        )
    )
    out = rows.withColumn("change", change).withColumn("change_kind", F.explode(kinds))
    rank = F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change_kind"))
    return out.withColumn("priority", rank.cast("int") - 1)


def state_counts(rows: DataFrame) -> DataFrame:
    """state, n: measured definitions by state; others that have not expired count as unmeasured."""
    state = F.when(is_measured(F.col("current_coverage")) & F.col("current_state").isNotNull(), F.col("current_state")).when(F.col("status") != "expired", "unmeasured")
    return rows.select(state.alias("state")).where("state is not null").groupBy("state").agg(F.count("*").alias("n"))


def alerts(changed: DataFrame, rising: DataFrame, date: str) -> DataFrame:
    """definition_id, alert_date, alert_type, severity: one per definition, date and type."""
    day = F.to_date(F.lit(date)).alias("alert_date")
    state = changed.where("change_kind = 'state_change'").select("definition_id", day, F.lit("state_change").alias("alert_type"), F.when(F.col("current_state").isin("rising", "fading"), "warning").otherwise("notice").alias("severity"))
    new = changed.where("change_kind = 'new_definition'").select("definition_id", day, F.lit("new_definition").alias("alert_type"), F.lit("notice").alias("severity"))
    mover = changed.where((F.col("change_kind") == "mover") & (F.abs("change") >= 3)).select("definition_id", day, F.lit("mover").alias("alert_type"), F.lit("notice").alias("severity"))
    surge = rising.where(F.col("attention_z") >= 2.5).select("definition_id", day, F.lit("attention_surge").alias("alert_type"), F.lit("warning").alias("severity"))
    return state.unionByName(new).unionByName(mover).unionByName(surge).dropDuplicates(["definition_id", "alert_date", "alert_type"])


def brief(lane_rows: DataFrame, changed: DataFrame, counts: DataFrame, date: str) -> DataFrame:
    """One row: date, lead and its state, fading, headline (what kind of day it is), unmeasured, transitions, and the
    number of narratives in each state.

    The lead is the first measured structural narrative that rises, then one that peaks; else the first of any kind
    that rises, then peaks; else one that is emerging. A lane item without coverage never leads.
    """
    measured, structural = F.col("state") != "unmeasured", F.coalesce("kind", F.lit("structural")) == "structural"
    turn = (
        F.when((F.col("lane") == "rising") & measured & structural, 0)
        .when((F.col("lane") == "peaking") & measured & structural, 1)
        .when((F.col("lane") == "rising") & measured, 2)
        .when((F.col("lane") == "peaking") & measured, 3)
        .when((F.col("lane") == "emerging") & (F.col("state") == "emerging"), 4)
    )
    first = lambda what, rank: F.min_by(what, F.when(rank.isNotNull(), F.struct(rank, "place")))
    falling = F.when((F.col("lane") == "fading") & measured, 0)
    leads = lane_rows.agg(first("name", turn).alias("lead"), first("state", turn).alias("lead_state"), first("name", falling).alias("fading"))
    by_state = counts.agg(*[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("unmeasured", "rising", "peaking", "steady", "emerging", "dormant")], F.coalesce(F.sum(F.when(F.col("state") == "fading", F.col("n"))), F.lit(0)).alias("fading_count"))
    moved = changed.agg(F.count_if(F.col("change_kind") == "state_change").alias("transitions"))
    row = leads.crossJoin(by_state).crossJoin(moved)  # a row each
    what = F.when(F.col("lead_state") == "rising", "gaining").when(F.col("lead_state") == "peaking", "at_peak").when(F.col("lead").isNotNull(), "newly_measurable").when(F.col("fading").isNotNull(), "only_fading").when(F.col("unmeasured") > 0, "awaiting_coverage").otherwise("no_movement")
    return row.select(F.to_date(F.lit(date)).alias("date"), "lead", "lead_state", "fading", what.alias("headline"), "unmeasured", "transitions", "rising", "peaking", "steady", "fading_count", "emerging", "dormant")


def brief_sections(lane_rows: DataFrame, changed: DataFrame, most: int = 8) -> DataFrame:
    """section, place, definition_id, what: the parts of a brief in their order, rising, peaking, fading, emerging and what
    changed; of the changes that are no movers the first `most`, in the order of reports. Parts without rows are absent."""
    order = {lane: k for k, lane in enumerate(("rising", "peaking", "fading", "emerging"))}
    rank = F.coalesce(*[F.when(F.col("lane") == lane, k) for lane, k in order.items()])
    shown = lane_rows.select(rank.alias("section"), F.col("place").cast("long").alias("place"), "definition_id", F.col("lane").alias("what"))
    kinds = F.coalesce(*[F.when(F.col("change_kind") == c, k) for k, c in enumerate(CHANGES)])
    order_ = [kinds, F.desc(F.abs("change")), "name", "definition_id"]
    told = changed.where("change_kind <> 'mover'").orderBy(*order_).limit(most)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order_))
    return shown.unionByName(told.select(F.lit(len(order)).alias("section"), place.cast("long").alias("place"), "definition_id", F.col("change_kind").alias("what")))


def brief_ids(sections_: DataFrame) -> DataFrame:
    """definition_id, place: the narratives that a brief's lanes name, each once, in the order in which they come up."""
    first = sections_.where("what NOT IN ('" + "', '".join(CHANGES) + "')").groupBy("definition_id").agg(F.min(F.struct("section", "place")).alias("at"))
    return first.select("definition_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at")).cast("long").alias("place"))


def brief_lines(lane_rows: DataFrame) -> DataFrame:
    """lane, place, line: the sentences of a daily brief."""
    sign = F.when(F.col("change") >= 0, "+").otherwise("")
    return lane_rows.select("lane", "place", F.concat(F.col("name"), F.lit(" is "), F.col("state"), F.lit(" at "), F.format_number("density", 2), F.lit(" ("), sign, F.format_number("change", 2), F.lit(").")).alias("line"))


def peak_position(density: Column, peak: Column, days: Column) -> Column:
    """How a density stands to its peak, in words."""
    share = F.floor(100 * density / F.nullif(peak, F.lit(0.0)) + 0.5).cast("long")
    return F.when(days.isNull() | (peak <= 0), "no measured peak").when(days == 0, "at its peak").otherwise(F.concat(share.cast("string"), F.lit("% of its peak, "), days.cast("string"), F.when(days == 1, " day ago").otherwise(" days ago")))


def sections(definitions: DataFrame) -> DataFrame:
    """section, definition_id, place: structural narratives head a section, events follow under their parent."""
    head = F.coalesce("parent_id", "definition_id")
    order = [F.when(F.col("kind") == "structural", 0).otherwise(1), F.asc("name")]
    return definitions.select(head.alias("section"), "definition_id", "kind", "name").withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order)))
