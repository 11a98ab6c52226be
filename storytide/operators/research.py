"""Research facts from reported figures, and the queue of leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import passages
from .relational import top_per

FACTS_PER_DOCUMENT = 40


def facts(documents: DataFrame, most: int = FACTS_PER_DOCUMENT) -> DataFrame:
    """document_id, company, published, place, metric, basis, quote: passages of 45 to 600 characters with a quantity and
    a reporting verb, not of an excluded kind; the metric named first counts. documents: document_id, company, published,
    source_class, text, and optionally tickers (array): those of several companies, whose passages belong to none for
    certain, are left out. Only filings and transcripts are read."""
    if "tickers" in documents.columns:
        documents = documents.where(F.size("tickers") == 1)
    rows = documents.where(F.col("source_class").isin("filing", "transcript")).select("document_id", "company", "published", F.posexplode(passages(F.col("text"))).alias("place", "quote"))
    q = F.col("quote")
    like = lambda p: q.rlike(f"(?i){p}")
    rows = rows.where(F.length(q).between(45, 600) & like(lists.QUANTITY) & like(lists.REPORTING_VERB) & (F.size(F.regexp_extract_all(q, F.lit(r"(\d[\d,.]*)"), 1)) <= 12))
    for p in lists.NOT_RESEARCH:
        rows = rows.where(~like(p))
    at = F.array(*[F.struct(F.length(F.regexp_replace(q, f"(?is)({p}).*$", "")).alias("at"), F.lit(k).alias("k"), F.lit(m).alias("metric"), like(p).alias("has")) for k, (m, p) in enumerate(lists.METRICS)])
    first = F.array_min(F.filter(at, lambda x: x["has"]))
    rows = rows.withColumn("metric", first["metric"]).where("metric is not null").where(~((F.col("metric") == "Demand and capacity") & like(lists.FINANCING)))
    rows = rows.groupBy("document_id", "company", "published", "metric", "quote").agg(F.min("place").alias("place"))
    rows = rows.withColumn("basis", F.when(like(lists.OUTLOOK), "Outlook").otherwise("Reported result"))
    return top_per(rows, ["document_id"], most, F.asc("place"))


def question(company: Column, names: Column, quotes: Column) -> Column:
    """What a lead asks, from its metrics and passages."""
    says = lambda p: F.exists(quotes, lambda q: q.rlike(f"(?i){p}"))
    cash, demand = F.array_contains(names, "Cash and investment"), F.array_contains(names, "Demand and capacity")
    return (
        F.when(says("prepayment") & demand, F.concat(F.lit("prepayments and backlog: "), company))
        .when(says("upfront license"), F.concat(F.lit("upfront licences and recurring revenue: "), company))
        .when(cash & demand, F.concat(F.lit("demand against cash and investment: "), company))
        .otherwise(F.concat(F.lit("figures against profitability: "), company))
    )


def leads(found: DataFrame, limit: int = 5) -> DataFrame:
    """company, question, reported, metrics, metric_names, facts, contrary, counter_evidence, invalidation, gaps, rank: the
    newest, most relevant fact of each metric, companies with two metrics at least. facts: at most four of them, contrary:
    the first two passages that say the opposite, each as metric, basis, document_id, quote, the newest first."""
    relevance = F.when(F.col("quote").rlike("(?i)prepayment|upfront license"), 6).otherwise(0) + F.when(F.col("quote").rlike("(?i)year.over.year|relative to|compared to|increased|decreased|grew|declined"), 3).otherwise(0)
    x = found.withColumn("relevance", relevance).withColumn("contrary", F.col("quote").rlike(f"(?i){lists.NEGATIVE}"))
    newest = [F.desc("published"), F.desc("relevance"), F.asc("document_id"), F.asc("place")]
    best = top_per(x, ["company", "metric"], 1, *newest)
    named = F.struct("metric", "basis", "document_id", "quote")
    sort_key = F.struct(F.negate(F.unix_date("published")).alias("p"), F.negate("relevance").alias("r"), "document_id", "place", named.alias("fact"))
    listed = lambda most: F.slice(F.transform(F.array_sort(F.collect_list(sort_key)), lambda v: v["fact"]), 1, most)
    per = best.groupBy("company").agg(F.count("*").alias("metrics"), F.max("published").alias("reported"), F.array_sort(F.collect_list("metric")).alias("metric_names"), F.collect_list("quote").alias("quotes"), listed(4).alias("facts")).where("metrics >= 2")  # a row a metric
    once = top_per(x.where("contrary"), ["company", "quote"], 1, *newest)
    against = top_per(once, ["company"], 2, *newest).groupBy("company").agg(F.count("*").alias("counter_evidence"), listed(2).alias("contrary"))
    out = per.join(against, "company", "left").withColumns({"counter_evidence": F.coalesce("counter_evidence", F.lit(0)), "contrary": F.coalesce("contrary", F.slice("facts", 1, 0))})
    cash = F.array_contains("metric_names", "Cash and investment")
    # one report window is one source event, so independent evidence is always missing; so are expectations
    missing = F.array_compact(F.array(F.lit("one_source_event"), F.when(~cash, "no_cash_passage"), F.when(F.col("counter_evidence") == 0, "no_contrary_passage"), F.lit("management_reported"), F.lit("expectations_unchecked")))
    out = out.select("company", question(F.col("company"), F.col("metric_names"), F.col("quotes")).alias("question"), "reported", "metrics", "metric_names", "facts", "contrary", "counter_evidence", F.when(cash, "cash_conversion").otherwise("revenue_demand_margins").alias("invalidation"), missing.alias("gaps"))
    order = [F.desc("reported"), F.desc("metrics"), F.asc("company")]
    return out.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def without_transcript(targets: DataFrame, transcripts: DataFrame, as_of: str, days: int = 120) -> DataFrame:
    """Targets (company) with no transcript of the last days."""
    recent = transcripts.where(F.datediff(F.to_date(F.lit(as_of)), "published").between(0, days))
    return targets.join(recent.select("company").distinct(), "company", "left_anti")
