"""Promotion, telemetry, jobs, feeds, exhibits and presets on rows that reach their edges."""

import datetime

import pytest
from pyspark.sql import functions as F

from storytide.functions import text
from storytide.operators import candidates, normalise, status, themes
from storytide.sources import readers

NOW = datetime.datetime(2024, 3, 20, 12)
AT = lambda **back: NOW - datetime.timedelta(**back)


def test_policies_cannot_loosen_the_floors():
    loose = candidates.bounded(candidates.PromotionPolicy(1.0, 1, 1, 90))
    assert (loose.least_score, loose.least_stories, loose.least_owners, loose.window_days) == (90.0, 3, 3, 7)
    strict = candidates.bounded(candidates.PromotionPolicy(95.0, 5, 4, 0))
    assert (strict.least_score, strict.least_stories, strict.least_owners, strict.window_days) == (95.0, 5, 4, 1)


def test_promotion_queue(spark):
    old, new = AT(days=9), AT(days=1)
    c = [("good", "pending", None, None, old), ("again", "pending", "ineligible", old, new), ("done", "pending", "ineligible", new, old), ("eligible", "pending", "eligible", new, old), ("closed", "promoted", None, None, old), ("thin", "pending", None, None, old), ("attached", "pending", None, None, old), ("waits", "pending", None, None, old)]
    rows = []

    def add(candidate, k, back, **how):
        row = {"candidate_id": candidate, "document_id": f"{candidate}{k}", "published": AT(days=back), "score": 95.0, "text_hash": "h", "content_hash": "h", "content": "full", "owner": f"o{k}", "publisher": "p", "platform": "web", "url": "https://x.test/a", "story": f"s{k}"}
        rows.append(tuple((row | how).values()))

    for name in ("good", "again", "done", "eligible", "closed", "attached", "waits"):
        for k in range(3):
            add(name, k, 1 + k)
    for name in ("good", "again", "eligible"):
        add(name, 9, 20, owner="o9")
    for k, how in enumerate(({"owner": "YouTube "}, {"content": "Preview"}, {"content_hash": "other"}, {"score": 89.9}, {"url": "https://m.youtube.com:443/x"}, {"platform": "YouTube"}, {"published": AT(days=8)}, {"published": NOW + datetime.timedelta(hours=1)})):
        add("thin", k, 1, **how)
    add("thin", 20, 1), add("thin", 21, 1)
    df = spark.createDataFrame(c, "candidate_id string, status string, validation string, evaluated timestamp, updated timestamp")
    ev = spark.createDataFrame(rows, "candidate_id string, document_id string, published timestamp, score double, text_hash string, content_hash string, content string, owner string, publisher string, platform string, url string, story string")
    parents = spark.createDataFrame([("d", "attached0"), ("d", "attached1"), ("e", "waits0")], "definition_id string, document_id string")
    got = {r.candidate_id: r.persistent for r in candidates.promotion_queue(df, ev, parents, str(NOW), limit=50).collect()}
    assert got == {"good": True, "again": True, "eligible": True, "attached": True, "waits": False}
    assert candidates.promotion_queue(df, ev, parents, str(NOW), limit=2).count() == 2


def test_promotion_verdicts(spark):
    d = [("ok", "approve", "structural", None, ""), ("event", "approve", "event", " ", None), ("people", "manual_review", "structural", None, "No single company"), ("none", "reject", None, None, None)]
    ok = lambda c, k, **how: tuple(({"candidate_id": c, "evidence_id": k, "verdict": "support", "supports": True, "violates": False, "event_key": f"e{k}", "entity_key": f"n{k}", "story": f"s{k}", "owner": f"o{k}", "source_class": "filing"} | how).values())
    v = [ok("ok", k) for k in range(3)] + [ok("event", k, event_key="one") for k in range(3)] + [ok("people", k, entity_key=" ") for k in range(2)] + [ok("people", 7, violates=True), ok("people", 8, verdict="reject"), ok("none", 1, supports=None)]
    x = candidates.promotion_verdicts(spark.createDataFrame(d, "candidate_id string, decision string, kind string, event_label string, exclusion string"), spark.createDataFrame(v, "candidate_id string, evidence_id int, verdict string, supports boolean, violates boolean, event_key string, entity_key string, story string, owner string, source_class string"))
    got = {r.candidate_id: (r.status, r.reasons) for r in x.collect()}
    assert got["ok"] == ("eligible", [])
    assert got["event"] == ("ineligible", ["EVENT_LABEL_REQUIRED"])
    assert got["people"] == ("manual_review", ["VALIDATOR_REQUIRES_MANUAL_REVIEW", "INSUFFICIENT_UNIQUE_STORIES", "INSUFFICIENT_PUBLISHER_OWNERS", "MISSING_PRIMARY_ENTITY_KEYS", "SINGLE_COMPANY_EXCLUSION_VIOLATED"])
    assert got["none"] == ("ineligible", ["VALIDATOR_REJECTED", "INSUFFICIENT_UNIQUE_STORIES", "INSUFFICIENT_PUBLISHER_OWNERS", "STRUCTURAL_REQUIRES_MULTIPLE_EVENTS_OR_ENTITIES", "STRUCTURAL_REQUIRES_SOURCE_OR_EVENT_BREADTH"])


@pytest.mark.parametrize(("events", "state"), [("queue", "queued"), ("queue claim", "running"), ("queue stop", "cancelled"), ("queue claim stop", "stop_requested"), ("queue claim stop stop", "cancelled"), ("queue claim stop finish", "cancelled"), ("queue claim finish stop", "completed"), ("queue claim fail claim", "failed"), ("claim queue", "queued"), ("queue cancelled claim", "running")])
def test_jobs(spark, events, state):
    rows = [("j", AT(minutes=4, seconds=-k), e) for k, e in enumerate(events.split())]
    got = status.controlled_jobs(spark.createDataFrame(rows, "job string, at timestamp, event string"), str(NOW)).collect()
    assert [(r.state, r.stale) for r in got] == [(state, False)]
    late = status.controlled_jobs(spark.createDataFrame([(j, t - datetime.timedelta(minutes=5), e) for j, t, e in rows], "job string, at timestamp, event string"), str(NOW)).first()
    stale = state in ("running", "stop_requested")
    assert (late.state, late.stale) == ("failed" if stale else state, stale)


def test_polling_without_runs(spark):
    runs = spark.createDataFrame([("poll_sources", "failed", '{"fetched": 3}'), ("poll_sources", "completed", "no json"), ("x", "completed", '{"fetched": 9}')], "stage string, status string, metadata string")
    assert tuple(status.polling(runs).first()) == (1, 0, 0, 0, 0, 0.0)
    runs = spark.createDataFrame([("poll_sources", "completed", '{"fetched": 3, "skipped": 2, "inserted": 1}')] * 2, runs.schema)
    assert tuple(status.polling(runs).first()) == (2, 6, 2, 4, 0, 0.667)


def test_exhibits(spark):
    rows = [("ex99-1.htm", "EX-31"), ("EX99.2.HTML", None), ("exhibit99.txt", "text/plain"), ("ex-10.htm", ""), ("a.txt", " ex-10.1 "), ("guidance.htm", None), ("ex99.xml", "EX-99"), ("main.htm", "EX-99"), ("ex99.pdf", "EX-99"), (None, "EX-99")]
    df = spark.createDataFrame([(n, t, "main.htm") for n, t in rows], "name string, type string, primary string")
    got = {r.name: (r.exhibit_type, r.relevance) for r in readers.exhibits(df).collect()}
    assert got == {"EX99.2.HTML": ("EX-99.2", "high"), "exhibit99.txt": ("EX-99", "low"), "a.txt": ("EX-10.1", "medium"), "guidance.htm": ("guidance.htm", "low")}


def test_lookback(spark):
    rows = [(None, 7), (AT(minutes=30), 7), (AT(hours=20, minutes=1), 7), (NOW + datetime.timedelta(days=1), 7)]
    x = spark.createDataFrame(rows, "t timestamp, d int").select(readers.lookback_hours(F.col("t"), F.col("d"), str(NOW)))
    assert [r[0] for r in x.collect()] == [168, 12, 27, 12]


def test_feeds_have_their_own_caps(spark, tmp_path):
    item = lambda k: f"<item><title>T{k}</title><link>http://x/{k}</link><pubDate>Wed, 20 Mar 2024 {k:02}:00:00 +0000</pubDate><description>b</description></item>"
    for name in ("one", "two", "unknown"):
        (tmp_path / f"feed={name}").mkdir()
        (tmp_path / f"feed={name}" / "f.xml").write_text("<rss><channel>" + "".join(item(k) for k in range(10)) + "</channel></rss>")
    feeds = spark.createDataFrame([("one", "One", "o", "snippet", None, 2, 3), ("two", "Two", "t", "full_text", AT(hours=1), 2, 9)], "feed_id string, name string, owner string, retention string, last_published timestamp, backfill_days int, most int")
    got = readers.registered(spark, f"{tmp_path}/feed=*", feeds, str(NOW)).collect()
    assert sorted(r.title for r in got if r.source == "one") == ["T7", "T8", "T9"] and {r.publisher for r in got} == {"One", "Two"}
    assert sorted(r.title for r in got if r.source == "two") == [f"T{k}" for k in range(1, 10)]
    both = readers.feed(spark, f"{tmp_path}/feed=*", str(NOW), limit=2).collect()
    assert len(both) == 6  # two of each payload


def test_presets(spark):
    p = [("wsj", "wsj", "WSJ Markets", "https://feeds.a.test/rss", "https://www.wsj.com/"), ("x", "trade", "Reuters Energy", "https://f.test/rss", "https://www.some-paper.test/"), ("y", "trade", "Nobody", "https://f.test/rss", "https://www.some-paper.test/")]
    g = spark.createDataFrame([("wsj", "dow-jones"), ("trade", "")], "group string, owner string")
    got = {r.feed_id: (r.owner, r.retention, r.most) for r in readers.preset_feeds(spark.createDataFrame(p, "id string, group string, name string, url string, homepage string"), g).collect()}
    assert got == {"wsj": ("dow-jones", "snippet", 50), "x": ("reuters", "snippet", 50), "y": ("some-paper", "snippet", 50)}


def test_subthemes(spark):
    rows = [("a", None, None, "A"), *((f"s{k:02}", "a", None if k < 3 else "sector", f"L{k:02}") for k in range(15))]
    got = [r.subtheme_id for r in themes.subthemes(spark.createDataFrame(rows, "theme_id string, parent_theme_id string, sector string, label string")).orderBy("place").collect()]
    assert got == [f"s{k:02}" for k in range(3, 15)]


def test_sections_and_transcripts(spark):
    x = spark.createDataFrame([("a" * 120_000,), ("b" * 120_001,), ("c" * 178_001,), ("",)], "t string")
    got = [[(s.label, len(s.text)) for s in r[0]] for r in x.select(text.sections(F.col("t"))).collect()]
    assert got[0] == [("Full document", 120_000)] and got[1] == [("Section 1", 60_000), ("Section 2", 60_000), ("Section 3", 4_001)]
    assert [n for _, n in got[2]] == [60_000, 60_000, 60_000, 4_001] and got[3] == [("Full document", 0)]
    said = spark.createDataFrame([("\r\nPresentation\r\n\r\n\r\n\r\nHi\tall\nQuestions and Answers now ",)], "t string").select(text.transcript_text(F.col("t"))).first()[0]
    assert said == "[Prepared Remarks]\nPresentation\n\nHi all\n\n\n[Q&A]\nQuestions and Answers now"


def test_sequence(spark):
    x = spark.range(300).select((F.col("id") * 37 % 300).alias("k"))
    assert [r.seq for r in normalise.sequence(x, F.col("k")).orderBy("k").collect()] == list(range(1, 301))
