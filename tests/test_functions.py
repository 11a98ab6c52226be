"""Expressions on hand-computed values."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from storytide.functions import address, jsondoc, numeric, similarity, text
from storytide.operators import bursts, candidates, ingest, narrative, relational, themes


def one(spark, column, **values):
    row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_rounding(spark):
    assert one(spark, numeric.half_up(F.col("a")), a=1.005) == pytest.approx(1.0)
    assert one(spark, numeric.half_up(F.col("a")), a=-1.5) == -1.5
    assert one(spark, numeric.half_up(F.col("a"), 0), a=-0.5) == 0.0
    assert one(spark, numeric.ratio(F.col("a"), F.col("b")), a=1, b=0) == 0.0


def test_statistics(spark):
    v = [1.0, 2.0, 3.0, 4.0, 100.0]
    assert one(spark, numeric.robust_scale(F.col("a")), a=v) == pytest.approx(1.4826)
    assert one(spark, numeric.robust_scale(F.col("a")), a=[5.0, 5.0, 5.0]) == 0.5
    assert one(spark, numeric.median_of(F.col("a")), a=[4.0, 1.0, 3.0, 2.0]) == 2.5
    assert one(spark, numeric.deviation_of(F.col("a")), a=[3.0]) == 0.0
    assert one(spark, numeric.percentile_rank(F.col("a"), F.lit(2.0)), a=[1.0, 2.0, 3.0]) == 67


def test_score_and_boost(spark):
    assert one(spark, themes.score_contribution(F.lit(80), F.lit(20), F.lit(90), F.lit(True))) == 0.792
    assert one(spark, themes.boost(F.lit(2.0), F.lit(3), F.lit(4))) == pytest.approx(2.32)
    assert one(spark, themes.boost(F.lit(1.0), F.lit(10), F.lit(50))) == pytest.approx(1.30)


def test_similarity(spark):
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))
    assert one(spark, similarity.jaccard(a, b)) == 0.5
    assert one(spark, similarity.overlap(a, b)) == 0.0
    assert [one(spark, similarity.collision_floor(F.lit(n))) for n in (3, 4, 6)] == [3, 3, 4]


def test_chunks(spark):
    d = spark.range(1).select(F.lit(1).alias("document_id"), F.repeat(F.lit("x"), 17000).alias("text"))
    assert [r["start"] for r in ingest.chunk_rows(d).orderBy("chunk_index").collect()] == [0, 7500, 15000]
    short = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "document_id int, text string")
    assert [(r["document_id"], r["content"]) for r in ingest.chunk_rows(short).collect()] == [(1, "abc")]


def test_texts(spark):
    assert one(spark, text.html_to_text(F.lit("<p>a&nbsp;&amp; b</p><script>x</script>"))) == "a & b"
    assert one(spark, text.slug(F.lit("Oil & Gas!"))) == "oil-and-gas"
    assert one(spark, text.title_ngrams(F.lit("Fed cuts rates again; Fed cuts"))) is not None
    assert one(spark, text.story_fingerprint(F.lit(""), F.lit(""), F.lit("Fed Cuts"))) == one(spark, F.md5(F.lit(" ed uts")))
    assert text.find_quotation("He said:  “we  grew”&nbsp;fast.", '"we grew" fast') == "“we  grew”&nbsp;fast"
    assert text.find_quotation("abc", "x") is None
    body = "Welcome to the call. " * 40
    assert text.question_boundary(body + "\nOperator: our first question comes from Ann of X.\n" + "Thanks. " * 40)[1] == "operator_cue"
    assert text.question_boundary("short") == (None, "none") == text.question_boundary(None)
    assert text.question_boundary(body + "\n[Q&A]\n" + "Thanks. " * 40) == (len(body) + 1, "heading")
    assert text.question_boundary(body + "\nOperator: it comes from Ann with X.\n" + "Thanks. " * 40)[1] == "first_analyst_question"


def test_addresses(spark):
    assert one(spark, address.canonical_url(F.lit("http://a.b/c?utm_source=x&id=1&ref=2#f"))) == "http://a.b/c?id=1"
    assert one(spark, address.canonical_url(F.lit("no address"))) == "no address"
    assert one(spark, address.hostname(F.lit("https://WWW.Reuters.com/x"))) == "reuters.com"
    assert one(spark, address.owner_of(F.lit("https://www.wsj.com/a"), F.lit("x"))) == "dow-jones"
    assert one(spark, address.owner_of(F.lit("bad"), F.lit("The New York Times"))) == "nyt"
    assert one(spark, address.owner_of(F.lit("bad"), F.lit("Some Paper"))) == "some-paper"


def test_json(spark):
    assert one(spark, jsondoc.has_key(F.lit('{"a": null}'), "a")) is True
    assert one(spark, jsondoc.get(jsondoc.merged(F.lit('{"a":1,"b":2}'), F.lit('{"b":3}')), "b")) == "3"
    assert one(spark, jsondoc.has_key(jsondoc.without(F.lit('{"a":1,"b":2}'), "a"), "a")) is False


def test_lifecycle(spark):
    def state(**k):
        v = {"covered": True, "low_history": False, "density": 5.0, "previous": 5.0, "change": 0.0, "previous_change": 0.0, "percentile": 50, "peak": 5.0, "days": 0, "stories": 5, "owners": 5} | k
        c = {n: F.lit(x).cast("double") if n == "previous" else F.lit(x) for n, x in v.items()}
        return one(spark, narrative.lifecycle(*[c[n] for n in ("covered", "low_history", "density", "previous", "change", "previous_change", "percentile", "peak", "days", "stories", "owners")]))

    assert state(covered=False) == "unmeasured"
    assert state(density=0.0, previous=None) == "dormant"
    assert state(density=0.0, previous=2.0) == "fading"
    assert state(change=-1.0, previous_change=-1.0) == "fading"
    assert state(low_history=True) == "emerging"
    assert state(stories=2) == "steady"
    assert state(change=1.0) == "rising"
    assert state(percentile=90) == "peaking"
    assert state() == "steady"


def test_density(spark):
    d = datetime.date(2024, 1, 1)
    rows = [("n", d, 1, "newspaper", True), ("n", d, 2, "newspaper", False), ("n", d, 3, "filing", True)]
    o = spark.createDataFrame(rows, "definition_id string, date date, document_id int, source_class string, matched boolean").withColumn("raw_matched", F.col("matched")).withColumn("match_score", F.lit(80.0))
    r = narrative.pooled(o, o.select("definition_id", "date", F.lit(0).alias("idx")).distinct(), 1).select(numeric.half_up(F.col("density")).alias("x")).first()
    assert r["x"] == 69.34


def test_baseline_counts(spark):
    d = datetime.date(1998, 6, 30)
    rows = [(1, 1, d, "c", ["e"], 1.0, "t", "market")]
    c = spark.createDataFrame(rows, "signal_id int, document_id int, date date, source_class string, entities array<string>, score double, theme_id string, trend_level string")
    got = {r["trend_window"]: r["baseline_days"] for r in themes.window_scores(c, "1998-06-30").where("date = date'1998-06-30'").collect()}
    assert got == {"7d": 107, "30d": 61}


def test_bursts(spark):
    d = datetime.date(2024, 1, 30)
    rows = [(i, d, f"s{i}", f"o{i}", "new thing", 0) for i in range(4)]
    rows += [(100 + i, d - datetime.timedelta(days=7 * (i + 1)), f"p{i}", "o", "old thing", 0) for i in range(12)] + [(200 + i, d, f"q{i}", f"o{i}", "old thing", 0) for i in range(9)]
    t = spark.createDataFrame(rows, "document_id int, date date, story_fingerprint string, publisher_owner string, term string, kind int")
    got = {r["term"]: r for r in bursts.scored_terms(t, "2024-01-30").collect()}
    assert (got["new thing"]["novel"], got["new thing"]["z_score"], got["new thing"]["score"]) == (True, 4.0, 8.0)
    assert (got["old thing"]["baseline_mean"], got["old thing"]["z_score"], got["old thing"]["score"]) == (1.0, 8.0, 8.0)


def test_nested_suppression(spark):
    rows = [("alpha beta gamma", "title_ngram", 4, 3, 9.0), ("alpha beta", "title_ngram", 4, 3, 8.0), ("beta gamma", "title_ngram", 5, 3, 7.0), ("alpha", "entity", 4, 3, 6.0)]
    b = spark.createDataFrame(rows, "term string, kind string, stories long, owners long, score double")
    assert [r["term"] for r in bursts.without_nested(b).orderBy("rank").collect()] == ["alpha beta gamma", "beta gamma", "alpha"]


def test_selected_evidence(spark):
    d = datetime.date(2024, 1, 1)
    rows = [("c", 1, 9.0, d, "s1", "t1", "n1"), ("c", 2, 8.0, d, "s1", "t2", "n2"), ("c", 3, 7.0, d, "s3", "t3", None), ("c", 4, 7.0, d, "s4", "t1", None)]
    e = spark.createDataFrame(rows, "candidate_id string, document_id int, score double, published date, snippet_key string, title_key string, near_key string")
    assert [r["document_id"] for r in candidates.selected_evidence(e).orderBy("rank").collect()] == [1, 3]


def _selected_by_loop(rows, most):
    out = []
    for c in {r[0] for r in rows}:
        seen, n = [set(), set(), set()], 0
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], -r[3].toordinal(), r[1])):
            if n < most and not any(k and k in s for k, s in zip(r[4:], seen, strict=True)):
                n += 1
                out.append((c, r[1], r[2], n))
                for k, s in zip(r[4:], seen, strict=True):
                    s.add(k)
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [50_000, 100])
def test_selected_evidence_in_batches(spark, monkeypatch, large):
    """Candidates of all sizes, none with a Python call of its own; batches end within them; keys are missing or empty."""
    rng, d = random.Random(5), datetime.date(2024, 1, 1)
    key = lambda p, n: rng.choice([None, "", *[f"{p}{rng.randrange(n)}"] * 12])
    rows = []
    for c, n, kinds in [(f"c{i}", 1 + i % 9, 6) for i in range(150)] + [("few keys", 1500, 4), ("rare third", 1500, 2), ("many keys", 1500, 10_000)]:
        rows += [(c, len(rows) + i, float(rng.randrange(8)), d + datetime.timedelta(rng.randrange(4)), key("s", 4 if c == "few keys" else kinds), key("t", kinds), key("n", 300 if c == "rare third" else kinds)) for i in range(n)]
    e = spark.createDataFrame(rows, "candidate_id string, document_id int, score double, published date, snippet_key string, title_key string, near_key string")
    monkeypatch.setattr(candidates, "LARGE", large, raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "61")
    try:
        for most in (3, 10):
            got = candidates.selected_evidence(e, most)
            assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, got.collect()), key=str) == _selected_by_loop(rows, most)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_contenders_of_large_candidates(spark):
    """Of 20 000 rows those are left that can be selected whatever else there is, up to a bound."""
    rows = spark.range(20_000).selectExpr("'c' AS candidate_id", "id AS document_id", "1.0D AS score", "date'2024-01-01' AS published", "concat('s', id % 3) AS snippet_key", "concat('t', id % 5) AS title_key", "concat('n', id) AS near_key")
    order = [F.desc("score"), F.desc("published"), F.asc("document_id")]
    assert candidates._contenders(rows, 3, order).count() == 3 * 5 * 3  # of each snippet and title three rows
    free = rows.withColumns({"snippet_key": F.concat(F.lit("s"), "document_id"), "title_key": F.lit(None).cast("string")})
    assert [r["document_id"] for r in candidates._contenders(free, 3, order).orderBy("document_id").collect()] == list(range(367))


def test_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "s int, t int")
    assert {r["s"]: (r["t"], r["steps"]) for r in relational.resolve_chain(links, "s", "t").collect()} == {1: (4, 3), 2: (4, 2), 3: (4, 1), 10: (11, 1)}


def test_title_ngrams_against_loop(spark):
    import re

    from storytide.functions import lists

    def grams(title):
        t = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9&%$.\- ]+", " ", re.sub("['’]", "", title.lower()))).strip()
        words = [w for w in t.split(" ") if len(w) > 1 and w not in lists.TITLE_STOPWORDS and not re.fullmatch(r"\d+(\.\d+)?%?", w)]
        out = [" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)]
        return list(dict.fromkeys(g for g in out if re.search("[a-z]{3,}", g)))

    titles = ["Chip demand surges as data centers expand in Texas", "", "Q1 5% up", "Oil's slide: crude oil slide 2024", "one word"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r["x"] for r in df.select(text.title_ngrams(F.col("t")).alias("x")).collect()] == [grams(t) for t in titles]


def test_json_types(spark):
    m = jsondoc.merged(F.lit('{"a":1,"b":"x","c":{"d":[1,2]}}'), F.lit('{"b":2.5,"e":null,"f":false}'))
    assert one(spark, m) == '{"a":1,"c":{"d":[1,2]},"b":2.5,"e":null,"f":false}'
    assert one(spark, jsondoc.without(m, "b")) == '{"a":1,"c":{"d":[1,2]},"e":null,"f":false}'
    assert one(spark, jsondoc.without(F.lit(None).cast("string"), "b")) is None


def test_amounts_stay_in_terms(spark):
    assert "$5 sale" not in one(spark, text.title_ngrams(F.lit("$5 10 fee"))) and "$5 fee" in one(spark, text.title_ngrams(F.lit("$5 10 fee")))
    assert "2024-25 season" in one(spark, text.title_ngrams(F.lit("2024-25 season 12% 3.5")))


def test_passages_and_chrome(spark):
    assert one(spark, text.passages(F.lit("One is. Two is\nthree&#8226;four&#x2022; five • six. seven"))) == ["One is.", "Two is", "three", "four", "five • six. seven"]
    html = '<p>Keep</p><div class="subscription-widget x"><p>Sign up</p></div><p> Thanks for reading this</p><p>End</p>'
    assert one(spark, text.html_to_text(text.without_chrome(F.lit(html)))) == "Keep End"


def test_rolling_distinct_against_loop(spark):
    import random

    rng = random.Random(3)
    first = datetime.date(2024, 1, 1)
    day = lambda k: first + datetime.timedelta(days=k)
    rows = [(rng.choice("ab"), day(rng.randrange(40)), rng.choice("xy"), f"m{rng.randrange(6)}") for _ in range(120)]
    members = spark.createDataFrame(rows, "k string, date date, kind string, m string")
    grid = spark.createDataFrame([(k, day(i)) for k in "abc" for i in range(40)], "k string, date date")
    for w in (1, 3, 7, 50):
        got = relational.rolling_distinct(members, grid, ["k"], w, {"x": "n_x", "y": "n_y"}).collect()
        assert len(got) == 120
        for r in got:
            for kind, n in (("x", r.n_x), ("y", r.n_y)):
                assert n == len({m for k, d, c, m in rows if k == r.k and c == kind and 0 <= (r.date - d).days < w})


def test_transcript_sections(spark):
    body = "We had a fine quarter. " * 40
    call = body + "\nQuestion-and-Answer Session\n" + "Thanks. " * 40
    x = spark.createDataFrame([(call,), ("short",), (None,)], "t string").withColumn("b", text.transcript_boundary("t"))
    got = [(r.b.at, r.b.method, r.s and [tuple(p) for p in r.s]) for r in x.withColumn("s", text.transcript_spans(F.col("t"), F.col("b.at"))).collect()]
    assert got[0] == (len(body) + 1, "heading", [("prepared_remarks", 0, len(body) + 1), ("qa", len(body) + 1, len(call))])
    assert got[1] == (None, "none", [("prepared_remarks", 0, 5)]) and got[2][:2] == (None, "none")


def test_stored_sections(spark):
    ok = '{"transcriptSections":{"sections":[{"label":"prepared_remarks","start":0,"end":5},{"label":"qa","start":5,"end":9}]}}'
    read = lambda s, n=9: one(spark, text.stored_spans(F.lit(s), F.lit(n)))
    assert [tuple(s) for s in read(ok)] == [("prepared_remarks", 0, 5), ("qa", 5, 9)]
    for bad in (ok.replace('"qa"', '"other"'), ok.replace('"end":9', '"end":10'), ok.replace('"end":9', '"end":5'), ok.replace('"start":0', '"start":-1'), ok.replace('"end":5', '"end":5.5'), '{"transcriptSections":{"sections":[]}}', "{}", None):
        assert read(bad) is None



def test_documents_of_one_day_are_counted_once(spark):
    """Documents of one day come as counts, others as rows, null ids among them; windows count both."""
    rng = random.Random(7)
    rows = []
    for doc in [*range(60), None]:
        for _ in range(1 if doc is not None and doc < 50 else 4):
            day, matched = rng.randrange(12), rng.random() < 0.6
            rows.append((rng.choice("ab"), doc, datetime.date(2024, 1, 1 + day), rng.choice(["f", "g", None]), matched, matched or rng.random() < 0.5, rng.uniform(0, 120), f"p{rng.randrange(4)}", f"o{rng.randrange(3)}", rng.choice(["", "s1", "s2"]), [f"e{rng.randrange(5)}"]))
    o = spark.createDataFrame(rows, "definition_id string, document_id long, date date, source_class string, matched boolean, raw_matched boolean, match_score double, publisher_id string, publisher_owner string, story_fingerprint string, entities array<string>")
    got = narrative.document_days(o)
    listed = {(r[0], r[1]) for r in got.several.collect()}
    several = {k for k in {r[:2] for r in rows} if k[1] is None or len({r[2:4] for r in rows if r[:2] == k}) > 1}
    assert listed == several
    assert got.single.agg(F.sum("n")).first()[0] == len({r[:2] for r in rows} - several)
    grid = spark.createDataFrame([(k, datetime.date(2024, 1, 1 + i), i) for k in "ab" for i in range(12)], "definition_id string, date date, idx int")
    docs = lambda k, day, w, ok: len({r[1] for r in rows if r[0] == k and r[1] is not None and 0 <= (day - r[2]).days < w and ok(r)})
    for w in (1, 5):
        for r in narrative.window_breadth(o, grid, w).collect():
            assert r.classified_documents == docs(r.definition_id, r.date, w, lambda x: True)
            assert r.matched_documents == docs(r.definition_id, r.date, w, lambda x: x[4])
            assert r.attention_matched_documents == docs(r.definition_id, r.date, w, lambda x: x[5])
            assert r.publisher_breadth == len({x[7] for x in rows if x[0] == r.definition_id and x[4] and 0 <= (r.date - x[2]).days < w})
        for r in narrative.pooled(o, grid, w).collect():
            total = weights = attention = 0.0
            for c in ("f", "g", None):
                own = [x for x in rows if x[0] == r.definition_id and x[3] == c and 0 <= (r.date - x[2]).days < w]
                n, hit = len({x[1] for x in own}), len({x[1] for x in own if x[4]})
                best = {}
                for x in own:
                    if x[5]:
                        best[x[1], x[2]] = max(best.get((x[1], x[2]), 0.0), min(x[6], 100.0) / 100)
                if n and c is not None:
                    total, weights, attention = total + 100 * hit / n * math.log1p(n), weights + math.log1p(n), attention + 100 * sum(best.values()) / n * math.log1p(n)
            assert abs(r.density - total / weights) < 1e-9 and abs(r.attention_density - attention / weights) < 1e-9


def test_nested_expressions_are_computed_once(spark):
    from storytide.sources import readers

    df = spark.createDataFrame([('{"k":1}', "Our BUSINESS")], "j string, t string")
    plan = lambda x: df.select(x.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(readers.filing_part(F.col("t"))).count("lower(") == 1
    x = F.col("j")
    for k in range(4):
        x = jsondoc.with_path(x, [f"p{k}"], F.lit("1"))
    assert plan(x).count("from_json(") + plan(x).lower().count("jsontostructs(") <= 4
