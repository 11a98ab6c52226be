"""Set joins, containment, guards, divisions and quotations against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storytide.functions import lists, text
from storytide.operators import containment, guards, relational, setjoin

WORDS = [f"w{k}" for k in range(25)]


def sets(rng, n):
    return [(k, rng.sample(WORDS[: rng.choice([8, 12, 25])], rng.randint(1, 8))) for k in range(n)]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.55, 1.0])
def test_jaccard_pairs(spark, least):
    rng = random.Random(1)
    a, b = sets(rng, 120), sets(rng, 90)
    df = lambda rows: spark.createDataFrame(rows, "id long, w array<string>")
    got = {(r.a, r.b) for r in setjoin.jaccard_pairs(df(a), df(b), least).collect()}
    assert got == {(i, j) for i, x in a for j, y in b if len({*x} & {*y}) / len({*x} | {*y}) >= least}
    own = {(r.a, r.b) for r in setjoin.jaccard_pairs(df(a), df(a), least, one_way=True).collect()}
    assert own == {(i, j) for i, x in a for j, y in a if i < j and len({*x} & {*y}) / len({*x} | {*y}) >= least}
    assert setjoin.jaccard_pairs(df(a), df([]), least).collect() == []


@pytest.mark.parametrize(("least", "shared"), [(0.5, 3), (0.8, 1), (0.4, 2)])
def test_overlap_pairs(spark, least, shared):
    rng = random.Random(2)
    a, b = sets(rng, 120), sets(rng, 90)
    df = lambda rows: spark.createDataFrame(rows, "id long, w array<string>")
    got = {(r.a, r.b) for r in setjoin.overlap_pairs(df(a), df(b), least, shared).collect()}
    assert got == {(i, j) for i, x in a for j, y in b if len({*x} & {*y}) >= max(shared, least * min(len(x), len(y)))}


def test_candidates_are_few(spark):
    """Names of documents against each other: at most 20 candidates a set, though words like w0 are in most."""
    from storytide.functions.text import tokens
    from storytide.plans import views

    d = "/root/testdata/sf0.01"
    of = lambda t, key: setjoin.distinct_sets(views.table(spark, d, t).select(key, tokens(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("w")), key, "w")[0]
    a, b = of("documents", "doc_id"), of("benchmark", "item_id")
    assert setjoin.overlap_candidates(a, b, 0.5, 3).count() <= 20 * a.count()
    assert setjoin.jaccard_candidates(a, b, 0.5).count() <= 20 * a.count()


def test_containing(spark):
    rng = random.Random(3)
    texts = [(k, "".join(rng.choices("ab %_\\é👍", k=rng.randint(0, 30)))) for k in range(80)] + [(99, None)]
    terms = {"".join(rng.choices("ab %_\\é👍", k=rng.randint(1, 5))) for _ in range(150)} | {"zzz"}
    rows = spark.createDataFrame([(t,) for t in [*terms, "", "ab"]], "term string")
    got = sorted((r.k, r.term) for r in containment.containing(spark.createDataFrame(texts, "k long, t string"), "k", "t", rows, "term").collect())
    assert got == sorted((k, t) for k, x in texts if x for t in terms | {"ab"} if t in x)
    plan = containment.containing(spark.createDataFrame(texts, "k long, t string"), "k", "t", rows, "term")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    ("pattern", "want"),
    [(r"\bai\b", "ai"), ("weather|storm", None), ("(economic|industrial) growth", " growth"), ("colou?r line", "r line"), ("ab*cd", "cd"), (r"rate \d+ rise", "rate "), ("[a-z]+ing", "ing"), ("x", None), (r"a\Qzz\E", None), ("[]ab] tail", " tail"), ("abc{0,2}d", "ab"), ("(", None), ("Électric car", "lectric car")],
)
def test_literals(pattern, want):
    assert guards.literal(pattern) == want


def test_literals_are_in_all_matches():
    rng = random.Random(4)
    parts = ["ab", "c", "d?", "e*", "f+", "(gh|i)", "[jk]", r"\d", r"\b", " ", "l{0,2}", "(m)?", "."]
    for _ in range(400):
        p = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        lit = guards.literal(p)
        for _ in range(60):
            m = re.search(p, "".join(rng.choices("abcdefghijklm 12", k=12)), re.I)
            if m and lit:
                assert lit in m[0].lower(), (p, lit, m[0])


def test_guards(spark):
    import json

    rules = [
        ("a", {"requiredPatterns": [r"\brise\b", "(", " "], "forbiddenPatterns": ["weather|storm"]}),
        ("b", {"requiredTermGroups": [[" Oil  Price ", "crude"], ["up"]]}),
        ("c", {}),
        ("d", {"requiredTermGroups": [[]]}),
    ]
    defs = spark.createDataFrame([(k, json.dumps({"evidenceContract": v})) for k, v in rules] + [("e", None), ("f", "no json")], "definition_id string, metadata string")
    said = ["Prices RISE now", "prices rise; storms", "sunrise", "the OIL\n price is up", "crude is down", "", None]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    c = guards.contracts(defs)
    got = {(r.t, r.definition_id) for r in rows.crossJoin(c).where(guards.passes(F.col("t"), F.col("required"), F.col("forbidden"), F.col("groups"))).collect()}
    want = {(t, d) for t in said for d in "cef"} | {("Prices RISE now", "a"), ("the OIL\n price is up", "b")}
    assert got == want


def test_eligible_within(spark):
    import datetime

    rng, day = random.Random(5), lambda k: datetime.date(2024, 1, 30) - datetime.timedelta(days=k)
    rows = [(k, day(rng.randint(-2, 25))) for k in range(100)]
    rules = [("r5", 5), ("r5b", 5), ("r10", 10), ("r0", 0), ("r20", 20)]
    covered = [(rng.randrange(100), rng.choice(rules)[0]) for _ in range(400)] + [(1, "unknown")]
    got = {r.k for r in relational.eligible_within(spark.createDataFrame(rows, "k long, d date"), "k", "d", spark.createDataFrame(rules, "rule string, days int"), "rule", "days", spark.createDataFrame(covered, "k long, rule string"), "2024-01-30").collect()}
    assert got == {k for k, d in rows if any(d >= day(n) and (k, r) not in covered for r, n in rules)}
    assert 0 < len(got) < 100


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None, "big", "big", "big"]), rng.randint(0, 9), k, rng.choice([None, 1, 5])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, k long, v long")
    got = {r.k: (r.total, r.n) for r in relational.running_sums(df, ["g"], [F.col("o"), F.desc("k")], {"total": F.coalesce("v", F.lit(0)), "n": F.lit(1)}).collect()}
    for g in {r[0] for r in rows}:
        total = n = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -r[2])):
            total, n = total + (r[3] or 0), n + 1
            assert got[r[2]] == (total, n)
    whole = {r.k: r.n for r in relational.running_sums(df, [], [F.col("k")], {"n": F.lit(1)}).collect()}
    assert whole == {k: k + 1 for k in range(500)}


def loop(value):
    """The comparison form of a text, character by character: text, begins, ends."""
    out, begins, ends = "", [], []
    for m in re.finditer(r"&#(?:x[0-9a-f]+|[0-9]+);|&[a-z]+;|[\s\S]", value, re.I):
        raw = shown = m[0]
        if len(raw) > 1 and raw[1] == "#":
            code = int(raw[3:-1], 16) if raw[2] in "xX" else int(raw[2:-1])
            if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
                shown = chr(code)
        elif len(raw) > 1:
            shown = lists.ENTITIES.get(raw[1:-1], raw)
        for c in shown.translate(str.maketrans("‘’“”", "''\"\"")):
            c = " " if c.isspace() else c
            if c == " " and out.endswith(" "):
                ends[-1] = m.end()
                continue
            out, begins, ends = out + c, [*begins, m.start()], [*ends, m.end()]
    return out, begins, ends


def test_quotations():
    rng = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "&amp;", "&nbsp;", "&#65;", "&#x41;", "&#0;", "&foo;", "&", ";", "“", "’", "'", '"', "&ldquo;", "&#55300;", "&#99999999999999;", "👍", " "]
    hits = 0
    for _ in range(3000):
        source, quote = "".join(rng.choices(parts, k=rng.randint(0, 14))), "".join(rng.choices(parts, k=rng.randint(0, 4)))
        t, begins, ends = loop(source)
        c = text.compared_text(source)
        assert (c[0], c[1].tolist(), c[2].tolist()) == (t, begins, ends)
        q, want = quote.strip(), None
        if q and q in source:
            want = q
        elif q and source:
            flat = loop(q)[0].strip()
            at = t.find(flat) if flat else -1
            if at >= 0:
                found = source[begins[at] : ends[at + len(flat) - 1]]
                want = found if loop(found)[0].strip() == flat else None
        assert text.find_quotation(source, quote) == want
        hits += want is not None
    assert hits > 300
    assert text.find_quotation(None, "x") is None and text.find_quotation("x", None) is None


def test_publish(spark, tmp_path):
    """In place, only days that change are written; anew, all days of the range are."""
    import datetime
    import os

    from storytide.operators import themes
    from storytide.sources.sinks import DayTable

    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    t = DayTable(spark, f"file://{tmp_path}/t", "theme_id string, intensity double, date date", "date")
    rows = lambda days, v=1.0: [(x, v, day(k)) for x in "ab" for k in days]
    frame = lambda own: spark.createDataFrame(own, t.schema)
    names = lambda: {k: sorted(os.listdir(f"{tmp_path}/t/date={k}")) for k in t.days()}
    keys = ["theme_id", "date"]
    t.insert_ignore(frame(rows(range(10))), keys)
    before = names()
    fresh = [r for r in rows(range(3, 10)) if r != ("b", 1.0, day(5))] + []
    fresh = [(x, 9.0, d) if d == day(7) else (x, v, d) for x, v, d in fresh]
    got = themes.publish(t, frame(fresh), keys, str(day(3)), str(day(9)), str(day(2)), rebuild_at=1)
    assert got == {"how": "in_place", "changed": 2, "removed": 1, "pruned": 4}
    after = names()
    assert set(after) == {str(day(k)) for k in range(2, 10)}
    assert {k for k in after if after[k] != before[k]} == {str(day(5)), str(day(7))}
    got = themes.publish(t, frame([*fresh, ("a", 1.0, day(10))]), keys, str(day(3)), str(day(10)), str(day(2)), rebuild_at=10)
    assert got == {"how": "rebuild", "changed": len(fresh) + 1, "removed": 0, "pruned": 0}
    assert sorted(map(tuple, t.read().where("date > date'2024-01-03'").collect())) == sorted([*fresh, ("a", 1.0, day(10))])


def test_terms_are_listed_by_many_tasks(spark, monkeypatch):
    """F8: documents of one partition are dealt out before their terms are listed."""
    import datetime

    from pyspark.sql import functions as F

    from storytide.operators import bursts

    monkeypatch.setattr(bursts, "DOCUMENTS_A_TASK", 50)
    rows = [(k, datetime.date(2024, 1, 1), "s", "o", f"copper demand rises {k % 7}x", ["Copper"], ["Copper demand"]) for k in range(1000)]
    docs = spark.createDataFrame(rows, "document_id long, date date, story_fingerprint string, publisher_owner string, title string, entities array<string>, theme_labels array<string>").coalesce(1)
    terms = bursts.burst_terms(docs)
    tasks = [r[0] for r in terms.select("document_id", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().select("count").collect()]
    assert len(tasks) >= 15 and sum(tasks) == 1000 and max(tasks) <= 150
    kinds = {r.term: (r.kind, r.n) for r in terms.groupBy("term").agg(F.max("kind").alias("kind"), F.count("*").alias("n")).collect()}
    assert kinds["copper demand"] == (2, 1000) and kinds["copper"] == (1, 1000) and kinds["demand rises"] == (0, 1000)


def test_contributions_of_a_lookback(spark):
    """F14, F16: only the rows of the asked days are written, with the levels that all days make."""
    from storytide.operators import themes

    day = lambda k: f"date_add(date'2024-01-01', {k})"
    signals = spark.range(0, 300, 1, 3).selectExpr("id AS signal_id", "id DIV 3 AS document_id", "concat('t', id % 5) AS theme_id", "CASE WHEN id > 20 AND id % 2 = 0 THEN concat('t', id % 5) END AS canonical_theme_id", "CASE WHEN id % 4 = 0 THEN concat('t', id % 7) END AS canonical_subtheme_id", f"{day('CAST(id % 50 AS INT)')} AS date", "'c' AS source_class", "array('e') AS entities", "1.0D AS score")
    listed = spark.createDataFrame([(f"t{k}",) for k in range(6)], "theme_id string")
    first, last = "2024-01-11", "2024-01-20"
    key = lambda df: sorted((r.theme_id, r.trend_level, r.signal_id, str(r.date)) for r in df.collect())
    want = [r for r in key(themes.contributions(signals, listed)) if first <= r[3] <= last]
    few = themes.contributions(signals, listed, (first, last))
    assert want and key(few) == want and len({r[1] for r in want}) > 1
    stored = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in few.inputFiles()})
    assert stored.count() == len(want)


def test_contributions_are_counted_by_many_tasks(spark, monkeypatch):
    """documents are counted where they were dealt to, in tasks of a bounded number of signals."""
    from storytide.queries import themes as q

    monkeypatch.setattr(q, "SIGNALS_A_TASK", 1000)
    df = q.union_all_contributions(spark, "/root/testdata/sf0.001")
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 1000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "document_id" in line]
    assert n > 1 and len(dealt) == 1 and f", {n}), REPARTITION_BY_NUM" in dealt[0]


def test_few_candidates_of_few_words(spark):
    """Sets of few words all meet on rare ones; pairs that share little else are no candidates, and none that do are lost."""
    rng = random.Random(4)
    sets = [(k, sorted(rng.sample([f"w{i}" for i in range(200)], 20))) for k in range(300)]
    sets += [(1000 + k, sorted({*w[k % 7 :], f"x{k}"})) for k, w in sets[:40]]
    sets += [(2000 + k, sorted({f"y{i}" for i in range(700)} - {f"y{i * (k + 2)}" for i in range(200)})) for k in range(4)]  # more words than bits
    df = spark.createDataFrame(sets, "id long, w array<string>")
    want = {(a, b) for a, u in sets for b, v in sets if a < b and len({*u} & {*v}) >= 0.5 * len({*u} | {*v})}
    assert len(want) > 40
    assert {(r.a, r.b) for r in setjoin.jaccard_pairs(df, df, 0.5, one_way=True).collect()} == want
    assert setjoin.jaccard_candidates(df, df, 0.5, one_way=True).count() <= 2 * len(want)
    most = {(a, b) for a, u in sets for b, v in sets if len({*u} & {*v}) >= max(3, 0.5 * min(len(u), len(v)))}
    assert {(r.a, r.b) for r in setjoin.overlap_pairs(df, df, 0.5).collect()} == most
    assert setjoin.overlap_candidates(df, df, 0.5, 3).count() <= 2 * len(most)
