"""Day tables, documents as they arrive, series that follow their evidence, archives that are read on."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from storytide.sources import archive
from storytide.sources.sinks import DayTable, Table
from storytide.streaming import ingestion, streams, windows

DAY = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)


def files(path, day):
    at = os.path.join(path, f"day={day}")
    return sorted(f for f in os.listdir(at) if f.endswith(".parquet")) if os.path.isdir(at) else []


def test_day_table(spark, tmp_path):
    t = DayTable(spark, f"file://{tmp_path}/t", "k int, v string, day date", "day")
    frame = lambda *rows: spark.createDataFrame(list(rows), t.schema)
    rows = lambda: sorted((r.k, r.v, (r.day - DAY(0)).days) for r in t.read().collect())
    assert t.read().count() == 0 and t.days() == []
    assert t.insert_ignore(frame((1, "a", DAY(0)), (2, "b", DAY(1)), (3, None, DAY(2)), (3, None, DAY(2))), ["k"]).count() == 3
    kept = {d: files(f"{tmp_path}/t", DAY(d)) for d in range(3)}
    same = lambda *days: all(files(f"{tmp_path}/t", DAY(d)) == kept[d] for d in days)
    assert t.insert_ignore(frame((1, "z", DAY(5))), ["k"]).count() == 0 and same(0, 1, 2)
    assert t.upsert(frame((1, "a", DAY(0)), (2, "c", DAY(1)), (9, "n", DAY(1))), ["k", "day"]) == 2
    assert rows() == [(1, "a", 0), (2, "c", 1), (3, None, 2), (9, "n", 1)]
    assert same(0, 2) and files(f"{tmp_path}/t", DAY(1)) != kept[1]
    assert t.upsert(frame((1, "a", DAY(0)), (3, None, DAY(2))), ["k", "day"]) == 0 and same(0, 2)
    t.replace_days(frame((7, "x", DAY(2)), (8, "not of these days", DAY(0))), [str(DAY(1)), str(DAY(2))])
    assert rows() == [(1, "a", 0), (7, "x", 2)] and same(0) and t.days() == [str(DAY(0)), str(DAY(2))]
    kept[2] = files(f"{tmp_path}/t", DAY(2))
    t.insert_ignore(frame((4, "d", DAY(0)), (5, "e", DAY(3))), ["k"])
    kept[3] = files(f"{tmp_path}/t", DAY(3))
    assert t.delete_obsolete(frame((4, None, DAY(0)), (7, None, DAY(2))), ["k"], str(DAY(0)), str(DAY(2))) == 1
    assert rows() == [(4, "d", 0), (5, "e", 3), (7, "x", 2)] and same(2, 3)
    assert t.prune(str(DAY(2))) == 1 and t.days() == [str(DAY(2)), str(DAY(3))] and same(2, 3)
    with pytest.raises(ValueError, match="day"):
        t.upsert(frame(), ["k"])


def test_pointers_are_never_empty(spark, tmp_path):
    """Each version has a pointer of its own; a second writer of the same number is an error and changes nothing."""
    t = Table(spark, f"file://{tmp_path}/t", "k int")
    t.replace(spark.createDataFrame([(1,)], t.schema))
    t.replace(spark.createDataFrame([(2,)], t.schema))
    assert sorted(f for f in os.listdir(tmp_path / "t") if f.startswith("CURRENT")) == ["CURRENT-000000000000", "CURRENT-000000000001"]
    other = Table(spark, f"file://{tmp_path}/t", "k int")
    other._pointers = lambda: ["CURRENT-000000000000"]
    with pytest.raises(RuntimeError, match="another writer"):
        other.replace(spark.createDataFrame([(3,)], t.schema))
    assert [r.k for r in t.read().collect()] == [2]


def arrival(i, day, content, text):
    return (i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), content, str(hash(text) % 10**9).zfill(12), text)


def run_batches(spark, tmp_path, batches, **how):
    path = f"file://{tmp_path}/in"
    rows = [(*r, k) for k, b in enumerate(batches) for r in b]
    df = spark.createDataFrame(rows, ingestion.ARRIVAL + ", part int")
    ingestion.written_in_order(df, path, "part", len(batches))
    return streams.drain(ingestion.ingested(ingestion.arrivals_stream(spark, path), **how), "t-ingested")


def test_previews_are_upgraded(spark, tmp_path):
    a, b, c = "preview of one", "one in full", "two in full"
    batches = [
        [arrival("1", 0, "preview", a), arrival("2", 0, "full", c), arrival("3", 0, "preview", "three")],
        [arrival("1", 1, "full", b), arrival("4", 1, "full", c), arrival("2", 1, "preview", "two in short")],
        [arrival("1", 2, "full", b), arrival("1", 2, "preview", a), arrival("1", 2, "full", "one corrected"), arrival("3", 2, "preview", "three")],
    ]
    out = run_batches(spark, tmp_path, batches)
    got = sorted((r.stored_id.split(":")[0], r.action, r.text) for r in out.collect())
    assert got == sorted([("1", "insert", a), ("2", "insert", c), ("3", "insert", "three"), ("1", "upgrade", b), ("2", "revision", "two in short"), ("1", "revision", "one corrected")])
    kept = {r.stored_id: r.text for r in ingestion.store(out).collect()}
    assert len(kept) == 5 and kept["1"] == b and kept["2"] == c and kept["3"] == "three"


def test_parts_are_batches_of_many_files(spark, tmp_path):
    """no task writes a part alone, parts of any size come one a batch, and one without rows is a batch too."""
    path = f"file://{tmp_path}/parts"
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "CASE WHEN id < 10 THEN 0 WHEN id < 3000 THEN 2 ELSE 3 END AS part")
    ingestion.written_in_order(df, path, "part", 4)
    assert len(spark.read.parquet(f"{path}/2").inputFiles()) == 8
    seen = []
    q = ingestion.arrivals_stream(spark, path).writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.id for r in b.collect()))).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [list(range(10)), [], list(range(10, 3000)), list(range(3000, 4000))]
    written = spark.read.parquet(f"{path}/2").groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0]
    assert written <= 500


def test_old_texts_are_forgotten(spark, tmp_path):
    """A text that comes again after `keep_days` is new, as its state is gone; within them it is not."""
    batches = [[arrival("1", 0, "full", "x")], [arrival("2", 4, "full", "y")], [arrival("3", 5, "full", "x")], [arrival("4", 20, "full", "z")], [arrival("5", 21, "full", "z2")], [arrival("6", 22, "full", "x")]]
    got = sorted(r.document_id for r in run_batches(spark, tmp_path, batches, keep_days=10).collect())
    assert got == ["1", "2", "4", "5", "6"]


def test_late_evidence(spark, tmp_path):
    """Batches in any order, some twice, some after a failure between the two tables: the full series."""
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice("pqr"), f"s{rng.randrange(9)}", DAY(rng.randrange(20))) for k in range(200)]
    schema = "id bigint, topic string, publisher string, story string, date date"
    last = DAY(19)
    view = windows.WindowView(spark, f"file://{tmp_path}/v", schema, "id", ["topic"], {"publishers": "publisher", "stories": "story"}, 5, str(last))
    cut = [rows[:60], rows[60:120], rows[120:]]
    for k in (2, 0, 2, 1, 0):
        view.absorb(spark.createDataFrame(cut[k], schema))
    want = {}
    for _, topic, p, s, d in rows:
        for i in range(5):
            e = d + datetime.timedelta(days=i)
            if e <= last:
                x = want.setdefault((topic, e), (set(), set(), []))
                x[0].add(p), x[1].add(s), x[2].append(1)
    result = lambda: {(r.topic, r.date): (r.publishers, r.stories, r.rows) for r in view.series.read().collect()}
    assert result() == {k: tuple(map(len, v)) for k, v in want.items()}
    kept = {d: sorted(os.listdir(f"{tmp_path}/v/series/date={d}")) for d in view.series.days()}
    late = (999, "a", "new", "s1", DAY(3))
    view.evidence.insert_ignore(spark.createDataFrame([late], schema), ["id"])  # fails before the series is written
    view.absorb(spark.createDataFrame([late], schema))
    after = result()
    assert [after["a", DAY(d)][2] - len(want["a", DAY(d)][2]) for d in range(20) if ("a", DAY(d)) in want] == [int(3 <= d <= 7) for d in range(20) if ("a", DAY(d)) in want]
    changed = [d for d in kept if sorted(os.listdir(f"{tmp_path}/v/series/date={d}")) != kept[d]]
    assert changed == [str(DAY(d)) for d in range(3, 8)]


def write_archive(path, posts):
    for name, own in posts.items():
        os.makedirs(f"{path}/publication={name}", exist_ok=True)
        own = sorted(own, key=lambda p: (p["post_date"], p["slug"]), reverse=True)
        with open(f"{path}/publication={name}/a.json", "w") as f:
            f.write("\n".join(map(json.dumps, own)))


def post(k, day):
    return {"slug": f"p{k}", "post_date": f"{DAY(day)}T00:00:00Z", "title": f"T{k}", "audience": "everyone"}


def test_archive_is_read_on(spark, tmp_path):
    """Polls with a cap of each publication, a poll that is killed, posts that come meanwhile, a later poll."""
    posts = {"one": [post(k, k) for k in range(50)], "two": [post(k, 2) for k in range(5)], "none": []}
    write_archive(f"{tmp_path}/a", posts)
    stream = lambda: archive.archive_stream(spark, f"file://{tmp_path}/a", "2024-01-06T00:00:00Z", 15)
    out, ck, seen = f"{tmp_path}/out", f"file://{tmp_path}/ck", []

    def write(df, k):
        df.write.mode("overwrite").parquet(f"file://{out}/batch={k}")
        seen.append((k, df.count()))
        if k == 1 and len(seen) == 2:
            raise RuntimeError("killed after the rows were written")

    def poll():
        q = stream().writeStream.foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:
            assert "killed" in str(e)

    got = lambda: sorted((r.publication, r.slug) for r in spark.read.parquet(f"file://{out}").collect())
    poll()
    assert got() == sorted(("one", f"p{k}") for k in range(35, 50))
    posts["one"].append(post(99, 60))  # shifts all pages
    posts["two"] += [post(77, 30)]
    write_archive(f"{tmp_path}/a", posts)
    poll()  # killed
    for _ in range(6):
        poll()
    assert got() == sorted([*(("one", f"p{k}") for k in [*range(6, 50), 99]), ("two", "p77")])
    assert max(n for _, n in seen) <= 16
    posts["two"].append(post(78, 31))
    write_archive(f"{tmp_path}/a", posts)
    poll()
    assert ("two", "p78") in got() and len(got()) == 47


def test_archive_pages_go_on_from_their_place(tmp_path):
    """A page that is far down an archive is read from its place, not from the archive's begin."""
    write_archive(f"{tmp_path}/a", {"one": [post(k, k % 300) for k in range(20_000)]})
    pages, read = archive.FolderPages(f"file://{tmp_path}/a"), []
    first = [x for page in pages.walk("one", 0) for x in page]
    assert len(first) == 20_000 and [len(p) for p in pages.walk("one", 0)][:-1] == [archive.PAGE] * 1666

    class Counted:
        def __init__(self, f):
            self.f = f

        def __getattr__(self, name):
            return getattr(self.f, name)

        def readable(self):
            return True

        def readinto(self, b):
            n = self.f.readinto(b)
            read.append(n)
            return n

    class Files:
        def __init__(self, fs):
            self.fs = fs

        def get_file_info(self, at):
            return self.fs.get_file_info(at)

        def open_input_file(self, path):
            return Counted(self.fs.open_input_file(path))

    own, root = pages._fs()
    pages._fs = lambda: (Files(own), root)
    for k in (0, 1, 9_999, 19_999):
        read.clear()
        assert next(pages.walk("one", first[k][1]))[0] == first[k]
        assert sum(read) <= 1 << 17
    more = next(pages.walk("one", first[5][1] + 3))  # posts in front have moved the lines
    assert more[0] == first[6]


def test_polls_are_drained_and_taken_up_again(spark, tmp_path):
    posts = {"one": [post(k, k) for k in range(50)], "two": [post(k, 2) for k in range(5)]}
    write_archive(f"{tmp_path}/a", posts)
    stream = lambda: archive.archive_stream(spark, f"file://{tmp_path}/a", "2024-01-02T12:00:00Z", 15)
    drain = lambda: archive.drain_polls(spark, stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    got = lambda: sorted((r.publication, r.slug) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert drain() == 4
    want = [*(("one", f"p{k}") for k in range(2, 50)), *(("two", f"p{k}") for k in range(5))]
    assert got() == sorted(want)
    drain()
    assert got() == sorted(want)
    posts["one"].append(post(99, 60))
    write_archive(f"{tmp_path}/a", posts)
    assert drain() == 5
    assert got() == sorted([*want, ("one", "p99")])
