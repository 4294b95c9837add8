"""Scans, lookups and builds that are stopped, repeated and late."""

import json

import pytest
from pyspark.sql import functions as F

from linkspan.sources import scans
from linkspan.streaming import facts, lookups


def stage(spark, path, answers):
    scans.staged(spark.createDataFrame([(t, n, v if isinstance(v, str) else json.dumps(v)) for t, n, v in answers], "token string, attempt int, value string"), path)


def page(ids, following=None, total=7):
    return {"studies": [{"id": i} for i in ids], "totalCount": total, "nextPageToken": following}


def scan(spark, tmp_path, name, **options):
    return scans.scanned(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-seen"), **options)


def told(rows):
    r = scans.retrieval(rows).first()
    return r["retrieved"], r["total"], r["pages"], r["attempts"], r["ended"], r["status"]


def test_scan_of_pages(spark, tmp_path):
    """A page fails twice and comes; a study on two pages counts once; the last page ends the scan."""
    stage(spark, str(tmp_path / "a"), [("first", 0, page([1, 2, 3], "b c")), ("b c", 0, {"code": 503}), ("b c", 1, "{not json"), ("b c", 2, page([3, 4, 5], "z")), ("z", 0, page([6, 7]))])
    rows = scan(spark, tmp_path, "a", pages_per_batch=1)
    assert told(rows) == (7, 7, 3, 5, "LAST", "OK")
    assert [tuple(r) for r in rows.where("pos is null").select("page", "token", "attempts", "status").orderBy("page").collect()] == [(0, "first", 1, "OK"), (1, "b c", 3, "OK"), (2, "z", 1, "LAST")]
    assert rows.where("pos is not null").count() == 8
    assert scan(spark, tmp_path, "a").count() == rows.count()  # nothing more comes when it is called again


def test_scans_that_end_early(spark, tmp_path):
    loop = [("first", 0, page([1, 2], "t1")), ("t1", 0, page([3, 4], "t2")), ("t2", 0, page([5], "t1"))]
    stage(spark, str(tmp_path / "loop"), loop)
    assert told(scan(spark, tmp_path, "loop", pages_per_batch=2)) == (5, 7, 3, 3, "TOKEN_REPEATED", "INCOMPLETE_RETRIEVAL")
    stage(spark, str(tmp_path / "cap"), loop)
    assert told(scan(spark, tmp_path, "cap", max_pages=2)) == (4, 7, 2, 2, "PAGE_CAP", "INCOMPLETE_RETRIEVAL")
    stage(spark, str(tmp_path / "bad"), [("first", 0, page([1], "t1"))] + [("t1", n, {"code": 500}) for n in range(9)])
    assert told(scan(spark, tmp_path, "bad")) == (1, 7, 2, 4, "RETRIEVAL_ERROR", "RETRIEVAL_ERROR")
    stage(spark, str(tmp_path / "none"), [("first", 0, page([], None, 0))])
    assert told(scan(spark, tmp_path, "none")) == (0, 0, 1, 1, "LAST", "NO_TRIALS")
    stage(spark, str(tmp_path / "blind"), [("first", 0, page([1], None, None))])
    assert told(scan(spark, tmp_path, "blind")) == (1, None, 1, 1, "LAST", "INCOMPLETE_RETRIEVAL")


def test_scan_goes_on_where_it_stopped(spark, tmp_path):
    """The last page is missing at first; once it is staged, a scan with a budget left reads only what it has not read."""
    stage(spark, str(tmp_path / "r"), [(f"t{i}" if i else "first", 0, page([i], f"t{i + 1}", 6)) for i in range(5)])
    reader = scans._Scan(str(tmp_path / "r"), str(tmp_path / "r-state"), 2, 3, 100)
    one = reader.latestOffset()
    assert one == reader.latestOffset() and one["page"] == 2 and one["token"] == "t2"
    assert [p.value[1] for p in reader.partitions(reader.initialOffset(), one)] == ["first", "t1"]
    again = scans._Scan(str(tmp_path / "r"), str(tmp_path / "r-state"), 2, 3, 100)
    two = again.latestOffset()
    assert two["page"] == 4 and [p.value[:3] for p in again.partitions(one, two)] == [(2, "t2", 1), (3, "t3", 1)]
    assert [p.value[:3] for p in again.partitions(one, two)] == [(2, "t2", 1), (3, "t3", 1)]  # a batch that is made again has the same pages
    end = again.latestOffset()
    assert end["ended"] == "RETRIEVAL_ERROR" and end["page"] == 6


def test_scan_of_very_many_pages(tmp_path, monkeypatch):
    """A scan of more than ten thousand pages is followed to its end, also across a restart; offsets do not grow with it, and a token from the first batch is still known."""
    n = 12_000
    monkeypatch.setattr(scans, "_answer", lambda folder, token, attempt: {"nextPageToken": f"t{k + 1}" if (k := int(token.removeprefix("t").replace("first", "0"))) + 1 < n else "t1"})
    make = lambda: scans.PagedScan({"path": str(tmp_path / "many"), "state": str(tmp_path / "many-state"), "pages_per_batch": "5000"}).streamReader(None)
    at, told, sizes = make().initialOffset(), [], []
    for _ in range(3):
        reader = make()
        end = reader.latestOffset()
        told += [p.value for p in reader.partitions(at, end)]
        sizes.append(len(json.dumps(end)))
        at = end
    assert [t[0] for t in told] == list(range(n)) and at["ended"] == told[-1][4] == "TOKEN_REPEATED" and {t[4] for t in told[:-1]} == {""}
    assert max(sizes) < 100 and make().latestOffset() == at


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_lookups(spark, tmp_path, rocks):
    """404 is an answer, other failures are tried again within the budget, silence is given up by a timer, and what comes after that changes nothing. Batches may lie anywhere."""
    answers = [("found", 0, 503, None), ("found", 900, 200, "x"), ("none", 0, 404, None), ("none", 500, 200, "too late"), ("busy", 0, 429, None), ("busy", 900, 503, None), ("busy", 2000, 500, None), ("busy", 2500, 200, "over budget"),
               ("silent", 0, 0, None), ("once", 100, 502, None), ("mute", 0, None, None), ("mute", 100, None, None), ("mute", 200, None, None), ("slow", 0, 500, None), ("slow", 60_000, 200, "after the wait")]
    want = {"found": ("OK", 2, "x"), "none": ("NOT_FOUND", 1, None), "busy": ("HTTP_500", 3, None), "silent": ("ERROR", 0, None), "once": ("HTTP_502", 1, None), "mute": ("ERROR", 3, None), "slow": ("HTTP_500", 1, None)}
    for files in (1, 4):
        path = tmp_path / f"answers{files}"
        df = spark.createDataFrame(answers, "key string, ms long, code int, value string").select("key", F.timestamp_millis(F.col("ms") + 10**6).alias("at"), "code", "value")
        df = df.orderBy("at")
        for i in range(files):  # in order of time, a few at once
            df.where((F.unix_millis("at") - 10**6 >= (0, 100, 901, 2001)[i]) & (F.unix_millis("at") - 10**6 < ((100, 901, 2001, 10**6)[i] if files > 1 else 10**6))).coalesce(1).write.mode("append").parquet(str(path))
        spark.createDataFrame([("clock", 10**9, 0, None)], "key string, ms long, code int, value string").select("key", F.timestamp_millis(F.col("ms") + 10**6).alias("at"), "code", "value").coalesce(1).write.mode("append").parquet(str(path))
        stream = lookups.settled(facts.page_stream(spark, str(path), "key string, at timestamp, code int, value string", files_per_trigger=1))
        out = facts.all_available(stream, str(tmp_path / f"out{files}"), str(tmp_path / f"seen{files}")).collect()
        assert {r["key"]: (r["status"], r["attempts"], r["value"]) for r in out if r["key"] != "clock"} == want and len(out) in (len(want), len(want) + 1)


def test_build_that_stops_inside_a_batch(spark, tmp_path):
    """Rows are written and the run stops before the keys are; the batch is made again and its rows are there once. Only the buckets of a batch's keys are read."""
    src, sink, seen = (str(tmp_path / x) for x in ("src", "sink", "seen"))
    spark.range(100).select("id").coalesce(1).write.parquet(src)
    work = lambda b: b.select("id", (F.col("id") * 2).alias("twice"))
    build = lambda run: facts.resumable_build(facts.page_stream(spark, src, "id long", files_per_trigger=1), "id", sink, seen, run).awaitTermination(120)
    build(work)
    spark.range(50, 180).select("id").coalesce(1).write.mode("append").parquet(src)
    replaced, n = facts._replaced, []

    def fails(df, path, number, *by):
        n.append(path)
        if by:
            raise RuntimeError("stopped")
        replaced(df, path, number, *by)

    facts._replaced = fails
    try:
        with pytest.raises(Exception, match="stopped"):
            build(work)
    finally:
        facts._replaced = replaced
    assert spark.read.parquet(sink).count() == 180 and len(n) == 2  # rows without keys
    build(work)
    rows = spark.read.parquet(sink)
    assert sorted(r["id"] for r in rows.collect()) == list(range(180)) and rows.where("twice <> id * 2").isEmpty()
    spark.createDataFrame([(3,), (177,), (500,)], "id long").coalesce(1).write.mode("append").parquet(src)
    build(work)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [*range(180), 500]
    plan = facts.ledger_rows(spark, f"{sink}-keys", "`id` long", [3, 5], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]


def test_late_rows_are_kept_apart(spark, tmp_path):
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    for minutes in ([0, 10], [200, 100], [199, 139, 140, None]):
        spark.createDataFrame([(m,) for m in minutes], "m int").select("m", F.timestamp_seconds(F.col("m") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(src)
    facts.late_apart(facts.page_stream(spark, src, "m int, ts timestamp", files_per_trigger=1), "ts", "1 hour", sink, str(tmp_path / "seen")).awaitTermination(120)
    read = lambda where: sorted((r["m"] is None, r["m"] or 0) for r in spark.read.schema("m int, _batch long").parquet(f"{sink}/{where}").collect())
    assert read("late") == [(False, 139)] and read("in_time") == [(False, m) for m in (0, 10, 100, 140, 199, 200)] + [(True, 0)]
