"""Queries of feeds that repeat themselves, come late, fail and name their pages by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch, table
from ..sources import scans
from ..streaming import facts, lookups
from .registry import query

# ---- late and repeated rows ---------------------------------------------------------------------------------------------
#: How far behind the latest row another may be.
_LATE = "20 days"
_EVENT = "event_id long, user_id long, ts timestamp, event_type string"


def _feed(spark: SparkSession, d: str) -> str:
    """Events staged in the order of a slow feed: the older half, the newer half, then every third row of the older half again and every fifth one only now."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    mid = e.agg(F.expr("timestamp_seconds((unix_seconds(min(ts)) + unix_seconds(max(ts))) div 2)").alias("mid"))
    e = e.join(F.broadcast(mid))  # one row
    old, held, path = F.col("ts") < F.col("mid"), F.col("event_id") % 5 == 0, scratch(spark, "feed")
    for part in (e.where(old & ~held), e.where(~old), e.where(old & (held | (F.col("event_id") % 3 == 0)))):
        part.drop("mid").coalesce(1).write.mode("append").parquet(path)  # a file a page, in order
    return path


_FEED = """WITH m AS (SELECT make_timestamp(((epoch_us(min(ts)) // 1000000 + epoch_us(max(ts)) // 1000000) // 2) * 1000000) AS mid, max(ts) AS top FROM events),
    f AS (SELECT event_id, user_id, ts, event_type, ts < mid AS old, event_id % 5 = 0 AS held, ts < top - INTERVAL 20 DAY AS behind FROM events, m)"""


def _apart(spark: SparkSession, d: str) -> str:
    sink = scratch(spark, "late")
    facts.late_apart(facts.page_stream(spark, _feed(spark, d), _EVENT, files_per_trigger=1), "ts", _LATE, sink, scratch(spark, "seen")).awaitTermination()
    return sink


@query(_FEED + """ SELECT event_type, CASE WHEN behind THEN 'late' ELSE 'in time' END AS came, count(*) AS n FROM f WHERE old AND (held OR event_id % 3 = 0) GROUP BY 1, 2""")
def late_rows(spark, d):
    """Rows of the last page of a feed, in time or late; none is lost."""
    sink = _apart(spark, d)
    parts = spark.read.schema(_EVENT + ", _batch long")
    rows = parts.parquet(f"{sink}/in_time").withColumn("came", F.lit("in time")).unionByName(parts.parquet(f"{sink}/late").withColumn("came", F.lit("late")))
    return rows.where("_batch = 2").groupBy("event_type", "came").agg(F.count("*").alias("n"))


@query(_FEED + """ SELECT event_id, user_id, event_type FROM f WHERE NOT (old AND held AND behind)""")
def stream_once_bounded(spark, d):
    """Each event once, from a feed with repeated and late rows, with ids kept for 20 days only; what is late was told apart before."""
    pages = facts.page_stream(spark, f"{_apart(spark, d)}/in_time", _EVENT + ", _batch long", files_per_trigger=1)
    once = facts.each_once(pages, "event_id", "ts", _LATE)
    return facts.all_available(once, scratch(spark, "once"), scratch(spark, "seen")).select("event_id", "user_id", "event_type")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM s)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n FROM g GROUP BY user_id, nth HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events)""")
def stream_sessions(spark, d):
    """Runs of a user's events without a gap of twelve hours; those that can no longer grow."""
    e, path = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), scratch(spark, "pages")
    e.repartition(3, "user_id").write.parquet(path)
    stream = facts.sessions(facts.page_stream(spark, path, "user_id long, ts timestamp"), "ts", "user_id", "12 hours", late="0 seconds")
    out = facts.all_available(stream, scratch(spark, "sessions"), scratch(spark, "seen"))
    plain = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select("user_id", plain("session.start").alias("began"), plain("session.end").alias("ended"), "n")


# ---- pages that are named by tokens -------------------------------------------------------------------------------------
_PAGE = 250


@query(f"""WITH p AS (SELECT (o_orderkey // {_PAGE})::INT AS page, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT max(page) AS last FROM p), g AS (SELECT unnest(range(0, last + 1))::INT AS page, last FROM l)
    SELECT g.page, coalesce(n, 0) AS n, CASE WHEN g.page % 7 = 3 THEN 3 ELSE 1 END AS attempts, CASE WHEN g.page = last THEN 'TOKEN_REPEATED' ELSE 'OK' END AS status, (SELECT count(*) FROM orders) AS total, 'INCOMPLETE_RETRIEVAL' AS scan FROM g LEFT JOIN p USING (page)""")
def scanned_pages(spark, d):
    """A scan that follows page tokens; every seventh page fails twice before it comes, and the last one names the first page again."""
    o = table(spark, d, "orders").select((F.floor(F.col("o_orderkey") / _PAGE)).cast("int").alias("page"), "o_orderkey")
    size = o.agg(F.max("page").alias("last"), F.count("*").alias("total"))
    every = size.select("last", "total", F.explode(F.sequence(F.lit(0), "last")).alias("page"))
    pages = every.join(o.groupBy("page").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"))).alias("studies")), "page", "left")  # at most _PAGE studies
    name = lambda p: F.when(p == 0, scans.FIRST).otherwise(F.concat(F.lit("t"), p.cast("string")))
    following = F.when(F.col("page") < F.col("last"), name(F.col("page") + 1)).otherwise(scans.FIRST)
    body = F.to_json(F.struct(F.lit(200).alias("code"), "studies", F.col("total").alias("totalCount"), following.alias("nextPageToken")))
    fails, n = F.col("page") % 7 == 3, F.col("attempt")
    tries = pages.withColumn("attempt", F.explode(F.when(fails, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0)))))
    answer = F.when(fails & (n == 0), '{"code": 503}').when(fails & (n == 1), '{"cut of').otherwise(body)
    folder = scratch(spark, "answers")
    scans.staged(tries.select(name(F.col("page")).alias("token"), "attempt", answer.alias("value")), folder)
    rows = scans.scanned(spark, folder, scratch(spark, "scan"), scratch(spark, "seen"), pages_per_batch=256)
    each = rows.groupBy("page").agg(F.count("pos").alias("n"), F.max("attempts").alias("attempts"), F.max(F.when(F.col("pos").isNull(), F.col("status"))).alias("status"))
    return each.join(F.broadcast(scans.retrieval(rows).select("total", F.col("status").alias("scan"))))  # one row


@query("""WITH a AS (SELECT o_custkey AS key, o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN NULL WHEN 4 THEN 429 ELSE 500 END AS code, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
    s AS (SELECT key, min(nth) FILTER (code IN (200, 404)) AS answered, count(*) AS n FROM a GROUP BY 1),
    e AS (SELECT key, CASE WHEN answered <= 3 THEN answered ELSE least(n, 3) END AS attempts, coalesce(answered <= 3, false) AS told FROM s)
    SELECT e.key::VARCHAR AS key, CASE WHEN told THEN CASE code WHEN 200 THEN 'OK' ELSE 'NOT_FOUND' END WHEN code IS NULL THEN 'ERROR' ELSE 'HTTP_' || code END AS status, e.attempts::INT AS attempts, CASE WHEN told AND code = 200 THEN 'v' || o_orderkey END AS value
    FROM e JOIN a ON a.key = e.key AND a.nth = e.attempts""")
def retried_lookups(spark, d):
    """Customers looked up until they are answered, not found, or given up: after three attempts, or when no answer comes in time."""
    m = F.col("o_orderkey") % 10
    code = F.when(m == 0, 200).when(m == 1, 404).when(m == 2, 503).when(m == 4, 429).when(m != 3, 500)
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.timestamp_millis(nth.cast("long") * 900).alias("at"), code.alias("code"), F.concat(F.lit("v"), "o_orderkey").alias("value"))
    path = scratch(spark, "answers")
    rows.repartition(4, "key").write.parquet(path)
    # The clock goes on after the last answer, so that timers run out.
    clock = spark.range(1).select(F.lit("clock").alias("key"), F.expr("timestamp'2100-01-01'").alias("at"), F.lit(0).alias("code"), F.lit(None).cast("string").alias("value"))
    clock.write.mode("append").parquet(path)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = lookups.settled(facts.page_stream(spark, path, "key string, at timestamp, code int, value string", files_per_trigger=100))
        return facts.all_available(stream, scratch(spark, "settled"), scratch(spark, "seen"))
    finally:
        spark.conf.set(name, before)
