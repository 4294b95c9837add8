"""Queries of scored names and of indexes in versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar
from ..session import scratch, table
from ..sources import snapshots
from .registry import query


@query("""WITH n AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS k FROM part),
    q AS (SELECT DISTINCT array_to_string(list_reverse(string_split(substr(k, 2), ' ')), ' ') AS t FROM n),
    x AS (SELECT k AS s, string_split(k, ' ') AS w FROM n UNION SELECT t, string_split(t, ' ') FROM q),
    f AS (SELECT s, unnest(list_distinct(list_concat(list_transform(w, lambda c: 'w:' || c), flatten(list_transform(w, lambda c: list_transform(range(1, length(c) + 1), lambda i: substr('^' || c || '$', i, 3))))))) AS x FROM x),
    d AS (SELECT x, count(*) AS df FROM f JOIN n ON n.k = f.s GROUP BY x),
    g AS (SELECT f.s, f.x, floor(100 * ln((SELECT count(*) FROM n)::DOUBLE / coalesce(df, 1)))::BIGINT + 1 AS w FROM f LEFT JOIN d USING (x)),
    o AS (SELECT s, sum(w)::BIGINT AS w FROM g GROUP BY s),
    c AS (SELECT q.t, n.k, sum(a.w)::BIGINT AS c FROM q JOIN g a ON a.s = q.t JOIN g b ON b.x = a.x JOIN n ON n.k = b.s GROUP BY 1, 2),
    p AS (SELECT t, k, 200 * c AS c, a.w + b.w AS w FROM c JOIN o a ON a.s = t JOIN o b ON b.s = k WHERE 200 * c >= 75 * (a.w + b.w))
    SELECT t, k, floor(c / w)::INT AS score, (row_number() OVER (PARTITION BY t ORDER BY (c / 200) / w DESC, k))::INT AS place FROM p QUALIFY place <= 3""")
def scored_names(spark, d):
    """Names with their words the other way round and a letter short, and the names of the list that score best."""
    names = table(spark, d, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("k")).distinct()
    texts = names.select(F.array_join(F.reverse(F.split(F.substring("k", 2, 1000), " ")), " ").alias("t"))
    return similar.scored_names(texts, names, 75)


@query("""SELECT p_partkey AS partkey, p_name AS name, 1 AS version, 'pinned' AS seen FROM part WHERE p_size < 25 UNION ALL SELECT p_partkey, upper(p_name), 2, 'newest' FROM part
          UNION ALL SELECT p_partkey, p_name, 1, 'by number' FROM part WHERE p_size < 25""")
def pinned_index(spark, d):
    """A reader that was there before a replacement sees the old version whole, one that comes after it the new one; what was staged and never committed is seen by none."""
    rows, path = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), scratch(spark, "index")
    schema = "partkey long, name string, size int"
    assert snapshots.read(spark, path, schema).isEmpty()
    snapshots.write(rows.where("size < 25"), path)
    pinned = snapshots.read(spark, path, schema)
    snapshots.stage(rows.limit(0), path)
    snapshots.write(rows.withColumn("name", F.upper("name")), path, ("size",))
    told = lambda df, version, seen: df.select("partkey", "name", F.lit(version).alias("version"), F.lit(seen).alias("seen"))
    return told(pinned, 1, "pinned").unionByName(told(snapshots.read(spark, path, schema), 2, "newest")).unionByName(told(snapshots.read(spark, path, schema, 1), 1, "by number"))
