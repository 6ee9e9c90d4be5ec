"""Queries of the dedup, join, ledger, window and curation operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import text as tx
from ..operators import curation, dedup, ledger, sampling, windows
from ..session import table
from .registry import query, rounded


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
       first(text ORDER BY turn, role, text) FILTER (role = 'user') AS first_user
FROM conversations GROUP BY conv_id
""")
def turns_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation in order, and the first of the user."""
    t = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(t.alias("t"))
    first = F.get(F.filter("t", lambda x: x["role"] == "user"), F.lit(0))["text"]
    return g.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join("t.role", ",").alias("roles"), first.alias("first_user"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf, "documents"), F.sha2("text", 256), "doc_id")


@query(r"SELECT sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS digest, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1")
def near_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf, "documents"), F.sha2(tx.normalized(F.col("text")), 256), "doc_id")


@query("SELECT sha256(text) AS digest, CAST(length(text) AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def version_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.version_counts(table(spark, sf, "documents"), F.col("text"))


_SHINGLES = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, string_split(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' ') AS t FROM documents
           UNION ALL SELECT 'b', item_id, string_split(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' ') FROM benchmark),
s AS (SELECT side, id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS s FROM w WHERE len(t) >= 8),
hit AS (SELECT DISTINCT id FROM s WHERE side = 'd' AND s IN (SELECT s FROM s WHERE side = 'b'))
"""


@query(_SHINGLES + "SELECT id AS doc_id FROM hit")
def decontam_semi(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(_SHINGLES + "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT id FROM hit)")
def decontam_anti(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.join(dedup.contaminated(d, table(spark, sf, "benchmark")), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query(r"""
WITH d AS (SELECT d.*, l.doc_id IS NOT NULL AS labelled, lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS norm
           FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
r AS (SELECT labelled, 'exact' AS level, text AS s FROM d UNION ALL SELECT labelled, 'normalized', norm FROM d
      UNION ALL SELECT labelled, 'first_line', split_part(text, chr(10), 1) FROM d),
a AS (SELECT level, s, count(*) AS n, bool_or(s IN (SELECT s FROM r r2 WHERE NOT labelled AND r2.level = r.level)) AS hit FROM r WHERE labelled GROUP BY level, s)
SELECT level, CAST(count(*) AS BIGINT) AS signatures, CAST(count(*) FILTER (hit) AS BIGINT) AS shared,
       CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS matched_rows, round(coalesce(sum(n) FILTER (hit), 0) / sum(n)::DOUBLE, 6) AS matched_rate
FROM a GROUP BY level
""")
def overlap_rates(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id").distinct()
    levels = {"exact": F.col("text"), "normalized": tx.normalized(F.col("text")), "first_line": F.substring_index("text", "\n", 1)}
    return rounded(dedup.overlap_rates(d.join(l, "doc_id", "left_semi"), d.join(l, "doc_id", "left_anti"), levels))


@query(r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, list_distinct(string_split(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' ')) AS bag FROM documents WHERE trim(text) <> ''
           UNION ALL SELECT 'b', item_id, list_distinct(string_split(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' ')) FROM benchmark WHERE trim(text) <> ''),
i AS (SELECT side, id, len(bag) AS n, unnest(bag) AS item FROM w),
c AS (SELECT b.id AS item_id, d.id AS doc_id, count(*) / (b.n + d.n - count(*))::DOUBLE AS similarity
      FROM i b JOIN i d ON b.item = d.item AND b.side = 'b' AND d.side = 'd' GROUP BY b.id, d.id, b.n, d.n),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM c)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5
""")
def knn_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    bag = lambda t, i: table(spark, sf, t).select(i, F.array_distinct(tx.words(F.col("text"))).alias("bag"))
    return rounded(dedup.nearest_bags(bag("benchmark", "item_id"), bag("documents", "doc_id"), "item_id", "doc_id", "bag"))


@query("""
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.pending(table(spark, sf, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic IS DISTINCT FROM 0 THEN 'stale' WHEN NOT coalesce(l.quality = 1, false) THEN 'unscorable' ELSE 'kept' END AS status,
       CAST(count(*) AS BIGINT) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def fail_closed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """J2, J3; toxic stands for the ledger's version, quality for its verdict."""
    g = ledger.gated(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "toxic", 0, F.col("quality") == 1)
    return g.groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS pass, min(p_partkey) OVER (PARTITION BY p_brand) AS bo FROM part)
SELECT p_partkey, p_brand, p_size, CAST(row_number() OVER (ORDER BY pass, bo) AS INTEGER) AS place FROM r QUALIFY place <= 48
""")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return windows.round_robin(p, ["p_brand"], "p_size", "p_partkey", sampling.RELATION).select("p_partkey", "p_brand", "p_size", "place")


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS turn, count(*) OVER (PARTITION BY lang, source) AS size FROM documents)
SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY turn, size DESC, lang, source) AS INTEGER) AS shape_rank FROM b QUALIFY shape_rank <= 25
""")
def shape_cap(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return windows.shape_cap(d, ["lang"], ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")], 25).select("doc_id", "lang", "source", "shape_rank")


@query("""
WITH s AS (SELECT count(*) AS n FROM documents GROUP BY lang, source)
SELECT CAST(cap AS INTEGER) AS cap, CAST(sum(least(n, cap)) AS BIGINT) AS kept FROM s, (VALUES (1), (2), (4), (8), (16), (32), (64)) c(cap) GROUP BY cap
""")
def cap_curve(spark: SparkSession, sf: str) -> DataFrame:
    return windows.cap_curve(table(spark, sf, "documents"), ["lang", "source"], [1, 2, 4, 8, 16, 32, 64])


@query("""
WITH t AS (SELECT source AS cell, count(*) AS train_n FROM documents GROUP BY 1),
e AS (SELECT source AS cell, count(*) AS eval_n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1)
SELECT t.cell, train_n, coalesce(eval_n, 0) AS eval_n,
       round(least(4.0, greatest(0.25, (coalesce(eval_n, 0) / (SELECT sum(eval_n) FROM e)::DOUBLE) / (train_n / (SELECT sum(train_n) FROM t)::DOUBLE))), 6) AS weight
FROM t LEFT JOIN e USING (cell)
""")
def importance_weights(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    return rounded(curation.importance_weights(d, d.join(good, "doc_id", "left_semi"), "source"))


@query("""
WITH b AS (SELECT event_type, user_id % 4 AS bucket, value, event_id FROM events)
SELECT event_type, CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE CAST(bucket AS VARCHAR) END AS bucket, CAST(count(*) AS BIGINT) AS n,
       round(sum(value), 4) AS total, round(sum(CASE WHEN event_id % 3 = 0 THEN value END) / sum(value), 6) AS micro,
       CAST(count(*) FILTER (value > 50) AS BIGINT) AS large, round(avg(CASE WHEN value > 50 THEN value END), 6) AS large_mean
FROM b GROUP BY GROUPING SETS ((event_type, bucket), (event_type))
""")
def rollup_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Micro rate, conditional counts and means, per type by bucket and in all."""
    e, v = table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 4), F.col("value")
    out = ledger.with_totals(e, ["event_type"], "bucket", [
        F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), nm.ratio(F.sum(F.when(F.col("event_id") % 3 == 0, v)), F.sum(v)).alias("micro"),
        F.count_if(v > 50).alias("large"), F.avg(F.when(v > 50, v)).alias("large_mean"),
    ])
    return rounded(out)


@query("""
WITH b AS (SELECT event_type, user_id, arg_max(event_id % 100, event_id) AS v FROM events GROUP BY 1, 2)
SELECT event_type, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS batches FROM b GROUP BY 1
""")
def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A5."""
    return ledger.once_per_batch(table(spark, sf, "events").withColumn("v", F.col("event_id") % 100), "user_id", "v", "event_id", ["event_type"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(o_totalprice / count(*) OVER (PARTITION BY l_orderkey), 6) AS share
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def shared_cost(spark: SparkSession, sf: str) -> DataFrame:
    """W20."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return rounded(ledger.shared_cost(l.join(o, "l_orderkey"), ["l_orderkey"], "o_totalprice").drop("o_totalprice"))


@query("""
WITH a AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS ok FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS ok FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT CAST(count(*) FILTER (a.ok AND b.ok) AS BIGINT) AS both, CAST(count(*) FILTER (NOT a.ok AND b.ok) AS BIGINT) AS gain,
       CAST(count(*) FILTER (a.ok AND NOT b.ok) AS BIGINT) AS regression, CAST(count(*) FILTER (NOT a.ok AND NOT b.ok) AS BIGINT) AS neither
FROM a JOIN b USING (k)
""")
def paired_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    arm = lambda p: o.where(F.col("o_orderkey") % 2 == p).groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ok"))
    return ledger.paired_outcomes(arm(0), arm(1), "k", "ok")


@query("""
WITH a AS (SELECT doc_id, quality AS l FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, 1 - toxic AS l FROM labels WHERE doc_id % 3 <> 1)
SELECT CASE WHEN a.doc_id IS NULL THEN 'only_second' WHEN b.doc_id IS NULL THEN 'only_first' WHEN a.l IS DISTINCT FROM b.l THEN 'label_differs' ELSE 'same' END AS kind, CAST(count(*) AS BIGINT) AS n
FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1
""")
def consistent_labels(spark: SparkSession, sf: str) -> DataFrame:
    """J13."""
    l = table(spark, sf, "labels")
    return ledger.consistent_labels(l.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("l")), l.where("doc_id % 3 <> 1").select("doc_id", (1 - F.col("toxic")).alias("l")), ["doc_id"], "l")


_SECONDS = "epoch(ts)"


@query(f"""
WITH e AS (SELECT user_id % 16 AS lane, {_SECONDS} AS s, {_SECONDS} + value AS e FROM events),
n AS (SELECT *, coalesce(s - max(e) OVER (PARTITION BY lane ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 300, true)::INTEGER AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY lane ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT lane, CAST(session AS BIGINT) AS session, round(min(s), 3) AS start, round(max(e), 3) AS "end", CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1, 2
""")
def session_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of 16 lanes, broken where more than 300 s pass after the latest end."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").select((F.col("user_id") % 16).alias("lane"), s.alias("s"), (s + F.col("value")).alias("e"))
    return rounded(windows.sessions(e, "s", "e", 300.0, ["lane"]), 3)


@query(f"""
WITH e AS (SELECT user_id % 16 AS lane, {_SECONDS} AS s, {_SECONDS} + value * 20 AS e FROM events),
n AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY lane ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INTEGER AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY lane ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS session FROM n),
u AS (SELECT lane, session, max(e) - min(s) AS w FROM g GROUP BY 1, 2)
SELECT lane, CAST(count(*) AS BIGINT) AS pieces, round(sum(w), 3) AS covered FROM u GROUP BY 1
""")
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    """Covered seconds of each lane; intervals that touch are one."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").select((F.col("user_id") % 16).alias("lane"), s.alias("s"), (s + F.col("value") * 20).alias("e"))
    u = windows.sessions(e, "s", "e", 0.0, ["lane"])
    return rounded(u.groupBy("lane").agg(F.count("*").alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("covered")), 3)


@query("""
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type, day, round(v, 6) AS v, round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM d
""")
def trailing_mean(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"))
    return rounded(windows.trailing_mean(d, ["event_type"], "day", "v"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS z FROM events)
SELECT event_type, round(avg(CASE WHEN a <= 20 THEN value END), 6) AS first_mean, round(avg(CASE WHEN z <= 20 THEN value END), 6) AS last_mean FROM r GROUP BY 1
""")
def first_last_window(spark: SparkSession, sf: str) -> DataFrame:
    """N6."""
    return rounded(windows.ends(table(spark, sf, "events"), ["event_type"], "event_id", "value"))


_LINES = """
WITH p AS (SELECT l_orderkey AS task, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS pos,
                  CASE WHEN l_linestatus = 'O' THEN l_returnflag = 'R' WHEN l_returnflag <> 'N' THEN l_returnflag = 'R' END AS ok FROM lineitem)
"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    ok = F.when((F.col("l_linestatus") == "O") | (F.col("l_returnflag") != "N"), F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.row_number().over(w).alias("pos"), ok.alias("ok"))


@query(_LINES + """
, k AS (SELECT task, k, min(CASE WHEN ok THEN pos END) AS witness, count(*) FILTER (ok IS NULL) AS unknown, count(*) AS seen
        FROM p, (VALUES (1), (4), (8)) b(k) WHERE pos <= k GROUP BY task, k)
SELECT task, CAST(k AS INTEGER) AS k, CASE WHEN witness IS NOT NULL THEN 'solved' WHEN unknown > 0 OR seen < k THEN 'unresolved' ELSE 'failed' END AS decision, witness FROM k
""")
def cumulative_decision(spark: SparkSession, sf: str) -> DataFrame:
    """N10."""
    return windows.cumulative_decision(_lines(spark, sf), "task", "pos", "ok", [1, 4, 8])


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) = 1
""")
def argmax_first(spark: SparkSession, sf: str) -> DataFrame:
    """N11, Q12."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").withColumn("pos", F.struct("l_linenumber", "l_partkey"))
    return windows.argmax_first(l, ["l_orderkey"], "l_quantity", "pos").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':probe'), doc_id) <= 5
""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """S25."""
    return windows.stratified_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5, "probe")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS it, event_type FROM events),
k AS (SELECT * FROM r WHERE it <= 128 OR it % 61 < 4)
SELECT event_type, event_id, CAST(it AS INTEGER) AS it FROM k QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY it) <= 200
""")
def print_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """S5 with shorter bursts, as the table is small."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("event_type", "event_id").withColumn("it", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    return windows.print_throttle(e, ["event_type"], "it", every=61, most=200)


@query("""
SELECT c_mktsegment, CAST(pos AS BIGINT) AS pos, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda i: (i * (n - 1)) // 9), pos)
""")
def evenly_spaced(spark: SparkSession, sf: str) -> DataFrame:
    """S24."""
    from pyspark.sql import Window

    w = Window.partitionBy("c_mktsegment")
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", (F.row_number().over(w.orderBy("c_custkey")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("n"))
    return c.where(nm.evenly_spaced(F.col("pos"), F.col("n"), 10)).select("c_mktsegment", "pos", "c_custkey")


@query("""
SELECT event_id, CAST(('0x' || substr(sha256(user_id::VARCHAR || '/' || event_type), 1, 16))::UBIGINT % 5 AS INTEGER) AS fold FROM events
""")
def fold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """A28."""
    return table(spark, sf, "events").select("event_id", nm.fold(F.concat_ws("/", F.col("user_id").cast("string"), "event_type"), 5).alias("fold"))


@query("""
WITH v AS (SELECT l_orderkey - 20000 AS a, CASE WHEN l_linenumber % 5 = 4 THEN 0 WHEN l_linenumber % 2 = 0 THEN -l_linenumber ELSE l_linenumber END AS b FROM lineitem)
SELECT a, b, CAST(CASE WHEN b <> 0 THEN sign(a) * sign(b) * (abs(a) // abs(b)) END AS BIGINT) AS q, CAST(CASE WHEN b <> 0 THEN a - b * CAST(sign(a) * sign(b) * (abs(a) // abs(b)) AS BIGINT) END AS BIGINT) AS r, CAST(count(*) AS BIGINT) AS n
FROM v GROUP BY 1, 2
""")
def c_div_mod(spark: SparkSession, sf: str) -> DataFrame:
    """P5."""
    n = F.col("l_linenumber")
    v = table(spark, sf, "lineitem").select((F.col("l_orderkey") - 20000).alias("a"), F.when(n % 5 == 4, 0).when(n % 2 == 0, -n).otherwise(n).alias("b"))
    return v.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", nm.c_div(F.col("a"), F.col("b")).alias("q"), nm.c_mod(F.col("a"), F.col("b").cast("long")).alias("r"), "n")


@query("""
WITH r AS (SELECT l_suppkey, CASE l_suppkey % 5 WHEN 0 THEN 0.96 + l_discount / 10 WHEN 1 THEN l_discount / 10 WHEN 2 THEN 0.5 + l_discount / 10 ELSE l_discount * 10 END AS reward FROM lineitem),
g AS (SELECT l_suppkey, round(avg(reward), 4) AS mean, round(stddev_pop(reward), 4) AS std FROM r GROUP BY l_suppkey),
v AS (SELECT CASE WHEN l_suppkey % 17 = 0 THEN 'error' WHEN l_suppkey % 13 = 0 THEN 'unscorable'
                  WHEN std < 0.05 THEN CASE WHEN mean > 0.95 THEN 'saturated' WHEN mean < 0.05 THEN 'hopeless' ELSE 'flat' END
                  WHEN mean > 0.95 THEN 'saturated' WHEN mean < 0.05 THEN 'hopeless' ELSE 'frontier' END AS verdict FROM g)
SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1
""")
def frontier_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Of whole lineitem; the discounts of a supplier's lines, on a scale that depends on the supplier, stand for rewards."""
    d, k = F.col("l_discount"), F.col("l_suppkey")
    paid = F.when(k % 5 == 0, 0.96 + d / 10).when(k % 5 == 1, d / 10).when(k % 5 == 2, 0.5 + d / 10).otherwise(d * 10)
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(paid), 4).alias("mean"), F.round(F.stddev_pop(paid), 4).alias("std"))
    return g.groupBy(curation.frontier_verdict(k % 17 != 0, k % 13 != 0, F.col("mean"), F.col("std")).alias("verdict")).agg(F.count("*").alias("n"))


_GATES = """
WITH g AS (SELECT d.doc_id, list_filter([CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END, CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 0 THEN 'poor' END, CASE WHEN n_chars < 400 THEN 'short' END], lambda x: x IS NOT NULL) AS gates
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").withColumn("there", F.lit(True))
    j = d.join(l, "doc_id", "left")
    return j.select("doc_id", curation.gates(unlabelled=F.col("there").isNull(), toxic=F.col("toxic") == 1, poor=F.col("quality") == 0, short=F.col("n_chars") < 400).alias("gates"))


@query(_GATES + "SELECT coalesce(gates[1], 'kept') AS gate, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1")
def gates_first_fail(spark: SparkSession, sf: str) -> DataFrame:
    """C1, C2."""
    return curation.first_gate(_gates(spark, sf))


@query(_GATES + ", e AS (SELECT unnest(gates) AS gate FROM g) SELECT gate, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1")
def gates_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """C2."""
    return _gates(spark, sf).select(F.explode("gates").alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT p_type AS cell, count(*) AS supply FROM part WHERE p_size <= 25 GROUP BY 1), d AS (SELECT p_type AS cell, count(*) AS demand FROM part GROUP BY 1)
SELECT cell, demand, coalesce(supply, 0) AS supply, least(5, demand - coalesce(supply, 0)) AS missing FROM d LEFT JOIN s USING (cell) WHERE demand > coalesce(supply, 0)
""")
def gap_filling(spark: SparkSession, sf: str) -> DataFrame:
    """C14."""
    p = table(spark, sf, "part")
    count = lambda d, n: d.groupBy(F.col("p_type").alias("cell")).agg(F.count("*").alias(n))
    return curation.gaps(count(p, "demand"), count(p.where("p_size <= 25"), "supply"), "cell", 5)


@query("""
SELECT user_id, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS units, round(sum(coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0) * 0.05 + coalesce(CAST(json_extract(props, '$.cached') AS DOUBLE), 0) * 0.005), 6) AS price
FROM events GROUP BY 1
""")
def token_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Units and price from nested usage."""
    p = F.from_json("props", "k double, cached double")
    e = table(spark, sf, "events").select("user_id", p.alias("p"))
    price = F.coalesce("p.k", F.lit(0.0)) * 0.05 + F.coalesce("p.cached", F.lit(0.0)) * 0.005
    return rounded(e.groupBy("user_id").agg(F.sum("p.k").alias("units"), F.sum(price).alias("price")))


@query("""
SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS low, round(avg(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1.0 ELSE 0.0 END), 6) AS high FROM orders GROUP BY 1
""")
def bounded_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A30."""
    s = F.col("o_orderstatus")
    r = ledger.rates(F.count_if(s == "F"), F.count_if(s == "P"), F.count("*"))
    return rounded(table(spark, sf, "orders").groupBy("o_orderpriority").agg(r.alias("r")).select("o_orderpriority", "r.low", "r.high"))


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS en, CAST(count(DISTINCT source) AS BIGINT) AS sources, bool_and(text IS NOT NULL) AS all_texts,
       count(DISTINCT doc_id) = count(*) AS unique_ids, bool_and(n_chars = length(text)) AS lengths_hold FROM documents
""")
def completion_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A31-A33."""
    d = table(spark, sf, "documents")
    ids = d.select("doc_id").distinct().agg(F.count("*").alias("u"))
    one = d.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.countDistinct("source").alias("sources"), F.bool_and(F.col("text").isNotNull()).alias("all_texts"), F.bool_and(F.col("n_chars") == F.length("text")).alias("lengths_hold"))
    return one.crossJoin(ids).select("n", "en", "sources", "all_texts", (F.col("u") == F.col("n")).alias("unique_ids"), "lengths_hold")  # a row each


@query("""
SELECT concat_ws(';', CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END) AS kinds, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1
""")
def failure_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """A34."""
    k = ledger.failure_kinds(open=F.col("o_orderstatus") == "O", large=F.col("o_totalprice") > 300000, urgent=F.col("o_orderpriority").startswith("1"))
    return table(spark, sf, "orders").groupBy(k.alias("kinds")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS family_index FROM lineitem
""")
def family_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """A35."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey").withColumn("o", F.struct("l_linenumber", "l_partkey"))
    return sampling.family_local_index(l, ["l_orderkey"], "l_returnflag", "o").drop("o")


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang, source")
def marginals(spark: SparkSession, sf: str) -> DataFrame:
    """A32."""
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R')
SELECT CAST(count(*) AS BIGINT) AS negatives, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.l_orderkey = n.l_orderkey AND p.l_linenumber = n.l_linenumber)) AS BIGINT) AS hard,
       CAST(count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.l_partkey = n.l_partkey AND p.l_suppkey = n.l_suppkey)) AS BIGINT) AS soft FROM n
""")
def mislabel_audit(spark: SparkSession, sf: str) -> DataFrame:
    """W23."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return sampling.mislabelled(l.where("l_returnflag = 'R'"), l.where("l_returnflag <> 'R'"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""
WITH v AS (SELECT event_type, user_id % 8 AS context, 'value' AS variable, value AS v FROM events UNION ALL SELECT event_type, user_id % 8, 'event_id', event_id::DOUBLE FROM events)
SELECT event_type, context, variable, min(v) AS low, max(v) AS high FROM v GROUP BY 1, 2, 3
""")
def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """S8, J8."""
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 8).alias("context"), "value", "event_id")
    return sampling.envelopes(e, ["event_type", "context"], ["value", "event_id"])


@query("""
WITH s AS (SELECT l_orderkey AS run, l_linenumber AS it, l_partkey AS x, l_quantity < 40 AS guard FROM lineitem
           QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
SELECT s.run, s.it, s.x, (n1.it IS NOT NULL AND n2.it IS NOT NULL AND n3.it IS NOT NULL) AS dense, coalesce(n1.x - s.x, s.x - p.x) AS step, coalesce(p.guard AND NOT s.guard, false) AS terminal
FROM s LEFT JOIN s n1 ON n1.run = s.run AND n1.it = s.it + 1 LEFT JOIN s n2 ON n2.run = s.run AND n2.it = s.it + 2
LEFT JOIN s n3 ON n3.run = s.run AND n3.it = s.it + 3 LEFT JOIN s p ON p.run = s.run AND p.it = s.it - 1
""")
def trace_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Terminal and dense states and steps, on (run, it)."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("it"), F.col("l_partkey").alias("x"), (F.col("l_quantity") < 40).alias("guard"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("_order"))
    return sampling.neighbours(l, ["run"], "it", ["x"], "guard").select("run", "it", "x", "dense", F.col("step_x").alias("step"), "terminal")


@query("""
WITH l AS (SELECT l_orderkey AS run, l_linenumber AS it, l_linenumber::BIGINT AS x, floor(l_quantity / 10)::BIGINT AS y, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem),
t AS (SELECT run, it, x, y FROM l WHERE r = 1),
n AS (SELECT t.run, t.it, t.x, t.y, p.it IS NOT NULL AND p.y < 4 AND t.y >= 4 AS terminal, a.it IS NOT NULL AND b.it IS NOT NULL AND c.it IS NOT NULL AS dense,
             coalesce(a.x - t.x, t.x - p.x) AS sx, coalesce(a.y - t.y, t.y - p.y) AS sy
      FROM t LEFT JOIN t p ON p.run = t.run AND p.it = t.it - 1 LEFT JOIN t a ON a.run = t.run AND a.it = t.it + 1
             LEFT JOIN t b ON b.run = t.run AND b.it = t.it + 2 LEFT JOIN t c ON c.run = t.run AND c.it = t.it + 3),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY run, x, y ORDER BY it) = 1),
v(dx, dy, far) AS (SELECT a * d, b * d, d > 2 FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)) u(a, b), (VALUES (1), (2), (3), (5), (8)) w(d)),
c AS (SELECT run, x + dx AS x, y + dy AS y FROM f JOIN v ON (terminal OR (dense AND NOT far))
      WHERE (y < 4) = (y + dy < 4) AND NOT coalesce((sx <> 0 OR sy <> 0) AND dx * sy = dy * sx AND CASE WHEN sx <> 0 THEN dx % sx = 0 ELSE dy % sy = 0 END, false)),
e AS (SELECT run, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l GROUP BY run)
SELECT c.run, CAST(count(*) AS BIGINT) AS n FROM c JOIN e ON e.run = c.run AND c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.run = c.run AND l.x = c.x AND l.y = c.y) GROUP BY c.run
""")
def relation_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Moved states inside the envelope that are no positive, on whole traces: run an order, it its line number."""
    n = F.col("l_linenumber")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), n.alias("it"), n.cast("long").alias("x"), F.floor(F.col("l_quantity") / 10).alias("y"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("_order"))
    c = sampling.relation_negatives(s, ["run"], "it", ["x", "y"], F.col("y") < 4)
    return c.groupBy("run").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_type, user_id AS run, floor(value / 10)::BIGINT AS state, event_id FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_type, state ORDER BY run, event_id) = 1),
g AS (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY run) - 1 AS group_idx FROM f)
SELECT event_type, run, state, CAST(group_idx AS INTEGER) AS group_idx FROM g WHERE group_idx < 12
""")
def escape_groups(spark: SparkSession, sf: str) -> DataFrame:
    """S16."""
    e = table(spark, sf, "events").select("event_type", F.col("user_id").alias("run"), F.floor(F.col("value") / 10).alias("state"), "event_id")
    return sampling.escape_groups(e, ["event_type"], "run", "state", "event_id").select("event_type", "run", "state", "group_idx")
