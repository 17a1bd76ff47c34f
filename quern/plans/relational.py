"""

Most queries are one text for both engines; where types or functions differ, DuckDB has a text of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import tables
from quern.operators import hierarchy, joins, ranking, sketches, theta
from quern.plans.registry import Registry
from quern.session import shared_dir, table
from quern.sources import files

REGISTRY = Registry()
#: Parts of a group that a user-defined aggregate sees one at a time.
LOTS = 64


def define(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query by SQL over ``{table}`` names."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    run.__doc__ = f"Track B: {name.replace('_', ' ')}."
    REGISTRY.add(name, oracle or re.sub(r"\{(\w+)\}", r"\1", sql))(run)


define(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
define(
    "filter_projection",
    "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%URGENT%'",
)
define(
    "join_inner_star",
    """SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey
    JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
define(
    "join_left_outer",
    """SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS total
    FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
    """SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0.0::DOUBLE) AS total
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
)
define(
    "join_full_outer",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) a
    FULL OUTER JOIN (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM {supplier} GROUP BY s_nationkey) b ON a.k = b.k""",
)
define("join_semi", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
define("join_anti", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
define("join_anti_priced", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
for kind, hint in (("merge", "MERGE(orders)"), ("shuffle_hash", "SHUFFLE_HASH(customer)"), ("broadcast", "BROADCAST(customer)")):
    define(
        f"join_{kind}",
        f"""SELECT /*+ {hint} */ c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM {{orders}} AS orders JOIN {{customer}} AS customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
        "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    )
define(
    "join_theta",
    """SELECT a.r_name AS one, b.r_name AS other FROM {region} a JOIN {region} b ON a.r_regionkey < b.r_regionkey""",
    "SELECT a.r_name AS one, b.r_name AS other FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
)
define("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
define(
    "aggregate_distinct",
    "SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS statuses, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_orderpriority",
)
for kind, clause in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    define(
        f"aggregate_{kind}",
        f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g_flag, CAST(grouping(l_linestatus) AS INT) AS g_status,
        CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(count(*) AS BIGINT) AS n FROM {{lineitem}} GROUP BY {clause}""",
    )
define("aggregate_filtered", "SELECT user_id, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high, round(max(value), 6) AS top FROM {events} GROUP BY user_id HAVING count(*) > 1")
define("aggregate_sorted", "SELECT c_nationkey, max(c_name) AS last, min(c_mktsegment) AS first FROM {customer} GROUP BY c_nationkey")
define("aggregate_median", "SELECT event_type, round(percentile(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS sd FROM {events} GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS sd FROM events GROUP BY event_type")
define(
    "window_ranking",
    """SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER p AS INT) AS rk, CAST(dense_rank() OVER p AS INT) AS dr,
    CAST(ntile(4) OVER w AS INT) AS quarter, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd FROM {orders}
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
define(
    "window_analytic",
    """SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS later, first_value(value) OVER w AS first, coalesce(nth_value(event_id, 2) OVER w, -1) AS second,
    round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last_three FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
define(
    "window_range_frame",
    "SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS BIGINT) AS near FROM {customer}",
)
define("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
define("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
define("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
define("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
define("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
define("set_except", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal < 0")
define("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
define(
    "recursive_tree",
    """WITH RECURSIVE t(c_custkey, depth) AS (SELECT c_custkey, 0 FROM {customer} WHERE c_custkey <= 1
    UNION ALL SELECT c.c_custkey, depth + 1 FROM {customer} c JOIN t ON c.c_custkey DIV 2 = t.c_custkey WHERE c.c_custkey > 1) SELECT c_custkey, depth FROM t""",
    """WITH RECURSIVE t(c_custkey, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey <= 1
    UNION ALL SELECT c.c_custkey, depth + 1 FROM customer c JOIN t ON c.c_custkey // 2 = t.c_custkey WHERE c.c_custkey > 1) SELECT c_custkey, depth FROM t""",
)
define(
    "correlated_scalar",
    "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
)
define(
    "pivot_status",
    "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority",
)
define(
    "unpivot_measures",
    "SELECT s_suppkey, name, amount FROM {supplier} UNPIVOT (amount FOR name IN (s_acctbal AS balance)) UNION ALL SELECT p_partkey, 'price', p_retailprice FROM {part}",
    "SELECT s_suppkey, 'balance' AS name, s_acctbal AS amount FROM supplier UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
)
define(
    "scalar_string",
    """SELECT doc_id, upper(lang) AS up, CAST(length(text) AS BIGINT) AS n, substr(text, 1, 7) AS head, replace(source, 'src', 'S') AS s, concat_ws('-', lang, source) AS joined,
    lpad(source, 8, '.') AS padded, CAST(instr(text, 'the') AS BIGINT) AS place, md5(text) AS digest, reverse(source) AS back, split_part(text, ' ', 2) AS second FROM {documents}""",
    """SELECT doc_id, upper(lang) AS up, length(text) AS n, substr(text, 1, 7) AS head, replace(source, 'src', 'S') AS s, concat_ws('-', lang, source) AS joined,
    lpad(source, 8, '.') AS padded, instr(text, 'the') AS place, md5(text) AS digest, reverse(source) AS back, split_part(text, ' ', 2) AS second FROM documents""",
)
define(
    "scalar_regexp",
    r"""SELECT doc_id, regexp_replace(text, '[aeiou]+', '_') AS masked, regexp_extract(text, '([A-Z][a-z]+)', 1) AS name, CAST(regexp_count(text, '[0-9]+') AS BIGINT) AS numbers FROM {documents}""",
    r"""SELECT doc_id, regexp_replace(text, '[aeiou]+', '_', 'g') AS masked, regexp_extract(text, '([A-Z][a-z]+)', 1) AS name, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers FROM documents""",
)
define(
    "scalar_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(dayofyear(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
    CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS start, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS due, CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM {orders}""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(dayofyear(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
    CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS start, CAST(CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS VARCHAR) AS due, datediff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days FROM orders""",
)
define(
    "scalar_math",
    """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS l, CAST(floor(p_retailprice) AS BIGINT) AS lo, CAST(ceil(p_retailprice) AS BIGINT) AS hi,
    p_size % 7 AS left_over, abs(p_size - 25) AS off, CAST(sign(p_size - 25) AS INT) AS side, greatest(p_size, 10) AS most, round(power(p_size, 2), 3) AS sq FROM {part}""",
)
define(
    "scalar_conditional",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, nullif(c_mktsegment, 'BUILDING') AS segment, coalesce(nullif(c_nationkey, 0), -1) AS nation FROM {customer}""",
)
define(
    "scalar_json",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
)
define(
    "scalar_variant",
    "SELECT event_id, variant_get(parse_json(props), '$.k', 'INT') AS k FROM {events} WHERE event_type = 'click'",
    "SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events WHERE event_type = 'click'",
)
define(
    "scalar_edit_distance",
    "SELECT a.r_name AS one, b.r_name AS other, CAST(levenshtein(a.r_name, b.r_name) AS INT) AS steps FROM {region} a JOIN {region} b ON a.r_regionkey < b.r_regionkey",
)
define(
    "scalar_json_struct",
    "SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT from_json(props, 'k INT').k AS k FROM {events}) GROUP BY k",
    "SELECT CAST(props->>'k' AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
)
define(
    "scalar_array",
    """SELECT vec_id, CAST(size(embedding) AS INT) AS n, element_at(embedding, 1) AS first, CAST(array_max(embedding) AS FLOAT) AS top, CAST(array_min(embedding) AS FLOAT) AS low,
    CAST(size(filter(embedding, x -> x > 0)) AS INT) AS positive FROM {embeddings}""",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1] AS first, list_max(embedding) AS top, list_min(embedding) AS low,
    CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive FROM embeddings""",
)
define(
    "explode_words",
    "SELECT w, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(split(text, ' ')) AS w FROM {benchmark}) GROUP BY w",
    "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY w",
)
define(
    "map_roundtrip",
    "SELECT conv_id, element_at(m, 0) AS first_role, CAST(size(m) AS INT) AS turns FROM (SELECT conv_id, map_from_entries(collect_list(struct(turn, role))) AS m FROM {conversations} GROUP BY conv_id)",
    "SELECT conv_id, max(role) FILTER (turn = 0) AS first_role, CAST(count(*) AS INT) AS turns FROM conversations GROUP BY conv_id",
)
define(
    "collect_ordered",
    "SELECT conv_id, concat_ws('>', transform(array_sort(collect_list(struct(turn, role))), x -> x.role)) AS roles FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
)


@REGISTRY.add("join_asof", """SELECT e.event_id, e.user_id, v.value AS value_before FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: each click with the user's last view at or before it. Times are numbers here; every user's rows are cut into slices of them."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "at")
    views = events.filter("event_type = 'view'").select("user_id", "at", F.col("value").alias("value_before"))
    return joins.asof_join(clicks, views, "user_id", "at", ["value_before"]).select("event_id", "user_id", "value_before")


@REGISTRY.add("join_asof_sliced", """SELECT e.event_id, e.user_id, v.value AS value_before FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def join_asof_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: as join_asof, with every user's rows cut into days, so that a user with very many rows fills no task."""
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("value_before"))
    return joins.asof_join(clicks, views, "user_id", "ts", ["value_before"]).select("event_id", "user_id", "value_before")


@REGISTRY.add("join_range", """SELECT p.p_partkey, s.s_suppkey FROM part p JOIN (SELECT s_suppkey, abs(s_acctbal) AS lo, abs(s_acctbal) + 50 AS hi FROM supplier) s
    ON p.p_retailprice >= s.lo AND p.p_retailprice < s.hi""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: parts whose price lies in a supplier's interval."""
    intervals = table(spark, sf_dir, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("lo"), (F.abs("s_acctbal") + 50).alias("hi"))
    points = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.range_join(points, intervals, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "s_suppkey")


_SPAN = "10 ** (event_id % 8)"  # seconds: from one to 116 days


@REGISTRY.add("join_intervals", f"""WITH s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS lo, epoch_us(ts) + CAST({_SPAN} AS BIGINT) * 1000000 AS hi FROM events)
    SELECT a.event_id AS view_id, b.event_id AS click_id, a.user_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def join_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: a user's views and clicks that overlap, if they last from one second to 116 days: intervals joined with intervals."""
    lasts = F.expr("make_dt_interval(0, 0, 0, cast(pow(10, event_id % 8) as decimal(18, 6)))")
    spans = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", (F.col("ts") + lasts).alias("te"))
    side = lambda kind: spans.filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), "user_id", F.col("ts").alias(f"{kind}_from"), F.col("te").alias(f"{kind}_to"))
    met = joins.interval_join(side("view"), side("click"), ("view_from", "view_to"), ("click_from", "click_to"), 1.0, "user_id")
    return met.select("view_id", "click_id", "user_id")


@REGISTRY.add("hierarchy_depths", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS top, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS depth FROM events")
def hierarchy_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: how far each event is from its user's first, over links from each event to the one before: chains climbed by path doubling."""
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    found = hierarchy.climb(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), before.alias("parent")))
    return found.select(F.col("id").alias("event_id"), "top", "depth")


@REGISTRY.add("join_salted", "SELECT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND o_orderstatus = 'F'")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: an equi-join whose hot keys are dealt over salts."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("k"), "l_partkey")
    heads = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return joins.salted_join(lines, heads, "k").select(F.col("k").alias("l_orderkey"), "l_partkey", "o_custkey")


@REGISTRY.add("top_k_per_group", """SELECT o_custkey, o_orderkey, CAST(rn AS INT) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: each customer's three largest orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_k_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@REGISTRY.add("approximate_counts")
def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: sketches. Engines' sketches differ, so there is no SQL to compare with."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.9).alias("p90"))


@REGISTRY.add("udf_vectorised", "SELECT event_id, round(value * 9 / 5 + 32, 6) AS fahrenheit FROM events")
def udf_vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: a vectorised user function."""
    @F.pandas_udf("double")
    def fahrenheit(c: pd.Series) -> pd.Series:
        return c * 9 / 5 + 32

    return table(spark, sf_dir, "events").select("event_id", F.round(fahrenheit("value"), 6).alias("fahrenheit"))


@REGISTRY.add(
    "approximate_within_bounds",
    """SELECT event_type, true AS users_near, true AS p90_near FROM events GROUP BY event_type""",
)
def approximate_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: whether sketches are as near to the exact figures as they promise: distinct users within 3 standard errors of 5 %, the percentile's rank within 0.001."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.05).alias("users"), F.percentile_approx("value", 0.9, 10_000).alias("p90"), F.count_distinct("user_id").alias("exact"), F.count("value").alias("n")
    )
    below = events.join(F.broadcast(counts.select("event_type", "p90")), "event_type").groupBy("event_type")  # a row a type
    ranks = below.agg(F.count_if(F.col("value") < F.col("p90")).alias("low"), F.count_if(F.col("value") <= F.col("p90")).alias("high"))
    near = (F.col("low") <= F.col("n") * 0.901 + 1) & (F.col("high") >= F.col("n") * 0.899 - 1)
    users = F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.15 * F.col("exact"))
    return counts.join(ranks, "event_type").select("event_type", users.alias("users_near"), near.alias("p90_near"))


@REGISTRY.add("udaf_grouped", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY event_type")
def udaf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: a user-defined aggregate. It sums up lots of a group, dealt by an event's id, and their sums are added up natively, so a hot group fills no task."""

    @F.pandas_udf("double")
    def sum_of_squares(x: pd.Series) -> float:
        return float(np.square(x).sum())

    lots = table(spark, sf_dir, "events").groupBy("event_type", F.pmod(F.xxhash64("event_id"), F.lit(LOTS)).alias("lot"))
    sums = lots.agg(sum_of_squares("value").alias("squares"))
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("n"))
    means = sums.groupBy("event_type").agg(F.sum("squares").alias("squares")).join(counts, "event_type")
    return means.select("event_type", F.round(F.sqrt(F.col("squares") / F.col("n")), 6).alias("rms"))


@REGISTRY.add("udtf_pieces", "SELECT item_id, CAST(unnest(range(1, len(words) + 1)) AS INT) AS place, unnest(words) AS word FROM (SELECT item_id, string_split(text, ' ') AS words FROM benchmark WHERE text IS NOT NULL)")
def udtf_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: a user-defined table function, joined laterally: every word of a text with its place. Null texts give no rows."""

    class Pieces:
        def eval(self, text: str):
            if text is not None:
                yield from enumerate(text.split(" "), 1)

    spark.udtf.register("quern_pieces", F.udtf(Pieces, returnType="place int, word string", useArrow=True))
    return spark.sql("SELECT b.item_id, p.place, p.word FROM {benchmark} b, LATERAL quern_pieces(b.text) p", benchmark=table(spark, sf_dir, "benchmark"))


@REGISTRY.add("files_round_trip", " UNION ALL ".join(f"SELECT '{kind}' AS kind, n_nationkey, n_name, n_regionkey FROM nation" for kind in ("parquet", "orc", "json", "csv")))
def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: a table written to and read from each file format."""
    nation, out = table(spark, sf_dir, "nation"), None
    for kind in ("parquet", "orc", "json", "csv"):
        path = shared_dir(spark, kind)
        files.write(nation, kind, path)
        back = files.read(spark, kind, path, schema=nation.schema).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey")
        out = back if out is None else out.unionByName(back)
    return out


@REGISTRY.add("join_bucketed", "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: two tables bucketed by their key once, then joined without a shuffle."""
    lines = files.write_bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), shared_dir(spark, "bucketed"), "l_orderkey", 8)
    heads = files.write_bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), shared_dir(spark, "bucketed"), "o_orderkey", 8)
    joined = lines.join(heads.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@REGISTRY.add("join_theta_counted", """SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n_matches FROM orders LEFT JOIN (
    SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN lineitem ON o_totalprice < l_extendedprice AND o_orderdate >= l_shipdate GROUP BY o_orderkey) ON o_orderkey = k""")
def join_theta_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: for each order, how many lines cost more than it and were shipped before it: two large sides on two inequalities, counted without pairs."""
    orders, lines = (table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    orders, lines = orders.select("o_orderkey", "o_totalprice", "o_orderdate"), lines.select("l_extendedprice", "l_shipdate")
    found = theta.theta_counts(orders, lines, ("o_totalprice", "<", "l_extendedprice"), ("o_orderdate", ">=", "l_shipdate"))
    return found.select("o_orderkey", "n_matches")


_RANGES = (("2024-01-01", "2024-01-31"), ("2024-01-05", "2024-01-11"), ("2024-01-17", "2024-01-17"))


@REGISTRY.add(
    "sketches_by_day",
    " UNION ALL ".join(f"SELECT '{a}' AS first_day, event_type, count(*) AS n, min(value) AS low, max(value) AS high, true AS users_near, true AS median_near FROM events WHERE CAST(ts AS DATE) BETWEEN '{a}' AND '{b}' GROUP BY event_type" for a, b in _RANGES),
)
def sketches_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: ranges of days answered from a table of daily sketches, kept in two loads that share days; distinct users and medians within the stated error of the exact ones."""
    events, path = table(spark, sf_dir, "events"), shared_dir(spark, "sketches")
    for load in (F.to_date("ts") <= F.lit("2024-01-20").cast("date"), F.to_date("ts") >= F.lit("2024-01-15").cast("date")):
        sketches.keep(sketches.sketched(events.filter(load), "ts", ["event_type"], "user_id", "value"), path)
    out = None
    for first, last in _RANGES:
        found = sketches.merged(spark, path, ["event_type"], first, last, [0.5]).withColumn("median", F.get("quantiles", F.lit(0)))
        days = events.filter(F.to_date("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        ranks = days.join(F.broadcast(found.select("event_type", "median")), "event_type").groupBy("event_type")  # a row a type
        exact = ranks.agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") < F.col("median")).alias("under"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
        users = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("users"))
        median = (F.col("under") <= (0.5 + sketches.RANK_ERROR) * F.col("n") + 1) & (F.col("upto") >= (0.5 - sketches.RANK_ERROR) * F.col("n") - 1)
        part = found.join(exact, "event_type").select(F.lit(first).alias("first_day"), "event_type", "n", "low", "high", users.alias("users_near"), median.alias("median_near"))
        out = part if out is None else out.unionByName(part)
    return out


@REGISTRY.add(
    "udtf_dialogue",
    """WITH c AS (SELECT *, CASE WHEN turn > min(turn) OVER w AND role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS switch FROM conversations WINDOW w AS (PARTITION BY conv_id))
    SELECT conv_id, CAST(count(*) AS INT) AS n_turns, CAST(sum(switch) AS INT) AS n_switches,
      CAST(count(*) FILTER (role = 'user') AS INT) AS user_turns, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS user_chars, arg_max(text, turn) FILTER (role = 'user') AS user_last,
      CAST(count(*) FILTER (role = 'assistant') AS INT) AS assistant_turns, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant_chars, arg_max(text, turn) FILTER (role = 'assistant') AS assistant_last
    FROM c GROUP BY conv_id""",
)
def udtf_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: a table function over conversations, dealt and ordered as it asks for, whose columns are decided by the call."""
    tables.register(spark)
    return spark.sql("SELECT * FROM quern_dialogue(table => TABLE({c}), conversation => 'conv_id', place => 'turn', roles => 'user,assistant')", c=table(spark, sf_dir, "conversations"))


@REGISTRY.add(
    "table_kept_up_to_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'changed' ELSE o_orderstatus END AS status,
    CAST(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 2 ELSE 1 END AS INT) AS version FROM orders""",
)
def table_kept_up_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track B: all orders by year, then a second load of the years from 1997 on, in which each has changed, and that load once more."""
    orders, path = table(spark, sf_dir, "orders"), shared_dir(spark, "kept")
    whole = orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    late = whole.filter("y >= 1997").withColumn("status", F.lit("changed")).withColumn("version", F.lit(2))
    for load in (whole, late, late, whole.filter("y = 1998")):
        files.upsert(load, path, ["o_orderkey"], "y", "version")
    return files.existing(spark, path, whole.schema)
