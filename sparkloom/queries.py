"""Registered queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import relational, words
from .plans import graph, ml
from .plans.iterate import settled
from .sources import readers
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("text").alias("line"))


# Java's split drops trailing empty parts; in SQL they are cut off the text before it is split.
_ROUTED = r"""
tokens AS (SELECT unnest(string_split_regex(regexp_replace(lower(text), '\W+$', ''), '\W+')) AS token FROM documents
           WHERE text = '' OR NOT regexp_full_match(text, '\W+'))
"""


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\W+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(_lines(spark, sf_dir))


@query("WITH " + _ROUTED + "SELECT CASE WHEN length(token) > 5 THEN 'rejectWordCount' WHEN length(token) > 0 THEN token ELSE 'error' END AS word, count(*) AS n FROM tokens GROUP BY 1")
def word_count_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.routed_word_count(_lines(spark, sf_dir))


@query("WITH " + _ROUTED + "SELECT 'rejected:' || token AS word, count(*) AS n FROM tokens WHERE length(token) > 5 GROUP BY 1")
def rejected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.rejected_words(_lines(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(regexp_replace(text, '\s+$', ''), '\s')) AS word FROM documents
WHERE text = '' OR NOT regexp_full_match(text, '\s+')) GROUP BY word""")
def whitespace_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.whitespace_word_count(_lines(spark, sf_dir))


@query("""SELECT CAST(n_chars AS BIGINT) AS rank, CAST(doc_id AS VARCHAR) AS url, lang AS avg_duration FROM documents
WHERE contains(text, ' the ') AND contains(text, ' and ') AND n_chars > 400
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = doc_id AND year(o_orderdate) = 1995)""")
def weblog_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumn("url", F.col("doc_id").cast("string"))
    docs, ranks = d.select("url", F.col("text").alias("contents")), d.select(F.col("n_chars").alias("rank"), "url", F.col("lang").alias("avg_duration"))
    visits = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("url"), F.col("o_orderdate").alias("visit_date"))
    return relational.web_log(docs, ranks, visits, [" the ", " and "], 400, 1995)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").where(text.in_year(F.col("o_orderdate"), 1997)).select("o_orderkey", "o_custkey")


@query("SELECT CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = _table(spark, sf_dir, "orders").select(text.year_of(F.col("o_orderdate").cast("string")).alias("year"))
    return dates.groupBy("year").agg(F.count("*").alias("n"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("event_type") == "error", F.lit(" \t")).when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", blank.alias("kind"), F.when(F.col("value") > 50, "").otherwise(F.col("props")).alias("props"))


_FIELDS = r"""fields AS (SELECT event_id, CASE WHEN event_type = 'error' THEN ' ' || chr(9) WHEN event_type = 'signup' THEN NULL ELSE event_type END AS kind,
CASE WHEN value > 50 THEN '' ELSE props END AS props FROM events),
marked AS (SELECT event_id, kind IS NULL OR regexp_full_match(kind, '[\x00-\x20]*') AS no_kind, props IS NULL OR regexp_full_match(props, '[\x00-\x20]*') AS no_props FROM fields)
"""


@query("WITH " + _FIELDS + "SELECT event_id FROM marked WHERE NOT no_kind AND NOT no_props")
def empty_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.whole_rows(_fields(spark, sf_dir), ["kind", "props"]).select("event_id")


@query("WITH " + _FIELDS + "SELECT 'kind' AS field, count(*) FILTER (no_kind) AS blanks FROM marked UNION ALL SELECT 'props', count(*) FILTER (no_props) FROM marked")
def empty_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.blank_counts(_fields(spark, sf_dir), ["kind", "props"])


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def user_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    mails = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return relational.join_pairs(users, mails, "key").select("left.c_name", "right.o_orderkey")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").where(text.in_year(F.col("o_orderdate"), 1995))
    return relational.difference(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), orders.select(F.col("o_custkey").alias("key")))


@query("SELECT o_custkey AS key, o_orderkey AS value FROM orders")
def co_group_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return relational.co_group_right(left, _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), "key")


@query("SELECT o_custkey AS src, array_to_string(list_sort(list(o_orderkey)), ',') AS neighbours FROM orders GROUP BY 1")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return relational.adjacency(edges).select("src", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_time(_table(spark, sf_dir, "events"), "ts")


def _plain(df: DataFrame) -> DataFrame:
    """Windows as epoch seconds: the same in any time zone."""
    return df.withColumns({c: F.unix_timestamp(c) for c in ("window_start", "window_end")})


@query("SELECT s AS window_start, s + 3600 AS window_end, event_type, count(*) AS n FROM (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS s, event_type FROM events) GROUP BY ALL")
def tumbling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.tumbling(_events(spark, sf_dir), "1 hour", ["event_type"], F.count("*").alias("n")))


@query("""SELECT s AS window_start, s + 36000 AS window_end, event_type, sum(user_id)::BIGINT AS total FROM
(SELECT (CAST(floor(epoch(ts) / 7200) AS BIGINT) - k) * 7200 AS s, event_type, user_id FROM events, range(5) AS r(k)) GROUP BY ALL""")
def sliding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.sliding(_events(spark, sf_dir), "10 hours", "2 hours", ["event_type"], F.sum("user_id").alias("total")))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS window_start, CAST(floor(epoch(max(ts) + INTERVAL 6 HOUR)) AS BIGINT) AS window_end, count(*) AS n FROM b GROUP BY user_id, k""")
def session_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.session(_events(spark, sf_dir), "6 hours", ["user_id"], F.count("*").alias("n")))


@query("""SELECT s AS window_start, s + 3600 AS window_end, CAST(trunc(a / n::DOUBLE * 100) AS INTEGER) AS slow_percent, CAST(trunc((n - a) / n::DOUBLE * 100) AS INTEGER) AS fast_percent, 1 AS one FROM
(SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS s, count(*) FILTER (value > 50) AS a, count(*) AS n FROM events GROUP BY 1)""")
def status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windows.slow_share(_events(spark, sf_dir), "1 hour", time="value", limit=50))


@query("""SELECT count(*) AS pv, CAST(sum(user_id) AS BIGINT) // count(user_id) AS avg_restime, round(count(*) FILTER (event_type <> 'view') / count(*)::DOUBLE, 2) AS error_rate,
CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 + 8 * 3600 AS at FROM events WHERE event_type <> 'error' GROUP BY floor(epoch(ts) / 3600)""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "error", 404).otherwise(500)
    log = _events(spark, sf_dir).select("ts", status.alias("status"), F.col("user_id").alias("restime"))
    return windows.dashboard(log, "1 hour").withColumn("at", F.unix_timestamp("at"))


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.running_count(_events(spark, sf_dir), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "n")


def _part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the same order, smaller key first, once for each order; lines are shuffled once."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    pairs = lines.alias("a").join(lines.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey")
    return pairs.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"))


def _part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir).distinct()


_PARTS = """e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""
# open pairs are few once each edge leaves its end of lower degree
_DIRECTED = """, d AS MATERIALIZED (SELECT v, count(*) AS k FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
o AS MATERIALIZED (SELECT CASE WHEN (a.k, src) < (b.k, dst) THEN src ELSE dst END AS low, CASE WHEN (a.k, src) < (b.k, dst) THEN dst ELSE src END AS high
FROM e JOIN d a ON a.v = src JOIN d b ON b.v = dst),
p AS MATERIALIZED (SELECT x.low, x.high AS src, y.high AS dst FROM o x JOIN o y ON x.low = y.low AND x.high < y.high)"""


@query("WITH " + _PARTS + _DIRECTED + " SELECT least(low, p.src, p.dst) AS v1, low + p.src + p.dst - least(low, p.src, p.dst) - greatest(low, p.src, p.dst) AS v2, greatest(low, p.src, p.dst) AS v3 FROM p JOIN e ON e.src = p.src AND e.dst = p.dst")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(_part_pairs(spark, sf_dir))


@query("WITH " + _PARTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e)
SELECT a.src AS v1, a.dst AS v2, b.dst AS v3 FROM r a JOIN r b ON a.src = b.src AND a.k = 1 AND b.k = 2 JOIN e c ON c.src = a.dst AND c.dst = b.dst""")
def triangles_first_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(_part_graph(spark, sf_dir), as_written=True)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each with an edge to the next one."""
    t = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("v")).distinct()
    return t.select(F.col("v").alias("src")).join(t.select(F.col("v").alias("dst")), F.col("dst") == F.col("src") + 1)


_TURNS = "t AS (SELECT DISTINCT conv_id * 100000 + turn AS v FROM conversations), e AS (SELECT a.v AS src, b.v AS dst FROM t a JOIN t b ON b.v = a.v + 1)"


@query("WITH RECURSIVE " + _TURNS + ", c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_turns(spark, sf_dir), steps=60, doubling=True).result


@query("WITH RECURSIVE " + _TURNS + ", c AS (SELECT v AS vertex, v AS label FROM t UNION SELECT e.dst, c.label FROM c JOIN e ON c.vertex = e.src) SELECT vertex, min(label) AS component FROM c GROUP BY 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("vertex")).distinct()
    return graph.contracted_components(vertices, _turns(spark, sf_dir)).result


def _steps_sql(steps: int) -> str:
    out = "WITH " + _TURNS + ", u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), c0 AS (SELECT v AS vertex, v AS component FROM t)"
    for k in range(steps):
        out += f", c{k + 1} AS (SELECT vertex, min(component) AS component FROM (SELECT vertex, component FROM c{k} UNION ALL SELECT u.dst, c.component FROM c{k} c JOIN u ON u.src = c.vertex) GROUP BY 1)"
    return out + f" SELECT vertex, component FROM c{steps}"


@query(_steps_sql(3))
def components_by_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("vertex")).distinct()
    return graph.components(vertices, _turns(spark, sf_dir), steps=3).result


def _rank_sql(steps: int) -> str:
    out = "WITH " + _PARTS + ", b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), d AS (SELECT src, count(*) AS k FROM b GROUP BY 1), n AS (SELECT count(*) AS n FROM d), r0 AS (SELECT src AS page, 1.0::DOUBLE / n AS rank FROM d, n)"
    for k in range(steps):
        out += f", r{k + 1} AS (SELECT b.dst AS page, sum(r.rank / d.k) * 0.85 + 0.15 / any_value(n) AS rank FROM r{k} r JOIN b ON b.src = r.page JOIN d ON d.src = r.page, n GROUP BY 1)"
    return out + f" SELECT page, round(rank, 9) AS rank FROM r{steps}"


@query(_rank_sql(5))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = settled(graph.mirrored(_part_graph(spark, sf_dir)))
    found = graph.page_rank(edges.select(F.col("src").alias("page")).distinct(), edges, steps=5, epsilon=None).result
    return found.select("page", F.round("rank", 9).alias("rank"))


K_START = [(1, -2.0, -2.0), (2, 2.0, 2.0), (3, 2.0, -2.0), (4, -2.0, 2.0)]


def _means_sql(steps: int) -> str:
    out = "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings), c0(id, x, y) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, x, y in K_START) + ")"
    for k in range(steps):
        out += f", c{k + 1} AS (SELECT id, avg(x) AS x, avg(y) AS y FROM (SELECT p.x, p.y, (SELECT id FROM c{k} c ORDER BY sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2), id LIMIT 1) AS id FROM p) GROUP BY 1)"
    return out + f" SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM c{steps}"


@query(_means_sql(5))
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "embeddings").select((F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"))
    found = [(i, round(x, 6), round(y, 6)) for i, x, y in ml.k_means(points, K_START, steps=5)]
    return spark.createDataFrame(found, "id int, x double, y double")


def _regression_sql(steps: int) -> str:
    out = "WITH s AS (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem), t0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
    for k in range(steps):
        out += f", t{k + 1} AS (SELECT avg(a - 0.01 * (a + b * x - y)) AS a, avg(b - 0.01 * (a + b * x - y) * x) AS b FROM s, t{k})"
    return out + f" SELECT round(a, 9) AS theta0, round(b, 9) AS theta1 FROM t{steps}"


@query(_regression_sql(10))
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100_000).alias("y"))
    a, b = ml.linear_regression(samples, steps=10)
    return spark.createDataFrame([(a, b)], "theta0 double, theta1 double").select(F.round("theta0", 9).alias("theta0"), F.round("theta1", 9).alias("theta1"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, CAST(p_partkey % 49 + 1 AS BIGINT) AS a, CAST(p_size % 49 + 1 AS BIGINT) AS b FROM part),
f AS (SELECT p_partkey, b AS p, a + b AS q, 1 AS n FROM p UNION ALL SELECT p_partkey, q, p + q, n + 1 FROM f WHERE p < 100 AND q < 100)
SELECT p_partkey, max(n) AS n FROM f GROUP BY 1""")
def fibonacci_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 49 + 1).alias("a"), (F.col("p_size") % 49 + 1).cast("long").alias("b"))
    steps = ml.fibonacci_steps(pairs.select("a", "b").distinct())
    return pairs.join(steps, ["a", "b"]).select("p_partkey", "n")


@query("""SELECT round(sum(CASE WHEN x * x + y * y < 1 THEN 1 ELSE 0 END) * 4 / count(*)::DOUBLE, 9) AS pi FROM
(SELECT ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE AS x, ((o_orderkey * 104729 + o_custkey * 31) % 10009) / 10009.0::DOUBLE AS y FROM orders)""")
def pi_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("o_orderkey") * 7919 % 10007) / F.lit(10007.0), ((F.col("o_orderkey") * 104729 + F.col("o_custkey") * 31) % 10009) / F.lit(10009.0)
    return ml.pi_estimate(_table(spark, sf_dir, "orders"), x, y).select(F.round("pi", 9).alias("pi"))


@query("SELECT round(sum(CASE WHEN x * x + y * y < 1 THEN 1 ELSE 0 END) * 4 / 1000000::DOUBLE, 9) AS pi FROM (SELECT ((id * 7919) % 10007) / 10007.0::DOUBLE AS x, ((id * 104729) % 10009) / 10009.0::DOUBLE AS y FROM range(1000000) r(id))")
def pi_of_a_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("id") * 7919 % 10007) / F.lit(10007.0), (F.col("id") * 104729 % 10009) / F.lit(10009.0)
    return ml.pi_estimate(spark.range(1_000_000), x, y).select(F.round("pi", 9).alias("pi"))


@query("""WITH p AS (SELECT id % 10000 + 1 AS key, id // 500000 * 500 AS pane, count(*) AS part FROM range(20000000) r(id) GROUP BY ALL)
SELECT key, pane - k * 500 AS window_start_ms, CAST(sum(part) AS BIGINT) AS total FROM p, range(5) s(k) GROUP BY ALL""")
def cycling_sliding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 million rows of 10,000 keys, a million a second: windows of 2.5 seconds that slide by half a second."""
    rows = readers.cycling_keys(spark, 20_000_000, 10_000, with_millis=1_000_000)
    return windows.sliding_sum(rows, 2500, 500, "key", "n", "ms")


@query("SELECT CAST(p_size AS BIGINT) + 2 AS value, count(*) AS n FROM part GROUP BY 1")
def increment_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("value"))
    return ml.increment_loop(start, 2).result.groupBy("value").agg(F.count("*").alias("n"))
