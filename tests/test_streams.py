import contextlib
import json
import socket
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import relational
from sparkloom.plans import graph, ml
from sparkloom.sinks import writers
from sparkloom.sources import readers
from sparkloom.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()))


def write_parts(folder, parts):
    """A file a part, in order of their times, so that each is a micro-batch of its own."""
    folder.mkdir()
    for k, part in enumerate(parts):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps(x) for x in part))
        stamp = 1_700_000_000 + k
        __import__("os").utime(path, (stamp, stamp))
    return str(folder)


def run_to_memory(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


@pytest.mark.parametrize("slack,kept", [("3 seconds", 4), ("0 seconds", 3), ("3 milliseconds", 3)])
def test_late_rows(spark, tmp_path, slack, kept):
    """A row of the first window comes when the watermark of the micro-batch before has passed it, but for a slack of three seconds."""
    parts = [[{"ts_ms": t, "word": "a"}] for t in (1_000, 2_000, 11_500, 12_000, 3_000, 30_000, 60_000)]
    name = "late_" + slack.replace(" ", "_")
    stream = windows.event_time(readers.file_stream(spark, write_parts(tmp_path / "in", parts), "ts_ms long, word string", files_per_batch=1), "ts_ms", slack, millis=True)
    got = run_to_memory(windows.tumbling(stream, "10 seconds", ["word"], F.count("*").alias("n")), name)
    first = got.where("window_start < timestamp_seconds(10)").first()
    assert first.n == kept - 1


def test_punctuated_watermark_of_three_milliseconds(spark, tmp_path):
    """A window closes as soon as a later event is over three milliseconds beyond its end."""
    for slack, last, closed in (("3 milliseconds", 10_004, 1), ("3 milliseconds", 10_002, 0), ("0 seconds", 10_001, 1)):
        name = f"mark_{slack[0]}_{last}"
        path = write_parts(tmp_path / name, [[{"ts_ms": 9_999, "word": "a"}], [{"ts_ms": last, "word": "a"}], [{"ts_ms": last, "word": "b"}]])
        stream = windows.event_time(readers.file_stream(spark, path, "ts_ms long, word string", files_per_batch=1), "ts_ms", slack, millis=True)
        assert run_to_memory(windows.tumbling(stream, "10 seconds", [], F.count("*").alias("n")), name).count() == closed


def test_processing_time_windows(spark, tmp_path):
    path = write_parts(tmp_path / "in", [[{"word": w}] for w in "aabab"])
    for name, form in (("tumble", lambda d: windows.tumbling(d, "1 day", ["word"], F.count("*").alias("n"))), ("slide", lambda d: windows.sliding(d, "2 days", "1 day", ["word"], F.count("*").alias("n")))):
        stream = windows.processing_time(readers.file_stream(spark, path, "word string", files_per_batch=1))
        got = run_to_memory(form(stream), f"processing_{name}", "complete")
        now = time.time()
        assert got.where("window_end < current_timestamp() - interval 1 day").isEmpty() and all(r.window_start.timestamp() <= now for r in got.collect())
        totals = {r.word: r.n for r in got.groupBy("word").agg(F.sum("n").alias("n")).collect()}
        assert totals == ({"a": 3, "b": 2} if name == "tumble" else {"a": 6, "b": 4})


@contextlib.contextmanager
def server(answer):
    """A TCP server that hands each connection to ``answer``."""
    listener = socket.create_server(("127.0.0.1", 0))

    def serve():
        with contextlib.suppress(OSError):
            while True:
                threading.Thread(target=answer, args=(listener.accept()[0],), daemon=True).start()

    threading.Thread(target=serve, daemon=True).start()
    yield listener.getsockname()[1]
    listener.close()


def test_socket_source(spark):
    def answer(connection):
        connection.sendall(b"to be or\nnot to be\n")
        time.sleep(20)

    with server(answer) as port:
        query = readers.socket_lines(spark, port, "127.0.0.1").writeStream.format("memory").queryName("socket_in").start()
        until = time.time() + 15
        while time.time() < until and spark.table("socket_in").count() < 2:
            time.sleep(0.2)
        query.stop()
        assert rows(spark.table("socket_in")) == [("not to be",), ("to be or",)]


@pytest.mark.parametrize("one", [True, False])
def test_socket_sink(spark, tmp_path, one):
    got = []

    def answer(connection):
        with connection.makefile() as lines:
            got.extend(lines)

    path = write_parts(tmp_path / "in", [[{"k": k, "w": "x"} for k in range(10)]])
    with server(answer) as port:
        writers.stream_to_socket(readers.file_stream(spark, path, "k long, w string"), "127.0.0.1", port, "append", one_connection=one, availableNow=True).awaitTermination()
        time.sleep(0.5)
    sent = [x.rstrip("\n").split(" : ") for x in got]
    assert sorted(b for _, b in sent) == sorted(f"({k},x)" for k in range(10)) and all(a.isdigit() for a, _ in sent)
    assert not one or [b for _, b in sent] == [f"({k},x)" for k in range(10)]


def test_socket_writer_connects_again():
    got, first = [], threading.Event()

    def answer(connection):
        if not first.is_set():
            first.set()
            connection.close()
            return
        with connection.makefile() as lines:
            got.extend(lines)

    with server(answer) as port:
        writer = writers.SocketWriter("127.0.0.1", port)
        writer.open(0, 0)
        first.wait(5)
        for k in range(20):
            writer.process((k,))
            time.sleep(0.02)
        writer.close(None)
        time.sleep(0.3)
    assert [x.split(" : ")[1].strip() for x in got][-10:] == [f"({k})" for k in range(10, 20)]
    with pytest.raises(OSError):
        writers.SocketWriter("127.0.0.1", 1, tries=2, wait=0.01).open(0, 0)


def test_cycling_keys_stream(spark):
    """A parallel bounded source; its sliding sums are the same by panes and by windows of the batch rows."""
    stream = readers.cycling_keys_stream(spark, rows_per_batch=500, keys=10, instances=4, n=1_000)
    query = stream.writeStream.format("memory").queryName("cycling").start()
    until = time.time() + 20
    while time.time() < until and spark.table("cycling").count() < 1_000:
        time.sleep(0.2)
    query.stop()
    got = spark.table("cycling")
    assert got.count() == 1_000 and got.groupBy("key").count().where("count <> 100").isEmpty()
    batch = readers.cycling_keys(spark, 1_000, 10, with_millis=200)
    panes = windows.sliding_sum(batch, 2500, 500, "key", "n", "ms")
    plain = windows.sliding(batch.withColumn("ts", F.timestamp_millis("ms")), "2500 milliseconds", "500 milliseconds", ["key"], F.sum("n").alias("total"))
    assert rows(panes) == rows(plain.select("key", F.unix_millis("window_start").alias("s"), "total"))


def test_feedback_loop_on_a_stream(spark, tmp_path):
    pairs = [(1, 1), (20, 30), (49, 49), (0, 0)]
    path = write_parts(tmp_path / "in", [[{"line": f"({a},{b})"} for a, b in pairs]])
    stream = ml.fibonacci_steps(readers.parsed_pairs(readers.file_stream(spark, path, "line string")))
    assert rows(run_to_memory(stream, "feedback")) == sorted(zip((1, 20, 49, 0), (1, 30, 49, 0), (10, 3, 2, 64), strict=True))


def test_dashboards_side_by_side_on_streams(spark, tmp_path):
    """Two dashboards don't share a view; a flush interval is a trigger."""
    parts = [[{"ts_ms": 1_000 * k, "status": (200, 404, 500)[k % 3], "restime": k}] for k in range(6)]
    log = windows.event_time(readers.file_stream(spark, write_parts(tmp_path / "in", parts), "ts_ms long, status int, restime int"), "ts_ms", "0 seconds", millis=True)
    a, b = windows.dashboard(log, "2 seconds"), windows.dashboard(log.where("status <> 500"), "2 seconds")
    assert sum(r.pv for r in run_to_memory(a, "board_a", "complete").collect()) == 4
    assert sum(r.pv for r in run_to_memory(b, "board_b", "complete").collect()) == 2
    query = log.writeStream.format("memory").queryName("flushed").trigger(processingTime="100 milliseconds").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("flushed").count() == 6


def test_window_ends_are_printed(spark, tmp_path, capfd):
    parts = [[{"ts_ms": t, "word": "a"}] for t in (1_000, 2_000, 25_000, 26_000)]
    stream = windows.event_time(readers.file_stream(spark, write_parts(tmp_path / "in", parts), "ts_ms long, word string", files_per_batch=1), "ts_ms", "0 seconds", millis=True)
    writers.show_window_ends(windows.tumbling(stream, "10 seconds", ["word"], F.count("*").alias("n")), availableNow=True).awaitTermination()
    writers.show(spark.range(1))
    assert "1970-01-01 00:00:09.999 a 2" in capfd.readouterr().out


def test_full_windows_and_parallelism(spark):
    df = spark.createDataFrame([(k * 1000, "ab"[k % 2], k) for k in range(20)], "ms long, word string, v int").withColumn("ts", F.timestamp_millis("ms"))
    median = windows.full_windows(df, "10 seconds", ["word"], lambda p: pd.DataFrame({"word": [p.word.iloc[0]], "median": [float(p.v.median())]}), "word string, median double")
    assert rows(median) == [("a", 4.0), ("a", 14.0), ("b", 5.0), ("b", 15.0)]
    spread = windows.with_parallelism(df, 3, "word")
    assert spread.rdd.getNumPartitions() == 3 and spread.groupBy("word", F.spark_partition_id().alias("p")).count().count() == 2


def test_co_group(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, 5), (2, 6), (3, 7)], "k int, w int")
    assert rows(relational.co_group_right(left, right, "k")) == [(2, 5), (2, 6), (3, 7)]
    sizes = relational.co_group(left, right, "k", lambda x, y: pd.DataFrame({"k": [int((x if len(x) else y).k.iloc[0])], "l": [len(x)], "r": [len(y)]}), "k int, l int, r int")
    assert rows(sizes) == [(1, 1, 0), (2, 1, 2), (3, 0, 1)]


def test_page_rank_stops_by_epsilon(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 4) for k in range(4)] + [(0, 2)], "src long, dst long")
    pages = spark.range(4).withColumnRenamed("id", "page")
    soon, late = (graph.page_rank(pages, edges, steps=200, epsilon=e) for e in (1e-2, 1e-9))
    assert soon.converged and late.converged and 1 < soon.steps < late.steps < 200
    last = dict(rows(late.result))
    after = graph.page_rank(pages, edges, steps=late.steps + 1, epsilon=None).result
    assert dict(rows(after)) == {k: pytest.approx(v, abs=1e-8) for k, v in last.items()}
    assert not graph.page_rank(pages, edges, steps=1, epsilon=1e-9).converged


def test_running_count_over_ranges(spark):
    """A key with most of the rows is counted in many ranges."""
    df = spark.range(5_000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, None).otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("key"), "id", F.lit(1).alias("_n"))
    got = relational.running_count(df, "key", ["id"], partitions=9)
    seen: dict = {}
    want = []
    for key, i, x in rows(df.orderBy("id").select("id", "key", "_n").select("key", "id", "_n").withColumn("key", F.coalesce("key", F.lit("-")))):
        seen[key] = seen.get(key, 0) + 1
        want.append((key, i, x, seen[key]))
    assert rows(got.withColumn("key", F.coalesce("key", F.lit("-")))) == sorted(want)


def test_components_and_closure_of_long_chains(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    v = spark.createDataFrame([(k,) for k in (*range(61), 100, 101, 500)], "vertex long")
    found = graph.contracted_components(v, chain)
    assert found.converged and found.steps < 12
    assert dict(rows(found.result)) == {k: 0 for k in range(61)} | {100: 100, 101: 100, 500: 500}
    slow, fast = graph.closure(chain, 100), graph.closure(chain, 100, doubling=True)
    assert slow.converged and fast.converged and fast.steps < 9 and rows(slow.result) == rows(fast.result)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_plans(spark):
    """Graph queries work their edges out once; a year reaches the scan."""
    from sparkloom.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert scans(QUERIES["triangles"](spark, sf)) == 0 and scans(QUERIES["pagerank"](spark, sf)) == 0
    plan = QUERIES["year_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_sources_and_client_sinks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,a;2,b;3,c")
    assert rows(readers.delimited(spark, str(tmp_path / "x.csv"), "k int, v string", line_sep=";")) == [(1, "a"), (2, "b"), (3, "c")]
    assert [tuple(r) for r in writers.to_list(readers.elements(spark, [(1, "x")], "a int, b string"))] == [(1, "x")]
    assert rows(readers.parsed_pairs(spark.createDataFrame([("(3,40)",)], "line string"))) == [(3, 40)]
