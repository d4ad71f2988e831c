import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import relational, words
from sparkloom.plans import graph, iterate, ml
from sparkloom.sinks import writers
from sparkloom.sources import readers, weblog
from sparkloom.streaming import running, windows


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_java_split_and_trim(spark):
    df = spark.createDataFrame([(",a,,",), ("",), (",,",), ("a b  c ",)], "t string")
    assert [r[0] for r in df.select(text.java_split(F.col("t"), ",")).collect()] == [["", "a"], [""], [], ["a b  c "]]
    assert [r[0] for r in df.select(text.whitespace_tokens(F.col("t"))).collect()][3] == ["a", "b", "", "c"]
    blank = spark.createDataFrame([(" \t\n",), (" ",), (None,), ("",), (" x ",)], "t string").select(text.is_blank(F.col("t")))
    assert [r[0] for r in blank.collect()] == [True, False, True, True, False]


def test_word_counts(spark):
    df = spark.createDataFrame([("To be, or not to be",), ("",), (".lead sleeping",), (None,)], "line string")
    assert dict(rows(words.word_count(df))) == {"to": 2, "be": 2, "or": 1, "not": 1, "lead": 1, "sleeping": 1}
    assert dict(rows(words.routed_word_count(df))) == {"to": 2, "be": 2, "or": 1, "not": 1, "lead": 1, "rejectWordCount": 1, "error": 2}
    assert rows(words.rejected_words(df)) == [("rejected:sleeping",)]


def test_web_log(spark):
    docs = spark.createDataFrame([("a", "x editors y oscillations z"), ("b", "editors at start oscillations z"), ("c", "q editors oscillations w"), ("d", "r editors oscillations w")], "url string, contents string")
    ranks = spark.createDataFrame([(50, "a", 1), (60, "a", 2), (90, "b", 3), (40, "c", 4), (41, "d", 5)], "rank int, url string, avg_duration int")
    visits = spark.createDataFrame([("d", "2007-1-1"), ("d", "2007-2-2"), ("a", "2006-3-9")], "url string, visit_date string")
    assert rows(relational.web_log(docs, ranks, visits, [" editors ", " oscillations "], 40, 2007)) == [(50, "a", 1), (60, "a", 2)]


def test_blank_fields_with_side_channel(spark):
    df = spark.createDataFrame([("John", "a", "x"), (None, "b", ""), ("Tom", "c", "  "), ("Amy", "d", "y")], "f0 string, f1 string, f2 string")
    kept, seen = relational.whole_rows_observed(df, df.columns)
    assert [r.f0 for r in kept.collect()] == ["John", "Amy"]
    assert seen.get == {"f0": 1, "f1": 0, "f2": 2}
    assert rows(relational.blank_counts(df, df.columns)) == [("f0", 1), ("f1", 0), ("f2", 2)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 5), (3, 4), (3, 5), (3, 7), (3, 8), (5, 6), (7, 8)], "src long, dst long")
    assert rows(graph.triangles(e)) == [(1, 2, 3), (1, 2, 5), (1, 3, 4), (1, 3, 5), (2, 3, 5), (3, 7, 8)]
    assert rows(graph.triangles(e, as_written=True)) == [(1, 2, 3), (2, 3, 5)]
    v = spark.range(1, 10).withColumnRenamed("id", "vertex")
    found = graph.components(v, e)
    assert found.converged and dict(rows(found.result)) == {k: (1 if k < 9 else 9) for k in range(1, 10)}
    done = graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long"))
    assert done.converged and rows(done.result) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    cut = graph.closure(spark.createDataFrame([(k, k + 1) for k in range(9)], "src long, dst long"), steps=2)
    assert not cut.converged and cut.result.count() == 9 + 8 + 7


def test_page_rank(spark):
    random.seed(1)
    links = sorted({(a, random.randrange(8)) for a in range(8) for _ in range(3)} | {(k, (k + 1) % 8) for k in range(8)})
    got = dict(rows(graph.page_rank(spark.range(8).withColumnRenamed("id", "page"), spark.createDataFrame(links, "src long, dst long"), epsilon=None).result))
    rank, degree = dict.fromkeys(range(8), 1 / 8), Counter(a for a, _ in links)
    for _ in range(10):
        rank = {p: 0.15 / 8 + 0.85 * sum(rank[a] / degree[a] for a, b in links if b == p) for p in range(8)}
    assert got == pytest.approx(rank)


def test_models(spark):
    points = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (10.0, 10.0), (10.0, 12.0)], "x double, y double")
    assert ml.k_means(points, [(1, 0.0, 0.0), (2, 9.0, 9.0), (3, 500.0, 500.0)]) == [(1, 0.0, 1.0), (2, 10.0, 11.0)]
    theta, data = [0.0, 0.0], [(0.5, 1.0), (1.0, 2.5), (2.0, 3.0)]
    for _ in range(10):
        e = [theta[0] + theta[1] * x - y for x, y in data]
        theta = [theta[0] - 0.01 * sum(e) / 3, theta[1] - 0.01 * sum(a * x for a, (x, _) in zip(e, data, strict=True)) / 3]
    assert ml.linear_regression(spark.createDataFrame(data, "x double, y double")) == pytest.approx(tuple(theta))
    pairs = spark.createDataFrame([(1, 1), (20, 30), (49, 49), (0, 0)], "a int, b int")
    assert [r.n for r in ml.fibonacci_steps(pairs).collect()] == [10, 3, 2, 64]
    assert rows(ml.increment_loop(spark.range(1, 6).withColumnRenamed("id", "value")).result) == [(k,) for k in range(3, 8)]
    done, last = ml.counting_loop(spark.createDataFrame([(45,), (48,)], "value long"))
    assert done.steps == 5 and rows(done.result) == [(50,), (53,)] and last.count() == 2
    assert 3 < ml.pi_estimate(ml.random_points(spark.range(20_000)), F.col("x"), F.col("y")).first()[0] < 3.3


def test_delta_stops(spark):
    e = spark.createDataFrame([], "src long, dst long")
    v = spark.createDataFrame([(5,)], "vertex long")
    assert graph.components(v, e).converged
    assert iterate.bulk(v, lambda d: d, 3).steps == 3


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.write_delimited(df, str(tmp_path / "c"), "|")
    assert rows(readers.delimited(spark, str(tmp_path / "c"), "k int, v string", "|", columns=["v"])) == [("a",), ("b",)]
    writers.write_text(df, str(tmp_path / "t"))
    writers.write_text(df, str(tmp_path / "t"), mode="overwrite")
    assert rows(readers.text_lines(spark, str(tmp_path / "t"))) == [("1,a",), ("2,b",)]
    weblog.write_files(weblog.documents(spark, 20), str(tmp_path / "d"))
    back = readers.delimited(spark, str(tmp_path / "d"), "url string, contents string", "|").collect()
    assert len(back) == 20 and all(10 <= len(r.contents.split()) <= 49 for r in back)
    assert weblog.ranks(spark, 100).where("rank not between 0 and 99 or avg_duration not between 0 and 58").isEmpty()
    assert weblog.visits(spark, 50, 5).where(~F.col("visit_date").rlike(r"^200\d-\d{1,2}-\d{1,2}$")).isEmpty()


def test_sources(spark):
    log = readers.request_log(spark.range(500).select(F.col("id").alias("value"), F.current_timestamp().alias("timestamp")))
    assert {r.status for r in log.select("status").distinct().collect()} == {200, 404, 500, 501}
    assert readers.cycling_keys(spark, 100, 10, 2).groupBy("key").count().where("count <> 20").isEmpty()
    assert readers.random_pairs(spark).where("a not between 1 and 49 or b not between 1 and 49").isEmpty()
    assert [r[0] for r in readers.number_sequence(spark, 1, 3).collect()] == [1, 2, 3]


def write_events(tmp_path, events, name="in"):
    folder = tmp_path / name
    folder.mkdir()
    for k, part in enumerate((events[::2], events[1::2])):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"ts_ms": t, "word": w}) for t, w in part))
    return str(folder)


def test_stream_equals_batch(spark, tmp_path):
    random.seed(3)
    events = [(1_700_000_000_000 + k * 400 + random.randrange(300), random.choice("abc")) for k in range(300)]
    path = write_events(tmp_path, events)
    schema = "ts_ms long, word string"
    agg = F.count("*").alias("n")
    forms = {
        "tumbling": lambda d: windows.tumbling(d, "10 seconds", ["word"], agg),
        "sliding": lambda d: windows.sliding(d, "10 seconds", "5 seconds", ["word"], agg),
        "session": lambda d: windows.session(d, "2 seconds", ["word"], agg),
    }
    for name, form in forms.items():
        stream = form(windows.event_time(readers.file_stream(spark, path, schema), "ts_ms", "3 seconds", millis=True))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = set(rows(spark.table(name)))
        batch = set(rows(form(windows.event_time(spark.read.schema(schema).json(path), "ts_ms", millis=True))))
        end = max(t for t, _ in events) / 1000 - 3
        assert got == {r for r in batch if r[1].timestamp() <= end}, name


def test_running_updates_and_side_outputs(spark, tmp_path):
    path = write_events(tmp_path, [(k, "ab"[k % 2]) for k in range(10)])
    q = running.running_updates(readers.file_stream(spark, path, "ts_ms long, word string")).writeStream.format("memory").queryName("run").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("run")) == [(w, n) for w in "ab" for n in range(1, 6)]
    seen = {"main": 0, "side": 0}

    def count(name, wanted):
        def sink(batch, epoch):
            seen[name] += batch.where(wanted).count()

        return sink

    stream = readers.file_stream(spark, path, "ts_ms long, word string")
    writers.stream_to_many(stream, [count("main", "true"), count("side", "word = 'a'")], availableNow=True).awaitTermination()
    assert seen == {"main": 10, "side": 5}
    writers.stream_to_csv(stream, str(tmp_path / "o"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.option("sep", "|").csv(str(tmp_path / "o")).count() == 10


def test_log_windows(spark):
    lines = spark.createDataFrame([(f"u{k},1,{1_700_000_000_000 + k * 100},{(200, 404, 500)[k % 3]},{k * 10}",) for k in range(12)], "line string")
    log = windows.event_time(windows.parse_log(lines), "ts_ms", millis=True)
    assert sum(r.n for r in windows.status_counts(log).collect()) == 12
    share = windows.slow_share(log).collect()
    assert [(r.slow_percent, r.fast_percent, r.one) for r in share] == [(50, 50, 1)]
    board = windows.dashboard(log).collect()
    assert sum(r.pv for r in board) == 8 and all(0 <= r.error_rate <= 1 for r in board)
    parsed = windows.parse_event(spark.createDataFrame([("1700000000000 hi",)], "line string"))
    assert rows(parsed) == [(1_700_000_000_000, "hi")]


def test_custom_source(spark):
    from sparkloom.sources.custom import RequestLogSource

    spark.dataSource.register(RequestLogSource)
    q = windows.parse_log(spark.readStream.format("request_log").option("rowsPerBatch", 20).load()).writeStream.format("memory").queryName("custom").trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("custom").collect()
    assert got and all(r.status in (200, 404, 500, 501) and 0 <= r.userid < 100 and 0 <= r.restime < 200 for r in got)


def _triangles(edges):
    near = {}
    for a, b in {(min(e), max(e)) for e in edges if None not in e and e[0] != e[1]}:
        near.setdefault(a, set()).add(b)
    return sorted((a, b, c) for a, out in near.items() for b in out for c in out & near.get(b, set()))


def test_triangles_in_cells(spark, monkeypatch):
    """Open pairs are no rows of any join; hubs, repeats, loops, nulls and ids of every kind, whatever the number of cells."""
    from sparkloom.plans import cells

    random.seed(4)
    plain = [(random.randrange(-30, 30), random.randrange(-30, 30)) for _ in range(400)]
    hub = [(-40, k) for k in range(-39, 900)] + [(k, 901) for k in range(0, 900)] + [(901, -40)]  # the smallest and the largest
    edges = plain + hub + [(b, a) for a, b in plain[:50]] + [(5, 5), (None, 3), (3, None)]
    want = _triangles(edges)
    e = spark.createDataFrame(edges, "src long, dst long")
    assert graph._hubs(graph.ordered_edges(e), len(edges)).count() >= 2
    assert "Join" not in graph.triangles(spark.createDataFrame(plain, "src long, dst long"))._jdf.queryExecution().executedPlan().toString()
    assert rows(graph.triangles(e)) == want
    for wide in (True, False):
        assert rows(cells.closed(graph.ordered_edges(e).toDF("low", "high"), 2000, wide, lambda n: (4, 3))) == want
    for name, value in (("HELD", 40), ("PASSED", 150), ("CHUNK", 7), ("MARKS", 64), ("OPENED", 3)):
        monkeypatch.setattr(cells, name, value)
    colours, slices = cells.cells_of(2000)
    assert colours == 8 and slices == 2
    low, high = zip(*sorted((min(x), max(x)) for x in edges if None not in x and x[0] != x[1]), strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["low", "high"])
    dealt = [r for out in cells._dealt((batch.slice(k, 50) for k in range(0, len(low), 50)), colours, slices, pa.int32()) for r in out.to_pylist()]
    dealt.sort(key=lambda r: (r["cell"], not r["held"]))
    sent = pa.RecordBatch.from_pylist(dealt, schema=pa.schema([("cell", pa.int32()), ("held", pa.bool_()), ("lists", pa.binary())]))
    found = [tuple(r.values()) for out in cells._closed((sent.slice(k, 30) for k in range(0, len(dealt), 30)), colours, slices) for r in out.to_pylist()]
    assert sorted(found) == want
    wide = spark.createDataFrame([(a * 2**50, b * 2**50) for a, b in plain], "src long, dst long")
    assert rows(graph.triangles(wide)) == [tuple(x * 2**50 for x in t) for t in _triangles(plain)]
    small = graph.triangles(spark.createDataFrame(edges, "src int, dst int"))
    assert rows(small) == want and small.dtypes == [("v1", "int"), ("v2", "int"), ("v3", "int")]
    assert rows(graph.triangles(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string"))) == [("a", "b", "c")]
    assert rows(graph.triangles(e.limit(0))) == []
    monkeypatch.setattr(graph, "COUNTED", 300)  # degrees of a part of the edges
    assert rows(graph.triangles(e)) == want
