"""Dialect semantics that DuckDB has no words for."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tideline import codecs
from tideline.charts import Chart
from tideline.engine import Engine
from tideline.errors import QueryError
from tideline.functions.datetime import interval_micros, parse_time, window_micros
from tideline.plans import mapreduce


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    i = F.col("id")
    spark.range(1, 101).select(i.alias("one"), (101 - i).alias("two"), F.when(i % 2 == 0, 20).otherwise(10).cast("bigint").alias("three")).createOrReplaceTempView("testtable")
    spark.range(1, 11).select((11 - i).alias("one"), (2 * (11 - i)).alias("two"), F.when((11 - i) % 2 == 1, 100).otherwise(200).cast("bigint").alias("three")).createOrReplaceTempView("testtable2")
    gap = F.when(i >= 300, 120_000_000).otherwise(0)
    spark.range(500).select(F.timestamp_micros(1415712875216794 + i * 1_000_000 + gap).alias("time"), i.alias("value")).createOrReplaceTempView("timeseries")
    return e


def rows(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


def test_arithmetic(engine):
    assert rows(engine, "select 13 + 2 * 5, 2 ^ 2 ^ 3, 13 * (8 % 3) + -5") == [(23, 256, 21)]
    assert rows(engine, "select -7 / 2, -7 % 3, 7.0 / 2, 1 / 0.0 > 5") == [(-3, -1, 3.5, True)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rows(engine, "select 1 / 0")


def test_groups(engine):
    assert sorted(rows(engine, "SELECT sum(one), three FROM testtable2 GROUP BY three")) == [(25, 100), (30, 200)]
    assert rows(engine, "select sum(one), count(*), mean(one) from testtable2") == [(55, 10, 5.5)]
    assert len(rows(engine, "select count(1) from testtable group by three, two % 8")) == 8
    assert sorted(rows(engine, "select three as t, count(*) as c from testtable group by t having c > 3 and t < 20")) == [(10, 50)]
    assert rows(engine, "select distinct three from testtable order by three") == [(10,), (20,)]


def test_limits_and_names(engine):
    assert rows(engine, "select one from testtable order by one limit 2, 3") == [(3,), (4,), (5,)]
    assert engine.sql("select * from testtable a join testtable2 b on a.one = b.one").columns == ["one", "two", "three", "b.one", "b.two", "b.three"]
    assert engine.sql("select one + 50, testtable.two from testtable").columns == ["one + 50", "two"]


def test_time_window(engine):
    got = sorted(rows(engine, "select time, sum(value) from timeseries group over timewindow(time, 60, 20)"))
    assert len(got) == 29
    assert [got[i][1] for i in (0, 10, 15, 28)] == [1770, 13770, None, 28170]
    by = rows(engine, "select time, k, count(value), count_distinct(value) from (select time, value, value % 2 as k from timeseries) t group over timewindow(time, 60, 20) by k")
    assert len(by) == 58
    empty = rows(engine, "select time, sum(value) from timeseries where value < 0 group over timewindow(time, 60)")
    assert empty == []


def test_times(engine):
    assert rows(engine, 'select date_trunc("10minutes", from_timestamp(1486553343)), date_add(from_timestamp(1486913087), "2 12:30:10", "DAY_SECOND")') == [(dt.datetime(2017, 2, 8, 11, 20), dt.datetime(2017, 2, 15, 3, 54, 57))]
    assert rows(engine, "select date_trunc('1w', from_timestamp(1486553343)), date_add(from_timestamp(1486913087), '1-2', 'YEAR_MONTH')") == [(dt.datetime(2017, 2, 2), dt.datetime(2018, 4, 13, 15, 24, 47))]
    assert parse_time("1451910364") == 1451910364_000000
    assert parse_time("1451910364000") == parse_time("2016-01-04 12:26:04") == 1451910364_000000
    now = dt.datetime(2020, 1, 8, tzinfo=dt.UTC)
    assert parse_time("-7days", now) == parse_time("7days ago", now) == parse_time("2020-01-01")
    assert parse_time("0000-00-00 00:00:00") == 0 and parse_time("x") is None
    assert interval_micros("-1.5", "minute") == -90_000_000
    for bad in ("3fortnights", "", "0d"):
        with pytest.raises(QueryError, match="unknown time window"):
            window_micros(bad)


def test_strings(engine):
    assert rows(engine, "select substring('abc', 0), substring('abc', -5), substring('abc', -3), substring('abc', -2), substring('abc', 9), substring('example', 4)") == [("", "", "abc", "bc", "c", "mple")]
    assert rows(engine, "select fnv32('fnord'), fnv32('fnord  '), fnv32('')") == [(0x6D964EB0, 0x6D964EB0, 2166136261)]
    assert rows(engine, """select 'a' + "b" + 1, 'x' like 'X', 'abc' regex 'b.'""") == [("ab1", False, True)]


@pytest.mark.parametrize(("text", "message"), [
    ("select fnord from testtable", "no such column: 'fnord'"),
    ("select ;", "unexpected"),
    ("select 1 +", "unexpected end of input"),
    ("select nofn(1)", "unknown function: nofn"),
    ("select * from nowhere", "table not found: 'nowhere'"),
    ("use nowhere", "Unknown database nowhere"),
    ("create table t (a decimal)", "invalid type: 'decimal' for column 'a'"),
    ("create table t (a string, A string)", "duplicate column: A"),
    ("draw heatmap; select 1", "invalid chart type"),
])
def test_errors(engine, text, message):
    with pytest.raises(QueryError, match=message.replace("(", r"\(")):
        engine.sql(text)


def test_keyed_table(engine):
    engine.sql_multi("""
        create table pv (time datetime, sid uint64, rid uint64 NOT NULL, url string, m REPEATED RECORD(thing string, temp double), PRIMARY KEY(time, sid, rid), PARTITION KEY(time)) WITH partition_size_hint = 100;
        insert into pv (time, sid, rid, url) values ('2017-01-01T12:00:00Z', 1, 2, '/',), (time_at('2017-01-01T12:00:01Z'), 1, 3, '/x');
        insert into pv (time, sid, rid, url) values ('2017-01-01T12:00:00Z', 1, 2, '/other');
        insert into pv from json '{"time":"2017-01-02T00:00:00Z","sid":9,"rid":1,"m":[{"thing":"a","temp":22.3},{"thing":"b","temp":21.8}]}';
    """)
    assert rows(engine, "select rid, url from pv order by rid") == [(1, None), (2, "/other"), (3, "/x")]
    assert rows(engine, "select m.thing, m.temp from pv where sid = 9") == [("a", 22.3), ("b", 21.8)]
    assert rows(engine, "select rid, sum(m.temp) within record, count(m.temp) within record from pv order by rid") == [(1, 44.1, 2), (2, None, 0), (3, None, 0)]
    engine.tables.compact("pv")
    assert rows(engine, "select count(*) from pv where time = time_at('2017-01-01T12:00:00Z')") == [(1,)]
    engine.sql("alter table pv add column n double, drop url, add column m.x string; alter table pv set property partition_size_hint = 5")
    assert [r[0] for r in rows(engine, "describe pv")] == ["time", "sid", "rid", "m", "n"]
    assert rows(engine, "describe table pv")[2][1:4] == ("UINT64", "NO", "YES")
    assert rows(engine, "select m.x from pv where sid = 9") == [(None,), (None,)]
    assert [r[:2] for r in rows(engine, "describe partitions pv")] == [("2017-01-01", 2), ("2017-01-02", 1)]
    with pytest.raises(QueryError, match="constant"):
        engine.sql("insert into pv (sid) values (rid)")
    with pytest.raises(Exception, match="must not be null"):
        engine.sql("insert into pv (sid) values (1)")
    engine.insert("pv", [{"time": "2018-01-01T00:00:00Z", "sid": 1, "rid": 1, "n": 0.5}])
    assert rows(engine, "select n from pv where rid = 1 and sid = 1") == [(0.5,)]
    assert ("pv", None) in rows(engine, "show tables")
    engine.sql("drop table pv")
    with pytest.raises(QueryError, match="table not found"):
        engine.sql("drop table pv")


def test_partitions_and_compaction(engine):
    """Bounds on the partition key leave other days unread; compaction swaps folders and carries late rows over."""
    engine.sql("create table days (time datetime, k uint64, v double, primary key(time, k), partition key(time))")
    engine.insert_csv("days", [f"2020-01-{d:02d}T{h:02d}:00:00Z,{h},{d}.5" for d in range(1, 11) for h in (0, 23)])
    engine.insert_csv("days", ["2020-01-03T00:00:00Z,0,99"])
    text = "select time, v from days where time >= time_at('2020-01-03') and time_at('2020-01-04T12:00:00Z') > time and k = 0"
    want = [("2020-01-03 00:00:00", 99.0), ("2020-01-04 00:00:00", 4.5)]
    for _ in range(3):
        plan = engine.explain(text)
        assert re.search(r"PartitionFilters: \[[^\]]*_day[^\]]* >= 18264[^\]]*_day[^\]]* <= 18265", plan), plan
        assert [(str(t), v) for t, v in sorted(rows(engine, text))] == want
        assert rows(engine, "select count(*) from days") == [(20,)]
        engine.tables.compact("days")
    assert len(rows(engine, "describe partitions days")) == 10
    assert rows(engine, "select count(*) from days where 'x' = concat('x', '') and v = 4.5 and time = '2020-01-04T00:00:00Z'") == [(1,)]
    assert rows(engine, "select count(*) from testtable where to_string(one) = '7' and three = 10") == [(1,)]
    # A row that is written while the others are being compacted is not lost.
    whole, tables = engine.spark.catalog.refreshTable, engine.tables
    try:
        engine.spark.catalog.refreshTable = lambda name: (setattr(engine.spark.catalog, "refreshTable", whole), tables.append(name, engine.spark.sql("select timestamp'2020-02-01' as time, 7 as k, 7.0 as v")), whole(name))
        tables.compact("days")
    finally:
        engine.spark.catalog.refreshTable = whole
    assert rows(engine, "select count(*) from days") == [(21,)] and rows(engine, "select v from days where k = 7") == [(7.0,)]
    assert "days" in engine.list_tables()
    engine.drop_table("days")


def test_unions(engine):
    two = "select 2 as n union all select 3 as n union all select 1 as n"
    assert rows(engine, f"{two} order by n limit 2") == [(1,), (2,)]
    assert rows(engine, f"({two}) order by n desc limit 1, 1") == [(2,)]
    assert sorted(rows(engine, "select 1 as n union all select 1 as n union select 2 as n union all select 2 as n")) == [(1,), (2,), (2,)]
    assert rows(engine, "select 5 as n union all (select 3 as n union all select 4 as n order by n limit 1) order by n") == [(3,), (5,)]
    with pytest.raises(QueryError, match="after the last part"):
        engine.sql("select 1 as n limit 1 union all select 2 as n")


def test_exact_integers(engine, spark):
    assert rows(engine, "select 3 ^ 39 as a, 2 ^ 0 as b, (0 - 1) ^ 101 as c, 2 ^ (0 - 1) as d, 1 ^ 1000000000 as e") == [(3**39, 1, -1, 0, 1)]
    with pytest.raises(Exception, match="(?i)overflow"):
        rows(engine, "select 2 ^ 64 as a")
    spark.createDataFrame([([2**53, 1, None],), ([],), (None,)], "xs array<bigint>").createOrReplaceTempView("wide")
    assert rows(engine, "select sum(xs) within record from wide") == [(2**53 + 1,), (None,), (None,)]


def test_windows_cover_all(engine, spark):
    """The last rows lie in a window, HAVING is heeded, and several tables share a grid."""
    spark.createDataFrame([(0, 1), (90, 2), (180, 4)], "t bigint, v bigint").createOrReplaceTempView("w1")
    spark.createDataFrame([(30, 10), (200, 20)], "t bigint, v bigint").createOrReplaceTempView("w2")
    assert [r[1] for r in sorted(rows(engine, "select t as time, sum(v) as s from w1 group over timewindow(t, 60)"))] == [1, 2, None, 4]
    assert sorted(rows(engine, "select sum(v) as s from w1 group over timewindow(t, 120, 60) having sum(v) > 2")) == [(3,), (4,)]
    got = sorted(rows(engine, "select a.t as time, sum(a.v) as x, sum(b.v) as y from w1 a, w2 b group over timewindow(a.t, 60)"))
    assert [r[1:] for r in got] == [(1, 10), (2, None), (None, None), (4, 20)]
    assert [r[1:] for r in rows(engine, "select a.t as time, sum(a.v) as x, sum(b.v) as y from w1 a, w2 b group over timewindow(a.t, 60) having sum(b.v) > 10")] == [(4, 20)]


def test_import_csv(engine, tmp_path):
    (tmp_path / "c.csv").write_text("id;name\n1;a\n2;'b;c'\n")
    engine.sql(f"""import table things from "csv://{tmp_path}/c.csv?headers=true&col_sep=%3B&quote_char='" """)
    assert rows(engine, "select * from things order by id") == [("1", "a"), ("2", "b;c")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    engine.sql(f"import table bad from 'csv://{tmp_path}/bad.csv'")
    with pytest.raises(Exception, match="(?i)malformed"):
        rows(engine, "select * from bad")


def test_map_reduce(engine):
    m = engine.map_table("testtable", lambda r: [(r["three"], r["one"])], ["one", "three"])
    total = lambda k, vs: [(k, sum(map(int, vs)))]
    assert sorted(engine.mapreduce.download_results(engine.reduce(m, total, shards=3, combine_fn=total))) == ['{"key": "10", "value": "2500"}', '{"key": "20", "value": "2550"}']
    engine.sql("create table sums (k string, v uint64, primary key(k))")
    engine.mapreduce.save_to_table(engine.reduce(m, lambda k, vs: [(k, {"k": k, "v": len(list(vs))})]), "sums")
    assert rows(engine, "select * from sums order by k") == [("10", 50), ("20", 50)]
    engine.sql("drop table sums")
    # Null values of a join add nothing; a combiner that makes no room passes its pairs on.
    some = engine.map_table("testtable", lambda r: [(r["three"], None), (r["three"], {"a": 1})], ["three"])
    more = engine.map_table("testtable", lambda r: [(r["three"], {"b": r["three"]})], ["three"])
    assert sorted(engine.mapreduce.download_results(engine.mapreduce.join([some, more]), lambda k, v: f"{k} {v}")) == ['10 {"a": 1, "b": 10}', '20 {"a": 1, "b": 20}']


def test_kept_pairs(engine):
    m = engine.mapreduce
    make = lambda r: [(r["three"], r["one"])]
    job = m.map_table("testtable", make, keep=True)
    assert m.map_table("testtable", make, keep=True) is job and m.map_table("testtable", make, ["one", "three"], keep=True) is not job
    assert job.pairs.storageLevel.useMemory
    m.forget()
    assert m.map_table("testtable", make, keep=True) is not job
    m.forget()
    with pytest.raises(QueryError, match="named table"):
        m.map_table(engine.spark.range(1), make, keep=True)


def test_combiner_bounds(monkeypatch):
    monkeypatch.setattr(mapreduce, "COMBINE_PAIRS", 100)
    total = lambda k, vs: [(k, sum(map(int, vs)))]
    got = list(mapreduce._combined(iter([(i % 7, 1) for i in range(1000)] + [(i, 2) for i in range(100, 200)]), total))
    sums: dict = {}
    for k, v in got:
        sums[k] = sums.get(k, 0) + int(v)
    assert sums == {str(i): 143 if i < 6 else 142 for i in range(7)} | {str(i): 2 for i in range(100, 200)} and len(got) < 300


def test_functions_of_users(engine):
    engine.register_function("twice", lambda x: x * 2)
    engine.register_aggregate("spread", lambda x: F.max(x) - F.min(x))
    assert rows(engine, "select twice(spread(one)) from testtable") == [(198,)]


def test_charts(engine):
    (chart,) = engine.sql_multi("draw linechart title 'a<b' axis bottom axis left ticks off grid xdomain 0, 50; select 'd' as series, one as x, two as y, 'circle' as point_style from testtable; draw barchart stacked legend top right inside title 'l' orientation horizontal; select three as series, one as x, two as y from testtable2")
    assert isinstance(chart, Chart)
    svg = chart.svg()
    assert svg.count("<polyline") == 1 and svg.count("<rect") == 2 + 10 + 2 and "a&lt;b" in svg and svg.count("<circle") == 100
    with pytest.raises(QueryError, match="no 'y' column"):
        engine.sql("draw pointchart; select one as x from testtable")


def test_codecs(engine):
    df = engine.sql("select one, if(one = 1, 'é', to_nil(1)) as s, from_timestamp(one) as t from testtable order by one limit 2")
    table = [["1", "é", "1970-01-01 00:00:01"], ["2", "NULL", "1970-01-01 00:00:02"]]
    assert list(codecs.rows(df)) == table
    assert codecs.from_binary(b"".join(codecs.to_binary(df))) == (["one", "s", "t"], table)
    assert '"type": "table"' in codecs.to_json(df) and len(list(codecs.to_json_sse(df))) == 3
    assert codecs.to_ascii(df).splitlines()[3] == "| 1   | é    | 1970-01-01 00:00:01 |"


def test_plans(engine, spark, data):
    """Filters and columns reach the scan; equi-joins hash or merge; sort and limit fuse."""
    from tideline.session import register

    register(spark, data)
    plan = engine.explain("select l_orderkey from lineitem where l_quantity > 45")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    plan = engine.explain("select event_id from events where ts < time_at('2024-01-10')")
    assert "LessThan(ts" in plan
    plan = engine.explain("select c.c_name, o.o_orderkey from customer c, orders o where c.c_custkey = o.o_custkey")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "TakeOrderedAndProject" in engine.explain("select o_orderkey from orders order by o_totalprice desc limit 3")


def test_streaming(engine, spark, data, tmp_path):
    from tideline.session import load
    from tideline.streaming import tumbling, upsert_stream

    events = load(spark, data, "events")
    (tmp_path / "in").mkdir()
    events.select("event_id", "ts", "value").repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id bigint, ts timestamp, value double").parquet(f"{tmp_path}/in")
    engine.sql("create table ev (event_id uint64, ts datetime, value double, primary key(event_id))")
    for n in ("a", "b"):  # the same rows twice: upserts leave the count
        upsert_stream(engine, stream, "ev", f"{tmp_path}/{n}", once=True).awaitTermination()
    assert rows(engine, "select count(*) from ev") == [(events.count(),)]
    q = tumbling(stream, "ts", "1 day", [F.count("*").alias("n")]).writeStream.outputMode("append").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days").count() > 20
    engine.sql("drop table ev")
