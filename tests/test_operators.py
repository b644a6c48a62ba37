"""Orders with gaps, files, tables, transactions, patterns and graphs where a registered query does not reach."""

import pytest
from pyspark.sql import functions as F

from rillstone.functions import aggregates as A
from rillstone.operators import matrices, tables
from rillstone.operators.cep import Nfa, run_matches, state
from rillstone.operators.flow import Flow
from rillstone.plans import usecases
from rillstone.plans.catalogue import QUERIES
from rillstone.sources.context import Context


@pytest.fixture
def files(tmp_path):
    for name, lines in (("a.txt", "0|5\n1|6\n2|7\n3|8\n"), ("b.txt", "4|9\n5|1\n6|2\n7|3\n")):
        (tmp_path / name).write_text(lines)
    return str(tmp_path)


def test_row_windows_over_files(spark, files):
    f = Context(spark).stream_from_csv(files, "k int, v int", "|")
    got = f.sliding_window("row", 3).aggregate(A.count(name="n")).df.orderBy("_seq").collect()
    assert [r.n for r in got] == [1, 2, 3, 3, 3, 3, 3, 3]
    got = f.where("k % 2 = 0").batch(2).df.collect()
    assert sorted(len(r.batch) for r in got) == [2, 2]
    assert Context(spark).stream_from_memory(files, "k int, v int", "|").df.agg(F.sum("v")).first()[0] == 41


def test_equal_times_count_only_what_came_first(spark):
    f = Context(spark).stream_from_generator(4, t=F.timestamp_seconds(F.lit(7))).assign_timestamps("t").sliding_window("range", 5).aggregate(A.count(name="n"))
    assert [r.n for r in f.df.orderBy("_seq").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("size", [10, 50_000])
def test_blocks_make_no_difference(spark, size):
    """Windows that reach over block borders, with a count that a single order gives."""
    f = Context(spark).stream_from_generator(40_000, k=F.col("id") % 3, v=F.col("id"))
    got = f.sliding_window("row", size).aggregate(A.sum_("v", "s"), A.count(name="n")).df
    first = F.greatest(F.lit(0), F.col("_seq") - size + 1)
    assert got.filter((F.col("n") != F.col("_seq") - first + 1) | (F.col("s") != (F.col("_seq") + first) * F.col("n") / 2)).count() == 0
    total = f.aggregate(A.sum_("v", "s"), A.avg("v", "a"), A.min_("v", "lo"), A.least_recent("v", "old"), every=1000).df
    assert total.count() == 40
    assert total.filter((F.col("s") != F.col("_seq") * (F.col("_seq") + 1) / 2) | (F.col("a") != F.col("_seq") / 2) | (F.col("lo") != 0) | (F.col("old") != 0)).count() == 0


@pytest.mark.parametrize("name", ["sliding_row_sum", "sliding_row_minmax", "sliding_row_median", "sliding_row_dcount", "changelog_sliding_row", "sliding_row_global_by_key", "sliding_range_global"])
def test_no_task_sees_all_rows(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # The only single task is the one that numbers partitions, over a row for each; the change log joins the numbered rows with themselves.
    assert plan.count("Exchange SinglePartition") <= (2 if name == "changelog_sliding_row" else 1)


def test_join_with_a_window_on_one_side(spark):
    f = Context(spark).stream_from_generator(6, k=F.col("id") % 2, v=F.col("id"))
    got = f.key_by("k").sliding_window("row", 2).join(f.key_by("k")).df
    # A left row lives for two arrivals: it meets the rights of its key up to then, and all that came before it.
    assert got.count() == sum((a - b) % 2 == 0 and b < a + 2 for a in range(6) for b in range(6))


def test_observers_and_live_sql(spark):
    c = Context(spark)
    t = c.create_table("t", spark.createDataFrame([(1, 1), (2, 2)], "k long, v long"), "k")
    now, then = [], []
    t.register_observer(lambda op, rows: now.append((op, rows.count())))
    t.register_observer(lambda op, rows: then.append((op, rows.count())), "commit")
    t.insert(spark.createDataFrame([(3, 3), (3, 4)], "k long, v long"))
    assert c.sql("select * from t where v > 3").count() == 1
    assert t.update_where(F.col("v") < 2, v=F.col("v") + 10) == 1
    assert t.changes().filter("_op = 'Update'").select("v").collect()[0].v == 11
    assert (now, then) == ([("Insert", 1), ("Update", 1)], [])
    assert c.stream_from_table("t", "commit").df is None
    t.commit()
    assert then == now
    t.delete_by_key(2)
    assert c.stream_from_table("t", "commit").df.count() == 2
    assert c.stream_from_table("t").df.count() == 3
    with pytest.raises(tables.TableError):
        t.get_by_key(2)
    t.truncate()
    assert t.size() == 0 and t.changes().filter("_outdated").count() == 3
    c.drop_table("t")
    assert "t" not in c.tables


def test_saved_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(tables.TableError):
        tables.KeyedTable.open(spark, path, "k")
    t = tables.KeyedTable(spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "k")
    t.save(path)
    t.delete_where(F.col("k") >= 50)
    t.save(path)
    back = tables.KeyedTable.open(spark, path, "k")
    assert back.size() == 50 and back.get_by_key(7).v == 14


def test_transactions(spark):
    t = tables.TxTable(spark.createDataFrame([(1, 10), (2, 20)], "k long, v long"), "k")
    rows = lambda x: dict(map(tuple, x.select("k", "v").collect()))
    a, b = t.begin(), t.begin()
    t.write(a, spark.createDataFrame([(1, 5)], "k long, v long"))
    assert rows(t.read_own(a)) == {1: 5, 2: 20} and rows(t.read()) == {1: 10, 2: 20} == rows(t.read_own(b))
    at = t.commit(a)
    assert rows(t.read()) == {1: 5, 2: 20} == rows(t.read(at)) and rows(t.read_own(b)) == {1: 10, 2: 20}
    t.write(b, spark.createDataFrame([(2, 0)], "k long, v long"))
    assert t.commit(b) is None  # it has read key 1, which was written since
    c = t.begin()
    t.read_own(c, F.col("k") == 2).count()
    d = t.begin()
    t.write(d, spark.createDataFrame([(1, 6)], "k long, v long"))
    assert t.commit(d) and t.commit(c)  # another key


def is_(x):
    return state(lambda e: e["t"] == x)


def found(text, p, s="first"):
    return ["".join(str(e["i"]) for e in m) for m in run_matches([{"t": t, "i": i} for i, t in enumerate(text)], p, s)]


def test_ends_of_patterns():
    a, b, c, x = map(is_, "abcx")
    assert found("abcbb", a >> b.plus()) == ["0134"]
    assert found("acbb", a >> b.star()) == ["023"] and found("ac", a >> b.star()) == ["0"]
    assert found("abc", a >> b.optional()) == ["01"]
    assert found("abc", a >> ~x) == ["0"] and found("abxc", a >> ~x) == []
    assert found("abcab", (a >> b.plus()).within("i", 2)) == ["01", "34"]
    assert found("abx", (a >> ~x).within("i", 1)) == ["0"]
    assert found("aabbc", a >> b.times(2) >> c) == ["0234"]
    assert found("abbc", a >> b.plus() >> c) == ["0123"]


def test_alternatives_and_limits():
    a, b, c, d, x = map(is_, "abcdx")
    assert found("abcd", (a >> b) | (c >> d)) == ["01", "23"]
    assert found("acbd", (a >> b) | (c >> d)) == ["02"]
    assert found("abbc", (b.plus() | a) >> c) == ["03"] and found("bbc", (b.plus() | a) >> c) == ["012"]
    assert found("adxbc", (a >> b >> c).within("i", 1, 1, 2)) == ["034"]
    assert found("abxxc", (a >> b >> c).within("i", 2, 1, 2)) == []
    related = is_("a") >> is_("a").plus() >> state(lambda e, r: e["t"] == "b" and r.related("i", max, 1) == r.previous("i"))
    assert found("aaab", related) == ["0123"]
    with pytest.raises(ValueError):
        (a >> b).plus()


def test_strategies_and_automata():
    a, b, c = map(is_, "abc")
    assert found("axbab", a >> b, "contiguous") == ["34"]
    assert found("aab", a >> b, "next") == ["02", "12"] and found("aab", a >> b, "recent") == ["12"]
    assert sorted(found("abb", a >> b, "all")) == ["01", "02"]
    nfa = Nfa(0, (2,), ((0, lambda e, r: e["t"] == "a", 1), (1, lambda e, r: e["t"] == "b", 2), (1, lambda e, r: e["t"] == "a", 1)), ((1, lambda e, r: e["t"] == "x"),))
    assert found("aabaxb", nfa) == ["012"]


def test_long_paths_and_matrices(spark):
    chain = spark.range(80).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    assert matrices.shortest_paths(chain, 0).filter("node = 80").first().dist == 80
    cells = spark.createDataFrame([(i, j, float(i * 3 + j)) for i in range(3) for j in range(3)], "i int, j int, v double")
    assert matrices.equal(matrices.remove_row(matrices.insert_row(cells, 1), 1), cells)
    assert not matrices.equal(matrices.set_cell(cells, 2, 2, 1.0), cells)
    assert (matrices.non_zeros(cells), matrices.get_cell(cells, 2, 1), matrices.get_cell(matrices.remove_cell(cells, 2, 1), 2, 1)) == (8, 7.0, 0.0)
    g = matrices.Graph(chain, 81).add_edge(80, 0)
    assert (g.num_vertices(), g.num_edges(), g.out_edges(80).count(), g.in_edges(0).count(), g.adjacent(80).first().node) == (81, 81, 1, 1, 0)
    assert g.remove_edge(0, 80).num_edges() == 80 and g.clear_vertex(5).num_edges() == 79


def test_patterns_of_any_length(spark):
    walk = [f"p{i}" for i in range(12)]
    rows = spark.createDataFrame([(walk,), (["z", *walk],), (["p3", "q"],)], "items array<string>")
    got = {tuple(r.pattern): r.support for r in usecases.frequent_patterns(rows).collect()}
    assert got[tuple(walk)] == 2 and got[("p3",)] == 3 and len(got) == 12 * 13 // 2
    assert {tuple(r.pattern) for r in usecases.frequent_patterns(rows, maximal=True).collect()} == {tuple(walk), ("p3",)}


def test_linear_road_reports(spark, tmp_path):
    (tmp_path / "cars.txt").write_text("0,30,7,50,0,1,0,3,1600,-1,-1,-1,-1,-1,-1\n")
    row = Context(spark).stream_from_linear_road(str(tmp_path / "cars.txt")).df.first()
    assert (row.time, row.vid, row.seg, row.day) == (30, 7, 3, -1)
    cars = [(v, t, t // 60 + 1, 3, 100 if t < 120 or v < 3 else 200) for v in (1, 2, 3) for t in range(0, 210, 30)]
    df = spark.createDataFrame(cars, "vid int, time int, m int, seg int, pos int")
    assert {(r.seg, r.m) for r in usecases.accidents(df).collect()} == {(3, 2), (3, 3), (3, 4)}


def test_aggregates_of_changes(spark):
    flow = Flow.of(spark.createDataFrame([(0, "a", 2.0), (1, "a", None), (2, "a", 4.0), (3, "b", 6.0)], "_seq long, k string, v double")).sliding_window("row", 2).changelog()
    out = flow.key_by("k").aggregate_changes(A.count(name="n"), A.sum_("v", "s"), A.avg("v", "m")).df.orderBy("_seq").collect()
    assert [(r._at, r._outdated, r.n, r.s, r.m) for r in out] == [(0, False, 1, 2.0, 2.0), (1, False, 2, 2.0, 2.0), (2, True, 1, None, None), (2, False, 2, 4.0, 4.0), (3, True, 1, 4.0, 4.0), (3, False, 1, 6.0, 6.0)]
    with pytest.raises(ValueError, match="min"):
        flow.aggregate_changes(A.min_("v", "m"))
    with pytest.raises(ValueError, match="changelog"):
        Flow.of(spark.range(1).withColumnRenamed("id", "_seq")).aggregate_changes(A.count(name="n"))


def test_tuplify_by_windows(spark):
    rows = [(i, t, s, p, o) for i, (t, s, p, o) in enumerate([(0, "x", "p", "1"), (5, "y", "p", "2"), (9, "x", "q", "3"), (10, "x", "p", "4"), (11, None, "q", "5"), (30, "x", "r", "6")])]
    df = spark.createDataFrame(rows, "_seq long, t long, s string, p string, o string").selectExpr("_seq", "timestamp_seconds(t) AS ts", "s", "p", "o")
    out = Flow.of(df, ts="ts").tuplify(["p", "q"], "window", seconds=10).df.collect()
    assert {(r.s, r.p, r.q) for r in out} == {("x", "1", "3"), ("x", "4", None), ("y", "2", None), (None, None, "5")}
