import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.operators import kv
from webloom.operators.bag import Context, Destroyed, PairBag


def pairs(spark, rows):
    return PairBag(spark.createDataFrame(rows, "key string, value string"))


def test_bag(spark):
    bag = Context(spark).parallelize(["1", "2", "2"])
    assert bag.count() == 3 and sorted(bag.distinct().collect()) == ["1", "2"]
    assert bag.intersection(Context(spark).parallelize(["2", "2", "3"])).collect() == ["2"]
    assert bag.fold("0", "sum") == "5" and Context(spark).parallelize([]).fold("0", "sum") == "0" and bag.fold("", "max") == "2"
    assert bag.fold("3", "integer_sum") == "8" and Context(spark).parallelize(["9007199254740993", "x", "1.5"]).fold("0", "integer_max") == "9007199254740993" and bag.fold("0.5", "sum") == "5.5" and bag.fold("9", "max") == "9" and bag.fold("1", "count") == "4"
    assert len(bag.take(2)) == 2 and sorted(bag.filter(lambda v: v > "1").collect()) == ["2", "2"]
    assert sorted(bag.flat_map_python(lambda v: [v, None] if v == "1" else None).collect()) == ["1"]
    assert bag.fold_ordered("", lambda a, v: F.concat(a, v), lambda v: v) == "122"
    assert sorted(bag.group_by(lambda v: v).collect()) == [("1", "1"), ("2", "2,2")]


def test_pairs(spark):
    left, right = pairs(spark, [("k", "1"), ("k", "2"), ("k", "2")]), pairs(spark, [("k", "a"), ("k", "a")])
    assert sorted(left.join(right).collect()) == sorted([("k", "1,a")] * 2 + [("k", "2,a")] * 4)
    fruit = pairs(spark, [("fruit", "apple"), ("fruit", "banana")]).cogroup(pairs(spark, [("fruit", "cherry"), ("fruit", "date"), ("fruit", "fig"), ("nut", "x")]))
    assert sorted(fruit.collect()) == [("fruit", "[apple,banana],[cherry,date,fig]"), ("nut", "[],[x]")]
    assert sorted(map(tuple, pairs(spark, [("a", "1"), ("a", "2"), ("b", "5")]).fold_by_key("sum").collect())) == [("a", 3.0), ("b", 5.0)]
    urls = pairs(spark, [("w", "http://h/10"), ("w", "http://h/1")]).fold_by_key("distinct_concat").collect()
    assert urls[0].value == "http://h/1, http://h/10"


def test_handles(spark):
    c = Context(spark)
    assert c.result() == "no output"
    c.output("x")
    assert c.result() == "x"
    with pytest.raises(ValueError):
        c.set_concurrency_level(0)
    bag = c.parallelize(["a"])
    bag.destroy()
    with pytest.raises(Destroyed):
        bag.count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc")), st.lists(st.sampled_from("bcd")))
def test_laws(spark, x, y):
    a, b = Context(spark).parallelize(x), Context(spark).parallelize(y)
    assert sorted(a.intersection(b).collect()) == sorted(b.intersection(a).collect()) == sorted(set(x) & set(y))
    assert sorted(a.distinct().distinct().collect()) == sorted(set(x))


def test_store(spark):
    base = spark.createDataFrame([("r", "c", "1", 1), ("r", "c", "2", 2), ("r", "d", "x", 1)], "row_key string, column string, value string, version long")
    latest = {(r.row_key, r.column): r.value for r in kv.upsert_latest(base).collect()}
    assert latest == {("r", "c"): "2", ("r", "d"): "x"}
    puts = spark.createDataFrame([("r", "c", 2, "3", "4"), ("r", "c", 1, "2", "3"), ("r", "c", 3, "3", "5"), ("r", "d", 1, "y", "z"), ("s", "c", 1, "1", "2")], "row_key string, column string, version int, expected string, new string")
    got = {(r.row_key, r.column, r.version): (r.value, r.status) for r in kv.conditional_put(kv.upsert_latest(base), puts).collect()}
    assert got == {("r", "c", 1): ("3", "OK"), ("r", "c", 2): ("4", "OK"), ("r", "c", 3): ("4", "FAIL"), ("r", "d", 1): ("x", "FAIL"), ("s", "c", 1): (None, "FAIL")}
    with pytest.raises(LookupError):
        kv.rename(spark, "no_such_table", "x")
    with pytest.raises(LookupError):
        kv.delete(spark, "no_such_table")
