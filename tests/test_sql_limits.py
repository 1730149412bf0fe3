"""Views around a statement, and statements that take too long."""

import threading
import time

import pytest

from tablegauge.operators.sql import guarded_sql, sql_over, sql_page, time_limit


def test_views_of_any_case_are_put_back(spark):
    mine = spark.createDataFrame([(1,)], "a int")
    other = spark.createDataFrame([(2,), (3,)], "a int")
    mine.createOrReplaceTempView("Orders_")
    try:
        for name in ("Orders_", "orders_", "ORDERS_"):
            assert sql_over(spark, "SELECT count(*) AS n FROM orders_", {name: other}).first().n == 2
            assert [r.a for r in spark.table("orders_").collect()] == [1]
        with pytest.raises(Exception):
            sql_over(spark, "SELECT nothing FROM orders_", {"ORDERS_": other})
        assert [r.a for r in spark.table("Orders_").collect()] == [1]
    finally:
        spark.catalog.dropTempView("Orders_")
    sql_over(spark, "SELECT * FROM passing", {"passing": other})
    assert not spark.catalog.tableExists("passing")
    with pytest.raises(ValueError):
        sql_over(spark, "SELECT 1", {"t": mine, "T": other})


def test_threads_see_their_own_tables(spark):
    frames = {i: spark.createDataFrame([(i,)], "a int") for i in range(4)}
    seen = {}

    def run(i):
        seen[i] = [sql_over(spark, "SELECT a FROM shared", {"shared": frames[i]}).first().a for _ in range(3)]

    threads = [threading.Thread(target=run, args=(i,)) for i in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {i: [i] * 3 for i in frames}


LONG = "SELECT sum(sin(id) * cos(id)) AS s FROM range(0, 20000000000, 1, 8)"


def test_a_long_statement_is_ended_and_the_session_lives_on(spark):
    start = time.time()
    with pytest.raises(TimeoutError):
        sql_page(spark, LONG, seconds=2)
    assert time.time() - start < 60
    assert sql_page(spark, "SELECT 1 AS x", seconds=60).first().x == 1
    assert guarded_sql(spark, "SELECT 2 AS x").first().x == 2


def test_other_work_of_the_session_is_left_alone(spark):
    found = []
    other = threading.Thread(target=lambda: found.append(spark.range(400_000_000).selectExpr("sum(id * 2 % 7) AS s").first().s))
    other.start()
    with pytest.raises(TimeoutError):
        with time_limit(spark, 1):
            spark.sql(LONG).collect()
    other.join()
    assert len(found) == 1


def test_errors_stay_errors_under_a_limit(spark):
    with pytest.raises(ValueError, match="Only SELECT"):
        sql_page(spark, "DROP TABLE x", seconds=60)
    with time_limit(spark, 60):
        assert spark.range(3).count() == 3
