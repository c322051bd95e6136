"""Queries against their SQL on small tables made to hold what the test tables lack: halves, sums that hang on their order, tests that cannot be done."""

import pytest
from pyspark.sql import functions as F

from lacuna.plans import registry


def _both(spark, folder, name, **tables):
    """The query's rows and those of its SQL, as sorted tuples in order of column name."""
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    return sorted(map(tuple, got.select(*columns).collect()), key=repr), sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_prices_at_halves_round_as_sql_does(spark, tmp_path):
    # SQL scales and rounds 258.4815 to 258.481, by decimal digits it would be 258.482
    orders = spark.createDataFrame([(3 * i, i, p) for i, p in enumerate((258481.5, 258481.0, 32072.5, 32072.0, 130232.5, 130231.7))], "o_orderkey long, o_custkey long, o_totalprice double")
    got, want = _both(spark, tmp_path, "fr1_variance_profile", orders=orders)
    assert got == want
    assert registry.queries()["fr1_variance_profile"](spark, str(tmp_path)).where("var = 'price'").first()["n_distinct"] == 3


def test_votes_add_up_in_order_of_the_orders(spark, tmp_path):
    # doubles such as 0.1 + 0.2 + 0.3 depend on their order: so do winners among near equals
    orders = spark.range(3000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 199 % 40).alias("o_custkey"), F.lit(1.0).alias("o_totalprice"))
    got, want = _both(spark, tmp_path, "pf10_weighted_vote", orders=orders)
    assert got == want
    other = tmp_path / "other"
    for k, part in enumerate((orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"))):
        part.orderBy(F.desc("o_orderkey")).coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{other}/orders.parquet")
    turned = registry.queries()["pf10_weighted_vote"](spark, str(other))
    assert sorted(map(tuple, turned.select(*sorted(turned.columns)).collect()), key=repr) == want


def test_datasets_too_small_for_the_forest_test_are_classed_as_the_sql_says(spark):
    import duckdb

    from lacuna.operators import diagnose

    rows = [("a", None, 0.3), ("b", None, 0.0), ("c", None, None), ("d", 0.2, 0.3), ("e", 0.01, 0.3), ("f", 0.01, 0.0), ("g", 0.05, 0.0)]
    tests = spark.createDataFrame(rows, "dataset_id string, pklm_p double, corr_x1 double")
    con = duckdb.connect()
    con.execute("create table scores (dataset_id varchar, pklm_p double, corr_x1 double)")
    con.executemany("insert into scores values (?, ?, ?)", rows)
    sql = registry.oracle_sql()["ts18_pklm_classify"]
    want = dict(con.execute(sql[sql.rindex("SELECT dataset_id, CASE") :]).fetchall())
    assert dict(map(tuple, diagnose.pklm_classify(tests, "shift").collect())) == want
    assert dict(map(tuple, diagnose.pklm_classify(tests).collect())) == want | dict.fromkeys("abc", "MCAR")


def test_small_datasets_lose_the_row_that_the_sql_says(spark, tmp_path):
    # four rows at 1 to 10 percent: most ways hit none, so the likeliest row (or the one of the lowest draw) goes
    rows = spark.range(240).select(
        (F.col("id") % 60).alias("l_suppkey"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 17).alias("l_partkey"),
        (F.col("id") * 7 % 50).cast("double").alias("l_quantity"), (F.col("id") * 13 % 101 + 0.25).alias("l_extendedprice"),
        (F.col("id") % 11 / 100).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax"),
    )
    got, want = _both(spark, tmp_path, "sim14_generate_benchmark", lineitem=rows)
    assert got == want


def test_simulation_reads_written_steps(spark):
    from lacuna.operators import simulate

    panel = simulate.base_panel(spark, 24, 20)
    plan = simulate.simulate(panel, simulate.variant_of(), 0.1, 42)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6  # dozens, and the ranks again and again, when each step held all those before it
