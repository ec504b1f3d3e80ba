"""Queries that stand for a whole feature, on every row of their tables; test_oracle has their values."""

from quarrygrid.queries import QUERIES, engine, orders


def test_every_order_is_projected_and_computed(spark, small):
    n = spark.read.parquet(f"{small}/orders.parquet").count()
    assert QUERIES["leaf_projection"](spark, small).count() == n
    assert QUERIES["calc_functions"](spark, small).count() == n


def test_every_customer_is_added(spark, small):
    out = QUERIES["transaction_apply"](spark, small)
    assert out.where("o_orderstatus = 'N'").count() == spark.read.parquet(f"{small}/customer.parquet").count()
    assert out.where("o_orderstatus != 'N'").count() == spark.read.parquet(f"{small}/orders.parquet").where("o_orderkey % 7 != 0").count()


def test_series_and_rows_beyond_the_default_caps(spark, tmp_path):
    spark.range(600).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50_001).selectExpr("id AS event_id", "'purchase' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert [QUERIES[n](spark, str(tmp_path)).count() for n in ("series", "query_all")] == [600, 50_001]
    e = orders(spark, str(tmp_path))
    assert e.series("o_custkey", {}).count() == 500
    e = engine(spark, str(tmp_path), "events", "event_id")
    assert e.query_all({}).count() == 50_000
