"""Queries on tables larger than the ones of sf0.001: more bases than 16 bits number, more suppliers than 8 bits hold."""

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as driver
from bitloom.operators import features

from test_queries import rows_of


def compared(spark, name, sf, table):
    df = driver.queries()[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf}/{table}.parquet/*.parquet'")
    cur = con.execute(driver.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


@pytest.fixture(scope="module")
def many_orders(spark, tmp_path_factory):
    """70,000 different prices of one status and three of another."""
    sf = str(tmp_path_factory.mktemp("orders"))
    price = (F.col("id") + F.floor(F.col("id") / 7) * 3).cast("double") / 100
    spark.range(70_003).select(F.when(F.col("id") < 70_000, "O").otherwise("F").alias("o_orderstatus"), price.alias("o_totalprice")).write.parquet(f"{sf}/orders.parquet")
    return sf


def test_adaptive_of_more_bases_than_16_bits(spark, many_orders):
    got = driver.queries()["adaptive_v3"](spark, many_orders).toPandas()
    norm = features.normalized(features.rank_delta(bases_of(spark, many_orders), "o_orderstatus", "value"), "o_orderstatus").toPandas()
    for status, limit in (("O", 2**32 - 1), ("F", 65535)):
        a = norm[norm.o_orderstatus == status].sort_values("rank").delta_norm.to_numpy()
        scale = features.largest_scale(a, limit, limit)
        part = got[got.o_orderstatus == status].sort_values("value")
        assert len(part) == len(a) and set(part["scale"]) == {scale}
        assert part.z.tolist() == (np.arange(len(a)) + np.floor(scale * a).cumsum().astype(np.int64)).tolist()
        assert part.z.max() <= limit
    with pytest.raises(PySparkException):
        features.adaptive(spark.createDataFrame(norm), "o_orderstatus").collect()


def bases_of(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("value")).distinct()


def test_cumulative_over_16_bits(spark, many_orders):
    compared(spark, "cumulative_v2", many_orders, "orders")


@pytest.fixture(scope="module", params=[4_000, 1_000_000])
def many_suppliers(request, spark, tmp_path_factory):
    """3,000 lines of suppliers that need 16 bits, or 32 where the packed row would be wider than a word."""
    sf = str(tmp_path_factory.mktemp("lines"))
    n = F.col("id")
    keys = [n.alias("l_orderkey"), (n % 200).alias("l_partkey"), (n * n * 37 % request.param).alias("l_suppkey"), (n % 7 + 1).cast("int").alias("l_linenumber")]
    values = [(n * 31 % 50 + 1).cast("double").alias("l_quantity"), (n * 17 % 11 / 100).alias("l_discount"), (n * 13 % 9 / 100).alias("l_tax")]
    spark.range(3_000).select(*keys, *values).write.parquet(f"{sf}/lineitem.parquet")
    return sf


@pytest.mark.parametrize("name", ["base_table", "delta_tiers_unary", "enforce_k_min", "row_assignment", "select_threshold", "base_deltas", "base_table_sorted", "delta_bitlen_hist", "delta_tiers_fixed", "size_model", "layout_states", "decode_roundtrip", "bit_pack", "bit_entropy", "bit_polarity", "bit_strings", "condensed_fixed", "encoded_size_normal"])
def test_many_suppliers(spark, many_suppliers, name):
    compared(spark, name, many_suppliers, "lineitem")
