"""Every registered query of the library against its SQL twin."""

from __future__ import annotations

import pytest
from twins import same

import __spark_entry__  # noqa: F401  registers the queries
from millrace.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        same(df, registry.ORACLES[name], sf_dir)
    else:
        assert df.count() >= 0


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0


def test_hash_split_does_not_depend_on_partitioning(spark, sf_dir):
    from millrace.operators import prep

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    shares = {"train": 0.8, "test": 0.2}
    one = prep.hash_split(orders, "o_orderkey", shares).select("o_orderkey", "split")
    two = prep.hash_split(orders.repartition(7), "o_orderkey", shares).select("o_orderkey", "split")
    assert one.exceptAll(two).isEmpty()
    share = one.where("split = 'train'").count() / one.count()
    assert 0.75 < share < 0.85
