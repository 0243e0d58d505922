"""Registered queries return a row for everything their tables hold."""

from __future__ import annotations

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_customer_has_a_count(spark):
    got = {r.c_custkey: r.n for r in catalogue.queries()["corr_scalar_count"](spark, SF).collect()}
    orders = [r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect()]
    keys = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()]
    assert got == {k: orders.count(k) for k in keys}
