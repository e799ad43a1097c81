"""Rows with defaults, and frames of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from tallyforge.sources.schema import raw_schema

RAW = dict(transaction_id="T1", customer_id="CUST1", product_id="P1", category="PROMO", purchase_date="2024-01-15", quantity=2.0, unit_price=19.99, total_amount=39.98, region="ASIA", payment_method="2-HIGH", customer_age=35.0, customer_segment="BUILDING")
CLEAN = RAW | {"purchase_date": dt.date(2024, 1, 15), "quantity": 2, "customer_age": 35}


def raw(spark, *changes):
    return spark.createDataFrame([tuple((RAW | c).values()) for c in changes], raw_schema())


def clean(spark, *changes):
    kinds = {"purchase_date": T.DateType(), "quantity": T.IntegerType(), "customer_age": T.IntegerType()}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in raw_schema()])
    return spark.createDataFrame([tuple((CLEAN | c).values()) for c in changes], schema)


def day(text):
    return dt.date.fromisoformat(text)
