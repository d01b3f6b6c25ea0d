"""S3: the customer-base table (14 columns, one row per customer).

Derived from ``customer`` LEFT JOIN (``orders`` aggregated per customer).  The
label is observed, not computed from the features: a customer has left if no
order follows the cut-off date.  Every feature uses only what was known before
it.  The aggregate is partial/final (map-side combine), so a customer holding a
large share of all orders costs one row per map task, not a hot reducer;
the join then sees one row per key on both sides and reuses the aggregate's
hash partitioning on the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Reference dates of the derivation
CUTOFF = "2000-07-01"
RECENT_SINCE = "1999-01-01"
ACTIVE_SINCE = "2000-01-01"


def _ts(orders: DataFrame, value: str):
    """A timestamp literal of the order-date column's own type, so the
    comparison does not depend on the session time zone (the driver tables
    store ``timestamp_ntz``)."""
    kind = orders.schema["o_orderdate"].dataType.simpleString()
    return F.lit(value).cast("timestamp_ntz" if kind == "timestamp_ntz" else "timestamp")


def order_summary(orders: DataFrame) -> DataFrame:
    """Per-customer order statistics: one partial + final aggregate.  All but
    ``after`` look at orders before the cut-off only."""
    date = F.col("o_orderdate")
    known = date < _ts(orders, CUTOFF)
    cents = F.round(F.col("o_totalprice") * 100, 0).cast("bigint")
    return (orders
            .select("o_custkey", "o_orderdate", "o_totalprice")
            .groupBy("o_custkey")
            .agg(F.count_if(known).alias("n"),
                 F.count_if(known & (date >= _ts(orders, RECENT_SINCE))).alias("n_recent"),
                 F.min(F.when(known, date)).alias("d0"),
                 F.max(F.when(known, date)).alias("d1"),
                 F.sum(F.when(known, cents)).alias("cents"),
                 F.count_if(~known).alias("after")))


def customer_base(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Build the raw customer table (RowNumber ... Exited)."""
    o = order_summary(orders)
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left")

    key = F.col("c_custkey")
    geo_code = F.col("c_nationkey") % 3
    geography = (F.when(geo_code == 0, "France").when(geo_code == 1, "Germany").otherwise("Spain"))
    gender = F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female")
    cents = F.coalesce(F.col("cents"), F.lit(0))
    # 300 to 850 by the mean order, 18 to 95 by the account balance
    credit = F.lit(300) + F.least(F.lit(550), F.expr("coalesce(cents, 0) div greatest(coalesce(n, 0), 1) div 70000"))
    age = F.lit(18) + F.least(F.lit(77), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000) / 143)))
    days = F.datediff(F.lit(CUTOFF).cast("date"), F.col("d0").cast("date"))
    tenure = F.least(F.lit(10), F.coalesce(F.floor(days / 180), F.lit(0)))
    balance = (F.when(F.col("c_acctbal") < 2500, F.lit(0.0))
               .otherwise(F.round((F.col("c_acctbal") - 2500) * 33, 2))).cast("double")
    products = F.least(F.lit(4), F.greatest(F.lit(1), F.coalesce(F.col("n_recent"), F.lit(0))))
    card = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "HOUSEHOLD"), 1).otherwise(0)
    active = F.when(F.col("d1") >= _ts(orders, ACTIVE_SINCE), 1).otherwise(0)
    salary = F.lit(10000.0) + F.least(F.lit(19_000_000), F.floor(cents / 24)).cast("double") / 100
    return j.select(
        (key + 1).cast("long").alias("RowNumber"),
        (key + 10000000).cast("long").alias("CustomerId"),
        F.col("c_name").alias("Surname"),
        credit.cast("int").alias("CreditScore"),
        geography.alias("Geography"),
        gender.alias("Gender"),
        age.cast("int").alias("Age"),
        tenure.cast("int").alias("Tenure"),
        balance.alias("Balance"),
        products.cast("int").alias("NumOfProducts"),
        card.cast("int").alias("HasCrCard"),
        active.cast("int").alias("IsActiveMember"),
        salary.alias("EstimatedSalary"),
        F.when(F.coalesce(F.col("after"), F.lit(0)) == 0, 1).otherwise(0).cast("int").alias("Exited"),
    )
