"""Report queries over a scored table.

All are lazy DataFrame plans: filters and projections reach the scan, group-bys
use partial aggregation, and top-k is ``orderBy(...).limit(k)`` which Spark
plans as ``TakeOrderedAndProject`` (a per-partition heap, k rows shuffled).
Every sort carries CustomerId as the final tie-breaker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..functions.money import money_avg, money_sum
from ..schema import ENGINEERED, LABEL

TOP_COLUMNS = ["CustomerId", "Age", "Geography_Label", "Balance", "clv_estimated",
               "churn_probability", "retention_value", "risk_level"]
CALL_COLUMNS = TOP_COLUMNS + ["recommended_action"]


def present(df: DataFrame, cols: list[str]) -> list[str]:
    """V6: keep only the columns the table has, in the asked order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def pct1(c: Column) -> Column:
    return F.bround(c * 100, 1)


# A1 / A2 -------------------------------------------------------------------
def correlations(feat: DataFrame, features: list[str] = ENGINEERED, label: str = LABEL) -> DataFrame:
    """A1: Pearson r of each engineered feature with the label, one aggregate,
    long output.  A constant on either side has no r: NaN."""
    def r(c: str) -> Column:
        x, y = F.col(c).cast("double"), F.col(label).cast("double")
        both = F.when(x.isNotNull() & y.isNotNull(), x), F.when(x.isNotNull() & y.isNotNull(), y)
        spread = F.stddev_pop(both[0]) * F.stddev_pop(both[1])
        return F.when(spread > 0, F.covar_pop(x, y) / spread).otherwise(F.lit(float("nan")))

    row = feat.agg(*[r(c).alias(c) for c in features])
    stacked = F.expr("stack({n}, {pairs}) as (feature, r)".format(
        n=len(features), pairs=", ".join(f"'{c}', `{c}`" for c in features)))
    return row.select(stacked).select("feature", F.bround("r", 6).alias("r"))


def top_correlations(feat: DataFrame, k: int = 5, **kw) -> DataFrame:
    """A2: top k by |r|; NaN/null r last; ties by name."""
    c = correlations(feat, **kw).withColumn("abs_r", F.when(~F.isnan("r"), F.abs("r")))
    return (c.orderBy(F.col("abs_r").desc_nulls_last(), F.col("feature")).limit(k)
            .select("feature", "r", "abs_r"))


# A3 / R3 -------------------------------------------------------------------
def revenue_by_segment(scored: DataFrame) -> DataFrame:
    return (scored.where(F.col("Geography_Label").isNotNull() & F.col("Age_Group_Label").isNotNull())
            .groupBy(F.col("Geography_Label").alias("geography"), F.col("Age_Group_Label").alias("age_group"))
            .agg(money_sum("retention_value").alias("retention_value")))


# A4 / A5 / R5 --------------------------------------------------------------
def cohort_churn(scored: DataFrame) -> DataFrame:
    """Churn rate % (1 decimal) by geography, age group, tenure band, credit
    band and activity: five group-bys in one scan through GROUPING SETS."""
    active = F.when(F.col("IsActiveMember") == 1, "Active").when(F.col("IsActiveMember") == 0, "Inactive")
    base = scored.select(F.col("Geography_Label").alias("g"), F.col("Age_Group_Label").alias("a"),
                         F.col("Tenure_Label").alias("t"), F.col("Credit_Label").alias("c"),
                         active.alias("s"), F.col(LABEL).alias("y"))
    gs = (base.groupingSets([["g"], ["a"], ["t"], ["c"], ["s"]], "g", "a", "t", "c", "s")
          .agg(F.avg("y").alias("rate"), F.count("*").alias("n"),
               F.grouping_id().alias("gid")))
    dim = (F.when(F.col("gid") == 15, "geography").when(F.col("gid") == 23, "age_group")
           .when(F.col("gid") == 27, "tenure").when(F.col("gid") == 29, "credit_band").otherwise("activity"))
    value = F.coalesce("g", "a", "t", "c", "s")
    return gs.select(dim.alias("dimension"), value.alias("segment"), F.col("n").cast("long").alias("customers"),
                     pct1(F.col("rate")).alias("churn_rate_pct")).where(F.col("segment").isNotNull())


# A6 / R6 -------------------------------------------------------------------
def value_by_geography(scored: DataFrame) -> DataFrame:
    return (scored.groupBy(F.col("Geography_Label").alias("geography"))
            .agg(money_sum("retention_value").alias("total_retention_value"),
                 money_avg("retention_value").alias("avg_retention_value"),
                 F.count("*").cast("long").alias("customers")))


# A9 ------------------------------------------------------------------------
def worst_segment(scored: DataFrame) -> DataFrame:
    """Geography with the highest churn rate (first by name on ties), its rate
    and the mean retention value of its customers."""
    g = (scored.groupBy(F.col("Geography_Label").alias("geography"))
         .agg(F.avg(LABEL).alias("rate"), money_avg("retention_value", 6).alias("avg_rv")))
    return (g.orderBy(F.col("rate").desc(), F.col("geography")).limit(1)
            .select("geography", F.bround("rate", 6).alias("churn_rate"),
                    F.bround("avg_rv", 4).alias("avg_retention_value")))


# A7 / R1 -------------------------------------------------------------------
def kpis(scored: DataFrame, threshold) -> DataFrame:
    """Executive KPI row: customers, count and share at/above the business
    threshold, retention value of HIGH risk rows, mean CLV, colour band."""
    tdf = threshold if isinstance(threshold, DataFrame) else None
    base = scored if tdf is None else scored.crossJoin(F.broadcast(tdf.select(F.col(tdf.columns[0]).alias("_t"))))
    t = F.col("_t") if tdf is not None else F.lit(float(threshold))
    row = base.agg(F.count("*").cast("long").alias("customers"),
                   F.count_if(F.col("churn_probability") >= t).cast("long").alias("at_risk"),
                   money_sum(F.when(F.col("risk_level") == "HIGH", F.col("retention_value"))).alias("revenue_at_risk_high"),
                   money_avg("clv_estimated").alias("avg_clv"))
    share = F.when(F.col("customers") > 0, F.col("at_risk") / F.col("customers")).otherwise(0.0)
    return row.select("*", F.bround(share, 6).alias("at_risk_share"),
                      F.when(share > 0.25, "red").when(share > 0.15, "amber").otherwise("green").alias("risk_band"))


def executive_kpis(scored: DataFrame, threshold: float, metrics: DataFrame) -> DataFrame:
    """The KPI row (A7) beside the metrics record (E11) - AUC, catch rate and
    net value at the business threshold - and the six cards as displayed."""
    m = metrics.select(F.col("test_auc").alias("model_auc"), "catch_rate", F.col("net_value_at_optimal_threshold").alias("business_value"))
    row = kpis(scored, threshold).crossJoin(F.broadcast(m))
    cards = {"at_risk_card": F.concat(F.format_number("at_risk", 0), F.lit(" ("), display.percent(F.col("at_risk_share")), F.lit(" of base)")),
             "revenue_at_risk_card": display.whole_euros(F.col("revenue_at_risk_high")),
             "model_auc_card": F.format_string("%.4f", "model_auc"), "catch_rate_card": display.percent(F.col("catch_rate")),
             "avg_clv_card": display.whole_euros(F.col("avg_clv")), "business_value_card": display.whole_euros(F.col("business_value"))}
    return row.select("*", *[c.alias(name) for name, c in cards.items()])


# A8 / R2 -------------------------------------------------------------------
def score_histogram(scored: DataFrame, bins: int = 40, p: str = "churn_probability") -> DataFrame:
    """Equal-width bins on [0, 1]; empty bins are present with count 0."""
    spark = scored.sparkSession
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * bins).cast("int")))
    counts = scored.groupBy(b.alias("bin")).agg(F.count("*").cast("long").alias("n"))
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (allb.join(F.broadcast(counts), "bin", "left")
            .select("bin", F.bround(F.col("bin") / bins, 6).alias("lower"),
                    F.bround((F.col("bin") + 1) / bins, 6).alias("upper"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("customers")))


# A10 -----------------------------------------------------------------------
def batch_summary(scored: DataFrame, rv: str = "retention_value") -> DataFrame:
    return scored.agg(
        F.count("*").cast("long").alias("total"),
        F.count_if(F.col("risk_level") == "HIGH").cast("long").alias("high_risk"),
        F.count_if(F.col("risk_level") == "MEDIUM").cast("long").alias("medium_risk"),
        (F.count("*") - F.count_if(F.col("risk_level") == "HIGH")
         - F.count_if(F.col("risk_level") == "MEDIUM")).cast("long").alias("low_risk"),
        money_sum(rv).alias("total_retention_value_at_risk"))


# A11 -----------------------------------------------------------------------
def split_rates(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count("*").cast("long").alias("rows"),
                                       F.bround(F.avg(LABEL), 6).alias("churn_rate"))


# A12 -----------------------------------------------------------------------
def column_max(df: DataFrame, col: str = "retention_value", default: float = 500.0) -> DataFrame:
    if col not in df.columns:
        return df.sparkSession.createDataFrame([(default,)], f"max_{col} double")
    return df.agg(F.coalesce(F.max(col).cast("double"), F.lit(default)).alias(f"max_{col}"))


def mean_clv(df: DataFrame, default: float = 1000.0) -> DataFrame:
    if "clv_estimated" not in df.columns:
        return df.sparkSession.createDataFrame([(default,)], "avg_clv double")
    return df.agg(F.coalesce(money_avg("clv_estimated"), F.lit(default)).alias("avg_clv"))


# P1-P3, P6 -----------------------------------------------------------------
# What each choice of the activity filter keeps
ACTIVITY = {"Active": 1, "Inactive": 0}
#: The choice that narrows nothing.
EVERYTHING = "ALL"


@dataclass(frozen=True)
class CallFilter:
    """The filters that the call list and the export share; None narrows nothing."""

    risk: str | None = None
    geo: str | None = None
    min_rv: float = 0.0
    is_active: int | None = None

    @classmethod
    def of(cls, risk: str = EVERYTHING, geo: str = EVERYTHING, min_rv: float = 0.0, active: str = EVERYTHING) -> CallFilter:
        """From the choices of a form."""
        return cls(None if risk == EVERYTHING else risk, None if geo == EVERYTHING else geo, float(min_rv), ACTIVITY.get(active))

    def apply(self, scored: DataFrame) -> DataFrame:
        """P1-P3; each condition is pushed into the scan."""
        for name, wanted in (("risk_level", self.risk), ("Geography_Label", self.geo), ("IsActiveMember", self.is_active)):
            if wanted is not None:
                scored = scored.where(F.col(name) == wanted)
        return scored.where(F.col("retention_value") >= self.min_rv) if "retention_value" in scored.columns else scored


def customer_lookup(df: DataFrame, customer_id: int) -> DataFrame:
    """One customer by id."""
    return df.where(F.col("CustomerId") == F.lit(int(customer_id)))


def masked_sums(scored: DataFrame) -> DataFrame:
    """Masked aggregation - HIGH-risk value and per-mask means."""
    high = F.col("risk_level") == "HIGH"
    inact = F.col("IsActiveMember") == 0
    return scored.agg(
        money_sum(F.when(high, F.col("retention_value"))).alias("high_value_sum"),
        F.count_if(high & inact).cast("long").alias("high_and_inactive"),
        money_avg(F.when(inact, F.col("retention_value"))).alias("inactive_avg_value"))


# T1 / R4 -------------------------------------------------------------------
def first_call_list(scored: DataFrame, k: int = 10) -> DataFrame:
    return (scored.orderBy(F.col("retention_value").desc(), F.col("CustomerId").asc()).limit(k)
            .select(*present(scored, TOP_COLUMNS)))


# T2 / R8 / R9 / S10 --------------------------------------------------------
#: The sorts there are, by the name a user asks for.
CALL_SORTS = {"retention_value": "retention_value", "churn_probability": "churn_probability", "clv_estimated": "clv_estimated"}


def call_list(scored: DataFrame, sort_col: str = "retention_value", k: int = 100, **choices) -> DataFrame:
    """The k first customers of the filtered table, by one of ``CALL_SORTS``;
    any other name sorts by retention value."""
    by = CALL_SORTS.get(sort_col, "retention_value")
    shown = CallFilter.of(**choices).apply(scored).orderBy(F.desc(by), "CustomerId").limit(k)
    return shown.select(*present(scored, CALL_COLUMNS))


def call_list_shown(calls: DataFrame) -> DataFrame:
    """R8 as displayed: ids cut to 10 characters, other texts to 40, money in whole
    euros, the probability in percent."""
    shown = {"CustomerId": lambda c: display.cut(c.cast("string"), 10), "churn_probability": display.percent}
    shown |= dict.fromkeys(("Balance", "clv_estimated", "retention_value"), display.whole_euros)
    return calls.select(*[shown.get(c, lambda x: display.cut(x.cast("string"), 40))(F.col(c)).alias(c) for c in calls.columns])


def call_list_total(scored: DataFrame, **kw) -> DataFrame:
    shown = call_list(scored, **kw)
    return shown.agg(F.count("*").cast("long").alias("customers"),
                     money_sum("retention_value").alias("total_retention_value"))


def export_rows(scored: DataFrame, risk: str = "ALL", geo: str = "ALL", min_rv: float = 0.0,
                active: str = "ALL") -> DataFrame:
    """The call-list filters without sort or row cap (content of the export)."""
    return CallFilter.of(risk, geo, min_rv, active).apply(scored)


# T5 ------------------------------------------------------------------------
def customer_picker(scored: DataFrame, k: int = 200) -> DataFrame:
    label = F.format_string("ID %d | Age %d | %s | %s", F.col("CustomerId"), F.col("Age"),
                            F.coalesce(F.col("Geography_Label"), F.lit("?")),
                            F.coalesce(F.col("risk_level"), F.lit("?")))
    return (scored.orderBy("CustomerId").limit(k)
            .select("CustomerId", label.alias("label")))



# R7 ------------------------------------------------------------------------
# Metrics shown in the model-performance table, in display order
METRIC_LABELS = [
    ("model_name", "Model"), ("test_auc", "Test AUC"), ("test_f1", "Test F1"),
    ("test_precision", "Precision"), ("test_recall", "Recall"), ("test_accuracy", "Accuracy"),
    ("average_precision", "Avg Precision"), ("catch_rate", "Catch Rate"),
    ("false_alarm_rate", "False Alarm Rate"), ("f1_optimal_threshold", "F1 Threshold"),
    ("business_optimal_threshold", "Business Threshold"),
    ("net_value_at_optimal_threshold", "Net Value (€)"),
]


def format_metric(v: Column) -> Column:
    """Value-dependent display: below 10 with 4 decimals, else euros with separators."""
    return F.when(v < 10, F.format_string("%.4f", v)).otherwise(F.concat(F.lit("€"), F.format_number(v, 2)))


def metrics_table(doc: DataFrame) -> DataFrame:
    """(position, label, value) rows of the metrics record, formatted."""
    rows = []
    for i, (key, label) in enumerate(METRIC_LABELS):
        value = F.col(key) if key == "model_name" else format_metric(F.col(key).cast("double"))
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("value")))
    return doc.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def flag_best(results: DataFrame) -> DataFrame:
    """Leaderboard with the chosen model (first maximum of Val AUC) flagged."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col("Val AUC").desc(), F.col("Model"))   # <= 5 rows
    return results.withColumn("is_best", F.row_number().over(w) == 1)


def export_csv(scored: DataFrame, path: str, risk: str = "ALL", geo: str = "ALL", min_rv: float = 0.0,
               active: str = "ALL") -> DataFrame:
    """Write the filtered rows (no sort, no row cap) as CSV with a header;
    returns the exported DataFrame."""
    from ..sources.files import write_csv
    rows = export_rows(scored, risk, geo, min_rv, active)
    write_csv(rows, path)
    return rows
