"""Data quality: table gates (V1-V3), column profile (V4), row contract (V5),
column-presence selection (V6) and what-if defaulting (V7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import CORRUPT
from ..schema import CONTRACT_BOUNDS, GENDER_CODES, GEOGRAPHY_CODES, LABEL, LABEL_RATE_RANGE, WHATIF_DEFAULTS

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _gate_measures(columns: list[str], label: str) -> list[Column]:
    """What V1-V3 look at: rows, null cells and the label rate."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return [F.count("*").cast("long").alias("rows"), nulls.cast("long").alias("null_cells"), F.avg(F.col(label)).alias("_rate")]


def _gate_flags(row: DataFrame, expected_rows: int | None, max_rows: int | None, rate_range: tuple[float, float]) -> DataFrame:
    n = F.col("rows")
    rows_ok = n == expected_rows if expected_rows is not None else n > 0
    if max_rows is not None:
        rows_ok = rows_ok & (n <= max_rows)
    return row.select("rows", "null_cells", F.bround("_rate", 6).alias("label_rate"),
                      rows_ok.alias("rows_ok"), (F.col("null_cells") == 0).alias("nulls_ok"),
                      F.col("_rate").between(*rate_range).alias("label_rate_ok"))


def quality_gates(df: DataFrame, expected_rows: int | None = None, max_rows: int | None = None,
                  label: str = LABEL, rate_range: tuple[float, float] = LABEL_RATE_RANGE) -> DataFrame:
    """V1-V3 in one aggregate: row count, total null cells, label rate, and
    a pass flag per gate."""
    return _gate_flags(df.agg(*_gate_measures(df.columns, label)), expected_rows, max_rows, rate_range)


class Gates:
    """V1-V3 taken from the pass that stores a table: write ``watched``, then ask
    for the ``result``; the table is not read again for it.

    Give it a frame of a session of its own (``spark.newSession()``): once a
    session has been observed, Spark can't send to the executors what refers to
    that session, as a freshly fitted model's summary does."""

    def __init__(self, df: DataFrame, label: str = LABEL):
        self.seen = Observation("gates")
        self.spark = df.sparkSession
        self.watched = df.observe(self.seen, *_gate_measures(df.columns, label))

    def result(self, expected_rows: int | None = None, max_rows: int | None = None,
               rate_range: tuple[float, float] = LABEL_RATE_RANGE) -> DataFrame:
        """The row that ``quality_gates`` gives; waits for the write."""
        m = self.seen.get
        row = self.spark.createDataFrame([(m["rows"], m["null_cells"], m["_rate"])], "rows long, null_cells long, _rate double")
        return _gate_flags(row, expected_rows, max_rows, rate_range)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """V4: count, mean, sample std, min, 25/50/75 % (exact, interpolated), max
    per numeric column; one aggregate, then unpivot to one row per column.
    The quantiles of all columns are searched together (see ``quantile``)."""
    from .quantile import quantiles
    cols = cols or numeric_columns(df)
    found = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        q = F.array(*[F.lit(found[c, q]).cast("double") for q in (0.25, 0.5, 0.75)])
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.first(q).alias(f"q{i}"), F.max(x).alias(f"max{i}")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("long").alias("count"),
                        F.bround(F.col(f"mean{i}"), 4).alias("mean"), F.bround(F.col(f"std{i}"), 4).alias("std"),
                        F.col(f"min{i}").alias("min"), F.bround(F.col(f"q{i}")[0], 4).alias("p25"),
                        F.bround(F.col(f"q{i}")[1], 4).alias("p50"), F.bround(F.col(f"q{i}")[2], 4).alias("p75"),
                        F.col(f"max{i}").alias("max")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# Rule codes of the row contract, in field order
def contract_rules() -> dict[str, Column]:
    rules = {}
    for name, (lo, hi) in CONTRACT_BOUNDS.items():
        rules[f"{name}_range"] = F.col(name).between(lo, hi)
    rules["Balance_range"] = F.col("Balance") >= 0
    rules["EstimatedSalary_range"] = F.col("EstimatedSalary") > 0
    rules["Geography_value"] = F.col("Geography").isin(*GEOGRAPHY_CODES.keys())
    rules["Gender_value"] = F.col("Gender").isin(*GENDER_CODES.keys())
    return rules


RULE_ORDER = ["CreditScore_range", "Age_range", "Tenure_range", "NumOfProducts_range", "HasCrCard_range",
              "IsActiveMember_range", "Balance_range", "EstimatedSalary_range", "Geography_value", "Gender_value"]


def validate(requests: DataFrame) -> DataFrame:
    """V5: add ``violations`` (array of rule codes); a null field violates
    its rule.  Valid rows have an empty array."""
    rules = contract_rules()
    arr = F.array(*[F.when(~F.coalesce(rules[r], F.lit(False)), F.lit(r)) for r in RULE_ORDER])
    if CORRUPT in requests.columns:                 # a record that can't be read breaks this rule alone
        arr = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("malformed_record"))).otherwise(arr)
    return requests.withColumn("violations", F.array_compact(arr))


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = validate(requests)
    return (v.where(F.size("violations") == 0).drop("violations", CORRUPT),
            v.where(F.size("violations") > 0))


def violation_counts(requests: DataFrame) -> DataFrame:
    """Count of requests breaking each rule (rules with no violation omitted)."""
    return (validate(requests).select(F.explode("violations").alias("rule"))
            .groupBy("rule").agg(F.count("*").cast("long").alias("violations")))


def whatif_defaults(requests: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """V7: missing inputs take defaults; IsActiveMember defaults only when
    null; HasCrCard is always 1.  By default only null (or an empty string)
    is missing.  ``zero_is_missing=True`` reproduces the original form
    handling, where a real 0 (e.g. tenure 0) was also replaced."""
    d = WHATIF_DEFAULTS

    def num(c: str) -> Column:
        x = F.nullif(F.col(c), F.lit(0)) if zero_is_missing else F.col(c)
        return F.coalesce(x, F.lit(d[c]))

    def txt(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d[c]))

    ids = [F.col("CustomerId")] if "CustomerId" in requests.columns else []
    return requests.select(
        *ids,
        num("CreditScore").cast("int").alias("CreditScore"), txt("Geography").alias("Geography"),
        txt("Gender").alias("Gender"), num("Age").cast("int").alias("Age"), num("Tenure").cast("int").alias("Tenure"),
        num("Balance").cast("double").alias("Balance"), num("NumOfProducts").cast("int").alias("NumOfProducts"),
        F.lit(1).alias("HasCrCard"),
        F.coalesce(F.col("IsActiveMember"), F.lit(d["IsActiveMember"])).cast("int").alias("IsActiveMember"),
        num("EstimatedSalary").cast("double").alias("EstimatedSalary"))
