"""Scoring requests: JSON record scan (S4) and a request table derived from
the customer base with rule-placed defects, so the contract (V5) and the
what-if defaulting (V7) are exercised on data that grows with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..schema import REQUEST_SCHEMA
from .files import CORRUPT

REQUEST_FIELDS = [f.name for f in REQUEST_SCHEMA.fields]


#: The request schema with a place for the raw text of a malformed record.
INTAKE_SCHEMA = T.StructType([*REQUEST_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


def intake(reader):
    """Options of a JSON reader (batch or stream) that keep malformed records."""
    return reader.schema(INTAKE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def read_requests_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Customer records as JSON lines (or one JSON array with multiline); a
    malformed one keeps its raw text in the ``CORRUPT`` column."""
    return intake(spark.read).option("multiLine", multiline).json(path)


# Fixed rule: defect number k = (RowNumber * 37) % 101; k in 1..15 places one defect
DEFECTS = {
    1: ("CreditScore", 299), 2: ("CreditScore", 851), 3: ("Age", 17), 4: ("Age", 96), 5: ("Tenure", 11),
    6: ("Balance", -1.0), 7: ("NumOfProducts", 0), 8: ("HasCrCard", 2), 9: ("IsActiveMember", None),
    10: ("EstimatedSalary", 0.0), 11: ("Geography", "Italy"), 12: ("Gender", "X"), 13: ("Geography", ""),
    14: ("CreditScore", None), 15: ("Tenure", 0),
}


def defect_number() -> Column:
    return (F.col("RowNumber") * 37) % 101


def requests_from_base(cust: DataFrame) -> DataFrame:
    """One request per customer (raw string categories), defects by rule."""
    k = defect_number()
    cols = []
    for f in REQUEST_SCHEMA.fields:
        expr = F.col(f.name)
        for code, (field, value) in DEFECTS.items():
            if field == f.name:
                expr = F.when(k == code, F.lit(value).cast(f.dataType)).otherwise(expr)
        cols.append(expr.cast(f.dataType).alias(f.name))
    return cust.select(*cols)
