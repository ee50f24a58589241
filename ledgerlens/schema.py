"""Record layouts and fixed values of the monitoring domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Label columns, default cut points, state lifetime, leakage columns.
TARGET_COL = "isMoneyLaundering"
LEGACY_TARGET_COL = "isFraud"
REVIEW_THRESHOLD = 0.65
BLOCK_THRESHOLD = 0.90
STATE_TTL_SECONDS = 86_400
LEAKAGE_COLS = ("fraud_probability", "laundering_typology", "isFraud", "isMoneyLaundering")
VERDICTS = ("CLEAR", "REVIEW", "BLOCK")
ALERT_VERDICTS = ("REVIEW", "BLOCK")
RESOLUTIONS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "ESCALATED", "DISMISSED")

MODEL_VERSION = "stacked_v1"
POLICY_VERSION = "policy_v1"
SCHEMA_VERSION = "1"


@dataclass(frozen=True)
class Policy:
    """Review and block cut points; both bounds belong to the higher class."""

    review: float = REVIEW_THRESHOLD
    block: float = BLOCK_THRESHOLD
    version: str = POLICY_VERSION

    def __post_init__(self) -> None:
        if self.review >= self.block:
            raise ValueError(f"the block cut {self.block} has to lie above the review cut {self.review}")


RAW_CSV = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("isMoneyLaundering", T.IntegerType()),
        T.StructField("laundering_typology", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("fraud_probability", T.DoubleType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("day_of_month", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

LOCATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("city", "state", "country", "postcode")]
)
DEVICE = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "os", "ip_address")])
# Leaves that end up numeric are read as text first, so that a bad number costs only itself.
MERCHANT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("merchant_id", "category", "risk_level", "avg_transaction")
    ]
)
RISK = T.StructType(
    [
        T.StructField("amount_vs_average", T.StringType()),
        T.StructField("customer_risk_score", T.StringType()),
        T.StructField("category_risk", T.StringType()),
        T.StructField("risk_score", T.StringType()),
        T.StructField("unusual_time", T.BooleanType()),
        T.StructField("unusual_location", T.BooleanType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("device_info", DEVICE),
        T.StructField("merchant_info", MERCHANT),
        T.StructField("risk_indicators", RISK),
    ]
)
# Nested group -> prefix of the flat columns.
GROUP_PREFIX = {
    "location": "loc",
    "device_info": "device",
    "merchant_info": "merch",
    "risk_indicators": "risk",
}
NUMERIC_LEAVES = (
    "loc_postcode",
    "merch_avg_transaction",
    "risk_amount_vs_average",
    "risk_customer_risk_score",
    "risk_risk_score",
)

# Event contract: field -> (kind, required).
EVENT_FIELDS = {
    "event_id": ("string", False),
    "source": ("string", False),
    "ingested_at": ("timestamp", False),
    "step": ("int", False),
    "type": ("string", True),
    "amount": ("double", True),
    "category": ("string", True),
    "nameOrig": ("string", True),
    "nameDest": ("string", True),
    "oldbalanceOrg": ("double", True),
    "newbalanceOrig": ("double", True),
    "hour": ("int", False),
    "day_of_week": ("int", False),
    "day_of_month": ("int", False),
    "month": ("int", False),
    "metadata": ("object", False),
    "isMoneyLaundering": ("int", False),
    "isFraud": ("int", False),
}
# Optional fields whose explicit null is accepted; the others need a value when present.
NULLABLE_FIELDS = (
    "hour",
    "day_of_week",
    "day_of_month",
    "month",
    "isMoneyLaundering",
    "isFraud",
)
