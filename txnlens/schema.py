"""Schemas, fixed domain values and thresholds.

Everything that must equal the analysed SQL workload byte for byte lives here,
so operators never spell a label or a cut-off twice.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

# Raw card-transaction file: 22 named columns plus the unnamed leading index.
# Every column is read as text from CSV (casts happen in ``clean``), so a
# malformed value is never silently turned into NULL by the reader.
RAW_COLUMNS = [
    "idx", "trans_date_trans_time", "cc_num", "merchant", "category", "amt",
    "first", "last", "gender", "street", "city", "state", "zip", "lat", "long",
    "city_pop", "job", "dob", "trans_num", "unix_time", "merch_lat",
    "merch_long", "is_fraud",
]

RAW_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Typed raw schema (parquet / derived sources).
RAW_TYPED_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("trans_date_trans_time", T.TimestampNTZType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", T.DoubleType()),
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("street", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zip", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("city_pop", T.LongType()),
    T.StructField("job", T.StringType()),
    T.StructField("dob", T.DateType()),
    T.StructField("trans_num", T.StringType()),
    T.StructField("unix_time", T.LongType()),
    T.StructField("merch_lat", T.DecimalType(9, 6)),
    T.StructField("merch_long", T.DecimalType(9, 6)),
    T.StructField("is_fraud", T.IntegerType()),
])

# ---------------------------------------------------------------------------
# Fixed values (must match the analysed workload exactly; do not reorder)
# ---------------------------------------------------------------------------

# The 14 known merchant categories.
KNOWN_CATEGORIES = (
    "entertainment", "food_dining", "gas_transport", "grocery_net", "grocery_pos",
    "health_fitness", "home", "kids_pets", "misc_net", "misc_pos", "personal_care",
    "shopping_net", "shopping_pos", "travel",
)

# Validation ranges (inclusive) and domains.
LAT_RANGE = (18, 72)
LONG_RANGE = (-168, -66)
VALID_GENDERS = ("M", "F")
VALID_LABELS = (0, 1)
EXTREME_AMOUNT = 25000

# Age groups: upper bound (exclusive) -> label; last label is the catch-all.
AGE_GROUPS = ((25, "Under 25"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"))
AGE_GROUP_ELSE = "65+"

# Hour-of-day bands (inclusive hour ranges).
TIME_OF_DAY = (((0, 5), "Late Night"), ((6, 11), "Morning"), ((12, 17), "Afternoon"), ((18, 21), "Evening"))
TIME_OF_DAY_ELSE = "Night"
LATE_NIGHT_HOURS = (0, 5)
WEEKEND_DAYS = (1, 7)  # dayofweek: 1 = Sunday, 7 = Saturday

# City population tiers: upper bound (exclusive) -> label.
CITY_TIERS = ((5000, "Rural"), (25000, "Small Town"), (100000, "Mid-size City"), (500000, "Large City"))
CITY_TIER_ELSE = "Metro"
CITY_TIER_ORDER = ("Rural", "Small Town", "Mid-size City", "Large City", "Metro")

# Flat-earth distance: km per degree, "far from home" cut-off in km.
KM_PER_DEGREE = Decimal("111.0")
FAR_FROM_HOME_KM = 100

# Amount buckets of the per-transaction amount feature.
AMOUNT_FEATURE_BUCKETS = ((10, "micro (<$10)"), (50, "small ($10-$50)"), (200, "medium ($50-$200)"),
                          (1000, "large ($200-$1000)"))
AMOUNT_FEATURE_ELSE = "very_large (>$1000)"

# Amount histogram buckets (labels contain an en dash).
AMOUNT_HISTOGRAM = ((10, "1. $0–$10"), (25, "2. $10–$25"), (50, "3. $25–$50"), (100, "4. $50–$100"),
                    (200, "5. $100–$200"), (500, "6. $200–$500"), (1000, "7. $500–$1,000"))
AMOUNT_HISTOGRAM_ELSE = "8. $1,000+"

# Category x amount tier cross-tab.
AMOUNT_TIERS = ((50, "Low (<$50)"), (200, "Medium ($50–$200)"))
AMOUNT_TIER_ELSE = "High (>$200)"

# Distance bands in km (labels contain an en dash).
DISTANCE_BANDS = ((10, "0–10 km"), (25, "10–25 km"), (50, "25–50 km"), (100, "50–100 km"),
                  (250, "100–250 km"), (500, "250–500 km"))
DISTANCE_BAND_ELSE = "500+ km"

# Two-way labels.
WEEKEND_LABELS = ("Weekend", "Weekday")
DISTANCE_GROUP_LABELS = ("Far (>100 km)", "Near (≤100 km)")
FRAUD_LABELS = ("Fraudulent", "Legitimate")
CUSTOMER_TYPE_LABELS = ("First Transaction", "Returning Customer")

# Customer risk score: per-component multiplier and cap; tier cut-offs.
RISK_CAP = 25
RISK_WEIGHTS = {"fraud": 10, "late_night": 2, "far": 3, "amount": 3}
RISK_TIERS = ((50, "High Risk"), (25, "Medium Risk"))
RISK_TIER_ELSE = "Low Risk"
Z_ANOMALY = 2

# State risk labels: ratio to the mean state rate.
STATE_RISK = ((1.5, "High-Risk State"), (1.0, "Above Average"))
STATE_RISK_ELSE = "Below Average"
