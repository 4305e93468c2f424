"""Reports from day partials that add up: each report is stated once, as keys, mergeable parts and a result.

A part is a sum, a count, a minimum, a maximum or a set of distinct values; every other figure (rates,
means, standard deviations) is an expression over merged parts, so a report over any union of
days equals the report over their rows:

* money and its squares are summed as exact decimals, so STDDEV merges without loss;
* distinct values of a key with many of them are bits of exact bitmaps over a dictionary's dense
  numbers, one row of 32,768 bits a key and range of numbers;
* distinct values of a key with few (a card's merchants) are sets of numbers.

``partials`` makes the day rows of some feature rows, ``report`` the report of some day rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semantics as X

DAY = "transaction_date"

#: Mergeable parts: what a part is over rows, and how parts of one kind merge.
PARTS: dict[str, tuple[Callable[[], Column], Callable[[str], Column]]] = {
    "n": (lambda: X.n_rows(), F.sum),
    "fraud": (lambda: F.sum("is_fraud").cast("long"), F.sum),
    "value": (lambda: F.sum("amount"), F.sum),
    "value_n": (lambda: F.count("amount"), F.sum),
    "squares": (lambda: F.sum((F.col("amount") * F.col("amount")).cast("decimal(24,4)")), F.sum),
    "fraud_value": (lambda: F.sum(X.fraud_amount()), F.sum),
    "fraud_value_n": (lambda: F.count(X.fraud_amount()), F.sum),
    "legit_value": (lambda: F.sum(X.legit_amount()), F.sum),
    "legit_value_n": (lambda: F.count(X.legit_amount()), F.sum),
    "min_age": (lambda: F.min("customer_age"), F.min),
    "km": (lambda: F.sum("geo_distance_km"), F.sum),
    "km_n": (lambda: F.count("geo_distance_km"), F.sum),
    "first": (lambda: F.min(DAY), F.min),
    "last": (lambda: F.max(DAY), F.max),
    "low": (lambda: F.min("amount"), F.min),
    "high": (lambda: F.max("amount"), F.max),
}

#: The columns of a feature row that each part reads.
PART_READS: dict[str, tuple[str, ...]] = {
    "n": (), "fraud": ("is_fraud",), "value": ("amount",), "value_n": ("amount",), "squares": ("amount",),
    **dict.fromkeys(("fraud_value", "fraud_value_n", "legit_value", "legit_value_n"), ("is_fraud", "amount")),
    "min_age": ("customer_age",), "km": ("geo_distance_km",), "km_n": ("geo_distance_km",), "first": (DAY,), "last": (DAY,), "low": ("amount",), "high": ("amount",),
}
#: Keys that are not a column of their name -> the column they are made of.
KEY_READS = {"month": DAY, "age_group": "customer_age"}


def _money(c: str) -> Column:
    return F.round(F.col(c), 2)


def _mean(total: str, n: str) -> Column:
    return F.round(F.col(total) / F.nullif(F.col(n), F.lit(0)), 2)


def _rate(scale: int = 4) -> Column:
    return X.rate(F.col("fraud"), F.col("n"), scale)


def stddev(total: str = "value", squares: str = "squares", n: str = "value_n") -> Column:
    """Sample standard deviation from exact sums: ``n * squares - total ** 2`` is exact before the one division."""
    k = F.col(n).cast("decimal(12,0)")
    spread = (k * F.col(squares).cast("decimal(25,4)")) - (F.col(total).cast("decimal(18,2)") * F.col(total).cast("decimal(18,2)"))
    return F.when(F.col(n) > 1, F.sqrt(spread.cast("double") / (F.col(n).cast("double") * (F.col(n) - 1))))


@dataclass(frozen=True)
class Rollup:
    """``keys``: name -> column of a feature row; ``columns``: name -> column over keys and merged parts.

    A report that counts distinct values has a key at least.
    """

    keys: dict[str, Column]
    parts: tuple[str, ...]
    columns: dict[str, Column]
    bits: dict[str, str] = field(default_factory=dict)  # name -> column with many distinct values a key
    sets: dict[str, str] = field(default_factory=dict)  # name -> column with few
    order: tuple = ()
    where: Column | None = None
    limit: int | None = None

    @property
    def distinct(self) -> dict[str, str]:
        return self.bits | self.sets


def _fraud(*more: str) -> tuple[str, ...]:
    return ("n", "fraud", *more)


def _same(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


#: The reports that can be kept up to date.
NAMES = (
    "fraud_summary",
    "fraud_by_category",
    "monthly_trend",
    "fraud_by_hour",
    "weekday_vs_weekend",
    "fraud_by_gender",
    "fraud_by_age_group",
    "fraud_by_city_tier",
    "far_vs_near",
    "top_fraud_merchants",
    "customer_summary",
    "fraud_by_job",
    "fraud_by_state",
    "top_fraud_cities",
    "daily_volume",
    "merchant_summary",
    "amount_moments",
)


def rollup(name: str) -> Rollup:
    return _rollups()[name]


def _rollups() -> dict[str, Rollup]:  # columns need a running session
    totals = {"total_txns": F.col("n"), "fraud_count": F.col("fraud"), "fraud_rate_pct": _rate()}
    fraud_mean = {"avg_fraud_amount": _mean("fraud_value", "fraud_value_n")}
    fraud_parts = ("fraud_value", "fraud_value_n")
    return {
        "fraud_summary": Rollup({}, _fraud("value", *fraud_parts, "legit_value", "legit_value_n"), {
            "total_transactions": F.col("n"), "total_fraud_cases": F.col("fraud"), "total_legit_cases": F.col("n") - F.col("fraud"), "fraud_rate_pct": _rate(),
            "total_transaction_value": _money("value"), "total_fraud_value": _money("fraud_value"), "fraud_value_pct": X.rate(F.col("fraud_value"), F.col("value")),
            **fraud_mean, "avg_legit_amount": _mean("legit_value", "legit_value_n")}),
        "fraud_by_category": Rollup(_same("category"), _fraud("value", *fraud_parts), {
            **_same("category"), **totals, "total_value": _money("value"), "fraud_value": _money("fraud_value"), **fraud_mean}, order=(F.desc("fraud_rate_pct"), "category")),
        "monthly_trend": Rollup({"month": F.trunc(DAY, "month")}, _fraud("fraud_value"), {**_same("month"), **totals, "fraud_value": _money("fraud_value")}, order=("month",)),
        "fraud_by_hour": Rollup(_same("transaction_hour"), _fraud(*fraud_parts), {**_same("transaction_hour"), **totals, **fraud_mean}, order=("transaction_hour",)),
        "weekday_vs_weekend": Rollup(_same("is_weekend"), _fraud("value", "value_n"), {
            "day_type": F.when(F.col("is_weekend") == 1, S.WEEKEND_LABELS[0]).otherwise(S.WEEKEND_LABELS[1]), **totals, "avg_transaction_amount": _mean("value", "value_n")}),
        "fraud_by_gender": Rollup(_same("gender"), _fraud(*fraud_parts, "legit_value", "legit_value_n"), {
            **_same("gender"), **totals, **fraud_mean, "avg_legit_amount": _mean("legit_value", "legit_value_n")}),
        "fraud_by_age_group": Rollup({"age_group": X.age_group("customer_age")}, _fraud(*fraud_parts, "min_age"), {**_same("age_group"), **totals, **fraud_mean}, order=("min_age",)),
        "fraud_by_city_tier": Rollup(_same("city_tier"), _fraud(*fraud_parts), {**_same("city_tier"), **totals, **fraud_mean}, order=(F.desc("fraud_rate_pct"), "city_tier")),
        "far_vs_near": Rollup(_same("is_far_from_home"), _fraud(), {
            "distance_group": F.when(F.col("is_far_from_home") == 1, S.DISTANCE_GROUP_LABELS[0]).otherwise(S.DISTANCE_GROUP_LABELS[1]), **totals}),
        "top_fraud_merchants": Rollup(_same("merchant_name", "category"), _fraud("fraud_value"), {
            **_same("merchant_name", "category"), "fraud_count": F.col("fraud"), "total_fraud_value": _money("fraud_value"), "fraud_rate_pct": _rate(2)},
            order=(F.desc_nulls_last("total_fraud_value"), "merchant_name", "category"), limit=10),
        "customer_summary": Rollup(
            _same("card_number", "full_name", "gender", "customer_age", "city", "state", "job", "city_tier"), _fraud("value", "value_n", "fraud_value", "first", "last"), {
                **_same("card_number", "full_name", "gender", "customer_age", "city", "state", "job", "city_tier"),
                "total_transactions": F.col("n"), "fraud_count": F.col("fraud"), "fraud_rate_pct": _rate(2), "total_spend": _money("value"), "total_fraud_amount": _money("fraud_value"),
                "avg_transaction_amount": _mean("value", "value_n"), "first_transaction": F.col("first"), "last_transaction": F.col("last"), **_same("unique_categories", "unique_merchants")},
            sets={"unique_categories": "category", "unique_merchants": "merchant_name"}, order=(F.desc("fraud_count"), "card_number", "customer_age")),
        "fraud_by_job": Rollup(_same("job"), _fraud("value", "value_n", *fraud_parts), {
            **_same("job", "unique_customers"), "total_transactions": F.col("n"), "fraud_count": F.col("fraud"), "fraud_rate_pct": _rate(),
            "avg_transaction_amount": _mean("value", "value_n"), **fraud_mean},
            bits={"unique_customers": "card_number"}, where=F.col("n") >= 10, order=(F.desc_nulls_last("fraud_rate_pct"), "job"), limit=25),
        "fraud_by_state": Rollup(_same("state"), _fraud("value", *fraud_parts), {
            **_same("state"), "total_transactions": F.col("n"), "fraud_count": F.col("fraud"), "fraud_rate_pct": _rate(), "total_value": _money("value"), "fraud_value": _money("fraud_value"),
            **fraud_mean, **_same("unique_cards", "unique_merchants")},
            bits={"unique_cards": "card_number", "unique_merchants": "merchant_name"}, order=(F.desc("fraud_rate_pct"), "state")),
        "top_fraud_cities": Rollup(_same("city", "state", "city_pop", "city_tier"), _fraud("fraud_value"), {
            **_same("city", "state", "city_pop", "city_tier"), "total_transactions": F.col("n"), "fraud_count": F.col("fraud"), "fraud_rate_pct": _rate(), "total_fraud_value": _money("fraud_value")},
            order=(F.desc("fraud_count"), "city", "state", "city_pop", "city_tier"), limit=20),
        "daily_volume": Rollup(_same(DAY), _fraud("value", "fraud_value"), {**_same(DAY), **totals, "total_value": _money("value"), "fraud_value": _money("fraud_value")}, order=(DAY,)),
        "merchant_summary": Rollup(_same("merchant_name", "category"), _fraud("value", "value_n", "fraud_value", "km", "km_n"), {
            **_same("merchant_name", "category"), "total_txns": F.col("n"), **_same("unique_customers"), "fraud_count": F.col("fraud"), "fraud_rate_pct": _rate(),
            "total_revenue": _money("value"), "avg_transaction": _mean("value", "value_n"), "fraud_value": _money("fraud_value"),
            "avg_customer_distance_km": F.round(F.col("km") / F.nullif(F.col("km_n"), F.lit(0)), 1)},
            bits={"unique_customers": "card_number"}, order=(F.desc("fraud_rate_pct"), "merchant_name", "category")),
        # the moments of each label's amounts: STDDEV merges, too
        "amount_moments": Rollup(_same("is_fraud"), ("n", "value", "value_n", "squares", "low", "high"), {
            **_same("is_fraud"), "txn_count": F.col("n"), "avg_amount": _mean("value", "value_n"), "min_amount": _money("low"), "max_amount": _money("high"), "std_amount": F.round(stddev(), 2)},
            order=("is_fraud",)),
    }


_NUMBER, _BUCKET, _BITS = "_number", "_bucket", "_bits"


def dictionary_columns(names) -> list[str]:
    """The columns whose distinct values the reports ``names`` count, in order."""
    return sorted({c for n in names for c in rollup(n).distinct.values()})


def columns_read(names) -> list[str]:
    """The columns of a feature row that the reports ``names`` read, in order."""
    found = {DAY, *dictionary_columns(names)}
    for r in map(rollup, names):
        found |= {KEY_READS.get(k, k) for k in r.keys} | {c for p in r.parts for c in PART_READS[p]}
    return sorted(found)


def _keyed(f: DataFrame, r: Rollup) -> DataFrame:
    """Feature rows with the report's keys as ``k_<name>``: a key may be named as a column of another meaning."""
    return f.withColumns({f"k_{name}": c for name, c in r.keys.items()})


def partials(f: DataFrame, name: str, numbers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The day rows of feature rows ``f``: part ``sums``, and one part for each distinct count.

    ``numbers``: column -> table of ``value`` and dense ``number``.
    """
    r = rollup(name)
    keys = [f"k_{k}" for k in r.keys]
    rows = _keyed(f, r)
    found = {"sums": rows.groupBy(F.col(DAY).alias("day"), *keys).agg(*[PARTS[p][0]().alias(p) for p in r.parts])}
    for out, column in r.distinct.items():
        # distinct values first, so that each meets the dictionary once a day and key
        values = rows.select(F.col(DAY).alias("day"), *keys, F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
        numbered = values.join(numbers[column], "value")
        if out in r.bits:
            found[out] = numbered.groupBy("day", *keys, F.bitmap_bucket_number(F.col("number")).alias(_BUCKET)).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(F.col("number"))).alias(_BITS))
        else:
            found[out] = numbered.groupBy("day", *keys).agg(F.array_sort(F.collect_set("number")).alias(_NUMBER))
    return found


def report(name: str, parts: dict[str, DataFrame], days: Column | None = None) -> DataFrame:
    """The report of the day rows ``parts`` (as ``partials`` makes them), of all days or those where ``days`` holds."""
    r = rollup(name)
    keys = [f"k_{k}" for k in r.keys]
    chosen = {n: p if days is None else p.where(days) for n, p in parts.items()}
    types = dict(chosen["sums"].dtypes)
    # sums in the parts' own types: a wider decimal would leave a quotient fewer digits
    merged = chosen["sums"].groupBy(*keys).agg(*[PARTS[p][1](p).cast(types[p]).alias(p) for p in r.parts])
    for out in r.distinct:
        if out in r.bits:
            ranges = chosen[out].groupBy(*keys, _BUCKET).agg(F.bitmap_count(F.bitmap_or_agg(_BITS)).alias("held"))
            counts = ranges.groupBy(*keys).agg(F.sum("held").alias(out))
        else:
            counts = chosen[out].select(*keys, F.explode(_NUMBER).alias("number")).distinct().groupBy(*keys).agg(F.count("number").alias(out))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        merged = merged.alias("a").join(counts.alias("b"), same, "left").select("a.*", F.coalesce(F.col(f"b.{out}"), F.lit(0)).alias(out))
    if r.where is not None:
        merged = merged.where(r.where)
    held = [p for p in r.parts if p not in r.columns]
    shown = merged.select(*[F.col(k).alias(k[2:]) for k in keys], *r.parts, *r.distinct)
    shown = shown.select(*[c.alias(n) for n, c in r.columns.items()], *held)
    if r.order:
        shown = shown.orderBy(*r.order)
    if r.limit:
        shown = shown.limit(r.limit)
    return shown.select(*r.columns)
