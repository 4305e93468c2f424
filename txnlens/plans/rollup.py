"""Reports kept up to date: a store of day partials that grows by loads.

A load reads only its own new files, and these once: the columns that its reports read are staged first.  Its rows become day partials (``operators.rollup``), which are
committed together by one manifest: a load that dies leaves the store as it was, and a
load that is repeated under its name replaces itself.  A report reads the partials of all
loads, never rows.  ``compact`` merges the partials of many loads into one row a day and key.

The store is one ``ManifestTable``: a part for each load, report and kind of partial, and the dictionary, which
gives dense numbers to the values that are counted distinctly and only ever grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rollup
from ..sources.manifest import ManifestTable


class RollupStore:
    def __init__(self, spark: SparkSession, base: str, names=None):
        self.spark = spark
        self.names = list(names or rollup.NAMES)
        self.table = ManifestTable(spark, base)

    # Parts are named "<load>/<report>/<part>" and, for the dictionary, "<load>/<state>/dictionary/<column>".

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.table.base}/{f}" for f in folders]) if folders else None

    def _folders(self, parts: dict[str, str], *suffix: str) -> list[str]:
        return [f for n, f in sorted(parts.items()) if n.endswith("/" + "/".join(suffix))]

    def loads(self) -> list[str]:
        return sorted({n.split("/")[0] for n in self.table.parts()})

    def _numbers(self, features: DataFrame, column: str, known: DataFrame | None) -> DataFrame:
        """New values of ``column`` with the numbers that follow the known ones, dense and without a global sort."""
        values = features.select(F.col(column).alias("value")).where("value is not null").distinct()
        start = 0
        if known is not None:
            values = values.join(known, "value", "left_anti")
            start = known.agg(F.max("number")).first()[0] or 0
        # numbered in a written table, so that a task that runs again numbers alike
        held = self._read([self.table.stage(values.withColumn("at", F.monotonically_increasing_id()))])
        part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        sizes = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a partition
        before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        return held.withColumn("part", part).join(before, "part").select("value", (F.col("before") + row + 1 + start).alias("number"))

    def load(self, name: str, features: DataFrame) -> int:
        """Adds the feature rows of new files as load ``name``; returns the number of the state committed."""
        if "/" in name:
            raise ValueError("the name of a load must not hold '/'")
        versions, parts = self.table.versions(), self.table.parts()
        after = versions[-1] if versions else 0
        # every dictionary and partial scans the rows, which may be long to derive; the staged copy is in no manifest
        features = self._read([self.table.stage(features.select(*rollup.columns_read(self.names)))])
        staged, numbers = {}, {}
        for column in rollup.dictionary_columns(self.names):
            old = self._folders(parts, "dictionary", column)
            fresh = self.table.stage(self._numbers(features, column, self._read(old)))
            staged[f"{name}/{after}/dictionary/{column}"] = fresh
            numbers[column] = self._read([*old, fresh])
        for report in self.names:
            for part, rows in rollup.partials(features, report, numbers).items():
                staged[f"{name}/{report}/{part}"] = self.table.stage(rows)
        # numbers stay, also those of a load that is repeated: other loads may use them
        kept = {n: f for n, f in parts.items() if not n.startswith(f"{name}/") or "/dictionary/" in n}
        return self.table.commit(kept | staged, after)

    def report(self, name: str, days: Column | None = None) -> DataFrame:
        """A report of all loads, of all days or those for which ``days`` (over the column ``day``) holds."""
        parts = self.table.parts()
        return rollup.report(name, {p: self._read(self._folders(parts, name, p)) for p in ("sums", *rollup.rollup(name).distinct)}, days)

    def compact(self) -> int:
        """Merges the partials of all loads into one row a day and key; they become the load ``compacted``."""
        versions, parts = self.table.versions(), self.table.parts()
        staged = {n: f for n, f in parts.items() if "/dictionary/" in n}
        for name in self.names:
            r = rollup.rollup(name)
            keys = ["day", *[f"k_{k}" for k in r.keys]]
            sums = self._read(self._folders(parts, name, "sums"))
            types = dict(sums.dtypes)
            merged = {"sums": sums.groupBy(*keys).agg(*[rollup.PARTS[p][1](p).cast(types[p]).alias(p) for p in r.parts])}
            for out in r.bits:
                merged[out] = self._read(self._folders(parts, name, out)).groupBy(*keys, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
            for out in r.sets:
                numbers = self._read(self._folders(parts, name, out)).select(*keys, F.explode("_number").alias("number"))
                merged[out] = numbers.groupBy(*keys).agg(F.array_sort(F.collect_set("number")).alias("_number"))
            # staged before the commit; the loads' own parts go with their manifest (``vacuum``)
            for part, rows in merged.items():
                staged[f"compacted/{name}/{part}"] = self.table.stage(rows)
        return self.table.commit(staged, after=versions[-1])


def two_loads(features: DataFrame, name: str, base: str) -> DataFrame:
    """The report ``name`` over a new store, into which the odd and the even days of ``features`` are loaded one after the other."""
    store = RollupStore(features.sparkSession, base, [name])
    for load in (0, 1):
        store.load(f"load-{load}", features.where(F.dayofmonth(rollup.DAY) % 2 == load))
    return store.report(name)
