"""Merge plans: a user's table, joined to a second one, counted into areas, with measures attached, then written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import joins


@dataclass
class Catalog:
    """Measures by geography: name -> a table with geoid and the measure."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def find(self, phrase: str) -> list[str]:
        """Measures whose name (geography:measure) holds every word of a phrase."""
        if phrase in self.tables:
            return [phrase]
        words = phrase.lower().replace(":", " ").split()
        return [n for n in sorted(self.tables) if all(w in n.lower() for w in words)]


@dataclass
class MergePlan:
    """What to do, always in this order: second table, count, attach."""

    second: DataFrame | None = None
    on: str | None = None
    keep: str = "left"
    count: str | None = None
    attach: list[str] = field(default_factory=list)


@dataclass
class Merged:
    data: DataFrame
    notes: list[str]


def run(spark: SparkSession, user: DataFrame, plan: MergePlan, catalog: Catalog, areas: DataFrame | None = None) -> Merged:
    """Carry out a plan. notes say what matched; nothing found for an asked measure is an error."""
    notes, data = [], user
    if plan.second is not None:
        key = plan.on or (joins.suggested_key(data, plan.second) or (None,))[0]
        if key is None:
            raise ValueError("no key to join on")
        r = joins.merge_report(data, plan.second, key).first()
        notes.append(f"{r['relation']}, matched {r['matched']}, only first {r['only_a']}, only second {r['only_b']}")
        data = joins.merge(data, plan.second, key, plan.keep)
    if plan.count:
        digits = {"state": 2, "county": 5, "tract": 11}[plan.count]
        n = data.groupBy(F.substring("geoid", 1, digits).alias("geoid")).agg(F.count(F.lit(1)).alias("points"))
        data = areas.where(F.length("geoid") == digits).join(n, "geoid", "left").withColumn("points", F.coalesce("points", F.lit(0)).cast("long"))
        notes.append(f"{n.count()} of the areas have points")
    for asked in plan.attach:
        found = catalog.find(asked)
        if not found:
            raise ValueError(f"nothing found for {asked}")
        name = found[0]
        measure = catalog.tables[name]
        before = data.count()
        data = joins.merge(data, measure, "geoid", "left", "_matched")
        notes.append(f"{name}: {data.where('_matched = 3').count()} of {before} rows")
        data = data.drop("_matched")
    return Merged(data, notes)
