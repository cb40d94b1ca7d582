"""As-of state in versions: totals of each entity at the start of blocks of days, and a log of the rows of each block.

A question for a day takes the totals at the start of the day's block and replays the block's rows before the day: whatever the order of the
questions, and for days long before the newest version. Blocks should have about as many rows as there are entities: then the totals of all blocks are no more than the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Steps
from .history import Spec, day_number

#: How two parts of a total are put together.
MERGE = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "max": F.greatest, "min": F.least}
AGG = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


@dataclass
class AsOfState:
    """`log`: (key, day, block, values) and `state`: (key, block, totals before the block), both as tables by block."""

    specs: Sequence[Spec]
    key: str
    day: str
    days_per_block: int
    log: DataFrame
    state: DataFrame

    def block(self, day: Column) -> Column:
        return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / self.days_per_block).cast("int")

    @classmethod
    def build(cls, obs: DataFrame, specs: Sequence[Spec], days_per_block: int, key: str = "entity_id", day: str = "event_day", steps: Steps | None = None) -> AsOfState:
        """Writes both tables. Specs take sums, counts, maxima and minima over all earlier rows; undated rows and rows without a key are left out."""
        if any(s.agg not in MERGE or s.months for s in specs):
            raise ValueError("state takes sums, counts, maxima and minima of whole histories")
        steps = steps or Steps(obs.sparkSession, "asof")
        out = cls(specs, key, day, days_per_block, obs, obs)
        one = lambda s: F.when(s.value.isNotNull(), 1).otherwise(0) if s.agg == "count" else s.value
        rows = obs.filter(F.col(day).isNotNull() & F.col(key).isNotNull()).select(key, day, *[one(s).alias(f"v_{s.name}") for s in specs], out.block(F.col(day)).alias("block"))
        out.log = steps.write(rows, "log", by="block")
        sums = out.log.groupBy(key, "block").agg(*[AGG[s.agg](f"v_{s.name}").alias(s.name) for s in specs])
        last = F.lit(out.log.agg(F.max("block")).first()[0] or 0)
        run = Window.partitionBy(key).orderBy("block")
        so_far = run.rowsBetween(Window.unboundedPreceding, 0)
        # totals after a block with rows hold until the next one with rows, itself included
        after = sums.select(key, "block", *[AGG[s.agg](s.name).over(so_far).alias(s.name) for s in specs], F.least(F.coalesce(F.lead("block").over(run), last + 1), last + 1).alias("_until"))
        out.state = steps.write(after.select(key, *[s.name for s in specs], F.explode(F.sequence(F.col("block") + 1, F.col("_until"))).alias("block")), "state", by="block")
        return out

    def at(self, day: str) -> DataFrame:
        """(key, totals) of all entities with rows before one day. Reads one block of each table: others are pruned."""
        when = F.lit(day).cast("date")
        block = self.log.sparkSession.range(1).select(self.block(when)).first()[0]
        part = self.log.filter((F.col("block") == block) & (F.col(self.day) < when)).select(self.key, *[F.col(f"v_{s.name}").alias(s.name) for s in self.specs])
        newest = self.log.agg(F.max("block")).first()[0]
        held = self.state.filter(F.col("block") == (block if newest is None else min(block, newest + 1))).select(self.key, *[s.name for s in self.specs])
        return held.unionByName(part).groupBy(self.key).agg(*[self._whole(s, AGG[s.agg](s.name)).alias(s.name) for s in self.specs])

    @staticmethod
    def _whole(s: Spec, total: Column) -> Column:
        return F.coalesce(total, F.lit(0)) if s.agg in ("sum", "count") else total

    def lookup(self, requests: DataFrame) -> DataFrame:
        """requests (key, day) with the totals before each day, and rows_read: of the log, what lies in the day's block before the day.

        Requests and the rows of their blocks are put in one order by key and block: no range join, and as many rows as both have. An entity
        without earlier rows has zero sums and null extremes.
        """
        newest = self.log.agg(F.max("block")).first()[0]
        block = self.block(F.col(self.day)) if newest is None else F.least(self.block(F.col(self.day)), F.lit(newest + 1))
        asked = requests.select(F.col(self.key), F.col(self.day)).distinct().filter(F.col(self.day).isNotNull() & F.col(self.key).isNotNull()).withColumn("block", block)
        rows = self.log.join(asked.select(self.key, "block").distinct(), [self.key, "block"], "left_semi").withColumn("_row", F.lit(1))
        both = rows.unionByName(asked, allowMissingColumns=True)
        earlier = Window.partitionBy(self.key, "block").orderBy(day_number(self.day)).rangeBetween(Window.unboundedPreceding, -1)
        read = both.withColumns({f"_{s.name}": AGG[s.agg](f"v_{s.name}").over(earlier) for s in self.specs} | {"rows_read": F.coalesce(F.sum("_row").over(earlier), F.lit(0))}).filter("_row is null")
        held = self.state.select(self.key, "block", *[F.col(s.name).alias(f"s_{s.name}") for s in self.specs])
        joined = read.join(held, [self.key, "block"], "left")

        def total(s: Spec) -> Column:
            a, b = F.col(f"s_{s.name}"), F.col(f"_{s.name}")
            both_ = MERGE[s.agg](F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))) if s.agg in ("sum", "count") else MERGE[s.agg](a, b)
            return both_.alias(s.name)

        found = joined.select(self.key, self.day, *[total(s) for s in self.specs], "rows_read")
        return requests.join(found, [self.key, self.day], "left")
