"""Sequential rating folds.

A rating depends on all earlier contests of both sides, so the order of contests cannot be given up: a fold is one ordered
pass. It is split where it can be.

`rating_snapshots` streams narrow rows, sorted by Spark, through one task for each group, or one for the overall rating. Such a task keeps a
number for each entity, about 300 bytes, and does some 180,000 contests a second.

`rating_snapshots_in_blocks` cuts time into blocks of days. Contests of a block that share no entity, directly or through others, don't
depend on each other, so the connected components of a block are folded side by side, each from the ratings that the block before left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import CHUNK, Steps, connected_components, least_connected

SNAPSHOT = "contest_id bigint, event_day date, grp string, entity_a bigint, entity_b bigint, rating_a double, rating_b double, updates_a bigint, updates_b bigint"


def decisive_pairs(obs: DataFrame) -> DataFrame:
    """One row for each contest: entity_a < entity_b, and score_a: 1, 0, or null if it isn't decisive."""
    rows = obs.filter("entity_id < opponent_id").select("contest_id", "event_day", "grp", F.col("entity_id").alias("entity_a"), F.col("opponent_id").alias("entity_b"), F.col("won").cast("double").alias("score_a"))
    return rows.filter("event_day is not null")


class _Fold:
    def __init__(self, k: float, start: float, frozen: bool, unknown_half: bool):
        self.k, self.start, self.frozen, self.unknown_half = k, start, frozen, unknown_half
        self.rating: dict = {}
        self.updates: dict = {}
        self.day, self.at_dawn = None, {}

    def row(self, day, group, a, b, score) -> tuple[float, float, int, int]:
        """Ratings before the contest; then the contest is folded in. Frozen: a day's snapshots show the state of its dawn."""
        if day != self.day:
            self.day, self.at_dawn = day, {}
        ka, kb = (group, a), (group, b)
        now = [(self.rating.get(x, self.start), self.updates.get(x, 0)) for x in (ka, kb)]
        seen = [self.at_dawn.setdefault(x, v) for x, v in zip((ka, kb), now, strict=True)] if self.frozen else now
        if score == score and score is not None or self.unknown_half:
            s = score if score == score and score is not None else 0.5
            ra, rb = now[0][0], now[1][0]
            gain = self.k * (s - 1 / (1 + 10 ** ((rb - ra) / 400)))
            self.rating[ka], self.rating[kb] = ra + gain, rb - gain
            self.updates[ka], self.updates[kb] = now[0][1] + 1, now[1][1] + 1
        return seen[0][0], seen[1][0], seen[0][1], seen[1][1]

    def rows(self, days, groups, a, b, scores) -> list[tuple]:
        """row() for each contest in order; without groups all are in one."""
        if groups is not None:
            return [self.row(*x) for x in zip(days, groups, a, b, scores, strict=True)]
        rating, updates, k, start, half, frozen = self.rating, self.updates, self.k, self.start, self.unknown_half, self.frozen
        day, dawn, out = self.day, self.at_dawn, []
        for d, x, y, s in zip(days, a, b, scores, strict=True):
            if d != day:
                day, dawn = d, {}
            rx, ry, ux, uy = rating.get(x, start), rating.get(y, start), updates.get(x, 0), updates.get(y, 0)
            if frozen:
                (sx, vx), (sy, vy) = dawn.setdefault(x, (rx, ux)), dawn.setdefault(y, (ry, uy))
                out.append((sx, sy, vx, vy))
            else:
                out.append((rx, ry, ux, uy))
            if s != s:
                if not half:
                    continue
                s = 0.5
            gain = k * (s - 1 / (1 + 10 ** ((ry - rx) / 400)))
            rating[x], rating[y], updates[x], updates[y] = rx + gain, ry - gain, ux + 1, uy + 1
        self.day, self.at_dawn = day, dawn
        return out


def _dealt(pairs: DataFrame, by_group: bool) -> DataFrame:
    """pairs in the order of the fold, in a task for each group or in one."""
    return (pairs.repartition("grp") if by_group else pairs.repartition(1)).sortWithinPartitions("event_day", "contest_id")


def _lists(b: pa.RecordBatch, by_group: bool) -> tuple:
    """days as numbers, groups or None, both sides, scores with NaN for none: what _Fold.rows takes."""
    number = lambda c: b.column(c).to_numpy(zero_copy_only=False).tolist()
    return b.column("event_day").cast(pa.int32()).to_pylist(), b.column("grp").to_pylist() if by_group else None, number("entity_a"), number("entity_b"), number("score_a")


def rating_snapshots(obs: DataFrame, by_group: bool = True, k: float = 32.0, start: float = 1500.0, frozen: bool = True, unknown_half: bool = False, with_score: bool = False) -> DataFrame:
    """Ratings of both sides before each contest, one row for each contest.

    Contests fold in by day and, within a day, by id. by_group keeps separate ratings for each group, in as many tasks as there
    are groups. unknown_half counts contests that aren't decisive as half won by both; else they change nothing. with_score keeps score_a (null if not decisive).
    """
    pairs = decisive_pairs(obs).select("event_day", "contest_id", "grp", "entity_a", "entity_b", "score_a")
    kept = ["event_day", "contest_id", "grp", "entity_a", "entity_b", *(["score_a"] if with_score else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(k, start, frozen, unknown_half)
        for b in batches:
            seen = list(zip(*fold.rows(*_lists(b, by_group)), strict=True)) or [()] * 4
            made = [pa.array(x, t) for x, t in zip(seen, (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *made], [*kept, "rating_a", "rating_b", "updates_a", "updates_b"])

    schema = SNAPSHOT.replace("contest_id bigint, event_day date", "event_day date, contest_id bigint")
    return _dealt(pairs, by_group).mapInArrow(run, schema.replace("entity_b bigint", "entity_b bigint, score_a double") if with_score else schema)


def _blocks_of(days: list[tuple], most: int) -> list[tuple]:
    """(day, first day of its block): days in order are put together while they hold no more than `most` contests."""
    out, first, held = [], None, 0
    for day, n in days:
        if first is None or held + n > most:
            first, held = day, 0
        held += n
        out.append((day, first))
    return out


def _whole_blocks(rows: DataFrame) -> DataFrame:
    """rows (block, u, v and others) with component in place of u and v, where no block has more than CHUNK rows: a task joins whole blocks, CHUNK rows at a time."""
    kept = [c for c in rows.columns if c not in ("u", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(t: pa.Table) -> list[pa.RecordBatch]:
            names, least, at = least_connected(t.column("u").to_numpy(), t.column("v").to_numpy())
            return t.select(kept).append_column("component", pa.array(names[least[at]])).to_batches(max_chunksize=1 << 16)

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) > CHUNK:
                t = pa.Table.from_batches(held)
                block = t.column("block").cast(pa.int32()).to_numpy()
                if cut := int(np.searchsorted(block, block[-1])):  # the last block may go on
                    yield from joined(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield from joined(pa.Table.from_batches(held))

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "component bigint"]))


def component_blocks(pairs: DataFrame, most: int, steps: Steps, by_group: bool = False, longest_first: bool = True, by: str | None = None) -> DataFrame:
    """pairs with block (the first day of it) and component: contests of one block are in different components if no chain of entities connects them.

    Blocks begin with `most` contests, or a quarter of the number of entities if that is more, and are halved, by days, as long as a component has more than `most`
    contests. A single day isn't cut. Without longest_first they begin with `most` contests whatever the number of entities. What the driver holds is a number for each day.

    Blocks of CHUNK contests or fewer are dealt out whole, a shuffle of narrow rows, and joined where they are; the components of larger ones are found by all tasks. by: the column
    by which what is written is laid out.
    """
    spark = pairs.sparkSession
    # two vertices with one hash only join two components
    of = lambda x: F.xxhash64(F.col("block"), F.col("grp") if by_group else F.lit(""), F.col(f"entity_{x}"))
    pairs = steps.write(pairs)
    days = [(r.event_day, r.n) for r in pairs.groupBy("event_day").agg(F.count(F.lit(1)).alias("n")).orderBy("event_day").collect()]
    entities = pairs.select(F.explode(F.array("entity_a", "entity_b")).alias("e")).agg(F.approx_count_distinct("e")).first()[0] if longest_first else 0
    wanted, settled = _blocks_of(days, max(most, entities // 4) if longest_first else most), []
    while wanted:
        size = dict(days)
        held: dict = {}
        for day, block in wanted:
            held[block] = held.get(block, 0) + size[day]
        plan = spark.createDataFrame([(day, block, held[block] <= CHUNK) for day, block in wanted], "event_day date, block date, small boolean")
        dealt, parts = pairs.join(F.broadcast(plan), "event_day"), []
        if min(held.values()) <= CHUNK:
            small = dealt.filter("small").drop("small").repartition("block").sortWithinPartitions("block")
            parts.append(_whole_blocks(small.withColumns({"u": of("a"), "v": of("b")})))
        if max(held.values()) > CHUNK:
            rows = dealt.filter("not small").drop("small").withColumns({"u": of("a"), "v": of("b")})
            found = steps.write(connected_components(rows.select("u", "v"), steps))
            parts.append(rows.join(found, rows.u == found.vertex).drop("u", "v", "vertex"))
        rows = steps.write(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], by=by)
        largest = rows.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.max("n").alias("n")).filter(F.col("n") > most)
        length = {}
        for day, block in wanted:
            length.setdefault(block, []).append((day, size[day]))
        bad = {r.block for r in largest.collect() if len(length[r.block]) > 1}
        settled.append(rows.filter(~F.col("block").isin(list(bad))) if bad else rows)
        wanted = [x for b in sorted(bad) for x in _halves(length[b])]
    out = settled[0] if settled else pairs.withColumns({"block": F.col("event_day"), "component": F.lit(0).cast("bigint")})
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def _halves(days: list[tuple]) -> list[tuple]:
    """(day, first day): the days in two blocks of about as many contests each, none of them empty."""
    total, held, cut = sum(n for _, n in days), 0, 1
    for i, (_, n) in enumerate(days[:-1]):
        held += n
        cut = i + 1
        if 2 * held >= total:
            break
    return [(d, days[0][0]) for d, _ in days[:cut]] + [(d, days[cut][0]) for d, _ in days[cut:]]


FOLDED = "opened boolean, grp string, entity_a bigint, entity_b bigint, event_day date, contest_id bigint, rating_a double, rating_b double, updates_a bigint, updates_b bigint"


def rating_snapshots_in_blocks(obs: DataFrame, most: int = 1_000_000, by_group: bool = False, k: float = 32.0, start: float = 1500.0, frozen: bool = True, unknown_half: bool = False, steps: Steps | None = None) -> DataFrame:
    """The rows of rating_snapshots, block by block of days with the components of each block in parallel.

    No component of more than one day has more than `most` contests, so a task holds no more than its entities. A block joins its entities with the ratings
    so far, folds, and writes its rows and the ratings it leaves; a lost executor costs a part of one block. Where contests are many for each
    entity, blocks are short and most of a block hangs together: then the plain fold is as good.
    """
    spark = obs.sparkSession
    steps = steps or Steps(spark, "ratings")
    pairs = decisive_pairs(obs).select("event_day", "contest_id", "grp", "entity_a", "entity_b", "score_a")
    blocks = component_blocks(pairs, most, steps, by_group, by="block")
    group = F.col("grp") if by_group else F.lit("")
    none = lambda kind: F.lit(None).cast(kind)
    names = [x.split()[0] for x in FOLDED.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, fold, left = None, None, []

        def close() -> None:
            for x, rating in fold.rating.items() if fold else ():
                g, e = x if by_group else ("", x)
                left.append((True, g, e, None, None, None, rating, None, fold.updates[x], None))

        for f in frames:
            opens, of = f.column("opens").to_numpy(zero_copy_only=False).astype(bool), f.column("component").to_numpy()
            f = f.set_column(f.schema.get_field_index("entity_b"), "entity_b", f.column("entity_b").fill_null(0))  # null where a rating is brought along
            days, groups, a, b, scores = _lists(f, by_group)
            ratings, updates = f.column("rating").to_pylist(), f.column("updates").to_pylist()
            cuts, seen = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if of[lo] != component:
                    close()
                    component, fold = of[lo], _Fold(k, start, frozen, unknown_half)
                while lo < hi and opens[lo]:
                    x = (groups[lo], a[lo]) if by_group else a[lo]
                    fold.rating[x], fold.updates[x] = ratings[lo], updates[lo]
                    lo += 1
                seen += fold.rows(days[lo:hi], groups[lo:hi] if by_group else None, a[lo:hi], b[lo:hi], scores[lo:hi])
            if left:
                yield _folded(left, names)
                left = []
            if seen:
                rows = f.filter(pa.array(~opens))
                made = [pa.array(x, t) for x, t in zip(zip(*seen, strict=True), (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(seen), bool)), *[rows.column(c) for c in names[1:6]], *made], names)
        close()
        if left:
            yield _folded(left, names)

    state = spark.createDataFrame([], "grp string, entity bigint, rating double, updates bigint")
    order = [r.block for r in blocks.select("block").distinct().orderBy("block").collect()]
    for i, block in enumerate(order):
        rows = blocks.filter(F.col("block") == F.lit(block))
        sides = rows.select("component", group.alias("grp"), F.explode(F.array("entity_a", "entity_b")).alias("entity")).distinct()
        opening = sides.join(state, ["grp", "entity"]).select(
            "component", F.lit(True).alias("opens"), none("date").alias("event_day"), none("bigint").alias("contest_id"), "grp", F.col("entity").alias("entity_a"), none("bigint").alias("entity_b"), none("double").alias("score_a"), "rating", "updates"
        )
        contests = rows.select("component", F.lit(False).alias("opens"), "event_day", "contest_id", "grp", "entity_a", "entity_b", "score_a", none("double").alias("rating"), none("bigint").alias("updates"))
        both = opening.unionByName(contests).repartition("component").sortWithinPartitions("component", F.desc("opens"), "event_day", "contest_id")
        done = steps.write(both.mapInArrow(run, FOLDED), f"folded{i}")
        left = done.filter("opened").select("grp", F.col("entity_a").alias("entity"), F.col("rating_a").alias("rating"), F.col("updates_a").alias("updates"))
        state = steps.write(state.join(left, ["grp", "entity"], "left_anti").unionByName(left), f"state{i}") if i + 1 < len(order) else state
    if not order:
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(done.schema).parquet(f"{steps.root}/folded*").filter("not opened").select(*[x.split()[0] for x in SNAPSHOT.split(", ")])


def _folded(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.date32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def block_shares(blocks: DataFrame) -> DataFrame:
    """(block, contests, components, largest) of component_blocks: how many contests the largest component of each block has."""
    sizes = blocks.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("block").agg(F.sum("n").alias("contests"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


def side_ratings(snapshots: DataFrame) -> DataFrame:
    """(contest_id, event_day, entity_id, opponent_id, rating, opponent_rating): a row for each side."""
    side = lambda x, y: F.struct(F.col(f"entity_{x}").alias("entity_id"), F.col(f"entity_{y}").alias("opponent_id"), F.col(f"rating_{x}").alias("rating"), F.col(f"rating_{y}").alias("opponent_rating"))
    return snapshots.select("contest_id", "event_day", "grp", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("contest_id", "event_day", "grp", "s.*")


def rating_series(sides: DataFrame, cutoff: Column, key: str = "entity_id") -> DataFrame:
    """(key, place, event_day, contest_id, rating, opponent_rating): each entity's points strictly before the cutoff, in order, one for each contest."""
    old = sides.filter(F.col("event_day") < cutoff).groupBy(key, "contest_id").agg(F.min(F.struct("event_day", "rating", "opponent_rating")).alias("p")).select(key, "contest_id", "p.*")
    place = F.row_number().over(Window.partitionBy(key).orderBy("event_day", "contest_id"))
    return old.select(key, place.cast("bigint").alias("place"), "event_day", "contest_id", "rating", "opponent_rating")


def final_ratings(obs: DataFrame, by_group: bool = True, k: float = 32.0, start: float = 1500.0) -> DataFrame:
    """(grp, entity_id, rating, updates) after all decisive contests; grp is '' for the overall rating.

    A task of the fold reads decisive contests only, without a group for the overall rating, and gives out what its entities have at the end: no row for each contest.
    """
    columns = ["event_day", "contest_id", *(["grp"] if by_group else []), "entity_a", "entity_b", "score_a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(k, start, False, False)
        for b in batches:
            fold.rows(*_lists(b, by_group))
        keys = list(fold.rating)
        ends = [[x[0] for x in keys] if by_group else [""] * len(keys), [x[1] for x in keys] if by_group else keys, [fold.rating[x] for x in keys], [fold.updates[x] for x in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ends, (pa.string(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["grp", "entity_id", "rating", "updates"])

    pairs = decisive_pairs(obs).filter("score_a is not null").select(*columns)
    return _dealt(pairs, by_group).mapInArrow(run, "grp string, entity_id bigint, rating double, updates bigint")
