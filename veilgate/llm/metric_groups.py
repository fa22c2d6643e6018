"""Links within groups of any size whose members lie in a metric space, without comparing all pairs.

A small group is one tile and is compared in one task. In a large group a few leaders meet all members, dealt in blocks.
With the triangle inequality their distances decide for most members: one within the limit of a leader, and nearer to
it than the leader's nearest non-linked neighbour (up to twice the limit) less the limit, can have no link that leads
elsewhere, so it is tied to the leader and leaves. So do the leaders. What stays goes on with new leaders, and is compared block
by block against itself once it is small or no longer shrinks. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgate.llm.common import packed, scan
from veilgate.session import settle

#: Members of a group compared in one task.
BUCKET = 1024
#: Leaders of a large group in one round, on average.
LEADERS = 8
#: Rounds of leaders; a round that leaves more than this share of the members is the last.
ROUNDS, SHRINK = 12, 0.75


class BitStrings:
    """Byte strings of one length; the distance is the number of bits that differ."""

    def __init__(self, values: Sequence[bytes]):
        width = -(-len(values[0]) // 8) * 8
        self.all = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint64).reshape(len(values), -1)
        self.left = self.all

    def distances(self, one: int) -> np.ndarray:
        return np.bitwise_count(self.left ^ self.all[one]).sum(axis=1, dtype=np.int64)

    def keep(self, mask: np.ndarray) -> None:
        self.left = self.left[mask]


class HashSets:
    """Sets of hashes, none of them empty; the distance is one less the overlap."""

    def __init__(self, values: Sequence[np.ndarray]):
        self.size = np.array([len(x) for x in values], np.int64)
        entries = np.unique(np.concatenate(values), return_inverse=True)[1].astype(np.int32)
        self.own = np.split(entries, np.cumsum(self.size)[:-1])
        self.mark = np.zeros(int(entries.max()) + 1, bool)
        self.flat, self.left = entries, self.size

    def distances(self, one: int) -> np.ndarray:
        self.mark[self.own[one]] = True
        common = np.add.reduceat(self.mark[self.flat], np.cumsum(self.left) - self.left, dtype=np.int64)
        self.mark[self.own[one]] = False
        union = self.left + self.size[one] - common
        return (union - common) / union  # one rounded division, so that limits of short decimals are met exactly

    def keep(self, mask: np.ndarray) -> None:
        self.flat = self.flat[np.repeat(mask, self.left)]
        self.left = self.left[mask]


def forest(ids: Sequence[int], space: BitStrings | HashSets, limit: float) -> list[tuple[int, int]]:
    """Edges that connect what is within ``limit``, one per member at most."""
    waiting = np.arange(len(ids))
    edges: list[tuple[int, int]] = []
    while len(waiting) > 1:
        front = [int(waiting[0])]
        waiting = waiting[1:]
        space.keep(np.arange(len(waiting) + 1) > 0)
        while front and len(waiting):
            one = front.pop()
            hit = space.distances(one) <= limit
            if hit.any():
                found = waiting[hit].tolist()
                edges += [(ids[k], ids[one]) for k in found]
                front += found
                waiting = waiting[~hit]
                space.keep(~hit)
    return edges


def _runs(batches: Iterator[pa.RecordBatch], read: Callable) -> Iterator[tuple[int, list, list, list]]:
    """(group, ids, values as ``read``, roles) of each tile of two rows or more; a row that repeats an id in one role counts once."""
    key, ids, values, roles = None, [], [], []
    for rows in batches:
        for tile, group, i, value, role in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (tile, group) != key:
                if len(ids) > 1:
                    yield key[1], ids, values, roles
                key, ids, values, roles = (tile, group), [], [], []
            if ids and ids[-1] == i and roles[-1] == role:
                continue
            ids.append(i)
            values.append(read(value))
            roles.append(role)
    if len(ids) > 1:
        yield key[1], ids, values, roles


def _dealt(spread: DataFrame) -> DataFrame:
    """``spread(tile, group, id, value, role)`` with the rows of a tile together and in order."""
    columns = spread.select("tile", "group", "id", "value", "role")
    return columns.repartition("tile").sortWithinPartitions("tile", "group", "role", "id")


def _blocks(bucket: int, most: int):
    return F.greatest(F.ceil(F.count("*") / bucket), F.ceil(F.sum("size") / most), F.lit(1)).cast("long").alias("blocks")


def connect(
    members: DataFrame,
    values: Callable[[DataFrame], DataFrame],
    read: Callable,
    space: type[BitStrings] | type[HashSets],
    limit: float,
    bucket: int = BUCKET,
    most: int = 1 << 62,
    leaders: int = LEADERS,
) -> DataFrame:
    """(u, v) edges, u <> v, whose components are those of the graph 'in one group and within ``limit``'.

    ``members(group, id long, size long)`` is a stored table; a tile holds at most about ``bucket`` members and sizes of
    ``most`` in sum. ``values`` adds a column ``value`` to a table with ``id``; ``read`` turns one into what ``space`` takes.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for _, ids, found, _ in _runs(batches, read):
                edges = forest(ids, space(found), limit)
                yield [a for a, _ in edges], [b for _, b in edges]

        return packed(parts(), {"u": pa.int64(), "v": pa.int64()})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for group, ids, found, roles in _runs(batches, read):
                first = roles.count(0)
                whole, own = space(found), np.array(ids, np.int64)
                for k in range(first):
                    distance = whole.distances(k)
                    near = np.flatnonzero((distance <= 2 * limit + 1e-9) & (own != own[k]))
                    near = near[near >= first]
                    yield [group] * len(near), own[near], np.full(len(near), own[k]), distance[near].astype(float)

        return packed(parts(), {"group": pa.int64(), "id": pa.int64(), "leader": pa.int64(), "d": pa.float64()})

    counted = members.groupBy("group").agg(_blocks(bucket, most), F.count("*").alias("n"))
    sized = settle(members.join(counted, "group"), "sized")
    tiles = sized.where("blocks = 1 AND n > 1").select("group", "id", "blocks")
    edges, live = [], sized.where("blocks > 1").select("group", "id", "size")
    total = live.count()
    for turn in range(ROUNDS):
        if not total:
            break
        mixed = F.xxhash64("id", F.lit(turn)).bitwiseAND((1 << 40) - 1)
        about = live.groupBy("group").agg(_blocks(bucket, most), F.count("*").alias("n"), F.min(mixed).alias("least"))
        dealt = settle(live.join(about, "group").withColumn("mixed", mixed), "live")
        chosen = dealt.where(f"blocks > 1 AND mixed <= greatest(least, {leaders << 40} / n)")
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks"))
        everyone = dealt.where("blocks > 1").select("group", "id", block.alias("block"), F.lit(1).alias("role"))
        to_all = chosen.select("group", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"))
        tile = F.xxhash64("group", "block")
        spread = values(everyone.unionByName(to_all)).withColumn("tile", tile)
        near = settle(scan(_dealt(spread), meet, "group long, id long, leader long, d double"), "near-leaders")
        edges.append(near.where(F.col("d") <= limit).selectExpr("id AS u", "leader AS v"))
        ring = near.where(F.col("d") > limit).groupBy("group", "leader").agg(F.min("d").alias("ring"))
        done = (
            near.where(F.col("d") <= limit)
            .join(ring, ["group", "leader"], "left")
            .where(F.col("ring").isNull() | (F.col("d") < F.col("ring") - limit - 1e-9))
            .select("group", "id")
            .unionByName(chosen.select("group", "id"))
            .distinct()
        )
        small = dealt.where("blocks = 1")
        tiles = tiles.unionByName(small.where("n > 1").select("group", "id", "blocks"))
        live = settle(dealt.where("blocks > 1").join(done, ["group", "id"], "left_anti").select("group", "id", "size"), "left")
        before, total = total, live.count()
        if total > SHRINK * before:
            break
    if total:
        again = live.groupBy("group").agg(_blocks(bucket, most), F.count("*").alias("n"))
        tiles = tiles.unionByName(live.join(again, "group").where("n > 1").select("group", "id", "blocks"))
    # every block of a group against every other
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks"))
    others = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: o != F.col("block")))
    spread = tiles.withColumn("block", block).withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0).cast("long")))))
    tile = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    met = values(spread.select("id", "group", tile.alias("tile"), F.lit(0).alias("role")))
    found = scan(_dealt(met), compare, "u long, v long")
    for more in edges:
        found = found.unionByName(more)
    return found.where("u <> v").distinct()
