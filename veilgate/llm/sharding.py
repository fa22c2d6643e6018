"""Sharding by best-fit-decreasing bin packing of indivisible groups.

The packer sorts items by size and puts each into the bin with the least room that still holds it, found in a
balanced tree of remaining capacities. For a fixed number of shards the capacity is lowered until the packing
needs just that many bins.

The packer runs in the driver on a number of items that does not grow with the data: groups of at least
1/256 of a shard are items of their own (there can be no more than 256 per shard); all smaller groups are
bundled by a hash into at most 7936 blocks, most of them 1/4096 of the data and some sixteen times finer, which
fill the last gaps. Groups are never divided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgate.session import settle

#: A group of at least this share of a mean shard is packed by itself.
HEAVY_SHARE = 256
#: Blocks of light groups: 65536 slots of a hash, the first 4096 single, the others in sixteens.
SLOTS, SINGLE, RUN = 65536, 4096, 16
#: Rows numbered by one window task.
SLOT_ROWS = 20_000


class RoomTree:
    """Bins by (room, number) in a balanced search tree (a treap whose priorities are a hash of the bin)."""

    def __init__(self):
        self.root = None

    def _split(self, node, key):
        """(all below key, all from key on)"""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def put(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        node = [(room, number), (number + 1) * 0x9E3779B97F4A7C15 % (1 << 64), None, None]
        self.root = self._merge(self._merge(low, node), high)

    def take(self, size: int):
        """Remove and return the tightest (room, number) with at least this room, or None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node, path = high, None
        while node[2] is not None:
            path, node = node, node[2]
        if path is None:
            high = node[3]
        else:
            path[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin number per item; None once more than ``most`` bins are needed. An item over the capacity gets a bin alone."""
    tree, bins, out = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            if bins == most:
                return None
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        out[i] = found[1]
        tree.put(found[0] - sizes[i], found[1])
    return out


def pack(sizes: Sequence[int], shards: int) -> list[int]:
    """Shard per item: items over a fair share stay alone, the others get the least capacity that best fit manages."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, left, total, at = [0] * len(sizes), shards, sum(sizes), 0
    while at < len(order) and left > 1 and sizes[order[at]] * left >= total:
        out[order[at]] = shards - left
        total, left, at = total - sizes[order[at]], left - 1, at + 1
    rest = order[at:]
    if not rest:
        return out
    small = [sizes[i] for i in rest]
    low = max(-(-total // left), small[0])
    high, best = 3 * low + 1, None
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(small, middle, left)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
            if high - low <= max(1, low // 50_000):
                break
    best = best or best_fit_decreasing(small, high, left)
    for i, shard in zip(rest, best, strict=True):
        out[i] = shards - left + shard
    return out


def shard_groups(rows: DataFrame, group_col: str, size_col: str, shards: int = 16) -> DataFrame:
    """``rows`` with ``shard int``: all rows of a group in one shard, the sums of sizes as equal as the groups allow.

    ``rows`` is read several times and should be a table. A null group is a group of its own, null sizes count 0.
    An empty table stays empty. Groups are summed before they are shuffled, so a hot group is one row per task.
    """
    spark = rows.sparkSession
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    groups = settle(rows.groupBy(F.col(group_col).alias("__group")).agg(F.sum(size).alias("__size")), "groups")
    total = groups.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    limit = max(1, total // (shards * HEAVY_SHARE))
    slot = F.pmod(F.xxhash64("__group"), F.lit(SLOTS)).cast("int")
    block = F.when(slot < SINGLE, slot).otherwise(F.lit(SINGLE) + F.floor(slot / RUN).cast("int"))
    heavy = groups.where(F.col("__size") >= limit).orderBy("__group").limit(2 * shards * HEAVY_SHARE).collect()
    light = groups.where(F.col("__size") < limit).groupBy(block.alias("b")).agg(F.sum("__size").alias("s")).orderBy("b").collect()
    placed = pack([r["__size"] for r in heavy] + [r.s for r in light], shards)
    group_type = groups.schema["__group"].dataType.simpleString()
    by_group = spark.createDataFrame(
        [(r["__group"], n) for r, n in zip(heavy, placed[: len(heavy)], strict=True)], f"__heavy {group_type}, __a int"
    )
    by_block = spark.createDataFrame(
        [(r.b, n) for r, n in zip(light, placed[len(heavy) :], strict=True)], "__block int, __b int"
    )
    keyed = rows.withColumn("__group", F.col(group_col)).withColumn("__block", block)
    found = keyed.join(F.broadcast(by_group), F.col("__group").eqNullSafe(F.col("__heavy")), "left")
    found = found.join(F.broadcast(by_block), "__block", "left")
    return found.select(*(F.col(f"`{c}`") for c in rows.columns if c != "shard"), F.coalesce("__a", "__b").alias("shard"))


def number_slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``shard``) and ``slot long``, gapless from 0 in each shard, without sorting a shard in one task."""
    from pyspark.sql import Window

    parts = max(1, -(-rows.count() // SLOT_ROWS) // 4)
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = dealt.groupBy("shard", "__part").count()
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__part").orderBy(*order)
    numbered = dealt.withColumn("__row", F.row_number().over(within))
    return numbered.join(starts, ["shard", "__part"]).select(
        *(F.col(f"`{c}`") for c in rows.columns), (F.col("__start") + F.col("__row") - 1).cast("long").alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; law ``bytes``, so ``grown_shard`` is null.

    Equal texts are one group (a null text equals an empty one). Ids may be null or repeated; other columns are
    ignored. A group larger than a fair share fills a shard of its own; the other shards share the rest equally.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    placed = settle(shard_groups(settle(rows, "sizes"), "digest", "size", shards).drop("digest"), "shards")
    return number_slots(placed, ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
