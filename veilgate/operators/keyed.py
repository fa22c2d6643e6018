"""Keyed operations that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.functions import sqltext
from veilgate.session import settle

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
#: Accuracy of the sketches that bracket a quantile: ranks are off by at most one in so many.
ACCURACY = 10_000


def _width(field: T.StructField) -> Column:
    column = F.col(sqltext.name(field.name))
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(field.dataType, T.AtomicType):
        return F.lit(8).cast("long")
    return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)).cast("long")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def hashable(field: T.StructField) -> Column:
    """A column in a form that can be hashed; maps cannot, so they are written out."""
    column = F.col(sqltext.name(field.name))
    return F.to_json(F.struct(column)) if _holds_map(field.dataType) else column


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when a frame is known to be small enough to broadcast, in rows and in bytes.

    Rows are counted first, which reads no columns; only a frame that passes is measured.
    """
    if df.count() > rows:
        return False
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        width = width + _width(field)
    return (df.agg(F.sum(width)).first()[0] or 0) <= size


def salted_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi join whose hot keys are spread over ``salts`` tasks.

    The large side gets a salt from its ``spread`` columns (all non-key columns by default), the
    small side is repeated once per salt. ``how`` may be inner, left, left_semi or left_anti.
    """
    spread = spread or [c for c in large.columns if c not in keys] or keys
    hashed = [hashable(large.schema[c]) for c in spread]
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def two_sided_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_spread: list[str], right_spread: list[str], salts: int = 4
) -> DataFrame:
    """Inner equi join for keys that may be hot on either side.

    Rows of each side are dealt over ``salts`` parts by their own columns and repeated for the parts of the
    other side, so the pairs of one key are made by salts x salts tasks, each pair once.
    """

    def parts(df: DataFrame, spread: list[str], own: str, other: str) -> DataFrame:
        hashed = [hashable(df.schema[c]) for c in spread]
        return df.withColumn(own, F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        )

    return (
        parts(left, left_spread, "_l", "_r")
        .join(parts(right, right_spread, "_r", "_l"), [*keys, "_l", "_r"])
        .drop("_l", "_r")
    )


def skewed_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_spread: list[str], right_spread: list[str],
    heavy: int = 100_000, buckets: int = 16_384,
) -> DataFrame:
    """Inner equi join that repeats rows only for keys that may be hot, as ``two_sided_join`` does; others are shuffled once.

    Rows are counted by buckets of the keys' hash, which shuffles next to nothing: a key with more than ``heavy`` rows
    makes its bucket heavy, and all rows of such a bucket count as hot.
    """
    if [left.schema[k].dataType for k in keys] != [right.schema[k].dataType for k in keys]:
        return two_sided_join(left, right, keys, left_spread, right_spread)  # unlike types hash differently
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    hot = set()
    for side in (left, right):
        counts = side.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        hot |= {r[0] for r in counts.where(F.col("_n") > heavy).select("_b").collect()}
    if not hot:
        return left.join(right, keys)
    is_hot = bucket.isin(*sorted(hot))
    spread = two_sided_join(left.where(is_hot), right.where(is_hot), keys, left_spread, right_spread)
    return left.where(~is_hot).join(right.where(~is_hot), keys).unionByName(spread)


def lookup_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Broadcast the small side when its size has been checked, otherwise join with salt."""
    if is_small(small, rows):
        return large.join(F.broadcast(small), keys, how)
    return salted_join(large, small, keys, how, spread)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by aggregation (combined before the shuffle)."""
    payload = F.struct(*[c for c in df.columns if c not in keys])
    newest = F.max_by(payload, F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    name: str = "position",
    descending: bool = False,
) -> DataFrame:
    """Row numbers within a key, without ever sorting one key's rows in a single task.

    ``bucket`` must be monotone in ``order`` (for instance the hour of the timestamp that leads
    it). Rows are numbered within (key, bucket); the sizes of earlier buckets are then added.
    """
    direction = F.desc if descending else F.asc
    staged = df.withColumn("_bucket", bucket)
    sizes = staged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys)
        .orderBy(direction("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*[direction(c) for c in order])
    ranked = staged.withColumn("_inside", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_bucket", "_inside", "_before")
    )


def asof_join(
    requests: DataFrame,
    history: DataFrame,
    keys: list[str],
    request_time: str,
    history_time: str,
    tie_break: str,
    ranges: int | None = None,
    heavy: int = 100_000,
    buckets: int = 16_384,
) -> DataFrame:
    """For every request the newest history row at or before its time (null when there is none).

    Both sides are shuffled together by key, once, and requests look back with a window. Rows are counted by buckets of
    the keys' hash before: all keys of a bucket with more rows than a range's share are dealt by ranges of time instead
    (``_asof_by_ranges``), so no key has to fit into a task. Both sides are read twice, so settle what is costly to make.
    ``ranges`` defaults to the session's shuffle partitions; then a bucket of up to ``heavy`` rows is never dealt by ranges.
    """
    payload = [c for c in history.columns if c not in keys]
    past = history.select(
        *keys,
        F.col(history_time).alias("_t"),
        F.lit(0).alias("_kind"),
        F.struct(*payload).alias("_hit"),
    )
    request_columns = [c for c in requests.columns if c not in keys]
    asked = requests.select(
        *keys,
        F.col(request_time).alias("_t"),
        F.lit(1).alias("_kind"),
        F.struct(*request_columns).alias("_request"),
    )
    n = ranges or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = past.unionByName(asked, allowMissingColumns=True)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    counts = together.groupBy(bucket.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).collect()
    share = max(sum(r["_n"] for r in counts) / n, 0 if ranges else heavy)
    hot = sorted(r["_h"] for r in counts if r["_n"] > share)
    if not hot:
        found = _last_before(together, keys, tie_break)
    else:
        is_hot = bucket.isin(*hot)
        found = _last_before(together.where(~is_hot), keys, tie_break).unionByName(
            _asof_by_ranges(together.where(is_hot), keys, tie_break, n)
        )
    return found.select(
        *keys,
        *[F.col(f"_request.{c}").alias(c) for c in request_columns],
        *[F.col(f"_found.{c}").alias(c) for c in payload],
    )


def _last_before(both: DataFrame, groups: list[str], tie_break: str) -> DataFrame:
    """The requests with the last history row of their group (``_found``) up to their time."""
    seen = (
        Window.partitionBy(*groups)
        .orderBy("_t", "_kind", F.asc_nulls_last("_order"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordered = both.withColumn("_order", F.col(f"_hit.{tie_break}"))
    found = ordered.withColumn("_found", F.last("_hit", ignorenulls=True).over(seen)).where(F.col("_kind") == 1)
    return found.select(*groups, "_request", "_found")


def _asof_by_ranges(together: DataFrame, keys: list[str], tie_break: str, ranges: int) -> DataFrame:
    """As ``_last_before``, for keys with more rows than a task should hold.

    Rows are dealt by ranges of (key, time) whose borders follow the data, so a key is spread over as many tasks as its
    rows need, however close in time they are; rows of one key and moment stay together. Requests look
    inside their own range with a window, and fall back to the last row of the closest earlier range, which is
    carried over on a table of one row per (key, range).
    """
    dealt = together.repartitionByRange(ranges, *keys, "_t")
    both = settle(dealt.withColumn("_b", F.spark_partition_id()), "as-of")
    last_of_bucket = both.where("_kind = 0").groupBy(*keys, "_b").agg(
        F.max_by("_hit", F.struct("_t", f"_hit.{tie_break}")).alias("_last")
    )
    marks = last_of_bucket.select(*keys, "_b", "_last").unionByName(
        both.where("_kind = 1").select(*keys, "_b").distinct(), allowMissingColumns=True
    )
    marks = marks.groupBy(*keys, "_b").agg(F.first("_last", ignorenulls=True).alias("_last"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = marks.select(
        *keys, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    return (
        _last_before(both, [*keys, "_b"], tie_break)
        .join(carried, [*keys, "_b"], "left")
        .select(*keys, "_request", F.coalesce("_found", "_carried").alias("_found"))
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """Nearest-rank quantiles, exact, by selection in two passes.

    A sketch combined before the shuffle gives, per key and quantile, two values between which the wanted rank lies
    (its rank is off by at most one in ``accuracy``). The second pass counts what lies below, and ranks only what lies
    between: a few thousandths of a key's rows at most, and fewer distinct values. Nulls do not count; a key whose
    values are all null has none.
    """
    given = df.select(*keys, F.col(value).alias("_v"))
    some = given.where(F.col("_v").isNotNull())
    ends = [min(1.0, max(0.0, q + side * 2 / accuracy)) for q in fractions.values() for side in (-1, 1)]
    sketch = F.approx_percentile("_v", [float(e) for e in ends], accuracy)
    brackets = settle(some.groupBy(*keys).agg(sketch.alias("_e"), F.count(F.lit(1)).alias("_all")), "brackets")
    parts = [
        F.struct(F.lit(i).alias("i"), F.ceil(F.col("_all") * F.lit(q)).alias("rank"), F.get("_e", F.lit(2 * i)).alias("low"), F.get("_e", F.lit(2 * i + 1)).alias("high"))
        for i, q in enumerate(fractions.values())
    ]
    wanted = brackets.select(*keys, F.array(*parts).alias("_b"))
    met = lookup_join(some, wanted, keys, spread=["_v"])
    below = met.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_b")[i].low).alias(f"_n{i}") for i in range(len(fractions))])
    inside = met.withColumn("_p", F.explode(F.filter("_b", lambda b: (F.col("_v") >= b.low) & (F.col("_v") <= b.high))))
    counted = inside.groupBy(*keys, F.col("_p.i").alias("_i"), F.col("_p.rank").alias("_rank"), "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    ranked = counted.withColumn("_upto", upto).join(below, keys)
    reached = F.element_at(F.array(*[F.col(f"_n{i}") for i in range(len(fractions))]), F.col("_i") + 1) + F.col("_upto") >= F.col("_rank")
    picks = [F.min(F.when((F.col("_i") == i) & reached, F.col("_v"))).alias(name) for i, name in enumerate(fractions)]
    found = ranked.groupBy(*keys).agg(*picks)
    return given.select(*keys).distinct().join(found, keys, "left")


def balanced_join(
    large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", heavy: int = 100_000, hot: DataFrame | None = None
) -> DataFrame:
    """Equi join that treats heavy keys apart; ``small`` must hold at most one row per key.

    Keys with more than ``heavy`` rows are few by construction; their rows meet a broadcast of
    just those keys, all others are joined by shuffle. Falls back to a salted join in the odd
    case that even the heavy keys are many. A caller that knows the heavy keys gives them as ``hot``:
    then neither side is read to count or measure it.
    """
    if hot is None and is_small(small):
        return large.join(F.broadcast(small), keys, how)
    if hot is None:
        hot = (
            large.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > heavy)
            .select(*keys)
        )
    if not is_small(hot):
        return salted_join(large, small, keys, how)
    if hot.isEmpty():
        return large.join(small, keys, how)
    hot_small = small.join(F.broadcast(hot), keys, "left_semi")
    hot_rows = large.join(F.broadcast(hot), keys, "left_semi")
    other_rows = large.join(F.broadcast(hot), keys, "left_anti")
    if is_small(hot_small):
        hot_joined = hot_rows.join(F.broadcast(hot_small), keys, how)
    else:
        hot_joined = salted_join(hot_rows, hot_small, keys, how)
    return hot_joined.unionByName(other_rows.join(small, keys, how))
