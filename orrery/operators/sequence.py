"""Operators over ordered rows. Order is data: each takes order columns that make a total order.

With partition columns (`by`) they are plain windows. Sequences without any would put all rows into one task, so the
global forms cut the order into blocks: an index from counts per block, neighbours through halo rows at block
edges, running totals from block totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery import shared

#: Rows of a block of an indexed sequence, and blocks that an unindexed one is cut into.
BLOCK, CUTS = 1 << 17, 256


def _w(by: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*by).orderBy(*order)


def index_within(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """0, 1, ... within each partition."""
    return df.withColumn(name, (F.row_number().over(_w(by, order)) - 1).cast("bigint"))


def index_all(df: DataFrame, order: str, ties: Sequence[str] = (), name: str = "idx", cuts: int = CUTS) -> DataFrame:
    """0, 1, ... over all rows by a numeric or timestamp column (then ties; nulls first), without one task for all.

    Blocks are cut at approximate quantiles of the column, and a value that fills several blocks at those of the first tie,
    where that is a number (literals, so a retried task cuts alike); each block is numbered on its own and moved by the
    count of the blocks before it. At most about 2 * `cuts` counts are broadcast.
    """
    shares = [(i + 1) / cuts for i in range(cuts - 1)]
    key = F.col(order).cast("double")
    found = df.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []
    marks = sorted(set(found))
    inside = lambda x, at: F.size(F.filter(F.array(*[F.lit(m) for m in at]).cast("array<double>"), lambda m: m < x)) if at else F.lit(0)
    block = F.when(key.isNull(), -1).otherwise(F.coalesce(inside(key, marks), F.lit(-1)))
    # blocks (k, j): the k-th range of the column; j-th range of the tie for values that were a mark more than once
    sub = F.lit(0)
    many = [m for m in marks if found.count(m) > 1]
    if many and ties and dict(df.dtypes)[ties[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        tie = F.col(ties[0]).cast("double")
        block = 3 * block + F.when(key.isin(many), 1).otherwise(0)
        for m, at in [(r["k"], r["at"]) for r in df.where(key.isin(many)).groupBy(key.alias("k")).agg(F.percentile_approx(tie, shares, 10_000).alias("at")).collect()]:
            few = sorted(set(at[:: max(1, cuts // (found.count(m) + 1))]))
            sub = F.when(key == m, F.when(tie.isNull(), -1).otherwise(inside(tie, few))).otherwise(sub)
    cut = df.withColumn("_block", F.struct(block.alias("k"), sub.alias("j")))
    counts = cut.groupBy("_block").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_block").alias("_b"), offset.alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(order, *ties)) - 1
    return cut.join(F.broadcast(offsets), F.col("_block") == F.col("_b")).withColumn(name, (inner + F.col("_offset")).cast("bigint")).drop("_block", "_b", "_offset")


def rank_all(df: DataFrame, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """0, 1, ... over all rows in the order of the keys, which may be of any type that sorts, arrays too: rows are dealt by range and
    written, so that a repeated task numbers alike; each part is numbered by itself and moved by the counts of the parts
    before it. Equal keys follow each other in any order."""
    dealt = shared.saved(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a part
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_p"), offset.alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])) - 1
    return dealt.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(name, (inner + F.col("_offset")).cast("bigint")).drop("_part", "_p", "_offset")


def with_neighbours(df: DataFrame, idx: str, columns: dict[str, tuple[str, int]], block: int = BLOCK) -> DataFrame:
    """Adds columns {new: (column, distance)} from rows at idx - distance, over one global dense index.

    A row at a block's edge is also sent to the block that looks at it, so no task holds more than block + reach rows.
    """
    reach = max(abs(d) for _, d in columns.values())
    if reach > block:
        raise ValueError("distances must be shorter than a block")
    own = F.floor(F.col(idx) / block)
    homes = F.array_distinct(F.array(own, F.floor((F.col(idx) + reach) / block), F.floor((F.col(idx) - reach) / block)))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(homes))
    w = Window.partitionBy("_block").orderBy(idx)
    for new, (column, distance) in columns.items():
        spread = spread.withColumn(new, F.lag(column, distance).over(w) if distance >= 0 else F.lead(column, -distance).over(w))
    return spread.where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def take(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def consume(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """All but the first n rows."""
    return df.orderBy(*order).offset(n)


def nth(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, n: int, default=None) -> DataFrame:
    """The n-th value (from 0) of each partition, or the default."""
    numbered = index_within(df, by, order, "_i")
    return numbered.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_i") == n, F.col(column))), F.lit(default)).alias(column))


def quantify(df: DataFrame, by: Sequence[str], pred: Column, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(pred).alias(name))


def stride(df: DataFrame, idx: str, every: int, start: int = 0) -> DataFrame:
    """Rows start, start + every, ... of an indexed sequence."""
    return df.where((F.col(idx) >= start) & ((F.col(idx) - start) % every == 0))


def by_indices(df: DataFrame, idx: str, wanted: Sequence[int]) -> DataFrame:
    """Rows in the order of a list of indices, repeats allowed; pos is the place in the list."""
    spine = df.sparkSession.createDataFrame([(p, int(i)) for p, i in enumerate(wanted)], f"pos bigint, `{idx}` bigint")
    return F.broadcast(spine).join(df, idx) if len(wanted) <= 100_000 else spine.join(df, idx)


def pick(df: DataFrame, idx: str, wanted: Sequence[int]) -> DataFrame:
    """Rows at a sorted, non-empty list of indices."""
    if not wanted or list(wanted) != sorted(wanted):
        raise ValueError("indices must be sorted and not empty")
    spine = df.sparkSession.createDataFrame([(int(i),) for i in wanted], f"`{idx}` bigint")
    return df.join(spine, idx, "left_semi")


def pad_none(df: DataFrame, by: Sequence[str], idx: str, length: int) -> DataFrame:
    """Each partition's rows at 0..length-1, nulls where it has none."""
    spine = df.select(*by).distinct().withColumn(idx, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))))
    return spine.join(df, [*by, idx], "left")


def ncycles(df: DataFrame, idx: str, n: int) -> DataFrame:
    """The sequence n times over: cycle and idx give the order."""
    return df.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))


def pairwise(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, ahead: int = 1) -> DataFrame:
    """(value, next value); the last row of each partition has no pair."""
    w = _w(by, order)
    return df.withColumn("next", F.lead(column, ahead).over(w)).withColumn("_more", F.lead(F.lit(True), ahead).over(w)).where("_more").drop("_more")


def chunks(df: DataFrame, by: Sequence[str], idx: str, column: str, size: int) -> DataFrame:
    """Arrays of `size` values in order; the last may be shorter."""
    rows = F.array_sort(F.collect_list(F.struct(idx, F.col(column).alias("v"))))
    return df.groupBy(*by, F.floor(F.col(idx) / size).cast("bigint").alias("chunk")).agg(rows.alias("_r")).withColumn("items", F.transform("_r", lambda r: r["v"])).drop("_r")


def grouper(df: DataFrame, by: Sequence[str], idx: str, column: str, size: int, fill) -> DataFrame:
    """Like chunks, with the last one filled up."""
    got = chunks(df, by, idx, column, size)
    return got.withColumn("items", F.concat("items", F.array_repeat(F.lit(fill), F.lit(size) - F.size("items"))))


def roundrobin(streams: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Interleaves streams of one schema; src and turn give the order (turn, src). One window per stream."""
    out = None
    for k, s in enumerate(streams):
        tagged = s.withColumn("src", F.lit(k)).withColumn("turn", (F.row_number().over(Window.partitionBy("src").orderBy(*order)) - 1).cast("bigint"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def roundrobin_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Interleaves the streams of a key's values, in the values' order: src and turn give the order (turn, src). The window
    that numbers the streams runs over distinct values only."""
    kinds = df.select(key).distinct().withColumn("src", (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))
    turn = (F.row_number().over(_w([key], order)) - 1).cast("bigint")
    return df.withColumn("turn", turn).join(kinds, key)


def powerset(items: Column) -> Column:
    """All subsets of a short array, by size, then by place. More than 20 items (a million subsets) are an error."""
    n = F.when(F.size(items) <= 20, F.size(items)).otherwise(F.raise_error(F.lit("powerset of more than 20 items")).cast("int"))
    masks = F.sequence(F.lit(0), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), n).cast("int") - 1)
    subsets = F.transform(masks, lambda m: F.struct(F.bit_count(m).alias("size"), F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: F.expr("1") == F.pmod(F.floor(m / F.pow(F.lit(2), e["i"])), F.lit(2))).alias("set")))
    return F.transform(F.array_sort(F.transform(subsets, lambda s: F.struct(s["size"], s["set"]))), lambda s: F.transform(s["set"], lambda e: e["x"]))


def unique_everseen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: a partial minimum, so a frequent key costs no task its rows."""
    names = [c for c in df.columns if c not in order]
    first = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct(*order, *names)).alias("_r"))
    return first.select("_r.*").select(*df.columns)


def unique_justseen(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Drops rows whose key equals the one before (null-safe)."""
    w = _w(by, order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~F.col(key).eqNullSafe(F.lag(key).over(w))).where("_keep").drop("_keep")


def accumulate(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, fold: str | Callable[[Column, Column], Column] = "sum", name: str = "acc") -> DataFrame:
    """Running fold: 'sum', 'max', 'min', 'count', 'product', or any function of two columns (an array fold per row: for
    short partitions)."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    if fold == "product":
        value = F.product(F.col(column)).over(w)
    elif callable(fold):
        seen = F.collect_list(column).over(w)
        value = F.aggregate(F.slice(seen, F.lit(2), F.greatest(F.size(seen) - 1, F.lit(0))), seen[0], fold)
    else:
        value = getattr(F, fold)(column).over(w)
    return df.withColumn(name, value)


def running_total(df: DataFrame, idx: str, column: str, name: str = "acc", block: int = BLOCK) -> DataFrame:
    """Running sum over one global index: totals of blocks, then within blocks. Null counts as zero."""
    value = F.coalesce(F.col(column), F.lit(0))
    cut = df.withColumn("_block", F.floor(F.col(idx) / block).cast("bigint"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cut.groupBy("_block").agg(F.sum(value).alias("_s")).select(F.col("_block").alias("_b"), before.alias("_before"))
    inner = F.sum(value).over(Window.partitionBy("_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(totals, F.col("_block") == F.col("_b")).withColumn(name, inner + F.col("_before")).drop("_block", "_b", "_before")


def moving_average(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, win: int = 3, name: str = "avg") -> DataFrame:
    """Means of `win` rows in a row; the first win - 1 rows of a partition have none and go."""
    w = _w(by, order)
    return df.withColumn("_n", F.row_number().over(w)).withColumn(name, F.avg(column).over(w.rowsBetween(-(win - 1), 0))).where(F.col("_n") >= win).drop("_n")


def unwrap(df: DataFrame, by: Sequence[str], order: Sequence[str], angle: str, name: str = "unwrapped") -> DataFrame:
    """Removes jumps of pi or more by whole turns, summed along the order."""
    pi, w = F.lit(3.141592653589793), _w(by, order)
    d = F.col(angle) - F.lag(angle).over(w)
    turn = 2 * pi
    wrapped = (d + pi) - F.floor((d + pi) / turn) * turn - pi
    wrapped = F.when((wrapped == -pi) & (d > 0), pi).otherwise(wrapped)
    fixed = df.withColumn("_fix", F.when(F.abs(d) >= pi, wrapped - d).otherwise(0.0))
    return fixed.withColumn(name, F.col(angle) + F.coalesce(F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).drop("_fix")


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest n rows of each partition, and how many there ever were (total)."""
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    counted = df.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).drop("_r")
    total = df.groupBy(*by).agg(F.count("*").alias("total"))
    return counted.join(total, list(by))


def latest_keys(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n keys seen first most recently, with the newest row of each: a map bounded at n that drops its oldest key."""
    seen = df.groupBy(key).agg(F.min(order).alias("first"), F.max_by(F.struct(*df.columns), order).alias("r"))
    return seen.orderBy(F.col("first").desc(), F.col(key)).limit(n).select("r.*", "first")


def first_seen_ids(df: DataFrame, label: str, order: str, name: str = "id") -> DataFrame:
    """(label, id): dense ids in order of first sight, by blocks of the order where it is a number or time; otherwise by one
    window over the distinct labels."""
    first = df.groupBy(label).agg(F.min(order).alias("first"))
    kinds = dict(first.dtypes)
    if kinds["first"] in ("bigint", "int", "double", "timestamp"):
        return index_all(first, "first", [label], name)
    return first.withColumn(name, (F.row_number().over(Window.orderBy("first", label)) - 1).cast("bigint"))


def every_kth(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, count_first: bool = True) -> DataFrame:
    """count_first: rows k, 2k, ... (from 1), as a counter that counts and then tests; else rows 1, k + 1, ..."""
    n = F.row_number().over(_w(by, order))
    return df.withColumn("_n", n).where((F.col("_n") % k == 0) if count_first else ((F.col("_n") - 1) % k == 0)).drop("_n")


def random_pick(df: DataFrame, r: int, seed: int = 1, replace: bool = False) -> DataFrame:
    """r rows at random: those with the least hashes of seed and columns, so the same rows however they are dealt; with
    replacement, r draws of an indexed row."""
    if not replace:
        return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), 256), *df.columns).limit(r)
    n = df.count()
    draws = df.sparkSession.range(r).select((F.rand(seed) * n).cast("bigint").alias("_draw"), F.col("id").alias("draw"))
    place = df.withColumn("_hash", F.xxhash64(*df.columns))
    return draws.join(index_all(place, "_hash", df.columns, "_draw"), "_draw").drop("_draw", "_hash")


def random_order(df: DataFrame, r: int | None = None, seed: int = 1, name: str = "idx") -> DataFrame:
    """A random permutation of all rows, or its first r: idx is the place. Rows get a seeded number by a hash of their
    columns, so the order doesn't depend on how they are dealt."""
    placed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *df.columns))
    out = index_all(placed, "_hash", df.columns, name).drop("_hash")
    return out if r is None else out.where(F.col(name) < r)


def random_combination(df: DataFrame, r: int, order: Sequence[str], seed: int = 1) -> DataFrame:
    """r rows of a random permutation, in the rows' own order."""
    return rank_all(random_order(df, r, seed, "_pick").drop("_pick"), order)


def random_product(pools: Sequence[DataFrame], repeat: int = 1, seed: int = 1) -> DataFrame:
    """One random row of each pool, `repeat` times: (pool, row) with the row as JSON."""
    out = None
    for k in range(repeat * len(pools)):
        pool = pools[k % len(pools)]
        row = random_order(pool, 1, seed + k, "_p").select(F.lit(k).alias("pool"), F.to_json(F.struct(*pool.columns)).alias("row"))
        out = row if out is None else out.unionByName(row)
    return out


def repeated(df: DataFrame, times: int, name: str = "call") -> DataFrame:
    """Each row `times` times, numbered: what a function gives that is called again and again."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1)).cast("array<bigint>"))) if times > 0 else df.withColumn(name, F.lit(0).cast("bigint")).where("false")


def best_so_far(df: DataFrame, by: Sequence[str], order: Sequence[str], loss: str, every: int = 1) -> DataFrame:
    """Rows at every k-th step whose loss is below all earlier ones: when a checkpoint would be kept."""
    w = _w(by, order)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_n", F.row_number().over(w)).withColumn("_best", before)
    return marked.where((F.col("_n") % every == 0) & (F.col("_best").isNull() | (F.col(loss) < F.col("_best")))).drop("_n", "_best")
