"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors is never above the Hamming distance, so pairs within distance r on the grid are all candidates
for Hamming distance r. For r = 2 every such pair shares a grid cell that is within 1 of both ends (a
midpoint), so each fingerprint goes to its own cell and to the cells one step away, and the range join is
an equi-join on cells (the packed count vector: exact, no hashing). Candidates are then verified exactly.
Cells with many members are not paired: their members are joined on bit-level midpoints (the fingerprint or
one flipped bit), which links exactly the pairs at distance 2 or less through a star.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, map_rows
from orrery.llm.components import connected_components

#: Members from which a cell is linked by stars, not by pairs.
STAR_FROM = 16
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64 values.

    A-Z are lower-cased, words end at [\\x20\\x09-\\x0D], shingles are `width` words with repeats; fewer
    words make one shingle, none (or null text) give 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n, tops = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    for at in range(0, n, 100_000):  # bounded memory for any length
        part = words[at : min(at + 100_000, n) + width - 1]
        if len(words) < width:
            keys = [b" ".join(words)]
        elif width == 3:
            keys = [b"%b %b %b" % t for t in zip(part, part[1:], part[2:], strict=False)]
        else:
            keys = [b" ".join(part[i : i + width]) for i in range(len(part) - width + 1)]
        h = xxhash.xxh64_intdigest
        v = np.array([h(k, SEED) for k in keys], np.uint64)
        tops += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(tops * 2 > n, bitorder="little").view(np.int64)
    return int(bits[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs; extra columns are ignored."""

    def make():
        def fn(cols):
            yield [cols[0], [fingerprint(t) for t in cols[1]]]

        return fn

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


LOW = 0x5555555555555555
#: Moves of one step: no move; 0 <-> 1 in a segment (flips its low bit); 1 <-> 2 (flips both its bits).
STEPS = [0, *(_signed(1 << i) for i in range(0, 64, 2)), *(_signed(3 << i) for i in range(0, 64, 2))]
FLIPS = [0, *(_signed(1 << i) for i in range(64))]


def _popcounts(fp: Column) -> Column:
    """The counts (0, 1, 2) of the two-bit segments, packed into as many bits. Bit operations only: no overflow."""
    down = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(down).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(down).bitwiseAND(F.lit(LOW)), 1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{v}L' if v > -(1 << 63) else '(-9223372036854775807L - 1L)' for v in values)})")


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, cell): the fingerprint's own cell and every legal cell one step away."""
    own, step = F.col("own"), F.col("step")
    low_only = step.bitwiseAND(F.lit(~LOW)) == 0
    legal = F.when(low_only, own.bitwiseAND(F.shiftleft(step, 1)) == 0).otherwise(own.bitwiseAND(step) != 0)
    stepped = fps.select("fp", _popcounts(F.col("fp")).alias("own"), F.explode(_longs(STEPS)).alias("step"))
    return stepped.where(legal).select("fp", own.bitwiseXOR(step).alias("cell"))


def links(ws: Workspace, fps: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b), a < b, that connect all fingerprints at Hamming distance <= 2.

    `distance` may be 0, 1 or 2: a common cell one step away is promised up to 2.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    # few bytes become about 49 rows each: dealt out first, to a number of tasks that stays as it is
    cells = _cells(fps.repartition(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), "fp"))
    shared = ws.save(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    near = hamming(F.col("a"), F.col("b")) <= distance
    two = shared.where("n = 2").where(near).select("a", "b")
    members = ws.save(cells.join(shared.where("n > 2").select("cell", "n"), "cell"), "members")
    few = members.where(F.col("n") < STAR_FROM).groupBy("cell").agg(F.collect_list("fp").alias("m"))
    some = few.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where("a < b").where(near)
    # a code has at most 65 fingerprints within one bit of it, so its group is bounded
    codes = members.where(F.col("n") >= STAR_FROM).select("fp").distinct().select("fp", F.explode(_longs(FLIPS)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("code"))
    if distance < 2:
        group = F.collect_list("fp").over(Window.partitionBy("code"))
        star = codes.select(F.col("fp").alias("a"), F.explode(group).alias("b")).where("a < b").where(near)
    else:
        star = codes.select(F.min("fp").over(Window.partitionBy("code")).alias("a"), F.col("fp").alias("b")).where("a < b")
    return two.union(some).union(star)


def components(ws: Workspace, fps: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): the smallest doc_id reachable over links, itself included.

    Rows keep their number; a null doc_id is never a component_id unless it has no other.
    """
    table = ws.save(fps, "fingerprints")
    ids = ws.save(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = connected_components(ws, links(ws, ids.select("fp"), distance))
    grouped = ids.join(label.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    grouped = ws.save(grouped, "labelled")
    root = ws.save(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "roots")
    named = ws.save(grouped.join(root, "label").select("fp", "component_id"), "named")
    return table.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """docs (doc_id, text, any others) -> (doc_id, fingerprint: 16 hex digits, component_id), a row per input row.

    Null and empty texts have fingerprint zero and are linked like any other. Ties and repeated rows are
    kept as they are. Columns of any other name are ignored, whatever their names.
    """
    ws = Workspace(docs.sparkSession)
    out = components(ws, fingerprints(docs), distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents without near copies of an earlier one: of each component its smallest doc_id stays, with all its
    rows and columns, whatever their names. Rows without doc_id stay. Null and empty texts are copies of each other."""
    ws = Workspace(docs.sparkSession)
    found = components(ws, fingerprints(docs), distance)
    gone = ws.save(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
