"""Filling containers of fixed capacity: harmonic packing.

Lengths fall into classes by the reciprocal of the capacity: class k holds lengths in (capacity/(k+1), capacity/k], and
every container of the class takes exactly k of them, so no container depends on any other. Groups of documents, set by
a hash of their id, are packed independently. Classes of long documents come first; the space they leave is then given,
best fit, to the short ones, and what is left of these fills containers of their own classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import cut

#: Documents in a group, about: 24 bytes each in one task.
GROUP = 200_000
#: Classes up to this one are placed by count alone; lengths of the later ones may first fill what these leave.
LONG_CLASSES = 7

SCHEMA = "container bigint, place int, item_id bigint, piece int, size int, start bigint"


def pack_group(ids: np.ndarray, piece: np.ndarray, sizes: np.ndarray, capacity: int, top_up: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Container number and place of each item (1 <= size <= capacity)."""
    long_classes = LONG_CLASSES if top_up else capacity
    n = len(sizes)
    bins, place = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((piece, ids, -sizes))
    klass = capacity // sizes[order]
    made = 0
    long = order[klass <= long_classes]
    for k in np.unique(klass[klass <= long_classes]).tolist():
        own = order[klass == k]
        at = np.arange(len(own))
        bins[own], place[own] = made + at // k, at % k
        made += -(-len(own) // k)
    used = np.bincount(bins[long], sizes[long], made).astype(np.int64) if made else np.zeros(0, np.int64)
    count = np.bincount(bins[long], minlength=made) if made else np.zeros(0, np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b in range(made - 1, -1, -1):
        room = capacity - int(used[b])
        if room:
            free[room].append(b)
            mask |= 1 << room
    rest = []
    for i in order[klass > long_classes].tolist():
        size = int(sizes[i])
        fits = mask >> size
        if not fits:
            rest.append(i)
            continue
        room = size + ((fits & -fits).bit_length() - 1)
        b = free[room].pop()
        if not free[room]:
            mask &= ~(1 << room)
        bins[i], place[i] = b, count[b]
        count[b] += 1
        if room > size:
            free[room - size].append(b)
            mask |= 1 << (room - size)
    if rest:
        left = np.array(rest, np.int64)
        kinds = capacity // sizes[left]
        for k in np.unique(kinds).tolist():
            own = left[kinds == k]
            at = np.arange(len(own))
            bins[own], place[own] = made + at // k, at % k
            made += -(-len(own) // k)
    return bins, place


def pack(df: DataFrame, item_id: str, size: str, capacity: int = 2048, group_rows: int = GROUP, top_up: bool = True) -> DataFrame:
    """container, place, item_id, piece, size, start: where each item goes.

    An item larger than the capacity is cut into full pieces and a last one (piece 0, 1, ...; start is the piece's
    offset); any other is never split (piece 0, start 0). Items of null or no size need no container and are left out;
    repeated ids are items of their own; a null id is packed like any other. Containers are numbered by group, so the
    result depends on the rows alone, not on how they are laid out. top_up fills what the long classes leave with items of
    the short ones, an extension of the method; without it every class takes its fixed count and nothing else. Sizes are found once and kept in the shared folder,
    16 bytes each. An empty table gives an empty result.
    """
    sized = cut(df.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(size).cast("bigint").alias("n")).where("n > 0"))
    items = (
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
        .select("item_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"))
    )
    groups = max(1, math.ceil(sized.count() / group_rows))

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("item_id").to_numpy(zero_copy_only=False)
        ids = np.where(np.isnan(ids), np.iinfo(np.int64).min, ids).astype(np.int64) if ids.dtype.kind == "f" else ids
        piece, sizes = group.column("piece").to_numpy().astype(np.int64), group.column("size").to_numpy().astype(np.int64)
        bins, place = pack_group(ids, piece, sizes, capacity, top_up)
        g = group.column("g")[0].as_py()
        return pa.table(
            [pa.array((g << 32) + bins), pa.array(place.astype(np.int32)), group.column("item_id"), pa.array(piece.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(piece * capacity)],
            names=["container", "place", "item_id", "piece", "size", "start"],
        )

    return items.withColumn("g", F.pmod(F.xxhash64("item_id", "piece"), F.lit(groups)).cast("bigint")).groupBy("g").applyInArrow(run, SCHEMA)
