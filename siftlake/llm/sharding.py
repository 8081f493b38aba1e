"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents of equal text form a group, and a group goes to the shard where the dot product of its vector (bytes, tokens,
rows, each as a share of a shard's capacity) with the shard's residual capacity is highest; large groups go first.

For scale the packing runs at two levels. A group that holds more than 1/(64 shards) of any total is heavy. There are at
most a few thousand of them whatever the corpus is, and they are packed on the driver, each whole where any shard has
bytes for it. Only a group that no shard has bytes for would break the law: it is dealt into pieces of about 1/64 of a
shard, or of a row, which are packed in the same order of size. All other groups are dealt by hash into cells of about
CELL_GROUPS groups; each cell is one task that packs its groups into its share of the capacity which the heavy groups
have left. Slots are numbered in two steps as well, within a bucket of a shard and by the sums of the buckets before it,
so no task holds a shard.

Cases: a null text has no bytes and no tokens and is not equal to the empty text; repeated rows each get a slot; a null
doc_id is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import cut

SHARDS = 24
HEAVY_PARTS = 64
CELL_GROUPS = 20_000
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 32
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, residual: np.ndarray, capacity: np.ndarray, strict: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item (rows of items, largest first): where its share of capacity, dotted with what is left, is highest.

    Only shards whose bytes it fits are asked, as bytes are the law; if there is none, it goes where most bytes are left,
    or, if it is strict, nowhere (-1). Ties go to the lowest shard. residual is changed.
    """
    scale = np.where(capacity > 0, capacity, 1.0)
    items, left = items / scale, residual / scale
    out = np.empty(len(items), np.int32)
    for k, item in enumerate(items):
        fits = left[:, 0] >= item[0]
        if strict is not None and strict[k] and not fits.any():
            out[k] = -1
            continue
        out[k] = best = int(np.argmax(np.where(fits, left @ item, -np.inf) if fits.any() else left[:, 0]))
        left[best] -= item
    residual[:] = left * scale
    return out


def _largest_first(frame: pd.DataFrame, total: np.ndarray) -> pd.DataFrame:
    share = (frame[list(DIMENSIONS)].to_numpy(float) / np.where(total > 0, total, 1)).max(1)
    return frame.assign(_share=-share).sort_values(["_share", "g1", "g2"], kind="stable").drop(columns="_share")


def pack(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    text = F.coalesce("text", F.lit(""))
    base = cut(
        documents.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("g1"),
            F.xxhash64(F.lit(1), "text").alias("g2"),
        )
    ).withColumn("row", F.monotonically_increasing_id())
    vector = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = base.groupBy("g1", "g2").agg(*vector)
    sums = groups.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS), F.count("*").alias("groups")).first()
    total = np.array([sums[d] for d in DIMENSIONS], float)
    parts = shards * HEAVY_PARTS
    share = F.greatest(*(F.col(d) * F.lit(parts / max(total[k], 1.0)) for k, d in enumerate(DIMENSIONS)))
    # Each heavy group holds more than 1/parts of some total: there are fewer than 3 * parts of them.
    pieces = F.least(F.ceil(share), F.col("rows")).cast("int").alias("pieces")
    heavy = pd.DataFrame([tuple(r) for r in groups.where(share > 1).select("g1", "g2", *DIMENSIONS, pieces).collect()], columns=["g1", "g2", *DIMENSIONS, "pieces"])
    heavy = _largest_first(heavy, total)
    session = documents.sparkSession
    capacity = total / shards
    residual = np.tile(capacity, (shards, 1))
    names = ["g1", "g2", "piece", *DIMENSIONS]

    def integers(frame: pd.DataFrame, columns: list[str]) -> list[tuple[int, ...]]:
        return [tuple(map(int, r)) for r in frame[columns].itertuples(index=False)]

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        """The pieces of groups."""
        if not len(frame):
            return pd.DataFrame(columns=names)
        to = session.createDataFrame(integers(frame, ["g1", "g2", "pieces"]), "g1 long, g2 long, pieces int")
        parts = base.join(F.broadcast(to), ["g1", "g2"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
        return pd.DataFrame([tuple(r) for r in parts.groupBy("g1", "g2", "piece").agg(*vector).collect()], columns=names)

    # Whole groups have one piece, of number 0; what no shard has bytes for is dealt after all.
    small = (heavy["pieces"] == 1) | (heavy["bytes"].to_numpy(float) <= capacity[0])
    items = _largest_first(pd.concat([heavy[small].assign(piece=0, strict=heavy["pieces"] > 1), deal(heavy[~small]).assign(strict=False)], ignore_index=True), total)
    items["shard"] = place(items[list(DIMENSIONS)].to_numpy(float), residual, capacity, items["strict"].to_numpy(bool)) if len(items) else []
    out = set(integers(items[items["shard"] < 0], ["g1", "g2"]))
    late = np.array([g in out for g in integers(heavy, ["g1", "g2"])], bool)
    pieces = _largest_first(deal(heavy[late]), total)
    pieces["shard"] = place(pieces[list(DIMENSIONS)].to_numpy(float), residual, capacity) if len(pieces) else []
    heavy.loc[small & ~late, "pieces"] = 1
    heavies = session.createDataFrame(integers(heavy, ["g1", "g2", "pieces"]), "g1 long, g2 long, pieces int")
    marked = base.join(F.broadcast(heavies), ["g1", "g2"], "left")
    big = marked.where("pieces IS NOT NULL").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
    shard_of = [r for x in (items[items["shard"] >= 0], pieces) for r in integers(x, ["g1", "g2", "piece", "shard"])]
    chosen = session.createDataFrame(shard_of, "g1 long, g2 long, piece int, shard int")
    columns = ["doc_id", "size", "text_crc32", "row", "shard"]
    placed = big.join(F.broadcast(chosen), ["g1", "g2", "piece"]).select(*columns)
    n_light = sums["groups"] - len(heavy)
    if n_light:
        cells = -(-n_light // CELL_GROUPS)
        left = residual.sum(0)

        def cell(frame: pd.DataFrame) -> pd.DataFrame:
            frame = _largest_first(frame, total)
            items = frame[list(DIMENSIONS)].to_numpy(float)
            part = items.sum(0) / np.where(left > 0, left, 1)
            return frame[["g1", "g2"]].assign(shard=place(items, residual * part, capacity * part))

        light = groups.where(share <= 1).withColumn("cell", F.pmod(F.xxhash64("g2", "g1"), F.lit(cells)))
        to = light.groupBy("cell").applyInPandas(cell, "g1 long, g2 long, shard int")
        placed = placed.unionByName(marked.where("pieces IS NULL").join(to, ["g1", "g2"]).select(*columns))
    buckets = max(LEAST_BUCKETS, int(total[2]) // (shards * BUCKET_ROWS))
    placed = cut(placed.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(buckets))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row"))
    slots = placed.withColumn("rank", rank).join(offsets, ["shard", "bucket"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))


def op4_sharding(documents: DataFrame) -> DataFrame:
    out = pack(documents)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
