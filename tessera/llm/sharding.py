"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed by their text into SLOTS virtual slots, so equal texts share a slot. Bytes are summed per slot. A
versioned map says which shard holds each slot: version 0 deals the slots out by number, every rebalancing appends a
version in which slots have moved from overfull shards. The map lives on: a later call with the same map_path edits its
last version by the sizes it then finds. A slot heavier than half a shard (a large group of copies) is cut by doc_id
into FINE parts, and such a part, if it is that heavy too (a repeated or null id), by the rows' place in the table; the
map moves parts one by one, everything else moves as a whole slot.

The law that holds is ``bytes``: the shards' sizes are near equal (apart by about the smallest slots' sizes, at most
by one slot), whatever the sizes of texts and groups. Groups of equal texts stay in one shard unless they are cut.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import cut, exists, new_path

SHARDS, SLOTS, FINE = 8, 4096, 64
#: Entries of the map up to which it is broadcast: 24 bytes each, so 6 MB.
BROADCAST_ENTRIES = 1 << 18
#: slots and fine are what the map was made with; the same virtual slot stands for other records under others.
MAP = "version int, virtual_slot int, part int, shard int, slots int, fine int"


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS, fine: int = FINE) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, part, at): size is UTF-8 bytes plus 1 (null: 1), the checksum of null that of the empty text.

    at numbers the rows, task by task.
    """
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(
        docs[key].alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(t), F.lit(slots)).cast("int").alias("virtual_slot"), F.pmod(F.xxhash64(docs[key], F.lit("part")), F.lit(fine)).cast("int").alias("part"),
        F.monotonically_increasing_id().alias("at"),
    )


def entries(rows: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """rows with their entry of the map in ``part``: -1 for a slot that moves as a whole, else the part, or a part of a part.

    Only slots and parts with more than half a shard's bytes are cut. Of those there are fewer than 2 * shards each, and
    they are what is broadcast.
    """
    cells = cut(rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes")), "cells")  # slots x fine rows at most
    total = cells.agg(F.sum("bytes")).first()[0] or 0

    def heavy(groups: DataFrame) -> DataFrame:
        return groups.filter(F.col("bytes") * 2 * shards > F.lit(total)).drop("bytes")

    slots = heavy(cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"))).withColumn("is_cut", F.lit(True))
    parts = heavy(cells).withColumn("is_fine", F.lit(True))
    spread = F.lit(fine) + F.col("part") * fine + F.pmod("at", F.lit(fine)).cast("int")
    part = F.when(F.col("is_cut").isNull(), F.lit(-1)).when(F.col("is_fine").isNull(), F.col("part")).otherwise(spread)
    joined = rows.join(F.broadcast(slots), "virtual_slot", "left").join(F.broadcast(parts), ["virtual_slot", "part"], "left")
    return joined.withColumn("part", part).drop("is_cut", "is_fine")


def entry_sizes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, part, bytes) of the map's entries in rows."""
    return rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0: (version, virtual_slot, part, shard), slots dealt out by number; part -1 stands for the whole slot."""
    return sizes.select(F.lit(0).alias("version"), "virtual_slot", "part", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"))


def last_version(versions: DataFrame) -> int:
    """-1 for a map without entries."""
    last = versions.agg(F.max("version")).first()[0]
    return -1 if last is None else last


def carry_over(old: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(virtual_slot, part, shard, bytes) of every entry that the last version of old or sizes has; bytes are 0 without rows.

    A new entry starts where its slot was as a whole, else where the slot's least part was; a new slot by its number.
    Shards that no longer exist are taken modulo shards.
    """
    now = old.filter(F.col("version") == F.lit(last_version(old))).select("virtual_slot", "part", F.pmod("shard", F.lit(shards)).cast("int").alias("shard"))
    home = now.groupBy("virtual_slot").agg(F.min(F.struct("part", "shard"))["shard"].alias("home"))
    whole = sizes.join(now, ["virtual_slot", "part"], "full").join(home, "virtual_slot", "left")
    start = F.coalesce("shard", "home", F.pmod("virtual_slot", F.lit(shards))).cast("int")
    return whole.select("virtual_slot", "part", start.alias("shard"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def rebalance(old: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: an edit of its last one by the bytes of the entries.

    Heaviest first, an entry stays where it is while its shard has room up to the mean, else it goes to the emptiest
    shard. The fold runs over the map's entries only (slots and parts of heavy ones), as one expression in one row.
    """
    listed = carry_over(old, sizes, shards).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "part", "shard"))).alias("entries"), F.ceil(F.sum("bytes") / shards).alias("mean"),
    )

    def place(state, e):
        load = state["load"]
        here = F.element_at(load, e["shard"] + 1) - e["less"]
        to = F.when(here <= F.col("mean"), e["shard"] + 1).otherwise(F.array_position(load, F.array_min(load)).cast("int"))
        changed = F.transform(load, lambda x, k: F.when(k + 1 == to, x - e["less"]).otherwise(x))
        return F.struct(changed.alias("load"), to.alias("to"))

    # the state of every entry is kept by folding blocks: inner folds carry loads, the outer one the list of moves
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"), F.lit(0).alias("to"))

    def step(acc, e):
        nxt = place(acc["state"], e)
        return F.struct(nxt.alias("state"), F.concat(acc["moved"], F.array(nxt["to"] - 1)).alias("moved"))

    size = 64
    block = F.struct(start.alias("state"), F.array().cast("array<array<int>>").alias("all"))

    def outer(acc, k):
        part = F.slice("entries", k * size + 1, size)
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast("array<int>").alias("moved")), step)
        return F.struct(inner["state"].alias("state"), F.concat(acc["all"], F.array(inner["moved"])).alias("all"))

    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size("entries") - 1) / size), F.lit(0)).cast("int"))
    folded = listed.filter(F.size("entries") > 0).select("entries", F.flatten(F.aggregate(blocks, block, outer)["all"]).alias("to"))
    pair = folded.select(F.explode(F.arrays_zip("entries", "to")).alias("x"))
    return pair.select(F.lit(last_version(old) + 1).cast("int").alias("version"), F.col("x.entries.virtual_slot"), F.col("x.entries.part"), F.col("x.to").alias("shard"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS, fine: int = FINE, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every row.

    slot is the row's place in its shard, from 0 without gaps; grown_shard is null under this law. The versioned map is
    kept at map_path (default: the shared folder). Where there is one, a version is appended to it: entries without rows
    keep their place, new slots and parts get one, no row is lost; one made with other numbers of slots or parts raises
    ``ValueError``. One call at a time may edit a map. Null texts count
    one byte and share a group with empty ones. Repeated rows each get a place. An empty table gives an empty result.
    Other columns of docs are not read.
    """
    spark = docs.sparkSession
    rows = cut(records(docs, key, text, slots, fine), "records")
    keyed = entries(rows, shards, fine)
    sizes = cut(entry_sizes(keyed), "entries")
    path = map_path or new_path(spark, "slot-map")
    made = lambda m: m.withColumns({"slots": F.lit(slots), "fine": F.lit(fine)})
    if not exists(spark, path):
        made(first_map(sizes, shards)).write.partitionBy("version").parquet(path)
    stored = spark.read.schema(MAP).parquet(path)
    other = stored.filter((F.col("slots") != slots) | (F.col("fine") != fine)).select("slots", "fine").limit(1).collect()
    if other:
        raise ValueError(f"the map at {path} was made with {other[0].slots} slots of {other[0].fine} parts")
    made(rebalance(stored, sizes, shards)).write.mode("append").partitionBy("version").parquet(path)
    stored = spark.read.schema(MAP).parquet(path)
    version = last_version(stored)
    current = stored.filter(F.col("version") == F.lit(version)).select("virtual_slot", "part", "shard")
    current = F.broadcast(current) if slots + 2 * shards * fine * (fine + 1) <= BROADCAST_ENTRIES else current
    # a task's rows are numbered within their shard, behind those of the tasks before; no group exceeds a task's rows
    placed = keyed.join(current, ["virtual_slot", "part"]).withColumn("task", F.shiftright("at", 33))
    counts = placed.groupBy("shard", "task").count()
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = counts.select("shard", "task", F.coalesce(F.sum("count").over(before), F.lit(0).cast("bigint")).alias("offset"))
    within = Window.partitionBy("shard", "task").orderBy("at")
    numbered = placed.select("*", (F.row_number().over(within) - 1).alias("k")).join(offsets, ["shard", "task"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        F.lit(version).cast("int").alias("map_version"),
    )
