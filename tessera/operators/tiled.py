"""A matrix stored as tiles: rows (tile_row, tile_col, at, cols, cells), at most TILE x TILE cells each, clipped at the edges.

``at`` holds the places within the tile of the rows that exist, ``cells`` their values one row behind the other. A product
reads a tile as one row, meets one packed stretch of x, and adds up its columns before anything is shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.linalg import TILE, fail
from tessera.sources.shared import stored

#: Elements of x up to which its packed stretches are broadcast.
BROADCAST_CELLS = 1 << 20


def to_tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Packed rows (i, row array) as tiles: one shuffle of row pieces.

    Rows may be missing. An index that occurs twice, or rows of different lengths in a tile, end the query with an error.
    """
    if tile < 1:
        raise ValueError("a tile has at least one row")
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"greatest(size(row) - 1, 0) div {tile}")), lambda c: F.slice("row", c * tile + 1, tile))
    dealt = rows.select("i", F.posexplode(pieces).alias("c", "piece")).select(
        F.expr(f"i div {tile}").alias("tile_row"), F.col("c").cast("bigint").alias("tile_col"), F.struct((F.col("i") % tile).cast("int").alias("at"), F.col("piece").cast("array<double>").alias("piece")).alias("r")
    )
    held = dealt.groupBy("tile_row", "tile_col").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    at, sizes = F.col("rs.at"), F.transform("rs", lambda r: F.size(r["piece"]))
    checked = F.when(F.size(F.array_distinct(at)) < F.size(at), fail("the matrix holds a row twice", "array<int>")).when(
        F.array_min(sizes) < F.array_max(sizes), fail("rows of a tile differ in length", "array<int>")).otherwise(at)
    return held.select("tile_row", "tile_col", checked.alias("at"), F.array_max(sizes).alias("cols"), F.flatten("rs.piece").alias("cells"))


def store_tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """The tiles of packed rows, written to the shared folder once for any number of products."""
    return stored(to_tiles(rows, tile), "tiles")


def packed_x(x: DataFrame, tile: int = TILE) -> DataFrame:
    """(tile_row, xs): the vector (i, xv) in stretches of ``tile``; null where x has no element. An index held twice ends the query with an error."""
    pairs = F.collect_list(F.struct((F.col("i") % tile).cast("int").alias("at"), F.col("xv").cast("double").alias("xv")))
    held = x.groupBy(F.expr(f"i div {tile}").alias("tile_row")).agg(pairs.alias("ps"))
    once = F.when(F.size(F.array_distinct("ps.at")) < F.size("ps"), fail("x holds an index twice", "map<int,double>")).otherwise(F.map_from_entries("ps"))
    return held.select("tile_row", once.alias("m")).select("tile_row", F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda k: F.col("m")[k]).alias("xs"))


def matvec_tiles(tiles: DataFrame, x: DataFrame, tile: int = TILE) -> DataFrame:
    """(j, y): the products of every tile's columns with its stretch of x, added up over the tiles of a column of tiles.

    A task shuffles one row of ``tile`` sums for each column of tiles that it has read. A row of the matrix without an
    element of x ends the query with an error. ``tile`` is the one the tiles were made with.
    """
    small = x.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    xs = packed_x(x, tile)
    met = tiles.join(F.broadcast(xs) if small else xs, "tile_row", "left")
    weight = lambda r: F.coalesce(F.get("xs", F.get("at", r)), fail("x has no element for a row of the matrix"))
    line = lambda r: F.slice("cells", r * F.col("cols") + 1, F.col("cols"))
    lines = F.transform(F.sequence(F.lit(0), F.size("at") - 1), lambda r: F.struct(weight(r).alias("w"), line(r).alias("line")))
    summed = F.aggregate(lines, F.array_repeat(F.lit(0.0), F.col("cols")), lambda acc, r: F.zip_with(acc, r["line"], lambda y, a: y + a * r["w"]))
    parts = met.select("tile_col", F.explode(F.array(summed)).alias("part"))  # so that it is made once, not once for each of its sums
    sums = parts.groupBy("tile_col").agg(*(F.sum(F.get("part", F.lit(k))).alias(f"s{k}") for k in range(tile)))
    cells = sums.select("tile_col", F.posexplode(F.array(*(f"s{k}" for k in range(tile)))).alias("k", "y"))
    return cells.filter("y is not null").select((F.col("tile_col") * tile + F.col("k")).alias("j"), "y")
