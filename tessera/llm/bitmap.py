"""A bit map of hashed rows that is broadcast: what it doesn't hold is surely none of them, and need not be shuffled.

It has MAP_WORDS words of 64 bits however many rows there are. Beyond some tens of millions of rows it fills up and lets
most others through as well; what a caller does with those has to be exact by itself.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import fresh

#: Words of the map: 16 bytes a row, so 16 MB are broadcast at most.
MAP_WORDS = 1 << 20


def word(place: Column) -> Column:
    return F.pmod(place, F.lit(MAP_WORDS)).cast("bigint")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(place, 20), F.lit(64)).cast("int"))


def made(rows: DataFrame, place: Column) -> DataFrame:
    """(word, bits) of the hashes ``place`` of rows."""
    return rows.groupBy(word(place).alias("word")).agg(F.bit_or(bit(place)).alias("bits"))


def holds(df: DataFrame, place: Column, bits: DataFrame, name: str) -> DataFrame:
    """df with ``name``: whether the map holds the hash ``place`` of a row."""
    w, b = fresh(df, "word", "bits")
    named = bits.select(F.col("word").alias(w), F.col("bits").alias(b))
    joined = df.join(F.broadcast(named), word(place) == F.col(w), "left")
    return joined.select(*(df[c] for c in df.columns), (F.coalesce(F.col(b), F.lit(0).cast("bigint")).bitwiseAND(bit(place)) != 0).alias(name))
