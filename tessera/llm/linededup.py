"""Line deduplication by overlapping three-line windows.

Every run of WINDOW consecutive lines of a document is hashed to 128 bits. A window that stands more than once in the
corpus, within a document or across documents, is repeated; its first occurrence (least doc_id, then least line, then
least hash of the text, which tells texts of one id apart) stays, and every later one covers its lines. Covered lines
go; a line goes once, however many windows cover it. Hashes are made once and written to the shared folder.

Most documents lose no line. Their texts aren't shuffled: what a bit map of the documents that do lose some doesn't hold
passes straight through.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.storage import cut, discard, fresh, write

WINDOW = 3


def _lines(text):
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(id, mark, line, a, b): a window's document, its first line from 0, and its hash."""
    body = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("mark"), _lines(docs[text]).alias("lines")).filter(F.size("lines") >= window)
    starts = F.sequence(F.lit(1), F.size("lines") - (window - 1))
    w = body.select("id", "mark", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice("lines", k, window), "\n"))).alias("line", "w"))
    return w.select("id", "mark", "line", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(WINDOW), "w").alias("b"))


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, mark, gone): the lines, from 0, that later occurrences of repeated windows cover; only documents with some."""
    return _covered(windows(docs, key, text, window), window)


def _covered(w: DataFrame, window: int) -> DataFrame:
    first = w.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "line", "mark")).alias("first")).filter("n > 1")
    later = w.join(first.select("a", "b", "first"), ["a", "b"]).filter(~F.struct("id", "line", "mark").eqNullSafe(F.col("first")))
    found = later.groupBy("id", "mark").agg(F.collect_set("line").alias("at"))
    return found.select("id", "mark", F.array_distinct(F.flatten(F.transform("at", lambda k: F.sequence(k, k + (window - 1))))).alias("gone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in ``keep``) with the covered lines taken out of the text, and n_removed, their number.

    All rows stay; a text all of whose lines are covered becomes empty. Null texts, texts of fewer lines than a window
    and unique texts stay as they are. Empty lines are lines. Rows with equal id and text are one document: they get
    the same result, and don't count as copies of one another. A null id comes before all others. A column n_removed of
    docs is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "n_removed"]
    i, m, h, gi, gm, g = fresh(docs, "id", "mark", "held", "gone_id", "gone_mark", "gone")
    hashed, path = write(windows(docs, key, text, window), "windows")
    gone = cut(_covered(hashed, window), "covered-lines")
    discard(docs.sparkSession, path)
    bits = bitmap.made(gone, F.xxhash64("id", "mark"))
    gone = gone.select(F.col("id").alias(gi), F.col("mark").alias(gm), F.col("gone").alias(g))
    own = docs.withColumn(i, docs[key]).withColumn(m, F.xxhash64(docs[text]))
    held = bitmap.holds(own, F.xxhash64(i, m), bits, h)
    free = held.filter(~F.col(h)).select(*kept, F.lit(0).cast("bigint").alias("n_removed"))
    joined = held.filter(F.col(h)).join(gone, F.col(i).eqNullSafe(F.col(gi)) & (F.col(m) == F.col(gm)), "left")
    remaining = F.array_join(F.filter(_lines(F.col(text)), lambda _, k: ~F.array_contains(F.col(g), k)), "\n")
    clean = F.when(F.col(g).isNull(), F.col(text)).otherwise(remaining)
    cleaned = joined.select(*(clean.alias(c) if c == text else F.col(c) for c in kept), F.coalesce(F.size(g), F.lit(0)).cast("bigint").alias("n_removed"))
    return free.union(cleaned)


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, k, array_to_string(lines[k:k + 2], chr(10)) AS w FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS k FROM d)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS o FROM w),
g AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM r WHERE o > 1),
a AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i)], chr(10)) END AS text,
       coalesce(len(gone), 0)::BIGINT AS n_removed
FROM d LEFT JOIN a USING (doc_id)
"""
