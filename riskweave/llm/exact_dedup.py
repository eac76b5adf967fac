"""Exact duplicates through an extendible-hash index on shared files.

The directory doubles until no bucket holds more than ``bucket_rows`` distinct
hashes; an owner task per bucket (a contiguous key range) chains the texts that
share a hash and stores the chain in the index.  Grouping by the text itself is
the byte comparison: equal hashes of different texts stay separate links.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.columns import text_of
from riskweave.session import materialise

#: The directory never has more slots, so it is safe to hold and broadcast;
#: a bucket at this depth that is still overfull grows a longer chain instead.
MAX_DEPTH = 16
BUCKET_ROWS = 4096


def split_directory(cells: list[tuple[int, int]], bucket_rows: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """``(prefix, local_depth, rows)`` of each bucket in key order.

    ``cells`` holds the rows of each non-empty slot at ``max_depth``.
    """
    slots = [s for s, _ in sorted(cells)]
    before = [0, *accumulate(n for _, n in sorted(cells))]

    def rows(prefix: int, depth: int) -> int:
        shift = max_depth - depth
        lo, hi = bisect_left(slots, prefix << shift), bisect_left(slots, (prefix + 1) << shift)
        return before[hi] - before[lo]

    directory = [(0, 0, rows(0, 0))]
    for _ in range(max_depth):  # each round doubles the directory
        if all(n <= bucket_rows for _, _, n in directory):
            break
        split = []
        for prefix, depth, n in directory:
            if n <= bucket_rows:
                split.append((prefix, depth, n))
            else:
                children = (2 * prefix, 2 * prefix + 1)
                split += [(c, depth + 1, rows(c, depth + 1)) for c in children]
        directory = split
    return directory


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - MAX_DEPTH).cast("int")


def build_index(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The index table ``(bucket, local_depth, h, link, text_sha256, keep_id, group_size)``.

    ``rows`` is ``(id, text, h)``.  The directory counts distinct hashes, so a
    text copied a million times takes one entry; the copies are folded before
    the shuffle.
    """
    cells = rows.select("h").distinct().groupBy(_slot(F.col("h")).alias("slot")).count().collect()
    directory = split_directory([(r["slot"], r["count"]) for r in cells], bucket_rows)
    table = []
    for bucket, (prefix, depth, _) in enumerate(directory):
        shift = MAX_DEPTH - depth
        table.append((bucket, depth, prefix << shift, (prefix + 1) << shift))
    taken = {r["slot"] for r in cells}
    slots = [(s, b, d) for b, d, lo, hi in table for s in range(lo, hi) if s in taken]
    where = rows.sparkSession.createDataFrame(slots, "slot int, bucket int, local_depth int")
    entries = (
        rows.groupBy("h", "text")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2(F.col("text"), 256).alias("text_sha256"), "keep_id", "group_size")
        .withColumn("slot", _slot(F.col("h")))
        .join(F.broadcast(where), "slot")
    )
    chain = Window.partitionBy("bucket", "h").orderBy("text_sha256")
    owned = entries.repartition("bucket").withColumn("link", F.row_number().over(chain) - 1)
    return materialise(
        owned.select("bucket", "local_depth", "h", "link", "text_sha256", "keep_id", "group_size"),
        "exact-index",
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
    key_bits: int = 64,
) -> DataFrame:
    """One row per document: which row of its group of equal texts stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, bucket, link``.
    Null text counts as empty.  The largest id of a group stays; a null id
    never beats another, and in a group without any id each row stays.  Rows
    repeated with their id share one decision.  Other columns are not read, so
    their names cannot clash.  ``key_bits`` narrows the hash (for tests).
    """
    text = text_of(text_col)
    h = F.xxhash64(text)
    if key_bits < 64:
        h = F.shiftleft(F.shiftrightunsigned(h, 64 - key_bits), 64 - key_bits)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), h.alias("h"))
    index = build_index(rows, bucket_rows)
    probe = rows.select("id", "h", F.sha2(F.col("text"), 256).alias("text_sha256"))
    return probe.join(index, ["h", "text_sha256"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "bucket",
        "link",
    )
