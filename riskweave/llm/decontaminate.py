"""Benchmark decontamination by a prefix-filtered join.

A window is ``window`` consecutive words of an item (the whole item if it is
shorter).  Words are ordered by how often the corpus has them, so the rarest
word of a window is the only prefix token needed to find a full containment.
Candidates obey the length and positional bounds and are then compared word by
word over windows of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.columns import ascii_lower, hash_pair, text_of, with_text_key
from riskweave.session import materialise

WINDOW = 10
#: After A-Z are lower-cased, everything ASCII but digits and letters parts words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of at most so many rows are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD, -1), "")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def prefix_tokens(texts: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(word, item_id, at, first, last, width, span)``: rarest word of each window.

    Consecutive windows with the same rarest position ``at`` share one row:
    they start at ``first`` to ``last``, and ``span`` is the words they cover.
    """
    i1, i2 = hash_pair(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text"))
    kept = items.select("item_id", words_of(F.col("text")).alias("words"), i1.alias("i1"), i2.alias("i2")).where(
        F.size("words") > 0
    )
    kept = materialise(kept.dropDuplicates(["i1", "i2"]), "items")
    placed = kept.select("i1", "i2", F.posexplode("words").alias("pos", "word"))
    vocabulary = materialise(placed.select("word").distinct(), "item-words")
    seen = (
        texts.select(F.explode(words_of(F.col("text"))).alias("word"))
        .join(_small(vocabulary), "word", "left_semi")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = (
        placed.join(seen, "word", "left")
        .groupBy("i1", "i2")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("order"))
    )
    width = F.least(F.lit(window), F.size("words"))
    rarest = F.transform(
        F.sequence(F.lit(0), F.size("words") - width),
        lambda s: F.struct(
            s.alias("start"),
            F.array_min(
                F.transform(F.slice("order", s + 1, width), lambda o: F.struct(o["n"], o["word"], o["pos"]))
            ).alias("token"),
        ),
    )
    return (
        kept.join(ranked, ["i1", "i2"])
        .select("i1", "i2", "item_id", "words", width.alias("width"), F.explode(rarest).alias("w"))
        .groupBy("i1", "i2", F.col("w.token.word").alias("word"), F.col("w.token.pos").alias("at"))
        .agg(
            F.first("item_id").alias("item_id"),
            F.first("width").alias("width"),
            F.min("w.start").alias("first"),
            F.max("w.start").alias("last"),
            F.first("words").alias("words"),
        )
        .select(
            "word", "item_id", "at", "first", "last", "width",
            F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("width")).alias("span"),
        )
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` rows as ``row`` with ``doc_id, n_words, hits, items``.

    ``hits`` is the array of ``(start, end)`` word intervals that equal a window
    of an item, sorted (twice if two items have it), ``items`` the distinct ids of those items as sorted strings.
    Null texts have no words; items without words are skipped; an item without
    an id matches and is listed as the empty string.  Rows may repeat and ids
    may be null: the join runs on the text.  Extra columns travel in ``row``.
    """
    text = text_of(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = with_text_key(docs.select(row, F.col(id_col).alias("doc_id"), text.alias("text")), F.col("text"))
    tokens = materialise(
        prefix_tokens(
            rows.select("text"),
            items.select(F.col(item_id_col).alias("item_id"), text_of(item_text_col).alias("text")),
            window,
        ),
        "prefix-tokens",
    )
    n_words = F.size("words")
    at_word = (
        rows.select("k1", "k2", words_of(F.col("text")).alias("words"))
        .where(n_words > 0)
        .select("k1", "k2", n_words.alias("n"), F.posexplode("words").alias("pos", "word"))
    )
    shift = F.col("pos") - F.col("at")
    found = (
        at_word.join(_small(tokens), "word")
        .withColumn("shift", shift)
        # some window must lie inside the document
        .where((F.col("shift") + F.col("last") >= 0) & (F.col("shift") + F.col("first") + F.col("width") <= F.col("n")))
        .groupBy("k1", "k2")
        .agg(
            F.collect_set(
                F.struct("shift", "first", "last", "width", "span", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
            ).alias("met")
        )
    )
    found = materialise(found, "leak-candidates")
    # a text crosses the shuffle once, as it is, and is split after it
    joined = rows.select("row", "doc_id", "k1", "k2").join(found, ["k1", "k2"], "left").select(
        "row", "doc_id", "met", words_of(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))).alias("words")
    )
    words = F.col("words")

    def equal_windows(c: Column) -> Column:
        starts = F.sequence(c["first"], c["last"])
        same = F.filter(
            starts,
            lambda s: (c["shift"] + s >= 0)
            & (c["shift"] + s + c["width"] <= F.size(words))
            & (
                F.slice(words, F.greatest(c["shift"] + s, F.lit(0)) + 1, c["width"])
                == F.slice(c["span"], s - c["first"] + 1, c["width"])
            ),
        )
        return F.transform(
            same,
            lambda s: F.struct(
                (c["shift"] + s).alias("start"), (c["shift"] + s + c["width"]).alias("end"), c["item"].alias("item")
            ),
        )

    hits = F.coalesce(
        F.flatten(F.transform(F.col("met"), equal_windows)), F.array().cast("array<struct<start:int,end:int,item:string>>")
    )
    # one row each, exploded: a filter on the result stays above it and does not compare anew
    told = F.struct(F.size("words").cast("long").alias("n_words"), hits.alias("found"))
    return joined.select("row", "doc_id", F.explode(F.array(told)).alias("told")).select(
        "row", "doc_id", "told.n_words",
        F.array_sort(F.transform("told.found", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))).alias("hits"),
        F.array_sort(F.array_distinct(F.transform("told.found", lambda h: h["item"]))).alias("items"),
    )


def covered(hits: Column) -> Column:
    """Words inside any of the sorted intervals."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, h: Column) -> Column:
        return F.struct(
            F.greatest(acc["end"], h["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], acc["end"]))).alias("n"),
        )

    return F.aggregate(hits, start, step, lambda acc: acc["n"])
