"""Lines that many documents share, found in levelled sorted runs of line hashes.

Each batch of documents adds one sorted run ``(h1, h2, n)``: the hashes of its
lines and in how many of its documents they stand.  Hashes that an existing run
already settles (``n`` at the threshold) are anti-joined away first.  When a
level has ``fanout`` runs they are merged into one run of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.columns import WHITE, ascii_lower, hash_pair, text_of, with_text_key
from riskweave.session import drop_table, materialise, materialise_at

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """Key of each line: white space stripped at both ends, A-Z lower-cased."""
    return F.transform(lines_of(text), lambda line: ascii_lower(F.btrim(line, F.lit(WHITE))))


class LineRuns:
    """Levels of sorted runs in the shared work folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def _store(self, run: DataFrame, level: int) -> None:
        # sorted by hash: a later merge reads the runs side by side
        run = run.repartition("h1", "h2").sortWithinPartitions("h1", "h2")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(materialise_at(run, f"line-run{level}"))
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._store(_summed([run for run, _ in old]), level + 1)
        for _, path in old:
            drop_table(self.spark, path)

    def add(self, batch: DataFrame) -> None:
        """``batch`` is ``(h1, h2, n)``, each hash once."""
        runs = self._all()
        if runs:
            settled = _union(runs).where(F.col("n") >= self.min_docs).select("h1", "h2").distinct()
            batch = batch.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._store(batch, 0)

    def repeated(self) -> DataFrame:
        """``(h1, h2)`` of the lines that reach the threshold."""
        runs = self._all()
        total = _summed(runs) if len(runs) > 1 else runs[0]
        return materialise(total.where(F.col("n") >= self.min_docs).select("h1", "h2"), "lines-repeated")

    def release(self) -> None:
        for level in self.levels:
            for _, path in level:
                drop_table(self.spark, path)
        self.levels = []


def _union(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def _summed(runs: list[DataFrame]) -> DataFrame:
    return _union(runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def repeated_lines(
    docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``(h1, h2)`` of the keys that at least ``min_docs`` rows contain.

    The corpus is read once: the lines of every batch are hashed and counted
    into one staged table, whose batches then enter the runs one by one.
    """
    text = text_of(text_col)
    h1, h2 = hash_pair(F.col("key"))
    counted = (
        docs.select(
            F.pmod(F.monotonically_increasing_id(), F.lit(batches)).cast("int").alias("batch"),
            F.explode(F.array_distinct(line_keys(text))).alias("key"),
        )
        .where(F.col("key") != "")
        .select("batch", h1.alias("h1"), h2.alias("h2"))
        .groupBy("batch", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    staged, path = materialise_at(counted, "line-batches")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for b in range(batches):
        runs.add(staged.where(F.col("batch") == b).drop("batch"))
    drop_table(docs.sparkSession, path)
    found = runs.repeated()
    runs.release()
    return found


def drop_repeated_lines(
    docs: DataFrame,
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with three more columns: the text without repeated lines and both counts.

    Null or empty text is one empty line.  Empty keys are never counted or
    dropped; a text that loses all its lines becomes empty.  A document counts
    once per line however often it repeats it, a repeated row counts again.
    Columns named like the new ones are replaced; all others stay.
    """
    found = repeated_lines(docs, text_col, min_docs, batches, fanout)
    text = text_of(text_col)
    h1, h2 = hash_pair(F.col("key"))
    # positions depend on the text alone: copies of a text fold into one row before the shuffle
    places = (
        with_text_key(docs.select(text.alias("text")), F.col("text"))
        .select("k1", "k2", F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
        .where(F.col("key") != "")
        .select("k1", "k2", "pos", h1.alias("h1"), h2.alias("h2"))
        .join(found, ["h1", "h2"], "left_semi")
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("pos")).alias("at"))
    )
    places = materialise(places, "line-places")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = with_text_key(docs.select(row, text.alias("text")), F.col("text"))
    cut = keyed.join(places, ["k1", "k2"], "left").select(
        "row", lines_of(F.col("text")).alias("lines"), F.coalesce("at", F.array().cast("array<int>")).alias("at")
    )
    # the lines between consecutive dropped positions: linear in the lines of the document
    starts = F.concat(F.array(F.lit(-1)), F.col("at"))
    ends = F.concat(F.col("at"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(starts, lambda s, i: F.slice(F.col("lines"), s + 2, F.get(ends, i) - s - 1)))
    out = [F.array_join(kept, "\n"), F.size("lines"), F.size("at")]
    return cut.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in names],
        out[0].alias(names[0]),
        out[1].cast("long").alias(names[1]),
        out[2].cast("long").alias(names[2]),
    )
