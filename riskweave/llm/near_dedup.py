"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch is filled in rounds.  In round i every element is hashed to a bin and a
value, and a bin keeps the least (round, value); once all bins are full no later
round can change one.  From round t on, round t + b offers every element to bin
b alone, so each bin fills for certain, and agreeing bins estimate the Jaccard
similarity with the concentration of independent samples.  Bands of a sketch
give buckets; links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.columns import text_of, with_text_key
from riskweave.llm.components import connected_components
from riskweave.llm.shingles import mix, shingle_set
from riskweave.session import materialise

#: Chance that banding misses a pair exactly at the threshold.
MISS = 1e-6
MAX_BANDS = 48
#: Texts on either side of a block of comparisons.
BLOCK_ROWS = 256


def banding(percent: int, miss: float = MISS, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most selective bands that still miss a pair at the threshold with chance ``miss`` at most."""
    best = (math.ceil(math.log(miss) / math.log(1 - percent / 100)) if percent < 100 else 1, 1)
    for rows in range(2, 65):
        p = (percent / 100) ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(miss) / math.log1p(-p))
        if bands > max_bands:
            break
        best = (bands, rows)
    return best


def similarity_sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The filled bins of a non-empty set of 64-bit hashes."""
    # bits of a packed value: round above hash, so the earliest round wins
    low, width, bits = np.uint64(32), np.uint64(bins), np.uint64(40)
    full = np.uint64(2**64 - 1)
    filled = np.full(bins, full)
    done, n = 0, elements.size
    with np.errstate(over="ignore"):
        while done < bins and (filled == full).any():
            # about as many rounds at once as usually fill all bins; later rounds never change a full one
            rounds = np.arange(done, min(bins, done + max(1, 7 * bins // n)), dtype=np.uint64)
            h = mix(elements[None, :] ^ mix(rounds + np.uint64(1))[:, None])
            at = ((h >> low) * width) >> low
            value = (rounds[:, None] << bits) | (h & np.uint64(0xFFFFFFFF))
            np.minimum.at(filled, at.ravel().astype(np.int64), value.ravel())
            done += rounds.size
        for b in np.flatnonzero(filled == full):
            r = np.uint64(bins + int(b))
            h = mix(elements ^ mix(np.array([r + np.uint64(1)], dtype=np.uint64)))
            filled[b] = (r << bits) | (h & np.uint64(0xFFFFFFFF)).min()
    return filled


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, with the band's number in it."""
    h = mix(np.arange(1, bands + 1, dtype=np.uint64))
    grid = sketch.reshape(bands, rows)
    with np.errstate(over="ignore"):
        for i in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grid[:, i])
    return h.view(np.int64)


def _sketch_texts(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``(id, k1, k2, n, node, keys)``: size, 128-bit hash and band keys of each shingle set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, keys = [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), size)
                n.append(s.size)
                node.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band_keys(similarity_sketch(s, bands * rows), bands, rows) if s.size else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "k1", "k2", "n", "node", "keys"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(sketch, f"id {kind}, k1 long, k2 long, n long, node binary, keys array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``(a, b)`` whose full sets reach the threshold. ``texts`` is ``(no, text)``."""
    rows = pairs.join(texts.select(F.col("no").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("no").alias("b"), F.col("text").alias("tb")), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of_held = None, None  # rows with the same b follow one another
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if b != held:
                    held, of_held = b, shingle_set(tb.as_py(), size)
                x = shingle_set(ta.as_py(), size)
                both = np.intersect1d(x, of_held, assume_unique=True).size
                keep.append(100 * both >= percent * (x.size + of_held.size - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column(1), batch.column(0))], ["a", "b"])

    return rows.select("b", "a", "ta", "tb").mapInArrow(verify, "a long, b long")


def _links_apart(members: DataFrame, bodies: DataFrame, size: int, percent: int, bins: int) -> DataFrame:
    """Links between the components that meet in a cluster.

    ``members`` is ``(no, comp, cluster)``.  Whatever is outside the largest
    component of its cluster meets all other members, in blocks of BLOCK_ROWS by
    BLOCK_ROWS texts, so a cluster of any size is spread over many tasks.  The
    largest component is not compared within itself, and a block reports only
    links that join components it has not joined yet.
    """
    per = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    placed = members.join(whole, "cluster").join(bodies, "no").select(
        "cluster", "no", "comp", "main", "text",
        F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("mb"),
        F.ceil((F.col("all") - F.col("most")) / BLOCK_ROWS).cast("int").alias("ob"),
    )
    placed = materialise(placed, "placed")
    own = lambda blocks: F.pmod(F.xxhash64("no"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = placed.where("comp <> main").withColumn("o", own("ob")).withColumn("m", every("mb"))
    right = placed.withColumn("m", own("mb")).withColumn("o", every("ob"))
    columns = ["cluster", "o", "m", "no", "comp", "main", "text"]
    both = left.select(*columns, F.lit(True).alias("left")).unionByName(right.select(*columns, F.lit(False).alias("left")))
    share = percent / 100
    # six deviations below the threshold
    least = bins * share - 6 * math.sqrt(bins * share * (1 - share)) - 1

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.drop_duplicates("no").set_index("no")
        sets = {no: shingle_set(text, size) for no, text in first["text"].items()}
        sketches = {no: similarity_sketch(x, bins) for no, x in sets.items()}
        here, there = pdf[pdf["left"]], pdf[~pdf["left"]]
        out: list[tuple[int, int]] = []
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        if len(here) and len(there):
            no, comp = there["no"].to_numpy(), there["comp"].to_numpy()
            is_main = comp == there["main"].to_numpy()
            n = np.array([sets[x].size for x in no])
            grid = np.stack([sketches[x] for x in no])
            for a, own_comp in zip(here["no"], here["comp"]):
                x = sets[a]
                # two outside the largest component meet twice, in either order: once is enough
                open_ = (comp != own_comp) & (is_main | (no > a)) & (100 * np.minimum(n, x.size) >= percent * np.maximum(n, x.size))
                near = np.flatnonzero(open_)
                near = near[(grid[near] == sketches[a]).sum(axis=1) >= least]
                for k in near:
                    # a link between components that are joined by now adds nothing
                    mine, other = root(own_comp), root(comp[k])
                    if mine == other:
                        continue
                    shared = np.intersect1d(x, sets[no[k]], assume_unique=True).size
                    if 100 * shared >= percent * (x.size + n[k] - shared):
                        joined[mine] = other
                        out.append((int(a), int(no[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.groupBy("cluster", "o", "m").applyInPandas(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    miss: float = MISS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, k1, k2)``, one row per document.

    Documents are linked when their sets of distinct ``size``-word shingles have
    a Jaccard similarity of at least ``percent`` hundredths; ``component_id`` is
    the least id reachable.  Null and wordless texts have no shingles and are
    linked with nothing; a component without any id has none, and its rows are
    all kept.  Rows repeated with their id share one decision.  Other columns
    are not read; ``k1, k2`` are the hash of the text, to join the decisions back.

    Equal sets are one node.  First each node meets the least node of one of its
    buckets, which connects most near copies in linear work.  Bucket mates that
    are still in different components are then compared with each other in
    blocks, on sketches and, where these don't rule it out, on full sets; only
    links leave a task.
    """
    bands, rows = banding(percent, miss)
    texts = with_text_key(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), F.col("text"))
    sketched = materialise(_sketch_texts(texts.select("id", "k1", "k2", "text"), size, bands, rows), "sketches")
    whole = F.first(F.struct("k1", "k2", "n", "keys")).alias("one")
    nodes = materialise(
        sketched.where("n > 0")
        .groupBy("node")
        .agg(F.min("id").alias("least_id"), whole)
        .select("node", "least_id", "one.*")
        .withColumn("no", F.monotonically_increasing_id()),
        "nodes",
    )

    placed = nodes.select("no", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.min("no").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialise(placed.join(shared.select("key", "head"), "key"), "buckets")
    needed = buckets.select("no").distinct().join(nodes.select("no", "k1", "k2"), "no")
    bodies = materialise(
        texts.select("k1", "k2", "text").join(needed, ["k1", "k2"]).groupBy("no").agg(F.first("text").alias("text")), "bodies"
    )

    first = materialise(
        buckets.where("no <> head").groupBy("no").agg(F.min("head").alias("head")).select(F.col("no").alias("a"), F.col("head").alias("b")),
        "first-pairs",
    )
    links = materialise(_linked(first, bodies, size, percent), "first-links")
    root = connected_components(links)

    # bucket mates that are still apart: compared within the groups that their buckets form
    comp = root.withColumnRenamed("v", "no")
    labelled = buckets.join(comp, "no", "left").select("key", "no", F.coalesce("root", "no").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("no").alias("hub")).where("c0 <> c1")
    apart = materialise(labelled.join(mixed.select("key", "hub"), "key").select("no", "comp", "hub").distinct(), "apart")
    cluster = connected_components(apart.select(F.col("no").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("v", "no")
    members = apart.select("no", "comp").distinct().join(cluster, "no", "left").select(
        "no", "comp", F.coalesce("root", "no").alias("cluster")
    )
    more = materialise(_links_apart(materialise(members, "members"), bodies, size, percent, bands * rows), "second-links")
    final = connected_components(links.union(more))

    named = nodes.select("no", "node", "least_id").join(final.withColumnRenamed("v", "no"), "no", "left").withColumn(
        "root", F.coalesce("root", "no")
    )
    named = materialise(named, "named-nodes")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = named.join(least, "root").select("node", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (
        sketched.select("id", "n", "node", "k1", "k2")
        .join(of_node, "node", "left")
        .select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"), "k1", "k2",
        )
    )
