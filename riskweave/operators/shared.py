"""How many keys any two members share, counted block of members against block of members.

Where many members hold the same keys, the pairs of a key number the square of
its members, and most of them come again with the next key.  Joined and grouped,
every one of them crosses a shuffle.  Here each member's keys are one row, which
is sent to the cells of its block, and a cell counts its pairs in memory: what
crosses the shuffle are the rows, once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import materialise

#: Members on one side of a cell at most, and at least while there are few blocks.
CELL_ROWS, LEAST_ROWS, FEW_BLOCKS = 16384, 512, 8
#: Pairs of members whose counts a task holds at once, and keys met at once.
GRID, MET = 1 << 20, 1 << 22
#: Pairs of keys' members that cells are worth, per row that they send.
PAIRS_PER_ROW = 1.0
#: Bytes of all keys up to which they are sent to every task to name a pair's least one.
BROADCAST_BYTES = 32 << 20


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the row of each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), counts)


class _Keys:
    """One relation's keys of both sides of a cell, as places in lists of members."""

    def __init__(self, left: pa.Array, right: pa.Array):
        keys, member = _flat(right)
        order = np.argsort(keys, kind="stable")
        self.known, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.members = member[order]
        keys, self.owner = _flat(left)
        at = np.searchsorted(self.known, keys)
        at[at == self.known.size] = 0
        held = self.known[at] == keys if self.known.size else np.zeros(keys.size, dtype=bool)
        self.at, self.owner = at[held], self.owner[held]

    def _met(self, start: int, at: np.ndarray, owner: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in the grid where keys ``at`` of left rows meet, with these keys and how many places each has; in parts."""
        n = self.count[at]
        ends, i = np.cumsum(n), 0
        while i < at.size:
            done = int(ends[i - 1]) if i else 0
            k = max(i + 1, int(np.searchsorted(ends, done + MET, "right")))
            some, m = at[i:k], n[i:k]
            place = np.arange(m.sum()) + np.repeat(self.first[some] - (np.cumsum(m) - m), m)
            yield np.repeat((owner[i:k] - start) * width, m) + self.members[place], some, m
            i = k

    def grid(self, start: int, stop: int, width: int) -> np.ndarray:
        """How many keys the left rows from ``start`` on share with each right row."""
        total = np.zeros((stop - start) * width, dtype=np.int32)
        i, j = np.searchsorted(self.owner, [start, stop])
        for met, _, _ in self._met(start, self.at[i:j], self.owner[i:j], width):
            total += np.bincount(met, minlength=total.size).astype(np.int32)
        return total.reshape(stop - start, width)

    def least(self, start: int, stop: int, width: int) -> np.ndarray:
        """The least key that the left rows from ``start`` on share with each right row, -1 without any."""
        out = np.full((stop - start) * width, -1, dtype=np.int64)
        i, j = np.searchsorted(self.owner, [start, stop])
        down = i + np.argsort(-self.at[i:j], kind="stable")  # the last one written stays
        for met, some, m in self._met(start, self.at[down], self.owner[down], width):
            out[met] = np.repeat(self.known[some], m)
        return out.reshape(stop - start, width)


class SharedKeys:
    """Members with the keys they share with others, by relation; :func:`shared_lists` makes it."""

    def __init__(self, lists: DataFrame, keys: dict[str, DataFrame], minimum: dict[str, int], blocks: int):
        self.lists, self.keys, self.relations, self.minimum = lists, keys, list(keys), minimum
        self.blocks = blocks

    def at_least(self, relation: str, minimum: int) -> SharedKeys:
        """Only pairs that share so many keys of the relation count as linked by it."""
        return SharedKeys(self.lists, self.keys, self.minimum | {relation: minimum}, self.blocks)

    def scan(self, emit: Callable, schema: str, least: bool = False, both_ways: bool = False) -> DataFrame:
        """``emit(entities, left, right, grids)`` for each strip of each cell.

        ``left`` and ``right`` are places in ``entities``, which is in order; ``grids`` has for
        each relation how many keys these two share, 0 below the relation's minimum and for
        pairs that belong to another place.  With ``least`` it has their least common keys
        besides, with ``both_ways`` each pair comes in both directions.
        """
        relations, minimum, blocks = self.relations, self.minimum, self.blocks
        own = F.pmod(F.xxhash64("entity_id"), F.lit(blocks)).cast("int")
        placed = self.lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        rows = placed.select((low * F.lit(blocks) + high).alias("cell"), (F.col("own") == low).alias("left"), "entity_id", *relations)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, table in _cells(batches):
                same = cell // blocks == cell % blocks
                order = pc.sort_indices(table.column("entity_id"))
                table = table.take(order)
                entities, is_left = table.column("entity_id"), table.column("left").to_numpy(zero_copy_only=False)
                left = np.flatnonzero(is_left)
                right = left if same else np.flatnonzero(~is_left)
                if not left.size or not right.size:
                    continue
                ways = [(left, right), (right, left)] if both_ways and not same else [(left, right)]
                for some, others in ways:
                    keys = [_Keys(*(table.column(r).take(pa.array(side)) for side in (some, others))) for r in relations]
                    step = max(1, GRID // others.size)
                    for start in range(0, some.size, step):
                        stop = min(some.size, start + step)
                        grids = [k.grid(start, stop, others.size) for k in keys]
                        for r, grid in zip(relations, grids):
                            if same:  # each pair once, or in both directions, and nobody with itself
                                at, other = np.arange(start, stop)[:, None], np.arange(others.size)[None, :]
                                grid[at == other if both_ways else at >= other] = 0
                            if minimum[r] > 1:
                                grid[grid < minimum[r]] = 0
                        if least:
                            grids += [k.least(start, stop, others.size) for k in keys]
                        yield from emit(entities, some[start:stop], others, grids)

        return rows.repartition(blocks * (blocks + 1) // 2, "cell").sortWithinPartitions("cell").mapInArrow(count, schema)

    def pairs(self, least: bool = False) -> DataFrame:
        """``(source, target, <relation>, …)``: linked pairs, the smaller id first, with the keys shared in each relation.

        With ``least`` also ``<relation>_key``, the number of the least key shared in it.
        """
        kind = self.lists.schema["entity_id"].dataType.simpleString()
        known = len(self.relations)
        columns = [*self.relations, *(f"{r}_key" for r in self.relations if least)]
        names = ["source", "target", *columns]

        def emit(entities: pa.Array, left: np.ndarray, right: np.ndarray, grids: list) -> Iterator[pa.RecordBatch]:
            i, j = np.nonzero(np.logical_or.reduce([g > 0 for g in grids[:known]]))
            a, b = left[i], right[j]
            for k in range(0, i.size, 1 << 17):
                part = slice(k, k + (1 << 17))
                ends = [_taken(entities, f(a[part], b[part])) for f in (np.minimum, np.maximum)]
                counts = [pa.array(g[i[part], j[part]].astype(np.int64)) for g in grids]
                yield pa.RecordBatch.from_arrays([*ends, *counts], names)

        return self.scan(emit, f"source {kind}, target {kind}, " + ", ".join(f"{c} long" for c in columns), least)

    def named(self, pairs: DataFrame, relation: str, name: str) -> DataFrame:
        """Add ``name``, the least key that :meth:`pairs` has by its number; null where no key is shared."""
        keys = self.keys[relation]
        size = keys.agg(F.sum(F.octet_length(F.col("key").cast("string")))).first()[0] or 0
        told = keys.select(F.col("no").alias(f"{relation}_key"), F.col("key").alias(name))
        return pairs.join(F.broadcast(told) if size <= BROADCAST_BYTES else told, f"{relation}_key", "left")

    def strongest(self, top: int, weights: dict[str, float]) -> DataFrame:
        """``(src, dst, relation_type, weight)``: each member's links, with its ``top`` of a cell or more.

        The order is by weight, then the other's id, then the relation.
        """
        kind = self.lists.schema["entity_id"].dataType.simpleString()
        relations = sorted(self.relations)
        order = [self.relations.index(r) for r in relations]

        def emit(entities: pa.Array, left: np.ndarray, right: np.ndarray, grids: list) -> Iterator[pa.RecordBatch]:
            weight = np.stack([grids[k] * weights[r] for k, r in zip(order, relations)], axis=2).reshape(left.size, -1)
            if weight.shape[1] > top:
                last = np.partition(weight, -top, axis=1)[:, -top, None]
                above, equal = weight > last, weight == last
                kept = above | (equal & (np.cumsum(equal, axis=1) <= top - above.sum(axis=1, keepdims=True)))
            else:
                kept = np.ones(weight.shape, dtype=bool)
            i, j = np.nonzero(kept & (weight > 0))
            columns = [_taken(entities, left[i]), _taken(entities, right[j // len(order)])]
            columns += [pa.array(np.array(relations)[j % len(order)]), pa.array(weight[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["src", "dst", "relation_type", "weight"])

        return self.scan(emit, f"src {kind}, dst {kind}, relation_type string, weight double", both_ways=True)

    def degrees(self) -> DataFrame:
        """``(entity_id, n)``: the members linked with each in any relation, 0 or more rows each to be added up."""
        kind = self.lists.schema["entity_id"].dataType.simpleString()

        def emit(entities: pa.Array, left: np.ndarray, right: np.ndarray, grids: list) -> Iterator[pa.RecordBatch]:
            linked = np.logical_or.reduce([g > 0 for g in grids])
            for side, n in ((left, linked.sum(axis=1)), (right, linked.sum(axis=0))):
                yield pa.RecordBatch.from_arrays([_taken(entities, side[n > 0]), pa.array(n[n > 0].astype(np.int64))], ["entity_id", "n"])

        return self.scan(emit, f"entity_id {kind}, n long")

    def totals(self) -> DataFrame:
        """``(relation_type, n)``: the pairs linked in each relation, rows to be added up."""
        relations = self.relations

        def emit(entities: pa.Array, left: np.ndarray, right: np.ndarray, grids: list) -> Iterator[pa.RecordBatch]:
            n = np.array([np.count_nonzero(g) for g in grids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(relations)[n > 0]), pa.array(n[n > 0])], ["relation_type", "n"])

        return self.scan(emit, "relation_type string, n long")


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    out = values.take(pa.array(at))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each cell; cells follow one another."""
    held, parts = None, []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), cells.size]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if cells[s] != held and parts:
                yield held, pa.Table.from_batches(parts)
                parts = []
            held = int(cells[s])
            parts.append(batch.slice(s, e - s))
    if parts:
        yield held, pa.Table.from_batches(parts)


def blocks_of(members: int) -> int:
    return max(1, -(-members // CELL_ROWS), min(FEW_BLOCKS, -(-members // LEAST_ROWS)))


def shared_lists(members: dict[str, DataFrame], pairs_per_row: float | None = None) -> SharedKeys | None:
    """Lists of shared keys of ``{relation: (key, entity_id)}``, or None where joining the pairs sends less.

    ``members`` hold each (key, entity) once.  Keys of one member are left out.
    """
    worth = PAIRS_PER_ROW if pairs_per_row is None else pairs_per_row
    kinds = {m.schema["entity_id"].dataType for m in members.values()}
    if len(kinds) != 1 or not isinstance(next(iter(kinds)), T.StringType | T.IntegralType):
        return None
    numbered, pairs, rows = {}, 0, 0
    for relation, m in members.items():
        sizes = m.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # numbered in the order of the keys
        keys = materialise(sizes.orderBy("key").withColumn("no", F.monotonically_increasing_id()), "shared-keys")
        n = F.col("n").cast("decimal(38,0)")
        held = keys.agg(F.sum(n * (n - 1) / 2).alias("p"), F.sum("n").alias("r")).first()
        pairs, rows = pairs + int(held["p"] or 0), rows + (held["r"] or 0)
        numbered[relation] = keys
    # every block has a member, so there are no more blocks than rows
    if pairs <= worth * rows * blocks_of(1) or not rows:
        return None
    listed = None
    for relation, m in members.items():
        told = m.join(numbered[relation].select("key", "no"), "key").select("entity_id", F.lit(relation).alias("r"), "no")
        listed = told if listed is None else listed.unionByName(told)
    lists = listed.groupBy("entity_id").agg(
        *[F.collect_list(F.when(F.col("r") == relation, F.col("no"))).alias(relation) for relation in members]
    )
    lists = materialise(lists, "shared-lists")
    found = SharedKeys(lists, numbered, dict.fromkeys(members, 1), blocks_of(lists.count()))
    return found if pairs > worth * rows * found.blocks else None
