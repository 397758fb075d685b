"""Items that appear together: pair counts by stripes, and their significance.

Each task turns its records into stripes, an associative array of neighbours and
counts per item, and merges the arrays of equal items before anything is sent.
Stripes of one item and one block of neighbours then meet in one task and are
merged as they stream by in sorted order. An item that is in very many records has
as many blocks as its number of records asks for, so no task holds more of a stripe
than its share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpoint, parallelism

#: Pairs of one item in one block, about; an item with more is split by its neighbours.
PAIRS_A_BLOCK = 1_000_000
#: Items with more than one block are at most this many; their numbers of blocks go to all tasks.
SPLIT_ITEMS = 100_000
#: Pairs held at once while stripes are made.
PAIRS_AT_ONCE = 1_000_000

_STRIPE = "item long, block int, neighbours array<long>, counts array<long>"


def _stripes(split_items, split_blocks):
    """Makes stripes of lists of distinct sorted ids, by item and block."""

    def block(items, ids):
        """Blocks of neighbours; items that aren't split have one."""
        if not len(split_items):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(split_items, items), len(split_items) - 1)
        blocks = np.where(split_items[at] == items, split_blocks[at], 1)
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks

    def stripes(pairs) -> pa.RecordBatch:
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        at = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)])
        counts = np.diff(np.r_[at, len(pairs)])
        item, neighbour = pairs[at, 0], pairs[at, 1]
        part = block(item, neighbour)
        order = np.lexsort((neighbour, part, item))
        item, neighbour, part, counts = item[order], neighbour[order], part[order], counts[order]
        cut = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (part[1:] != part[:-1])])
        offsets = pa.array(np.r_[cut, len(item)].astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (neighbour, counts)]
        return pa.RecordBatch.from_arrays([pa.array(item[cut]), pa.array(part[cut].astype(np.int32)), *arrays], names=["item", "block", "neighbours", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            for pairs in _pairs(batch.column(0)):
                held.append(pairs)
                size += len(pairs)
                if size >= PAIRS_AT_ONCE:
                    yield stripes(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield stripes(np.concatenate(held))

    return run


def _pairs(ids: pa.Array) -> Iterator:
    """Pairs of each list's sorted ids, in pieces of bounded size."""
    lengths = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(ids.flatten()).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for n in np.unique(lengths).tolist():
        if n < 2:
            continue
        first = starts[lengths == n]
        if n * (n - 1) // 2 > PAIRS_AT_ONCE:  # one very long record after the other, one of its items at a time
            for a in first.tolist():
                for i in range(a, a + n - 1):
                    yield np.stack([np.full(a + n - 1 - i, values[i]), values[i + 1 : a + n]], 1)
            continue
        left, right = np.triu_indices(n, 1)
        step = max(1, PAIRS_AT_ONCE // len(left))
        for i in range(0, len(first), step):
            rows = first[i : i + step, None]
            yield np.stack([values[rows + left].ravel(), values[rows + right].ravel()], 1)


def _merge_stream(min_count: int):
    """Merges stripes that come sorted by item and block; the last, perhaps unfinished, one waits."""

    def merged(parts: list):
        neighbour, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(neighbour, kind="stable")
        neighbour, count = neighbour[order], count[order]
        at = np.flatnonzero(np.r_[True, neighbour[1:] != neighbour[:-1]])
        return neighbour[at], np.add.reduceat(count, at)

    def out(items, neighbours, counts) -> pa.RecordBatch:
        item, neighbour, count = (np.concatenate(x) for x in (items, neighbours, counts))
        keep = count >= min_count
        return pa.RecordBatch.from_arrays([pa.array(item[keep]), pa.array(neighbour[keep]), pa.array(count[keep])], names=["item", "neighbour", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, limit = None, [], 0, PAIRS_AT_ONCE
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            ends = np.cumsum(lengths)
            neighbour, count = (np.asarray(batch.column(i).flatten()) for i in (2, 3))
            item, block = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            cut = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (block[1:] != block[:-1])])
            done: tuple = ([], [], [])
            last = int(cut[-1])
            # all stripes that end in this batch at once, and the first one with what was held of it
            low = int(ends[cut[0]] - lengths[cut[0]])
            if current is not None and (int(item[0]), int(block[0])) != current:
                n, c = merged(held)
                done = ([np.full(len(n), current[0])], [n], [c])
                held, size, limit = [], 0, PAIRS_AT_ONCE
            elif current is not None and len(cut) > 1:
                first_end = int(ends[cut[1] - 1])
                n, c = merged([*held, (neighbour[:first_end], count[:first_end])])
                done = ([np.full(len(n), current[0])], [n], [c])
                held, size, limit, low = [], 0, PAIRS_AT_ONCE, first_end
            tail = int(ends[last] - lengths[last])
            if tail > low:
                i = np.repeat(item, lengths)[low:tail]
                b = np.repeat(block, lengths)[low:tail]
                n, c = neighbour[low:tail], count[low:tail]
                order = np.lexsort((n, b, i))
                i, n, c = i[order], n[order], c[order]
                at = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (n[1:] != n[:-1])])
                for store, values in zip(done, (i[at], n[at], np.add.reduceat(c, at)), strict=True):
                    store.append(values)
            if done[0]:
                yield out(*done)
            current = (int(item[last]), int(block[last]))
            held.append((neighbour[tail:], count[tail:]))
            size += len(neighbour) - tail
            if size > limit:  # the limit doubles with what stays, so an entry is sorted a few times only
                held = [merged(held)]
                size = len(held[0][0])
                limit = max(PAIRS_AT_ONCE, 2 * size)
        if current is not None:
            n, c = merged(held)
            yield out([np.full(len(n), current[0])], [n], [c])

    return run


@dataclass(frozen=True)
class Together:
    """``pairs`` is ``a, b, n_ab`` with a < b, ``items`` is ``item, n``, ``records`` their number."""

    pairs: DataFrame
    items: DataFrame
    records: int


def pair_counts(records: DataFrame, record: Column, items: Column, min_count: int = 1, pairs_a_block: int = PAIRS_A_BLOCK) -> Together:
    """Pairs in at least ``min_count`` records, single items, and the number of records with an id above 0.

    ``items`` is an array of ids. Only ids above 0 count, once per record; a record that
    comes more than once counts once, with the ids of all its lists. Null and empty lists
    give no pairs. Null records are one record.
    """
    ids = F.array_sort(F.array_distinct(F.filter(items, lambda x: x > 0)))
    lists = records.select(record.alias("record"), ids.alias("ids")).filter(F.size("ids") > 0)
    # equal lists of a record are one before they are sent; written once, as it is read three times
    once = lists.groupBy("record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    once = checkpoint(once.select("ids"))
    singles = once.select(F.explode("ids").alias("item"), (F.size("ids") - 1).cast("bigint").alias("others")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("others").alias("pairs"))
    total = once.agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("ids") - 1).cast("bigint") * F.size("ids")).alias("pairs")).first()
    # an item above the share that only SPLIT_ITEMS can have, or above a block
    share = max(pairs_a_block, -(-(total["pairs"] or 0) // SPLIT_ITEMS))
    split = singles.filter(F.col("pairs") > share).select("item", F.ceil(F.col("pairs") / pairs_a_block).cast("bigint").alias("blocks")).orderBy("item").toPandas()
    split_items, split_blocks = split["item"].to_numpy(np.int64), split["blocks"].to_numpy(np.int64)
    merged = (
        once.mapInArrow(_stripes(split_items, split_blocks), _STRIPE)
        .repartition(parallelism(records.sparkSession), "item", "block")
        .sortWithinPartitions("item", "block")
        .mapInArrow(_merge_stream(min_count), "item long, neighbour long, n long")
    )
    pairs = merged.select(F.col("item").alias("a"), F.col("neighbour").alias("b"), F.col("n").alias("n_ab"))
    return Together(pairs, singles.select("item", "n"), total["n"])


def with_significance(counted: Together) -> DataFrame:
    """The pairs with ``n_a, n_b, lift`` and ``llr``, the log-likelihood ratio of the two-by-two table."""
    pairs, items, n = counted.pairs, counted.items, counted.records
    full = pairs.join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(
        items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b"
    )
    k11, n_a, n_b, n_all = F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.lit(n).cast("bigint")
    k12, k21, k22 = n_a - k11, n_b - k11, n_all - n_a - n_b + k11
    part = lambda k, row, col: F.when(k > 0, k * F.log(k.cast("double") * n_all / (row.cast("double") * col))).otherwise(0.0)
    llr = 2 * (part(k11, n_a, n_b) + part(k12, n_a, n_all - n_b) + part(k21, n_all - n_a, n_b) + part(k22, n_all - n_a, n_all - n_b))
    lift = k11.cast("double") * n_all / (n_a.cast("double") * n_b)
    return full.select("a", "b", "n_ab", "n_a", "n_b", lift.alias("lift"), llr.alias("llr"))


def strong_pairs(scored: DataFrame, n: int, min_count: int = 5, times: int = 8) -> DataFrame:
    """Pairs in at least ``min_count`` records and at least ``times`` as often as by chance."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    often = wide("n_ab") * F.lit(n).cast("decimal(19,0)") >= wide("n_a") * wide("n_b") * times
    return scored.filter((F.col("n_ab") >= min_count) & often)
