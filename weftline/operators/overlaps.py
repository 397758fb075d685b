"""How many members sets have in common, for all pairs of sets, where a few members are in very many.

Such a member makes pairs by the square of its sets, so pairs are counted before they are
sent: sets are cut into blocks by the hash of their id, and one task counts the pairs of
two blocks from their members alone. What is sent are the members, twice for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint

#: Members of the sets in a block; a task holds two blocks.
BLOCK_MEMBERS = 2_000_000
#: Blocks at least, above this many members, so that all cores get some.
SPREAD, SPREAD_MEMBERS = 6, 20_000
#: Pairs that a task counts at once, and cells of a table of counts.
STEP = 1 << 20


def common_members(
    sets: DataFrame, least: int = 1, unlinked: bool = False, chance: float | None = None, most: int | None = None, seed: int = 42, block_members: int = BLOCK_MEMBERS, step: int = STEP
) -> DataFrame:
    """``a, b, n`` with ``a < b`` of sets with at least ``least`` common members.

    ``sets`` has ``id, member``, numbers; repeated rows count once, null ones not. With
    ``unlinked``, ids are members too, and pairs where ``b`` is a member of ``a`` are left
    out. With ``most``, of the pairs that :func:`weftline.functions.scalars.key_uniform` of
    ``seed, a, b`` draws with a ``chance`` only so many of each ``a`` with the greatest
    ``n`` come out, the least ``b`` of equals.
    """
    sets = checkpoint(sets.select(F.col("id").cast("bigint").alias("id"), F.col("member").cast("bigint").alias("member")).filter("id IS NOT NULL AND member IS NOT NULL").distinct())
    members = sets.count()
    blocks = max(-(-members // block_members), SPREAD if members > SPREAD_MEMBERS else 1)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    sides = [
        sets.select(block.alias("_i"), every.alias("_j"), F.lit(True).alias("_left"), "id", "member"),
        sets.select(every.alias("_i"), block.alias("_j"), F.lit(False).alias("_left"), "id", "member"),
    ]
    task: Column = F.col("_i") * blocks + F.col("_j")
    placed = sides[0].unionAll(sides[1]).select(task.alias("task"), "_left", "id", "member")
    counted = (
        placed.repartitionById(blocks * blocks, F.col("task").cast("int")).sortWithinPartitions("task")
        .mapInArrow(_counter(least, unlinked, chance, most, seed, step), "a long, b long, n long")
    )
    if most is None:
        return counted
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return counted.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def _counter(least: int, unlinked: bool, chance: float | None, most: int | None, seed: int, step: int) -> Callable[[Iterator], Iterator]:
    """The pairs of each task, whose rows follow one another. All is inside, as workers may lack the package."""

    def count(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        def drawn(a: int, b: int) -> bool:
            return chance is None or int(hashlib.md5(f"{seed}|{a}|{b}".encode()).hexdigest()[:12], 16) / 16**12 < chance

        def best(a: int, ids, keys, n):
            """Of one ``a``; most pairs are never drawn, as the first ones do."""
            kept: list[int] = []
            for take in (16 * most, len(n)):
                order = np.arange(len(n))
                if take < len(n):  # all with as many as the last one taken
                    order = np.flatnonzero(n >= np.partition(n, len(n) - take)[len(n) - take])
                order = order[np.lexsort((keys[order], -n[order]))]
                kept = []
                for k in order:
                    if drawn(a, int(ids[keys[k]])):
                        kept.append(k)
                        if len(kept) == most:
                            return kept
                if len(order) == len(n):
                    break
            return kept

        def pairs(left, id_, member):
            rows, own = id_[left], member[left]
            ids, local = np.unique(id_[~left], return_inverse=True)
            if not len(rows) or not len(ids):
                return
            # the sets of each member, in the order of their ids
            held, slot = np.unique(member[~left], return_inverse=True)
            lists = np.sort(slot.astype(np.int64) * len(ids) + local)
            order = np.lexsort((own, rows))
            rows, own = rows[order], own[order]
            if unlinked:
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                linked = (ids[at] == own) & (own > rows)
                links_row, links_at = rows[linked], at[linked]
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            known = held[at] == own
            rows, at = rows[known], at[known]
            # only sets with a greater id
            first = np.searchsorted(lists, at * len(ids) + np.searchsorted(ids, rows, "right"))
            size = np.searchsorted(lists, (at + 1) * len(ids)) - first
            some = size > 0
            rows, first, size = rows[some], first[some], size[some]
            targets = lists % len(ids)
            sets_, start = np.unique(rows, return_index=True)
            if not len(sets_):
                return
            start = np.append(start, len(rows))
            ends = np.cumsum(np.append(0, size))
            sums = ends[start]
            done = 0
            while done < len(sets_):
                last = max(done + 1, int(np.searchsorted(sums, sums[done] + step, "right")) - 1)
                f, s = first[start[done] : start[last]], size[start[done] : start[last]]
                n_pairs = int(sums[last] - sums[done])
                place = np.repeat(f - np.append(0, np.cumsum(s)[:-1]), s) + np.arange(n_pairs)
                of = np.repeat(np.arange(last - done), np.diff(sums[done : last + 1]))
                keys = of * len(ids) + targets[place]
                cells = (last - done) * len(ids)
                if cells <= 16 * n_pairs:
                    table = np.bincount(keys, minlength=cells)
                    keys = np.flatnonzero(table >= least)
                    n = table[keys]
                else:
                    keys.sort()
                    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    n = np.diff(np.append(begin, len(keys)))
                    keys = keys[begin]
                    keys, n = keys[n >= least], n[n >= least]
                if unlinked:
                    lo, hi = np.searchsorted(links_row, sets_[done]), np.searchsorted(links_row, sets_[last - 1], "right")
                    taken = np.searchsorted(sets_, links_row[lo:hi]) - done
                    # a set with links but without a pair isn't among the sets
                    there = sets_[np.minimum(taken + done, len(sets_) - 1)] == links_row[lo:hi]
                    free = ~np.isin(keys, taken[there] * len(ids) + links_at[lo:hi][there])
                    keys, n = keys[free], n[free]
                a, b = keys // len(ids), keys % len(ids)
                if most is not None:
                    cut = np.searchsorted(a, np.arange(last - done + 1))
                    chosen = [cut[k] + x for k in range(last - done) if cut[k] < cut[k + 1] for x in best(int(sets_[done + k]), ids, b[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]])]
                    a, b, n = a[chosen], b[chosen], n[chosen]
                for x in range(0, len(n), 200_000):
                    y = slice(x, x + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(sets_[done + a[y]]), pa.array(ids[b[y]]), pa.array(n[y].astype(np.int64))], names=["a", "b", "n"])
                done = last

        def tasks():
            """The columns of a task after the other."""
            now, held = None, []
            for batch in batches:
                task, left, id_, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1), len(task)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    if x == y:
                        continue
                    if held and task[x] != now:
                        yield [np.concatenate(c) for c in zip(*held)]
                        held = []
                    now = task[x]
                    held.append((left[x:y], id_[x:y], member[x:y]))
            if held:
                yield [np.concatenate(c) for c in zip(*held)]

        for columns in tasks():
            yield from pairs(*columns)

    return count
