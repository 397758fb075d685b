"""Filling fixed-capacity containers with documents, by swap-based local search.

Documents are sized once in tokens of a public tokenizer. A document that exceeds
the capacity is cut into full pieces and a rest; nothing else is split. The items
of a kind are spread by hash over groups, as each group leaves at most about one
container partly filled. In a group the items are first placed best fit, and then
documents are moved or exchanged, one for one or two for one, from the emptiest
container into others, each step raising the sum of squared fills, until
containers empty and no step helps any more.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpoint

#: Items packed together.
GROUP_ITEMS = 10_000


def default_vocabulary() -> str:
    """Place of the rank file of the many-language tokenizer; any such file can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_sizes(docs: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``key, n_tokens`` of the documents whose text is not null or blank."""
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        pairs = (line.split() for line in ranks.value.splitlines() if line)
        encoding = tiktoken.Encoding("sizes", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])

    filled = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?U)\S"))
    return filled.mapInArrow(count, "key long, n_tokens long")


def pack(sizes: list[int], capacity: int, first_fit: bool = False, search: bool = True) -> list[int]:
    """Number of the container of each item; every size is from 1 to ``capacity``.

    Starts best fit from the largest item down, or, with ``first_fit``, in the order given, which leaves more to the search.
    """
    place = _first_fit(sizes, capacity) if first_fit else _best_fit(sizes, capacity)
    if search:
        local_search(sizes, place, capacity)
    number: dict[int, int] = {}
    return [number.setdefault(b, len(number)) for b in place]


def _first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The first container with room, by a tree of the most room in each half."""
    leaves = 1 << max(1, len(sizes)).bit_length()
    most = [capacity] * (2 * leaves)
    place = []
    for size in sizes:
        at = 1
        while at < leaves:
            at = 2 * at if most[2 * at] >= size else 2 * at + 1
        place.append(at - leaves)
        most[at] -= size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
    return place


def _best_fit(sizes: list[int], capacity: int) -> list[int]:
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if some container has room r
    place = [0] * len(sizes)
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        rest = rooms >> sizes[i]
        if rest:
            room = sizes[i] + (rest & -rest).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        place[i] = b
        if room > sizes[i]:
            by_room[room - sizes[i]].append(b)
            rooms |= 1 << (room - sizes[i])
    return place


def least_containers(sizes: list[int], capacity: int) -> int:
    """A bound from below: the sum, and the items of which no two fit together."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def local_search(sizes: list[int], place: list[int], capacity: int, steps: list | None = None) -> None:
    """Empties containers by moves and by exchanges of one for one and two for one; changes ``place``.

    Containers give from the emptiest on; each step takes the most tokens from one that some container
    has room for, and raises the sum of squared fills. It ends when as few containers are left as can
    hold all items, or when none can give any more. ``steps`` gets that sum after each step.
    """
    import numpy as np

    size, bin_of = np.asarray(sizes, np.int64), np.asarray(place, np.int64)
    if not len(size):
        return
    fill = np.bincount(bin_of, weights=size).astype(np.int64)
    least = least_containers(sizes, capacity)
    alive = int((fill > 0).sum())
    stepped = True
    while stepped and alive > least:
        stepped = False
        for donor in np.lexsort((np.arange(len(fill)), fill)).tolist():
            if not 0 < fill[donor] < capacity:
                continue
            while fill[donor] and (step := _step(size, bin_of, fill, capacity, donor)):
                out, target, back = step
                gain = int(size[out].sum() - size[back].sum())
                bin_of[out] = target
                bin_of[back] = donor
                fill[target] += gain
                fill[donor] -= gain
                stepped = True
                if steps is not None:
                    steps.append(int((fill * fill).sum()))
            alive -= not fill[donor]
            if alive <= least:
                break
    place[:] = bin_of.tolist()


def _step(size, bin_of, fill, capacity: int, donor: int):
    """Items to give, the container that takes them, and the items it gives back, or none if nothing helps."""
    import numpy as np

    room = np.where(fill > 0, capacity - fill, 0)
    room[donor] = 0
    mine = np.flatnonzero(bin_of == donor)
    mine = mine[np.argsort(size[mine], kind="stable")]
    own = size[mine]
    best = (0, None)
    # a move: the largest item for which there is room, to the container it fills best
    n = int(np.searchsorted(own, room.max(), "right"))
    if n:
        takes = np.flatnonzero((room >= own[n - 1]) & (fill + own[n - 1] > fill[donor]))
        if len(takes):
            best = (int(own[n - 1]), (mine[n - 1 : n], int(takes[np.argmin(room[takes])]), mine[:0]))
    others = np.flatnonzero(room[bin_of] > 0)
    theirs, theirs_room, theirs_fill = size[others], room[bin_of[others]], fill[bin_of[others]]

    def exchange(sums):
        """For each item of the others the largest of ``sums`` that may take its place."""
        at = np.searchsorted(sums, theirs + theirs_room, "right") - 1
        gain = np.where(at >= 0, sums[np.maximum(at, 0)] - theirs, 0)
        gain[theirs_fill + gain <= fill[donor]] = 0
        k = int(np.argmax(gain))
        return int(gain[k]), int(at[k]), others[k]

    if len(others):
        gain, at, back = exchange(own)
        if gain > best[0]:
            best = (gain, (mine[at : at + 1], int(bin_of[back]), np.array([back])))
        if not best[0] and len(mine) > 1:
            first, second = np.triu_indices(len(mine), 1)
            both = own[first] + own[second]
            order = np.argsort(both, kind="stable")
            gain, at, back = exchange(both[order])
            if gain > 0:
                best = (gain, (mine[[first[order[at]], second[order[at]]]], int(bin_of[back]), np.array([back])))
    return best[1]


def fill_containers(sizes: DataFrame, kinds: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``kind, container, key, piece, token_from, token_to`` for every item and kind.

    ``sizes`` has unique ``key`` and ``n_tokens``; ``kinds`` has ``kind`` and
    ``capacity`` and is a short list. Sizes of null or 0 take no container; kinds
    with a null or a capacity below 1 are left out. Only a document larger than the
    capacity has more than one piece, each but the last filling a container.
    ``token_to`` is exclusive. No documents give no rows.
    """
    sizes = checkpoint(sizes.filter("n_tokens > 0"))
    total = sizes.count()
    groups = max(1, -(-total // group_items))
    kinds = kinds.filter("kind IS NOT NULL AND capacity > 0").distinct()
    rows = kinds.collect()  # a short list by its meaning
    if not rows:
        return sizes.filter("false").selectExpr("'' AS kind", "'' AS container", "key", "0 AS piece", "0L AS token_from", "0L AS token_to")
    pieces = _per_kind(sizes, rows).withColumn("last", F.floor((F.col("n_tokens") - 1) / F.col("capacity")))
    # a rest that is full too is a piece like those before it
    whole = F.when(F.col("n_tokens") % F.col("capacity") == 0, F.col("last")).otherwise(F.col("last") - 1)
    number = lambda c: (c * F.col("capacity")).alias("token_from")
    full = (
        pieces.filter(whole >= 0)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)).alias("piece"))
        .select("kind", F.concat(F.lit("d"), F.col("key").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), "key", F.col("piece").cast("int").alias("piece"), number(F.col("piece")), ((F.col("piece") + 1) * F.col("capacity")).alias("token_to"))
    )
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")
    rests = pieces.filter(F.col("n_tokens") % F.col("capacity") > 0).select(
        "kind", "capacity", group.alias("grp"), "key", F.col("last").cast("int").alias("piece"),
        number(F.col("last")), F.col("n_tokens").alias("token_to"),
    )

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending")])
        size = pa.compute.subtract(table["token_to"], table["token_from"]).to_pylist()
        placed = pack(size, table["capacity"][0].as_py())
        g = table["grp"][0].as_py()
        names = pa.array([f"g{g}-{p}" for p in placed])
        return pa.table([table["kind"], names, table["key"], table["piece"], table["token_from"], table["token_to"]], names=["kind", "container", "key", "piece", "token_from", "token_to"])

    packed = rests.groupBy("kind", "grp").applyInArrow(place, "kind string, container string, key long, piece int, token_from long, token_to long")
    return packed.unionByName(full)


def _per_kind(sizes: DataFrame, rows: list) -> DataFrame:
    """Each document once for each kind; the kinds are written into the plan, as they are few by their meaning."""
    kinds = F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(int(r["capacity"])).cast("bigint").alias("capacity")) for r in rows])
    return sizes.select("key", "n_tokens", F.inline(kinds))


def container_fill(placed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Fill of every container, ``kind, container, n_items, n_tokens, capacity``."""
    tokens = F.sum(F.col("token_to") - F.col("token_from"))
    fills = placed.groupBy("kind", "container").agg(F.count(F.lit(1)).alias("n_items"), tokens.alias("n_tokens"))
    return fills.join(F.broadcast(kinds.select("kind", "capacity").distinct()), "kind")


def validity(placed: DataFrame, sizes: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kind, capacity, n_docs, n_too_full, n_not_whole, n_cut`` of a packing held against the sizes; all but the first are 0 if it is sound."""
    n = F.col("token_to") - F.col("token_from")
    kinds = kinds.filter("kind IS NOT NULL AND capacity > 0").select("kind", "capacity").distinct()
    full = placed.groupBy("kind", "container").agg(F.sum(n).alias("n")).join(F.broadcast(kinds), "kind").groupBy("kind").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_too_full"))
    docs = placed.groupBy("kind", "key").agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("pieces"), F.min("token_from").alias("a"), F.max("token_to").alias("b"), F.countDistinct("piece").alias("distinct")
    )
    held = _per_kind(sizes.filter("n_tokens > 0"), kinds.collect()).join(docs, ["kind", "key"], "left")
    whole = (F.col("a") == 0) & (F.col("b") == F.col("n_tokens")) & (F.col("n") == F.col("n_tokens")) & (F.col("pieces") == F.col("distinct"))
    per = held.groupBy("kind", "capacity").agg(
        F.count("pieces").alias("n_docs"),
        F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_not_whole"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("n_cut"),
    )
    return per.join(full, "kind").select("kind", "capacity", "n_docs", "n_too_full", "n_not_whole", "n_cut")
