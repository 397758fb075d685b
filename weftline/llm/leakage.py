"""Evaluation texts leaking into training text, by template canonicalisation.

Both sides become templates: numbers, names and units are typed placeholders. Windows of
templates are hashed on both sides, and the documents' windows are joined with those of the
evaluation items. There are two kinds of windows: of template tokens, which also find questions
asked again with other parameters, and of letters with typed digits, which don't depend on how a
text is divided into words. Joined windows are checked by their slots (are the fillers the same,
or replaced one for one?) and letter by letter.

The documents are read once, whatever the number of items: a filter of the items' windows goes to
all tasks, and only windows it holds leave them.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.canonical import DIGIT, NAME, NUMBER, UNIT, Stream, Template, char_tables, stream, template, window_hashes
from weftline.session import checkpoint, parallelism

#: Letters of the least passage, for items in words and in zh or ja.
RUN, RUN_DENSE = 60, 24
DENSE = ("zh", "ja")
#: Least template tokens of a re-parameterised passage.
TEMPLATE_WORDS, TEMPLATE_CHARS = 16, 32
#: Kinds of windows: number, size, and distance of the items' windows, so that each least passage holds one.
LETTERS, LETTERS_DENSE, WORDS, CHARS = (0, 52, 9), (1, 20, 5), (2, 14, 3), (3, 28, 5)
#: Bits of the filter for one window of an item, probes, and its greatest size, 64 MB. Above some 30 million
#: windows more of the others pass, which the join removes.
BITS_A_WINDOW, PROBES, MAX_BITS = 32, (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 29
#: Characters of small texts handled at once. A longer text is handled whole, at about 40 bytes a character.
CHARS_AT_ONCE = 500_000

_HITS = "doc long, kind int, hash long, letters string, hashes array<long>, slice string"


def _typed(s: Stream) -> np.ndarray:
    """The letters with every digit as one placeholder."""
    return np.where(s.kind == DIGIT, np.uint32(NUMBER), s.chars)


def _letter_windows(s: Stream, kind: tuple[int, int, int]):
    """Pieces of positions and hashes of the windows that lie in one text."""
    number, size, _ = kind
    left = np.repeat(s.bounds[1:], np.diff(s.bounds))
    for a, h in window_hashes(_typed(s), size, number):
        whole = left[a : a + len(h)] >= np.arange(a + size, a + size + len(h))
        yield a, h, whole


def _token_windows(t: Template, kind: tuple[int, int, int]):
    number, size, _ = kind
    dense = np.r_[0, np.cumsum(t.dense)]
    for a, h in window_hashes(t.code, size, number):
        b = a + len(h)
        same_text = t.text[a:b] == t.text[a + size - 1 : b + size - 1]
        yield a, h, same_text & ((dense[a + size : b + size] > dense[a:b]) == (number == CHARS[0]))


def _around(s: Stream, text: int, at: int, need: int, size: int, pad: str) -> str:
    """The window's letters and so many on each side that every least passage with it is among them."""
    a, b = at - (need - size), at + need
    low, high = max(a, int(s.bounds[text])), min(b, int(s.bounds[text + 1]))
    return pad * (low - a) + s.chars[low:high].tobytes().decode("utf-32-le") + pad * (b - high)


def _slot(bits: int, h: np.ndarray, probe: int) -> np.ndarray:
    return (h if probe == 1 else h * np.uint64(probe)) >> np.uint64(64 - bits)


def _held(filter_: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter holds."""
    kept = np.arange(len(h))
    for probe in PROBES:
        at = _slot(bits, h[kept], probe)
        kept = kept[(filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0]
    return kept


def _item_windows(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``kind, hash, item, need, letters, tokens`` of each item's windows."""
        for batch in batches:
            for item, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = stream([text], tables.value)
                need, kind = (RUN_DENSE, LETTERS_DENSE) if lang in DENSE else (RUN, LETTERS)
                rows = []
                for a, h, whole in _letter_windows(s, kind):
                    for i in np.flatnonzero(whole & (np.arange(a, a + len(h)) % kind[2] == 0)):
                        rows.append((kind[0], h[i], need, _around(s, 0, a + int(i), need, kind[1], "\x02")))
                t = template(s)
                for kind in (WORDS, CHARS):
                    for a, h, whole in _token_windows(t, kind):
                        rows += [(kind[0], h[i], None, None) for i in np.flatnonzero(whole & (np.arange(a, a + len(h)) % kind[2] == 0))]
                if rows:
                    k, h, need, letters = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array([item] * len(k), pa.int64()),
                            pa.array(need, pa.int32()), pa.array(letters, pa.string()), pa.array([len(t.code)] * len(k), pa.int32()),
                        ],
                        names=["kind", "hash", "item", "need", "letters", "tokens"],
                    )

    return run


def _partial_filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, most, kinds = np.zeros(1 << bits - 3, np.uint8), 0, 0
        for batch in batches:
            for probe in PROBES:
                at = _slot(bits, np.asarray(batch.column(1)).view(np.uint64), probe)
                np.bitwise_or.at(made, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            most = max([most, *batch.column(2).to_pylist()])
            kinds |= int(np.bitwise_or.reduce(1 << np.asarray(batch.column(0)).astype(np.int64), initial=0))
        yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()]), pa.array([most]), pa.array([kinds])], names=["made", "most", "kinds"])

    return run


def _grouped(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Texts in groups of bounded size; a longer text is a group of its own."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > CHARS_AT_ONCE:
            yield keys[at:i], texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield keys[at:], texts[at:]


def _scan(tables, filter_, kinds: tuple, reach: int):
    """Windows of the documents that the filter holds: of letters one row each, of tokens one row for those close together."""
    bits, made = filter_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(made.value, np.uint8)
        for batch in batches:
            for keys, texts in _grouped(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = stream(texts, tables.value)
                rows: list[tuple] = []
                for kind in kinds:
                    if kind[0] > 1:
                        continue
                    need = RUN if kind == LETTERS else RUN_DENSE
                    for a, h, whole in _letter_windows(s, kind):
                        hits = _held(held, bits, h)
                        hits = hits[whole[hits]]
                        of = np.searchsorted(s.bounds, hits + a, "right") - 1
                        for i, x in zip(hits.tolist(), of.tolist(), strict=True):
                            rows.append((keys[x], kind[0], int(h[i].view(np.int64)), _around(s, x, a + i, need, kind[1], "\x01"), None, None))
                t = template(s)
                for kind in kinds:
                    if kind[0] < 2:
                        continue
                    found = [(a + i, h[i]) for a, h, whole in _token_windows(t, kind) for i in _held(held, bits, h) if whole[i]]
                    rows += _clusters(s, t, keys, texts, kind, found, reach)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["doc", "kind", "hash", "letters", "hashes", "slice"]
                    )

    return run


def _clusters(s: Stream, t: Template, keys, texts, kind, found: list, reach: int) -> Iterator[tuple]:
    """Windows closer than ``reach`` tokens as one row, with the text as far as any item could reach around them."""
    i = 0
    while i < len(found):
        j = i + 1
        x = t.text[found[i][0]]
        while j < len(found) and t.text[found[j][0]] == x and found[j][0] - found[j - 1][0] <= reach:
            j += 1
        own = np.searchsorted(t.text, [x, x + 1])
        a, b = max(own[0], found[i][0] - reach), min(own[1], found[j - 1][0] + kind[1] + reach)
        first = s.source[t.start[a]] - s.origin[x] if a > own[0] else 0
        last = s.source[t.end[b - 1] - 1] + 1 - s.origin[x]
        yield keys[x], kind[0], None, None, [int(h.view(np.int64)) for _, h in found[i:j]], texts[x][first:last].encode("utf-8", "replace").decode()
        i = j


def _common_run(a: Stream, b: Stream, need: int) -> bool:
    """Whether the letters agree over a run of ``need``."""
    ours, theirs = (np.concatenate([h for _, h in window_hashes(x.chars, need, 0)] or [np.zeros(0, np.uint64)]) for x in (a, b))
    _, i, j = np.intersect1d(ours, theirs, return_indices=True)
    return any(np.array_equal(a.chars[p : p + need], b.chars[q : q + need]) for p, q in zip(i, j, strict=True))


def _slots(s: Stream, t: Template, first: int, n: int) -> list[str]:
    """Fillers of the slots of some template tokens; a name is all its words."""
    return [
        s.chars[t.start[k] : t.end[k]].tobytes().decode("utf-32-le") for k in range(first, first + n) if t.code[k] in (NAME, NUMBER, UNIT)
    ]


def _verdict(a: Stream, b: Stream) -> tuple[str, int, int, int] | None:
    """Kind, tokens, slots and changed slots of the longest common template run, or none if all are too short."""
    ta, tb = template(a), template(b)
    ours, theirs = (np.concatenate([h for _, h in window_hashes(t.code, WORDS[1], 0)] or [np.zeros(0, np.uint64)]) for t in (ta, tb))
    order = np.argsort(theirs, kind="stable")
    low, high = (np.searchsorted(theirs[order], ours, side) for side in ("left", "right"))
    n = high - low
    mine = np.repeat(np.arange(len(ours)), n)
    if not len(mine):
        return None
    other = order[np.repeat(low, n) + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)]
    by = np.lexsort((mine, mine - other))
    mine, other = mine[by], other[by]
    new = np.r_[True, (mine[1:] - other[1:] != mine[:-1] - other[:-1]) | (mine[1:] - mine[:-1] != 1)]
    at = np.flatnonzero(new)
    best = None
    for first, windows in zip(at, np.diff(np.r_[at, len(mine)]), strict=True):
        p, q, length = int(mine[first]), int(other[first]), int(windows) + WORDS[1] - 1
        if length < (TEMPLATE_CHARS if tb.dense[q : q + length].any() else TEMPLATE_WORDS):
            continue
        fillers, items = _slots(a, ta, p, length), _slots(b, tb, q, length)
        # a name at either end of the run may be longer on one side, by words outside the run
        if fillers and ta.code[p] == NAME and (fillers[0].endswith(items[0]) or items[0].endswith(fillers[0])):
            fillers[0] = items[0]
        if fillers and ta.code[p + length - 1] == NAME and (fillers[-1].startswith(items[-1]) or items[-1].startswith(fillers[-1])):
            fillers[-1] = items[-1]
        changed = sum(x != y for x, y in zip(fillers, items, strict=True))
        # one filler of the item stands for one of the document, and the other way round
        consistent = len(set(zip(items, fillers, strict=True))) == len(set(items)) == len(set(fillers))
        kind = "copied" if not changed else "reparameterised" if consistent else "same_template"
        if best is None or (length, -changed) > (best[1], -best[3]):
            best = (kind, length, len(fillers), changed)
    return best


def _judge(tables, letters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document's slice and item whether a passage is copied letter by letter, or the verdict on their templates."""
        for batch in batches:
            rows = []
            for doc, part, item, lang, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                a, b = stream([part], tables.value), stream([text], tables.value)
                copied = letters and _common_run(a, b, RUN_DENSE if lang in DENSE else RUN)
                got = None if letters else _verdict(a, b)
                if got or copied:
                    rows.append((doc, item, copied, *(got or (None, None, None, None))))
            if rows:
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                names = ["doc", "item", "passage", "kind", "tokens", "slots", "changed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _joined(docs: DataFrame, items: DataFrame, letters: bool) -> tuple[DataFrame, DataFrame] | None:
    """Pairs with a common window of letters (if asked for), and what is found of those with a common window of template tokens."""
    context = docs.sparkSession.sparkContext
    items = items.select("item", "lang", "text").filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    # a plain holder, as a broadcast value is unpickled without this package
    tables = context.broadcast(SimpleNamespace(**vars(char_tables())))
    windows = items.mapInArrow(_item_windows(tables), "kind int, hash long, item long, need int, letters string, tokens int")
    if not letters:
        windows = windows.filter(F.col("kind") > 1)
    windows = checkpoint(windows)
    n = windows.count()
    if not n:
        return None
    bits = min(MAX_BITS, max(20, (n * BITS_A_WINDOW).bit_length()))
    # at most 8 partial filters reach the driver
    parts = windows.select("kind", "hash", "tokens").coalesce(8).mapInArrow(_partial_filters(bits), "made binary, most long, kinds long").collect()
    made = np.bitwise_or.reduce([np.frombuffer(r["made"], np.uint8) for r in parts]).tobytes()
    present = np.bitwise_or.reduce([r["kinds"] for r in parts])
    kinds = tuple(k for k in (LETTERS, LETTERS_DENSE, WORDS, CHARS) if present >> k[0] & 1)
    filled = docs.select("doc", "text").filter("doc IS NOT NULL AND text IS NOT NULL")
    hits = filled.mapInArrow(_scan(tables, (bits, context.broadcast(made)), kinds, max(r["most"] for r in parts)), _HITS)
    # written once, as it is read three times; it has only what the filter let through
    hits = checkpoint(hits.withColumn("hit", F.monotonically_increasing_id()))
    theirs = windows.filter("letters IS NOT NULL").select("kind", "hash", "item", "need", F.col("letters").alias("of_item")).distinct()
    same = F.exists(
        F.sequence(F.lit(1), F.length("letters") - F.col("need") + 1),
        lambda i: F.substring(F.col("letters"), i, F.col("need")) == F.substring(F.col("of_item"), i, F.col("need")),
    )
    ours = hits.filter("letters IS NOT NULL").select("doc", "kind", "hash", "letters").distinct()
    exact = ours.join(theirs, ["kind", "hash"]).filter(same).select("doc", "item")
    tokens = hits.filter("hashes IS NOT NULL")
    marks = windows.filter("letters IS NULL").select("kind", "hash", "item").distinct()
    pairs = tokens.select("hit", "kind", F.explode("hashes").alias("hash")).join(marks, ["kind", "hash"]).select("hit", "item").distinct()
    judged = (
        pairs.join(tokens.select("hit", "doc", "slice"), "hit")
        .join(items, "item")
        .select("doc", "slice", "item", "lang", "text")
        .repartition(parallelism(docs.sparkSession))
        .mapInArrow(_judge(tables, letters), "doc long, item long, passage boolean, kind string, tokens int, slots int, changed int")
    )
    return exact, judged


def leaked_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc, item`` for each document that contains a passage of an item.

    ``docs`` has ``doc, text``, ``items`` has ``item, lang, text``. A passage is an
    unbroken common run of at least 60 letters and digits, or 24 for items in zh or ja,
    however the text around them is divided, punctuated or cased. Candidates come from
    joined template windows and are checked letter by letter. Null ids and texts and empty
    texts contain nothing; the same item text under several ids, or the same text under
    several documents, counts for each; repeated rows count once.
    """
    made = _joined(docs, items, True)
    if made is None:
        return docs.sparkSession.createDataFrame([], "doc long, item long")
    exact, judged = made
    return judged.filter("passage").select("doc", "item").unionByName(exact).distinct()


def leaked_templates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc, item, kind, tokens, slots, changed``: the longest common template of each pair.

    ``kind`` is "copied" if all slots hold the same, "reparameterised" if every filler of
    the item is replaced by the same filler throughout, else "same_template". The run has
    at least 16 tokens, or 32 with characters of scripts without spaces. Nulls as above.
    """
    made = _joined(docs, items, False)
    if made is None:
        return docs.sparkSession.createDataFrame([], "doc long, item long, kind string, tokens int, slots int, changed int")
    runs = made[1].filter("kind IS NOT NULL")
    best = runs.groupBy("doc", "item").agg(F.max(F.struct("tokens", -F.col("changed"), "kind", "slots", "changed")).alias("r"))
    return best.select("doc", "item", "r.kind", "r.tokens", "r.slots", "r.changed")
