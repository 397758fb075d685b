"""Canonical streams of texts: letters and digits only, cut into template tokens.

Texts are handled with NumPy, many at once. Every code point is replaced by the letters and
numbers of its compatibility decomposition, case folded; marks and invisible characters vanish,
and anything else separates words. A template token is a word, or one character in scripts
without spaces. Numbers, names and units become placeholders by rules that need no word list:
a name starts in upper case (or is in katakana), and a unit is the word behind a number.

The functions here run in workers; they take the tables of :func:`char_tables` as an argument,
so that nothing has to be installed or imported there.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

OTHER, LETTER, DIGIT, CHAR, KANA = range(5)
#: Codes of the placeholders; words have the hash of their letters.
NUMBER, NAME, UNIT = 1, 2, 3
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9
#: Code points above are unassigned, private, or marks.
PLANES = 0x33480
#: Windows hashed at once, and powers of the base at hand.
AT_ONCE = 1 << 18
#: Ranges of scripts written without spaces, and of katakana.
_CHAR_RANGES = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x309F),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, PLANES),
)
_KANA_RANGE = (0x30A0, 0x30FF)


@dataclass
class Tables:
    """Per code point: how many letters it gives, the first, where the others are, and its class."""

    count: np.ndarray
    first: np.ndarray
    more_at: np.ndarray
    more: np.ndarray
    kind: np.ndarray
    parts: np.ndarray  # separates words
    upper: np.ndarray


def char_tables() -> Tables:
    """The tables, made once a process."""
    if not _MADE:
        _MADE.append(_char_tables())
    return _MADE[0]


_MADE: list[Tables] = []


def _char_tables() -> Tables:
    n = PLANES + 1
    count, kind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    first, more_at = np.zeros(n, np.uint32), np.zeros(n, np.int32)
    parts, upper = np.ones(n, bool), np.zeros(n, bool)
    more: list[int] = []
    for c in range(PLANES):
        category = unicodedata.category(chr(c))
        if category in ("Cn", "Cs", "Co"):
            continue
        parts[c] = not (category[0] in "LNM" or category == "Cf")
        upper[c] = category in ("Lu", "Lt")
        kind[c] = {"L": LETTER, "N": DIGIT}.get(category[0], OTHER)
        letters = [ord(x) for x in unicodedata.normalize("NFKD", chr(c)).casefold() if unicodedata.category(x)[0] in "LN"]
        count[c] = len(letters)
        if letters:
            first[c] = letters[0]
        if len(letters) > 1:
            more_at[c] = len(more)
            more += letters
    for code, ranges in ((CHAR, _CHAR_RANGES), (KANA, (_KANA_RANGE,))):
        for a, b in ranges:
            span = kind[a : b + 1]
            span[span == LETTER] = code
    return Tables(count, first, more_at, np.array([*more, 0], np.uint32), kind, parts, upper)


@dataclass
class Stream:
    """Letters of several texts, one after the other."""

    chars: np.ndarray  # folded code points
    source: np.ndarray  # place of each in the joined texts
    bounds: np.ndarray  # first letter of each text, and the end
    origin: np.ndarray  # place of each text in the joined texts
    starts: np.ndarray  # whether a token starts here
    upper: np.ndarray
    kind: np.ndarray


def stream(texts: list[str], t: Tables) -> Stream:
    """The letters of some texts; a null text has none."""
    sizes = np.array([len(x or "") + 1 for x in texts], np.int64)
    origin = np.r_[0, np.cumsum(sizes)]
    chars, source, starts, upper, kind = [], [], [], [], []
    at, apart, last = 0, True, OTHER
    joined = "\n".join([*(x or "" for x in texts), ""])
    for a in range(0, len(joined), 4 * AT_ONCE):
        cp = np.frombuffer(joined[a : a + 4 * AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.minimum(cp, PLANES)
        n = t.count[cp]
        separators = np.cumsum(t.parts[cp])
        if n.max(initial=0) <= 1:
            of = np.flatnonzero(n)
            c = t.first[cp[of]]
        else:
            of = np.repeat(np.arange(len(cp)), n)
            within = np.arange(len(of)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
            own = cp[of]
            c = np.where(within == 0, t.first[own], t.more[np.minimum(t.more_at[own] + within, len(t.more) - 1)])
        if len(of):
            k, seen = t.kind[np.minimum(c, PLANES)], separators[of]
            new = np.r_[(seen[0] > 0) | apart | (k[0] != last), (seen[1:] != seen[:-1]) | (k[1:] != k[:-1])]
            chars.append(c)
            source.append(of + at)
            starts.append(new | (k == CHAR))
            upper.append(t.upper[cp[of]])
            kind.append(k)
            last = k[-1]
            apart = bool(separators[-1] > seen[-1])
        else:
            apart = apart or bool(len(cp) and separators[-1] > 0)
        at += len(cp)
    join = lambda parts, dtype: np.concatenate(parts) if parts else np.zeros(0, dtype)
    places = join(source, np.int64)
    return Stream(
        join(chars, np.uint32), places, np.searchsorted(places, origin), origin, join(starts, bool), join(upper, bool), join(kind, np.uint8)
    )


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def window_hashes(codes: np.ndarray, size: int, seed: int):
    """Pieces of first positions and hashes of all windows of ``size`` codes."""
    n = len(codes) - size + 1
    most = min(max(n, 0), AT_ONCE) + size
    forward, inverse = _powers(BASE, most), _powers(pow(BASE, -1, 2**64), most)
    for a in range(0, n, AT_ONCE):
        m = min(AT_ONCE, n - a)
        part = codes[a : a + m + size - 1].astype(np.uint64) + np.uint64(seed)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * forward[: len(part)], out=prefix[1:])
        h = (prefix[size:] - prefix[:m]) * inverse[:m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX)
        yield a, h ^ (h >> np.uint64(32))


@dataclass
class Template:
    """Template tokens of a stream; neighbouring names are one placeholder."""

    code: np.ndarray
    start: np.ndarray  # first letter of each
    end: np.ndarray  # behind its last letter
    text: np.ndarray  # number of its text
    dense: np.ndarray  # one character of a script without spaces


def template(s: Stream) -> Template:
    """Replaces numbers, names and units by typed placeholders."""
    first = np.flatnonzero(s.starts)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Template(np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool))
    text = np.searchsorted(s.bounds, first, "right") - 1
    end = np.r_[first[1:], len(s.chars)]
    within = np.arange(len(s.chars)) - np.repeat(first, end - first)
    within %= AT_ONCE
    weighted = (s.chars.astype(np.uint64) + np.uint64(1)) * _powers(BASE, int(within.max()) + 1)[within]
    code = np.add.reduceat(weighted, first)
    code ^= code >> np.uint64(31)
    code *= np.uint64(MIX)
    kind = s.kind[first]
    number = kind == DIGIT
    name = ((kind == LETTER) & s.upper[first]) | (kind == KANA)
    behind = np.r_[False, number[:-1] & (text[1:] == text[:-1])]
    unit = behind & ~name & ~number
    code[number], code[name], code[unit] = NUMBER, NAME, UNIT
    again = np.r_[False, name[1:] & name[:-1] & (text[1:] == text[:-1])]
    kept = np.flatnonzero(~again)
    # a placeholder of several names ends where its last name does
    ends = end[np.r_[kept[1:] - 1, len(end) - 1]]
    return Template(code[kept], first[kept], ends, text[kept], (kind[kept] == CHAR) | (kind[kept] == KANA))
