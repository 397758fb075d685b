"""Sentence boundaries across languages and scripts, in SQL expressions.

Marks that don't end a sentence (in decimals, file names, initials, abbreviations,
ordinals, and inside quotations and brackets) are masked by private-use characters,
one for one, so places in the text stay the same. The masked text is cut by the
terminators of each script, and each piece is restored by its place in the text.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private-use placeholders. BLANK is a blank line, DOT a mark and INNER a blank that ends nothing, CUT the end of a sentence.
BLANK, DOT, INNER, CUT = "\ue001", "\ue002", "\ue003", "\ue016"
#: Opening and end of a closed quotation and of a closed bracket; marks without partner stay as they are.
QUOTE, Q_END = "\ue010", "\ue013"
BRACKET, B_END = "\ue011", "\ue012"
_B_OPEN, _B_SHUT = r"(（\[【", r")）\]】"
_OPEN, _SHUT = QUOTE + BRACKET + _B_OPEN, Q_END + B_END + _B_SHUT
_END = ".!?…。！？।؟｡"
#: Turns letters and blanks away before a list of marks is tried, as most characters are these.
_NO_LETTER = r"(?![a-z ])(?!\p{L})"
_SPACE = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HIDDEN = r"[\u00ad\u200b-\u200d\u2060\ufeff]*"
_TRIM = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" + BLANK + INNER

#: Abbreviations that never end a sentence.
ABBREVIATIONS = (
    "Mr Mrs Ms Dr Prof Col Lt Sgt Capt Gen Gov Sen Rep Rev Hon Maj Cpl Cmdr St Mt Messrs vs cf Cf Prod Fig fig Figs figs Vol vol Vols "
    "vols ch Ch chs pp approx Approx incl i\\.e e\\.g viz "
    "Sr Sra Srta Sres Dra Dña D Ud Uds vol pág págs Pág núm Núm cap Cap art "
    "Mme Mlle MM Me chap Chap env éd "
    "Hr Hrn Frl Vgl vgl Nr nr Bd Bde Str Abb Tel ca Ca bzw Mio Mrd Tsd z\\.\\s{0,3}B u\\.\\s{0,3}a d\\.\\s{0,3}h o\\.\\s{0,3}ä i\\.\\s?d\\.\\s?R "
    "т\\.\\s{0,3}е См см стр гл рис проф акад им ул пл "
    "डॉ प्रो श्री पृ सं रु क्र ดร ศ รศ ผศ นพ พญ น\\.ส"
).split()
#: Abbreviations that end a sentence unless it goes on in lower case.
LAST_WORDS = (
    "etc Inc Ltd Co Corp Bros Jr Esq [ap]\\.\\s{0,3}m U\\.S U\\.K U\\.N E\\.U D\\.C usw usf aprox EE\\.\\s?UU a\\.\\s?C d\\.\\s?C "
    "т\\.\\s{0,3}[дпк] др руб коп млн млрд тыс"
).split()
#: Words without vowels that may end a sentence.
NO_VOWELS = "Jr Ltd Hmm Shh Brr Psst Pfft Tsk".split()
#: German words before an ordinal, and months.
BEFORE_ORDINAL = "Die Der Das Dem Den Des Am Im Vom Zum Zur Beim die der das dem den des am im vom zum zur beim ab seit".split()
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()

#: Closed quotations. The classes are possessive and exclude their own marks, so each is found in one pass, however long.
_MARKS = (
    rf"{_NO_LETTER}(?=[“„«「『\"'‘\u2014])(?:„([^„“”{BLANK}]*+)[“”]|“([^“”„{BLANK}]*+)”|«([^«»{BLANK}]*+)»"
    rf"|「([^「」{BLANK}]*+)」|『([^『』{BLANK}]*+)』|\"([^\"{BLANK}]*+)\""
    rf"|(?<![\p{{L}}\p{{N}}])'([^'\ue017{BLANK}]*+(?:'(?=[\p{{L}}\p{{N}}])[^'\ue017{BLANK}]*+)*+)['\ue017](?![\p{{L}}\p{{N}}])"
    rf"|‘([^‘’{BLANK}]*+(?:’(?=\p{{L}})[^‘’{BLANK}]*+)*+)’(?!\p{{L}})"
    # speech after a dash, up to the dash before its speaker; the blank there stands for the closing mark
    rf"|\u2014([^\u2014{BLANK}]+)[{_SPACE}](?=\u2014\p{{Ll}}))"
)
#: In long texts the last possible end of a quotation in straight single marks is marked in each paragraph, and all such
#: marks behind it are set aside, so that no search for an end runs in vain. Both are put back.
_LONG, _LAST_END, _ASIDE = 10_000, "\ue017", "\ue018"
_FINAL = rf"'(?![\p{{L}}\p{{N}}])(?=[^'{BLANK}]*+(?:'(?=[\p{{L}}\p{{N}}])[^'{BLANK}]*+)*+(?:{BLANK}|\z))"
_VAIN = rf"((?:\G(?!^)|{_LAST_END}|(?:^|{BLANK})(?![^{_LAST_END}{BLANK}]*+{_LAST_END}))[^'{BLANK}{_LAST_END}]*+)'"
#: Brackets in brackets are followed so deep; deeper ones count as text.
_DEPTH = 5


def _bracket_pattern() -> str:
    """A closed bracket with those inside it. What has no partner is given up at the next brackets, so scans stay short."""
    plain = rf"[^{_B_OPEN}{_B_SHUT}{BLANK}]++"
    inside = rf"(?:{plain})?+"
    for _ in range(_DEPTH):
        inside = rf"(?:{plain}|[{_B_OPEN}]{inside}[{_B_SHUT}])*+"
    return rf"[{_B_OPEN}]({inside})[{_B_SHUT}]"


#: Marks inside addresses: behind a scheme, www. or @, and before @. A mark that only blanks or other marks follow is none.
_IN_ADDRESS = (
    r"((?:\G(?!^)|(?<![\p{L}\p{N}])(?:[A-Za-z][A-Za-z0-9+-]*+://|www(?=\.))|(?<=[A-Za-z0-9_%+-])@(?=[A-Za-z0-9]))"
    r"[A-Za-z0-9_~:/#@$&*+,;=%()-]*+)[.!?](?=[.!?,;:]*+[A-Za-z0-9_~/#@$&*+=%-])"
    r"|\.(?=[A-Za-z0-9_.%+-]{0,64}+@[A-Za-z0-9])"
)
_NOT_LETTER = r"(?<![\p{L}\p{N}\p{M}])"
_SINGLE = rf"(?<={_NOT_LETTER}(?<!\.)\p{{L}}\p{{M}}{{0,2}}\.)(?<!(?:[ap]\.\s{{1,3}}|т\.\s{{1,3}}|\d\s{{1,3}}|\d)[mдпкг]\.)"
#: Marks outside quotations that end nothing.
_MASKED = (
    rf"[.…!?](?:(?<=[\p{{L}}\p{{N}}_)].)(?=[\p{{Ll}}\p{{N}}_])"  # decimals, codes, file names, addresses
    rf"|(?<=\.\.)(?=\s{{0,3}}[\p{{Ll}}\p{{Lo}}])|(?<=\.)(?=\.{{1,5}}\s{{0,3}}[\p{{Ll}}\p{{Lo}}])|(?<=…)(?=…{{0,5}}\s{{0,3}}[\p{{Ll}}\p{{Lo}}])"  # an ellipsis that goes on
    rf"|(?<!\p{{L}}{{8}}.)(?:(?<={_NOT_LETTER}(?:{'|'.join(ABBREVIATIONS)})\.)"
    rf"|(?<={_NOT_LETTER}(?:{'|'.join(LAST_WORDS)})\.)(?=[{_SPACE}]{{1,4}}\p{{Ll}})"
    rf"|(?<=\d[{_SPACE}]{{0,3}}гг?\.)(?=[{_SPACE}]{{1,4}}\p{{Ll}})"
    rf"|(?<={_NOT_LETTER}(?:No|Nos|no|p|t|S|с|ص)\.)(?=[{_SPACE}]{{0,3}}\p{{N}})"
    rf"|{_SINGLE}(?=[{_SPACE}]{{0,4}}[\p{{L}}\p{{N}}])"  # initials
    rf"|(?<=\.\p{{Lu}}\.)(?=\p{{Lu}}\.)"
    rf"|(?<={_NOT_LETTER}\p{{Lu}}\p{{Ll}}\.)(?=\p{{Lu}}\p{{Ll}}{{0,2}}\.)"  # degrees
    rf"|(?<={_NOT_LETTER}[B-DF-HJ-NP-TV-XZ][b-df-hj-np-tv-xz]{{1,4}}\.)(?<!{_NOT_LETTER}(?:{'|'.join(NO_VOWELS)})\.)(?=[{_SPACE}]{{1,4}}\p{{Lu}})"  # shortened titles
    rf"|(?<={_NOT_LETTER}(?:{'|'.join(BEFORE_ORDINAL)})[{_SPACE}]{{1,3}}\d{{1,2}}\.)(?=[{_SPACE}]{{1,3}}\p{{Lu}})"
    rf"|(?<=\d\.)(?=[{_SPACE}]{{1,3}}(?:{'|'.join(MONTHS)})(?!\p{{L}}))))"
)
_SPEAKER = rf"(?:^|[\n{BLANK}])[QA]:"
_START = rf"(?<=(?:^|[{BLANK}]|[{_END}]{_HIDDEN.replace('*', '{0,3}')}(?:[{_SPACE}]?[{_SHUT}])?|\n-|{_SPEAKER})[{_SPACE}]{{0,4}}.)"
_SAID = rf"(?<=[:：,，、،؛;][{_SPACE}]{{0,3}}.)(?<!{_SPEAKER}[{_SPACE}]{{0,3}}.)"
_CLOSERS = r"[\"'”’»」』]*"
_WITH_LAST = rf"(?<=[{_END}][{_SPACE}]{{0,1}}.){_HIDDEN}"
_GOES_ON = rf"(?![{_SPACE}]*[\p{{Ll}},;:،，、。.!?—–-])"
#: A quotation or bracket whose last mark ends the sentence too. One at the start of a sentence
#: is ended by its speaker, unless another follows.
_CLOSING = (
    rf"{_NO_LETTER}(?:{BRACKET}{_START}[^{BRACKET}{B_END}]*+{B_END}{_WITH_LAST}{_GOES_ON}"
    rf"|{QUOTE}(?:{_SAID}[^{QUOTE}{Q_END}]*{Q_END}{_WITH_LAST}{_GOES_ON}"
    rf"|{_START}[^{QUOTE}{Q_END}]*{Q_END}{_WITH_LAST}(?=[{_SPACE}]*[{_OPEN}])"
    rf"|(?!{_START})[^{QUOTE}{Q_END}]*{Q_END}{_WITH_LAST}(?=[{_SPACE}]+[\p{{Lu}}¿¡{_OPEN}])))"
)
_CUTS = (
    rf"{_NO_LETTER}(?=[{_END}{BLANK}\n])(?:"
    rf"[.!?…]+{_CLOSERS}{_HIDDEN}(?=[{_SPACE}{BLANK}]|$)(?![{_SPACE}]?[{_SHUT}])"
    rf"|[.!?…]*[。！？।؟｡][{_END}]*{_CLOSERS}{_HIDDEN}(?![{_SPACE}]?[{_SHUT}])"
    rf"|[.!?…]+(?=[\p{{Lu}}\p{{Lt}}¿¡{_OPEN}])"
    rf"|(?<=\p{{IsArabic}}{{2}})\.(?=[\p{{IsArabic}}])"
    rf"|[!?]+(?=\p{{Lo}})"
    rf"|(?={BLANK})|(?=\n- ))"
)
#: A blank of Thai text, which has no end marks; those in quotations and brackets are INNER.
_THAI_CUTS = (
    rf"(?<=[\u0e01-\u0e45\u0e47-\u0e4e{B_END}{_B_SHUT}])[{_SPACE}]+(?=[^{_SPACE}{BLANK}\p{{IsLatin}}\p{{N}}\u0e46])"
    rf"|(?<=[^{_SPACE}{BLANK}\p{{IsLatin}}\p{{N}}\u0e46{DOT}:{CUT}{Q_END}”’»\"'-])[{_SPACE}]+(?=[\u0e01-\u0e45])"
)


def _within(opening: str, end: str, what: str, last: str = "") -> str:
    """From an opening, or from the sign found before, to the next sign of ``what`` inside."""
    return rf"((?:\G(?!^)|{opening})[^{opening}{end}{BLANK}{what}]*+)[{what}]{last}"


def _has_thai(text: Column) -> Column:
    """Looks for the first two bytes that all Thai letters have in UTF-8, which is faster than a pattern."""
    data = text.cast("binary")
    return F.contains(data, F.lit(b"\xe0\xb8")) | F.contains(data, F.lit(b"\xe0\xb9"))


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def masked(text: Column) -> Column:
    """The text with placeholders, of equal length, and CUT behind each sentence."""
    sub = lambda c, pattern, by: F.regexp_replace(c, F.lit(pattern), F.lit(by))
    # the first two bytes that all placeholders have in UTF-8
    own = F.contains(text.cast("binary"), F.lit(b"\xee\x80"))
    s = F.when(own, sub(text, r"[\ue000-\ue03f]", "\ufffd")).otherwise(text)
    address = text.contains("://") | text.contains("@") | text.contains("www.")
    s = _let(s, lambda x: F.when(address, sub(x, _IN_ADDRESS, f"$1{DOT}")).otherwise(x))
    s = sub(s, rf"\n(?=[{_SPACE.replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'x0b' + chr(92) + 'f')}]*\n)", BLANK)
    quoted = lambda x: sub(x, _MARKS, f"{QUOTE}$1$2$3$4$5$6$7$8$9{Q_END}")
    spared = lambda x: sub(sub(x, _FINAL, _LAST_END), _VAIN, f"$1{_ASIDE}")
    long = (F.length(text) > _LONG) & text.contains("'")
    s = _let(s, lambda x: F.when(long, F.translate(quoted(spared(x)), _LAST_END + _ASIDE, "''")).otherwise(quoted(x)))
    s = sub(s, _bracket_pattern(), f"{BRACKET}$1{B_END}")
    for opening, end in ((QUOTE, Q_END), (BRACKET, B_END)):
        s = sub(s, _within(opening, end, _END, rf"(?![{_END}]{{0,5}}[{_SPACE}]?{end})"), f"$1{DOT}")
    s = sub(s, _MASKED, DOT)
    s = sub(s, _CLOSING, f"$0{CUT}")

    def thai(x: Column) -> Column:
        for opening, end in ((QUOTE, Q_END), (BRACKET, B_END)):
            x = sub(x, _within(opening, end, _SPACE), f"$1{INNER}")
        return sub(x, _THAI_CUTS, f"$0{CUT}")

    s = _let(s, lambda x: F.when(_has_thai(text), thai(x)).otherwise(x))
    return sub(s, _CUTS, f"$0{CUT}")


#: Pieces up to which an array of running sums is built by appending.
_FEW = 500


def sentence_spans(pieces: Column) -> Column:
    """Array of ``start, end`` in code points, end exclusive, without surrounding blanks; blank pieces have no length.

    ``pieces`` are those of a :func:`masked` text, as a column of their own, as they are
    read more than once.
    """
    starts = F.when(F.size(pieces) <= _FEW, _appended(pieces)).otherwise(_summed(pieces))
    return F.zip_with(pieces, starts, _trimmed)


def _trimmed(p: Column, at: Column) -> Column:
    begin = at + F.length(p) - F.length(F.ltrim(p, F.lit(_TRIM)))
    # few pieces end in blanks, and looking for them takes longer than the last character
    blank_end = F.instr(F.lit(_TRIM), F.substring(p, -1, 1)) > 0
    kept = F.when(blank_end, F.length(F.rtrim(p, F.lit(_TRIM)))).otherwise(F.length(p))
    return F.struct(begin.alias("start"), (at + kept).alias("end"))


def _appended(pieces: Column) -> Column:
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
    step = lambda acc, p: F.struct((acc["s"] + F.length(p)).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a"))
    return F.aggregate(pieces, start, step, lambda acc: acc["a"])


def _summed(pieces: Column) -> Column:
    """Running sums in blocks, so that very long texts take no square time."""
    step = 256
    total = lambda a, start, length: F.aggregate(F.slice(a, start, length), F.lit(0), lambda x, y: x + y)
    blocks = lambda n: F.sequence(F.lit(0), F.floor((F.size(n) - 1) / step).cast("int"))
    sizes = F.transform(F.array(F.transform(pieces, lambda p: F.length(p))), lambda n: F.struct(n.alias("n")))
    summed = F.transform(sizes, lambda r: F.struct(r["n"].alias("n"), F.transform(blocks(r["n"]), lambda b: total(r["n"], b * step + 1, F.lit(step))).alias("b")))
    ahead = F.transform(summed, lambda r: F.struct(r["n"].alias("n"), F.transform(r["b"], lambda _, i: total(r["b"], F.lit(1), i)).alias("a")))

    def place(r: Column, i: Column) -> Column:
        block = F.floor(i / step).cast("int")
        return F.element_at(r["a"], block + 1) + total(r["n"], block * step + 1, i - block * step)

    return F.transform(ahead, lambda r: F.transform(r["n"], lambda _, i: place(r, i)))[0]


def _pieces(docs: DataFrame, *kept: str) -> DataFrame:
    filled = docs.filter(F.col("text").isNotNull())
    return filled.select(*kept, F.split(masked(F.col("text")), CUT).alias("_pieces"))


def sentences(docs: DataFrame) -> DataFrame:
    """``doc, sent_start, sent_end`` of the sentences of ``docs`` (``doc, text``).

    Each row of ``docs`` is taken for itself, so null or repeated ids do no harm. Null
    and blank texts have no sentences. Private-use characters of the text that serve
    as placeholders here are read as unknown characters.
    """
    spans = _pieces(docs, "doc").select("doc", F.inline(sentence_spans(F.col("_pieces")))).filter("start < end")
    return spans.withColumnsRenamed({"start": "sent_start", "end": "sent_end"})


def sentence_texts(docs: DataFrame) -> DataFrame:
    """As :func:`sentences`, with the restored text of each as ``sentence``."""
    spans = _pieces(docs, "doc", "text").select("doc", "text", F.inline(sentence_spans(F.col("_pieces")))).filter("start < end")
    return spans.select(
        "doc", F.col("start").alias("sent_start"), F.col("end").alias("sent_end"),
        F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("sentence"),
    )


def coverage(docs: DataFrame) -> DataFrame:
    """``doc, n_filled, n_overlaps`` of each text with sentences: characters that aren't blank in them, and sentences that begin too early."""
    spans = _pieces(docs, "doc", "text").select("doc", "text", sentence_spans(F.col("_pieces")).alias("_s"))
    spans = spans.select("doc", "text", F.filter("_s", lambda x: x["start"] < x["end"]).alias("_s")).filter(F.size("_s") > 0)
    filled = lambda x: F.length(F.regexp_replace(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]), rf"[{_SPACE}\x1c-\x1f]", ""))
    early = F.zip_with(F.slice("_s", 2, F.size("_s")), F.slice("_s", 1, F.size("_s") - 1), lambda x, y: (x["start"] < y["end"]).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    return spans.select("doc", total(F.transform("_s", filled)).alias("n_filled"), total(early).alias("n_overlaps"))
