"""Personal data: plain patterns, and offset-preserving deobfuscation.

Plain spans come from the four base patterns.  Then transducers rewrite disguises: compatibility
and look-alike characters to ASCII, invisible characters to nothing, spelled digits to digits, and
"(at)", "[dot]", " at " and " dot " to @ and full stops.  Each rewritten piece keeps the source
offsets of what it replaced, the same patterns run on the result, and matches that touch a
rewritten piece are mapped back to source characters.  They are added to the plain ones where they
overlap no plain span, or cover more than all that they overlap ("jane dot doe@example.com" holds a plain address).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

KINDS = ("email", "ip", "card", "phone")

HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "α": "a", "ο": "o", "ν": "v", "ι": "i", "Ο": "O", "Α": "A", "Ε": "E", "‐": "-", "‑": "-", "–": "-", "−": "-", "․": ".", "。": ".", "。": ".", "﹫": "@", " ": " "}
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punkt", "point", "punto")


def _folding() -> dict[int, str | None]:
    """Character to its ASCII form: compatibility forms by rule (full-width, circled, mathematical), look-alikes by table."""
    blocks = ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EB), (0x2070, 0x208F), (0x24B6, 0x24EB))
    fold = {c: n for a, b in blocks for c in range(a, b) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
    return fold | {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): "" for c in INVISIBLE}


FOLD = _folding()
FOLDED = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(FOLD)) + "]")
_any = "|".join
BRACKETED = re.compile(rf"[ ]*[(\[{{<][ ]*(?:(?P<at>{_any(AT_WORDS)}|@)|(?P<dot>{_any(DOT_WORDS)}|\.))[ ]*[)\]}}>][ ]*", re.IGNORECASE)
_dot = rf" (?:{_any(DOT_WORDS)}) "
AT = re.compile(rf" (?:{_any(AT_WORDS)}|@)(?= )|@", re.IGNORECASE)
HOST_PART = re.compile(r"[A-Za-z0-9-]++")
DOT = re.compile(_dot, re.IGNORECASE)
STOP = re.compile(rf"\.|{_dot}", re.IGNORECASE)
DOT_LENGTHS = sorted({len(w) + 2 for w in DOT_WORDS})
DOTTED = re.compile(rf"(?<!\w)[0-9]{{1,3}}(?:(?:\.|{_dot})[0-9]{{1,3}}){{3}}(?!\w)", re.IGNORECASE)
_word = rf"(?:{_any(sorted(DIGIT_WORDS, key=len, reverse=True))})"
SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|más|mas)[ -]+)?(?:{_word}|[0-9]+)(?:(?:[ -]+(?:(?:{_any(DOT_WORDS)})[ -]+)?|[ ]?\.[ ]?)(?:{_word}|[0-9]+))+(?!\w)", re.IGNORECASE)
SPELLED_PART = re.compile(rf"(?P<plus>plus|más|mas)[ -]+|(?P<word>{_word})|(?P<digits>[0-9]+)|[ -]+(?:{_any(DOT_WORDS)})[ -]+(?P<dot>)|[ -]+(?P<gap>)|[ ]?\.[ ]?(?P<stop>)", re.IGNORECASE)
MIXED = re.compile(rf"[0-9][ -]{{1,3}}{_word}(?!\w)", re.IGNORECASE)
BRACKET = re.compile(r"[(\[{<]")
FOLDED_LATIN = [chr(c) for c in FOLD if 127 < c < 256]
BEYOND_LATIN = frozenset(chr(c) for c in FOLD if c > 255)
LETTERS = re.compile(r"[^\W\d_]+")


def shows_folded(text: str) -> bool:
    """Whether a character stands for an ASCII one; texts in Latin-1 can only hold a few such."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if not BEYOND_LATIN.isdisjoint(text):
            return True
    return any(c in text for c in FOLDED_LATIN)


def shows_spelled(text: str) -> bool:
    """Whether three digit words stand anywhere in the text, or one after a digit; the parts of a spelled number are whole words, so none is passed over."""
    return sum(map(DIGIT_WORDS.__contains__, LETTERS.findall(text.casefold()))) >= 3 or MIXED.search(text) is not None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ to the left and right."""
    done = 0
    for m in HOST.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the plain patterns, sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(found)


class Rewritten:
    """A text under rewriting; knows the source span of every character."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        # breakpoints: out position, source start, source end, output length; between them text is as it was
        self.edits: list[tuple[int, int, int, int]] = []

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace spans of the present text; edits are sorted and don't overlap."""
        if not edits:
            return self
        out, pieces, at, shift = Rewritten(""), [], 0, 0
        olds = list(self.edits)
        marks: list[tuple[int, int, int, int]] = []
        spans = []
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            spans.append((a, b, a + shift, len(new)))
            shift += len(new) - (b - a)
            at = b
        pieces.append(self.text[at:])
        out.text, out.n = "".join(pieces), self.n
        starts = [s[0] for s in spans]
        for pos, sa, sb, length in olds:  # earlier edits that no new one swallows move along
            i = bisect_right(starts, pos) - 1
            if i >= 0 and pos < max(spans[i][1], spans[i][0] + 1) and pos + length <= spans[i][1]:
                continue
            moved = (spans[i][2] + spans[i][3] + (pos - spans[i][1])) if i >= 0 else pos
            marks.append((moved, sa, sb, length))
        for a, b, pos, length in spans:
            sa, sb = self.source(a, b)
            marks.append((pos, sa, sb, length))
        out.edits = sorted(marks)
        return out

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of [a, b) of the present text."""
        return self._left(a), self._right(b)

    def _left(self, a: int) -> int:
        i = bisect_right(self.edits, (a, self.n + 1, self.n + 1, self.n + 1)) - 1
        while i >= 0 and self.edits[i][3] == 0 and self.edits[i][0] == a:  # nothing stands here: what follows does
            return self.edits[i][2]
        if i < 0:
            return a
        pos, sa, sb, length = self.edits[i]
        return sa if a < pos + length else sb + (a - pos - length)

    def _right(self, b: int) -> int:
        i = bisect_right(self.edits, (b - 1, self.n + 1, self.n + 1, self.n + 1)) - 1
        if i < 0:
            return b
        pos, _, sb, length = self.edits[i]
        return sb if b <= pos + length else sb + (b - pos - length)

    def touched(self, a: int, b: int) -> bool:
        """Whether an edit lies in [a, b) of the present text; edits are sorted and don't overlap."""
        i = bisect_right(self.edits, (a, self.n + 1, self.n + 1, self.n + 1))
        if i < len(self.edits) and self.edits[i][0] < b:
            return True
        while i and self.edits[i - 1][0] == a and self.edits[i - 1][3] == 0:
            i -= 1
        return i > 0 and a < self.edits[i - 1][0] + self.edits[i - 1][3]


def deobfuscate(text: str) -> Rewritten | None:
    """The text with its disguises undone; None if it shows none."""
    folded = shows_folded(text)
    out = Rewritten(text)
    if folded:
        out = out.apply([(m.start(), m.end(), FOLD[ord(m.group())]) for m in FOLDED.finditer(text)])
    if BRACKET.search(out.text):
        out = out.apply([(m.start(), m.end(), "@" if m["at"] else ".") for m in BRACKETED.finditer(out.text)])
    low = out.text.lower()
    ats = ("@", *AT_WORDS) if out.edits else ("@",)  # at words count beside a dot word or an edit only
    if any(f" {w} " in low for w in (*DOT_WORDS, *ats)):
        out = out.apply(_worded(out))
    if any(f" {w} " in low for w in DOT_WORDS):
        out = out.apply([(m.start() + d.start(), m.start() + d.end(), ".") for m in DOTTED.finditer(out.text) for d in DOT.finditer(m.group())])
    if shows_spelled(out.text):
        out = out.apply(_spelled(out.text))
    return out if out.edits else None


def _host(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The stops of a host name from ``at`` on, as full stops or words, and its end."""
    stops: list[tuple[int, int]] = []
    part, end = HOST_PART.match(text, at), at
    while part:
        end = part.end()
        stop = STOP.match(text, end)
        part = HOST_PART.match(text, stop.end()) if stop else None
        if part:
            stops.append(stop.span())
    return stops, end


def _local(text: str, at: int, least: int) -> tuple[list[tuple[int, int]], bool]:
    """The dot words of a name that ends at ``at``, not further left than ``least``, and whether there is a name."""
    dots: list[tuple[int, int]] = []
    end, named = at, False
    while True:
        start = end
        while start > least and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start == end or (start and text[start - 1] in LOCAL_CHARS):  # none, or what stands before it is told already
            return (dots[:-1] if named else []), named
        named = True
        before = next((start - n for n in DOT_LENGTHS if start - n > least and DOT.fullmatch(text, start - n, start)), None)
        if before is None:
            return dots, True
        dots.append((before, start))
        end = before


def _worded(out: Rewritten) -> list[tuple[int, int, str]]:
    """The rewritings of addresses told in words, found from each @ or at word to the right and, past the last address, to the left.

    " at " before a plain host name ("meet at example.com") is ordinary prose; a dot word or a dot from brackets shows a disguise.
    """
    text, edits, done = out.text, [], 0
    for m in AT.finditer(text):
        a, word = m.start(), m.group() != "@"
        if a < done:
            continue
        b = m.end() + word
        stops, end = _host(text, b)
        if not stops:
            continue
        dots, named = _local(text, a, done)
        if not named:
            continue
        done = end
        if word and m.group() != " @" and not any(text[i] == " " or out.touched(i, j) for i, j in stops):
            continue
        edits += [(i, j, ".") for i, j in reversed(dots)] + [(a, b, "@")] * word + [(i, j, ".") for i, j in stops if text[i] == " "]
    return edits


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """The rewritings of runs with three digit words or more, and of runs of 12 digits or more with a word between digits."""
    edits = []
    for m in SPELLED.finditer(text):
        parts = list(SPELLED_PART.finditer(m.group()))
        words, digits = sum(p["word"] is not None for p in parts), sum(len(p["digits"] or "") for p in parts)
        ends = [p for p in parts if p["word"] or p["digits"]]
        if words < 3 and not (words and words + digits >= 12 and ends[0]["digits"] and ends[-1]["digits"]):
            continue
        for p in parts:
            a, b = m.start() + p.start(), m.start() + p.end()
            if p["plus"]:
                edits.append((a, b, "+"))
            elif p["word"]:
                edits.append((a, b, DIGIT_WORDS[p["word"].casefold()]))
            elif p["dot"] is not None:
                edits.append((a, b, "."))
            elif p["gap"] is not None:
                edits.append((a, b, ""))
    return edits


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the deobfuscated text shows, in source offsets; none overlaps one added before, or a plain span that it doesn't cover.

    A span that a plain one equals or covers tells nothing new and is left out.
    """
    clear = deobfuscate(text)
    if clear is None:
        return []
    starts = [a for a, _, _ in base]
    plain = {(a, b) for a, _, b in base}
    ends = [0, *accumulate((b for _, _, b in base), max)]  # the furthest end of those before
    found, last = [], 0
    for a, kind, b in base_spans(clear.text):
        if clear.touched(a, b):
            sa, sb = clear.source(a, b)
            apart = ends[bisect_left(starts, sa)] <= sa and ends[bisect_left(starts, sb)] <= sb
            if sa >= last and apart and (sa, sb) not in plain:
                found.append((sa, kind, sb))
                last = sb
    return found


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(text: Column) -> Column:
    """Struct of the base counts, the base spans' digest, all spans and the number of added ones; null texts are empty."""

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                base = base_spans(t or "")
                more = added_spans(t or "", base)
                n = [0, 0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(sorted([*base, *more])), len(more)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return find(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """A row for each input row; spans in code points of its text, end exclusive.

    A null text is empty and has no spans; null ids and repeated rows stay, no rows give no rows.
    """
    return texts(docs).withColumn("found", personal_data(F.col("text"))).select("doc_id", "found.*")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
