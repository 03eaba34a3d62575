"""Bands that prose states, read text by text inside tasks.

A text is cut into sentences and each sentence is read once; sentences that come again (formulaic prose is full of them) are looked up.
The patterns are read as the column expressions of `textjobs` read them: ``\\d``, ``\\s`` and case by ASCII, ``\\b`` by all letters and digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa

# Abbreviations whose full stop ends no sentence
ABBREVIATIONS = r"\b(?:Figs?|Tabs?|al|ca|cf|e\.g|i\.e|vs|approx|Nos?|Eqs?|Refs?|resp|et|sp|var|incl|min|max)\."
_SHAPE = r"(?:\s?\((?:sh|vs|s|m|w|vw|br|b)\))?"
# a first digit, none before it: patterns that start with a plain character are sought fast
_WHOLE = r"\d(?<!\d\d)(?<!\d\.\d)\d+(?:\.\d+)?"
_NUMBER = _WHOLE + _SHAPE
_RUN = rf"((?:{_NUMBER}(?:\s*,\s*(?:and\s+)?|\s+and\s+|\s*;\s*))*{_NUMBER})\s*cm-1"
# Words that deny a band, before it and after it, in its own clause
NEGATION = r"(?i)\b(?:no|without|lack(?:s|ing)?|absence of)\b"
NEGATED_AFTER = r"(?i)\b(?:not (?:observed|present|detected|seen|found|visible|recorded)|absent|missing)\b"
# where a clause ends: a semicolon, a turning word, or another band, unless that is joined to this one in a list
_TURN = r";|\b(?:but|whereas|while|however|although|though|yet)\b"
_BEFORE_CLAUSE = rf"(?is)^.*(?:{_TURN}|cm-1(?!\s*(?:,|or|nor|and)+\s*(?:at|near|around|about)?\s*$))"
_AFTER_CLAUSE = rf"(?is)^(.*?)(?:{_TURN}|\d\s*cm-1|$)"
FAMILIES = ("UO2", "SO4", "PO4", "AsO4", "VO4", "SiO4", "CO3", "NO3", "MoO4", "WO4", "CrO4", "SeO4", "SeO3", "TeO3", "NH4", "H2O", "OH", "uranyl", "sulfate", "phosphate", "arsenate", "carbonate", "silicate", "water", "hydroxyl")
_SYNONYM = {"uranyl": "UO2", "sulfate": "SO4", "phosphate": "PO4", "arsenate": "AsO4", "carbonate": "CO3", "silicate": "SiO4", "water": "H2O", "hydroxyl": "OH"}
_FAMILY = "|".join(sorted(FAMILIES, key=len, reverse=True))
_MODE = "|".join([r"ν[1-4]", "δ", *(f"{first}(?i:{word[1:]})" for word in ("bend", "deform", "scissor", "stretch", "librat") for first in (word[0], word[0].upper()))])
_SPACE = " \t\n\x0b\f\r"


# a letter, digit or underscore; raised and lowered digits are marks beside a word
_LETTER = r"[^\W¹²³⁰⁴-⁹₀-₉¼-¾]"


def _read(pattern: str) -> re.Pattern:
    starts = re.sub(r"\\b(?=[(A-Za-z])", lambda _: f"(?u:(?<!{_LETTER}))", pattern)
    return re.compile(starts.replace(r"\b", f"(?u:(?!{_LETTER}))"), re.ASCII)


_UNIT = _read(r"cm(?:\s*-\s*1\b|⁻¹)")
_DASHES = str.maketrans("−–—‐‑υ", "-----ν")
_BLANKS = re.compile(r"[ \t]{2,}|\t")
# what a sentence ends in where an abbreviation may stand
_SHORT = tuple(f"{word}.{close}" for word in "Fig Figs Tab Tabs al ca cf e.g i.e vs approx No Nos Eq Eqs Ref Refs resp et sp var incl min max".split() for close in ("", ")"))
_CUT, _ABBREVIATED = _read(r"[.!?]\)?(\s+)(?=[A-ZÀ-Þ(\[ν~∼])"), _read(rf"{ABBREVIATIONS}\)?\Z")
_RAMAN, _INFRARED = _read(r"\bRaman\b"), _read(r"\b(?:[Ii]nfrared|IR|FTIR|FT-IR)\b")
_FAMILIES, _MODES, _RUNS, _NUMBERS, _WHOLES, _SHAPES = _read(_FAMILY), _read(_MODE), _read(_RUN), _read(_NUMBER), _read(_WHOLE), _read(r"\((\w+)\)")
_NO, _NOT_SEEN, _NOT_SEEN_AFTER = _read(NEGATION), _read(NEGATED_AFTER), _read(_AFTER_CLAUSE)
_CLAUSES = _read(_BEFORE_CLAUSE)
# a sentence without one of these denies nothing
_MAYBE_NO, _MAYBE_NOT_SEEN = ("no", "without", "lack", "absence of"), ("not ", "absent", "missing")
_TWO, _BETWEEN, _FROM = _read(r"^\d+(?:\.\d+)?\s+and\s+\d+(?:\.\d+)?$"), _read(r"(?i)between\s*$"), _read(r"\d\s*(?:-|to)\s*$")
_OTHERS = ("et al.", "reported by", "according to", "literature")


def normal(text: str | None) -> str:
    """`textjobs.normalise_text` of one text."""
    text = text or ""
    if any(c in text for c in "−–—‐‑υ"):
        text = text.translate(_DASHES)
    parts = _UNIT.split(text) if "cm" in text else [text]
    if len(parts) > 1:
        text = " cm-1".join([*(part.rstrip(_SPACE) for part in parts[:-1]), parts[-1]])
    return _BLANKS.sub(" ", text) if "  " in text or "\t" in text else text


def sentences(text: str) -> list[str]:
    """`textjobs.sentences_of` of one text."""
    out, start = [], 0
    for cut in _CUT.finditer(text):
        at, end = cut.span(1)
        if not (text.endswith(_SHORT, 0, at) and _ABBREVIATED.search(text, max(0, at - 12), at)):
            out.append(text[start:at])
            start = end
    out.append(text[start:])
    return [s for s in out if s.strip(" ")]


def _nearest(found: list[tuple[int, str]], start: int, end: int) -> str | None:
    """The match with the smallest gap to the stretch from `start` to before `end`; the earlier of two, None of none."""
    best, least = None, None
    for at, m in found:
        gap = at - end if at >= end else max(start - at - len(m), 0)
        if least is None or gap < least:
            best, least = m, gap
    return best


def _mode_name(said: str | None) -> str | None:
    if said is None or said[0] == "ν":
        return said
    low = said.lower()
    return "stretch" if low.startswith("stre") else "lib" if low.startswith("libr") else "bend"


def _any(words: tuple[str, ...], low: str) -> bool:
    return any(word in low for word in words)


def _denied(ahead: str, behind: str, low: str) -> bool:
    """Is a run denied by a word of its own clause? `low` is the sentence in small letters."""
    if _any(_MAYBE_NO, low) and _NO.search(_CLAUSES.sub("", ahead)):
        return True
    return _any(_MAYBE_NOT_SEEN, low) and bool(_NOT_SEEN.search(_NOT_SEEN_AFTER.search(behind)[1]))


def _ranged(ahead: str, numbers: str) -> bool:
    """Is a run the end of a range, or its two ends?"""
    last = ahead.rstrip(_SPACE)
    if last.endswith(("-", "to")) and _FROM.search(ahead):
        return True
    return last[-1:] in "nN" and bool(_BETWEEN.search(ahead)) and bool(_TWO.search(numbers))


@lru_cache(maxsize=1 << 14)
def told(sentence: str) -> tuple[str | None, list[tuple], list[float]]:
    """The technique a sentence names (``raman``, ``ir``, ``open`` for both, None), its bands (pos, shape, family, mode, own) and the numbers it denies.

    Runs of numbers are closed by cm-1. Every number keeps its own place; its group and its mode are those named nearest to it.
    """
    raman = "Raman" in sentence and _RAMAN.search(sentence)
    ir = ("IR" in sentence or "nfrared" in sentence) and _INFRARED.search(sentence)
    technique = "open" if raman and ir else "raman" if raman else "ir" if ir else None
    stated: list[tuple] = []
    absent: list[float] = []
    if "cm-1" not in sentence:
        return technique, stated, absent
    families = modes = None
    low = sentence.lower()
    own = not _any(_OTHERS, low)
    for run in _RUNS.finditer(sentence):
        (start, end), numbers = run.span(), run[1]
        ahead = sentence[:start]
        if _denied(ahead, sentence[end:], low):
            absent.extend(float(n) for n in _WHOLES.findall(numbers))
            continue
        if _ranged(ahead, numbers):
            continue
        if families is None:
            families = [(m.start(), m[0]) for m in _FAMILIES.finditer(sentence)]
            modes = [(m.start(), m[0]) for m in _MODES.finditer(sentence)]
        for number in _NUMBERS.finditer(numbers):
            spot, m = start + number.start(), number[0]
            shape = _SHAPES.search(m) if m[-1] == ")" else None
            family = _nearest(families, spot, end)
            value = float(m[: m.index("(")] if shape else m)
            stated.append((value, shape[1] if shape else None, _SYNONYM.get(family, family), _mode_name(_nearest(modes, spot, end)), own))
    return technique, stated, absent


def _tables(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows_of: Callable[[str | None], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) to batches of the id and what `rows_of` reads in the text."""
    for batch in batches:
        at, rows = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            found = rows_of(text)
            rows.extend(found)
            at.extend([k] * len(found))
        columns = zip(*rows) if rows else [[] for _ in schema]
        ids = batch.column(0).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, schema))], [batch.schema.names[0], *schema.names])


def _stated(text: str | None) -> list[tuple]:
    out, standing = [], None
    for no, sentence in enumerate(sentences(normal(text))):
        technique, bands, _absent = told(sentence)
        standing = technique or standing
        if bands:
            said = None if standing == "open" else standing
            out.extend((no, pos, shape, said, family, mode, own) for pos, shape, family, mode, own in bands)
    return out


def _absent(text: str | None) -> list[tuple]:
    deny = (*_MAYBE_NO, *_MAYBE_NOT_SEEN)
    if not text or not _any(deny, text.lower()):
        return []
    found = ((no, told(s)[2]) for no, s in enumerate(sentences(normal(text))) if "cm-1" in s and _any(deny, s.lower()))
    return [(no, n, n) for no, numbers in found for n in dict.fromkeys(numbers)]


def stated_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, number = pa.string(), pa.float64()
    return _tables(batches, pa.schema([("sent_no", pa.int32()), ("pos", number), ("shape", text), ("technique", text), ("family", text), ("mode", text), ("own", pa.bool_())]), _stated)


def absent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tables(batches, pa.schema([("sent_no", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]), _absent)
