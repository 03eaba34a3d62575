"""Names: folding, normal forms, ordered fallbacks, edit distance."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from recordaudit.functions.measured import let

# Letters without a decomposition, and what they are written as.
_DIGRAPHS = {"ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "þ": "th"}
_SINGLE = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ð": "d", "ħ": "h", "ŧ": "t", "’": "'", "‐": "-", "‑": "-"}


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = dict(_SINGLE)
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != char:
            pairs.setdefault(char, base)
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _BASE = _plain_letters()
_COMBINING = "".join(chr(c) for c in range(0x0300, 0x0370))


def plain(text: Column) -> Column:
    """Letters without diacritics; soft hyphens and combining marks dropped."""
    out = F.coalesce(text, F.lit(""))
    for letter, written in _DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(written))
    return F.translate(F.translate(out, _ACCENTED, _BASE), _COMBINING + "­", "")


def fold_name(text: Column) -> Column:
    """A surname for comparison: letters a–z only."""
    return F.regexp_replace(F.lower(plain(text)), r"[^a-z]", "")


def norm_name(text: Column) -> Column:
    """A species name for matching: no diacritics, lower case, no ``-syn`` tag, single spaces; ``-(Ce)`` stays."""
    out = F.lower(F.trim(plain(text)))
    out = F.regexp_replace(out, r"[\s,\-]*\bsyn\b\.?", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.regexp_replace(out, r"^[ ,\-]+|[ ,\-]+$", "")


def squash(name: Column) -> Column:
    return F.translate(name, "- '", "")


def name_candidates(name: Column) -> Column:
    """Ordered fallbacks: the name, its ``-(xx)`` form, without a polytype tail, the base before a comma or hyphen."""

    def forms(n: Column) -> Column:
        levinson = F.when(n.rlike(r"^.+-[a-z][a-z]?$"), F.regexp_replace(n, r"^(.+?)-([a-z][a-z]?)$", "$1-($2)"))
        polytype = F.regexp_replace(n, r"-[0-9ivxabcmht]+(-[0-9]+)?$", "")
        base = F.trim(F.element_at(F.split(n, r"[,\-]"), 1))
        return F.array_distinct(F.filter(F.array(n, levinson, polytype, base), lambda c: c.isNotNull() & (c != "")))

    return let(norm_name(name), forms)


def normalise_primary(name: Column) -> Column:
    """A name's token form: folded, hyphens and repeated spaces as one space, the synthetic tag dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm_name(name), r"-(?!\()", " "), r"\s+", " "))


# What a species adds to its root: elements in brackets, a letter, a polytype, a count in Roman digits.
SUFFIXES = (r"-\([a-z0-9+,]+\)", r"[- ][a-z]", r"[- ][0-9][a-z0-9']*", r"[- ]i{1,3}", r"[- ]iv")
SUFFIX = "(?:" + "|".join(SUFFIXES) + ")$"


def name_root(norm: Column) -> Column:
    return F.regexp_replace(norm, SUFFIX, "")


def deletes(word: Column, depth: int) -> Column:
    """The word and every form of it with up to `depth` letters left out."""

    def once(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
        )

    first = F.concat(F.array(word), once(word))
    if depth == 1:
        return F.array_distinct(first)
    return F.array_distinct(F.concat(F.array(word), F.flatten(F.transform(once(word), lambda w: F.concat(F.array(w), once(w))))))


def osa_distance(a: str, b: str) -> Column:
    """Optimal string alignment distance of two string columns (a transposition is one edit), row by row."""
    return F.expr(
        f"""
        element_at(aggregate(sequence(1, length({a})),
          named_struct('pp', sequence(0, length({b})), 'p', sequence(0, length({b}))),
          (s, i) -> named_struct('pp', s.p, 'p', aggregate(sequence(1, length({b})), array(i), (r, j) ->
             concat(r, array(least(get(s.p, j) + 1, get(r, j - 1) + 1,
               get(s.p, j - 1) + CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN 0 ELSE 1 END,
               CASE WHEN i > 1 AND j > 1 AND substr({a}, i, 1) = substr({b}, j - 1, 1) AND substr({a}, i - 1, 1) = substr({b}, j, 1)
                    THEN get(s.pp, j - 2) + 1 ELSE 1000 END)))))).p, -1)"""
    )


def similar(a: Column, b: Column) -> Column:
    """Two folded surnames that are probably one misspelt: one opens the other, or they differ in a fifth of
    their letters at most (by edit distance) and in length by two at most."""
    opens = (F.startswith(a, b) | F.startswith(b, a)) & (F.length(a) >= 3) & (F.length(b) >= 3)
    longest = F.greatest(F.length(a), F.length(b))
    close = (1 - F.levenshtein(a, b) / longest >= 0.8) & (F.abs(F.length(a) - F.length(b)) <= 2)
    return (a != "") & (b != "") & (opens | close)
