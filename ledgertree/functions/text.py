"""Names, paths and tokens."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F


def ascii_lower(col: Column) -> Column:
    """Case folding of ASCII letters only, as in a NOCASE comparison."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def segments(path: Column) -> Column:
    """Non-empty segments of a slash path."""
    return F.filter(F.split(slashes(path), "/"), lambda s: s != "")


def prefixes(parts: Column) -> Column:
    """["a","b"] -> ["a", "a/b"]."""
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        )
    )


def drive_of(path: Column) -> Column:
    """Upper-case drive of "c:/x"; NULL when there is none."""
    norm = slashes(path)
    return F.when(F.substring(norm, 2, 1) == ":", F.upper(F.substring(norm, 1, 2)))


def after_drive(path: Column) -> Column:
    """Segments below the drive."""
    return segments(F.substr(path, F.lit(3)))


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty for dot-files and plain names."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def tokens(name: Column) -> Column:
    """Lower-case runs of letters and digits, however long."""
    parts = F.split(F.lower(name), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def grams(text: str, low: int = 3, high: int = 10) -> list[str]:
    """Distinct character grams of a query string."""
    return sorted({text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)})


def within_edits(token: Column, word: str, limit: int) -> Column:
    """Whether ``token`` is within ``limit`` (1 or 2) edits of ``word``.

    An edit is an insertion, deletion, substitution or a swap of two
    neighbouring characters, and no character is edited twice. The built-in
    distance knows no swaps, so each swap is tried in turn: what stands before
    or after the swapped pair may take the remaining edit.
    """
    hit = F.levenshtein(token, F.lit(word), limit) >= 0
    spots = [i for i in range(len(word) - 1) if word[i] != word[i + 1]]
    once = sorted({_swap(word, i) for i in spots})
    if limit == 1:
        return hit | token.isin(once) if once else hit
    for i in spots:
        head, pair, tail = word[:i], word[i + 1] + word[i], word[i + 2 :]
        rest = F.substr(token, F.lit(i + 3))
        start = F.substr(token, F.lit(1), F.length(token) - (len(tail) + 2))
        hit = hit | (token.startswith(head + pair) & (F.levenshtein(rest, F.lit(tail), 1) >= 0))
        hit = hit | (token.endswith(pair + tail) & (F.levenshtein(start, F.lit(head), 1) >= 0))
    twice = sorted({_swap(_swap(word, i), j) for i in spots for j in spots if j >= i + 2})
    return hit | token.isin(twice) if twice else hit


def _swap(word: str, i: int) -> str:
    return word[:i] + word[i + 1] + word[i] + word[i + 2 :]


def attribute_names(bits: Column) -> Column:
    # Bit -> name.
    named = [(1, "readonly"), (2, "hidden"), (4, "system"), (32, "archive"), (1024, "reparse")]
    return F.array_compact(
        F.array(*[F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in named])
    )


def attribute_flags(bits: Column) -> Column:
    # Bit -> letter.
    letters = [(1, "R"), (2, "H"), (4, "S"), (32, "A"), (1024, "L")]
    text = F.concat(
        *[F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(ch)).otherwise(F.lit("")) for bit, ch in letters]
    )
    return F.when(text == "", F.lit("-")).otherwise(text)
