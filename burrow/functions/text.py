"""Text analysis, path prefixes and currencies as Column functions, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PROTECTED: tuple[str, ...] = ()


def words(text: Column, stem: bool = False, protected: tuple[str, ...] = PROTECTED) -> Column:
    """The terms of a full-text field: split at white space, at other signs and between lower and upper case or letters
    and digits; in lower case; with common English endings cut if `stem`, but for protected words."""
    apart = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    found = F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: stemmed(w, protected)) if stem else found


def joined_parts(text: Column) -> Column:
    """What words() cuts in two at signs, in one piece as well: wi-fi gives wifi."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[-'_.][\p{L}\p{N}]+)+"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))


def stemmed(word: Column, protected: tuple[str, ...] = PROTECTED) -> Column:
    """A light English stem: plural, -ed and -ing endings."""
    cut = F.regexp_replace(word, "(?<=[^s])s$", "")
    cut = F.regexp_replace(cut, "(?<=(?:ss|x|ch|sh))e$", "")
    cut = F.regexp_replace(cut, "ie$", "y")
    cut = F.regexp_replace(cut, "(?<=[a-z]{3})(?:ed|ing)$", "")
    stem = F.when(F.length(word) > 3, cut).otherwise(word)
    return F.when(word.isin(*protected), word).otherwise(stem) if protected else stem


def path_prefixes(path: Column, separator: str = "/") -> Column:
    """a/b/c as a, a/b and a/b/c."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def convert(amount: Column, currency: Column, rates: dict[str, float], to: str = "USD") -> Column:
    """An amount in another currency. rates: units of each currency for one of the base; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return amount / table[currency] * table[F.lit(to)]
