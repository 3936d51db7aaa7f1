"""Tokenisers and text filters as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED, PLAIN = "áéíóúüÁÉÍÓÚÜ", "aeiouuAEIOUU"

#: The token patterns, in the order in which they are tried.
PATTERNS = {
    "abbreviations": r"\b(?:Dr|Lic|Ing|Sr|Sra|S\.A|etc)\.\b",
    "acronyms": r"\b[A-Z](?:\.?[A-Z]+){1,7}\b",
    "numbers": r"\b\d{1,4}(?:[.-]?\d{1,4}){0,3}\b",
    "urls": r"\b(?:ftp|https|http)?://[^\s/$.?#].[^\s]*\b",
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b",
    "names": r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b(?!\.)",
    "dates": r"\b\d{2}[-/.]\d{2}[-/.]\d{4}\b",
    "words": r"[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]+(?:-[a-zA-Z]+)*",
}

#: A short Spanish and English stop list for the queries here; every operator takes its own.
STOP_WORDS = tuple("a al and con de del el en in is la las los of or que se the to un una y".split())


def fold_accents(text: Column) -> Column:
    """áéíóúü, either case, without their accents; ñ stays."""
    return F.translate(text, ACCENTED, PLAIN)


def tok_basic(text: Column, fold: bool = False) -> Column:
    """Lower-cased runs of a-z, with accents folded first if asked."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(fold_accents(low) if fold else low, F.lit("[a-z]+"), F.lit(0))


def tok_regex(text: Column, *kinds: str) -> Column:
    """Leftmost matches of the chosen patterns (all if none), first pattern first; an unknown name is an error."""
    if unknown := set(kinds) - set(PATTERNS):
        raise ValueError(f"no such pattern: {sorted(unknown)}")
    chosen = [p for k, p in PATTERNS.items() if not kinds or k in kinds]
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + "|".join(chosen)), F.lit(0))


def tok_case(token: Column) -> Column:
    """Lower-case only what is made of a-z and hyphens once accents are folded."""
    folded = fold_accents(token)
    return F.when(folded.rlike(r"^[a-zA-Z]+(-[a-zA-Z]+)*$"), F.lower(folded)).otherwise(folded)


def strip_tags(token: Column) -> Column:
    return F.regexp_replace(token, "<[^>]+>", "")


def tokenize(text: Column, *kinds: str, stop_words: tuple[str, ...] = ()) -> Column:
    """Match, fold, strip tags, set case, drop stop words: the whole tokeniser."""
    out = F.transform(tok_regex(text, *kinds), lambda t: tok_case(strip_tags(t)))
    return F.filter(out, lambda t: ~t.isin(*stop_words)) if stop_words else out


def clean_chars(line: Column) -> Column:
    """Lower case, accents folded, without what is no word character and without digits; the underscore stays."""
    return F.regexp_replace(fold_accents(F.lower(F.coalesce(line, F.lit("")))), r"(?U)[\W\d]", "")


def char_ngrams(line: Column, n: int) -> Column:
    """All runs of n characters, by one pass of a look-ahead."""
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
