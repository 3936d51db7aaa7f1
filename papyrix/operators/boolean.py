"""Boolean queries: a parser and one-shuffle evaluation over postings.

Any expression is one aggregation: a flag for each of its terms by document, then a filter; NOT sees all documents.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_word = re.compile(r"\s*(?:([()])|(&|\*|\||\+|~|!)|([^\s()&*|+~!]+))")
_signs = {"&": "and", "*": "and", "|": "or", "+": "or", "~": "not", "!": "not"}


def parse(text: str) -> tuple:
    """("term", t), ("not", x), ("and", [..]), ("or", [..]); NOT binds before AND before OR."""
    words, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _word.match(text, at)
        at = m.end()
        low = (m[3] or "").lower()
        words.append(("sign", m[1]) if m[1] else ("sign", _signs[m[2]]) if m[2] else ("sign", low) if low in ("and", "or", "not") else ("term", m[3]))
    place = 0

    def peek():
        return words[place] if place < len(words) else ("end", "")

    def take():
        nonlocal place
        place += 1
        return words[place - 1]

    def chain(name, inner):
        parts = [inner()]
        while peek() == ("sign", name):
            take()
            parts.append(inner())
        return parts[0] if len(parts) == 1 else (name, parts)

    def factor():
        kind, what = peek()
        if kind == "term":
            return take()
        if (kind, what) == ("sign", "not"):
            take()
            return ("not", factor())
        if (kind, what) == ("sign", "("):
            take()
            inner = whole()
            if peek() != ("sign", ")"):
                raise ValueError("a parenthesis stays open")
            take()
            return inner
        raise ValueError(f"unexpected {what or 'end'}")

    def whole():
        return chain("or", lambda: chain("and", factor))

    out = whole()
    if peek()[0] != "end":
        raise ValueError(f"unexpected {peek()[1]}")
    return out


def terms(tree: tuple) -> list[str]:
    if tree[0] == "term":
        return [tree[1]]
    inner = [tree[1]] if tree[0] == "not" else tree[1]
    return sorted({t for x in inner for t in terms(x)})


def evaluate(posts: DataFrame, docs: DataFrame, expression: str | tuple) -> DataFrame:
    """doc_id of the documents that satisfy an expression; a term that is nowhere is in none."""
    tree = parse(expression) if isinstance(expression, str) else expression
    names = terms(tree)
    flags = {t: f"f{k}" for k, t in enumerate(names)}
    found = posts.where(F.col("term").isin(names)).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == t).alias(flags[t]) for t in names])

    def column(x: tuple) -> Column:
        if x[0] == "term":
            return F.coalesce(F.col(flags[x[1]]), F.lit(False))
        if x[0] == "not":
            return ~column(x[1])
        return reduce((lambda a, b: a & b) if x[0] == "and" else (lambda a, b: a | b), map(column, x[1]))

    def matches_nothing(x: tuple) -> bool:
        """Whether a document without any of the terms fails; only then can the documents be left out."""
        return True if x[0] == "term" else not matches_nothing(x[1]) if x[0] == "not" else any(map(matches_nothing, x[1])) if x[0] == "and" else all(map(matches_nothing, x[1]))

    rows = found if matches_nothing(tree) else docs.select("doc_id").distinct().join(found, "doc_id", "left")
    return rows.where(column(tree)).select("doc_id")


def intersect(posts: DataFrame, first: str, second: str) -> DataFrame:
    """Documents with both terms, by a semi join of two pruned scans."""
    return posts.where(F.col("term") == first).select("doc_id").join(posts.where(F.col("term") == second).select("doc_id"), "doc_id", "left_semi")
