"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and of runs of words. What a run's words score is learned from labelled pages: a logistic model
over the elements that are open around it, each by its tag, by the tag it lies in, by its class, id and role, and by its
position (within an article or main element or not) says how likely they are main content. Words of likely content score
positive, others slightly negative, and tags negative, by how much more often labelled pages have them outside than inside.
One linear scan finds the contiguous run of the highest sum, and the text of that run, without words that are no likely
content (an advert inside an article) and without scripts, styles, comments and markup, is the main text. Titles, drawings,
frames, templates, text fields and sources of formulas are left out too where they have an end tag or close themselves;
without one only the tag itself is, as a browser or its reader would lose the rest of the page. Head needs no end.

Time is linear in the page: a tag, an attribute or a search for an end is looked at a bounded number of times, whatever is
left open. Defined results: a null or empty page, or one whose best run is empty, has empty text; of equal runs the first
wins; an element that never ends is taken to end where its parent does; a quote that never closes is a character like any
other; repeated rows are read one by one; an empty table gives an empty result; other columns of pages are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from . import common

_mark = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<odd>[!?]|/(?![a-zA-Z]))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+))")
#: All attributes of a tag up to its end, where values are well quoted and hold no angle bracket; what else there is goes through ``_attributes``.
_plain = re.compile(r"(?:[\s/]++[^\s\"'<>=/]++(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=]++))?)*+[\s/]*+>")
_attribute = re.compile(r"[\s/]*+(?:>|([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+)?)")
_named = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|\b(hidden)\b(?!\s*=|-)", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style")}
_own_end = {name: re.compile(rf"(?P<end></{name}\s*>)|<(?:{name}(?=[\s/>])|body[\s>]|/head\s*>|/body\s*>)", re.I) for name in ("title", "textarea", "template", "svg", "iframe", "annotation-xml", "annotation")}

#: Fixed values of the language: elements that don't end a block; elements without an end tag; what an opening tag closes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements of formulas and drawings: their tags say nothing about where the main content is.
FOREIGN = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mspace mpadded mphantom menclose merror semantics svg g path circle rect line polyline polygon ellipse defs use symbol clippath mask lineargradient radialgradient stop text tspan desc metadata filter image foreignobject pattern marker animate animatetransform".split())
FOREIGN_BREAKS = frozenset("mtable mtr mtd svg text foreignobject".split())

KNOWN = 50_000  # opening tags whose weight a worker remembers
DEPTH = 256  # elements open at once that are told apart; deeper ones count as their parent
LEAST_TAG, MOST_TAG = -2.0, -0.01  # what a tag can score
MOST_WORD, OTHER_WORD = 4.0, -0.05  # what a word of likely content can score, and one of another kind


def features(name: str, rest: str, parent: str, inside: bool) -> list[str]:
    """What is known of an opening tag: itself and its parent, both by position, and the words of its class, id and role."""
    if not name:
        return ["words"]
    where = "in" if inside else "out"
    out = [f"{name}@{where}", f"{parent}>{name}@{where}"]
    if len(rest) > 4:
        for m in _named.finditer(rest):
            if m[5] or m[1].lower() == "style":
                if m[5] or re.search(r"display\s*:\s*none", m[2] or m[3] or m[4] or "", re.I):
                    out.append("hidden")
                continue
            for word in (m[2] or m[3] or m[4] or "").split():
                found = [x.lower() for x in _parts.findall(word)]
                out += [f".{x}" for x in dict.fromkeys([*found, "-".join(found)])]
    return out


def _attributes(page: str, at: int, last: dict[str, int]) -> int:
    """Where a tag whose name ends at ``at`` ends, or -1. A quote after the last of its kind (``last``) opens nothing."""
    while m := _attribute.match(page, at):
        at = m.end()
        if m[1] is None:
            return at
        quote = page[at : at + 1]
        if m[0].rstrip().endswith("=") and quote in ("'", '"') and at < last[quote]:
            at = page.index(quote, at + 1) + 1
        elif m[0].rstrip().endswith("="):
            while at < len(page) and page[at] not in " \t\n\r\f>":
                at += 1
    return -1


def tags(page: str):
    """(kind, name, attributes, from, to) of all that is no text, in page order: kind is start, end, gone (content left out), cdata."""
    last = {q: page.rfind(q) for q in "'\""}
    bracket = page.rfind(">")
    loose = False  # a tag ran to the end of the page inside its quotes: from then on quotes mean nothing
    at = 0
    while m := _mark.search(page, at):
        start, at = m.start(), m.end()
        if m["comment"]:
            to = page.find("-->", at)
            at = len(page) if to < 0 else to + 3
            yield "skip", "", "", start, at
            continue
        if m["cdata"]:
            to = page.find("]]>", at)
            yield "cdata", "", "", start, at
            if to < 0:
                return
            yield "skip", "", "", to, to + 3
            at = to + 3
            continue
        if start > bracket:
            return
        if m["odd"]:
            at = page.index(">", at) + 1
            yield "skip", "", "", start, at
            continue
        if n := _plain.match(page, at):
            to = n.end()
        elif loose:
            to = page.index(">", at) + 1
        else:
            to = _attributes(page, at, last)
            if to < 0:
                loose, to = True, page.index(">", at) + 1
        name, rest = m["name"].lower(), page[at : to - 1]
        at = to
        if m["end"]:
            yield "end", name, "", start, to
            continue
        if name in _raw_end:
            found = _raw_end[name].search(page, to)
            at = found.end() if found else len(page)
            yield "gone", name, rest, start, at
            continue
        if name in _own_end and not (name == "svg" and rest.endswith("/")):
            found = _own_end[name].search(page, to)
            if found and found["end"]:
                at = found.end()
                yield "gone", name, rest, start, at
                continue
            if name == "title":  # one without an end lasts to the next tag
                found = _mark.search(page, to)
                at = found.start() if found else len(page)
                yield "gone", name, rest, start, at
                continue
        yield "start", name, rest, start, to


def segments(page: str, weigh):
    """(tag's name or "", text, breaks, logit, place) in page order. logit: of the context, what ``weigh`` makes of the
    features of each open element, added up; breaks: a tag that ends a block."""
    stack: list[tuple[str, float, bool]] = []  # name, logit of the context, whether within article or main
    open_: Counter = Counter()
    logit, inside, at = weigh("", "", "", False), False, 0

    def close(upto: int) -> None:
        nonlocal logit, inside
        name = ""
        while len(stack) > upto:
            name, logit, inside = stack.pop()
            open_[name] -= 1

    for kind, name, rest, start, to in tags(page):
        if start > at:
            yield "", page[at:start], False, logit, at
        at = to
        if kind == "skip" or kind == "cdata":
            continue
        if kind == "gone":
            yield "gone", "", True, logit, start
            continue
        breaks = name in FOREIGN_BREAKS if name in FOREIGN else name not in INLINE
        if kind == "end":
            if open_[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
            yield name, "", breaks, logit, start
            continue
        for sibling in SIBLINGS.get(name, ()):
            if open_[sibling]:
                for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                    if stack[k][0] == sibling:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
        if name in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        yield name, "", breaks, logit, start
        if name in VOID or rest.endswith("/") or len(stack) >= DEPTH or name in FOREIGN:
            continue
        parent = "body"
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] not in INLINE:
                parent = stack[k][0]
                break
        stack.append((name, logit, inside))
        open_[name] += 1
        inside = inside or name in MAIN
        logit += weigh(name, rest, parent, stack[-1][2])
    if at < len(page):
        yield "", page[at:], False, logit, at


#: Labelled names: what pages call their parts. Any of them may stand alone or beside others.
LABELLED_NOISE = "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
LABELLED_MAIN = "content article post entry story text body main page container wrapper inner section lead intro summary quote figure caption table chart recipe abstract chapter title headline paragraph share-price price-header quick-reply-rate ad-hoc social-science cookie-recipe widget-theory menu-engineering comment-free".split()
LABELLED_ANY = "box block row col left right top bottom wide clearfix group item list first last odd even area module".split()


def labelled_pages(n: int = 700, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Pages of several layouts as (fragment, whether main content): the labels that the weights are learned from."""
    r = random.Random(seed)
    pick = lambda a, b: r.randint(a, b)
    word = lambda: "".join(r.choice("aeinorstlu") for _ in range(pick(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(pick(a, b)))

    def names(pool: list[str]) -> str:
        """A class, id or role with one of the pool's names, alone or beside names that say nothing."""
        name = r.choice(pool)
        name = r.choice([name, name, f"{name}-{r.choice(LABELLED_ANY)}", f"{r.choice(LABELLED_ANY)}-{name}", f"{name}_{pick(1, 9)}", f"{word()}-{name}", f"{name} {r.choice(LABELLED_ANY)}", f"{name} {word()}", name.capitalize()])
        return f'{r.choice(["class", "class", "class", "id", "role"])}="{name}"'

    def nothing() -> str:
        return r.choice(["", "", f' class="{r.choice(LABELLED_ANY)}"', f' class="{word()}"', f' id="{word()}"'])

    def links(a: int = 3, b: int = 9) -> str:
        item = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
        return r.choice([lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(pick(a, b))) + "</ul>", lambda: " | ".join(item() for _ in range(pick(a, b))), lambda: "".join(f"<div>{item()}</div>" for _ in range(pick(a, b)))])()

    def some() -> str:
        """What is inside a part that is no main content."""
        return r.choice([lambda: words(3, 40), lambda: f"<p>{words(3, 40)}</p>", lambda: f"<h3>{words(1, 4)}</h3>{links()}", lambda: links(), lambda: f"<p>{words(3, 20)}</p><p>{words(3, 20)}</p>", lambda: f"<div{nothing()}><p>{words(3, 30)} <a href='/x'>{words(1, 2)}</a></p></div>", lambda: f"<span>{words(1, 6)}</span>"])()

    def noise() -> str:
        part = r.choice(["div", "div", "div", "section", "ul", "p", "span"])
        return r.choice([
            lambda: f"<{part} {names(LABELLED_NOISE)}>{some() if part in ('div', 'section') else words(3, 25)}</{part}>", lambda: f"<{part} {names(LABELLED_NOISE)}>{some() if part in ('div', 'section') else words(3, 25)}</{part}>",
            lambda: f"<aside{nothing()}>{some()}</aside>", lambda: f'<form action="/x"><label>{words(1, 3)}</label><input type="text"><select><option>{word()}<option>{word()}</select><button>{words(1, 3)}</button></form>',
            lambda: f"<nav{nothing()}>{some()}</nav>", lambda: f"<button>{words(1, 3)}</button>", lambda: f"<dialog>{some()}</dialog>", lambda: f"<menu>{links(2, 5)}</menu>", lambda: f'<div style="display:none">{some()}</div>', lambda: f"<div hidden>{some()}</div>",
            lambda: f'<div {names(LABELLED_NOISE)}><article class="{word()}"><p>{words(5, 40)}</p></article></div>' if r.random() < 0.3 else f"<footer>{some()}</footer>",
        ])()

    def block() -> str:
        return r.choice([
            lambda: f"<p>{words(20, 90)}</p>", lambda: f"<p>{words(5, 30)}</p>", lambda: f"<p><b>{words(5, 30)}<br><p>{words(9, 60)}", lambda: f"<h2>{words(2, 6)}</h2><p>{words(20, 70)} <em>{words(1, 3)}</em> {words(5, 20)}</p>",
            lambda: f"<blockquote><p>{words(9, 30)}</p></blockquote>", lambda: f"<ul><li>{words(4, 14)}</li><li>{words(4, 14)}<li>{words(2, 5)}</ul>", lambda: f"<ol><li><p>{words(4, 14)}</p></li><li>{words(1, 4)}</li></ol>",
            lambda: f"<p>{words(5, 40)} <a href='/{word()}'>{words(1, 4)}</a> {words(5, 40)}</p>", lambda: f"<ul><li><a href='/{word()}'>{words(1, 5)}</a> {words(1, 9)}</li><li><a href='/{word()}'>{words(2, 5)}</a></li></ul>",
            lambda: f"<table><tr><th>{words(1, 2)}<td>{words(1, 4)}<tr><td>{word()}<td>{words(1, 3)}</table>", lambda: f"<pre><code>{words(4, 20)}</code></pre>", lambda: f"<figure><img src='x'><figcaption>{words(3, 12)}</figcaption></figure>",
            lambda: f"<div {names(LABELLED_MAIN)}><p>{words(9, 50)}</p></div>", lambda: f"<section{nothing()}><h3>{words(1, 6)}</h3><p>{words(9, 50)}</p></section>", lambda: f"<p {names(LABELLED_MAIN)}>{words(4, 40)}</p>", lambda: f"<span {names(LABELLED_MAIN)}>{words(1, 9)}</span>",
            lambda: f"<dl><dt>{words(1, 3)}<dd>{words(3, 12)}</dl>", lambda: f"<div{nothing()}>{words(6, 40)}</div>", lambda: f"{words(5, 40)}<br>{words(3, 20)}", lambda: f"<details><summary>{words(1, 5)}</summary>{words(5, 30)}</details>", lambda: f"<h4{nothing()}>{words(1, 6)}</h4><hr>", lambda: f"<select><option>{words(1, 3)}<option>{words(1, 3)}</select>", lambda: f"<p><label>{words(1, 3)}</label> <object data='x'><p>{words(2, 9)}</p></object>",
        ])()

    pages = []
    for _ in range(n):
        outer, inner = r.choice([("<article>", "</article>"), ("<main>", "</main>"), (f"<div {names(LABELLED_MAIN)}>", "</div>"), ("<main><article>", "</article></main>"), (f"<main{nothing()}><div {names(LABELLED_MAIN)}>", "</div></main>"), (f"<article {names(LABELLED_MAIN)}><div{nothing()}>", "</div></article>"), ("", "")])
        around = r.choice([("", ""), (f"<div{nothing()}>", "</div>"), (f"<div{nothing()}><div{nothing()}>", "</div></div>")])
        page = [(r.choice(["<html><head><title>x</title></head><body>", "<!doctype html><html><body>", f"<body{nothing()}>"]) + around[0], False)]
        page.append((r.choice([f"<nav{nothing()}>{links()}</nav>", f"<header{nothing()}><div>{words(1, 4)}</div>{links()}</header>", f"<div {names(LABELLED_NOISE)}>{links()}</div>", f"<header><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>", ""]), False))
        page += [(noise(), False) for _ in range(pick(0, 3))]
        page.append((outer, False))
        page.append((r.choice([f"<h1>{words(2, 9)}</h1>", f"<h1{nothing()}>{words(2, 9)}</h1>", f"<header><h1>{words(2, 9)}</h1><p>{words(2, 6)}</p></header>" if "article" in outer else f"<h1>{words(2, 9)}</h1>", ""]), True))
        for _ in range(pick(1, 8)):
            page.append((block(), True))
            if r.random() < 0.3:
                page.append((noise(), False))
        page.append((inner, False))
        page += [(noise(), False) for _ in range(pick(0, 3))]
        page += [(r.choice([f"<footer{nothing()}>{some()}</footer>", f"<footer>&copy; {words(3, 15)}</footer>", ""]), False), (r.choice([around[1] + "</body></html>", ""]), False)]
        pages.append(page)
    return pages


class Weights:
    """What features add to the logit of words in their context, and what tags score."""

    def __init__(self, context: dict[str, float], tags: dict[str, float]):
        self.context, self.tags, self.known = context, tags, {}

    def weigh(self, *opened) -> float:
        """The sum of the weights of an opening tag's features (see ``features``)."""
        found = self.known.get(opened)
        if found is None:
            found = sum([self.context.get(x, 0.0) for x in features(*opened)])
            if len(self.known) < KNOWN and len(opened[1]) < 200:
                self.known[opened] = found
        return found

    def score(self, parts: list[tuple[str, str, bool, float, int]]) -> list[float]:
        """Of each part: a run of words by their number and context, a tag by itself."""
        out = []
        for name, text, _, logit, _ in parts:
            if text:
                out.append((min(MOST_WORD, logit) if logit > 0 else max(OTHER_WORD, logit)) * len(text.split()))
            elif name == "gone" or name in FOREIGN:
                out.append(0.0)
            else:
                out.append(self.tags.get(name, -1.0))
        return out


def examples(pages: list[list[tuple[str, bool]]]) -> tuple[list[tuple[list[str], int, bool]], list[tuple[str, bool]]]:
    """Runs of words as (features of the context, words, label) and tags as (name, label).

    ``segments`` only adds up what ``weigh`` makes of features, so here that is the list of their numbers.
    """
    runs, names = [], []
    for page in pages:
        known: list[list[str]] = []

        class Sum:
            """Numbers of lists of features that can be added up, in place of their weights."""

            def __init__(self, ids=()):
                self.ids = ids

            def __add__(self, other):
                return Sum(self.ids + other.ids)

        def weigh(*opened, known=known, Sum=Sum):
            known.append(features(*opened))
            return Sum((len(known) - 1,))

        starts = np.cumsum([0, *(len(f) for f, _ in page)])
        for name, text, _, logit, start in segments("".join(f for f, _ in page), weigh):
            main = page[int(np.searchsorted(starts, start, "right")) - 1][1]
            if text.strip():
                runs.append(([x for k in logit.ids for x in known[k]], len(text.split()), main))
            elif not text and name != "gone":
                names.append((name, main))
    return runs, names


def learn(pages: list[list[tuple[str, bool]]], rounds: int = 400, ridge: float = 1e-3) -> Weights:
    """A logistic fit over contexts, and log odds of tags inside against outside. A feature seen fewer than three times, as a
    made-up name is, has no weight."""
    runs, names = examples(pages)
    seen = Counter(x for found, _, _ in runs for x in set(found))
    index = {x: k for k, x in enumerate(sorted(x for x, c in seen.items() if c >= 3))}
    rows = [[index[x] for x in found if x in index] for found, _, _ in runs]
    row, column = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate([np.array(x, np.int64) for x in rows])
    y = np.array([main for *_, main in runs], float)
    amount = np.minimum(np.array([n for _, n, _ in runs], float), 10) ** 0.5
    amount /= amount.sum()
    w, m, v = np.zeros(len(index)), np.zeros(len(index)), np.zeros(len(index))
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column], len(rows))
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * amount
        g = np.bincount(column, d[row], len(index)) + ridge * w / len(index)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    inside, outside = (Counter(name for name, main in names if main == kind) for kind in (True, False))
    all_in, all_out = sum(inside.values()), sum(outside.values())
    odds = {x: float(np.log((inside[x] + 0.5) / all_in) - np.log((outside[x] + 0.5) / all_out)) for x in inside | outside}
    return Weights({x: round(float(w[k]), 4) for x, k in index.items()}, {x: min(MOST_TAG, max(LEAST_TAG, o)) for x, o in odds.items()})


def best_run(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous run of the highest sum begins and ends, by one scan; (0, 0) if no sum is positive."""
    best = total = 0.0
    start = first = last = 0
    for k, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, last = total, start, k + 1
    return first, last


_weights: Weights | None = None


def weights() -> Weights:
    global _weights
    if _weights is None:
        _weights = learn(labelled_pages())
    return _weights


def main_text(page: str | None, w: Weights | None = None) -> str:
    """The main text of a page: one scan over its tags and words."""
    if not page:
        return ""
    w = w or weights()
    parts = list(segments(page, w.weigh))
    first, last = best_run(w.score(parts))
    out = []
    for _, text, breaks, logit, _ in parts[first:last]:
        if text and logit > 0:
            out.append(entities.unescape(text))
        elif breaks:
            out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; only the html is read by Python, nothing is shuffled."""
    w = weights()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py(), w) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    common.arrow_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
