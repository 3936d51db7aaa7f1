"""Stemmers from their published descriptions: Porter (1980), Paice and Husk (Lancaster, 1990) in its core rules, and the
Spanish Snowball stemmer. They run over distinct terms only (``stem_terms``), which are then joined back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shape(word: str) -> str:
    return "".join("v" if c in "aeiou" or c == "y" and k and word[k - 1] not in "aeiou" else "c" for k, c in enumerate(word))


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def porter(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w

    def swap(pairs, least):
        nonlocal w
        for end, new in pairs:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + new
                return

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, cut = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, cut = w[:-3], True
    if cut:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    swap([("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    swap([("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


#: The published rules. An ending (reversed), * if only of a whole word, how many letters go, what is added, > to go on or . to stop.
LANCASTER = """
ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y>
ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1.
mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2>
ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1.
vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.
"""
_rules = [(m[1][::-1], bool(m[2]), int(m[3]), m[4], m[5] == ">") for m in re.finditer(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", LANCASTER)]
_by_letter = {c: [r for r in _rules if r[0].endswith(c)] for c in "abcdefghijklmnopqrstuvwxyz"}


def lancaster(word: str) -> str:
    """The first rule whose ending fits and that leaves two letters after a vowel, or three with a vowel among the second and
    third, is applied, and so on until a rule stops or none fits."""
    w = whole = word.lower()
    on = True
    while on and w:
        on = False
        for end, intact, cut, new, more in _by_letter.get(w[-1], ()):
            left = len(w) - cut
            fits = left >= 2 if w[0] in "aeiouy" else left >= 3 and (w[1] in "aeiouy" or w[2] in "aeiouy")
            if w.endswith(end) and fits and (not intact or w == whole):
                w, on = w[:left] + new, more
                break
    return w


_vowels = "aeiouáéíóúü"
#: Fixed values of the Spanish stemmer.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
SUFFIXES = [
    ("amientos imientos amiento imiento anzas ismos ables ibles istas anza icos icas ismo able ible ista osos osas oso osa ico ica".split(), ""),
    ("adoras adores aciones antes ancias adora ador ación acion ante ancia".split(), "ic"), ("logías logía".split(), "log"), ("uciones ución ucion".split(), "u"), ("encias encia".split(), "ente"),
    ("amente mente".split(), "mente"), ("idades idad".split(), "idad"), ("ivas ivos iva ivo".split(), "iv"),
]
Y_VERBS = "yeron yendo yamos yais yan yen yas yes ya ye yo yó".split()
VERBS = "aríamos eríamos iríamos iéramos iésemos aríais aremos eríais eremos iríais iremos ierais ieseis asteis isteis ábamos áramos ásemos arían arías aréis erían erías eréis irían irías iréis ieran iesen ieron iendo ieras ieses abais arais aseis éamos arán arás aría erán erás ería irán irás iría iera iese aste iste aban aran asen aron ando abas adas idas aras ases íais ados idos amos imos ará aré erá eré irá iré aba ada ida ara ase ían ado ido ías áis ía ad ed id an ió ar er ir as ís".split()


def snowball_es(word: str) -> str:
    w = word.lower()
    r1 = r2 = rv = len(w)
    if m := re.search(f"[{_vowels}][^{_vowels}]", w):
        r1 = m.end()
        if n := re.search(f"[{_vowels}][^{_vowels}]", w[r1:]):
            r2 = r1 + n.end()
    if len(w) > 3:
        if w[1] not in _vowels:
            found = re.search(f"[{_vowels}]", w[2:])
            rv = found.end() + 2 if found else len(w)
        elif w[0] in _vowels:
            found = re.search(f"[^{_vowels}]", w[2:])
            rv = found.end() + 2 if found else len(w)
        else:
            rv = 3
    for p in PRONOUNS:
        if w.endswith(p) and len(w) - len(p) >= rv:
            stem = w[: -len(p)]
            m = re.search("(iéndo|ándo|ár|ér|ír|iendo|ando|ar|er|ir)$", stem[rv:]) or (stem.endswith("uyendo") and re.search("(yendo)$", stem[rv:]))
            if m:
                w = stem[:rv] + stem[rv:].translate(str.maketrans("áéíóú", "aeiou")) if re.search("[áéí]", m[1]) else stem
            break
    done = _standard(w, r1, r2)
    if done == w:
        for v in Y_VERBS:
            if w.endswith(v) and len(w) - len(v) >= rv and w[: -len(v)].endswith("u"):
                done = w[: -len(v)]
                break
    if done == w:
        for v in sorted([*VERBS, "en", "es", "éis", "emos"], key=len, reverse=True):
            if w.endswith(v) and len(w) - len(v) >= rv:
                done = w[: -len(v)]
                if v in ("en", "es", "éis", "emos") and done.endswith("gu"):
                    done = done[:-1]
                break
    w = done
    for v in ("os", "a", "o", "á", "í", "ó"):
        if w.endswith(v) and len(w) - len(v) >= rv:
            w = w[: -len(v)]
            break
    else:
        if w.endswith(("e", "é")) and len(w) - 1 >= rv:
            w = w[:-1]
            if w.endswith("gu") and len(w) - 1 >= rv:
                w = w[:-1]
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def _standard(w: str, r1: int, r2: int) -> str:
    best = max(((s, kind) for ends, kind in SUFFIXES for s in ends if w.endswith(s)), key=lambda x: len(x[0]), default=None)
    if not best:
        return w
    s, kind = best
    stem, at = w[: -len(s)], len(w) - len(s)
    if s == "amente":
        if at < r1:
            return w
        for more in ("ativ", "iv", "os", "ic", "ad"):
            if stem.endswith(more) and len(stem) - len(more) >= r2:
                return stem[: -len(more)]
        return stem
    if at < r2:
        return w
    extra = {"ic": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iv": ("at",)}.get(kind, ())
    for more in extra:
        if stem.endswith(more) and len(stem) - len(more) >= r2:
            return stem[: -len(more)]
    return stem + {"log": "log", "u": "u", "ente": "ente"}.get(kind, "")


METHODS = {"porter": porter, "lancaster": lancaster, "snowball_es": snowball_es}


def stem_terms(postings: DataFrame, method: str, term: str = "term") -> DataFrame:
    """Add ``stem`` to a table of terms: each distinct term is stemmed once and joined back."""
    if method not in METHODS:
        raise ValueError(f"no such stemmer: {method}")
    one = METHODS[method]

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(one, na_action="ignore")

    return postings.join(postings.select(term).distinct().withColumn("stem", stem(term)), term)
