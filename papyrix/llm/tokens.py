"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of words.

The tokenizer splits at white space before anything else that depends on neighbours, so a text's ids are the ids of
its space-separated chunks in order. Chunks repeat (Zipf), so each worker keeps the ids of those it has seen, in one cache; a chunk
of Latin letters, ASCII digits and ASCII signs is looked up by its pre-tokens, any other goes through the library whole. That holds for a tokenizer with the normalizer and the pre-tokenizer
of ``KNOWN``; with any other every text goes through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array

from . import common

CACHE = 500_000  # entries a worker keeps: about 100 MB

_pretoken = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_plain = re.compile(r"[!-~À-ÖØ-Þß-öø-ÿ]*")
#: The normalizer and pre-tokenizer that splitting at white space is right for.
KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class _Cache(dict):
    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        ids = self.find(key)
        if len(key) < 64 and len(self) < CACHE:
            self[key] = ids
        return ids


class WordCachedTokenizer:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers, equal to ``Tokenizer.encode(text).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.model, self.letters = self.whole.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.known = (made["normalizer"], made["pre_tokenizer"]) == KNOWN and made["model"]["type"] == "BPE" and not any(made.get(x) for x in ("truncation", "padding"))
        self.known = self.known and all(x["special"] and not x["normalized"] and x["content"].startswith("<|") for x in made["added_tokens"])
        self.ids = _Cache(self._chunk)  # of chunks and of pre-tokens, since a pre-token met as a chunk has the same ids

    def _piece(self, piece: str) -> bytes:
        s = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return array("I", [x.id for x in self.model.tokenize(s)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._piece(chunk) if chunk.islower() else self.ids[chunk.lower()]
        if "<|" not in chunk and (chunk.isascii() and chunk.isprintable() or _plain.fullmatch(chunk)):
            pieces = _pretoken.findall(chunk.lower())
            if pieces == [chunk]:
                return self._piece(chunk)
            return b"".join([self.ids[p] for p in pieces])
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.ids.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_loaded: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    common.claim("tokens", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = WordCachedTokenizer(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
