"""Counts of character n-grams (of one or two characters) of many lines at once, over Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES = 1 << 20  # of text that is counted at once; a longer line is one piece
CODES = 0x110000


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut at BYTES of a text column."""
    for batch in batches:
        upto, at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def count(lines: pa.Array, n: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """group, gram and count of each pair that is there, by group, and the grams' texts; a group is a line where none are given."""
    sizes = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32)
    line = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.zeros(CODES, bool)
    seen[chars] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(CODES, np.int64)
    place[letters] = np.arange(len(letters))
    code, several = place[chars], max(1, len(letters))
    if n == 2:
        code = (code[:-1] * several + code[1:])[line[1:] == line[:-1]]
        line = line[1:][line[1:] == line[:-1]]
    key = (line if groups is None else groups[line]) * several**n + code
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    group, gram = np.divmod(key[first], several**n)
    used, gram = np.unique(gram, return_inverse=True)
    text = [chr(letters[g]) if n == 1 else chr(letters[g // several]) + chr(letters[g % several]) for g in used.tolist()]
    return group, gram, np.diff(first, append=len(key)), text


def profile(n: int):
    """lang, line to lang, gram, cnt of a piece."""

    def run(batches):
        for batch in pieces(batches, "line"):
            coded = batch.column("lang").dictionary_encode()
            names = pa.concat_arrays([coded.dictionary, pa.array([None], coded.dictionary.type)])
            groups = pc.fill_null(coded.indices, len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            group, gram, cnt, text = count(batch.column("line"), n, groups)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(group)), pa.array(text, pa.string()).take(pa.array(gram)), pa.array(cnt)], ["lang", "gram", "cnt"])

    return run


def sums(n: int, place: dict[str, int], counts: np.ndarray):
    """doc_id, line to doc_id, sx, sxx, nx, and sxy, nxy for each column of counts (a row for each gram, a last one of 0)."""

    def run(batches):
        for batch in pieces(batches, "line"):
            row, gram, x, text = count(batch.column("line"), n)
            if not len(row):
                continue
            y = counts[np.array([place.get(g, len(counts) - 1) for g in text])]
            first = np.flatnonzero(np.diff(row, prepend=-1) != 0)
            add = lambda v: np.add.reduceat(v, first)
            sxy = np.stack([add(x * y[gram, k]) for k in range(y.shape[1])], 1)
            nxy = np.stack([add((y[gram, k] > 0).astype(np.int64)) for k in range(y.shape[1])], 1)
            ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * y.shape[1])
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (sxy, nxy)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[first])), pa.array(add(x)), pa.array(add(x * x)), pa.array(np.diff(first, append=len(row))), *lists], ["doc_id", "sx", "sxx", "nx", "sxy", "nxy"])

    return run
