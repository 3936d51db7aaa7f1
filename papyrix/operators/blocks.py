"""Compressed postings by Arrow batches: runs of sorted postings to a row of codes each, and back."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import codec

NUMBERS = 1 << 18  # postings that are decoded at once


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """Bytes cut at these ends."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """term, block and number of postings of each run of equal term and block, where it starts, and all ids and counts in order.

    Rows come in the order of ``key``, which a run has in common; terms that share one are told apart here, and ids sorted.
    """
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            rows, held, end = held, None, held.num_rows if held is not None else 0
        elif not batch.num_rows:
            continue
        else:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            end = int(np.searchsorted(key := _numbers(rows.column("key")), key[-1]))
            held, rows = rows.slice(end), rows.slice(0, end)
        if not end:
            continue
        term, block, ids = rows.column("term"), _numbers(rows.column("block")), _numbers(rows.column("doc_id"))
        code = _numbers(term.dictionary_encode().indices)
        order = np.lexsort((ids, block, code))
        code, block = code[order], block[order]
        starts = np.concatenate(([0], np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1))
        yield term.take(pa.array(order[starts])), block[starts], np.diff(starts, append=end), starts, ids[order], _numbers(rows.column("tf"))[order]


def encode_blocks(width: int):
    """key, term, block, doc_id, tf in the order of key to term, block, df, ids, counts; ids as gaps from the block's first possible id on."""

    def run(batches):
        for term, block, df, starts, ids, tf in runs(batches):
            gaps = np.diff(ids, prepend=0)
            gaps[starts] = ids[starts] - block * width
            upto = np.cumsum(codec.vbyte_sizes(gaps))
            codes, ends, _ = codec.gamma_rows(tf, df, True)
            yield pa.RecordBatch.from_arrays([term, pa.array(block), pa.array(df), _binary(codec.vbyte_array(gaps), upto[starts + df - 1]), _binary(codes, ends)], ["term", "block", "df", "ids", "counts"])

    return run


def encode(gaps: bool):
    """key, term, block, doc_id, tf in the order of key to term, block, df, first, last, rest, bits, counts.

    rest has the codes of all ids but the first, whose gap is not known here; counts are in plain gamma codes of so many bits.
    """

    def run(batches):
        for term, block, df, starts, ids, tf in runs(batches):
            if ids.min() < 0:
                raise ValueError("no code for a negative number")
            others = np.ones(len(ids), bool)
            others[starts] = False
            rest = (np.diff(ids, prepend=0) if gaps else ids)[others]
            upto = np.concatenate(([0], np.cumsum(codec.vbyte_sizes(rest))))
            codes, ends, bits = codec.gamma_rows(tf, df, False)
            yield pa.RecordBatch.from_arrays(
                [term, pa.array(block), pa.array(df), pa.array(ids[starts]), pa.array(ids[starts + df - 1]), _binary(codec.vbyte_array(rest), upto[np.cumsum(df - 1)]), pa.array(bits), _binary(codes, ends)],
                ["term", "block", "df", "first", "last", "rest", "bits", "counts"],
            )

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of NUMBERS postings about, one row at least, and their rows' df."""
    for batch in batches:
        upto, at = np.cumsum(_numbers(batch.column("df"))), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + NUMBERS, "right")))
            rows = batch.slice(at, end - at)
            yield rows, _numbers(rows.column("df"))
            at = end


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row's begin in them."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at[:-1] - at[0]


def _ids(rows: pa.RecordBatch, df: np.ndarray, base: np.ndarray, gaps: bool) -> np.ndarray:
    """Ids of the rows' codes, from each row's base on."""
    numbers = codec.un_vbyte_array(_bytes(rows.column("ids"))[0])
    if not gaps:
        return numbers
    sums, ends = np.cumsum(numbers), np.cumsum(df)
    return sums + np.repeat(base - np.concatenate(([0], sums[ends[:-1] - 1])), df)


def decode_blocks(width: int):
    def run(batches):
        for rows, df in slices(batches):
            ids = _ids(rows, df, _numbers(rows.column("block")) * width, True)
            tf = codec.un_gamma_rows(*_bytes(rows.column("counts")), df)
            yield pa.RecordBatch.from_arrays([rows.column("term").take(pa.array(np.repeat(np.arange(len(df)), df))), pa.array(ids), pa.array(tf)], ["term", "doc_id", "tf"])

    return run


def decode(gaps: bool):
    def run(batches):
        for rows, df in slices(batches):
            ids = _ids(rows, df, _numbers(rows.column("base")), gaps)
            yield pa.RecordBatch.from_arrays([rows.column("term").take(pa.array(np.repeat(np.arange(len(df)), df))), pa.array(ids)], ["term", "doc_id"])

    return run
