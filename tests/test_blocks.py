"""Compressed postings in blocks against the codes of whole lists, in plain Python."""

import numpy as np
import pyarrow as pa

from papyrix.functions import codec
from papyrix.operators import blocks, index

LISTS = {"a": [(k * 30_011, 1 + k % 9) for k in range(40)], "b": [(0, 1), (1 << 40, 70_000)], "c": [(65_535, 2), (65_536, 1), (65_537, 300)]}


def _posts(spark):
    return spark.createDataFrame([(i, t, n) for t, rows in LISTS.items() for i, n in rows], "doc_id long, term string, tf long")


def test_blocks_of_a_term_joined_are_its_whole_code(spark):
    for gaps in (True, False):
        made = index.compress(_posts(spark), gaps)
        rows = sorted(made.collect(), key=lambda r: (r.term, r.block))
        for term, want in LISTS.items():
            mine, ids = [r for r in rows if r.term == term], [i for i, _ in want]
            assert len(mine) == len({i // index.BLOCK_IDS for i in ids}) and sum(r.df for r in mine) == len(ids)
            assert b"".join(r.ids for r in mine) == codec.vbyte_encode(codec.dgaps(ids) if gaps else ids)
            bits = "".join("".join(f"{b:08b}" for b in r.counts)[: r.bits] for r in mine)
            whole = codec.gamma_encode([n for _, n in want])
            assert bits + "0" * (-len(bits) % 8) == "".join(f"{b:08b}" for b in whole)
        assert sorted(map(tuple, index.decompress(made, gaps).collect())) == sorted((t, i) for t, r in LISTS.items() for i, _ in r)


def test_blocks_round_trip_with_counts(spark):
    got = index.decompress_blocks(index.compress_blocks(_posts(spark))).collect()
    assert sorted(map(tuple, got)) == sorted((t, i, n) for t, rows in LISTS.items() for i, n in rows)


def test_codes_of_many_lists_are_read_at_once():
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 1 << rng.integers(1, 30), n) for n in (1, 2, 700, 1, 65)]
    numbers, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
    for readable in (True, False):
        data, ends, _ = codec.gamma_rows(numbers, sizes, readable)
        cut = [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        assert cut == [codec.elias_array(x) if readable else codec.gamma_encode(x.tolist()) for x in lists]
        if readable:
            assert codec.un_gamma_rows(np.frombuffer(data, np.uint8), np.append(0, ends[:-1]), sizes).tolist() == numbers.tolist()


def test_runs_over_batches_and_terms_of_one_key():
    rows = [(1, "x", 0, 5, 1), (1, "y", 0, 2, 2), (1, "x", 0, 3, 1), (1, "x", 1, 70_000, 4), (2, "z", 0, 9, 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "term", "block", "doc_id", "tf"), r))]) for r in rows]
    made = pa.Table.from_batches(blocks.encode_blocks(index.BLOCK_IDS)(iter(batches))).combine_chunks().to_batches()
    back = pa.Table.from_batches(blocks.decode_blocks(index.BLOCK_IDS)(iter(made))).to_pylist()
    assert sorted((r["term"], r["doc_id"], r["tf"]) for r in back) == sorted((t, i, n) for _, t, _, i, n in rows)
