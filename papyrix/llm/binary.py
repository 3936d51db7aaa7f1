"""Token-id output: every document compressed by itself with a shared, trained zstandard dictionary.

A file's rows are blocks of documents in ascending doc_id order (null ids first): the dictionary's hash, the id width, the
smallest and largest doc_id, an index of (doc_id, byte offset, number of ids) and the compressed documents end to end. Any
document is read from its block by one slice and one decompression (``lookup``). Blocks are Parquet rows of bounded numbers
of documents and bytes, so the writer's commit survives lost executors.

Defined results: a null or empty text holds only the end id; repeated rows are written one by one, in any order; an empty
table gives an empty archive with an empty dictionary; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 512  # documents in a block, at most
BLOCK_BYTES = 8 << 20  # compressed bytes in a block, but for one longer document
SAMPLE = 2000  # documents that the dictionary is trained on, at most (the smallest hashes of id and text); of each a run of SAMPLE_IDS ids
SAMPLE_IDS = 2048
DICTIONARY = 65536
ROWS_A_FILE = 2_000_000


def _serial(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train(docs: DataFrame, path: str, width: int, total: int) -> bytes:
    """The dictionary, of ids of a bounded sample of documents. Where zstandard finds too few ids to train on, they are the
    dictionary themselves."""
    import zstandard

    def run(batches):
        import pyarrow as pa

        encode = tokens.tokenizer(path).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_serial(encode(x.as_py())[: 4 * SAMPLE_IDS], width) for x in batch.column(1)], pa.binary())], ["named", "ids"])

    named = F.xxhash64("doc_id", "text")
    share = int(min(1.0, 1.5 * SAMPLE / max(total, 1)) * (1 << 30)) + 1
    picked = docs.where(F.pmod(named, F.lit(1 << 30)) < share).select(named.alias("named"), "text").mapInArrow(run, "named long, ids binary")
    samples = sorted(bytes(r.ids) for r in picked.orderBy("named", "ids").limit(SAMPLE).collect() if r.ids)
    size = min(DICTIONARY, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def write(docs: DataFrame, out: str, tokenizer_path: str | None = None, end_id: int = 1) -> None:
    """Write the archive of a table with doc_id and text to the folder ``out``."""
    path = tokenizer_path or tokens.default_path()
    spark = docs.sparkSession
    common.arrow_batches(spark)
    width = 2 if tokens.tokenizer(path).size <= 65536 else 4
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.count()
    dictionary = train(docs, path, width, total)
    digest = hashlib.sha256(dictionary).hexdigest()

    def encoded(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40  # tells repeated rows apart, so that they can be dealt out

        encode, end = tokens.tokenizer(path).encode, array("I", [end_id]).tobytes()
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=False, write_dict_id=False)
        for batch in batches:
            counts, data = [], []
            for x in batch.column(1):
                ids = encode(x.as_py()) + end
                counts.append(len(ids) // 4)
                data.append(press.compress(_serial(ids, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(row, row + len(data)), pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "row", "n_tokens", "data"])
            row += len(data)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        file, at = TaskContext.get().partitionId(), 0

        def block(rows):
            nonlocal at
            ids, counts, data = zip(*rows)
            offsets = np.cumsum([0, *map(len, data)])
            named = [i for i in ids if i is not None]
            made = {"file": file, "block": at, "first": min(named, default=None), "last": max(named, default=None), "dictionary_hash": digest, "width": width, "tokens": sum(counts), "index": [{"doc_id": a, "offset": int(b), "n_tokens": c} for a, b, c in zip(ids, offsets, counts)], "data": b"".join(data)}
            at += 1
            index = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))
            return pa.RecordBatch.from_pylist([made], pa.schema([("file", pa.int32()), *((x, pa.int64()) for x in ("block", "first", "last")), ("dictionary_hash", pa.string()), ("width", pa.int32()), ("tokens", pa.int64()), ("index", index), ("data", pa.binary())]))

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and (len(held) == BLOCK or size + len(row[2]) > BLOCK_BYTES):
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield block(held)

    staged, at = common.stage(docs.mapInArrow(encoded, "doc_id long, row long, n_tokens long, data binary"), "encoded")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_A_FILE))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ordered = staged.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "data")
    ordered.mapInArrow(blocks, "file int, block long, first long, last long, dictionary_hash string, width int, tokens long, index array<struct<doc_id:long,offset:long,n_tokens:long>>, data binary").write.option("compression", "none").parquet(f"{out}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    common.remove(spark, at)


def _dictionary(spark, path: str) -> tuple[bytes, str]:
    held = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(held.dictionary)).hexdigest() != held.dictionary_hash:
        raise ValueError("the dictionary does not have the hash it is stored under")
    return bytes(held.dictionary), held.dictionary_hash


def lookup(spark, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one doc_id: blocks are found by the smallest and largest id that Parquet's statistics know,
    and of those only the document's own slice is decompressed. None where the archive has no such document."""
    import zstandard

    dictionary, digest = _dictionary(spark, path)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("file", "block")
    ends = F.transform("index", lambda x, k: F.coalesce(F.get("index", k + 1)["offset"], F.octet_length("data").cast("long")))
    rows = blocks.select("dictionary_hash", "width", "data", F.explode(F.arrays_zip(F.col("index").alias("of"), ends.alias("end"))).alias("x")).where(F.col("x.of.doc_id") == doc_id)
    out = []
    for r in rows.select("dictionary_hash", "width", F.substring("data", (F.col("x.of.offset") + 1).cast("int"), (F.col("x.end") - F.col("x.of.offset")).cast("int")).alias("part")).toLocalIterator():
        if r.dictionary_hash != digest:
            raise ValueError(f"document {doc_id} needs dictionary {r.dictionary_hash}")
        out.append(np.frombuffer(press.decompress(bytes(r.part)), f"<u{r.width}").tolist())
    return out


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document of an archive.

    Ids before a block come from two sums: of the files (few, on the driver) and of the blocks within each file.
    """
    dictionary, digest = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    before, total = {}, 0
    for row in blocks.groupBy("file").agg(F.sum("tokens").alias("n")).orderBy("file").collect():
        before[row.file], total = total, total + row.n
    from pyspark.sql import Window

    sums = blocks.select("file", "block", F.sum("tokens").over(Window.partitionBy("file").orderBy("block")).alias("_upto")) if before else blocks.select("file", "block", F.col("tokens").alias("_upto"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError(f"block {row['file']}/{row['block']} needs dictionary {row['dictionary_hash']}")
                start, data, index = before[row["file"]] + row["_upto"] - row["tokens"], row["data"], row["index"]
                out: list[list] = [[], [], [], []]
                for one, ends in zip(index, [*(x["offset"] for x in index[1:]), len(data)]):
                    ids = np.frombuffer(press.decompress(data[one["offset"] : ends]), f"<u{row['width']}").astype("<u4").tobytes()
                    if len(ids) != 4 * one["n_tokens"]:
                        raise ValueError(f"document {one['doc_id']} does not have the length in its index")
                    for column, value in zip(out, (one["doc_id"], start, one["n_tokens"], ids)):
                        column.append(value)
                    start += one["n_tokens"]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(F.broadcast(sums) if total < 2_000_000_000 else sums, ["file", "block"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_binary(spark, sf_dir: str) -> DataFrame:
    import uuid

    out = f"{common.shared_dir(spark)}/papyrix/tokens-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), out)
    return read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
