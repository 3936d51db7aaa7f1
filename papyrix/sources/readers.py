"""Text collections as tables, and the writers of their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """doc_id, name, text: one file a document. The id is a hash of the name, so it does not depend on listing order."""
    rows = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("name"), F.col("value").alias("text"))


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """doc{i}.txt files; the id is i."""
    rows = whole_files(spark, path, "doc*.txt", recursive=False)
    return rows.select(F.regexp_extract("name", r"doc(\d+)\.txt$", 1).cast("long").alias("doc_id"), "name", "text")


def bytes_as_text(spark: SparkSession, path: str, charset: str = "UTF-8", drop_invalid: bool = True, glob: str = "*") -> DataFrame:
    """name, text of files in a charset; bytes that are not valid UTF-8 are dropped rather than replaced, a U+FFFD of the file's stays.

    Genuine ones are held as the noncharacter U+FDD0 meanwhile, which no text is to hold.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    if charset.upper() != "UTF-8":
        return rows.select(F.col("path").alias("name"), F.decode("content", charset).alias("text"))
    if not drop_invalid:
        return rows.select(F.col("path").alias("name"), F.expr("make_valid_utf8(CAST(content AS STRING))").alias("text"))
    held = F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\xef\xbf\xbd"), F.lit("\xef\xb7\x90")), "ISO-8859-1")
    return rows.select(F.col("path").alias("name"), held.alias("content")).select("name", F.translate(F.expr("make_valid_utf8(CAST(content AS STRING))"), "\ufdd0\ufffd", "\ufffd").alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of the lines that are not blank, trimmed."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.trim("line").alias("line")).where("line <> ''")


def trec(texts: DataFrame, compat: bool = False) -> DataFrame:
    """doc_id, text of TREC markup in a column ``text``. compat lower-cases, glues lines without a space and keeps the end tag."""
    bodies = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<doc>(.*?</doc>)"), F.lit(1))).alias("b"))
    doc_id = F.regexp_extract("b", r"(?i)<docno>\s*(\d+)\s*</docno>", 1).cast("long")
    body = F.regexp_replace("b", r"(?is)<docno>.*?</docno>", "")
    if compat:
        return bodies.select(doc_id.alias("doc_id"), F.lower(F.regexp_replace(body, r"\s*\n\s*", "")).alias("text"))
    return bodies.select(doc_id.alias("doc_id"), F.trim(F.regexp_replace(F.regexp_replace(body, r"(?i)</doc>", ""), r"\s*\n\s*", " ")).alias("text"))


def dump(rows: DataFrame) -> DataFrame:
    """term, df, docs of lines ``term:df:id,id,``."""
    p = F.split("value", ":")
    ids = F.transform(F.filter(F.split(F.element_at(p, 3), ","), lambda x: F.trim(x) != ""), lambda x: x.cast("long"))
    return rows.select(F.element_at(p, 1).alias("term"), F.element_at(p, 2).cast("long").alias("df"), F.sort_array(ids).alias("docs"))


def write_terms(vocab: DataFrame, path: str) -> None:
    """Lines ``term cf df`` in the order of terms."""
    vocab.orderBy("term").select(F.concat_ws(" ", "term", "cf", "df").alias("value")).write.mode("overwrite").text(path)


def write_words(words: DataFrame, path: str, column: str = "term") -> None:
    """A word a line, in order."""
    words.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Lines ``name value`` of a table of one row."""
    stats.select(F.explode(F.array(*[F.concat_ws(" ", F.lit(c), F.col(c).cast("string")) for c in stats.columns])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rel of judgement files: lines ``qid any doc_id rel``."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(p, 1).alias("qid"), F.element_at(p, 3).alias("doc_id"), F.element_at(p, 4).cast("int").alias("rel"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """qid, query of topic files: lines ``qid<tab or space>query``."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("qid"), F.trim(F.regexp_replace("value", r"^\s*\S+\s*", "")).alias("query"))


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_index(posts: DataFrame, path: str, parts: int | None = None) -> None:
    """Postings ranged and sorted by term, so a pushed ``term`` filter reads few row groups."""
    (posts.repartitionByRange(parts, "term") if parts else posts.repartitionByRange("term")).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, *terms: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("term").isin(*terms)) if terms else rows
