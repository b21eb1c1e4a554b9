"""A corpus pipeline of five stages, each of which reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixfield.llm import language, lines, mixing, packing, queries, simhash, substrings
from mixfield.llm.common import WORD, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with a new text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: those without text or without letters go.

    ``lang`` becomes the language found where the document had none.
    """
    profiles = language.fit(language.training_rows(docs))
    known = docs.where(F.col("text").isNotNull()).select(*COLUMNS)
    found = language.identify(known, profiles, keep=("lang", "source", "n_chars"))
    return found.where("lang_pred != 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of runs of lines; a document that has no line left goes."""
    found = lines.deduplicate(docs)
    return _with_text(found.where("n_removed < n_lines or n_removed = 0"), F.col("kept"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest doc_id, one without doc_id only if there is no other.

    Near copies share at least 0.8 of their 5-word shingles; they are found by SimHash fingerprints of parts of the shingles and verified. Rows
    are told apart by doc_id and text, so rows that are no copies of each other stay, also those without doc_id or with the same one.
    """
    found = written(simhash.near_texts(docs), "groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    # a row for each text, then one for each group: no group is gathered in a task
    first = found.groupBy("root", "node").agg(F.min(rank).alias("rank")).groupBy("root").agg(F.min("rank").alias("rank"))
    first = first.select(F.col("rank.doc_id").alias("_id"), F.col("rank.node").alias("_node"))
    counted = found.groupBy("doc_id", "node").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("_again"), F.col("node").alias("_node_again"))
    first = first.join(counted, F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_node") == F.col("_node_again")), "left")
    first = written(first.select("_id", "_node", F.col("_node_again").isNotNull().alias("_repeated")), "first")
    own = docs.select(*COLUMNS).withColumn("_own", simhash.text_hash(F.col("text")))
    at = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_node"))
    once = own.join(first.where("not _repeated"), at, "left_semi").select(*COLUMNS)
    # rows that are repeated with their doc_id and text
    again = first.where("_repeated")
    repeated = substrings.thinned(own, "_own", substrings.bitmap(again.select("_node"))).join(again, at, "left_semi").groupBy("doc_id", "_own").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return once.unionByName(repeated.select("doc_id", "row.*").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each reading of a document, with the words that the reading takes.

    A reading finds its document by doc_id, source and text, so documents without doc_id or with the same one are told apart. Rows that are alike in
    these are read as often as the mix says, and the other columns are those of one of them.
    """
    took = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_key"), "copies", F.col("size").alias("_size"), F.explode("passes").alias("_pass"))
    took = written(took, "readings")
    own = docs.select(*COLUMNS).withColumn("_own", mixing.text_key(F.col("text")))
    at = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_key"))
    rows = own.join(took.where("copies = 1"), at)
    again = took.where("copies > 1")
    repeated = own.join(again.select("_id", "_source", "_key").distinct(), at, "left_semi").groupBy("doc_id", "source", "_own").agg(F.min(F.struct("text", "lang", "n_chars")).alias("row"))
    repeated = repeated.select("doc_id", "row.text", "row.lang", "source", "row.n_chars", "_own")
    if not again.isEmpty():
        rows = rows.unionByName(repeated.join(again, at))
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), (F.col("_pass.first") + 1).cast("int"), F.col("_pass.words").cast("int"))
    return _with_text(rows, F.when(F.col("_pass.words") == F.col("_size"), F.col("text")).otherwise(F.array_join(words, " ")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, queries.ranks_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language profiles, the schedule and the packing have no counterpart in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
