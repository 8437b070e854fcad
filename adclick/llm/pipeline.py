"""The stages of the corpus pipeline, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Other columns of ``docs`` play no part.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adclick.llm import language_id
from adclick.llm.bloom import may_hold
from adclick.llm.bpe import encode_and_decode
from adclick.llm.decontaminate import find_benchmark
from adclick.llm.near_dedup import near_duplicates
from adclick.llm.substring_dedup import remove_repeated
from adclick.llm.tables import table
from adclick.sources.scratch import discard, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and the least similarity, in percent, of near duplicates.
SHINGLE, SIMILAR = 5, 80
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. It learns from documents
    that name their language; those go that have no letter, or to which it gives a
    lower score than to any labelled document kept out of its training."""
    network = language_id.fit(docs, "doc_id", F.lit(True), bounded=True)
    found = language_id.identify(docs.select(*COLUMNS), network)
    known = F.col("lang_pred") != language_id.UNKNOWN
    return found.where(known & (F.col("score") >= (network.bound if network else 0.0))).select(*COLUMNS)


def _row_digest() -> Column:
    """128 bits of the id and the text of a row."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id,
    of several with that id or of a class without ids the one whose row has the
    least digest. Documents without words are in no class and stay; of those
    equal in id and text one does.

    Only digests of rows are grouped and joined. Rows that may have to go, by a
    Bloom filter of those that do, are looked up exactly; the others stay where
    they are.
    """
    rows = docs.select(*COLUMNS).withColumn("__row", _row_digest())
    found = near_duplicates(rows, "doc_id", size=SHINGLE, percent=SIMILAR, row="__row")
    own = F.coalesce("class_id", F.col("__row").cast("binary")).alias("class")
    once = found.groupBy("__row", own).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    once = materialise(once, "rows")
    # an order in which null ids come last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__row")))["__row"]
    stays = materialise(once.groupBy("class").agg(least.alias("__row")).select("__row"), "stays")
    gone = once.join(stays, "__row", "left_anti").select("__row")
    doubtful = gone.unionAll(once.where("n > 1").select("__row")).select(F.xxhash64("__row").alias("h"))
    doubt = may_hold(doubtful)(F.xxhash64("__row"))
    looked_up = rows.where(doubt).dropDuplicates(["__row"]).join(stays.hint("merge"), "__row", "left_semi")
    discard(once)
    return rows.where(~doubt).unionByName(looked_up).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; n_chars follows.
    Documents in which nothing is repeated keep their text as it is."""
    found = remove_repeated(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = find_benchmark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.col("n_hit") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and a digest of the text they decode to."""
    coded = encode_and_decode(
        docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    )
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: A trained network and subword tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared scratch folder
    and read again, and goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
