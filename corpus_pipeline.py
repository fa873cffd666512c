"""Corpus cleaning in five stages, each one of the corpus operators over whole tables.

Every stage decides by row: rows have a key of their own, the doc_id where doc_ids are distinct
and not null, else a number in order of doc_id, written with the rows. So rows that repeat a doc_id, or
have none, are documents of their own. A stage gives the columns of its input, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontam, language_mix, lsh_forest, passages
from lattica.llm.common import cut, free_name, give_back_heaps, remainder, table


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of distinct keys, and its name."""
    key = free_name(docs.columns, "key")
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    return cut(docs.orderBy(F.asc_nulls_last("doc_id")).withColumn(key, F.monotonically_increasing_id())), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't a doc_id of gone, without the key."""
    columns, other = [c for c in docs.columns if c != key], free_name(docs.columns, "gone")
    return docs.join(cut(gone.select(F.col("doc_id").alias(other)).distinct()), F.col(key) == F.col(other), "left_anti").select(*columns)


def _texts(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col("text").alias("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letters) go; so do those whose mixture
    gives no language at least 0.2. The lang column stays as it is."""
    give_back_heaps(spark)
    keyed, key = _keyed(docs)
    model = language_mix.fit(docs.select("text", "lang").where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))))
    return _without(keyed, key, language_mix.identify(_texts(keyed, key), model).where("lang_pred = 'und' or score < 0.2"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 over five-word shingles the row of the smallest key
    stays; rows with null or blank texts are in no group."""
    give_back_heaps(spark)
    keyed, key = _keyed(docs)
    return _without(keyed, key, lsh_forest.near_duplicates(_texts(keyed, key), width=5, percent=80).where("not kept"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a row of smaller key has go from the text, and so does a row of which no word is
    left; n_chars follows. Null texts stay."""
    give_back_heaps(spark)
    keyed, key = _keyed(docs)
    own = free_name(keyed.columns, "id")
    named = keyed.select(*(F.col(f"`{c}`").alias("doc_id" if c == key else own if c.lower() == "doc_id" else c) for c in keyed.columns))
    found = passages.repeated(_texts(keyed, key))
    give_back_heaps(spark)
    left = passages.remove(named, found)
    column = lambda c: F.length("text").cast(left.schema[c].dataType) if c.lower() == "n_chars" else F.col(f"`{own if c.lower() == 'doc_id' else c}`")
    return left.select(*(column(c).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    give_back_heaps(spark)
    keyed, key = _keyed(docs)
    return _without(keyed, key, decontam.contaminated(_texts(keyed, key), table(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining row's token ids, their count, and digests of ids and of what they decode to."""
    import public_tokenizers

    give_back_heaps(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, with_ids=True, pack=5_000_000, ahead_of=100_000)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Mixtures, chaining and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
