"""From raw documents to packed sequences: five stages, each a table that the next one reads.

Edge cases, for every stage: an empty table stays empty; a null text counts as empty; ids
may be null or repeated, and rows are then told apart by their texts; texts of any length
are read whole; further columns are handed through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, packing, quality, simhash, suffixes
from tidewright.llm.queries import documents, tokenizer_path
from tidewright.scratch import discard, keep, tables_made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go: by id and text, so rows equal in both go or stay together; null and empty texts go."""
    return quality.filter_quality(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (lower-casing A-Z) one row stays, that with the smallest id; null ids count as the largest."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sharing at least 0.8 of their five-word shingles the one with the smallest id stays; rows with a null id all stay."""
    return simhash.drop_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that a document with a smaller id has go, in whole characters; every row stays, if need be with an empty text. Rows of one id do not remove each other's; null ids count as the largest."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = suffixes.remove_repeated_strings(docs, carry=others, as_text=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("left"), "n_chars": F.length("left").cast("bigint")}
    return out.select(*[new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, by retrieval; every row's ids and end mark lie in some, repeated rows' too."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("simhash near-dedup", near_duplicates), ("suffix-array dedup", repeated_strings), ("packing", packed)]

#: No SQL expresses the vantage-point trees or the retrieval; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents; scratch tables of earlier stages are removed."""
    docs = documents(spark, sf_dir)
    with tables_made() as made:
        for name, stage in STAGES:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
            discard(spark, made[:-1])
            del made[:-1]
    return docs
