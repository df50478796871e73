"""The corpus pipeline: documents through five stages, each written and reread.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame; all but the last
return the columns of documents.  Language identification drops texts without
a language; the Jaccard join keeps the document with the smallest id of each
group; decontamination drops documents that hold a benchmark passage; personal
data is replaced by its kind; packing returns the pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, jaccard_join, language, packing, pii
from trackloom.llm.common import saved, scope, table
from trackloom.llm.entry import tokenizer_path
from trackloom.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found (``und``); the column lang keeps its value."""
    ship(spark)
    found = language.label(docs, language.train(docs), keep=docs.columns)
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest id, of each component.

    Rows are told apart by a 64-bit hash of all their columns, so unlike texts
    under one id are judged each by itself; equal rows are one.  A row without
    an id cannot be named, so it stays.
    """
    ship(spark)
    row = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    rows = docs.where("doc_id is not null").withColumn("_row", row)
    groups, _ = saved(jaccard_join.jaccard_components(rows, id_col="_row"), "components")
    ids = rows.select("_row", "doc_id").distinct()
    named = groups.select(F.col("doc_id").alias("_row"), "component_id").distinct().join(ids, "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("least")).select("least._row")
    kept = rows.join(first, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; a row without an id stays."""
    hits, _ = saved(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), "hits")
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the text."""
    ship(spark)
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: No SQL expresses these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        # What a stage made for itself goes once its result is written, and so does the table it read.
        with scope(spark) as made:
            docs, path = saved(stage(spark, docs, sf_dir), name)
            made.remove(path)
            if old:
                made.append(old)
        old = path
    return docs
