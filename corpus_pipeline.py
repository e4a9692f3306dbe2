"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns
of ``documents``, those of any other name as they were; ``lang`` is the predicted language from the first stage on, and ``n_chars`` follows the text.

* language: documents without a letter, or unlike every learned language, go.
* near_duplicates: of each group of near copies the document with the smallest id stays. Rows that share an id are
  one document and stay or go together; rows with a null id stay.
* decontaminate: words inside benchmark windows are cut out of the texts.
* pii: personal data is replaced by its kind in brackets.
* pack: token sequences along a Hilbert curve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import decontaminate as benchmark_windows
from driftwarden.llm import langid, neardup, packing
from driftwarden.llm import pii as personal_data
from driftwarden.llm.common import cut, held_out, prepare, table
from driftwarden.llm.queries import word_tokenizer


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose further columns have names that no operator uses; they get their own back last."""
    aside = {c: c if c in OWN else f"_aside_{k}" for k, c in enumerate(docs.columns)}
    done = work(docs.select(*(docs[f"`{a}`"].alias(b) for a, b in aside.items())))
    return done.select(*(F.col(b).alias(a) for a, b in aside.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = langid.fit(docs, ~held_out())
    return beside(docs, lambda d: langid.identify(d, model).where(~F.col("li_rejected")).withColumn("lang", F.col("li_lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = neardup.near_duplicates(docs).where("nd_kept").select(F.col("id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return beside(docs, lambda d: benchmark_windows.remove(d, benchmark).withColumn("n_chars", F.char_length("text").cast("long")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    finder = personal_data.fit(docs)
    return beside(docs, lambda d: personal_data.find(d, finder, redact=True).withColumn("text", F.col("pii_clean")).withColumn("n_chars", F.char_length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, word_tokenizer(), with_ids=False).withColumnRenamed("id", "doc_id").withColumnRenamed("tokens", "doc_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("pack", pack),
]

#: SQL expresses neither the language models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
