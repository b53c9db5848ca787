"""A training corpus from documents: language ID, n-gram Jaccard join, benchmark decontamination, packing.

Every stage takes all rows its predecessor kept; all but the last return the columns of ``documents``, others
that the table has besides included. Null and empty texts are ``und`` and go in the first stage; rows without
doc_id pass the second. That goes by rows: of repeated rows one stays, and unlike texts of one id all stay. Empty tables give empty tables; texts of any length
count whole; of near-duplicates the smallest doc_id stays, so no tie arises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, jaccard, langid, packing
from cloakwork.llm.common import materialise, table
from cloakwork.plans.tables import numbered

#: A prediction of less confidence rejects the document, as does ``und``.
LEAST_SCORE = 0.3
#: Up to so many ids of rejected documents are broadcast; beyond it they are joined by shuffle.
BROADCAST_IDS = 200_000
#: The column of row numbers where ids repeat.
ROW = "pipeline_row_number"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told; a null lang gets the language found."""
    model = langid.learn(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    told = langid.predict(docs, model).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document with the smallest id, once."""
    given = docs
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        # Rows of one id are told apart by a number of their own, in the order of ids and texts.
        given = materialise(numbered(docs, ["doc_id", "text"], name=ROW), "pipeline-rows")
        docs = given.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.col(ROW)))
    found = materialise(jaccard.near_duplicates(docs), "pipeline-groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(ROW if ROW in given.columns else "doc_id")).distinct()
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return given.join(gone, gone.columns, "left_anti").select(*[c for c in given.columns if c != ROW])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 1024 ids."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("packing", pack)]

#: Learned models, tokenizers and edit distances are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
