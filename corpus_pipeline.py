"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is
written as Parquet to the shared checkpoint folder and read again, so a lost executor
costs no more than the stage that runs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dimspark.llm.common import ensure_checkpoint_dir, read_table
from dimspark.llm.linededup import rewrite_documents
from dimspark.llm.mixing import mix_documents
from dimspark.llm.ngram_join import keep_one_of_each
from dimspark.llm.packing import pack_with_crc
from dimspark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the base rules and the learnt rules reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that three documents share out of all but the last of them."""
    return rewrite_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at a similarity of 0.8 or more."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights, dealt to shards and shuffled; a document that is drawn twice is there twice."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece."""
    return pack_with_crc(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The learnt thresholds, the mix and the packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages applied to documents, one after the other.

    folder: where stages are written, a new one in the shared folder unless named; with the folder of
    a run that broke off, the run goes on after the last stage that was written whole. A stage's
    rows are removed once the next ones are written.
    """
    folder = folder or f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [name for name, _ in STAGES[:-1]]
    done = max((k for k, name in enumerate(names) if files.exists(hadoop(f"{folder}/{name}/_SUCCESS"))), default=-1)
    docs = spark.read.parquet(f"{folder}/{names[done]}") if done >= 0 else read_table(spark, sf_dir, "documents")
    for k in range(done + 1, len(names)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{names[k]}")
        docs = spark.read.parquet(f"{folder}/{names[k]}")
        if k:
            files.delete(hadoop(f"{folder}/{names[k - 1]}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
