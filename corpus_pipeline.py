"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

A stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainframe.llm import decontaminate, langid, packing, simhash, substring
from rainframe.llm.shared import materialize, release, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of 8 MB, or one text, and of 2000 rows at most: a batch is held several times on its way."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or of no language with half of the posterior mass, go. Rows are judged
    by their text alone, so repeated rows and ids are judged alike; if no row can be learned from, all go."""
    in_small_batches(spark)
    return langid.keep_known(docs.select(COLUMNS), least=0.5)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five words, the one with the least doc_id stays (null ids last, then by a hash of
    the text). Null and wordless texts are alike; rows alike in id and text are one, unlike rows of one id are not."""
    in_small_batches(spark)
    begin = written()
    kept = simhash.keep_one_similar(docs.select(COLUMNS))
    release(spark, begin)  # kept rests on the last table only
    return kept


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that stand elsewhere too are cut; n_chars follows; documents with no word left go."""
    in_small_batches(spark)
    cut = substring.remove_repeats(docs.select(COLUMNS), k=35, anchor=12)
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.where((F.col("n_removed") == 0) | (F.col("text") != "")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words one in twenty or more stand in 13-word windows of benchmark items go."""
    in_small_batches(spark)
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens with the sources in the proportions of the corpus that is left. Null texts are one token; null sources
    are one source; repeated rows are packed each; an empty table gives no sequence."""
    in_small_batches(spark)
    return packing.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixture packing", mixture_packing),
]

#: Models and fingerprints are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. When a stage is written, the tables that it and those before it needed go."""
    begin = written()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
        release(spark, begin)
    return STAGES[-1][1](spark, docs, sf_dir)
