"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns the documents of the token files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import contamination, mixing, neardup, tokens, toxicity
from skylattice.storage import materialise


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. Labels of documents that aren't here teach nothing.

    Null and empty texts have the score of texts without known terms, drawn towards the toxic rate of the examples; repeated
    rows get equal scores and go or stay together; long texts are scored as a whole; without labels all stay. Extra columns
    are kept, whatever their names; an empty table gives no rows."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, index)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of Jaccard similarity 0.8 on five words stays, that of the smallest doc_id.

    Null and empty texts are one group. A null id comes last; of equal ids the smallest text hash stays, then the smallest
    hash of the other columns, and one of rows that are equal in all. Long texts are compared as a whole. Extra columns
    are kept, but ``__text_hash``, ``__other``, ``__id``, ``__hash`` and ``__rest`` are reserved; an empty table gives no
    rows."""
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go.

    Null and empty texts hold no item and stay; repeated rows go or stay together; long texts are searched as a whole.
    Null and empty items are found nowhere. Extra columns are kept; an empty table gives no rows."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass in which the mix takes a document, in order of training position.

    A null source is a source, the last one. Texts without words, null ones included, have no place in the mix and go; the
    mix takes whole documents, long ones too. Rows equal in id and text share positions and are taken one by one. Extra
    columns are kept, but names that begin with ``__mix`` are reserved; an empty table gives no rows."""
    return mixing.mixed_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in its order, and their documents as read back: doc_id, start, n_tokens, ids_crc32 and
    shard. The order is that of the stored rows.

    A null or empty text is its end id alone; each row is a document, repeated ones too; a null id stays null; long texts
    are encoded as a whole. Other columns go; an empty table gives no rows."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files
        docs = materialise(docs, "mixed")
    return tokens.encode_corpus(docs, tokens.tokenizer_path(), stored_order=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", encode_tokens),
]

#: Nearest-example scores, SimHash components and byte-pair encoding have no SQL form; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
