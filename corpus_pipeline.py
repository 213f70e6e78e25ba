"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import jaccard, mixing, packing, pii, queries, superminhash, toxicity
from tilewright.llm.common import free_name, quoted, written

TOXIC = 0.5
#: Near duplicates share so many hundredths of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, with a model of the labelled ones. Null and empty texts stay.

    Repeated rows and rows without an id are scored each. Other columns, whatever their names, are kept.
    """
    model = toxicity.fit(docs.select(F.col("doc_id").cast("long"), "text"), queries.toxic_labels(spark, sf_dir))
    name = free_name("toxicity", docs.columns)
    return toxicity.score(docs, model, name).where(F.col(name) < TOXIC).select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, with the smallest id; similar by their sets of 5-word shingles,
    which share eight tenths, as the prefix trees of the join find them in groups of candidates.

    Candidates are the sets that agree in a band of a SuperMinHash signature, which links at eight tenths miss once in ten million times:
    the parts that the join itself deals by hold three elements at that share, and join texts that only have a passage in common.

    Texts without words are in no group and all stay. Rows that share an id and have different texts are different
    documents; of equal ones one stays. Rows without an id stay where no row of their group has one, one of each
    group. Other columns, whatever their names, are kept.
    """
    return jaccard.first_of_groups(docs, NEAR_WORDS, NEAR_PERCENT, superminhash.grouped)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the names of their kinds.

    Null and empty texts stay as they are, repeated rows each stay. Other columns, whatever their names, are kept.
    """
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, in its order.

    Texts without words stay once, a null source is one of its own. Other columns, whatever their names, are kept.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. Null and empty texts have their closing id; other columns are left."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: The stages learn models, follow links and use a tokenizer, none of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
