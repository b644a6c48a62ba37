"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), is given what its predecessor kept and returns a DataFrame; all but the last return the columns of documents.

Defined results, for all stages: a null or empty text is kept by toxicity, line dedup and near-dedup, takes no words of the mix and so is not of it; repeated rows are documents each for itself, of which
near-dedup keeps the first; null ids and sources are kept, a null source is a source of its own; texts of any length go through whole; ties are broken by doc_id or by the order of rows; an empty table gives no rows;
further columns pass through to the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import lines, mixing, packing, sketches, toxicity
from rillstone.llm.common import cut, table


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go; it is trained on the labelled documents of the corpus."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of three lines, or of fifty words, that stand earlier in the corpus go, and lines that recur by themselves or ends of longer lines that do; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = lines.drop_repeated_lines(docs)
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in out.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return sketches.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their weights; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = mixing.mix(docs)
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in out.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 4,096 tokens: doc_id, piece, start, length, checksum, sequence and place in it. A document of several epochs has the pieces of each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", filter_toxic),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Compression lengths, sketches and tokens are beyond SQL; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
