"""From raw documents to a mixed, tokenised corpus: toxicity, exact dedup, near-duplicates, mixing, encoding.

Every stage takes null and repeated ids, null, empty and very long texts, repeated rows, columns of any other name and empty
tables; what becomes of them is said with each. All but the last return the columns that they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.llm.common import table, written
from spectralake.llm.exact_dedup import keep_first
from spectralake.llm.jaccard_join import keep_representatives
from spectralake.llm.mixing import mixed
from spectralake.llm.piece_codec import encode_pieces
from spectralake.llm.queries import pieces
from spectralake.llm.toxicity import fit_toxicity, without_toxic
from spectralake.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects at the threshold of their language go.

    Null and empty texts are scored as texts without words; ids play no part; of labels that are null or name no document
    nothing is learned, and with too few labels nothing goes.
    """
    ship(spark)
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the document with the smallest id stays, of its repeated rows one; a null id only where its group has no other."""
    ship(spark)
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; texts without words, and rows without an id, stay."""
    ship(spark)
    return keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domain, language and source ask for; null lang and source are names of their own."""
    ship(spark)
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with whether they decode to it again; null texts have null ids."""
    ship(spark)
    coded = encode_pieces(docs, pieces(spark), verify=True)
    return coded.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "n_bytes", F.round("score", 4).alias("score"), "round_trip")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near duplicates", drop_near_copies), ("source mixing", mix), ("piece encoding", encode)]

#: The first stage is a trained classifier, which SQL does not express; the tests recompute what stages 1 to 4 keep in plain Python,
#: and that the fifth decodes to its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
