"""From raw documents to encoded training text: five stages over the operators of blocklens.llm.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written
and read again as the next stage's ``docs``.  Texts of any length are handled
whole, empty tables give empty tables, and columns besides ``COLUMNS`` are left
behind by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm._common import Scratch, table
from blocklens.llm.exact_dedup import exact_dedup
from blocklens.llm.ngram_join import ngram_join, row_key
from blocklens.llm.pareto_mix import length_rate, pareto_mix
from blocklens.llm.piece_bpe import encode_decode
from blocklens.llm.toxicity import fit, sample, score_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids and keys of rows up to this many may be broadcast (16 bytes each); beyond it the join is dealt out.
_BROADCAST_ROWS = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Labels of one kind alone (or none) give no classifier, and then all stay.
    Null and empty texts stay; repeated rows are judged one by one.
    """
    model = fit(sample(docs, table(spark, sf_dir, "labels")))
    if model.table is None:
        return docs.select(COLUMNS)
    return score_texts(docs.select(COLUMNS), model, carry=True).filter("_predicted = 0").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document stays: the one with the smallest id (null ids last, of repeated rows any one).

    Null, empty and blank texts are equal where their white space runs are.
    """
    return exact_dedup(docs.select(COLUMNS), carry=True).filter("_kept").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest id.

    Rows go by id and text together, so a row that only shares its id with a
    near copy stays; rows without words are no copies of anything.
    """
    scratch = Scratch(spark, "pipeline-near")
    docs = docs.select(COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    joined = ngram_join(docs, n=5, threshold=(4, 5), stays=True)
    gone = scratch.save(joined.filter("NOT stays").select(F.col("doc_id").alias("_gone"), F.col("row_key").alias("_gone_key")).distinct(), "gone")
    few = gone.count() <= _BROADCAST_ROWS
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (row_key("doc_id", "text") == F.col("_gone_key"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a row for each copy that the mix takes.

    A null source is a source of its own; a repeated row is drawn on its own.
    """
    taken = pareto_mix(docs.select(COLUMNS), weights=(5, 2, 1), cap=3.0, seed="mix", rate=length_rate, carry=True)
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_taken_copies").cast("int")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix encoded, checked and decoded again: number of ids, and digests; null text counts as empty."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mix", mix), ("encode", encode)]

#: Neither the classifier nor the encoder can be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
    return docs
