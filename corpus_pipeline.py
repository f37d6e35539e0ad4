"""The corpus pipeline: each stage reads what its predecessor kept and writes what the next one reads.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Defined cases, for every stage: an empty table gives an empty result; columns beyond those of documents are dropped, whatever their names;
texts are read whole, of any length; rows are rows, so repeated rows are treated alike and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.mixing import mix_documents
from gaugeframe.llm.near_dedup import near_duplicate_components
from gaugeframe.llm.passages import removed_spans, repeated_passages, without_passages
from gaugeframe.llm.piece_bpe import encode_documents
from gaugeframe.llm.queries import coded_digests, piece_model
from gaugeframe.llm.toxicity import fit_toxicity, without_toxic
from gaugeframe.sources.scratch import materialize, scratch_scope, written_side

#: Numbers of a written side of a join that may be broadcast.
BROADCAST_VALUES = 2_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    A null or empty text has the bias as its score, a null doc_id is scored like any other; rows of one doc_id are judged each by its own text.
    """
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(spark, docs.select(*COLUMNS), machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Documents without words (null, empty, white space) are near nothing and stay, and so do rows without a doc_id; rows of one doc_id
    stay or go together.
    """
    with scratch_scope(spark) as keep:
        found = near_duplicate_components(spark, docs, shingle_words=5, percent=80)
        gone = keep(written_side(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "near-copies", BROADCAST_VALUES))
    return docs.select(*COLUMNS).join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in one of them; every document stays, with what is left of its text.

    The smallest doc_id keeps a passage.  A null text stays null, an empty one empty; repetition inside a document is left, rows of one
    doc_id count as one document, those without a doc_id are left as they are.  n_chars follows the text where it was cut.
    """
    docs = docs.select(*COLUMNS)
    with scratch_scope(spark) as keep:
        cuts = keep(removed_spans(repeated_passages(docs)))
    return without_passages(docs, cuts)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with the probabilities that meet the target weights of sources, languages and topics.

    A null source or language is a value of its own; a null or empty text counts as one token without a topic; the draw follows from
    the doc_id, so rows of one doc_id are drawn together.
    """
    return mix_documents(docs.select(*COLUMNS)).where("selected").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its ids and of its decoded text; a null text counts as empty, a null doc_id stays null."""
    return coded_digests(encode_documents(spark, docs, piece_model(), decode=True))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Factorization machines, exact merges of pieces and components of sketches are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
