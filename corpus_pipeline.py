"""From documents to packed training sequences: STAGES in order, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Their
treatment of nulls, empty and long texts, repeated rows and empty tables is that of the operators they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm import mixing, packing, quality, simhash, suffix_dedup
from presslake.llm.common import tune, written
from presslake.llm.queries import table, tokenizer_path

KEEP_FROM = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, scores at KEEP_FROM or more."""
    model = quality.fit(docs, table(tune(spark), sf_dir, "labels"), "quality")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = quality.score(rows, model, ["row"]).where(F.col("_score") >= KEEP_FROM)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of SimHash links."""
    tune(spark)
    return simhash.drop_near_duplicates(docs, shingle=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that occurred earlier; a character cut in two goes as a whole.

    Documents of which nothing is left go too; n_chars counts the new text.
    """
    tune(spark)
    out = suffix_dedup.remove_repeats(docs, min_len=100, whole_characters=True)
    cut = F.size("spans") > 0
    new = out.select("row", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("row.text")).alias("new"), cut.alias("cut"))
    new = new.where(~F.col("cut") | (F.length("new") > 0))
    columns = {"text": F.col("new"), "n_chars": F.when(F.col("cut"), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))}
    return new.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    tune(spark)
    return mixing.mix(docs, cycle=(1, 2, 3), max_repeats=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    tune(spark)
    return packing.pack(packing.pieces(docs, tokenizer_path(), length=1024, end_id=2), length=1024)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_first_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
# Neither the classifier nor the packing can be stated in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what each stage returns is written and read again."""
    docs = table(tune(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
