"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Between stages the rows are written as Parquet and read again. All stages but the last return the columns of
``documents``, extra ones included, whatever their names. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, pieces, quality, simhash, substring
from tracelake.llm.common import scratch


#: Five-word shingles, and the bits in which near-duplicates' fingerprints may differ: one in eight. Of texts that
#: share 0.8 to 0.85 of their shingles about half are this near, of those that share 0.95 nearly all.
NEAR = {"shingle": 5, "errors": 8}


def _free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like others; repeated rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, good = _free("_score", docs), _free("_good", docs)
    scored = quality.scored(docs, quality.fit(docs, labels), threshold=0.3, score_col=score, label_col=good)
    return scored.where(F.col(good) == 1).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Texts without words, null ones too, are a group. Rows that share an id are one document and stay or go
    together; rows without an id stay.
    """
    near = simhash.near_duplicates(docs.select("doc_id", "text"), **NEAR)
    gone = near.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id also holds; none is left out.

    A text that loses words has its kept words joined by one space, and n_chars counts them; others stay as
    they are, null and empty ones and those without an id included. Rows that share an id lose the same.
    """
    named = {c: f"column{k}" for k, c in enumerate(docs.columns)}  # none is called as what the operator adds
    cut = substring.repeats(docs.select(*(F.col(c).alias(n) for c, n in named.items())), id_col=named["doc_id"], text_col=named["text"])
    lost = F.col("n_removed") > 0
    own = {c: F.col(n) for c, n in named.items()} | {"text": F.when(lost, F.col("kept_text")).otherwise(F.col(named["text"]))}
    if "n_chars" in named:
        own["n_chars"] = F.when(lost, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return cut.select(*(own[c].alias(c) for c in docs.columns))


def no_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null, empty and wordless texts and rows without an id stay, and rows that share an id go together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids spell the text again, of every row. A null text has null ids and no tokens."""
    both = pieces.decode(pieces.encode(docs.select("doc_id", "text")))
    return both.select("doc_id", "ids", F.greatest(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("substrings", cut_repeats),
    ("decontamination", no_tests),
    ("pieces", to_pieces),
]

#: SQL can't express trained classifiers nor Viterbi paths; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
