"""Training-data pipeline: toxicity, language, near-duplicates, benchmark passages, packing.

Each stage but the last returns the columns of its input, whatever others there
are beside those of documents, and an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, language_id, packing, similar, toxicity
from siftwell.llm.common import discard, materialize, quoted, table, unused

#: SQL cannot express trained models; tests compare the stages with brute force.
ORACLE_SQL = None
#: When a text resembles no known language: this share of the largest distance. Runs of 1 to
#: 80 words of known languages, and whole texts, stay below 0.82.
FAR = 0.85


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored 0.5 or more go; labels of the training folds teach the score.

    Each row is judged by its own text, a null one as an empty one, so that
    repeated rows and rows without an id stay or go alike. Without labels of both
    kinds nothing is scored high, unless all labels are toxic.
    """
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=True)
    return scored.where("predicted = 0").select("row.*")


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go.

    Those are null texts, texts without letters, and texts, short or long, that
    are about as far from every known language as can be: FAR of the largest
    distance. Texts of several known languages stay.
    """
    found = language_id.identify(docs, language_id.profiles(docs), keep=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("distance") < FAR)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, once; rows without an id come last.

    Near-duplicates are texts whose five-word shingles have a Jaccard similarity
    of 0.8 or more, and a group is what such links join. Candidates are operator
    6's links and, as fingerprints lose pairs at that similarity, those of an exact
    prefix filter; all are compared exactly. Rows are told apart by
    id and text, so that of different texts with one id each is judged by itself.
    Texts without words, null ones too, are near-duplicates of one another; rows
    with neither id nor text hold nothing to compare, and one of them stays.
    """
    copy = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    bare = docs["doc_id"].isNull() & docs["text"].isNull()
    found = similar.groups(docs.where(~bare).select(F.col("doc_id").alias("who"), copy.alias("copy"), "text"))
    first = F.min(F.struct(F.col("who").isNull().alias("last"), "who", "copy")).alias("first")
    who, what = unused(docs, "who"), unused(docs, "copy")
    stay = found.groupBy("root").agg(first).select(F.col("first.who").alias(who), F.col("first.copy").alias(what))
    kept = docs.where(~bare).join(stay, copy.eqNullSafe(F.col(what)) & docs["doc_id"].eqNullSafe(F.col(who)), "left_semi").select(*quoted(docs))
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.where(bare).dropDuplicates(["text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, each by its own text, whatever its id; null texts stay."""
    copy = F.unhex(F.md5(docs["text"]))
    found = decontaminate.contaminated(docs.select(copy.alias("copy"), "text"), table(spark, sf_dir, "benchmark"), key="copy")
    what = unused(docs, "copy")
    return docs.join(found.select(F.col("copy").alias(what)).distinct(), copy == F.col(what), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens; a null or empty text is its end token alone."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
