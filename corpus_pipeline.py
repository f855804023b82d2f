"""A training corpus out of `documents`: toxic documents go, then exact copies, then near copies; sources are mixed to
their targets; what is left is encoded.

Each stage takes (spark, docs, sf_dir), `docs` straight from a Parquet scan, and works on all that its predecessor kept;
run() writes its result to the shared staging folder and reads it again. Stages that decide about rows number them
first: doc_ids may repeat or be null, and of each group exactly one row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traincover.llm import exact, jaccard, mixing, sentpiece, toxicity
from traincover.llm.base import read
from traincover.session import bound_batches, stage


# Bits of a row's place in its file; those above hold the number of the file.
_PLACE_BITS = 36


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `row_key`, a number of each row by its file and its place there: the same whenever it is read."""
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = placed.select("_file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file")).cast("long"))
    files = F.broadcast(stage(files, "pipeline-files"))
    key = F.shiftleft("_no", _PLACE_BITS) + F.col("_place")
    return placed.join(files, "_file").select(*docs.columns, key.alias("row_key"))


def _only(keyed: DataFrame, decisions: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The rows of `keyed` whose row_key is among `decisions`."""
    renamed = decisions.withColumnRenamed("row_key", "decided_key")
    met = keyed.join(renamed, F.col("row_key") == F.col("decided_key"))
    return met.select(*(c for c in keyed.columns if c != "row_key"), *(extra or []))


def _first_of(keyed: DataFrame, decided: DataFrame, group: str, *before: Column) -> DataFrame:
    """row_key of one row of each group: by `before`, then the smallest doc_id, null last. `decided`: row keys as doc_id."""
    order = F.struct(*before, F.col("doc_id").isNull().alias("none"), "doc_id", "row_key").alias("order")
    groups = decided.select(F.col("doc_id").alias("decided_key"), group)
    met = keyed.select("row_key", order).join(groups, F.col("row_key") == F.col("decided_key"))
    return met.groupBy(group).agg(F.min("order").alias("first")).select("first.row_key")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is trained on these documents and the training labels."""
    bound_batches(spark)
    model = toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row with the most code points stays, then the smallest doc_id."""
    bound_batches(spark)
    keyed = _keyed(docs)
    decided = exact.exact_dedup(keyed.select(F.col("row_key").alias("doc_id"), "text"))
    shortness = (-F.length(F.coalesce("text", F.lit("")))).alias("shortness")
    return _only(keyed, _first_of(keyed, decided, "text_sha256", shortness))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays."""
    keyed = _keyed(docs)
    decided = jaccard.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"))
    return _only(keyed, _first_of(keyed, decided, "component_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order and as often as the schedule takes them. A document that a source's target cuts is kept
    whole if at least half of it is taken; documents without words go."""
    keyed = _keyed(docs)
    mixture, _ = mixing.mix(keyed.select("row_key", "doc_id", "text", "source"), row_key="row_key")
    parts = mixture.groupBy("row_key", "turn").agg(
        F.min("slot").alias("slot"), F.sum("n_words").alias("taken"), F.max("size").alias("size")
    )
    turns = parts.where("2 * taken >= size").select("row_key", "slot", "turn")
    placed = _only(keyed.withColumn("own_key", F.col("row_key")), turns, ["slot", "turn"])
    return placed.orderBy("slot", "turn", "doc_id", "own_key").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether decoding them gives the text again."""
    bound_batches(spark)
    coded = sentpiece.round_trip(docs.select("doc_id", "source", "text"), sentpiece.read_model())
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

# SQL can't express the classifier of the first stage, on which all others depend; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
