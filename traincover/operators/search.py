"""Search of evaluation samples in the vector table, over any set of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traincover.operators import ann, topk
from traincover.session import stage
from traincover.sources.vectors import IMAGE, TEXT, active_versions

MATCH_COLUMNS = (
    "sample_id", "channel", "rank", "score", "version", "index_id", "image_path", "text", "annotation", "source",
)


def _in_versions(vectors: DataFrame, modality: str, active: list[str]) -> DataFrame:
    """The vectors to search: folders of other versions and of the other modality are pruned."""
    return vectors.where((F.col("modality") == modality) & F.col("version").isin(active))


def _version_place(active: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in active]).cast("array<string>"), F.col("version")).cast("int")


def attach_details(ranked: DataFrame, details: DataFrame, channel: str, active: list[str]) -> DataFrame:
    """The match rows of ranked ids. `details` carries the metadata by `index_id`, and by `version` unless ids are
    unique over all versions.

    The ranking is staged, so its size is known: when it is small (an evaluation set's always is), its keys are
    broadcast to pick the wanted metadata in one scan that shuffles nothing and reads no vectors.
    """
    names = F.array(*[F.lit(v) for v in active]).cast("array<string>")
    ranked = stage(ranked, "ranked")
    keyed = ranked.withColumn("version", F.element_at(names, F.col("version_pos"))).drop("version_pos")
    key = [name for name in ("version", "index_id") if name in details.columns]
    details = details.select(*key, "image_path", "text", "annotation", "source")
    if ranked.count() <= topk.BROADCAST_MATCHES:
        details = details.join(F.broadcast(keyed.select(*key).distinct()), key, "left_semi")
    source = F.coalesce("source", F.lit(""))
    if len(active) > 1:
        source = F.format_string("[%s] %s", F.col("version"), source)
    filled = {name: F.coalesce(name, F.lit("")) for name in ("image_path", "text", "annotation")}
    return keyed.join(details, key, "left").withColumns(
        {"channel": F.lit(channel), "source": source, **filled}
    ).select(*MATCH_COLUMNS)


def rank(
    queries: DataFrame,
    vectors: DataFrame,
    channel: str,
    active: list[str],
    k: int = 5,
    index: ann.CellIndex | None = None,
    nprobe: int = 8,
    broadcast_queries: int = topk.BROADCAST_QUERIES,
) -> DataFrame:
    """(sample_id, rank, score, version_pos, index_id) of the k best rows per query, over the active versions."""
    corpus = _in_versions(vectors, channel, active).withColumn("version_pos", _version_place(active))
    if index is None:
        return topk.topk(queries, corpus, k, broadcast_queries)
    return ann.approximate_topk(queries, corpus, k, index, nprobe)


def search(
    queries: DataFrame,
    vectors: DataFrame,
    channel: str,
    versions: list[str] | None = None,
    details: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The k most similar training rows of every query, merged over the versions, best first.

    `queries`: sample_id, embedding. `channel` is the modality searched. With several active versions the source
    gets a `[version]` prefix. Exact by default; option `index` asks for the approximate search in `nprobe` cells.
    `details` names the metadata table where the vectors do not carry it themselves.
    """
    active = active_versions(vectors, versions)
    ranked = rank(queries, vectors, channel, active, **options)
    if details is None:
        details = _in_versions(vectors, channel, active)
    return attach_details(ranked, details, channel, active)


def search_images(queries: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """Image search: samples without an image vector have no matches."""
    return search(queries, vectors, IMAGE, **options)


def search_texts(queries: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """Text search; versions without texts contribute nothing. Drop samples with empty text before embedding."""
    return search(queries, vectors, TEXT, **options)
