"""Offline build: scan, check, embed, number and store one data version."""

from __future__ import annotations

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traincover.functions.paths import escape_glob
from traincover.functions.text import is_blank
from traincover.operators import ann as approximate
from traincover.operators import embed, ids, quality
from traincover.session import release, stage
from traincover.sources import annotations as ann
from traincover.sources import tars
from traincover.sources import vectors as vec

DEFAULT_SHARDS = 8


def scan_annotations(spark: SparkSession, root: str, keep_raw: bool = True) -> DataFrame:
    """All valid annotations of a tree with their `global_id` in scan order.

    The parsed scan is staged once; ids, quality report and both embedding jobs read the staged table.
    """
    rows = ann.annotations(ann.scan_lines(spark, root))
    marked = ids.mark_rows(rows if keep_raw else rows.drop("raw"))
    return ids.marked_ids(stage(marked, "annotations"), ann.SCAN_ORDER).drop("block")


def check_dataset(annotated: DataFrame, check_images: bool = False, **thresholds) -> DataFrame:
    """`quality.check`, optionally with the image audit (slow: reads every image)."""
    if not check_images:
        return quality.check(annotated, **thresholds)
    return quality.check(tars.readable(annotated), image_readable="image_readable", **thresholds)


def build_vectors(
    annotated: DataFrame,
    image_encoder: embed.Encoder,
    text_encoder: embed.Encoder,
    shards: int = DEFAULT_SHARDS,
    members: DataFrame | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Both modalities of the vector table (without `version`), numbered shard by shard.

    Embedding runs map-only on the staged annotations. Its output is staged: vectors are computed once. `members`
    (`tars.list_members`) is for archives that many tasks read from, `profile` for executors with GPUs.
    """
    samples = ann.training_samples(annotated)
    pictured = samples if members is None else tars.locate(samples, members)
    images = embed.version_vectors(embed.embed_images(pictured, image_encoder, profile=profile), vec.IMAGE)
    named = samples.where(~is_blank(F.col("text")))
    texts = embed.version_vectors(embed.embed_texts(named, text_encoder, profile=profile), vec.TEXT)
    return ids.shard_ids(stage(images, "images"), shards).unionByName(
        ids.shard_ids(stage(texts, "texts"), shards)
    )


def build_version(
    spark: SparkSession,
    data_root: str,
    index_root: str,
    image_encoder: embed.Encoder,
    text_encoder: embed.Encoder,
    version: str | None = None,
    shards: int = DEFAULT_SHARDS,
    run_qc: bool = True,
    huge_archives: bool = False,
    profile: ResourceProfile | None = None,
    cells: int | None = None,
) -> dict[str, int]:
    """Build and store one version; returns the number of vectors per modality.

    With `cells`, an approximate index is stored beside it too: that many centres fitted on all its image vectors, and
    the image vectors by cell (`sources.vectors.write_cells`; load it with `operators.ann.load_index`).

    The quality report is printed; it removes nothing. A tree without valid data is an error. With `huge_archives`
    the archives are listed once beforehand, so that many tasks can share one without walking through it each.
    """
    vec.version_folder(index_root, version)  # a bad name fails before the work
    annotated = scan_annotations(spark, data_root, keep_raw=False)
    if annotated.isEmpty():
        raise ValueError(f"no valid data in {data_root}")
    if run_qc:
        print(quality.report_text(check_dataset(annotated)))
    members = tars.list_members(spark, f"{escape_glob(data_root.rstrip('/'))}/*/images/*.tar") if huge_archives else None
    vectors = build_vectors(annotated, image_encoder, text_encoder, shards, members, profile)
    vec.write_version(vectors, index_root, version)
    release(annotated, vectors)
    stored = vec.read_vectors(spark, index_root).where(F.col("version") == (version or vec.DEFAULT_VERSION))
    if cells:
        images = stored.where(F.col("modality") == vec.IMAGE)
        index = approximate.fit_cells(images, cells)
        housed = stage(approximate.house(images, index), "housed")
        radii = approximate.cell_radii(housed, index)
        vec.write_cells(housed, index.centres, index_root, version, radii)
        release(housed)
    return {row.modality: row["count"] for row in stored.groupBy("modality").count().collect()}
