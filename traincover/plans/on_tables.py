"""The operators applied to the driver's tables. Every query reads its tables whole.

Stand-ins for the image-and-text data of a real run:

* image vectors: `embeddings`, described by the `documents` row of the same id (name = source, annotation = text);
* text vectors: all of `documents`, embedded with the hashed-token encoder;
* evaluation samples: all `benchmark` items; the embedding of the same id, if any, is the vector of their image;
* annotations: `documents` with `labels`; JSONL records: `conversations`, `events` and the lines of `documents`.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traincover.functions import jsonpath, paths, text, vectors
from traincover.operators import ann, coverage, embed, fields, ids, quality, search, topk
from traincover.plans import evaluate, export
from traincover.session import configure, spread, stage, staging_root
from traincover.sources import annotations, benchmark
from traincover.sources import vectors as table

TOP_K = 5
THRESHOLD = 0.35
SHARDS = 8
ENCODER = embed.HashedTokenEncoder(1024)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(column: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(column)


# Vectors and search


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows of the vector table, one version per label. Their metadata is in `image_details`."""
    return _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("index_id"), "embedding", F.format_string("v%d", "label").alias("version"),
        F.lit(table.IMAGE).alias("modality"),
    )


def document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by id: the source is the name, the text the annotation."""
    return _read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index_id"), F.format_string("img/%d.jpg", "doc_id").alias("image_path"),
        F.col("source").alias("text"), F.col("text").alias("annotation"), F.col("lang").alias("source"),
    )


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding) of the documents with text."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    filled = spread(documents).where(~text.is_blank(F.col("text")))
    return embed.embed_texts(filled, ENCODER).drop("text")


def benchmark_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "benchmark").where(F.col("text") != "")
    return embed.embed_texts(asked, ENCODER).select(F.col("item_id").alias("sample_id"), "embedding")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding against all embeddings."""
    rows = _read(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("sample_id"), "embedding")
    corpus = rows.select(F.lit(1).alias("version_pos"), F.col("vec_id").alias("index_id"), "embedding")
    return topk.topk(queries, spread(corpus), TOP_K).select("sample_id", "rank", "index_id", _rounded("score"))


def _image_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample_id"))
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding").join(
        items, "sample_id", "left_semi"
    )


def search_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the evaluation samples against all versions, and against a selection with an unknown name."""
    queries, corpus = _image_queries(spark, sf_dir), image_vectors(spark, sf_dir)
    details = document_details(spark, sf_dir)
    columns = ["sample_id", "rank", "version", "index_id", _rounded("score"), "image_path", "text", "source"]
    selections = {"all": None, "some": ["v7", "v2", "unknown"], "one": ["v3"]}
    results = [
        search.search_images(queries, corpus, k=TOP_K, versions=versions, details=details).select(
            F.lit(name).alias("selection"), *columns
        )
        for name, versions in selections.items()
    ]
    return results[0].unionByName(results[1]).unionByName(results[2])


def version_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors per version; the text-only default version is not listed."""
    texts = _read(spark, sf_dir, "documents").select(
        F.lit(table.DEFAULT_VERSION).alias("version"), F.lit(table.TEXT).alias("modality")
    )
    images = image_vectors(spark, sf_dir).select("version", "modality")
    return table.versions(images.unionByName(texts))


def _text_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = document_vectors(spark, sf_dir).select(
        F.lit(1).alias("version_pos"), F.col("doc_id").alias("index_id"), "embedding"
    )
    return topk.topk(benchmark_vectors(spark, sf_dir), corpus, TOP_K)


def _text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = document_details(spark, sf_dir)
    return search.attach_details(_text_ranking(spark, sf_dir), details, table.TEXT, [table.DEFAULT_VERSION])


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_matches(spark, sf_dir).select(
        "sample_id", "rank", "index_id", _rounded("score"), "text", "source"
    )


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero entries of the text vectors, whole texts."""
    entries = document_vectors(spark, sf_dir).select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return entries.where(F.col("weight") != 0).select(
        "doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stretched by their label come back to unit length."""
    stretched = _read(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v")
    )
    unit = stretched.select("vec_id", F.posexplode(vectors.l2_normalize(F.col("v"))).alias("place", "value"))
    return unit.select("vec_id", "place", _rounded("value"))


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text matches per score band."""
    banded = _text_ranking(spark, sf_dir).withColumn("band", coverage.score_band(F.col("score")))
    return banded.groupBy("band").agg(F.count("*").alias("n"))


def _label_centres(rows: DataFrame) -> ann.CellIndex:
    """One cell for each label, its centre the mean vector to three decimals."""
    entries = rows.select("label", F.posexplode("embedding").alias("place", "value"))
    means = entries.groupBy("label", "place").agg(F.round(F.avg(F.col("value").cast("double")), 3).alias("mean"))
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "mean")))["mean"].alias("centre"))
    held = centres.orderBy("label").limit(ann.MAX_CELLS + 1).toArrow()
    if held.num_rows > ann.MAX_CELLS:
        raise ValueError(f"more than {ann.MAX_CELLS} labels")
    return ann.CellIndex(np.array(held["centre"].to_pylist()))


def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding against those in the two cells nearest to it, under fixed centres."""
    rows = _read(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("sample_id"), "embedding")
    corpus = rows.select(F.lit(1).alias("version_pos"), F.col("vec_id").alias("index_id"), "embedding")
    found = ann.approximate_topk(queries, corpus, TOP_K, _label_centres(rows), nprobe=2)
    return found.select("sample_id", "rank", "index_id", _rounded("score"))


def ann_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ann_search` through a stored index: the vectors written by cell beside a version, loaded, two cells probed."""
    rows = _read(spark, sf_dir, "embeddings")
    index = _label_centres(rows)
    corpus = rows.select(
        F.col("vec_id").alias("index_id"), "embedding", F.col("vec_id").alias("global_id"), F.lit(table.IMAGE).alias("modality"),
        *(F.lit(None).cast("string").alias(name) for name in ("image_path", "text", "annotation", "source")),
    )
    root = f"{staging_root(spark)}/traincover-staged-cells-{uuid.uuid4().hex}"
    table.write_cells(ann.house(corpus, index), index.centres, root)
    loaded, stored = ann.load_index(spark, root)
    queries = rows.select(F.col("vec_id").alias("sample_id"), "embedding")
    found = search.rank(queries, stored, table.IMAGE, [table.DEFAULT_VERSION], k=TOP_K, index=loaded, nprobe=2)
    return found.select("sample_id", "rank", "index_id", _rounded("score"))


def bounded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`search_topk` exactly, through 16 fitted cells: two probed, then only cells whose bound reaches the k-th score."""
    rows = _read(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("sample_id"), "embedding")
    corpus = rows.select(F.lit(1).alias("version_pos"), F.col("vec_id").alias("index_id"), "embedding")
    fitted = ann.fit_cells(corpus, cells=16)
    housed = stage(ann.house(corpus, fitted), "cells")
    index = ann.CellIndex(fitted.centres, ann.cell_radii(housed, fitted))
    found = ann.exact_topk(queries, housed, TOP_K, index, nprobe=2)
    return found.select("sample_id", "rank", "index_id", _rounded("score"))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact matches that the approximate search finds, by the number of cells probed."""
    queries, corpus = _image_queries(spark, sf_dir), image_vectors(spark, sf_dir)
    active = table.active_versions(corpus)
    index = ann.fit_cells(corpus, cells=16)
    housed = stage(ann.house(corpus, index).sortWithinPartitions("cell"), "cells")
    exact = search.rank(queries, corpus, table.IMAGE, active, k=TOP_K)
    reports = [
        ann.recall(search.rank(queries, housed, table.IMAGE, active, k=TOP_K, index=index, nprobe=nprobe), exact)
        .select(F.lit(nprobe).alias("nprobe"), "n_exact", "n_found", "recall")
        for nprobe in (1, 4, 16)
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


# Coverage


def evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(samples, matches): every benchmark item. An image's own row is not counted as its match."""
    samples = _read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("sample_id"), F.col("text").alias("query_text")
    )
    corpus = image_vectors(spark, sf_dir)
    active = table.active_versions(corpus)
    # One place more than asked for makes up for the row that is left out.
    ranked = search.rank(_image_queries(spark, sf_dir), corpus, table.IMAGE, active, k=TOP_K + 1)
    others = topk.final_ranking(ranked.where(F.col("index_id") != F.col("sample_id")).drop("rank"), TOP_K)
    images = search.attach_details(others, document_details(spark, sf_dir), table.IMAGE, active)
    return samples, images.unionByName(_text_matches(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str, durable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classified samples, matches). Matches that are read twice are made durable first."""
    samples, matches = evaluation(spark, sf_dir)
    matches = stage(matches, "matches") if durable else matches
    return coverage.classify(coverage.facts(samples, matches), THRESHOLD), matches


def coverage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _ = _classified(spark, sf_dir)
    return classified.select("sample_id", _rounded("best_image"), _rounded("best_text"), "category")


def coverage_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose image and text matches share a name, with the highest threshold at which they do."""
    samples, matches = evaluation(spark, sf_dir)
    return coverage.facts(samples, matches).where(F.col("agree_at").isNotNull()).select(
        "sample_id", _rounded("agree_at")
    )


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.summary(coverage.facts(*evaluation(spark, sf_dir)), THRESHOLD)


def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.sweep(coverage.facts(*evaluation(spark, sf_dir)))


def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _ = _classified(spark, sf_dir)
    return coverage.filter_membership(classified)


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _ = _classified(spark, sf_dir)
    return coverage.overview(classified)


def shown_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text-hit samples in order, with their shown and hidden matches."""
    classified, matches = _classified(spark, sf_dir, durable=True)
    return evaluate.drill_down(classified, matches, THRESHOLD, coverage.ONLY_TEXT).select(
        "position", "sample_id", "channel", "n_shown", "n_hidden"
    )


def detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail export, unfolded again: one row per match."""
    classified, matches = _classified(spark, sf_dir, durable=True)
    nested = export.detail(classified, matches)
    channels = F.array(
        F.struct(F.lit("image").alias("channel"), F.col("image_results").alias("results")),
        F.struct(F.lit("text").alias("channel"), F.col("text_results").alias("results")),
    )
    unfolded = nested.select("stem", "category", F.inline(channels)).select(
        "stem", "category", "channel", F.inline("results")
    )
    return unfolded.select("stem", "category", "channel", "rank", "score", "text", "source", "image_path")


def agree_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, matches = _classified(spark, sf_dir, durable=True)
    return export.agree_manifest(classified, matches, THRESHOLD)


# Quality


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as annotations; labels decide the name. A toxic document's text is withheld (a blank
    annotation), and a document without a labels row has no image (an empty path): both are errors of the check."""
    labels = _read(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    return _read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("global_id"),
        F.when(F.col("toxic") == 1, "").when(F.col("quality") == 0, F.col("source"))
        .otherwise(F.regexp_extract("text", r"^\S+", 0)).alias("entity_name"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("text")).alias("annotation"),
        F.when(F.col("labelled"), F.format_string("%s/%d.jpg", "source", "doc_id")).otherwise("").alias("image_relative_path"),
        F.format_string("doc-%d", "doc_id").alias("data_uuid"),
        F.col("source").alias("source_name"),
        F.when(F.col("quality").isNotNull(), F.col("lang")).otherwise("").alias("model_name"),
        F.col("lang").alias("source_dataset"),
    )


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(annotated(spark, sf_dir))


def qc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exploded_issues(_checked(spark, sf_dir), "global_id")


def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(_checked(spark, sf_dir))


def qc_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distributions(annotated(spark, sf_dir))


def qc_issue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_fields(_checked(spark, sf_dir))


def qc_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = quality.problems(_checked(spark, sf_dir))
    return listed.select("global_id", "name", F.size("issues").alias("n_issues"), "is_error")


def qc_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_sources(annotated(spark, sf_dir))


def qc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).select("global_id", F.length(text.strip(F.col("annotation"))).alias("n_chars"))


def qc_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the name occurs in the annotation, where both are filled."""
    rows = annotated(spark, sf_dir).where(
        ~text.is_blank(F.col("entity_name")) & ~text.is_blank(F.col("annotation"))
    )
    found = F.contains("annotation", text.strip(F.col("entity_name")))
    return rows.select("global_id", found.cast("int").alias("found"))


def qc_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("global_id", "name")


def nonblank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that enter the text index."""
    rows = annotated(spark, sf_dir)
    return rows.where(~text.is_blank(F.col("entity_name"))).select("global_id", "entity_name")


# JSON


def messages(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """One annotation record per conversation: all its turns or the `first`, described by the document of the same id.

    Only user turns carry an image, so a conversation that opens with another role makes an unusable record.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    turns = _read(spark, sf_dir, "conversations").withColumn("at", F.row_number().over(by_turn))
    if first:  # the limit on the row number reaches below the shuffle: a huge conversation sends so many rows per task
        turns = turns.where(F.col("at") <= first)
    image = F.struct(
        F.lit("image").alias("type"),
        F.struct(F.format_string("turns/%d.jpg", "conv_id").alias("relative_path")).alias("image"),
        F.lit(None).cast("struct<string: string>").alias("text"),
    )
    words = F.struct(
        F.lit("text").alias("type"), F.lit(None).cast("struct<relative_path: string>").alias("image"),
        F.struct(F.col("text").alias("string")).alias("text"),
    )
    content = F.when(F.col("role") == "user", F.array(words, image)).otherwise(F.array(words))
    said = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", content.alias("content")))).alias("data")
    )
    described = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "source", "lang")
    record = F.struct(
        F.format_string("conv-%d", "conv_id").alias("data_uuid"), "data",
        F.struct(
            F.struct(F.array(F.struct(
                F.col("source").alias("entity_name"), F.array("lang").alias("entity_tags")
            )).alias("knowledge_entities")).alias("knowledge_info"),
            F.struct(F.col("lang").alias("source_name")).alias("source_info"),
        ).alias("meta_info_image"),
        F.struct(F.array(F.struct(F.lit("annotator").alias("model_name"))).alias("task_oriented_data"))
        .alias("data_generated_info"),
    )
    return said.join(described, "conv_id", "left").select(F.to_json(record).alias("value"))


def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three kinds: records, JSON that is no record, prose."""
    events = _read(spark, sf_dir, "events").select(F.col("props").alias("value"))
    prose = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return messages(spark, sf_dir).unionByName(events).unionByName(prose)


def _parsed(lines: DataFrame) -> DataFrame:
    return annotations.parse_records(annotations.decode_lines(lines))


def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records parsed from the conversations."""
    rows = _parsed(messages(spark, sf_dir, first=2)).where(F.col("status") == annotations.STATUS_OK)
    return rows.select(
        "data_uuid", "image_relative_path", "annotation", "entity_name", F.array_join("entity_tags", ",").alias("tags"),
        "source_name", "model_name",
    )


def jsonl_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(jsonl_lines(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.scan_stats(_parsed(jsonl_lines(spark, sf_dir)))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form JSON of every turn: {<role>: [{question, answer}], "turn": number, "meta": {"role": text}}."""
    turns = _read(spark, sf_dir, "conversations")
    entry = F.array(F.struct(
        F.col("conv_id").alias("question"), F.col("text").alias("answer"), F.array("role").alias("roles")
    ))
    roles = ["system", "user", "assistant"]
    body = F.struct(
        *[F.when(F.col("role") == role, entry).alias(role) for role in roles],
        F.col("turn"), F.struct("role", F.lit(" ").alias("blank")).alias("meta"),
    )
    stem = F.format_string("%012d-%06d", "conv_id", "turn").alias("stem")
    return turns.select("conv_id", "turn", stem, F.parse_json(F.to_json(body)).alias("json"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at paths: text, number (no text), default for a missing path, a model's answer."""
    json = F.col("json")
    return answers(spark, sf_dir).select(
        "conv_id", "turn",
        jsonpath.text_at(json, "meta.role").alias("role_text"),
        jsonpath.text_at(json, "turn").alias("turn_text"),
        jsonpath.value_at(json, "turn", as_type="long").alias("turn_value"),
        jsonpath.value_at(json, "meta", "missing", default="-").alias("missing_value"),
        jsonpath.text_at(json, "user[0].roles[0]").alias("user_role"),
        jsonpath.answer_of(json, "assistant").alias("assistant_answer"),
    )


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = _read(spark, sf_dir, "events").select(F.try_parse_json("props").alias("json"))
    return fields.text_paths(answers(spark, sf_dir).select("json").unionByName(props))


def list_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.list_keys(answers(spark, sf_dir))


def field_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.preview(answers(spark, sf_dir), "assistant[0].answer", n=5)


# Paths and ids


def shard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as annotation shards (language and number out of the URL), documents as tars; with or without a tar."""
    shard = F.regexp_extract_all("url", F.lit(r"/(fr|en|de|es)/(\d+)"), F.lit(1))
    number = F.regexp_extract("url", r"/(?:fr|en|de|es)/(\d+)", 1)
    jsonl = annotations.shard_keys(
        _read(spark, sf_dir, "pages").where(number != "").select(
            F.concat(F.lit("/data/"), F.get(shard, F.lit(0)), F.lit("/jsonl/"), number, F.lit(".jsonl")).alias("path")
        ).distinct(),
        "jsonl_path",
    )
    tars = annotations.shard_keys(
        _read(spark, sf_dir, "documents").select(F.format_string("/data/%s/images/%d.tar", "lang", "doc_id").alias("path")),
        "tar_path",
    )
    paired = annotations.pair_shards(jsonl, tars)
    return paired.unionByName(annotations.unpaired_shards(jsonl, tars).withColumn("tar_path", F.lit("missing")))


def stem_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files whose suffix depends on the language (one is no image), labels as JSON files."""
    suffix = (
        F.when(F.col("lang") == "en", ".JPG").when(F.col("lang") == "fr", ".png")
        .when(F.col("lang") == "de", ".txt").otherwise(".v2.tiff")
    )
    images = _read(spark, sf_dir, "documents").select(
        F.concat(F.format_string("/bench/%s/doc.%d", "lang", "doc_id"), suffix).alias("path")
    )
    texts = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id").select(
        F.format_string("/bench/%s/doc.%d.json", "lang", "doc_id").alias("path")
    )
    return benchmark.pair_stems(images.unionByName(texts))


def tar_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member addresses composed and split again; members may hold the separator."""
    pages = _read(spark, sf_dir, "pages").select(
        "page_id", F.format_string("/data/%d.tar", "page_id").alias("archive"),
        F.concat(F.lit("a::"), "url").alias("member"),
    )
    uri = paths.member_uri(F.col("archive"), F.col("member"))
    split = pages.withColumn("uri", uri).withColumn("parts", paths.split_member_uri(F.col("uri")))
    return split.select(
        "page_id", "uri", "parts.archive", "parts.member", paths.is_member_uri(F.col("uri")).cast("int").alias("is_uri")
    )


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, numbered in scan order."""
    scan = _read(spark, sf_dir, "documents").select(
        "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    return ids.scan_ids(scan, ("file", "block")).drop("file", "block")


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its `global_id` in scan order; those with an embedding also get `index_id` in shard order,
    the others a NULL one."""
    numbered = _numbered(spark, sf_dir)
    embedded = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    indexed = ids.shard_ids(numbered.join(embedded, "doc_id", "left_semi"), SHARDS).select("global_id", "index_id")
    return numbered.select("doc_id", "global_id").join(indexed, "global_id", "left").select("doc_id", "global_id", "index_id")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).groupBy((F.col("global_id") % SHARDS).alias("shard")).agg(F.count("*").alias("n"))


QUERIES = {
    "search_topk": search_topk,
    "search_versions": search_versions,
    "versions": version_list,
    "text_search": text_search,
    "text_vectors": text_vectors,
    "l2_normalize": l2_normalize,
    "score_bands": score_bands,
    "ann_search": ann_search,
    "ann_recall": ann_recall,
    "ann_stored": ann_stored,
    "bounded_topk": bounded_topk,
    "coverage_samples": coverage_samples,
    "coverage_agree": coverage_agree,
    "coverage_summary": coverage_summary,
    "coverage_sweep": coverage_sweep,
    "coverage_filter": coverage_filter,
    "overview": overview,
    "shown_hidden": shown_hidden,
    "detail_nested": detail_nested,
    "agree_bundle": agree_bundle,
    "qc_issues": qc_issues,
    "qc_summary": qc_summary,
    "qc_distribution": qc_distribution,
    "qc_issue_fields": qc_issue_fields,
    "qc_problems": qc_problems,
    "qc_top_sources": qc_top_sources,
    "qc_lengths": qc_lengths,
    "qc_consistency": qc_consistency,
    "qc_label": qc_label,
    "nonblank_filter": nonblank_filter,
    "first_turns": first_turns,
    "jsonl_decode": jsonl_decode,
    "scan_stats": scan_stats,
    "json_field": json_field,
    "json_paths": json_paths,
    "list_keys": list_keys,
    "field_preview": field_preview,
    "shard_pairs": shard_pairs,
    "stem_pairing": stem_pairing,
    "tar_uri": tar_uri,
    "dense_ids": dense_ids,
    "shard_sizes": shard_sizes,
}
