"""Discovery and preview of text fields in free-form JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from json import loads

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traincover.functions.jsonpath import PLAIN_KEY, text_at
from traincover.functions.text import WHITESPACE

_PLAIN = re.compile(PLAIN_KEY)


def _step(path: str, key: str) -> str:
    """Append a key to a path; keys the path grammar cannot spell plainly are quoted."""
    if not _PLAIN.search(key):
        return f'{path}["{key}"]'
    return f"{path}.{key}" if path else key


def _walk(sample: object) -> Iterator[str]:
    """The paths that lead to a non-blank string, by a stack of its own: nesting may be as deep as it likes."""
    stack = [("", sample)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack.extend((_step(path, key), value) for key, value in node.items())
        elif isinstance(node, list):
            stack.extend((f"{path}[0]", value) for value in node[:1])
        elif isinstance(node, str) and path and node.strip(WHITESPACE):
            yield path


def _kind(node: Column) -> Column:
    """OBJECT, ARRAY, STRING or another type name."""
    return F.substring_index(F.schema_of_variant(node), "<", 1)


def text_paths(samples: DataFrame, json: str = "json", first: int | None = None, order: str = "stem") -> DataFrame:
    """The distinct paths that lead to a non-blank string in any sample, sorted. Lists are probed at position 0.

    All samples are read unless `first` limits the probe. Each sample is walked once, as JSON text; every batch hands on
    its distinct paths only.
    """
    if first is not None:
        samples = samples.orderBy(order).limit(first)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {path for text in batch.column(0).to_pylist() if text for path in _walk(loads(text))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["path"])

    texts = samples.select(F.to_json(F.col(json)).alias("text"))
    return texts.mapInArrow(paths, "path string").distinct().orderBy("path")


def list_keys(samples: DataFrame, json: str = "json") -> DataFrame:
    """The distinct top-level keys whose value is a list, sorted."""
    fields = samples.select(F.when(_kind(F.col(json)) == "OBJECT", F.col(json)).alias("json")).lateralJoin(
        samples.sparkSession.tvf.variant_explode(F.col("json").outer())
    )
    return fields.where(_kind(F.col("value")) == "ARRAY").select("key").distinct().orderBy("key")


def preview(samples: DataFrame, path: str, n: int = 5, json: str = "json", order: str = "stem") -> DataFrame:
    """The first `n` non-empty texts at a path, in sample order."""
    texts = samples.select(order, text_at(F.col(json), path).alias("value"))
    return texts.where(F.col("value") != "").orderBy(order).limit(n)
