"""What a task that embeds texts holds: bounded batches, vectors of a slice of its rows, a bounded memory of tokens."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from traincover import configure
from traincover.operators import embed


def embedding_task(monkeypatch, encoder):
    """The function that embed_texts gives its tasks."""
    monkeypatch.setattr(embed, "_ship", lambda rows, encoder: lambda: encoder)
    monkeypatch.setattr(embed, "_with_vectors", lambda rows, out: None)
    rows = SimpleNamespace(columns=["doc_id", "text"], mapInArrow=lambda task, schema, profile=None: task)
    return embed.embed_texts(rows, encoder)


def test_vectors_leave_a_task_slice_by_slice(monkeypatch):
    texts = [None if i % 11 == 0 else "" if i % 13 == 0 else f"Word{i % 700} word other{i}" for i in range(5000)]
    texts[40], texts[41] = "long " * 1_000_000, "x" * 9_000_000
    batch = pa.record_batch({"doc_id": pa.array(range(5000), pa.int64()), "text": pa.array(texts)})
    encoder = embed.HashedTokenEncoder(64)
    out = list(embedding_task(monkeypatch, encoder)(iter([batch.slice(0, 0), batch.slice(0, 3000), batch.slice(3000)])))
    assert max(part.num_rows for part in out) <= 1024
    whole = pa.Table.from_batches(out)
    assert whole["doc_id"].to_pylist() == list(range(5000)) and whole["text"].to_pylist() == texts
    for text, vector in zip(texts, whole["embedding"].to_pylist()):
        if not text:
            assert vector is None
        else:
            assert np.array_equal(np.array(vector, np.float32), embed.unit_rows(encoder.encode([text]))[0])


def test_long_tokens_are_not_remembered():
    encoder = embed.HashedTokenEncoder(64)
    encoder.encode(["short " + "y" * 5000])
    assert set(encoder._buckets) == {"short"}


def batch_sizes(rows):
    """Rows and bytes of the Arrow batches that a task over `rows` gets."""
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows]), "bytes": pa.array([batch.nbytes])})

    return [tuple(row) for row in rows.mapInArrow(sizes, "n long, bytes long").collect()]


def test_batches_of_texts_and_of_vectors_are_bounded_by_bytes(spark):
    """Both Python steps of the text ranking: whole texts come in, wide vectors come out and go in again."""
    texts = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id % 900, ' '), 1500) AS text")
    texts = configure(spark).createDataFrame(texts.toArrow()).coalesce(1)
    embedded = embed.embed_texts(texts, embed.HashedTokenEncoder(1024)).drop("text")
    for rows in (texts, embedded):
        got = batch_sizes(rows)
        assert sum(n for n, _ in got) == 3000
        assert max(size for _, size in got) <= 5 << 20


def test_a_worker_remembers_a_bounded_number_of_tokens():
    encoder = embed.HashedTokenEncoder(64)
    texts = [" ".join(f"t{i}" for i in range(at, at + 1000)) for at in range(0, 200_000, 1000)]
    counts = encoder.encode(texts)
    assert len(encoder._buckets) <= 1 << 16
    assert np.array_equal(counts, embed.HashedTokenEncoder(64).encode(texts[::-1])[::-1]) and counts.sum() == 200_000
