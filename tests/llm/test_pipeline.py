"""Each stage of the pipeline against plain rules, at the smallest scale."""

import re
from collections import Counter

import corpus_pipeline
from traincover.llm.base import read

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stages_do_what_they_say(spark):
    docs = read(spark, SF, "documents")
    kept = [docs.collect()]
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(apply(spark, docs, SF), "pipeline-test")
        assert docs.columns == read(spark, SF, "documents").columns
        kept.append(docs.collect())
    _, clean, unique, apart, mixed = ({r.doc_id: r.text for r in rows} for rows in kept)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    assert set(map(plain, unique.values())) == set(map(plain, clean.values())) and len(set(map(plain, unique.values()))) == len(unique)
    sets = {i: _shingles(t) for i, t in unique.items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in apart for b in apart if a < b)
    assert all(any(near(a, b) for b in unique if b != a) for a in set(unique) - set(apart))
    assert set(mixed) <= set(apart) and max(Counter(r.doc_id for r in kept[-1]).values()) <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(final) == len(kept[-1]) and all(r.exact and r.n_tokens == len(r.ids) for r in final)


def test_one_row_of_each_group_stays(spark):
    text = lambda k, *at: " ".join("x" if i in at else f"w{k}v{i}" for i in range(40))
    rows = [(1, text(1), "a")] * 6  # one row again and again
    rows += [(2, text(2), "a"), (2, text(1), "a"), (None, text(2), "b")]  # a copy under the id of a kept row, one without
    rows += [(None, text(3), "b")] * 3 + [(None, text(3, 0), "b"), (5, text(4), "a"), (5, text(4, 39), "a"), (5, text(5), "b")]
    rows += [(None, None, "a"), (8, "", "b")]
    docs = corpus_pipeline.stage(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "pipeline-test")
    seen = []
    for apply in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        docs = corpus_pipeline.stage(apply(spark, docs, SF), "pipeline-test")
        seen.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    unique, apart, mixed = seen
    assert unique == Counter([(1, text(1)), (2, text(2)), (None, text(3)), (None, text(3, 0)), (5, text(4)), (5, text(4, 39)), (5, text(5)), (8, "")])
    assert sum(apart.values()) == 6 and set(apart) <= set(unique) and {t[-4:] for _, t in apart} >= {"1v39", "2v39", "3v39", "5v39"}
    assert set(mixed) <= set(apart) and max(mixed.values()) <= 2 and any(i is None for i, _ in mixed)


def test_stages_bound_the_bytes_of_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = corpus_pipeline.stage(read(spark, SF, "documents").limit(20), "pipeline-test")
    for name, apply in corpus_pipeline.STAGES:
        if name == "mix_sources":  # has no Python step
            continue
        spark.conf.set(key, str(64 << 20))
        apply(spark, docs, SF)
        assert int(spark.conf.get(key)) <= 4 << 20, name
