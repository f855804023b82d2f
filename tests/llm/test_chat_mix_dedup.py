"""Chat formatting, mixing and exact dedup on hard cases, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from traincover.llm import chat, exact, mixing

DOCS = "doc_id long, text string, source string, score int, kept string"


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def _read_back(spark, rows):
    made = chat.format_conversations(_turns(spark, rows)).select(
        "conv_id", "n_turns", "n_blocks", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return {r.conv_id: r for r in made.collect()}


def test_chat_reads_back_any_text(spark):
    alphabet = ["<|", "|>", "\\", "0", "1", "2", "\n", "im_start", "<|im_sep|>", "<|im_end|>\n", "<", "|", "é", "😀", " "]
    pick = random.Random(3)
    rows, want = [], defaultdict(list)
    for conv in range(60):
        for turn in range(pick.randint(1, 7)):
            role = pick.choice(["user", "assistant", "assistant", "a\nb\\1", "", None])
            text = pick.choice([None, "", "".join(pick.choices(alphabet, k=pick.randint(1, 12)))])
            rows.append((conv, turn, role, text, "x"))
            want[conv].append((role or "", text or ""))
    pick.shuffle(rows)
    got = _read_back(spark, rows)
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].n_blocks == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))


def test_chat_ties_nulls_and_nothing(spark):
    got = _read_back(spark, [(None, 1, "user", "q", ""), (1, None, "user", "first", ""), (1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", "")])
    assert [t.text for t in got[1].turns] == ["first", "a", "a", "b"]
    assert got[1].formatted == "<|im_start|>user\nfirst<|im_sep|>a<|im_sep|>a<|im_sep|>b<|im_end|>\n"
    assert got[None].n_turns == 1
    assert _read_back(spark, []) == {}


def test_chat_long_text(spark):
    text = "é<|" * 200_000
    got = _read_back(spark, [(1, 0, "assistant", text, "")])
    assert got[1].turns[0].text == text and got[1].loss == text


def _mixed(spark, rows, **options):
    mixture, per_doc = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3), **options)
    return mixture.collect(), per_doc.collect()


def _filled(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    pick = random.Random(5)
    rows = []
    for i in range(400):
        source = pick.choice(["hot"] * 6 + ["b", "ä", "Z", "", None, "tiny", "none"])
        words = 0 if source == "none" else pick.choice([0, 1, 3, 30, 400]) if source != "tiny" else 1
        rows.append((i, None if i % 50 == 0 and source == "b" else " \t\n\x0b".join(["w"] * words), source, 1, "k"))
    rows += rows[:3]  # repeated rows
    mixture, docs = _mixed(spark, rows, block_words=64)
    assert len(docs) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = _filled(sizes)
    for r in docs:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
    for source, words in taken.items():
        assert abs(words - want[source]) <= 0.5 + 1e-6
    assert sorted(map(str, docs)) == sorted(map(str, _mixed(spark, rows, block_words=64)[1]))
    # A slot holds one source, and pieces of at most a block; early slots already have the shares of all.
    in_slot = defaultdict(set)
    for p in mixture:
        in_slot[p.slot].add(p.source)
    assert all(len(s) == 1 for s in in_slot.values())
    hot = [s for s in in_slot if "hot" in in_slot[s]]
    early = [s for s in hot if s < sum(want.values()) / 64 / 2]
    assert abs(len(early) - len(hot) / 2) < 6


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert _mixed(spark, []) == ([], [])
    mixture, docs = _mixed(spark, [(1, "", None, 1, ""), (2, None, "a", 1, ""), (2, " \t", "a", 1, "")])
    assert mixture == [] and [(r.target, r.taken) for r in docs] == [(0.0, 0)] * 3


def _groups(rows):
    found = defaultdict(list)
    for i, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        found[hashlib.sha256(plain.encode()).hexdigest()].append((-len(text or ""), float("inf") if i is None else i))
    return found


def test_exact_dedup_matches_plain_grouping(spark):
    pick = random.Random(7)
    rows = [(i, pick.choice([None, "", " ", "\n", "a", "a ", " a\t", "b ", "b", "long " * 30_000, f"own {i}"])) for i in range(600)]
    rows += rows[:5] + [(None, "a        b"), (None, "only here")]
    docs = spark.createDataFrame([(*r, "s", 1, "other") for r in rows], DOCS).repartition(5)
    got = exact.exact_dedup(docs).collect()
    groups = _groups(rows)
    assert len(got) == len(rows)
    for r in got:
        members = groups[r.text_sha256]
        best = min(members)[1]
        assert r.group_size == len(members)
        assert r.keep_id == (None if best == float("inf") else best)
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact.exact_dedup(docs.limit(0)).collect() == []


def test_filter_never_forgets_and_resizes():
    pick = random.Random(1)
    shard, live = exact.Shard(), {}
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(6000)]
    for step in range(20_000):
        key = pick.choice(keys)
        if pick.random() < 0.6:
            shard.insert(key, 1, (0, step))
            live[key] = live.get(key, 0) + 1
        elif key in live:
            shard.delete(key, 1)
            live[key] -= 1
            if not live[key]:
                del live[key]
    assert len(shard.filter.slots) > 256
    for key in keys:
        at = shard.find(key)
        assert (shard.counts[at] if at is not None else 0) == live.get(key, 0)
    assert sum(map(len, shard.filter.slots)) == len(live)


def test_false_hits_are_told_apart():
    shard = exact.Shard()
    one = "0" * 64
    other = "0" * 63 + "1"  # same bucket and fingerprint
    shard.insert(one, 1, (0, 1))
    assert shard.filter.candidates(other) and shard.find(other) is None
    shard.insert(other, 1, (0, 2))
    shard.delete(one, 1)
    assert shard.find(one) is None and shard.find(other) is not None


def test_index_follows_deletions(spark):
    rows = [(1, "a"), (2, "a "), (3, "b"), (4, "c"), (5, "a  ")]
    docs = spark.createDataFrame([(*r, "s", 1, "") for r in rows], DOCS)
    found = exact.digests(docs)
    index = exact.insert(None, found, 4)
    left = found.where("doc_id not in (3, 5)")
    after = {r.keep_id: r.group_size for r in exact.delete(index, found.where("doc_id in (3, 5)"), left, 4).collect()}
    assert after == {2: 2, 4: 1}
    again = {r.keep_id: r.group_size for r in exact.insert(exact.insert(None, left, 4), found.where("doc_id in (3, 5)"), 4).collect()}
    assert again == {5: 3, 3: 1, 4: 1}
