"""Near duplicates by a Jaccard join on word n-grams: rare-first prefix filtering.

A document's set holds the hashes of its distinct 5-word shingles (fewer words: one shingle of all of them). Documents
with equal sets form a class, and only classes are joined. Two classes link when 100 |x & y| >= 80 |x | y|.

1. Order. A fixed table of cells counts, over all documents, how many hold a shingle of each cell. Shingles are sorted
   by that count, rarest first, then by hash: any order that is the same everywhere keeps the join exact, and this one
   keeps frequent shingles out of prefixes.
2. Prefixes. Sets that reach the threshold share one of their first n - ceil(0.8 n) + 1 shingles. Prefix shingles that
   two classes have make a list of candidates.
3. Pairs. In each list the class with the fewest shingles of its own is the hub and is paired with the others that pass the length and the
   positional filter. Pairs of many lists are verified once: a suffix filter that compares counts on the halves of the
   hash range, then the exact intersection. Links are contracted to components.
4. What hubs leave open. Members of one list that are not yet in one component meet further hubs, then all of each
   other, so no link between different texts is lost, while a large group of near copies costs one comparison for each
   member and list, not all pairs. Components are what links give; links inside a component are not listed.

Shingles and classes are told apart by 64-bit hashes. Null texts and texts without words have empty sets and link with
nothing. Repeated rows are in one class. Rows with a null doc_id link like others; their component_id is the smallest
doc_id of the component, or null where none of its rows has one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traincover.llm.base import mix, sequence_hashes, smaller, texts_of, word_hashes, words
from traincover.session import bound_batches, release, stage

SHINGLE = 5
THRESHOLD = 80  # in hundredths
# Cells of the table that counts shingles: its size is that of the broadcast, one byte each.
CELL_BITS = 22
_BLOCK = 1 << 14
_BATCH = 256
# Bits of the filter that picks the documents whose sets are needed.
_PICK_BITS = 1 << 23
# Bits of the filter that keeps shingles of one class out of the join.
_LIST_BITS = 1 << 26
# Bytes of the blocks in which a filter travels.
_BIT_BLOCK = 1 << 16
# Further hubs of each list before the rest of the list is joined in full.
FURTHER_HUBS = 4


def shingle_set(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(sequence_hashes(word_hashes(words(text)), n))


def _class_of(shingles: np.ndarray) -> int:
    """The signed 64-bit name of a set; 0 is the empty one."""
    if not len(shingles):
        return 0
    total = np.array([len(shingles)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(shingles).sum(dtype=np.uint64)
    return int(mix(total).view(np.int64)[0]) or 1


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


# Rows of the first pass: documents (block is null) and, from each task, blocks of its cell counts.
_PASS = "doc_id long, class long, n long, block int, dense boolean, counts binary"


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    names = ["doc_id", "class", "n", "block", "dense", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def rows(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        seen = False
        for batch in smaller(batches, _BATCH):
            seen = True
            sets = [shingle_set(t, n) for t in texts_of(batch)]
            cells += np.bincount(_cell(np.concatenate(sets)), minlength=len(cells)).astype(np.uint32) if sum(map(len, sets)) > 200_000 else 0
            if sum(map(len, sets)) <= 200_000:
                np.add.at(cells, _cell(np.concatenate(sets)), 1)
            size = len(sets)
            yield rows([batch.column("doc_id").to_pylist(), [_class_of(s) for s in sets], [len(s) for s in sets], [None] * size, [None] * size, [None] * size])
        if not seen:
            return
        for block in range(len(cells) // _BLOCK):
            own = cells[block * _BLOCK: (block + 1) * _BLOCK]
            at = np.flatnonzero(own)
            if not len(at):
                continue
            # Few cells: (cell, count) pairs; many: a byte each, with what is over 255 as pairs behind them.
            if len(at) < _BLOCK // 6:
                packed, dense = np.stack([at.astype("u4"), own[at]]).tobytes(), False
            else:
                over = np.flatnonzero(own > 255)
                packed, dense = np.minimum(own, 255).astype("u1").tobytes() + np.stack([over.astype("u4"), own[over]]).tobytes(), True
            yield rows([[None], [None], [None], [block], [dense], [packed]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PASS)


def _unpack(dense: bool, packed: bytes) -> np.ndarray:
    if not dense:
        at, n = np.frombuffer(packed, "u4").reshape(2, -1)
        own = np.zeros(_BLOCK, np.uint32)
        own[at] = n
        return own
    own = np.frombuffer(packed[:_BLOCK], "u1").astype(np.uint32)
    at, n = np.frombuffer(packed[_BLOCK:], "u4").reshape(2, -1)
    own[at] = n
    return own


def _levels(first: DataFrame) -> bytes:
    """One byte for each cell, increasing with its count: the order of shingles. Its size is fixed."""
    blocks = (1 << CELL_BITS) // _BLOCK

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, dense, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "dense", "counts"))):
                sums[block] = sums.get(block, np.uint64(0)) + _unpack(dense, packed)
        for block, total in sums.items():
            level = np.floor(8 * np.log2(total + 1.0)).clip(0, 255).astype("u1")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()])], names=["block", "levels"])

    spread = first.where("block is not null").select("block", "dense", "counts").repartition(16, "block")
    table = np.zeros((blocks, _BLOCK), "u1")
    for block, levels in spread.mapInArrow(add, "block int, levels binary").collect():
        table[block] = np.frombuffer(levels, "u1")
    return table.tobytes()


def _postings(docs: DataFrame, levels: bytes, n: int, threshold: int) -> DataFrame:
    """shingle, class, n, position for the prefix of each set; a task lists a class once as long as it remembers it."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, "u1")
        seen: set[int] = set()
        for batch in smaller(batches, _BATCH):
            out = []
            for text in texts_of(batch):
                own = shingle_set(text, n)
                name = _class_of(own)
                if not name or name in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(name)
                size = len(own)
                prefix = size - -(-threshold * size // 100) + 1
                first = np.lexsort((own, table[_cell(own)]))[:prefix]
                out.append((own[first].view(np.int64), np.full(prefix, name, np.int64), np.full(prefix, size, np.int32), np.arange(prefix, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["shingle", "class", "n", "position"])

    return docs.select("text").mapInArrow(run, "shingle long, class long, n int, position int")


def _mark(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _packed_bits(own: np.ndarray) -> bytes:
    """A block of a bitmap; few bytes that hold a bit as (place, byte) pairs, which then are shorter than the block."""
    at = np.flatnonzero(own)
    return at.astype("u4").tobytes() + own[at].tobytes() if 5 * len(at) < len(own) else own.tobytes()


def _add_bits(own: np.ndarray, packed: bytes) -> None:
    if len(packed) == len(own):
        own |= np.frombuffer(packed, "u1")
    else:
        n = len(packed) // 5
        own[np.frombuffer(packed[:4 * n], "u4")] |= np.frombuffer(packed[4 * n:], "u1")


def _bitmap(table: DataFrame, column: str, bits: int) -> bytes:
    """A bit for each value of a column of longs, null counting as 0. The size is fixed: the more values, the less it tells
    apart. Blocks that hold a bit meet in tasks, so that the driver gets each of them once."""
    block = min(bits // 8, _BIT_BLOCK)

    def rows(blocks) -> pa.RecordBatch:
        numbers, packed = zip(*blocks)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["block", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 8, "u1")  # packed as np.packbits packs: a task holds bits / 8 bytes
        for batch in batches:
            at = np.unique(_mark(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), bits))
            np.bitwise_or.at(found, at >> 3, (np.uint8(128) >> (at & 7).astype("u1")).astype("u1"))
        for number, own in enumerate(found.reshape(-1, block)):
            if own.any():
                yield rows([(number, _packed_bits(own))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _add_bits(met.setdefault(number, np.zeros(block, "u1")), packed)
        for number, own in met.items():
            yield rows([(number, _packed_bits(own))])

    form = "block int, bits binary"
    marked = table.select(column).coalesce(8).mapInArrow(mark, form).repartition("block").mapInArrow(meet, form)
    total = np.zeros((bits // 8 // block, block), "u1")
    for number, packed in marked.collect():
        _add_bits(total[number], packed)
    return total.tobytes()


def _shared_lists(postings: DataFrame, threshold: int) -> DataFrame:
    """shingle, class, n, position, is_hub: postings of the shingles that two classes have, staged.

    A list's hub is the class with the fewest prefix shingles of its own, then the smallest: among near copies of one
    text that is the least changed one, which most others link with.
    """
    lists = postings.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high")
    lists = stage(lists.select("shingle"), "shared")
    # Most shingles are one class's own. A bitmap keeps nearly all of them out of the join, which decides.
    shared = postings.sparkSession.sparkContext.broadcast(_bitmap(lists, "shingle", _LIST_BITS))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, "u1")
        for batch in batches:
            at = _mark(batch.column("shingle").to_numpy(), _LIST_BITS)
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype("u1") & 1).astype(bool)))

    screened = postings.mapInArrow(screen, postings.schema).join(lists, "shingle")
    members = stage(_once(screened), "members")  # a class may come from several tasks
    release(lists)
    prefix = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    own = members.groupBy("class").agg(F.max(prefix).alias("prefix"), F.count("*").alias("in_lists"))
    order = F.shiftleft(F.least(F.col("prefix") - F.col("in_lists"), F.lit(32767)).cast("long"), 47) + F.shiftrightunsigned("class", 17)
    keyed = stage(members.join(own.select("class", order.alias("order")), "class"), "keyed")
    release(members)
    first = keyed.groupBy("shingle").agg(F.min("order").alias("first"))
    marked = keyed.join(first, "shingle").select("shingle", "class", "n", "position", (F.col("order") == F.col("first")).alias("is_hub"))
    marked = stage(marked, "lists")
    release(keyed)
    return marked


def _once(table: DataFrame, *more: str) -> DataFrame:
    return table.groupBy("shingle", "class", *more).agg(F.min("n").alias("n"), F.min("position").alias("position"))


def _passes(a: str, b: str, threshold: int):
    """The length and the positional filter for two postings of one shingle, taken as the first that a pair shares: no more
    than what is left of the shorter rest is shared with it. Links pass in the list of their first shared shingle."""
    na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "position") for x in (a, b))
    lengths = (100 * F.least(na, nb) >= threshold * F.greatest(na, nb))
    most = F.least(na - pa_, nb - pb)
    return lengths & ((100 + threshold) * most >= threshold * (na + nb))


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, shingles (sorted hashes) for `wanted`: doc_id (null where only rows without one have the text), class. A
    bitmap lets the scan skip most others."""
    picked = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "doc_id", _PICK_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(picked.value, "u1")
        seen: set[int] = set()  # classes of rows without a doc_id: a task lists one once as long as it remembers it
        for batch in smaller(batches, 4096):
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            at = _mark(ids, _PICK_BITS)
            hit = (packed[at >> 3] >> (7 - (at & 7)).astype("u1")) & 1
            for part in smaller([batch.take(pa.array(np.flatnonzero(hit)))], _BATCH):
                out = []
                for key, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                    own = shingle_set(text, n)
                    name = _class_of(own)
                    if key is None:
                        if name in seen:
                            continue
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(name)
                    out.append((key, name, own.tobytes()))
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "class", "shingles"]
                )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, class long, shingles binary")
    # Rows that repeat a doc_id may hold other texts: the class tells. Rows of one class hold one set, so any of them
    # serves (null doc_ids too); keeping one per class reuses the join's partitioning by class, sets move once.
    return made.join(wanted.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"]).select("class", "shingles")


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted sets reach the threshold."""
    need = threshold * (len(a) + len(b))
    # Suffix filter: hashes below and above a middle can be shared only with hashes on the same side.
    middle = a[len(a) // 2]
    left_a, left_b = len(a) // 2, int(np.searchsorted(b, middle))
    if (100 + threshold) * (min(left_a, left_b) + min(len(a) - left_a, len(b) - left_b)) < need:
        return False
    return (100 + threshold) * len(np.intersect1d(a, b, assume_unique=True)) >= need


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that link. Only the sets of classes in a pair are made, from one document each."""
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = stage(classes.join(asked, "class"), "wanted")
    sets = stage(_sets(docs, wanted, n), "sets")
    release(wanted)
    left, right = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, 1024):
            a, b = batch.column("set_a"), batch.column("set_b")
            ok = [linked(np.frombuffer(a[i].as_buffer(), "u8"), np.frombuffer(b[i].as_buffer(), "u8"), threshold) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    links = stage(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "links")
    release(sets)
    return links


def _relabel(table: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """`column` replaced by its parent, where it has one."""
    return table.join(parents.withColumnRenamed("node", column), column, "left").withColumn(
        column, F.coalesce("parent", column)
    ).drop("parent")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """class, component (its smallest class) for every class in `links` (a, b). Each round every node joins its smallest
    neighbour if that is smaller, and the graph is contracted; a round at least halves the nodes that have links.

    `known` is the result for earlier links: then only what `links` adds to it is worked through.
    """
    edges = links
    if known is not None:
        parents = known.select(F.col("class").alias("node"), F.col("component").alias("parent"))
        edges = _relabel(_relabel(links, "a", parents), "b", parents)
    edges = _edges(edges)
    members = None
    while not edges.isEmpty():
        parents = stage(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        if members is None:
            nodes = edges.select(F.col("a").alias("class")).unionByName(edges.select(F.col("b").alias("class"))).distinct()
            members = nodes.withColumn("component", F.col("class"))
        before, members = members, stage(_relabel(members, "component", parents).select("class", "component"), "members")
        moved = _edges(_relabel(_relabel(edges, "a", parents), "b", parents))
        release(before, edges, parents)
        edges = moved
    release(edges)
    if members is None:
        return known if known is not None else links.select(F.col("a").alias("class"), F.col("b").alias("component")).limit(0)
    if known is None:
        return members
    moved = _relabel(known, "component", members.select(F.col("class").alias("node"), F.col("component").alias("parent")))
    added = members.join(known, "class", "left_anti")
    return stage(moved.select("class", "component").unionByName(added), "members")


def _edges(pairs: DataFrame) -> DataFrame:
    """The distinct edges (a < b) of pairs (a, b), staged."""
    return stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")


def _pairs(asking: DataFrame, others: DataFrame, threshold: int, apart) -> DataFrame:
    """Distinct (a, b), a from `asking` and b from `others`, that share a list and pass the filters and `apart`."""
    met = asking.alias("x").join(others.alias("y"), F.col("x.shingle") == F.col("y.shingle"))
    return met.where(apart & _passes("x", "y", threshold)).select(
        F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")
    ).distinct()


def class_components(docs: DataFrame, classes: DataFrame, levels: bytes, n: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """class, component for the classes that link with another. `classes`: class, doc_id of one of its documents."""
    postings = stage(_postings(docs, levels, n, threshold), "postings")
    lists = _shared_lists(postings, threshold)
    release(postings)

    hubs, others = lists.where("is_hub"), lists.where("not is_hub")
    tested = stage(_pairs(hubs, others, threshold, F.lit(True)), "pairs")
    members = components(_verified(tested, docs, classes, n, threshold))

    # What is open after the hubs: lists whose other members are in several components.
    for further in (FURTHER_HUBS, None):
        labelled = others.join(members, "class", "left").withColumn("component", F.coalesce("component", "class"))
        open_lists = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        rest = stage(labelled.join(open_lists.select("shingle"), "shingle"), "open")
        if rest.isEmpty():
            break
        asking, apart = rest, F.col("x.component") != F.col("y.component")
        if further:
            lane = F.pmod(F.xxhash64("class"), F.lit(further)).alias("lane")
            asking = rest.join(rest.groupBy("shingle", lane).agg(F.min("class").alias("class")), ["shingle", "class"], "left_semi")
        else:
            apart = apart & (F.col("x.class") < F.col("y.class"))
        pairs = stage(_pairs(asking, rest, threshold, apart).join(tested, ["a", "b"], "left_anti"), "pairs")
        release(rest)
        members = components(_verified(pairs, docs, classes, n, threshold), members)
        tested = tested.unionByName(pairs)
    return members


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links): one row for each row of `docs`."""
    bound_batches(docs.sparkSession)  # 10,000 rows may be whole texts or pairs of sets
    first = stage(_first_pass(docs, n), "shingled")
    own = first.where("block is null").select("doc_id", "class", F.col("n").alias("n_shingles"))
    classes = stage(own.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "classes")
    members = class_components(docs, classes, _levels(first), n, threshold)
    of_component = members.join(classes, "class").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = members.join(of_component, "component").select("class", "component_id")
    named = stage(classes.join(of_class, "class", "left").select("class", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    alone = own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.where("n_shingles > 0").join(named, "class").select("doc_id", "n_shingles", "component_id").unionByName(alone)
