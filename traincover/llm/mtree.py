"""Exact top-k inner products with M-trees of paged metric nodes and best-first search.

Inner products become distances: with one more component sqrt(R^2 - |x|^2), R being the greatest norm of a tree, all
vectors lie on one sphere, and |q - x|^2 = |q|^2 + R^2 - 2 q.x. The vectors are dealt over trees. A node is a page of entries:
a routing object, its covering radius, its distance to the parent's routing object, and the child page (inner nodes), or
a vector with its distance to the parent (leaves). Nodes are rows of a table. The search opens pages in the order of the
least distance they can hold, a group of queries at a time, and leaves out every entry whose distance |d(q, parent) - d(parent, entry)| alone
already rules it out, so that its own distance is never computed. Integer components make the final scores exact; bounds
carry a margin for rounding, and pages that could tie with the k-th place are opened.

Components are floor(64 x). A vector that is null, or has null or non-finite components, takes no part; one of other length than a query
takes no part for that query. Equal scores go to the smaller vec_id, null ids last; equal vectors share one leaf entry, with as many ids as one
answer can need. Repeated ids are rows of their own, except that a query never meets rows of its own id. Fewer
candidates than k give fewer rows. An empty table gives an empty result. Other columns are ignored.

Scale: vectors are dealt by their components, so that neither null nor repeated ids meet in one tree. A tree holds a bounded
number of vectors and its node rows are written once. Queries go in blocks of bounded size, a few of them broadcast at a time. A
block reads the node rows where they lie, in a few tasks; a task keeps the best k of its trees so far, whose k-th places bound
the search of the next one. A tree that is cut between tasks is searched in parts: a page without its parent is a root.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traincover.session import bound_batches, stage

FACTOR = 64
K = 20
PAGE = 256
FAN = 64
TREE_VECTORS = 65_536
LEAST_TREES = 8
BLOCK_QUERIES = 16_384
# Blocks that are searched side by side, so that no core waits for the last task of a block.
BLOCKS_AT_ONCE = 4
# Queries that search a tree together, rows that leave a task at a time, and tasks of a block for each core.
GROUP_QUERIES = 512
FOUND_ROWS = 65_536
TASKS_A_CORE = 2
# Better rows of a group that wait until they are ranked, for each of its queries; share of a page that is worth picking.
WAITING_ROWS = 4
PICKED = 0.75
_MARGIN = 1e-6
# Below, single precision holds every integer; so it does every partial sum of q.x, none being above |q| |x|.
_SINGLE = 2.0**24

NODES = "tree int, node int, leaf boolean, n int, objects binary, radii binary, to_parent binary, children binary, ids array<array<long>>"
FOUND = "query_id long, vec_id long, score long"


def quantised(table: DataFrame, factor: int = FACTOR) -> DataFrame:
    """vec_id, v: the usable rows with integer components."""
    v = F.col("embedding").cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x * factor).cast("double")).alias("v"),
    )


def _groups(batches: Iterator[pa.RecordBatch], key: str):
    """(key, table) of runs of equal keys in sorted batches."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                current, held = keys[a], []
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


class Builder:
    """One tree over distinct vectors (rows of `points`, with the extra component)."""

    def __init__(self, points: np.ndarray, seed: int):
        self.points, self.rng = points, np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # leaf, rows or pivots, radii, distances to parent, children

    def build(self, rows: np.ndarray, centre: np.ndarray) -> int:
        """Number of the page for `rows`, under a routing object at `centre`."""
        if len(rows) <= PAGE:
            to_parent = np.linalg.norm(self.points[rows] - centre, axis=1)
            order = np.argsort(to_parent, kind="stable")
            self.nodes.append((True, rows[order], np.zeros(len(rows)), to_parent[order], np.full(len(rows), -1)))
            return len(self.nodes) - 1
        fan = min(FAN, -(-len(rows) // (PAGE // 2)))
        pivots = self.rng.choice(rows, size=max(fan, 2), replace=False)
        nearest = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 8192):  # squared distances but for a term that all pivots share
            part = self.points[rows[a: a + 8192]]
            nearest[a: a + 8192] = ((self.points[pivots] ** 2).sum(axis=1) - 2 * part @ self.points[pivots].T).argmin(axis=1)
        kept, radii, children = [], [], []
        for i, pivot in enumerate(pivots):
            own = rows[nearest == i]
            if not len(own):
                continue
            for part in np.array_split(own, 2) if len(own) == len(rows) else [own]:
                centre_i = self.points[pivot]
                radii.append(np.linalg.norm(self.points[part] - centre_i, axis=1).max() + _MARGIN)
                children.append(self.build(part, centre_i))
                kept.append(pivot)
        kept = np.array(kept)
        to_parent = np.linalg.norm(self.points[kept] - centre, axis=1)
        self.nodes.append((False, kept, np.array(radii), to_parent, np.array(children)))
        return len(self.nodes) - 1


def _lifted(points: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)
    return np.hstack([points, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]])


def build_index(vectors: DataFrame, trees: int, k: int = K) -> DataFrame:
    """Node rows of M-trees over `vectors` (vec_id, v). Page 0 of a tree is its root."""
    # Rows of one length make a tree of their own.
    dealt = vectors.select(F.pmod(F.xxhash64("v"), F.lit(trees)).cast("int").alias("part"), F.size("v").alias("width"), "vec_id", "v")
    # Equal vectors make one entry, with the ids that an answer can need. So a vector that makes up much of the table
    # arrives as a few rows.
    merged = dealt.mapInArrow(_merge_equal(k), "part int, width int, v array<double>, ids array<long>")
    keyed = merged.withColumn("tree", (F.col("part") + trees * F.col("width")).cast("int"))
    sorted_rows = keyed.repartitionById(trees, "part").sortWithinPartitions("tree")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _groups(batches, "tree"):
            points = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            lists = table["ids"].combine_chunks()
            points, inverse = np.unique(points, axis=0, return_inverse=True)
            entry = np.repeat(inverse.ravel(), pc.list_value_length(lists).to_numpy())
            ids = _needed(entry, lists.flatten(), k).to_pylist()
            lifted = _lifted(points)
            builder = Builder(lifted, int(number))
            root = builder.build(np.arange(len(points)), lifted[0])
            for node, (leaf, rows, radii, to_parent, children) in enumerate(builder.nodes):
                yield pa.RecordBatch.from_pydict({
                    "tree": [number], "node": [0 if node == root else node + 1], "leaf": [leaf], "n": [len(rows)],
                    "objects": [lifted[rows].tobytes()], "radii": [radii.tobytes()], "to_parent": [to_parent.tobytes()],
                    "children": [(children + 1).astype("i4").tobytes()], "ids": [[ids[r] for r in rows] if leaf else []],
                }, schema=pa.schema([
                    ("tree", pa.int32()), ("node", pa.int32()), ("leaf", pa.bool_()), ("n", pa.int32()), ("objects", pa.binary()),
                    ("radii", pa.binary()), ("to_parent", pa.binary()), ("children", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))),
                ]))

    return sorted_rows.mapInArrow(build, NODES)


def _needed(entry: np.ndarray, ids: pa.Array, k: int) -> pa.ListArray:
    """The ids of each entry that an answer can need, null ids last. `entry`: the number of each id's entry, none is left out.

    No answer has more than k rows, so an id counts k times at most; without a query's own id the first 2 k still hold k.
    """
    null, values = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    order = np.lexsort((values, null, entry))
    entry, null, values = entry[order], null[order], values[order]
    another = np.diff(entry, prepend=-1) != 0
    another[1:] |= (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    kept = _ranks(another) < k
    entry, null, values = entry[kept], null[kept], values[kept]
    kept = _ranks(np.diff(entry, prepend=-1) != 0) < 2 * k
    entry, null, values = entry[kept], null[kept], values[kept]
    offsets = np.append(np.flatnonzero(np.diff(entry, prepend=-1)), len(entry))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64(), mask=null))


def _ranks(starts: np.ndarray) -> np.ndarray:
    """The place of each row in its run, from 0. `starts`: where a run begins."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def _merge_equal(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width")
            for width in pc.unique(widths).to_pylist():
                if not width:
                    continue
                rows = batch.filter(pc.equal(widths, width))
                points = rows.column("v").flatten().to_numpy().reshape(-1, width)
                # A vector has one part, and floor() leaves no negative zero: equal bytes are equal rows.
                whole = np.ascontiguousarray(points).view(np.dtype((np.void, 8 * width))).ravel()
                _, first, entry = np.unique(whole, return_index=True, return_inverse=True)
                ends = pa.array(np.arange(len(first) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    rows.column("part").take(pa.array(first)), pa.array(np.full(len(first), width), pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(points[first].ravel())), _needed(entry.ravel(), rows.column("vec_id"), k),
                ], names=["part", "width", "v", "ids"])

    return merge


class Tree:
    """The pages of one tree, or of a part of it, ready to be searched."""

    def __init__(self, table: pa.Table):
        rows = table.to_pylist()
        # An id's place in the order of ids, nulls last, stands for it; the last place holds the null id.
        known = sorted({i for row in rows for some in row["ids"] for i in some if i is not None})
        self.ids, self.place = pa.array([*known, None], pa.int64()), {i: at for at, i in enumerate([*known, None])}
        self.pages = {}
        for row in rows:
            n = row["n"]
            objects = np.frombuffer(row["objects"]).reshape(n, -1)
            entry = np.repeat(np.arange(len(row["ids"])), [len(some) for some in row["ids"]])
            places = np.array([self.place[i] for some in row["ids"] for i in some], np.int64)
            self.pages[row["node"]] = (
                row["leaf"], objects, np.frombuffer(row["radii"]), np.frombuffer(row["to_parent"]),
                np.frombuffer(row["children"], "i4"), entry, places,
            )
        below = {int(child) for leaf, *_, children, _, _ in self.pages.values() if not leaf for child in children}
        self.roots = [node for node in self.pages if node not in below]  # the root, and pages whose parent lies elsewhere
        objects = self.pages[self.roots[0]][1]
        self.width = objects.shape[1] - 1
        self.square = float((objects[0] ** 2).sum())  # R^2: all lifted vectors have this length
        self.computed = 0
        self.single: dict[int, np.ndarray] = {}  # objects of leaves in single precision, as they are wanted

    def _leaf(self, node: int, dtype: np.dtype) -> np.ndarray:
        """The objects of a leaf, for scores in `dtype`."""
        objects = self.pages[node][1]
        if dtype == objects.dtype:
            return objects
        if node not in self.single:
            self.single[node] = objects.astype(dtype)
        return self.single[node]

    def search(self, query: np.ndarray, own, k: int) -> list[tuple[int, int]]:
        """The best k (score, id), by score, then the smaller id."""
        _, places, scores = self.search_all(query[None, :], [own], k)
        return list(zip(scores.tolist(), self.ids.take(pa.array(places)).to_pylist()))

    def search_all(
        self, queries: np.ndarray, own: list, k: int, floors: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, place of the id, score) of the best k of each row of `queries`, best first; of those, rows
        below the score in `floors` may be missing."""
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        own_places = np.array([self.place.get(i, -1) for i in own], np.int64)
        longest = np.sqrt((lifted**2).sum(axis=1).max(initial=0) * self.square)
        exact = lifted.astype("f4") if longest < _SINGLE / 2 else lifted
        floors = self._first_floors(lifted, own_places, np.full(len(queries), -np.inf) if floors is None else floors, k)
        # Queries whose nearest entry of the root is the same want much the same pages.
        order = np.argsort((lifted @ self.pages[self.roots[0]][1].T).argmax(axis=1), kind="stable")
        found = []
        for start in range(0, len(order), GROUP_QUERIES):
            group = order[start: start + GROUP_QUERIES]
            best = _Best(floors[group], k)
            self._search_group(lifted[group], exact[group], own_places[group], best)
            rows, slots = np.nonzero(best.places >= 0)
            found.append((group[rows], best.places[rows, slots], best.scores[rows, slots].astype(np.int64)))
        return tuple(np.concatenate(parts) for parts in zip(*found))

    def _first_floors(self, lifted: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> np.ndarray:
        """`floors`, where unknown from the leaf to which the nearest routing objects lead. So hardly a query has to open
        pages one by one until it has k rows, and most pages are opened once for a whole group."""
        floors = floors.copy()
        ways = [(self.roots[0], np.flatnonzero(np.isneginf(floors)))]
        while ways:
            node, who = ways.pop()
            leaf, objects, _, _, children, entry, places = self.pages[node]
            if not leaf:
                nearest = (lifted[who] @ objects.T).argmax(axis=1)  # all objects are equally long
                ways += [(int(children[at]), who[nearest == at]) for at in np.unique(nearest) if int(children[at]) in self.pages]
            elif len(entry) >= k:
                for a in range(0, len(who), GROUP_QUERIES):
                    some = who[a: a + GROUP_QUERIES]
                    scores = (lifted[some] @ objects.T)[:, entry]
                    scores[places == own[some][:, None]] = -np.inf
                    floors[some] = np.partition(scores, -k, axis=1)[:, -k]
        return floors

    def _search_group(self, lifted: np.ndarray, exact: np.ndarray, own: np.ndarray, best: _Best) -> None:
        """Best-first search of a group: a page is opened once for all queries that may need it then.

        Pages wait in the order of the least distance that any of their queries can find there. A query without k rows
        yet opens a page only when no nearer one of its own is waiting, so that a neighbour in the group can't send it
        to far pages first. `exact`: the same queries, in a precision that is enough for scores.
        """
        base = (lifted**2).sum(axis=1) + self.square
        reach = np.sqrt(np.maximum(base - 2.0 * best.floors, 0.0))  # distances of the k-th places, as far as they are known
        # A page waits once, for all queries that still want it: (queries, their least distances there, distances to its
        # routing object). The heap may hold it more than once, and holds no arrays, which don't compare.
        heap: list[tuple[float, int]] = []
        waiting: dict[int, list[tuple]] = {}

        def wait(node: int, who: np.ndarray, bounds: np.ndarray, to_centre: np.ndarray | None) -> None:
            waiting.setdefault(node, []).append((who, bounds, to_centre))
            heapq.heappush(heap, (float(bounds.min()), node))

        for root in self.roots:  # distances to a root's routing object are not known
            wait(root, np.arange(len(lifted)), np.zeros(len(lifted)), None)
        while heap:
            least, node = heapq.heappop(heap)
            if least > reach.max() + _MARGIN:
                break
            held = waiting.pop(node, None)
            if held is None:
                continue
            who, bounds, to_centre = held[0] if len(held) == 1 else (np.concatenate(parts) for parts in zip(*held))
            now = bounds <= np.where(reach[who] < np.inf, reach[who], least) + _MARGIN
            later = ~now & (reach[who] == np.inf)
            if later.any():
                wait(node, who[later], bounds[later], to_centre[later])
            if not now.all():
                who, to_centre = who[now], to_centre[now]
            if not len(who):
                continue
            leaf, objects, radii, to_parent, children, entry, places = self.pages[node]
            near = np.arange(len(objects))
            if to_centre is not None:
                reached = reach[who] + _MARGIN
                # Most often some query reaches from the nearest to the farthest entry.
                if not ((to_centre - reached <= to_parent.min()) & (to_centre + reached >= to_parent.max())).any():
                    near = np.flatnonzero((np.abs(to_centre[:, None] - to_parent) - radii <= reached[:, None]).any(axis=0))
                if not len(near):
                    continue
            asked = exact if leaf else lifted
            part = self._leaf(node, exact.dtype) if leaf else objects
            if len(near) > PICKED * len(objects):
                near = np.arange(len(objects))
            part = part[near] if len(near) < len(objects) else part
            self.computed += len(part) * len(who)
            products = asked[who] @ part.T
            if leaf:
                scores = products  # sums of products of integers
                if len(near) < len(objects) or len(entry) > len(objects):
                    spot = np.full(len(objects), -1)
                    spot[near] = np.arange(len(near))
                    listed = spot[entry] >= 0
                    scores, places = scores[:, spot[entry[listed]]], places[listed]
                if best.take(who, scores, places, own[who]):
                    full = np.flatnonzero(best.places[:, -1] >= 0)
                    reach[full] = np.sqrt(np.maximum(base[full] - 2.0 * best.scores[full, -1], 0.0))
            else:
                distances = np.sqrt(np.maximum(base[who][:, None] - 2.0 * products, 0.0))
                held = np.maximum(distances - radii[near], 0.0)
                wanted = held <= reach[who][:, None] + _MARGIN
                for column, at in enumerate(near):
                    some = np.flatnonzero(wanted[:, column])
                    if len(some) and int(children[at]) in self.pages:  # a page elsewhere is a root there
                        wait(int(children[at]), who[some], held[some, column], distances[some, column])
        best.settle()


class _Best:
    """The best k (score, place of the id) of each query of a group so far: greater scores first, then smaller places.
    Scores below a query's floor don't count."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors
        self.scores, self.places = np.full((len(floors), k), -np.inf), np.full((len(floors), k), -1, np.int64)

        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows (query, score, place) to be ranked
        self.rows = 0

    def take(self, who: np.ndarray, scores: np.ndarray, places: np.ndarray, own: np.ndarray) -> bool:
        """`scores` of the queries `who` with rows at `places`; a query never meets its own place. True if all rows taken
        so far are ranked now; they wait while every query has a floor."""
        floor = np.maximum(self.scores[who, -1], self.floors[who])
        if scores.shape[1] > self.k and np.isneginf(floor).any():
            others = np.where(places == own[:, None], scores.dtype.type(-np.inf), scores)
            floor = np.maximum(floor, np.partition(others, -self.k, axis=1)[:, -self.k])
        row, at = np.divmod(np.flatnonzero(scores >= floor.astype(scores.dtype)[:, None]), scores.shape[1])
        score, place, query = scores[row, at].astype("f8"), places[at], who[row]
        last = self.places[query, -1]
        better = (place != own[row]) & ((last < 0) | (score > self.scores[query, -1]) | (place < last))
        score, place, query = score[better], place[better], query[better]
        if not len(query):
            return False
        self.waiting.append((query, score, place))
        self.rows += len(query)
        if self.rows < WAITING_ROWS * len(self.floors) and not np.isneginf(floor).any():
            return False
        self.settle()
        return True

    def settle(self) -> None:
        """Rank the rows that wait."""
        if not self.waiting:
            return
        query, score, place = (np.concatenate(parts) for parts in zip(*self.waiting))
        self.waiting, self.rows = [], 0
        touched = np.unique(query)
        old, slot = np.nonzero(self.places[touched] >= 0)
        query = np.concatenate([touched[old], query])
        score = np.concatenate([self.scores[touched[old], slot], score])
        place = np.concatenate([self.places[touched[old], slot], place])
        order = np.lexsort((place, -score, query))
        query = query[order]
        rank = _ranks(np.diff(query, prepend=-1) != 0)
        kept = rank < self.k
        self.scores[query[kept], rank[kept]] = score[order][kept]
        self.places[query[kept], rank[kept]] = place[order][kept]


class _Found:
    """The best k (score, id) of each query of a block over the trees of a task so far, smaller ids first, null ids last."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.query, self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.int64())

    def floors(self) -> np.ndarray:
        """The score of each query's k-th place."""
        out = np.full(self.queries, -np.inf)
        ends = np.cumsum(np.bincount(self.query, minlength=self.queries))
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.k)
        out[full] = self.scores[ends[full] - 1]
        return out

    def take(self, query: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        query, scores = np.concatenate([self.query, query]), np.concatenate([self.scores, scores])
        ids = pa.concat_arrays([self.ids, ids])
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -scores, query))
        kept = order[_ranks(np.diff(query[order], prepend=-1) != 0) < self.k]
        self.query, self.scores, self.ids = query[kept], scores[kept], ids.take(pa.array(kept))


def search(queries: Broadcast, index: DataFrame, k: int = K) -> DataFrame:
    """query_id, vec_id, score: the best k of each task for each query of one block. `queries`: by width, their ids and
    vectors. `index`: a written node table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Found] = {}
        for _, table in _groups(batches, "tree"):
            tree = Tree(table)
            own, vectors = queries.value.get(tree.width, ([], None))
            if not own:
                continue
            found = held.setdefault(tree.width, _Found(len(own), k))
            query, places, scores = tree.search_all(vectors, own, k, found.floors())
            found.take(query, scores, tree.ids.take(pa.array(places)))
        for width, found in held.items():
            own = pa.array(queries.value[width][0], pa.int64())
            for a in range(0, len(found.query), FOUND_ROWS):
                part = slice(a, a + FOUND_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(found.query[part])), found.ids[part], pa.array(found.scores[part])], names=["query_id", "vec_id", "score"]
                )

    # Few tasks, however large the index: each sends up to k rows for every query.
    return index.coalesce(max(LEAST_TREES, TASKS_A_CORE * index.sparkSession.sparkContext.defaultParallelism)).mapInArrow(scan, FOUND)


def _by_width(asked: pa.Table) -> dict[int, tuple[list, np.ndarray]]:
    """The ids and vectors (vec_id, v) of the rows of each width."""
    widths = pc.list_value_length(asked["v"])
    held = {}
    for width in pc.unique(widths).to_pylist():
        rows = asked.filter(pc.equal(widths, width))
        held[width] = rows["vec_id"].to_pylist(), rows["v"].combine_chunks().flatten().to_numpy().reshape(len(rows), width)
    return held


def topk(vectors: DataFrame, is_query: Column, k: int = K, trees: int | None = None, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `vectors` (vec_id, v) that `is_query` picks, against all others."""
    spark = vectors.sparkSession
    bound_batches(spark)
    vectors = stage(vectors, "quantised")
    index = stage(build_index(vectors, trees or max(LEAST_TREES, -(-vectors.count() // TREE_VECTORS)), k), "mtree")
    asked = stage(vectors.where(is_query), "mtree-queries")
    blocks = max(1, -(-asked.count() // block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    found = []
    for start in range(0, blocks, BLOCKS_AT_ONCE):  # each block is bounded; the index is read once for each
        shared = []
        for b in range(start, min(start + BLOCKS_AT_ONCE, blocks)):
            of_block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
            shared.append(spark.sparkContext.broadcast(_by_width(of_block)))
        met = reduce(DataFrame.unionByName, [search(queries, index, k) for queries in shared])
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(stage(ranked.select("query_id", "rank", "vec_id", "score"), "mtree-found"))
        for queries in shared:
            queries.destroy()
    return reduce(DataFrame.unionByName, found)


def query_table(table: DataFrame, every: int = 20) -> DataFrame:
    """The rows whose vec_id is divisible by `every` against all rows of `table` (vec_id, embedding)."""
    return topk(quantised(table), F.col("vec_id") % every == 0)
