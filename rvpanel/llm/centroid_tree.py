"""Centroid clustering with a vantage-point tree over the centroids.

Each round builds a tree over the centroids, broadcasts it, and finds every vector's nearest centroid by best-first
branch and bound: a vector opens the node with its smallest lower bound next and stops when that bound exceeds its
best distance.  Pruning is inclusive, so that a node which may hold a centroid at the same distance is still opened
and ties go to the smaller number.  Distances are exact integers; bounds are floating numbers with a margin wider
than their rounding, so they leave out nothing.  The vectors of an Arrow batch search at the same time,
each along its own path.

Tasks add up the vectors of each centroid in parts of 40 bits, and one row per centroid, component and
part goes on, so neither the size of a cluster nor of a number matters.  What a round sends to
the driver and back is bounded by the number of centroids times their dimensions, both parameters.

Edge cases: vectors of another length, null vectors and those with a null or non-finite component are left out; vectors
that repeat an id have a row each; a null id is a possible start only after all others; vectors of equal hash are
ordered by their components.  With fewer vectors than centroids every vector starts one.  Of no vectors there is no row.
Components beyond 2^24 in size are computed as Python integers; a sum or distance beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.llm.tasks import on_executors, sent
from rvpanel.sources.store import materialize

#: Components up to this size are held in 64-bit numbers.
SMALL = 1 << 24
LEAF = 2
_LONG = (1 << 63) - 1
_PART = 40
#: Wider than any rounding of distances between small vectors.
_MARGIN = 1e-3


@dataclass
class Node:
    """``members`` are compared exactly.  An inner node has one, its vantage point, and children with the least and the largest
    distance from it to a centroid below them, rounded outwards."""

    members: list[int]
    children: list[tuple[int, int, int]] = field(default_factory=list)


def _root(square: int) -> int:
    return math.isqrt(square)


def square(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def build_tree(centroids: list[list[int]], leaf: int = LEAF) -> list[Node]:
    """Nodes of the tree, its root first."""
    nodes: list[Node] = []

    def add(rest: list[int]) -> int:
        at = len(nodes)
        if len(rest) <= leaf:
            nodes.append(Node(rest))
            return at
        # The centroid farthest from the first one sees the others spread widest.
        point = max(rest, key=lambda c: (square(centroids[rest[0]], centroids[c]), -c))
        nodes.append(Node([point]))
        others = sorted((square(centroids[point], centroids[c]), c) for c in rest if c != point)
        half = (len(others) + 1) // 2
        for side in (others[:half], others[half:]):
            if side:
                child = add([c for _, c in side])
                nodes[at].children.append((child, _root(side[0][0]), _root(side[-1][0]) + 1))
        return at

    if centroids:
        add(list(range(len(centroids))))
    return nodes


def nearest(vector: list[int], centroids: list[list[int]], nodes: list[Node]) -> tuple[int, int]:
    """(squared distance, centroid) by best-first search in integers of any size."""
    best = None
    queue = [(0, 0)]
    while queue:
        bound, at = heapq.heappop(queue)
        if best is not None and bound * bound > best[0]:
            break
        node = nodes[at]
        for c in node.members:
            found = (square(vector, centroids[c]), c)
            best = found if best is None else min(best, found)
            d = found[0]
        for child, low, high in node.children:
            least = max(bound, low - _root(d) - 1, _root(d) - high, 0)
            heapq.heappush(queue, (least, child))
    return best


class Searcher:
    """The tree in arrays, for many small vectors at once."""

    def __init__(self, centroids: list[list[int]], leaf: int = LEAF):
        self.lists, self.nodes = centroids, build_tree(centroids, leaf)
        self.small = all(abs(x) <= SMALL for c in centroids for x in c)
        if not self.small or not centroids:
            return
        self.points = np.array(centroids, np.int64)
        most = max(len(n.members) for n in self.nodes)
        self.members = np.array([n.members + [-1] * (most - len(n.members)) for n in self.nodes])
        self.children = np.full((len(self.nodes), 2), -1)
        self.low, self.high = np.zeros((2, len(self.nodes), 2))
        for at, node in enumerate(self.nodes):
            for j, (child, low, high) in enumerate(node.children):
                self.children[at, j], self.low[at, j], self.high[at, j] = child, low - _MARGIN, high + _MARGIN

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Squared distance and number of each row's nearest centroid, and how many distances were computed."""
        n, computed = len(vectors), 0
        best, number = np.full(n, _LONG), np.zeros(n, np.int64)
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0
        rows = np.arange(n)
        while len(rows):
            # Every row opens its own best node; those whose best bound is beyond their best distance are done.
            node = bounds[rows].argmin(1)
            bound = bounds[rows, node]
            open_ = bound * bound <= best[rows]
            rows, node, bound = rows[open_], node[open_], bound[open_]
            bounds[rows, node] = np.inf
            d = np.zeros(len(rows))
            for j in range(self.members.shape[1]):
                c = self.members[node, j]
                has = c >= 0
                mine, c = rows[has], c[has]
                apart = vectors[mine] - self.points[c]
                found = np.einsum("ij,ij->i", apart, apart)
                computed += len(c)
                better = (found < best[mine]) | ((found == best[mine]) & (c < number[mine]))
                best[mine[better]], number[mine[better]] = found[better], c[better]
                if j == 0:
                    d = np.sqrt(found.astype(float))
            for j in range(2):
                child = self.children[node, j]
                has = child >= 0
                least = np.maximum(self.low[node, j] - d, d - self.high[node, j])
                bounds[rows[has], child[has]] = np.maximum(np.maximum(bound, least), 0)[has]
        return best, number, computed


def _integers(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each component, exactly, whatever its size."""
    out = []
    for x in values:
        top, bottom = float(x).as_integer_ratio()
        out.append(top * scale // bottom)
    return out


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x, wide) of the vectors that are kept: small ones as integers in ``x``, others as they are in ``wide``."""
    given = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.select(F.col(id_col).alias("id"), given.alias("v")).where((F.size("v") == dims) & fine)
    small = F.forall("v", lambda x: F.abs(x) <= F.lit(SMALL / scale))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return kept.select("id", F.when(small, whole).alias("x"), F.when(~small, F.col("v")).alias("wide"))


def _batches(batches, tree, scale: int):
    """(ids, small rows or list of wide ones as integers, distances, numbers) of each batch."""
    for batch in batches:
        x, wide = batch.column(1), batch.column(2)
        is_small = x.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(is_small)
        rows = x.filter(x.is_valid()).flatten().to_numpy().astype(np.int64)
        rows = rows.reshape(len(at), len(rows) // max(len(at), 1))
        lists = {int(i): _integers(wide[int(i)].as_py(), scale) for i in np.flatnonzero(~is_small)}
        if not tree.small:
            lists |= {int(i): rows[j].tolist() for j, i in enumerate(at)}
            at, rows = at[:0], rows[:0]
        found = np.zeros(len(x), object)
        number = np.zeros(len(x), np.int64)
        if len(at):
            found[at], number[at] = tree.search(rows)[:2]
        for i, v in lists.items():
            found[i], number[i] = nearest(v, tree.lists, tree.nodes)
        yield batch, at, rows, lists, found, number


def _sums(kept: DataFrame, tree, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors of each centroid."""

    def run(batches):
        total: dict[tuple[int, int, int], int] = defaultdict(int)
        for _, at, rows, lists, _, number in _batches(batches, tree.value, scale):
            wide: dict[int, list[int]] = {}
            for i, v in lists.items():
                mine = wide.setdefault(int(number[i]), [0] * dims)
                mine[:] = [a + b for a, b in zip(mine, v, strict=True)]
            order = np.argsort(number[at], kind="stable")
            groups, first = np.unique(number[at][order], return_index=True)
            for c, some in zip(groups.tolist(), np.split(rows[order], first[1:]), strict=True) if len(at) else ():
                mine = wide.setdefault(c, [0] * dims)
                mine[:] = [a + b for a, b in zip(mine, some.sum(0).tolist(), strict=True)]
            for c, n in zip(*(a.tolist() for a in np.unique(number, return_counts=True)), strict=True):
                total[c, -1, 0] += n
            for c, v in wide.items():
                for j, value in enumerate(v):
                    sign, rest, part = (-1 if value < 0 else 1), abs(value), 0
                    while rest:
                        total[c, j, part] += sign * (rest & ((1 << _PART) - 1))
                        rest, part = rest >> _PART, part + 1
        keys = list(total)
        columns = {k: pa.array([key[i] for key in keys], pa.int64()) for i, k in enumerate(("c", "j", "part"))}
        yield pa.record_batch(columns | {"s": pa.array([total[k] for k in keys], pa.int64())})

    parts = kept.mapInArrow(run, "c long, j long, part long, s long")
    out: dict[int, tuple[int, list[int]]] = {}
    for c, j, part, s in parts.groupBy("c", "j", "part").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
        n, sums = out.get(c, (0, [0] * dims))
        if j < 0:
            n = int(s)
        else:
            sums[j] += int(s) << (_PART * part)
        out[c] = (n, sums)
    return out


def first_centroids(kept: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of their id."""
    text = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    order = [F.asc_nulls_last(text), F.asc_nulls_last("x"), F.asc("wide")]
    rows = kept.orderBy(*order).limit(k).collect()
    return [list(r["x"]) if r["x"] is not None else _integers(r["wide"], scale) for r in rows]


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: str = "1:",
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance`` (squared), ``cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    on_executors(spark)
    kept = materialize(integer_vectors(vectors, dims, scale, id_col, vector))
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        tree = sent(spark, Searcher(centroids))
        for c, (n, sums) in _sums(kept, tree, dims, scale).items():
            centroids[c] = [s // n for s in sums]
        tree.destroy()
    tree = sent(spark, Searcher(centroids))

    def assign(batches):
        for batch, _, _, _, found, number in _batches(batches, tree.value, scale):
            wholes = found.tolist()
            fits = [d if d <= _LONG else None for d in wholes]
            # A sum of squares beyond 64 bits makes its cluster's and the whole inertia null.
            yield pa.record_batch(
                {"id": batch.column(0), "cluster": pa.array(number, pa.int32()), "distance": pa.array(fits, pa.int64())}
            )

    kind = kept.schema["id"].dataType.simpleString()
    placed = materialize(kept.mapInArrow(assign, f"id {kind}, cluster int, distance long"))
    complete = F.expr("CASE WHEN count(distance) = count(*) THEN sum(CAST(distance AS DECIMAL(38, 0))) END")
    inertia = {r[0]: r[1] for r in placed.groupBy("cluster").agg(complete).collect()}
    whole = None if None in inertia.values() else sum(map(int, inertia.values()))
    long = F.lit(None).cast("long")

    def fit(value):
        return long if value is None or value > _LONG else F.lit(int(value)).cast("long")

    numbers = list(range(len(centroids)))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.array(*[fit(inertia.get(c)) for c in numbers]) if numbers else F.array(long)
    return placed.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        F.get(own, F.col("cluster")).alias("cluster_inertia"),
        fit(whole).alias("inertia"),
        F.get(F.array(*map(F.lit, shas)) if shas else F.array(F.lit("")), F.col("cluster")).alias("centroid_sha256"),
    )
