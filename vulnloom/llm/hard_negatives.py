"""Hard negatives for contrastive training, from vantage-point trees over norm-augmented vectors.

With M the largest norm, each row x gets one more component, sqrt(M^2 - |x|^2), and an anchor q the component 0.  Then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a higher score is a smaller distance and a window of scores an annulus around the
anchor.  A tree halves rows at the median distance from a vantage point; by the triangle inequality a node's rows lie within
known distances of an anchor.  Nodes are visited nearest first, from the inner radius on; those inside it or outside it are
never opened, and a search ends when no unopened node can be nearer than the k-th row found.  Scores are exact, distances
only say what to skip (with a margin for rounding), so results are those of brute force.

Trees have two floors.  The upper, fitted on a bounded sample, deals all rows to cells; a cell with many rows (one vector
that is a third of all, say) is dealt on by row into parts of ``part_rows``, and each part gets its own tree in the task that
searches it.  An anchor first goes to its ``first`` nearest cells, then to those of the rest that can still matter.

Plan: rows are cleaned and written once, then dealt to cells in one Arrow pass and written.  A search cogroups parts with
blocks of the anchors that come to them: both bounded, keyed by (cell, part, block); a part hands on at most k rows for an
anchor and window, and a rank keeps k of them.  Broadcast: the upper tree (at most ``sample`` / 8 cells).  Random vectors of
many dimensions leave no node out; the cost is then that of all anchors against all rows, in blocks.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors count
as ended by zeros; an id that repeats is several rows, each an anchor by itself, and only the anchor's own row is left out;
ties go by vec_id, then by row; anchors without positives or without rows in the window are absent; scores must be whole
numbers below 2^53 (else ValueError); other columns do not pass; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnloom.llm.common import stored


@dataclass(frozen=True)
class MineOptions:
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least so many, and at most so many, hundredths of the positive's.
    low: int = 80
    high: int = 100
    #: Rows that the tree of cells is fitted on; it has at most an eighth as many cells.
    sample: int = 4096
    part_rows: int = 8192
    #: Anchors that meet a part in one group.
    block: int = 4096
    #: Rows of a leaf of a part's tree.
    leaf: int = 256
    #: Cells that an anchor visits in the first round.
    first: int = 8


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).filter(sound)


# --- trees --------------------------------------------------------------------------------------------------------


def matrix(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1, keepdims=True), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of two sets of augmented vectors."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


class Tree:
    """A vantage-point tree over augmented vectors, ``depth`` halvings deep; node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, x: np.ndarray, depth: int) -> None:
        self.depth = depth
        inner = (1 << depth) - 1
        self.points = np.zeros((inner, x.shape[1]))
        self.radius = np.zeros(inner)
        rows = [np.arange(len(x))]
        for k in range(inner):
            own = rows[k]
            if len(own):
                # A row far from the others' mean sees them at the most different distances.
                self.points[k] = x[own[np.argmax(((x[own] - x[own].mean(axis=0)) ** 2).sum(axis=1))]]
                d = distances(x[own], self.points[k : k + 1])[:, 0]
                self.radius[k] = np.median(d)
                rows += [own[d <= self.radius[k]], own[d > self.radius[k]]]
            else:
                rows += [own, own]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each row, its distances from the vantage points on the way)."""
        node, way = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            at = self.points[node]
            way[:, level] = np.sqrt(((x - at) ** 2).sum(axis=1))
            node = 2 * node + 1 + (way[:, level] > self.radius[node])
        return node - ((1 << self.depth) - 1), way

    def ancestors(self, leaf: int) -> list[int]:
        node, out = leaf + (1 << self.depth) - 1, []
        while node:
            node = (node - 1) // 2
            out.append(node)
        return out[::-1]


@dataclass
class Cells:
    """The upper tree: per cell how many parts it has, and how far its rows are from the vantage points above it."""

    tree: Tree
    square: float
    dim: int
    parts: dict[int, int]
    near: dict[int, list[float]]
    far: dict[int, list[float]]
    margin: float

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Least and greatest distances of each cell's rows from each anchor."""
        cells = sorted(self.parts)
        d = distances(np.hstack([q, np.zeros((len(q), 1))]), self.tree.points)
        low, high = np.zeros((len(q), len(cells))), np.full((len(q), len(cells)), np.inf)
        for c, cell in enumerate(cells):
            for level, node in enumerate(self.tree.ancestors(cell)):
                low[:, c] = np.maximum(low[:, c], np.maximum(self.near[cell][level] - d[:, node], d[:, node] - self.far[cell][level]))
                high[:, c] = np.minimum(high[:, c], d[:, node] + self.far[cell][level])
        return low, high, cells


class Part:
    """Rows of a part under a tree of their own."""

    def __init__(self, x: np.ndarray, vec_id: np.ndarray, label: np.ndarray, row: np.ndarray, square: float, leaf: int) -> None:
        order = np.lexsort((row, vec_id))
        x, self.square = x[order], square
        a = augmented(x, square)
        self.tree = Tree(a, max(0, math.ceil(math.log2(max(len(x), 1) / leaf))))
        place, _ = self.tree.place(a)
        order2 = np.argsort(place, kind="stable")
        self.x, self.vec_id, self.label, self.row = x[order2], vec_id[order][order2], label[order][order2], row[order][order2]
        self.bounds = np.searchsorted(place[order2], np.arange((1 << self.tree.depth) + 1))
        # Nearest and farthest rows of each node's children, from its vantage point.
        inner = (1 << self.tree.depth) - 1
        self.near, self.far = np.zeros(2 * inner + 1), np.full(2 * inner + 1, np.inf)
        a = a[order2]
        for node in range(1, 2 * inner + 1):
            first, last = node, node
            while first < inner:
                first, last = 2 * first + 1, 2 * last + 2
            rows = a[self.bounds[first - inner] : self.bounds[last - inner + 1]]
            parent = (node - 1) // 2
            d = distances(rows, self.tree.points[parent : parent + 1])[:, 0] if len(rows) else np.array([np.inf])
            self.near[node], self.far[node] = d.min(), d.max()

    def search(self, q: np.ndarray, seen: np.ndarray, label: int, row: int, windows: list[tuple[float, float]], k: int, same: bool, margin: float) -> list[list[tuple]]:
        """Per window (least, greatest score) its k best rows (-score, vec_id, row) of the same, or of other, labels.

        ``seen`` has the anchor's distances from the tree's vantage points.  All windows share one traversal: nodes come
        nearest first, and one is opened only if it may hold rows inside the widest annulus that is still wanted.
        """
        base = float(q @ q) + self.square
        away = lambda score: math.sqrt(max(base - 2 * score, 0.0)) if math.isfinite(score) else (math.inf if score < 0 else 0.0)
        best: list[list[tuple]] = [[] for _ in windows]
        inside = min(away(high) for _, high in windows)
        outside = [away(low) for low, _ in windows]
        least, most = min(low for low, _ in windows), max(high for _, high in windows)
        inner = (1 << self.tree.depth) - 1
        heap = [(0.0, 0, math.inf)]
        while heap:
            near, node, far = heapq.heappop(heap)
            if near > max(outside) + margin:
                break
            if node < inner:
                d = float(seen[node])
                for child in (2 * node + 1, 2 * node + 2):
                    low = max(near, self.near[child] - d, d - self.far[child])
                    high = min(far, d + self.far[child])
                    if high >= inside - margin and low <= max(outside) + margin and math.isfinite(self.near[child]):
                        heapq.heappush(heap, (low, child, high))
                continue
            a, b = self.bounds[node - inner], self.bounds[node - inner + 1]
            score = self.x[a:b] @ q
            fit = (score >= least) & (score <= most) & ((self.label[a:b] == label) if same else (self.label[a:b] != label))
            for i in np.flatnonzero(fit).tolist():
                if self.row[a + i] == row:
                    continue
                found = (-float(score[i]), int(self.vec_id[a + i]), int(self.row[a + i]))
                for w, (low, high) in enumerate(windows):
                    if low <= -found[0] <= high and (len(best[w]) < k or found < best[w][-1]):
                        best[w].append(found)
                        best[w].sort()
                        del best[w][k:]
                        if len(best[w]) == k:
                            outside[w] = away(-best[w][-1][0])
            if all(len(x) == k for x in best):
                least = min(-x[-1][0] for x in best)
        return best


# --- Spark --------------------------------------------------------------------------------------------------------

_WINDOWS = "array<struct<name:long,low:double,high:double>>"
_ANCHOR = f"anchor_row long, anchor_id long, label long, vector array<double>, windows {_WINDOWS}"
_FOUND = "anchor_row long, anchor_id long, name long, score double, vec_id long, row long"


def index(rows: DataFrame, options: MineOptions) -> tuple[DataFrame, Cells] | None:
    """``rows`` (row, vec_id, label, vector) dealt to (cell, part), and the tree that dealt them; None if there are none."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, most, dim = rows.agg(F.count("*"), F.max(square), F.max(F.size("vector"))).first()
    if not n:
        return None
    if most >= 2.0**53:
        raise ValueError("scores are exact below 2^53")
    depth = max(0, math.ceil(math.log2(n / options.part_rows)))
    sample = [r.vector for r in rows.select("vector", F.xxhash64("vec_id", "row").alias("h")).orderBy("h").limit(options.sample).collect()] if depth else []
    tree = Tree(augmented(matrix(sample, dim), most), min(depth, max(0, int(math.log2(max(len(sample), 8) / 8)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, way = tree.place(augmented(matrix(batch.column("vector").to_pylist(), dim), most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), *[pa.array(way[:, k]) for k in range(tree.depth)]], names=[*batch.schema.names, "cell", *[f"way{k}" for k in range(tree.depth)]])

    ways = [f"way{k}" for k in range(tree.depth)]
    dealt = stored(rows.mapInArrow(deal, "row long, vec_id long, label long, vector array<double>, cell long" + "".join(f", {w} double" for w in ways)), "vector-cells")
    facts = dealt.groupBy("cell").agg(F.count("*").alias("n"), *[f(w).alias(f"{f.__name__}{w}") for w in ways for f in (F.min, F.max)]).collect()
    cells = Cells(
        tree,
        float(most),
        dim,
        {f.cell: math.ceil(f.n / options.part_rows) for f in facts},
        {f.cell: [f[f"min{w}"] for w in ways] for f in facts},
        {f.cell: [f[f"max{w}"] for w in ways] for f in facts},
        1e-6 * (1 + math.sqrt(most)),
    )
    parts = F.element_at(F.create_map(*[F.lit(x) for cell, k in sorted(cells.parts.items()) for x in (cell, k)]), F.col("cell"))
    return dealt.drop(*ways).withColumn("part", F.pmod(F.xxhash64("row"), parts)), cells


def _visits(anchors: DataFrame, cells: Cells, options: MineOptions, first: bool) -> DataFrame:
    """``anchors`` for each (cell, part) to visit: the first nearest cells, or all others that the windows still reach."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("vector").to_pylist(), cells.dim)
            low, high, names = cells.reach(q)
            base = (q * q).sum(axis=1) + cells.square
            take, cell, part = [], [], []
            for i, windows in enumerate(batch.column("windows").to_pylist()):
                away = lambda s: math.sqrt(max(base[i] - 2 * s, 0.0)) if math.isfinite(s) else (math.inf if s < 0 else 0.0)  # noqa: B023, E731
                inside, outside = min(away(w["high"]) for w in windows), max(away(w["low"]) for w in windows)
                near = np.maximum(low[i], inside)
                order = np.argsort(near, kind="stable")
                may = (low[i] <= outside + cells.margin) & (high[i] >= inside - cells.margin)
                for c in (order[: options.first] if first else order[options.first :]).tolist():
                    if may[c]:
                        for k in range(cells.parts[names[c]]):
                            take.append(i)
                            cell.append(names[c])
                            part.append(k)
            for k in range(0, len(take), 4096):
                own = pa.RecordBatch.from_arrays([c.take(pa.array(take[k : k + 4096])) for c in batch.columns], names=batch.schema.names)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell[k : k + 4096], pa.int64()), pa.array(part[k : k + 4096], pa.int64())], names=[*own.schema.names, "cell", "part"])

    return anchors.mapInArrow(work, f"{_ANCHOR}, cell long, part long")


def _met(anchors: DataFrame, indexed: DataFrame, cells: Cells, options: MineOptions, k: int, same: bool, blocks: int) -> DataFrame:
    """What the parts that anchors visit have for their windows."""

    def meet(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asking):
            part = Part(matrix(list(rows["vector"]), cells.dim), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["row"].to_numpy(), cells.square, options.leaf)
            q = matrix(list(asking["vector"]), cells.dim)
            seen = distances(np.hstack([q, np.zeros((len(q), 1))]), part.tree.points)
            for i, a in enumerate(asking.itertuples(index=False)):
                windows = [(w["low"], w["high"]) for w in a.windows]
                best = part.search(q[i], seen[i], a.label, a.anchor_row, windows, k, same, cells.margin)
                out += [(a.anchor_row, a.anchor_id, w["name"], -s, v, r) for w, found in zip(a.windows, best, strict=True) for s, v, r in found]
        return pd.DataFrame(out, columns=["anchor_row", "anchor_id", "name", "score", "vec_id", "row"])

    keys = ["cell", "part", "block"]
    asking = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_row"), F.lit(blocks)))
    rows = indexed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))) if blocks > 1 else F.lit(0).cast("long"))
    return rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(meet, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "name").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(anchors: DataFrame, indexed: DataFrame, cells: Cells, k: int, same: bool, blocks: int, options: MineOptions = MineOptions()) -> DataFrame:
    """Per anchor and window the first k rows of the same, or of other, labels, by score, vec_id, row; with ``rank`` from 1."""
    begun = _met(_visits(anchors, cells, options, True), indexed, cells, options, k, same, blocks)
    if len(cells.parts) <= options.first:
        return stored(_best(begun, k), "vector-neighbours")
    begun = stored(_best(begun, k), "vector-begun")
    worst = begun.filter(F.col("rank") == k).select("anchor_row", "name", F.col("score").alias("worst"))
    told = worst.groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("name", "worst"))).alias("worst"))
    narrower = F.transform("windows", lambda w: F.struct(w["name"].alias("name"), F.greatest(w["low"], F.coalesce(F.element_at("worst", w["name"]), w["low"])).alias("low"), w["high"].alias("high")))
    rest = anchors.join(told, "anchor_row", "left").withColumn("windows", narrower).select(*anchors.columns)
    more = _met(_visits(rest, cells, options, False), indexed, cells, options, k, same, blocks)
    return stored(_best(begun.drop("rank").unionByName(more), k), "vector-neighbours")


def mine(vectors: DataFrame, anchor: Column, options: MineOptions = MineOptions()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, label,
    embedding) for which ``anchor`` holds: the anchor's best rows of its label, and for each the best rows of other labels
    whose score is between ``low`` and ``high`` hundredths of its own.  Components must be whole numbers."""
    rows = usable(vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False))))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), "_anchor")
    rows = stored(rows, "vectors")
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = index(rows.drop("_anchor"), options)
    if made is None:
        return spark.createDataFrame([], schema)
    indexed, cells = made
    asking = rows.filter("_anchor").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label", "vector")
    blocks = max(1, math.ceil(asking.count() / options.block))
    anywhere = F.array(F.struct(F.lit(0).cast("long").alias("name"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    positives = search(asking.withColumn("windows", anywhere), indexed, cells, options.positives, True, blocks, options)
    # A window of whole scores: its ends rounded inwards, by the integers that the bounds are told in.
    low, high = F.ceil(F.col("score").cast("decimal(38,0)") * options.low / 100), F.floor(F.col("score").cast("decimal(38,0)") * options.high / 100)
    window = F.struct(F.col("rank").cast("long").alias("name"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    windows = positives.withColumn("w", window).filter("w.low <= w.high").groupBy("anchor_row").agg(F.array_sort(F.collect_list("w")).alias("windows"))
    negatives = search(asking.join(windows, "anchor_row"), indexed, cells, options.negatives, False, blocks, options)
    named = positives.select("anchor_row", F.col("rank").cast("long").alias("name"), F.col("vec_id").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))
    paired = named.join(negatives.withColumnRenamed("score", "s"), ["anchor_row", "name"])
    return paired.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("s").cast("long").alias("negative_score"))
