"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 40_000


#: Quantiles of the absolute value of a standard normal variable.
FOLDED = np.array([NormalDist().inv_cdf(0.5 + (k + 0.5) / 64) for k in range(32)])


class Forest:
    """Trees of random splits at a sample's median; points within ``spill`` of a split go to both sides.

    A pair with a cosine of ``threshold`` differs along a random direction by
    a normal variable of known width. A node stays a leaf where a split would
    part more than ``part`` of such pairs, or leave less than ``together`` of
    them in one leaf of the tree: groups that are dense at that distance are
    not cut, at any depth.
    """

    def __init__(
        self, sample: np.ndarray, trees: int, depth: int, spill: float, threshold: float, seed: int = 5, part: float = 0.25, together: float = 0.5
    ) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth, dim = trees, depth, sample.shape[1]
        inner = (1 << depth) - 1
        self.nodes = 2 * inner + 1
        self.direction = rng.standard_normal((trees, max(1, inner), dim)).astype(np.float32)
        self.direction /= np.linalg.norm(self.direction, axis=2, keepdims=True)
        self.low = np.zeros((trees, max(1, inner)), np.float32)
        self.high = np.zeros((trees, max(1, inner)), np.float32)
        self.split = np.zeros((trees, self.nodes), bool)
        apart = np.sqrt(max(0.0, 2 - 2 * threshold) / dim) * FOLDED
        for t in range(trees):
            members, kept = {0: np.arange(len(sample))}, {0: 1.0}
            for node in range(inner):
                own, share = members.pop(node, None), kept.pop(node, 1.0)
                if own is None or len(own) < 4:
                    continue
                x = sample[own] @ self.direction[t, node]
                cut = np.quantile(x, [0.5 - spill, 0.5, 0.5 + spill])
                ordered = np.sort(x)
                lost = np.searchsorted(ordered, cut[0], "right") - np.searchsorted(ordered, cut[2] - apart, "right")
                lost = np.where(apart > cut[2] - cut[0], lost, 0).clip(0).mean() / len(x)
                if lost > part or share * (1 - lost) < together:
                    continue
                self.split[t, node] = True
                self.low[t, node], self.high[t, node] = cut[0], cut[2]
                members[2 * node + 1], members[2 * node + 2] = own[x <= cut[1]], own[x > cut[1]]
                kept[2 * node + 1] = kept[2 * node + 2] = share * (1 - lost)
        self.earlier = self._earlier(sample, inner)

    def _earlier(self, sample: np.ndarray, inner: int) -> np.ndarray:
        """For each leaf that is an uncut node, the leaf of an earlier tree that shares most of its sample, else -1."""
        out = np.full(self.trees * self.nodes, -1, np.int64)
        rows, leaf = self.leaves(sample)
        dense = leaf % self.nodes < inner
        rows, leaf = rows[dense], leaf[dense]
        of = {k: np.zeros(len(sample), bool) for k in np.unique(leaf).tolist()}
        for k, own in of.items():
            own[rows[leaf == k]] = True
        for k, own in of.items():
            before = [(int((own & of[e]).sum()), -e) for e in of if e // self.nodes < k // self.nodes]
            if before and max(before)[0] > 0:
                out[k] = -max(before)[1]
        return out

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, leaf numbers counted through all trees and ordered by tree."""
        rows_out, leaf_out = [], []
        for t in range(self.trees):
            rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            while len(rows):
                cut = self.split[t][node]
                rows_out.append(rows[~cut])
                leaf_out.append(node[~cut] + t * self.nodes)
                rows, node = rows[cut], node[cut]
                value = np.einsum("ij,ij->i", x[rows].astype(np.float32), self.direction[t][node])
                left, right = value <= self.high[t][node], value > self.low[t][node]
                rows = np.concatenate([rows[left], rows[right]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def met_before(a: list[np.ndarray], b: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether each pair of a row of a and one of b shares a leaf before this one: each pair counts in one leaf of the forest."""

    def places(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        who, what = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
        return who[what < leaf], what[what < leaf]

    (i, p), (j, q) = places(a), places(b)
    both = np.intersect1d(p, q)
    out = np.zeros((len(a), len(b)), bool)
    for s in range(0, len(both), 512):
        some = both[s : s + 512]
        left, right = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for table, who, what in ((left, i, p), (right, j, q)):
            at = np.minimum(np.searchsorted(some, what), len(some) - 1)
            hit = some[at] == what
            table[who[hit], at[hit]] = 1
        out |= (left @ right.T) > 0
    return out


def spanning(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a link matrix joins, one a vertex at most, found by spreading minima."""
    if not mask.any():
        return []
    ids, far = np.unique(np.concatenate([left, right])), np.iinfo(np.int64).max
    at_left, at_right = np.searchsorted(ids, left), np.searchsorted(ids, right)
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, at_left, np.where(mask, label[at_right][None, :], far).min(1))
        np.minimum.at(new, at_right, np.where(mask, label[at_left][:, None], far).min(0))
        if (new == label).all():
            break
        label = new
    moved = label != ids
    return list(zip(label[moved].tolist(), ids[moved].tolist()))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, trees: int = 10, leaf_rows: int = 256, spill: float = 0.06, block_rows: int = 1024
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Links are pairs with a cosine of ``threshold`` or more in double
    precision that meet in a leaf of the forest, each counted once, whatever
    the number of leaves in which it meets. Equal vectors are one class: they
    link with each other, and with what their class links with. Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing. Vectors of each length have a forest of their own. A
    forest is fitted on a sample of at most 40,000 distinct vectors; its depth
    follows the number of vectors, but groups that are dense at the
    threshold's distance are not cut. Leaves above ``block_rows`` are compared
    block by block, so that no task holds more than two blocks; rows that were
    together in an uncut group of an earlier tree aren't compared again.
    Null vec_ids are kept and link with nothing; a repeated vec_id with equal
    vectors is one more copy, and one with other vectors has a row for each,
    which share the component and may share link counts. Other columns, of any
    name, are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.size(v) > 0
    good = good & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = common.materialize(rows.withColumn("good", F.col("good") & F.col("vec_id").isNotNull()), "vectors")
    lengths = sorted(r["n"] for r in rows.where("good").select(F.size("v").alias("n")).distinct().collect())
    alone = rows.where(~F.col("good"))
    out = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for n in lengths:  # one, as a rule
        own = rows.where(F.col("good") & (F.size("v") == n))
        out = out.unionByName(_of_one_length(own, n, threshold, trees, leaf_rows, spill, block_rows))
    return out


def _of_one_length(rows: DataFrame, dim: int, threshold: float, trees: int, leaf_rows: int, spill: float, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = common.materialize(classes, "classes")
    total = classes.count()
    rate = min(1.0, 0.9 * SAMPLE / total)
    drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * rate)).orderBy("rep").select("v").limit(SAMPLE).toPandas()
    sample = unit(np.array(drawn["v"].tolist(), float).reshape(-1, dim))
    depth = max(0, min(int(np.ceil(np.log2(max(1.0, total / leaf_rows)))), int(np.log2(max(1, len(sample) / 8)))))
    forest = spark.sparkContext.broadcast(Forest(sample, trees, depth, spill, threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1))
            row, leaf = forest.value.leaves(x)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            own = np.split(leaf, np.searchsorted(row, np.arange(1, b.num_rows)))
            again = [np.isin(forest.value.earlier[x], x).tolist() for x in own]
            cols = [b.column(0), b.column(1), b.column(2), pa.array([x.tolist() for x in own], pa.list_(pa.int32())), pa.array(again, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "v", "copies", "own", "again"])

    kinds = "rep long, v array<double>, copies long, own array<int>, again array<boolean>"
    placed = common.materialize(classes.select("rep", "v", "copies").mapInArrow(place, kinds), "leaves")
    each = F.explode(F.arrays_zip(F.col("own").alias("leaf"), F.col("again").alias("again"))).alias("at")
    in_leaf = placed.select("rep", "v", "copies", "own", each).select("rep", "v", "copies", "own", "at.leaf", "at.again")
    load = placed.select(each).groupBy("at.leaf").agg(F.count("*").alias("rows"), F.count_if("at.again").alias("old"))
    # At most trees * 2 ** (depth + 1) leaves, with depth bounded by the sample.
    # Blocks 0 to fresh - 1 meet all blocks; the old ones behind them meet only those.
    small = F.col("rows") <= block_rows
    load = load.withColumn("fresh", F.when(small, 1).otherwise(F.ceil((F.col("rows") - F.col("old")) / block_rows)).cast("int"))
    load = load.withColumn("n", F.when(small, 1).otherwise(F.col("fresh") + F.ceil(F.col("old") / block_rows)).cast("int"))
    blocked = in_leaf.join(F.broadcast(load), "leaf").withColumn("again", F.col("again") & (F.col("rows") > block_rows))
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    blocked = blocked.withColumn("block", F.when(F.col("again"), F.col("fresh") + spread(F.col("n") - F.col("fresh"))).otherwise(spread(F.col("fresh"))))
    blocked = blocked.withColumn("meets", F.when(F.col("again"), F.col("fresh")).otherwise(F.col("n"))).where("meets > 0")
    other = F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other")
    pairs = blocked.select("rep", "v", "copies", "own", "leaf", "block", other)
    pairs = pairs.select(
        "rep", "v", "copies", "own", "leaf", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )

    def compare(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rep")
        leaf, same = int(pdf["leaf"].iloc[0]), pdf["one"].iloc[0] == pdf["two"].iloc[0]
        a = pdf[pdf["block"] == pdf["one"].iloc[0]]
        b = a if same else pdf[pdf["block"] == pdf["two"].iloc[0]]
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        if not len(a) or not len(b):
            return empty
        open_ = ~met_before(a["own"].tolist(), b["own"].tolist(), leaf)
        if same:
            open_ &= np.triu(np.ones(open_.shape, bool), 1)
        if not open_.any():
            return empty
        x, y = unit(np.array(a["v"].tolist(), float)), unit(np.array(b["v"].tolist(), float))
        mask = ((x @ y.T) >= threshold) & open_
        if not mask.any():
            return empty
        ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
        n: dict[int, int] = {}
        for who, weight, links in ((ra, b["copies"].to_numpy(), mask), (rb, a["copies"].to_numpy(), mask.T)):
            counts = (links @ weight.astype(float)).astype(np.int64)
            for k in np.flatnonzero(counts).tolist():
                n[int(who[k])] = n.get(int(who[k]), 0) + int(counts[k])
        edges = spanning(mask, ra, rb)
        return pd.DataFrame(
            [(p, q, 0) for p, q in edges] + [(r, r, w) for r, w in n.items()], columns=["a", "b", "n"]
        ).astype("int64")

    found = pairs.groupBy("leaf", "one", "two").applyInPandas(compare, "a long, b long, n long")
    found = common.materialize(found, "links")
    linked = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    labels = common.components(found.where("a <> b").select("a", "b"))
    info = classes.join(linked, "rep", "left").join(labels.withColumnRenamed("v", "vertex"), F.col("rep") == F.col("vertex"), "left")
    info = info.select("v", "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "rep").alias("component_id"))
    hit = common.lookup(rows, info, "v", "copies")
    return hit.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, first by their largest component, so that none over- or underflows."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
