"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector to the signs of random projections, concatenated to one key, and orders the vectors of a
label lexicographically by it. A vector is compared with the next :data:`WINDOW` in that order. Vectors close to each
other share a long prefix in some pass, so they meet in a window there; pairs whose cosine reaches the threshold are
united across passes. Copies of a vector are one node from the start, so they cannot fill a window.

Vectors of one label often lie in narrow cones, around one direction or many, where signs tell little. So the first hash of a
key is the nearest of a pass's own :data:`CENTRES`, and the signs are those of what is left of the vector less that centre.
The centres of a pass come from vectors of the label drawn anew, so a pair that one pass separates meets in another.

How many passes a label needs is measured: vectors of a sample (:data:`MEASURED`) are compared with the whole label, and their
links are held against the components found so far. Passes are added until :data:`RECALL` of these links lie within
components, of vectors with few links and of those with many alike. A label that :data:`MOST` passes leave short of it is
compared whole, in blocks: the exact way. Nothing of this depends on how many vectors there are.

Windows are bounded, links are not: within each component that the passes have united, all pairs are compared, in
blocks, and only counts leave the tasks. So the links of a crowded neighbourhood are complete however many share it; a
link can only be missing between two vectors that no chain of window pairs connects.

The order of a pass is cut into blocks of :data:`BLOCK` rows by rank; the last rows of a block go to the next one as
well, so windows reach across. Ranks come from range partitions and their sums. Large components are cut into blocks,
each pair of which is a task; small ones share tasks.

Only vectors of one label and one length are compared. A null label or vector, a zero vector, and one with a null or
non-finite component link with nothing; their row is its own component. Repeated rows are copies. A row without an id
counts as a link of others; a component of such rows alone has no id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.llm.components import components
from triplane.llm.mixing import _before
from triplane.llm.simhash_trie import _union
from triplane.shared import materialise

THRESHOLD = 0.98
SIGNS, CENTRES = 48, 32
#: Vectors of a label that centres are drawn from, and those whose links measure recall.
SAMPLE, MEASURED = 4096, 1024
RECALL = 0.98
#: Passes of the first round; later rounds have as many as all before them.
PASSES = 16
#: Passes after which a label still short of the recall is compared whole.
MOST = 256
#: Vectors of a label that a task hashes or measures at once.
SLICE = 20_000
WINDOW, BLOCK = 64, 4096
#: Vectors of a component in one block of the exact count.
PART = 1000


def comparable(embedding: Column) -> Column:
    """False for null and zero vectors and for those with null or non-finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``(node, label, embedding, n, least)``: one row per distinct comparable vector of a label."""
    fit = vectors.where(F.col("label").isNotNull() & comparable(F.col("embedding"))).withColumn("node", F.xxhash64("label", "embedding"))
    return fit.groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least"))


def _drawn(nodes: DataFrame, most: int) -> DataFrame:
    """So many vectors of each label, the least by hash."""
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64(F.lit(11), "node"))
    return nodes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _in_slices(nodes: DataFrame, sizes: DataFrame, other: DataFrame, run, kind: str) -> DataFrame:
    """``run`` over slices of each label's nodes, each with all rows of that label of ``other``."""
    slices = sizes.select("label", "dim", F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    left = nodes.join(slices, ["label", "dim"]).withColumn("slice", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("slices")).cast("int")).drop("slices")
    right = other.join(slices, ["label", "dim"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both may come from one table
    keys = ["label", "dim", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, kind)


def keyed(nodes: DataFrame, sizes: DataFrame, sample: DataFrame, first: int, last: int, seed: int = 0) -> DataFrame:
    """``(node, label, dim, pass, key)`` for the passes from ``first`` up to ``last``."""
    label = nodes.schema["label"].dataType.simpleString()

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.sort_values("node")["embedding"].tolist())
        out = []
        for n in range(first, last):
            own = x[np.random.default_rng([seed, x.shape[1], n]).permutation(len(x))[:CENTRES]]
            for _ in range(2):
                near = (x @ own.T - (own * own).sum(axis=1) / 2).argmax(axis=1)
                total, count = np.zeros_like(own), np.bincount(near, minlength=len(own))
                np.add.at(total, near, x)
                own = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], own)
            out.append(own.ravel())
        return pd.DataFrame({"label": pdf["label"].iloc[0], "dim": x.shape[1], "pass": range(first, last), "centres": out})

    def hashed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, dim = unit(left["embedding"].tolist()), int(left["dim"].iloc[0])
            powers = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
            for n, own in zip(right["pass"], right["centres"], strict=True):
                own = own.reshape(-1, dim)
                near = (x @ own.T - (own * own).sum(axis=1) / 2).argmax(axis=1)
                plane = np.random.default_rng([seed, dim, n, 1]).normal(size=(dim, SIGNS))
                key = near.astype(np.int64) << SIGNS | ((x - own[near]) @ plane > 0) @ powers
                out.append(pd.DataFrame({"node": left["node"], "label": left["label"], "dim": dim, "pass": n, "key": key}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("node", "label", "dim", "pass", "key")}).astype({"node": np.int64, "dim": np.int32, "pass": np.int32, "key": np.int64})

    fits = sample.select("label", "dim", "node", "embedding").groupBy("label", "dim").applyInPandas(centres, f"label {label}, dim int, pass int, centres array<double>")
    return _in_slices(nodes.select("label", "dim", "node", "embedding"), sizes, fits, hashed, f"node long, label {label}, dim int, pass int, key long")


def measured(nodes: DataFrame, sizes: DataFrame, reach: DataFrame, threshold: float) -> DataFrame:
    """``(label, dim, recall)``: of the links of sampled vectors, the share within components; the lesser of vectors with few links and with many."""
    placed = nodes.join(reach, "node", "left").select("label", "dim", "node", "embedding", "n", F.coalesce("root", "node").alias("root"))
    asked = _drawn(placed, MEASURED)
    label = nodes.schema["label"].dataType.simpleString()

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"label": [], "dim": [], "node": [], "true": [], "met": []}).astype({"dim": np.int32, "node": np.int64, "true": np.int64, "met": np.int64})
        x, q = unit(left["embedding"].tolist()), unit(right["embedding"].tolist())
        near = q @ x.T >= threshold
        near &= right["node"].to_numpy()[:, None] != left["node"].to_numpy()
        same = near & (right["root"].to_numpy()[:, None] == left["root"].to_numpy())
        n = left["n"].to_numpy()
        return pd.DataFrame({"label": right["label"], "dim": right["dim"], "node": right["node"], "true": near @ n, "met": same @ n})

    found = _in_slices(placed, sizes, asked, count, f"label {label}, dim int, node long, true long, met long")
    each = found.groupBy("label", "dim", "node").agg(F.sum("true").alias("true"), F.sum("met").alias("met")).where(F.col("true") > 0)
    share = F.col("met") / F.col("true")
    few = F.col("true") <= WINDOW
    kinds = each.groupBy("label", "dim").agg(F.avg(F.when(few, share)).alias("few"), F.avg(F.when(~few, share)).alias("many"))
    return kinds.select("label", "dim", F.least("few", "many").alias("recall"))


def _pairs_of_parts(own: Column, parts: Column) -> Column:
    """Each pair of parts that a row of the part ``own`` belongs to."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(own, p).alias("i"), F.greatest(own, p).alias("j")))


def _compared(threshold: float, window: int):
    """Links of a block of a pass (rows in order, windows) or of a pair of parts (all pairs): a spanning forest."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        node, rank, label = pdf["node"].to_numpy(), pdf["rank"].to_numpy(), pdf["label"].to_numpy()
        size = pdf["embedding"].map(len).to_numpy()
        place = np.arange(len(pdf))
        union = place.copy()
        for d in np.unique(size):
            rows = place[size == d]
            x = unit(pdf["embedding"].iloc[rows].tolist())
            reach = window if pdf["pass"].iloc[0] >= 0 else len(rows)
            for apart in range(1, min(reach, len(rows) - 1) + 1):
                a, b = rows[:-apart], rows[apart:]
                near = np.einsum("ij,ij->i", x[:-apart], x[apart:]) >= threshold
                near &= (label[a] == label[b]) & (rank[b] - rank[a] <= window)
                if near.any():
                    _union(union, a[near], b[near])
        hung = np.flatnonzero(union != place)
        return pd.DataFrame({"a": node[hung], "b": node[union[hung]]})

    return compare


def pass_links(nodes: DataFrame, keys: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: a spanning forest, per block and pass, of the pairs in windows that reach the threshold."""
    ranked = _before(keys.withColumn("one", F.lit(1).cast("long")), "pass", ["label", "dim", "key", "node"], "one").select("node", "pass", F.col("before").alias("rank"))
    own = F.floor(F.col("rank") / block)
    places = F.when(F.col("rank") % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = ranked.select("node", "pass", "rank", F.explode(places).alias("block")).join(nodes.select("node", "label", "embedding"), "node")
    return dealt.groupBy("pass", "block").applyInPandas(_compared(threshold, window), "a long, b long").distinct()


def all_links(nodes: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """``(a, b)``: a spanning forest, per pair of parts of a label, of all its pairs that reach the threshold."""
    cut = nodes.join(sizes, ["label", "dim"]).withColumn("parts", F.ceil(F.col("size") / part).cast("int"))
    cut = cut.withColumn("pair", F.explode(_pairs_of_parts(F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"), F.col("parts"))))
    task = F.xxhash64("label", "dim").bitwiseOR(F.lit(-(1 << 63)))  # below all passes
    dealt = cut.select(task.alias("pass"), "pair.i", "pair.j", "node", F.lit(0).cast("long").alias("rank"), "label", "embedding")
    return dealt.groupBy("pass", "i", "j").applyInPandas(_compared(threshold, 0), "a long, b long").distinct()


def window_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b)``: links that connect what the passes, or all pairs of a label, connect; labels take as many passes as they need."""
    nodes = nodes.withColumn("dim", F.size("embedding"))
    sizes = materialise(nodes.groupBy("label", "dim").agg(F.count("*").alias("size")))
    done, found = 0, []
    sample = None
    while sizes.limit(1).count():
        passes = max(PASSES, done)
        own = materialise(nodes.join(sizes.select("label", "dim"), ["label", "dim"]))
        if done >= MOST:
            found.append(materialise(all_links(own, sizes, threshold, PART)))
            break
        sample = materialise(_drawn(own, SAMPLE)) if sample is None else sample
        kept = sample.join(sizes.select("label", "dim"), ["label", "dim"])
        found.append(materialise(pass_links(own, keyed(own, sizes, kept, done, done + passes), threshold, WINDOW, BLOCK)))
        done += passes
        reach = materialise(components(reduce(DataFrame.unionByName, found), "a", "b"))
        short = measured(own, sizes, reach, threshold).where(F.col("recall") < RECALL).select("label", "dim")
        sizes = materialise(sizes.join(short, ["label", "dim"]))
    return reduce(DataFrame.unionByName, found).distinct() if found else nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def link_counts(members: DataFrame, threshold: float = THRESHOLD, part: int | None = None) -> DataFrame:
    """``(node, linked)``: vectors of other nodes of the same component that link, copies counted.

    ``members``: node, root, label, embedding, n.
    """
    part = part or PART
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    cut = members.join(sizes, "root").withColumn("parts", F.ceil(F.col("m") / part).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int"))
    # a component of one part is a row of a shared task, others meet as pairs of parts
    tasks = max(1, members.count() // (4 * part))
    shared = cut.where("parts = 1").withColumns({"task": F.pmod(F.xxhash64("root"), F.lit(tasks)), "i": F.lit(-1), "j": F.lit(-1)})
    split = cut.where("parts > 1").withColumn("pair", F.explode(_pairs_of_parts(F.col("part"), F.col("parts")))).withColumns({"task": F.col("root"), "i": F.col("pair.i"), "j": F.col("pair.j")})
    columns = ["task", "i", "j", "root", "part", "node", "label", "embedding", "n"]
    tasks = shared.select(*columns).unionByName(split.select(*columns))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        out = []
        for _, own in pdf.groupby("root"):
            x, n = unit(own["embedding"].tolist()), own["n"].to_numpy()
            if i == j:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                out.append(pd.DataFrame({"node": own["node"], "linked": near @ n}))
                continue
            left = own["part"].to_numpy() == i
            near = x[left] @ x[~left].T >= threshold
            out.append(pd.DataFrame({"node": own["node"][left], "linked": near @ n[~left]}))
            out.append(pd.DataFrame({"node": own["node"][~left], "linked": n[left] @ near}))
        return pd.concat(out)

    found = tasks.groupBy("task", "i", "j").applyInPandas(count, "node long, linked long")
    return found.groupBy("node").agg(F.sum("linked").alias("linked"))


def digest(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vectors = vectors.select("vec_id", "embedding", "label")
    nodes = materialise(nodes_of(vectors))
    reach = materialise(components(materialise(window_links(nodes, threshold)), "a", "b"))
    linked = link_counts(materialise(nodes.join(reach, "node")), threshold)
    named = nodes.select("node", "n", "least").join(reach, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named)
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    each = named.join(smallest, "root").select(F.col("node").alias("of"), "component", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    fit = F.col("label").isNotNull() & comparable(F.col("embedding"))
    met = vectors.select("vec_id", F.when(fit, F.xxhash64("label", "embedding")).alias("node")).join(each, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return met.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
