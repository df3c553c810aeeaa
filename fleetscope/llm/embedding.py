"""Embedding near-dedup: PCA-ordered tiled comparison.

Vectors of one label are scaled to length one and rotated onto the principal axes of all vectors, so that the leading
coordinates carry most of every product. Cells of the leading coordinates, as wide as two linked vectors can lie apart, say
which vectors can meet at all; the more vectors there are, the more coordinates make a cell. Before two tiles travel to each
other, their bounding boxes over all coordinates must lie near enough. Tiles that meet are compared a few dimensions at a time:
what the rest can still add is bounded by the product of the suffix norms, and a pair stops as soon as its cosine cannot
reach the threshold. Pairs that are left are decided on the vectors themselves in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .components import connected_components

#: Leading coordinates that make the cells at least and at most; rows of a tile; dimensions added at a time.
CELL_DIMS, MOST_DIMS, TILE, STEP = 2, 6, 768, 16


def marked(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector: array of double or float, ok): ok if it can link, with label and components not null, all finite, not all zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"  # half the bytes where that is all the input has
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda v: (v.cast("double") + F.lit(0.0)).cast(kind)).alias("vector"))
    return rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0), F.lit(False)))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes of the scaled vectors of each size, from one matrix of second moments a task, summed as a tree.

    Sizes differ only in odd inputs; each has its own matrix. What a task gives doesn't grow with its rows.
    """

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for size, x in by_size(b.column(0))[1]:
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[size] = total.get(size, 0) + x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))], names=["size", "m"]
        )

    parts = map_arrow(vectors.select("vector"), partial, "size int, m array<double>")
    summed = parts.select("size", F.posexplode("m").alias("i", "v")).groupBy("size", "i").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for size, m in summed.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m")).collect():
        moments = np.array([x["v"] for x in m]).reshape(size, size)
        found[size] = np.linalg.eigh(moments)[1][:, ::-1].copy()
    return found


def by_size(column: pa.ListArray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(size of each vector, [(size, matrix of its vectors in order)])."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(at)
    out = []
    for size in np.unique(sizes).tolist():
        first = at[:-1][sizes == size]
        out.append((size, flat[first[:, None] + np.arange(size)]))
    return sizes, out


def reach(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two rotated, scaled matrices whose product may reach the threshold, by leading dimensions and suffix norms."""
    d = a.shape[1]
    slack = threshold - 1e-9
    suffix = lambda x: np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]))  # noqa: E731  norm from a column on
    sa, sb = suffix(a), suffix(b)
    partial = a[:, :step] @ b[:, :step].T
    rest = np.outer(sa[:, step], sb[:, step]) if step < d else 0
    i, j = np.nonzero(partial + rest >= slack)
    done, value = step, partial[i, j]
    while done < d and len(i):
        end = min(d, done + step)
        value = value + np.einsum("ij,ij->i", a[i, done:end], b[j, done:end])
        rest = sa[i, end] * sb[j, end] if end < d else 0
        keep = value + rest >= slack
        i, j, value, done = i[keep], j[keep], value[keep], end
    return i, j


def similar_vectors(rows: DataFrame, scratch: Scratch, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Only vectors of one label (not null) and one size are compared. A vector that is null, zero, empty or holds a null or
    non-finite component links with nothing: no links, its own component, kept. Copies of a vector are compared once and
    counted as often as they come. Ids are taken as unique; rows with a null id link, but name no component.
    """
    base = marked(rows)
    good = base.where("ok")
    copies = scratch.cut(good.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low")).withColumn("rep", F.xxhash64("label", "vector")))
    rotations = scratch.spark.sparkContext.broadcast(axes(copies))  # a square matrix for each size of vector
    width = float(np.sqrt(2 - 2 * threshold)) * 1.0001

    def cells(batches):
        for b in batches:
            cell = np.zeros((b.num_rows, MOST_DIMS), np.int64)
            sizes, parts = by_size(b.column(3))
            for size, x in parts:
                y = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotations.value[size][:, :MOST_DIMS]
                cell[sizes == size, : y.shape[1]] = np.floor(y / width)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * MOST_DIMS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(cell.ravel()))], names=["rep", "label", "n", "vector", "size", "cell"])

    kinds = dict(copies.dtypes)
    placed = scratch.cut(map_arrow(copies.select("rep", "label", "n", "vector"), cells, f"rep long, label {kinds['label']}, n long, vector {kinds['vector']}, size int, cell array<bigint>"))
    n = placed.count()
    dims = CELL_DIMS
    while dims < MOST_DIMS and n > TILE * placed.select("label", "size", F.slice("cell", 1, dims)).distinct().count():
        dims += 1
    placed = placed.withColumn("cell", F.slice("cell", 1, dims))
    # tiles of a cell, by hash: their number follows the cell's count
    counts = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dealt = placed.join(counts, ["label", "size", "cell"]).withColumn("tile", F.pmod(F.hash("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.repartition("label", "size", "cell", "tile")  # else the join's partitioning serves, and a hot cell's tiles are made in one task
    listed = dealt.groupBy("label", "size", "cell", "tile").agg(F.collect_list(F.struct("rep", "n", "vector")).alias("rows"))

    def boxes(batches):
        for b in batches:
            low, high = [], []
            for i in range(b.num_rows):
                size = b.column(1)[i].as_py()
                x = _unpack(b.column(4)[i].values, size)[2]
                y = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotations.value[size]
                low.append(y.min(0) - 1e-9)
                high.append(y.max(0) + 1e-9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))], names=[*b.schema.names, "low", "high"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    tiles = scratch.cut(map_arrow(listed, boxes, f"{schema}, low array<double>, high array<double>"))
    # each tile meets those of its own cell and of the neighbours, once, if their boxes are near enough
    own = tiles.select("label", "size", "cell", "tile", "low", "high", F.explode(F.array(*[F.array(*[(F.col("cell")[k] + s[k]) for k in range(dims)]) for s in _shifts(dims)])).alias("to"))
    there = tiles.select("label", "size", F.col("cell").alias("to"), F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = "aggregate(zip_with(zip_with(low, high2, (a, b) -> a - b), zip_with(low2, high, (a, b) -> a - b), (a, b) -> pow(greatest(a, b, 0D), 2)), 0D, (s, x) -> s + x)"
    pairs = own.join(there, ["label", "size", "to"]).where("struct(cell, tile) <= struct(to, other)").where(F.expr(apart) <= width**2).select("label", "size", "cell", "tile", "to", "other")
    left = tiles.select("label", "size", "cell", "tile", F.col("rows").alias("a"))
    right = tiles.select("label", "size", F.col("cell").alias("to"), F.col("tile").alias("other"), F.col("rows").alias("b"))
    met = pairs.join(left, ["label", "size", "cell", "tile"]).join(right, ["label", "size", "to", "other"])
    met = met.select("size", "a", "b", F.expr("cell = to AND tile = other").alias("same"))

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                size, same = b.column(0)[i].as_py(), b.column(3)[i].as_py()
                (ra, na, xa), (rb, nb, xb) = (_unpack(b.column(k)[i].values, size) for k in (1, 2))
                ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (xa, xb))
                turn = rotations.value[size]
                p, q = reach(ua @ turn, ub @ turn, threshold)
                if same:
                    p, q = p[p < q], q[p < q]
                # the deciding product is that of the vectors themselves
                cosine = np.einsum("ij,ij->i", xa[p], xb[q]) / (np.linalg.norm(xa[p], axis=1) * np.linalg.norm(xb[q], axis=1))
                p, q = p[cosine >= threshold], q[cosine >= threshold]
                for s in range(0, len(p), 1 << 16):
                    u, v = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                    # of a tile pair: what each vector gains, and a spanning set of links
                    yield _links(ra, na, rb, nb, u, v)

    links = scratch.cut(map_arrow(met, compare, "a long, b long, gain long"))
    gains = links.groupBy(F.col("a").alias("rep")).agg(F.sum("gain").alias("gain"))
    roots = connected_components(links.where("a <> b").select("a", "b"), scratch).withColumnRenamed("node", "rep")
    named = copies.select("label", "vector", "rep", "n", "low").join(gains, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = scratch.cut(named)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = named.join(lowest, "root").select("rep", (F.coalesce("gain", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    keyed = good.select("vec_id", F.xxhash64("label", "vector").alias("rep")).join(facts, "rep").select("vec_id", "n_links", "component_id")
    alone = base.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keyed.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _shifts(dims: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(dims):
        out = [(*s, d) for s in out for d in (-1, 0, 1)]
    return out


def _unpack(rows: pa.StructArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = rows.field("vector")
    flat = vectors.values.to_numpy(zero_copy_only=False)
    at = vectors.offsets.to_numpy()
    return rows.field("rep").to_numpy(), rows.field("n").to_numpy(), flat[at[0] : at[-1]].reshape(-1, size).astype(np.float64)


def _links(ra: np.ndarray, na: np.ndarray, rb: np.ndarray, nb: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """One row for each vector at most: its gain from these links, beside a partner; the rows span the links' components."""
    reps, at = np.unique(np.concatenate([ra[p], rb[q]]), return_inverse=True)
    i, j = at[: len(p)], at[len(p) :]
    gain = np.bincount(i, nb[q], len(reps)) + np.bincount(j, na[p], len(reps))
    # hook each node to the smallest root until no link parts two roots; then one row a node spans them
    root = np.arange(len(reps))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new != new[new]).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(reps[root]), pa.array(gain.astype(np.int64))], names=["a", "b", "gain"])


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))


#: Every pair of a label, and what its links reach.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""
