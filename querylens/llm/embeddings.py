"""Embedding near-dedup by an epsilon grid order join (operator 7).

Equal vectors of a label are one class, counted. Unit vectors are sorted by
the grid cells of their leading principal dimensions, cells as wide as the
greatest distance of a link. The sequence is cut into blocks; blocks whose
boxes are provably too far apart never meet. Where two meet, their intervals
are halved again and again, and halves too far apart are dropped, until few
vectors are left to compare in full. A task returns counts of links and a
spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import drop_table, materialize
from .gray_index import unite

#: Leading dimensions of the grid, those by whose cells blocks meet, vectors of a block and of an interval that is not halved any more.
GRID_DIMS, MEET_DIMS, BLOCK, LEAF = 8, 3, 16_384, 256
#: Vectors that a task puts into grid order.
ORDERED_ROWS = 32_768


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal size as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: no cosine changes, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("dim").to_numpy()
    for d in np.unique(sizes):
        yield batch.filter(pa.array(sizes == d))


def _axes(classes: DataFrame, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and k leading principal axes of the unit vectors, for each size of vector; from all rows."""

    def sums(batches):
        for batch in batches:
            for part in _by_size(batch):
                x = _scaled(_matrix(part.column("v")))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                d = x.shape[1]
                value = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), d, np.int32)), pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], ["dim", "at", "value"])

    rows = classes.select("dim", "v").mapInArrow(sums, "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).toArrow()
    dim, at, value = (rows.column(x).to_numpy() for x in ("dim", "at", "value"))
    out = {}
    for d in np.unique(dim):
        mine = np.zeros((dim == d).sum())
        mine[at[dim == d]] = value[dim == d]
        n, mean, second = mine[0], mine[1 : d + 1] / mine[0], mine[d + 1 :].reshape(d, d) / mine[0]
        axes = np.linalg.eigh(second - np.outer(mean, mean))[1][:, ::-1][:, :k]
        out[int(d)] = (mean, axes)
    return out


def join_intervals(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, same: bool, reach: float, least: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a cosine of least or more, of vectors a and b in grid order with projections pa_ and pb.

    With same, a and b are one sequence and each pair comes once, i < j.
    """
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    ua, ub = a / na[:, None], b / nb[:, None]
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or same and k + m < i + j:
            continue
        gap = np.maximum(0, np.maximum(pa_[i:j].min(axis=0) - pb[k:m].max(axis=0), pb[k:m].min(axis=0) - pa_[i:j].max(axis=0)))
        if gap @ gap > reach * reach:
            continue
        if j - i <= leaf and m - k <= leaf:
            x, y = np.nonzero(ua[i:j] @ ub[k:m].T >= least - 1e-9)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                exact = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= least
                yield x[exact], y[exact]
        elif same and (i, j) == (k, m):
            h = (i + j) // 2
            todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif j - i >= m - k:
            todo += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
        else:
            todo += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]


def embedding_links(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in
    double precision, is least or more; copies link each other. Vectors that are
    null, empty, zero, or hold a null or non-finite component, and those with a
    null id, link nothing: no links, a component of their own. Vectors of
    different sizes never link. Repeated rows count as vectors of their own.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    ok = F.coalesce(F.expr(finite), F.lit(False))
    good = rows.where(ok)
    classes = materialize(good.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "classes")
    reach = float(np.sqrt(2 - 2 * least)) + 1e-7
    axes = _axes(classes, GRID_DIMS)

    def projected(batches):
        for batch in batches:
            for part in _by_size(batch):
                v = _scaled(_matrix(part.column("v")))
                x = v / np.linalg.norm(v, axis=1, keepdims=True)
                mean, axis = axes[x.shape[1]]
                p = np.zeros((len(x), GRID_DIMS))
                p[:, : axis.shape[1]] = (x - mean) @ axis
                cells = np.floor(p / reach).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "dim", "node", "copies")), pa.array(list(v), pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))], ["label", "dim", "node", "copies", "v", "p", "cells"])

    kind = classes.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dim int, node long, copies long, v array<double>, p array<double>"
    placed = classes.mapInArrow(projected, schema + ", cells array<int>")
    order = ["label", "dim", *(F.col("cells")[i] for i in range(GRID_DIMS)), "node"]
    parts = max(4, -(-classes.count() // ORDERED_ROWS))

    def blocked(batches):
        number, held, last = -1, 0, None
        task = TaskContext.get().partitionId()
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            for i, key in enumerate(keys):
                if key != last or held == block:
                    number, held, last = number + 1, 0, key
                out[i] = task << 32 | number
                held += 1
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(np.arange(batch.num_rows, dtype=np.int64)), *(batch.column(c) for c in ("label", "dim", "node", "copies", "v", "p", "cells"))], ["block", "seq", "label", "dim", "node", "copies", "v", "p", "cells"])

    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = materialize(ordered.mapInArrow(blocked, f"block long, seq long, {schema}, cells array<int>"), "grid-order")
    boxes = ordered.groupBy("block", "label", "dim").agg(F.array(*(F.min(F.col("p")[i]) for i in range(GRID_DIMS))).alias("lo"), F.array(*(F.max(F.col("p")[i]) for i in range(GRID_DIMS))).alias("hi"))
    boxes = materialize(boxes, "boxes")
    # blocks meet on label and the cell of the leading dimensions, each taken with its neighbours on one side

    def met(more: int) -> list:
        return [F.expr(f"sequence(cast(floor(lo[{i}] / {reach}) as int) - {more}, cast(floor(hi[{i}] / {reach}) as int) + {more})") for i in range(MEET_DIMS)]

    def at_cells(df: DataFrame, more: int) -> DataFrame:
        for i, cells in enumerate(met(more)):
            df = df.withColumn(f"c{i}", F.explode(cells))
        return df

    at = [f"c{i}" for i in range(MEET_DIMS)]
    left = at_cells(boxes, 1).select("label", "dim", F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), *at)
    right = at_cells(boxes, 0).select("label", "dim", F.col("block").alias("b"), "lo", "hi", *at)
    gap = "aggregate(sequence(0, {0}), 0D, (s, i) -> s + pow(greatest(0D, greatest(alo[i] - hi[i], lo[i] - ahi[i])), 2))".format(GRID_DIMS - 1)
    meet = left.join(right, ["label", "dim", *at]).where("a <= b").where(F.expr(gap) <= reach * reach).select("a", "b").distinct()
    meet = materialize(meet, "meetings")
    sides = meet.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).union(meet.where("a < b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    sent = sides.join(ordered.select("block", "node", "copies", "v", "p", "cells"), "block").select("a", "b", "side", "node", "copies", "v", "p", "cells")

    def linked(key, rows):
        side = rows.column("side").to_numpy()
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        v, p, cells = _matrix(rows.column("v")), _matrix(rows.column("p")), _matrix(rows.column("cells"))
        at = np.lexsort([node, *cells.T[::-1], side])
        first = at[: int((side == 0).sum())]
        same = key[0].as_py() == key[1].as_py()
        second = first if same else at[len(first) :]
        label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        for i, j in join_intervals(v[first], v[second], p[first], p[second], same, reach, least):
            i, j = first[i], second[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            unite(label, i, j)
        out = np.flatnonzero(links)
        return pa.table({"node": node[out], "root": node[label[out]], "links": links[out]})

    found = materialize(sent.groupBy("a", "b").applyInArrow(linked, "node long, root long, links long"), "links")
    for done in (ordered, boxes, meet):
        drop_table(done)
    comps = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "node", "left").join(comps, "node", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.join(classes, ["label", "v"]).select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
