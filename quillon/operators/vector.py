"""Approximate nearest neighbours by cosine: an inverted file of k-means cells, probed and ranked exactly.

The cells' centres are fitted on at most ``SAMPLE`` rows (fewer where vectors are long: at most ``FLOATS`` numbers), every row is put into its
nearest cell, and a query reads its nearest cells: as many as give the wanted recall when ``TRIALS`` rows of that sample are looked for in the
sample, where neighbours lie no nearer than in the whole. Centres are the only thing that is broadcast: at most ``MOST_CELLS`` of them.
A cell is cut into chunks of about ``CHUNK`` rows on either side, so a cell with a third of all rows is many tasks; each
task returns at most ``k`` rows a query.

Defined cases: null ids, null vectors, vectors of another length than the first's, of length zero or norm zero, and vectors that hold null,
NaN or infinity are not searched and find nothing; ties go to the smaller id; a row doesn't find its own id;
rows of one id count once, by the most similar; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, FLOATS, MOST_CELLS, CHUNK, TRIALS = 20_000, 8_000_000, 4_096, 4_096, 256


def _units(column: pa.Array, width: int) -> np.ndarray:
    x = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; a cell that loses all its rows keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells to read so that this share of the sample's true neighbours lies in them."""
    own = (x @ c.T).argmax(axis=1)
    q = x[:TRIALS]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    if not best.size:
        return 1
    place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)  # of each cell in the order a query reads them
    return int(np.quantile(np.take_along_axis(place, own[best], 1), recall, method="higher")) + 1


def _assign(c: np.ndarray, probes: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _units(b.column(1), c.shape[1])
            best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            rows = np.repeat(np.arange(b.num_rows), best.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(best.ravel())], names=["id", "v", "cell"])

    return run


def _search(width: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            q, r = _units(queries["v"], width), _units(rows["v"], width)
            qid, rid = np.asarray(queries["id"]), np.asarray(rows["id"])
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ r.T
                s[qid[a : a + 256, None] == rid[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, best, 1)
                keep = np.isfinite(value)
                out[0].append(np.repeat(qid[a : a + 256], best.shape[1])[keep.ravel()])
                out[1].append(rid[best][keep])
                out[2].append(value[keep])
        ids, others, value = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"id": pa.array(ids.astype(np.int64)), "neighbour": pa.array(others.astype(np.int64)), "similarity": pa.array(value.astype(np.float64))})

    return run


def _sound(d: DataFrame, width: int) -> DataFrame:
    """Rows whose vector can be compared, as doubles."""
    d = d.withColumns({"id": F.col("id").cast("long"), "v": F.col("v").cast("array<double>")}).where(F.col("id").isNotNull() & (F.size("v") == width))
    return d.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def _width(rows: DataFrame) -> int:
    head = rows.where("id is not null and size(v) > 0").select(F.size("v")).first()
    return head[0] if head else 0


def _ranked(r: DataFrame, q: DataFrame, k: int, width: int) -> DataFrame:
    """r(cell, id, v), q(cell, id, v): of each query the k most similar rows in its cells. Cells are cut into pieces, and every piece of queries meets every
    piece of rows of its cell in a task of its own."""

    def counted(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))

    sizes = counted(r, "rows").join(counted(q, "asks"), "cell")

    def piece(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    r = r.join(sizes, "cell").select("cell", piece("rows").alias("part"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "id", "v")
    q = q.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("part"), piece("asks").alias("ask"), "id", "v")
    keys = ["cell", "part", "ask"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_search(width, k), "id long, neighbour long, similarity double")
    found = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")


RESULT = "id long, rank int, neighbour long, similarity double"


def exact(rows: DataFrame, queries: DataFrame, k: int, within: str | None = None, above: float | None = None) -> DataFrame:
    """As ``nearest``, but all rows are compared, block by block; with ``within``, only rows whose value of that column is the query's;
    with ``above``, only similarities above it are returned."""
    width = _width(rows)
    if not width:
        return rows.sparkSession.createDataFrame([], RESULT)
    cell = F.col(within) if within else F.lit(0)
    r, q = (_sound(d.select("id", "v", cell.alias("cell")), width) for d in (rows, queries))
    out = _ranked(r, q, k, width)
    return out if above is None else out.where(F.col("similarity") > above)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.95) -> DataFrame:
    """rows(id, v), queries(id, v) -> (id, rank, neighbour, similarity): about this share of the k nearest rows of each query, other than itself."""
    spark, width = rows.sparkSession, _width(rows)
    if not width:
        return spark.createDataFrame([], RESULT)
    rows, queries = (_sound(d.select("id", "v"), width) for d in (rows, queries))
    bound = max(1, min(SAMPLE, FLOATS // width))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(bound).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], RESULT)
    cells = int(min(MOST_CELLS, max(1, rows.count() ** 0.5 / 2)))
    known = _units(sample["v"], width)
    c = centres(known, cells)
    probes = probes_for(known, c, k, recall)
    kind = "id long, v array<double>, cell int"
    return _ranked(rows.mapInArrow(_assign(c, 1), kind), queries.mapInArrow(_assign(c, probes), kind), k, width)
