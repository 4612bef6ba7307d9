"""Approximate nearest neighbours by cosine: a small-world graph over each part of the rows, walked by all queries of a block in step.

``build`` deals distinct rows (id, vector and what else they carry) by hash to parts of about ``PART`` rows, so one id or one vector with a third of all
rows is spread over all parts, and links each part's distinct vectors in one task. The index is an ordinary table, one line a row, to be written and
read again; ``search`` brings every query to every part and merges the parts' best.

A graph: vectors enter in batches; each looks for its ``EFFORT`` nearest among those before it by a walk, and among its own batch exactly, and is linked both
ways with ``LINKS`` of them, those preferred that are nearer to it than to one already chosen. A vector keeps at most twice as many links. Walks start at
every sqrt(n)-th vector, compared exactly (an upper layer), and at one vector of each piece that can't be reached from these, so every row can be found.

A walk keeps the ``effort`` best vectors met and follows the nearest not yet followed, until all are. With a predicate it walks through vectors that don't fulfil it
and gathers those that do beside; the rarer they are the wider it walks, few of them are compared exactly, and a query that met less than k is compared with all.

Defined cases: as in ``vector.nearest``: null ids and vectors that can't be compared are neither indexed nor find anything; ties go to the smaller id;
a row doesn't find its own id; rows of one id count once, by the most similar; an empty table gives no rows; rows whose predicate is null don't fulfil it.
Similarities are rounded to twelve decimals, so that equal ones are. Vectors that only differ in length are one. Columns called part, node or links are the
index's own: rows that carry such a column are refused; what rows carry must be of types that can be grouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import vector

PART, FLOATS, LINKS, EFFORT, BATCH, ASKS, STEP = 8_192, 4_000_000, 16, 64, 256, 4_096, 4
OWN = ("part", "node", "links")


def _units(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of length one, whatever the size of their numbers."""
    x = np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block(width: int) -> int:
    """How many vectors walk in step: the vectors they look at are held."""
    return min(BATCH, max(16, 65_536 // width))


def _best(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line the most similar: ids, similarities and the places they had."""
    if ids.shape[1] <= keep:
        place = np.broadcast_to(np.arange(ids.shape[1]), ids.shape)
    else:
        place = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    return np.take_along_axis(ids, place, 1), np.take_along_axis(sims, place, 1), place


def walk(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, effort: int, fulfils: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each line of q about the ``effort`` nearest lines of x that fulfil the predicate: places (-1: none) and similarities, unsorted."""
    n = len(x)
    wide = effort if fulfils is None else min(n, int(np.ceil(effort * n / max(1, fulfils.sum()))))
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True  # stands for no link
    seen[:, entries] = True
    met = np.broadcast_to(entries, (len(q), len(entries)))
    sims = q @ x[entries].T
    ids, near, _ = _best(met, sims, wide)
    followed = np.zeros(ids.shape, bool)
    found = None if fulfils is None else _best(met, np.where(fulfils[met], sims, -np.inf), effort)[:2]
    active = np.arange(len(q))
    while active.size:
        ahead = np.where(followed[active], -np.inf, near[active])
        _, value, place = _best(ids[active], ahead, min(STEP, ahead.shape[1]))
        usable = np.isfinite(value)
        going = usable.any(axis=1)
        active, place, usable = active[going], place[going], usable[going]
        if not active.size:
            break
        followed[active[:, None], place] = True
        nodes = np.where(usable, ids[active[:, None], place], -1)
        to = np.where((nodes >= 0)[:, :, None], links[nodes], -1).reshape(len(active), -1)
        to = np.sort(np.where(to < 0, n, to), axis=1)
        to[:, 1:][to[:, 1:] == to[:, :-1]] = n
        to[seen[active[:, None], to]] = n
        to = np.sort(to, axis=1)
        to = to[:, : max(1, int((to < n).sum(axis=1).max()))]
        seen[active[:, None], to] = True
        new = to < n
        to = np.where(new, to, 0)
        value = np.where(new, np.matmul(x[to], q[active][:, :, None])[:, :, 0], -np.inf)
        if found is not None:
            f_ids, f_sims, _ = _best(np.hstack([found[0][active], to]), np.hstack([found[1][active], np.where(fulfils[to], value, -np.inf)]), effort)
            if f_ids.shape[1] > found[0].shape[1]:
                more = f_ids.shape[1] - found[0].shape[1]
                found = (np.pad(found[0], ((0, 0), (0, more))), np.pad(found[1], ((0, 0), (0, more)), constant_values=-np.inf))
            found[0][active], found[1][active] = f_ids, f_sims
        m_ids, m_near, place = _best(np.hstack([ids[active], to]), np.hstack([near[active], value]), wide)
        m_followed = np.take_along_axis(np.hstack([followed[active], ~new]), place, 1)
        if m_ids.shape[1] > ids.shape[1]:
            more = ((0, 0), (0, m_ids.shape[1] - ids.shape[1]))
            ids, near, followed = np.pad(ids, more), np.pad(near, more, constant_values=-np.inf), np.pad(followed, more, constant_values=True)
        ids[active], near[active], followed[active] = m_ids, m_near, m_followed
    out, value = (ids, near) if found is None else found
    return np.where(np.isfinite(value), out, -1), value


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each line's candidates (-1: none) at most ``keep``: from the most similar down those nearer to the line's own vector than to one chosen, then the
    most similar of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    c = x[np.maximum(ids, 0)]
    between = np.matmul(c, c.transpose(0, 2, 1))
    real, chosen = ids >= 0, np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        hidden = (chosen & (between[:, j, :] > sims[:, j, None])).any(axis=1)
        chosen[:, j] = real[:, j] & ~hidden & (chosen.sum(axis=1) < keep)
    first = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, first, 1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Gives the targets of the new vectors' links a link back; a full list keeps the chosen ones."""
    width = links.shape[1]
    source, target = np.repeat(new, width), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not target.size:
        return
    order = np.lexsort((source, -(x[source] * x[target]).sum(axis=1), target))
    source, target = source[order], target[order]
    own, start, count = np.unique(target, return_index=True, return_counts=True)
    rank, line = np.arange(len(target)) - np.repeat(start, count), np.repeat(np.arange(len(own)), count)
    fresh = np.full((len(own), width), -1, links.dtype)
    fresh[line[rank < width], rank[rank < width]] = source[rank < width]
    fresh[(fresh[:, :, None] == links[own][:, None, :]).any(axis=2)] = -1
    step = 2 * _block(x.shape[1])
    for a in range(0, len(own), step):
        mine = own[a : a + step]
        every = np.hstack([links[mine], fresh[a : a + step]])
        near = np.where(every >= 0, np.matmul(x[np.maximum(every, 0)], x[mine][:, :, None])[:, :, 0], -np.inf)
        links[mine] = choose(x, every, near, width)


def entries_of(links: np.ndarray, n: int) -> np.ndarray:
    """Every sqrt(n)-th vector, and one of each piece that can't be reached from those before it."""
    start = list(range(0, n, max(1, int(n**0.5))))
    reached = np.zeros(n, bool)
    edge = np.array(start, int)
    reached[edge] = True
    while True:
        while edge.size:
            to = np.unique(links[edge])
            edge = to[to >= 0]
            edge = edge[~reached[edge]]
            reached[edge] = True
        if reached.all():
            return np.array(start, int)
        edge = np.array([int(reached.argmin())])
        start.append(int(edge[0]))
        reached[edge] = True


def graph(x: np.ndarray) -> np.ndarray:
    """The links of each of these distinct unit vectors (-1: none)."""
    n, step = len(x), _block(x.shape[1])
    links = np.full((n, 2 * LINKS), -1, np.int32)
    for a in range(0, n, step):
        new = np.arange(a, min(n, a + step))
        peers = x[new] @ x[new].T
        np.fill_diagonal(peers, -np.inf)
        ids, sims, _ = _best(np.broadcast_to(new, peers.shape), peers, min(EFFORT, len(new)))
        ids = np.where(np.isfinite(sims), ids, -1)
        if a:
            before = walk(x[:a], links[:a], entries_of(links[:a], a), x[new], EFFORT)
            ids, sims = np.hstack([ids, before[0]]), np.hstack([sims, before[1]])
        chosen = choose(x, ids, sims, LINKS)
        links[new, : chosen.shape[1]] = chosen
        _link_back(x, links, new)
    return links


def _build(width: int):
    def run(rows: pa.Table) -> pa.Table:
        x, first, node = np.unique(_units(rows["v"], width).astype(np.float32), axis=0, return_index=True, return_inverse=True)
        order = np.random.default_rng(0).permutation(len(x))  # vectors enter in an order that says nothing of where they lie and is the same in every run
        number = np.argsort(order)
        links = graph(x[order])
        lists = np.empty(rows.num_rows, object)
        lists[:] = [()] * rows.num_rows
        for i, row in enumerate(first[order]):
            lists[row] = links[i][links[i] >= 0]
        return rows.append_column("node", pa.array(number[node.ravel()], pa.int32())).append_column("links", pa.array(lists, pa.list_(pa.int32())))

    return run


def build(rows: DataFrame, part_rows: int | None = None) -> DataFrame:
    """rows(id, v, ...) -> the index: the distinct rows with part, node (equal vectors of a part have one) and links (in one row of each node).
    It isn't kept by itself: write it, and give ``search`` what is read."""
    own = [c for c in rows.columns if c.lower() in OWN]
    if own:
        raise ValueError(f"columns of the index's own names: {own}")
    width = vector._width(rows)
    rows = vector._sound(rows, width)
    parts = max(1, -(-rows.count() // (part_rows or max(1, min(PART, FLOATS // max(1, width))))))
    kept = rows.dropDuplicates().withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    return kept.groupBy("part").applyInArrow(_build(width), StructType(list(kept.schema.fields)).add("node", IntegerType()).add("links", ArrayType(IntegerType())))


class _Part:
    """A part of the index in a task: its graph, and the rows of each node that fulfil the predicate, by id."""

    def __init__(self, rows: pa.Table, width: int):
        node, self.ids, ok = np.asarray(rows["node"]), np.asarray(rows["id"]), np.asarray(rows["fulfils"])
        n = int(node.max()) + 1
        self.exact = np.zeros((n, width))
        self.exact[node] = _units(rows["v"], width)
        self.x = self.exact.astype(np.float32)
        size = np.asarray(pc.list_value_length(rows["links"]))
        self.links = np.full((n, max(1, int(size.max()))), -1, np.int32)
        self.links[np.repeat(node, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(rows["links"].combine_chunks().flatten())
        self.fulfils = np.zeros(n, bool)
        self.fulfils[node[ok]] = True
        self.matching = np.flatnonzero(self.fulfils)
        order = np.lexsort((self.ids, node))
        self.members = order[ok[order]]
        self.start = np.searchsorted(node[self.members], np.arange(n + 1))
        self.entries = entries_of(self.links, n)

    def nodes(self, q: np.ndarray, effort: int) -> np.ndarray:
        if len(self.matching) <= 4 * effort:
            return np.broadcast_to(self.matching, (len(q), len(self.matching)))
        return walk(self.x, self.links, self.entries, q.astype(np.float32), effort, None if self.fulfils.all() else self.fulfils)[0]

    def rows(self, nodes: np.ndarray, q: np.ndarray, asks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows of each line's nodes, of equal ids one and not the query's own: line, id, similarity."""
        line, place = np.nonzero(nodes >= 0)
        nodes = nodes[line, place]
        value = np.round(np.einsum("ij,ij->i", self.exact[nodes], q[line]), 12)
        first = self.start[nodes]
        size = np.minimum(self.start[nodes + 1] - first, k + 1)  # equal rows come in order of their ids, which differ in a node: no more than k and the query's own count
        line, value = np.repeat(line, size), np.repeat(value, size)
        found = self.ids[self.members[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]]
        other = asks[line] != found
        line, found, value = line[other], found[other], value[other]
        order = np.lexsort((-value, found, line))
        again = np.zeros(len(order), bool)
        again[1:] = (line[order][1:] == line[order][:-1]) & (found[order][1:] == found[order][:-1])
        order = order[~again]
        order = order[np.lexsort((found[order], -value[order], line[order]))]
        order = order[np.arange(len(order)) - np.searchsorted(line[order], line[order]) < k]
        return line[order], found[order], value[order]


def _found(width: int, k: int, effort: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and rows.num_rows:
            part, step = _Part(rows, width), _block(width)
            every, ids = _units(queries["v"], width), np.asarray(queries["id"])
            for a in range(0, len(ids), step):
                q, asks = every[a : a + step], ids[a : a + step]
                line, found, value = part.rows(part.nodes(q, effort), q, asks, k)
                out.append((asks[line], found, value))
                if len(part.matching) > 4 * effort:  # who met less than k that fulfil the predicate and have different ids is compared with all
                    for i in np.flatnonzero(np.bincount(line, minlength=len(asks)) < k):
                        _, found, value = part.rows(part.matching[None, :], q[i : i + 1], asks[i : i + 1], k)
                        out.append((np.full(len(found), asks[i]), found, value))
        return pa.table(dict(zip(("id", "neighbour", "similarity"), map(np.concatenate, zip(*out)))))

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, where: str | None = None, effort: int | None = None) -> DataFrame:
    """index(part, node, links, id, v, ...), queries(id, v) -> (id, rank, neighbour, similarity): about the k nearest rows of each query among those that fulfil
    ``where``, a predicate over the index's columns. ``effort`` (more than k; ``EFFORT`` or 4 * k if not given) buys recall with time."""
    width = vector._width(index)
    if not width:
        return index.sparkSession.createDataFrame([], vector.RESULT)
    effort = max(k + 1, effort or max(EFFORT, 4 * k))
    asks = vector._sound(queries.select("id", "v"), width).dropDuplicates()
    last, blocks = index.agg(F.max("part")).first()[0], max(1, -(-asks.count() // ASKS))
    rows = index.select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "node", "links", "id", "v", F.coalesce(F.expr(where or "true"), F.lit(False)).alias("fulfils"))
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    keys = ["part", "block"]
    found = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_found(width, k, effort), "id long, neighbour long, similarity double")
    found = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")
