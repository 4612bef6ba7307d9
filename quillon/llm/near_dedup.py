"""MinHash near-dedup with sequential Bayesian verification.

1. Each document's distinct word shingles are hashed to 64 bits; ``BANDS * ROWS`` MinHash functions give band keys (full values) and a
   signature of their low 8 bits. Texts with equal shingle sets are one class, which is a node of the graph and has a number; ids with texts of several classes link these.
2. In each band the members of a bucket are compared with the one of the smallest doc_id only, so a bucket costs as many pairs as it has
   members. A pair's signatures are read in batches; it is pruned as soon as the posterior probability that its similarity reaches
   the threshold, given the matches so far, falls below ``MISS``. Survivors are verified exactly on their full shingle sets.
3. Members that fail against their pivot form the bucket again without it, for ``ROUNDS`` rounds. A member that fails may still be linked to
   one that doesn't: Jaccard distance is a metric, so only members whose estimated distances to the pivot differ by no more than the
   allowed distance plus ``slack`` can be. The estimate is taken from all values of the signatures, also where pruning stopped early, and either
   bound of ``slack`` loses a pair with probability below ``MISS``. These, and members left in a bucket after the last round, are compared inside tasks, in pairs of
   chunks of about ``CHUNK`` rows and ``CHUNK_BYTES`` of sets at most; a task returns only links that join two components, never pairs.
4. Components are found by alternating large-star and small-star steps over tables; a component's id is the smallest doc_id of its classes.

Digests, ids and band keys that a large share of the rows has are joined by broadcast (``common.join_counted``).

Tables in between are removed when their last reader is done, or if a step fails; one narrow table remains.

Defined cases: null, empty and blank texts have no shingle and stay alone; fewer words than a shingle make one shingle; rows of equal doc_id are one
document, with the exact and near copies of all its texts; null doc_ids stay alone and are kept; an empty table stays empty; other columns pass through ``stage``.
Very long texts: a text, its shingle hashes (8 bytes a word) and signature must fit in a task.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, mix64, shingle_sets, slices, text_or_empty, tidy, unstash
from .common import stash as keep

BANDS, ROWS, BATCH = 32, 6, 32
MISS, ROUNDS = 1e-6, 3
_SEEDS = np.random.default_rng(7_032_024).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(set, function) -> smallest 64-bit product of an odd factor and a shingle hash."""
    out = np.zeros((len(sets), len(_SEEDS)), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            least = None
            for a in range(0, len(s), 2048):
                m = (s[a : a + 2048, None] * _SEEDS).min(axis=0)
                least = m if least is None else np.minimum(least, m)
            if least is not None:
                out[i] = least
    return mix64(out)


def _profile(words: int):
    @tidy
    def run(batches):
        for whole in batches:
            for b in slices(whole):
                sets = list(shingle_sets(b.column(1).to_pylist(), words))
                sig = signatures(sets)
                keys = np.zeros((len(sets), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        keys = mix64(keys + sig[:, r::ROWS]) * np.uint64(3)
                    keys = mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                low = (sig & np.uint64(255)).astype(np.uint8)
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if x else None for s, x in zip(sets, some)], pa.binary()),
                        pa.array([low[i].tobytes() if x else None for i, x in enumerate(some)], pa.binary()),
                        pa.array([keys[i] if x else None for i, x in enumerate(some)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "h", "n", "digest", "sig", "bands"],
                )

    return run


def _set_rows(words: int):
    """(node, text, many) -> (doc_id, set, many)."""

    @tidy
    def run(batches):
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1).to_pylist(), words)], pa.binary()), b.column(2)], names=["doc_id", "set", "many"])

    return run


def least_matches(threshold: float) -> list[int]:
    """For 1, 2, ... batches compared: the fewest matches with which P(similarity >= threshold | matches) >= MISS.

    A uniform prior on the share of equal signature bytes makes the posterior a Beta; its tail at whole parameters is a binomial sum."""
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        # P(Beta(m+1, n-m+1) >= p) = P(Binomial(n+1, p) <= m)
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(p) + (n + 1 - m) * math.log1p(-p))
        out.append(m)
    return out


def slack(threshold: float) -> float:
    """How far estimates from whole signatures may be beyond the bounds of the triangle inequality before a linked pair is ruled out.

    For members x and y that are linked, and y to the pivot: x has at least similarity 2 * threshold - 1 to the pivot, and matches of x and of y
    with the pivot differ in number by at most the places where x and y differ. Both counts are binomial at worst; each tail cut off is below ``MISS``."""
    n, chance = BANDS * ROWS, 1 / 256

    def tail(p: float) -> int:
        """The largest m with P(Binomial(n, p) <= m) < MISS, or -1."""
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n, m) * p**m * (1 - p) ** (n - m)
            if total >= MISS:
                return m - 1
        return n

    least = max(0.0, 2 * threshold - 1)
    below = least - ((tail(least + (1 - least) * chance) + 1) / n - chance) / (1 - chance)
    apart = (n - tail(threshold) - 1) / n / (1 - chance) - (1 - threshold)
    return max(below, apart) + 1e-9


def _bayes(threshold: float):
    least = least_matches(threshold)

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            share = (x == y).mean(axis=1)
            for k, need in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= need]
            passed = np.zeros(b.num_rows, bool)
            passed[alive] = True
            estimate = np.maximum(0.0, (share - 1 / 256) / (1 - 1 / 256))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(passed), pa.array(estimate)], names=["a", "b", "passed", "estimate"])

    return run


def _exact(threshold: float):
    per_cent = round(threshold * 100)

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> a written table (node, root): the smallest node each node reaches, by large-star and small-star until nothing changes."""
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select("b", "a"))
        # large star: every larger neighbour goes to the smallest of node and neighbours
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every neighbour not larger, and the node, go to the smallest
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()
        new = keep(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstash(e)
        e = new
        if now == mark:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._quillon_path = e._quillon_path
            return out
        mark = now


def _cross(threshold: float):
    """Links between rows of side 0 and rows of either side of a group that have different roots, by signature batches and then exactly.

    Roots merge as links are found, so a group gives fewer links than it has rows."""
    least, per_cent, apart = least_matches(threshold), round(threshold * 100), 1 - threshold + slack(threshold)

    def run(key, table):
        t = table.sort_by([("side", "ascending"), ("doc", "ascending")])
        docs, roots, sides = (t[c].to_pylist() for c in ("doc", "root", "side"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(docs), -1)
        sets, near = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()], np.array(t["estimate"].to_pylist())
        up = {r: r for r in roots}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for i in range(sides.count(0)):
            alive = np.arange(i + 1, len(docs))
            alive = alive[np.abs(near[alive] - near[i]) <= apart]
            matches = np.zeros(len(docs), np.int64)
            for k, need in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (sig[alive, cut] == sig[i, cut]).sum(axis=1)
                alive = alive[matches[alive] >= need]
            for j in alive.tolist():
                if top(roots[i]) != top(roots[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                        up[top(roots[i])] = top(roots[j])
                        out.append((docs[i], docs[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


#: Rows of one pivot's members that one task compares with others, and bytes of their sets.
CHUNK, CHUNK_BYTES = 2_000, 16 << 20


def link(docs: DataFrame, words: int, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    made: list[DataFrame] = []
    try:
        return _link(docs, words, threshold, made)
    finally:
        for x in made:
            unstash(x)


def _link(docs: DataFrame, words: int, threshold: float, made: list[DataFrame]) -> DataFrame:
    def stash(df: DataFrame, name: str) -> DataFrame:
        made.append(keep(df, name))
        return made[-1]

    text = text_or_empty()
    docs = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    all_rows = stash(docs.mapInArrow(_profile(words), "doc_id long, h long, n long, digest binary, sig binary, bands array<long>"), "profiles")
    sound = all_rows.where("digest is not null and doc_id is not null")
    # copies of a class, and of the row that stands for it, are counted before anything wide moves
    counted = sound.groupBy("digest", "doc_id", "h").agg(F.count(F.lit(1)).alias("same"), *[F.first(c).alias(c) for c in ("sig", "bands", "n")])
    grouped = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "same")).alias("rep"), F.sum("same").alias("copies"), *[F.first(c).alias(c) for c in ("sig", "bands", "n")])
    classes = stash(grouped.select(F.monotonically_increasing_id().alias("doc_id"), "digest", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("rep_h"), F.col("rep.same").alias("same"), "copies", "sig", "bands", "n"), "classes")
    # from here to the components a doc_id is the number of a class
    reps = classes.select("doc_id", "sig", "n")
    members = classes.select("doc_id", "rep", F.explode("bands").alias("key"))
    shared = members.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stash(members.join(shared, F.col("key") == F.col("k"), "left_semi"), "members")
    # classes that meet others; the ids grow with the corpus, so this is never a broadcast; texts are read and moved this once
    met = members.select(F.col("doc_id").alias("node")).distinct()
    needed = stash(classes.join(met.hint("merge"), F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "rep", "rep_h", "same"), "needed")
    texts = join_counted(docs, needed, {"doc_id": "rep", "h": "rep_h"}, "same").select("node", "text", (F.col("same") > 1).alias("many"))
    sets = stash(texts.mapInArrow(_set_rows(words), "doc_id long, set binary, many boolean"), "sets")
    # rows that stand several times in the table give their set once
    sets = sets.where("not many").select("doc_id", "set").union(sets.where("many").groupBy("doc_id").agg(F.first("set").alias("set")))

    def paired(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        s = of.select(F.col("doc_id").alias("u"), F.col(column).alias("x"))
        t = of.select(F.col("doc_id").alias("v"), F.col(column).alias("y"))
        return pairs.join(s, F.col("a") == F.col("u")).join(t, F.col("b") == F.col("v")).select("a", "b", "x", "y")

    # an id with texts of several classes links them
    several = stash(sound.groupBy(F.col("doc_id").alias("id")).agg(F.min("digest").alias("first"), F.max("digest").alias("last"), F.count(F.lit(1)).alias("c")).where("first <> last").drop("last"), "several")
    links = join_counted(sound.select("doc_id", "digest"), several, {"doc_id": "id"}, "c").select("digest", "first").where("digest <> first").distinct()
    named = classes.select(F.col("doc_id").alias("node"), F.col("digest").alias("of"))
    links = links.join(named.hint("merge"), F.col("digest") == F.col("of")).select(F.col("node").alias("a"), "first")
    found, tested = [stash(links.join(named.hint("merge"), F.col("first") == F.col("of")).select("a", F.col("node").alias("b")), "same-id")], None
    for _ in range(ROUNDS):
        pivots = stash(members.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("rep", "doc_id"))["doc_id"].alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1"), "pivots")
        starred = stash(join_counted(members, pivots, {"key": "k"}, "c").where("doc_id <> p").select("key", "rep", F.col("doc_id").alias("a"), F.col("p").alias("b")), "starred")
        pairs = starred.select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        judged = stash(paired(pairs, reps, "sig").mapInArrow(_bayes(threshold), "a long, b long, passed boolean, estimate double"), "judged")
        verified = stash(paired(judged.where("passed").select("a", "b"), sets, "set").mapInArrow(_exact(threshold), "a long, b long"), "verified")
        found.append(verified)
        new = judged.join(verified.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("a", "b", "estimate", F.coalesce("linked", F.lit(False)).alias("linked"))
        tested = stash(new if tested is None else tested.union(new), "tested")
        members = stash(starred.join(tested.where("not linked"), ["a", "b"], "left_semi").select(F.col("a").alias("doc_id"), "rep", "key"), "members")
        if not members.limit(1).count():
            break
    # what no pivot has settled: of each pivot, members near it but not linked, against each other and all that are linked; and
    # members that are left in a bucket after the last round, against each other
    near = 1 - threshold
    first = components(reduce(DataFrame.union, found))
    made.append(first)
    far = tested.where(f"not linked and estimate >= {1 - 2 * near - slack(threshold)}").select(F.col("b").alias("g"), F.col("a").alias("doc"), "estimate", F.lit(0).alias("side"))
    close = tested.where("linked").select(F.col("b").alias("g"), F.col("a").alias("doc"), "estimate", F.lit(1).alias("side"))
    close = close.join(far.select(F.col("g").alias("h")).distinct(), F.col("g") == F.col("h"), "left_semi")
    rest = members.select(F.col("key").alias("g"), F.col("doc_id").alias("doc"), F.lit(0.0).alias("estimate"), F.lit(0).alias("side")).distinct()
    rows = far.union(close).withColumn("kind", F.lit(0)).union(rest.withColumn("kind", F.lit(1)))
    rows = stash(rows.join(reps.select("doc_id", "sig", F.col("n").alias("size")), F.col("doc") == F.col("doc_id")).drop("doc_id"), "unsettled")
    chunks = rows.groupBy(F.col("kind").alias("k2"), F.col("g").alias("g2")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") * 8 / CHUNK_BYTES)).cast("int").alias("c"), F.expr("count_if(side = 0)").alias("n0"), F.count(F.lit(1)).alias("n")).where("n0 > 0 and n > 1")
    rows = rows.join(chunks, (F.col("kind") == F.col("k2")) & (F.col("g") == F.col("g2"))).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("c")).cast("int"))
    rows = rows.join(first, F.col("doc") == F.col("node"), "left").join(sets, F.col("doc") == F.col("doc_id"))
    # every pair of chunks meets once: a row goes to the pairs its chunk is in
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    rows = rows.select("kind", "g", "lo", "hi", "doc", F.coalesce("root", "doc").alias("root"), "side", "estimate", "sig", "set")
    more = stash(rows.groupBy("kind", "g", "lo", "hi").applyInArrow(_cross(threshold), "a long, b long"), "more")
    if more.limit(1).count():
        first = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        made.append(first)
    rooted = classes.select("doc_id", "digest", "rep", "copies").join(first.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("digest", "rep", "copies", F.coalesce("root", "doc_id").alias("root"))
    smallest = rooted.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id"))
    done = stash(rooted.join(smallest.hint("merge"), F.col("root") == F.col("r")).select(F.col("digest").alias("of"), "component_id", "copies"), "rooted")
    out = join_counted(sound.select("doc_id", "n", "digest"), done, {"digest": "of"}, "copies").select("doc_id", "n", "component_id")
    alone = all_rows.where("digest is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return keep(out.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "components")


def digest(docs: DataFrame, words: int = 2, threshold: float = 0.8) -> DataFrame:
    out = link(docs, words, threshold)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; of rows that share an id all go or stay."""
    found = link(docs, words, threshold)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_q_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_q_gone"], "left_anti")
