"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Words are lower-cased and five of them make a shingle (fewer make one). Each shingle is hashed once: the low bits choose one of ``BINS`` bins and
the rest is its value there; a bin keeps its smallest value. An empty bin takes the value of the first filled bin in a probing
order of its own (a bin-specific odd step, so all bins are visited: optimal densification's independent choice per empty bin). The low 8 bits of the values,
in hex, are the fingerprint. Likeness is the share of equal bins, corrected for values that agree in 8 bits by chance.

The fingerprint of a text whose end is replaced reuses the shingles that both texts share, so these are hashed once.

Defined cases: null and empty or blank texts have no shingle and a fingerprint of zeros; likeness of two such texts is 1, of one such text and
another 0; equal texts have equal fingerprints. Neighbours are by ascending doc_id, nulls first; among rows of one id, by text; of an only
document the next is itself; other columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

WORDS, BINS, BITS = 5, 128, 8
#: Bytes of text that one task orders by id, and pieces that the ids are cut into at most (their ends are part of the plan).
PIECE_BYTES, MOST_PIECES = 32 << 20, 20_000


def _steps() -> list[int]:
    """An odd number below BINS for each bin, from a multiplicative rule."""
    return [((i * 2654435761 + 40503) >> 7) % (BINS // 2) * 2 + 1 for i in range(BINS)]


def _minima(words: str) -> str:
    """SQL: bin minima, sorted, from an array of words of which every five in a row are a shingle."""
    n = WORDS - 1
    combine = ", ".join(["h"] + [f"get(hs, i + {k})" for k in range(1, WORDS)])
    hashes = f"transform(array({words}), hs0 -> transform(hs0, w -> xxhash64(w)))[0]"
    shingles = f"transform(array({hashes}), hs -> transform(slice(hs, 1, greatest(size(hs) - {n}, 0)), (h, i) -> xxhash64({combine})))[0]"
    return _first_of_bins(shingles)


def _first_of_bins(shingles: str) -> str:
    """SQL: the smallest value of each bin; the top bits are the bin, so that sorting puts a bin's values together."""
    return f"transform(array(sort_array({shingles})), s -> filter(s, (x, i) -> i = 0 or shiftrightunsigned(x, {64 - 7}) <> shiftrightunsigned(get(s, i - 1), {64 - 7})))[0]"


def _merged(a: str, b: str) -> str:
    return _first_of_bins(f"concat({a}, {b})")


def _dense(minima: str) -> str:
    """SQL: the low bits of all bins' values, empty bins filled."""
    steps = "array(" + ",".join(map(str, _steps())) + ")"
    filled = f"map_from_arrays(transform(m, x -> cast(shiftrightunsigned(x, {64 - 7}) as int)), m)"
    # a dense array first, so that a probe is an array access
    table = f"transform(array({minima}), m -> if(size(m) = 0, null, transform(array({filled}), f -> transform(sequence(0, {BINS - 1}), b -> element_at(f, b)))[0]))[0]"
    probe = "get(t, cast(pmod(b + {k} * get(st, b), " + str(BINS) + ") as int))"
    near = ", ".join(probe.format(k=k) for k in range(1, 13))
    rest = f"get(t, cast(array_min(transform(filter(sequence(13, {BINS - 1}), k -> {probe.format(k='k')} is not null), k -> k * {BINS} + pmod(b + k * get(st, b), {BINS}))) % {BINS} as int))"
    low = f"cast(coalesce(v, {near}, {rest}) & {(1 << BITS) - 1} as int)"
    return f"transform(array({table}), t -> if(t is null, array_repeat(0, {BINS}), transform(array({steps}), st -> transform(t, (v, b) -> {low}))[0]))[0]"


def _packed(values: Column) -> Column:
    return F.lower(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def likeness(a: Column, b: Column, empty_a: Column, empty_b: Column) -> Column:
    """Equal bins, less those expected by chance among unlike values."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    return F.when(empty_a | empty_b, (empty_a & empty_b).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))), " ", -1)


def whole(text: str) -> str:
    """SQL: the sorted bin minima of a text column."""
    w = f"filter(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')"
    return f"transform(array({w}), ws -> if(size(ws) between 1 and {WORDS - 1}, array(xxhash64(array_join(ws, ' '))), {_minima('ws')}))[0]"


def neighbours(docs: DataFrame, pieces: int) -> DataFrame:
    """docs(doc_id, text) with _q_next, the next document's text, without one task for all: pieces between sampled
    quantiles of doc_id are ordered separately, and the first row of each piece follows the last of the one before."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], min(100 * pieces, 200_000))).first()[0]
    cuts = sorted(set(cuts or []))
    root = max(1, int(len(cuts) ** 0.5))
    if cuts:
        # the piece is the number of cuts not above the id; looked up in two steps
        fine, coarse = "array(" + ",".join(f"{c}L" for c in cuts) + ")", "array(" + ",".join(f"{c}L" for c in cuts[::root]) + ")"
        d = docs.withColumn("_q_c", F.expr(f"greatest(size(filter({coarse}, x -> x <= doc_id)) - 1, 0) * {root}"))
        d = d.withColumn("_q_p", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_q_c") + F.expr(f"size(filter(slice({fine}, _q_c + 1, {root}), x -> x <= doc_id))")))
    else:
        d = docs.withColumn("_q_p", F.lit(0))
    return d.drop("_q_c")


def compare(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """The fingerprints of every text and its edited text, and likenesses."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    if pieces is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        pieces = min(MOST_PIECES, max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // PIECE_BYTES))
    d = neighbours(d, pieces)
    firsts = d.groupBy("_q_p").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("t"))).alias("f"))
    firsts = firsts.select(F.col("_q_p").alias("_q_fp"), F.col("f.t").alias("_q_ft"))  # a row for each piece
    in_turn = Window.orderBy("_q_fp")
    every = in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_q_fp", F.coalesce(F.lead("_q_ft").over(in_turn), F.first("_q_ft").over(every)).alias("_q_ft"))
    by = Window.partitionBy("_q_p").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    d = d.withColumn("_q_next", F.lead("text").over(by))
    d = d.join(firsts, F.col("_q_p") == F.col("_q_fp"), "left").withColumn("_q_next", F.coalesce("_q_next", "_q_ft"))
    d = d.withColumn("n_chars", n.cast("long")).withColumn("_q_k", F.floor(n / 4).cast("int"))
    d = d.withColumn("_q_head", F.expr("substring(text, 1, n_chars - _q_k)")).withColumn("_q_new", F.expr("substring(_q_next, 1, _q_k)"))
    d = d.withColumn("_q_tail", F.expr("substring(text, cast(n_chars - _q_k + 1 as int), _q_k)"))
    d = d.withColumn("edited_sha256", F.sha2(F.concat("_q_head", "_q_new"), 256))
    blank = "'[\\\\x20\\\\x09-\\\\x0D]+'"
    # all words of the head but the last, which the cut may go through
    d = d.withColumn("_q_hw", F.expr(f"split(lower(_q_head), {blank}, -1)"))
    d = d.withColumn("_q_full", F.expr("filter(slice(_q_hw, 1, size(_q_hw) - 1), w -> w <> '')"))
    d = d.withColumn("_q_join", F.expr(f"concat(array_join(slice(_q_full, greatest(size(_q_full) - {WORDS - 2}, 1), {WORDS - 1}), ' '), ' ', element_at(_q_hw, -1))"))
    d = d.withColumn("_q_a", F.expr(_minima("_q_full")))
    parts = {"o": "_q_tail", "e": "_q_new"}
    for k, rest in parts.items():
        d = d.withColumn(f"_q_w{k}", F.expr(f"filter(split(lower(concat(_q_join, {rest})), {blank}, -1), w -> w <> '')"))
        short = f"size(_q_full) < {WORDS - 1} and size(_q_w{k}) between 1 and {WORDS - 1}"
        d = d.withColumn(f"_q_b{k}", F.expr(f"if({short}, array(xxhash64(array_join(_q_w{k}, ' '))), {_minima(f'_q_w{k}')})"))
        d = d.withColumn(f"_q_m{k}", F.expr(_merged("_q_a", f"_q_b{k}")))
        d = d.withColumn(f"_q_f{k}", F.expr(_dense(f"_q_m{k}"))).withColumn(f"_q_n{k}", F.size(f"_q_m{k}") == 0)
    firsts = firsts.withColumn("_q_ff", F.expr(_dense(whole("_q_ft")))).withColumn("_q_fe", F.size(F.expr(whole("_q_ft"))) == 0)
    d = d.select("doc_id", "n_chars", "edited_sha256", "_q_p", "text", "_q_fo", "_q_fe", "_q_no", "_q_ne")
    d = d.withColumn("_q_nf", F.lead(F.struct("_q_fo", "_q_no")).over(by)).drop("text")
    f2 = firsts.select(F.col("_q_fp").alias("_q_fp2"), F.struct(F.col("_q_ff").alias("_q_fo"), F.col("_q_fe").alias("_q_no")).alias("_q_fn"))
    d = d.join(f2, F.col("_q_p") == F.col("_q_fp2"), "left").withColumn("_q_nf", F.coalesce("_q_nf", "_q_fn"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256",
        _packed(F.col("_q_fo")).alias("fingerprint"), _packed(F.col("_q_fe")).alias("edited_fingerprint"),
        likeness(F.col("_q_fo"), F.col("_q_fe"), F.col("_q_no"), F.col("_q_ne")).alias("near_edited"),
        likeness(F.col("_q_fo"), F.col("_q_nf._q_fo"), F.col("_q_no"), F.col("_q_nf._q_no")).alias("near_next"),
    )
