"""Alignment, whitening and license scans against plain loops over the same rows; nulls, empties, repeated rows, very long texts, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import alignment, licenses, whitening
from quillon.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, k string, h string, pos int, pair long, chunk int, words string, n_words string"


def ordered(rows):
    return sorted(rows, key=lambda x: tuple((v is None, v) for v in x))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "h", 1, 2, 3, "w", "n") for i, t in rows], CLASH)


# --- alignment -----------------------------------------------------------------------------------------------------------


def aligned(rows):
    """What the contract says of each row, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: x for x, c in alignment.byte_characters().items()}
    docs, count = [], Counter()
    for doc, t in rows:
        links, groups, sizes = [], [], (0, 0)
        if t:
            e = a.encode(" " + t, add_special_tokens=False)
            pieces = b.encode(t)
            spelt_a = [bytes(back[c] for c in x) for x in e.tokens]
            spelt_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
            if b"".join(spelt_a) == b"".join(spelt_b) == (" " + t).encode():
                sizes = len(spelt_a), len(spelt_b)
                spans = []
                for spelt, ids in ((spelt_a, e.ids), (spelt_b, pieces)):
                    end = np.cumsum([len(x) for x in spelt]).tolist()
                    spans.append([(y - len(x), y, i) for x, y, i in zip(spelt, end, ids)])
                start = 0
                for cut in sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]}):
                    groups.append("|".join(",".join(str(i) for x, y, i in s if start <= x and y <= cut) for s in spans))
                    start = cut
                links = [(i, j) for x, y, i in spans[0] for u, v, j in spans[1] if x < v and u < y]
        docs.append((doc, sizes, groups, links))
        count.update(set(links))
    best: dict[int, int] = {}
    for (i, _), c in count.items():
        best[i] = max(best.get(i, 0), c)
    return [
        (doc, *sizes, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, sizes, groups, links in docs
    ]


def test_alignment(spark, monkeypatch):
    r = random.Random(3)
    pool = ["the", "of", " ", "  ", "\n", "\t", "é", "ß", "日本", "▁", "x" * 60, "don't", "'s", "1234", " ", " ", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "🙂", "B.", "--", "\x00", "\x85", "ﬁ"]
    texts = [None, "", "   ", " a", "a ", "\n", "a\n\n b \n"] + ["".join(r.choice(pool) for _ in range(r.randint(1, 25))) for _ in range(300)]
    rows = [(None if i == 9 else i // 2 if i < 30 else i, t) for i, t in enumerate(texts)] + [(9, "one two"), (9, "one two"), (None, "one two")]
    monkeypatch.setattr(alignment, "PART_BYTES", 2_000)  # many partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = alignment.digest(frame(spark, rows).repartition(3), A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = ordered(aligned(rows))
    assert ordered(tuple(x) for x in out.collect()) == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.setattr(alignment, "MOST_PAIRS", 10)  # counts meet pairs by shuffle
    assert ordered(tuple(x) for x in alignment.digest(frame(spark, rows), A, B).collect()) == want


def test_alignment_of_long_texts_and_no_rows(spark, monkeypatch):
    r = random.Random(4)
    text = "\n".join(" ".join(r.choice(["alpha", "Béta", "gamma", "x" * 40]) for _ in range(12)) for _ in range(20_000))  # 3 MB in one text
    monkeypatch.setattr(alignment, "_AT_ONCE", 10_000)
    found = {x.doc_id: x for x in alignment.digest(frame(spark, [(1, text), (2, "y" * 300_000), (3, "tail")]), A, B).collect()}
    a, b = alignment.side(alignment.ByteSide, A).library, alignment.side(alignment.PieceSide, B).sp
    assert (found[1].n_a, found[1].n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text))) and found[1].n_links == found[1].n_a + found[1].n_b - found[1].n_groups
    assert found[2].n_links == found[2].n_a + found[2].n_b - found[2].n_groups and found[3].n_links > 0
    assert alignment.digest(frame(spark, []), A, B).count() == 0


def test_alignment_never_shuffles_tokens(spark):
    with alignment.by_document(spark, 4):
        plan = alignment.links(frame(spark, [(1, "a b")]), A, B)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Generate posexplode")]
    assert " Exchange hashpartitioning" not in after and plan.count("Exchange hashpartitioning") == 1


# --- whitening -----------------------------------------------------------------------------------------------------------


def test_whitening(spark, monkeypatch):
    g = np.random.default_rng(7)
    base = g.normal(size=(300, 20)) * np.linspace(3, 0.05, 20)
    base = base[np.concatenate([np.arange(300), np.zeros(150, int), g.integers(0, 300, 50)])]  # a hot vector and repeats
    rows = [(i, [float(np.float32(v)) for v in x], "n", 1) for i, x in enumerate(base)]
    bad = [(900, None, "n", 1), (901, [], "n", 1), (902, [1.0, None] * 10, "n", 1), (903, [float("nan")] * 20, "n", 1), (904, [float("inf")] * 20, "n", 1), (905, [1e30] * 20, "n", 1), (906, [1.0] * 19, "n", 1)]
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n string, x int").repartition(7)
    out, model = whitening.whiten(d)
    x = {i: np.floor(64 * np.array(v)).astype(int) + 1_000_000 for i, v, *_ in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    got = out.collect()
    assert len(got) == 16 * len(x) and model.n == n
    sign = {}
    for r in got:
        c = r.component - 1
        w = ((n * x[r.vec_id] - s) / n) @ v[:, c] / math.sqrt(e[c])
        sign.setdefault(c, 1 if abs(w - r.whitened) <= abs(w + r.whitened) else -1)
        assert abs(sign[c] * w - r.whitened) < 1e-9 and abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9
        assert r.deviation == int(((n * x[r.vec_id].astype(object) - s) ** 2).sum()) and r.n == n and r.identity_error < 1e-10
    # large numbers pass through the exact way
    large = whitening.Model(1 << 40, np.array([3 * (1 << 40) + 5, -7], object), None, None, None)
    assert whitening._apart(large, np.array([[3, 0], [4, 1]])) == [5 * 5 + 7 * 7, None]


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out, model = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and model is None
    out, model = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])], schema))
    assert len(model.components) == 1 and out.count() == 3 and out.first().n == 2


@pytest.mark.parametrize("shape", [(5, 7), (50, 33), (64, 64), (1, 4), (4, 1)])
def test_jacobi(shape):
    r = np.random.default_rng(1).normal(size=shape)
    s, v = whitening.jacobi(r)
    assert np.allclose(s[: min(shape)], np.linalg.svd(r, compute_uv=False), atol=1e-12) and np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-12)


# --- licenses ------------------------------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def scanned(t, templates):
    """Every run of words tried against every template."""
    w, starts, base, labels, score = words(t), [], set(), set(), 0.0
    for x in templates:
        spelt = words(x.text)
        if x.phrase:
            places = [i for i in range(len(w)) if w[i : i + len(spelt)] == spelt]
            if places:
                starts, score = starts + places, 1.0
                base.add(x.label)
                labels.add(x.label)
            continue
        distinct, span = set(spelt), len(spelt) + len(spelt) // 4
        best = max((len(distinct & set(w[i : i + span])) for i in range(len(w))), default=0)
        if best >= max(1, math.ceil(len(distinct) * x.threshold - 1e-9)):
            labels.add(x.label)
            score = max(score, best / len(distinct))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licenses(spark):
    r, all_of = random.Random(5), licenses.BASE + licenses.NOTICES
    filler = ["the", "of", "Über", "ΑΒ", "license", "version", "2", "cc", "by", "under", "a", "software", "x1", "copy"]
    texts = [None, "", "CC BY-NC", "cc by nc cc by nc", "cc by cc by nc"]
    for _ in range(200):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(" ".join(r.choice(filler) for _ in range(r.randint(0, 90))))
            if r.random() < 0.6:
                w = r.choice(all_of).text.split(" ")
                for _ in range(r.randint(0, 4)):
                    j = r.randrange(len(w))
                    w = w[:j] + ([r.choice(filler)] if r.random() < 0.5 else []) + w[j + (r.random() < 0.5) :] or ["x"]
                parts.append(r.choice([" ", "\n", ", "]).join(w))
        texts.append("\n".join(parts))
    texts.append("w " * 700_000 + licenses.NOTICES[0].text + " cc by nc" + " w" * 300_000)  # 2 MB
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (9, texts[7])]
    out = licenses.digest(frame(spark, rows))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = ordered(tuple(x) for x in out.collect())
    short = [x for x in rows if len(x[1] or "") < 1_000_000]
    assert [x for x in got if x[1] < 1_000_000] == ordered((i, *scanned(t, all_of)) for i, t in short)
    long = next(x for x in got if x[1] > 1_000_000)
    assert long[2:7] == (1, 700_000 + len(words(licenses.NOTICES[0].text)), 700_000 + len(words(licenses.NOTICES[0].text)), "cc-by-nc", "cc-by-nc,mit") and long[7] == 1.0
    assert licenses.digest(frame(spark, [])).count() == 0


def test_licenses_of_other_templates(spark):
    mine = (licenses.Template("own", "cc by nc", phrase=True), licenses.Template("half", "alpha beta gamma delta", 0.5))
    out = {x.doc_id: x for x in licenses.scan(frame(spark, [(1, "delta x alpha"), (2, "alpha " + "x " * 20 + "beta"), (3, "CC-BY-NC")]), mine).collect()}
    assert (out[1].labels, out[1].score) == ("half", 0.5) and out[2].labels == "" and out[3].base_labels == "own"
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, []), (licenses.Template("none", "..."),))
