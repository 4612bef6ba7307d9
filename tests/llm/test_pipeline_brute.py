"""The whole pipeline against plain Python: every stage by its definition, with loops, on a made folder."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import regex

from quillon.llm import quality
from quillon.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def unit(*parts):
    return (int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16) + 1) / 4294967297.0


def good_ones(docs, label):
    grams = lambda t: [x for x in quality.ngram_buckets([t or ""])[0].ravel().tolist() if x >= 0]
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t, _ in docs:
        for g in grams(t):
            raw[g] += 1
            target[g] += label.get(i) == 1
    prior = (raw + 1) / (raw.sum() + quality.BUCKETS)
    ratio = np.log((target + quality.BUCKETS * prior) / (target.sum() + quality.BUCKETS)) - np.log(prior)
    weight = [100.0 * sum(ratio[g] for g in grams(t)) / (max(2 * len(WORD.findall(t or "")) - 1, 0) + 10.0) for _, t, _ in docs]
    key = [w - math.log(-math.log(unit("gumbel", d[0]))) for w, d in zip(weight, docs)]
    order = sorted((w, label[d[0]]) for w, d in zip(weight, docs) if d[0] in label)
    cost = [20 * sum(q for _, q in order[:c]) + sum(1 - q for _, q in order[c:]) for c in range(len(order) + 1)]
    c = cost.index(min(cost))
    cut = -math.inf if c == 0 else (order[c - 1][0] + order[c][0]) / 2 if c < len(order) else order[-1][0]
    bar = sorted(key, reverse=True)[sum(w >= cut for w in weight) - 1]
    return [d for d, k in zip(docs, key) if k >= bar]


def without_repeats(docs):
    seen, out = {}, []
    for i, t, s in sorted(docs):
        solid = [(p, x.strip(" ")) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        gone = set()
        for a in range(len(solid)):
            for size in (1, 2, 3):
                some = solid[a : a + size]
                if len(some) == size and (size == 3 or sum(len(WORD.findall(x)) for _, x in some) >= 50) and seen.setdefault(tuple(x for _, x in some), (i, a)) < (i, a):
                    gone |= {p for p, _ in some}
        left = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone)
        if not gone or left.strip("\n "):
            out.append((i, left if t is not None else None, s))
    return out


def one_of_each(docs):
    sets, root = {}, {}
    for i, t, _ in docs:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [d for d in docs if find(d[0]) == d[0]]


def mixed(docs):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in names}
    weight, target, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    while True:
        rest = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= over
    out = []
    for s in names:
        mine = []
        for i, t, x in docs:
            if x == s:
                n = len(t or "")
                q = 0.05 + (len(regex.sub(r"[^\p{L} ]", "", t)) / n if n else 0.0)
                mine.append((-math.log(unit(i)) / q, i, t))
        epochs, before = int(target[s] // total[s]) if total[s] else 0, 0
        for _, i, t in sorted(mine):
            extra = epochs < 2 and before + size[i] / 2 <= target[s] - epochs * total[s]
            out += [(i, t, s)] * (epochs + extra if size[i] else 0)
            before += size[i]
    return out


def test_run(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    r = random.Random(12)
    words = {g: ["".join(r.choice("abcdefghiklmnoprstuvwé") for _ in range(r.randint(3, 8))) for _ in range(60)] for g in (0, 1)}
    line = lambda g, n: " ".join(r.choice(words[g]) for _ in range(n))
    passage = "\n".join(line(1, 12) for _ in range(4))
    long = line(1, 60)
    docs = []
    for i in range(260):
        g = 0 if i % 6 == 0 else 1
        t = "\n".join(line(g, r.randint(4, 14)) for _ in range(r.randint(1, 8)))
        t += r.choice(["", "", "", "\n" + passage, "\n" + long])
        if i and r.random() < 0.2:
            t = docs[-1][1].replace(" ", "  ", 1) if r.random() < 0.5 else docs[-1][1] + " " + words[1][0]
        docs.append((i, t, r.choice(["a", "b", "é", "a"])))
    docs[7], docs[9] = (7, "", "b"), (9, "one", "a")
    label = {i: int(i % 6 > 0) for i in range(120)}
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in label.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = mixed(one_of_each(without_repeats(good_ones(docs, label))))
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.text, x.source, x.ids) for x in got) == sorted((i, t, s, enc.encode_ordinary(t)) for i, t, s in want)
    kept = {i for i, *_ in want}
    assert len(kept) < len(docs) - 30 and len(want) > len(kept)


def test_run_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fingerprints_recomputed(spark):
    # every fingerprint from its definition, with loops, over a table of the driver's
    import xxhash

    from quillon.llm import fingerprint

    def text_hash(s):
        return xxhash.xxh64(s.encode(), seed=42).intdigest()

    def chain(values):
        h = 42
        for v in values:
            h = xxhash.xxh64(v.to_bytes(8, "little"), seed=h).intdigest()
        return h

    def print_of(t):
        w = WORD.findall(t.lower())
        hashes = [text_hash(x) for x in w]
        shingles = [chain(hashes[i : i + 5]) for i in range(len(w) - 4)] or ([text_hash(" ".join(w))] if w else [])
        least = {}
        for h in shingles:
            least[h >> 57] = min(h, least.get(h >> 57, h))
        if not least:
            return [0] * 128, True
        out = []
        for b in range(128):
            step, k = ((b * 2654435761 + 40503) >> 7) % 64 * 2 + 1, 0
            while (b + k * step) % 128 not in least:
                k += 1
            out.append(least[(b + k * step) % 128] & 255)
        return out, False

    def likeness(a, b):
        if a[1] or b[1]:
            return float(a[1] and b[1])
        return max(0.0, (sum(x == y for x, y in zip(a[0], b[0])) / 128 - 1 / 256) / (1 - 1 / 256))

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    data = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    for k, (i, t) in enumerate(data):
        after, q = data[(k + 1) % len(data)][1], len(t) // 4
        own, edited = print_of(t), print_of(t[: len(t) - q] + after[:q])
        r = got[i]
        assert r.fingerprint == bytes(own[0]).hex() and r.edited_fingerprint == bytes(edited[0]).hex()
        assert math.isclose(r.near_edited, likeness(own, edited), abs_tol=1e-12) and math.isclose(r.near_next, likeness(own, print_of(after)), abs_tol=1e-12)
