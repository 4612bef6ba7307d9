"""Corpus operators on small fixtures: brute force, round trips, nulls, empties, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, fingerprint, html_text, line_dedup, media_ogg, mixing, near_dedup, quality, suffix_dedup, token_store
from quillon.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string"


def rows(seed=1, n=60):
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "délta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "λάμδα", "mu."]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    block = "\n".join(line(9) for _ in range(5))
    long, pair = line(55), line(30) + "\n" + line(24)
    texts = [None, "", "   \n\t ", "one", "two words", "x" * 400, line(4000)]
    while len(texts) < n:
        t = "\n".join(line(r.randint(3, 14)) for _ in range(r.randint(1, 9)))
        if r.random() < 0.3:
            t += "\n" + block
        if r.random() < 0.15:
            t += "\n" + r.choice([long, pair])
        if r.random() < 0.2 and texts[-1]:
            t = texts[-1]
        elif r.random() < 0.3 and texts[-1] and len(texts[-1]) > 100:
            t = texts[-1].replace("alpha", "omega", 1)
        texts.append(t)
    sources = [None, "b", "a", "é", "hot", "hot", "hot"]
    return [(i * 3, t, "en", r.choice(sources), len(t or ""), 7, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    seen, want = {}, {}
    data = [(i, t) for i, t, *_ in rows()]
    for i, t in data:
        solid = [(p, x.strip(" ")) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        gone = set()
        for s in range(len(solid)):
            for size in (1, 2, 3):
                some = solid[s : s + size]
                if len(some) == size and (size == 3 or sum(len(WORD.findall(x)) for _, x in some) >= 50):
                    if seen.setdefault(tuple(x for _, x in some), (i, s)) < (i, s):
                        gone |= {p for p, _ in some}
        want[i] = (len(solid), len(gone), "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.digest(docs).collect()}
    assert got == {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in want.items()}
    assert sum(b for _, b, _ in want.values()) > 20
    out = line_dedup.stage(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text or "" for r in out.collect()} == {i: c for i, (a, b, c) in want.items() if not b or c.strip("\n ")}
    assert line_dedup.stage(none).count() == line_dedup.digest(none).count() == 0
    # null and repeated ids, and one line in most documents: it alone is short, so it stays
    some = [(None, "a\nb\nc"), (1, "a\nb\nc\nx"), (1, "a\nb\nc\nx"), (1, "a\nb\nc\ny"), *((i, f"p{i}\ncommon\nq{i}") for i in range(2, 300)), (300, "a\nb\ncommon\na\nb\nc\nd")]
    odd = docs.sparkSession.createDataFrame([(i, t, "k") for i, t in some], "doc_id long, text string, f string")
    got = [(r.doc_id, r.text) for r in line_dedup.stage(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, "a\nb\nc"), (1, "x"), (1, "x"), (1, "y"), *some[4:-1], (300, "a\nb\ncommon\nd")], key=str)


def test_fingerprints(docs, none, spark):
    data = [(i, t or "") for i, t, *_ in rows()]
    got = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    plain = {}
    for k, (i, t) in enumerate(data):
        q = len(t) // 4
        edited = t[: len(t) - q] + data[(k + 1) % len(data)][1][:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        plain.setdefault(t, set()).add(got[i].fingerprint)
        plain.setdefault(edited, set()).add(got[i].edited_fingerprint)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if t == edited:
            assert got[i].near_edited == 1
        a, b = shingles(t, 5), shingles(edited, 5)
        if a or b:
            assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.25
        c = shingles(data[(k + 1) % len(data)][1], 5)
        if a or c:
            assert abs(got[i].near_next - len(a & c) / len(a | c)) < 0.25
    for s in plain.values():
        assert len(s) == 1  # the two ways to a text's fingerprint agree
    assert fingerprint.compare(none).count() == 0
    one = fingerprint.compare(spark.createDataFrame([(None, "a b c d e f g")], "doc_id long, text string")).first()
    assert one.near_next == 1
    assert not re.search("Python|Pandas|Arrow", fingerprint.compare(docs)._jdf.queryExecution().executedPlan().toString())


def shingles(t, k):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_ogg(docs, none):
    for r in media_ogg.digest(docs).collect():
        raw = next((t or "") for i, t, *_ in rows() if i == r.doc_id).encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert media_ogg.digest(none).count() == 0
    file = media_ogg.write(bytes(range(256)) * 300, 5)
    assert media_ogg.features(media_ogg.read(file))[0] == bytes(range(256)) * 300
    crc = 0
    page = file[:22] + b"\0\0\0\0" + file[26 : 28 + file[27]]
    for b in page:  # the definition, bit by bit
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    assert crc == int.from_bytes(file[22:26], "little")
    for bad in (file[:-3], file[:100] + b"?" + file[101:], file[: 28 + file[27]] + file[-70:]):
        with pytest.raises(ValueError):
            media_ogg.read(bad)


def test_mixing(docs, none):
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}
    source = {i: s for i, _, _, s, *_ in rows()}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, target, open_ = 1.5 * sum(total.values()), {}, set(names)
    while True:
        rest = goal - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    got = mixing.digest(docs).collect()
    taken = defaultdict(int)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s)
    assert sorted(got) == sorted(mixing.digest(docs.repartition(7)).collect())
    out = mixing.stage(docs)
    assert out.columns == docs.columns and out.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.stage(none).count() == mixing.digest(none).count() == 0
    # repeated rows and ids each count, ties fall by size
    twice = docs.union(docs.limit(20)).union(docs.limit(1).selectExpr("cast(null as long)", "'a b c'", "lang", "source", "n_chars", "size", "key"))
    out = mixing.digest(twice).collect()
    assert len(out) == twice.count() and all(r.taken in (0, r.size, 2 * r.size) for r in out)
    with pytest.raises(ValueError):
        mixing.stage(docs.withColumn("_q_size", F.lit(1)))


def test_mixing_pieces(spark):
    # whatever the qualities, no piece holds many more rows than it should
    d = spark.range(200_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 0.05 else 1.0 end as q")
    key = d.select((F.log(-F.log(mixing.unit_hash(F.col("doc_id"))) / F.col("q")) * 200_000 / (mixing.ROWS_PER_PIECE * np.e)).alias("t"))
    assert key.groupBy(F.floor("t")).count().agg(F.max("count")).first()[0] < 1.2 * mixing.ROWS_PER_PIECE


def test_quality(spark, none):
    r = random.Random(3)
    good = lambda: " ".join(r.choice("the of and house tree river stone cloud".split()) for _ in range(60))
    bad = lambda: " ".join(r.choice("BUY!! $$$ click%%% win### free***".split()) for _ in range(60))
    data = [(i, good() if i % 4 else bad()) for i in range(400)] + [(400, None), (401, ""), (None, good()), (3, good())]
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, _extra int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)] + [(None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int")
    keep = {x.doc_id: x.keep for x in quality.digest(docs, labels).collect()}
    wrong = [i for i, _ in data[120:400] if keep[i] != bool(i % 4)]
    assert len(wrong) <= 2 and keep[None]
    out = quality.stage(docs, labels)
    assert out.columns == docs.columns and abs(out.count() - sum(quality.digest(docs, labels).toPandas().keep)) == 0
    assert quality.stage(docs, labels.limit(0)).count() == len(data)
    assert quality.stage(none, labels).count() == 0
    x = spark.range(30000).selectExpr("cast(xxhash64(id) % 9000 as double) as v")
    v = sorted((a.v for a in x.collect()), reverse=True)
    assert [quality.kth_largest(x, "v", k) for k in (1, 777, 15000, 30000)] == [v[k - 1] for k in (1, 777, 15000, 30000)]


def test_quality_by_brute_force(spark):
    # weights, noise, cut and kept set of the definition, with loops; no toxic labels
    import math

    r = random.Random(8)
    word = lambda q: r.choice("alpha beta gamma delta epsilon".split() if r.random() < q else "omega psi chi phi tau".split())
    data = [(i, " ".join(word(0.9 if i % 5 else 0.2) for _ in range(r.randint(1, 40)))) for i in range(300)] + [(300, ""), (301, None), (7, "omega " * 9)]
    label = {i: int(i % 5 > 0) for i in range(150)}
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((x.doc_id, round(x.log_weight, 6), x.keep) for x in quality.digest(docs, spark.createDataFrame([(i, q, 0) for i, q in label.items()], "doc_id long, quality int, toxic int")).collect())

    def grams(t):
        g, _ = quality.ngram_buckets([t or ""])
        return [x for x in g.ravel().tolist() if x >= 0]

    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in data:
        for g in grams(t):
            raw[g] += 1
            target[g] += label.get(i) == 1
    prior = (raw + 1) / (raw.sum() + quality.BUCKETS)
    ratio = np.log((target + quality.BUCKETS * prior) / (target.sum() + quality.BUCKETS)) - np.log(prior)
    rows_ = []
    for i, t in data:
        n = len(WORD.findall(t or ""))
        u = (int(hashlib.md5(f"gumbel|{i}".encode()).hexdigest()[:8], 16) + 1) / 4294967297.0
        w = 100.0 * sum(ratio[g] for g in grams(t)) / (max(2 * n - 1, 0) + 10.0)
        rows_.append((i, w, w - math.log(-math.log(u))))
    least = {i: min(w for j, w, _ in rows_ if j == i) for i in label}
    order = sorted(least.items(), key=lambda x: x[1])
    cost = [20 * sum(label[i] for i, _ in order[:c]) + sum(1 - label[i] for i, _ in order[c:]) for c in range(len(order) + 1)]
    c = cost.index(min(cost))
    cut = -math.inf if c == 0 else (order[c - 1][1] + order[c][1]) / 2 if c < len(order) else order[-1][1]
    k = sum(w >= cut for _, w, _ in rows_)
    bar = sorted((key for *_, key in rows_), reverse=True)[k - 1]
    assert got == sorted((i, round(w, 6), key >= bar) for i, w, key in rows_)
    assert 0 < k < len(rows_)


def test_kth_largest(spark):
    for values in ([5.0] * 12000 + [1.0] * 3, [float(x % 3) for x in range(15000)], [math_exp for math_exp in np.exp(np.linspace(-300, 300, 20000))], [1.0, 2.0]):
        x = spark.createDataFrame([(float(v),) for v in values], "v double")
        v = sorted(map(float, values), reverse=True)
        for k in (1, len(v) // 3 + 1, len(v)):
            assert quality.kth_largest(x, "v", k) == v[k - 1]


def test_quality_toxic(spark):
    r = random.Random(4)
    vocab = [f"{a}{b}" for a in "ba co di fu ge".split() for b in "lan mer tis von rud".split()]
    mean = "zorg blat fizk gnarp".split()
    text = lambda toxic: " ".join(r.sample([r.choice(vocab) for _ in range(120)] + (r.sample(mean, 2) if toxic else []), 120 + 2 * toxic))
    junk = lambda: " ".join(r.choice("BUY!! $$$ click%%% win### free***".split()) for _ in range(60))
    toxic = lambda i: i % 8 == 3
    data = [(i, junk() if i % 8 == 0 else text(toxic(i))) for i in range(800)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0), int(toxic(i))) for i in range(400)], "doc_id long, quality int, toxic int")
    keep = {x.doc_id: x.keep for x in quality.digest(docs, labels).collect()}
    for part in (range(400), range(400, 800)):  # labelled and unseen
        assert sum(keep[i] for i in part if toxic(i)) <= 2
        assert sum(not keep[i] for i in part if i % 8 and not toxic(i)) <= 8


def test_byte_bpe(docs, none):
    import base64

    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {i: t or "" for i, t, *_ in rows()}
    for r in bpe.digest(docs, path, public_tokenizers.PATTERN).collect():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    c = bpe.coder(path, public_tokenizers.PATTERN)
    for t in ["it's I'LL 12½ x²\x1c\x85 \xa0\n\n y  ", "  a\tb 　 中文字 привет 🙂🙂 <|endoftext|>", "\x00\x01ÿ " * 50, "'re''s 's", "é" * 3000, " \n \n x", "a" * 5000]:
        assert c.encode(t) == " ".join(map(str, enc.encode_ordinary(t))) and c.decode(c.encode(t)) == t.encode()
    out = {r.doc_id: r for r in bpe.stage(docs, path, public_tokenizers.PATTERN).collect()}
    assert all(out[i].text == t for i, t, *_ in rows())
    assert bpe.digest(none, path, public_tokenizers.PATTERN).count() == 0


def test_suffix_dedup(spark, none):
    r = random.Random(5)
    soup = lambda n: "".join(r.choice("ab é") for _ in range(n))
    shared, texts = [soup(120), soup(60), "z" * 200], [None, "", "short"]
    for _ in range(40):
        t = soup(r.randint(0, 300))
        for s in shared:
            if r.random() < 0.4:
                a = r.randint(0, len(s) // 2)
                t += s[a : a + r.randint(30, len(s))] + soup(r.randint(0, 40))
        texts.append(r.choice([t, t, t, texts[-1]]))
    data = [(i, t) for i, t in enumerate(texts)] + [(None, soup(100) + shared[0]), (7, texts[7]), (7, shared[0] + "q")]
    first = {}
    raw = [((i is not None, i or 0), i, (t or "").encode()) for i, t in data]
    for k, _, b in raw:
        for q in range(len(b) - 49):
            g = b[q : q + 50]
            first[g] = min(first.get(g, k), k)
    want = []
    for k, i, b in raw:
        cut = np.zeros(len(b), bool)
        for q in range(len(b) - 49):
            if first[b[q : q + 50]] < k:
                cut[q : q + 50] = True
        left = bytes(x for x, c in zip(b, cut) if not c)
        want.append((-1 if i is None else i, len(b), int(cut.sum()), int((np.diff(cut.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, bucket int")
    got = [(-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digest(docs.repartition(5)).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 1000
    assert suffix_dedup.digest(none).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, new = suffix_dedup.multikey_order(keys)
    rows_ = [tuple(x) for x in keys[order]]
    assert rows_ == sorted(map(tuple, keys)) and [bool(x) for x in new] == [i == 0 or rows_[i] != rows_[i - 1] for i in range(500)]


def test_token_store(docs, none, spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok, start = Tokenizer.from_file(path), 0
    blocks = token_store.write_store(docs, path)
    got = {r.doc_id: r for r in token_store.read_store(blocks).collect()}
    for i, t, *_ in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    latin = ["ÀÉÎ's ªº µm ß×÷ x² ½ a\x85b\xa0c \x1cd\x1f ''s 'RE'll 12 3.4!?,; naïve't", "".join(map(chr, range(1, 256))) * 2]
    for text in [*latin, "a,b .. ., it's IT'S \x1cA b<|endoftext|>c, ΑΣ. ΟΔΟΣ, 1,2 x1. É, don't, ab.. A.B. 　x", "é́ ﬁ, Ǆ."]:
        assert np.frombuffer(token_store.token_ids([text], path)[0], "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, int), rng.integers(0, 49408, 5000), np.tile(rng.integers(0, 49408, 50), 200), np.full(3000, 49407), rng.zipf(1.2, 9000) % 49408):
        coded = token_store.encode_blocks(ids)
        assert not len(ids) or (token_store.decode_blocks(coded).ravel()[: len(ids)] == ids).all()
    data = bytearray(blocks.first().data)
    data[30] ^= 1
    with pytest.raises(ValueError):
        token_store.unpack(bytes(data))
    a, b = b"hello", b"world, again"
    assert token_store._shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)
    assert token_store.digest(none, path).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
    <nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad > --><div class="ad">Buy this.</div><div id="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1>
    <p>Short.<p>The first   paragraph of the article is long enough to be decided by its length, and it has <a href="x">a link</a>.<br>Next &lt;b&gt; line&nbsp;here.</p>
    <form><input><button>Send</button></form><aside>See also</aside><section class="comments"><p>First!</p></section><p>Last &copy &#233;.</p></article><footer>&copy; us</footer>"""
    want = "Title & more\n\nShort.\n\nThe first paragraph of the article is long enough to be decided by its length, and it has a link. Next <b> line here.\n\nLast © é."
    assert html_text.main_text(page) == want
    long = "It was the best of times and it was the worst of times, so we went to the sea with all of our friends and they were happy to be there for a while. " * 2
    plain = f"<div><a href=1>Home</a> <a href=2>News</a></div><h1>A day</h1><p>{long}</p><p>Ok.</p><p>{long}</p><div><a href=3>More</a></div>"
    assert html_text.main_text(plain) == f"A day\n\n{long.strip()}\n\nOk.\n\n{long.strip()}"
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<p cla"), (None, "x", "<article>a&am")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("", 0), None: ("a&am", 4)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_wrappers():
    text = "It was the best of times and it was the worst of times, so we went to the sea with all of our friends and they were happy to be there for a while."
    ad = "<div class='widget'><p>Buy this.</p></div>"
    for wrap in ("layout has-sidebar", "widget-container"):
        page = f"<html><head><title>t</title></head><body><div class='{wrap}'>{ad}<nav>Menu</nav><article><p>{text}</p>{ad}</article></div></body></html>"
        assert html_text.main_text(page) == text
        assert html_text.main_text(page.replace("article>", "main>")) == text
    # names still decide inside an article, and navigation stays unwanted whatever stands in it
    assert html_text.main_text(f"<article><p>{text}</p><div class='comments'><article><p>{text} First!</p></article></div></article>") == text
    assert html_text.main_text(f"<main><p>{text}</p></main><nav><div class='widget'><article><p>{text}</p></article></div></nav>") == text
    for start in ("<body>", "<div>", "<h1></h1>", "<br>", ""):
        assert html_text.main_text(f"<html><head><meta charset=utf-8><title>t</title><style>p</style>{start}<article><p>{text}</p></article>") == text


def test_html_names_and_languages():
    text = "It was the best of times and it was the worst of times, so we went to the sea with all of our friends and they were happy to be there for a while."
    for start, end in (("<div class='page has-sidebar'>", "</div>"), ("<div class='layout with-sidebar'>", "</div>"), ("<section class='post comments-open'>", "</section>"), ("<div id='share-article'>", "</div>"), ("<div class='sidebar'>", "</div>")):
        assert html_text.main_text(f"<body>{start}<article><p>{text}</p></article>{end}</body>") == text
        # without an article: the names don't speak for a whole token, or the element holds most of the text
        plain = html_text.main_text(f"<body><div><a href=1>Home</a></div>{start}<p>{text} {text}</p><p>{text} {text}</p>{end}</body>")
        assert plain == f"{text} {text}\n\n{text} {text}"
    for name in ("comments", "comment-list", "cookie-notice", "site-footer", "nav-bar", "sidebarLeft", "social_links", "page-header"):
        assert html_text.main_text(f"<body><p>{text} {text}</p><div class='{name}'><p>{text}</p></div><p>{text} {text}</p></body>") == f"{text} {text}\n\n{text} {text}"
    for other in ("Жили-были старик со старухой у самого синего моря и жили они в ветхой землянке ровно тридцать лет и три года. " * 3, "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。" * 2, "Lanku mirto sevali dorne, pasku telimo ravni kusto belari, nomi trasku velo dinare. " * 4):
        page = f"<body><ul><li><a href=1>{other[:20]}</a></li><li><a href=2>{other[:15]}</a></li></ul><h1>{other[:12].strip()}</h1><p>{other}</p><p>{other}</p><div><a href=3>{other[:30]}</a></div></body>"
        assert html_text.main_text(page) == f"{other[:12].strip()}\n\n{other.strip()}\n\n{other.strip()}"
    # rules inside an article: a list of links between paragraphs goes, a table of numbers stays
    page = f"<article><p>{text}</p><ul><li><a href=1>Read this</a></li><li><a href=2>And this</a></li></ul><p>{text}</p><table><tr><td>1,234 5,678 9,012 3,456 7,890 1,234 5,678 9,012 3,456 7,890 1,234 5,678</td></tr></table><p>{text}</p></article>"
    got = html_text.main_text(page)
    assert "Read this" not in got and "1,234" in got and got.count(text) == 3


def test_html_blocks_of_made_pages():
    # pages without article or main, made of blocks whose kind is known
    r, wrong, total = random.Random(5), 0, 0
    common = "the of and to in a is that it was for on are with as at be this have from or by not but".split()
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.45 else word() for _ in range(n)).capitalize() + "."
    for _ in range(60):
        blocks_ = [(False, "".join(f"<li><a href=/{i}>{word()} {word()}</a></li>" for i in range(6)), "ul")]
        for _ in range(r.randint(3, 7)):
            blocks_.append((True, prose(r.randint(50, 120)), "p"))
            if r.random() < 0.4:
                blocks_.append((True, prose(r.randint(3, 8)), "p"))
        blocks_ += [(False, f"<a href=/x>{word()}</a> <a href=/y>{word()} {word()}</a>", "div"), (False, " ".join(word() for _ in range(60)), "div")]
        page = "<html><body>" + "".join(f"<{t}>{x}</{t}>" for _, x, t in blocks_) + "</body></html>"
        got = html_text.main_text(page).split("\n\n")
        want = [x for good, x, _ in blocks_ if good]
        wrong += len(set(got) ^ set(want))
        total += len(want)
    assert wrong <= 0.02 * total


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup(spark, none, words):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    data = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "É a"), (7, "é a")]
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        for _ in range(r.choice([1, 2, 6, 25])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 18))):
                t[r.randrange(len(t))] = r.choice(vocab)
            data.append((len(data), " ".join(t)))
    ids = [i for i, _ in data]
    r.shuffle(ids)
    data = [(i, t) for i, (_, t) in zip(ids, data)]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in data:
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame([(i, t, "x") for i, t in data] + [(None, "w1 w2 w3 w4 w5 w6", "x")], "doc_id long, text string, rep string")
    got = {x.doc_id: x for x in near_dedup.digest(docs, words).collect()}
    assert got[None].kept and got[None].component_id is None
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    out = near_dedup.stage(docs, words)
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == {i for i in sets if find(i) == i} | {None}
    assert near_dedup.digest(none).count() == near_dedup.stage(none).count() == 0


def test_near_dedup_repeated_ids(spark):
    r = random.Random(2)
    text = lambda: " ".join(r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(60))
    a, b, c = text(), text(), text()
    data = [(1, a), (1, a), (1, b), (2, a + " more"), (3, b), (4, c), (4, c), (None, a), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in near_dedup.digest(docs).collect()), key=str)
    assert len(got) == len(data) and set(got) == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)}
    kept = near_dedup.stage(docs, 2).collect()
    assert sum(x.doc_id == 4 for x in kept) == 2 and sum(x.doc_id is None for x in kept) == 2 and not any(x.doc_id == 3 for x in kept)


def test_near_dedup_links_all_texts_of_an_id(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice("abcdefgh") + str(r.randint(0, 999)) for _ in range(80))
    data = []
    for i in range(20):  # id i has two texts, and each has a near copy under another id
        a, b = text(), text()
        data += [(i, a), (i, b), (100 + i, a + " more"), (200 + i, "more " + b)]
    data += [(7, text()) for _ in range(30)] + [(300, data[0][1])] * 40  # one id with many texts, one row many times
    got = near_dedup.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == len(data)
    assert {x.doc_id: x.component_id for x in got} == {i: 0 if i == 300 else i % 100 for i, _ in data}


def test_tables_between_are_removed(spark, docs):
    import os

    from quillon.llm.common import shared_dir

    where = shared_dir(spark).removeprefix("file://") + "/quillon"
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    near_dedup.digest(docs).count()
    suffix_dedup.digest(docs).count()
    line_dedup.digest(docs).count()
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(where)) - before) == ["components", "deduplicated", "repeats"]


def test_repeated_rows_and_null_ids(spark):
    from tokenizers import Tokenizer

    data = [(None, "one two"), (5, "b c d"), (5, "b c d"), (5, "a b"), (None, None), (2, "x " * 30)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in data], "doc_id long, text string, part int, place string")
    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in token_store.digest(docs, path).collect()), key=str) == sorted(want, key=str)
    prints = fingerprint.compare(docs).collect()
    assert len(prints) == len(data) and len({r.fingerprint for r in prints if r.doc_id == 5 and r.n_chars == 5}) == 1
    import public_tokenizers

    bytes_ = tokenizer_path("byte_bpe_50k.tiktoken")
    assert sorted(r.n_tokens for r in bpe.digest(docs, bytes_, public_tokenizers.PATTERN).collect())[0] == 0
    assert media_ogg.digest(docs).count() == len(data)


def test_bayes_bound():
    least = near_dedup.least_matches(0.8)
    p = 0.8 + 0.2 / 256
    for k, m in enumerate(least):
        n = near_dedup.BATCH * (k + 1)
        draws = np.random.default_rng(k).beta(m + 1, n - m + 1, 200_000)
        assert m < n * p and (draws >= p).mean() < 1e-4


def test_triangle_bound():
    import pyarrow as pa

    # signatures of a pivot and of x at similarity 0.6, the least that a member linked to one that is linked to the pivot can have
    g, n, size = np.random.default_rng(9), 20_000, near_dedup.BANDS * near_dedup.ROWS
    p = g.integers(0, 256, (n, size), dtype=np.uint8)
    y = np.where(g.random((n, size)) < 0.6, p, g.integers(0, 256, (n, size), dtype=np.uint8))
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([v.tobytes() for v in p]), pa.array([v.tobytes() for v in y])], names=list("abxy"))
    est = next(near_dedup._bayes(0.8)([b])).column(3).to_numpy()
    assert (est < 0.45).mean() < 5e-4 and abs(est.mean() - 0.6) < 0.01
    e = near_dedup.slack(0.8)
    assert 0.15 <= e < 0.2 and (est < 0.6 - e).sum() == 0
    # places where linked members differ, as matches with the pivot can differ in number
    assert (g.binomial(size, 0.2, 1_000_000) / size / (255 / 256) > 0.2 + e).sum() <= 10


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, step, sf)
        assert new.columns == docs.columns
        step = spark.createDataFrame(new.toPandas(), docs.schema)
    want = sorted((r.doc_id, r.text) for r in step.collect())
    assert sorted(zip(out.doc_id, out.text)) == want and len(want) > 50 and (out.n_tokens > 0).all()
