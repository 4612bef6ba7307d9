"""Deep and broken markup in time that grows with the page, and a plain version of the second pass."""

import random
import time

import pytest

from quillon.llm import html_text

TEXT = "the cat of the house and a dog " * 20


@pytest.mark.parametrize("page, want", [
    ('<div class="sidebar">' * 10_000 + f"<p>{TEXT}</p>" + "</div>" * 10_000, TEXT.strip()),
    ("<div>" * 10_000 + f"<p>{TEXT}</p>", TEXT.strip()),
    ("<b></x>" * 150_000 + f"<p>{TEXT}</p>", TEXT.strip()),
    ("<b>" * 100_000 + "<li>" * 20_000 + f"<p>{TEXT}</p>", TEXT.strip()),
    (("<b>" * 1_000 + "<div>") * 200 + f"<p>{TEXT}</p>", TEXT.strip()),
    (f"<p>{TEXT * 2_000}</p>", (TEXT * 2_000).strip()),
    ('<a class="ad"><a class="ad">x</a>' + f"<p>{TEXT}</p>", TEXT.strip()),
])
def test_deep_pages(page, want):
    began = time.process_time()
    assert html_text.main_text(page) == want
    assert time.process_time() - began < 5  # a second on a quiet machine


def plain_labels(found):
    """The second pass by looking at every decided block for every undecided one."""
    first = []
    inside = any(article and not bad for _, _, bad, article in found)
    outs = [bad or (inside and not article) for _, _, bad, article in found]
    sizes = [0 if o else html_text._size(t) for (t, *_), o in zip(found, outs)]
    stops = [html_text._density(t) if n >= html_text.SHORT and links <= html_text.MOST_LINKS_IN_ARTICLE else 0.0 for (t, links, *_), n in zip(found, sizes)]
    long = [(n, d) for n, d, (_, links, *_) in zip(sizes, stops, found) if n >= html_text.SHORT and links <= html_text.MOST_LINKS]
    known = sum(n * d for n, d in long) >= html_text.STOP_KNOWN * sum(n for n, _ in long)
    for (_, links, *_), o, n, d in zip(found, outs, sizes, stops):
        if o:
            x = False
        elif inside:
            x = False if links > 0.8 else True if n >= 70 and links <= 0.2 and (d >= 0.1 or not known) else None
        elif links > 0.2:
            x = False
        elif n < 70:
            x = None
        elif known:
            x = True if d >= 0.32 and n > 200 else None if d >= 0.30 else False
        else:
            x = True if n > 200 else None
        first.append(x)
    scope = [i for i, b in enumerate(found) if not inside or (b[3] and not b[2])]
    out = []
    for i, x in enumerate(first):
        if x is None:
            left = [j for j in scope if j < i and first[j] is not None][-1:]
            right = [j for j in scope if j > i and first[j] is not None][:1]
            best = sorted((abs(j - i), not first[j], j) for j in left + right)
            x = inside if not best else first[best[0][2]]
        out.append(bool(x))
    return out


def test_second_pass_against_a_plain_search():
    r = random.Random(6)
    pieces = ["the cat of the house and a dog " * 3, "the cat of the house and a dog " * 9, "word " * 20, "word " * 60, "short", "ein Wort"]
    for _ in range(2_000):
        article = r.random() < 0.4
        found = [(r.choice(pieces).strip(), r.choice([0.0, 0.0, 0.1, 0.5, 0.9]), r.random() < 0.2, article and r.random() < 0.7) for _ in range(r.randint(0, 12))]
        assert html_text.labels(found) == plain_labels(found)
