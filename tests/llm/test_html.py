"""HTML extraction: the probes of its rules, hostile pages, and a second version of both passes on random pages."""

import html
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from kinmark.llm import html_extract as H

LONG = "The cat is in the house and the dog is on the mat, as it was in the days of old when all of them were at home by the sea."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="content with-sidebar"><h1>T</h1><p>{LONG}</p><p>Yes.</p></div><div class="sidebar"><p>{LONG}</p></div>', f"T\n\n{LONG}\n\nYes."),
        (f'<div id="social-science"><h1>T</h1><p>{LONG}</p></div><footer>x</footer>', f"T\n\n{LONG}"),
        (f'<section id="social-science"><p>{LONG}</p></section>', LONG),
        ('<p>Hello world.</p><svg class="icon"/><p>Second paragraph.</p>', "Hello world.\n\nSecond paragraph."),
        (f'<div id=post><h1>Title</h1><p>{LONG}</p></div><div class="comment-list">{f"<p>{LONG}</p>" * 5}</div>', f"Title\n\n{LONG}"),
        (f"<form id=page><h1>Title</h1><p>{LONG}</p><p>End.</p></form>", f"Title\n\n{LONG}\n\nEnd."),
        (f"<article><p>{LONG}</p><form><p>{LONG}</p></form></article>", LONG),
        (f'<div class=main><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=related><article><h2>Other</h2><p>Teaser</p></article></div>', f"T\n\n{LONG}\n\n{LONG}"),
        (f'<article><h1>T</h1><p>{LONG}</p><div class="newsletter-signup"><p>{LONG}</p></div><p>End.</p></article><div><p>{LONG}</p></div>', f"T\n\n{LONG}\n\nEnd."),
        (f'<body class="has-nav"><p>{LONG}</p><div class="siteFooter">About us and all of the rest</div>', LONG),
        ("<article><h1>Short</h1><p>Bad luck</article><footer>x</footer>", "Short\n\nBad luck"),
        (f'<div hidden><p>{LONG}</p></div><p>{LONG}</p>', LONG),
        ("<b id=\"x>y\">in</b><p title='a > b'>Last", "in\n\nLast"),
        ('<p>One <b title="x>Two</p><p>Three</p>', "One Two\n\nThree"),
        ("a < b, c<d", "a < b, c<d"),
    ],
)
def test_rules(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    ['<script "' * 40_000, "<div>" * 30_000 + "</p>" * 30_000, '<a x="1>" ' * 40_000, '<a ="' * 60_000 + ">", "<button>" * 40_000, "</script x" * 40_000, "<script>" + "</script x" * 40_000, "<" * 300_000, "<b>" * 90_000, "<svg>" * 60_000, "<div " + "a='" * 100_000 + ">", "<p>&" * 80_000, '<div class="' + "ad-" * 90_000 + '">x'],
)
def test_hostile_pages_take_linear_time(page):
    def seconds(text):
        began = time.process_time()
        H.main_text(text)
        return time.process_time() - began

    whole, part = min(seconds(page) for _ in range(2)), min(seconds(page[: len(page) // 4]) for _ in range(2))
    assert whole < 3 and whole < 9 * part + 0.2  # four times the length; a square would be sixteen times the time


class Tree(HTMLParser):
    """Blocks of a well-formed page, each with its chain of (tag, attributes) and the pages' frames, found naively."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.chain, self.blocks, self.now, self.n = [], [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag in H.BREAKS:
            self.now = None
        self.n += 1
        self.chain.append((tag, dict(attrs), self.n))

    def handle_endtag(self, tag):
        if tag in H.BREAKS:
            self.now = None
        self.chain.pop()

    def handle_data(self, data):
        if self.now is None:
            self.now = [list(self.chain), "", ""]
            self.blocks.append(self.now)
        self.now[1] += data
        if any(t == "a" for t, _, _ in self.chain):
            self.now[2] += data.strip()


def second_version(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    rows = []
    for chain, text, linked in tree.blocks:
        text = " ".join(text.split())
        if text:
            words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
            rows.append((chain, text, len(linked) / len(text), max(sum(w in s for w in words) for s in H.STOP) / len(words)))
    run = [len(t) >= 100 and share <= 0.35 and dense >= 0.2 for _, t, share, dense in rows]
    starts = [(m.start(), m[1]) for m in re.finditer(r"<(\w+)", page)]

    def frames(number):
        """The element holds an article, main or h1 (or is one), and running text."""
        inner = {n: tag for chain, *_ in rows for tag, _, n in chain if any(x[2] == number for x in chain[: [y[2] for y in chain].index(n) + 1])}
        head = any(tag in ("article", "main", "h1") for tag in inner.values())
        return head and any(r and any(x[2] == number for x in chain) for (chain, *_), r in zip(rows, run, strict=True))

    def place(chain):
        points, inside = 0.0, False
        for tag, attrs, number in chain:
            above, inside = points, inside or tag in ("article", "main")
            own = -8.0 if tag in ("nav", "footer", "aside", "menu", "dialog") or tag == "header" and not inside else 0.0
            names = -8.0 if tag == "form" else 0.0
            if tag not in ("html", "body", "main", "article"):
                for key, value in attrs.items():
                    if key in ("class", "id"):
                        names += H.named(value)
            points = above + own + (max(names, 0.0) if frames(number) else names)
            points = min(points, above + 1) if above < 0 else min(points, 1.0)
        return points, inside

    places = [place(chain) for chain, *_ in rows]
    total = sum(len(t) for (_, t, *_), r, (p, _) in zip(rows, run, places, strict=True) if r and p > -1.5)
    held = sum(len(t) for (_, t, *_), r, (p, i) in zip(rows, run, places, strict=True) if r and p > -1.5 and i)
    some = any(i and p > -1.5 for p, i in places)
    labels = []
    for (chain, text, share, dense), (points, inside) in zip(rows, places, strict=True):
        points += (3 if some and held * 3 >= total else 0) if inside else (-4 if some and held * 2 >= total else 0)
        if len(text) >= 100:
            points += 2 if dense >= 0.2 else 1 if dense >= 0.08 else -2 if share > 0 else 0
        elif len(text) >= 60 and dense >= 0.08:
            points += 1
        if share > 0.8:
            points -= 4 + 2 * any(t == "li" for t, *_ in chain)
        elif share > 0.35:
            points -= 1.5
        labels.append(1 if points >= 1.5 else -1 if points <= -1.5 else 0.5 if points > 0 else 0)
    kept = []
    for i, x in enumerate(labels):
        left = next(((i - j, labels[j]) for j in range(i - 1, -1, -1) if abs(labels[j]) == 1), None)
        right = next(((j - i, labels[j]) for j in range(i + 1, len(labels)) if abs(labels[j]) == 1), None)
        if abs(x) == 1:
            good = x == 1
        elif left is None and right is None:
            good = places[i][0] > -1.5 and (places[i][1] or not (some and held * 2 >= total))
        elif x == 0.5:
            good = not (left and right and left[1] == right[1] == -1)
        elif left and right:
            good = (left[1] if left[0] <= right[0] else right[1]) == 1
        else:
            good = (left or right)[1] == 1
        kept += [rows[i][1]] if good else []
    assert starts or not page
    return "\n\n".join(kept)


def test_second_version_on_random_pages():
    rng = np.random.default_rng(11)
    names = ["content", "with-sidebar", "sidebar", "social-science", "comment-list", "post-body", "ad", "x", "site-footer", "share-buttons"]
    words = "the of and a house dog river in to running mountain was green &amp; they lake with stone".split()
    dull = "Zorb Quix Plam Frun Drel Vosk".split()

    def text():
        pool = words if rng.random() < 0.7 else dull
        return " ".join(rng.choice(pool, rng.integers(1, 40)))

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            inner = text()
            if rng.random() < 0.3:
                inner = f"<a href=x>{inner}</a>" + (text() if rng.random() < 0.5 else "")
            return f"<{(t := rng.choice(['p', 'h2', 'p', 'blockquote']))}>{inner}</{t}>"
        if kind < 0.55:
            return "<ul>" + "".join(f"<li>{'<a href=y>' * (k := bool(rng.random() < 0.6))}{text()}{'</a>' * k}</li>" for _ in range(3)) + "</ul>"
        tag = rng.choice(["div", "div", "div", "section", "article", "aside", "nav", "footer", "form", "main", "header"])
        name = f' class="{rng.choice(names)}"' if rng.random() < 0.5 else ""
        head = "<h1>The title</h1>" if rng.random() < 0.2 else ""
        return f"<{tag}{name}>{head}{''.join(node(depth - 1) for _ in range(rng.integers(1, 5)))}</{tag}>"

    kept = 0
    for _ in range(400):
        page = f"<html><body>{''.join(node(3) for _ in range(rng.integers(1, 5)))}</body></html>"
        want = second_version(page)
        kept += bool(want)
        assert H.main_text(page) == want, page
    assert kept > 200 and html.unescape("&amp;") == "&"


def test_columns(spark):
    pages = spark.createDataFrame([(1, "<p>x", "k"), (None, None, "k"), (1, "<p>x", "k")], "page_id long, html string, html_ string")
    rows = H.extract(pages, keep=("page_id", "html", "html_")).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "<p>x", "k", "x"), (1, "<p>x", "k", "x"), (None, None, "k", "")]
    with pytest.raises(ValueError):
        H.extract(pages, keep=("page_id", "text"))
