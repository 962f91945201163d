"""Main text of pages: blocks, the tree, whole pages against a plain reading of their article."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfattr.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, c0 int"


def blocks_of(page):
    found = html_text.Blocks()
    found.read(page)
    return found


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b>c<p>d", ["abc", "d"]),
        ("<p>one<br>two</p>", ["one", "two"]),
        ("<p> a\n\t b&nbsp; c </p>", ["a b c"]),
        ("<P>x<SCRIPT>var t='</p>'; if (a<b) {}</SCRIPT>y</P>", ["x y"]),
        ("<style>p{}</style><p>a<!-- <p>no</p> -->b", ["ab"]),
        ("a<!-- never closed <p>b", ["a"]),
        ('<p title="a > b">x</p>', ["x"]),
        ("<p title=it's>x</p><p>y's</p>", ["x", "y's"]),
        ("<p>1 < 2 and 3 <4</p>", ["1 < 2 and 3 <4"]),
        ("<p>a</p><p clas", ["a"]),
        ("<p>a</p></div></x><p>b", ["a", "b"]),
        ("<select><option>no</select><p>a<textarea><p>no</textarea>", ["a"]),
        ("<svg><text>no</text><svg></svg></svg>yes", ["yes"]),
        ("<noscript><p>no</p></noscript><p>yes</p>", ["yes"]),
        ("<head><title>no</title></head><body>yes", ["yes"]),
        ("<p>&lt;b&gt; &am &#x41;&#66; &notanentity; &copy;</p>", ["<b> &am AB ¬anentity; ©"]),
        ("<script>never closed <p>a</p>", []),
        ("<!doctype html><?xml x?><p>a", ["a"]),
        ("<table><tr><td>a<td>b</table>", ["a", "b"]),
    ],
)
def test_blocks(page, texts):
    assert blocks_of(page).texts == texts


def test_features_of_neighbours_stay_within_a_page():
    found = html_text.Blocks()
    found.read("<p>one two <a href=x>three</a></p><li>four")
    found.read("<article><h1>five</h1></article>")
    rows = [dict(zip(html_text.FEATURES, r)) for r in found.features()]
    assert [r["words"] for r in rows] == [3, 1, 1] and rows[0]["links"] == pytest.approx(1 / 3)
    assert rows[1]["words_before"] == 3 and rows[0]["words_after"] == 1
    assert rows[1]["words_after"] == rows[2]["words_before"] == 0
    assert rows[1]["listed"] == 1 and rows[2]["heading"] == 1 and rows[2]["landmark"] == 1


def test_marks_end_with_their_element():
    found = blocks_of("<div class=sidebar><p>a<div>b</div></div><p>c<nav>d<ul><li>e</nav>f<section hidden>g</section>h")
    named, landmark = html_text.FEATURES.index("named"), html_text.FEATURES.index("landmark")
    rows = found.features()
    assert found.texts == list("abcdefgh")
    assert rows[:, named].tolist() == [-1, -1, 0, 0, 0, 0, -1, 0]
    assert rows[:, landmark].tolist() == [0, 0, 0, -1, -1, 0, 0, 0]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.booleans()), min_size=1, max_size=40))
def test_tree_splits_as_well_as_a_plain_search(rows):
    x, y = np.array([[a, b] for a, b, _ in rows], float), np.array([c for *_, c in rows], float)

    def gini(labels):
        return 2 * labels.mean() * (1 - labels.mean()) * len(labels) if len(labels) else 0.0

    tree = html_text.grow(x, y, depth=1)
    got = html_text.shares(tree, x)
    best = min([gini(y)] + [gini(y[x[:, f] <= c]) + gini(y[x[:, f] > c]) for f in (0, 1) for c in np.arange(0, 5) + 0.5])
    assert sum(2 * s * (1 - s) for s in got) == pytest.approx(best)
    full = html_text.shares(html_text.grow(x, y, depth=50), x)
    same = {(a, b): [c for p, q, c in rows if (p, q) == (a, b)] for a, b, _ in rows}
    assert full == pytest.approx([np.mean(same[a, b]) for a, b, _ in rows])


def test_labelled_pages_are_learned_and_hold_for_the_page_left_out():
    blocks, labels = html_text.labelled_blocks()
    assert ((html_text.shares(html_text.fitted(), blocks.features()) > 0.5) == labels).all()
    right = total = 0
    for k, page in enumerate(html_text.html_samples.PAGES):
        others = [x for j, x in enumerate(html_text.html_samples.PAGES) if j != k]
        blocks, labels = html_text.labelled_blocks([page])
        right += int(((html_text.shares(html_text.fitted(others), blocks.features()) > 0.5) == labels).sum())
        total += len(labels)
    assert right / total > 0.85


@pytest.fixture(scope="module")
def pages():
    draw = random.Random(2)

    def prose(n):
        return " ".join(draw.choice(["a", "été", "x&y", "<tag>", "it's", '"q"', "über", "日本"]) for _ in range(n))

    made = []
    for k in range(120):
        body = [prose(draw.randint(1, 120)) for _ in range(draw.randint(1, 12))]
        spelt = "".join(f"<p>{html.escape(x)}" + draw.choice(["</p>", "", "<br>"]) for x in body)
        title = prose(4)
        made.append(
            (
                f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title><script>var t='</p>';</script></head><body>"
                f"<nav><ul>{''.join(f'<li><a href=/{j}>{prose(1)}</a></li>' for j in range(draw.randint(1, 9)))}</ul></nav>"
                f'<!-- ad --><div class="ad">{html.escape(prose(draw.randint(1, 90)))}</div>'
                f"<article><h1>{html.escape(title)}</h1>{spelt}</article>"
                f"<footer>&copy; {html.escape(prose(draw.randint(1, 60)))}</footer>" + draw.choice(["</body></html>", ""]),
                " ".join([title, *body]),
            )
        )
    return made


def test_whole_pages(spark, pages):
    odd = [(None, ""), ("", ""), ("<p></p>", ""), ("<nav>a", ""), ("<article>" + "long text " * 200_000, ("long text " * 200_000).strip())]
    rows = [(k, f"u{k}", page, "clash", 1) for k, (page, _) in enumerate(pages + odd)]
    found = html_text.main_text(spark.createDataFrame(rows + rows[:1], SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows) + 1 and found[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    for r in found:
        expected = (pages + odd)[r.page_id][1]
        assert r.text == expected and r.n_chars == len(expected) and r.url == f"u{r.page_id}"


def test_an_article_read_by_pattern(spark, pages):
    """The same texts by a plain reading of the article element."""
    rows = [(k, "u", page, "clash", 1) for k, (page, _) in enumerate(pages)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (page, _) in enumerate(pages):
        inner = re.sub(r"<[^>]*>", " ", re.search("<article>(.*)</article>", page, re.S)[1])
        assert found[k] == " ".join(html.unescape(inner).split())


def test_empty_table(spark):
    assert html_text.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
