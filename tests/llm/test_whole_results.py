"""Queries and operators held against results by hand: pages of the table, repeated ids, contradictory labels."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest
from panelworks.llm import html_text, toxicity, vector_dedup
from panelworks.llm.queries import QUERIES


def by_hand(page: str) -> str:
    """The blocks of a page's only article, where it holds h1, p, b and br alone."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    assert set(re.findall(r"</?([a-z0-9]+)", body)) <= {"h1", "p", "b", "br", "i", "em", "a", "ul", "li"}, body[:200]
    blocks = re.split(r"</?(?:h1|p|ul|li)>", body.replace("<br>", " "))
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(line for line in lines if line)


def test_every_page_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r["page_id"]: (r["url"], by_hand(r["html"])) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in QUERIES["op9_html_text"](spark, sf_dir).collect()}
    assert got == pages and len(pages) == 250
    bare = [re.sub(r"</?article>", "", r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    same = sum(html_text.main_text(p) == t for p, (_, t) in zip(bare, (pages[k] for k in pages)))
    assert same == len(bare)  # the windows alone find where the text begins and ends


TEXT = "".join(f"<p>{'A sentence that is long enough to be text. ' * 3}</p>" for _ in range(6))


@pytest.mark.parametrize(
    "before, after",
    [("<div class='layout has-sidebar'>", "</div>"), ("<div class='page sidebar-left'>", "</div>"), ("<div id='with-nav'>", "</div>"), ("<div class=cookie-banner>", "</div>"), ("<section id=main-comments>", "</section>")],
)
def test_no_name_condemns_the_container_of_a_page(before, after):
    assert html_text.main_text(f"<body>{before}{TEXT}{after}<div class=ad>Buy it</div></body>").count("\n") == 5


def test_names_inside_an_article():
    links = "".join(f"<li><a href=/{i}>Link {i} to somewhere</a></li>" for i in range(3))
    page = f"""<article><div class="article-header"><h1>The title</h1></div>{TEXT}<section class="related-work"><p>Others did this before.</p></section>
<div class="share-price"><p>The share fell.</p></div><div class="share-links"><ul>{links}</ul></div><div class="related-stories"><ul>{links}</ul></div>
<div class="social-bar">Follow us</div><div class="sidebar-box"><p>{"Elsewhere. " * 9}</p></div><p>The end.</p></article>"""
    text = html_text.main_text(page).split("\n")
    assert text[0] == "The title" and text[-3:] == ["Others did this before.", "The share fell.", "The end."] and len(text) == 10


def test_an_opening_of_light_lines_is_kept():
    page = f"<body><div><a href=/>Home</a></div><h2>A heading</h2><p>By her.</p><p>Today.</p><p>Soon.</p>{TEXT}</body>"
    assert html_text.main_text(page).split("\n")[:4] == ["A heading", "By her.", "Today.", "Soon."]
    assert html_text.main_text(page.replace("h2", "p")).count("\n") == 7  # from the first window of three that surges
    adverts = "<div class=ad>Buy</div>" * 5
    assert html_text.main_text(f"<article>{TEXT}{adverts}<p>The end.</p></article>").endswith("\nThe end.")


def test_repeated_vec_ids_count_once(spark):
    e, f = [1.0, 0.0, 0.0, 0.0] * 4, [0.0, 1.0, 0.0, 0.0] * 4
    rows = [(1, e), (5, e), (5, f), (7, f), (9, f), (9, f), (2, None), (2, [1.0, 1.0, 1.0, 1.0] * 4), (None, e)]
    keys = {r["vec_id"]: r["key"] for r in vector_dedup.prepared(spark.createDataFrame([(1, e), (7, f)], "vec_id long, embedding array<double>")).collect()}
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    with_e = keys[1] < keys[7]
    assert got[2] == (0, 2, True) and len(got) == 5
    if with_e:
        assert got == {1: (1, 1, True), 5: (1, 1, False), 7: (1, 7, True), 9: (1, 7, False), 2: (0, 2, True)}
    else:
        assert got == {1: (0, 1, True), 5: (2, 5, True), 7: (2, 5, False), 9: (2, 5, False), 2: (0, 2, True)}


def test_of_several_labels_the_greatest_counts(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["vile", "nasty"] if i % 3 == 0 else ["calm", "plain"], 8)), "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = [(i, int(i % 3 == 0)) for i in range(600)]
    twice = spark.createDataFrame([*labels, *((i, 0) for i in range(0, 600, 3)), *((i, None) for i in range(600))], "doc_id long, toxic int")
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in toxicity.toxicity(docs, x).collect()} for x in (spark.createDataFrame(labels, "doc_id long, toxic int"), twice))
    assert a == b and min(a[i] for i in range(0, 600, 3)) > max(a[i] for i in range(1, 600, 3))
