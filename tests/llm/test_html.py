"""The weights decide: pages whose names are in no list, pages without labels' tags, and odd markup."""

import html as htmllib
import re
import time

import pytest

from cinnabar.llm import html


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html like '%<article>%'").select("html").collect()]


def article(page):
    """The article's blocks, read by plain rules of the tables' pages."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"\s+", " ", htmllib.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br|li|ul)[^>]*>", inner)]
    return "\n".join(b for b in blocks if b)


def renamed(page):
    """No name of the lists is left outside the article."""
    return page.replace("<nav>", "<zul>").replace("</nav>", "</zul>").replace('class="ad"', 'class="qq"').replace("<footer>", "<end>").replace("</footer>", "</end>")


def test_articles_of_pages(pages):
    weights = html.learned(pages[::2])
    for page in pages:
        want = article(page)
        assert html.main_text(page, weights) == want
        for tag in ("div", 'div class="x1"', "section", "td"):
            assert html.main_text(page.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>"), weights) == want


def test_names_are_learned(pages):
    weights = html.learned([renamed(p) for p in pages[::2]])
    for page in pages:
        assert html.main_text(renamed(page), weights) == article(page)
        assert html.main_text(renamed(page).replace("<article>", "<div>").replace("</article>", "</div>"), weights) == article(page)


def test_labels_outweigh_priors():
    labelled = ["<body><div class=out>x y</div><article><div class=notice>a b</div><p class='related-work'>c d</p></article></body>"] * 12
    page = labelled[0]
    assert html.main_text(page, html.learned(labelled)) == "a b\nc d"
    assert html.main_text(page, html.learned([])) == "x y\nc d"


def test_lists_and_links_stay_inside(pages):
    page = "<body><nav><ul><li><a>m n</a></li></ul></nav><div><h1>t</h1><ul><li>one <a>two</a> three</li><li>four</li></ul><header>own</header></div><footer>f</footer></body>"
    assert html.main_text(page.replace("<header>own</header>", ""), html.learned(pages)) == "t\none two three\nfour"
    inner = page.replace("<div>", "<article>").replace("</div>", "</article>")
    assert html.main_text(inner, html.learned(pages)) == "t\none two three\nfour\nown"


@pytest.mark.parametrize("odd", ["<!", "<!--", "<a '", '<a "', "<a", "</a>", "<nav>", "&#"])
def test_odd_markup_takes_linear_time(odd):
    weights, start = html.learned([]), time.time()
    html.main_text(odd * 200_000, weights)
    assert time.time() - start < 20


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html.extract(empty).columns == ["page_id", "url", "text", "n_chars"] and html.extract(empty).count() == 0
