"""Names of elements that only look like those of comments or adverts don't cost articles; paths and votes aren't cut."""

import random
import re

import pytest
from reportloom.llm import html

TEXT = "<h1>Head</h1><p>%s</p><p>%s</p>" % ("first " * 30, "second " * 25)
WANT = "\n\n".join(["Head", ("first " * 30).strip(), ("second " * 25).strip()])


@pytest.mark.parametrize("names", ["post type-post comment-status-open", "story social-issues", "entry has-related", "article-body with-comments", "post", "social-issues", "x1 related-y"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_article_stays(names, tag):
    page = f'<html><body><nav><a href="/">Home</a></nav><{tag} class="{names}">{TEXT}</{tag}><div class="box"><p>else</p></div><div id="comments"><p>{"reader " * 300}</p></div></body></html>'
    page = page.replace('<div class="box"><p>else</p></div>', '<div class="share-buttons">else</div>')
    if tag == "div" and names in ("social-issues", "x1 related-y"):
        page = page.replace("reader " * 300, "reader")
    assert html.extracted(page) == WANT


@pytest.mark.parametrize("names", ["comment", "comments", "comment-body", "share-buttons", "newsletter-signup", "ad-slot", "related-posts", "cookie-notice"])
def test_certain_names_go(names):
    assert html.extracted(f'<body><article class="post">{TEXT}<div class="{names}"><p>{"gone " * 200}</p></div></article></body>') == WANT


def test_article_elements_of_comments_go():
    said = "".join(f'<article class="comment">said {k} {"blah " * 80}</article>' for k in range(3))
    assert html.extracted(f'<body><article class="post">{TEXT}</article>{said}</body>') == WANT


def test_doubtful_element_stays_on_the_winning_path(spark):
    page = '<body><div class="promo-%s"><p>%s</p></div><div class="other"><p>%s</p></div></body>'
    rows = [(k, f"https://h.example.org/{k}", page % ("area9x", "main " * 50, "rest")) for k in range(9)] + [(50, "https://h.example.org/50", page % ("area9x", "short one", "rest " * 40))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[50] == "short one" and all(got[k] == ("main " * 50).strip() for k in range(9))


def test_deep_paths_differ():
    wrap = [f'<div class="{"wrapper-with-a-very-long-name-of-its-own " * 2}{chr(97 + k)}">' for k in range(15)]
    page = "".join(wrap) + '<div class="left"><p>%s</p></div><div class="right"><p>%s</p></div>' % ("a " * 50, "b " * 40) + "</div>" * 15
    assert len(html.votes_of(page)) == 17  # each container is voted for, on a path of its own


def test_nesting_beyond_the_limit():
    page = "<div>" * 900 + "<p>deep</p>" + "</div>" * 900 + "<p>after</p>"
    assert [t for t, _, _ in html.blocks(page)[0]] == ["deep", "after"]


def test_long_page():
    page = f"<article>{''.join(f'<p>para {k}</p>' for k in range(60_000))}</article>"
    assert html.extracted(page).count("\n\n") == 59_999


def brute_paths(pages):
    """Votes by host, summed in plain Python."""
    sums = {}
    for _, url, source in pages:
        m = re.match(r"[a-z]+://([^/]+)", url or "")
        for path, share in html.votes_of(source or ""):
            key = (m[1] if m else None, path)
            sums[key] = sums.get(key, 0) + round(share, 6)
    out = {}
    for (host, path), n in sums.items():
        out.setdefault(host, []).append((-round(n, 6), path))
    return {host: [p for _, p in sorted(x)[: html.PATHS]] for host, x in out.items()}


def test_voting_equals_brute_force(spark):
    random.seed(8)
    rows = []
    for k in range(120):
        parts = "".join(f'<{t} class="c{random.choice("abc")}"><p>{"w " * random.randint(1, 60)}</p></{t}>' for t in random.choices(["div", "section", "article"], k=4))
        rows.append((k, random.choice(["https://a.example.org/", "http://b.example.org/x", None]), f"<body>{parts}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    # Spark's regexp_extract gives null for a null address.
    got = {r["host"]: [bytes(p) for p in r["paths"]] for r in html.host_paths(df).collect()}
    assert got == brute_paths(rows)


def test_clashing_columns_and_repeats(spark):
    rows = [(1, "https://h.example.org/1", f"<article>{TEXT}</article>", 1, "p", "h", 3)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string, salt int, paths string, host string, h int")
    assert [r.text for r in html.extract(df).collect()] == [WANT] * 3
