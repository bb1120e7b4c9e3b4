import html
import math
import random
import re
import time

import pytest

from pointloom.llm import html_text
from pointloom.llm.html_text import extract_text, main_text

PARA = "The committee met on Tuesday to weigh the plans, and after a long debate it agreed to most of them. "


def page(article, before="", after=""):
    return f"""<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="top"><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>{before}{article}{after}
<footer>&copy; Owner</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["article", "main", 'div class="story"', 'section id="content"'])
def test_article_without_the_rest(wrap):
    body = f"<{wrap}><h1>Title &amp; more</h1><p>{PARA * 3}</p><p>Short.</p><p>a\n  <b>b</b>&nbsp;c &lt;d&gt;</p></{wrap.split()[0]}>"
    extra = """<div class="cookie-notice">We use cookies to make this site better for you and for all of our many partners.</div>
<aside><p>Read this too: many other stories of interest.</p></aside><div id="comments"><p>First! I think that the committee was wrong about all this, and so on and so forth.</p></div>
<form><p>Subscribe to our letter with many words that go on for a long time</p><input></form><div class="ad">Buy now</div>"""
    want = "\n".join(["Title & more", (PARA * 3).strip(), "Short.", "a b c <d>"])
    assert main_text(page(body, after=extra)) == want
    assert main_text(page(body, before=extra)) == want


def test_misnested_and_cut_off():
    assert main_text("<body><article><p><b>one<br><p>two</p></article></body>") == "one\ntwo"
    assert main_text("<p>a<p>b<ul><li>c<li>d</ul>e <i") == "a\nb\nc\nd\ne"
    assert main_text("<p>1 < 2 and 3 > 2</p><!-- no <p>no</p> --><p>x</p><script>for(;;)</script") == "1 < 2 and 3 > 2\nx"
    assert main_text("plain &eacute; text") == "plain é text"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_split_over_boxes():
    boxes = "".join(f"<div><p>{PARA * 2}{i}</p></div>" for i in range(3))
    assert main_text(page(boxes)) == "\n".join(f"{PARA * 2}{i}" for i in range(3))


def test_link_list_inside_goes():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Another story number {i}</a></li>" for i in range(6)) + "</ul>"
    assert main_text(page(f"<article><p>{PARA * 3}</p>{links}<p>End.</p></article>")) == (PARA * 3).strip() + "\nEnd."


def test_class_alone_does_not_condemn_the_article():
    body = f'<div class="site has-sidebar"><div id="post-share"><h1>Title</h1><p>{PARA * 3}</p><div class="related">More of this</div></div></div>'
    assert main_text(page(body)) == "Title\n" + (PARA * 3).strip()
    talk = '<div id="comments">' + f'<article class="comment"><p>{PARA * 9}</p></article>' * 3 + "</div>"
    assert main_text(page(f"<article><h1>Title</h1><p>{PARA}</p></article>", after=talk)) == "Title\n" + PARA.strip()


@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_headline_beside_the_body_box(wrap):
    body = "".join(f"<p>{PARA * 3}{i}</p>" for i in range(5))
    got = main_text(page(f"<{wrap}><h1>Title</h1><div class=body>{body}</div></{wrap}>"))
    assert got == "\n".join(["Title", *(f"{PARA * 3}{i}" for i in range(5))])


@pytest.mark.parametrize("wrap", ["article", "main"])
def test_short_section_beside_the_body_box(wrap):
    body = "".join(f"<p>{PARA * 3}{i}</p>" for i in range(5))
    got = main_text(page(f"<{wrap}><section>{body}</section><section><p>They meet again in the spring.</p></section></{wrap}>"))
    assert got == "\n".join([*(f"{PARA * 3}{i}" for i in range(5)), "They meet again in the spring."])


@pytest.mark.parametrize("wrap", ["article", "main"])
def test_anchors_and_class_words_inside_the_article(wrap):
    long = (PARA * 3).strip()
    body = f"""<h1>Title</h1><p>{long}</p><h2 id="related-work">Related work</h2><p>{long}</p><h2 id="legal-framework" class="social">Law</h2>
<section id="discussion"><h3>Discussion</h3><p>Brief.</p><p>{long}</p></section><div class="social-impact"><p>{long}</p></div>"""
    junk = """<div class="ad">Buy now</div><div class="related"><a href=/a>A story of some length, with a headline that goes on and on and on and on</a></div>
<div class="comments"><div class="comment"><p>I think so</p></div><div class="comment"><p>""" + PARA * 5 + "</p></div></div>"
    want = ["Title", long, "Related work", long, "Law", "Discussion", "Brief.", long, long]
    assert main_text(page(f"<{wrap}>{body}{junk}</{wrap}>")) == "\n".join(want)


def test_linked_names_and_references_stay():
    names = ", ".join(f"<a href=/{i}>Member of the board {i}</a>" for i in range(4))
    table = "<table><tr>" + "".join(f"<td><a href=/{i}>Cell {i}</a>" for i in range(4)) + "</table>"
    refs = "<ol>" + "".join(f"<li><a href=/{i}>A study of the plans of the committee, volume {i}</a>, Smith, 2001</li>" for i in range(4)) + "</ol>"
    got = main_text(page(f"<article><p>{PARA * 3}</p><p>{names}</p>{table}{refs}</article>"))
    want = [(PARA * 3).strip(), ", ".join(f"Member of the board {i}" for i in range(4)), *(f"Cell {i}" for i in range(4))]
    assert got == "\n".join([*want, *(f"A study of the plans of the committee, volume {i}, Smith, 2001" for i in range(4))])


@pytest.mark.parametrize("wrap", ["article", "main"])
@pytest.mark.parametrize(
    ("inside", "want"),
    [
        (f'<div class="notice"><p>{PARA * 2}</p></div>', [PARA * 2]),
        (f'<section class="discussion"><h2>Talk</h2><p>Brief.</p><p>{PARA}</p></section>', ["Talk", "Brief.", PARA]),
        (f'<div class="legal-analysis"><p>{PARA}</p><p>Brief.</p></div>', [PARA, "Brief."]),
        ('<div class="alert-level">Level 3</div>', ["Level 3"]),
        ('<p class="lead promotion">In short.</p>', ["In short."]),
        ('<table class="social"><tr><td>a<td>b</table>', ["a", "b"]),
        ("<p>So <math><mi>x</mi> = 1</math> here</p>", ["So x = 1 here"]),
        ("<object><p>Held</p></object>", ["Held"]),
        ("<p><a href=1>One</a>, <a href=2>two</a> and <a href=3>three</a></p>", ["One, two and three"]),
        ("<div><a href=1>One</a> <a href=2>two</a> <a href=3>three</a></div>", ["One two three"]),
        ('<div class="social-links"><a href=1>Follow us on this and that and many other places</a></div>', []),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>", []),
    ],
)
def test_density_decides_inside(wrap, inside, want):
    body = f"<{wrap}><h1>Title</h1><p>{PARA * 3}</p>{inside}<p>{PARA * 2}</p></{wrap}>"
    assert main_text(page(body)) == "\n".join(["Title", (PARA * 3).strip(), *(x.strip() for x in want), (PARA * 2).strip()])


def test_title_and_lead_in_a_box_of_their_own():
    body = f"<div><h1>Title</h1><p>Short lead.</p></div><div>{''.join(f'<p>{PARA * 3}{i}</p>' for i in range(5))}</div>"
    assert main_text(page(body)) == "\n".join(["Title", "Short lead.", *(f"{PARA * 3}{i}" for i in range(5))])


def test_names_alone_do_not_hide_the_only_text():
    assert main_text(f'<body><div class="legal"><p>{PARA * 3}</p></div><div>x</div></body>') == (PARA * 3).strip()
    talk = '<div class="comments">' + f'<div class="comment"><p>{PARA}</p></div>' * 20 + "</div>"
    assert main_text(f'<body><div class="text"><p>{PARA * 3}</p><p>{PARA * 2}</p></div>{talk}</body>') == (PARA * 3).strip() + "\n" + (PARA * 2).strip()


def grow(rng, depth=0):
    """A random tree as (tag, text before the children, children)."""
    tag = rng.choice(["div", "div", "span", "a", "b", "section"])
    few = 0 if depth > 4 or tag == "a" else rng.randint(0, 4)
    return tag, "w" * rng.choice([0, 0, 3, 40, 200]), [grow(rng, depth + 1) for _ in range(few)]


def written(tree):
    tag, text, children = tree
    return f"<{tag}>{text}{''.join(map(written, children))}</{tag}>"


def totals(tree, linked=False):
    """(characters, tags, characters in links, link tags) of a tree, by recursion."""
    tag, text, children = tree
    linked = linked or tag == "a"
    parts = [(totals(c, linked), c[0] == "a") for c in children]
    return len(text) + sum(t[0] for t, _ in parts), sum(t[1] + 1 for t, _ in parts), linked * len(text) + sum(t[2] for t, _ in parts), sum(t[3] + a for t, a in parts)


def test_densities_and_the_largest_sum_against_the_formula():
    """Density: C / T log_B(C / LC * T / LT), B = ln(C / notLC * LC + LC_body / C_body * C + e); the subtree of the largest sum of children's densities."""
    rng = random.Random(5)
    for _ in range(200):
        tree = ("body", "", [grow(rng) for _ in range(3)])
        c_body, _, lc_body, _ = totals(tree)
        if not c_body:
            continue

        def formula(t, linked):
            c, n, lc, ln = totals(t, linked)
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * max(lc, 1) + lc_body / c_body * c + math.e)  # noqa: B023
            return c / max(n, 1) * max(math.log(max(c / max(lc, 1) * max(n, 1) / max(ln, 1), 1), base), 0)

        def walk(t, linked=False):
            linked = linked or t[0] == "a"
            yield formula(t, linked), sum(formula(x, linked or x[0] == "a") for x in t[2])
            for x in t[2]:
                yield from walk(x, linked)

        root, nodes, flow = html_text._parse(f"<body>{''.join(map(written, tree[2]))}</body>")
        html_text._measure(nodes, flow)
        html_text._densities(nodes, nodes[1])
        want = list(walk(tree))
        assert [x.density for x in nodes[1:]] == pytest.approx([d for d, _ in want], rel=1e-9)
        got = html_text._densest(nodes, nodes[1])
        assert sum(x.density for x in got.children) == pytest.approx(max(s for _, s in want), rel=1e-9)
        assert sum(x.density for x in got.children) == pytest.approx(want[nodes.index(got) - 1][1], rel=1e-9)


def test_the_threshold_is_the_least_density_on_the_path():
    close = "".join(f"<div><p>{PARA * 2}{i}</p><p>{PARA * 2}</p></div>" for i in range(3))
    root, nodes, flow = html_text._parse(f"<body><div>{close}<div><i>short</i><i>run</i></div></div></body>")
    html_text._measure(nodes, flow)
    body = nodes[1]
    html_text._densities(nodes, body)
    best = html_text._densest(nodes, body)
    top, threshold = html_text._grown(best, body)
    path, x = [], best
    while x is not root:
        path.append(x.density)
        x = x.parent
    assert threshold == min(path) and top is nodes[2]


@pytest.mark.parametrize("start", ["<span>", "<div>", "<p>", "<b>", "<header>", "<ul><li>", "<li>", "<table><tr><td>", "<a>", "<article>", '<div class="ad">', "<section class=comments>"])
@pytest.mark.parametrize("then", ["<li>", "</i><p>"])
def test_nested_tags_take_linear_time(start, then):
    def seconds(n):
        text = start * n + then * n + "text"
        at = time.process_time()
        main_text(text)
        return time.process_time() - at

    small, large = min(seconds(1_000) for _ in range(2)), seconds(16_000)
    assert large < 60 * max(small, 0.02)  # 256 times, were it quadratic


def test_a_hundred_thousand_nested_tags():
    at = time.process_time()
    main_text("<span>" * 100_000 + "<li>" * 100_000 + "text")
    assert time.process_time() - at < 30


def test_deep_nesting():
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_tables_articles(spark, sf_dir):
    for r in extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.sub("<br>", " ", re.search("<article>(.*?)</article>", r["html"], re.S)[1])
        blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1)>", "\0", article)).split("\0")
        assert r["text"] == "\n".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))
        assert r["n_chars"] == len(r["text"])


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (None, "u", "<p>x"), (3, "u", "<p>" + PARA * 20000 + "</p>"), (4, "u", "<" * 5000), (5, "u", "&amp" * 100 + "\0")]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars"))
    got = sorted(((r["page_id"], r["n_chars"]) for r in out.collect()), key=str)
    assert len(got) == 7 and (1, 0) in got and (2, 0) in got and got.count((None, 1)) == 2
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
