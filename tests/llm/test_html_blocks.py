import numpy as np
import pytest

from toposcan.llm import html_blocks as H

SENTENCES = "The ferry left late because of the fog. Some passengers had waited since noon and were tired of it."


@pytest.fixture(scope="module")
def tree():
    return H.fit_tree(*H.labelled())


def test_tree_learns_the_examples(tree):
    x, y = H.labelled()
    assert (H.apply_tree(tree, x) == y).all() and 0 < y.mean() < 1
    one = H.fit_tree(np.array([[0.0], [1.0], [1.0]]), np.array([False, True, True]))
    assert H.apply_tree(one, np.array([[0.2], [0.9]])).tolist() == [False, True]


CASES = {
    "all": (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body class='has-sidebar'><header><p>{SENTENCES}</p></header><nav><a href=x>Menu</a></nav><!-- {SENTENCES} -->"
        f"<div class='ad'>{SENTENCES}</div><article><h1>On  the\n river</h1><p>One &amp; two&#33; <b>bo</b>ld.<br>Next<p>{SENTENCES}<p>Short</p><form><label>Mail</label><button>Send</button></form></article>"
        f"<aside>{SENTENCES}</aside><div id='cookie-notice'>{SENTENCES}</div><section class='comments'><article class='comment'><p>{SENTENCES}</p></article></section><footer>{SENTENCES}</footer></body></html>",
        f"On the river One & two! bold. Next {SENTENCES} Short"),
    "comments inside": (f"<article><p>{SENTENCES}</p><div class='post-comments'><p>{SENTENCES}</p></div><div class=sponsored-box>{SENTENCES}</div><p>End</p></article>", f"{SENTENCES} End"),
    "no article": (f"<body><div class=nav><a href=1>A</a></div><div>{SENTENCES}</div><div>{SENTENCES} {SENTENCES}</div><div class=sidebar>{SENTENCES}</div></body>", f"{SENTENCES} {SENTENCES} {SENTENCES}"),
    "unclosed": (f"<article><p>{SENTENCES}<p><b>Last <i>one <!-- open", f"{SENTENCES} Last one"),
    "bare brackets": (f"<article><p>a < b and c &lt; d. {SENTENCES}</p></article>", f"a < b and c < d. {SENTENCES}"),
    "quotes in tags": (f"<article data-x=\"a > b\"><p title='</p>'>{SENTENCES}</p></article>", SENTENCES),
    "menu of links": ("<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></body>", ""),
    "empty": ("", ""),
    "no markup": ("<<>>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(tree, name):
    page, want = CASES[name]
    assert H.main_text(page, tree) == want


def test_table(spark):
    long = "<article>" + f"<p>{SENTENCES}</p>" * 20_000 + "</article>"
    rows = [(1, "u", CASES["all"][0], "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", long, "x"), (1, "u", CASES["all"][0], "x"), (4, "q", "\"'<" * 20_000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(frame).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    texts = {(r.page_id, r.url): r.text for r in out}
    assert texts[1, "u"] == CASES["all"][1] and texts[2, None] == "" and texts[None, "v"] == "" and texts[3, "w"].count("ferry") == 20_000
    assert H.extract(frame.limit(0)).count() == 0


WRAPPED = f"<header><p>{SENTENCES}</p></header><article><h1>Fog</h1><p>{SENTENCES}</p><div class=ad>{SENTENCES}</div><section class=comments><article><p>{SENTENCES}</p></article></section><p>End</p></article><aside><article><p>{SENTENCES}</p></article></aside>"
LIFTED = {
    "closed svg": (f"<body><header><svg class='i'/><a href=1>Home</a></header><article><p>{SENTENCES}</p><svg><title>no</title></svg><p>{SENTENCES}</p></article></body>", f"{SENTENCES} {SENTENCES}"),
    "math": (f"<article><p>{SENTENCES} So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding=tex>x=2</annotation></semantics></math> holds.</p><p><math/>{SENTENCES}</p></article>", f"{SENTENCES} So x=2 holds. {SENTENCES}"),
    "wrapper": (f"<body><div id=page class='site has-sidebar'>{WRAPPED}</div></body>", f"Fog {SENTENCES} End"),
    "form": (f"<body><form id=aspnetForm>{WRAPPED}</form></body>", f"Fog {SENTENCES} End"),
    "main in a small wrapper": (f"<body><p>{SENTENCES}</p><p>{SENTENCES}</p><div class=no-sidebar><main><p>{SENTENCES}</p></main></div></body>", SENTENCES),
    "content in a named wrapper": (f"<body><div class='layout has-sidebar'><div class='content'><h1>Fog</h1><p>{SENTENCES}</p><p>{SENTENCES}</p></div></div></body>", f"Fog {SENTENCES} {SENTENCES}"),
    "content beside a menu": (f"<body><div id=page class='with-menu'><div id=menu><a href=1>Start</a></div><div id=content><p>{SENTENCES}</p><p>{SENTENCES}</p></div></div></body>", f"{SENTENCES} {SENTENCES}"),
    "content in a menu wrapper": (f"<body><div class='menu'><div class=nav><a href=1>Start</a></div><div id=content><p>{SENTENCES}</p><p>{SENTENCES}</p></div></div></body>", f"{SENTENCES} {SENTENCES}"),
    "content in a form": (f"<body><form id=aspnetForm><div class=content><h1>Fog</h1><p>{SENTENCES}</p><p>{SENTENCES}</p></div></form></body>", f"Fog {SENTENCES} {SENTENCES}"),
    "form without content element": (f"<body><form id=f><h1>Fog</h1><p>{SENTENCES}</p><p>{SENTENCES}</p><div class=footer>{SENTENCES}</div></form></body>", f"Fog {SENTENCES} {SENTENCES}"),
    "named span": (f"<article><p>{SENTENCES} A <span class='tags'>tagged</span> word, more text here.</p></article>", f"{SENTENCES} A tagged word, more text here."),
    "named paragraph": (f"<article><p>{SENTENCES}</p><p class='legal'>{SENTENCES}</p><p class=ad>{SENTENCES}</p></article>", f"{SENTENCES} {SENTENCES}"),
    "named section": (f"<article><p>{SENTENCES}</p><section id='discussion'><h2>Discussion</h2><p>{SENTENCES}</p></section></article>", f"{SENTENCES} Discussion {SENTENCES}"),
    "only a notice": (f"<body><div class=cookie-notice><h2>We use cookies</h2><p>{SENTENCES}</p></div></body>", ""),
    "a form to fill in": (f"<body><div><p>{SENTENCES}</p><p>{SENTENCES}</p></div><form><h3>Write to us</h3><p>{SENTENCES}</p></form></body>", f"{SENTENCES} {SENTENCES}"),
    "teasers": (f"<body><article><p>{SENTENCES}</p></article><div class=related><article><p>{SENTENCES}</p></article><article><p>{SENTENCES}</p></article></div></body>", SENTENCES),
}


@pytest.mark.parametrize("name", LIFTED)
def test_main_text_inside_wrappers(tree, name):
    page, want = LIFTED[name]
    assert H.main_text(page, tree) == want
