import html
import itertools
import re
import time

import numpy as np
import pytest

from dawnchorus.llm import dom_marginals as dom
from dawnchorus.llm.labelled_pages import labelled_pages
from dawnchorus.llm.queries import QUERIES
from tests.llm.helpers import SF


@pytest.fixture(scope="module")
def model():
    return dom.train(labelled_pages())


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>First paragraph of the story.</p><p>Second one, with "
     "<a href=x>a link</a> inside.</p><div class='comments'><p>I liked this a lot, thank you!</p><p>Me too.</p></div></article>"
     "<footer>c 2020</footer></body></html>", "Title here\nFirst paragraph of the story.\nSecond one, with a link inside."),
    ("<body><div class='cookie-notice'>We use cookies to improve your experience.</div><header><h1>Site name</h1></header><main>"
     "<h2>A heading</h2><p>Body text of the page.</p><ul><li>one</li><li>two</li></ul></main><aside><p>Read also this.</p></aside>"
     "<section id='comments'><h3>Comments</h3><div class='comment'><p>First!</p></div></section></body>",
     "A heading\nBody text of the page.\none\ntwo"),
    ("<html><body><div id='content'><p>Alpha beta gamma.</p><div class='ad'>Buy now the best things.</div><p>Delta.</p></div></body></html>",
     "Alpha beta gamma.\nDelta."),
    ("<main><p>A &lt;b&gt; &amp; c&nbsp;d &copy</p></main>", "A <b> & c d ©"),
    ("<html><head><title>t</title><style>p{}</style><script>var a='</p><p>';</script></head><body><article><p><b>Open.<br><p>Next\n  one"
     "</article><form><p>Sign up for more</p><button>Go</button></form></body>", "Open.\nNext one"),
    ("plain text only here.", "plain text only here."), ("", ""), (None, ""), ("<p></p><!-- x", ""),
    ("<body>" + "<div>" * 3000 + "deep text" + "</div>" * 3000, "deep text"),
    ("<article><p>" + "long words " * 60000 + "</p></article>", ("long words " * 60000).strip()),
]


def test_pages(spark, model):
    rows = [(i, f"u{i}", p[0], "x") for i, p in enumerate(PAGES)] + [(0, None, PAGES[0][0], "x"), (None, "u", None, "x")]
    got = dom.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == ("" if r.page_id is None else PAGES[r.page_id][1]) and r.n_chars == len(r.text)
    assert dom.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


HEAD = "<div class='header'>Site of many things</div>"
ARTICLE = ("<h1>The title of it</h1><p>First paragraph of the story is here, and long enough.</p><p>Second one, a bit longer than the "
           "first one was, with words.</p><p>Third and last, it ends.</p>")
FOOT = "<div class='footer'>Copyright 2020 all rights reserved</div>"
LAYOUTS = {
    "flat": f"<body>{HEAD}{ARTICLE}{FOOT}</body>", "one wrapper": f"<body><div>{HEAD}{ARTICLE}{FOOT}</div></body>",
    "wrapper and menu": f"<body><div class='wrapper'>{HEAD}<nav><a href=/>Home</a></nav>{ARTICLE}{FOOT}</div></body>",
    "table": f"<body><table><tr><td><a href='/'>Home</a></td><td>{ARTICLE}</td></tr></table></body>",
    "compound name": f"<article>{ARTICLE}<section class='usercomments'><p>I liked it.</p><p>Me too, well.</p></section></article>",
    "teaser": f"<body><article>{ARTICLE}<div class='teaser'>Read on the next story of ours</div></article></body>",
    "unknown names": f"<body><div class='xyz'>{ARTICLE}</div><div class='foo'><a>Home</a> <a>About</a></div></body>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(model, layout):
    assert dom.main_text(LAYOUTS[layout], model) == "\n".join(re.findall(r"<(?:h1|p)>(.*?)</", ARTICLE))


@pytest.mark.parametrize("source, texts", [
    ("<p>a</p><canvas><p>b</p><p>c</p>", ["a", "b", "c"]), ("<p>a<object><b>x</b></object>b<audio>c", ["a", "bc"]),
    ("<p>f <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> g", ["f x=2 g"]),
    ("<p>a<svg><title>t</title><g><svg><text>in</text></svg>no</g></svg>b</p>c", ["ab", "c"]),
    ("<p title=\"a>b\">c<p title='d>e", ["c", "e"]), ("a < b <3 c", ["a < b <3 c"]), ("x<a href='", ["x<a href='"]),
    ("<script>if (a<b) '</p>'</script>y<textarea>z", ["y", "z"]),
    ("<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b<ul><li>c</ul><li>d</ul>", list("123abcd")),
])
def test_markup(source, texts):
    assert [t for t in dom.parse(source).text if t] == texts


@pytest.mark.parametrize("unit, rest", [("<a ", ""), ('<a x=">"', "'"), ("<!", ""), ("<canvas>", ""), ("<textarea>", ""), ("<!--", ""),
                                        ("<li></li>", ""), ("<p class", " " * 100_000)])
def test_hostile_markup_takes_time_in_proportion(unit, rest):
    """A megabyte; quadratic time would be hours."""
    nested = "<li><ul>" + "<div>" * 50_000 if unit == "<li></li>" else ""
    began = time.monotonic()
    dom.contract(dom.parse(nested + unit * (1_000_000 // len(unit)) + rest))
    dom.contract(dom.parse("".join(f"<div class=k{i}>" for i in range(50_000)) + "x"))
    assert time.monotonic() - began < 30


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op10_dom_marginals"](spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?p>|</?h1>|<br>", article))
        assert r.text == "\n".join(b for b in blocks if b)


def test_marginals_are_exact(model):
    """Message passing against the sum over all assignments of states."""
    source = "<body><nav><a>x</a></nav><div class='content'><p>Some text.</p><p>More.</p></div><p class='ad'>Buy</p></body>"
    page = dom.parse(source)
    tree = dom.contract(page)
    n = len(tree.node)
    potentials = [model.potential(dom._look(page, tree, i)) for i in range(n)]
    want = np.zeros((n, dom.STATES))
    for states in itertools.product(range(dom.STATES), repeat=n):
        p = np.exp(model.first[states[0]])
        for i, s in enumerate(states):
            p *= potentials[i][s] * (np.exp(model.between[states[tree.parent[i]], s]) if i else 1)
        for i, s in enumerate(states):
            want[i, s] += p
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(dom.content_marginals(page, tree, model), want)


def test_held_out_accuracy(model):
    wrong = total = 0
    for source in labelled_pages(150, seed=99):
        page = dom.parse(source)
        label = page.label[:]
        for i in range(1, len(label)):
            label[i] = label[i] or label[page.parent[i]]
        tree = dom.contract(page)
        for node, p in zip(tree.node, dom.content_marginals(page, tree, model), strict=True):
            if page.text[node] is not None:
                total += 1
                wrong += (p[dom.ALL] >= 0.5) != (label[node] == "main")
    assert wrong / total < 0.05
