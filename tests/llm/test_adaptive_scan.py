"""The adaptive scan abandons candidates at small sizes, too, and pages keep their text whatever their markup's quirks."""

import numpy as np
import pytest

from meshlens.llm import dimension_scan as D
from meshlens.llm import html_tree, labelled_pages, nn_descent


def test_bounds_abandon_candidates():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 64))
    x = centres[rng.integers(0, 40, 2000)] + 1.5 * rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, index = np.arange(2000), D.fit(x, 80)
    at = index.nearest(x @ index.rotation)
    order = index.order(x[::20] @ index.rotation)[:, : index.probes]
    tally, lost, asked = {}, 0, 0
    for q, lists in zip(range(0, 2000, 20), order):
        sizes = np.cumsum([(at == i).sum() for i in lists]) - 1
        first = int((sizes < 20).sum()) + 1
        near = next(D.top(ids[[q]], x[[q]], ids[np.isin(at, lists[:first])], x[np.isin(at, lists[:first])], index.rotation, 20))
        bound = np.array([near[2][-1]])
        found = list(zip(near[2], near[1]))
        for i in lists[first:]:
            if (at == i).any():
                _, got, score = next(D.top(ids[[q]], x[[q]], ids[at == i], x[at == i], index.rotation, 20, bound, tally))
                found += zip(score, got)
        mine = [i for _, i in sorted(found, key=lambda f: (-f[0], f[1]))[:20]]
        probed = ids[np.isin(at, lists) & (ids != q)]
        best = probed[np.lexsort((probed, -(x[probed] @ x[q])))][:20]
        lost += len(set(best) - set(mine))
        asked += len(best)
    assert tally["pairs"] > 10_000 and tally["abandoned"] > 0.3 * tally["pairs"], tally
    assert lost <= 0.005 * asked  # what the tests cost within the probed lists


def test_search_recall_over_the_whole_table(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((30, 48))[rng.integers(0, 30, 1500)] + 0.5 * rng.standard_normal((1500, 48))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = D.search(vectors).cache()
    assert found.groupBy("query_id").count().where("count <> 20").count() == 0 and D.recall_of(found, vectors) >= 0.9


def test_search_recall_where_the_sample_tells_too_little(spark):
    """Vectors without clusters, of which the index is fitted on a twentieth: its own sample lies nearer to the centroids than the rest."""
    x = np.random.default_rng(9).standard_normal((6000, 32)) * np.random.default_rng(10).lognormal(0, 0.3, (6000, 1))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = D.search(vectors, sample=300).cache()
    assert found.groupBy("query_id").count().where("count <> 20").count() == 0 and D.recall_of(found, vectors) >= 0.93


def test_bounds_lose_no_near_neighbours_of_tight_clusters():
    """Of vectors that lie close together the columns not yet seen hold much of the product: their mean isn't 0."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20, 64))[rng.integers(0, 20, 4000)] + 0.7 * rng.standard_normal((4000, 64))
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    lost, tally = 0, {}
    for q in range(0, 4000, 40):
        score = x @ x[q]
        best = np.argsort(-score)[:20]
        lost += len(set(best) - set(D.scan(x[[q]] @ turn, x @ turn, 20, score[best[-1:]], tally)[0]))
    assert lost <= 0.002 * 2000 and tally["abandoned"] > 0.3 * tally["pairs"], (lost, tally)


def test_exact_links_whatever_the_audit_lets_pass(spark):
    """Short lists, one round and an audit that is always content: the exact comparison still finds every link."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((150, 16)).repeat(4, axis=0) + 0.13 * rng.standard_normal((600, 16))
    x = x.astype("f4").astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(600, dtype=bool)
    root, old = np.arange(600), None
    while old is None or (old != root).any():
        old, root = root, np.minimum(root, np.where(near, root[None, :], 600).min(1))
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = nn_descent.near_duplicates(vectors, k=1, max_rounds=1, recall=0.0, exact=True).toPandas().set_index("vec_id").sort_index()
    assert near.any() and (got["n_links"].to_numpy() == near.sum(1)).all() and (got["component_id"].to_numpy() == root).all()


@pytest.fixture(scope="module")
def model():
    return html_tree.train(labelled_pages.pages())


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<article><p class=a\">First text.</p><p class=b\">Second text.</p><p>Third.</p></article>", ["First text.", "Second text.", "Third."]),
        ("<p>One.<a title=don't>link</a> Two.</p><p>It's three.</p>", ["One.link Two.", "It's three."]),
        ("<p>One.</p><!--><p>Two.</p><p>Three.</p>", ["One.", "Two.", "Three."]),
        ("<p>A.</p><!-- x --!><p>B.</p><!---><p>C.</p><!-- to the end <p>D.</p>", ["A.", "B.", "C."]),
        ("<p a=\"x>y\" b='q>\"r' c = \"z>\" d=e>ok</p><p a=>two</p><p a= >three</p>", ["ok", "two", "three"]),
        ("<a href=/x?y=\"1\">t</a> u", ["t u"]),
        ("1 < 2 and <3", ["1 < 2 and <3"]),
    ],
)
def test_markup_as_html_reads_it(source, texts):
    assert [t for t in html_tree.parse(source).text if t is not None] == texts


def test_markup_is_read_in_linear_time():
    for source in ("<p " * 100_000, "<p a='" * 50_000, "<!-" * 100_000, "<p a=" * 100_000 + '"', "<a b='c' " * 50_000 + ">x"):
        html_tree.parse(source)


#: Pages written by hand, with the article's blocks; none of them comes from the training layouts.
PAGES = [
    ("<html><body><header><a href=/>Daily Leaf</a></header><nav><a href=/n>News</a> <a href=/s>Sport</a></nav><main><article><h1>River level falls</h1><p>The river fell by a metre on Monday, officials said.</p><p>Boats may pass again.</p></article></main><footer>Copyright Daily Leaf</footer></body></html>", ["River level falls", "The river fell by a metre on Monday, officials said.", "Boats may pass again."]),
    ('<body><div id="nav-main"><ul><li><a href="#">Home</a></li></ul></div><div class="post-content"><h1>Bread at home</h1><p>Mix flour, water and salt.</p><ul><li>Rest for an hour.</li><li>Bake at high heat.</li></ul></div><section class="comments"><h2>Comments</h2><p>Loved it, thank you.</p></section></body>', ["Bread at home", "Mix flour, water and salt.", "Rest for an hour.", "Bake at high heat."]),
    ('<body><div class="cookie-banner">We use cookies. <button>OK</button></div><article class="story"><h1>New bridge</h1><p>It opens in May, &amp; tolls are low.</p><aside class="advert"><p>Buy tyres now.</p></aside><p>Traffic will ease.</p></article><aside class="sidebar"><h3>Most read</h3><ul><li><a href=1>Old bridge</a></li></ul></aside></body>', ["New bridge", "It opens in May, & tolls are low.", "Traffic will ease."]),
    ('<body><main><h1>Opening hours</h1><p>We open at nine, every day but Sunday.</p></main><form class="newsletter"><p>Get our letter.</p><input><button>Send</button></form><footer><p>Terms, privacy.</p></footer></body>', ["Opening hours", "We open at nine, every day but Sunday."]),
    ('<div class="wrapper"><div class="menu"><a href=/a>A</a><a href=/b>B</a></div><div class="entry-content"><h2>Notes on light</h2><p>Light bends, slowly.<p>It also bounces.<blockquote><p>So it was written.</p></blockquote></div><div class="related-posts"><h4>See also</h4><a href=/c>Notes on sound</a></div></div>', ["Notes on light", "Light bends, slowly.", "It also bounces.", "So it was written."]),
    ('<article><header><h1>Council votes</h1></header><p>Members voted, nine to two.</p><table><tr><td>For</td><td>Nine members, all from the north.</td></tr></table></article><div id="comments"><h4>Replies</h4><ol><li>Well done, all.</li><li>No, I disagree with this.</li></ol></div><footer>&copy; 2020</footer>', ["Council votes", "Members voted, nine to two.", "For", "Nine members, all from the north."]),
]


def test_pages_written_by_hand(model):
    right = told = wanted = 0
    for source, texts in PAGES:
        got = html_tree.main_text(source, model).split("\n")
        right += len(set(got) & set(texts))
        told, wanted = told + len(got), wanted + len(texts)
    assert right / told >= 0.9 and right / wanted >= 0.9, (right, told, wanted)
