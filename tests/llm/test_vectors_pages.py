"""Vectors and pages against brute force, and the pipeline."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import components, embedding_dedup, html_extract
from gridlark.llm.scratch import Scratch

SMALL = "/root/testdata/sf0.001"


def linked(vectors, cosine=0.95):
    ids = list(vectors)
    ok = {i: v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for i, v in vectors.items()}
    unit = {i: np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in ids if ok[i]}
    near = {i: [j for j in ids if j != i and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]) and unit[i] @ unit[j] >= cosine] for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    out = {}
    for _ in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            out[len(out)] = (base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist()
    n = len(out)
    out |= {n: None, n + 1: [], n + 2: [0.0] * 16, n + 3: [float("nan")] * 16, n + 4: [None, 1.0], n + 5: [1.0, 2.0], n + 6: [2.0, 4.0], n + 7: out[0], n + 8: [x * 2 for x in out[0]], n + 9: [float("inf")] + [1.0] * 15}
    return out


@pytest.mark.parametrize("block", [512, 5])
def test_embedding_links_equal_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], "vec_id long, embedding array<float>, node int, raw string")
    got = embedding_dedup.projection_dedup(df, Scratch(spark, "t")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == linked(vectors) and len(got) == len(vectors)


@pytest.mark.parametrize(("n", "partitions"), [(6000, 3), (6000, 40), (50_000, 8)])
def test_embedding_links_in_a_dense_topic(spark, n, partitions):
    """Near pairs among many distinct vectors of one topic, all of them at a cosine of about 0.85."""
    rng, pairs = np.random.default_rng(5), 300
    x = np.sqrt(0.85) * np.eye(64)[0] + np.sqrt(0.15 / 64) * rng.standard_normal((n, 64))
    x[n - pairs :] = x[:pairs] / np.linalg.norm(x[:pairs], axis=1)[:, None] + rng.standard_normal((pairs, 64)) * 0.31 / 8
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = {(i, n - pairs + i) for i in range(pairs) if u[i] @ u[n - pairs + i] >= 0.95}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r[0]: (r[1], r[2]) for r in embedding_dedup.projection_dedup(df, Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = sum(got[i][1] == got[j][1] for i, j in near)
    assert len(got) == n and len(near) > 100 and found >= 0.9 * len(near)
    members = {}
    for i, (_, component) in got.items():
        members.setdefault(component, []).append(i)
    for them in members.values():  # every link counted within a component, none below the cosine
        dots = u[them] @ u[them].T >= 0.95
        np.fill_diagonal(dots, False)
        assert dots.sum(axis=1).tolist() == [got[i][0] for i in them]


def test_embedding_passes_find_what_is_not_equal(spark, vectors):
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    direction = {i: tuple((np.array(v, np.float64) / np.abs(v).max()).tolist()) for i, v in vectors.items() if linked(vectors)[i][0]}
    got = {r[0]: r[1] for r in embedding_dedup.projection_dedup(df, Scratch(spark, "t"), passes=0).collect()}
    assert got == {i: sum(direction[j] == direction[i] for j in direction if j != i) if i in direction else 0 for i in vectors}


def test_embedding_empty_and_alone(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.projection_dedup(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0])], schema)
    assert [tuple(r) for r in embedding_dedup.projection_dedup(one, Scratch(spark, "t2")).collect()] == [(5, 0, 5, True)]
    assert embedding_dedup.projection_dedup(one.unionAll(one), Scratch(spark, "t3")).count() == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (5, 5), (201, 200), (None, 3)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t2")).count() == 0


TEXT = "This is the first paragraph of a long article about &eacute;clairs &amp; tea, and it goes on for a while."
PAGES = {
    "plain": (f"<html><head><title>t</title><script>x='</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{TEXT}<p>Second <b>bold</b>word\n here.</p></article><footer>c</footer></body></html>", "Title {} Second boldword here."),
    "divs": (f"<body><div id='top-menu'><a>Menu</a></div><div class='post-12 entry'><p>{TEXT}</p><p>Second boldword here.</p></div><div class=comments><p>A reader says a lot of words here, more than the article itself has to say about it, and then some.</p></div></body>", "{} Second boldword here."),
    "noise": (f"<body><main><form><input value=1>Sign up</form><div class='cookie-notice'>We use cookies</div><p>{TEXT}</p><aside>Side</aside><div style='display: none'>hid</div><ul><li>One<li>Two</ul><!-- gone <p>no</p> --></main><div>Copyright</div></body>", "{} One Two"),
    "bare": ("just text &lt;b&gt; here", "just text <b> here"),
    "broken": (f"<body><article><p>{TEXT}</div></span><p>Second boldword here.", "{} Second boldword here."),
    "empty": ("", ""),
    "null": (None, ""),
    "boiler": ("<body><nav>only a menu</nav></body>", ""),
}


def test_html(spark):
    want = {k: v[1].format(html_extract.html.unescape(TEXT)) for k, v in PAGES.items()}
    names = list(PAGES)
    rows = [(i, f"http://h{i}.example.com/{n}", PAGES[n][0], "x", 1) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, score int")
    got = html_extract.extract(df, Scratch(spark, "t")).collect()
    assert {names[r["page_id"]]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.limit(0), Scratch(spark, "t2")).count() == 0


def test_host_consensus(spark):
    """A page whose own tightest container is another follows its host."""
    good = f"<body><div class='body'><p>{TEXT}</p></div><div class='box'><p>x</p></div></body>"
    odd = f"<body><div class='body'><p>Short text.</p></div><div class='box'><p>{TEXT} {TEXT}</p></div></body>"
    rows = [(i, "https://Same.example.com:80/a", good) for i in range(5)] + [(9, "http://same.example.com", odd), (10, None, good), (11, "nohost", None)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t")).collect()}
    assert got[9] == "Short text." and got[10].startswith("This is") and got[11] == ""


def test_siblings_of_the_widest_child_are_kept(spark):
    """No prose or heading is left out, on a page alone or by its host's path."""
    rest = f"<p>{TEXT}</p>" * 5
    alone = f"<body><div class=post><h1>Title</h1><p>An intro of some words.</p><div class=rest>{rest}</div></div></body>"
    nested = f"<body><div class=post><div class=lead><p>An intro of some words.</p></div><div class=rest>{rest}</div></div></body>"
    items = "".join(f"<li>Entry number {i} of a long list</li>" for i in range(400))
    listing = f"<body><div class=post><ul>{items}</ul></div></body>"
    other = f"<body><div class=post><p>{TEXT}</p><ul><li>One</li></ul></div></body>"
    rows = [(1, "http://a.org/", alone), (2, "http://b.org/", nested)] + [(10 + i, "http://c.org/", other) for i in range(3)] + [(20, "http://c.org/", listing)]
    rows += [(30 + i, "http://d.org/", listing) for i in range(3)] + [(40, "http://d.org/", other)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t")).collect()}
    plain = html_extract.html.unescape(TEXT)
    assert got[1] == f"Title An intro of some words. {' '.join([plain] * 5)}" and got[2] == got[1][6:]
    assert {got[k] for k in (10, 11, 12, 40)} == {f"{plain} One"} and got[20] == got[30] and got[20].count("Entry") == 400


def page_text(html):
    return html_extract.Page(html).text


def test_classes_that_say_so_in_part():
    """Theme classes and forms around or on the article do not drop it, those beside it go."""
    plain = html_extract.html.unescape(TEXT)
    side = "<div class='site-footer'>All about this site, in a few words.</div><div class='main-nav'><a>x</a> and some more words here</div>"
    for page in (
        f"<body><div class='content-area with-sidebar'><p>{TEXT}</p></div>{side}",
        f"<body><div class='layout no-sidebar'><article><p>{TEXT}</p></article></div>{side}",
        f"<body><article class='post share-card'><p>{TEXT}</p></article>{side}",
        f"<body><div class='notice-board'><h1>{TEXT}</h1></div>{side}",
        f"<body><form id=aspnetForm><div class=page-header-wrap>A site of some words</div><div><p>{TEXT}</p></div></form>",
        f"<body><div><label>{TEXT}</label></div>{side}",
        f"<body><form><div class='search-results'><div class='ad-free'><p>{TEXT}</p></div><form><label>Your name</label></form></div></form>",
        f"<body><article><p>{TEXT}</p></article><div class='comment-list'><article class=comment><p>{TEXT} {TEXT} {TEXT}</p></article></div><form>Say what you think of all this</form>",
    ):
        assert page_text(page) == plain, page
    assert page_text("<body><div class=sidebar>Words of a page that is nothing else</div>") == ""


MORE = "Some words on what readers had to say, which are many more than the article has, and go on and on for as long as it takes. "
EVERYDAY = {
    "widget around the article": (f"<body><div class='widget'><article><p>{TEXT}</p></article></div><div class=footer>All about this site, in words</div>", "{}"),
    "a restaurant's menu": (f"<body><div id='menu'><main><h1>Our menu</h1><p>{TEXT}</p></main></div>", "Our menu {}"),
    "wrapper in a wrapper": (f"<body><div class='layout-sidebar'><div class='banner'><article><p>{TEXT}</p></article></div></div>", "{}"),
    "teasers in a sidebar": (f"<body><div class=post><p>{TEXT}</p></div><div class=sidebar><article><p>{MORE}</p></article><article><p>{MORE}</p></article></div>", "{}"),
    "a paper's sections": (f"<body><article><p>{TEXT}</p><section id='discussion'><h2>Discussion</h2><p>We find this and that.</p></section><section id=search><h2>Search</h2><p>How we looked for it.</p></section></article>", "{} Discussion We find this and that. Search How we looked for it."),
    "readers' discussion": (f"<body><article><p>{TEXT}</p><section id='discussion'><h2>Discussion</h2><div class=comment><p>{MORE}</p></div></section></article>", "{}"),
    "a search box": (f"<body><article><p>{TEXT}</p><section id='search'><h2>Search</h2><p>Look for other things here.</p><form><input></form></section></article>", "{}"),
    "title called header": (f"<body><div class='post'><h1 class='header'>A title</h1><p>{TEXT}</p></div>", "A title {}"),
    "nav left open": (f"<body><nav><a href=/>Home</a><ul><li>One of many<article><p>{TEXT}</p></article><footer>foot</footer>", "{}"),
    "nav with an article in it": (f"<body><nav><article>A teaser of some words</article></nav><article><p>{TEXT}</p></article>", "{}"),
    "empty comments": (f"<body><article><!--><p>{TEXT}</p><!---><p>One.</p><!-- x --!><p>Two.</p><!-- a > b --></article>", "{} One. Two."),
    "cdata": (f"<body><article><![CDATA[ x ]><p>{TEXT}</p></article>", "{}"),
    "cdata, closed": (f"<body><article><![CDATA[ x ]]><p>{TEXT}</p></article>", "{}"),
    "comments as articles": (f"<body><div class=post><p>{TEXT}</p></div><div class='comments-section'><article><p>{MORE}</p></article><article><p>{MORE}</p></article></div>", "{}"),
    "a theme with comments": (f"<body><div class='comments-enabled'><h1>Title</h1><p>{TEXT}</p></div>", "Title {}"),
    "a notice only": ("<body><div class='notice'>This page has gone to another place</div>", ""),
}


@pytest.mark.parametrize("name", EVERYDAY)
def test_everyday_pages(name):
    page, want = EVERYDAY[name]
    assert page_text(page) == want.format(html_extract.html.unescape(TEXT))


def test_scanner_is_linear():
    """Tags that never end, quotes that never close and long runs of white space."""
    start = time.perf_counter()
    for page in ("<div " * 200_000, '<a title="' * 100_000, "<a x='" * 100_000 + ">", "<" * 1_000_000, "<p a" + " " * 1_000_000 + ">x", "<p " + "a" * 1_000_000 + ">x", "<!--" * 250_000, "</ " * 300_000, "<div class='with-nav'>" * 20_000 + "x y z"):
        page_text(page)
    assert time.perf_counter() - start < 20
    assert page_text(f"<body><article><p>{TEXT}</p></article>" + "<div " * 8000) == html_extract.html.unescape(TEXT)
    assert page_text("<p title='a > b'>x</p><p title=\"it's\">y</p><br/>z < 3 <!DOCTYPE x><b>w</b></ x>") == "x y z < 3 w"


class Tree(HTMLParser):
    """Every text with the elements it is in, by the library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.open, self.texts = [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "div", "ul", "table") and any(t == "p" for t, _ in self.open[-1:]):
            self.open.pop()
        if tag in html_extract.BLOCK:
            self.texts.append(([], " "))
        if tag not in html_extract.VOID:
            self.open.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self.texts.append(([], " "))
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.texts.append((list(self.open), data))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_equal_a_plain_extractor(spark, sf):
    """The article's text as a parser sees it, less whatever is not part of it."""
    dropped = {"script", "style", "nav", "footer", "aside", "header", "form", "title", "button", "noscript"}
    classes = {"ad", "ads", "comments", "comment", "sidebar", "cookie", "menu", "nav", "footer", "share", "related", "newsletter", "banner"}

    def main(source):
        out = []
        for around, text in Tree(source or "").texts:
            inside = [t for t, _ in around]
            if not around:
                out.append(text)
            elif "article" in inside and not dropped & set(inside) and not any(classes & set((a.get("class") or "").split()) for _, a in around):
                out.append(text)
        return " ".join("".join(out).split())

    pages = {r["page_id"]: main(r["html"]) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.op4_html_extract(spark, f"/root/testdata/{sf}").collect()}
    assert {k: (got[k], v) for k, v in pages.items() if got[k] != v} == {}


def test_many_open_and_deep_elements(spark):
    """However many elements are open or around it, the text is found."""
    unclosed = f"<body><nav>{'<font><b>x' * 300}</nav><article><p>{TEXT}</p></article></body>"
    deep = f"<body>{'<div>' * 20}<article><p>{TEXT}</p></article><div>Something about this site, in words.</div>"
    deeper = f"<body>{'<div>' * 5000}<article><p>{TEXT}</p></article>"
    rows = [(i, f"http://h{i}.org/", x) for i, x in enumerate((unclosed, deep, deeper))]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "t")).collect()
    assert [r["text"] for r in sorted(got)] == [html_extract.html.unescape(TEXT)] * 3


def test_pages_table(spark):
    out = html_extract.op4_html_extract(spark, SMALL)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert out.count() == pages.count() and out.where("n_chars = 0").isEmpty()
    assert out.where(F.col("text").rlike("</|track\\(")).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    docs, rows = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    own = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = Scratch(spark, "stage").table(stage(spark, docs, SMALL), f"s{k}")
        assert out.columns == own or k == len(corpus_pipeline.STAGES) - 1
        rows.append(out.count())
        docs = out
    assert rows[0] <= 200 and rows[1] <= rows[0] and rows[2] <= rows[1]
    assert sorted(r["slot"] for r in docs.select("slot").collect()) == list(range(rows[-1]))
    assert corpus_pipeline.run(spark, SMALL).count() == rows[-1]


def test_pipeline_on_awkward_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _score string, doc string, _rate long, _row long"
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, "x y z a b c d", "en", "s", 1, "a"), (3, "x y z a b c d", "en", "s", 1, "a"), (None, "q r s t u v", None, "s", 1, "a")]
    rows = [(*r, "d", 7, 8) for r in rows]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        got = [r.asDict() for r in out.collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and all((r["doc"], r["_rate"], r["_row"]) == ("d", 7, 8) and r["_score"] in ("a", None) for r in got)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
