import html
import re

from commitlens.llm import html_text as H
from llm.conftest import SF, rows_of


def test_query_matches_plain_reading(spark):
    """The pages' articles are headings and paragraphs: read by pattern."""
    got = rows_of(H.op6_html_text(spark, SF), "page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[p.page_id]["n_chars"] == len(got[p.page_id]["text"]) and got[p.page_id]["url"] == p.url


def text(source, *template):
    return H.main_text(source, frozenset(template))


def test_what_is_no_main_text():
    parts = ["<nav>x</nav>", "<header><h1>x</h1></header>", "<footer>x</footer>", "<aside>x</aside>", "<form>x<input value=x></form>", "<script>if (a < b) x</script>",
             "<style>p{x}</style>", "<noscript>x</noscript>", "<div class='ad'>x</div>", "<div id=cookie-notice>x</div>", "<section class='comments'><article>x</article></section>",
             "<div role=navigation>x</div>", "<ul class=\"menu main\"><li>x</ul>", "<div hidden>x</div>", "<!-- <p>x</p> -->", "<div class='newsletter signup'>x</div>", "<div class=site-header>x</div>"]
    for part in parts:
        for page in (f"<body>{part}<article><p>kept</p></article>{part}</body>", f"<body>{part}<div><p>kept</p></div>{part}</body>", f"<article>{part}<p>kept{part}</article>" if "header" not in part else "<article>kept</article>"):
            assert text(page) == "kept", page


def test_blocks_and_references():
    assert text("<article><h1>T &amp; x</h1><p>a\n b<p>c <i>d</i>e<br>f<ul><li>1<li>2 &lt;p&gt;</ul>tail &#8212; &nbsp;end</article>") == "T & x\n\na b\n\nc de f\n\n1\n\n2 <p>\n\ntail — end"
    assert text("<main><p>m</p></main><p>outside</p>") == "m"
    assert text("<article><p>one</article><p>no</p><article><p>two</article>") == "one\n\ntwo"
    assert text("<table><tr><td>a<td>b<tr><th>c</table>") == "a b\n\nc"
    assert text("a < b and <unknown x='>'>c</unknown> d") == "a < b and c d"
    assert text("<article><header><h1>title</h1></header><p>body</p></article>") == "title\n\nbody"
    assert text("") == text("<html>") == text("<article></article>") == ""
    assert text("<div>" * 5000 + "deep" + "</div>" * 4000) == "deep"


def test_templates_are_counted_per_host(spark):
    box = "<div><span>Follow us on all the sites</span></div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{box}<p>page {i}</p></body>") for i in range(8)]
    rows += [(100 + i, f"https://b.example/{i}", f"<body>{box if i == 0 else ''}<p>other {i}</p></body>") for i in range(8)]
    rows += [(200 + i, f"https://c.example/{i}", f"<article><p>a quoted line</p><p>{i}</p></article>") for i in range(8)]
    rows += [(300, None, f"<body>{box}<p>no host</p></body>"), (301, "not a url", None), (302, "http://a.example/x", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'old' AS text", "page_id AS host")
    out = H.extract_text(pages)
    assert sorted(out.columns) == sorted(pages.columns)
    got = rows_of(out, "page_id")
    assert got[3]["text"] == "page 3" and got[100]["text"] == "Follow us on all the sites\n\nother 0"
    assert got[205]["text"] == "a quoted line\n\n5"
    assert got[300]["text"] == "Follow us on all the sites\n\nno host" and got[301]["text"] == got[302]["text"] == ""
    assert H.extract_text(pages.limit(0)).collect() == []


def test_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<article>x</article>")] * 3, "page_id bigint, url string, html string")
    assert [r.text for r in H.extract_text(pages).collect()] == ["x"] * 3


def test_section_templates_of_a_large_host(spark):
    """Boxes on a quarter of a host go, whatever they are called; copies of a page stay."""
    box = [f"<div><ul><li><a>Section {k} archive</a></ul><span>Write to section {k}</span></div>" for k in range(4)]
    rows = [(i, f"https://big.example/{i}", f"<body><div>{box[i % 4]}<div><p>page {i} says {'<b>not</b>' if i % 4 == 0 else 'now'} this</p></div></div></body>") for i in range(400)]
    rows += [(1000 + i, f"https://big.example/copy/{i}", f"<head><title>{i}</title></head><body><div><div><p>copied text</p><ul><li>a<li>b</ul></div></div></body>") for i in range(90)]
    got = rows_of(H.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "page_id")
    assert [got[i]["text"] for i in range(400)] == [f"page {i} says {'now' if i % 4 else 'not'} this" for i in range(400)]
    assert {got[1000 + i]["text"] for i in range(90)} == {"copied text\n\na\n\nb"}


def test_wrappers_stay():
    long = "<p>" + "the text of the article " * 5 + "</p>"
    want = " ".join(["the text of the article"] * 5)
    side = "<div class='sidebar'><p>about me</p></div>"
    for wrap in ("<div class='content has-sidebar'>", "<div class='layout-sidebar-right'>", "<div id='page' class='no-comments'>", "<form id='aspnetForm'>", "<div class='search-page'>",
                 "<div class='widget'>", "<div role=form>", "<div class='comments-open'>"):
        end = "</form>" if "<form" in wrap else "</div>"
        for inner in (f"<article>{long}</article>", f"<main>{long}</main>", f"<div>{long}</div>"):
            assert text(f"<body>{wrap}{inner}{side}<form><input>subscribe</form>{end}</body>") == want, (wrap, inner)
    assert text(f"<body><article>{long}</article><div id=comments>{'<p>a long comment </p>' * 90}</div></body>") == want


def read_all(spark, rows):
    return rows_of(H.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "page_id")


def test_copies_of_a_text_on_a_small_host(spark):
    """Print versions and session ids: the text is on many pages, beside nothing of their own."""
    long = "<p>The first paragraph of the story that was told.</p><p>And the second one, which ends it.</p>"
    want = "The first paragraph of the story that was told.\n\nAnd the second one, which ends it."
    menu = "<div><ul><li>Home<li>Contact us</ul></div>"
    for k, wrap in enumerate(("<div class=post>%s</div>", "<article><div class=entry>%s</div></article>", "<div><div>%s</div></div>", "<section>%s</section>", "%s")):
        rows = [(i, f"http://h{k}.example/{i}", f"<body>{menu}{wrap % f'<p>Page {i} tells of something else, number {i}.</p>'}</body>") for i in range(7)]
        rows += [(10 + i, f"http://h{k}.example/print?session={i}", f"<body>{menu}{wrap % long}<small>id {i}</small></body>") for i in range(5)]
        got = read_all(spark, rows)
        for i in range(5):
            assert got[10 + i]["text"] in (want, f"{want}\n\nid {i}"), (wrap, got[10 + i]["text"])
        assert all(got[i]["text"] == f"Page {i} tells of something else, number {i}." for i in range(7)), wrap


def test_teasers_of_other_articles(spark):
    main = "<article><h1>Title</h1>" + "<p>a paragraph of the article itself</p>" * 6 + "</article>"
    page = f"<body>{main}<div><h2>Read next</h2><article><a>Another story</a></article><article><a>One more</a></article></div></body>"
    assert text(page) == "Title" + "\n\na paragraph of the article itself" * 6


def test_templates_against_brute_force(spark):
    """Every subtree of every page, counted by plain Python."""
    import collections
    import random

    rng = random.Random(5)
    boxes = [f"<div><span>box {k} of the site</span><b>{k}</b></div>" for k in range(6)]
    pages = [(i, f"http://s{i % 3}.example/{i}", "<body>" + "".join(rng.sample(boxes, rng.randint(0, 4))) + f"<p>page {rng.randrange(25)} says this and that</p></body>") for i in range(60)]
    on, total = collections.defaultdict(set), collections.Counter()
    for i, url, source in pages:
        host = url.split("/")[2]
        total[host] += 1
        for h in H.subtrees(source):
            on[host, h].add(i)
    candidates = {k for k, v in on.items() if len(v) >= 5 and len(v) >= 0.3 * total[k[0]]}
    want = set()
    for host, h in candidates:
        mine = frozenset(x for k, x in candidates if k == host)
        texts = {H.own_text(source, mine)[1] for i, url, source in pages if i in on[host, h]}
        if len(texts - {None}) >= 5:
            want.add((host, h))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {tuple(r) for r in H.site_templates(df).collect()} == want and want


def test_the_callers_own_column_names(spark):
    names = ["_host", "_template", "_of_host", "of_host", "hashes", "row", "read", "host", "text"]
    df = spark.createDataFrame([(1, "http://h/1", "<article>x</article>")], "page_id bigint, url string, html string").selectExpr("*", *[f"'mine' AS `{n}`" for n in names])
    got = H.extract_text(df)
    assert sorted(got.columns) == sorted(df.columns)
    r = got.first()
    assert r["text"] == "x" and all(r[n] == "mine" for n in names if n != "text")
