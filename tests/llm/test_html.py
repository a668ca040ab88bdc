"""Site templates on small hosts, page shapes, and the main text of the given pages against their documents."""

from fundscope.llm import html_main as hm


def text(html, template=()):
    return hm.main_text(hm.parse(html), set(template))


def test_page_shapes():
    page = """<html><head><title>t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div><article><header><h1>Head &amp; tail</h1></header><p>One <b>two</b>
    three<br>four<p>Five&nbsp;six &lt;tag&gt; &#233;<div class="share-box">Share</div><ul><li>a<li>b</ul><aside>side</aside>
    <form><input value="x">send</form><section class="comments"><p>Nice!</p></section><!-- gone --><footer>by me</footer></article>
    <div id="cookie-notice">We use cookies</div><footer>(c)</footer></body></html>"""
    assert text(page) == "Head & tail\n\nOne two three four\n\nFive six <tag> é\n\na\n\nb"
    assert text("") == "" and text("just text  here") == "just text here" and text("<p>a<p>b</div>c") == "a\n\nbc"
    assert text("<body><nav>m</nav><main><p>x</p></main></body>") == "x"
    assert text("<p>a<script>if (1 < 2) {</script> b</p><p>open") == "a b\n\nopen"
    assert text("<article class='comment'>no</article><article><p>yes</p></article>") == "yes"
    assert text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert text("<p>R&<b>copy</b> &amp;lt; &copy;</p>") == "R&copy &lt; ©"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_templates_per_host(spark):
    box = "<div class='box'><p>Join our list</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<div><p>Body {i}</p></div><div><p>Shared line</p></div></body>" if i < 8 else None, "x") for i in range(9)]
    rows += [(100, "http://b.example/1", f"<body>{box}<p>Only here</p></body>", "y"), (101, None, "<p>No url</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in hm.extract(df).collect()}
    assert got[0] == ("Body 0", 6) and got[8] == ("", 0)
    assert got[100][0] == "Join our list\n\nOnly here" and got[101][0] == "No url"
    assert hm.extract(df.limit(0)).count() == 0
    article = [(i, "http://a.example/x", f"<article><p>Common</p><div class='x'><p>Box</p></div><p>{i}</p></article>") for i in range(6)]
    out = hm.extract(spark.createDataFrame(article, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Common\n\n{i}" for i in range(6)}


def test_rotating_boxes_and_copies_of_articles(spark):
    rows = []
    for i in range(400):
        box = f"<div><p>Notice {i % 40}</p></div>"
        end = f"<div><span>Rotating end {i % 25}</span></div>"
        rows.append((i, "http://hot.example/x", f"<body>{box}<div><h1>Head {i}</h1><p>Body {i}</p></div>{end}</body>"))
        rows.append((1000 + i, "http://art.example/x", f"<body>{box}<article><h1>Head {i}</h1><p>Body {i}</p>{box}<ul><li>Point {i % 40}</li></ul></article></body>"))
    long = " ".join(f"word{k}" for k in range(90))
    for i in range(60):
        rows.append((2000 + i, "http://hot.example/copy", f"<body><div><p>{long}</p></div><div>Promo {i % 10}</div></body>"))
    got = {r["page_id"]: r["text"] for r in hm.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(400):
        assert got[i] == f"Head {i}\n\nBody {i}"
        assert got[1000 + i] == f"Head {i}\n\nBody {i}\n\nPoint {i % 40}"
    # one text beside a promo: the promo is not known from its own pages' text, but the article stays
    assert all(got[2000 + i].startswith(long) for i in range(60))
