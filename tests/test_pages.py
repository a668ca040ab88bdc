"""Page-shape vectors (FIXTURES §2.8, §2.13): hand-written HTML through E-0 and the page operators."""

from pyspark.sql import functions as F

from fundscope.functions import blocks
from fundscope.functions.urls import resolve_url
from fundscope.operators import pages

DETAIL = """<!DOCTYPE html><html><head><title>T</title><base href="https://base.example/"></head><body>
<h1 class="page-title"> Early Career  Award </h1>
<div class="opportunity-summary">Summary &amp; more</div>
<section><div>Eligibility</div><ul><li> UK based </li><li></li></ul><ol><li>PhD</li></ol></section>
<p>Funding of £50,000 - £80,000 for 2 years. Closes 3 June 2026. Contact grants@example.org</p>
<a href="/apply">Apply now</a><a href="/opportunity/x-award/">X</a><a href="/opportunity/?filter_council=mrc">F</a>
<a href="/opportunity/page/2/">P</a><a href="/opportunity/filter_me/">Q</a>
<a href="https://other.org/opportunity/y/">Y</a><a href="/opportunity/x-award">X2</a>
<script>var x = "<p>not text</p>";</script><!-- comment -->
</body></html>"""

NESTED_ELIG = "<html><body><h1>Funding finder</h1><div>Eligibility <b>rules</b></div><ul><li>a</li></ul>" \
              "<p>one<p>two</p><p>three</p><p>four</p></body></html>"

CARDS = """<html><body>
<div class="teaser-grant"><h3 class="teaser-grant__title"> Discovery </h3><p class="teaser-grant__summary">S</p>
<p class="teaser-grant__meta">Up to £1.5 million for 2 to 5 years</p></div>
<div class="tool-card date-card fund-card bg-area"><h3 class="tool-card__title">Grant A</h3>
<div class="tool-card__intro">Intro A</div><a class="btn-secondary" href="/fund/a">More</a>
<div class="select-county-box__calendar-top">3 June 2026</div><div class="tool-card__subheading">£10,000</div></div>
<div class="tool-card date-card fund-card bg-area bg-dark-blue"><h3 class="tool-card__title">Grant B</h3>
<div class="select-county-box__calendar-top">Closed</div></div>
</body></html>"""


def _facts(spark, html, url="https://www.ukri.org/opportunity/x/"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return pages.page_facts(df)


def test_detail_page(spark):
    f = _facts(spark, DETAIL)
    assert pages.extract_title(f).collect()[0]["title"] == "Early Career Award"
    assert pages.extract_description(f).collect()[0]["description"] == "Summary & more"
    assert pages.extract_requirements(f).collect()[0]["requirements"] == ["UK based", "PhD"]
    assert pages.application_url(f, F.lit("https://www.ukri.org")).collect()[0][1] == "https://www.ukri.org/apply"
    text = pages.page_text(f, "raw").collect()[0]["text"]
    assert "not text" not in text and "comment" not in text and "T" in text
    links = sorted(r["link"] for r in pages.extract_links(f, base_url=F.lit("https://www.ukri.org")).collect())
    assert links == ["https://other.org/opportunity/y/", "https://www.ukri.org/opportunity/x-award",
                     "https://www.ukri.org/opportunity/x-award/"]


def test_nested_eligibility_and_title_drop(spark):
    f = _facts(spark, NESTED_ELIG)
    assert pages.extract_requirements(f).collect()[0]["requirements"] == []
    assert pages.drop_non_records(f).count() == 0
    # unclosed <p> nests: the first paragraph holds the text of those inside it
    assert pages.extract_description(f).collect()[0]["description"] == "onetwothreefour two three"


def test_cards(spark):
    f = _facts(spark, CARDS, "https://www.nuffieldfoundation.org/funding/")
    t = pages.teaser_cards(f).collect()[0]
    assert (t["title"], t["amount"], t["duration_years"]) == ("Discovery", 1500000.0, 5)
    d = pages.dated_cards(f).collect()
    assert len(d) == 1  # the card without an intro is dropped
    assert (d[0]["title"], d[0]["deadline"], d[0]["amount_min"]) == ("Grant A", "2026-06-03", 10000)
    assert d[0]["application_url"] == "https://www.nuffieldfoundation.org/fund/a"


def test_resolve_url(spark):
    base = "https://www.ukri.org/a/b/c?q=1#f"
    cases = [("/opportunity/x/", "https://www.ukri.org/opportunity/x/"), ("d", "https://www.ukri.org/a/b/d"),
             ("../d", "https://www.ukri.org/a/d"), ("./d/../e", "https://www.ukri.org/a/b/e"),
             ("?z=2", "https://www.ukri.org/a/b/c?z=2"), ("#g", "https://www.ukri.org/a/b/c?q=1#g"),
             ("//cdn.org/x", "https://cdn.org/x"), ("http://o.org/p", "http://o.org/p"), ("", base),
             ("../../../../x", "https://www.ukri.org/x")]
    df = spark.createDataFrame([(h,) for h, _ in cases], "h string")
    got = [r[0] for r in df.select(resolve_url(F.lit(base), F.col("h"))).collect()]
    assert got == [e for _, e in cases]


def test_labelled_block(spark):
    text = ("Research Fellowships\nFor early career researchers\nDuration: 2 to 3 years\nFrequency: Annual\n"
            "Value: £50,000 to £100,000\nDeadline/Opening: 1 May 2025")
    df = spark.createDataFrame([(1, text)], "id long, text string")
    r = blocks.labelled_blocks(df, "id").collect()[0]
    assert (r["title"], r["duration_years"], r["amount_min"], r["amount_max"], r["deadline"], r["frequency"]) == (
        "Research Fellowships", 3, 50000.0, 100000.0, "2025-05-01", "Annual")


def test_labelled_block_with_separator_char(spark):
    text = "Grants\nFor a\u0001b\nValue: £5 to £7\nDeadline/Opening: Open all year"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    r = blocks.labelled_blocks(df, "id").collect()[0]
    assert (r["description"], r["amount_min"], r["amount_max"], r["deadline"]) == ("a\u0001b", 5.0, 7.0, "Rolling")


def test_text_nodes_and_hidden_text(spark):
    for html, text, items in [
        ("<p>Eligibility < 5 years</p><template><p>tpl</p></template>", "Eligibility < 5 years", []),
        ("<div>Eligibility < 5</div><ul><li>a & b</li></ul>", "Eligibility < 5a & b", ["a & b"]),
        ("<template><div>x<b>y</b></div></template>z", "z", []),
        ("a<!-- c -->b <p> \n  </p><i>  </i>", "ab \n ", []),
        ("<ruby>x<rt>kan</rt></ruby><![CDATA[raw]]>", "xraw", [])]:
        f = _facts(spark, html)
        assert f.select("text_raw").first()[0] == text
        assert pages.extract_requirements(f).first()["requirements"] == items


def test_page_record_keeps_failures_as_data(spark):
    from fundscope.operators import page_records

    rows = [(1, "https://www.ukri.org/opportunity/x/", DETAIL), (2, "https://www.ukri.org/opportunity/health-y/", None), (3, "u", NESTED_ELIG), (4, "u", "<p>no title</p>"),
            (5, "https://www.ukri.org/opportunity/z/", "<h1>Award</h1><p>Funding, known in advance for 99999999999 years, on 31/2/2025")]
    out = {r["page_id"]: r for r in page_records.page_outcomes(spark.createDataFrame(rows, "page_id long, url string, html string"), "2025-01-01 00:00:00").collect()}
    assert {k: r["reject"] for k, r in out.items()} == {1: None, 2: "no page", 3: "search page", 4: "no title", 5: None}
    assert out[1]["problems"] == ["council"] and out[1]["funding_details"]["amount"]["min"] == 50_000 * 1000  # the page has a 'k'
    assert out[1]["application"]["deadline"] == "2026-06-03" and out[1]["contact"]["email"] == "grants@example.org"
    assert out[5]["problems"] == ["council", "amount", "duration", "deadline"]
    amount = out[5]["funding_details"]["amount"]
    assert (amount["min"], amount["max"], amount["duration_years"], out[5]["application"]["deadline"]) == (0, 0, 1, "2025-04-01")
    assert out[5]["funding_details"]["covers"] == ["Research costs", "Equipment", "Travel"] and out[5]["key_info"]["success_rate"] == "N/A"


def test_link_classification_sends_no_text(spark):
    from fundscope.operators import page_records

    links = spark.createDataFrame([(1, "https://x/arts/"), (2, "https://x/a/"), (3, "https://x/b/"), (4, None), (5, "https://x/a/")], "link_id int, url string")
    fetched = spark.createDataFrame([(9, "https://x/a/", "<p>Medical</p>"), (8, "https://x/a/", "<p>natural"), (7, "https://x/arts/", "<p>social"), (6, "https://x/b/", None)],
                                    "page_id long, url string, html string")
    out = page_records.classify_links(links, fetched)
    assert {r["link_id"]: (r["council"], r["decided_by"]) for r in out.collect()} == {
        1: ("ahrc", "url"), 2: ("nerc", "text"), 3: ("ahrc", "default"), 4: ("ahrc", "default"), 5: ("nerc", "text")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the fetched pages are filtered by their own url below the parse, and what leaves it is aggregated as (url, council)
    below = plan[plan.index("MapInPandas"):]
    assert "Filter" in below and "arts" in below and "ResolvedHint" not in plan
    physical = out._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in physical.split("\n") if "partial_min_by" in x]
    assert sent and all("text_raw" not in x.split("output")[-1] for x in sent)


def test_plain_markup_gives_the_tree_of_html_parser():
    import random

    from fundscope.functions import html_facts as hf

    def tree(n):
        return (n.kind, n.value) if isinstance(n, hf.Text) else (n.tag, n.attrs, n.hidden, [tree(c) for c in n.children])

    assert hf._parse_plain('<!DOCTYPE html><div class="a b">x &amp; y < 5<br></div><!-- c --><script>if (a) b="&amp;"</script></p>') is not None
    bits = ['<p>', '</p>', '<div class="a b">', '</div>', 'x &amp; y', '&', '&lt', ' \n ', '<br>', '</br>', '<!-- c -->', '<!---->', '<!--a-b-->', '<script>', 'var a="&amp;"', '</script>',
            '</script >', '<title>', '</title>', '<textarea>', '</textarea>', '<A>', '<a href=x>', '<a href="x&amp;y">', '<a  href="q">', '<', '>', '<!doctype html>', '<?pi?>',
            '<![CDATA[z]]>', '<iframe>', '</iframe>', '<h1 id="a" id="b">', '</h1>', '<template>', '</template>', '<a data-x="1" b="">', '</a>', '<col/>', '< 5', 'a <= b']
    rng, plain = random.Random(3), 0
    for _ in range(5000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        root = hf._parse_plain(html)
        if root is not None:
            plain += 1
            assert tree(root) == tree(hf.parse_any(html)), html
        root = hf.parse(html)
        hits = {s: hf.get_text(n) for s in pages.SELECTORS if (n := hf.select_one(root, s)) is not None}
        assert hf.page_facts(html, pages.SELECTORS, ("selectors",))["selectors"] == hits
    assert plain > 500


def test_an_apply_link_is_looked_up_once(spark):
    out = pages.application_url(_facts(spark, DETAIL))
    assert out.first()["application_url"] == "https://www.ukri.org/apply"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("apply|application") == 1


def test_facts_leave_a_worker_in_small_parts():
    import pandas as pd

    run = pages._facts_fn(("text_raw", "teaser_cards"))
    out = list(run(iter([pd.DataFrame({"page_id": range(1200), "url": "u", "html": [CARDS] * 1199 + [None]})])))
    assert [len(o) for o in out] == [500, 500, 200]
    assert [k for o in out for k in o["page_id"]] == list(range(1200)) and out[-1]["missing"].tolist() == [False] * 199 + [True]
    long = list(run(iter([pd.DataFrame({"page_id": range(3), "url": "u", "html": ["<p>" + "x" * pages.FACTS_CHARS] * 3})])))
    assert [len(o) for o in long] == [1, 1, 1]


def test_a_text_without_blocks_is_left_in_time(spark):
    import time

    texts = [(i, "a long text of cards " * 1000) for i in range(60)] + [(60, "Fellowship X\nFor anyone\nValue: £5\n"), (61, "Title\nForty pages\n\nOther\n For x\n"), (62, None)]
    df = spark.createDataFrame(texts, "leaflet_id long, text string").repartition(1).cache()
    df.count()
    t = time.time()
    rows = blocks.labelled_blocks(df, "leaflet_id").collect()
    assert [(r["leaflet_id"], r["title"], r["amount_min"]) for r in rows] == [(60, "Fellowship X", 5.0)]
    assert time.time() - t < 10
