import html
import re

from driftline.llm.html_text import extract, extract_text, fit


def article(page):
    """What the generator's template puts in the article."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inner)]
    lines = [" ".join(html.unescape(p).split()) for p in parts]
    return "\n\n".join(x for x in lines if x)


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_text(pages, fit(pages)).collect()}
    assert got == {r["page_id"]: article(r["html"]) for r in pages.collect()}


def test_other_markup():
    words = "word " * 30
    page = f"""<html><head><title>T</title></head><body><header><a href=/>Home</a></header><div class="cookie-notice">We use <b>cookies</b> here</div>
    <div id="content"><h2>A &amp; B</h2><div><p>{words}<a href=x>link</a> end&nbsp;here.</div><aside>See also this</aside><ul><li>one</li><li>two</li></ul>
    <form><label>Mail</label><button>Send it now</button></form><p>Last   line.</p></div><div class="comments"><p>{words}</p></div><footer>&copy; me</footer></body></html>"""
    text = extract(page, {})
    assert text == f"A & B\n\n{words}link end here.\n\none\n\ntwo\n\nLast line."


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "no tags at all", 3), (3, "u", "no tags at all", 3), (None, "u", "<p>x<p>y", 4), (4, "u", "<script>var a='<p>'", None), (5, "u", "<div" * 5000, 1), (6, "u", "<b>" + "w " * 50000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract_text(pages, fit(pages)).select("page_id", "text").collect()
    texts = {(r[0], r[1][:20]) for r in got}
    assert len(got) == 8 and texts >= {(1, ""), (2, ""), (3, "no tags at all"), (None, "x\n\ny"), (4, ""), (6, "w " * 10)}
    assert extract_text(pages.limit(0), {}).count() == 0
