import hashlib
import random
import re

import numpy as np
from keyfold.llm import html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="single-post has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site to do things.</p></div>
<div id="main-wrap"><article class="post"><h1>Title &amp; more</h1><p>First   paragraph with <b>bold<i> and</i> text</b> that goes on for a while, &eacute;t&#233;.<br>Next line<p>Short.
<div class="ad">Buy now, this is an advert with many words in it, really many.</div><ul><li>Item one<li>Item two</ul><form><p>Enter</p><input name=q></form>
<p>Last paragraph that is long enough to be content &lt;here&gt;.</p><!-- hidden --></article>
<section id="comments"><p>A reader comment that is long and looks like content, with many many words in it.</p></section></div>
<aside class="sidebar"><p>Related things to read, with a long teaser text that goes on.</p></aside><footer>&copy; 2024</footer></body></html>"""
TEXT = "Title & more\n\nFirst paragraph with bold and text that goes on for a while, été. Next line\n\nShort.\n\nItem one\n\nItem two\n\nLast paragraph that is long enough to be content <here>."


def test_extract():
    assert html_text.extract(PAGE) == TEXT
    plain = PAGE.replace('<article class="post">', '<div class="post">').replace("</article>", "</div>")
    assert html_text.extract(plain) == TEXT
    assert html_text.extract(PAGE[:PAGE.index("Last paragraph")] + "<di") == TEXT[:TEXT.index("\n\nLast")]
    assert [html_text.extract(x) for x in (None, "", "<nav>x</nav>", "<p", "just text")] == ["", "", "", "", "just text"]


def test_extract_all_content():
    """The whole content comes: titles, leads and blocks beside the heaviest element."""
    p = "A paragraph of some words that make a sentence. "
    said = lambda k: (p * k).strip()
    join = "\n\n".join
    assert html_text.extract(f"<body><h1>Title</h1><p>{said(4)}</p><pre>{said(42)}</pre></body>") == join(["Title", said(4), said(42)])
    body = "".join(f"<p>{said(8)}</p>" for _ in range(6))
    lead = f'<div id="page"><h1>Title</h1><p class="lead">{said(5)}</p><div class="text">{body}</div></div>'
    links = "<div><a>One</a><a>Two</a></div>"
    assert html_text.extract(f"<body>{links * 4}{lead}{links * 4}</body>") == join(["Title", said(5), *[said(8)] * 6])
    assert html_text.extract(f'<div><h1>Title</h1>{links * 5}<div class="text">{body}</div></div>').startswith("Title\n\n")
    items = "".join(f"<li>{said(6)}</li>" for _ in range(8))
    assert html_text.extract(f"<div><h2>List</h2><p>Intro</p><ul>{items}</ul><p>End</p></div>") == join(["List", "Intro", *[said(6)] * 8, "End"])
    assert html_text.extract(f"<div><div><p>{said(1)}</p></div>{links * 9}<div><pre>{said(400)}</pre></div></div>").startswith(said(1))
    two = f"<div><article><h2>A</h2><p>{said(3)}</p></article><h2>Between</h2><article><h2>B</h2><p>{said(9)}</p><p>Short</p></article>{{}}</div>{links}"
    assert html_text.extract(two.format("")) == join(["A", said(3), "Between", "B", said(9), "Short"])
    assert html_text.extract(two.format(f'<article class="comment"><p>{said(20)}</p></article>')) == html_text.extract(two.format(""))
    assert html_text.extract(f"<main><h1>Title</h1><article><p>{said(9)}</p></article><p>Note</p></main>{links}") == join(["Title", said(9), "Note"])
    assert html_text.extract(f"<h1>Title</h1><p>{said(5)}</p><article><p>{said(30)}</p></article>") == join(["Title", said(5), said(30)])


def test_extract_marked_wrappers():
    """A class or id that only describes the layout drops nothing; sections of others' words stay out."""
    p = "A paragraph of some words that make a sentence. "
    said = lambda k: (p * k).strip()
    article = f"<article><h1>Title</h1><p>{said(9)}</p><p>Short</p></article>"
    plain = article.replace("article>", "section>")
    text = "\n\n".join(["Title", said(9), "Short"])
    aside = f'<div class="sidebar"><p>{said(4)}</p></div>'
    comments = f'<section id="comments"><article><p>{said(20)}</p></article></section>'
    for wrapper in ("content has-sidebar", "no-sidebar", "with-comments", "elementor-widget", "page-header-fixed", "share-enabled", "widgetArea", "sidebar-layout main", "comments-layout", "banner widget"):
        for own in (article, plain) if wrapper != "comments-layout" else (article,):
            assert html_text.extract(f'<body><div class="{wrapper}">{own}</div></body>') == text, wrapper
            assert html_text.extract(f'<body><div class="{wrapper}"><div>{own}</div>{aside}</div><div class="ad">{said(2)}</div></body>') == text, wrapper
        assert html_text.extract(f'<body><div id="{wrapper}">{article}{comments}</div></body>') == text, wrapper
    widgets = "".join(f'<div class="elementor-widget elementor-widget-text"><p>{said(k)}</p></div>' for k in (3, 4, 5))
    assert html_text.extract(f"<body>{widgets}</body>") == "\n\n".join(said(k) for k in (3, 4, 5))
    many = "".join(f'<div class="widget"><p>{said(k)}</p></div>' for k in (3, 4, 5))
    assert html_text.extract(f"<body>{many}</body>") == "\n\n".join(said(k) for k in (3, 4, 5))
    related = '<div class="related">' + f"<article><p>{said(2)}</p></article>" * 30 + "</div>"
    for own in (article, plain):
        assert html_text.extract(f"<body>{own}{comments}{aside}</body>") == text
    assert html_text.extract(f"<body>{article}{related}</body>") == text
    menu = '<div class="menu">' + "<a>Entry</a>" * 900 + "</div>"
    assert html_text.extract(f"<body>{menu}{plain}</body>") == text
    assert html_text.extract('<div><p>Hello <span class="share">share this now</span> world</p></div>') == "Hello world"


def test_main_text_rows(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t"), (1, "u", PAGE, "t"), (4, "w", "<p>" + "long text " * 50_000 + "</p>", "t"), (None, "x", "<p>a&nbsp; b</p>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()]
    want = [(1, "u", TEXT), (2, None, ""), (3, "v", ""), (1, "u", TEXT), (4, "w", ("long text " * 50_000).strip()), (None, "x", "a b")]
    assert sorted(got, key=repr) == sorted([(*w, len(w[2])) for w in want], key=repr)
    assert html_text.main_text(df.limit(0)).count() == 0


def parse(data):
    """Records of a WARC text as (headers, block)."""
    out, at, raw = [], 0, data.encode()
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        out.append((headers, raw[end + 4:end + 4 + size]))
        assert raw[end + 4 + size:end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    return out


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", PAGE, "x"), (2, None, None, "x"), (3, "http://b/é", "<p>WARC/1.1\r\n\r\nbody</p>", "x"), (1, "http://a/", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    responses = warc.responses(df, "2024-01-01T00:00:00Z")
    derived = warc.derivatives(responses)
    got = derived.collect()
    assert len(got) == 8
    ids = {r["record_id"]: r for r in responses.collect()}
    for r in got:
        source = ids[r["refers_to"]]
        assert (r["target_uri"], r["source_headers"], r["date"]) == (source["target_uri"], source["http_headers"], source["date"])
        assert r["payload_digest"] == "sha256:" + hashlib.sha256(source["payload"].encode()).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r["record_id"])
        if r["warc_type"] == "conversion":
            assert r["block"] == warc.plain_text(source["payload"])
        else:
            fields = dict(line.split(": ", 1) for line in r["block"].strip().split("\r\n"))
            assert fields["source-payload-digest"] == r["payload_digest"] and fields["text-length"] == str(len(warc.plain_text(source["payload"])))
    assert "hidden" not in warc.plain_text(PAGE) and "Title & more" in warc.plain_text(PAGE) and "var t" not in warc.plain_text(PAGE)
    path = str(tmp_path / "warc")
    warc.write(derived, path, compression="none")
    records = [x for f in (tmp_path / "warc").glob("part-*") for x in parse(f.read_bytes().decode())]
    assert sorted((h["WARC-Record-ID"], b.decode()) for h, b in records) == sorted((r["record_id"], r["block"]) for r in got)
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_warc_files_keep_source_headers_and_digests(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a: b\r\nX-Long: one\r\n two\r\nSet-Cookie: c\r\n"
    rows = [(1, "r1", "http://a/", "2024-01-01T00:00:00Z", http, "<p>One</p>"), (2, "r2", None, None, None, "<p>Two</p>")]
    derived = warc.derivatives(spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, date string, http_headers string, payload string"))
    path = str(tmp_path / "warc")
    warc.write(derived, path, compression="none")
    records = [x for f in (tmp_path / "warc").glob("part-*") for x in parse(f.read_bytes().decode())]
    assert len(records) == 4
    for headers, block in records:
        source = next(r for r in rows if r[1] == headers["WARC-Refers-To"])
        assert headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(source[5].encode()).hexdigest()
        if headers["WARC-Type"] == "metadata":
            kept = [x.split(": ", 1)[1] for x in block.decode().split("\r\n") if x.startswith("source-http-header: ")]
            assert kept == [x for x in (source[4] or "").split("\r\n") if x]


def built(rng, article):
    """A page put together from parts, and the text that its parts say is the article."""
    words = lambda n: " ".join(rng.choice(["river", "stone", "light", "garden", "window", "paper", "morning", "quiet"]) for _ in range(n))
    noise = lambda: rng.choice([
        "<div>Home | News | Sport</div>", f"<nav><ul><li><a href='/'>{words(2)}</a></li><li><a href='/b'>{words(1)}</a></li></ul></nav>",
        f"<aside><p>{words(30)}</p></aside>", f"<div class='cookie-banner'><p>{words(20)}</p></div>", "<form><label>Mail</label><input name=q></form>", f"<header>{words(2)}</header>"])
    title, body, text = words(4), [], []
    text.append(title)
    for _ in range(rng.randint(2, 7)):
        kind = rng.choice(["p", "p", "short", "list", "table", "quote", "formula"])
        if kind == "p":
            said = words(rng.randint(15, 60))
            body.append(f"<p>{said}</p>")
            text.append(said)
        elif kind == "short":
            said = words(2)
            body.append(f"<h2>{said}</h2>")
            text.append(said)
        elif kind == "list":
            items = [words(3) for _ in range(3)]
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            text += items
        elif kind == "table":
            cells = [words(2) for _ in range(2)]
            body.append("<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>")
            text += cells
        elif kind == "quote":
            said = words(12)
            body.append(f"<blockquote>{said}</blockquote>")
            text.append(said)
        else:
            said = words(14)
            body.append(f"<p>{said} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>")
            text.append(said + " x=1")
    last = words(40)
    body.append(f"<p>{last}</p>")
    text.append(last)
    head = f"<header><h1>{title}</h1><span>By me</span></header>" if article and rng.random() < 0.5 else f"<h1>{title}</h1>"
    core = head + "".join(body)
    core = f"<article>{core}</article>" if article else core
    return f"<html><body>{''.join(noise() for _ in range(rng.randint(0, 4)))}{core}<footer>{words(3)}</footer></body></html>", "\n\n".join(text)


def test_pages_put_together_from_parts():
    rng = random.Random(11)
    for i in range(400):
        page, text = built(rng, article=i % 2 == 0)
        assert html_text.extract(page) == text, page


def test_the_ratio_decides_where_no_article_is_marked(monkeypatch):
    links = "<div>" + " ".join(f"<a href='/{w}'>{w}</a>" for w in "Home News Sport Weather Business Culture Travel Science Opinion Letters".split()) + "</div>"
    sentence = "This is a long sentence of the text, which goes on for a while and ends here, after some more of its words were said."
    page = f"<body>{links}<div>Home | News | Sport</div><h1>Title</h1><p>{sentence}</p><p>{sentence}</p><ul><li>one</li></ul><div>Imprint</div>{links}</body>"
    text = f"Title\n\n{sentence}\n\n{sentence}\n\none"
    assert html_text.extract(page) == text
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, sigma=1.0: np.ones(len(ratios)))  # every block passes
    assert html_text.extract(page).startswith("Home News Sport Weather") and html_text.extract(page) != text


def test_headers_of_an_article_and_formulas():
    page = "<body><header>Site</header><article><header><h1>Title</h1><p>By me</p></header><p>The value <math><mi>x</mi></math> is used</p><video>See it</video></article></body>"
    assert html_text.extract(page) == "Title\n\nThe value x is used\n\nSee it" or html_text.extract(page) == "Title\n\nThe value x is used\n\nSee it".replace("\n\nSee it", " See it")
