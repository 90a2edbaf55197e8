import re
import time
from html.parser import HTMLParser

from foldline.llm.html import Page, consensus, extract, votes

from .conftest import SF

PAGE = """<html><body class="home"><header class="site"><h1>Site</h1><nav><a href=x>m</a></nav></header>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="post-content"><h1>Title &amp; more</h1>
<p>One two<br>three <b>four</b> <a href=y>five</a>.<p>Second   para&nbsp;here<ul><li>item a</li><li>item b</ul>
<div class="ad-box">BUY</div><blockquote><p>quoted text.</p></blockquote><!-- no --><table><tr><td>c1</td><td>c2</td></tr></table></div>
<aside>side</aside><section class="comments"><p>reader comment is long enough to be here</p></section></div>
<form><label>Email</label><input></form><footer>foot</footer><script>if(a<b){x="</p>"}</script></body></html>"""
TEXT = "Title & more\nOne two three four five.\nSecond para here\nitem a\nitem b\nquoted text.\nc1\nc2"


def best(source):
    p = Page(source)
    return p.text(p.path(p.best()[0]))


def test_main_text():
    assert best(PAGE) == TEXT
    assert best("<p>just a paragraph") == "just a paragraph"
    assert best("no markup at all") == "no markup at all"
    assert best("") == "" and best("<nav>a</nav><script>x") == "" and best("<<>><p") is not None


def test_extract(spark):
    rows = [(i, f"http://h.example/{i}", PAGE) for i in range(4)] + [(9, None, None), (9, "http://h.example/z", ""), (None, "nonsense", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "'c' AS winner", "'c' AS path")
    for most in (200_000, 0):
        got = sorted(((r["page_id"] or -1, r["text"], r["n_chars"]) for r in extract(df, broadcast_hosts=most).collect()), key=str)
        assert got == sorted([(i or -1 if i is None else i, TEXT, len(TEXT)) for i in range(1, 4)] + [(-1, TEXT, len(TEXT)), (9, "", 0), (9, "", 0), (-1, "x", 1)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_hosts_agree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = extract(pages).collect()
    assert len(found) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in found)
    host = consensus(votes(pages.selectExpr("'h' AS host", "html"))).collect()
    assert len(host) == 1 and host[0]["winner"].endswith("article")


def test_nothing_beside_the_best_is_lost(spark):
    intro, body = "An introduction of some length. " * 9, "What the page is about in all its length. " * 9
    for around in ("article", "div", "main"):
        assert best(f'<{around}><header></header><h1>Title</h1><div class="entry-content"><p>{body}</div></{around}>') == f"Title\n{body.strip()}"
        assert best(f'<{around}><div class="intro">{intro}</div><div class="body">{body}</div></{around}>') == f"{intro.strip()}\n{body.strip()}"
        assert best(f"<{around}><h1>T</h1><p>intro<ul><li>{body}<li>{body}</ul></{around}>") == f"T\nintro\n{body.strip()}\n{body.strip()}"
        assert best(f"<{around}><p>intro<table><tr><td>{body}</td></tr></table><p>end</{around}>") == f"intro\n{body.strip()}\nend"
    assert best(f'<article><header><h1>Title</h1></header><div class="entry-content"><p>{body}</div></article>') == f"Title\n{body.strip()}"
    assert best(f"<div><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></div><div class=a>{body}</div><div class=a>{intro}</div>") == f"{body.strip()}\n{intro.strip()}"
    plain, more = f"<div class=a><p>{body}</div>", f"<p>{intro}</p><div class=a><p>{body}</div>"
    df = spark.createDataFrame([(i, "http://h.example/", plain if i else more) for i in range(4)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == {i: body.strip() if i else f"{intro.strip()}\n{body.strip()}" for i in range(4)}


def test_noise_words_do_not_outweigh_content():
    body = "What the page is about in all its length. " * 9
    text = body.strip()
    for kind in ("content has-sidebar", "post-content no-comments", "content sidebar", "sidebar-layout", "widget", "content-sidebar-wrap"):
        assert best(f'<body><div class="{kind}"><p>{body}</div><footer>f</footer></body>') == text
        assert best(f'<body><div class="{kind}"><article><p>{body}</article></div><div class="ad">BUY</div></body>') == text
    assert best(f'<article class="post tag-social"><p>{body}</article><div class="ad">BUY</div>') == text
    assert best(f'<article class="comments"><p>{body}</article><div class="ad">BUY</div>') == text
    assert best(f'<h1>T</h1><section id="intro"><p>{body}</section><section id="discussion"><h2>Discussion</h2><p>{body}</section>') == f"T\n{text}\nDiscussion\n{text}"
    assert best(f'<article><h2 id="related-work">Related work</h2><p class="notice">{body}</p><p>a <b class="reply">reply</b> here</article>') == f"Related work\n{text}\na reply here"
    assert best(f'<body><form id="aspnetForm"><div class="nav-bar">n</div><p>{body}</form></body>') == text
    assert best(f'<form><div class="comments"><p>{body}</div><div class="content"><p>{text}</div></form>') == text
    assert best('<div class="comments"><p>one</div><div class="comments"><p>two</div><div class="comments"><p>three</div><nav>n</nav>') == "one\ntwo\nthree"
    assert best(f'<article><header><div class="titles"><h1>T</h1></div></header><p>{body}</article>') == f"T\n{text}"
    for kind in ("comments", "sidebar", "related-posts", "ad-box", "cookie-notice", "site-header", "comment-body", "main-menu"):
        assert best(f'<article><p>short text</article><div class="{kind}">{body}</div>') == "short text"
        assert best(f'<div class="entry"><p>{body}</div><div id="{kind}">{body}</div>') == text


def test_embedded_elements_end_where_they_end():
    for lone in ('<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<math/>", "<button>", "<select>", '<iframe src="x">', "<canvas>", "<object>", "<noscript>", "<template>"):
        assert best(f"<article><p>one {lone}two</p><p>three</article><footer>f</footer>") == "one two\nthree"
        assert best(f"<article>{lone}<p>one</p><p>two</p></article><button>b</button>") == "one\ntwo"
        assert best(f"<p>one {lone}two") == "one two"
    for tag in ("svg", "button", "select", "iframe", "canvas", "object", "noscript", "template"):
        assert best(f"<article><p>one <{tag} a='b'><{tag}>no</{tag}><p>no</p> no</{tag}>two</p><div>three</div></article>") == "one two\nthree"
    assert best("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds") == "if x=2 holds"
    assert best("<svg><title/><style/><script/><path d='m'/></svg><p>one</p><p>two <textarea><p>no</textarea>") == "one\ntwo"
    assert best("<div><button>a<div><select>b</div><p>c</div><p>d</p>") == "a\nb\nc\nd"
    assert len(best("<p>word <button>" * 3000 + "</p>")) > 3000


def test_the_vote_decides(spark):
    """Pages of a host show the same text in a container of no telling name: no page can know it, but the host can."""
    own = [f"What page {i} is about, at a length that no other page has. " * 4 for i in range(6)]
    same = "All pages of this host show this and nothing else here. " * 2
    pages = [(i, f"http://h.example/{i}", f'<div class="w"><div class="c7"><p>{own[i]}</div><div class="q"><p>{same}</div></div>') for i in range(5)]
    pages += [(5, "http://h.example/5", f'<div class="w"><div class="c7"><p>{own[5]}</div><div class="q"><p>only here</div></div>')]
    pages += [(6, "http://h.example/6", f'<div class="w"><div class="c7"><p>{own[0]}</div><div class="q"><p>{same}</div><div class="r">more of it</div></div>')]
    pages += [(7, "http://other.example/", pages[0][2])] + [(10 + i, "http://copies.example/", pages[0][2]) for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: own[i].strip() for i in range(5)} | {5: f"{own[5].strip()}\nonly here", 6: f"{own[0].strip()}\nmore of it"}
    alone = f"{own[0].strip()}\n{same.strip()}"
    want |= {i: alone for i in (7, *range(10, 16))}  # one page, or copies of one, can't tell
    assert best(pages[0][2]) == alone
    for most in (50_000, 0):
        assert {r["page_id"]: r["text"] for r in extract(df, broadcast_hosts=most).collect()} == want


class Plain(HTMLParser):
    """The blocks of the given tables' pages, by the standard library's parser and their known layout."""

    SKIP = frozenset("script style nav aside footer form header noscript button svg select iframe".split())
    BLOCKS = frozenset("p h1 h2 h3 h4 li td th blockquote pre div section article ul ol table tr figcaption dt dd".split())

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip, self.inside = [], [], [], 0
        self.feed(source)
        self.close()
        self.flush()

    def flush(self):
        if body := " ".join("".join(self.text).split()):
            self.out.append(body)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.append(tag)
            return
        noise = re.search(r"comment|sidebar|related|cookie|ad-|promo|share|newsletter", " ".join(v or "" for k, v in attrs if k in ("class", "id")))
        if tag in self.SKIP or noise and tag in self.BLOCKS:
            self.skip = [tag]
            return
        if tag in self.BLOCKS:
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            return
        if tag in self.BLOCKS:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside > 0 and not self.skip:
            self.text.append(data)


def test_against_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    by_id = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    checked = 0
    for r in extract(pages).collect():
        if by_id[r["page_id"]].count("<article") == 1 and "</article>" in by_id[r["page_id"]]:
            assert r["text"] == "\n".join(Plain(by_id[r["page_id"]]).out)
            checked += 1
    assert checked > 100


def test_time_is_linear_in_hostile_pages():
    for part in ("<a ", '<a "', "<a '\"", '<a x=">" ', "<span hidden>", '<b role="alert">x', "<! ", "<svg><p></svg", "<button><div>", "<li><ul>", "<div>x", "<p></section>"):
        began = time.process_time()
        best(part * (400_000 // len(part)))
        assert time.process_time() - began < 20
