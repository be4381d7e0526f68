"""Chat, URL, HTML, WARC and embedding operators, and the pipeline, against brute force and on awkward tables."""

import base64
import collections
import gzip
import hashlib
import html
import html.parser
import json
import math
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatid.llm import chat_format, embed_dedup, html_extract, queries, url_rules, warc
from chromatid.llm.common import new_path

SF = "/root/testdata/sf0.001"


CHAT = "conv_id long, turn long, role string, text string"


def chat(spark, rows):
    return spark.createDataFrame(rows, CHAT).selectExpr("*", "'x' AS part", "'y' AS speaker", "1 AS turns", "2 AS system")


def test_chat_is_rendered_for_every_speaker(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi <|im_end|> all"), (1, 2, "Bob", "Hello"), (1, 3, "Ann", None), (1, 3, "Ann", None), (1, None, "Bob", "late"),
        (2, 0, None, "who am I"), (2, 1, "unknown", "me"), (None, 0, "a b", "x"), (None, 1, "a_b", "日本"), (3, 0, "system", "alone"), (4, 0, "Анна", "a"), (4, 1, "Иван", "b"), (5, 10**15, "x", "long " * 50_000),
        (5, 1, "%20", ""), (5, 2, " ", ""),
    ]
    df = chat(spark, rows)
    got = {(r.conv_id, r.part, r.speaker): r for r in chat_format.rotate(df).collect()}
    assert set(got) == {(c, 0, s) for c, s in ((1, "Ann"), (1, "Bob"), (2, None), (2, "unknown"), (None, "a b"), (None, "a_b"), (4, "Анна"), (4, "Иван"), (5, "x"), (5, "%20"), (5, " "))}
    ann = got[1, 0, "Ann"]
    assert ann.rendered == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi < |im_end|> all<|im_end|>\n<|im_start|>user name=Bob\nHello<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=Bob\nlate<|im_end|>\n"
    )
    spans = [ann.rendered[int(a) : int(b)] for a, b in (s.split("-") for s in ann.mask.split(","))]
    assert spans == ["Hi < |im_end|> all<|im_end|>", "<|im_end|>", "<|im_end|>"] and (ann.n_turns, ann.n_own) == (6, 3)
    assert got[None, 0, "a_b"].rendered == "<|im_start|>user name=a%20b\nx<|im_end|>\n<|im_start|>assistant\n日本<|im_end|>\n"
    assert got[2, 0, "unknown"].rendered.startswith("<|im_start|>user name=%\n") and got[2, 0, None].rendered.startswith("<|im_start|>assistant\nwho")
    assert got[4, 0, "Анна"].n_own == got[4, 0, "Иван"].n_own == 1 and "name=Иван\n" in got[4, 0, "Анна"].rendered
    assert "name=%2520\n" in got[5, 0, " "].rendered and "name=%20\n" in got[5, 0, "%20"].rendered and len(got[5, 0, "x"].rendered) > 250_000
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_chat_renders_dialogues_whole(spark):
    rows = [(1, 1000 * k, "u" if k % 2 else "v", f"t{k}") for k in range(3000)] + [(1, -5, "system", "S"), (1, None, "u", "end")] + [(None, 7, "u", "same")] * 700
    got = {(r.conv_id, r.part, r.speaker): r for r in chat_format.rotate(chat(spark, rows)).collect()}
    assert set(got) == {(1, 0, "u"), (1, 0, "v"), (None, 0, "u")} and [got[1, 0, s].n_turns for s in "uv"] == [3002] * 2
    for who, key in (("u", (1, 0, "u")), ("v", (1, 0, "v")), ("u", (None, 0, "u"))):
        r = got[key]
        spans = [r.rendered[int(a) : int(b)] for a, b in (x.split("-") for x in r.mask.split(","))]
        want = [f"{t}<|im_end|>" for c, n, role, t in rows if c == key[0] and role == who]
        assert spans == want and r.n_own == len(want)


def test_chat_deals_what_no_row_holds_to_parts(spark):
    rows = [(1, 1000 * k, "u" if k % 2 else "v", f"t{k}" + "é" * (k % 5)) for k in range(1000)] + [(1, -5, "system", "S"), (1, None, "u", "end")]
    rows += [(None, 7, "u", "same")] * 251 + [(2, k, "w", "short") for k in range(3)]
    limit = 7000
    parts, at = {}, {}
    for c, n, role, t in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2], r[3])):
        parts.setdefault((c, at.get(c, 0) // limit), []).append((role, t))
        at[c] = at.get(c, 0) + len(t.encode()) + chat_format.TURN_BYTES
    want = {}
    for (c, p), turns in parts.items():
        turns = ([("system", "S")] if c == 1 and p else []) + turns
        for who in {r for d, _, r, _ in rows if d == c} - {"system"}:
            text, mask = "", []
            for role, t in turns:
                text += "<|im_start|>" + ("assistant" if role == who else role if role == "system" else f"user name={role}") + "\n"
                if role == who:
                    mask.append(f"{len(text)}-{len(text) + len(t) + 10}")
                text += t + "<|im_end|>\n"
            want[c, p, who] = (text, ",".join(mask))
    got = {(r.conv_id, r.part, r.speaker): (r.rendered, r.mask) for r in chat_format.rotate(chat(spark, rows), part_bytes=limit).collect()}
    assert got == want and max(p for _, p, _ in got) > 5


def test_chat_sql_is_the_operator(spark):
    rows = [(k % 5 if k % 6 else None, k // 7 if k % 11 else None, ("u", "v w", "system", None, "日%")[k % 5], f"t{k} <|" if k % 13 else None) for k in range(900)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [*rows, *((9, k % 50, "system" if k % 9 == 0 else "u", f"x{k}") for k in range(1200))])
    df = chat(spark, con.execute("SELECT * FROM conversations").fetchall())
    for limit, least in ((chat_format.PART_BYTES, 9), (5000, 30)):
        got = sorted(map(str, (tuple(r) for r in chat_format.rotate(df, part_bytes=limit).collect())))
        assert got == sorted(map(str, con.execute(queries.OP1_SQL.replace(str(chat_format.PART_BYTES), str(limit))).fetchall())) and len(got) >= least


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_url_rules_are_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://a.com", "HTTP://A.COM/x", "https://www.example.com/en/1?x#y", "https://example.com/en", "https://example.com/en/", "http://WWW.Example.com/de/",
        "ftp://x.y.net/es/1", "http://net/fr/", "http://net/fr", "http://a.net#/fr/", "http://com?q", "http://xcom/", "http://.com/", "http://a..com/en/", "http://ü.com/ß", "a://b://c.com/",
        "http://com.:80/", "http://example.com/en/\nx", "http://user@example.com/en/", "x" * 5000 + "://" + "s." * 40 + "com/" + "p" * 3000,
    ]
    rules = [*queries.URL_RULES, ("example.com", "/en/1", "block"), ("ü.com", "", "block"), ("net", "", "allow"), ("com", "/en", "block")]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.com/"), (4, "http://a.com")], "page_id long, url string")
    df = df.selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS prefix")
    r = spark.createDataFrame([*rules, (None, "/", "allow")], "host string, path string, verdict string")
    got = [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_rules.judge_urls(df, r).collect()]
    want = [(i, *judge(u, rules)) for i, u in [*enumerate(urls), (None, "http://a.com/"), (4, "http://a.com")]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x.verdict for x in url_rules.judge_urls(df, r.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge_urls(df.limit(0), r).count() == 0


def test_article_texts_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just &lt;text&gt; &amp;amp; more", "just <text> &amp; more"),
        ("<p>one<p>two  \n three<br>four", "one\ntwo three four"),
        ("<body><nav><a href=x>Menu</a></nav><main><h1>T</h1><p>A long enough sentence, with marks.</p><aside>no</aside><div class='comments'><p>bad</p></div></main><footer>f</footer>", "T\nA long enough sentence, with marks."),
        ("<article><header><h1>Head</h1></header><p>Text.</p><form>no</form><script>x<y</script><ul><li>a<li>b</ul></article>", "Head\nText.\na\nb"),
        ("<article><p>An <b>un<i>closed</b> tag &#233; &nbsp; x</p><div class=ad>buy</div><p>End.</p>", "An unclosed tag é x\nEnd."),
        ("<div class='cookie-notice'>We use cookies.</div><div><p>First paragraph of text, long and punctuated.</p><p>Second one, also long, with a point.</p></div><div><a href=1>l</a></div>", "First paragraph of text, long and punctuated.\nSecond one, also long, with a point."),
        ("<!-- <p>no</p> --><article>bare</article>", "bare"),
        ("<nav>only a menu</nav>", ""),
        ("<article><p>" + "long text. " * 30_000 + "</p></article>", ("long text. " * 30_000).strip()),
        ("<article><p>See <a href=foo\">this</a> now.</p><p>Second paragraph, here.</p><p>Third.</p></article>", "See this now.\nSecond paragraph, here.\nThird."),
        ("<article><p>See <a href=\"foo>this</a> now.</p><p>Second <a href=\"x\">one</a>, here.</p></article>", "See this now.\nSecond one, here."),
        ("<article><p>x <!-- y <p>text, here.</p></article>", "x text, here."),
        ("<article><p title='<b>no</b>'>a < b, and c > d.</p><title>u</article>", "a < b, and c > d.\nu"),
        ("<body><div id=content><h1>Title</h1><p>A long enough sentence, with marks, and more of it.</p><ul><li>one</li><li>two</li></ul></div><div>x</div></body>", "Title\nA long enough sentence, with marks, and more of it.\none\ntwo"),
        ("<article><h1>T</h1><p>A long text, with marks. Yes.</p><section id='related-work'><h2>Related work</h2><p>Others did it, too.</p></section><div class='menu-of-the-day'><p>Soup, then fish.</p></div><div class='relatedPosts'><p>Some other long text, with marks, to read.</p></div><div class='comment-list'><p>I like it, really, it is good.</p></div></article>", "T\nA long text, with marks. Yes.\nRelated work\nOthers did it, too.\nSoup, then fish."),
        ("<article><h2><a href=1>Linked heading</a></h2><p>Body text, long enough to be content. Sure.</p><ul><li><a href=1>rel one</a></li><li><a href=2>rel two</a></li></ul></article>", "Linked heading\nBody text, long enough to be content. Sure.\nrel one\nrel two"),
        ("<main><div class='sidebar'><p>Side text, long and good, with marks.</p></div><article>The text, which is short.</article></main>", "The text, which is short."),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


LONG = "A long sentence, with marks, that tells a lot. " * 9


def test_wrappers_lists_and_names_that_mislead():
    text = LONG.strip()
    form = f"<body><form action='/'><div class='page'><nav>no</nav><h1>T</h1><p>{LONG}</p></div><input></form></body>"
    assert html_extract.main_text(form) == f"T\n{text}"
    assert html_extract.main_text(f"<body><p>{LONG}</p><form><p>Your name, please.</p><input></form></body>") == text
    lists = "<ul><li><a href=x>Alpha report</a></li><li><a href=y>Beta report</a></li></ul><p><a href=z>A linked paragraph, whole.</a></p>"
    page = f"<main><article><h1>T</h1><p>{LONG}</p>{lists}<p>Press <button>Go</button> to start.</p><button>Share</button><table class='share'><tr><td>1</td><td>2</td></tr></table></article></main>"
    assert html_extract.main_text(page) == f"T\n{text}\nAlpha report\nBeta report\nA linked paragraph, whole.\nPress Go to start.\n1\n2"
    for tag in ("section id='discussion'", "div class=\"comments\""):
        assert html_extract.main_text(f"<main><h1>T</h1><p>{LONG}</p><{tag}><p>I liked it.</p><p>Me too, said Bob.</p></{tag.split()[0]}></main>") == f"T\n{text}"
    assert html_extract.main_text(f"<article><h1>T</h1><p>{LONG}</p><section id='discussion'><p>We discuss.</p></section></article>").endswith("We discuss.")


def test_ratios_find_content_without_telling_names():
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    right = 0
    for page in pages:
        blind = re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", page).replace(' class="ad"', "")
        want, got = html_extract.main_text(page), html_extract.main_text(blind)
        right += got == want
        assert want in got  # nothing of the article is lost
    assert right >= 0.85 * len(pages)


def test_ratios_decide():
    ad = "<div class=ad>Buy it now, it is good.</div>"
    page = ad + "<div id=c><h1>Title</h1><p>First paragraph of text, long and punctuated.</p><p>Second one, also long, with a point.</p></div><div>About</div><article><a href=1>A teaser</a></article>"
    assert html_extract.main_text(page) == "Title\nFirst paragraph of text, long and punctuated.\nSecond one, also long, with a point."
    assert html_extract.main_text(page, threshold=0.0) != html_extract.main_text(page)
    rows = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    assert all(html_extract.main_text(h, threshold=0.0) != html_extract.main_text(h) for h in rows)


@pytest.mark.parametrize(
    "page",
    [
        '<p a="x> ' * 12_000, "<p '> t " * 16_000, "<p " * 40_000, "<div>" * 16_000 + "x" + "</div>" * 16_000, "<b>" * 16_000 + "<p></p>" * 16_000, "<i><div>" + "<b>" * 16_000 + "</i>" * 16_000,
        "<!-- " * 20_000, "<title>x" * 16_000, '<a b="' * 20_000 + ">", "<" * 100_000 + ">", "</" * 50_000 + ">", "<p " + "class " * 20_000 + ">x", "<p class" + " " * 100_000 + ">x", "<svg>" * 20_000,
    ],
)
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 1.5


def test_extract_on_awkward_tables(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (2**60 + 1, "u", ""), (1, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [tuple(r) for r in html_extract.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "", 0), (None, "u", "x", 1), (2**60 + 1, "u", "", 0), (1, None, "", 0)], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_warc_records_are_linked(spark):
    page = "<html><head><title>T &amp; t</title></head><body><a href='/a?b&amp;c'>link</a><p>Grüße</p><!-- <a href=no> --><script>var x='<p>';</script></body></html>"
    rows = [("1", "<urn:uuid:1>", "http://x/", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX-A: b: c\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n", page), ("2", "<urn:uuid:2>", None, None, None, None), ("2", "<urn:uuid:2>", None, None, None, None)]
    df = spark.createDataFrame(rows, "source_id string, record_id string, target_uri string, warc_date string, http_headers string, body string").selectExpr("*", "1 AS block", "2 AS refers_to")
    got = warc.derivatives(df).collect()
    assert len(got) == 6
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    by = {(r.source_id, r.record_type): r for r in got}
    for (_, kind), r in by.items():
        assert r.block_digest == sha(r.block) and r.content_length == len(r.block.encode()) and r.refers_to == f"<urn:uuid:{r.source_id}>" and kind in ("metadata", "conversion")
    assert by["1", "conversion"].block == "link\nGrüße" and by["1", "conversion"].source_digest == sha(page) and by["2", "conversion"].source_digest == sha("")
    meta = json.loads(by["1", "metadata"].block)["Envelope"]
    http = meta["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Headers"] == {"X-A": "b: c", "Set-Cookie": ["a=1", "b=2"]} and http["HTML-Metadata"] == {"Title": "T & t", "Links": [{"path": "A@/href", "url": "/a?b&c"}]}
    assert meta["WARC-Header-Metadata"]["WARC-Record-ID"] == "<urn:uuid:1>"
    assert len({r.record_id for r in got}) == 4
    path = new_path(spark, "warc")
    warc.write_members(warc.derivatives(df), path)
    back = [warc.parse(bytes(r.member))[0] for r in spark.read.parquet(path).collect()]
    assert {(r["WARC-Type"], r["WARC-Refers-To"], r["block"]) for r in back} == {(r.record_type, r.refers_to, r.block) for r in got}
    first = next(r for r in back if r["WARC-Refers-To"] == "<urn:uuid:1>" and r["WARC-Type"] == "conversion")
    assert first["WARC-Source-Header"] == ["X-A: b: c", "Set-Cookie: a=1", "Set-Cookie: b=2"] and first["WARC-Source-Payload-Digest"] == sha(page)
    assert warc.derivatives(df.limit(0)).count() == 0


class Visible(html.parser.HTMLParser):
    """A page's links, title and words, by another parser."""

    def __init__(self, page):
        super().__init__()
        self.links, self.words, self.title, self.inside = [], [], "", []
        self.feed(page)

    def handle_starttag(self, tag, attributes):
        self.inside += [tag] if tag in ("script", "style", "title") else []
        self.links += [f"{v}" for k, v in attributes if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()

    def handle_data(self, data):
        if not self.inside:
            self.words += [data]
        elif self.inside == ["title"]:
            self.title += data


def test_warc_of_the_test_pages_is_brute_force(spark):
    got = {(r.source_id, r.record_type): r for r in queries.op7_warc_derivatives(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == 2 * len(pages)
    for p in pages:
        seen, meta, text = Visible(p.html), got[str(p.page_id), "metadata"], got[str(p.page_id), "conversion"]
        sha = "sha1:" + base64.b32encode(hashlib.sha1(p.html.encode()).digest()).decode()
        assert "".join(text.block.split()) == "".join("".join(seen.words).split())
        found = json.loads(meta.block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert [x["url"] for x in found["Links"]] == seen.links and found["Title"] == " ".join(seen.title.split())
        for r in (meta, text):
            assert (r.target_uri, r.source_digest) == (p.url, sha) and r.refers_to == meta.refers_to and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()


def test_warc_files_are_read(spark, tmp_path):
    def record(kind, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\nWARC-Target-URI: http://x/\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x</p>"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("warcinfo", b"WARC/ x")) + gzip.compress(record("response", body)))
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.target_uri, r.body) for r in got] == [("<urn:response>", "http://x/", "<p>x</p>")]
    assert {r.record_type for r in warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()} == {"metadata", "conversion"}


def test_warc_payloads_stay_bytes(spark, tmp_path):
    def record(k, head, payload, digest=""):
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + payload
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{k}>\r\n{digest}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    latin, squeezed = "<p>Grüße\r\n</p>".encode("latin-1"), gzip.compress("<p>Ωmega</p>".encode(), mtime=0)
    cases = {
        "a": ("Content-Type: text/html; charset=ISO-8859-1", latin, "", "Grüße"),
        "b": ("Content-Type: text/html\r\nContent-Encoding: gzip", squeezed, "", "Ωmega"),
        "c": ("Content-Type: image/png", bytes(range(256)) * 300, "", ""),
        "d": ("Content-Type: text/html", b"<p>kept</p>", "WARC-Payload-Digest: sha1:OWN\r\n", "kept"),
        "e": ("Content-Type: text/html\r\nTransfer-Encoding: chunked", b"3\r\n<p>\r\n4\r\nx y \r\n0\r\n\r\n", "", "x y"),
        "f": ("Content-Type: text/html", latin, "", "Grüße"),
    }
    members = [record(k, head, payload, own) for k, (head, payload, own, _) in cases.items()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "plain.warc").write_bytes(b"".join(members * 5))
    (tmp_path / "zipped.warc").write_bytes(b"".join(map(gzip.compress, members)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # plain files are split
    try:
        responses = warc.read_responses(spark, str(tmp_path))
        got = responses.collect()
        out = [r for r in warc.derivatives(responses).collect() if r.record_type == "conversion"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(out) == 8 * len(cases)
    want = {f"<{k}>": own[21:-2] or "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() for k, (_, payload, own, _) in cases.items()}
    assert all(bytes(r.payload) == cases[r.record_id[1]][1] and r.payload_digest == want[r.record_id] for r in got)
    assert all(r.source_digest == want[r.source_id] and r.block == cases[r.source_id[1]][3] for r in out)


def test_warc_records_come_in_pieces():
    data = b"".join(warc.serialize({"record_type": "conversion", "record_id": f"<{k}>", "refers_to": None, "target_uri": None, "warc_date": None, "block_digest": None, "content_type": None, "block": "WARC/ é" * k}) for k in range(9))
    for raw in (data, gzip.decompress(data)):
        for n in (1, 7, 100_000):
            found = list(warc.records(raw[i : i + n] for i in range(0, len(raw), n)))
            assert [(h["WARC-Record-ID"], b.decode()) for h, b in found] == [(f"<{k}>", "WARC/ é" * k) for k in range(9)]


def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(4, 16))
        for k in range(60):
            v = centres[k % 4] + rng.normal(size=16) * (0.25 if k % 3 else 0.02)
            rows.append((1000 * label + k, [float(x) for x in np.float32(v * (1 + k % 5))], label))
    copy = rows[3][1]
    rows += [(500 + k, copy, 0) for k in range(30)] + [(600, [2 * x for x in copy], 0), (601, copy, 1), (602, copy, None)]
    rows += [(700, None, 0), (701, [0.0] * 16, 0), (702, [math.nan] + copy[1:], 0), (703, [math.inf] + copy[1:], 0), (704, [None, *copy[1:]], 0), (705, [], 0), (706, copy[:8], 0), (None, copy, 0), (707, copy, 0), (707, copy, 0)]
    # One id with other vectors and labels; and components whose squares overflow.
    rows += [(3, rows[7][1], 0), (3, rows[61][1], 1), (3, [1e20] * 16, 0), (708, [2e20] * 16, 0)]
    return rows


def brute_vectors(rows, threshold=0.93):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (a, x, p), (b, y, q) = rows[i], rows[j]
            if p is None or p != q or a is None or b is None or not ok(x) or not ok(y) or len(x) != len(y):
                continue
            x, y = np.array(x), np.array(y)
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], n[i], low.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile_rows", [1024, 9])
def test_embedding_links_are_brute_force(spark, tile_rows):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS bits", "2 AS rep", "3 AS size", "4 AS useful", "5 AS key")
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], q) for i, v, q in rows]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.link_near(df, tile_rows=tile_rows).collect()), key=str)
    want = brute_vectors(rows)
    assert got == want
    assert embed_dedup.link_near(df.limit(0)).count() == 0


def test_quantisation_bound_misses_nothing():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(200, 64))
    b = a[rng.integers(0, 200, 200)] + rng.normal(size=(200, 64)) * rng.uniform(0.1, 0.5, (200, 1))
    sure, maybe = embed_dedup.decided(embed_dedup.quantise(a), embed_dedup.quantise(b), 0.93)
    cosine = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    assert (cosine[sure] >= 0.93).all() and (cosine[~sure & ~maybe] < 0.93).all() and 0 < maybe.sum() < sure.sum() < sure.size


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline
    from chromatid.llm import cotrain, decontam, mixing, ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r.doc_id for r in cotrain.score(docs, labels).where("kept").collect()}
    left = docs.where(F.col("doc_id").isin(list(kept)))
    firsts = {r.class_id for r in ngram_join.join(left).collect()}
    left = left.where(F.col("doc_id").isin(list(firsts)))
    dirty = {r.doc_id for r in decontam.regions(left, bench).collect()}
    left = left.where(~F.col("doc_id").isin(list(dirty)))
    copies = collections.Counter({r.doc_id: r.copies for r in mixing.mix(left).collect()})
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +copies
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]


def test_pipeline_on_awkward_tables(spark):
    import corpus_pipeline

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rng = np.random.default_rng(3)
    item = "The quick brown fox jumps over the lazy dog, while seven wizards quietly judge my vow of silence."
    rows = [(i, " ".join(rng.choice(words, 40)), "en", f"s{i % 3}", 200) for i in range(60)]
    rows += [(100 + i, "!!! %%% ### $$$ " * 20, "xx", "s1", 320) for i in range(30)] + [(200, rows[0][1], "en", "s0", 200), (201, rows[0][1].upper(), "en", "s2", 200)] + [rows[5]] * 3
    rows += [(300, f"{rows[7][1]} {item}", "en", "s1", 300), (None, "one row of words without an id", None, None, None), (301, None, None, None, None), (302, "", "en", "s1", 0), (303, "long text " * 30_000, "en", "s0", 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"1 AS {c}" for c in ("_row", "_key", "_hits", "row", "shard", "key", "fp")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, item)], "item_id long, text string")

    def run(tables):
        path = new_path(spark, "tables")
        for name, df in zip(("documents", "labels", "benchmark"), tables, strict=True):
            df.write.parquet(f"{path}/{name}.parquet")
        return collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, path).collect())

    got = run((docs, labels, bench))
    assert not set(got) & {*range(100, 130), 200, 201, 300} and got[5] <= 3 and len(set(got)) > 30
    assert run((docs.limit(0), labels, bench)) == run((docs.limit(0), labels.limit(0), bench.limit(0))) == {}
    # Without labels and benchmark nothing is rejected.
    every = set(run((docs, labels.limit(0), bench.limit(0))))
    assert {r[0] for r in rows} >= every and every & set(range(100, 130))


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
