"""Top-k, archives, page extraction, licences and tool calls: plain versions and edge cases."""

import hashlib
import json
import math
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeledger.llm import licence_texts, licences, toolcalls, topk, warc, wrapper

INF = float("inf")


def plain_top(rows, k, is_query):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if is_query(i)}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in ok if j != q)[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_against_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    r = random.Random(4)
    rows = [(i, [round(r.uniform(-1, 1), 2) if r.random() < 0.7 else 0.0 for _ in range(r.choice([3, 8, 8, 8]))]) for i in range(300)]
    rows += [(1, rows[1][1]), (50, rows[50][1]), (1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [INF]), (1004, []), (None, [1.0]), (1005, [0.0] * 8), (-50, [0.5] * 8)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id bigint, embedding array<double>, id int, vec string")
    got = topk.top_k(df, lambda i: i % 10 == 0, 5).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 5, lambda i: i % 10 == 0)


def test_top_k_extreme_components(spark):
    rows = [(0, [1e307, 1.0]), (50, [0.5, 2.0]), (7, [0.0, 2.5]), (8, [-1e300, 0.0]), (9, [1e-300, 1.0])]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), lambda i: i % 50 == 0).collect()}
    top, low = (1 << 63) - 1, -(1 << 63)
    assert got == {(0, 50): top, (0, 7): 640 * 256, (0, 8): low, (0, 9): 65536, (50, 0): top, (50, 7): 512 * 640, (50, 8): low, (50, 9): 512 * 256}


def test_lookup_of_urls_that_share_a_key(spark):
    pages = spark.createDataFrame([(1, "http://A.org/x#1", "<p>a</p>"), (1, "http://a.org/x", "<p>b</p>"), (2, "http://a.org/y", "c" * 2000)], "page_id bigint, url string, html string")
    got = warc.lookup(warc.write_archive(pages), pages, id_col="page_id")
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got.collect()) == [(1, "<p>a</p>"), (1, "<p>b</p>"), (2, "c" * 2000)]


def test_top_k_large_components_and_few_rows(spark):
    rows = [(0, [3e9, 1.0]), (50, [2e4, -5.0]), (7, [1.5, 2.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, lambda i: i % 50 == 0).collect())) == plain_top(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_archive_round_trip(spark):
    big = "<p>" + "é text " * 400
    rows = [(1, "http://a.example.org/x?b=1#f", big), (9, "http://a.example.org/x?b=1", big), (4, "https://B.example.org:8080/", big), (2, None, None), (3, "not a url\n\t", "short"), (5, "http://a.example.org/x?b=1", "short"), (None, "http://n.org", big), (6, "http://[bad", ""), (7, "http://c.org/é", "x" * 50_000), (7, "http://c.org/é", "x" * 50_000)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id bigint, url string, html string, keep int, key string")
    archive = warc.write_archive(pages)
    got = warc.lookup(archive, pages, id_col="page_id").collect()
    assert len(got) == len(rows)
    text = {(i, warc.url_key(u)): (h or "").encode() for i, u, h in rows}
    for r in got:
        data = text[r.page_id, r.url_key]
        again = data == big.encode() and r.page_id != 9
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if again else ("response", None))
        assert r.payload == (None if again else bytearray(data))
    by_url = warc.lookup(archive, spark.createDataFrame([("http://A.example.org/x?b=1",), ("http://none.org/",), ("http://A.example.org/x?b=1",)], "url string"))
    assert sorted(r.page_id for r in by_url.collect()) == [1, 5, 9]
    empty = warc.write_archive(pages.limit(0))
    assert warc.lookup(empty, pages).count() == 0


def test_busy_url_spans_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 16)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 7}.org/{i}", f"page {i}") for i in range(900)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert len(archive.files) > 1
    got = warc.lookup(archive, spark.createDataFrame([("http://hot.org/",), ("http://h0.org/0",)], "url string")).collect()
    assert sorted(r.page_id for r in got) == sorted([i for i in range(900) if i % 3] + [0])


def test_url_keys():
    assert warc.url_key("http://www.Example.org/a?b=c#d") == "org,example,www)/a?b=c"
    assert warc.url_key("https://example.org:81") == "org,example:81)/"
    assert warc.url_key(None) == ")" and warc.url_key("x y") == ")x%20y"


PAGE = """<!doctype html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header class="site-header"><h1>Site</h1><ul><li><a href=/>Home</a><li><a>About</a></ul></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div><div class="wrap"><div class="col"><h2>Title {n} &lt;b&gt;</h2><p>First para with <a href=x>link</a> and <b>bold</b>text &nbsp; here &#233;t&eacute; {n}.<p>Second <em>para</em><br>of the text, long enough.{more}<ul><li>item one is long<li>item two is {n}</ul></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a>One</a><li><a>Two</a></ul></div></div><!-- c --><form><label>Name</label><textarea>abc</textarea></form><div id="comments"><div class=comment><p>Great post {n}!</p></div></div><footer>&copy; me</footer><style>p{{}}</style></body></html>"""


def page_rows():
    rows = [(i, f"http://one.org/{i}", PAGE.format(n=i, more="<table><tr><td>a<td>b</table>" if i % 2 else "")) for i in range(14)]
    want = {i: f"Title {i} <b> First para with link and boldtext here été {i}. Second para of the text, long enough.{' a b' if i % 2 else ''} item one is long item two is {i}" for i in range(14)}
    article = "<body><nav>Menu</nav><article><header><h1>Head {n}</h1><p>by me</p></header><p>Text {n}.</p><aside>Ad</aside><p>More&amp;more</p><section class=comments><p>first!</p></section></article><footer>f</footer>"
    rows += [(100 + i, f"https://Two.org:80/{i}", article.format(n=i)) for i in range(3)]
    want |= {100 + i: f"Head {i} Text {i}. More&more" for i in range(3)}
    rows += [(200, "http://t.org", ""), (201, None, None), (202, "nonsense", "plain a &lt; b < c text"), (203, "http://d.org", "<div>" * 3000 + "deep" + "</div>" * 3000), (204, "http://r.org", "<p>x</p>"), (204, "http://r.org", "<p>x</p>"), (None, "http://s.org", "<script>a")]
    want |= {200: "", 201: "", 202: "plain a < b < c text", 203: "deep", 204: "x", None: ""}
    return rows, want


def test_main_text(spark):
    rows, want = page_rows()
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id bigint, url string, html string, host string, text string")
    got = wrapper.main_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert wrapper.main_text(pages.limit(0)).count() == 0


def test_wrappers_do_not_depend_on_the_split(spark):
    rows, _ = page_rows()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    a, b = ({r.host: (r.pages, r.rule) for r in wrapper.wrappers(pages.repartition(n)).collect()} for n in (1, 9))
    assert a == b and a["one.org"][0] == 14


def test_wrapper_marks():
    pages = ["<ul><li>a</ul><p>x", "<ul><li>b<li>c</ul>", "<ul><li>b</ul><h2>q</h2><p>y<h2>r</h2><p>z"]
    tree = wrapper.shape(wrapper.parse(pages[0]))
    for p in pages[1:]:
        tree = wrapper.align(tree, wrapper.shape(wrapper.parse(p)))
    text = wrapper.expression(tree)
    assert text.startswith("<ul>(<li>#</li>)+</ul>") and "(<h2>#</h2> <p>#</p>)*" in text and "(<p>" in text and "|" not in text


def main_texts(pages):
    """Texts of one host's pages, without Spark."""
    tree = wrapper.shape(wrapper.parse(pages[0]))
    for p in pages[1:]:
        tree = wrapper.align(tree, wrapper.shape(wrapper.parse(p)))
    kept = wrapper.pruned(wrapper.rule(tree))
    return [wrapper.extract(p, kept) for p in pages]


def test_omitted_end_tags_of_left_out_elements():
    assert main_texts(["<html><head><title>t</title><meta name=a><script>x</script><body><article><p>a</article>"]) == ["a"]
    assert main_texts(["<head><title>t</title><p>a"]) == ["a"] and main_texts(["<head><title>t</title></head><p>a"]) == ["a"]
    assert main_texts(['<p>a <svg class="i"/> b <math/> c</p><p>d<svg><path/><g><text>no</text></g></svg>e</p>']) == ["a b c de"]
    assert main_texts(["<p>a<svg><g>no<p>b</p><p>c <select><option>no</p><p>d</p><template><p>no</p></template><p><video>no</p>e"]) == ["a b c d e"]
    assert main_texts(["<p>a</p><script>no <p>no</p>"]) == ["a"]


def test_text_behind_deep_parts():
    for n in (50, 150, 3000):
        assert main_texts(["<div><article><p>a</p>" + "<div>" * n + "<p>in</p>" + "</div>" * n + "<p>b</p></article></div>"]) == ["a in b"]
        assert main_texts(["<article><p>a</p>" + "<ul><li>" * n + "in" + "</ul>" * n + "<p>b</p></article>"]) == ["a in b"]


def test_nested_groups_keep_all_texts():
    body = "".join(f"<h2>h{i}</h2><p>p{i}</p><h2>i{i}</h2><p>q{i}</p><ul><li>l{i}</ul><table><tr><td>t{i}</table>" for i in range(2))
    want = " ".join(f"h{i} p{i} i{i} q{i} l{i} t{i}" for i in range(2))
    assert main_texts([f"<article>{body}</article>"]) == [want]
    assert main_texts([f"<article>{body}</article>", "<article><h2>a</h2><p>b</p></article>"]) == [want, "a b"]
    kept = wrapper.rule(wrapper.shape(wrapper.parse("<article><p>a</p></article>")))
    assert wrapper.extract("<article><p>x</p><pre>y<nav>n</nav></pre></article>", kept) == "x y"


def test_class_words_do_not_drop_whole_pages():
    inner = "<h1>Head</h1><p>Text of the page, long enough.</p><div class='related-posts'><p>more</p></div>"
    want = ["Head Text of the page, long enough."]
    assert main_texts([f'<html class="no-ads"><body class="has-sidebar sidebar"><article>{inner}</article></body></html>']) == want
    assert main_texts([f'<body><div class="content no-sidebar">{inner}</div><div class="sidebar-left"><p>x</p></div></body>']) == want
    assert main_texts([f'<body><article class="post category-social comments-open">{inner}</article><div class="comments"><article class="comment"><p>first</p></article></div></body>']) == want
    assert main_texts([f'<div class="banner"><main class="skip-social">{inner}</main></div><p>x</p>']) == want
    assert main_texts([f'<div class="alert-wrap"><div>{inner}</div></div><p>x</p>']) == want
    assert main_texts(["<form><div><p>all in a form</p></div></form>", "<form><div><p>other text</p></div></form>"]) == ["all in a form", "other text"]
    assert main_texts(["<article><ul><li><a>One link</a><li><a>Two</a></ul></article>"]) == ["One link Two"]
    assert main_texts(["<nav><a>Menu</a></nav>"]) == [""]


@pytest.mark.parametrize("notice", ["Short notice.", "A long notice about the terms. " * 20])
def test_template_texts(notice):
    notice = notice.strip()
    page = lambda i: f"<body><article><h2>Head {i}</h2><div class='x'>{notice}</div><p>Text {i} of the page.</p></article></body>"
    want = [f"Head {i} Text {i} of the page." for i in range(12)]
    pages = [page(i) for i in range(12)]
    assert main_texts(pages) == want
    assert main_texts([*pages, "", "<!-- -->"]) == [*want, "", ""]
    assert main_texts([*pages, "<body><article><h2>Other</h2><p>Page.</p></article></body>"]) == [*want, "Other Page."]
    assert all(main_texts(pages[:n]) == want[:n] for n in (2, 5, 9, 10))  # no number of pages is a border
    near = [f"<body><article><h2>Head {i}</h2><p>{notice}</p><div>One.</div><p>Two.</p></article></body>" for i in range(3)]
    assert main_texts(near) == [f"Head {i} {notice} One. Two." for i in range(3)]  # near copies lose nothing
    rows = "".join("<tr><td>yes</table>" if k == 14 else "<tr><td>yes" for k in range(15))
    assert main_texts([f"<article><p>Text {i}.</p><table>{rows}</article>" for i in range(2)]) == [f"Text {i}. " + " ".join(["yes"] * 15) for i in range(2)]


def test_host_wrappers_know_more_than_one_page_does():
    """Unmarked templates with optional and repeated parts: one page alone cannot tell notices from the article."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    pages, want = [], []
    for i in range(8):
        head, body = f"Story {word()}", [" ".join(word() for _ in range(20)) for _ in range(r.randint(1, 5))]
        items = [word() for _ in range(r.randint(0, 4))]
        by = f"<b>By {word()}</b>" if i % 3 else ""
        pages.append(
            f"<body><div class='ka'><h1>{head}</h1>{f'<div class=kb>{by}</div>' if by else ''}<div class='kc'>All rights are with us and you may write to us at any time.</div>"
            f"{''.join(f'<p>{p}</p>' for p in body)}{'<ul>' + ''.join(f'<li>{x}</li>' for x in items) + '</ul>' if items else ''}<div class='kd'>Thank you for being with us today.</div></div></body>"
        )
        want.append(" ".join([head, *([by[3:-4]] if by else []), *body, *items]))
    assert main_texts(pages) == want
    assert all(t not in want and "Thank you" in t for p in pages for t in main_texts([p]))


@pytest.mark.parametrize("bad", ["<a", "<a ", '<a "', "<a '", "<!--", "<script", "<!x", '<a "\'>"', "</", "<a b='>", "<a" * 2 + ">"])
def test_unfinished_tags_take_linear_time(bad):
    page = "<body><article><p>Before it all.</p>" + bad * (1_000_000 // len(bad))
    start = time.time()
    tokens = sum(1 for _ in wrapper.tokens(page))
    assert time.time() - start < 2 and tokens > 3
    end = page + "</article></body>"
    start = time.time()
    assert sum(1 for _ in wrapper.tokens(end)) > 3 and time.time() - start < 2
    assert wrapper.parse("<p>x</p>" + "<" + "a" * 1_000_000)


def test_tokens_of_broken_pages():
    texts = lambda page: [block for block in main_texts([page])]
    assert texts("<article><p>a 1 < 2</p><p>b <c</p></article>") == ["a 1 < 2 b"]
    assert texts("<article><p>one</p><p>two <!-- gone </p></article>") == ["one two"]
    assert texts('<article><p title="x>y">one</p><p title="x>two</p><p>three</p></article>') == ["one two three"]
    assert texts("<article><p>tail</p> and a < b <i") == ["tail and a < b <i"]


def test_licence_forms(spark):
    mit = licence_texts.MIT
    changed = "Copyright (c) 2020 Some One <a@b.c>\n\n" + mit.upper().replace('"AS IS"', "“as is”").replace("\n\n", "\n") + "\n"
    rows = [(1, mit), (2, changed), (3, "My poem.\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0\n"), (4, mit + " extra"), (5, ""), (6, None), (None, mit), (7, "***"), (8, "Released under the MIT License."), (8, "Released under the MIT License."), (9, "x " * 500_000)]
    texts = spark.createDataFrame([(*r, "d", "l", "n") for r in rows], "doc_id bigint, text string, digest string, licence string, notices string")
    known = spark.createDataFrame([*licence_texts.KNOWN, (None, "x"), ("E", ""), ("E", None)], "licence_id string, text string")
    got = licences.scan(texts, known).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].licence for i in (1, 2, 3, 4, None, 8)] == ["MIT", "MIT", None, None, "MIT", "MIT"]
    assert by[3].notices == ["CC-BY-NC-4.0", "MIT"] and by[8].notices == ["MIT"] and by[9].notices == []
    assert by[5].digest is by[6].digest is by[7].digest is None and by[1].digest == by[2].digest != by[4].digest
    assert licences.scan(texts.limit(0), known).count() == 0
    assert {r.licence for r in licences.scan(texts, known.limit(0)).collect()} == {None}


CALLS = "conv_id bigint, call_id string, turn int, tool string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, call_id string, turn int, content string"
SCHEMAS = "tool string, parameter string, type string, required boolean"


@pytest.fixture
def tools(spark):
    rows = [("f", "a", "integer", True), ("f", "b", "string", False), ("f", "c", "array", None), ("f", "b", "string", False), ("g", None, None, None), (None, "x", "string", True)]
    return spark.createDataFrame(rows, SCHEMAS)


def test_links_errors_and_json(spark, tools):
    calls = [
        (1, "x", 1, "f", '{"b": "t", "a": 5}', None), (1, "y", 3, "f", '{"a": "5", "z": 1, "c": [1]}', ["x", "gone"]), (1, "w", 2, "g", "{}", ["y"]), (1, None, 4, "g", "{}", None), (2, "x", 1, "f", "[1]", []),
        (2, "q", 1, "h", "{}", None), (2, "r", 1, "f", "{bad", None), (2, "s", None, "f", None, [None]), (None, "x", 1, "f", '{"a":1,"a":2}', None), (1, "x", 1, "f", '{"b": "t", "a": 5}', None),
    ]
    results = [(1, "x", 2, '{"k": [2, 1], "a": null}'), (1, "x", 5, "later"), (3, "o", 1, "orphan"), (2, "s", 2, None), (None, "x", 2, "text")]
    c = spark.createDataFrame([(*r, 1, "m") for r in calls], CALLS + ", k int, errors string")
    got = toolcalls.link(c, spark.createDataFrame(results, RESULTS), tools).collect()
    assert len(got) == len(calls) + 1
    by = {(r.conv_id, r.call_id): r for r in got}
    x = by[1, "x"]
    assert (x.status, x.results, x.result_turn, x.valid) == ("linked", 2, 2, True)
    assert x.message == '{"call":{"arguments":{"a":5,"b":"t"},"id":"x","tool":"f","turn":1},"conversation":1,"result":{"content":{"a":null,"k":[2,1]},"id":"x","turn":2}}'
    assert by[1, "y"].errors == ["unknown z", "not integer: a", "needs unknown gone"]
    assert by[1, None].status == "no id" and by[1, "w"].status == "no result" and by[1, "w"].valid
    assert (by[1, "y"].order_turn, by[1, "y"].order_step, by[1, "w"].order_turn, by[1, "w"].order_step) == (3, 0, 3, 1)
    assert by[2, "x"].errors == ["arguments are no object"] and by[2, "q"].errors == ["unknown tool"]
    assert by[2, "r"].errors == by[None, "x"].errors == ["arguments are not JSON"] and by[2, "s"].errors == ["no arguments"]
    assert by[3, "o"].status == "no call" and json.loads(by[3, "o"].message)["result"]["content"] == "orphan"
    assert by[None, "x"].status == "linked" and by[2, "s"].status == "linked"


NUMBERS = ["1", "1.0", "1e0", "10e-1", "100", "1e2", "1.00E+2", "1.5", "1.50", "15e-1", "0", "-0", "0.0", "0e5", "-2.50", "1e-7", "0.0000001", "18446744073709551616", "1.8446744073709551616e19", "12345678901234567890123456789012345678",
           "123456789012345678901234567890123456789", "1.23456789012345678901234567890123456789e38", "1e400", "10e399", "-1e400", "1e-400", "0.5e400", "1.25e1", "1e38", "1e37", "1e39", "123456789012345678901234567890.123456789012345"]


def test_equal_numbers_are_written_alike(spark):
    df = spark.createDataFrame([(x, f'[{x}, {{"b": {x}, "a": "{x} \\" {x}"}}]') for x in NUMBERS], "x string, text string")
    got = {r.x: r.json for r in df.select("x", toolcalls.canonical_json(F.col("text")).alias("json")).collect()}
    forms = {}
    for x, text in got.items():
        number = text[1 : text.index(",")]
        assert text == f'[{number},{{"a":"{x} \\" {x}","b":{number}}}]'  # numbers in strings stay
        assert Decimal(number) == Decimal(x) and " " not in number
        forms.setdefault(Decimal(x), set()).add(number)
    assert all(len(f) == 1 for f in forms.values()) and forms[Decimal(1)] == {"1"} and forms[Decimal(100)] == {"100"} and forms[Decimal(0)] == {"0"}
    assert forms[Decimal(2**64)] == {str(2**64)} and forms[Decimal("1e400")] == {"1e400"} and forms[Decimal("1e-7")] == {"0.0000001"}
    bad = spark.createDataFrame([(x,) for x in ("01.0", "1.", "1.e5", ".5e1", "-", "1.5.2", "1e999999999999999999999", '"1.50', "", "1.50 x", "{} {", "1] x [2", '1} x {"v":2', '1, "w": 2', "1, 2", "null", " [ 1 ]\n", None)], "text string")
    assert [r[0] for r in bad.select(toolcalls.canonical_json(F.col("text"))).collect()] == [None] * 6 + ["1e999999999999999999999"] + [None] * 8 + ["null", "[1]", None]
    long = spark.createDataFrame([('{"t": "' + "1.0 \\\\n" * 300_000 + '", "n": 2.0}',)], "text string").select(toolcalls.canonical_json(F.col("text"))).first()[0]
    assert long.startswith('{"n":2,') and len(long) > 300_000 * 5


def test_types_and_allowed_values(spark):
    rows = [("f", "n", "integer|null", True, None), ("f", "x", "number", False, None), ("f", "s", "string", False, ['"a"', "1.0", '{"b": 2e0, "a": []}', "{bad"]), ("f", "e", "array|object|integer", False, []), ("f", "u", "unheard", False, None)]
    tools = spark.createDataFrame(rows, SCHEMAS + ", allowed array<string>")
    mark = hashlib.md5(b"x").hexdigest()
    given = {
        '{"n": 1.0}': [], '{"n": 1e2}': [], '{"n": 18446744073709551616}': [], '{"n": 1e400, "x": 1.5e400}': [], '{"n": null}': [], '{"n": 1.5}': ["not integer|null: n"], '{"n": 1e-400}': ["not integer|null: n"], '{"n": 1.25e1}': ["not integer|null: n"],
        '{"n": 1, "x": 12345678901234567890123456789012345678.25}': [], '{"n": 1, "x": "1.0"}': ["not number: x"], f'{{"n": "#number {mark} 1e400"}}': ["not integer|null: n"], '{"n": 1, "s": "a"}': [], '{"n": 1, "s": 1}': ["not string: s"],
        '{"n": 1, "s": "b"}': ["not allowed: s"], '{"n": 1, "s": {"a": [], "b": 2.0}}': ["not string: s"], '{"n": 1, "e": 2}': ["not allowed: e"], '{"n": 1, "e": true}': ["not array|object|integer: e", "not allowed: e"], '{"n": 1, "u": 5}': [], '{"x": 1}': ["missing n"],
    }
    calls = spark.createDataFrame([(i, "c", 1, "f", a, None) for i, a in enumerate(given)], CALLS)
    results = spark.createDataFrame([(i, "c", 2, "2.50") for i in range(len(given))], RESULTS)
    got = {r.conv_id: r for r in toolcalls.link(calls, results, tools, allowed_col="allowed").collect()}
    assert [got[i].errors for i in range(len(given))] == list(given.values())
    assert '"arguments":{"n":1e400,"x":1.5e400}' in got[3].message and f'{{"n":"#number {mark} 1e400"}}' in got[10].message
    assert all('"content":2.5,' in r.message for r in got.values())


def test_places_follow_dependencies(spark, tools):
    r = random.Random(6)
    calls, needs = [], {}
    for conv in range(12):
        ids = list(range(10))
        rank = r.sample(ids, 10)  # a hidden order; dependencies point back in it
        for n, i in enumerate(rank):
            needs[conv, i] = r.sample(rank[:n], min(n, r.randint(0, 3)))
            calls.append((conv, f"c{i}", i, "g", "{}", [f"c{j}" for j in needs[conv, i]]))
    # one long chat in which each call needs the next one, but for some that come late enough
    n = 300
    calls += [(40, f"l{i}", i, "g", "{}", [f"l{i + 1}"] if i < n - 1 and i % 100 != 60 else None) for i in range(n)]
    n = 40
    calls += [(41, f"m{i}", i * 7 % n, "g", "{}", [f"m{i + 1}", f"m{(i * 3 + 5) % n}"] if i < n - 1 and (i * 3 + 5) % n > i else [f"m{i + 1}"] if i < n - 1 else []) for i in range(n)]
    calls += [(50, "a", 1, "g", "{}", ["b"]), (50, "b", 2, "g", "{}", ["a"]), (50, "c", 3, "g", "{}", ["b"]), (50, "d", 4, "g", "{}", None), (51, "s", 1, "g", "{}", ["s"])]
    got = {(x.conv_id, x.call_id): x for x in toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), tools).collect()}
    for (conv, i), before in needs.items():
        own = got[conv, f"c{i}"]
        assert all((got[conv, f"c{j}"].order_turn, got[conv, f"c{j}"].order_step) < (own.order_turn, own.order_step) for j in before) and not own.in_cycle
    for conv, c, _, _, _, before in calls:
        if conv in (40, 41):
            own = got[conv, c]
            assert not own.in_cycle and all((got[conv, b].order_turn, got[conv, b].order_step) < (own.order_turn, own.order_step) for b in before or [])
    assert (got[40, "l0"].order_turn, got[40, "l0"].order_step) == (60, 60)
    assert [got[50, x].in_cycle for x in "abcd"] == [True, True, False, False] and got[51, "s"].in_cycle
    assert toolcalls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), tools).count() == 0
