import base64
import gzip
import hashlib
import json
import random
import re
import time

import pytest

from wattline.llm import warc

PAGE = "page_id long, url string, html string"
HTML = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; b</title><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- no --><p>One <b>bo</b>ld   é &lt;x&gt;<br>two</p><div>three<a href="/q?a=1&amp;b=2">l</a><img src='i.png'></div> 3 < 4</body></html>"""


def sha(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_links_digests_and_round_trip(spark, tmp_path):
    rows = [(1, "http://x.org/d/", HTML), (2, None, None), (3, "", ""), (None, "http://y", "plain"), (5, "bad\r\nurl", "<p>" + "w " * 100000), (1, "http://x.org/d/", HTML)]
    out = warc.derivatives(spark.createDataFrame(rows, PAGE), records=True).collect()
    assert len(out) == 6
    one = [r for r in out if r.page_id == 1]
    assert one[0] == one[1]
    r = one[0]
    assert r.text == "A & b\nOne bold é <x>\ntwo\nthreel\n3 < 4" and r.title == "A & b" and r.lang == "fr" and r.n_links == 2
    assert r.payload_digest == sha(HTML.encode()) and r.text_digest == sha(r.text.encode()) and r.metadata_digest == sha(r.metadata.encode())
    env = json.loads(r.metadata)["Envelope"]
    assert env["WARC-Header"]["WARC-Record-ID"] == r.response_id and env["Payload"]["Declared-Digest-Agrees"]
    assert [x["url"] for x in env["HTML"]["Links"]] == ["http://x.org/q?a=1&b=2", "http://x.org/d/i.png"]
    assert env["HTTP-Status"] == "HTTP/1.1 200 OK"
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(x) for r in out for x in (r.warc_response, r.warc_metadata, r.warc_conversion)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 18
    by_id = {g.record_id: g for g in got}
    for r in out:
        for kind, rid in (("metadata", r.metadata_id), ("conversion", r.conversion_id)):
            g = by_id[rid]
            assert g.record_type == kind and g.headers["WARC-Refers-To"] == r.response_id and g.headers["WARC-Block-Digest"] == sha(bytes(g.block))
        assert bytes(by_id[r.conversion_id].block).decode() == r.text
        assert by_id[r.response_id].headers["WARC-Payload-Digest"] == r.payload_digest


def test_gzip_members():
    a, b = warc.response("a", "http://a", b"x\r\n\r\ny", "d"), warc.response("b", None, b"", "d")
    got = list(warc.parse(a.compressed() + b.compressed()))
    assert [g.block for g in got] == [a.block, b.block] and warc.http_parts(got[0].block)[1] == b"x\r\n\r\ny"
    assert "WARC-Target-URI" not in got[1].headers


def test_empty(spark):
    assert warc.derivatives(spark.createDataFrame([], PAGE)).count() == 0


SKIP = r"(?is)<(?:!--.*?-->|(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|!doctype[^>]*>)"
LINK = r"""(?is)<(a|link|img|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANG = r"""(?is)<html[^>]*\blang\s*=\s*["']?([\w-]+)"""
BITS = ["<!--", "-->", "<script", "</script>", "</SCRIPT >", "<style>", "</style>", "<template", "<!doctype", ">", "<a ", "<img", " href=", " src = ", '"', "'", "x", "<title", "</title>", "<html", ' lang="fr"', "lang=de", " ", "<p>", "</p", "<", "&amp;", "<br/>", "<link\n", "=", "É"]


def test_scanning_equals_expressions_with_backtracking():
    rng = random.Random(9)
    for _ in range(20000):
        page = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 22)))
        bare = re.sub(SKIP, " ", page)
        assert warc.visible(page) == bare, page
        assert list(warc.page_links(page)) == [(t, a or b or c) for t, a, b, c in re.findall(LINK, page)], page
        title, lang = re.search(TITLE, page), re.search(LANG, page)
        assert (warc.page_title(page) is None) == (title is None) and warc.page_lang(page) == (lang[1] if lang else None), page


@pytest.mark.parametrize("part", ["<a ", "<script>", "<script", "<title>", "<!--", "<html ", "<a href=", '<img src="', "<template><p", "</p", "< a", "&", "<html lang"])
def test_unclosed_markup_takes_linear_time(part):
    page = part * (1_000_000 // len(part))
    began = time.perf_counter()
    source = warc.response("a", "http://a", page.encode(), "d")
    warc.derive(source)
    assert time.perf_counter() - began < 20


def test_ids_differ_where_pages_do(spark):
    rows = [(1, "http://a", "x"), (1, "http://a", "y"), (1, "http://b", "x"), (None, "http://a", "x"), (None, None, "x"), (None, None, "x")]
    out = warc.derivatives(spark.createDataFrame(rows, PAGE).withColumnRenamed("page_id", "__html"), id_col="__html").collect()
    assert len({r.response_id for r in out}) == 5 and len({r.metadata_id for r in out} | {r.conversion_id for r in out}) == 10


def test_files_to_derivatives_to_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x.org/{i}", f"<p>page {i} é") for i in range(20)] + [(None, None, None)], PAGE).repartition(3)
    one = warc.derivatives(pages, records=True)
    warc.write_warc(one.selectExpr("warc_response AS record"), str(tmp_path / "in"), gzip_=True)
    sources = warc.read_warc(spark, str(tmp_path / "in"), "part-*")
    two = warc.derivatives_of(sources, records=True)
    assert sorted(map(str, one.drop("page_id").collect())) == sorted(map(str, two.collect()))
    warc.write_derivatives(two, str(tmp_path / "out"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")))
    assert raw.count(b"WARC/1.0\r\n") == 42 and raw.endswith(b"\r\n\r\n") and b"\r\n\r\n\r\nWARC" not in raw.replace(b"\r\n\r\n\r\n\r\n", b"")
    back = warc.read_warc(spark, str(tmp_path / "out"), "part-*").collect()
    assert len(back) == 42 and {r.headers["WARC-Refers-To"] for r in back} == {r.response_id for r in one.collect()}
    assert all(r.headers["WARC-Block-Digest"] == sha(bytes(r.block)) for r in back)


def test_truncated_files_and_charsets():
    a, b = warc.response("a", "http://a", b"x" * 500, "d"), warc.response("b", None, b"y" * 500, "d")
    got = list(warc.parse((a.serialize() + b.serialize())[:-300]))
    assert len(got) == 2 and "WARC-Truncated" not in got[0].headers and got[1].headers["WARC-Truncated"] and got[1].block
    cut = gzip.compress(a.serialize() + b.serialize(), 0)[:-300]
    assert [bool(r.headers.get("WARC-Truncated")) for r in warc.parse(cut)][0] is False
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>\xe9t\xe9"
    assert warc.derive(warc.Record({"WARC-Type": "response"}, http))[3] == "été"
    assert warc.derive(warc.Record({"WARC-Type": "response"}, http.replace(b"ISO-8859-1", b"nonesuch")))[3] == "\ufffdt\ufffd"
    with pytest.raises(ValueError):
        list(warc.parse(b"garbage"))
