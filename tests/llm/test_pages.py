"""Main text and WARC archives."""

import base64
import gzip
import hashlib
import io
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from probestats.llm import html, shared, warc

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="home page"><header>Site<a href=/>home</a></header>
<div class="site-content"><div id=sidebar-left>aside text</div><%(tag)s class="post-%(n)d entry"><header><h1>T &eacute;<i>x</i></h1></header><p>One <b>two</b>
 three &lt;b&gt;<p>Four<br>five %(more)s<div class="ad-box">BUY</div><ul><li>a<li>b&nbsp;c</ul><form>f<input></form><div class="cookie-notice">n</div>
<script>if(a<b){"</p>"}</script><!-- no <p> --><table><tr><td>c1<td>c2</table></%(tag)s><div id="comments"><p>reader says a lot, much more than the article itself says in all its
blocks, again and again and again and again and again</div></div><nav>menu</nav><footer>foot &copy;</footer></body></html>"""
TEXT = "T éx One two three <b> Four five %s a b c c1 c2"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string, score int")


def test_article_only(spark):
    rows = [(i, f"http://www.h{i % 2}.org/{i}", PAGE % {"tag": "div", "n": i, "more": f"m{i}"}, "x", "y", 1) for i in range(6)]
    found = {r["page_id"]: r for r in html.main_text(pages(spark, rows)).collect()}
    for i in range(6):
        assert found[i]["text"] == TEXT % f"m{i}" and found[i]["n_chars"] == len(found[i]["text"]) and found[i]["agreed"]
        assert found[i]["path"] == "body.home.page>div.site-content>div.entry.post"  # numbers are left out of names


def test_host_overrules_a_page(spark):
    """A page whose longest text is elsewhere gets its text from where its host's other pages have it."""
    usual = "<body><div class=main><p>%s</div><div class=extra><p>x</div></body>"
    rows = [(i, "http://h.org/", usual % f"text {i} of a page that is long enough", None, None, None) for i in range(5)]
    rows += [(9, "http://h.org/", "<body><div class=main><p>short</div><div class=extra><p>something else that is very long here</div></body>", None, None, None)]
    rows += [(10, "http://h.org/", "<section>no such path here</section>", None, None, None), (11, "http://other.org", rows[-1][2], None, None, None)]
    found = {r["page_id"]: r for r in html.main_text(pages(spark, rows)).collect()}
    assert (found[9]["text"], found[9]["agreed"]) == ("short", True)
    assert (found[10]["text"], found[10]["agreed"]) == ("no such path here", False)
    assert found[11]["text"] == "something else that is very long here"


def test_the_hosts_path_leaves_no_article_text_behind(spark):
    """A page's own container that encloses the host's path and holds more of the article is taken."""
    usual = "<body><div class=page><article><p>{}</p></article></div></body>".format("Usual words of an article. " * 12)
    ends = "<body><div class=page><p>{}</p><article><p>{}</p></article></div></body>".format("First part of it. " * 40, "The end of the text. " * 12)
    teaser = "<body><div class=page><div class=body><p>{}</p></div><article><p>{}</p></article></div></body>".format("The whole story, told here. " * 100, "Read also this.")
    pages = spark.createDataFrame([(i, "http://a.org/x", usual) for i in range(5)] + [(8, "http://a.org/y", ends), (9, "http://a.org/z", teaser)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    assert got[0]["agreed"] and got[0]["path"] == "body>div.page>article"
    assert got[8]["text"] == " ".join(("First part of it. " * 40 + "The end of the text. " * 12).split())
    assert got[9]["text"].startswith("The whole story") and got[9]["n_chars"] > 2700


def test_appends_add_and_overwrites_replace(spark, folder):
    kinds = "record_id string, record_type string, payload binary"
    warc.register(spark)

    def write(mode, *ids):
        rows = spark.createDataFrame([(f"<urn:page:{i}>", "response", bytes([i])) for i in ids], kinds)
        columns = [F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split(" ") for x in warc.SCHEMA.split(", "))]
        rows.select(*columns).write.format("warc").mode(mode).save(folder)
        return sorted(bytes(r["payload"])[0] for r in spark.read.format("warc").load(folder).collect())

    assert write("append", 1, 2) == [1, 2]
    assert write("append", 3) == [1, 2, 3]
    assert write("overwrite", 4) == [4]
    assert write("append", 5, 6) == [4, 5, 6]
    assert len(list(Path(folder).glob("*.warc.gz"))) <= 3  # replaced files are gone


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    rows = [
        (1, None, None, None, None, None), (2, "", "", None, None, None), (3, "not a url", "plain & text <", None, None, None), (None, "http://a.org", "<p>x", None, None, None), (5, "http://a.org", "<p>x", None, None, None),
        (5, "http://a.org", "<p>x", None, None, None), (6, "http://b.org", deep, None, None, None), (7, "http://c.org", "<!-- never ends", None, None, None), (8, "http://d.org", "<script>never ends", None, None, None), (9, "http://e.org", "<div title='a>b", None, None, None),
        (10, "http://f.org", "</p></div><p>&#x41;&amp;&bogus;&am <a href=x>link</a>", None, None, None), (11, "http://g.org", "<p>" + "word " * 200_000, None, None, None),
    ]
    found = html.main_text(pages(spark, rows)).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert (text[1], text[2], text[3], text[5], text[6], text[7], text[8]) == ("", "", "plain & text <", "x", "deep text", "", "")
    assert text[10] == "A&&bogus;&am link" and len(text[11]) == 5 * 200_000 - 1 and Counter(r["page_id"] for r in found)[5] == 2
    assert html.main_text(pages(spark, [])).count() == 0


def test_given_pages(spark):
    """The given pages have one article each: its text, by plain patterns."""
    import re
    from html import unescape

    table = shared.table(spark, "/root/testdata/sf0.01", "pages")
    found = {r["page_id"]: r["text"] for r in html.main_text(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))
        assert found[r["page_id"]] == " ".join(unescape(plain).split())


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def test_round_trip(spark, folder):
    warc.register(spark)
    rows = [
        (3, "http://a.org/x", "same", None, None, None), (1, "http://a.org/y\r\nWARC-Type: forged", "same", None, None, None), (1, None, "same", None, None, None), (None, "u", "same", None, None, None), (2, "u", None, None, None, None), (4, "u", "", None, None, None),
        (None, "u", "only one", None, None, None), (7, "ü", "é\r\n\r\nWARC/1.1\r\n" * 9, None, None, None), (8, "u", "long " * 100_000, None, None, None), (-5, "u", "WARC-Type: response\r\n\r\n", None, None, None),
    ]
    warc.page_records(pages(spark, rows)).repartition(3).write.format("warc").mode("append").option("maxFileBytes", "500").save(folder)
    read = spark.read.format("warc").option("verify", "true")
    found = read.load(folder).select("*", warc.page_id_of("record_id").alias("page_id"), warc.page_id_of("refers_to").alias("first")).collect()
    want = Counter()
    for page, _, payload, *_ in rows:
        payload = payload or ""
        revisit = (payload == "same" and page != 1) or page == 4
        want[page, "revisit" if revisit else "response", (1 if payload == "same" else 2) if revisit else None, len(payload.encode()), "sha1:" + digest(payload), None if revisit else payload] += 1
    assert want == Counter((r["page_id"], r["record_type"], r["first"], r["payload_length"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in found)
    pushed = read.load(folder).where("record_type = 'revisit'")
    assert "Filter (" not in pushed._jdf.queryExecution().executedPlan().toString()
    assert pushed.count() == 3
    assert read.load(folder).where("record_type IN ('response') AND record_id = '<urn:page:7>' AND payload_length > 3").count() == 1
    assert spark.read.format("warc").option("recordType", "revisit").load(folder).count() == 3
    heads = spark.read.format("warc").option("payload", "false").load(folder).collect()
    assert all(r["payload"] is None for r in heads) and sorted(r["payload_length"] for r in heads) == sorted(r["payload_length"] for r in found)


def test_no_pages(spark, folder):
    warc.register(spark)
    warc.page_records(pages(spark, [])).write.format("warc").mode("append").save(folder)
    assert spark.read.format("warc").load(folder).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Records without skip lengths, and without compression, as other programs write them."""
    warc.register(spark)
    record = lambda i: warc.record_bytes({"record_id": f"<urn:page:{i}>", "record_type": "response", "payload": b"x" * (i * 10_000)})
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in [info, *map(record, range(4))]))
    (tmp_path / "b.warc").write_bytes(info + record(5) + record(6))
    found = {r["record_id"]: r for r in spark.read.format("warc").load(str(tmp_path)).collect() if r["record_id"]}
    assert {k: len(r["payload"]) for k, r in found.items()} == {f"<urn:page:{i}>": i * 10_000 for i in (0, 1, 2, 3, 5, 6)}
    assert spark.read.format("warc").load(str(tmp_path)).where("record_type = 'warcinfo'").count() == 2


def test_unwanted_payloads_are_not_read():
    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            data = super().read(n)
            self.got += len(data)
            return data

    import os

    rows = [{"record_id": f"<{i}>", "record_type": "response" if i % 2 else "revisit", "payload": os.urandom(400_000)} for i in range(10)]
    data = b"".join(warc.gzip_member(warc.record_bytes(r)) for r in rows)
    file = Counting(data)
    wanted = warc._Wanted({"record_id": ["<3>"]}, set())
    found = list(warc.records(file, len(data), wanted))
    assert len(found) == 1 and found[0][1].endswith(rows[3]["payload"]) and file.got < 400_000 * 1.5
    assert gzip.decompress(data).count(b"WARC/1.1") >= 10  # an ordinary gzip file
