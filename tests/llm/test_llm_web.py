"""Page extraction on hand-made pages, archives by exact round trip."""

import base64
import hashlib
import html
import io
import re
import zipfile

import pyarrow.parquet as pq
from fixtures_llm import SF

from strata.llm import zip_warc as zw
from strata.llm.queries import QUERIES
from strata.llm.tag_paths import extract_pages, main_text

LONG = "This is a sentence of the article, with commas, and it goes on for a while. It has a second sentence."


def pages():
    return pq.read_table(f"{SF}/pages.parquet").to_pylist()


def test_extraction_query_equals_the_article_element(spark):
    got = {r.page_id: r for r in QUERIES["op7_tag_paths"](spark, SF).collect()}
    assert len(got) == len(pages())
    for x in pages():
        body = re.sub(r"<[^>]*$", "", x["html"].partition("<article>")[2].partition("</article>")[0])
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|li|ul)>", body)]
        want = "\n".join(p for p in parts if p)
        assert got[x["page_id"]].text == want and got[x["page_id"]].n_chars == len(want) and got[x["page_id"]].url == x["url"]


def test_extraction_drops_what_is_not_the_article():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="page">
    <header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice"><p>{LONG}</p></div>
    <main><article class="post"><h1>Title &amp; more</h1><p>{LONG}</p><ul><li>one<li>two</ul><p>Short.</p>
    <div class="ad-box">Buy, now, here. Buy.</div><script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
    <blockquote>{LONG}</blockquote><table><tr><td>a<td>b</table><p>x&nbsp;y
    z &lt;b&gt; &#233;</p><form><p>Name, please.</p><input></form></article>
    <section id="comments"><h2>Comments</h2><p>{LONG}</p></section></main><aside><p>{LONG}</p></aside><footer>&copy; me, 2020.</footer></body></html>"""
    assert main_text(page).split("\n") == ["Title & more", LONG, "one", "two", "Short.", LONG, "a", "b", "x y z <b> é"]


def test_extraction_without_a_container_and_broken_pages():
    flat = f"<body><div id=menu><a>Home</a> <a>About</a></div><h1>Head</h1><p>{LONG}<p>{LONG}<div class=footer>c</div>"
    assert main_text(flat).split("\n") == ["Head", LONG, LONG]
    divs = f"<div><div><div>{LONG}</div><div>{LONG}</div><div>Yes.</div></div><div><a>one</a><a>two</a></div></div>"
    assert main_text(divs).split("\n")[:2] == [LONG, LONG]
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x") == ""
    assert main_text(f"<p>{LONG}</p><p>cut<a hr") == f"{LONG}\ncut"
    assert main_text("plain text, no tags.") == "plain text, no tags."
    assert main_text(f"<p>{LONG}</p><p title=\"a > b\">1 < 2 & 3</p>") == f"{LONG}\n1 < 2 & 3"


def test_extraction_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", f"<p>{LONG}</p>", "y"), (1, None, None, "x"), (2, "u", "<p>" * 3000 + LONG, "t")],
                               "page_id long, url string, html string, text string")
    rows = extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, LONG, len(LONG)), (1, "", 0), (1, "", 0), (2, LONG, len(LONG))]
    assert extract_pages(df.limit(0)).count() == 0


def digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(raw) if len(raw) >= least and i is not None and first.get(raw) != i else None
        out.append((i, len(raw), digest(raw), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_archive_query_is_a_whole_round_trip(spark):
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op8_zip_warc"](spark, SF).collect()]
    assert sorted(got, key=repr) == brute([(x["page_id"], x["url"], x["html"]) for x in pages()])


ODD = [(5, "http://a b/ü\r\n", "same"), (3, None, "same"), (9, "u", "same"), (4, "u", None), (6, "u", ""), (7, "u", "ö" * 50_000), (7, "u", "ö" * 50_000),
       (None, "u", "same"), (8, "u", "a\r\n\r\nb")]


def test_archives_odd_rows_limits_and_payloads(spark, tmp_path):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string")
    for least in (0, 10):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in zw.archive_round_trip(df, least).collect()]
        assert sorted(got, key=repr) == brute(ODD, least)
    assert zw.archive_round_trip(df.limit(0)).count() == 0
    planned = zw.plan_records(df.select(df.page_id.alias("id"), "url", df.html.cast("binary").alias("payload")))
    rows = zw.write_archives(planned.repartition(2), f"file://{tmp_path}/w", archive_bytes=300).collect()
    assert sum(r.records for r in rows) == len(ODD) and len(rows) > 2
    archives = spark.createDataFrame([(r.path, r.bytes) for r in rows], "path string, bytes long")
    for span in (64, 1 << 20):
        got = zw.read_records(archives, range_bytes=span).collect()
        assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted((h or "").encode() for i, _, h in ODD if i not in (5, 9, 6))
        assert len(got) == len(ODD)


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_directories_of_other_writers_and_zip64():
    own = b"".join(zw.zip_stored([("a.txt", [b"one", b"two"]), ("dir/b", [b""])]))
    with zipfile.ZipFile(io.BytesIO(own)) as z:
        assert z.testzip() is None and z.read("a.txt") == b"onetwo" and z.read("dir/b") == b""
    assert [(m.name, m.size) for m in zw.directory(Bytes(own), len(own))] == [("a.txt", 6), ("dir/b", 0)]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        for i in range(3):
            z.writestr(f"m{i}", b"x" * i)
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    f = Bytes(plain.getvalue())
    for m in zw.directory(f, len(f.raw)):
        at = zw.data_start(f, m)
        assert f.raw[at : at + m.size] == b"x" * int(m.name[1:])
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:  # more entries than 16 bits hold: Python writes ZIP64 records
        for i in range(65_600):
            z.writestr(f"{i}", b"")
    f = Bytes(many.getvalue())
    assert len(zw.directory(f, len(f.raw))) == 65_600
    for bad in (b"", b"PK\x05\x06", b"x" * 100):
        try:
            zw.directory(Bytes(bad), len(bad))
            raise AssertionError("accepted")
        except ValueError:
            pass
