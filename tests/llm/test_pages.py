import gzip
import random
import zlib
from html.parser import HTMLParser

import pytest
import zstandard

from corvane.llm import html_layout, warc_derivatives

PAGE = "<title>t</title><p>one</p><p>zwei é</p>"


def response(headers, payload):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + headers + "\r\n"
    return warc_derivatives.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>")], head.encode() + payload)


def conversion(raw):
    meta, conv = warc_derivatives.derive(raw)
    fields = warc_derivatives.parse_record(meta["record"])[1].decode()
    headers, body = warc_derivatives.parse_record(conv["record"])
    return body.decode(), headers.get("warc-truncated"), [x for x in fields.split("\r\n") if x.startswith("conversion-problem")], fields


def raw_deflate(data):
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize(
    "coding,payload",
    [
        ("gzip", gzip.compress(PAGE.encode())),
        ("gzip", gzip.compress(PAGE[:20].encode()) + gzip.compress(PAGE[20:].encode())),
        ("gzip", gzip.compress(PAGE.encode()) + b"\0" * 8),
        ("deflate", zlib.compress(PAGE.encode())),
        ("deflate", raw_deflate(PAGE.encode())),
        ("zstd", zstandard.compress(PAGE.encode())),
        ("gzip, deflate", zlib.compress(gzip.compress(PAGE.encode()))),
        ("identity", PAGE.encode()),
    ],
)
def test_codings_are_read_whole(coding, payload):
    assert conversion(response(f"Content-Encoding: {coding}\r\n", payload))[:3] == ("one\n\nzwei é", None, [])


def test_what_cannot_be_read_is_said():
    body, cut, problem, _ = conversion(response("Content-Encoding: br\r\n", b"\x8b\x02\x80abc\x03"))
    assert (body, cut, problem) == ("", "unspecified", ["conversion-problem: unknown content-encoding br"])
    whole = "<p>start</p>" + "".join(f"<p>{random.Random(k).random()}</p>" for k in range(5000))
    body, cut, problem, _ = conversion(response("Content-Encoding: gzip\r\n", gzip.compress(whole.encode())[:20000]))
    assert body.startswith("start\n\n0.8") and len(body) > 5000 and cut == "unspecified" and problem == ["conversion-problem: cut off"]


def test_payloads_are_bounded(monkeypatch):
    monkeypatch.setattr(warc_derivatives, "MOST_BYTES", 1000)
    for coding, packed in (("gzip", gzip.compress(b"a" * 10**6)), ("deflate", raw_deflate(b"a" * 10**6)), ("zstd", zstandard.compress(b"a" * 10**6))):
        assert warc_derivatives.unpacked(packed, coding) == (b"a" * 1000, "longer than is unpacked")


def test_repeated_headers_stay_apart():
    fields = conversion(response("Set-Cookie: a=1, x\r\nSet-Cookie: b=2\r\n", PAGE.encode()))[3]
    assert "source-http-set-cookie: a=1, x\r\nsource-http-set-cookie: b=2\r\n" in fields


def test_files_of_records(spark, tmp_path):
    records = [response("", f"<p>{k}</p>".encode()) for k in range(25)] + [warc_derivatives.write_record([("WARC-Type", "warcinfo")], b"WARC/1.1 in a block\r\n\r\n")]
    df = spark.createDataFrame([(bytearray(r), "x", 1) for r in records] + [(None, "x", 1)], "record binary, file string, offset int").repartition(3)
    index = warc_derivatives.write_warc(df, str(tmp_path / "w")).collect()
    assert len(index) == len(records)
    for r in index:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])) in records
    back = warc_derivatives.read_warc(spark, str(tmp_path / "w"))
    assert sorted(bytes(r["record"]) for r in back.collect()) == sorted(records)
    assert back.columns == ["file", "offset", "length", "record"]
    plain = b"".join(records)
    assert [plain[a : a + n] for a, n, _ in warc_derivatives.split_records(plain)] == records
    assert warc_derivatives.split_records(plain[:-30]) == warc_derivatives.split_records(plain)[:-1]
    assert warc_derivatives.split_records(b"") == []


@pytest.mark.parametrize(
    "html,text",
    [
        ("a<select><option>x<option>y</select>", "a\nx\ny"),
        ("<p>E <math><mi>m</mi><mo>=</mo></math> <svg><text>s</text></svg>", "E m= s"),
        ("<pre>a<span style='visibility:hidden'>no<b style='visibility:visible'>yes</b></span><i hidden>no</i></pre>", "ayes"),
        ("<div style='visibility:hidden'><pre>no<b style='visibility:visible'>yes</b></pre></div>", "yes"),
        (f"<table><tr><td>{'w' * 45}<td>1<tr><td>x<td>2</table>", f"{'w' * 45}  1\nx{' ' * 44}  2"),
        ("<table><tr><th colspan=2>a long heading over both<tr><td>a<td>b<tr><td>cc<td>d</table>", "a long heading over both\na   b\ncc  d"),
        ("<table><tr><th colspan=2>heading<th>z<tr><td>a<td>b<td>c</table>", "heading  z\na  b     c"),
        ("<table><tr>loose<td>a<td>b</table>", "loose  b\na"),
        ("<table><tr><td colspan=5000>a<tr><td rowspan=0>b<td>c</table>", "a\nb  c"),
    ],
)
def test_layout_of_hard_cases(html, text):
    assert html_layout.render(html) == text


class Words(HTMLParser):
    """The words outside hidden elements, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "template"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "template"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_all_visible_words_of_the_table(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        other = Words()
        other.feed(r["html"])
        got = html_layout.render(r["html"]).split()
        marks = {"-", *(f"{k}." for k in range(200))}
        assert [w for w in got if w not in marks] == [w for w in other.words if w not in marks]


def test_layout_frames(spark):
    rows = [(1, "<p>x"), (None, "<p>y"), (2, None), (3, ""), (1, "<p>x"), (4, "<b>" + "z " * 200_000)]
    df = spark.createDataFrame([(i, h, 7, "t", 8) for i, h in rows], "page_id long, html string, n_lines int, text string, n_chars int")
    got = sorted(((r["page_id"] or 0, len(r["text"]), r["n_lines"]) for r in html_layout.rendered(df).collect()))
    assert got == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 399_999, 1)]
    assert html_layout.rendered(df.limit(0)).count() == 0


def test_open_paragraphs_and_cells_are_looked_up():
    """Scopes are not searched for by walking over open elements."""
    import time

    from corvane.llm import html_layout

    for some in ("<p><button>" + "<div>" * 30_000, "<td>" + "<b>" * 20_000 + "</i>" * 20_000 + "</p>" * 20_000 + "<li>" * 20_000):
        began = time.process_time()
        html_layout.build_tree(some)
        assert time.process_time() - began < 15
