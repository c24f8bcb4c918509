"""Embeddings, pages and archives."""

import gzip
import json
import time
import zlib

import numpy as np
import pytest
import zstandard

from barloom.llm import cap_filters, components, html_layout, warc


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    pick = np.random.default_rng(5)
    base = pick.standard_normal((60, 16))
    near = np.concatenate([base, base[:40] + 0.08 * pick.standard_normal((40, 16)), base[:30] * 3, np.repeat(base[:1], 20, axis=0)])
    vectors = [(k, [float(x) for x in v], "x") for k, v in enumerate(near)]
    odd = [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [1.0, None] * 8, "x"), (903, [float("nan")] * 16, "x"), (904, [], "x"), (905, [float("inf")] * 16, "x"), (906, [1.0, 2.0], "x"), (None, vectors[0][1], "x")]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, rep string").repartition(3)
    got = {r.vec_id: r for r in cap_filters.near_duplicates(df).collect()}
    unit = cap_filters.unit(near)
    linked = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    label = np.arange(len(unit))
    for _ in range(len(unit)):
        label = np.array([min([label[k], *label[linked[k]]]) for k in range(len(unit))])
    assert [tuple(got[k])[:3] for k in range(len(unit))] == [(k, linked[k].sum(), label[k]) for k in range(len(unit))]
    assert all(tuple(got[k]) == (k, 0, k, True) for k in range(900, 907))
    assert tuple(got[None]) == (None, 0, None, False)
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0


def test_layout():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><h1>Salt &amp; more</h1><p>One <b>two
 three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><table><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig</td><td>22</td></table>
<div hidden>no</div><div style="display: none">no</div><script>var a="</p>";</script>tail<pre> a
   b</pre><details><summary>S</summary>inner</details></body></html>"""
    assert html_layout.visible_text(page).split("\n") == [
        "Salt & more", "", "One two three", "", "Four", "five", "", "- a", "- b", "", "  3. x", "  4. y", "",
        "Name   N", "apple  1", "fig    22", "", "tail", "", " a", "   b", "", "S",
    ]
    for odd in ["<p", "<<<>>>", "<a href='x", "</p></div>", "<table><td>x<table><td>y", "<li>" * 3000 + "deep", "<div>" * 5000 + "t", "a<!-- x"]:
        assert isinstance(html_layout.visible_text(odd), str)
    assert html_layout.visible_text("<div>" * 5000 + "t") == "t"


def test_text_of_formulas_and_drawings():
    text = html_layout.visible_text
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mi>a</mi><mn>2</mn></mfrac></math> holds") == "so x= a 2 holds"
    assert text("<math><semantics><mrow><mi>y</mi></mrow><annotation>\\y</annotation></semantics></math>") == "y"
    assert text("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>") == "1 2"
    drawing = """<svg><title>T</title><desc>D</desc><style>a{}</style><defs><text>later</text></defs><path d="M0"/><g><rect/>
<text x=1>Sales <tspan>2020</tspan></text><text>Costs</text><text display="none">no</text></g></svg>"""
    assert text(f"<div>Chart {drawing} end</div>") == "Chart Sales 2020 Costs end"
    assert text("<svg>" + "<path d='M0'/>" * 400 + "<text>deep</text></svg>") == "deep"
    assert text("<svg>" + "<g>" * 400 + "<text>very <tspan>deep</tspan></text>") == "very deep"
    assert text("<svg><foreignObject><div>in</div><p>it</p></foreignObject><text>z</text></svg>").split() == ["in", "it", "z"]
    assert text("<svg><path d='M0'><p>after") == "after"
    assert text("<math><mi>x<div>after") == "x\nafter"
    assert text("<p>a<svg/>b<math/>c") == "abc"


def test_open_head_ends_at_its_first_content():
    head = "<html><head><meta charset=x> <title>T</title>\n<style>p{}</style><script>1</script><link href=x>\n"
    for rest in ["a <b>b</b><p>c", "<span>a</span> b<p>c", "<a href=x>a</a> <i>b</i><p>c", "a b<br>c", "<b>a</b> b<li>c", "<img src=x>a b<p>c"]:
        assert html_layout.visible_text(head + rest).replace("- ", "").split() == ["a", "b", "c"]
    assert html_layout.visible_text(head + "only") == "only"
    assert html_layout.visible_text(head + "<select><option>one</select>") == "one"
    assert html_layout.visible_text(head + "<noscript><img src=x>no</noscript><meta name=a></head><body>yes") == "yes"
    assert html_layout.visible_text(head + "<template><b>no</b></template>yes") == "yes"
    assert html_layout.visible_text("<p>a<head>b") == "ab"


def test_tables_with_spans_and_wide_cells():
    lines = lambda page: html_layout.visible_text(page).split("\n")
    assert lines("<table><tr><td rowspan=2>Fruit<td>fig<td>1<tr><td>plum<td rowspan=0>2<tr><td colspan=2>sum<tr><td>x<td>y</table>") == [
        "Fruit  fig   1", "       plum  2", "sum", "x      y",
    ]
    assert lines("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>") == ["a  b", "c  d"]
    assert lines("<table><tr><td colspan=300>a<td>b<tr><td>c<td>d</table>") == ["a     b", "c  d"]
    wide = "one two three four five six seven eight nine ten eleven"
    assert lines(f"<table><tr><td>{wide}<td>1<tr><td>x<td>2</table>") == [
        "one two three four five six seven eight  1", "nine ten eleven", "x" + " " * 40 + "2",
    ]
    assert lines(f"<table><tr><td>{'w' * 50}<td>1<tr><td>xyz<td>{wide}</table>") == ["w" * 50, "     1", "xyz  " + wide]
    started = time.time()
    html_layout.visible_text("<table>" + ("<tr>" + "<td colspan=1000 rowspan=60000>a" * 100) * 100 + "</table>")
    assert time.time() - started < 5


def test_rendered(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (1, "<p>a<p>b", "x"), (2, None, "x"), (None, "", "x")], "page_id long, html string, text string")
    got = sorted(map(str, map(tuple, html_layout.rendered(pages).collect())))
    assert got == sorted(map(str, [(1, "a\n\nb", 3), (1, "a\n\nb", 3), (2, "", 0), (None, "", 0)]))
    assert html_layout.rendered(pages.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("http://a/\r\nx", "<p>Hé<p>there"), (None, None)], "url string, html string")
    records = warc.responses(pages)
    derived = warc.derivatives(records).collect()
    assert len(derived) == 4 and len({r.record_id for r in derived}) == 4
    responses = {warc.value_of(warc.read_record(bytes(r.record))[0], "WARC-Record-ID") for r in records.collect()}
    for row in derived:
        headers, block = warc.read_record(bytes(row.record))
        assert block == bytes(row.block) and row.refers_to in responses
        assert warc.value_of(headers, "WARC-Refers-To") == row.refers_to
        assert warc.value_of(headers, "WARC-Block-Digest") == row.block_digest == warc.digest(block)
        assert row.warc_date == "1970-01-01T00:00:00Z" and row.target_uri in ("http://a/ x", "")
    texts = {bytes(r.block).decode() for r in derived if r.warc_type == "conversion"}
    assert texts == {"Hé\n\nthere", ""}
    about = [json.loads(bytes(r.block)) for r in derived if r.warc_type == "metadata"]
    assert all(["Content-Type", "text/html; charset=utf-8"] in a["headers"] for a in about)
    warc.write_archive(spark.createDataFrame(derived), str(tmp_path / "out"))
    back = [gzip.decompress(bytes(r.record)) for r in warc.read_archive(spark, str(tmp_path / "out")).collect()]
    assert sorted(back) == sorted(bytes(r.record) for r in derived)


def test_derivatives_of_odd_records(spark):
    whole = warc.to_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none-such\r\n\r\nhi")
    records = [whole, whole, gzip.compress(whole), gzip.compress(whole)[:20], b"", None, b"junk", warc.to_record([("WARC-Type", "warcinfo")], b"x"), warc.to_record([("WARC-Type", "response")], b"no http")]
    got = warc.derivatives(spark.createDataFrame([(bytearray(r) if r is not None else None,) for r in records], "record binary")).collect()
    assert len(got) == 8 and sum(bytes(r.block) == b"hi" for r in got) == 3
    assert warc.derivatives(spark.createDataFrame([], "record binary")).count() == 0


def test_conversion_undoes_codings_and_goes_by_type():
    def kinds(headers, body, first="HTTP/1.1 200 OK"):
        http = "\r\n".join([first, *headers, "", ""]).encode() + body
        rows = warc.derive(warc.to_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Payload-Digest", "sha1:SOURCE")], http))
        for row in rows:
            assert warc.value_of(warc.read_record(row["record"])[0], "WARC-Refers-To-Payload-Digest") == "sha1:SOURCE" == row["payload_digest"]
        return {r["warc_type"]: r["block"].decode() for r in rows}

    def text(headers, body):
        return kinds(headers, body).get("conversion")

    html, type_ = "<p>Hé<p>there".encode(), "Content-Type: text/html; charset=utf-8"
    chunks = lambda b: b"".join(b"%x;x=y\r\n%s\r\n" % (len(p), p) for p in (b[:3], b[3:])) + b"0\r\nTrailer: x\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(html) + raw.flush()
    want = "Hé\n\nthere"
    assert text([type_, "Transfer-Encoding: chunked"], chunks(html)) == want
    assert text([type_, "Transfer-Encoding: chunked"], html) == want
    assert text([type_, "Transfer-Encoding: gzip, chunked"], chunks(gzip.compress(html))) == want
    assert text([type_, "Content-Encoding: GZIP", "transfer-encoding: Chunked"], chunks(gzip.compress(html))) == want
    for coding, body in [("gzip", gzip.compress(html)), ("x-gzip", gzip.compress(html[:5]) + gzip.compress(html[5:])), ("gzip", html), ("deflate", zlib.compress(html)), ("deflate", raw), ("deflate", html), ("deflate, gzip", gzip.compress(raw)), ("zstd", zstandard.compress(html)), ("identity", html)]:
        assert text([type_, f"Content-Encoding: {coding}"], body) == want
    long = " ".join(f"word{k * k % 9973}" for k in range(20_000))
    cut = text([type_, "Content-Encoding: gzip"], gzip.compress(long.encode())[:20_000])
    assert len(cut) > 10_000 and long.startswith(cut)
    assert text(["Content-Type: text/plain"], b"a <b> c\n  d") == "a <b> c\n  d"
    assert text(["Content-Type: application/json"], b'{"a": "<b>"}') == '{"a": "<b>"}'
    assert text(["Content-Type: application/xhtml+xml"], html) == want
    assert text([], html) == want
    for headers, body in [(["Content-Type: image/png"], b"\x89PNG\r\n"), (["Content-Type: application/pdf"], b"%PDF-1.4"), ([type_, "Content-Encoding: br"], b"\x0b\x02"), ([], b"\x89PNG\0")]:
        assert list(kinds(headers, body)) == ["metadata"]
    assert json.loads(kinds([type_, "Transfer-Encoding: chunked"], chunks(html))["metadata"])["payload_length"] == len(html)


def test_pages_that_end_inside_tags():
    assert html_layout.visible_text("<p>a < b and c<d>e</d> then <a href='x") == "a < b and ce then"
    assert html_layout.visible_text("one <!-- never closed") == "one"
    started = time.time()
    assert html_layout.visible_text("x" + "<a " * 300_000) == "x"
    assert html_layout.visible_text("x<b>" + "<" * 300_000) == "x" + "<" * 300_000
    assert time.time() - started < 5


def test_damaged_archives_and_odd_charsets():
    def record(http):
        return warc.to_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], http)

    text = lambda r: [d["block"].decode() for d in warc.derive(r) if d["warc_type"] == "conversion"]
    page = record(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhi")
    for at in range(10, len(gzip.compress(page)), 3):
        damaged = bytearray(gzip.compress(page))
        damaged[at] ^= 0xFF
        assert isinstance(warc.derive(bytes(damaged)), list)
    for charset in ("idna", "undefined", "none-such", "hex", "utf-16", "punycode", "²"):
        assert len(text(record(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\nhi".encode()))) == 1
    for length in ("²", "9" * 5000, "-1", "x"):
        assert warc.read_record(f"WARC/1.1\r\nContent-Length: {length}\r\n\r\nabc".encode())[1] == b"abc"
    word = "Привет"
    assert text(record(b"HTTP/1.1 200 OK\nContent-Type: text/html\n\n<meta charset=windows-1251><p>" + word.encode("cp1251"))) == [word]
    assert text(record(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xef\xbb\xbf" + word.encode())) == [word]
    assert text(record(b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n\xff\xfe" + word.encode("utf-16-le"))) == [word]


def test_bodies_that_grow_too_large_have_no_conversion(monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 1 << 16)
    bomb = gzip.compress(b"a" * (1 << 20))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\n" + bomb
    got = warc.derive(warc.to_record([("WARC-Type", "response")], http))
    assert [r["warc_type"] for r in got] == ["metadata"]
    assert warc.derive(gzip.compress(warc.to_record([("WARC-Type", "response")], b"b" * (1 << 20)))) == []
    packed = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: zstd\r\n\r\n" + zstandard.compress(b"a" * (1 << 20))
    assert [r["warc_type"] for r in warc.derive(warc.to_record([("WARC-Type", "response")], packed))] == ["metadata"]
