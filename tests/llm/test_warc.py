"""Derivatives against a plain version, files against other readers of the formats they are made of."""

import base64
import email.parser
import gzip
import hashlib
import html
import io
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from locuspark.llm import warc

sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def plain_record(raw: bytes):
    """Headers and block by the standard library's header parser."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    assert version == b"WARC/1.0"
    headers = email.parser.HeaderParser().parsestr(lines.decode())
    block = rest[: int(headers["Content-Length"])]
    assert rest[len(block) :] in (b"\r\n\r\n", b"")
    return headers, block


def made_page(rng):
    words = ["alpha", "été", "漢字", "AT&T", "a<b", "x"]
    said = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
    links = [f"/p?{i}&q={rng.randint(0, 9)}" for i in range(rng.randint(0, 3))]
    page = f"<html><head><title>{html.escape(said[0]) if said else ''}</title></head><body>" + "".join(f"<p>{html.escape(s)}</p>" for s in said) + "".join(f'<a href="{html.escape(x)}">l</a> ' for x in links)
    return page, said, links


def test_derivatives_equal_a_plain_version(spark, tmp_path):
    rng = random.Random(1)
    made = [made_page(rng) for _ in range(60)]
    rows = [(str(i), f"http://h{i % 3}.example/{i}", p) for i, (p, _, _) in enumerate(made)]
    pages = spark.createDataFrame([*rows, rows[5]], "page_id string, url string, html string").select("*", *(F.lit("clash").alias(c) for c in ("record", "source_key", "block")))
    places = warc.write(warc.derive(warc.responses(pages)), f"file://{tmp_path}/out", segment_bytes=3000).collect()
    got = warc.read(spark, f"file://{tmp_path}/out").collect()
    assert len(got) == len(places) == 2 * len(rows) + 2 and all(r["digest_holds"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_key"], r["warc_type"]), []).append(r)
    assert len(by["5", "metadata"]) == 2
    for (key, url, page), (_, said, links) in zip(rows, made, strict=True):
        headers, block = plain_record(warc.response(key, url, page))
        payload = block.partition(b"\r\n\r\n")[2]
        meta, text = by[key, "metadata"][0], by[key, "conversion"][0]
        assert meta["refers_to"] == text["refers_to"] == headers["WARC-Record-ID"] and meta["record_id"] != text["record_id"]
        assert meta["target_uri"] == text["target_uri"] == url and payload == page.encode()
        assert bytes(text["block"]).decode() == "\n".join([*said, " ".join("l" for _ in links)] if links else said)
        fields = [tuple(x.split(": ", 1)) for x in bytes(meta["block"]).decode().split("\r\n") if x]
        assert ("http-status", "HTTP/1.1 200 OK") in fields and ("source-payload-digest", sha1(payload)) in fields and ("source-block-digest", sha1(block)) in fields
        assert ("payload-digest-match", "true") in fields and [v for k, v in fields if k == "outlink"] == links
    # Each place is a gzip member of its own, that any reader can open.
    for p in places:
        whole = (tmp_path / "out" / p["segment"]).read_bytes()
        headers, block = plain_record(gzip.decompress(whole[p["offset"] : p["offset"] + p["length"]]))
        assert headers["WARC-Source-Key"] == p["source_key"] and headers["WARC-Block-Digest"] == sha1(block)


def crawled(head: str, body: bytes, *more: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\n{head}\r\n".encode() + body
    lines = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://a.example/", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(derived):
    return {k: [v for x, _, v in (line.partition(": ") for line in warc.parse(derived[0][5])[1].decode().split("\r\n")) if x == k] for k in ("warc-header", "undecoded", "http-header", "payload-digest-match")}


@pytest.mark.parametrize("encoding", ["", "gzip", "deflate", "raw", "chunked", "gzip chunked", "gzip undone"])
def test_bodies_are_decoded(encoding):
    page = "<p>Ça va</p>".encode("latin-1") * 50
    body, head = page, "Content-Type: text/html; charset=iso-8859-1\r\n"
    if "gzip" in encoding:
        body, head = gzip.compress(page) if "undone" not in encoding else page, head + "Content-Encoding: gzip\r\n"
    if encoding in ("deflate", "raw"):
        packer = zlib.compressobj(wbits=15 if encoding == "deflate" else -15)
        body, head = packer.compress(page) + packer.flush(), head + "Content-Encoding: deflate\r\n"
    if "chunked" in encoding:
        body, head = b"".join(b"%x\r\n%b\r\n" % (len(body[i : i + 70]), body[i : i + 70]) for i in range(0, len(body), 70)) + b"0\r\n\r\n", head + "Transfer-Encoding: chunked\r\n"
    found = warc.derivatives(crawled(head, body, "WARC-IP-Address: 10.1.2.3", "WARC-Concurrent-To: <urn:uuid:2>", f"WARC-Payload-Digest: {sha1(body)}"))
    assert [x[0] for x in found] == ["metadata", "conversion"] and all(x[2] == "<urn:uuid:1>" for x in found)
    assert warc.parse(found[1][5])[1].decode() == "\n".join(["Ça va"] * 50)
    said = fields_of(found)
    assert said["warc-header"] == ["warc-ip-address: 10.1.2.3", "warc-concurrent-to: <urn:uuid:2>"] and said["payload-digest-match"] == ["true"]


def test_other_payloads():
    kinds = lambda head, body: [x[0] for x in warc.derivatives(crawled(head, body))]
    assert kinds("Content-Type: image/png\r\n", b"\x89PNG") == ["metadata"]
    assert kinds("Content-Type: application/pdf\r\n", b"%PDF") == ["metadata"]
    assert kinds("Content-Type: text/html\r\nContent-Encoding: br\r\n", b"\x01\x02") == ["metadata"]
    assert kinds("Content-Type: text/html\r\nContent-Encoding: gzip\r\n", b"\x1f\x8bbroken") == ["metadata"]
    assert fields_of(warc.derivatives(crawled("Content-Type: text/html\r\nContent-Encoding: br\r\n", b"\x01")))["undecoded"] == ["br"]
    plain = warc.derivatives(crawled("content-type: Text/Plain\r\n", b"a <b> c\n d"))
    assert warc.parse(plain[1][5])[1] == b"a <b> c\n d"
    assert kinds("", b"<p>x") == ["metadata", "conversion"]
    assert warc.derivatives(b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n") == []
    assert fields_of(warc.derivatives(crawled("", b"x", "WARC-Payload-Digest: sha1:OTHER")))["payload-digest-match"] == ["false"]


def test_crawl_files_are_read_as_streams(spark, tmp_path):
    """Gzip members, plain files, other record types, cut-off files, and a page of many megabytes."""
    long = b"<p>" + b"word " * 1_500_000
    records = [crawled("Content-Type: text/html\r\n", b"<p>one"), b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n", crawled("", long)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(records[0]) + gzip.compress(records[0])[:-30])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b"WARC/1.0\r\n")
    found = warc.records(spark, f"file://{tmp_path}")
    assert {f.rsplit("/", 1)[1]: n for f, n in found.groupBy("file").count().collect()} == {"a.warc.gz": 3, "b.warc": 3, "c.warc.gz": 1}
    made = warc.derive(found.select(F.col("file").alias("source_key"), "record")).filter("warc_type = 'conversion'").select("source_key", F.length("record").alias("n")).collect()
    assert len([r for r in made if r["source_key"].endswith("a.warc.gz")]) == 2 and max(r["n"] for r in made) > 7_000_000


def test_any_bytes_are_taken():
    rng = random.Random(9)
    for _ in range(400):
        raw = bytes(rng.choice(b"\r\n: WARCHTTP/1.0<p>\x1f\x8b\xff9a") for _ in range(rng.randint(0, 120)))
        for start in (b"", b"\x1f\x8b", gzip.compress(b"WARC/1.0\r\n\r\n")[:-9], b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"):
            warc.derivatives(start + raw)
            list(warc.members(io.BytesIO(start + raw)))
    assert re.match("<urn:uuid:", warc.derivatives(b"")[0][1])


def test_all_members_of_a_body_are_read():
    whole = gzip.compress(b"one ") + gzip.compress(b"two")
    lines = ["Content-Encoding: gzip"]
    assert warc.body_of(lines, whole) == (b"one two", "")
    assert warc.body_of(lines, whole + b"\0\0") == (b"one two", "")
    text, broken = warc.body_of(lines, whole[:-9])
    assert b"one two".startswith(text) and text.startswith(b"one") and broken == "gzip (breaks off)"
    assert warc.body_of(lines, b"\x1f\x8bnothing of the kind") == (b"\x1f\x8bnothing of the kind", "gzip")
    assert warc.body_of(["Content-Encoding: deflate"], zlib.compress(b"q")) == (b"q", "")


def test_a_body_that_breaks_off_is_read_and_named():
    body = gzip.compress(b"<p>" + b"words of a page " * 500)[:-12]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n" + body
    raw = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block)
    made = {x[0]: x[-1] for x in warc.derivatives(raw)}
    assert b"undecoded: gzip (breaks off)" in made["metadata"] and b"words of a page" in made["conversion"]


def test_links_come_from_the_scan():
    page = '<title>One &amp;\n two</title><title>other</title><!-- <a href="no">x</a> --><script>"<a href=no2>"</script><a data-x="href=no3" href="yes&amp;1">y</a><a name=top>z</a><A HREF=two>'
    raw = warc.response("1", "http://x", page)
    [meta] = [x[-1].decode() for x in warc.derivatives(raw) if x[0] == "metadata"]
    assert [v for k, _, v in (x.partition(": ") for x in meta.split("\r\n")) if k == "outlink"] == ["yes&1", "two"]
    assert "title: One & two\r\n" in meta


def test_long_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<a " * 350_000, "<title" * 150_000, "<a href=x>" * 100_000, "<table>" + "<div>" * 100_000 + "</p>" * 100_000):
        warc.derivatives(warc.response("1", "u", page))
    assert time.time() - began < 30
