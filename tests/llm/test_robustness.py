"""Hostile and odd inputs of single operators."""

import gzip
import time
import zlib

import numpy as np
import pytest
from siftwell.llm import media, warc
from siftwell.llm.licenses import Scanner

APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This file is part of a program.

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
AGPL = GPL.replace("General Public", "Affero General Public").replace("version 2", "version 3")
LGPL = GPL.replace("General Public", "Lesser General Public").replace("program", "library").replace("version 2", "version 2.1")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
HEADERS = {"Apache-2.0": (APACHE, "header", 4), "GPL-2.0-or-later": (GPL, "header", 4), "AGPL-3.0-or-later": (AGPL, "header", 4), "LGPL-2.1-or-later": (LGPL, "header", 4), "MPL-2.0": (MPL, "header", 2), "ISC": (ISC, "text", 3), "Unlicense": (UNLICENSE, "text", 2)}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- ", ";; "])
def test_published_headers_in_comments(mark):
    scanner = Scanner()
    for name, (text, kind, n) in HEADERS.items():
        commented = "\n".join((mark + line).rstrip() for line in text.split("\n")) + "\nint main() { return 0; }\n"
        assert [(m[0], m[1], len(m[4])) for m in scanner.scan(commented)] == [(name, kind, n)], (name, mark)
        assert [(m[0], m[1], len(m[4])) for m in scanner.scan(" ".join((text.partition("\n\n")[2] if text.startswith("Copyright") else text).split()))] == [(name, kind, n)], name


def test_spdx_lines_and_titles():
    scanner = Scanner()
    assert [m[:2] for m in scanner.scan("#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-or-later\nset -e\n")] == [("GPL-2.0-or-later", "spdx")]
    assert [m[:2] for m in scanner.scan("// SPDX-License-Identifier: MIT\n")] == [("MIT", "spdx")]
    assert [m[:2] for m in scanner.scan("# thing\n\nMIT License\n\nCopyright (c) 2020 A\n")] == [("MIT", "reference")]
    assert scanner.scan("the MIT License is short, says the text") == []


def test_sentences_far_apart_are_no_match():
    from siftwell.llm.licenses import SENTENCES

    scanner, parts = Scanner(), [SENTENCES[k] for k in ("bsd-1", "bsd-2", "bsd-3")]
    assert [m[0] for m in scanner.scan("\n".join(parts))] == ["BSD-2-Clause"]
    assert scanner.scan(parts[0] + "\n" + "prose goes on. " * 9_000 + "\n" + parts[1] + "\n" + parts[2]) == []


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<!--", "<script", "<a href='", "</title", "<", "&", "<a href=x>", "<p>", "<style>", "</script ", "<template>", "<a title='"])
def test_markup_is_read_in_linear_time(piece):
    def seconds(size):
        page, best = piece * (size // len(piece)), 1e9
        for _ in range(3):
            began = time.process_time()
            warc.read_page(page)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(400_000) / max(seconds(100_000), 0.02) < 4 * 2.6


def page_record(content_type, body, more=""):
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\n{more}\r\n".encode() + body
    return warc.record("response", [("WARC-Record-ID", "<urn:x>"), ("WARC-Date", warc.DATE)], http)


@pytest.mark.parametrize("charset", ["idna", "undefined", "punycode", "hex", "base64", "no-such", "unicode_escape", "utf-16", "utf-7", "..", "rot13"])
def test_odd_charsets_give_rows(charset):
    found = warc.derived(page_record(f"text/html; charset={charset}", "<p>text é</p>".encode()))
    assert [d["kind"] for d in found] == ["metadata", "conversion"]


def test_codings():
    text = b"<p>some text</p>"
    deflate = zlib.compressobj(wbits=-15)
    for coding, body in (("gzip", gzip.compress(text)), ("deflate", zlib.compress(text)), ("deflate", deflate.compress(text) + deflate.flush()), ("identity", text)):
        assert warc.derived(page_record("text/html", body, f"Content-Encoding: {coding}\r\n"))[1]["block"] == b"some text"
    for coding, body in (("br", b"xx"), ("zstd", b"xx"), ("gzip", gzip.compress(text)[:-9]), ("gzip", b"no")):
        found = warc.derived(page_record("text/html", body, f"Content-Encoding: {coding}\r\n"))
        assert [d["kind"] for d in found] == ["invalid"] and found[0]["error"]
    chunked = b"5\r\n<p>so\r\n9;x=y\r\nme text</\r\n2\r\np>\r\n0\r\n\r\n"
    assert warc.derived(page_record("text/html", chunked, "Transfer-Encoding: chunked\r\n"))[1]["block"] == b"some text"
    for bad in (b"-5\r\nabc", b"zz\r\nabc", b"\r\n"):
        assert warc.derived(page_record("text/html", bad, "Transfer-Encoding: chunked\r\n"))[0]["kind"] == "invalid"


def test_page_is_read_by_its_tags():
    page = """<html><head><TITLE lang=en>One &amp; two
    three</TITLE><style>p { x }</style></head><body><!-- <a href="/hidden">no</a> --><p>First<br>line <b>bold</b></p>
    <a class=x href="/a?b&amp;c">A</a><A HREF='/d'>D</A><a data-href="/not" href=/e>E</a><a href="/a?b&amp;c">again</a><script>"<a href='/s'>"</script>5 < 6 &lt;ok&gt;</body>"""
    text, title, links = warc.read_page(page)
    assert title == "One & two three" and links == ["/a?b&c", "/d", "/e"]
    assert text == "One & two\nthree\nFirst\nline bold\nADEagain5 < 6 <ok>"
    assert warc.read_page("a <!-- open <p>") == ("a", None, []) and warc.read_page("x <b")[0] == "x <b" and warc.read_page("") == ("", None, [])


def test_rows_with_one_key_and_other_pages_have_other_ids():
    ids = {dict(warc.parsed(warc.response("u", page, None))[0])["WARC-Record-ID"] for page in ("a", "b", "a")}
    assert len(ids) == 2


def test_images_without_pixels_or_with_too_much_data_are_errors():
    def image(width, height, data):
        import struct

        header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
        return media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", data) + media._chunk(b"IEND", b"")

    for bad in (image(4, 0, zlib.compress(b"")), image(0, 4, zlib.compress(b"\0" * 4)), image(1, 1, zlib.compress(b"\0" * 50_000_000)), image(4, 4, zlib.compress(b"\0" * 5)), image(1 << 31, 1 << 31, zlib.compress(b""))):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_cosine_hash_by_its_definition():
    rng = np.random.default_rng(4)
    for height, width in ((3, 192), (64, 192), (40, 33)):
        samples = rng.integers(0, 256, (height, width), dtype=np.uint8)
        small = np.zeros((32, 32))
        for y in range(32):
            for x in range(32):
                y0, x0 = y * height // 32, x * width // 32
                y1, x1 = ((y + 1) * height // 32 if y < 31 else height), ((x + 1) * width // 32 if x < 31 else width)
                small[y, x] = samples[y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)].mean()
        low = [round(1024 * sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * v / 64) * np.cos(np.pi * (2 * x + 1) * u / 64) for y in range(32) for x in range(32))) for v in range(8) for u in range(8)]
        middle = np.median(low[1:])
        bits = "0" + "".join("1" if c > middle else "0" for c in low[1:])
        assert media.cosine_hash(samples) == f"{int(bits, 2):016x}"
