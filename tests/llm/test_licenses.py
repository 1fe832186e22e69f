import re

import pytest
from siftwell.llm import licenses
from siftwell.llm.licenses import RULES, SENTENCES, Scanner, licence_matches
from siftwell.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs


def test_every_rule_is_found_in_its_own_text():
    scanner = Scanner()
    for name, kind, ids in RULES:
        marked = all(SENTENCES[i][-1] in ".!?;:" for i in ids)
        for between in (" ", "\n", "\n\n") if marked else ("\n", "\n\n"):
            text = "Some prose before.\n" + between.join(SENTENCES[i] for i in ids) + "\nAnd prose after"
            assert [(m[0], m[1]) for m in scanner.scan(text)] == [(name, kind)], (name, between)


def test_wrapped_lines_case_and_order():
    scanner = Scanner()
    wrapped = SENTENCES["mit-1"].replace(" software", "\nsoftware").upper() + "\n" + SENTENCES["mit-2"] + " " + SENTENCES["mit-3"] + "  " + SENTENCES["mit-4"]
    assert [m[0] for m in scanner.scan("A heading with no end\n" + wrapped)] == ["MIT"]
    swapped = SENTENCES["bsd-2"] + " " + SENTENCES["bsd-1"]
    assert scanner.scan(swapped) == []
    both = SENTENCES["mit-notice"] + " " + SENTENCES["apache-2.0-notice"] + " unlicensed text follows."
    found = scanner.scan(both)
    assert [m[0] for m in found] == ["MIT", "Apache-2.0"] and both[found[0][2] : found[0][3]] == SENTENCES["mit-notice"]


def test_whole_table_against_a_line_search(spark, sf):
    got = {r.doc_id: r.licenses for r in QUERIES["op2_license_scan"](spark, sf).collect()}
    notices = {"Apache-2.0": "apache-2.0-notice", "MIT": "mit-notice", "GPL-3.0-only": "gpl-3.0-notice", "CC-BY-NC-4.0": "cc-by-nc-4.0-notice"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        lines = {re.sub(r"\W+", " ", x).strip().lower() for x in d.text.split("\n")}
        want = sorted(k for k, n in notices.items() if re.sub(r"\W+", " ", SENTENCES[n]).strip().lower() in lines)
        assert got[d.doc_id] == ",".join(want)


def test_edges(spark):
    rows = edge_docs(spark)
    got = licence_matches(rows).collect()
    assert len(got) == rows.count() and all(r.licenses == [] and r.matches == [] for r in got)
    long = spark.createDataFrame([(1, "no end " * 50_000 + "\n" + SENTENCES["mit-notice"] + "\n" + "\nx" * 20_000)], "doc_id bigint, text string")
    assert licence_matches(long).first().licenses == ["MIT"]
    assert licence_matches(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("text, want", [
    ("                                 Apache License\n                           Version 2.0, January 2004\n", ("Apache-2.0", "title")), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright", ("GPL-3.0-only", "title")),
    ("# SPDX-License-Identifier: Apache-2.0 OR MIT\nimport x", ("Apache-2.0 OR MIT", "spdx")), ("/* SPDX-License-Identifier: (GPL-2.0 AND BSD-3-Clause) */", ("GPL-2.0-only AND BSD-3-Clause", "spdx")), ("// SPDX-License-Identifier: Zlib", ("Zlib", "spdx")),
    ("Eclipse Public License - v 2.0\n", ("EPL-2.0", "title")), ("Boost Software License - Version 1.0 - August 17th, 2003\n", ("BSL-1.0", "title")),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin", ("Zlib", "text")),
])
def test_titles_expressions_and_zlib(text, want):
    assert [m[:2] for m in licenses.Scanner().scan(text)] == [want]
