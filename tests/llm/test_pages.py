"""Page text, url filters and licence scans on small inputs."""

from __future__ import annotations

import html
import re
from collections import Counter

import duckdb
import pytest

from kgspark.llm import licenses, page_text, queries, url_filter
from kgspark.llm.support import table

SF = "/root/testdata/sf0.001"
PAGES = "page_id BIGINT, url STRING, html STRING, host STRING, text STRING"
SHELL = (
    '<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home'
    '<li>News</ul></nav><div id="cookie-notice">We use cookies</div><div class="{kind}"><h1>T{n} &amp; U</h1><p>One{n}<br>two'
    ' <i>th</i>ree<p>open <b>bold<div class="x7">Subscribe now</div><div class="ad-box">Buy</div></div><aside>rel</aside>'
    '<section class="comments"><p>nice {n}</section><form>Mail</form><script>var a="</p><p>no";</script><footer>f'
)


def test_template_of_a_host(spark):
    rows = [(i, f"http://a.example.com/{i}", SHELL.format(kind="c1", n="abcdefghijklmnopqrstuvwxyz"[i]), "h", "t") for i in range(20)]
    got = {r.page_id: (r.text, r.n_chars) for r in page_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i, row in enumerate(rows):
        c = "abcdefghijklmnopqrstuvwxyz"[i]
        text = f"T{c} & U One{c} two three open bold"  # the repeated call in x7 is template text
        assert got[i] == (text, len(text))


def test_repeated_rows_keep_the_template(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"http://a.example.com/{i}", SHELL.format(kind="c1", n=letters[i]), "h", "t") for i in range(20)]
    rows += [rows[0], (None, *rows[1][1:]), (None, *rows[2][1:]), (3, *rows[4][1:])]
    got = {(r.url, r.text) for r in page_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(f"http://a.example.com/{i}", f"T{c} & U One{c} two three open bold") for i, c in enumerate(letters[:20])}


@pytest.mark.parametrize("depth", [0, 38, 39, 40, 41, 60, 3000])
def test_markup_below_any_depth(depth):
    inner = "<nav>menu</nav><article><header>Title</header><div><p>text</div><div class='comments'><div><p>reply</div></div></article><footer><p>foot"
    page = "<body>" + "<div>" * depth + inner
    assert page_text.main_text(page, set(), set()) == "Title text"
    paths = {text: path for path, text in page_text.blocks(page)}
    assert len(set(paths.values())) == 5 and max(map(len, paths.values())) < 400
    (article,) = {p for kind, p, _ in page_text.walk(page) if kind == "open" and re.match("article", p.rpartition("/")[2])}
    assert [t for t, p in paths.items() if p.startswith(article + "/")] == ["Title", "text", "reply"]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (3, "http://x/", "plain &lt; text"), (4, "http://x/", "<article>a<!-- b --><p>c"),
            (None, "http://x/", "<p>" + "long " * 50_000), (4, "http://x/", "<article>a<!-- b --><p>c")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    got = sorted((r.page_id or 0, r.text) for r in page_text.extract(df).collect())
    assert got == [(0, ("long " * 50_000).strip()), (1, ""), (2, ""), (3, "plain < text"), (4, "a c"), (4, "a c")]
    assert page_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<section id="side-effects"><p>Nausea</p></section>', "Nausea"),
        ('<div class="discussion"><p>We find</p></div>', "We find"),
        ('<div id="search-algorithms">Binary <b>search</b></div>', "Binary search"),
        ('<h1>Film</h1><div class="review-body">Good</div>', "Film Good"),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> hold.</p>", "Let x=1 hold."),
        ('<p>a</p><ins class="adsbygoogle">Buy now</ins><p>b</p>', "a b"),
        ('<p>a <a class="ad">Buy</a> b <span hidden>no <b>no</b></span> c</p>', "a b c"),
        ('<p>a <span aria-hidden="true">#</span><span class="share-button">Share</span>b <span class="x">c</span></p>', "a b c"),
        ('<p>a <a class="ad">never closed</p><p>b</p>', "a b"),
        ('<div class="ad-box">Buy</div><div id="cookie-notice">ok</div><div class="ads2">Buy</div><p>a</p>', "a"),
        ('<p>a</p><section class="comments"><p>hi</p></section><ul class="comment-list"><li>me</ul><div class="related-posts">x</div>', "a"),
        ('<p>a</p><div class="main header">b</div><div role="navigation">c</div><div class="social-share">d</div>', "a b"),
    ],
)
def test_marks_inside_the_article(inside, text):
    assert page_text.main_text(f"<body><nav>menu</nav><article>{inside}</article><footer>f", set(), set()) == text


def test_copies_do_not_become_template(spark):
    rows = [(i, "http://c/", "<body><nav>menu</nav><article><h1>One</h1><p>same text</article>", "", "") for i in range(40)]
    assert {r.text for r in page_text.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"One same text"}


def test_bylines_stay_on_hosts_of_any_size(spark):
    page = "<body><nav>menu</nav><article><p class='byline'>By author {}<h2>Part {}</h2><div class='x7'>Call</div><p>text {}</article>"
    sizes = {"small": 20, "large": 300}
    rows = [(i, f"http://{h}/{i}", page.format(i % 5, i % 3, i), "", "") for h, n in sizes.items() for i in range(n)]
    got = {(r.url, r.text) for r in page_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(f"http://{h}/{i}", f"By author {i % 5} Part {i % 3} text {i}") for h, n in sizes.items() for i in range(n)}


def test_shared_pages(spark):
    source = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in queries.QUERIES["op9_page_text"](spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        plain = re.sub(r"</?(?:p|h1|br)>", " ", body).replace("<b>", "")
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_split_name():
    known = {"cheap": 50, "pills": 40, "pill": 10, "s": 5, "che": 1}
    assert url_filter.split_name("cheappills", known, 1000) == ["cheap", "pills"]
    assert "".join(url_filter.split_name("zzqpills", known, 1000)) == "zzqpills"
    assert url_filter.split_name("", known, 1000) == []
    long = "counterrevolutionaries" * 2
    assert url_filter.split_name(f"the{long}", {long: 3, "the": 9}, 1000) == ["the", long]


def _brute_force(rows):
    """host, path, rule, verdict by the written method, in plain Python."""
    words = Counter(w for _, _, page in rows if page for w in re.split(r"[^\w]|[\d_]", re.sub("<[^>]*>", " ", page).lower()) if w)
    total = sum(words.values()) or 1
    parsed, tokens = [], {}
    for i, url, _ in rows:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest).group().translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest).group()) :]).group()
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        shape = path.lower()
        names = [n for n in re.split(r"[\W_]+", host) if n]
        tokens[host, shape] = [w for w in re.split(r"[\W_]+", shape) if w] + [
            w for n in dict.fromkeys(names) for w in url_filter.split_name(n, words, total) for _ in range(names.count(n))
        ]
        parsed.append((i, host, path, rule, shape))
    b, a = Counter(), Counter({w: 0 for t in tokens.values() for w in t})
    for _, host, _, rule, shape in parsed:
        if rule:
            (b if rule.verdict == "block" else a).update(tokens[host, shape])
    import math

    vocabulary = len(a)
    shift = math.log((sum(a.values()) + vocabulary + 1) / (sum(b.values()) + vocabulary + 1))
    blocked = sum(1 for p in parsed if p[3] and p[3].verdict == "block")
    allowed = sum(1 for p in parsed if p[3] and p[3].verdict == "allow")
    prior = math.log((blocked + 1) / (allowed + 1))
    out = []
    for i, host, path, rule, shape in parsed:
        score = prior + sum(math.log((b[w] + 1) / (a[w] + 1)) + shift for w in tokens[host, shape])
        out.append((i, host, path, rule and rule.text, rule.verdict if rule else "block" if score > 1e-7 else "allow"))
    return out


def test_urls_equal_brute_force(spark):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, SF, "pages").collect()]
    rows += [(900, None, None), (901, "no scheme", ""), (902, "HTTP://WWW.CheapPills.Example.COM/de", "<p>cheap pills"),
             (903, "https://org/", None), (904, "https://example.org?x=/en/1", None), (905, "http://example.org/en/1?y#z", None),
             (905, "http://example.org/en/1?y#z", None), (906, f"http://www.{'verylong' * 5}names.net/2024/05", f"<p>{'verylong' * 5}"),
             (907, "http://x.org/2024/05/07", None), (908, "http://x.com/de/2024", None), (909, "http://y.net/2024", None),
             (910, f"http://{'zq' * 400}.net/", None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(_brute_force(rows), key=key)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_license_rules(documents):
    texts = [
        "Some code.\nLicensed under the Apache License, Version 2.0.\nMore.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "Licensed under the Apache License,\n   Version 2.0. You may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0",
        "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: x",
        "Released under the MIT License. Released under the MIT License.",
        "license to drive",
        "",
        None,
        "All rights reserved.\n" + "x" * 200_000 + ". Released under the MIT License.",
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(documents(list(enumerate(texts)))).collect()}
    assert got == {0: "Apache-2.0", 1: "Apache-2.0", 2: "Apache-2.0", 3: "BSD", 4: "MIT", 8: "MIT,all-rights-reserved"}
    assert licenses.scan_licenses(documents([])).count() == 0
    assert all(any(a in t for a in licenses.ANCHORS) for n, t in licenses.SENTENCES.items() if "anchor" not in n)


GNU = (
    "This program is free software{} you can redistribute it and/or modify\n    it under the terms of the GNU {}General Public "
    "License as published by\n    the Free Software Foundation{} either version {} of the License, or\n    (at your option) any later version."
)


NOTICES = {
    'Copyright 2024 A\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in '
    "compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software": "Apache-2.0",
    GNU.format(":", "", ",", "3"): "GPL-3.0-or-later",
    GNU.format(";", "", ";", "2"): "GPL-2.0-or-later",
    GNU.format(":", "Affero ", ",", "3"): "AGPL-3.0-or-later",
    GNU.format(";", "Lesser ", ";", "2.1"): "LGPL-2.1-or-later",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not": "MPL-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0BSD",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "It was released under the MIT License in 2020, like all of them.": "MIT",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "// SPDX-License-Identifier: Apache-2.0\nint main() {}": "Apache-2.0",
    "# SPDX-License-Identifier: GPL-2.0+\n": "GPL-2.0-or-later",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
    "Distributed under the MIT license.": "MIT",
    "See the GNU General Public License v3.0, or ask.": "GPL-3.0",
    "SPDX-License-Identifier: Something-Else": None,
    "Those were all rights. Reserved seats are free.": None,
}


def test_canonical_notices(documents):
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(documents(list(enumerate(NOTICES)))).collect()}
    assert got == {i: v for i, v in enumerate(NOTICES.values()) if v}
    assert all(any(a in t for a in licenses.NOTICE_ANCHORS) for _, t in licenses.NOTICES)


def test_notices_match_sql(documents):
    texts = [*NOTICES, None, "", " ".join(NOTICES), "\n\n".join(NOTICES), "licensed under cc by 4.0 licensed under cc by 4.0 all rights reserved."]
    df = documents([(i % 20, t) for i, t in enumerate(texts)])
    duck = duckdb.connect()
    duck.register("documents", df.select("doc_id", "text").toPandas())
    got = [tuple(r) for r in licenses.scan_licenses(df).select("doc_id", "licenses", "sentence_ids").collect()]
    expected = duck.execute(f"SELECT doc_id, licenses, sentence_ids FROM ({licenses.check_sql()})").fetchall()
    assert sorted(got) == sorted(expected) and len(got) >= 20


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.CHECKS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, result.select(*columns).collect())) == sorted(cursor.fetchall())
