"""The operators made of built-in functions, against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillwatch.llm import licenses, line_dedup, quality_rules, queries, sharding, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x\n\nx\n x\n", "Der " * 500, "a b a b a b", "é#*$%&|<> ü", "w " * 20_000, "one two three\none two three\nfour"]


def features(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_features_match_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD)], docs.schema)
    for r in quality_rules.count_features(docs.union(odd)).collect():
        assert tuple(r[c] for c in quality_rules.FEATURES) == features(r["text"]), r["doc_id"]


def test_many_repeated_windows_take_the_sorted_path(spark):
    text = " ".join(f"w{k}" for k in range(300)) * 1 + " " + " ".join(f"w{k}" for k in range(300)) + " tail end"
    got = quality_rules.count_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_repeat_words"] == features(text)[4] == 600


def test_bad_hosts_lose_all_documents_and_good_ones_keep_theirs(spark):
    good, bad = " ".join(f"word{k}" for k in range(80)), " ".join(f"word{k}%%%" for k in range(80))
    rows = [(k, good, "good", "x") for k in range(40)] + [(100 + k, bad if k else good, "bad", "x") for k in range(40)] + [(200, None, None, "x"), (201, good, None, "x")]
    out = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")).collect()}
    assert all(out[k]["kept"] for k in range(40)) and not any(out[100 + k]["kept"] for k in range(40))
    assert not out[100]["base_failed"] and out[200]["base_failed"] and not out[200]["kept"]


def test_dropping_keeps_columns_whatever_their_names(spark):
    good = " ".join(f"word{k}" for k in range(80))
    df = spark.createDataFrame([(1, good, "s", 7, "y"), (2, "bad", "s", 8, None)], "doc_id long, text string, source string, n_words int, host string")
    assert quality_rules.drop_rejected(df).collect() == df.filter("doc_id = 1").collect()


def test_rules_on_an_empty_table(spark):
    assert quality_rules.apply_quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_line_dedup_matches_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    rows = docs.collect()
    extra = [(-1, None, "a\nb"), (-2, "src0", None), (-3, "src0", ""), (-4, "src0", rows[0]["text"])]
    every = [tuple(r) for r in rows] + extra
    pages, holds = Counter(s for _, s, _ in every), Counter()
    blank = lambda line: not WORD.search(line)
    for _, s, t in every:
        holds.update({(s, line) for line in (t or "").split("\n") if not blank(line)})
    want = {}
    for i, s, t in every:
        lines = (t or "").split("\n")
        keep = [x for x in lines if blank(x) or holds[s, x] < 3 or holds[s, x] <= 0.1 * pages[s]]
        want[i] = (None if t is None else "\n".join(keep), len(lines) - len(keep))
    df = docs.union(spark.createDataFrame(extra, docs.schema))
    for limit in (0, 10**6):  # both ways of joining
        got = {r["doc_id"]: (r["text"], r["n_lines_dropped"]) for r in line_dedup.drop_boilerplate(df, broadcast_lines=limit).collect()}
        assert got == want
    assert sum(n for _, n in want.values()) > 0


def test_licenses(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n"
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    )
    cases = {
        "A line.\nLicensed under the Apache License, Version 2.0.\nmore": ("Apache-2.0", True),
        "Released under the MIT License.": ("MIT", True),
        "x. Licensed under CC BY-NC 4.0.": ("CC-BY-NC-4.0", False),
        "This work is licensed under the GNU General Public License, version 3.": ("GPL-3.0-only", False),
        mit: ("MIT", True),
        "nothing here": (None, None),
        "": (None, None),
    }
    df = spark.createDataFrame([*[(k, t, "x") for k, t in enumerate(cases)], (99, None, "x")], "doc_id long, text string, license string")
    got = {r["doc_id"]: (r["license"], r["permissive"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {k: v for k, v in enumerate(cases.values())} | {99: (None, None)}
    both = spark.createDataFrame([("Released under the MIT License.\nLicensed under CC BY-NC 4.0.",)], "text string")
    assert licenses.scan_licenses(both).first()["licenses"] == "MIT,CC-BY-NC-4.0"


def test_lookup_table_against_the_definition():
    names, size = [f"s{k}" for k in range(7)], 101
    owner = sharding.fill_table(names, size)
    import xxhash

    want, place = {}, {n: 0 for n in names}
    while len(want) < size:
        for n in names:
            start, step = xxhash.xxh64_intdigest(n, seed=1) % size, xxhash.xxh64_intdigest(n, seed=2) % (size - 1) + 1
            while (s := (start + place[n] * step) % size) in want:
                place[n] += 1
            want[s] = n
            if len(want) == size:
                break
    assert [names[i] for i in owner] == [want[s] for s in range(size)]


def test_shard_query_on_whole_tables(spark, sf):
    names, size = [f"shard-{k:04d}" for k in range(256)], 65_537
    import xxhash

    owner, asked, k = {}, [0] * 256, 0
    walks = [(xxhash.xxh64_intdigest(n, seed=1) % size, xxhash.xxh64_intdigest(n, seed=2) % (size - 1) + 1) for n in names]
    while len(owner) < size:  # turn by turn, as the definition has it
        start, step = walks[k]
        while (start + asked[k] * step) % size in owner:
            asked[k] += 1
        owner[(start + asked[k] * step) % size] = k
        k = (k + 1) % 256
    mask = (1 << 64) - 1
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & mask

    def hash_long(v, seed=42):  # XXH64 of eight bytes
        p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
        h = (seed + p5 + 8) & mask
        h ^= (rot((v & mask) * p2 & mask, 31) * p1) & mask
        h = (rot(h, 27) * p1 + p4) & mask
        h ^= h >> 33
        h = h * p2 & mask
        h ^= h >> 29
        h = h * p3 & mask
        h ^= h >> 32
        return h - (1 << 64) if h >> 63 else h

    rows = queries.op2_sharding(spark, sf).collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    want = {(i, s := hash_long(i) % size, owner[s], names[owner[s]]) for i in ids}
    assert len(rows) == len(ids) and {tuple(r) for r in rows} == want


def test_weights(spark):
    for weights in ([0, 0], [1, -1], [1]):
        with pytest.raises(ValueError):
            sharding.fill_table(["a", "b"], 101, weights)
    assert Counter(sharding.fill_table(["a", "b", "c"], 101, [0, 1, 3]).tolist()).keys() == {1, 2}


def test_write_shards_splits_a_hot_key(spark, tmp_path):
    df = spark.createDataFrame([(None if k < 600 else k, k) for k in range(1000)], "doc_id long, n long")
    path = str(tmp_path / "shards")
    sharding.write_shards(df, ["doc_id"], ["a", "b", "c"], path, files_per_shard=4)
    back = spark.read.parquet(path)
    assert sorted(r["n"] for r in back.collect()) == list(range(1000))
    hot = back.filter("doc_id is null").select("shard", F.input_file_name().alias("f")).groupBy("shard", "f").count().collect()
    assert len({r["shard"] for r in hot}) == 1 and len(hot) > 1 and max(r["count"] for r in hot) < 400


def test_shards_are_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    a, b = sharding.fill_table(names), sharding.fill_table(names[:-1])
    counts = Counter(a.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(x != y for x, y in zip(a, b) if x != 19) < 0.05 * len(a)


def test_assign_shards_with_odd_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "z")], "doc_id long, shard string")
    out = sharding.assign_shards(df, ["doc_id"], ["a", "b", "c"]).collect()
    assert len(out) == 4 and len({r["shard_name"] for r in out if r["doc_id"] == 1}) == 1 and len({r["shard_name"] for r in out if r["doc_id"] is None}) == 1
    assert sharding.assign_shards(df.limit(0), ["doc_id"], ["a"]).count() == 0


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in url_filters.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def test_url_query_on_whole_tables(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op7_url_filters(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = cut(urls[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["purity"] < 0.3 else "allow"))
    assert {r["rule"] for r in rows} >= {"com/en/", "net/de/", "org/es/"}
    undecided = Counter(r["verdict"] for r in rows if r["rule"] is None)
    assert undecided["block"] > 0 and undecided["allow"] > 0  # by the templates alone


def test_many_rules_are_looked_up_by_host(spark):
    rules = [("block" if k % 2 else "allow", f"h{k}.org/{'abc'[k % 3]}/") for k in range(300)] + [("allow", "org/a/x"), ("block", "org/"), ("block", "/z")]
    urls = [f"http://{sub}h{k}.org/{p}/x" for k in range(0, 300, 7) for sub in ("", "www.") for p in "abc"] + ["http://org/a/x", "http://h.com/a", "http:///z", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filters.host_of(F.col("url")).alias("h"), url_filters.path_of(F.col("url")).alias("p"))
    found = df.select("url", url_filters.longest_rule(F.col("h"), F.col("p"), rules).alias("r")).collect()
    for r in found:
        host, path = cut(r["url"])
        fits = [(len(x), x, v) for v, x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        assert (tuple(r["r"]) if r["r"] else None) == (max(fits)[1:] if fits else None), r


def test_inner_columns_have_names_of_their_own(spark):
    urls = spark.createDataFrame([("http://a.org/x", 1, 2, 3)], "url string, _shape int, _rule int, _found int")
    r = url_filters.judge_urls(urls).first()
    assert (r["_shape"], r["_rule"], r["_found"], r["verdict"]) == (1, 2, 3, "allow")
    r = quality_rules.count_features(urls.select(F.col("url").alias("text"), F.col("_rule").alias("_words"))).first()
    assert (r["_words"], r["n_words"]) == (2, 1)
    pages = spark.createDataFrame([("s", "a\nb", 1, 2)], "source string, text string, _host int, _keys int")
    assert tuple(line_dedup.drop_boilerplate(pages).first()) == ("s", "a\nb", 1, 2, 0)
    texts = spark.createDataFrame([("Released under the MIT License.", 1, 2)], "text string, _joined int, _by_line int")
    r = licenses.scan_licenses(texts).first()
    assert (r["_joined"], r["_by_line"], r["license"]) == (1, 2, "MIT")


def test_line_dedup_on_empty_tables_and_long_texts(spark):
    schema = "doc_id long, source string, text string"
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], schema)).count() == 0
    long = "\n".join(f"line {k}" for k in range(100_000))
    rows = [(k, "s", f"{long}\nown {k}" if k == 0 else f"menu\nline 7\nown {k}") for k in range(4)]
    got = {r["doc_id"]: (r["n_lines_dropped"], r["text"]) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: (1, "\n".join(x for x in long.split("\n") if x != "line 7") + "\nown 0")} | {k: (2, f"own {k}") for k in range(1, 4)}


def test_licenses_on_empty_tables_long_texts_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0
    long = "some words and more. " * 50_000 + "\nReleased under the MIT License.\n" + "x" * 100_000
    rows = licenses.scan_licenses(spark.createDataFrame([(1, long), (2, long), (2, long)], schema)).collect()
    assert [(r["license_sentences"], r["license"]) for r in rows] == [("mit-name", "MIT")] * 3


def test_odd_urls_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com", "x://É.Net/de/1?a", "a://b://c/d", "https://u.example.net/de/80#x", "https://example.com/en/7", "https://notexample.com/en/7", "https://com/en/", "http://a.com/en\n/x?y", "http://h.org/" + "a/" * 3000]
    urls += [f"http://shop.org/item/{'abcdefghij'[k % 10]}x{k}/view" for k in range(40)] + [f"http://shop.org/es/p{k}/view" for k in range(40)] + ["http://shop.org/about"] * 20
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rows = {r["page_id"]: r for r in url_filters.judge_urls(df).collect()}
    assert len(rows) == len(urls)
    for k, u in enumerate(urls):
        host, path = cut(u)
        rule, verdict = rule_of(host, path)
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == (host, path, rule)
        assert verdict is None or rows[k]["verdict"] == verdict
    assert rows[13]["template"] == "/item/*/view" and rows[13]["verdict"] == "block" and rows[93]["template"] == "/about"  # as the host's labelled pages are
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(f"http://h.net/spam/x{k}a/p", 1 if k < 30 else None) for k in range(60)] + [(f"http://h.net/good/x{k}a/p", 0 if k < 30 else None) for k in range(60)]
    out = url_filters.judge_urls(spark.createDataFrame(rows, "url string, bad int"), rules=(), label="bad").collect()
    assert {(r["template"], r["verdict"]) for r in out} == {("/spam/*/p", "block"), ("/good/*/p", "allow")}


def test_the_rules_own_labels_block_what_varies_beside_them(spark):
    rows = [(f"http://x.org/es/{k}",) for k in range(12)] + [(f"http://x.org/{c}/{k}",) for k, c in enumerate("abcdefg")]
    out = url_filters.judge_urls(spark.createDataFrame(rows, "url string")).collect()
    assert {(r["rule"], r["template"], r["purity"], r["verdict"]) for r in out} == {("org/es/", "/*/{n}", 0.125, "block"), (None, "/*/{n}", 0.125, "block")}


MIT = """MIT License

Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """   Copyright 2024 Jane Doe

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
GPL = """Copyright (C) 2024  Jane Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Copyright (c) 2024, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_canonical_notices_in_their_usual_layout(spark):
    cases = {
        MIT: ("mit-grant,mit-notice,as-is", "MIT", "MIT"),
        APACHE: ("apache-notice,apache-copy", "Apache-2.0", "Apache-2.0"),
        GPL: ("gpl3-later,gpl-hope", "GPL-3.0-or-later", "GPL-3.0-or-later"),
        BSD: ("reserved,bsd-grant,bsd-source,bsd-binary,bsd-names", "BSD-3-Clause,BSD-2-Clause", "BSD-3-Clause"),
        MPL: ("mpl-notice", "MPL-2.0", "MPL-2.0"),
    }
    cases |= {"\n".join(("/*", *(f" * {x}".rstrip() for x in t.splitlines()), " */")): v for t, v in list(cases.items())}
    cases |= {"\n".join(f"# {x}".rstrip() for x in t.splitlines()).replace("\n", "\r\n"): v for t, v in list(cases.items())[:5]}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license_sentences"], r["licenses"], r["license"]) for r in licenses.scan_licenses(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert all(any(m in s for m in licenses.MARKS) for _, s in licenses.SENTENCES)


def test_names_and_more_licenses(spark):
    cases = {BSD.replace("the copyright holder", holder): ("BSD-3-Clause,BSD-2-Clause", "BSD-3-Clause") for holder in ("Example Corp.", "the University", "Jane Doe, Inc")}
    cases |= {
        "SPDX-License-Identifier: AGPL-3.0-only": ("AGPL-3.0-only", "AGPL-3.0-only"),
        "// SPDX-License-Identifier: MIT OR Apache-2.0": ("MIT OR Apache-2.0", "MIT OR Apache-2.0"),
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free": ("Unlicense", "Unlicense"),
        "To the extent possible under law, Jane Doe has waived all copyright and related\nor neighboring rights to this work.": ("CC0-1.0", "CC0-1.0"),
        "# SPDX-License-Identifier: LGPL-2.1-or-later\n": ("LGPL-2.1-or-later", "LGPL-2.1-or-later"),
        "SPDX-License-Identifier: EPL-2.0": ("EPL-2.0", "EPL-2.0"),
        "SPDX-License-Identifier: Zlib": ("Zlib", "Zlib"),
        "neither the name of " + "x" * 300 + " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": ("", None),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["license"]) for r in licenses.scan_licenses(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_one_line_and_wrapped_notices_in_one_text(spark):
    text = GPL + "\nSPDX-License-Identifier: MIT\nLicensed under CC BY 4.0\nReleased under the MIT License\n" + MIT
    r = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).first()
    assert r["license_sentences"] == "gpl3-later,gpl-hope,mit-name,cc-by-4.0,mit-name,mit-grant,mit-notice,as-is"
    assert (r["licenses"], r["license"], r["permissive"]) == ("GPL-3.0-or-later,MIT,CC-BY-4.0", "GPL-3.0-or-later", False)


def test_small_hosts_lose_their_boilerplate(spark):
    rows = [(h, f"menu\nown {k}\nfew {k % 2}") for h, n in (("a", 19), ("b", 3), ("c", 2), (None, 5)) for k in range(n)] + [("d", f"own {k}" + "\nrare" * (k < 3)) for k in range(30)]
    got = {(r["source"], r["text"], r["n_lines_dropped"]) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "source string, text string")).collect()}
    want = {("a", f"own {k}", 2) for k in range(19)} | {("b", f"own {k}\nfew {k % 2}", 1) for k in range(3)} | {("c", f"menu\nown {k}\nfew {k}", 0) for k in range(2)}
    want |= {(None, f"own {k}" + "\nfew 1" * (k % 2), 2 - k % 2) for k in range(5)} | {("d", f"own {k}" + "\nrare" * (k < 3), 0) for k in range(30)}
    assert got == want


def test_templates_learn_at_any_depth(spark):
    labelled = lambda k: 1 if k < 30 else None
    rows = [(f"http://h.net/a/b/c/d/spam/x{k}a/p", labelled(k)) for k in range(60)] + [(f"http://h.net/a/b/c/d/good/x{k}a/p", labelled(k) and 0) for k in range(60)]
    rows += [("http://h.net/a/b/c/d", None), ("http://h.net/a/b/c/d/good", None), ("http://h.net/" + "a/" * 500, None)] + [("http://i.net" + "/a" * k, 0) for k in range(40)]
    out = url_filters.judge_urls(spark.createDataFrame(rows, "url string, bad int"), rules=(), label="bad").collect()
    assert len(out) == len(rows)
    assert {(r["template"], r["verdict"]) for r in out if "/c/" in r["url"]} == {("/a/b/c/d/spam/*/p", "block"), ("/a/b/c/d/good/*/p", "allow"), ("/a/b/c/d", "allow"), ("/a/b/c/d/good", "allow")}
    assert all(r["template"] == r["path"] for r in out if "/c/" not in r["url"])
