import math
import re
from collections import Counter

from logweave.llm.licenses import TEMPLATES, WHOLE, scan_licenses, template_weights
from logweave.llm.queries import op7_licenses

SCHEMA = "path string, text string, license int"


def run(spark, rows):
    df = spark.createDataFrame([(p, t, 1) for p, t in rows], SCHEMA)
    return {r.path: (r.license, r.origin, r.license_path) for r in scan_licenses(df).collect()}


def test_own_and_inherited(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("a/b/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
        ("a/x.py", "print(1)"),
        ("a/b/c/y.py", None),
        ("a/b/z.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("other/q.py", ""),
        ("ab/q.py", "no word on it"),
        ("top.py", "x"),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    out = run(spark, rows)
    assert out["a/LICENSE"] == ("MIT", "own", "a/LICENSE")
    assert out["a/x.py"] == ("MIT", "inherited", "a/LICENSE")
    assert out["a/b/c/y.py"] == ("GPL-3.0", "inherited", "a/b/COPYING")
    assert out["a/b/z.py"] == ("Apache-2.0", "own", "a/b/z.py")
    assert out["other/q.py"] == out["ab/q.py"] == out["top.py"] == (None, None, None)
    assert out[None] == ("CC-BY-NC-4.0", "own", None)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([("d/f", "Released under the MIT License.", 1)] * 3, SCHEMA)
    assert [r.license for r in scan_licenses(df).collect()] == ["MIT"] * 3
    assert scan_licenses(df.limit(0)).count() == 0


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("concat(source, '/', doc_id) AS path", "text")
    rows, idf, other = template_weights()
    by = {}
    for t, i, _, w in rows:
        by.setdefault(i, {})[t] = w
    want = {}
    for r in docs.collect():
        best = (0.0, 0, None)
        for s in re.split(r"[\r\n]+|(?<=[a-z]{3}[.!?])\s+(?=\S)", r.text):
            if re.search(r"(?i)licen[sc]|copyright|spdx|redistribut|warrant|public domain|permission is hereby", s):
                tf = Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", s.lower()))
                norm = math.sqrt(sum((c * idf.get(t, other)) ** 2 for t, c in tf.items()))
                for i, w in by.items():
                    cos = sum(c * idf[t] * w[t] for t, c in tf.items() if t in w) / norm
                    if cos >= 0.6:
                        best = max(best, (round(cos, 9), -i, TEMPLATES[i][0]))
        want[r.path] = best[2]
    got = {r.path: r.license for r in scan_licenses(docs).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 5


HEADERS = {
    "GPL-2.0": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.""",
    "AGPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as
# published by the Free Software Foundation, either version 3 of the
# License, or (at your option) any later version.""",
    "LGPL-3.0": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Lesser General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}


def test_wrapped_headers_count_as_a_whole(spark):
    rows = [(f"{k}/x.c", f"/*\n{h}\n */\n\nint main;") for k, h in HEADERS.items()]
    assert {p: x[0] for p, x in run(spark, rows).items()} == {f"{k}/x.c": k for k in HEADERS}


def test_whole_texts_are_their_own_license(spark):
    lines = [(f"{i}/LICENSE", text.replace(", ", ",\n")) for i, (_, text) in enumerate(WHOLE)]
    out = run(spark, lines)
    assert [out[f"{i}/LICENSE"][0] for i in range(len(WHOLE))] == [k for k, _ in WHOLE]


def test_the_query_inherits(spark):
    rows = op7_licenses(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    given = {r.license_path for r in rows if r.origin == "inherited"}
    assert given and all("/LICENSE-" in p for p in given)
    by = {r.path: r.license for r in rows}
    assert all(r.license == by[r.license_path] for r in rows if r.origin == "inherited")
