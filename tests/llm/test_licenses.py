import random
from collections import Counter

import pytest

from pagelantern.llm import licenses


def test_each_template_is_its_own():
    t = licenses.Templates({}, 100)
    for name, text in licenses.TEMPLATES:
        near, said, at = t.best("some words " + text + " and more", 0.7)
        assert near > 0.999 and said == name and at <= 2, (name, said, text)


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, "MIT"), ("# " + MIT.replace("\n", "\n# "), "MIT"),
        ("A first sentence here. Licensed under the Apache License, Version 2.0. And a last one on the same line.", "Apache-2.0"),
        ("/*\n * Licensed under the Apache License,\n * Version 2.0 (the License); you may not\n * use this file except in compliance\n * with the License.\n */", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3", "AGPL-3.0"),
        ("// SPDX-License-Identifier: LGPL-2.1\nint main() {}", "LGPL-2.1"), ("Copyright 2020. Redistribution and use in source and binary forms, with or without\nmodification, are permitted", None), ("a license to kill and a permit to fish", None), ("", None), (None, None),
    ],
)
def test_wrapped_headers_and_files(text, want):
    assert licenses.Templates({}, 10_000).own(text, False, 0.7)[0] == want


def slow_best(t, text, threshold):
    """The best window by computing all cosines from counted words."""
    idf = lambda w: t.weight[t.place.get(w, 0)]
    words, top = licenses.terms(text), (0.0, None)
    for name, template in licenses.TEMPLATES:
        bag = Counter(licenses.terms(template))
        n = min(sum(bag.values()), len(words))
        size = sum((c * idf(w)) ** 2 for w, c in bag.items()) ** 0.5
        for i in range(len(words) - n + 1 if words else 0):
            own = Counter(words[i : i + n])
            near = sum(c * idf(w) * bag[w] * idf(w) for w, c in own.items()) / (size * sum((c * idf(w)) ** 2 for w, c in own.items()) ** 0.5)
            if near >= threshold - 1e-9 and near > top[0] + 1e-9:
                top = (near, name)
    return top


def test_search_equals_all_cosines():
    rng = random.Random(3)
    vocabulary = sorted({w for _, text in licenses.TEMPLATES for w in licenses.terms(text)}) + ["tree", "house", "river", "stone"] * 30
    t = licenses.Templates({w: rng.randrange(500) for w in vocabulary}, 500)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = licenses.terms(rng.choice(licenses.TEMPLATES)[1])
            at = rng.randrange(len(words))
            parts += words[at : at + rng.randint(2, 40)] + rng.choices(vocabulary, k=rng.randint(0, 12)) + [rng.choice(words)] * rng.randint(0, 6)
        text = " ".join(parts)
        near, name, _ = t.best(text, 0.7)
        slow, said = slow_best(t, text, 0.7)
        assert abs(near - slow) < 1e-6 and (name == said or abs(near - slow) < 1e-9)


def test_own_and_inherited(frame):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit), ("a.txt", "words only"), ("x/b.txt", "some words"), ("x/COPYING", "intro\n" + gpl), ("x/y/c.txt", None), ("x/y/z/LICENSE.md", "nothing here"),
        ("x/y/z/d.txt", ""), ("p/e.txt", "text\nLicensed under the Apache License, Version 2.0.\n"), (None, mit), ("p/f.txt", "a license to speak freely was granted by the king in those old days of wonder"), ("q/g.txt", "w " * 100000),
    ]
    got = {r.path: r for r in licenses.scan(frame([(*r, "k") for r in rows], "path string, text string, license string")).collect()}
    want = {"LICENSE": ("MIT", "MIT", None), "a.txt": (None, "MIT", ""), "x/b.txt": (None, "GPL-3.0", "x"), "x/COPYING": ("GPL-3.0", "GPL-3.0", None), "x/y/c.txt": (None, "GPL-3.0", "x"), "x/y/z/LICENSE.md": (None, "GPL-3.0", "x"), "x/y/z/d.txt": (None, "GPL-3.0", "x"), "p/e.txt": ("Apache-2.0", "Apache-2.0", None), None: ("MIT", "MIT", None), "p/f.txt": (None, "MIT", ""), "q/g.txt": (None, "MIT", "")}
    assert {p: (r.own_license, r.license, r.from_dir) for p, r in got.items()} == want
    assert licenses.scan(frame([], "path string, text string")).count() == 0


def test_query_on_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    rows = licenses.op6_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = {v for k, v in lines.items() if k in texts[r.doc_id].split("\n")}
        assert (r.own_license in own) if own else r.own_license is None or r.score >= 0.7
