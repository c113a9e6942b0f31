"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A header or licence text may stand anywhere in a text, wrapped over lines or within a paragraph. So a text's passages are all its
windows of as many terms as a template has (the whole text, if it is shorter), and a licence file's whole text as well.
Vectors are sparse: a term's weight is its count times its inverse document frequency over all texts; terms of no
template have the weight of a term that is in one text, so only the frequencies of the templates' terms are counted and
sent. A text's own licence is the template of its highest cosine, if that is at or above the threshold.

The search is exact, but skips what cannot reach the threshold: a template of whose weight a text holds too little (by the
inequality of Cauchy and Schwarz), and windows whose dot product, a difference of running sums, is too small for
the least norm that a window with such terms can have.

Licence files give their licence to their directory, and a directory without one takes that of its nearest ancestor:
directories are joined with their ancestors' paths, then files with their directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from pagelantern.llm.common import added, cut, table

# Public licence texts, notices and headings, by SPDX identifier.
_DISCLAIMER = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("This program", "", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", _GNU.format("This program", "", "2").replace("software:", "software;")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", _GNU.format("This library", "Lesser ", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _GNU.format("This library", "Lesser ", "2.1").replace("software:", "software;")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", _GNU.format("This program", "Affero ", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "No rights reserved. Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher."),
]
TEMPLATES += [(f"CC-{k.upper()}-4.0", f"Licensed under CC {k.upper()} 4.0.") for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")]
TEMPLATES += [(f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {said} 4.0 International License.") for k, said in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"))]
TEMPLATES += [(k, f"SPDX-License-Identifier: {k}") for k in dict.fromkeys(k for k, _ in TEMPLATES if k != "Proprietary")]
EDGE = 1e-9  # cosines that differ by less are equal
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Templates:
    """The templates' weighted vectors, from the number of texts and how many hold each template term."""

    def __init__(self, seen: dict[str, int], texts: int):
        weight = lambda n: math.log((1 + texts) / (1 + n)) + 1
        bags = [Counter(terms(text)) for _, text in TEMPLATES]
        self.place = {t: i + 1 for i, t in enumerate(sorted(set().union(*bags)))}  # 0 is any other term
        self.weight = np.array([weight(1), *(weight(seen.get(t, 0)) for t in self.place)])
        self.long = [sum(bag.values()) for bag in bags]
        self.vectors = np.zeros((len(bags), len(self.weight)))
        for k, bag in enumerate(bags):
            for t, n in bag.items():
                self.vectors[k, self.place[t]] = n * self.weight[self.place[t]]
        self.norms = np.sqrt((self.vectors**2).sum(1))

    def cosine(self, k: int, window: np.ndarray, words: list[str]) -> float:
        """The cosine of a window of terms (their places and words) to template k."""
        size = sum((n * self.weight[self.place.get(t, 0)]) ** 2 for t, n in Counter(words).items())
        return float((self.weight[window] * self.vectors[k, window]).sum() / (math.sqrt(size) * self.norms[k]))

    def best(self, text: str, threshold: float, whole: bool = False) -> tuple[float, str | None, int]:
        """(cosine, licence, term where the window starts) of the best window at or above the threshold, else (0, None, -1).

        Of equal windows the first template's first one counts; whole: the whole text is a window too, starting at -1.
        """
        words, top = terms(text), (0.0, None, -1)
        places = np.fromiter(map(self.place.get, words, repeat(0)), dtype=np.int64, count=len(words))
        held = np.zeros(len(self.weight))
        held[places] = 1
        held[0] = 0
        reach = np.sqrt((self.vectors**2) @ held) / self.norms  # no window's cosine is more
        own = self.weight[places]
        norms = np.sqrt(np.r_[0, np.cumsum(own**2)])
        for k in np.flatnonzero(reach >= threshold - EDGE).tolist():
            n = min(self.long[k], len(words))
            dots = np.r_[0, np.cumsum(own * self.vectors[k, places])]
            most = (dots[n:] - dots[: len(dots) - n]) / (np.sqrt(np.maximum(norms[n:] ** 2 - norms[: len(norms) - n] ** 2, 1e-12)) * self.norms[k])
            likely = np.flatnonzero(most >= max(threshold, top[0]) - EDGE)
            met = set()
            for i in likely[np.argsort(-most[likely], kind="stable")].tolist():
                if most[i] < top[0] - EDGE:
                    break
                window = tuple(words[i : i + n])
                if window not in met:  # windows of repeated text are compared once
                    met.add(window)
                    near = self.cosine(k, places[i : i + n], words[i : i + n])
                    if near >= threshold - EDGE and near > top[0] + EDGE:
                        top = (near, TEMPLATES[k][0], i)
            if whole and (near := self.cosine(k, places, words)) >= threshold - EDGE and near > top[0] + EDGE:
                top = (near, TEMPLATES[k][0], -1)
        return top

    def own(self, text: str | None, whole: bool, threshold: float) -> tuple[str | None, float, int | None]:
        """(licence, cosine, line from 0 where the best window starts, -1 for a whole licence file); (None, 0, None) below the threshold."""
        near, name, at = self.best(text or "", threshold, whole)
        if name is None:
            return None, 0.0, None
        low = (text or "").lower()
        return name, near, -1 if at < 0 else low.count("\n", 0, next(islice(TERM.finditer(low), at, None)).start())


def learn(docs: DataFrame) -> Templates:
    """Document frequencies of the templates' terms over all texts."""
    words = frozenset(t for _, text in TEMPLATES for t in terms(text))

    def of(texts):
        return [[" ".join(sorted(words.intersection(terms(t or "")))) for t in texts]]

    held = added(docs.select("text"), "text", of, {"held": StringType()}).select("held")
    seen = held.select(F.explode(F.split("held", " ")).alias("term")).where("term <> ''").groupBy("term").count()
    return Templates({r["term"]: r["count"] for r in seen.collect()}, docs.count())  # as many rows as template terms


def scan(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs (path, text, any others but those that follow) with own_license, score, line, license and from_dir.

    own_license and line are null and score is 0 below the threshold, and for null or empty texts. line is where the best
    window starts, -1 if it is a licence file's whole text. license is the own one or else that of the
    nearest ancestor directory with a licence file (own directory first), from_dir that directory. Of several licence
    files in a directory the highest score counts, then the first name. A null path has no directory. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))
    base = F.substring_index(F.coalesce("path", F.lit("")), "/", -1)
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))

    def of(rows):
        return zip(*(sent.value.own(r["text"], r["file"], threshold) for r in rows))

    marked = docs.withColumn("row", F.struct("text", base.rlike(FILE).alias("file"))).withColumn("from_file", base.rlike(FILE)).drop("text")
    marked = added(marked, "row", of, {"own_license": StringType(), "score": DoubleType(), "line": IntegerType()}).drop("row")
    marked = marked.withColumn("dir", folder)
    marked = cut(marked)
    given = marked.where("from_file and own_license is not null and dir is not null").groupBy("dir")
    given = cut(given.agg(F.min_by("own_license", F.struct(-F.col("score"), "own_license")).alias("given")))
    dirs = marked.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    above = dirs.select("dir", F.explode(above).alias("x")).select("dir", "x.*").distinct()
    near = above.join(given.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by(F.struct("given", "at"), "depth").alias("near"))
    near = cut(near)
    out = marked.join(near, "dir", "left")
    out = out.withColumns({"license": F.coalesce("own_license", "near.given"), "from_dir": F.when(F.col("own_license").isNull(), F.col("near.at"))})
    return out.drop("dir", "near", "from_file")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, laid out by id: a hundred to a directory, the first of each its LICENSE file."""
    k = "doc_id"
    path = F.expr(f"concat('a', {k} div 10000, '/b', {k} div 1000, case when {k} % 1000 = 0 then '/LICENSE' when {k} % 100 = 0 then concat('/c', {k} div 100, '/LICENSE') else concat('/c', {k} div 100, '/', {k}, '.txt') end)")
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return scan(docs).select("doc_id", "path", "own_license", F.round("score", 6).alias("score"), "line", "license", "from_dir")
