"""License scans: normalised text against templates by the Dice coefficient over word bigrams.

Candidates are all stretches of words, wherever they start and end. Bounds prune them without loss: a stretch
whose number of bigrams is outside t / (2 - t) … (2 - t) / t of a template's can't reach the threshold t, neither
can one that holds fewer than t / (2 - t) of them that are the template's, and the best stretch begins and ends
with bigrams of the template. A stretch must also hold one of the bigrams that only this license's templates have,
if the template has any: "SPDX-License-Identifier:" alone names no license.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import in_slices, words

#: Public notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0-only": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-2.0-only": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "BSD-2-Clause": (
        "Licensed under the 2-Clause BSD License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

MATCHES = ArrayType(StructType([StructField("license", StringType()), StructField("template", IntegerType()), StructField("line", IntegerType()), StructField("lines", IntegerType()), StructField("dice", DoubleType())]))


def bigrams(own: list[bytes]) -> Counter:
    """Counts of pairs of neighbouring words; a single word pairs with an empty one."""
    return Counter(zip(own, own[1:] if len(own) > 1 else [b""], strict=False))


def dice(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[g]) for g, n in a.items() if g in b)
    total = sum(a.values()) + sum(b.values())
    return 2 * both / total if total else 0.0


class Scanner:
    """Templates prepared for one threshold."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least, self.all = least, []
        named: dict[tuple, set[str]] = {}
        for name, texts in templates.items():
            for t in texts:
                for g in bigrams(words(t)):
                    named.setdefault(g, set()).add(name)
        for name, texts in templates.items():
            for i, t in enumerate(texts):
                grams = bigrams(words(t))
                n = sum(grams.values())
                if n:
                    # Rounding must not cost a bound its last bigram.
                    low, high = max(1, math.ceil(n * least / (2 - least) - 1e-9)), n * (2 - least) / least + 1e-9
                    self.all.append((name, i, grams, n, low, high, {g for g in grams if len(named[g]) == 1}))
        self.by_gram: dict[tuple, list[int]] = {}
        for k, (_, _, grams, *_) in enumerate(self.all):
            for g in grams:
                self.by_gram.setdefault(g, []).append(k)
        #: Templates of one word, whose bigram no longer stretch has.
        self.single = {g[0] for g in self.by_gram if g[1] == b""}

    def stretches(self, at: list[int], grams: list[tuple], k: int) -> Iterator[tuple[float, int, int]]:
        """(Dice, first bigram, last bigram) of stretches that reach the threshold, given the template's bigrams in the text."""
        _, _, template, size, low, high, own = self.all[k]
        for a in range(len(at) - low + 1):
            first = at[a]
            if at[a + low - 1] - first + 1 > high:
                continue
            left: dict[tuple, int] = {}
            both, named = 0, not own
            for b in range(a, len(at)):
                n = at[b] - first + 1
                if n > high:
                    break
                g = grams[b]
                more = left.get(g, template[g])
                if more:
                    left[g] = more - 1
                    both += 1
                    named = named or g in own
                    d = 2 * both / (n + size)
                    if named and d >= self.least:
                        yield d, first, at[b]

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """Best match of each license: (license, template, first line, lines, Dice), least lines and templates first on ties."""
        if not text:
            return []
        own = words(text)
        by_gram = self.by_gram
        near: dict[int, tuple[list[int], list[tuple]]] = {}
        for p, g in enumerate(zip(own, own[1:], strict=False)):
            if g in by_gram:
                for k in by_gram[g]:
                    at, grams = near.setdefault(k, ([], []))
                    at.append(p)
                    grams.append(g)
        if self.single and not self.single.isdisjoint(own):
            for p, w in enumerate(own):
                for k in by_gram.get((w, b""), ()):
                    near.setdefault(k, ([], []))[0].append(p)
                    near[k][1].append((w, b""))
        best: dict[str, tuple] = {}
        ends: list[int] = []
        for k, (at, grams) in sorted(near.items()):
            name, i, _, size, low, *_ = self.all[k]
            if len(at) < low:
                continue
            one = grams[0][1] == b""
            for d, first, last in self.stretches(at, grams, k):
                if name in best and -d > best[name][0][0]:
                    continue
                # The number of words up to the end of each line says in which line a word stands.
                ends = ends or list(accumulate(len(words(x)) for x in text.split("\n")))
                start, end = bisect_right(ends, first), bisect_right(ends, last if one else last + 1)
                rank = (-d, end - start, start, i)
                if name not in best or rank < best[name][0]:
                    best[name] = (rank, (name, i, start, end - start + 1, d))
        return sorted((x for _, x in best.values()), key=lambda x: (-x[4], x[0]))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    least: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with the licenses found in its whole text.

    Returns ``key``, license (the best match, the first by name on ties; null if none), dice, n_licenses and
    matches (the best of each license). Words are [0-9a-z] or non-ASCII after lower-casing A-Z. Null and empty
    texts match nothing; repeated rows and null keys are kept; other columns aren't read; texts of any length are scanned
    whole; an empty table gives no rows. Equal scores go to fewer lines, then to the earlier line and template. Templates
    are a parameter held by each task, not a table.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("line", pa.int32()), ("lines", pa.int32()), ("dice", pa.float64())]))
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("t").to_pylist()]
            rows = [[dict(zip(("license", "template", "line", "lines", "dice"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(rows, kind)], names=["k", "matches"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = rows.mapInArrow(in_slices(scan), StructType([rows.schema["k"], StructField("matches", MATCHES)]))
    top = F.try_element_at("matches", F.lit(1))
    return rows.select(
        F.col("k").alias(key),
        top["license"].alias("license"),
        top["dice"].alias("dice"),
        F.size("matches").cast("long").alias("n_licenses"),
        "matches",
    )


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
