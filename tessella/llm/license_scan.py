"""License scans (operator 8), DataFrame operations only.

Windows of lines of a file are compared with licence headers and texts by the
cosine of sparse TF-IDF vectors, and a licence file as a whole as well. A
directory has the licence of its licence file; a file without a licence of its
own inherits from its nearest ancestor directory that has one.

* A window is 1, 2, 4, 8 or 16 lines (``WINDOW_LINES``) that hold a letter or a
  digit, so a header may be wrapped, indented and commented in any way. All
  lines of a file are looked at, not the first few. Windows start at every line,
  those of more than four lines at every quarter of their length and at the end.
* Document frequencies of all terms are counted over all files, added up before
  they are shuffled. Those of the templates' terms go into the model; terms of
  no template meet theirs by an equi-join and add to a window's norm.
* The best template of a window isn't only the nearest: texts go before notices,
  long before short if both are near enough, since a part of a text is nearer to a short template, and a
  generic notice ("All rights reserved.") goes last. A template needs the words
  that tell its licence from others of the kind, as version numbers, and the
  window none that tell another family. A licence file's whole text goes before
  its windows.
* Scores are computed inside a row by higher-order functions. Only windows with a
  telling term are scored: the terms are chosen, rare ones first, so that, by
  Cauchy-Schwarz, a window without any can't reach the least score. Of those only
  the ones that would reach it if each other term had the least weight there is
  meet the join.
* Inheritance joins distinct directories, exploded into their ancestors, with
  licensed directories by equality, and files with directories at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._cluster import cut

#: Headers and texts by licence identifier, as their publishers word them.
NOTICES: dict[str, list[str]] = {
    "AGPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to
        copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free,
        copyleft license for software and other kinds of works.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.
        "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.
        "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.""",
    ],
    "Artistic-1.0": [
        """The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder
        maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the
        Package in a more-or-less customary fashion, plus the right to make reasonable modifications.""",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        """Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS
        DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS" BASIS.""",
    ],
    "GFDL-1.2": [
        """GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000,2001,2002 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA
        02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
    ],
    "GFDL-1.3": [
        """GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. <https://fsf.org/>
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
    ],
    "GPL-1.0": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 1, or (at your option) any later version.""",
        """GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The license agreements of most
        software companies try to keep users at the mercy of those companies.""",
    ],
    "GPL-2.0": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version.""",
        """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim
        copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and
        change it.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""",
        """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and
        distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for
        software and other kinds of works.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies.""",
    ],
    "LGPL-2.0": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free
        Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        """GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA
        02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. [This is the first
        released version of the library GPL. It is numbered 2 because it goes with version 2 of the ordinary GPL.]""",
    ],
    "LGPL-2.1": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston,
        MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. [This is the first
        released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.]""",
    ],
    "LGPL-3.0": [
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy
        and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates
        the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "MPL-1.1": [
        """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.mozilla.org/MPL/""",
        """MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. "Commercial Use" means distribution or otherwise making the Covered Code available to a third party.
        1.1. "Contributor" means each entity that creates or contributes to the creation of Modifications.""",
    ],
    "MPL-2.0": [
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns
        Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular
        Contributor's Contribution.""",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at http://mozilla.org/MPL/2.0/.""",
    ],
    "Proprietary": ["All rights reserved."],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
}
#: Words that tell a licence from those of its kind; a window without those that a template has isn't it.
MARKS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("gnu", "affero", "3"),
    "Apache-2.0": ("apache", "2"),
    "Artistic-1.0": ("artistic",),
    "BSD-2-Clause": ("redistributions", "disclaimer"),
    "BSD-3-Clause": ("redistributions", "endorse"),
    "CC-BY-NC-4.0": ("nc", "noncommercial", "4"),
    "CC0-1.0": ("cc0",),
    "GFDL-1.2": ("gnu", "1", "2"),
    "GFDL-1.3": ("gnu", "1", "3"),
    "GPL-1.0": ("gnu", "1"),
    "GPL-2.0": ("gnu", "2"),
    "GPL-3.0": ("gnu", "3"),
    "ISC": ("fee", "appear"),
    "LGPL-2.0": ("gnu", "library", "2"),
    "LGPL-2.1": ("gnu", "lesser", "2", "1"),
    "LGPL-3.0": ("gnu", "lesser", "3"),
    "MIT": ("charge", "obtaining", "deal"),
    "MPL-1.1": ("mozilla", "commercial", "1"),
    "MPL-2.0": ("mozilla", "owns", "2"),
    "Unlicense": ("unencumbered",),
}
#: Words of families; a window that has one which a template lacks is of another family.
FAMILIES = ("affero", "documentation", "lesser", "library", "mozilla")
#: What is said beside a licence as well as without one: it only counts where no licence does.
GENERIC = ("Proprietary",)
#: From this score on a template counts before longer ones below it.
SURE_SCORE = 0.85
#: Terms of a licence text; a shorter template is a notice, which counts after texts.
TEXT_TERMS = 30
#: Lines of the windows that are compared; a template of any length is about as long as one of them.
WINDOW_LINES = (1, 2, 4, 8, 16)
#: Names of licence files, lower case, before a suffix.
LICENCE_FILES = ("license", "licence", "copying", "notice")
#: What cosine a line needs.
LEAST_SCORE = 0.7


def terms(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda x: x != "")


def _terms(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.translate({k: k + 32 for k in range(65, 91)})).split()


def vocabulary(notices: Mapping[str, Sequence[str]]) -> list[str]:
    """All terms of the templates."""
    return sorted({t for texts in notices.values() for text in texts for t in _terms(text)})


def windows(lines: Column) -> Column:
    """The terms of each window that has a told line, of an array of lines ``t, told``."""
    n = F.size(lines)

    def of(size: int) -> Column:
        last = F.greatest(n - size, F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(max(1, size // 4))), F.array(last)))
        told = F.filter(starts, lambda s: F.exists(F.slice(lines, s + 1, size), lambda x: x["told"]))
        return F.when(2 * n > size, F.transform(told, lambda s: F.flatten(F.transform(F.slice(lines, s + 1, size), lambda x: x["t"])))).otherwise(F.array().cast("array<array<string>>"))

    return F.concat(*[of(size) for size in WINDOW_LINES])


def any_of(words: Sequence[str]) -> str:
    """A regular expression for any of some words of a-z and 0-9, letter by letter, so that few are tried at a place."""

    def node(rest: list[str]) -> str:
        tails: dict[str, list[str]] = {}
        for word in rest:
            if word:
                tails.setdefault(word[0], []).append(word[1:])
        branches = "|".join(first + node(tails[first]) for first in sorted(tails))
        if not branches:
            return ""
        return f"(?:{branches})" + "?" * ("" in rest)

    return f"(?<![a-z0-9]){node(sorted(words))}(?![a-z0-9])"


def traits(name: str, text: str) -> tuple[int, int, list[str], list[str]]:
    """``tier, size, needs, family`` of a template: 2 for a text, 1 for a notice, 0 for a generic one; its terms; words that a window must, and that it may have."""
    own = _terms(text)
    tier = 0 if name in GENERIC else 2 if len(own) >= TEXT_TERMS else 1
    return tier, len(own), [m for m in MARKS.get(name, ()) if m in own], [f for f in FAMILIES if f in own]


class Templates:
    """TF-IDF vectors of headers and texts for ``n`` files and the document frequencies ``df`` of their terms."""

    def __init__(self, notices: Mapping[str, Sequence[str]], n: int, df: Mapping[str, int], least: float):
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary(notices)}
        self.vectors: list[tuple[str, dict[str, float]]] = []
        self.traits: list[tuple[int, int, list[str], list[str]]] = []
        for name, text in ((name, text) for name in sorted(notices) for text in notices[name]):
            weights = {t: k * self.idf[t] for t, k in sorted(Counter(_terms(text)).items())}
            norm = math.sqrt(math.fsum(w * w for w in weights.values()))
            if norm:
                self.vectors.append((name, {t: w / norm for t, w in weights.items()}))
                self.traits.append(traits(name, text))
        self.telling = self._telling(least)

    def _telling(self, least: float) -> list[str]:
        """Terms of which a window that reaches ``least`` has one: what is left of each unit vector without them is shorter."""
        out: set[str] = set()
        for _, weights in self.vectors:
            left = {t: w for t, w in weights.items() if t not in out}
            while left and math.sqrt(math.fsum(w * w for w in left.values())) >= least - 1e-9:
                rarest = max(left, key=lambda t: (self.idf[t], left[t], t))
                out.add(rarest)
                del left[rarest]
        return sorted(out)

    def best(self, words: Column, least: float, other: Column | None = None) -> Column:
        """``tier, sure, size, score, name`` of the template that an array of terms is taken for, null if none; equal ones go to the greater name.

        ``other`` is the sum of the squared weights of those terms that no template
        has; without it the score is the greatest that there can be.
        """
        weight = F.create_map(*[F.lit(x) for t, w in self.idf.items() for x in (t, w)])
        # one literal map from a term to its weight in every template keeps the expression, and what is compiled of it, small
        texts = lambda own: F.array(*[F.lit(x) for x in own]).cast("array<string>")
        known = F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(size).alias("size"), F.lit(name).alias("name"), texts(needs).alias("needs"), texts(family).alias("family")) for (name, _), (tier, size, needs, family) in zip(self.vectors, self.traits, strict=True)])
        unit = F.create_map(*[x for t in self.idf for x in (F.lit(t), F.array(*[F.lit(v.get(t, 0.0)) for _, v in self.vectors]))])
        marks = texts(sorted({m for _, _, needs, _ in self.traits for m in needs} | set(FAMILIES)))
        own = F.array_sort(F.array_intersect(words, F.array(*[F.lit(t) for t in self.idf])))
        counted = F.transform(own, lambda t: F.struct(t.alias("t"), F.size(F.filter(words, lambda x: x == t)).alias("k")))
        rest = (lambda x: F.size(words) - F.aggregate(x, F.lit(0), lambda a, c: a + c["k"])) if other is None else lambda _: other  # a weight is 1 at least
        have = F.array_intersect(words, marks)
        counts = F.transform(F.array(counted), lambda x: F.struct(F.transform(x, lambda c: F.struct(c["t"].alias("t"), (c["k"] * weight[c["t"]]).alias("w"))).alias("counts"), rest(x).cast("double").alias("other"), have.alias("have")))

        def scored(x: Column) -> Column:
            norm = F.sqrt(F.aggregate(x["counts"], x["other"], lambda a, c: a + c["w"] * c["w"]))
            dots = F.aggregate(x["counts"], F.array(*[F.lit(0.0) for _ in self.vectors]), lambda a, c: F.zip_with(a, unit[c["t"]], lambda s, u: s + c["w"] * u))
            scores = F.transform(dots, lambda d: F.round(F.when(norm > 0, d / norm).otherwise(0.0), 6))
            near = F.filter(F.zip_with(scores, known, lambda s, t: F.struct(s.alias("score"), t.alias("of"))), lambda z: z["score"] >= least)
            foreign = lambda z: F.array_except(F.array_intersect(x["have"], texts(FAMILIES)), z["of"]["family"])
            fits = F.filter(near, lambda z: (F.size(F.array_except(z["of"]["needs"], x["have"])) == 0) & (F.size(foreign(z)) == 0))
            return F.array_max(F.transform(fits, lambda z: F.struct(z["of"]["tier"].alias("tier"), (z["score"] >= SURE_SCORE).alias("sure"), z["of"]["size"].alias("size"), z["score"].alias("score"), z["of"]["name"].alias("name"))))

        return F.transform(counts, scored)[0]


def license_scan(
    files: DataFrame, id_col: str, path: str, text: str, notices: Mapping[str, Sequence[str]] = NOTICES, least: float = LEAST_SCORE,
) -> DataFrame:
    """``<id_col>, path, license, score, origin, directory`` for each row of ``files``.

    ``origin`` is ``header`` (a window of the file reaches ``least``), ``file`` (a
    licence file as a whole does, which goes before its windows), ``inherited`` (from the licence
    file of ``directory``, the nearest of the file's own directory and those
    above it) or null. Of a file's templates the longest text counts (those of
    ``SURE_SCORE`` before others), then the longest notice, a generic notice last; equal ones by score, then the greater
    identifier. Of several licence files in a directory the best counts.

    Null and empty texts have no notice but inherit. A null path is in no
    directory, and null ids and repeated rows stay. A very long line has a low
    cosine and costs one pass. Other columns are not read, so their names can't
    clash; an empty table gives no rows.
    """
    rows = files.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = vocabulary(notices)
    counted = cut(rows.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(terms(F.col("text"))))).alias("t")).groupBy("t").agg(F.count("*").alias("df")), "license-df")
    df = {r["t"]: r["df"] for r in counted.where(F.col("t").isin("", *known)).collect()}  # at most a row per term of a template
    n = df.get("", 0)
    model = Templates(notices, n, df, least)

    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    stem = F.substring_index(F.lower(F.element_at(F.split("path", "/"), -1)), ".", 1)
    is_file = F.coalesce(stem.isin(*LICENCE_FILES), F.lit(False))
    hint = any_of(model.telling)
    told = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike(hint)
    lines = F.filter(F.transform(F.split("text", "[\\n\\r]+"), lambda x: F.struct(terms(x).alias("t"), told(x).alias("told"))), lambda x: F.size(x["t"]) > 0)
    heard = F.filter(F.transform(F.array(lines), windows)[0], lambda x: model.best(x, least).isNotNull())
    whole = terms(F.col("text"))
    hinted = rows.select("_id", "path", "text", folder.alias("folder"), is_file.alias("is_file"), told(F.col("text")).alias("told"))
    heard = hinted.select("_id", "path", "folder", "is_file", F.when(F.col("told"), heard).alias("heard"), F.when(F.col("is_file") & F.col("told"), whole).alias("whole"))
    heard = cut(heard.withColumn("row", F.monotonically_increasing_id()), "license-heard")
    # terms of scored windows that no template has, the whole file as window -1
    others = F.concat(F.coalesce(F.transform("heard", lambda x, k: F.struct(k.alias("k"), x.alias("t"))), F.array()), F.array(F.struct(F.lit(-1).alias("k"), F.coalesce("whole", F.array().cast("array<string>")).alias("t"))))
    others = heard.where("size(heard) > 0 or size(whole) > 0").select("row", F.explode(others).alias("x")).select("row", "x.k", F.explode("x.t").alias("t"))
    others = others.where(~F.col("t").isin(*known)).groupBy("row", "k", "t").agg(F.count("*").alias("c"))
    weight = F.col("c") * (F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1)
    others = others.join(counted, "t").groupBy("row", "k").agg(F.sum(weight * weight).alias("w"))
    others = others.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("others"))
    other = lambda k: F.coalesce(F.try_element_at("others", k), F.lit(0.0))
    header = F.array_max(F.filter(F.transform("heard", lambda x, k: model.best(x, least, other(k))), lambda x: x.isNotNull()))
    scored = heard.join(others, "row", "left").select("_id", "path", "folder", "is_file", header.alias("header"), F.when(F.size("whole") > 0, model.best(F.col("whole"), least, other(F.lit(-1)))).alias("whole"))
    scored = cut(scored, "license-scored")
    own = F.when(F.col("whole").isNotNull() & (F.col("header").isNull() | (F.col("whole.tier") > 0) | (F.col("header.tier") == 0)), F.struct(F.col("whole").alias("best"), F.lit("file").alias("origin"))).when(F.col("header").isNotNull(), F.struct(F.col("header").alias("best"), F.lit("header").alias("origin")))
    scored = scored.withColumn("own", own)

    licensed = scored.where("is_file and own is not null and folder is not null").groupBy(F.col("folder").alias("above")).agg(F.max("own.best").alias("given"))
    steps = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")))
    folders = scored.select("folder").where("folder is not null").distinct().select("folder", F.explode(chain).alias("x")).select("folder", "x.depth", "x.above")
    inherited = folders.join(licensed, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("from"))
    out = scored.join(inherited, "folder", "left")
    takes = F.col("own").isNull() & F.col("from").isNotNull()
    return out.select(
        F.col("_id").alias(id_col),
        "path",
        F.coalesce("own.best.name", "from.given.name").alias("license"),
        F.coalesce("own.best.score", "from.given.score").alias("score"),
        F.when(takes, F.lit("inherited")).otherwise(F.col("own.origin")).alias("origin"),
        F.when(takes, F.col("from.above")).alias("directory"),
    )
