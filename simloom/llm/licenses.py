"""Licences of texts by canonical digest lookup, in DataFrame functions alone.

A text, each of its paragraphs and each of its lines is normalised: lower case,
copyright lines dropped, equivalent spellings made one, and every run of other
characters than letters and digits one space.  The digest of what is left is
joined with the digests of known licence texts and notices, which are
normalised by the same expressions; the known table has a fixed, small size and
is broadcast.  Marks before a copyright line, as in a commented header, belong
to the line.
"""

from __future__ import annotations

import re
import textwrap
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of licences as notices have them.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT license (MIT)"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0 License"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
# How a notice grants a licence; {} is its name.
GRANTS = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.",
    "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "This project is licensed under the {}.",
    "This software is licensed under the {}.", "This software is released under the {}.", "This program is licensed under the {}.",
    "This file is licensed under the {}.", "Available under the {}.", "{}", "The {}", "License: {}",
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
#: Whole licence texts, by paragraphs.
TEXTS: dict[str, tuple[str, ...]] = {"MIT": _MIT, "ISC": _ISC}
#: Licences whose whole texts are files; their paragraphs stand in other licences too.
FILES = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
_TITLES = {"Apache-2.0": ("Apache License",), "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"), "Unlicense": ("The Unlicense", "Unlicense")}
_APPENDIX = re.compile(r"\n[^\n]*END OF TERMS AND CONDITIONS[^\n]*\n")


def _gnu(what: str, name: str, version: str) -> tuple[str, ...]:
    """Paragraphs of the GNU licences' notices that tell which licence it is."""
    start, under = f"This {what} is free software{{}} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation", f"version {version} of the License"
    ends = (f"{under}.", f"either {under}, or (at your option) any later version.", f"either {under}, or any later version.")
    return tuple(f"{start.format(mark)}{comma} {end}" for mark in (";", ":") for comma in (",", ";") for end in ends)


def _cc(name: str, path: str) -> tuple[str, ...]:
    first = f"This work is licensed under {{}} Creative Commons {name} 4.0 International License."
    ends = ("send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", "send a letter to Creative Commons, 444 Castro Street, Suite 900, Mountain View, California, 94041, USA.")
    where = f"To view a copy of this license, visit http://creativecommons.org/licenses/{path}/4.0/"
    return tuple(f"{first.format(a)}{more}" for a in ("the", "a") for more in ("", f" {where}.", *(f" {where} or {end}" for end in ends)))


#: Standard headers, by paragraphs that are one licence's alone.
HEADERS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding "
        'copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    "GPL-2.0": (*_gnu("program", "General Public License", "2"), *_gnu("file", "General Public License", "2")),
    "GPL-3.0": (*_gnu("program", "General Public License", "3"), *_gnu("file", "General Public License", "3")),
    "LGPL-2.1": (*_gnu("library", "Lesser General Public License", "2.1"), *_gnu("program", "Lesser General Public License", "2.1")),
    "LGPL-3.0": (*_gnu("library", "Lesser General Public License", "3"), *_gnu("program", "Lesser General Public License", "3")),
    "AGPL-3.0": (*_gnu("program", "Affero General Public License", "3"), *_gnu("file", "Affero General Public License", "3")),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": tuple(
        f"{mark} Neither the name of {a} nor the names of {b} contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        for mark in ("3.", "*") for a in ("the copyright holder", "the author", "the organization", "the project") for b in ("its", "other")
    ),
    "CC-BY-4.0": _cc("Attribution", "by"), "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "by-sa"), "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "by-nc"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "by-nd"), "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "by-nc-sa"),
}

#: Equivalent spellings, as regular expressions that both engines read alike.
SPELLINGS = (("licen[cs]e", "license"), ("https?://(www\\.)?", ""), ("\\bv(er|ersion)?\\.? ?([0-9])", "version $2"), ("©|\\(c\\)", "copyright"), ("organisation", "organization"), ("&", " and "))
_COPYRIGHT_LINE = "(?m)^[^\\p{L}\\p{N}\\n]*(copyright|©|\\(c\\)|all rights reserved)[^\\n]*$"
_OTHERS = "[^\\p{L}\\p{N}\\n]+"


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all known texts, paragraphs of texts and notices."""
    out = {(spdx, grant.format(name)) for spdx, names in NAMES.items() for name in names for grant in GRANTS}
    out |= {(spdx, f"SPDX-License-Identifier: {spdx}{more}") for spdx in NAMES for more in ("", "-only", "-or-later")}
    for spdx, parts in TEXTS.items():
        whole = "\n\n".join(parts)
        out |= {(spdx, whole), *((spdx, f"{head}\n\n{whole}") for head in (f"{spdx} License", f"The {spdx} License", f"The {spdx} License ({spdx})"))}
        out |= {(spdx, part) for part in parts}
    for spdx in FILES:
        whole = (files(__package__) / "licence_texts" / f"{spdx}.txt").read_text(encoding="utf-8")
        # With and without what follows the terms, titles, and numbers of clauses.
        wholes = {whole, _APPENDIX.split(whole)[0]} | ({re.sub(r"(?m)^[1-3]\. ", "", whole)} if spdx.startswith("BSD") else set())
        out |= {(spdx, head + text) for text in wholes for head in ("", *(f"{title}\n\n" for title in _TITLES.get(spdx, ())))}
    out |= {(spdx, part) for spdx, parts in HEADERS.items() for part in parts}
    # The same wrapped in other places, where a line would begin as a copyright line does.
    begins = re.compile(r"(?im)^[^\w\n]*(copyright|\(c\)|all rights reserved)")
    for spdx, text in list(out):
        parts = re.split(r"\n\s*\n", text)
        first = sum(bool(begins.match(x)) for x in parts)
        for width in (10**6, *range(60, 81)) if "copyright" in text.lower() and len(text) < 2500 else ():
            wrapped = "\n\n".join(textwrap.fill(" ".join(x.split()), width, break_long_words=False, break_on_hyphens=False) for x in parts)
            if len(begins.findall(wrapped)) > first:
                out.add((spdx, wrapped))
    return sorted(out)


def normalised(text: Column) -> Column:
    """Canonical form of a text, its line ends kept."""
    x = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        x = F.regexp_replace(x, a, b)
    return F.regexp_replace(x, _OTHERS, " ")


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\n]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest, license``: one row for each known digest, some hundreds in all."""
    rows = spark.createDataFrame(known_texts(), "license string, text string")
    return rows.select(F.sha2(_flat(normalised(F.col("text"))), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, n_text, n_paragraph, n_line``: one row for each document and licence it has.

    The counts tell how many of the whole text, its paragraphs and its lines are
    known.  A document without any has one row with a null licence and zeros, as
    have null and empty texts.  Repeated ids are one document, whose rows add
    up; a null id is one too.  Other columns are not read.
    """
    text = normalised(F.col(text_col).cast("string"))
    units = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("x"))
    one = lambda kind, of: F.transform(of, lambda u: F.struct(F.lit(kind).alias("kind"), _flat(u).alias("x")))
    split = F.concat(one("text", F.array("x")), one("paragraph", F.split("x", "\\n ?\\n+")), one("line", F.split("x", "\\n")))
    each = units.select("doc_id", F.explode(split).alias("u")).where("u.x != ''").select("doc_id", "u.kind", F.sha2("u.x", 256).alias("digest"))
    found = each.join(F.broadcast(known_digests(docs.sparkSession)), "digest")
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).cast("long").alias(f"n_{kind}")
    counts = found.groupBy("doc_id", "license").agg(count("text"), count("paragraph"), count("line"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return ids.join(counts.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "license", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_text", "n_paragraph", "n_line"))
    )


def oracle() -> str:
    """The same rows over the tables of the registered query, in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_texts())
    x = f"regexp_replace(lower(t), {quote(_COPYRIGHT_LINE)}, '', 'g')"
    for a, b in SPELLINGS:
        x = f"regexp_replace({x}, {quote(a)}, {quote(b.replace('$', chr(92)))}, 'g')"
    canonical = f"regexp_replace({x}, {quote(_OTHERS)}, ' ', 'g')"
    flat = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
    return f"""
with known as (
  select sha256({flat("c")}) as digest, min(license) as license
  from (select license, {canonical} as c from (values {values}) as k(license, t)) group by 1),
units as (select doc_id, {canonical} as x from (select doc_id, text as t from documents where text is not null)),
each as (
  select doc_id, 'text' as kind, x as u from units
  union all select doc_id, 'paragraph', unnest(regexp_split_to_array(x, '\\n ?\\n+')) from units
  union all select doc_id, 'line', unnest(string_split(x, chr(10))) from units),
digests as (select doc_id, kind, sha256(f) as digest from (select doc_id, kind, {flat("u")} as f from each) where f != ''),
counts as (
  select doc_id, license, count(*) filter (kind = 'text') as n_text, count(*) filter (kind = 'paragraph') as n_paragraph, count(*) filter (kind = 'line') as n_line
  from digests join known using (digest) group by 1, 2)
select d.doc_id, c.license, coalesce(n_text, 0)::bigint as n_text, coalesce(n_paragraph, 0)::bigint as n_paragraph, coalesce(n_line, 0)::bigint as n_line
from (select distinct doc_id from documents) d left join counts c on d.doc_id is not distinct from c.doc_id"""
