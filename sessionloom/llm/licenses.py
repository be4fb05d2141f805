"""License scans: sparse TF-IDF cosine of license lines, blocks and files to templates, then inheritance from the nearest directory above.

Only DataFrame functions run here. The templates are fixed and small, so they are broadcast; document frequencies are
counted for every token over all segments of all files and joined back by shuffle, those of the commonest tokens by broadcast.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.shared import narrow_side, written

#: Short notices by license id.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms are permitted under the simplified 2-clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the 3-clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
_GNU = {"AGPL-3.0": ("GNU Affero General Public License", 3), "GPL-2.0": ("GNU General Public License", 2), "GPL-3.0": ("GNU General Public License", 3), "LGPL-3.0": ("GNU Lesser General Public License", 3)}
_GNU_TERMS = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
#: Usual headers and titles by license id.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "ISC License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((license, _GNU_TERMS.format(*of)) for license, of in _GNU.items()),
    *((license, f"{_GNU_TERMS} {_GNU_REST}".format(*of)) for license, of in _GNU.items()),
)
#: The licenses whose full text lies in licensetexts.
FULL = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0")
#: Lines that a header at the beginning of a file may consist of.
COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|$)"
#: A line is a license line if its lower-cased text holds one of these.
STEMS = ("licens", "licence", "copyright", "spdx", "redistribut", "public domain", "creative commons")
THRESHOLD = 0.6
#: A token with at least this fraction of all frequencies is common: so few are broadcast, so that none outgrows a task.
COMMON = 1000
TOKEN = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"


def full_text(license: str) -> str:
    return pkgutil.get_data("sessionloom.llm", f"licensetexts/{license}.txt").decode()


def templates() -> list[tuple[str, int, str]]:
    """(license, form, text): the notices, headers, SPDX lines and full texts that segments are compared with."""
    spdx = []
    for license in dict(TEMPLATES):
        spdx += [(license, f"SPDX-License-Identifier: {license}{end}") for end in ("", *(("-only", "-or-later") if license in _GNU else ()))]
    # the AGPL's own text is not here: its terms are those of the GPL under its name, save section 13
    affero = re.sub(r"(?i)GNU\s+General\s+Public\s+License", "GNU Affero General Public License", full_text("GPL-3.0"))
    found = [*TEMPLATES, *HEADERS, *spdx, *((license, full_text(license)) for license in FULL), ("AGPL-3.0", affero)]
    return [(license, form, text) for form, (license, text) in enumerate(found)]


def _marked(text: Column) -> Column:
    found = F.lit(False)
    for stem in STEMS:
        found = found | F.contains(text, F.lit(stem))
    return found


def segments(files: DataFrame) -> DataFrame:
    """(path, segment, first, text): each license line of a file, and all of them together as segment -1.

    Of a file with a license line also the whole file (-2), the comment that it begins with (-3) and its blocks between
    blank lines (-4 and below) are segments, if they have more than one line and a license line. ``first`` tells that
    nothing but white space stands before the line; a whole file is first. Lines are split at newlines and lower-cased.
    """
    lines = written(files.select("path", F.lower("text").alias("t")).where(_marked(F.col("t"))).select("path", F.split(F.ltrim(F.regexp_replace("t", r"^\s+", "")), "\n").alias("lines")), "license-lines")
    kept = lines.select("path", F.posexplode("lines").alias("segment", "text")).where(_marked(F.col("text")))
    kept = kept.select("path", F.col("segment").cast("long").alias("segment"), (F.col("segment") == 0).alias("first"), "text")
    chosen = lines.select("path", F.filter("lines", _marked).alias("own")).where("size(own) > 1")
    joined = chosen.select("path", F.lit(-1).cast("long").alias("segment"), F.lit(False).alias("first"), F.array_join("own", " ").alias("text"))
    code = F.array_position(F.transform("lines", lambda x: x.rlike(COMMENT)), False)
    head = F.when(code == 0, F.lit(None)).otherwise(F.array_join(F.slice("lines", 1, F.greatest(code - 1, F.lit(0)).cast("int")), "\n"))
    wide = lines.select("path", F.array_join("lines", "\n").alias("text"), head.alias("head"))
    blocks = wide.select("path", F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("at", "text"))
    blocks = blocks.select("path", (F.lit(-4) - F.col("at")).cast("long").alias("segment"), F.lit(False).alias("first"), "text")
    whole = wide.select("path", F.lit(-2).cast("long").alias("segment"), F.lit(True).alias("first"), "text")
    heads = wide.select("path", F.lit(-3).cast("long").alias("segment"), F.lit(False).alias("first"), F.col("head").alias("text")).where("head is not null")
    several = whole.unionByName(heads).unionByName(blocks).where(F.contains(F.trim("text"), F.lit("\n")) & _marked(F.col("text")))
    return kept.unionByName(joined).unionByName(several)


def tokens(segments: DataFrame, *key: str) -> DataFrame:
    """(key..., token, tf), one row for each distinct token of a segment."""
    split = segments.select(*key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("token"))
    return split.groupBy(*key, "token").agg(F.count("*").alias("tf"))


def similarities(segments: DataFrame) -> DataFrame:
    """(path, segment, first, license, similarity) of the segments whose cosine to a template reaches THRESHOLD."""
    spark = segments.sparkSession
    texts = templates()
    own = tokens(spark.createDataFrame(texts, "license string, form int, text string"), "license", "form")
    key = ["path", "segment", "first"]
    found = written(tokens(segments, *key), "license-tokens")
    n = found.select(*key).distinct().count() + len(texts)
    df = own.select("token").unionByName(found.select("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = written(df.select("token", "df", (F.log(F.lit(n + 1.0) / (1 + F.col("df"))) + 1).alias("idf")), "license-idf")
    total = idf.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    common = idf.where(F.col("df") * COMMON >= total).select("token", "idf")
    rest = idf.where(F.col("df") * COMMON < total).select("token", "idf")
    weighed = idf.join(F.broadcast(own), "token").select("license", "form", "token", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighed.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = written(weighed.join(norms, "form").select("license", "form", F.col("token").alias("_token"), (F.col("w") / F.col("norm")).alias("u")), "license-weights")
    known = found.join(F.broadcast(common), "token").unionByName(found.join(F.broadcast(common.select("token")), "token", "left_anti").join(rest, "token"))
    mine = known.select(*key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = mine.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = mine.join(F.broadcast(weighed), F.col("token") == F.col("_token")).groupBy(*key, "license", "form").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("length"), 6)
    return dots.join(lengths, key).select(*key, "license", cosine.alias("similarity")).where(F.col("similarity") >= THRESHOLD)


def directories(path: Column) -> Column:
    """The directories above a path, nearest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame) -> DataFrame:
    """Per row of ``files`` (``path``, ``text``): path, license, similarity, origin (own, inherited or none) and license_path.

    Other columns stay, but those of the result's names are replaced and ``text`` goes.

    A file's own license is the template that one of its segments is most similar to (ties: the least id). A file that
    begins with a license line is a license file: it gives its license to the files in its directory and below that have
    none of their own, unless a directory in between has one (of several in a directory the most similar, then the least
    path counts). Null and empty texts have no license of their own; a null path inherits nothing. Repeated rows get
    equal results. A very long text is read whole; an empty table gives an empty result.
    """
    best = similarities(segments(files.where("path is not null")))
    own = best.groupBy("path").agg(F.max(F.struct("similarity", "first")).alias("top"), F.min(F.struct(-F.col("similarity"), "license")).alias("pick"), F.bool_or("first").alias("heads"))
    own = written(own.select("path", F.col("pick.license").alias("license"), F.col("top.similarity").alias("similarity"), "heads"), "license-own")
    place = lambda path: F.element_at(directories(path), -1)
    result = ("path", "license", "similarity", "origin", "license_path")
    extra = [c for c in files.columns if c not in (*result, "text")]
    files = files.select("path", "text", F.struct(*(F.col(c) for c in extra)).alias("_extra") if extra else F.lit(None).alias("_extra"))
    givers = own.where("heads").groupBy(place(F.col("path")).alias("directory")).agg(F.min(F.struct(-F.col("similarity"), "path", "license")).alias("g"))
    givers = narrow_side(written(givers.select("directory", F.col("g.path").alias("license_path"), F.col("g.license").alias("given")), "license-givers"))
    folders = files.where("path is not null").select(place(F.col("path")).alias("folder")).distinct()
    above = folders.select("folder", F.posexplode(directories(F.concat("folder", F.lit("/x")))).alias("depth", "directory"))
    above = above.unionByName(folders.where("folder = ''").select("folder", F.lit(0).alias("depth"), F.lit("").alias("directory")))
    nearest = above.join(givers, "directory").groupBy("folder").agg(F.max(F.struct("depth", "license_path", "given")).alias("n"))
    nearest = narrow_side(written(nearest.select("folder", F.col("n.license_path").alias("license_path"), F.col("n.given").alias("given")), "license-nearest"))
    own = narrow_side(own.select(F.col("path").alias("_path"), "license", "similarity"))
    out = files.select("_extra", "path", place(F.col("path")).alias("folder")).join(own, F.col("path") == F.col("_path"), "left").join(nearest, "folder", "left")
    license = F.coalesce("license", "given")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    source = F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("license_path"))
    return out.select(*(F.col("_extra").getField(c).alias(c) for c in extra), "path", license.alias("license"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), origin.alias("origin"), source.alias("license_path"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: below the source a directory for each digit of doc_id but the last."""
    digits = F.array_join(F.split(F.col("doc_id").cast("string"), ""), "/")
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("unknown")), digits).alias("path"), "text", "doc_id")
