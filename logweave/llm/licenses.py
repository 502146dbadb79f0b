"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories.

All steps are DataFrame operations.  The statements of a file that may be about a license,
and its blocks of lines without comment marks, are compared with short templates, with
usual headers and with whole licenses.  A file without a license of its own takes
that of the license file in its nearest ancestor directory, found by joining the
distinct directories, cut at each level, with the directories of license files.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wording of common license statements, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met neither the name of the copyright holder"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Licensed under the ISC License"),
    ("Zlib", "Licensed under the zlib License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http www.eclipse.org legal epl-2.0"),
    ("0BSD", "Licensed under the BSD Zero Clause License"),
)
#: Usual headers, and whole texts of short licenses, by SPDX identifier.
WHOLE: tuple[tuple[str, str], ...] = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http www.apache.org licenses LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla.org MPL 2.0.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
TEMPLATES += WHOLE
#: A statement is read further only if it holds one of these.
CUES = r"(?i)licen[sc]|copyright|spdx|redistribut|warrant|public domain|permission is hereby"
#: What comments begin a line with.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+)?[ \t]*"
#: Names of files that hold the license of their directory.
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying)[^/]*$"
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(term, template, license, weight) with unit length for each template; idf by term; idf of other terms."""
    n = len(templates)
    df = Counter(t for _, text in templates for t in set(_terms(text)))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    rows = []
    for i, (license_id, text) in enumerate(templates):
        tf = Counter(_terms(text))
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        rows += [(t, i, license_id, c * idf[t] / norm) for t, c in sorted(tf.items())]
    return rows, idf, math.log(1 + n) + 1


def statements(text: Column) -> Column:
    """Lines of a text, cut into sentences, that hold a cue word; null text has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\r\n]+|(?<=[a-z]{3}[.!?])\s+(?=\S)")
    return F.filter(pieces, lambda s: s.rlike(CUES))


def blocks(text: Column) -> Column:
    """Blocks of at least two lines between blank ones, without comment marks, as one line each, that hold a cue word."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), MARKS, "")
    several = F.filter(F.split(plain, r"\n\s*\n"), lambda b: b.contains("\n") & b.rlike(CUES))
    return F.when(text.rlike(CUES), several).otherwise(F.array().cast("array<string>"))


def scan_licenses(files: DataFrame, least: float = 0.6, keep: tuple[str, ...] = ()) -> DataFrame:
    """License of each file: path, license, score, origin (``own``, ``inherited`` or null) and license_path, and columns to keep.

    files has path and text.  Every statement with a cue word, and every block of lines
    with one, is compared with all templates; the best cosine of at least ``least`` gives the
    file's own license (ties to the earlier template), so that a wrapped header counts as
    a whole.  A file without one inherits from the license file in the nearest directory
    above it or beside it (ties to the smaller path).  Null and empty texts have no license
    of their own; rows with a null path have no directory and inherit nothing; rows that
    repeat a path share what is found in any of them, each row staying.  Only texts with cue
    words are exploded, into their terms with a hash of the statement; the templates' weights
    are the only broadcast.  Inheritance joins distinct directories, so a directory that
    holds a third of all files is one row there and a skewed join's key when handed back.
    """
    spark = files.sparkSession
    rows, idf, other = template_weights()
    weights = F.broadcast(spark.createDataFrame([(t, i, lic, w, idf[t]) for t, i, lic, w in rows], "term string, template int, license string, weight double, idf double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    base = files.select(F.col("path").cast("string").alias("path"), "text", *[F.col(c).alias(f"_kept_{c}") for c in keep])

    every = F.array_distinct(F.concat(statements(F.col("text")), F.coalesce(blocks(F.col("text")), F.array().cast("array<string>"))))
    said = base.select("path", F.explode(every).alias("statement")).select("path", F.xxhash64("statement").alias("said"), "statement").dropDuplicates(["path", "said"])
    terms = said.select("path", "said", F.explode(F.regexp_extract_all(F.lower("statement"), F.lit(f"({_TERM})"), 1)).alias("term"))
    tf = terms.groupBy("path", "said", "term").agg(F.count("*").alias("tf"))
    norms = tf.join(known, "term", "left").groupBy("path", "said").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), 2))).alias("norm"))
    dots = tf.join(weights, "term").groupBy("path", "said", "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    near = dots.withColumnRenamed("path", "p").withColumnRenamed("said", "s").join(norms, F.col("p").eqNullSafe(F.col("path")) & (F.col("s") == F.col("said")))
    near = near.select("path", "license", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    own = near.groupBy("path").agg(F.max(F.struct("score", (-F.col("template")).alias("earlier"), "license")).alias("best")).select("path", F.col("best.license").alias("license"), F.col("best.score").alias("score"))

    folder = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    dirs = own.where(F.col("path").rlike(LICENSE_FILE)).select(folder.alias("above"), F.struct("path", "license", "score").alias("given"))
    dirs = dirs.groupBy("above").agg(F.min("given").alias("given"))
    each = base.where("path IS NOT NULL").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    ladder = each.select("dir", F.explode(F.array_distinct(prefixes)).alias("above"))
    nearest = ladder.join(dirs, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "given")).alias("x")).select("dir", F.col("x.given").alias("given"))

    mine = own.withColumnRenamed("path", "own_path").withColumnRenamed("license", "own_license").withColumnRenamed("score", "own_score")
    full = base.select("path", folder.alias("dir"), *[f"_kept_{c}" for c in keep]).join(mine, F.col("path").eqNullSafe(F.col("own_path")), "left").join(nearest, "dir", "left")
    has = F.col("own_license").isNotNull()
    return full.select(
        "path",
        F.coalesce("own_license", "given.license").alias("license"),
        F.coalesce("own_score", "given.score").alias("score"),
        F.when(has, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("given.path")).alias("license_path"),
        *[F.col(f"_kept_{c}").alias(c) for c in keep],
    )
