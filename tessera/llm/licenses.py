"""Operator 8: license scans by TF-IDF cosine to templates, with inheritance down the directory tree.

Built from DataFrame functions only. A file's segments are its lines that speak of a licence, the blank-line
separated paragraphs around such lines, and its whole text if it has such a line or is named as a licence
file. A file whose whole text matches the body of a licence (a template of many terms) is a licence file, and so is one
that is named as the text of a licence (LICENSE, COPYING) if any of its segments matches; a notice alone covers its own file only. Each segment is a
sparse TF-IDF vector; its cosine to every template is a join on shared terms and a sum. Document frequencies
of all terms are counted over all files. A file without a licence of its own
takes that of the nearest ancestor directory in which a licence file stands, by a join on directory paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed, lower_az
from tessera.session import table

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: (licence, template). Notices, titles, opening clauses and short bodies as their publishers word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    # how the publishers' full texts begin, or all of the short ones
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", _BSD.format("", "") + _BSD_3.format("") + _BSD_END),
    ("BSD-3-Clause", _BSD.format("1. ", "2. ") + _BSD_3.format("3. ") + _BSD_END),
    ("BSD-2-Clause", _BSD.format("", "") + _BSD_END),
    ("BSD-2-Clause", _BSD.format("1. ", "2. ") + _BSD_END),
)
#: What a line must hold to be a segment, and what makes a file name a licence file.
CUE = r"licen[cs]|copyright|spdx|permission is hereby|redistribut|public domain|free software|warrant|waived all"
FILE_NAME = r"(?i)(^|/)(un)?licen[cs]e|(^|/)copying|(^|/)notice(\.[a-z]+)?$"
#: Names of files that hold the text of a licence, but no source code.
DECLARING = r"(?i)(^|/)(?![^/]*\.(c|cc|cpp|h|hpp|cs|css|go|java|js|json|kt|php|pl|py|rb|rs|scala|sh|sql|swift|ts|xml|ya?ml)$)((un)?licen[cs]es?|copying)([-_.][^/]*)?$"
#: Segments of at least this cosine to a template bear its licence.
THRESHOLD = 0.7
#: Distinct terms from which a template is the body of a licence.
BODY_TERMS = 40
#: Places in which the files of one directory meet its licence.
SHARES = 32
#: Terms in at least one of so many files have their weights broadcast: at most as many as these files have terms.
COMMON = 100


def _terms(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")


def _parent(path: Column) -> Column:
    """The directory of a path, without the last slash; '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _ancestors(directory: Column) -> Column:
    """The directory itself and all above it, '' last, as (directory, depth)."""
    parts = F.split(directory, "/")
    size = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(
        F.sequence(F.lit(0), size), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory"), n.alias("depth"))
    )


def _rank() -> Column:
    """Orders licences: the largest cosine first, then the first name."""
    return F.struct((-F.col("cosine")).alias("order"), "license")


def _unranked(rank: str, prefix: str = "") -> list[Column]:
    return [(-F.col(f"{rank}.order")).alias(f"{prefix}cosine"), F.col(f"{rank}.license").alias(f"{prefix}license")]


def template_vectors(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``template`` (its number), ``license``, ``term`` and ``tf``."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(_terms(F.lower("text"))).alias("term")).groupBy("template", "license", "term").agg(
        F.count("*").alias("tf")
    )


def segments(files: DataFrame) -> DataFrame:
    """``_id``, ``whole`` and ``segment``, each distinct, of files (``_id``, ``path``, ``text`` in lower case)."""
    cued = F.col("text").rlike(CUE)
    rows = files.where(cued | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))).select("_id", "text")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    paragraphs = F.filter(F.split("text", r"\n[ \t]*\n"), lambda x: x.rlike(CUE))
    parts = F.array_except(F.concat(lines, paragraphs), F.array("text"))
    every = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("segment"))), F.transform(parts, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("segment"))))
    return rows.select("_id", F.explode(every).alias("s")).select("_id", "s.whole", "s.segment").where("segment <> ''")


def license_scan(
    files: DataFrame,
    id_col: str,
    path: Column,
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: id, ``directory``, ``license``, ``cosine`` (4 decimals) and ``origin``.

    ``origin`` is ``file`` (a segment of its own text), ``inherited`` (from a licence file's directory, itself or
    the nearest above) or ``none``. Of several licences the largest cosine counts, then the first name. Term
    weights are ``ln((1 + files) / (1 + files with the term)) + 1``.
    Null and empty texts have no segment, null paths stand at the top. Files are told apart by id: rows that repeat
    one share the licence of their texts, and each is returned. A row without an id has no licence of its own.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = files.sparkSession
    text = lower_az(F.coalesce(F.col(text_col), F.lit("")))
    rows = files.select(F.col(id_col).alias("_id"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text"))
    vectors = template_vectors(spark, templates)
    vocabulary = sorted({r["term"] for r in vectors.select("term").distinct().collect()})  # of the templates, not of the files
    bodies = [r["template"] for r in vectors.groupBy("template").count().where(F.col("count") >= BODY_TERMS).collect()]
    total = files.count()
    counts = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = checkpointed(counts)
    known = {r["term"]: r["df"] for r in counts.where(F.col("term").isin(vocabulary)).collect()}
    listed = spark.createDataFrame([(t, known.get(t, 0)) for t in vocabulary], "term string, df long")
    idf = (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf")
    weighted = vectors.join(listed.select("term", idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # one row per term, so that a segment's term meets it once: what it adds to each template
    postings = weighted.join(norms, "template").groupBy("term").agg(
        F.collect_list(F.struct("template", "license", (F.col("w") / F.col("norm")).alias("w"))).alias("postings")
    )
    found = segments(rows.where(F.col("_id").isNotNull())).withColumn("seg", F.md5("segment"))
    terms = found.select("_id", "whole", "seg", F.explode(_terms(F.col("segment"))).alias("term"))
    terms = checkpointed(terms.groupBy("_id", "whole", "seg", "term").agg(F.count("*").alias("tf")))
    # a common term stands in a large share of the segments: those don't meet at it, the others are dealt by term
    common = F.broadcast(counts.where(F.col("df") * COMMON >= total).select("term", idf))
    others = terms.join(common.select("term"), "term", "left_anti").join(counts.where(F.col("df") * COMMON < total).select("term", idf), "term")
    weights = terms.join(common, "term").unionByName(others).join(F.broadcast(postings), "term", "left").withColumn("v", F.col("tf") * F.col("idf"))
    scores = weights.groupBy("_id", "whole", "seg").agg(
        F.sum(F.col("v") * F.col("v")).alias("square"),
        F.flatten(F.collect_list(F.transform("postings", lambda p: F.struct(p["license"].alias("license"), p["template"].alias("template"), (p["w"] * F.col("v")).alias("x"))))).alias("parts"),
    )  # a segment has at most one row per term of the templates that carries postings
    best = (
        scores.select("_id", "whole", "seg", "square", F.explode("parts").alias("p"))
        .groupBy("_id", "whole", "seg", "square", "p.license", "p.template")
        .agg(F.round(F.sum("p.x") / F.sqrt("square"), 4).alias("cosine"))
        .where(F.col("cosine") >= threshold)
        .groupBy("_id")
        .agg(F.min(_rank()).alias("best"), F.min(F.when(F.col("whole") & F.col("template").isin(bodies), _rank())).alias("whole_best"))
        .select("_id", *_unranked("best"), F.col("whole_best").isNotNull().alias("licence_file"))
    )
    best = checkpointed(best)
    owned = rows.select("_id", _parent(F.col("path")).alias("directory"), F.col("path").rlike(DECLARING).alias("named")).join(best, "_id", "left")
    owned = checkpointed(owned)
    declared = owned.where("licence_file OR named AND license IS NOT NULL").groupBy("directory").agg(F.min(_rank()).alias("best"))
    declared = declared.select("directory", *_unranked("best", "from_"))
    above = owned.select("directory").distinct().select(F.col("directory").alias("below"), F.explode(_ancestors(F.col("directory"))).alias("a"))
    inherited = (
        above.select("below", F.col("a.directory").alias("directory"), F.col("a.depth").alias("depth"))
        .join(declared, "directory")
        .groupBy("below")
        .agg(F.max_by(F.struct("from_license", "from_cosine"), "depth").alias("best"))
        .select(F.col("below").alias("directory"), "best.from_license", "best.from_cosine")
    )
    # a directory may hold a large share of all files: its files meet its one row in SHARES places
    owned = owned.withColumn("share", F.pmod(F.xxhash64("_id"), F.lit(SHARES)))
    inherited = inherited.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<bigint>")))
    origin = F.when(F.col("license").isNotNull(), "file").when(F.col("from_license").isNotNull(), "inherited").otherwise("none")
    return owned.join(inherited, ["directory", "share"], "left").select(
        F.col("_id").alias(id_col),
        "directory",
        F.coalesce("license", "from_license").alias("license"),
        F.coalesce("cosine", "from_cosine").alias("cosine"),
        origin.alias("origin"),
    )


def document_path() -> Column:
    """Documents as files: ``source/lang/doc_id``; a null part is left out."""
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), "doc_id", document_path())
