"""License scans: TF-IDF cosine of passages to templates, then inheritance by directory.

DataFrame functions only. The parts of a text are its lines, or sentences of these (a stop,
blanks and a capital part two), that have terms: runs of a-z and 0-9 of the lower-cased part,
so comment marks drop out. A passage is any run of consecutive parts up to the first that
makes it REACH times as long as the longest template, so wrapped notices are compared as one;
the header, which is the leading comment of a text, is a passage of any length. The text as a
whole is compared with whole licences, weighed by their own terms.
A term that templates have weighs its count times 1 + ln((1 + texts) / (1 + texts with
it)) over all texts, any other term its count. A file's licence is that of the template
with the largest cosine to any of its passages, or to the whole, if that reaches THRESHOLD
(ties: first template, whole licences last).

Passages with none of a template's anchors are not looked at: the anchors are its
heaviest terms, as many as it takes for the others to stay below the threshold however
well they match, so nothing is lost.

A licence file (by name) declares its licence for its directory. A file without a licence of
its own inherits from the nearest directory above that declares one; two licence files in one
directory with different licences: first by path.

NULL and empty texts have no licence of their own. A NULL path has no directory and
inherits nothing. Repeated rows get equal results. Without templates nothing is found.
Other columns stay as they are, columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.columns import unused

# Short public notices by SPDX name; a parameter.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Texts of whole licences; a parameter. Others are found by the notices that they contain.
WHOLE = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)
THRESHOLD = 0.8
#: Passages of several parts end with the part that makes them so many times as long as the longest template.
REACH = 2
#: File names that declare a licence for their directory.
FILES = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
#: Templates are literals of the plan.
MAX_TEMPLATES = 1000

_SENTENCE = r"([.!?])[ \t]+([A-Z])"
_COMMENT = r"(?i)^\s*($|#|//|/\*|\*|--|;|%|<!--|\"\"\"|'''|(rem|dnl)\s)"
_BLOCK = r"(?s)^\s*(?:/\*|<!--|\"\"\")(.*?)(?:\*/|-->|\"\"\")"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def passages(text: Column) -> Column:
    return F.split(F.regexp_replace(text, _SENTENCE, "$1\n$2"), "\n")


def weights(docs: DataFrame, templates: Sequence[tuple[str, str]], text: str = "text") -> dict[str, float]:
    """Weight of each template term, from all texts."""
    words = sorted({w for _, t in templates for w in re.findall("[a-z0-9]+", t.lower())})
    if not words:
        return {}
    known = F.array(*map(F.lit, words))
    seen = docs.select(F.explode(F.array_intersect(terms(F.col(text)), known)).alias("term"))
    counts = {r["term"]: r["count"] for r in seen.groupBy("term").count().collect()}
    total = docs.filter(F.col(text).isNotNull()).count()
    return {w: 1 + math.log((1 + total) / (1 + counts.get(w, 0))) for w in words}


def anchors(templates: Sequence[tuple[str, str]], weight: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a passage needs one to reach the threshold with some template."""
    out = set()
    for _, text in templates:
        parts = sorted(((n * weight[w]) ** 2, w) for w, n in Counter(re.findall("[a-z0-9]+", text.lower())).items())
        total, rest = sum(p for p, _ in parts), 0.0
        for p, w in parts:
            rest += p
            # A little below, for the sums of the cosine may round up.
            if rest >= total * (threshold - 1e-6) ** 2:
                out.add(w)
    return sorted(out)


def header(text: Column) -> Column:
    """The leading comment: a block comment, or the comment and blank lines before any other; else empty or NULL."""
    lines = F.split(text, "\n")
    other = F.array_position(F.transform(lines, lambda x: ~x.rlike(_COMMENT)), True)
    leading = F.array_join(F.when(other > 0, F.slice(lines, 1, other.cast("int") - 1)).otherwise(lines), "\n")
    block = F.regexp_extract(text, _BLOCK, 1)
    return F.when(block != "", block).otherwise(leading)


def runs(docs: DataFrame, limit: int, marked: Column, text: str) -> DataFrame:
    """(key, no, size, words) of the passages with a marked term; a header has size 0."""
    parts = docs.select(
        F.xxhash64(text).alias("key"), terms(header(F.col(text))).alias("header"),
        F.filter(F.transform(passages(F.col(text)), terms), lambda x: F.size(x) > 0).alias("parts"),
    )

    def reach(i):
        """Parts from the i-th on until there are ``limit`` terms. Each has one at least."""
        none = F.struct(F.lit(0).alias("terms"), F.lit(0).alias("parts"))
        return F.aggregate(
            F.slice("parts", i, limit), none,
            lambda a, x: F.when(a["terms"] < limit, F.struct((a["terms"] + F.size(x)).alias("terms"), (a["parts"] + 1).alias("parts"))).otherwise(a),
            lambda a: a["parts"],
        )

    ahead = F.transform(
        F.when(F.size("parts") > 0, F.sequence(F.lit(1), F.size("parts"))),
        lambda i: F.struct(i.alias("no"), F.slice("parts", i, reach(i)).alias("ahead")),
    )
    starts = parts.select("key", F.inline(F.filter(ahead, lambda x: F.arrays_overlap(F.flatten(x["ahead"]), marked))))
    several = starts.select("key", "no", "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("size")).select(
        "key", "no", "size", F.flatten(F.slice("ahead", 1, F.col("size"))).alias("words")
    )
    headers = parts.select("key", F.lit(0).alias("no"), F.lit(0).alias("size"), F.col("header").alias("words"))
    return several.union(headers).filter(F.arrays_overlap("words", marked))


def _cosines(
    docs: DataFrame, templates: Sequence[tuple[str, str]], weight: dict[str, float], threshold: float, text: str, whole: bool
) -> DataFrame:
    """(key, license, template, score) of passages, or whole texts, that reach the threshold."""
    rows = []
    for i, (name, notice) in enumerate(templates):
        counts = Counter(re.findall("[a-z0-9]+", notice.lower()))
        norm = math.sqrt(sum((n * weight[w]) ** 2 for w, n in counts.items()))
        rows += [(w, i + MAX_TEMPLATES * whole, name, n * weight[w] / norm) for w, n in counts.items()]
    table = docs.sparkSession.createDataFrame(rows, "term string, template int, license string, share double")
    values = F.create_map(*[F.lit(x) for w in weight.items() for x in w])
    needed = anchors(templates, weight, threshold)
    some = docs.filter(F.col(text).rlike(rf"(?i)(^|[^a-z0-9])({'|'.join(needed)})($|[^a-z0-9])"))
    if whole:
        read = some.select(F.xxhash64(text).alias("key"), F.lit(0).alias("no"), F.lit(0).alias("size"), terms(F.col(text)).alias("words"))
    else:
        longest = max(len(re.findall("[a-z0-9]+", t.lower())) for _, t in templates)
        read = runs(some, REACH * longest, F.array(*map(F.lit, needed)), text)
    found = (
        read.select("key", "no", "size", F.explode("words").alias("term"))
        .groupBy("key", "no", "size", "term").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("w", F.col("n") * F.coalesce(values[F.col("term")], F.lit(1.0)))
    )
    norms = found.groupBy("key", "no", "size").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = found.join(F.broadcast(table), "term").groupBy("key", "no", "size", "template", "license").agg(
        F.sum(F.col("w") * F.col("share")).alias("dot")
    )
    # Equal texts were counted together, which scales a passage but not its angle.
    scored = dots.join(norms, ["key", "no", "size"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    return scored.filter(F.col("score") >= threshold).select("key", "license", "template", "score")


def match(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text",
    whole: Sequence[tuple[str, str]] = WHOLE,
) -> DataFrame:
    """(key, license, score) of texts that match a template; key is ``text_key`` of the text."""
    if max(len(templates), len(whole)) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    weight = weights(docs, [*templates, *whole], text)
    scored = docs.sparkSession.createDataFrame([], "key bigint, license string, template int, score double")
    for group in (templates, whole):
        own = {w: weight[w] for w in sorted({w for _, t in group for w in re.findall("[a-z0-9]+", t.lower())})}
        if own:
            scored = scored.union(_cosines(docs, group, own, threshold, text, group is whole))
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("template")))
    return scored.groupBy("key").agg(best.alias("b")).select("key", "b.license", "b.score")


def folder(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, path: str, license: str) -> DataFrame:
    """(dir, inherited, declared_in): the nearest declared licence of each directory with files."""
    named = files.filter(F.col(path).isNotNull()).select(
        folder(F.col(path)).alias("dir"), F.col(path).alias("path"), F.col(license).alias("license")
    )
    declared = (
        named.filter(F.col("license").isNotNull() & F.regexp_extract("path", r"[^/]*$", 0).rlike(FILES))
        .groupBy("dir").agg(F.min_by("license", "path").alias("inherited")).withColumnRenamed("dir", "declared_in")
    )
    steps = F.size(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(0), steps), lambda n: F.array_join(F.slice(F.split("dir", "/"), 1, n), "/"))
    up = named.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("declared_in"))
    nearest = up.join(declared, "declared_in").groupBy("dir").agg(
        F.max_by(F.struct("inherited", "declared_in"), F.length("declared_in")).alias("n")
    )
    return nearest.select("dir", "n.inherited", "n.declared_in")


def scan(
    files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
    path: str = "path", text: str = "text", whole: Sequence[tuple[str, str]] = WHOLE,
) -> DataFrame:
    """Add own_license, score, inherited, declared_in and license (own or inherited)."""
    results = ("own_license", "score", "inherited", "declared_in", "license")
    key, mine, at, down = (unused(files, x) for x in ("_key", "_own", "_dir", "_down"))
    found = match(files, templates, threshold, text, whole).select(
        F.col("key").alias(key), F.struct("license", "score").alias(mine)
    )
    own = files.withColumn(key, F.when(F.col(text).isNotNull(), F.xxhash64(text))).join(found, key, "left").drop(key)
    known = own.select(F.col(path).alias("path"), F.col(mine)["license"].alias("license"))
    above = inherit(known, "path", "license").select(
        F.col("dir").alias(at), F.struct("inherited", "declared_in").alias(down)
    )
    placed = own.withColumn(at, folder(F.col(path))).join(above, at, "left")
    values = (
        F.col(mine)["license"], F.col(mine)["score"], F.col(down)["inherited"], F.col(down)["declared_in"],
        F.coalesce(F.col(mine)["license"], F.col(down)["inherited"]),
    )
    return placed.select(
        *[F.col(c) for c in files.columns if c not in results], *[v.alias(r) for v, r in zip(values, results)]
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files, source/language/hundred/name; each 25th is a licence file."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    name = F.when(F.col("doc_id") % 25 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string"))
    return docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", hundred, name).alias("path"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, score, inherited, declared_in and license of each document."""
    return scan(as_files(docs)).select("doc_id", "path", "own_license", "score", "inherited", "declared_in", "license")
