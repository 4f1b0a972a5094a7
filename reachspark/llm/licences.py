"""License scans: sparse TF-IDF cosine to notice templates, then inheritance along directories.

Texts are cut into lines; words are hashed into buckets, document frequencies are counted over all
lines of the corpus, and a line is compared with every template in that space. A cheap bound
decides first: the cosine is at most the share of the line's norm that lies in template words.
Blocks of consecutive lines and whole files are compared with headers and full licence texts too.
A file that mostly is a licence, or is named as one and has a notice, speaks for its directory;
files without a notice take the licence of the nearest directory above.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.llm.linking import small_join
from reachspark.llm.textops import fingerprints, pieces, spans, utf8
from reachspark.session import cut

BUCKETS = 1 << 16
#: Notices as their licences ask for them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
)

_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software "
    "Foundation, either version {2} of the License, or (at your option) any later version."
)
_NO_WARRANTY = (
    " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the "
    "GNU {1} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_FAMILIES = (
    ("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("LGPL-3.0", "Lesser General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"), ("AGPL-3.0", "Affero General Public License", "3"),
)
#: Standard headers of several lines: the opening paragraph alone, and the whole header.
HEADERS = (
    *((name, (_GNU + more).format("This program", licence, version)) for name, licence, version in _FAMILIES for more in ("", _NO_WARRANTY)),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
     'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Lines of a block and lines from one block to the next.
WINDOWS = ((2, 1), (3, 1), (4, 2), (8, 4), (16, 8))
#: Names of files that hold the licence of their directory.
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([-._][^/]*)?$"


def full_texts() -> tuple[tuple[str, str], ...]:
    """Full licence texts; that of the AGPL is the GPL's with its name, that of BSD-2 lacks a clause of BSD-3."""
    files = {"GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3"}
    names = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-3-Clause", "MPL-2.0", "CC0-1.0")
    texts = {x: pkgutil.get_data("reachspark.llm", f"licence_texts/{files.get(x, x)}.txt").decode() for x in names}
    bsd = texts["BSD-3-Clause"]
    texts["BSD-2-Clause"] = bsd[: bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE") :]
    gpl = texts["GPL-3.0"]
    texts["AGPL-3.0"] = gpl.replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")
    return tuple(texts.items())


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [c if chr(c).isalnum() else 0x20 for c in range(128)]
_PLAIN[65:91] += 32


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``line, bucket, count`` of all words, and the first line of each text (with the end)."""
    raw, offsets = utf8(column)
    starts, ends, first = spans(_PLAIN[raw], offsets)
    bucket = (fingerprints(_PLAIN[raw], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    feeds = np.flatnonzero(raw == 10)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # a text begins a line, as does what follows a line feed
    line = np.searchsorted(feeds, starts) + doc
    first_line = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    found, count = np.unique(line * BUCKETS + bucket, return_counts=True)
    return found // BUCKETS, found % BUCKETS, count, first_line


def _blocks(line: np.ndarray, bucket: np.ndarray, count: np.ndarray, first: np.ndarray, size: int, step: int):
    """Distinct ``block, bucket, count`` of blocks of ``size`` lines in texts that have more, and the first block of each text."""
    n_lines = np.diff(first)
    n = np.where(n_lines > size, -(-(n_lines - size) // step) + 1, 0)
    base = np.concatenate(([0], np.cumsum(n)))
    doc = np.searchsorted(first, line, "right") - 1
    inside = n[doc] > 0
    doc, last, bucket, count = doc[inside], (line[inside] - first[doc[inside]]) // step, bucket[inside], count[inside]
    keys, counts = [], []
    for k in range(size // step):
        ok = (last >= k) & (last - k < n[doc])
        keys.append((base[doc] + last - k)[ok] * BUCKETS + bucket[ok])
        counts.append(count[ok])
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found // BUCKETS, found % BUCKETS, np.bincount(back, np.concatenate(counts), len(found)), base


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in pieces(batches, "text"):
        line, bucket, _, _ = _lines(batch.column(0))
        total += np.bincount(bucket, minlength=BUCKETS)
        n += len(np.unique(line))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()]), pa.array([n, *total[at].tolist()])], names=["bucket", "n"])


class Templates:
    """Unit TF-IDF vectors of the templates over hashed words."""

    def __init__(self, templates, idf: np.ndarray):
        self.idf = idf
        self.names = [name for name, _ in templates]
        self.weights = np.zeros((BUCKETS, len(templates)))
        for t, (_, text) in enumerate(templates):
            _, bucket, count, _ = _lines(pa.array([text.replace("\n", " ")]))
            self.weights[bucket, t] = count * idf[bucket]
        self.weights /= np.maximum(np.linalg.norm(self.weights, axis=0), 1e-300)
        self.known = self.weights.any(axis=1)

    def cosines(self, group: np.ndarray, bucket: np.ndarray, count: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``group, template, cosine`` of the best template for groups that reach ``least``.

        ``group`` is sorted. The bound on the cosine discards most groups before any product.
        """
        if not len(group):
            return group, group, np.zeros(0)
        weight = count * self.idf[bucket]
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        norm = np.add.reduceat(weight**2, begin)
        inside = np.add.reduceat(np.where(self.known[bucket], weight, 0) ** 2, begin)
        near = inside >= (least * least - 1e-9) * norm
        rows = np.repeat(near, np.diff(np.append(begin, len(group))))
        if not rows.any():
            return group[:0], group[:0], np.zeros(0)
        group, bucket, weight, norm = group[rows], bucket[rows], weight[rows], norm[near]
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        products = np.add.reduceat(weight[:, None] * self.weights[bucket], begin, axis=0) / np.sqrt(norm)[:, None]
        best = products.argmax(axis=1)
        cosine = products[np.arange(len(best)), best]
        keep = cosine >= least
        return group[begin][keep], best[keep], cosine[keep]


def _notices(shared, line_least: float, file_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, long = shared.value
        for batch in pieces(batches, "text"):
            line, bucket, count, first = _lines(batch.column(1))
            n = batch.num_rows
            own: list = [None] * n
            cosine, lines = np.zeros(n), np.zeros(n, np.int64)
            at, best, score = templates.cosines(line, bucket, count, line_least)
            for x, t, c in zip((np.searchsorted(first, at, "right") - 1).tolist(), best.tolist(), score.tolist(), strict=True):
                lines[x] += 1
                if c > cosine[x]:
                    own[x], cosine[x] = templates.names[t], c
            for size, step in WINDOWS:
                block, words, n_words, base = _blocks(line, bucket, count, first, size, step)
                at, best, score = long.cosines(block, words, n_words, line_least)
                for x, t, c in zip((np.searchsorted(base, at, "right") - 1).tolist(), best.tolist(), score.tolist(), strict=True):
                    lines[x] = max(lines[x], 1)
                    if c > cosine[x]:
                        own[x], cosine[x] = long.names[t], c
            doc = np.searchsorted(first, line, "right") - 1
            whole, back = np.unique(doc * BUCKETS + bucket, return_inverse=True)
            at, best, score = long.cosines(whole // BUCKETS, whole % BUCKETS, np.bincount(back, count), file_least)
            entire: list = [None] * n
            share = np.zeros(n)
            for x, t, c in zip(at.tolist(), best.tolist(), score.tolist(), strict=True):
                entire[x], share[x] = long.names[t], c
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(own, pa.string()), pa.array(cosine), pa.array(lines),
                    pa.array(entire, pa.string()), pa.array(share),
                ],
                names=["path", "notice", "cosine", "n_notices", "file_licence", "file_cosine"],
            )

    return run


def scan(files: DataFrame, templates=TEMPLATES, line_least: float = 0.7, file_least: float = 0.6) -> DataFrame:
    """``path, notice, cosine, n_notices, file_licence, file_cosine`` of ``files(path, text)``.

    Corpus frequencies come from all lines of all files, 65 536 sums. ``notice`` is the template
    nearest to any line, or with headers and full texts to any block of lines, if as near as
``line_least``; ``file_licence`` that of the whole text. ``n_notices`` counts lines, or 1 if only a block is near.
    """
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    table = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(table["bucket"].tolist(), table["n"].tolist(), strict=True))
    df = np.zeros(BUCKETS)
    at = [b for b in counts if b >= 0]
    df[at] = [counts[b] for b in at]
    idf = np.log((1 + counts.get(-1, 0)) / (1 + df)) + 1
    shared = files.sparkSession.sparkContext.broadcast((Templates(templates, idf), Templates((*templates, *HEADERS, *full_texts()), idf)))
    schema = "path string, notice string, cosine double, n_notices long, file_licence string, file_cosine double"
    return rows.mapInArrow(_notices(shared, line_least, file_least), schema)


def directory(path: Column) -> Column:
    """What stands before the last slash; the empty root for a bare name and for NULL."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """``found(path, notice, file_licence, file_cosine, ...)`` with ``licence, via, from_dir``.

    A directory's licence is that of its licence file with the highest cosine, then the smallest
    path; a file is one by its whole text, or by its name if it has a notice. A file's own notice comes first, then the whole file's, then the nearest directory at or above it.
    Only distinct directories are joined with their ancestors.
    """
    rows = found.withColumn("dir__", directory(F.col("path")))
    named = F.col("path").rlike(LICENCE_FILE) & F.col("notice").isNotNull()
    spoken = F.coalesce("file_licence", F.when(named, F.col("notice"))).alias("spoken")
    near = F.when(F.col("file_licence").isNotNull(), F.col("file_cosine")).otherwise(F.col("cosine"))
    order = F.struct(-near, F.col("path"), spoken)
    speaking = rows.where(spoken.isNotNull()).groupBy("dir__").agg(F.min(order)["spoken"].alias("dir_licence"))
    speaking = cut(speaking.withColumnRenamed("dir__", "above"))
    dirs = rows.select("dir__").distinct()
    parts = F.split("dir__", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    chain = F.array_distinct(F.concat(F.array(F.lit("")), chain))
    above = dirs.select("dir__", F.explode(chain).alias("above"))
    nearest = F.max_by(F.struct("dir_licence", F.col("above").alias("from_dir")), F.length("above"))
    given = above.join(speaking, "above").groupBy("dir__").agg(nearest.alias("given"))
    rows = small_join(rows, cut(given), "dir__", "left")
    own = F.coalesce("notice", "file_licence")
    via = F.when(F.col("notice").isNotNull(), "header").when(F.col("file_licence").isNotNull(), "file").when(F.col("given").isNotNull(), "directory")
    return rows.select(
        *found.columns, F.coalesce(own, F.col("given.dir_licence")).alias("licence"), via.alias("via"),
        F.when(own.isNull(), F.col("given.from_dir")).alias("from_dir"),
    )


def scan_licences(files: DataFrame, templates=TEMPLATES, line_least: float = 0.7, file_least: float = 0.6) -> DataFrame:
    """Notices of every file and the licence that holds for it; one row per row of ``files(path, text)``.

    Whole texts are scanned. NULL and empty texts have no notice and inherit; a NULL path lies in
    the root; repeated rows are scanned alike; a tie between templates goes to the first one.
    Other columns are ignored. An empty table gives no rows.
    """
    return inherit(cut(scan(files, templates, line_least, file_least)))
