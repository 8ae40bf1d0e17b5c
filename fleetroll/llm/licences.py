"""Licence scan: normalised lines, texts and windows of words against templates, by Dice over distinct word bigrams."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import Words, plain, shingle_hash, sliced

#: The usual notices by which a work names its licence.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Full licence texts, one file a licence. (CC-BY, CC-BY-SA and CC-BY-NC are known by their notices only.)
TEXTS: list[tuple[str, str]] = [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def normalised(text: Column) -> Column:
    """Lower case, everything but letters and digits a single space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _by_line(text: Column) -> Column:
    """The normalised lines, each still on a line of its own."""
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normalised), "\n")


def _bigrams(w: Words) -> np.ndarray:
    """A hash of each word and the next one, whatever text they are in."""
    return shingle_hash(w.hash, 2) if len(w.starts) > 1 else np.zeros(0, np.uint64)


class Templates:
    """Distinct bigrams of every template: sorted hashes, and the templates each one is in."""

    def __init__(self, names: list[str], bodies: list[str], percent: int):
        self.names, self.percent = names, percent
        own = [_bigrams(Words(pa.array([x]), False)) for x in bodies]
        self.length = np.array([len(g) for g in own], np.int64)
        own = [np.unique(g) for g in own]
        self.n = np.array([len(g) for g in own], np.int64)
        #: shared bigrams that a unit needs: 200 s >= percent * (m + n), and m >= s
        self.need = np.maximum(1, -(-self.n * percent // (200 - percent)))
        t = np.repeat(np.arange(len(own)), self.n)
        g = np.concatenate([*own, np.zeros(0, np.uint64)])
        at = np.argsort(g, kind="stable")
        self.grams, self.first = np.unique(g[at], return_index=True)
        self.first, self.t = np.append(self.first, len(g)), t[at]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` and templates that have the bigram there."""
        at = np.searchsorted(self.grams, h)
        at[at == len(self.grams)] = 0
        where = np.flatnonzero(self.grams[at] == h) if len(self.grams) else np.zeros(0, np.int64)
        lo = self.first[at[where]]
        n = self.first[at[where] + 1] - lo
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(where, n), self.t[np.repeat(lo, n) + inner]


def _previous(h: np.ndarray) -> np.ndarray:
    """The place of the same value before each one, or -1."""
    at = np.argsort(h, kind="stable")
    out = np.full(len(h), -1, np.int64)
    same = h[at[1:]] == h[at[:-1]]
    out[at[1:][same]] = at[:-1][same]
    return out


def _in_windows(where: np.ndarray, prev: np.ndarray, length: int, n: int) -> np.ndarray:
    """Distinct values among those at ``where``, for each window of ``length`` of the ``n`` places.

    A value counts once: where it comes first, in windows that start after its previous place.
    """
    lo = np.maximum(np.maximum(prev[where], where - length) + 1, 0)
    d = np.bincount(lo, minlength=n + 1) - np.bincount(where + 1, minlength=n + 1)
    return np.cumsum(d)[: n - length + 1]


def _found(t: int, tm: Templates, lines: np.ndarray, several: bool, prev: np.ndarray, where: np.ndarray) -> tuple[tuple | None, int]:
    """The best (dice, -line, -t) of one template in one text, and what n_found counts.

    ``lines`` has the line of each word, ``where`` the places of the template's bigrams.
    """
    n, need, length, percent = int(tm.n[t]), int(tm.need[t]), int(tm.length[t]), tm.percent
    best, count, covered = [], 0, np.zeros(len(lines) + 1, np.int64)
    within = where[lines[where] == lines[where + 1]]
    own, hits = np.unique(lines[within], return_counts=True)
    for line in own[hits >= need]:
        a, e = np.searchsorted(lines, line), np.searchsorted(lines, line, side="right")
        m = int((prev[a : e - 1] < a).sum())
        w = within[np.searchsorted(within, a) : np.searchsorted(within, e)]
        s = int((prev[w] < a).sum())
        if 200 * s >= percent * (m + n):
            best.append((2.0 * s / (m + n), -int(line), -t))
            count += 1
            covered[a + 1 : e + 1] = 1
    whole = False
    if several:
        m, s = int((prev < 0).sum()), int((prev[where] < 0).sum())
        whole = 200 * s >= percent * (m + n)
        if whole:
            best.append((2.0 * s / (m + n), 0, -t))
            count += 1
    if len(prev) > length:
        s = _in_windows(where, prev, length, len(prev))
        if s.max() >= need:
            m = _in_windows(np.arange(len(prev)), prev, length, len(prev))
            good = np.flatnonzero(200 * s >= percent * (m + n))
            dice = 2.0 * s[good] / (m[good] + n)
            if len(good):
                top = int(np.argmax(dice))
                best.append((float(dice[top]), -int(lines[good[top]]), -t))
            if not whole and len(good):
                before = np.cumsum(covered)
                free = before[good + length + 1] == before[good]
                taken = np.zeros(len(lines), bool)
                good, dice = good[free], dice[free]
                for x in good[np.lexsort((good, -dice))]:
                    # windows are of one length, so one that overlaps a taken one has an end in it
                    if not taken[x] and not taken[x + length]:
                        taken[x : x + length + 1] = True
                        count += 1
    return max(best, default=None), count


def _scanned(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tm: Templates = shared.value
        k = len(tm.names)
        for b in sliced(batches):
            texts = b.column("~lines")
            w = Words(texts, False)
            h = _bigrams(w)
            p, t = tm.hits(h)
            inside = w.doc[p] == w.doc[p + 1]
            p, t = p[inside], t[inside]
            key = w.doc[p] * k + t
            at = np.argsort(key, kind="stable")
            pairs, lo, hits = np.unique(key[at], return_index=True, return_counts=True)
            breaks = np.cumsum(w.data == 10)
            best: list[tuple | None] = [None] * b.num_rows
            count = np.zeros(b.num_rows, np.int64)
            last = -1
            for i in np.flatnonzero(hits >= tm.need[pairs % k]):
                doc, own = divmod(int(pairs[i]), k)
                if doc != last:
                    last, a, e = doc, int(w.first[doc]), int(w.first[doc + 1])
                    prev = _previous(h[a : e - 1])
                    start = int(w.offsets[doc])
                    base = int(breaks[start - 1]) if start else 0
                    lines = breaks[w.starts[a:e]] - base + 1
                    several = int(breaks[w.offsets[doc + 1] - 1]) > base
                where = p[at[lo[i] : lo[i] + hits[i]]] - a
                if (prev[where] < 0).sum() < tm.need[own]:
                    continue
                top, n = _found(own, tm, lines, several, prev, where)
                count[doc] += n
                if top is not None and (best[doc] is None or top > best[doc]):
                    best[doc] = top
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in columns),
                    pa.array([x and tm.names[-x[2]] for x in best], pa.string()),
                    pa.array([x and x[0] for x in best], pa.float64()),
                    pa.array([x and -x[1] for x in best], pa.int32()),
                    pa.array(count),
                ],
                names=[*columns, "licence", "dice", "line", "n_found"],
            )

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES + TEXTS, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its columns, licence, dice, line (0: the whole text) and n_found.

    The units are each line, the whole text, and each run of as many words as a template has, across lines.  A unit
    is compared with a template only if the text has the bigrams that the Dice coefficient needs to reach
    ``percent``: 2 * shared / (shared + template) is a bound.  The best unit is named, ties going to the earlier line
    (of a run: that of its first word) and then the earlier template.  n_found counts lines, whole texts and
    templates that reach the mark, and runs apart from one another and from those: of runs that overlap the best
    counts.  Null and empty texts, and units of one word, match nothing.  ``templates`` is a bounded parameter that
    is broadcast.  Texts are normalised by built-in functions; bigrams are compared by 64-bit hashes.  No shuffle.
    Columns with the name of a result, or ``~lines``, give way.
    """
    docs = plain(docs, "licence", "dice", "line", "n_found", "~lines")
    spark = docs.sparkSession
    t = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(templates)], "t_no int, body string")
    bodies = [r.body for r in t.select("t_no", normalised(F.col("body")).alias("body")).orderBy("t_no").collect()]
    shared = spark.sparkContext.broadcast(Templates([a for a, _ in templates], bodies, percent))
    own = [StructField("licence", StringType()), StructField("dice", DoubleType()), StructField("line", IntegerType()), StructField("n_found", LongType())]
    d = docs.withColumn("~lines", _by_line(F.col("text"))).mapInArrow(_scanned(shared, docs.columns), StructType([*docs.schema.fields, *own]))
    return d.withColumn("dice", F.round("dice", 6))


def _sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(NOTICES))
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    grams = "CASE WHEN len(w) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
    WITH t AS (SELECT t_no, licence, {grams} AS g FROM (SELECT t_no, licence, string_split({norm("body")}, ' ') AS w FROM (VALUES {rows}) v(t_no, licence, body))),
    s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS t FROM documents),
    u AS (SELECT doc_id, 0 AS line, t AS x FROM s WHERE len(l) > 1 UNION ALL SELECT doc_id, unnest(range(1, len(l) + 1)), unnest(l) FROM s),
    g AS (SELECT doc_id, line, {grams} AS g FROM (SELECT doc_id, line, string_split({norm("x")}, ' ') AS w FROM u)),
    m AS (SELECT doc_id, line, t_no, licence, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice
          FROM g JOIN t ON least(len(g.g), len(t.g)) * 200 >= (len(g.g) + len(t.g)) * 80),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, t_no) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM m WHERE dice * 100 >= 80)
    SELECT s.doc_id, licence, round(dice, 6) AS dice, line::INTEGER AS line, coalesce(n, 0)::BIGINT AS n_found FROM s LEFT JOIN k ON k.doc_id = s.doc_id AND r = 1"""


SQL = _sql()
