"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A unit is a whole text, each of its lines, and each run of words that is closest to a template (below). Units and templates
are lower-cased and cut into words of letters and digits; a unit's bigrams are the set of its pairs of neighbouring words.
The coefficient is twice the shared bigrams over the sum of both sizes. It can only reach the threshold if the unit's size lies between t / (2 - t) and (2 - t) / t times
the template's, so other templates aren't compared. Before that, hashes of all bigrams of a chunk of texts are looked up
among the templates' at once, and units with fewer of a template's than the threshold needs, nearly all, are passed over.

Runs find licences that are wrapped over lines of a longer text, or share their line with other words. Wherever enough of a
template's bigrams lie within (2 - t) / t times its length, the run of at most that length with the highest coefficient
is taken, across line ends; then the best beside it. A run is left out if it overlaps a unit or another run that
shares more bigrams with its template (of equals the one with the higher coefficient stays). ``line`` is the line that a
run begins on. The SQL knows whole texts and lines and the texts in TEMPLATES; a plain search of all runs checks the rest.

Nothing is shuffled, and the templates are fixed. Each text and line is reported with its best template, of equals the first
by name. Null and empty texts have no units; a unit or template of one word has no bigram and is never reported. A text of
one line is reported as that line only. Repeated rows are reported once each.
"""

from __future__ import annotations

import heapq
import re
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapforge.llm.common import chunks, span_hashes, table, texts_of, word_bounds
from lapforge.llm.decontaminate import _BETWEEN_WORDS
from lapforge.llm.registry import register

# Notices and short licences in their published wording.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."),
}
# More notices; full texts are in the folder license_texts.
NOTICES = {
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty."),
} | {
    name: (
        f"This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
        f"the Free Software Foundation{stop[0].replace(':', ',')} either version {version} of the License, or (at your option) any later "
        f"version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.")
    for name, work, stop, kind, version in (
        ("gpl-2.0-header", "program", ";", "General Public License", "2"),
        ("lgpl-2.1-header", "library", ";", "Lesser General Public License", "2.1"),
        ("lgpl-3.0-header", "library", ":", "Lesser General Public License", "3"))
}
LEAST = 0.8
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


@cache
def all_templates() -> dict[str, str]:
    """TEMPLATES, NOTICES and the full texts."""
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files("lapforge.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | NOTICES | texts


def bigrams(text: str) -> set[tuple[bytes, bytes]]:
    words = _WORD.findall(text.lower().encode())
    return set(zip(words, words[1:]))


def best_template(found: set, templates: dict[str, set], least: float) -> tuple[float, str] | None:
    """The highest coefficient of at least ``least``, and its template; sizes out of bounds aren't compared."""
    size, best = len(found), None
    for name in sorted(templates):
        other = templates[name]
        # 3 * 0.8 is more than 2 * 1.2 in floats: the coefficient itself decides at the bound.
        if not other or len(other) * least > size * (2 - least) + 1e-9 or size * least > len(other) * (2 - least) + 1e-9:
            continue
        dice = 2.0 * len(found & other) / (size + len(other))
        if dice >= least and (best is None or dice > best[0]):
            best = (dice, name)
    return best


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the bigrams within lines, the number of each one's line, and the number of each text's first line."""
    low = [t.decode().lower().encode() for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(low) + b"\n", np.uint8)
    starts, ends = word_bounds(buf, _BETWEEN_WORDS)
    line = np.cumsum(buf == 10)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    words = span_hashes(buf, starts, ends)
    at = np.arange(max(0, len(words) - 1))
    pairs = span_hashes(words, at, at + 2)
    offsets = np.cumsum([0] + [t.count(b"\n") + 1 for t in low])[:-1]
    return pairs, line, offsets


def best_runs(pairs: np.ndarray, known: np.ndarray, starts: np.ndarray, size: int, longest: int, least: float) -> list[tuple[int, int]]:
    """Runs [start, stop) of ``pairs`` with a coefficient of at least ``least``, the highest first, none overlapping another.

    ``known`` marks the pairs of a template of ``size`` different ones; runs begin at one of ``starts`` and hold at most
    ``longest`` pairs.
    """
    order = np.argsort(pairs, kind="stable")
    before = np.full(len(pairs), -1)
    again = pairs[order[1:]] == pairs[order[:-1]]
    before[order[1:][again]] = order[:-1][again]

    def push(start, stop):
        new = before[start:stop] < start
        dice = 2.0 * np.cumsum(new & known[start:stop]) / (np.cumsum(new) + size)
        end = int(dice.argmax())
        if dice[end] >= least:
            heapq.heappush(heap, (-dice[end], start, start + end + 1))

    heap: list[tuple[float, int, int]] = []
    for start in starts.tolist():
        push(start, start + longest)
    runs, taken = [], np.zeros(len(pairs), bool)
    while heap:
        _, start, stop = heapq.heappop(heap)
        if taken[start]:
            continue
        if taken[start:stop].any():
            push(start, start + int(taken[start:stop].argmax()))
        else:
            taken[start:stop] = True
            runs.append((start, stop))
    return runs


def license_units(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row for each unit that matches: the other columns of ``df``, line (0: whole text), license and dice."""
    new = StructType.fromDDL("line int, license string, dice double")
    kept = [c for c in df.columns if c not in (text, *new.fieldNames())]
    schema = StructType([df.schema[c] for c in kept] + list(new))
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    templates = all_templates() if templates is None else templates

    def run(batches):
        sets = {name: bigrams(t) for name, t in templates.items()}
        hashed = {name: _hashes([" ".join(t.split()).encode()])[0] for name, t in templates.items() if sets[name]}
        known = np.unique(np.concatenate([*hashed.values(), np.zeros(1, np.uint64)]))
        member = {name: np.isin(known, h) for name, h in hashed.items()}
        # Of a template's pairs, so many must be in a unit, and a run is at most so long.
        needed = {name: max(1, int(np.ceil(len(sets[name]) * least / (2 - least) - 1e-9))) for name in hashed}
        longest = {name: int(len(h) * (2 - least) / least + 1e-9) for name, h in hashed.items()}

        def units_of(whole, t, pairs, line, offsets, whole_too, lines, starts):
            """(line, license, dice) for what matches in one text."""
            first = int(offsets[t])
            w0, w1 = np.searchsorted(line, [first, first + whole.count("\n") + 1]).tolist()
            units, texts_lines = [], whole.split("\n")
            if whole_too and "\n" in whole:
                units.append((0, whole, 0, w1 - w0 - 1))
            for n in lines:
                a, b = np.searchsorted(line, [first + n, first + n + 1]).tolist()
                units.append((n + 1, texts_lines[n], a - w0, b - w0 - 1))
            out, spans = [], []
            for number, unit, a, b in units:
                found = bigrams(unit)
                match = best_template(found, sets, least)
                if match:
                    out.append((number, match[1], match[0]))
                    spans.append((a, b, len(found & sets[match[1]])))
            runs = []
            if starts:
                words = _WORD.findall(whole.lower().encode())
                own = pairs[w0:w1 - 1]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                equal = known[at] == own
                for name, places in starts.items():
                    for a, b in best_runs(own, equal & member[name][at], places - w0, len(sets[name]), longest[name], least):
                        found = set(zip(words[a:b], words[a + 1:b + 1]))
                        shared = len(found & sets[name])
                        dice = 2.0 * shared / (len(found) + len(sets[name]))
                        if dice >= least:
                            runs.append((-shared, -dice, a, name, b))
            for shared, dice, a, name, b in sorted(runs):
                if all(b <= x or y <= a or -shared > n for x, y, n in spans):
                    spans.append((a, b, -shared))
                    out.append((int(line[w0 + a]) - first + 1, name, -dice))
            return out

        for batch in batches:
            texts = texts_of(batch, "text")
            for i, j in chunks(texts):
                pairs, line, offsets = _hashes(texts[i:j])
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                hit = np.flatnonzero(known[at] == pairs)
                text_of = lambda x: np.searchsorted(offsets, x, side="right") - 1
                hit = hit[text_of(line[hit]) == text_of(line[hit + 1])] if len(hit) else hit
                which, inner, owner = at[hit], line[hit] == line[hit + 1] if len(hit) else hit.astype(bool), text_of(line[hit])
                wholes, lines, starts = set(), {}, {}
                for name, need in needed.items():
                    of = member[name][which]
                    if np.count_nonzero(of) < need:
                        continue
                    places, owners = hit[of], owner[of]
                    numbers, counts = np.unique(owners, return_counts=True)
                    wholes.update(numbers[counts >= need].tolist())
                    numbers, counts = np.unique(line[places[inner[of]]], return_counts=True)
                    for n in numbers[counts >= need].tolist():
                        t = int(text_of(n))
                        lines.setdefault(t, set()).add(n - int(offsets[t]))
                    last = len(places) - need + 1
                    dense = np.flatnonzero((places[need - 1:] - places[:last] < longest[name]) & (owners[need - 1:] == owners[:last]))
                    edges = np.flatnonzero(np.diff(owners[dense])) + 1
                    for some in np.split(dense, edges) if len(dense) else ():
                        starts.setdefault(int(owners[some[0]]), {})[name] = places[some]
                origin, out = [], []
                for t in sorted(wholes | set(lines) | set(starts)):
                    found = units_of(texts[i + t].decode(), t, pairs, line, offsets, t in wholes, sorted(lines.get(t, ())), starts.get(t))
                    origin += [t + i] * len(found)
                    out += found
                columns = [c.take(pa.array(origin, pa.int64())) for c in batch.columns[:len(kept)]]
                new_columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*columns, *new_columns], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _sql() -> str:
    listed = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    words = "regexp_extract_all(lower({}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    return f"""
WITH templates AS (
  SELECT license, {pairs} AS b FROM (SELECT license, {words.format('t')} AS w FROM (VALUES {listed}) v(license, t)) x),
lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, CAST(0 AS INTEGER) AS line, text AS unit FROM lines WHERE len(l) > 1
  UNION ALL SELECT doc_id, CAST(i AS INTEGER), l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines) x),
sets AS (
  SELECT doc_id, line, {pairs} AS b FROM (SELECT doc_id, line, {words.format('unit')} AS w FROM units) x),
matched AS (
  SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
  FROM sets s JOIN templates t ON len(s.b) > 0 AND len(s.b) * {LEAST} <= len(t.b) * {2 - LEAST} AND len(t.b) * {LEAST} <= len(s.b) * {2 - LEAST}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS n FROM matched WHERE dice >= {LEAST})
SELECT doc_id, line, license, dice FROM ranked WHERE n = 1"""


@register("op4_license_scan", _sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
