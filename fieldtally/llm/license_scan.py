"""Licence scans by conditional compression.

Templates are short notices, file headers and whole licence texts. Runs of words that a document shares with a template say
where in it a copy may lie, over any number of lines; other lines with the vocabulary of licences are blocks of their own.
A block is compressed alone and with each of its templates as raw zstandard dictionary; templates rank by how much they
shrink it. The best is confirmed by the exact wording: the words to add, drop or change to get from the template's wording
to the block's. SPDX tags name their licences themselves.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import utf8_of, window_hashes, word_hashes

# Usual short notices of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
}
# Whole texts, in ``licenses/``; BSD-2-Clause is BSD-3-Clause without its third clause.
TEXTS = ("0BSD", "Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Zlib")
MARKERS = r"(?i)licen[cs]e|copyright|spdx|warrant(y|ies)|redistribution"
_WORD = re.compile(r"\w+(?:[.-]\w+)*")
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_HOPE = (
    " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a "
    "copy of the GNU {kind} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
_GNU_KINDS = (
    ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
)
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
     'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
     "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
     "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
     "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
     "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    *[(n, _GNU.format(what=w, kind=k, version=v) + more.format(what=w, kind=k))
      for n, k, v in _GNU_KINDS for w in (("library", "program") if n[0] == "L" else ("program",)) for more in ("", _HOPE)],
    *[(n, f"Licensed under the GNU {k}, version {v}.") for n, k, v in _GNU_KINDS],
]
# A notice is the licence's only if no word that names it is missing, and no word that makes it another one is added.
_NAMES = frozenset(
    "mit apache gnu gpl lgpl lesser affero general mozilla cc by by-nc by-sa creative commons attribution attribution-sharealike "
    "attribution-noncommercial sharealike noncommercial bsd".split()
)
_OTHERS = frozenset(
    "lesser affero library by-nc by-sa by-nd by-nc-sa by-nc-nd nc sa nd sharealike noncommercial noderivatives noderivs "
    "attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike "
    "attribution-noncommercial-noderivatives".split()
)
_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
_TAG = re.compile(rf"(?i)\bspdx-license-identifier\s*:[ \t]*((?:\([ \t]*)*{_ID}(?:[ \t)]*[ \t](?:and|or|with)[ \t]+[( \t]*{_ID})*)")
_FIELD = re.compile(rf"(?i)\blicen[cs]e[\"']?[ \t]*[:=][ \t]*[\"']?({_ID})")
_REST = re.compile(rb"(?:[._-](?!\s)[0-9A-Za-z\x80-\xff]*)*")  # of a word of several parts, from the end of one
_STRETCH = re.compile(rb"[0-9A-Za-z\x80-\xff._-]*")
_PARTS = np.ones(256, bool)  # bytes between words
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def compressed(block: bytes, template: bytes | None, level: int = 19) -> int:
    """Bytes of ``block`` under zstandard, with ``template`` as raw dictionary if given."""
    known = zstandard.ZstdCompressionDict(template, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if template else None
    return len(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False).compress(block))


def _packer(template: bytes, level: int = 19) -> zstandard.ZstdCompressor:
    """What ``compressed`` uses, made ready once for many blocks."""
    known = zstandard.ZstdCompressionDict(template, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if template else None
    if known:
        known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False)


def differences(block: str, template: str) -> tuple[int, str]:
    """Number of template words in the block's wording, in order, and the changes as text: ``-`` gone, ``+`` added."""
    a, b = _WORD.findall(template.lower()), _WORD.findall(block.lower())
    shared, said = 0, []
    for kind, i, j, k, l in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():  # noqa: E741
        if kind == "equal":
            shared += j - i
        else:
            said += [f"-{w}" for w in a[i:j]] + [f"+{w}" for w in b[k:l]]
    return shared, " ".join(said)


def notices() -> list[tuple[str, str]]:
    """Licence and wording of notices and file headers: these name a licence."""
    return [*TEMPLATES.items(), *HEADERS]


def whole_texts() -> list[tuple[str, str]]:
    """Licence and wording of whole licences: these are one, with or without its title."""
    read = lambda name: resources.files(__package__).joinpath("licenses", f"{name}.txt").read_text("utf-8")
    whole = [(name, read(name)) for name in TEXTS]
    two = re.sub(r"(?s)\n3\. Neither.*?permission\.\n", "\n", read("BSD-3-Clause"))
    return [*whole, ("BSD-2-Clause", two)]


def forms() -> list[tuple[str, str]]:
    """Licence and wording of every template."""
    return [*notices(), *whole_texts()]


def _version(word: str) -> str:
    return word.lstrip("v").removesuffix(".0")


class Scanner:
    """Finds the copies of ``forms`` (licence, wording) in texts; the first ``named`` of them are notices."""

    def __init__(self, forms: list[tuple[str, str]], named: int, agree: float, any_tag: bool):
        self.forms, self.named, self.agree, self.any_tag = forms, named, agree, any_tag
        self.names = {name.lower(): name for name, _ in forms}
        self.words = [_WORD.findall(text.lower()) for _, text in forms]
        self.index: dict[int, tuple[np.ndarray, ...]] = {}
        self.sizes, self.least = [], []
        runs: dict[int, list] = {}
        for f, (_, text) in enumerate(forms):
            hashes = word_hashes(*utf8_of(pa.array([text])), _PARTS, lower=True)[0]
            size = min(3, len(hashes))
            self.sizes.append(len(hashes))
            found = window_hashes(hashes, size) if size else np.zeros(0, np.uint64)
            values, first, count = np.unique(found, return_index=True, return_counts=True)
            if (count == 1).any():  # a run that a form repeats does not tell its place
                values, first = values[count == 1], first[count == 1]
            # a copy with four words of five, in order, keeps half of the runs of three; a fifth leaves room for insertions
            self.least.append(max(1, len(values) // 5))
            runs.setdefault(size, []).extend(zip(values.tolist(), [f] * len(values), first.tolist()))
        for size, triples in runs.items():
            if size:
                triples.sort()
                hashes = np.array([t[0] for t in triples], np.uint64)
                keys, first = np.unique(hashes, return_index=True)
                self.index[size] = (keys, np.append(first, len(hashes)), *(np.array([t[i] for t in triples]) for i in (1, 2)))
        self.least, self.sizes = np.array(self.least), np.array(self.sizes)
        self.packers = [_packer(text.encode()) for _, text in forms]
        self.aligned, self.gain = cache(self._aligned), cache(self._gain)

    def places(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Per row, where copies may lie: form, first and end byte."""
        hashes, rows, starts, ends = word_hashes(data, offsets, _PARTS, lower=True)
        parts = []
        for size, (keys, first, form, at) in self.index.items():
            every = window_hashes(hashes, size)
            near = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
            p = np.flatnonzero(keys[near] == every)
            p = p[rows[p] == rows[p + size - 1]]
            count = first[near[p] + 1] - first[near[p]]
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[near[p]], count)
            parts.append((np.repeat(p, count), form[which], at[which], np.full(len(which), size)))
        p, form, at, size = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        out: dict[int, list] = {}
        if not len(p):
            return out
        order = np.lexsort((p, p - at, form, rows[p]))
        p, form, at, size = p[order], form[order], at[order], size[order]
        new = np.flatnonzero(np.append(True, (np.diff(rows[p]) != 0) | (np.diff(form) != 0)))
        for low, high in zip(new, np.append(new[1:], len(p))):
            f = int(form[low])
            if high - low < self.least[f]:
                continue
            n, row = int(self.sizes[f]), int(rows[p[low]])
            cuts = np.flatnonzero(np.diff((p - at)[low:high]) > max(3, n // 5)) + 1 + low
            groups = []
            for a, b in zip([low, *cuts], [*cuts, high]):
                if b - a >= max(1, self.least[f] // 10):
                    x, q = p[a:b], at[a:b]
                    groups.append([int(x.min()), int((x + size[a:b]).max()), int(q.min()), int((q + size[a:b]).max()), b - a])
            joined: list[list] = []
            for g in sorted(groups):  # what follows in the form and in the text, after an insertion, is the same copy
                last = joined[-1] if joined else None
                if last and g[2] >= last[3] - 2 and last[1] - 2 <= g[0] <= last[1] + n:
                    joined[-1] = [last[0], g[1], last[2], g[3], last[4] + g[4]]
                else:
                    joined.append(g)
            low_word, high_word = np.searchsorted(rows, [row, row + 1])
            for x, y, q, r, count in joined:
                if count >= self.least[f]:
                    x = max(int(low_word), x - q - 2 - n // 10)
                    y = min(int(high_word), y + n - r + 2 + n // 10)
                    out.setdefault(row, []).append((f, int(starts[x] - offsets[row]), int(ends[y - 1] - offsets[row])))
        return out

    def _aligned(self, block: str, f: int) -> tuple[int, int, tuple[str, ...], tuple[tuple[int, int], ...], bool]:
        """Words shared, number of changes, the changes, places of the shared words, and whether the block is this form."""
        a, found = self.words[f], [(m.group().lower(), m.span()) for m in _WORD.finditer(block)]
        b = [w for w, _ in found]
        same = [x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
        spans = tuple(found[k][1] for x in same for k in range(x.b, x.b + x.size))
        gone, added, said, i, k = [], [], [], 0, same[0].b if same else 0
        for x in [*same, difflib.Match(len(a), same[-1].b + same[-1].size if same else 0, 0)]:
            gone += a[i : x.a]
            added += b[k : x.b]
            said += [f"-{w}" for w in a[i : x.a]] + [f"+{w}" for w in b[k : x.b]]
            i, k = x.a + x.size, x.b + x.size
        sure = len(spans) >= self.agree * len(a) and bool(spans)
        if sure and f < self.named:
            instead = {_version(w) for w in added}
            named = [w for w in gone if w in _NAMES or re.search(r"\d", w) and _version(w) not in instead]
            sure = not named and not _OTHERS.intersection(added)
        return len(spans), len(said), tuple(said), spans, sure

    def _gain(self, block: bytes, f: int) -> int:
        return compressed(block, None) - len(self.packers[f].compress(block))

    def tags(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and licence of the SPDX tags, and of ``license:`` fields that name a known one."""
        for pattern in (_TAG, _FIELD):
            for m in pattern.finditer(text):
                words = re.findall(_ID, m.group(1))
                for before, word in zip(["", *words], words):
                    if word.lower() in ("and", "or", "with") or before.lower() == "with":
                        continue
                    base = re.sub(r"(?i)(-only|-or-later|\+)$", "", word).lower()
                    if pattern is _TAG and self.any_tag or base in self.names or word.lower() in self.names:
                        yield m.start(), m.end(), self.names.get(base, self.names.get(word.lower(), word.rstrip(".")))

    def _whole_words(self, raw: bytes, places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Places moved to the ends of the words they cut, each once. A stretch without a gap is walked once, however long."""
        out, head, tail = {}, (0, -1), (0, -1)
        for f, start, end in sorted(places, key=lambda x: x[1:]):
            if not tail[0] <= end <= tail[1]:
                tail = (end, _REST.match(raw, end).end())
            if not head[0] < start <= head[1]:
                first = start
                while first and (not _PARTS[raw[first - 1]] or raw[first - 1 : first] in b".-_"):
                    first -= 1
                head = (first, _STRETCH.match(raw, start).end())
            # only a start inside the stretch moves to its first byte
            out[f, head[0], tail[1]] = None
        return list(out)

    def findings(self, text: str, places: list[tuple[int, int, int]], marked: bool) -> list[dict]:
        """Blocks of one text, by place."""
        if self.aligned.cache_info().currsize > 20_000:
            self.aligned.cache_clear()
            self.gain.cache_clear()
        raw, out, left = text.encode() if places else b"", [], []
        for f, start, end in self._whole_words(raw, places):
            block = raw[start:end].decode()
            shared, n_changes, said, spans, sure = self.aligned(block, f)
            if spans:
                base = len(raw[:start].decode())
                kept = block[spans[0][0] : spans[-1][1]]
                gain = self.gain(kept.encode(), f)
                left.append((sure, gain, shared - n_changes, f, said, {base + s for s, _ in spans}, base + spans[0][0], base + spans[-1][1]))
        spans_of: list[tuple[int, int]] = []
        for start, end, name in self.tags(text) if marked else ():
            out.append({"at": start, "end": end, "template": name, "gain": 0, "changes": "", "confirmed": True})
            spans_of.append((start, end))
        while left:  # confirmed ones first; the wording decides between templates that shrink a block alike
            top = max(left, key=lambda c: (c[0], c[1], c[2], c[3]))
            near = [c for c in left if c[0] == top[0] and c[1] >= 0.9 * top[1] - 2 and c[5] & top[5]]
            best = max(near, key=lambda c: (c[2], c[1], self.forms[c[3]][0]))
            _, gain, _, f, said, words, start, end = best
            out.append({"at": start, "end": end, "template": self.forms[f][0], "gain": gain, "changes": " ".join(said), "confirmed": best[0]})
            spans_of.append((start, end))
            left = [c for c in left if c is not best and 2 * len(c[5] & words) < len(c[5])]
        if marked:
            done = sorted(spans_of)
            reach = np.maximum.accumulate([e for _, e in done]) if done else []
            starts, at = [s for s, _ in done], 0
            for line in text.split("\n"):
                end = at + len(line)
                i = int(np.searchsorted(starts, end, side="right"))  # those that begin on or before the line
                if not (i and reach[i - 1] > at) and re.search(MARKERS, line):
                    sizes = [(self.gain(line.encode(), f), f) for f in range(self.named)]
                    top = max((s for s, _ in sizes), default=0)
                    ranked = [(self.aligned(line, f), s, f) for s, f in sizes if s >= top - 2]
                    if ranked:
                        (_, _, said, _, _), gain, f = max(ranked, key=lambda x: (x[0][0] - x[0][1], x[1], self.forms[x[2]][0]))
                        out.append({
                            "at": at, "end": end, "template": self.forms[f][0], "gain": gain, "changes": " ".join(said), "confirmed": False,
                        })
                at = end + 1
        out.sort(key=lambda x: (x["at"], x["end"], x["template"]))
        line, seen = 0, 0
        for x in out:
            at, end = x.pop("at"), x.pop("end")
            line, seen = line + text.count("\n", seen, at), at
            x["line"], x["last"] = line, line + text.count("\n", at, end)
        return out


_KIND = pa.list_(pa.struct([
    ("line", pa.int64()), ("template", pa.string()), ("gain", pa.int64()), ("changes", pa.string()), ("confirmed", pa.bool_()), ("last", pa.int64()),
]))


def _scan(forms: list[tuple[str, str]], named: int, agree: float, any_tag: bool, piece: int = 2_000_000):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(forms, named, agree, any_tag)
        for batch in batches:
            texts, marks = batch.column("text"), batch.column("marked").to_pylist()
            data, offsets = utf8_of(texts)
            first = 0
            out: list[list] = []
            while first < len(marks):
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece, side="right")) - 1)
                places = scanner.places(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
                for i in range(first, end):
                    near = places.get(i - first, [])
                    out.append(scanner.findings(texts[i].as_py(), near, bool(marks[i])) if near or marks[i] else [])
                first = end
            names = [",".join(sorted({x["template"] for x in found if x["confirmed"]})) for found in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in out], pa.int64()),
                    pa.array(names, pa.string()),
                    pa.array([x or None for x in out], _KIND),
                ],
                names=["doc_id", "n_blocks", "licenses", "findings"],
            )

    return scan


def scanned(
    docs: DataFrame, templates: dict[str, str] | None = None, agree: float = 0.8, texts: dict[str, str] | None = None
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_blocks``, the confirmed licences (sorted, by commas) and ``findings``.

    A finding has the block's first and last line number, template, bytes saved, wording changes, and whether at least
    ``agree`` of the template's words are there in order; a notice also needs the words that name its licence, a whole text
    does not. Lines with the vocabulary of licences in which no copy was found are ranked against all notices, and stay
    unconfirmed. ``templates`` replaces the notices and ``texts`` the whole texts; one without the other stands alone, and SPDX
    tags then count for its licences only. NULL and empty texts have none; rows that are the same in id and text each get
    their row. Other columns are not looked at.
    """
    own = templates is not None or texts is not None
    named, whole = (list((templates or {}).items()), list((texts or {}).items())) if own else (notices(), whole_texts())
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = "array<struct<line:bigint,template:string,gain:bigint,changes:string,confirmed:boolean,last:bigint>>"
    rows = docs.select("doc_id", "text", F.col("text").rlike(MARKERS).alias("marked"))
    return rows.mapInArrow(
        _scan([*named, *whole], len(named), agree, not own), f"doc_id {kind}, n_blocks long, licenses string, findings {item}"
    )
