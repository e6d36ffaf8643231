"""License scans: normalised passages against templates by Dice over word bigrams.

Texts and templates are normalised to lower-case runs of ASCII letters and
digits. A passage that resembles a template consists mostly of the template's
bigrams, so the scan looks up each bigram of the whole text in the templates'
bigram vocabulary and only examines the neighbourhoods of hits. For a template
with m bigrams, a passage of w bigrams can have a Dice coefficient of at least
t only if ``t*m/(2-t) <= w <= m*(2-t)/t``; templates outside these bounds are
pruned before any window is compared. Within a neighbourhood every window that
starts and ends on a hit and meets the bounds is scored, the best one is
reported, and the search goes on to both sides of it.
"""

from __future__ import annotations

import bisect
import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import sliced

#: Short notices, SPDX lines, headers and permission texts of common public licences.
#: An SPDX line of a one-word identifier has too few bigrams to be told from others at the threshold.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
        "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    # The opening parts, which texts may carry without the rest.
    "BSD-opening": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "Unlicense-opening": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "GPL-2.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "LGPL-2.1-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any "
        "later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public "
        "License for more details."
    ),
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": (
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held '
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    **{f"{i}-SPDX": f"SPDX-License-Identifier: {i}" for i in (
        "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
        "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0",
    )},
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits; all else separates."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


@dataclass(frozen=True)
class Index:
    """Templates as bigram multisets over one vocabulary. Its size is that of the templates."""

    templates: dict[str, str]
    threshold: float = 0.8

    @cached_property
    def vocabulary(self) -> dict[bytes, int]:
        words = sorted({w for t in self.templates.values() for w in words_of(t)})
        return {w: i for i, w in enumerate(words)}

    @cached_property
    def bigrams(self) -> dict[str, Counter]:
        v = self.vocabulary
        out = {}
        for name, text in self.templates.items():
            ids = [v[w] for w in words_of(text)]
            out[name] = Counter(a * len(v) + b for a, b in zip(ids, ids[1:], strict=False))
        return out

    @cached_property
    def member(self) -> dict[str, np.ndarray]:
        n = len(self.vocabulary)
        out = {}
        for name, grams in self.bigrams.items():
            out[name] = np.zeros(n * n, bool)
            out[name][list(grams)] = True
        return out

    @cached_property
    def any_member(self) -> np.ndarray:
        return np.logical_or.reduce(list(self.member.values()))

    def bounds(self, name: str) -> tuple[float, float]:
        m, t = sum(self.bigrams[name].values()), self.threshold
        return t * m / (2 - t), m * (2 - t) / t

    def bigram_ids(self, text: str) -> np.ndarray:
        """A bigram id for each pair of neighbouring words, -1 where a word is in no template."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words_of(text)), np.int64)
        if len(ids) < 2:
            return np.empty(0, np.int64)
        a, b = ids[:-1], ids[1:]
        return np.where((a >= 0) & (b >= 0), a * len(self.vocabulary) + b, -1)

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, last word + 1, score) of the passages at or above the threshold.

        A passage is reported for its best template only; ties go to the longer,
        then to the earlier passage, then to the template's name.
        """
        grams = self.bigram_ids(text)
        known = np.flatnonzero((grams >= 0) & self.any_member[grams])
        if not len(known):
            return []
        found: list[tuple[float, int, int, str]] = []
        for name in self.templates:
            hits = known[self.member[name][grams[known]]]
            low, high = self.bounds(name)
            if len(hits) < low:  # a passage shares t*(w+m)/2 bigrams at least, which is ``low`` for the shortest one
                continue
            found += self._template(name, grams, hits, low, high)
        found.sort(key=lambda x: (-x[0], -(x[2] - x[1]), x[1], x[3]))
        taken = Taken()
        kept = [x for x in found if taken.add(x[1], x[2])]
        return [(n, a, b + 1, s) for s, a, b, n in sorted(kept, key=lambda x: x[1])]

    def _template(self, name: str, grams: np.ndarray, hits: np.ndarray, low: float, high: float) -> list[tuple[float, int, int, str]]:
        """Passages like one template: the best stretch, then the best that does not overlap it, and so on.

        A bigram of a stretch is shared if the stretch has it no more often before
        than the template has it at all, that is, if the place where it stands
        that many times earlier lies outside. So all stretches from one start are
        counted in one cumulative sum, and starts do not depend on each other.
        """
        counts = self.bigrams[name]
        m, most = sum(counts.values()), int(high)
        ids = grams[hits]
        order = np.argsort(ids, kind="stable")
        known, at = np.unique(ids, return_inverse=True)
        times = np.array([counts[int(g)] for g in known])[at]
        back = np.arange(len(ids)) - times[order]
        same = (back >= 0) & (ids[order][np.maximum(back, 0)] == ids[order])
        before = np.full(int(hits[-1]) + 1 + most, _NEVER)
        before[hits[order]] = np.where(same, hits[order][np.maximum(back, 0)], -1)
        # A stretch shares ``low`` bigrams at least, so that many places of the template's must follow.
        last = np.searchsorted(hits, hits + most)
        starts = hits[last - np.arange(len(hits)) >= low]
        offsets = np.arange(most)
        widths = offsets + 1

        def best(a: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
            """The best score from each start, -1 where none passes, and the stretch's end; of equal scores the longest."""
            place = a[:, None] + offsets
            p = before[place]
            shared = np.cumsum(p < a[:, None], axis=1)
            score = 2 * shared / (widths + m)
            fine = (p != _NEVER) & (widths >= low) & (score >= self.threshold) & (place < until)
            score = np.where(fine, score, -1.0)
            top = score.max(1)
            return top, a + most - np.argmax(score[:, ::-1] == top[:, None], axis=1)

        queue: list[tuple[float, int, int]] = []
        step = max(1, _CELLS // most)
        for i in range(0, len(starts), step):
            own = starts[i : i + step]
            top, end = best(own, _NEVER)
            queue += [(-float(top[k]), -int(end[k] - own[k]), int(own[k])) for k in np.flatnonzero(top >= 0)]
        heapq.heapify(queue)
        taken, out = Taken(), []
        while queue:
            score, width, a = heapq.heappop(queue)
            until = taken.free(a)
            if until <= a:
                continue
            if a - width > until:
                top, end = best(np.array([a]), until)
                if top[0] >= 0:
                    heapq.heappush(queue, (-float(top[0]), -int(end[0] - a), a))
                continue
            taken.add(a, a - width)
            out.append((-score, a, a - width, name))
        return out


_NEVER = np.iinfo(np.int64).max
#: Places looked at together.
_CELLS = 1 << 20


class Taken:
    """Intervals that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int) -> int:
        """Where the next interval begins from ``a`` on; ``a`` itself if it lies in one."""
        i = bisect.bisect_right(self.starts, a)
        if i and self.ends[i - 1] > a:
            return a
        return self.starts[i] if i < len(self.starts) else _NEVER

    def add(self, a: int, b: int) -> bool:
        if self.free(a) < b:
            return False
        i = bisect.bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    *,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Passages like a licence template: ``doc_id, license_id, start_word, end_word, score, passage``.

    A row for each passage, none for texts without one; word positions count
    normalised words from 0, ends exclusive. Null and empty texts have none; null
    ids stay null; repeated rows are answered each; other columns are not read.
    """
    index = Index(dict(templates or TEMPLATES), threshold)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_field = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            at, names, starts, ends, scores, passages = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for name, s, e, score in index.scan(text or ""):
                    at.append(i)
                    names.append(name)
                    starts.append(s)
                    ends.append(e)
                    scores.append(score)
                    passages.append(b" ".join(words_of(text)[s:e]).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64()), pa.array(passages, pa.string())],
                names=["doc_id", "license_id", "start_word", "end_word", "score", "passage"],
            )

    return src.mapInArrow(run, f"doc_id {id_field}, license_id string, start_word bigint, end_word bigint, score double, passage string")
