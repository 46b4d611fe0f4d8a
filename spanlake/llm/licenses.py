"""License scan by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, letters and
digits only, single blanks) and looked up among known licence sentences. The sequence
of known sentences is then matched against rules: a rule is an ordered list of
sentences, of which one may follow the one before within ``GAP`` sentences; of several
occurrences of a sentence the nearest from which the rule can be completed counts. A match whose sentences
all belong to a longer match is part of that one and not reported.

Every known sentence has one of the words of ``ANCHORS``; a text without any is not cut at all.
``All rights reserved`` is a rule without a licence: it is a match, in ``rules`` and ``spans``, and adds none to ``licenses``.

Defined results: null and empty texts, and texts without a match, have one row with no
licences; a rule that matches several times is listed each time; repeated rows get
equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanlake.llm.arrays import column, slices
from spanlake.llm.tables import mapped

GAP = 3
SCHEMA = "doc_id long, n_matches int, licenses string, rules string, spans string"

# Sentences of common licence texts and notices, by identifier.
SENTENCES = {
    "mit-name": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ],
    "apache-name": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-compliance": ["you may not use this file except in compliance with the License"],
    "apache-terms": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3-name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "gpl-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ],
    "gpl-details": ["See the GNU General Public License for more details"],
    "by-nc-name": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "by-name": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd-intro": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "bsd-names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "mpl2-name": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "gpl2-name": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2"],
    "gpl2-free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"
    ],
    "lgpl3-name": ["Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "lgpl21-name": ["Licensed under the GNU Lesser General Public License, version 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"],
    "lgpl21-free": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"
    ],
    "lgpl3-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "lgpl-warranty": [
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl3-name": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "agpl-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "isc-name": ["Licensed under the ISC License", "Released under the ISC License", "This project is licensed under the ISC License"],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "isc-warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"
    ],
    **{
        f"by-{kind}-name": [f"Licensed under CC BY-{kind.upper()} 4.0", f"This work is licensed under CC BY-{kind.upper()} 4.0", f"This work is licensed under a Creative Commons Attribution-{name} 4.0 International License"]
        for kind, name in (("sa", "ShareAlike"), ("nd", "NoDerivatives"), ("nc-sa", "NonCommercial-ShareAlike"), ("nc-nd", "NonCommercial-NoDerivatives"))
    },
    "cc0-name": ["Licensed under CC0 1.0", "Released under CC0 1.0", "This work is licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal"],
    "unlicense-name": ["Released under the Unlicense", "Licensed under the Unlicense", "This project is licensed under the Unlicense"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"
    ],
    "all-rights": ["All rights reserved"],
}

# Rules, each a licence and its sentences in order; one without a licence states that none is given.
RULES = {
    "mit-reference": ("MIT", ["mit-name"]),
    "mit-text": ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    "apache-2.0-reference": ("Apache-2.0", ["apache-name"]),
    "apache-2.0-header": ("Apache-2.0", ["apache-name", "apache-compliance", "apache-terms", "apache-see"]),
    "gpl-3.0-reference": ("GPL-3.0", ["gpl3-name"]),
    "gpl-3.0-header": ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-details"]),
    "cc-by-nc-4.0-reference": ("CC-BY-NC-4.0", ["by-nc-name"]),
    "cc-by-4.0-reference": ("CC-BY-4.0", ["by-name"]),
    "bsd-2-clause-text": ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary"]),
    "bsd-3-clause-text": ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-names"]),
    "mpl-2.0-reference": ("MPL-2.0", ["mpl2-name"]),
    "gpl-2.0-reference": ("GPL-2.0", ["gpl2-name"]),
    "gpl-2.0-header": ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty", "gpl-details"]),
    "lgpl-2.1-reference": ("LGPL-2.1", ["lgpl21-name"]),
    "lgpl-2.1-header": ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-warranty", "lgpl-details"]),
    "lgpl-3.0-reference": ("LGPL-3.0", ["lgpl3-name"]),
    "lgpl-3.0-program-header": ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-warranty", "lgpl-details"]),
    "lgpl-3.0-library-header": ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-warranty", "lgpl-details"]),
    "agpl-3.0-reference": ("AGPL-3.0", ["agpl3-name"]),
    "agpl-3.0-header": ("AGPL-3.0-or-later", ["agpl-free", "gpl-warranty", "agpl-details"]),
    "isc-reference": ("ISC", ["isc-name"]),
    "isc-text": ("ISC", ["isc-grant", "isc-warranty"]),
    "cc-by-sa-4.0-reference": ("CC-BY-SA-4.0", ["by-sa-name"]),
    "cc-by-nd-4.0-reference": ("CC-BY-ND-4.0", ["by-nd-name"]),
    "cc-by-nc-sa-4.0-reference": ("CC-BY-NC-SA-4.0", ["by-nc-sa-name"]),
    "cc-by-nc-nd-4.0-reference": ("CC-BY-NC-ND-4.0", ["by-nc-nd-name"]),
    "cc0-1.0-reference": ("CC0-1.0", ["cc0-name"]),
    "unlicense-reference": ("Unlicense", ["unlicense-name"]),
    "unlicense-text": ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    "all-rights-reserved": ("", ["all-rights"]),
}

_CUT = re.compile(r"(?<=[.;:!?])[\"')\]]*(?=\s|$)|\n|\r|$")
_WORD = re.compile(r"[^\W_]+")


def normal(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


KNOWN = {normal(s): name for name, texts in SENTENCES.items() for s in texts}


def _anchors() -> tuple[str, ...]:
    """Words of which every known sentence holds one: the one in most sentences first, then of those left."""
    left, out = set(KNOWN), []
    while left:
        words = {w for k in left for w in k.split() if len(w) >= min(5, max(map(len, k.split())))}
        out.append(min(words, key=lambda w: (-sum(w in k for k in left), -len(w), w)))
        left = {k for k in left if out[-1] not in k}
    return tuple(out)


ANCHORS = _anchors()


def sentences(text: str) -> list[str]:
    """Normalised sentences that have a word. A line break ends one, as do . ; : ! ? before white space."""
    out, last = [], 0
    for cut in _CUT.finditer(text):
        if cut.end() > last or cut.end() == len(text):
            s = normal(text[last : cut.end()])
            if s:
                out.append(s)
            last = cut.end()
    return out


def _joined(parts: list[str]) -> list[tuple[int, int, str]]:
    """(first, last, identifier) of known sentences; one may be broken over several lines or marks."""
    out, i = [], 0
    while i < len(parts):
        text, found = "", None
        for j in range(i, len(parts)):
            text = f"{text} {parts[j]}" if text else parts[j]
            if text in KNOWN:
                found = (i, j, KNOWN[text])
            if text not in _HEADS:
                break
        if found:
            out.append(found)
            i = found[1] + 1
        else:
            i += 1
    return out


_HEADS = {" ".join(k.split()[:n]) for k in KNOWN for n in range(1, len(k.split()) + 1)}


def matches(text: str, gap: int = GAP) -> list[tuple[str, int, int]]:
    """(rule, first sentence, last sentence) in the order of the text."""
    hits = _joined(sentences(text))
    at: dict[str, list[int]] = {}
    for i, (_, _, name) in enumerate(hits):
        at.setdefault(name, []).append(i)
    found = []
    for rule, (_, wanted) in RULES.items():
        # From the last sentence back: occurrences from which the rest of the rule is reached, and the next one of each.
        steps: list[dict[int, int]] = []
        later = at.get(wanted[-1], [])
        for name in wanted[-2::-1]:
            nearest = ((i, bisect_right(later, i)) for i in at.get(name, ()))
            steps.append({i: later[k] for i, k in nearest if k < len(later) and hits[later[k]][0] - hits[i][1] <= gap})
            later = list(steps[-1])
        for first in later:
            path = [first]
            for step in reversed(steps):
                path.append(step[path[-1]])
            found.append((path, rule))
    found.sort(key=lambda f: (-len(f[0]), f[0], f[1]))
    used: set[int] = set()
    kept = []
    for path, rule in found:
        if not used.issuperset(path):
            used.update(path)
            kept.append((rule, hits[path[0]][0], hits[path[-1]][1]))
    return sorted(kept, key=lambda k: (k[1], k[2], k[0]))


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per document: its matches, in order, as comma-separated lists."""

    def run(batches):
        for batch in slices(batches):
            texts = column(batch, "text")
            low = pc.ascii_lower(texts)
            near = pc.match_substring(low, ANCHORS[0])
            for anchor in ANCHORS[1:]:
                near = pc.or_(near, pc.match_substring(low, anchor))
            at = np.flatnonzero(near.fill_null(False).to_numpy(zero_copy_only=False))
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for i, text in zip(at.tolist(), texts.take(pa.array(at)).cast(pa.binary()).to_pylist(), strict=True):
                rows[i] = matches(text.decode(errors="replace"), gap)
            names = [list(dict.fromkeys(RULES[r][0] for r, _, _ in m if RULES[r][0])) for m in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").cast(pa.int64()), pa.array([len(m) for m in rows], pa.int32()), pa.array([",".join(n) for n in names], pa.string()),
                    pa.array([",".join(r for r, _, _ in m) for m in rows], pa.string()), pa.array([",".join(f"{a}-{b}" for _, a, b in m) for m in rows], pa.string()),
                ],
                names=["doc_id", "n_matches", "licenses", "rules", "spans"],
            )

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)
