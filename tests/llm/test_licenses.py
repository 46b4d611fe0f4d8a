import itertools
import random
import re

import pyarrow.parquet as pq

from spanlake.llm import licenses as L

HEADER = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def rules(text, **more):
    return [m[0] for m in L.matches(text, **more)]


def text_of(*names):
    return ". ".join(L.SENTENCES[n][0] for n in names) + "."


def test_notices_and_headers():
    assert rules("Some words.\nReleased under the MIT License.\nMore.") == ["mit-reference"]
    assert rules("x. Licensed under CC BY-NC 4.0. y") == ["cc-by-nc-4.0-reference"]
    assert rules(HEADER) == ["apache-2.0-header"]
    assert rules("released UNDER the mit   license!") == ["mit-reference"]
    assert rules("Not released under the MIT License, really.") == []


def test_order_gap_and_longest_rule():
    assert rules(text_of("bsd-intro", "bsd-source", "bsd-binary")) == ["bsd-2-clause-text"]
    assert rules(text_of("bsd-intro", "bsd-source", "bsd-binary", "bsd-names")) == ["bsd-3-clause-text"]
    assert rules(text_of("bsd-source", "bsd-intro", "bsd-binary")) == []
    far = text_of("bsd-intro") + " a. b. c. d. e. " + text_of("bsd-source", "bsd-binary")
    assert rules(far) == [] and rules(far, gap=9) == ["bsd-2-clause-text"]
    assert rules(text_of("mit-name") + " words. " + text_of("gpl3-name") + " " + text_of("mit-name")) == ["mit-reference", "gpl-3.0-reference", "mit-reference"]


def test_every_rule_matches_its_own_text():
    for rule, (_, names) in L.RULES.items():
        assert rules(text_of(*names)) == [rule]
    assert all(any(a in k for a in L.ANCHORS) for k in L.KNOWN)


def test_documents_against_plain_search(spark):
    """In the corpus notices stand on lines of their own; a search for their words must agree."""
    path = "/root/testdata/sf0.01/documents.parquet"
    names = {"MIT": r"released under the mit license", "Apache-2.0": r"licensed under the apache license version 2 0", "GPL-3.0": r"this work is licensed under the gnu general public license version 3", "CC-BY-NC-4.0": r"licensed under cc by nc 4 0"}
    want = {}
    for doc, text in zip(*(pq.read_table(path).column(c).to_pylist() for c in ("doc_id", "text"))):
        found = {n for line in text.split("\n") for n, p in names.items() if re.fullmatch(p, L.normal(line)) or any(re.fullmatch(p, s) for s in L.sentences(line))}
        want[doc] = found
    got = {r.doc_id: set(r.licenses.split(",")) - {""} for r in L.scan(spark.read.parquet(path)).collect()}
    assert got == want and sum(map(bool, want.values())) > 5


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Released under the MIT License.", "x"), (3, "words " * 50_000 + "\nReleased under the MIT License.", "x"), (3, "words", "x"), (3, "words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string")
    got = sorted(((r.doc_id, r.n_matches, r.licenses) for r in L.scan(docs).collect()), key=repr)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (None, 1, "MIT"), (3, 1, "MIT"), (3, 0, ""), (3, 0, "")], key=repr)
    assert L.scan(docs.limit(0)).count() == 0


def test_rights_reserved_is_told_apart(spark):
    rows = [(1, "words.\nAll rights reserved."), (2, "words."), (3, "Copyright 2020 X. ALL RIGHTS\nRESERVED! Released under the MIT License."), (4, "Released into the public domain: CC0 1.0 Universal.")]
    got = {r.doc_id: (r.n_matches, r.licenses, r.rules) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, "", "all-rights-reserved"), 2: (0, "", ""), 3: (2, "MIT", "all-rights-reserved,mit-reference"), 4: (1, "CC0-1.0", "cc0-1.0-reference")}


def test_common_licences_are_known():
    header = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
    assert rules(header) == ["gpl-2.0-header"]
    assert rules("This work is licensed under CC BY-SA 4.0.") == ["cc-by-sa-4.0-reference"]
    licences = {licence for licence, _ in L.RULES.values()}
    assert licences >= {"GPL-2.0", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "ISC", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC0-1.0", "Unlicense"}
    assert all(name in L.SENTENCES for _, names in L.RULES.values() for name in names)


def test_repeated_middle_sentence():
    a, b, c = (L.SENTENCES[n][0] for n in ("bsd-intro", "bsd-source", "bsd-binary"))
    assert L.matches(f"{a}. {b}. x. {b}. y. {c}.") == [("bsd-2-clause-text", 0, 5)]
    assert rules(f"{a}. {b}. x. y. z. {b}. z. {c}.") == []  # the second is too far from the first sentence
    assert L.matches(f"{a}. {b}. {c}. {b}. {c}.") == [("bsd-2-clause-text", 0, 2)]


def test_matches_against_all_paths():
    """A first sentence has a match exactly where some ordered choice of occurrences keeps every gap."""
    names = L.RULES["bsd-3-clause-text"][1]
    rng = random.Random(3)
    for _ in range(300):
        order = [rng.choice([*names, None]) for _ in range(12)]
        place = {n: [i for i, x in enumerate(order) if x == n] for n in names}
        want = {p[0] for p in itertools.product(*place.values()) if all(0 < y - x <= 3 for x, y in itertools.pairwise(p))}
        text = " ".join((L.SENTENCES[n][0] if n else "words") + "." for n in order)
        got = {m[1] for m in L.matches(text) if m[0] == "bsd-3-clause-text"}
        assert got <= want and bool(got) == bool(want)
