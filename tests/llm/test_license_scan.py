import random
import re
import time

import pyarrow as pa

from logwarden.llm import license_scan


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(text, own):
    """Aligned words of two lists, by the plain definition: words that both have once, a
    longest increasing subsequence by quadratic search, the same in its gaps."""
    if not text or not own:
        return 0
    if text[0] == own[0]:
        return 1 + brute(text[1:], own[1:])
    if text[-1] == own[-1]:
        return 1 + brute(text[:-1], own[:-1])
    once = [(k, own.index(w)) for k, w in enumerate(text) if text.count(w) == own.count(w) == 1]
    best = []
    chains = []
    for k, (p, q) in enumerate(once):
        chains.append(max((c for (_, r), c in zip(once[:k], chains) if r < q), key=len, default=[]) + [(p, q)])
        best = max(best, chains[-1], key=len)
    if not best:
        return 0
    marks = [(-1, -1), *best, (len(text), len(own))]
    return len(best) + sum(brute(text[p + 1:r], own[q + 1:s]) for (p, q), (r, s) in zip(marks, marks[1:]))


def noise(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bdfgklmz") for _ in range(7)) for _ in range(n))


TEXTS = {path.stem: path.read_text("utf-8") for path in license_scan.FOLDER.glob("*.txt")}


def scanned(documents, rows, **options):
    return {r.doc_id: r for r in license_scan.license_scan(documents(rows), **options).collect()}


def test_texts_and_notices_are_found_where_they_stand(documents):
    rows = [(k, f"{noise(40, k)}\n{text}\n{noise(70, k + 100)}") for k, (_, text) in enumerate(license_scan.known_licenses())]
    got = scanned(documents, rows)
    for k, (name, text) in enumerate(license_scan.known_licenses()):
        row = got[k]
        assert (row.licenses, row.coverage, row.begins, row.ends) == ([name], [1.0], [40], [40 + len(words(text))]), name
        assert row.n_words == 110 + len(words(text))


def test_edited_texts_against_brute_force(documents):
    rng = random.Random(7)
    rows, expected = [], {}
    for k, name in enumerate([n for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") for _ in range(5)]):
        own, edited = words(TEXTS[name]), []
        for word in own:
            chance = rng.random()
            edited += [] if chance < 0.04 else [word, noise(1, rng.random())] if chance < 0.08 else [noise(1, rng.random())] if chance < 0.1 else [word]
        rows.append((k, " ".join([noise(300, k), *edited, noise(300, -k)])))
        expected[k] = (name, brute(edited, own) / len(own))
    got = scanned(documents, rows, licenses=[(n, TEXTS[n]) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")])
    for k, (name, coverage) in expected.items():
        assert got[k].licenses == [name] and 300 - 3 <= got[k].begins[0] <= 300 + 10
        assert abs(got[k].coverage[0] - coverage) < 0.03, (name, got[k].coverage, coverage)


def test_every_copy_is_found_and_rows_do_not_share(documents):
    notice = "Released under the MIT License."
    many = "\n".join([notice] * 500)
    rows = [(1, many), (2, f"{TEXTS['MIT']} {TEXTS['ISC']} {TEXTS['MIT']}"), (3, "Released under the"), (4, "MIT License."),
            (5, "Released " + noise(30, 1) + " under the " + noise(30, 2) + " MIT License"), (6, "the " * 30_000)]
    got = scanned(documents, rows)
    assert got[1].licenses == ["MIT"] * 500 and got[1].begins == list(range(0, 2500, 5))
    assert got[2].licenses == ["MIT", "ISC", "MIT"]
    assert all(got[k].licenses == [] for k in (3, 4, 5, 6))


def test_odd_rows(documents, odd):
    got = license_scan.license_scan(documents(odd)).collect()
    assert len(got) == len(odd) and not any(r.licenses for r in got)
    assert {r.doc_id: r.n_words for r in got}[6] == 30_000
    assert license_scan.license_scan(documents([])).collect() == []


def test_whole_table_against_the_sentences_in_it(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(table).collect()}
    sentences = [(name, words(text)) for name, text in license_scan.NOTICES]
    for row in table.select("doc_id", "text").collect():
        mine = words(row.text)
        brute = [(k, name) for k in range(len(mine)) for name, own in sentences if mine[k:k + len(own)] == own]
        assert got[row.doc_id] == [name for _, name in brute], row.doc_id
    assert sum(map(len, got.values())) > 0


GNU_NOTICE = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as "
              "published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
NEAR = [
    ("SPDX-License-Identifier: ISC", ["ISC"]), ("SPDX-License-Identifier: Proprietary-Foo", []), ("SPDX-License-Identifier: BSD-2-Clause", ["BSD-2-Clause"]),
    ("SPDX-License-Identifier: LGPL-3.0", ["LGPL-3.0"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
    ("SPDX-License-Identifier: MIT-0", ["MIT-0"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Released under the Apache License", []),
    ("The minister was released under the license agreement", []), ("Licensed under the Apache License, Version 1.0", []),
    (GNU_NOTICE.format("General", 2), ["GPL-2.0"]), (GNU_NOTICE.format("General", 3), ["GPL-3.0"]), (GNU_NOTICE.format("General", 4), []),
    (GNU_NOTICE.format("Lesser General", 2.1), ["LGPL-2.1"]), (GNU_NOTICE.format("Library General", 2), ["LGPL-2.0"]),
    (GNU_NOTICE.format("Affero General", 3), ["AGPL-3.0"]), (GNU_NOTICE.format("Lesser General", 3), ["LGPL-3.0"]),
    ("licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", ["CC-BY-SA-3.0"]),
]


def test_near_misses(documents):
    got = scanned(documents, [(k, f"{noise(30, k)} {text} {noise(30, -k)}") for k, (text, _) in enumerate(NEAR)])
    for k, (text, names) in enumerate(NEAR):
        assert got[k].licenses == names, text


def test_no_template_passes_for_another(documents):
    """Every template alone, with every one of its words replaced in turn: its name or none."""
    rows, names = [], []
    for name, text in license_scan.known_licenses():
        own = words(text)
        for k in range(len(own) if len(own) < license_scan.NOTICE else 0):
            rows.append((len(rows), " ".join([*own[:k], "zzzz", *own[k + 1:]])))
            names.append((name, len(own)))
    got = scanned(documents, rows)
    for k, (name, length) in enumerate(names):
        inner = {n for n, t in license_scan.known_licenses() if words(t) != rows[k][1].split() and f" {' '.join(words(t))} " in f" {rows[k][1]} "}
        assert set(got[k].licenses) <= ({name} if length >= license_scan.SENTENCE else set()) | inner, rows[k]


def test_equals_at_one_place_name_none(documents):
    text = "Use of this thing is granted to whom it may concern"
    got = scanned(documents, [(1, f"x y {text} z")], licenses=[("A", text), ("B", text)])
    assert got[1].licenses == []


def test_time_grows_with_the_notices():
    known = tuple(license_scan.known_licenses())
    license_scan.scan_rows(license_scan.arrow.texts(pa.array(["x"])), known)
    spent = []
    for n in (2_000, 8_000):
        began = time.perf_counter()
        found = license_scan.scan_rows(license_scan.arrow.texts(pa.array(["Released under the MIT License.\n" * n])), known)
        spent.append(time.perf_counter() - began)
        assert len(found[1][0]) == n
    assert spent[1] < 0.5 + 6 * spent[0] and spent[1] < 4, spent
