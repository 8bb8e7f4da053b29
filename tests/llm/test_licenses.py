"""Licence scan against brute force over all windows and templates, and on planted notices."""

import random
import re

from plumbline.llm.licenses import TEMPLATES, license_scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, percent=80, shingle=5):
    w = words_of(text)
    g = [tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
    passages = []
    for name, template in TEMPLATES.items():
        t = words_of(template)
        own = {tuple(t[i : i + shingle]) for i in range(len(t) - shingle + 1)}
        spans = []
        if len(own) <= 4:
            spans = [(i, i + len(t), 1.0) for i in range(len(w) - len(t) + 1) if w[i : i + len(t)] == t]
        else:
            size = 1 << ((len(own) - 1).bit_length() - 1)
            for a in range(0, len(g), size):
                window = g[a : a + 3 * size]
                at = [a + i for i, x in enumerate(window) if x in own]
                if 100 * len(set(window) & own) >= percent * len(own):
                    spans.append((at[0], at[-1] + shingle, len(set(window) & own) / len(own)))
        merged = []
        for a, b, s in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), max(merged[-1][2], s))
            else:
                merged.append((a, b, s))
        passages += [(-s, -len(t), name, a, b) for a, b, s in merged]
    kept = []
    for s, _, name, a, b in sorted(passages):
        if all(b <= x or y <= a for _, x, y, _ in kept):
            kept.append((name, a, b, -s))
    return sorted(kept)


def test_scan_by_brute_force(spark):
    r = random.Random(3)
    filler = lambda n: " ".join(r.choice(["the", "software", "license", "under", "alpha", "beta", "version", "any"]) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "MIT License")]
    for i, (_, text) in enumerate(sorted(TEMPLATES.items()) * 2):
        parts = text.split()
        for _ in range(r.choice([0, 0, 1, 2])):
            parts[r.randrange(len(parts))] = "changed"
        rows.append((10 + i, f"{filler(r.randint(0, 60))} {' '.join(parts)} {filler(r.randint(0, 40))} {r.choice(list(TEMPLATES.values()))}"))
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, license string, start_word int")
    got = {}
    for x in license_scan(docs).collect():
        got.setdefault(x["doc_id"], []).append((x["license"], x["start_word"], x["end_word"], x["containment"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(t) for k, t in rows if brute(t)}


def test_notices_are_told_apart(spark):
    found = lambda text: [x["license"] for x in license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert found("x " + TEMPLATES["lgpl-3.0"]) == ["lgpl-3.0"] and found(TEMPLATES["agpl-3.0"] + " y") == ["agpl-3.0"]
    assert found("// SPDX-License-Identifier: MIT\nint x;") == ["spdx:MIT"] and found("SPDX-License-Identifier: GPL-3.0-or-later") == ["spdx:GPL-3.0-or-later"]
    assert found("This project is licensed under the MIT License - see the LICENSE file for details") == ["mit-line"]
    assert found(TEMPLATES["mpl-2.0"]) == ["mpl-2.0"] and found(TEMPLATES["isc"]) == ["isc"] and found("nothing of the kind is said here at all") == []
