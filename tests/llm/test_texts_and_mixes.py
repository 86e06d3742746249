"""Quality rules, mixing, packing, chat examples and licences, held to brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import adaptive_quality, chat_prefix, kk_packing, licence_rules, water_filling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, size string, _text int, u int"


def docs_of(spark, rows):
    """Rows of (id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, 1, "s", 2, 3) for r in rows], DOCS)


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def text_rows(rng):
    plain = ["river", "stone", "walks", "slow", "été", "bright", "under", "q"]
    rows = []
    for i in range(700):
        words = [rng.choice(plain) + str(rng.randrange(400)) for _ in range(rng.randrange(12, 60))]
        if i % 15 == 0:  # fewer than lie above the upper quantile
            words = [w + "###" for w in words]
        text = " ".join(words)
        if i % 11 == 0:
            text = "\n".join([text[:40]] * 3 + [text])
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])))
    rows += [(800, None, "en", "a"), (801, "", None, None), (802, "\n\n \t\x0b", "en", "a"), (803, "a b c d e " * 4000, "en", "z"),
             (804, "w" * 200_000, "fr", "b"), (805, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10\nsame\nsame", "en", "a"), (805, rows[0][1], "en", "a"),
             (None, rows[1][1], "de", "only")]
    return rows


def test_measures_and_verdicts(spark):
    rows = text_rows(random.Random(3))
    got = adaptive_quality.quality(docs_of(spark, rows)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = sorted((r["id"] if r["id"] is not None else -1, *(r[c] for c in columns)) for r in got)
    assert found == sorted((i if i is not None else -1, *measures(t)) for i, t, _, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["id"] for r in got if r["kept"]}
    assert not kept & {i for i in range(700) if i % 15 == 0} and 804 not in kept
    assert len(kept & {i for i in range(700) if i % 15 and i % 11}) == len([i for i in range(700) if i % 15 and i % 11])
    good = adaptive_quality.keep_good(docs_of(spark, rows))
    assert good.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(r["id"] for r in got if r["kept"])
    assert adaptive_quality.quality(docs_of(spark, [])).count() == 0


def test_sketches_merge_and_bound_their_error(spark):
    rng = random.Random(1)
    values = [int(rng.lognormvariate(5, 3)) for _ in range(4000)]
    frame = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v long")
    parts = adaptive_quality.sketch(frame, ["g"], "v")
    whole = adaptive_quality.sketch(frame, [], "v")
    joined = adaptive_quality.merged(parts, [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, joined.collect()))
    ranked = sorted(values)
    bins = sorted((r["bin"], r["n"]) for r in whole.collect())
    for share in (0.1, 0.5, 0.9, 0.99):
        true, upto = ranked[int(np.ceil(share * len(ranked))) - 1], 0
        for low, n in bins:
            upto += n
            if upto >= share * len(ranked):
                break
        assert low <= true <= low * (1 + 1 / 64) + 1


def test_quantiles_of_mixed_sketches(spark):
    rng = random.Random(6)
    sizes = {("en", "a"): 900, ("en", "b"): 40, ("en", None): 3, (None, "a"): 120, ("xx", "lone"): 1}
    rows = [("r", lang, source, int(rng.lognormvariate(3 + k / 2, 1))) for k, ((lang, source), n) in enumerate(sizes.items()) for _ in range(n)]
    frame = spark.createDataFrame(rows, "rule string, lang string, source string, v long")
    fine = adaptive_quality.sketch(frame, ["rule", "lang", "source"], "v")
    counts = Counter()
    for r in fine.collect():
        counts[r["lang"], r["source"], r["bin"]] += r["n"]
    prior, bins = adaptive_quality.PRIOR, sorted({b for _, _, b in counts})
    got = {(r["lang"], r["source"]): [r[f"p{p}"] for p in (10, 50, 85, 99)] for r in adaptive_quality.mixed_quantiles(fine).collect()}
    assert set(got) == set(sizes)
    for lang, source in sizes:
        def share(test, top):
            chosen = {k: n for k, n in counts.items() if test(k)}
            return sum(n for k, n in chosen.items() if k[2] <= top), sum(chosen.values())

        for p, found in zip((10, 50, 85, 99), got[lang, source]):
            for top in bins:
                (w, r), (v, t), (u, own) = (share(f, top) for f in (lambda k: True, lambda k: k[0] == lang, lambda k: k[:2] == (lang, source)))
                middle = Fraction(v * r + prior * w, r * (t + prior))
                if (u + prior * middle) / (own + prior) >= Fraction(p, 100):
                    break
            assert found == top


def test_fences_follow_their_group(spark):
    rng = random.Random(12)

    def rows(long_words):
        """Word lengths by source; in each, a few documents have words twice as long as is usual there."""
        out = []
        for k, (source, usual) in enumerate((("short", 4), ("long", long_words), ("other", 6))):
            for i in range(600):
                size = (2 if i % 40 == 0 else 1) * usual
                text = " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, size + rng.choice((-1, 0, 0, 1))))) for _ in range(60))
                out.append((1000 * k + i, text, "en", source))
        return out

    def verdicts(table):
        return {r["id"]: r["kept"] for r in adaptive_quality.quality(docs_of(spark, table)).collect()}

    before = verdicts(rows(8))
    # What is usual in one source is rejected in another: the fences differ.
    assert all(kept == (i % 1000 % 40 != 0) for i, kept in before.items())
    # One source's distribution moves: its verdicts are judged anew by its own fences, the others' stay.
    table = rows(8)
    moved = [(i, " ".join(w * 2 for w in t.split()), lang, s) if s == "long" and i % 1000 % 40 else (i, t, lang, s) for i, t, lang, s in table]
    after = verdicts(moved)
    assert {i: k for i, k in after.items() if i // 1000 != 1} == {i: k for i, k in before.items() if i // 1000 != 1}
    assert all(after[1000 + i] for i in range(600) if i % 40) and any(after[1000 + i] != before[1000 + i] for i in range(0, 600, 40))


def fill_level(sizes, weights, epochs):
    """Targets by resharing, one clamped source at a time."""
    open_, targets, rest = set(sizes), {}, sum(sizes.values())
    while True:
        level = rest / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > epochs * sizes[s]]
        if not over:
            return targets | {s: weights[s] * level for s in open_}
        for s in over:
            targets[s] = epochs * sizes[s]
            rest -= targets[s]
            open_.remove(s)


def test_mix_follows_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 50)), "en", rng.choice(["a", "b", "c", "c", "c", "c", "é", None])) for i in range(600)]
    rows += [(600, "w " * 30_000, "en", "c"), (601, None, "en", "empty"), (602, "", "en", "b"), (5, "w w w", "en", "a"), (5, "w w w", "en", "a"), (None, "w w", "en", None)]
    got = water_filling.mix(docs_of(spark, rows)).collect()
    again = water_filling.mix(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fill_level(sizes, weights, 3)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["whole"] + r["extra"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-9 for s in sizes)  # some source is clamped


def test_mix_of_equal_sources_empty_tables_and_given_weights(spark):
    assert water_filling.mix(docs_of(spark, [])).count() == 0
    assert water_filling.mix(docs_of(spark, [(1, None, "en", "a")])).first()["taken"] == 0
    rows = [(i, "w w w w", "en", "ab"[i % 2]) for i in range(40)]
    weights = spark.createDataFrame([("a", 3)], "source string, weight long")
    got = water_filling.mix(docs_of(spark, rows), weights=weights).collect()
    assert {r["source"]: r["target"] for r in got} == {"a": 160.0, "b": 0.0}
    mixed = water_filling.expand(docs_of(spark, rows), weights=weights)
    assert mixed.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: 2 for i in range(0, 40, 2)})


def test_expanded_rows_come_near_the_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "en", rng.choice("abcdd")) for i in range(300)]
    mixed = water_filling.mix(docs_of(spark, rows)).collect()
    copies = Counter(r["doc_id"] for r in water_filling.expand(docs_of(spark, rows)).collect())
    for r in mixed:
        if r["extra"] in (0, r["size"]) and r["size"]:
            assert copies[r["id"]] == r["whole"] + (r["extra"] > 0)
        elif r["size"] == 0:
            assert copies[r["id"]] == 0


def test_differencing_balances_and_keeps_all_pieces():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(1, 513) for _ in range(rng.randrange(1, 200))]
        k = rng.randrange(1, 20)
        window = kk_packing.differencing(sizes, k)
        assert len(window) == len(sizes) and max(window) < k
        loads = np.bincount(window, sizes, minlength=k)
        if len(sizes) >= 12 * k:
            assert loads.max() - loads.min() <= 64
        filled = kk_packing.fill_windows(sizes, 2048)
        assert np.bincount(filled, sizes).max() <= 2048
    assert kk_packing.differencing([5, 5, 4, 4, 3, 3], 2).count(0) == 3  # sums of 12 each
    assert len(set(kk_packing.fill_windows([1500, 1500, 1000], 2048))) == 3  # two cannot hold them


def test_pieces_cover_documents_and_sequences(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["tokens", "and", "été", "x9", "\n\n", "don't"]) for _ in range(rng.randrange(0, 900))), "en", "s") for i in range(120)]
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (202, "a b " * 20_000, "en", "s"), (203, "<|endoftext|> end", "en", "s"),
             (204, " " * 5_000 + "end", "en", "s"), (300, "again", "en", "s"), (300, "again", "en", "s"), (None, "no id", "en", "s")]
    got = kk_packing.pack(docs_of(spark, rows).repartition(3), with_ids=True).collect()
    full = Tokenizer.from_file(f"{kk_packing.tokenizer_folder()}/byte_bpe_50k.json")
    want = Counter((i, tuple([*full.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _, _ in rows if i != 300)
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["id"] != 300:
            pieces[r["id"]][r["start"]] = (r["ids"], r["doc_tokens"])
    found = Counter()
    for i, parts in pieces.items():
        ids = [x for _, (part, _) in sorted(parts.items()) for x in part]
        assert all(tokens == len(ids) for _, tokens in parts.values())
        found[i, tuple(ids)] += 1
    assert found == want and sum(r["id"] == 300 for r in got) == 2
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= total // 2048 + 6  # at most about one window more per task
    assert kk_packing.pack(docs_of(spark, [])).count() == 0


TURNS = "conv_id long, turn long, role string, text string, forms string, last int, t int"


def test_examples_hold_turns_and_train_replies_once(spark):
    odd = ["</s>[INST] ok [/INST]", "&lt; &amp; &#91;", " <a> x </s> ", "<</>>", "", None, "é\n\n", "[[", "x" * 300_000, "<<b>> y <</>>"]
    rng = random.Random(1)
    rows = []
    for c in range(30):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "to<ol>", None]), rng.choice(odd)))
    rows += [(40, 0, "assistant", "a"), (40, 0, "assistant", "a"), (40, None, "user", "u"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    frame = spark.createDataFrame([(*r, "f", 0, 0) for r in rows], TURNS).repartition(4)
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((-1 if turn is None else turn, role or "", text or ""))
    made = chat_prefix.examples(frame)
    for r in made.collect():
        assert r["n_turns"] == r["example"] + 1
        assert r["loss_end"] <= len(r["formatted"])
    got = {r["conv_id"]: r for r in chat_prefix.digests(made).collect()}
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        if c is not None and c < 30:
            turns.sort(key=lambda t: t[0])
        else:
            turns.sort()
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        replies = "".join(text for _, role, text in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(replies)
        assert got[c]["loss_sha256"] == hashlib.sha256(replies.encode()).hexdigest()
    counts = Counter(r["conv_id"] for r in made.collect())
    for c, turns in groups.items():
        replies = sum(role == "assistant" for _, role, _ in turns)
        assert counts[c] == replies + (turns[-1][1] != "assistant")
    assert chat_prefix.digests(chat_prefix.examples(frame.limit(0))).count() == 0


MIT = """/* Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
 Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
 disclaimer in the documentation and/or other materials provided with the distribution."""
CLAUSE3 = """
 Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
 products derived from this software without specific prior written permission."""


@pytest.mark.parametrize("text, want, unmatched", [
    ("Prose here.\nReleased under the MIT License.\nMore prose without end", ["MIT"], 0),
    ("no stop before\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"], 0),
    ("LICENCED UNDER CC BY-NC 4.0", ["CC-BY-NC-4.0"], 0),
    ("Licensed under CC BY-NC 4.0.  This work is licensed under the GNU General Public Licence, version 3.", ["CC-BY-NC-4.0", "GPL-3.0-only"], 0),
    (MIT, ["MIT"], 0),
    (BSD, ["BSD-2-Clause"], 0),
    (BSD + CLAUSE3, ["BSD-3-Clause"], 0),
    (CLAUSE3, [], 1),
    ("All rights reserved.", [], 1),
    ("", [], 0), (None, [], 0), ("license " * 50_000, [], 0),
])
def test_licences(spark, text, want, unmatched):
    got = licence_rules.licences(docs_of(spark, [(1, text, "en", "s"), (1, text, "en", "s"), (None, text, "en", "s")])).collect()
    assert [(r["licences"], r["unmatched"]) for r in got] == [(want, unmatched)] * 3


APACHE_HEADER = """Copyright 2020 A. Writer

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3_HEADER = """Copyright (C) 2020  A. Writer

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2_HEADER = """Copyright (C) 2020  A. Writer

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
ISC_HEADER = """Copyright (c) 2020, A. Writer

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""
MIT_HEADER = """Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2_HEADER = """Copyright (c) 2020, A. Writer

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3_HEADER = BSD2_HEADER + """

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
HEADERS = [
    (APACHE_HEADER, "Apache-2.0"), (GPL3_HEADER, "GPL-3.0-or-later"), (GPL2_HEADER, "GPL-2.0-or-later"),
    (GPL2_HEADER.replace("version 2", "version 3"), "GPL-3.0-or-later"),
    (GPL3_HEADER.replace("version 3", "version 2"), "GPL-2.0-or-later"),
    (ISC_HEADER, "ISC"), (ISC_HEADER.replace("and/or", "and"), "ISC"), (MIT_HEADER, "MIT"),
    (BSD2_HEADER, "BSD-2-Clause"), (BSD3_HEADER, "BSD-3-Clause"),
]


def commented(header: str, start: str, mark: str, end: str) -> str:
    return start + "\n".join(f"{mark} {line}".rstrip() for line in header.split("\n")) + end


def test_unaltered_headers_plain_and_commented(spark):
    marks = [("/*\n", " *", "\n */\nint x;"), ("", "#", "\nimport os"), ("", "//", "\n"), ("", "--", ""), ("", ";;", "")]
    texts = [
        (text, name) for header, name in HEADERS
        for text in (header, header.replace("\n", "\r\n"), *(commented(header, *m) for m in marks))
    ]
    rows = [(i, text, "en", "s") for i, (text, _) in enumerate(texts)]
    got = {r["id"]: (r["licences"], r["unmatched"]) for r in licence_rules.licences(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == [([name], 0) for _, name in texts]


def test_parts_of_headers_of_other_licences(spark):
    lesser = GPL3_HEADER.replace("GNU General", "GNU Affero General")
    got = licence_rules.licences(docs_of(spark, [(1, lesser, "en", "s"), (2, "This program is free software.", "en", "s")]))
    assert [r["licences"] for r in got.collect()] == [[], []]


def test_licences_of_no_rows(spark):
    assert licence_rules.licences(docs_of(spark, [])).count() == 0
