"""Ops 4, 5 and 8: held-out accuracy on known sources, odd rows."""

import random
from collections import Counter

from quern.llm import langid, licences, quality

WORDS = {"en": "the and of that with from this have thing other".split(), "de": "der die und nicht schön über einen auch für zwischen".split(), "fr": "le la être où déjà élève près français une chaque".split()}


def texts(seed, n):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(5, 60))), lang) for k in range(n) for lang in [rnd.choice(list(WORDS))]]


def test_language_held_out_accuracy(spark):
    docs = spark.createDataFrame(texts(1, 300), "doc_id long, text string, lang string")
    got = langid.identify(docs).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    """1- to 3-grams of the words, padded with one blank on each side, and their counts."""
    out = Counter()
    for word in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split():
        out.update(word)
        for n in (2, 3):
            padded = f" {word} "
            out.update(padded[k : k + n] for k in range(len(padded) - n + 1) if n == 2 or padded[k + 1] != " ")
    return out


def plain_rank(counts, top):
    """Most frequent first; ties by code: shorter grams first, then letter by letter, a blank before all."""
    key = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    return sorted(counts, key=lambda g: (-counts[g], key(g)))[:top]


def test_language_against_plain_profiles(spark):
    import zlib

    rows = [*texts(11, 120), (500, "Ein Wörtchen, the end.", None), (501, "1 2 3", "en"), (502, None, "fr"), (503, "x", None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    sums = {}
    for i, t, lang in rows:
        if lang and t and not held(i):
            sums.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {lang: {g: k for k, g in enumerate(plain_rank(c, langid.PROFILE))} for lang, c in sums.items() if c}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        own = plain_rank(plain_grams(t or ""), langid.OWN)
        away = sorted((sum(min(abs(p.get(g, 10**9) - k), langid.PROFILE) for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        assert got[i].held_out == held(i)
        assert got[i].lang_pred == (away[0][1] if own else "und"), (i, t)


def test_language_prediction_sees_only_the_text(spark):
    rows = texts(2, 100)
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    a = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    b = spark.createDataFrame([(k + 1000, t, "xx") for k, t, _ in rows], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predict(a, model).orderBy("doc_id").collect()] == [(r.lang_pred, r.score) for r in langid.predict(b, model).orderBy("doc_id").collect()]


def test_language_that_no_profile_knows_goes(spark):
    rnd = random.Random(5)
    clean = [(k, t, lang) for k, t, lang in texts(6, 400)]
    chinese = [(k, "".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(60)), None) for k in range(1000, 1010)]
    noise = [(k, "".join(rnd.choice("bcfgjkmpqvwxyz ") for _ in range(300)), None) for k in range(2000, 2010)]
    # one foreign row with a language among the training rows does not move the bound
    rows = [*clean, *chinese, *noise, (3000, chinese[0][1], "en"), (3001, None, "en"), (3002, "12 34", "en")]
    kept = {r.doc_id for r in langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept & {r[0] for r in [*chinese, *noise]} == set() and not kept & {3000, 3001, 3002}
    assert len(kept) >= 0.99 * len(clean)


def test_language_odd_rows(odd, none):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).collect()]
    assert len(got) == odd.count()
    by = {i: (p, s) for i, p, s in got}
    assert by[0] == by[1] == by[2] == ("und", 0.0) and by[13][0] != "und"  # 13 has letters
    assert all(r.held_out in (True, False) for r in langid.identify(odd).collect())
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and 6 in {r.doc_id for r in kept.select("doc_id").collect()}
    assert langid.identify(none).count() == 0 and langid.keep_known(none).count() == 0


def test_rank_order_distance_by_hand():
    codes, counts = langid.np.unique(langid.grams("ab ab"), return_counts=True)
    assert counts.sum() == len(langid.grams("ab ab"))
    assert len(langid.grams("123")) == 0
    p = langid.Profiles(["x", "y"], codes, langid.np.stack([langid.np.arange(len(codes)), langid.np.full(len(codes), 9999)], 1))
    assert p.nearest("ab ab")[0] == "x"
    assert p.nearest(None) == p.nearest("1 2") == ("und", 0.0)


def junk(rnd):
    return " ".join(rnd.choice(["***", "$$$", "###"]) + rnd.choice("abcdef") * 3 for _ in range(rnd.randint(20, 80)))


def test_quality_held_out_accuracy(spark):
    rnd = random.Random(3)
    rows = [(k, junk(rnd) if k % 4 == 0 else " ".join(rnd.choice(WORDS["en"]) for _ in range(rnd.randint(20, 80))), int(k % 4 != 0)) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = quality.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_quality_against_plain_sizes(spark):
    import math

    import zstandard as zstd

    rnd = random.Random(4)
    rows = [(k, junk(rnd) if k % 3 == 0 else " ".join(rnd.choice(WORDS["en"]) for _ in range(rnd.randint(1, 200))), int(k % 3 != 0)) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert len(model.weights) == 5
    packers = [zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_FULLDICT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    for i, t, _ in rows:
        raw, pieces = t.encode(), []
        while raw:
            n = len(raw) if len(raw) < 128 + 64 + (len(raw) == 192) else 128
            pieces.append(raw[:n])
            raw = raw[n:]
        a, b = ([len(p.compress(x)) for x in pieces] for p in packers)
        each = sorted((y - x) / (x + y) for x, y in zip(a, b, strict=True))
        facts = [(sum(b) - sum(a)) / (sum(a) + sum(b)), sum(each) / len(each), each[len(each) // 10], each[0]]
        z = model.weights[0] + sum(w * (f - m) / d for w, f, m, d in zip(model.weights[1:], facts, model.means, model.deviations, strict=True))
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(14)] + [(3, 0, 0), (3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    empty = labels.limit(0)
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0


def test_licence_rules_in_order():
    m = licences.Matcher()
    s = licences.SENTENCES
    mit = ". ".join(s[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")).upper() + "."
    assert [(f[0], f[3]) for f in m.find("Intro.\n" + mit)] == [("MIT", 4)]
    bsd = [s[k][0] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    assert [f[0] for f in m.find(".\n".join(bsd))] == ["BSD-3-Clause"]
    assert [f[0] for f in m.find(".\n".join(bsd[:3]))] == ["BSD-2-Clause"]
    assert m.find(".\n".join(reversed(bsd))) == []
    gap = "\nunknown sentence of software"
    assert [f[0] for f in m.find(bsd[0] + gap * 2 + "\n" + bsd[1] + "\n" + bsd[2])] == ["BSD-2-Clause"]
    assert m.find(bsd[0] + gap * 3 + "\n" + bsd[1] + "\n" + bsd[2]) == []
    found = m.find("Text.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License.")
    assert [f[0] for f in found] == ["Apache-2.0", "MIT", "MIT"]
    assert m.find(None) == m.find("") == m.find("no such thing") == []


MIT = """MIT License

Copyright (c) 2024 A. Person

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
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_licence_texts_as_they_are_printed():
    m = licences.Matcher()
    gpl2 = GPL.replace("software: you", "software; you").replace("version 3", "version 2")
    for text, name, n in [(MIT, "MIT", 4), (BSD, "BSD-3-Clause", 4), (BSD[: BSD.index("3. ")], "BSD-2-Clause", 3), (GPL, "GPL-3.0-or-later", 3), (gpl2, "GPL-2.0-or-later", 3), (APACHE, "Apache-2.0", 4), (ISC, "ISC", 1), (MPL, "MPL-2.0", 1)]:
        for t in (text, text.replace("\n", "\r\n"), "Some words before.\n\n" + text):
            assert [(f[0], f[3]) for f in m.find(t)] == [(name, n)], name
    for line, name in [("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("License: MIT", "MIT")]:
        assert [f[0] for f in m.find(line)] == [name], line
    # neither over a blank line nor over the end of a sentence, and no piece is cut
    assert m.find("License:\n\nMIT") == m.find("See the\nlicense. MIT") == m.find("SPDX-License-Identifier: MIT-0") == []


def test_licence_wrapped_unknown_sentence_is_one():
    one = "\nThe copyright holder asks that this unknown sentence be read by all who\nuse the software, on whatever machine they may come to use it, and by all\nwho hand it on to others in whatever form they like to do that."
    t = BSD.replace("are met:\n", "are met:\n" + one + "\n")
    assert [f[0] for f in licences.Matcher().find(t)] == ["BSD-3-Clause"]


def test_licence_hint_covers_every_known_sentence():
    m = licences.Matcher()
    assert not m.full and all(m.hint.search(s) for s in m.ident)


def test_licence_odd_rows(spark, odd, none):
    assert {tuple(r.licences) for r in licences.scan_licences(odd).collect()} == {()}
    assert licences.scan_licences(none).count() == 0
    two = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.\nall rights reserved")], "doc_id long, text string")
    r = licences.scan_licences(two).first()
    assert r.licences == ["CC-BY-NC-4.0", "Proprietary"] and r.n_matches == 2 and r.spans[0].first == 0
