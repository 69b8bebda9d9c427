"""Licence scans by sentence rules.

A text is cut into pieces at end signs and line ends, pieces are normalised
(lower case, runs of anything but letters and digits become one space), and the
longest run of pieces that makes a known sentence becomes its identifier, so
wrapped lines and signs inside a sentence do no harm.  The sequence of identifiers is matched against ordered rules:
earlier rules take their sentences first; a rule's identifiers must follow one
another in order, with at most ``GAP`` unknown sentences in between.

Defined cases: null and empty texts have no licence; a sentence counts for one
rule only; repeated rows each give a row; a licence found twice is listed once,
both spans are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_text

#: Unknown sentences that may stand between two sentences of a rule.
GAP = 2

# Sentences of public licences, normalised, by identifier.
SENTENCES: dict[str, list[str]] = {
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "mit-short": ["released under the mit license", "licensed under the mit license", "distributed under the mit license", "this project is licensed under the mit license", "license mit", "spdx license identifier mit"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-short": ["released under the isc license", "licensed under the isc license", "spdx license identifier isc"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-2-short": ["licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd-3-short": ["licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "apache-short": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "spdx license identifier apache 2 0"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "gpl-3-short": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gpl version 3", "spdx license identifier gpl 3 0 only"],
    "gpl-2-short": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only"],
    "lgpl-short": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only"],
    "agpl-short": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"],
    "mpl-short": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "cc0-short": ["licensed under cc0 1 0", "released under cc0 1 0", "spdx license identifier cc0 1 0"],
    "cc-by-short": ["licensed under cc by 4 0", "released under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-short": ["licensed under cc by sa 4 0", "released under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-short": ["licensed under cc by nc 4 0", "released under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}

# Ordered rules, whole texts before short forms.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-short", "apache-use", "apache-copy", "apache-as-is"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl-2-free", "gpl-hope", "gpl-received"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("ISC", ["isc-short"]),
    ("BSD-2-Clause", ["bsd-2-short"]),
    ("BSD-3-Clause", ["bsd-3-short"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-2-free"]),
    ("GPL-3.0-only", ["gpl-3-short"]),
    ("GPL-2.0-only", ["gpl-2-short"]),
    ("LGPL-3.0-only", ["lgpl-short"]),
    ("AGPL-3.0-only", ["agpl-short"]),
    ("MPL-2.0", ["mpl-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["reserved"]),
]

#: A piece ends at such a sign before white space or the end, or at a line's end.
_END = re.compile(r"[.!?;:]+(?=\s|$)|[\n\r]+")
_OTHER = re.compile(r"[\W_]+")
_BREAK = re.compile(r"\r\n|\n|\r")
#: Characters of a line that count as wrapped when it ends without a sign.
WRAPPED = 45


def normal(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def pieces(text: str) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(first character, end, normalised, joins, wrapped) of each piece that holds a letter or digit.

    ``joins``: a sentence may go on from the piece before: over a line's end, a colon, a
    semicolon, or the full stop of a list mark or short form, never over a blank line.
    ``wrapped``: the line before was full, so unknown text goes on in the same sentence.
    """
    at, before, sign, breaks, long = 0, "", "", 0, False
    for m in [*_END.finditer(text), None]:
        end, raw = (m.end(), text[at : m.start()]) if m else (len(text), text[at:])
        n = normal(raw)
        if n:
            stopped = "!" in sign or "?" in sign or ("." in sign and len(before.rsplit(" ", 1)[-1]) > 2)
            yield at, end, n, bool(before) and breaks < 2 and not stopped, bool(before) and breaks == 1 and not sign and long
            before, sign, breaks, long = n, "", 0, len(raw) >= WRAPPED
        if m:
            new = len(_BREAK.findall(m.group()))
            breaks, sign = breaks + new, sign if new else sign + m.group()
        at = end


class Matcher:
    """Compiled sentences and rules; both may be replaced by the caller's own."""

    def __init__(self, known: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None):
        known, self.rules = known or SENTENCES, rules or RULES
        self.ident = {normal(s): k for k, texts in known.items() for s in texts}
        self.by_word: dict[str, list[str]] = {}
        for n in sorted(self.ident, key=len, reverse=True):
            self.by_word.setdefault(n.split(" ", 1)[0], []).append(n)
        # a known sentence holds one of these words; the rest of a text need not be cut up
        words = [set(s.split()) for s in self.ident]
        rare = ["license", "licensed", "copyright", "permission", "redistribution", "redistributions", "warranty", "warranties", "liable", "software", "unencumbered", "rights", "cc", "cc0", "compliance", "endorse"]
        self.full = any(not w & set(rare) for w in words)
        self.hint = re.compile("|".join(rare), re.IGNORECASE)

    def _known(self, cut: list[tuple[int, int, str, bool, bool]], k: int) -> tuple[int, str] | None:
        """(piece after it, identifier) of the longest known sentence that starts with piece ``k`` and ends with a piece."""
        for n in self.by_word.get(cut[k][2].split(" ", 1)[0], ()):
            at, j = 0, k
            while n.startswith(cut[j][2], at):
                at, j = at + len(cut[j][2]), j + 1
                if at == len(n):
                    return j, self.ident[n]
                if n[at] != " " or j == len(cut) or not cut[j][3]:
                    break
                at += 1
        return None

    def seen(self, text: str) -> list[tuple[int, int, int, str]]:
        """(number among all sentences, first character, end, identifier) of the known sentences."""
        cut, out = list(pieces(text)), []
        k, number, unknown = 0, 0, False
        while k < len(cut):
            hit = self._known(cut, k)
            if hit:
                number += 1
                out.append((number, cut[k][0], cut[hit[0] - 1][1], hit[1]))
            elif not (unknown and cut[k][4]):
                number += 1
            unknown, k = not hit, hit[0] if hit else k + 1
        return out

    def find(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(licence, first character, end, sentences) of every rule match, by place."""
        if not text or not (self.full or self.hint.search(text)):
            return []
        seen = self.seen(text)
        free, out = [True] * len(seen), []
        for name, wanted in self.rules:
            for start in range(len(seen)):
                if not free[start] or seen[start][3] != wanted[0]:
                    continue
                taken, last = [start], seen[start][0]
                for w in wanted[1:]:
                    nxt = next((j for j in range(taken[-1] + 1, len(seen)) if seen[j][0] - last > GAP + 1 or (free[j] and seen[j][3] == w)), None)
                    if nxt is None or seen[nxt][3] != w or seen[nxt][0] - last > GAP + 1 or not free[nxt]:
                        break
                    taken.append(nxt)
                    last = seen[nxt][0]
                if len(taken) == len(wanted):
                    for j in taken:
                        free[j] = False
                    out.append((name, seen[taken[0]][1], seen[taken[-1]][2], len(taken)))
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def scan_licences(docs: DataFrame, known: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, licences (distinct names, sorted), n_matches, spans of every row; a map, no shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(known, rules)
        span = pa.struct([("licence", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("sentences", pa.int64())])
        for batch in rows:
            found = [matcher.find(t) for t in batch.column("text").to_pylist()]
            names = pa.array([sorted({f[0] for f in fs}) for fs in found], pa.list_(pa.string()))
            spans = pa.array([[dict(zip(("licence", "first", "stop", "sentences"), f, strict=True)) for f in fs] for fs in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array([len(f) for f in found], pa.int64()), spans], ["doc_id", "licences", "n_matches", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return id_text(docs).mapInArrow(run, f"doc_id {kind}, licences array<string>, n_matches long, spans array<struct<licence:string,first:long,stop:long,sentences:long>>")
