"""License scans: token automata compiled from template markup.

A template is license wording with two kinds of markup:

* ``[[ ... ]]``      optional words, present as a whole or not at all;
* ``{{a-b}}``        a replaceable region of a to b arbitrary words.

It is compiled into a nondeterministic automaton over words; the set of active
states is one integer, a word moves it with two bit operations. A text is
accepted where every mandatory word stands exactly as in the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_BSD_CLAUSES = (
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met [[1]] redistributions of source code must retain "
    "the above copyright notice this list of conditions and the following disclaimer [[2]] "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the "
    "distribution")
_BSD_DISCLAIMER = (
    "this software is provided by {{1-6}} as is and any express or implied warranties including but "
    "not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed in no event shall {{1-6}} be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods "
    "or services loss of use data or profits or business interruption however caused and on any theory "
    "of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such "
    "damage")

# Public license notices, openings and, under labels with "-full" or a clause count,
# whole wordings in template markup. Each begins with mandatory words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[version]] 2 0 "
                  "[[the license you may not use this file except in compliance with the license]]",
    "mit-notice": "released under the [[terms of the]] mit license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this "
           "{{1-8}} the software to deal in the software without restriction including without "
           "limitation the rights to use copy modify merge publish distribute sublicense and or "
           "sell copies of the software and to permit persons to whom the software is furnished "
           "to do so subject to the following conditions",
    "gpl-notice": "licensed under the gnu general public license [[as published by the free "
                  "software foundation]] version {{1-2}}",
    "gpl": "this program is free software you can redistribute it and or modify it under the "
           "terms of the gnu general public license as published by the free software foundation "
           "either version {{1-2}} of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with "
           "or without fee is hereby granted",
    "cc-by-nc": "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[4 0]]",
    "cc-by-sa": "licensed under [[a]] [[the]] [[creative commons]] cc by sa [[4 0]]",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this "
                "{{1-8}} the software to deal in the software without restriction including without "
                "limitation the rights to use copy modify merge publish distribute sublicense and or "
                "sell copies of the software and to permit persons to whom the software is furnished "
                "to do so subject to the following conditions the above copyright notice and this "
                "permission notice [[including the next paragraph]] shall be included in all copies "
                "or substantial portions of the software the software is provided as is without "
                "warranty of any kind express or implied including but not limited to the warranties "
                "of merchantability fitness for a particular purpose and noninfringement in no event "
                "shall the authors or copyright holders be liable for any claim damages or other "
                "liability whether in an action of contract tort or otherwise arising from out of or "
                "in connection with the software or the use or other dealings in the software",
    "bsd-2-clause": f"{_BSD_CLAUSES} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_CLAUSES} [[3]] neither the name of {{{{1-12}}}} may be used to endorse or "
                    f"promote products derived from this software without specific prior written "
                    f"permission {_BSD_DISCLAIMER}",
    "isc-full": "permission to use copy modify and or distribute this software for any purpose with "
                "or without fee is hereby granted provided that the above copyright notice and this "
                "permission notice appear in all copies the software is provided as is and the author "
                "disclaims all warranties with regard to this software including all implied "
                "warranties of merchantability and fitness in no event shall the author be liable for "
                "any special direct indirect or consequential damages or any damages whatsoever "
                "resulting from loss of use data or profits whether in an action of contract "
                "negligence or other tortious action arising out of or in connection with the use or "
                "performance of this software",
}

#: A-Z lower-cased, other ASCII characters that end a word turned into spaces.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: bytes) -> bytes:
    """The words of a UTF-8 text, each followed by one space, with one in front."""
    words = text.lower().translate(_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b" "


@dataclass
class Automaton:
    """Bit i of a state set: the first i items of the template are consumed."""

    label: str
    anchor: bytes                        # the mandatory words it begins with
    moves: dict[bytes, int] = field(default_factory=dict)
    wild: int = 0                        # items that any word satisfies
    skips: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0
    mandatory: list[int] = field(default_factory=list)   # mandatory words up to item i

    def closed(self, states: int) -> int:
        for a, b in self.skips:          # in ascending order, so one pass is enough
            if states >> a & 1:
                states |= 1 << b
        return states

    def run(self, words: Iterator[bytes]) -> float:
        """Share of the mandatory words read before the automaton dies; 1.0
        where it accepts."""
        states, far = self.closed(1), 0
        for w in words:
            states &= self.moves.get(w, 0) | self.wild
            if not states:
                break
            states = self.closed(states << 1)
            far = max(far, states.bit_length() - 1)
            if states >> self.size & 1:
                return 1.0
        return self.mandatory[far] / self.mandatory[-1] * 0.999


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label, b"")
    anchor: list[bytes] = []
    leading, opened, n, need = True, -1, 0, 0
    a.mandatory.append(0)
    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template.lower()):
        if part == "[[":
            opened, leading = n, False
        elif part == "]]":
            a.skips.append((opened, n))
            opened = -1
        elif part.startswith("{{"):
            leading = False
            low, high = map(int, part[2:-2].split("-"))
            for k in range(high):
                a.wild |= 1 << n
                if k >= low:
                    a.skips.append((n, n + high - k))
                n += 1
                a.mandatory.append(need)
        else:
            w = part.encode()
            a.moves[w] = a.moves.get(w, 0) | 1 << n
            n += 1
            need += opened < 0
            a.mandatory.append(need)
            if leading:
                anchor.append(w)
    if len(anchor) < 2:
        raise ValueError(f"template {label!r} must begin with two mandatory words")
    a.skips.sort()
    a.size, a.anchor = n, b" " + b" ".join(anchor) + b" "
    return a


def _places(text: bytes, phrase: bytes) -> Iterator[int]:
    """Where a phrase (with its outer spaces) begins; its last space may be the
    next one's first."""
    at = text.find(phrase)
    while at >= 0:
        yield at
        at = text.find(phrase, at + 1)


def _tail(text: bytes, at: int, step: int = 4096) -> Iterator[bytes]:
    """The words from a place on, read piecewise."""
    while at < len(text):
        end = len(text) if at + step >= len(text) else text.rfind(b" ", at + 1, at + step)
        end = text.find(b" ", at + step) if end <= at else end
        end = len(text) if end < 0 else end
        yield from text[at:end].split()
        at = end


def scan_text(text: bytes | None, phrases: dict[bytes, str],
              automata: list[Automaton]) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score) of one text."""
    t = normalised(text or b"")
    n = t.count(b" ") - 1
    n_base, first, last, base, more, score = 0, None, None, set(), set(), 0.0
    if b"licen" in t or any(b"licen" not in p for p in phrases):
        for phrase, label in phrases.items():
            word = seen = 0                  # the word at a place: spaces since the one before
            for at in _places(t, phrase):
                word += t.count(b" ", seen, at)
                seen = at
                n_base += 1
                first = word if first is None else min(first, word)
                last = word if last is None else max(last, word)
                base.add(label)
    for a in automata:
        if a.label in more:
            continue
        for at in _places(t, a.anchor):
            got = a.run(_tail(t, at))
            score = max(score, got)
            if got == 1.0:
                more.add(a.label)
                break
    if base:
        score = max(score, 0.5)
    return (n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)),
            float(score))


SCHEMA = ("id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] | None = None,
                  templates: dict[str, str] | None = None) -> DataFrame:
    """License phrases and accepted license templates of every whole text.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
    characters. ``n_base`` counts every place where the words of a phrase stand
    consecutively, ``first_word`` and ``last_word`` are the smallest and the
    largest of their starts. ``labels`` adds the labels of the templates
    accepted anywhere in the text. ``score``: 1 for an accepted template, else
    the largest share of mandatory words an automaton read (below 1), at least
    0.5 with a base phrase, 0 without any sign. ``mit``, ``bsd`` and ``isc`` stand for
    the opening sentence alone, whatever follows it; ``mit-full``, ``bsd-2-clause``,
    ``bsd-3-clause`` and ``isc-full`` for the whole wording. The work on a text grows
    with its length, however many phrases it repeats.

    One row per input row, in one pass without a shuffle; a null or empty text
    has no words, no labels and score 0; null ids stay null; repeated rows give
    repeated results; an empty table gives an empty result.
    """
    ph = {b" " + k.encode() + b" ": v for k, v in (phrases or PHRASES).items()}
    au = [compile_template(k, v) for k, v in (templates or TEMPLATES).items()]

    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                            ("first_word", pa.int64()), ("last_word", pa.int64()),
                            ("base_labels", pa.string()), ("labels", pa.string()),
                            ("score", pa.float64())])
        for b in batches:
            rows = [scan_text(x.as_py(), ph, au) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))],
                schema=schema)

    out = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
    return out.withColumnRenamed("id", id_col)
