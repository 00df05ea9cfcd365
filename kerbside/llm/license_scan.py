"""License scans by template markup: optional, alternative and replaceable regions become parts of an automaton over tokens.

A template is a license's or notice's wording with ``<<optional>> ... <<end>>`` around regions that may be left out,
``<<either>> ... <<or>> ... <<end>>`` around wordings of which one must be there (both nest) and ``<<any:N>>`` for a region of at most N tokens of any kind. All
other wording is mandatory. A text matches where its tokens spell the mandatory wording exactly, in order, with nothing between but what the template
allows. Tokens are lower-case words and numbers; punctuation, white space and letter case do not count, and a few
spellings are one (licence, license). A license may have several templates: its text, its notice, its SPDX line.

A compiled template has a position before each of its tokens; skipping an optional region, or going on to another alternative, is a jump between positions.
All positions that a text's tokens can have reached are carried along together, so a match is found in one pass from its
first token, whatever the regions. The longest match from a start counts. A match inside another one is left out if
that one is of the same license or reads all its tokens as wording; a notice that another template's replaceable region
has swallowed is reported beside it.

Every match has one of its template's anchors: the longest word that all texts of it have, else one of each alternative. A few words
cover all templates so; texts without any of them are passed over in the JVM. Texts are scanned whole.

Defined results. Null and empty texts have no match; texts of any length are scanned. Offsets count characters, end exclusive. Matches of one span by
several licenses are all reported, by license name. A null doc_id is reported as null; repeated rows give repeated
matches. No rows give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.frames import col

_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "copyrights": "copyright", "organisation": "organization"}
_TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_MARKUP = re.compile(r"<<(optional|either|or|end|any:[0-9]+)>>")

_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software"""
_BSD_END = """this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:12>> be liable for any direct indirect
incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD_TWO = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution"""
_COPYRIGHT = "<<optional>>copyright <<optional>>c<<end>> <<any:16>><<end>>"
_UNDER = """<<optional>>this <<any:4>> is<<end>> <<either>><<optional>><<either>>licensed<<or>>released<<or>>distributed<<or>>available<<or>>made available<<or>>published<<end>><<end>> under<<or>>subject to<<end>>
<<optional>><<either>>a<<or>>the<<end>><<end>> <<optional>>terms of <<optional>>the<<end>><<end>>"""
_FSF = """<<any:2>> <<optional>>june<<end>> <<optional>>november<<end>> <<any:1>> copyright <<optional>>c<<end>> <<any:8>> free software foundation inc <<any:16>> everyone is permitted to copy and distribute verbatim copies of
this license document but changing it is not allowed"""


def _version(number: str) -> str:
    return f"<<either>>version {number}<<or>>v {number}<<or>>v{number}<<end>>"


def _gnu(kind: str, number: str) -> str:
    return f"{_UNDER} gnu {kind} public license <<optional>>as published by the free software foundation <<optional>>either<<end>><<end>> {_version(number)} <<optional>>of the license<<end>>"


def _spdx(identifier: str) -> str:
    return f"spdx license identifier {identifier}"


def _cc(*wordings: str) -> str:
    """A notice of a Creative Commons license: its name or its short name, and its version."""
    return f"{_UNDER} <<optional>>creative commons attribution license<<end>> <<either>>{'<<or>>'.join(wordings)}<<end>> 4.0 <<optional>>international<<end>> <<optional>>license<<end>>"


TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        f"{_UNDER} apache license <<either>>2.0<<or>>{_version('2.0')}<<end>>",
        "apache license version 2.0 january 2004 <<optional>>http <<optional>>www<<end>> apache org licenses<<end>> terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
        _spdx("apache 2.0"),
    ),
    "MIT": (f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software {_WARRANTY}", _spdx("mit")),
    "MIT-notice": (f"{_UNDER} mit license",),
    "BSD-2-Clause": (f"{_BSD_TWO} {_BSD_END}", f"{_UNDER} <<optional>>simplified<<end>> bsd 2 clause <<optional>>simplified<<end>> license", _spdx("bsd 2 clause")),
    "BSD-3-Clause": (f"{_BSD_TWO} <<optional>>3<<end>> neither the name of <<any:12>> nor the names of <<any:4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}", f"{_UNDER} <<optional>>new<<end>> bsd 3 clause <<optional>>new<<end>> license", _spdx("bsd 3 clause")),
    "ISC": ("permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", f"{_UNDER} isc license", _spdx("isc")),
    "GPL-3.0": (_gnu("general", "3"), f"gnu general public license version 3 {_FSF}", _spdx("gpl 3.0")),
    "GPL-2.0": (_gnu("general", "2"), f"gnu general public license version 2 {_FSF}", _spdx("gpl 2.0")),
    "LGPL-3.0": (_gnu("lesser general", "3"), f"gnu lesser general public license version 3 {_FSF}", _spdx("lgpl 3.0")),
    "LGPL-2.1": (_gnu("lesser general", "2.1"), f"gnu lesser general public license version 2.1 {_FSF}", _spdx("lgpl 2.1")),
    "AGPL-3.0": (_gnu("affero general", "3"), f"gnu affero general public license version 3 {_FSF}", _spdx("agpl 3.0")),
    "MPL-2.0": (f"{_UNDER} mozilla public license <<either>>2.0<<or>>{_version('2.0')}<<end>>", "mozilla public license version 2.0 1 definitions 1.1 contributor", _spdx("mpl 2.0")),
    "CC-BY-4.0": (_cc("creative commons attribution", "cc by"), _spdx("cc by 4.0")),
    "CC-BY-NC-4.0": (_cc("creative commons attribution <<either>>noncommercial<<or>>non commercial<<end>>", "cc by nc"), _spdx("cc by nc 4.0")),
    "CC-BY-SA-4.0": (_cc("creative commons attribution <<either>>sharealike<<or>>share alike<<end>>", "cc by sa"), _spdx("cc by sa 4.0")),
    "CC0-1.0": (f"<<optional>>dedicated to the public domain<<end>> {_UNDER} <<optional>>creative commons<<end>> cc0 1.0 <<optional>>universal<<end>>", _spdx("cc0 1.0")),
    "All-rights-reserved": (f"{_COPYRIGHT} all rights reserved",),
}


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of a text."""
    return [(_SAME.get(w, w), m.start(), m.end()) for m in _TOKEN.finditer(text) for w in (m[0].lower(),)]


class Automaton:
    """A template's positions; words[p] is the token that leads from p to p + 1, jumps[p] where p also leads without one.

    free[p] is the number of tokens of any kind that may be read at p (a replaceable region), counted as it goes.
    """

    def __init__(self, markup: str):
        self.words: list[str | None] = []  # None: any token; "": no token, the end of an alternative
        self.jumps: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        opened: list[tuple[str, int, list[int], list[set[str]], set[str]]] = []  # kind, where, ends of its alternatives, their words, words of the one at hand
        sure: set[str] = set()  # words that every match has; while a region is open, those of the region
        choices: list[list[set[str]]] = []
        for k, part in enumerate(_MARKUP.split(markup)):
            if k % 2 == 0:
                read = [w for w, _, _ in tokens(part)]
                self.words += read
                sure.update(read)
            elif part in ("optional", "either"):
                opened.append((part, len(self.words), [], [], sure))
                sure = set()
            elif part == "or":
                kind, where, ends, told, _ = opened[-1]
                if kind != "either":
                    raise ValueError("<<or>> belongs between <<either>> and <<end>>")
                ends.append(len(self.words))
                self.words.append("")
                self.jumps.setdefault(where, []).append(len(self.words))
                told.append(sure)
                sure = set()
            elif part == "end":
                kind, where, ends, told, before = opened.pop()
                if kind == "optional":
                    self.jumps.setdefault(where, []).append(len(self.words))
                else:
                    for e in ends:
                        self.jumps.setdefault(e, []).append(len(self.words))
                    told.append(sure)
                    before = before | set.intersection(*told)
                    if all(told) and not opened:
                        choices.append(told)
                sure = before
            else:
                self.free[len(self.words)] = int(part[4:])
                self.words.append(None)
        if opened or not (sure or choices):
            raise ValueError("a template needs mandatory wording, and an end for each region")
        longest = lambda words: max(words, key=lambda w: (len(w), w))
        #: Sets of words, of one of which every match has all.
        self.needs = [sure] if sure else choices[0]
        self.anchors = {longest(words) for words in self.needs}
        self.start = self._closed({(0, 0)})
        self.first = {self.words[p] for p, _ in self.start if p < len(self.words)} - {""}
        if None in self.first or len(self.words) in {p for p, _ in self.start}:
            raise ValueError("a template can't begin with a replaceable region")

    def _closed(self, at: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, out = list(at), set()
        while todo:
            p, used = todo.pop()
            if (p, used) in out:
                continue
            out.add((p, used))
            todo += [(q, 0) for q in self.jumps.get(p, ())]
            if p in self.free:
                todo.append((p + 1, 0))
        return out

    def match(self, read: list[tuple[str, int, int]], begin: int) -> int:
        """The end of the longest match from token begin, or -1."""
        at, best, last = self.start, -1, len(self.words)
        for k in range(begin, len(read)):
            word, after = read[k][0], set()
            for p, used in at:
                if p < last and self.words[p] == word:
                    after.add((p + 1, 0))
                if p in self.free and used < self.free[p]:
                    after.add((p, used + 1))
            if not after:
                break
            at = self._closed(after)
            if any(p == last for p, _ in at):
                best = k + 1
        return best

    def free_tokens(self, read: list[tuple[str, int, int]], begin: int, end: int) -> set[int]:
        """The tokens of the match begin to end that replaceable regions read, where as few as possible are left to these."""
        last = len(self.words)
        layers: list[dict] = [{s: (0, None, False) for s in self.start}]  # state: (free tokens so far, state before, free)
        for k in range(begin, end):
            after: dict = {}
            for (p, used), (cost, _, _) in layers[-1].items():
                steps = [((p + 1, 0), cost, False)] if p < last and self.words[p] == read[k][0] else []
                if p in self.free and used < self.free[p]:
                    steps.append(((p, used + 1), cost + 1, True))
                for to, total, free in steps:
                    for s in self._closed({to}):
                        if s not in after or total < after[s][0]:
                            after[s] = (total, (p, used), free)
            layers.append(after)
        state = min((s for s in layers[-1] if s[0] == last), key=lambda s: layers[-1][s][0])
        found = set()
        for k in range(end - 1, begin - 1, -1):
            _, before, free = layers[k - begin + 1][state]
            if free:
                found.add(k)
            state = before
        return found


def compiled(templates: dict[str, str | tuple[str, ...]] | None = None) -> dict[tuple[str, int], Automaton]:
    """The automata of each license's templates."""
    every = TEMPLATES if templates is None else templates
    return {(name, k): Automaton(markup) for name, markups in every.items() for k, markup in enumerate([markups] if isinstance(markups, str) else markups)}


def matches(text: str, automata: dict[tuple[str, int], Automaton]) -> list[tuple[int, int, str]]:
    """(start, end, license) of the matches in a text, without those that a larger one covers."""
    read = tokens(text)
    begins: dict[str, list[tuple[str, int]]] = {}
    there = {w for w, _, _ in read}
    for name, a in automata.items():
        if not a.anchors.isdisjoint(there):
            for word in a.first:
                begins.setdefault(word, []).append(name)
    found: set[tuple[int, int, tuple[str, int]]] = set()  # by tokens
    until: dict[tuple[str, int], int] = {}
    for k, (word, _, _) in enumerate(read):
        for name in begins.get(word, ()):
            if k >= until.get(name, 0) and (end := automata[name].match(read, k)) >= 0:
                found.add((k, end, name))
                until[name] = end
    kept, around = set(), []  # around: matches that reach further, at most one a template
    free: dict[tuple[int, int, tuple[str, int]], set[int]] = {}
    for match in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        begin, end, name = match
        around = [m for m in around if m[1] > begin]
        covered = False
        for m in around:
            if m[1] >= end and m[:2] != (begin, end):
                if m not in free:
                    free[m] = automata[m[2]].free_tokens(read, m[0], m[1])
                covered = covered or m[2][0] == name[0] or free[m].isdisjoint(range(begin, end))
        around.append(match)
        if not covered:
            kept.add((read[begin][1], read[end - 1][2], name[0]))
    return sorted(kept, key=lambda x: (x[0], -x[1], x[2]))


def cover(automata: Iterable[Automaton]) -> list[str]:
    """Few words, one of which every match of any of the automata has: each time the one that the most of their needs have, of ties the longest."""
    left, found = [words for a in automata for words in a.needs], []
    while left:
        every = {w for words in left for w in words}
        found.append(max(every, key=lambda w: (sum(w in words for words in left), len(w), w)))
        left = [words for words in left if found[-1] not in words]
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, license, start, end): a row for each match."""
    automata = compiled(templates)
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matches(t, automata) for t in batch.column(1).to_pylist()]
            rows = [k for k, f in enumerate(found) for _ in f]
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([n for _, _, n in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, e, _ in flat], pa.int64())],
                ["doc_id", "license", "start", "end"],
            )

    anchors = cover(automata.values())
    spellings = sorted({w for anchor in anchors for w in (anchor, *(k for k, v in _SAME.items() if v == anchor))})
    few = [w for w in spellings if not any(v != w and v in w for v in spellings)]  # a word that contains another is found with it
    # The first sign rules out nearly all places before any word is tried there.
    seen = F.lower("text").rlike(f"(?=[{''.join(sorted({re.escape(w[0]) for w in few}))}])(?:{'|'.join(map(re.escape, few))})") if few else F.lit(False)
    few = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text")).where(seen)
    return few.mapInArrow(scan, f"doc_id {kind}, license string, start bigint, end bigint")
