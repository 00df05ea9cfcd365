"""License scans, personal data, chat formatting: against brute force and in the odd cases."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbside.llm import chat_format, license_scan, pii

from .conftest import rows

# License scans


def as_regex(markup):
    """The template as a regular expression over tokens joined by spaces: what the automaton must agree with."""
    out, kinds = [], []
    for k, part in enumerate(re.split(r"<<(optional|either|or|end|any:[0-9]+)>>", markup)):
        if k % 2 == 0:
            out += [re.escape(w) + " " for w, _, _ in license_scan.tokens(part)]
        elif part in ("optional", "either"):
            kinds.append(part)
            out.append("(?:")
        elif part == "end":
            out.append(")?" if kinds.pop() == "optional" else ")")
        else:
            out.append("|" if part == "or" else rf"(?:\S+ ){{0,{part[4:]}}}")
    return re.compile("".join(out))


@pytest.mark.parametrize(
    "markup",
    ["a <<optional>>b <<optional>>c<<end>> <<end>> d <<any:3>> e <<optional>>f<<end>>", "<<either>>a<<or>>b c<<or>><<optional>>d<<end>> e<<end>> f", "a <<either>>b <<either>>c<<or>>d<<end>><<or>>e <<any:2>> f<<end>> <<optional>>a<<end>>"],
)
def test_automata_match_what_the_expressions_match(markup):
    rng = random.Random(2)
    automaton, pattern = license_scan.Automaton(markup), as_regex(markup)
    seen = 0
    for _ in range(2500):
        text = " ".join(rng.choice("abcdefx") for _ in range(rng.randint(1, 12)))
        read = license_scan.tokens(text)
        for k in range(len(read)):
            end = automaton.match(read, k)
            rest = "".join(w + " " for w, _, _ in read[k:])
            lengths = [n for n in range(1, len(read) - k + 1) if pattern.fullmatch("".join(w + " " for w, _, _ in read[k : k + n]))]
            assert (end - k if end >= 0 else None) == (max(lengths) if lengths else None), (rest, k)
            if lengths:
                seen += 1
                assert not automaton.anchors.isdisjoint(w for w, _, _ in read[k:end])
    assert seen > 50


def wordings(markup, full):
    """A text of a template: with all optional regions or with none, and each alternative in turn."""
    parts = re.split(r"<<(optional|either|or|end|any:[0-9]+)>>", markup)

    def read(i, stop):
        texts = [""]
        while i < len(parts) and not (i % 2 and parts[i] in stop):
            part = parts[i]
            if i % 2 == 0:
                texts = [t + part for t in texts]
            elif part == "optional":
                inner, i = read(i + 1, {"end"})
                texts = [t + x for t in texts for x in inner] if full else texts
            elif part == "either":
                options, i = read(i + 1, {"or", "end"})
                while parts[i] == "or":
                    more, i = read(i + 1, {"or", "end"})
                    options = options + more
                texts = [t + x for t in texts for x in options]
            else:
                texts = [t + "Some" for t in texts] if full else texts
            i += 1
        return texts, i

    return read(0, ())[0]


EVERY = [(name, k) for name, markups in license_scan.TEMPLATES.items() for k in range(len(markups))]


@pytest.mark.parametrize(("name", "k"), EVERY)
def test_every_template_finds_itself(name, k):
    automata = license_scan.compiled()
    for full in (True, False):
        for text in wordings(license_scan.TEMPLATES[name][k], full)[:40]:
            assert name in {n for _, _, n in license_scan.matches(f"Xyz qrs.\n{text.upper()}!\nXyz", automata)}, text
            words = text.split()
            broken = " ".join([*words[:-2], "other", words[-1]]) if words[-2] not in ("the", "of") else " ".join(words[:-1])
            if not full:
                assert name not in {n for _, _, n in license_scan.matches(broken, {(name, k): automata[name, k]})} or len(license_scan.tokens(broken)) >= 4, broken


@pytest.mark.parametrize(("name", "k"), EVERY)
def test_mandatory_wording_names_the_license(name, k):
    """The shortest text of each template is as long as the license's name and version, and has a word of its own."""
    own = {"apache", "mit", "bsd", "isc", "gnu", "gpl", "lgpl", "agpl", "mpl", "mozilla", "cc", "commons", "cc0", "reserved", "software", "redistributions"}
    for text in wordings(license_scan.TEMPLATES[name][k], False):
        words = [w for w, _, _ in license_scan.tokens(text)]
        assert len(words) >= max(3, len(license_scan.tokens(name.replace("-notice", "").replace("-Clause", "")))) and own & set(words), text


def test_every_wording_has_a_word_of_the_cover():
    automata = license_scan.compiled()
    words = set(license_scan.cover(automata.values()))
    assert len(words) < 10
    for name, k in EVERY:
        for full in (True, False):
            for text in wordings(license_scan.TEMPLATES[name][k], full)[:40]:
                assert words & {w for w, _, _ in license_scan.tokens(text)}, text


@pytest.mark.parametrize("text", ["prices fell under by 4.0", "licensed released available under apache", "the MIT license is popular", "under the sea 2.0", "the apache license", "creative commons is a movement"])
def test_what_is_no_notice(text):
    assert license_scan.matches(text, license_scan.compiled()) == []


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under the Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
        ("This work is licensed under CC BY 4.0", "CC-BY-4.0"), ("Released under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("under the terms of the GNU Lesser General Public License v3", "LGPL-3.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("made available under the Apache License v2.0", "Apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "GPL-3.0"),
    ],
)
def test_notices(text, name):
    assert [n for _, _, n in license_scan.matches(text, license_scan.compiled())] == [name]


def test_license_rows(frame):
    clash = ["license", "start", "end", "automata"]
    far = "filler words " * 60_000 + "This file is licensed under the Apache License, Version 2.0."
    text = "Licensed under CC BY-NC 4.0. And again: licensed under CC BY-NC 4.0."
    found = rows(license_scan.scan_licenses(frame([(1, text), (2, None), (3, ""), (None, "Released under the MIT licence"), (4, far), (5, "the apache tribe"), (1, text)])))
    assert Counter((i, n) for i, n, _, _ in found) == {(1, "CC-BY-NC-4.0"): 4, (4, "Apache-2.0"): 1, (None, "MIT-notice"): 1}
    for i, _, start, end in found:
        if i == 1:
            assert text[start:end].lower() == "licensed under cc by-nc 4.0"
    assert license_scan.scan_licenses(frame([])).count() == 0
    odd = frame([(1, text)]).withColumns({c: F.lit("x") for c in clash})
    assert license_scan.scan_licenses(odd).columns == ["doc_id", "license", "start", "end"] and license_scan.scan_licenses(odd).count() == 2


@pytest.mark.parametrize(
    ("notice", "name"),
    [
        ("Licensed under the MIT License", "MIT-notice"), ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("Licensed under the GNU General Public License version 3", "GPL-3.0"),
        ("Released under the GNU General Public License, version 2", "GPL-2.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Released under CC0 1.0", "CC0-1.0"),
    ],
)
def test_a_notice_between_copyright_and_rights(notice, name):
    text = f"Copyright (c) 2021 Acme. {notice}. All rights reserved."
    assert [(text[s:e], n) for s, e, n in license_scan.matches(text, license_scan.compiled())] == [(text[:-1], "All-rights-reserved"), (notice, name)]


def test_what_covers_a_match():
    automata = license_scan.compiled({"large": "a <<optional>>b c<<end>> <<any:4>> z", "small": "b c", "free": "<<optional>>a<<end>> x"})
    names = lambda text: [n for _, _, n in license_scan.matches(text, automata)]
    assert names("a b c z") == ["large"]  # by wording
    assert names("a q b c z") == ["large", "small"] and names("a b c b c z") == ["large", "small"]  # by a replaceable region
    assert names("a x z") == ["large", "free"] and names("x b c") == ["free", "small"]
    assert names("a b c q z x a") == ["large", "free"]


def test_bad_templates():
    for markup in ("<<optional>>a<<end>>", "<<any:3>> a", "<<optional>>a b", "<<either>>a<<or>><<end>>", "<<optional>>a<<or>>b<<end>> c"):
        with pytest.raises((ValueError, IndexError)):
            license_scan.Automaton(markup)


# Personal data

CARD, IBAN = "4539 1488 0343 6467", "DE89 3704 0044 0532 0130 00"


def test_checksums():
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    for k in range(16):  # Luhn catches every wrong digit
        wrong = "4539148803436467"
        assert not pii.luhn(wrong[:k] + str((int(wrong[k]) + 1) % 10) + wrong[k + 1 :])


def kinds(text):
    return [(k, text[s:e]) for s, e, k, _ in pii.spans(text)]


def test_spans():
    assert kinds(f"My card {CARD}, my IBAN {IBAN}.") == [("card", CARD), ("iban", IBAN)]
    assert kinds("order 4539148803436468") == [] and kinds(IBAN.replace("89", "88")) == []
    assert kinds("Write to a.b+c@mail.example.org today") == [("email", "a.b+c@mail.example.org")]
    assert kinds("server 10.20.30.40 but version 1.2.3.4 and 300.1.1.1") [:1] == [("ip", "10.20.30.40")]
    assert kinds("ssn 123-45-6789, no 666-45-6789, 000-12-3456") == [("ssn", "123-45-6789")]
    assert kinds("call +1 (555) 010-1234 now") == [("phone", "+1 (555) 010-1234")]
    assert kinds('api_key = "abcdefghij0123456789"') == [("secret", "abcdefghij0123456789")]


@pytest.mark.parametrize(
    ("before", "after"),
    [("", " 12/25"), ("", " 122"), ("12 ", ""), ("", " 12-25 122"), ("1 ", " 12/25"), ("1234 5678 ", ""), ("", " 4"), ("3.14 ", " 2"), ("", " 12a"), ("x1 ", "")],
)
@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "4111111111111111", "4539-1488-0343-6467", "3782 822463 10005"])
def test_cards_beside_other_numbers(before, after, card):
    assert ("card", card) in kinds(f"pay {before}{card}{after} now")


def test_cards_in_a_row():
    assert kinds("pay 4111 1111 1111 1111 4539 1488 0343 6467 12/25") == [("card", "4111 1111 1111 1111"), ("card", "4539 1488 0343 6467")]
    assert kinds("pay 4111 1111 1111 1112 and 4111.1111.1111.1111, x4111111111111111, 4111111111111111x") == []
    assert kinds("pay 41 11 1111 1111 1111 12/25") == [("card", "41 11 1111 1111 1111")]


@pytest.mark.parametrize("iban", ["BE68 5390 0754 7034", "BE68539007547034", IBAN, "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32", "FR76 3000 6000 0112 3456 7890 189"])
@pytest.mark.parametrize(("before", "after"), [("", " BIC KREDBEBB"), ("", " KREDBEBB"), ("", " EUR 100"), ("AB12 ", ""), ("REF AB12 CDEF ", " BIC"), ("", "")])
def test_ibans_beside_other_words(before, after, iban):
    assert kinds(f"to {before}{iban}{after}.") == [("iban", iban)]


def test_ibans_of_an_unknown_country():
    number = next(f"ZZ{k:02d} 5390 0754 7034" for k in range(2, 99) if pii.mod97(f"ZZ{k:02d}539007547034"))
    assert kinds(f"to {number} BIC KREDBEBB") == [("iban", number)]


def test_context_adjusts_the_score():
    score = lambda t: pii.spans(t, 0.0)[0][3]
    assert score(f"credit card {CARD}") > score(f"number {CARD}") > score(f"order {CARD}")
    assert not pii.spans(f"order {CARD}") and pii.spans(f"number {CARD}")


def brute_personal(text, kind):
    """Spans of one kind by looking at every substring: what begins first and reaches farthest of what is valid and stands alone."""
    local, domain = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.%+-"), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
    word = lambda c: c.isalnum() or c == "_"

    def alone(i, j, at):
        before, after = text[i - 1] if i else " ", text[j] if j < len(text) else " "
        if kind == "email":
            led = text[at:i].rstrip(".")  # dots before an address are not of it
            return not (led and led[-1] in local) and not word(after)
        if kind == "ip":
            return not (before in ".0123456789" or word(before)) and not word(after) and not (after == "." and j + 1 < len(text) and text[j + 1].isdigit())
        return not (word(before) or before == "-") and not (word(after) or after == "-")

    def valid(s):
        if kind == "email":
            name, _, host = s.partition("@")
            labels = host.split(".")
            return (
                name != "" and name[0] != "." and name[-1] != "." and set(name) <= local and len(labels) > 1
                and all(x and set(x) <= domain for x in labels) and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24
            )
        if kind == "ip":
            parts = s.split(".")
            return len(parts) == 4 and all(p.isdigit() and str(int(p)) == p and int(p) < 256 for p in parts)
        parts = s.split("-")
        return [len(p) for p in parts] == [3, 2, 4] and all(p.isdigit() for p in parts) and parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000"

    out, at = [], 0
    if kind == "email":  # the longest around each at sign; one that is too long is none
        for q in (q for q, c in enumerate(text) if c == "@"):
            i, j = min(((i, -j) for i in range(at, q) for j in range(q + 2, len(text) + 1) if valid(text[i:j]) and alone(i, j, at)), default=(0, 0))
            name, _, host = text[i:-j].partition("@")
            if j and len(name) <= 64 and len(host) <= 253 and max(map(len, host.split("."))) <= 63 and ".." not in name:
                out.append((i, -j))
                at = -j
        return out
    while found := min(((i, -j) for i in range(at, len(text)) for j in range(i + 5, min(len(text), i + 330) + 1) if valid(text[i:j]) and alone(i, j, at)), default=None):
        at = -found[1]
        out.append((found[0], at))
    return out


@pytest.mark.parametrize("kind", ["email", "ip", "ssn"])
def test_spans_are_those_of_all_substrings(kind):
    rng = random.Random(12)
    bits = {"email": ["a", "b.c", "@", "x", ".", "-", "org", "co", " ", "_", "9", "d" * 61, "@e.fr", ".com"], "ip": ["1", "25", "255", "256", "0", "01", ".", ".", ".", " ", "a", "10.2.3.4"], "ssn": ["123", "45", "6789", "-", "-", " ", "000", "00", "0000", "666", "x", "912", *["123-45-6789", " "] * 3]}[kind]
    base = dict(pii.KINDS)
    seen = 0
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(3, 14)))
        got = [(s, e) for s, e, k, _ in pii.spans(text, 0.0) if k == kind]
        want = brute_personal(text, kind)
        covered = [(s, e) for s, e, k, _ in pii.spans(text, 0.0) if list(base).index(k) < list(base).index(kind)]
        want = [w for w in want if not any(s < w[1] and w[0] < e for s, e in covered)]
        assert got == want, (text, got, want)
        seen += len(want)
    assert seen > 20


def brute_cards(text):
    """Every run of whole groups that single separators join; usual grouping first, then the earliest, then the longest."""
    found = []
    for i in range(len(text)):
        for j in range(i + 13, min(len(text), i + 37) + 1):
            s = text[i:j]
            before, after = text[i - 1] if i else " ", text[j] if j < len(text) else " "
            if not re.fullmatch(r"[0-9]+(?:[ -][0-9]+)*", s) or before.isalnum() or before in "._" or after.isalnum() or after == "_":
                continue
            digits = re.sub(r"\D", "", s)
            if 13 <= len(digits) <= 19 and len(set(digits)) > 1 and pii.luhn(digits):
                sizes = " ".join(str(len(g)) for g in re.split("[ -]", s))
                found.append((not re.fullmatch(r"1[3-9]|4 4 4 4(?: [1-3])?|4 6 [45]|4 4 4 1", sizes), i, -j))
    taken = []
    for _, i, j in sorted(found):
        if all(-j <= a or i >= b for a, b in taken):
            taken.append((i, -j))
    return sorted(taken)


def test_cards_are_those_of_all_substrings():
    rng = random.Random(13)
    bits = [CARD, "4111111111111111", "3782 822463 10005", "12/25", "123", "7", " ", " ", "-", "a", ".", "4111 1111 1111 1112"]
    seen = 0
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(2, 8)))
        got = [(s, e) for s, e, k, _ in pii.spans(text, 0.0) if k == "card"]
        if not any(k in ("email", "iban") for _, _, k, _ in pii.spans(text, 0.0)):
            assert got == brute_cards(text), text
            seen += len(got)
    assert seen > 100


@pytest.mark.parametrize(("local", "domain", "found"), [(64, 20, True), (65, 20, False), (300, 20, False), (10, 63, True), (10, 64, False), (110, 63, False)])
def test_long_addresses_are_whole_or_not_there(local, domain, found):
    address = "a" * local + "@" + "d" * domain + ".example.org"
    assert kinds(f"write {address} now") == ([("email", address)] if found else [])
    many = "a@" + "bc." * 83 + "org"
    assert kinds(many) == [("email", many)] and kinds("a@" + "bc." * 90 + "org") == []


def test_personal_rows(frame):
    long = "nothing here 12 " * 60_000 + "me@example.com"
    found = rows(pii.find_personal_data(frame([(1, "ñ a@b.co"), (2, None), (3, ""), (None, "a@b.co"), (4, long), (1, "ñ a@b.co"), (5, "@@ 1@ @2")])))
    assert [(i, k, s, e) for i, k, s, e, _ in found] == [(1, "email", 2, 8), (1, "email", 2, 8), (4, "email", len(long) - 14, len(long)), (None, "email", 0, 6)]
    assert pii.find_personal_data(frame([])).count() == 0


def test_no_pattern_runs_away():
    import time

    t = time.time()
    for text in ("1 " * 100_000, "1-" * 100_000, "a@" * 50_000, "A" * 200_000, "token=" * 30_000, "1." * 100_000, "a.a" * 60_000 + "@"):
        pii.spans(text)
    assert time.time() - t < 30


# Chat formatting


@pytest.fixture
def chats(spark):
    from kerbside.session import ship

    ship(spark)
    return lambda data: spark.createDataFrame([(*r, "x", "y") for r in data], "conv_id bigint, turn bigint, role string, text string, start string, template string")


def brute_spans(messages, render):
    """A turn has a span if its prefix's rendering starts with that of the one before."""
    cuts = [render(messages[:k]) for k in range(len(messages) + 1)] if messages else []
    cuts = ["", *cuts[1:]]
    out = [(len(a), len(b), False) if b.startswith(a) else (None, None, True) for a, b in itertools.pairwise(cuts)]
    last = max((k for k, x in enumerate(out) if x[2]), default=-1)
    return [(*x, k > last) for k, x in enumerate(out)]


def test_spans_of_turns():
    rng = random.Random(4)
    for _ in range(100):
        messages = [{"role": rng.choice(["system", "user", "assistant", "tool"]), "text": "w" * rng.randint(0, 5)} for _ in range(rng.randint(1, 7))]
        for template in chat_format.TEMPLATES.values():
            assert chat_format.turn_spans(messages, template) == brute_spans(messages, template)


def test_rewriting_templates_are_found(chats):
    data = [(1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "more"), (1, 4, "assistant", "ok")]
    found = {(r["template"], r["turn"]): r for r in chat_format.format_chats(chats(data)).collect()}
    assert len(found) == 15
    assert [found["late_system", t]["rewrites"] for t in range(5)] == [False, False, False, True, False]
    assert [found["late_system", t]["trained"] for t in range(5)] == [False, False, False, False, True]
    assert [found["marked", t]["trained"] for t in range(5)] == [False, False, True, False, True]
    text = chat_format.marked([{"role": r, "text": x} for _, _, r, x in data])
    assert "yo" in text[found["marked", 2]["start"] : found["marked", 2]["end"]]


def test_chat_rows(chats):
    data = [(1, 1, None, None), (1, 0, "assistant", ""), (None, 0, "user", "a"), (None, None, "user", "b"), (2, 0, "user", "z" * 300_000), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")]
    found = chat_format.format_chats(chats(data), {"marked": chat_format.marked}).collect()
    assert len(found) == 7
    by = sorted(((r["conv_id"], r["turn"], r["role"], r["start"], r["end"]) for r in found if r["conv_id"] == 3), key=str)
    assert by[0][4] == by[1][3] and [b[:3] for b in by] == [(3, 0, "assistant")] * 2
    assert [r["role"] for r in found if r["conv_id"] == 1] == ["assistant", "user"]
    assert chat_format.format_chats(chats([])).count() == 0


def strict(messages):
    """A template that refuses any conversation that the assistant doesn't end."""
    if messages[-1]["role"] != "assistant":
        raise ValueError(messages[-1]["role"])
    return chat_format.marked(messages)


def test_a_template_that_raises(chats):
    data = [(1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|yo"), (1, 3, "user", "more"), (1, 4, "assistant", "ok"), (1, 5, "user", "bye")]
    found = sorted(chat_format.format_chats(chats(data), {"strict": strict}).collect(), key=lambda r: r["turn"])
    text = chat_format.marked([{"role": r, "text": x} for _, _, r, x in data[:5]])
    assert [text[r["start"] : r["end"]] if r["start"] is not None else None for r in found] == [None, None, "<|yo", None, "ok", None]
    assert [r["trained"] for r in found] == [False, False, True, False, True, False] and not any(r["rewrites"] for r in found)


def test_no_span_holds_the_text_of_another_turn():
    """Templates that refuse prefixes at random: each span lies within its own turn's part of the whole rendering."""
    rng = random.Random(6)
    for case in range(300):
        messages = [{"role": rng.choice(["system", "user", "assistant"]), "text": "".join(rng.choices("ab<|", k=rng.randint(0, 6)))} for _ in range(rng.randint(1, 7))]
        refused = {k for k in range(1, len(messages)) if rng.random() < 0.4}

        def render(prefix, refused=refused):
            if len(prefix) in refused:
                raise RuntimeError
            return chat_format.marked(prefix)

        own = [(a, b) for a, b, _, _ in chat_format.turn_spans(messages, chat_format.marked)]
        for k, (start, end, rewrites, holds) in enumerate(chat_format.turn_spans(messages, render)):
            assert not rewrites and holds == (start is not None)
            if k + 1 in refused:
                assert start is None
            elif k in refused:  # all its text, and no more, where there is some
                text = messages[k]["text"]
                body = own[k][0] + len(f"<|im_start|>{messages[k]['role']}\n")
                whole = chat_format.marked(messages)
                assert (whole[start:end] == text and abs(start - body) <= len(text) and own[k][0] <= start and end <= own[k][1]) if text else start is None, case
            else:
                assert (start, end) == own[k]


def test_a_long_conversation(chats):
    data = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * 20) for t in range(400)] + [(2, 0, "user", "w" * 2_000_000)]
    found = {(r["conv_id"], r["turn"]): r for r in chat_format.format_chats(chats(data), {"marked": chat_format.marked}).collect()}
    whole = chat_format.marked([{"role": r, "text": x} for c, _, r, x in data if c == 1])
    assert len(found) == 401 and found[1, 399]["end"] == len(whole) and found[2, 0]["end"] > 2_000_000
    assert all(f"turn {t} " in whole[found[1, t]["start"] : found[1, t]["end"]] and found[1, t]["trained"] == bool(t % 2) for t in range(400))


def test_rows_without_a_conversation_stay_apart(chats):
    found = chat_format.format_chats(chats([(None, t, "user", f"q{t}") for t in range(200)]), {"marked": chat_format.marked}).collect()
    assert len(found) == 200 and {r["start"] for r in found} == {0}
