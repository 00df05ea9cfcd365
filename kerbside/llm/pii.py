"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Kinds: email, iban (mod 97), card (Luhn), ssn (allotted ranges), ip (octets), phone (7 to 15 digits), secret (a named
token). Each has a base score; a supporting word within ``WINDOW`` characters raises it, a contrary one lowers it, and
spans of at least ``MIN_SCORE`` are reported. Numbers that stand beside others (a card before its expiry date, an IBAN
before a BIC) are looked for at every separator, as checksums tell where they end: cards of the usual grouping first, then
the earliest and longest; an IBAN of its country's length first. Where spans overlap, the kind listed first wins, then the earlier start.
Texts with neither a digit nor an at sign, which no kind can do without, are passed over in the JVM.

An e-mail address has at most 64 characters before the at sign, 253 after it and 63 between its dots, as the standards have it; what is longer is no
address and is not reported in part.

Defined results. Null and empty texts have no spans; texts of any length are read whole. Offsets count characters (code points), end exclusive. A null
doc_id is reported as null; repeated rows give repeated spans. Spans of equal start can't be two, as spans never overlap. No rows give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.frames import col

WINDOW = 48
MIN_SCORE = 0.5
RAISE, LOWER = 0.2, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


#: Characters of an IBAN by country, from the registry.
IBAN_LENGTHS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}
#: Digits in each group of a card's number, as cards are usually written.
_CARD_GROUPS = re.compile(r"1[3-9]|4 4 4 4(?: [1-3])?|4 6 [45]|4 4 4 1")
_NUMBERS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")


def _only(pattern: str, text: str) -> str:
    return re.sub(pattern, "", text)


def _card(text: str) -> bool:
    digits = _only(r"\D", text)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ip(text: str) -> bool:
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in text.split("."))


#: kind: (pattern, validator, base score, supporting words, contrary words). [0-9], as \d has the digits of every script.
KINDS = {
    "email": (re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\b"), lambda s: ".." not in s, 0.9, ("mail", "contact", "write"), ()),
    "iban": (re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), lambda s: 15 <= len(_only(" ", s)) <= 34 and mod97(_only(" ", s)), 0.9, ("iban", "account", "bank"), ()),
    "card": (re.compile(r"(?<![0-9.\w])[0-9](?:[ -]?[0-9]){12,18}(?![0-9\w])"), _card, 0.7, ("card", "visa", "credit", "pay"), ("order", "isbn", "serial", "tracking", "sku")),
    "ssn": (re.compile(r"(?<![0-9\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\w-])"), _ssn, 0.5, ("ssn", "social security"), ("order", "part", "serial", "sku")),
    "ip": (re.compile(r"(?<![0-9.\w])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9\w]|\.[0-9])"), _ip, 0.6, ("ip", "host", "address", "server"), ("version", "release", "section", "chapter")),
    "phone": (re.compile(r"(?<![0-9\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9\w-])|(?<![0-9\w.+-])\+[0-9]{8,15}(?![0-9\w])"), lambda s: 7 <= len(_only(r"\D", s)) <= 15, 0.6, ("phone", "tel", "call", "mobile", "fax"), ("order", "isbn", "serial", "version", "sku")),
    "secret": (re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_/+.-]{16,})", re.IGNORECASE), lambda s: any(c.isdigit() for c in s), 0.8, (), ("example", "placeholder")),
}


def _around(text: str, start: int, end: int) -> list[str]:
    return re.findall(r"\w+", text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower())


def _score(text: str, start: int, end: int, base: float, support: tuple[str, ...], against: tuple[str, ...]) -> float:
    words = _around(text, start, end)
    joined = f" {' '.join(words)} "
    has = lambda w: f" {w} " in joined or f" {w}s " in joined
    return round(min(1.0, max(0.0, base + RAISE * any(map(has, support)) - LOWER * any(map(has, against)))), 2)


_LOCAL = re.compile(r"[\w.%+-]*\Z")
_SIGN = re.compile(r"[\w.%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9.-]*")
_ADDRESS = re.compile(r"[A-Za-z0-9_%+-](?:[\w.%+-]*[\w%+-])?\Z")
MAX_LOCAL, MAX_DOMAIN, MAX_LABEL = 64, 253, 63


def _emails(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Addresses around each at sign, so that texts are not tried at every letter. One with a part that is too long is no address."""
    at, done = text.find("@"), 0
    while at >= 0:
        run = _LOCAL.search(text, max(done, at - MAX_LOCAL - 1), at).start()
        edge = run
        while at - run > MAX_LOCAL and edge > done and text[edge - 1] == ".":
            edge -= 1
        longer = at - run > MAX_LOCAL and (text[run] != "." or edge > done and _SIGN.match(text, edge - 1))
        stop = _DOMAIN.match(text, at + 1, at + MAX_DOMAIN + 2).end()
        local = next((m for k in range(run, at) if (m := _ADDRESS.match(text, k, at))), None) if not longer else None
        if local and stop - at - 1 <= MAX_DOMAIN and (m := pattern.match(text, at + 1)) and all(len(x) <= MAX_LABEL for x in m[0].split(".")):
            yield local.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """Valid cards among digits that single spaces and hyphens separate: whole groups of 13 to 19 digits in all."""
    for run in _NUMBERS.finditer(text):
        groups = [m.span() for m in re.finditer("[0-9]+", run[0])] if run.end() - run.start() >= 13 else []
        at, size = run.start(), len(groups)
        sizes = [b - a for a, b in groups]
        opens = not (at and (text[at - 1] in "._" or text[at - 1].isalnum()))
        closes = not (run.end() < len(text) and (text[run.end()] == "_" or text[run.end()].isalnum()))
        found = []  # (grouping is unusual, first group, -last group)
        for i in range(0 if opens else 1, size):
            total = 0
            for j in range(i, size if closes else size - 1):
                total += sizes[j]
                if total > 19:
                    break
                if total >= 13 and _card(run[0][groups[i][0] : groups[j][1]]):
                    found.append((not _CARD_GROUPS.fullmatch(" ".join(map(str, sizes[i : j + 1]))), i, -j))
        taken: set[int] = set()
        for _, i, j in sorted(found):
            if taken.isdisjoint(range(i, 1 - j)):
                taken.update(range(i, 1 - j))
                yield at + groups[i][0], at + groups[-j][1]


def _ibans(pattern: re.Pattern, valid, text: str) -> Iterator[tuple[int, int]]:
    """Valid IBANs: those of their country's length first, else as far as the pattern goes, else, of an unknown country, up to a separator."""
    found = []  # (not of its country's length, start, -end)
    at = 0
    while m := pattern.search(text, at):
        start, end = m.span()
        at = start + 1
        size = IBAN_LENGTHS.get(text[start : start + 2])
        ends = [k for k in range(end, start + 14, -1) if k == end or text[k] == " "]
        found += [(len(_only(" ", text[start:k])) != size, start, -k) for k in ends if (k == end or not size or len(_only(" ", text[start:k])) == size) and valid(text[start:k])]
    taken: list[tuple[int, int]] = []
    for unlike in (False, True):
        done, fixed = 0, iter(sorted(taken))
        other = next(fixed, None)
        for _, start, k in sorted(x for x in found if x[0] == unlike):
            while other and other[1] <= start:
                other = next(fixed, None)
            if start >= done and not (other and other[0] < -k):
                taken.append((start, -k))
                done = -k
    yield from sorted(taken)


def spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the personal data in a text, in order."""
    taken: list[tuple[int, int, str, float]] = []
    covered = bytearray(len(text))
    for kind, (pattern, valid, base, support, against) in KINDS.items():
        if kind == "email":
            found = _emails(pattern, text)
        elif kind == "secret":
            found = (m.span(1) for m in pattern.finditer(text))
        elif kind == "card":
            found = _cards(text)
        elif kind == "iban":
            found = _ibans(pattern, valid, text)
        else:
            found = (m.span() for m in pattern.finditer(text))
        for start, end in found:
            if valid(text[start:end]) and not any(covered[start:end]):
                score = _score(text, start, end, base, support, against)
                if score >= min_score:
                    taken.append((start, end, kind, score))
                    covered[start:end] = b"\1" * (end - start)
    return sorted(taken)


def find_personal_data(docs: DataFrame, doc_id="doc_id", text="text", min_score=MIN_SCORE) -> DataFrame:
    """(doc_id, kind, start, end, score): a row for each span."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0), [spans(t, min_score) for t in batch.column(1).to_pylist()]
            rows = [k for k, f in enumerate(found) for _ in f]
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array([k for _, _, k, _ in flat], pa.string()), pa.array([s for s, _, _, _ in flat], pa.int64()), pa.array([e for _, e, _, _ in flat], pa.int64()), pa.array([x for _, _, _, x in flat], pa.float64())],
                ["doc_id", "kind", "start", "end", "score"],
            )

    some = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    return some.mapInArrow(scan, f"doc_id {kind}, kind string, start bigint, end bigint, score double")
