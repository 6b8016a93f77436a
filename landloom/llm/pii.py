"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from math import isqrt
from secrets import token_hex

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landloom.session import read

ROUNDS = 8
#: Dates are permuted among these days.
FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
KINDS = ("email", "iban", "date", "card", "ssn", "phone", "ip")

#: The leftmost place counts, and there the first kind in this order whose value is valid.
PLACES = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?:(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})"
    r"|(?P<card>[0-9](?:[\x20-]?[0-9]){12,18})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
    r"|(?P<phone>\+[1-9](?:[\x20().-]{0,2}[0-9]){7,14}|\(?[2-9][0-9]{2}\)?[\x20.-]\x20?[2-9][0-9]{2}[.-][0-9]{4}))(?![A-Za-z0-9])"
)
#: Usual layouts of card numbers; in a run of several numbers they come before others.
CARD = re.compile(r"[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5}")
#: Lengths of IBANs by country.
IBAN = dict(
    re.findall(
        "([A-Z]{2})([0-9]{2})",
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 "
        "PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20",
    )
)
#: Country calling codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Digits of an international number with and without its country's code.
PHONE_MOST, SUBSCRIBER_LEAST = 15, 5
#: What any match holds; texts without it are left at once.
HINT = re.compile(r"@|[0-9][0-9 ().\-/]{6}")


def _round(key: bytes, tweak: str, k: int, half: int, size: int) -> int:
    width = (size.bit_length() + 71) // 8
    return int.from_bytes(hashlib.shake_256(b"%b|%b|%d|%d" % (key, tweak.encode(), k, half)).digest(width)) % size


def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The place of x in a keyed permutation of range(n); ``back`` inverts it. Results outside the range are permuted on."""
    if n < 2:
        return x
    side = isqrt(n - 1) + 1
    while True:
        left, right = divmod(x, side)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, k, left, side)) % side, left
            else:
                left, right = right, (left + _round(key, tweak, k, right, side)) % side
        x = left * side + right
        if x < n:
            return x


def _until(valid, x: int, n: int, key: bytes, tweak: str, back: bool) -> int:
    x = permute(x, n, key, tweak, back)
    while not valid(x):
        x = permute(x, n, key, tweak, back)
    return x


def _refill(layout: str, digits: str) -> str:
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), layout)


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _day(text: str) -> tuple[date, str] | None:
    """The day and how it is written; of d/m/y and m/d/y the first that is a date."""
    if text[4:5] == "-":
        parts, order = text.split("-"), ["ymd"]
    else:
        parts, order = re.split("[/.]", text), ["dmy", "mdy"]
    for o in order:
        try:
            day = date(*(int(parts[o.index(c)]) for c in "ymd"))
        except ValueError:
            continue
        if FIRST <= day.toordinal() <= LAST:
            return day, o
    return None


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str:
    """ASCII letters and digits permuted together, each staying upper case, lower case or digit; case is a matter of form."""
    sizes = [10 if c.isdigit() else 26 for c in text if c.isascii() and c.isalnum()]
    x, n = 0, 1
    for c, size in zip((c for c in text if c.isascii() and c.isalnum()), sizes):
        x, n = x * size + (int(c) if size == 10 else ord(c.lower()) - 97), n * size
    x = permute(x, n, key, f"{tweak}:{sizes}", back)
    out = []
    for size in reversed(sizes):
        x, v = divmod(x, size)
        out.append(str(v) if size == 10 else chr(97 + v))
    it = iter(reversed(out))
    return "".join((n.upper() if c.isupper() else n) if c.isascii() and c.isalnum() and (n := next(it)) else c for c in text)


@lru_cache(1 << 14)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value in the same form, or None if the value is no valid one of its kind."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        local, _, domain = text.partition("@")
        return f"{_mixed(local, key, kind, back)}@{domain}"
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        n = len(digits) - 1
        body = _until(bool, int(digits[:-1]), 10**n, key, f"card{n}", back)
        return _refill(text, f"{body:0{n}d}" + luhn_digit(f"{body:0{n}d}"))
    if kind == "ssn":
        fits = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
        return _refill(text, f"{_until(fits, int(digits), 10**9, key, kind, back):09d}") if fits(int(digits)) else None
    if kind == "phone":
        head = digits[: 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3] if text[0] == "+" else ""
        body = digits[len(head) :]
        if len(digits) > PHONE_MOST or len(body) < SUBSCRIBER_LEAST or head == "1" and len(body) != 10:
            return None
        nanp = lambda x: x // 10**9 >= 2 and x // 10**6 % 10 >= 2
        n = len(body)
        dialled = n == 10 and head in ("", "1") and nanp(int(body))
        # North American numbers share their permutation whether or not +1 is written.
        x = _until(nanp, int(body), 10**10, key, "phone1", back) if dialled else _until(lambda v: not (n == 10 and head == "1" and nanp(v)), int(body), 10**n, key, f"phone{head}:{n}", back)
        return _refill(text, f"{head}{x:0{n}d}")
    if kind == "ip":
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = permute(int.from_bytes(bytes(map(int, parts))), 2**32, key, kind, back)
        return ".".join(map(str, x.to_bytes(4)))
    if kind == "date":
        if not (found := _day(text)):
            return None
        day, order = found
        new = date.fromordinal(FIRST + permute(day.toordinal() - FIRST, LAST - FIRST + 1, key, kind, back))
        if order == "ymd":
            return new.isoformat()
        wide = {c: len(p) for c, p in zip(order, re.split("[/.]", text))}
        two = {c: f"{v:02d}" if wide[c] == 2 else str(v) for c, v in (("d", new.day), ("m", new.month))} | {"y": str(new.year)}
        return re.sub("[/.]", "{}", re.sub("[0-9]+", "%s", text)).replace("{}", text[wide[order[0]]]) % tuple(two[c] for c in order)
    if kind == "iban":
        bare = text.replace(" ", "")
        if _iban_number(bare[4:] + bare[:4]) % 97 != 1:
            return None
        body = _mixed(bare[4:], key, f"iban{bare[:2]}", back)
        it = iter(f"{bare[:2]}{98 - _iban_number(f'{body}{bare[:2]}00') % 97:02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)
    raise ValueError(kind)


def _ends(text: str, start: int, group: re.Pattern, least: int, most: int) -> list[int]:
    """Ends of groups from ``start`` on that leave so many characters without separators, and after which no letter or digit comes."""
    out, at, size = [], start, 0
    while m := group.match(text, at):
        size += len(m[1])
        if size > most:
            break
        at = m.end()
        if size >= least and not (at < len(text) and text[at].isascii() and text[at].isalnum()):
            out.append(at)
    return out


CARD_GROUP, IBAN_GROUP, PHONE_GROUP = re.compile(r"[\x20-]?([0-9]+)"), re.compile(r"\x20?([A-Z0-9]+)"), re.compile(r"[\x20().-]{0,2}([0-9]+)")
#: Where a number may begin within a run of them.
BORDER = re.compile(r"(?<=[\x20-])[0-9]")
IBAN_BORDER = re.compile(r"(?<=\x20)[A-Z]{2}[0-9]{2}")


def card_end(text: str, start: int, key: bytes, back: bool = False) -> int | None:
    """Where the card number ends that begins here, if one does: the shortest of a usual layout, else the longest unless a usual one begins within it."""
    valid = [e for e in _ends(text, start, CARD_GROUP, 13, 19) if pseudonym("card", text[start:e], key, back)]
    usual = [e for e in valid if CARD.fullmatch(text, start, e)]
    if usual or not valid:
        return usual[0] if usual else None
    for m in BORDER.finditer(text, start + 1, valid[-1]):
        if any(CARD.fullmatch(text, m.start(), e) and pseudonym("card", text[m.start() : e], key, back) for e in _ends(text, m.start(), CARD_GROUP, 13, 19)):
            return None
    return valid[-1]


def iban_end(text: str, start: int, end: int, key: bytes, back: bool = False) -> int | None:
    """Where the IBAN ends that begins here, if one does: at its country's length; of unknown countries at the last border,
    unless one of a known country begins within it."""

    def at_length(at: int) -> list[int]:
        long = int(IBAN.get(text[at : at + 2], 0))
        return [e for e in _ends(text, at, IBAN_GROUP, long, long) if pseudonym("iban", text[at:e], key, back)]

    if ends := at_length(start):
        return ends[0]
    if text[start : start + 2] in IBAN:
        return None
    others = [*_ends(text, start, IBAN_GROUP, 12, 34)[::-1], end]
    valid = next((e for e in others if pseudonym("iban", text[start:e], key, back)), None)
    return None if valid and any(at_length(m.start()) for m in IBAN_BORDER.finditer(text, start + 1, valid)) else valid


def phone_end(text: str, start: int, end: int, key: bytes, back: bool = False) -> int | None:
    """Where the phone number ends that begins here: at ``end``, or at the last border of digit groups up to which it is valid."""
    ends = [end] if text[start] != "+" else [end, *reversed(_ends(text, start + 1, PHONE_GROUP, 8, PHONE_MOST))]
    return next((e for e in ends if pseudonym("phone", text[start:e], key, back)), None)


def places(text: str, key: bytes, back: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of each valid value, from the left, without overlaps."""
    at = 0
    while m := PLACES.search(text, at):
        kind = m.lastgroup
        end = m.end()
        if kind == "card":
            end = card_end(text, m.start(), key, back)
        elif kind in ("iban", "phone"):
            end = (iban_end if kind == "iban" else phone_end)(text, m.start(), m.end(), key, back)
        if end and (new := pseudonym(kind, text[m.start() : end], key, back)):
            yield kind, m.start(), end, new
            at = end
        else:  # not valid as that kind: another may begin here, or inside
            other = next((o for o in KINDS[KINDS.index(kind) + 1 :] if o != "card" and (p := ONE[o].match(text, m.start())) and pseudonym(o, p[0], key, back)), None)
            if other:
                p = ONE[other].match(text, m.start())
                yield other, p.start(), p.end(), pseudonym(other, p[0], key, back)
                at = p.end()
            elif kind in ("email", "iban"):
                at = m.start() + 1
            else:  # go on at the next number of this run, or behind it, so that no part of a longer number is taken
                inside = (b.start() for b in BORDER.finditer(text, m.start() + 1, m.end())) if kind == "card" else ()
                at = next((b for b in inside if text[b - 1] == " " or card_end(text, b, key, back)), m.end())


def _alone(kind: str) -> re.Pattern:
    """The pattern of one kind, cut out of PLACES."""
    text, start = PLACES.pattern, PLACES.pattern.index(f"(?P<{kind}>")
    depth, i, in_class = 0, start, False
    while True:
        c = text[i]
        if c == "\\":
            i += 1
        elif c in "[]":
            in_class = c == "["
        elif not in_class and c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return re.compile(text[start : i + 1] + "(?![A-Za-z0-9])")
        i += 1


ONE = {kind: _alone(kind) for kind in KINDS}


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    """The text with valid values replaced by their pseudonyms, and the kinds of these."""
    if not HINT.search(text):
        return text, []
    out, kinds, done = [], [], 0
    for kind, start, end, new in places(text, key, back):
        out += [text[done:start], new]
        kinds.append(kind)
        done = end
    return "".join([*out, text[done:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_<kind>...) of every row: its whole text with personal numbers, dates and addresses replaced.

    Card numbers (Luhn), IBANs (mod 97), social security numbers, IPv4 addresses, phone numbers, calendar dates and the local parts of mail
    addresses are permuted among the values of the same form, by a Feistel network whose rounds are keyed: equal values get equal pseudonyms in all
    documents, different ones stay different, and the key's holder can invert them. What fails its check (a number
    with a wrong check digit, an IBAN that isn't as long as its country's, a phone number of over 15 digits, 31 February) is no such value and stays. A phone number's
    country code, a card's check digit and an IBAN's country and check digits follow from the form. Null texts stay null with counts of 0; nothing else of a text changes;
    rows may repeat and ids may be null; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [f"n_{k}" for k in KINDS]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, []) if t is None else replace(t, key) for t in b.column(1).to_pylist()]
            counts = [pa.array([ks.count(k) for _, ks in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), *counts], ["doc_id", "text", *columns])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, text string, " + ", ".join(f"{c} long" for c in columns))


def run_key(spark: SparkSession) -> bytes:
    """The key of the setting landloom.pii.key; where that is unset, one drawn at random for this session, which nobody can invert with afterwards."""
    if not spark.conf.get("landloom.pii.key", None):
        spark.conf.set("landloom.pii.key", token_hex(32))
    return spark.conf.get("landloom.pii.key").encode()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the session's key. To link runs, or to invert pseudonyms, set landloom.pii.key."""
    return pseudonymise(read(spark, sf_dir, "documents"), run_key(spark))
