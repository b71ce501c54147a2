"""Personal data replaced by format-preserving Feistel pseudonyms.

Validated values are found in whole texts and replaced by a keyed permutation
within their format: a card number becomes another card number with a right
check digit, a date another date in the same notation, an e-mail address one
with as many letters and digits, and so on.  Equal values (in whatever
spacing or notation of a kind) get equal pseudonyms in all documents, and the
holder of the key can map them back (``reverse``).

The permutation is a Feistel network of ``ROUNDS`` rounds on the mixed-radix
number of the value, over the smallest a * b that holds the format's N values,
with keyed blake2b as round function; results outside the format walk on
through the cycle.

Kinds: e-mail addresses, payment cards (Luhn), IBANs (mod 97), telephone
numbers, US social security numbers, IPv4 and global or unique local IPv6
addresses, dates, access keys, tokens of known services (``TOKENS``, and signed
web tokens eyJ...), private key blocks and assigned secrets (password=...,
token = "...").  IPv6 addresses come out, and back, in their shortest notation.
Not found: telephone numbers without + that are not in a US form, names, postal
addresses, and secrets that nothing marks as such.

The key comes from the Spark setting ``KEY_SETTING``; without it each application
makes a random one that nobody holds.

E-mail addresses begin at the start of their run of letters, digits, combining
marks and ``._%+-``, in any script; leading punctuation is left out, and so is a
leading run of a script written without spaces (Chinese, Japanese, Korean, Thai,
Lao, Khmer, Burmese) before Latin letters or digits, which is taken for text.
Letters outside ASCII become letters of their own block of Unicode, cased ones
among each other; combining marks and the top domain stay.

Dates of 1900 to 2099: year-month-day with - or / (one or two digits a part),
year.month.day (two digits), day-month-year with . / or -, read as month-day-year
where it is no date otherwise, and English month names (March 25, 1990; 25th of
Mar. 1990; 25-Mar-1990).  All notations of a day have the same pseudonym: days
1-9, 10-12 and later ones, and months 1-9 and 10-12, are permuted among
themselves, so that a pseudonym is read in its notation's order and width again.
Reversed, a month's name may come back in its other form (Sept as Sep, and May,
which is both, as a full name); the day is the same.

Defined cases: NULL stays NULL with no findings; empty texts stay empty.
Values that fail their check (a wrong check digit, a 31st of February) are left
alone.  Overlapping findings: the first, at equal start the earlier kind of
``KINDS``.  Other columns pass unchanged, in whatever order and number; one
called like an added column (n_found, found, key_id) is replaced.
"""

from __future__ import annotations

import os
import re
import unicodedata
from calendar import monthrange
from datetime import date
from functools import cache
from hashlib import blake2b
from ipaddress import IPv6Address
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import named, with_computed

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
# Lengths of account numbers (IBAN) by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
                "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
                "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
# What access tokens of known services begin with.
TOKENS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "hf_", "pypi-", "dop_v1_",
          "sk_live_", "sk_test_", "rk_live_", "pk_live_", "sk-", "AIza", "ya29.", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "SG.")
# The Spark setting that holds the key.
KEY_SETTING = "spark.paddock.pseudonym.key"
_SESSION_KEYS: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key of the setting ``KEY_SETTING``.

    Where it is unset, a random key of this application, which is written nowhere:
    values are linked within the application's runs, and nobody can map them back."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()
    return _SESSION_KEYS.setdefault(spark.sparkContext.applicationId, os.urandom(32))


def key_id(key: bytes) -> str:
    """Tells which key made a pseudonym, without telling the key."""
    return blake2b(b"key id", key=key[:64], digest_size=6).hexdigest()


class Feistel:
    """Keyed permutations of 0 .. n-1, one for each kind and n."""

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _step(self, value: int, n: int, kind: str, back: bool) -> int:
        b = isqrt(n - 1) + 1
        a = (n + b - 1) // b
        left, right = divmod(value, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            of = right if r % 2 == 0 else left
            size = (n.bit_length() + 7) // 8 + 8
            data = f"{kind}:{n}:{r}:{of}".encode()
            word = b"".join(blake2b(data + bytes([i]), key=self.key, digest_size=64).digest() for i in range((size + 63) // 64))
            number = int.from_bytes(word[:size], "big")
            if r % 2 == 0:
                left = (left + sign * number) % a
            else:
                right = (right + sign * number) % b
        return left * b + right

    def permute(self, value: int, n: int, kind: str, back: bool = False) -> int:
        if n < 2:
            return value
        value = self._step(value, n, kind, back)
        while value >= n:
            value = self._step(value, n, kind, back)
        return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _cased(c: str) -> bool:
    """Upper and lower case are one letter each, in one block."""
    low, up = c.lower(), c.upper()
    return len(low) == len(up) == 1 and low != up and low.upper() == up and up.lower() == low and c in (low, up) and ord(low) >> 7 == ord(up) >> 7


@cache
def alphabet(c: str) -> str:
    """The lower-case signs among which ``c`` is replaced: for a letter or digit its like in the
    same 128 code points of Unicode (cased letters together, others by category), else itself."""
    if not c.isalnum():
        return c
    block = [chr(i) for i in range(ord(c) >> 7 << 7, (ord(c) >> 7 << 7) + 128)]
    if _cased(c):
        return "".join(x for x in block if _cased(x) and x == x.lower() and (ord(c) > 127 or x.isascii()))
    kind = unicodedata.category(c)
    return "".join(x for x in block if x.isalnum() and not _cased(x) and unicodedata.category(x) == kind)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _digits(self, digits: str, kind: str, back: bool, first: int = 0) -> str:
        """Numbers whose first digit is at least ``first`` among themselves, and so the others."""
        low, value = first * 10 ** (len(digits) - 1), int(digits)
        if value < low:
            new = self.feistel.permute(value, low, f"{kind}{len(digits)}<", back)
        else:
            new = low + self.feistel.permute(value - low, 10 ** len(digits) - low, f"{kind}{len(digits)}", back)
        return str(new).zfill(len(digits))

    def _signs(self, text: str, kind: str, back: bool) -> str:
        """Letters for letters and digits for digits of the same script; case and other signs stay."""
        value, n = 0, 1
        among = [alphabet(c) for c in text]
        for c, signs in zip(text, among, strict=True):
            value = value * len(signs) + signs.index(c.lower() if _cased(c) else c)
            n *= len(signs)
        shape = "".join(signs[0] for signs in among)
        value = self.feistel.permute(value, n, f"{kind}{shape}", back)
        out = []
        for c, signs in zip(reversed(text), reversed(among), strict=True):
            value, d = divmod(value, len(signs))
            out.append(signs[d].upper() if _cased(c) and c.isupper() else signs[d])
        return "".join(reversed(out))

    def email(self, m: re.Match, back: bool) -> str | None:
        name, _, host = m["address"].rpartition("@")
        stem, dot, top = host.rpartition(".")
        return f"{self._signs(name, 'email', back)}@{self._signs(stem, 'host', back)}{dot}{top}"

    def iban(self, m: re.Match, back: bool) -> str | None:
        whole = m[0]
        length = IBAN_LENGTHS.get(whole[:2])
        if length:
            # What follows a number of known length is not part of it.
            ends = [i + 1 for i, c in enumerate(whole) if not c.isspace()]
            if len(ends) < length or len(ends) > length and whole[ends[length - 1]] != " ":
                return None
            whole = whole[:ends[length - 1]]
        plain = re.sub(r"\s", "", whole)
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._signs(plain[4:], "iban" + plain[:2], back)
        it = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
        return "".join(c if c.isspace() else next(it) for c in whole)

    def card(self, m: re.Match, back: bool) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self._digits(digits[:-1], "card", back, first=1)
        return refill(m[0], body + luhn_digit(body))

    def phone(self, m: re.Match, back: bool) -> str | None:
        return m["country"] + refill(m["rest"], self._digits(re.sub(r"\D", "", m["rest"]), "phone", back, first=2))

    def ssn(self, m: re.Match, back: bool) -> str | None:
        if m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0].endswith("0000"):
            return None
        # 898 areas (001-899 without 666), 99 groups, 9999 serials.
        area, group, serial = (int(x) for x in m[0].split("-"))
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value = self.feistel.permute(value, 898 * 99 * 9999, "ssn", back)
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, m: re.Match, back: bool) -> str | None:
        parts = [int(x) for x in m[0].split(".")]
        if max(parts) > 255 or not 1 <= parts[0] <= 223 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
            return None
        value = ((parts[0] - 1) << 24) + (parts[1] << 16) + (parts[2] << 8) + parts[3]
        value = self.feistel.permute(value, 223 << 24, "ip", back) + (1 << 24)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def day(self, m: re.Match, back: bool) -> str | None:
        at = {k: m.span(k) for k in ("year", "month", "day")}
        name = m["month"] if m["month"].isalpha() else ""
        y, d = int(m["year"]), int(m["day"])
        mo = [x[:3].lower() for x in MONTHS].index(name[:3].lower()) + 1 if name else int(m["month"])
        if not name and mo > 12 and at["day"] < at["month"]:
            # Month first.
            mo, d, at["month"], at["day"] = d, mo, at["day"], at["month"]
        if not (1900 <= y <= 2099 and 1 <= mo <= 12 and 1 <= d <= monthrange(y, mo)[1]):
            return None
        kind = lambda x: (x.month > 9, (x.day > 9) + (x.day > 12))
        old, n = date(y, mo, d), LAST_DAY - FIRST_DAY + 1
        new = date.fromordinal(FIRST_DAY + self.feistel.permute(old.toordinal() - FIRST_DAY, n, "day", back))
        while kind(new) != kind(old):
            new = date.fromordinal(FIRST_DAY + self.feistel.permute(new.toordinal() - FIRST_DAY, n, "day", back))
        parts = {k: str(getattr(new, k)).zfill(end - begin) for k, (begin, end) in at.items()}
        if name:
            word = MONTHS[new.month - 1]
            word = word if name.lower() in (x.lower() for x in MONTHS) else word[:3]
            parts["month"] = word.upper() if name.isupper() else word.lower() if name.islower() else word
            if m["th"]:
                th = "th" if 11 <= new.day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
                parts["th"], at["th"] = th.upper() if m["th"].isupper() else th, m.span("th")
        text = m[0]
        for k, (begin, end) in sorted(at.items(), key=lambda x: -x[1][0]):
            text = text[:begin - m.start()] + parts[k] + text[end - m.start():]
        return text

    def key(self, m: re.Match, back: bool) -> str | None:
        return m[0][:4] + self._signs(m[0][4:], "key" + m[0][:4], back)

    def token(self, m: re.Match, back: bool) -> str | None:
        if not any(c.isdigit() for c in m["value"]):
            return None
        # The beginning of a web token's second part stays, as that of the first: the pseudonym is found again by both.
        head, begin, rest = m["value"].partition(".eyJ")
        new = self._signs(head + rest, "token" + m["before"], back)
        return m["before"] + new[:len(head)] + begin + new[len(head):]

    def private_key(self, m: re.Match, back: bool) -> str | None:
        lines = re.split(r"(\s+)", m["body"])
        return m["before"] + "".join(x if x.isspace() or not x else self._signs(x, "private", back) for x in lines) + m["after"]

    def ip6(self, m: re.Match, back: bool) -> str | None:
        try:
            old = int(IPv6Address(m[0]))
        except ValueError:
            return None
        for base, bits in ((0x2000 << 112, 125), (0xFC00 << 112, 121)):
            if old >> bits == base >> bits:
                return str(IPv6Address(base + self.feistel.permute(old - base, 1 << bits, f"ip6/{bits}", back)))
        return None

    def secret(self, m: re.Match, back: bool) -> str | None:
        return m["before"] + self._signs(m["value"], "secret", back)


_MONTH = "|".join([*MONTHS, "Sept", *(x[:3] for x in MONTHS)])
_MARKS = "".join(chr(i) for i in range(0x300, 0x3100) if unicodedata.category(chr(i)) in ("Mn", "Mc"))
_RUN_HOST = rf"\w{_MARKS}-"
_RUN = rf"\w{_MARKS}.%+-"
# Scripts written without spaces, in whole blocks of ``alphabet``.
_UNSPACED = "\u0e00-\u0eff\u1000-\u107f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7ff"
# The quantifiers with a plus never give back, and each pattern begins at the start of a run: time is linear in the text.
# Kind, what a text must hold one of (signs or strings), pattern.
KINDS: tuple[tuple[str, str | tuple[str, ...], re.Pattern], ...] = (
    ("email", "@", re.compile(
        rf"(?<![{_RUN}])[._%+-]*+(?:[{_UNSPACED}]++[._%+-]*+(?=[A-Za-z0-9]))?+(?P<address>[{_RUN}]++@"
        rf"(?:(?:[{_RUN_HOST}]++\.)+[A-Za-z]{{2,24}}+(?![A-Za-z0-9-])|(?:[{_RUN_HOST}]++\.)+(?:xn--[A-Za-z0-9-]{{2,59}}+|[^\W\d_A-Za-z]{{2,24}}+)(?![\w-])))")),
    ("secret", "=:", re.compile(r"(?P<before>\b(?:password|passwd|pwd|secret|token|api_?key|access_?key)\b[\"']?\s?[=:]\s?[\"']?)(?P<value>[^\s\"',;]{6,})", re.I)),
    ("key", "A", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("token", TOKENS, re.compile(rf"(?<![A-Za-z0-9_-])(?P<before>{'|'.join(map(re.escape, TOKENS))})(?P<value>[A-Za-z0-9_-]{{16,255}}+)(?![A-Za-z0-9_-])")),
    ("token", ("eyJ",), re.compile(r"(?<![A-Za-z0-9_.-])(?P<before>eyJ)(?P<value>[A-Za-z0-9_-]{8,2000}+\.eyJ[A-Za-z0-9_-]{8,4000}+\.[A-Za-z0-9_-]{16,1000}+)(?![A-Za-z0-9_.-])")),
    ("private_key", ("PRIVATE KEY-----",), re.compile(r"(?P<before>-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----)(?P<body>[A-Za-z0-9+/=\s]{40,20000}+)(?P<after>-----END )")),
    ("ip6", ":", re.compile(r"(?<![\w:.])(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2})(?::[0-9a-f]{0,4}){2,7}(?![\w:]|\.[0-9])", re.I)),
    ("iban", "0123456789", re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b")),
    ("day", "0123456789", re.compile(r"(?<![\w.-])(?P<year>[0-9]{4})-(?P<month>[0-9]{1,2})-(?P<day>[0-9]{1,2})(?:(?=T[0-9]{2}:)|(?![\w-]))")),
    ("day", "0123456789", re.compile(r"(?<![\w./])(?P<year>[0-9]{4})/(?P<month>[0-9]{1,2})/(?P<day>[0-9]{1,2})(?![\w/])")),
    ("day", "0123456789", re.compile(r"(?<![\w./-])(?P<year>[0-9]{4})\.(?P<month>[0-9]{2})\.(?P<day>[0-9]{2})(?![\w/]|\.[0-9])")),
    ("day", "0123456789", re.compile(r"(?<![\w./])(?P<day>[0-9]{1,2})(?P<s>[./])(?P<month>[0-9]{1,2})(?P=s)(?P<year>[0-9]{4})(?![\w/])")),
    ("day", "0123456789", re.compile(r"(?<![\w./-])(?P<day>[0-9]{1,2})-(?P<month>[0-9]{1,2})-(?P<year>[0-9]{4})(?![\w-])")),
    ("day", "0123456789", re.compile(rf"(?<![\w-])(?P<month>{_MONTH})\.?(?:\s{{1,2}}|-)(?P<day>[0-9]{{1,2}})(?P<th>st|nd|rd|th)?(?:\s?,\s{{0,2}}|\s{{1,2}}|-)(?P<year>[0-9]{{4}})(?![\w-])", re.I)),
    ("day", "0123456789", re.compile(rf"(?<![\w.-])(?P<day>[0-9]{{1,2}})(?P<th>st|nd|rd|th)?(?:\s{{1,2}}(?:of\s{{1,2}})?|-)(?P<month>{_MONTH})(?:\.?,?\s{{1,2}}|-)(?P<year>[0-9]{{4}})(?![\w-])", re.I)),
    ("ip", "0123456789", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])")),
    ("ssn", "0123456789", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("card", "0123456789", re.compile(r"(?<!\w)(?<![0-9][.,-])[1-9][0-9]{12,18}(?![0-9A-Za-z])(?![.,-][0-9])")),
    ("card", "0123456789", re.compile(r"(?<![\w-])(?<![0-9][.,])[1-9][0-9]{3}(?P<s>[ -])(?:[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}|[0-9]{6}(?P=s)[0-9]{5})(?![0-9A-Za-z])")),
    ("phone", "0123456789", re.compile(r"(?<![\w+])(?P<country>\+1[ .-]?)(?P<rest>(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4})(?![0-9A-Za-z])")),
    ("phone", "0123456789", re.compile(r"(?<![\w+])(?P<country>\+[0-9]{1,3}[ .-]?)(?P<rest>(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4})(?![\w-])")),
    ("phone", "0123456789", re.compile(r"(?<![\w+(])(?P<country>)(?P<rest>(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4})(?![\w-])")),
)
_DIGIT = re.compile("[0-9]")


def rewrite(text: str, pseudonyms: Pseudonyms, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its findings replaced; (kind, begin, end) in the old text."""
    digits = _DIGIT.search(text) is not None
    found = []
    for rank, (kind, marks, pattern) in enumerate(KINDS):
        if marks[0] == "0" and not digits or not any(c in text for c in marks):
            continue
        for m in pattern.finditer(text):
            found.append((m.start("address" if kind == "email" else 0), rank, m.end(), kind, m))
    found.sort(key=lambda f: f[:3])
    parts, spans, at = [], [], 0
    for begin, _, end, kind, m in found:
        if begin >= at and (new := getattr(pseudonyms, kind)(m, back)) is not None:
            if kind == "iban":              # may be shorter than what its pattern took
                end = begin + len(new)
            parts += [text[at:begin], new]
            spans.append((kind, begin, end))
            at = end
    return "".join([*parts, text[at:]]) if spans else text, spans


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with ``text`` rewritten, ``n_found``, ``found`` (kind, begin,
    end: code points of the old text) and ``key_id`` added.  One narrow pass."""

    def run(texts: list[str | None]) -> list:
        done = [rewrite(t, Pseudonyms(key)) if t else (t, []) for t in texts]
        return [[t for t, _ in done], [len(s) for _, s in done], [[{"kind": k, "begin": a, "end": b} for k, a, b in s] for _, s in done]]

    added = ("n_found", "found", "key_id")
    keep = [c for c in docs.columns if c not in ("text", *added)]
    out = with_computed(docs, keep, "text", run, "text string, n_found long, found array<struct<kind:string,begin:bigint,end:bigint>>")
    return out.select(*[named(c) for c in docs.columns if c not in added], "n_found", "found", F.lit(key_id(key)).alias("key_id"))


def rewritten(docs: DataFrame, key: bytes) -> DataFrame:
    """The columns of ``docs``, ``text`` with pseudonyms."""

    def run(texts: list[str | None]) -> list:
        return [[rewrite(t, Pseudonyms(key))[0] if t else t for t in texts]]

    keep = [c for c in docs.columns if c != "text"]
    return with_computed(docs, keep, "text", run, "text string").select(*map(named, docs.columns))


def reverse(text: str, key: bytes) -> str:
    """The old text of a rewritten one (formats keep their places)."""
    return rewrite(text, Pseudonyms(key), back=True)[0]
