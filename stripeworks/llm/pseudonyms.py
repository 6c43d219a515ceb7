"""Format-preserving pseudonyms for personal data.

What is found is validated (check digits, calendar, number plans), numbered
within the set of all values of its format, and sent through a keyed Feistel
permutation of that set: equal values get equal pseudonyms in every document,
different values different ones, and the pseudonym passes the same checks.

The key is the caller's: whoever has it can undo the pseudonyms.  Texts of any
length are read whole, ties go to the kind that comes first in ``KINDS``.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import map_texts

ROUNDS = 8


def permute(x: int, n: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network, walked until it lands inside."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    size = (half + 7) // 8
    wide = min(64, size)

    def mix(r: int, v: int) -> int:
        seed = tweak + bytes([r]) + v.to_bytes(size, "big")
        out = hashlib.blake2b(seed, digest_size=wide, key=key[:64]).digest()
        while len(out) < size:
            out += hashlib.blake2b(out + seed, digest_size=wide, key=key[:64]).digest()
        return int.from_bytes(out[:size], "big") & mask

    while True:
        a, b = x >> half, x & mask
        if inverse:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ mix(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ mix(r, b)
        x = a << half | b
        if x < n:
            return x


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SET_OF = {c: s for s in _SETS for c in s}
#: Longer values are moved in pieces of this many characters, as the numbers behind them get slow.
PIECE = 200


def _spell(text: str, sets: list[str], kind: str, key: bytes, inverse: bool) -> str:
    """``text`` with each character moved within its set: all together, or piece by piece, each keyed by the pseudonym of the piece before it."""
    if len(text) > PIECE:
        out, before = [], ""
        for at in range(0, len(text), PIECE):
            own = text[at : at + PIECE]
            tag = f"{kind}:{hashlib.blake2b(before.encode(), digest_size=8).hexdigest()}" if at else kind
            out.append(_spell(own, sets[at : at + PIECE], tag, key, inverse))
            before += own if inverse else out[-1]
            before = hashlib.blake2b(before.encode(), digest_size=16).hexdigest()
        return "".join(out)
    x, n = 0, 1
    for c, s in zip(text, sets):
        x = x * len(s) + s.index(c)
        n *= len(s)
    y = permute(x, n, key, f"{kind}:{n}".encode(), inverse)
    out = []
    for s in reversed(sets):
        y, d = divmod(y, len(s))
        out.append(s[d])
    return "".join(reversed(out))


def _in_place(text: str, kind: str, key: bytes, inverse: bool, sets: Callable[[str], str | None] = _SET_OF.get) -> str:
    """Letters and digits of ``text`` permuted within their sets; everything else stays."""
    at = [i for i, c in enumerate(text) if sets(c)]
    moved = _spell("".join(text[i] for i in at), [sets(text[i]) for i in at], kind, key, inverse)
    out = list(text)
    for i, c in zip(at, moved):
        out[i] = c
    return "".join(out)


def _fill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _card(m: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(m)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    head, body = d[0], d[1:-1]
    body = _spell(body, [_SETS[0]] * len(body), "card" + head, key, inverse)
    return _fill(m, head + body + str(-luhn(head + body + "0") % 10))


def _phone(m: str, key: bytes, inverse: bool) -> str | None:
    """Ten digits of the North American plan, with or without the leading 1; both codes start with 2 to 9.  Without any sign between them a word like "phone" must come before."""
    d = _digits(m)
    lead, d = d[:-10], d[-10:]
    if lead not in ("", "1") or d[0] < "2" or d[3] < "2":
        return None
    from_two = _SETS[0][2:]
    return _fill(m, lead + _spell(d, [from_two, *[_SETS[0]] * 2, from_two, *[_SETS[0]] * 6], "phone", key, inverse))


def _abroad(m: str, key: bytes, inverse: bool) -> str | None:
    """Any other number with a plus; its first two digits hold the country and stay."""
    d = _digits(m)
    if not 9 <= len(d) <= 15:
        return None
    return _fill(m, d[:2] + _spell(d[2:], [_SETS[0]] * (len(d) - 2), "abroad" + d[:2], key, inverse))


def _ipv4(m: str, key: bytes, inverse: bool) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    y = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ipv4", inverse)
    return ".".join(map(str, y.to_bytes(4, "big")))


def _ipv6(m: str, key: bytes, inverse: bool) -> str | None:
    """Written in full, as short forms would give the value away."""
    try:
        x = int(ipaddress.IPv6Address(m))
    except ValueError:
        return None
    if x < 1 << 16 or len(m) < 6:  # "::", "::1" and the like name nobody
        return None
    y = permute(x, 1 << 128, key, b"ipv6", inverse)
    return ipaddress.IPv6Address(y).exploded if y >= 1 << 16 else None


def _ssn(m: str, key: bytes, inverse: bool) -> str | None:
    a, b, c = (int(x) for x in m.split("-"))
    if a in (0, 666) or a > 899 or not b or not c:
        return None
    x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    y = permute(x, 898 * 99 * 9999, key, b"ssn", inverse)
    y, c = divmod(y, 9999)
    a, b = divmod(y, 99)
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


#: Length of the IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(m: str, key: bytes, inverse: bool) -> str | None:
    flat = m.replace(" ", "")
    if _mod97(flat) != 1:
        return None
    body = _in_place(flat[4:], "iban" + flat[:2], key, inverse)
    flat = flat[:2] + f"{98 - _mod97(flat[:2] + '00' + body):02d}" + body
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in m)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(m: str, key: bytes, inverse: bool) -> str | None:
    """Year first, day first with dots, or with slashes month first where that is a date, else day first."""
    mark = re.search(r"\D", m)[0]
    parts = [int(x) for x in m.split(mark)]
    orders = ["ymd"] if parts[0] > 31 else ["dmy"] if mark == "." else ["mdy", "dmy"]
    for order in orders:
        f = dict(zip(order, parts))
        try:
            day = datetime.date(f["y"], f["m"], f["d"]).toordinal()
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            return None
        # One permutation for all formats, so a date stays linked however it is written; the 1st to 12th are moved among
        # themselves, as only the rest can be told to come day first between slashes.
        early = f["d"] <= 12
        while True:
            day = _FIRST + permute(day - _FIRST, _LAST - _FIRST + 1, key, b"date" + bytes([early]), inverse)
            new = datetime.date.fromordinal(day)
            if (new.day <= 12) == early:
                break
        widths = [len(x) for x in m.split(mark)]
        values = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(f"{values[o]:0{w}d}" for o, w in zip(order, widths))
    return None


def _email(m: str, key: bytes, inverse: bool) -> str | None:
    local, _, domain = m.partition("@")
    return f"{_in_place(local, 'email@' + domain.lower(), key, inverse)}@{domain}"


def _key_id(m: str, key: bytes, inverse: bool) -> str | None:
    return m[:4] + _spell(m[4:], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * (len(m) - 4), "key-id", key, inverse)


def _hex(m: str, key: bytes, inverse: bool) -> str | None:
    if m.isdigit() or not (m == m.lower() or m == m.upper()):
        return None
    s = "0123456789abcdef" if m == m.lower() else "0123456789ABCDEF"
    return _spell(m, [s] * len(m), "hex", key, inverse)


def _secret(m: str, key: bytes, inverse: bool) -> str | None:
    """A word for a secret, a sign, and the value, which alone is moved."""
    head = re.match(r"(?s).*?[=:]\s*[\"']?", m)[0]
    body = m[len(head) :]
    if head[-1] not in "\"'" and not any(map(str.isdigit, body)) and not re.search("[a-z][A-Z]", body):
        return None  # words, not a value
    if re.fullmatch("[0-9a-f]{32,}", body) and not body.isdigit():
        return head + _hex(body, key, inverse)
    return head + _in_place(body, "secret", key, inverse)


#: Kinds in the order in which they are tried at a place: pattern, and what it becomes (None: not valid, left alone).
KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "secret": (r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)[A-Za-z0-9_+/\-]{8,}", _secret),
    "email": (r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}", _email),
    "key_id": (r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])", _key_id),
    "hex": (r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", _hex),
    "iban": ("(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{'|'.join(v.split())})" + r"\d{2}(?: ?[A-Z0-9]){%d}" % (k - 4) for k, v in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])", _iban),
    "ipv6": (r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.]*[0-9A-Za-z:])", _ipv6),
    "ipv4": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", _ipv4),
    "date": (r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/\-])", _date),
    "ssn": (r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _ssn),
    "phone": (r"(?i:(?<![a-z])(?:phone|tel|fax|mobile|cell|call)\b[.:]? {0,2})\d{10}(?!\d)|(?:(?<![\d+])\+?1[ .\-]?)?(?:\(\d{3}\) ?|(?<![\d.\-])\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)", _phone),
    "abroad": (r"(?<![\d+])\+[1-9](?:[ .\-]?\(?\d\)?){8,14}(?!\d)", _abroad),
    "card": (r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)", _card),
}


PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))
_EACH = {k: re.compile(p) for k, (p, _) in KINDS.items()}
#: A text without any of these has nothing to find.
HINT = re.compile(r"[0-9@=:]|A[KS]IA")


def rewrite(text: str | None, key: bytes, inverse: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of what they replaced."""
    if not text or not HINT.search(text):
        return text, []
    out, spans, end, at = [], [], 0, 0
    while m := PATTERN.search(text, at):
        new = None
        for kind in KINDS:
            if m[kind] is not None:
                new = KINDS[kind][1](m[kind], key, inverse)
                break
        if new is None:  # not valid as this kind: another may start here or further on
            other = _second(text, m, key, inverse)
            if other is None:
                at = m.start() + 1
                continue
            kind, stop, new = other
        else:
            stop = m.end()
        out += [text[end : m.start()], new]
        spans.append((kind, m.start(), stop - m.start()))
        end = at = stop
    return "".join([*out, text[end:]]), spans


def _second(text: str, m: re.Match, key: bytes, inverse: bool) -> tuple[str, int, str] | None:
    """The first later kind that is valid at the place where ``m`` was not."""
    for kind, pattern in list(_EACH.items())[list(KINDS).index(m.lastgroup) + 1 :]:
        if (n := pattern.match(text, m.start())) and (new := KINDS[kind][1](n[0], key, inverse)) is not None:
            return kind, n.end(), new
    return None


SPANS = "array<struct<kind:string,start:int,length:int>>"


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the rewritten ``text``, and ``found``: array of (kind, start, length) in the original, by code points.

    A null text stays null; texts without personal data come back as they
    are; repeated rows are treated alike; other columns are left to the caller.
    An empty table gives an empty result.
    """
    if not key:
        raise ValueError("pseudonyms need a key")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["t"]):
                new, spans = rewrite(t, key)
                rows.append((i, new, [{"kind": k, "start": s, "length": n} for k, s, n in spans]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "found"])

    return map_texts(docs, id_col, text, work, f"text string, found {SPANS}")
