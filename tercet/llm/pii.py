"""Format-preserving pseudonyms for personal data and secrets.

Values that pass their kind's validation are replaced by others of the same format: digits stay
digits, a letter stays a letter of its case, separators stay, a card number still passes its checksum and a date
is still a date. A value's pseudonym depends on the key and the value only, so equal values have equal
pseudonyms in all documents, whatever task meets them, and no table of them is kept or shuffled. Who has the key
can turn them back, so there is no key by default.

A value is a number x below N, the count of its format's values. A balanced Feistel network over the least even
number of bits that hold N, walked until it falls below N again, is a keyed permutation E of them. The pseudonym is
E(E'(x) + 1 mod N), E' being the inverse: this too is a keyed permutation, and it leaves no value as it is. Where
not every number of the format is valid, it is applied again until the outcome is.

Kinds: e-mail addresses, international and North American telephone numbers, payment cards (Luhn), IBANs (mod 97), social security numbers,
IPv4 and IPv6 addresses, dates (ISO and day/month/year in either order), access keys, JSON web tokens, and what is assigned to a password, secret, token or key.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
KINDS = ("secret", "access", "jwt", "email", "iban", "ipv6", "ip", "date", "ssn", "phone", "card")
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Letters beyond ASCII are permuted among themselves.
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
#: Dates are permuted among the days of these years.
YEARS = (1900, 2099)

_DATE = r"(?P<date>(?<![\d./-])(?:(?:19|20)\d\d(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)(?:19|20)\d\d)(?![\d/-]|\.\d))"
FOUND = re.compile(
    r"(?P<secret>(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\W{0,3}?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[^\s\"']{7,}[A-Za-z0-9+/_-]))"
    r"|(?P<access>(?<![A-Za-z0-9])(?i:AKIA|ASIA)[A-Za-z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?P<jwt>(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){1,2}(?![A-Za-z0-9_-]))"
    r"|(?P<email>(?<![\w.+\u0080-\uffff-])[\w.+\u00a1-\uffff-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Za-z]{2}\d\d(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,37}::)[0-9A-Fa-f:]{3,39})(?![\w:]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|" + _DATE + r"|(?P<ssn>(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d)|(?<![\d(.-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?!\d))",
    re.ASCII,
)
#: Every value but a secret has one of these, and no more than GAP other characters between two of them or before the first or behind the last.
ANCHORS = re.compile(r"[\d@](?:[^\d@]{0,70}[\d@])*", re.ASCII)
GAP = 80
#: Characters of a secret that are permuted at once.
PIECE = 128
#: A text with one of these may hold a secret.
KEYWORDS = ("passw", "pwd", "secret", "token", "key", "akia", "asia", "eyj")


class Feistel:
    """A keyed permutation of the numbers below n."""

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.n = n
        self.half = max(1, -(-(n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.width = -(-self.half // 8)
        self.seed = hashlib.blake2b(f"{tweak}|{n}".encode(), key=hashlib.sha256(key).digest())

    def _round(self, i: int, x: int) -> int:
        h = self.seed.copy()
        h.update(bytes([i]) + x.to_bytes(self.width, "little"))
        return int.from_bytes(h.digest(), "little") & self.mask

    def _once(self, x: int, order: range) -> int:
        a, b = (x >> self.half, x & self.mask) if order.step > 0 else (x & self.mask, x >> self.half)
        for i in order:
            a, b = b, a ^ self._round(i, b)
        return a << self.half | b if order.step > 0 else b << self.half | a

    def encrypt(self, x: int) -> int:
        while (x := self._once(x, range(ROUNDS))) >= self.n:
            pass
        return x

    def decrypt(self, x: int) -> int:
        while (x := self._once(x, range(ROUNDS - 1, -1, -1))) >= self.n:
            pass
        return x

    def pseudonym(self, x: int) -> int:
        return self.encrypt((self.decrypt(x) + 1) % self.n) if self.n > 1 else x

    def original(self, y: int) -> int:
        return self.encrypt((self.decrypt(y) - 1) % self.n) if self.n > 1 else y


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Pseudonyms:
    """The pseudonyms under a key. With `back`, the originals of pseudonyms."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = key, back
        self.networks: dict[tuple[str, int], Feistel] = {}
        self.known: dict[tuple[str, str], str] = {}

    def permuted(self, kind: str, x: int, n: int) -> int:
        if (kind, n) not in self.networks:
            if len(self.networks) > 10_000:
                self.networks.clear()
            self.networks[kind, n] = Feistel(self.key, kind, n)
        f = self.networks[kind, n]
        return f.original(x) if self.back else f.pseudonym(x)

    def characters(self, kind: str, text: str, hexadecimal: bool = False, valid: Callable[[str], bool] = lambda _: True) -> str:
        """text with its letters and digits permuted, in their places and cases."""
        places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum() or c.lower() in LATIN]
        sets = [HEX if hexadecimal else DIGITS if text[i] in DIGITS else LETTERS if text[i].isascii() else LATIN for i in places]
        x, n = 0, 1
        for i, own in zip(places, sets):
            x, n = x * len(own) + own.index(text[i].lower()), n * len(own)
        pattern = "".join("h" if hexadecimal else "d" if s is DIGITS else "a" if s is LETTERS else "l" for s in sets)
        while True:
            x = self.permuted(f"{kind}|{pattern}", x, n)
            out, y = list(text), x
            upper = not any(c.islower() for c in text) if hexadecimal else None
            for i, own in zip(reversed(places), reversed(sets)):
                y, at = divmod(y, len(own))
                out[i] = own[at].upper() if (upper if hexadecimal else text[i].isupper()) else own[at]
            if valid(new := "".join(out)):
                return new

    @staticmethod
    def put(text: str, chars: str) -> str:
        """text with its letters and digits replaced, one by one."""
        it = iter(chars)
        return "".join(next(it) if c.isascii() and c.isalnum() else c for c in text)

    def secret(self, text: str) -> str | None:
        if not any(c.isascii() and c.isalnum() for c in text):
            return None
        hexadecimal = bool(re.fullmatch(r"(?:[0-9a-f]{8,}|[0-9A-F]{8,})", text))
        return self.by_pieces("secret", text, hexadecimal)

    def by_pieces(self, kind: str, text: str, hexadecimal: bool = False) -> str:
        """A network's rounds reach 512 bits: longer values are permuted by pieces."""
        return "".join(self.characters(f"{kind}{i or ''}", text[i : i + PIECE], hexadecimal=hexadecimal) for i in range(0, len(text), PIECE))

    def jwt(self, text: str) -> str:
        return text[:3] + self.by_pieces("jwt", text[3:])

    def access(self, text: str) -> str:
        return text[:4] + self.characters("access", text[4:])

    def email(self, text: str) -> str:
        local, _, host = text.partition("@")
        if not any(c.isascii() and c.isalnum() or c.lower() in LATIN for c in local):
            return f"{local}@{self.characters('email', host)}"
        return f"{self.characters('email@' + host.lower(), local)}@{host}"

    def iban(self, text: str) -> str | None:
        bare = text.replace(" ", "").upper()
        if not 15 <= len(bare) <= 34 or not iban(bare):
            return None
        own = self.characters("iban" + bare[:2], bare[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in own + bare[:2] + "00")) % 97
        new = f"{bare[:2]}{check:02d}{own}"
        return self.put(text, "".join(n.lower() if o.islower() else n for n, o in zip(new, text.replace(" ", ""))))

    def ipv6(self, text: str) -> str | None:
        def digit(s: str) -> bool:
            return any(c.isdigit() for c in s)

        if "::" not in text:
            return self.characters("ipv6", text, hexadecimal=True)
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return self.characters("ipv6", text, hexadecimal=True, valid=digit) if digit(text) else None

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.permuted("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", text).groups()
        first, base = len(a) == 4, datetime.date(YEARS[0], 1, 1).toordinal()
        n = datetime.date(YEARS[1], 12, 31).toordinal() - base + 1
        order = "ymd" if first else "dmy" if int(b) <= 12 else "mdy"  # day before month where both are possible
        field = dict(zip(order, map(int, (a, b, c))))
        try:
            x = datetime.date(field["y"], field["m"], field["d"]).toordinal() - base
        except ValueError:
            return None
        ordered = order
        while True:
            x = self.permuted("date", x, n)
            day = datetime.date.fromordinal(x + base)
            parts = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
            new = sep.join(parts[k] for k in ordered)
            if order != "mdy" or day.day > 12:  # else it would be read day first
                return new

    def ssn(self, text: str) -> str | None:
        def valid(s: str) -> bool:
            return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"

        return self.characters("ssn", text, valid=valid) if valid(text) else None

    def phone(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        prefix = re.match(r"\+(\d{1,3})(?=\D)", text)
        north = len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and text[0] != "+"
        if not 8 <= len(digits) <= 15:
            return None
        if north:
            own = digits[-10:]
            valid = lambda s: s[0] in "23456789" and s[3] in "23456789"
            if not valid(own):
                if text[0] != "+" and "(" not in text:
                    return None
                valid = lambda s: s[0] not in "23456789" or s[3] not in "23456789"
            return self.put(text, digits[:-10] + self.characters("north", own, valid=valid))
        country = prefix.group(1) if prefix else digits[:2]
        return self.put(text, country + self.characters("phone" + country, digits[len(country) :]))

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if not luhn(digits) or len(set(digits)) == 1:
            return None

        def checked(payload: str) -> str:
            return next(payload + c for c in DIGITS if luhn(payload + c))

        payload = self.characters("card", digits[:-1], valid=lambda p: len(set(checked(p))) > 1)
        return self.put(text, checked(payload))

    def of(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None for what isn't valid."""
        if (kind, text) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, text] = getattr(self, kind)(text)
        return self.known[kind, text]

    def replaced(self, text: str | None) -> tuple[str | None, int]:
        """text with pseudonyms, and the number of values replaced."""
        out, at, n = [], 0, 0
        for start, end in self.regions(text or ""):
            pos = max(start, at)
            while m := FOUND.search(text, pos, end):
                kind = next(k for k in KINDS if m[k] is not None)
                a, b = m.span("value") if kind == "secret" else m.span(kind)
                new = self.of(kind, text[a:b])
                if new is None:  # not valid: what begins within it is looked at
                    pos = a + 1
                    continue
                out += [text[at:a], new]
                at = pos = b
                n += 1
        return "".join([*out, text[at:]]) if n else text, n

    @staticmethod
    def regions(text: str) -> Iterator[tuple[int, int]]:
        """Where values may be."""
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            yield 0, len(text)
            return
        for m in ANCHORS.finditer(text):
            start, end = max(0, m.start() - GAP), min(len(text), m.end() + GAP)
            yield start, end


def pseudonymise(docs: DataFrame, *, key: bytes, back: bool = False, column: str = "text", count: str = "n_replaced") -> DataFrame:
    """docs with pseudonyms in `column`, and the column `count` of values replaced (one of that name is replaced).

    Every row stays. A null text stays null and an empty one empty, with a count of 0; ids, other columns and repeated rows
    are as they were. Texts keep their lengths, but for addresses and dates, whose numbers may have more or fewer digits; a column n_chars
    follows the text's length. With `back` and the same key, values come back. An empty table gives an empty table. No shuffle.
    """
    own = docs.drop(count) if count in docs.columns else docs
    columns = own.columns
    has_length = dict(own.dtypes).get("n_chars") in ("int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            found = [names.replaced(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            arrays = {column: pa.array([t for t, _ in found], pa.string())}
            if has_length:
                arrays["n_chars"] = pa.array([None if t is None else len(t) for t, _ in found], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([*(arrays.get(f.name, c) for f, c in zip(batch.schema, batch.columns)), pa.array([n for _, n in found], pa.int64())], names=[*columns, count])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(count, T.LongType())]))


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_replaced) for each row of docs."""
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key=key)
