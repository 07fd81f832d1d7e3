"""Personal data: validated values are replaced by format-preserving pseudonyms of a keyed Feistel permutation.

A value is found by shape, validated (Luhn for cards, mod 97 for IBANs, ranges for phones, SSNs and IPv4 addresses, the calendar for
dates) and mapped to a number in the mixed radix of its format; the permutation of that range gives another valid value of the same
shape and length, with its check digits made anew. Equal values get equal pseudonyms in all documents, whatever their separators, and
whoever has the key can go back. What looks like a number but fails validation stays, as does a dotted number that follows the word version. Of digits in a row the shortest valid card at a
separator is taken, and the search goes on behind it. Dates with one-digit fields or short names of months stay within that form.

Cases: a null text stays null, an empty one empty; texts without digits or @ aren't touched; documents of any length are scanned whole;
repeated rows give repeated rows; an empty table gives no rows; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._text import bounded_batches, released

#: In production the caller or the setting KEY_SETTING gives the key; this one is known to everybody and makes results repeatable.
KEY = b"sparrowdex-pseudonyms"
KEY_SETTING = "spark.sparrowdex.pseudonyms.key"
ROUNDS = 8
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31


def permute(key: bytes, kind: str, size: int, value: int, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network over two nearly equal radices, walked until it is in range."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def f(i: int, x: int, m: int) -> int:
        said = f"{kind}/{size}/{i}/{x}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=key[:64], digest_size=16 + m.bit_length() // 8).digest(), "big") % m

    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * f(i, left, b)) % b
            else:
                left = (left + sign * f(i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


class Feistel:
    """Pseudonyms of one key."""

    def __init__(self, key: bytes = KEY, back: bool = False):
        self.key, self.back = key, back
        self.of = lru_cache(1 << 16)(self._of)

    def mixed(self, kind: str, radices: list[int], digits: list[int]) -> list[int]:
        """Permutes a number in mixed radix as a whole."""
        size, value = 1, 0
        for r, d in zip(radices, digits, strict=True):
            size, value = size * r, value * r + d
        value = permute(self.key, kind, size, value, self.back)
        out = []
        for r in reversed(radices):
            value, d = divmod(value, r)
            out.append(d)
        return out[::-1]

    def chars(self, kind: str, text: str, keep: str = "") -> str:
        """Permutes digits among digits and letters among letters of their case; other characters stay."""
        sets = [next((s for s in _SETS if c in s and c not in keep), None) for c in text]
        at = [k for k, s in enumerate(sets) if s]
        new = self.mixed(kind, [len(sets[k]) for k in at], [sets[k].index(text[k]) for k in at])
        out = list(text)
        for k, d in zip(at, new, strict=True):
            out[k] = sets[k][d]
        return "".join(out)

    def _of(self, kind: str, text: str) -> str:
        return getattr(self, kind)(text) or text

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        return self.chars("email", local) + "@" + domain

    def secret(self, text: str) -> str:
        hexed, out = re.fullmatch(r"[0-9a-f]+", text), []
        for k in range(0, len(text), _BLOCK):
            part, block = text[k : k + _BLOCK], str(k // _BLOCK or "")
            if hexed:
                out.extend(f"{d:x}" for d in self.mixed("hex" + block, [16] * len(part), [int(c, 16) for c in part]))
            else:
                out.append(self.chars("secret" + block, part))
        return "".join(out)

    def ip(self, text: str) -> str:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return ""
        low = {1: 0, 2: 10, 3: 100}
        size = {1: 10, 2: 90, 3: 156}
        new = self.mixed("ip", [size[len(p)] for p in parts], [int(p) - low[len(p)] for p in parts])
        return ".".join(str(low[len(p)] + d) for p, d in zip(parts, new, strict=True))

    def iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return ""
        body = self.chars("iban" + plain[:2], plain[4:])
        check = 98 - number(body + plain[:2] + "00") % 97
        return _shaped(text, f"{plain[:2]}{check:02d}{body}")

    def ssn(self, text: str) -> str:
        a, g, s = (int(x) for x in text.split("-"))
        if not 0 < a < 900 or a == 666 or not g or not s:
            return ""
        area = a - 1 - (a > 666)
        area, g, s = self.mixed("ssn", [898, 99, 9999], [area, g - 1, s - 1])
        area += 1
        return f"{area + (area >= 666):03d}-{g + 1:02d}-{s + 1:04d}"

    def date(self, text: str) -> str:
        for pattern, order in _DATES:
            m = re.fullmatch(pattern, text)
            if not m:
                continue
            for names in order:
                at = dict(zip(names, m.groups(), strict=True))
                try:
                    day = datetime.date(int(at["y"]), int(at["m"]), int(at["d"])).toordinal() - _FIRST_DAY
                except ValueError:
                    continue
                if not 0 <= day < _DAYS:
                    continue
                narrow = any(len(g) == 1 for g in m.groups())
                while True:
                    day = permute(self.key, "date", _DAYS, day, self.back)
                    new = datetime.date.fromordinal(_FIRST_DAY + day)
                    if not narrow or new.month < 10 or new.day < 10:
                        break
                width = 1 if narrow else 2
                value = {"y": f"{new.year:04d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
                return re.sub(r"\d+", lambda _, n=iter(names): value[next(n)], text)
        return self.named_date(text)

    def named_date(self, text: str) -> str:
        said = re.search(r"[A-Za-z]{3,}", text)
        digits = re.findall(r"\d+", text)
        if not said or len(digits) != 2:
            return ""
        name, short = said.group(), len(said.group()) < 5 and said.group()[:3].title() in _SHORT and said.group().title() not in _MONTHS
        try:
            day = datetime.date(int(digits[1]), [x[:3] for x in _MONTHS].index(name[:3].title()) + 1, int(digits[0])).toordinal() - _FIRST_DAY
        except ValueError:
            return ""
        if not 0 <= day < _DAYS:
            return ""
        ordinal, padded = re.search(r"\d(st|nd|rd|th)\b", text), digits[0][0] == "0"
        while True:
            day = permute(self.key, "date", _DAYS, day, self.back)
            new = datetime.date.fromordinal(_FIRST_DAY + day)
            if not (short and new.month == 5) and not (padded and new.day > 9):
                break
        month = _MONTHS[new.month - 1][: 3 if short else None]
        month = month.upper() if name.isupper() else month.lower() if name.islower() else month
        of_day = f"{new.day:0{1 + padded}d}"
        if ordinal:
            of_day += "th" if 10 < new.day < 20 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        values = iter([of_day, f"{new.year:04d}"])
        return re.sub(r"\d+(?:st|nd|rd|th)?|[A-Za-z]{3,}", lambda m: month if m.group()[0].isalpha() else next(values), text)

    def card(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        if not is_card(digits):
            return ""
        while True:
            body = digits[0] + "".join(map(str, self.mixed("card" + digits[0], [10] * (len(digits) - 2), [int(c) for c in digits[1:-1]])))
            digits = body + next(c for c in "0123456789" if luhn(body + c))
            new = _shaped(text, digits)
            if card_end(new) == len(new):  # no shorter card in it, as in text
                return new

    def phone(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        if len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and text[0] != "+":
            lead, n = digits[:-10], digits[-10:]
            if n[0] in "01" or n[3] in "01":
                return ""
            new = self.mixed("phone", [8, 100, 8, 100, 10_000], [int(n[0]) - 2, int(n[1:3]), int(n[3]) - 2, int(n[4:6]), int(n[6:])])
            return _shaped(text, f"{lead}{new[0] + 2}{new[1]:02d}{new[2] + 2}{new[3]:02d}{new[4]:04d}")
        if text[0] == "+" and 8 <= len(digits) <= 15:
            new = self.mixed("phone" + digits[:2], [10] * (len(digits) - 2), [int(c) for c in digits[2:]])
            return _shaped(text, digits[:2] + "".join(map(str, new)))
        return ""


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DATES = (
    (r"(\d{4})-(\d\d?)-(\d\d?)", ("ymd",)),
    (r"(\d{4})/(\d\d?)/(\d\d?)", ("ymd",)),
    (r"(\d\d?)/(\d\d?)/(\d{4})", ("mdy", "dmy")),
    (r"(\d\d?)\.(\d\d?)\.(\d{4})", ("dmy",)),
)
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_SHORT = tuple(x[:3] for x in _MONTHS)
#: Characters of a secret that are permuted as one number.
_BLOCK = 128


def _shaped(text: str, value: str) -> str:
    """The characters of value at the places of text's letters and digits."""
    it = iter(value)
    return "".join(next(it) if c.isalnum() else c for c in text)


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and digits[0] != "0" and luhn(digits)


def card_end(text: str) -> int:
    """The end of the shortest valid card that starts a run of digits and ends at a separator or with the run; 0 if there is none."""
    for m in re.finditer(r"\d(?=\D|$)", text):
        if is_card(re.sub(r"\D", "", text[: m.end()])):
            return m.end()
    return 0


_MONTH = r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"\d\d?(?:st|nd|rd|th)?"
_EMAIL = r"(?<![A-Za-z0-9._%+\-])(?P<email>[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24})"
_PHONE = r"(?P<phone>\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,4}|\(\d{3}\) ?\d{3}[\-. ]\d{4}|\d{3}[\-. ]\d{3}[\-. ]\d{4})(?![\w]|[\-.]\d)"
_OTHERS = (
    r"(?<![A-Za-z0-9_.])(?:"
    rf"(?P<date>\d{{4}}-\d\d?-\d\d?|\d{{4}}/\d\d?/\d\d?|\d\d?/\d\d?/\d{{4}}|\d\d?\.\d\d?\.\d{{4}}|{_DAY} {_MONTH},? \d{{4}}|{_MONTH} {_DAY},? \d{{4}})(?:(?=T\d\d)|(?![\w\-/]|\.\d))"
    r"|(?<![Vv]ersion )(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)"
    r"|(?P<ssn>\d{3}-\d\d-\d{4})(?![\w\-])"
    r"|(?P<card>\d(?:[ \-]?\d){12,18})(?![\w\-]?\d|\w)"
    rf"|{_PHONE}"
    r"|(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r")"
)
_SECRET = r"(?i:\b(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key|key)\b)(?P<gap>[\"']?\s{0,4}[=:]\s{0,4}[\"']?)(?P<secret>[A-Za-z0-9+/_\-]{16,})"
_NUMBER = re.compile(_PHONE)
_WITH_AT = re.compile(f"{_SECRET}|{_EMAIL}|{_OTHERS}")
_WITHOUT = re.compile(f"{_SECRET}|{_OTHERS}")


def pseudonymise(text: str, feistel: Feistel) -> tuple[str, int]:
    """The text with its personal values replaced, and their number."""
    pattern = _WITH_AT if "@" in text else _WITHOUT
    found, out, done, at = 0, [], 0, 0
    while m := pattern.search(text, at):
        kind = m.lastgroup
        start, at = m.span(kind)
        if kind == "card":
            phone, end = _NUMBER.match(text, start), card_end(m.group(kind))
            if phone and feistel.phone(phone.group("phone")):  # no card is grouped like a phone
                kind, at = "phone", phone.end("phone")
            elif end:
                at = start + end
            else:  # another value may start within the run
                at = start + re.match(r"\d+", text[start:at]).end()
                continue
        value = text[start:at]
        new = (feistel.of if len(value) <= 2 * _BLOCK else feistel._of)(kind, value)
        if new != value:
            found += 1
            out += (text[done:start], new)
            done = at
    return "".join((*out, text[done:])), found


def _rewriter(key: bytes, back: bool, column: str, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key, back)
        for batch in batches:
            k = batch.schema.names.index(column)
            text = batch.column(k)
            mask = pc.fill_null(pc.match_substring_regex(text, "[0-9@]|(?i:token|secret|passw|key)"), False)
            done = [pseudonymise(t, feistel) for t in text.filter(mask).to_pylist()]
            new = pc.replace_with_mask(text, mask, pa.array([t for t, _ in done], text.type))
            arrays = [new if i == k else batch.column(i) for i in range(batch.num_columns)]
            names = list(batch.schema.names)
            if counted:
                zero = pa.array([0] * batch.num_rows, pa.int64())
                arrays.append(pc.replace_with_mask(zero, mask, pa.array([n for _, n in done], pa.int64())))
                names.append("found")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def key_of(spark: SparkSession) -> bytes:
    return (spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None) or KEY.decode()).encode()


def with_pseudonyms(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """docs with the personal values of text replaced (or, with back, restored) under a key, by default the session's."""
    bounded_batches(docs.sparkSession)
    key = key_of(docs.sparkSession) if key is None else key
    return docs.mapInArrow(released(_rewriter(key, back, "text", False)), docs.schema)


def mask_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: all documents, with pseudonyms."""
    return with_pseudonyms(docs)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, found) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bounded_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(released(_rewriter(key_of(spark), False, "text", True)), "doc_id long, text string, found long")
