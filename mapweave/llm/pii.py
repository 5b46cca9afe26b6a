"""Personal data: detection, and keyed surrogates of the same type, gender, script and format.

Every surrogate is a keyed permutation of the strings of the entity's own shape
(a Feistel network over a mixed radix, walked until the shape's rules hold), so
distinct entities of a shape keep distinct surrogates and the same entity has
the same one everywhere, in whatever format: phone numbers are permuted by their
country code and national digits. Given and family names are entities of their
own, so a name and its parts stay together. Given names come from lists by
gender, where two entities can meet; the distinct entities of the corpus are
therefore gathered, their surrogates compared, and all but the first of those
that meet get another attempt, until none meet.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, small_batches

#: Titles that mark a person's name, with the gender they tell ("" where they tell none).
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
          "Dr": "", "Doctor": "", "Doktor": "", "Prof": "", "Professor": "", "Rev": "", "Docteur": "", "Professeur": ""}
GIVEN = {
    "m": ["Adam", "Anton", "Bruno", "Carlos", "Daniel", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Nils", "Oscar", "Paul", "Rafael", "Simon", "Victor"],
    "f": ["Ada", "Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Ines", "Julia", "Karin", "Laura", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Vera"],
    "": ["Alex", "Andrea", "Charlie", "Dominique", "Eden", "Fran", "Jules", "Kim", "Lou", "Max", "Nikita", "Noor", "Robin", "Sacha", "Sam", "Toni"],
}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x3B1, 0x3C2))), "".join(map(chr, range(0x391, 0x3A2))),
             "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "àáâãäåæçèéêëìíîïñòóôõöùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"]
PLACE = {c: a for a in ALPHABETS for c in a}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DETECT = {
    "ip": (re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"), "."),
    "phone": (re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d.-])\d{3}([-.])\d{3}\1\d{4}(?![\d.-]?\d)"), "+(-."),
    "card": (re.compile(r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\d)"), ""),
    "ssn": (re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "-"),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), ""),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT_RIGHT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z])")
_SECRET_NAME = re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential)s?[\"']?[ \t]*\Z", re.IGNORECASE)
_SECRET = re.compile(r"[ \t]*([\"']?)([A-Za-z0-9+/_.~-]{12,})\1")
_BARE = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]").search
_WORD = r"[^\W\d_]{2,}(?:[-'’][^\W\d_]{2,})*"
_ANY = "|".join(sorted(TITLES, key=len, reverse=True))
_TITLED = re.compile(rf"(?<!\w)({_ANY})(\.? )(?!(?:{_ANY})\.? )({_WORD})(?: ({_WORD}))?(?!\w)")
#: The gender that a listed given name tells.
GENDER = {n: g for g, names in GIVEN.items() for n in names}
_PAIR = re.compile(r"([A-Z][a-z]+) (?=[^\W\d_a-z])")
_NEXT = re.compile(rf"{_WORD}(?!\w)")
#: Country calling codes of one and two digits; the others have three.
CALLING = {"1", "7", *map(str, (20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98))}


def _back(text: str, at: int, chars) -> int:
    """Where the run of ``chars`` that ends before ``at`` starts."""
    while at and text[at - 1] in chars:
        at -= 1
    return at


def _capital(word: str | None) -> bool:
    """Whether each part of a name begins with a capital and goes on without."""
    return bool(word) and all(p[:1].isupper() and p[1:].islower() for p in re.split("[-'’]", word))


def _names(text: str) -> list[tuple[int, int, str]]:
    """Given names (given-m, given-f, given-) and family names in a text: behind a title, or a listed given name before
    another capitalised word; and each of these names wherever it stands again as a whole word.

    A single word behind a title is a given name if it is one elsewhere in the text
    or in the lists, else a family name.
    """
    found, single, known = [], [], {}
    for m in _TITLED.finditer(text) if any(t in text for t in TITLES) else ():
        if not _capital(m[3]):
            continue
        if _capital(m[4]) and m[4] not in TITLES:
            found += [(*m.span(3), "given-" + (TITLES[m[1]] or GENDER.get(m[3], ""))), (*m.span(4), "family")]
        else:
            single.append((*m.span(3), TITLES[m[1]]))
    taken = {x[0] for x in found} | {x[0] for x in single}
    for m in _PAIR.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if m[1] in GENDER and m.start() not in taken and not (before.isalnum() or before in ("_", "-", "'", "’")):
            other = _NEXT.match(text, m.end())
            if other and _capital(other[0]) and other[0] not in TITLES and other[0] != m[1]:
                found += [(*m.span(1), "given-" + GENDER[m[1]]), (*other.span(), "family")]
    for x, y, kind in found:
        known.setdefault(text[x:y], kind)
    for x, y, gender in single:
        word = text[x:y]
        known.setdefault(word, "given-" + (gender or GENDER[word]) if word in GENDER else "family")
        found.append((x, y, known[word]))
    if known:
        again = re.compile(r"(?<![\w])(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?!\w)")
        at = {x[0] for x in found}
        found += [(*m.span(), known[m[0]]) for m in again.finditer(text) if m.start() not in at]
    return [(x, y, known[text[x:y]]) for x, y, _ in found]


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities in a whole text, in order, none overlapping: the first, then the longer one, wins."""
    if not text:
        return []
    found = []
    at = text.find("@")
    while at >= 0:
        start = _back(text, at, _LOCAL)
        right = _AT_RIGHT.match(text, at + 1) if start < at else None
        if right:
            found.append((at - len(text[start:at].lstrip(".-%+_")), right.end(), "email"))
        at = text.find("@", at + 1)
    for kind, (pattern, needs) in DETECT.items() if _DIGIT(text) else ():
        if not needs or any(c in text for c in needs):
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            if _SECRET_NAME.search(text, max(0, _back(text, at, " \t") - 24), at) and (m := _SECRET.match(text, at + 1)) and re.search(r"\d", m[2]):
                found.append((*m.span(2), "secret"))
            at = text.find(sign, at + 1)
    if "AKIA" in text or "gh" in text or "sk-" in text or "xox" in text:
        found += [(*m.span(), "secret") for m in _BARE.finditer(text)]
    found += _names(text)
    numbers = {_national(text[x:y])[1] for x, y, k in found if k == "phone"}
    if numbers:  # the same numbers, bare
        found += [(*m.span(), "phone") for m in re.finditer(r"(?<![\w.+-])\d{7,15}(?![\w.-]*\d)", text) if m[0] in numbers]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, last = [], 0
    for x in found:
        if x[0] >= last:
            out.append(x)
            last = x[1]
    return out


def _national(phone: str) -> tuple[str, str]:
    """(country code, national digits); ten digits without a code belong to code 1."""
    digits = "".join(filter(str.isdigit, phone))
    if not phone.startswith("+"):
        return ("1" if len(digits) == 10 else "", digits)
    size = next((n for n in (1, 2) if digits[:n] in CALLING), 3)
    return digits[:size], digits[size:]


class Surrogates:
    """Keyed surrogates. ``attempt`` above 0 gives another one, where two entities met."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def _number(self, *parts) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")

    def _feistel(self, value: int, size: int, label: str, back: bool) -> int:
        """A keyed permutation of range(size): six rounds on the next even number of bits, walked back into the range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for k in reversed(range(6)) if back else range(6):
                if back:
                    left, right = right ^ (self._stretch(half, label, size, k, left) & mask), left
                else:
                    left, right = right, left ^ (self._stretch(half, label, size, k, right) & mask)
            value = left << half | right
            if value < size:
                return value

    def permute(self, value: int, size: int, label: str) -> int:
        """The same without fixed points: a step of one between the permutation and its inverse."""
        if size < 2:
            return value
        return self._feistel((self._feistel(value, size, label, False) + 1) % size, size, label, True)

    def _stretch(self, bits: int, *parts) -> int:
        out, k = 0, 0
        while k * 256 < bits:
            out, k = out << 256 | self._number(*parts, k), k + 1
        return out

    def shaped(self, text: str, label: str, place: dict = PLACE) -> str:
        """Permute a string among those of its shape: letters and digits stay in their alphabets, the rest stays."""
        value, size, shape = 0, 1, []
        for c in text:
            a = place.get(c)
            shape.append(a[0] if a else c)
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)
        value, out = self.permute(value, size, f"{label}|{''.join(shape)}"), []
        for c in reversed(text):
            a = place.get(c)
            if a:
                value, r = divmod(value, len(a))
            out.append(a[r] if a else c)
        return "".join(reversed(out))

    def _digits(self, text: str, label: str) -> str:
        """Permute the digits of a text whatever stands between them: one number in several formats stays one."""
        new = iter(self.shaped("".join(filter(str.isdigit, text)), label))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def email(self, text: str, attempt: int) -> str:
        local, _, domain = text.rpartition("@")
        body, dot, top = domain.rpartition(".")
        return f"{self.shaped(local, f'local{attempt}')}@{self.shaped(body, 'domain')}{dot}{top}"

    def phone(self, text: str, attempt: int) -> str:
        """The country code stays; the national digits are permuted, whatever the format."""
        code, national = _national(text)
        new = iter((code if text.startswith("+") else "") + self.shaped(national, f"phone{code}|{attempt}"))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def ssn(self, text: str, attempt: int) -> str:
        return self._digits(text, f"ssn{attempt}")

    def card(self, text: str, attempt: int) -> str:
        """Numbers with a sound check digit get one, others stay as far from it as they were."""
        digits = "".join(filter(str.isdigit, text))
        body = self.shaped(digits[:-1], f"card{attempt}")
        new = iter(body + str((_luhn(body) + int(digits[-1]) - _luhn(digits[:-1])) % 10))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def ip(self, text: str, attempt: int) -> str:
        """Addresses of special ranges keep the range's bits, others stay outside these ranges."""
        value = int.from_bytes(bytes(map(int, text.split("."))), "big")
        fixed = _ip_fixed(value)
        for _ in range(1 + attempt):
            if fixed:
                free = 32 - fixed
                low = self.permute(value & ((1 << free) - 1), 1 << free, f"ip{value >> free}")
                value = value >> free << free | low
            else:
                value = self.permute(value, 1 << 32, "ip")
                while _ip_fixed(value):  # one address in eight is special
                    value = self.permute(value, 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def iban(self, text: str, attempt: int) -> str:
        """Sound check digits become sound ones; of the others, those that are sound for the new body change places with it."""
        bare = text.replace(" ", "")
        body = self.shaped(bare[4:], f"iban{bare[:2]}|{attempt}")
        old, new = _iban_check(bare[:2], bare[4:]), _iban_check(bare[:2], body)
        check = {old: new, new: old}.get(bare[2:4], bare[2:4])
        out = iter(bare[:2] + check + body)
        return "".join(c if c == " " else next(out) for c in text)

    def secret(self, text: str, attempt: int) -> str:
        for hexa in ("0123456789abcdef", "0123456789ABCDEF"):
            if not set(text) - set(hexa):
                return self.shaped(text, f"secret{attempt}", dict.fromkeys(hexa, hexa))
        return self.shaped(text, f"secret{attempt}")

    def given(self, text: str, gender: str, attempt: int) -> str:
        """A given name of the gender; in scripts other than Latin one of its shape."""
        if not all(c.isascii() or c in "-'’" or (c in PLACE and ord(c) < 0x250) for c in text):
            return self.shaped(text, f"given{attempt}")
        names = GIVEN[gender]
        others = [x for x in names if x != text]
        k = self._number("given", gender, text) + attempt
        new = others[k % len(others)]
        rest = attempt // len(others)
        while rest:  # more entities than names: another one is added
            rest, r = divmod(rest - 1, len(names))
            new += "-" + names[r]
        return new

    def family(self, text: str, attempt: int) -> str:
        """A name of its shape; the parts of a double name each as they are alone."""
        return "".join(p if p in "-'’" else self.shaped(p, f"family{attempt}") for p in re.split("([-'’])", text) if p)

    def __call__(self, kind: str, text: str, attempt: int = 0) -> str:
        at = (kind, text, attempt)
        got = self.known.get(at)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            kind, _, gender = kind.partition("-")
            got = self.given(text, gender, attempt) if kind == "given" else getattr(self, kind)(text, attempt)
            self.known[at] = got
        return got


def _luhn(body: str) -> int:
    """The check digit of a card number's other digits."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _ip_fixed(value: int) -> int:
    """The leading bits that tell the special range of an address: private, loopback, link-local, multicast; 0: none of these."""
    first, second = value >> 24, value >> 16 & 255
    if first in (0, 10, 127) or first >= 224:
        return 8
    if first == 172 and 16 <= second < 32:
        return 12
    return 16 if (first, second) in ((192, 168), (169, 254)) else 0


def _iban_check(country: str, body: str) -> str:
    return f"{98 - _iban_rest(body + country + '00'):02d}"


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def replace(text: str | None, make: Surrogates, attempts: dict | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and the number of entities."""
    found = detect(text)
    if not found:
        return text, 0
    out, last = [], 0
    for start, end, kind in found:
        e = text[start:end]
        out += [text[last:start], make(kind, e, (attempts or {}).get((kind, e), 0))]
        last = end
    return "".join(out) + text[last:], len(found)


def collisions(docs: DataFrame, key: bytes, text_col: str = "text", max_attempts: int = 1000) -> DataFrame:
    """(kind, entity, attempt) of the corpus's distinct entities; no two of a kind have one surrogate. No texts: no rows."""
    small_batches(docs.sparkSession, 256)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sorted({(k, t[x:y]) for t in b.column("text").to_pylist() for x, y, k in detect(t)})
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got]), pa.array([e for _, e in got])], names=["kind", "entity"])

    def surrogates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for b in batches:
            new = [make(k, e, a) for k, e, a in zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "surrogate"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    known = materialise(texts.mapInArrow(find, "kind string, entity string").distinct().withColumn("attempt", F.lit(0)), "entities")
    for _ in range(max_attempts):
        made = materialise(known.mapInArrow(surrogates, "kind string, entity string, attempt int, surrogate string"), "surrogates")
        clash = made.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1").select(F.col("kind").alias("k2"), F.col("surrogate").alias("s2"), "n", "first")
        clash = materialise(clash, "clashes")
        if clash.isEmpty():
            return known
        hit = materialise(made.join(clash, (F.col("kind") == F.col("k2")) & (F.col("surrogate") == F.col("s2")), "left"), "hit")
        # The first keeps its attempt. The others draw one from several times as many as they are, by a hash.
        again = F.when(F.col("k2").isNull() | (F.col("entity") == F.col("first")), F.col("attempt")).otherwise(
            F.col("attempt") + 1 + F.pmod(F.xxhash64("entity", "attempt"), F.least(F.lit(1 << 24), 8 * F.col("n"))).cast("int"))
        known = materialise(hit.select("kind", "entity", again.alias("attempt")), "entities")
    raise RuntimeError("surrogates still meet")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in its texts, and their number in ``count_col`` (replaced if there is one).

    Null texts stay null; texts without entities stay as they are; repeated rows
    each stay; no rows: no rows. Texts are taken whole, however long. The result
    depends on the key, the texts and nothing else. Attempts above 0 are few;
    they reach the texts by a join on a digest of the text, and only if there are any.
    """
    docs = docs.drop(count_col) if count_col in docs.columns else docs
    more = collisions(docs, key, text_col).where("attempt > 0")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{count_col} int").fields])
    names, rows, extra = docs.columns, docs, False
    if not more.isEmpty():
        held, extra = _attempts(docs, more, text_col), True
        rows = docs.join(held, F.md5(F.col(text_col).cast("binary")) == F.col("__digest"), "left").drop("__digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for b in batches:
            held = b.column("__attempts").to_pylist() if extra else [None] * b.num_rows
            new = [replace(t, make, {(x["kind"], x["entity"]): x["attempt"] for x in a} if a else None) for t, a in zip(b.column(text_col).to_pylist(), held, strict=True)]
            cols = [pa.array([t for t, _ in new], pa.string()) if n == text_col else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in new], pa.int32())], names=[*names, count_col])

    return rows.mapInArrow(run, schema)


def _attempts(docs: DataFrame, more: DataFrame, text_col: str) -> DataFrame:
    """(__digest, __attempts): of each text that holds such entities, their attempts."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(hashlib.md5(t.encode()).hexdigest(), k, e) for t in b.column("text").to_pylist() for k, e in sorted({(k, t[x:y]) for x, y, k in detect(t)})]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*got, strict=True)], names=["__digest", "kind", "entity"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    held = texts.mapInArrow(find, "__digest string, kind string, entity string").join(more, ["kind", "entity"])
    return held.groupBy("__digest").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("__attempts"))
