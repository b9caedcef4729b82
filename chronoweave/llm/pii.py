"""Surrogates for personal data.

Detected are e-mail addresses, telephone numbers (ten bare digits after a word for them), IPv4 and IPv6 addresses, IBANs with right check digits,
numbers written like US social security numbers, card numbers (13 to 19 digits with a right check digit, or with a card network's prefix and
length), names after a title and every other mention of such a name in its
document, in full, by the first or by the last word, in any case that starts with a capital or in a script without case.  A last name that follows another title, or stands alone,
is the first full name in the document that ends in it and has no other gender; a first name alone is the first full name that begins with it.  An entity's canonical form (what differs only in
case or separators is one entity) is mapped by a keyed permutation of all
strings of its form, so different entities get different surrogates and one entity gets
the same everywhere.  Surrogates keep the type, the length and the class of each
character: digits, vowels and consonants of a script, case and separators.
Checksums of card numbers stay valid or invalid, addresses stay private or public,
telephone numbers keep their country code.  First names that are in the gender's list are
permuted in that list; others keep their classes of letters, and titles stay.

Collision check: a surrogate must not be shown as an entity of the corpus is: names are compared without genders and titles, in full and
by their last word.  (Listed first names are exchanged for others of the list, which people of the corpus may have.)  The distinct
entities are compared with the surrogates.  One whose surrogate is itself an entity
tries others in turns, each by a permutation keyed for this entity and turn; a
candidate counts if it is no entity and no other entity's surrogate, and of several
entities that meet in one the smallest takes it.  So the map is one-to-one.  After
`SAME_FORM` turns the form is taken to be full and gets wider: longer names, addresses and
numbers, other check digits, a public address.  Only these exceptions are joined back
to the documents, and only if there are any.

Null texts stay null, empty ones empty.  Each row is handled alone otherwise, so
ties, repeated rows and extra columns have no effect; columns named like an output are
replaced.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.util import cut, map_columns, texts_of

TYPES = ("email", "ip", "ipv6", "iban", "ssn", "card", "phone", "name")

# First names by gender, and titles with the gender they tell.
MALE = ("Adam", "Carlos", "David", "Felix", "Hans", "Henri", "Jean", "John", "Juan", "Karl", "Louis", "Luis", "Marc", "Michael", "Miguel", "Paul", "Peter", "Pierre", "Robert", "Thomas")
FEMALE = ("Alice", "Anna", "Anne", "Carmen", "Clara", "Elena", "Emma", "Eva", "Greta", "Heidi", "Jane", "Julia", "Laura", "Lucia", "Maria", "Marie", "Mary", "Sarah", "Sofia", "Sophie")
TITLES = {"Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr.": "m", "Sra.": "f", "Dr.": "", "Dr": "", "Prof.": ""}

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)", re.ASCII)
_CARD = re.compile(r"(?<![A-Za-z0-9.+-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9]|[.-]\d)", re.ASCII)
_PHONE = re.compile(r"(?<![A-Za-z0-9.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?(?![A-Za-z0-9]|[.-]\d)", re.ASCII)
#: International numbers, with as many digits as the plans of +1, +33 and +34 have; national ones by their trunk prefix.
_PLUS = re.compile(r"\+(?<![A-Za-z0-9.+]\+)(?:1(?:[ ./-]?\(?\d\)?){10}|3[34](?: ?\(0\))?(?:[ ./-]?\(?\d\)?){9}|(?!1|3[34])\d(?:[ ./-]?\(?\d\)?){7,14})(?![A-Za-z0-9]|[.-]\d)", re.ASCII)
_TRUNK = re.compile(r"0(?<![A-Za-z0-9.+-]0)(?<!\d 0)(?:[1-9]([ .-])\d\d(?:\1\d\d){3}(?! ?\d)|[1-9]\d{1,3}(?:[ -]| ?/ ?)\d{5,8}(?:-\d{1,4})?(?! ?\d)|[1-9]\d{8,9})(?![A-Za-z0-9]|[.-]\d)", re.ASCII)
_AREA = re.compile(r"\((?<![A-Za-z0-9.]\()0[1-9]\d{1,3}\) ?\d{5,8}(?![A-Za-z0-9]|[.-]\d)", re.ASCII)
_TEN = re.compile(r"(?i:\b(?:phone|tel|telephone|mobile|call|fax|teléfono|telefon|téléphone)\b[.:]?\s*(?:number|no\.?)?[:\s]*)([2-9]\d{9})(?!\w|[.-]\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", re.ASCII)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f:]{3,37}(?![\w:])(?!\.\d)", re.ASCII)
_SSN = re.compile(r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-]|\.\d)", re.ASCII)
#: Prefixes of card networks, and the lengths of their numbers.
_NETWORK = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d+|3[47]\d{13}|(?:6011|65\d\d|64[4-9]\d)\d{12}|35(?:2[89]|[3-8]\d)\d{12}")
#: Country codes of one and two digits; all others have three.
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile("(?<!\\w)(" + "|".join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True)) + r") ((?:[^\W\d_]\.|[^\W\d_][^\W\d_]+)(?:[ -][^\W\d_][^\W\d_]+){0,2})(?!\w)")
_TITLE_MARKS = ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Sr.", "Sra.", "Dr", "Prof.")
_DIGIT = re.compile(r"[0-9]")
#: Longest word of a script without case that is read as a name.
CASELESS = 12

#: Turns in which an entity whose surrogate is taken keeps its form, and the turn after which the job fails.  Addresses and cards have forms too large to be full.
SAME_FORM = {"email": 8, "ip": 32, "ipv6": 32, "iban": 32, "ssn": 32, "card": 32, "phone": 8, "name": 8}
LAST_TURN = 64


def detect(text: str | None) -> list[tuple[str, int, int, str]]:
    """(type, start, end, canonical form) of entities by start; of overlapping ones the first type listed stays."""
    found: list[tuple[str, int, int, str]] = []
    if not text:
        return found
    if "@" in text:
        found += [("email", *m.span(), m[0].lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span(), m[0]) for m in _IP.finditer(text)]
        found += [("card", *m.span(), n) for m in _CARD.finditer(text) if is_card(n := re.sub(r"[^0-9]", "", m[0]))]
        if "::" in text or text.count(":") >= 7:
            found += [("ipv6", *m.span(), c) for m in _IPV6.finditer(text) if (c := _ipv6(m[0]))]
        found += [("iban", m.start(), m.start() + n, m[0][:n].replace(" ", "").lower()) for m in _IBAN.finditer(text) if (n := _iban(m[0]))]
        found += [("ssn", *m.span(), m[0].replace("-", "")) for m in _SSN.finditer(text)]
        found += [("phone", *m.span(1), m[1]) for m in _TEN.finditer(text)]
        forms = [_PHONE, *([_PLUS] if "+" in text else ()), *([_TRUNK] if "0" in text else ()), *([_AREA] if "(0" in text else ())]
        found += [("phone", *m.span(), re.sub(r"[^0-9+]", "", m[0])) for form in forms for m in form.finditer(text)]
    if any(t in text for t in _TITLE_MARKS):
        titled: list[tuple[int, int, str, str]] = []
        m = _NAME.search(text)
        while m:
            # What follows the name may be the next title.
            words, at = m[2].split(" "), m.start(2)
            kept = next((i for i, w in enumerate(words) if not names_start(w) or i and (w in TITLES or w + "." in TITLES)), len(words))
            if kept:
                name = " ".join(words[:kept])
                titled.append((m.start(2), m.start(2) + len(name), TITLES[m[1]], unicodedata.normalize("NFC", name).lower()))
                at += len(name)
            m = _NAME.search(text, at)
        if titled:
            found += mentions(text, titled)
    order = {t: i for i, t in enumerate(TYPES)}
    out: list[tuple[str, int, int, str]] = []
    for e in sorted(found, key=lambda e: (order[e[0]], e[1], -e[2])):
        at = bisect.bisect_left(out, e[1], key=lambda o: o[1])
        if (not at or out[at - 1][2] <= e[1]) and (at == len(out) or out[at][1] >= e[2]):
            out.insert(at, e)
    return out


def is_card(digits: str) -> bool:
    """Whether a number of 13 to 19 digits is a card's: by its check digit, or by its network's prefix and length."""
    return int(digits[-1]) == _luhn(digits[:-1]) or bool(_NETWORK.fullmatch(digits) and (digits[0] not in "52" or len(digits) == 16))


def _ipv6(text: str) -> str | None:
    """The shortest form of an address with three groups or more."""
    try:
        return str(ipaddress.IPv6Address(text)) if len(text.replace("::", ":").strip(":").split(":")) >= 3 else None
    except ValueError:
        return None


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(text: str) -> int:
    """The length of the longest part that ends where a word does and has right check digits; 0 without one."""
    ends = [n for n in range(len(text), 14, -1) if text[n - 1] != " " and text[n : n + 1] in ("", " ")]
    return next((n for n in ends if len(c := text[:n].replace(" ", "")) >= 15 and _remainder(c) == 1), 0)


def names_start(word: str) -> bool:
    """Whether a word may be part of a name: it starts with a capital, or is of a script without case and at most `CASELESS` letters long, as longer runs are sentences."""
    return word[0].isupper() or unicodedata.category(word[0]) == "Lo" and len(word) <= CASELESS


def mentions(text: str, titled: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int, str]]:
    """Names after titles (start, end, gender, name), and where else they are mentioned, all as the entities of their document."""
    # Of one name, or of full names with one last name, the first of each gender, and the first at all.
    whole: dict[tuple[str, str], str] = {}
    ending: dict[tuple[str, str], str] = {}
    given: dict[str, str] = {}
    for _, _, gender, name in titled:
        if gender:
            whole.setdefault((name, gender), f"{gender}:{name}")
            whole.setdefault((name, ""), f"{gender}:{name}")
    for _, _, gender, name in titled:
        if not gender:
            whole.setdefault((name, ""), f":{name}")
    for _, _, gender, name in titled:
        if " " in name:
            entity = whole[name, gender]
            last = name.rpartition(" ")[2]
            given.setdefault(name.partition(" ")[0], entity)
            for own in ("", *((entity[0],) if entity[0] != ":" else ("m", "f"))):
                ending.setdefault((last, own), entity)

    out: list[tuple[str, int, int, str]] = []
    places: dict[str, dict[str, str]] = {}
    for start, end, gender, name in titled:
        entity = (ending.get((name, gender)) if " " not in name else None) or whole[name, gender]
        out.append(("name", start, end, entity))
        own, last = text[start:end].lower(), text[start:end].rpartition(" ")[2].lower()
        for form, owner in ((own, entity), (last, ending.get((name.rpartition(" ")[2], ""), entity))):
            if len(form) > 1 and not form.endswith("."):
                places.setdefault(_WORD.search(form)[0], {}).setdefault(form, owner)
    for form, owner in given.items():
        if len(form) > 1 and not form.endswith("."):
            places.setdefault(_WORD.search(form)[0], {}).setdefault(form, owner)
    sizes = {first: sorted({len(f) for f in forms}, reverse=True) for first, forms in places.items()}
    for m in _WORD.finditer(text):
        first, a = m[0].lower(), m.start()
        if first in places and names_start(m[0]) and not (a and (text[a - 1].isalnum() or text[a - 1] == "_")):
            for n in sizes[first]:
                owner, b = places[first].get(text[a : a + n].lower()), a + n
                if owner and not (text[b : b + 1].isalnum() or text[b : b + 1] == "_"):
                    out.append(("name", a, b, owner))
                    break
    # Where both start at one place, the name after the title stays.
    named = {o[1] for o in out[: len(titled)]}
    return out[: len(titled)] + [o for o in out[len(titled) :] if o[1] not in named]


def permuted(number: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits, walked until it falls in the range."""
    if size < 2:
        return 0
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for turn in range(8):
            data = f"{tweak}|{size}|{turn}|{right}".encode()
            left, right = right, left ^ (int.from_bytes(hashlib.blake2b(data, key=key, digest_size=max(8, half // 8 + 1)).digest(), "big") & mask)
        number = left << half | right
        if number < size:
            return number


@functools.cache
def _alphabets() -> dict[str, str]:
    """The alphabet of each letter that can be exchanged: vowels and consonants of a script, plain and accented apart; digits."""
    vowels, groups = set("aeiouyаеёиоуыэюяαεηιουω"), {}
    scripts = [range(0x61, 0x7B), range(0xE0, 0x100), range(0x101, 0x180), range(0x3B1, 0x3CA), range(0x430, 0x460)]
    for at, script in enumerate(scripts):
        for code in script:
            c = chr(code)
            if c.isalpha() and c == c.lower() and len(c.upper()) == 1 and c.upper().lower() == c and c != "ς":
                base = unicodedata.normalize("NFD", c)[0]
                groups.setdefault((at, base in vowels), []).append(c)
    out = {c: "0123456789" for c in "0123456789"}
    for members in groups.values():
        out |= dict.fromkeys(members, "".join(members))
    return out


@functools.lru_cache(4096)
def _alphabet(c: str) -> str:
    """The alphabet of a character, empty if it stays. Letters of other scripts have those of their kind among the 128 codes around them."""

    def kind(x: str) -> tuple | None:
        if x in known or not x.isalpha() or x != x.lower() or len(x.upper()) != 1 or x.upper().lower() != x or unicodedata.normalize("NFC", x) != x:
            return None
        return unicodedata.category(x), unicodedata.normalize("NFD", x)[0] in "aeiouy"

    known = _alphabets()
    if c in known or kind(c) is None:
        return known.get(c, "")
    block = ord(c) & ~127
    return "".join(x for x in map(chr, range(block, block + 128)) if kind(x) == kind(c))


def permuted_text(text: str, key: bytes, tweak: str) -> str:
    """Lower-case text with every character exchanged inside its alphabet, all at once; others stay and are part of the tweak."""
    number, size, form = 0, 1, []
    for c in text:
        alphabet = _alphabet(c)
        form.append(alphabet[0] if alphabet else "=" + c)
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    number = permuted(number, size, key, tweak + "|" + "".join(form))
    out = []
    for c in reversed(text):
        alphabet = _alphabet(c)
        if alphabet:
            number, at = divmod(number, len(alphabet))
            c = alphabet[at]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit that makes `digits` valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _private(octets: tuple[int, ...]) -> int:
    a, b = octets[:2]
    return 1 if a == 10 or a == 127 or (a == 172 and 16 <= b < 32) or (a, b) == (192, 168) else 2 if a == 0 or a >= 224 else 0


def prefix(phone: str) -> str:
    """What stays of a telephone number: + or 00 and the country code, a trunk 0, or the 1 before ten digits."""
    lead = "+" if phone[0] == "+" else "00" if phone.startswith("00") else ""
    if lead:
        code = phone[len(lead) : len(lead) + 3]
        return lead + next((code[:n] for n in (1, 2) if code[:n] in COUNTRIES), code)
    return phone[0] if phone[0] == "0" or (phone[0] == "1" and len(phone) == 11) else ""


def surrogate(kind: str, canonical: str, key: bytes) -> str:
    """One step of the permutation of a type's canonical forms."""
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        host, _, top = domain.rpartition(".")
        return f"{permuted_text(local + '@' + host, key, 'email.' + top)}.{top}"
    if kind == "ip":
        octets = tuple(map(int, canonical.split(".")))
        number = int.from_bytes(bytes(octets), "big")
        while True:
            number = permuted(number, 1 << 32, key, "ip")
            found = tuple(number.to_bytes(4, "big"))
            if _private(found) == _private(octets):
                return ".".join(map(str, found))
    if kind == "ipv6":
        number = int(ipaddress.IPv6Address(canonical))
        head = number >> 112  # tells private, link-local and other addresses
        return str(ipaddress.IPv6Address(head << 112 | permuted(number & (1 << 112) - 1, 1 << 112, key, f"ipv6{head}")))
    if kind == "iban":
        bban = permuted_text(canonical[4:], key, "iban" + canonical[:2])
        return f"{canonical[:2]}{98 - _remainder(canonical[:2] + '00' + bban):02d}{bban}"
    if kind == "ssn":
        while True:
            canonical = str(permuted(int(canonical), 10**9, key, "ssn")).zfill(9)
            if canonical[:3] not in ("000", "666") and canonical[0] != "9" and canonical[3:5] != "00" and canonical[5:] != "0000":
                return canonical
    if kind == "card":
        body, offset = canonical[:-1], (int(canonical[-1]) - _luhn(canonical[:-1])) % 10
        while True:  # numbers with a wrong check digit are walked on until they are a network's again
            body = str(permuted(int(body), 10 ** len(body), key, f"card{len(body)}")).zfill(len(body))
            found = body + str((_luhn(body) + offset) % 10)
            if is_card(found) or not is_card(canonical):
                return found
    if kind == "phone":
        # Walked on until the prefix is read as the same one again, so that the whole stays one-to-one.
        head = prefix(canonical)
        tail, n = canonical[len(head) :], len(canonical) - len(head)
        while True:
            tail = str(permuted(int(tail), 10**n, key, f"phone{n}")).zfill(n)
            if prefix(head + tail) == head:
                return head + tail
    gender, name = canonical.split(":", 1)
    first, blank, rest = name.partition(" ")
    for own, names in (("m", MALE), ("f", FEMALE)):
        low = [x.lower() for x in names]
        if first in low:
            # The rest is permuted first and tells which permutation of the list is taken, so that the whole stays one-to-one.
            rest = permuted_text(rest, key, "rest")
            return f"{gender}:{low[permuted(low.index(first), len(low), key, f'first{own}{rest}')]}{blank}{rest}"
    # Class-keeping exchange may fall on a listed name: it is walked on until it doesn't.
    while True:
        name = permuted_text(name, key, "name")
        if name.partition(" ")[0] not in _listed():
            return f"{gender}:{name}"


@functools.cache
def _listed() -> frozenset[str]:
    return frozenset(x.lower() for x in (*MALE, *FEMALE))


def widened(kind: str, canonical: str, more: int) -> str:
    """A canonical form of the same type with more room."""
    if kind == "email":
        return "ba" * more + canonical
    if kind == "ip":
        return "8.8.8.8"
    if kind in ("ipv6", "iban", "ssn"):
        return canonical  # too many for a corpus to fill
    if kind == "card":
        return canonical[:-1] + str((int(canonical[-1]) + more) % 10)
    if kind == "phone":
        return canonical + "0" * more
    # Letters that have no others to be exchanged with would stay in clear.
    return "".join(c if _alphabet(c) or not c.isalpha() else "a" for c in canonical.rstrip(".")) + "ba" * more


def other(kind: str, canonical: str, key: bytes, turn: int) -> str:
    """A turn's candidate for an entity whose surrogate is taken."""
    own = hashlib.blake2b(f"{turn}|{kind}|{canonical}".encode(), key=key, digest_size=32).digest()
    more = turn - SAME_FORM[kind]
    return surrogate(kind, widened(kind, canonical, more) if more > 0 else canonical, own)


def shown(kind: str, original: str, canonical: str, given: bool = False) -> str:
    """A canonical surrogate in the original's case and separators; what a wider form has more comes last.

    Of a name as many words as the original has, the last ones or (`given`) the first ones."""
    if kind in ("ip", "ipv6"):
        return canonical
    if kind in ("card", "phone", "ssn"):
        digits = iter(canonical.lstrip("+"))
        return "".join([*(next(digits) if c.isdigit() else c for c in original), *digits])
    if kind == "iban":
        rest = iter(canonical.upper())
        return "".join([*(c if c == " " else next(rest) for c in original), *rest])
    if kind == "name":
        words, n = canonical.split(":", 1)[1].split(" "), 1 + original.count(" ")
        return " ".join(_cased(o, c) for o, c in zip(original.split(" "), words[:n] if given else words[-n:], strict=True))
    if len(canonical) != len(original):
        return canonical
    return "".join(c.upper() if o.isupper() else c for o, c in zip(original, canonical, strict=True))


def _cased(original: str, word: str) -> str:
    """A word of a name in the case of the original one; a listed name may have another length."""
    if len(word) == len(original):
        return "".join(c.upper() if o.isupper() else c for o, c in zip(original, word, strict=True))
    return word.upper() if len(original) > 1 and original.isupper() else word[:1].upper() + word[1:] if original[:1].isupper() else word


def plain(kind: str, canonical: str) -> str:
    """What tells an entity from others: of a name, the name without a gender."""
    return ":" + canonical.split(":", 1)[1] if kind == "name" else canonical


def shown_as(kind: str, canonical: str) -> list[str]:
    """What an entity may be read as: a name in full and by its last word."""
    if kind != "name":
        return [canonical]
    name = canonical.split(":", 1)[1]
    return list(dict.fromkeys([name, name.rpartition(" ")[2]]))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, canonical) of the corpus, names without genders; equal ones meet in partial sums, so frequent entities cost a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(k, plain(k, c)) for t in texts_of(batch, 0) for k, _, _, c in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["kind", "canonical"])

    return docs.select(text).mapInArrow(run, "kind string, canonical string").distinct()


def exceptions(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, surrogate) of entities whose first surrogate is an entity too; theirs are no entity's and nobody else's."""
    spark = known.sparkSession

    def first(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([surrogate(k, c, key) for k, c in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.string())]

    def tried(left: DataFrame, turn: int) -> DataFrame:
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([other(k, c, key, turn) for k, c in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.string())]

        return map_columns(left, ["kind", "canonical"], run, "step string")

    def keys(rows: DataFrame, column: str) -> DataFrame:
        """kind, canonical and key: one row for each form in which `column` may be read."""

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([shown_as(k, c) for k, c in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.list_(pa.string()))]

        each = map_columns(rows, ["kind", column], run, "_keys array<string>")
        return each.select("kind", "canonical", F.explode("_keys").alias("key")).distinct()

    taken = cut(keys(known, "canonical").select("kind", "key").distinct(), spark)
    steps = cut(map_columns(known, ["kind", "canonical"], first, "step string"), spark)
    left = cut(keys(steps, "step").join(taken, ["kind", "key"], "left_semi").select("kind", "canonical").distinct(), spark)
    if left.isEmpty():
        return left.withColumn("surrogate", F.lit(None).cast("string"))
    fine = keys(steps.join(left, ["kind", "canonical"], "left_anti"), "step").select("kind", "key")
    used, done, turn = cut(taken.unionAll(fine).distinct(), spark), None, 0
    while not left.isEmpty():
        turn += 1
        if turn > LAST_TURN:
            raise ValueError(f"no free surrogates after {LAST_TURN} turns")
        steps = cut(tried(left, turn), spark)
        read = cut(keys(steps, "step"), spark)
        # Of entities that would be read alike the smallest takes the form.
        losers = read.join(used, ["kind", "key"], "left_semi").select("kind", "canonical")
        meet = read.groupBy("kind", "key").agg(F.min("canonical").alias("least")).join(read, ["kind", "key"]).where("canonical <> least").select("kind", "canonical")
        won = cut(steps.join(losers.unionAll(meet).distinct(), ["kind", "canonical"], "left_anti").select("kind", "canonical", F.col("step").alias("surrogate")), spark)
        left = cut(left.join(won, ["kind", "canonical"], "left_anti"), spark)
        used = used.unionAll(cut(keys(won, "surrogate").select("kind", "key"), spark))
        done = won if done is None else done.unionAll(won)
    return done


def replaced(text: str | None, key: bytes, special: dict[tuple[str, str], str]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and its entities with the original offsets."""
    found = detect(text)
    if not found:
        return text, []
    out, at, rows = [], 0, []
    for kind, start, end, canonical in found:
        entity = plain(kind, canonical)
        new = special.get((kind, entity)) or surrogate(kind, entity, key)
        words = entity[1:].split(" ")
        new = shown(kind, text[start:end], new, kind == "name" and len(words) > 1 and " " not in text[start:end] and text[start:end].lower() == words[0] != words[-1])
        out += [text[at:start], new]
        at = end
        rows.append({"kind": kind, "start": start, "end": end, "surrogate": new})
    return "".join([*out, text[at:]]), rows


def replace(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Adds `entities` (kind, start and end in the original, surrogate) and replaces the text."""
    spark = docs.sparkSession
    known = cut(entities(docs, text), spark)
    special = exceptions(known, key)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (text, "entities")]
    if special.isEmpty():
        rows = docs.withColumn("_special", F.lit(None).cast("array<struct<kind:string,canonical:string,surrogate:string>>"))
    else:
        special = cut(special, spark)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sorted({(i, k, c) for i, t in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True) for k, _, _, c in ((k, a, b, plain(k, c)) for k, a, b, c in detect(t))})
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(3)], names=["_id", "kind", "canonical"])

        # Rows without an id are known by their text.
        row_id = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.col(text).cast("binary"))))
        owners = docs.where(F.col(text).isNotNull()).select(row_id, text).mapInArrow(spread, "_id string, kind string, canonical string")
        own = owners.join(special, ["kind", "canonical"]).groupBy("_id").agg(F.collect_set(F.struct("kind", "canonical", "surrogate")).alias("_special"))
        rows = docs.join(own, row_id == F.col("_id"), "left")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        both = [replaced(t, key, {(s["kind"], s["canonical"]): s["surrogate"] for s in row or ()}) for t, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        return [pa.array([t for t, _ in both], pa.string()), pa.array([e for _, e in both], kind)]

    return map_columns(rows, [text, "_special"], run, f"`{text}` string, entities array<struct<kind:string,start:int,end:int,surrogate:string>>", kept)
