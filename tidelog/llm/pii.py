"""PII: keyed surrogates that keep type, format, script and gender.

Every entity is replaced by a keyed permutation of its own format: the characters that vary (digits, letters of one
alphabet and case) form a mixed-radix number, and a Feistel network with HMAC rounds, walked until it stays in range,
permutes all numbers of that format. A permutation never gives two entities one surrogate and always gives one entity
the same, in any document, task or run with the key: distinctness and coreference hold over the whole corpus without a
shuffle. A surrogate is never its entity: fixed points of a permutation are exchanged in a cycle.

Entities are compared by what they are, not by how they are written: numbers by their digits, IBANs by letters and
digits, with check digits that are right if the entity's are. Known first names permute within the list of their gender.
Of other names' letters, vowels become vowels and consonants consonants of their alphabet, so that a surrogate can be
read. Persons are found behind a title or by a known first name with a name behind it; what names a person there is
replaced in the rest of the text too. Each batch's replacements are checked: two entities of a type with one surrogate
get others, drawn anew for both.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import mapped

FEMALE = "Alice Amelia Anna Camille Carla Carmen Charlotte Chloe Clara Elena Elizabeth Emma Eva Hannah Helga Ines Isabel Jane Julia Karin Laura Lea Lucia Luisa Maria Marie Mary Nina Olivia Paula Petra Rosa Sarah Sofia Sophie Susan Ursula Valerie".split()
MALE = "Alan Andreas Antonio Carlos Charles Claude David Diego Edward Emil Francisco Frank George Hans Henri Hugo Jack James Javier Jean John Jorge Juan Karl Klaus Louis Lukas Manuel Marc Michael Otto Pablo Paul Pedro Peter Pierre Robert Thomas".split()
_TITLES = {"Mr": MALE, "Herr": MALE, "Monsieur": MALE, "Señor": MALE, "Don": MALE, "Mrs": FEMALE, "Ms": FEMALE, "Miss": FEMALE, "Frau": FEMALE, "Madame": FEMALE, "Mme": FEMALE, "Señora": FEMALE, "Doña": FEMALE}
#: Titles that say no gender.
_OTHERS = "Dr Dra Prof Professor Professeur Profesor Profesora Doctor Doctora Docteur Doktor Mx Sir Dame Lord Lady Rev Reverend Hon Capt Captain Col Colonel Lt Lieutenant Sgt Sergeant Gen Maj Senator Judge Mlle Mademoiselle Sra Srta Señorita Hr".split()

#: Alphabets: a character varies within its own.
_SETS = [string.digits, string.ascii_lowercase, string.ascii_uppercase, "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "".join(c for c in map(chr, range(0x100, 0x180)) if c.islower()), "".join(c for c in map(chr, range(0x100, 0x180)) if c.isupper()), "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
_SET_OF = {c: s for s in _SETS for c in s}
_VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýāăąēĕėęěĩīĭįıōŏőœũūŭůűųŷαεηιουωаеиоуыэюяё" + "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýāăąēĕėęěĩīĭįōŏőœũūŭůűųŷαεηιουωаеиоуыэюяё".upper())
#: The same, with vowels and consonants apart.
_SOUND_OF = {c: "".join(x for x in s if (x in _VOWELS) == (c in _VOWELS)) for s in _SETS[1:] for c in s}
_HEX = "0123456789abcdef"

_UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩЁА-Я" + "".join(c for c in map(chr, range(0x100, 0x180)) if c.isupper())
_LETTER = r"[^\W\d_]"
#: A name's word: O'Brien, McDonald, Smith-Jones; 's behind it is no part of it.
_NAME = rf"[{_UPPER}](?:{_LETTER}++|['’][{_UPPER}]{_LETTER}++)(?:['’-][{_UPPER}]{_LETTER}*+)*+"
_INITIAL = rf"[{_UPPER}]\.(?:[ -]?[{_UPPER}]\.)*+"
_PARTICLE = r"(?:von|van|vom|zu|zum|zur|de|der|den|del|della|di|da|du|des|dos|das|la|le|bin|ibn|al|y|ter|ten)"
#: Capitalised words that follow a name without being part of it.
_NOT_NAMES = "The|He|She|It|They|We|You|In|On|At|And|But|Or|For|This|That|These|Those|There|When|Then|If|As|His|Her|Who|What|Is|Was|Has|Der|Die|Das|Er|Sie|Es|Und|Im|Am|Il|Elle|Les|Los|Las|El|Et|Pero|Mais|" + "|".join([*_TITLES, *_OTHERS])
_MORE = rf"(?: (?:{_PARTICLE} ){{0,3}}(?:{_INITIAL}|(?!(?:{_NOT_NAMES})(?!{_LETTER})){_NAME}))"
_FIRST_NAMES = "|".join(sorted({*FEMALE, *MALE}))
_TITLE = rf"(?:{'|'.join([*_TITLES, *_OTHERS])}|(?:M|Fr|Sr)(?=\.))"
_KINDS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:(?:sk|pk|ghp|xox[bp])[-_][0-9A-Za-z_-]{16,}+|AKIA[0-9A-Z]{16}|(?=[0-9]*+[a-f])[0-9a-f]{32,}+|(?=[0-9]*+[A-F])[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:(?! (?:[0-9]{1,3}\.){3}[0-9])[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "person": rf"(?<![^\W_])(?:{_TITLE}(?:\.?[ \n]{_TITLE}){{0,2}}\.?[ \n](?:{_PARTICLE} ){{0,3}}(?:{_INITIAL}|{_NAME}){_MORE}*+|(?:{_FIRST_NAMES})(?!{_LETTER})(?:\n(?!(?:{_NOT_NAMES})(?!{_LETTER})){_NAME}|{_MORE}){_MORE}*+)",
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()))
#: A text without any of these has no entity: cheaper than the pattern, and what each begins with is cheaper still.
_HINT = re.compile(rf"{_TITLE}\.?[ \n]|(?:{_FIRST_NAMES})[ \n]|(?:sk|pk|ghp|xox[bp])[-_]|AKIA")
_BEGINS = [*FEMALE, *MALE, *_TITLES, *_OTHERS, "M.", "Fr.", "Sr.", "sk-", "sk_", "pk-", "pk_", "ghp-", "ghp_", "xoxb", "xoxp", "AKIA"]
_SIGN, _LETTERS_ALONE = re.compile("[0-9@]"), re.compile("[a-f]{32}|[A-F]{32}")


def hinted(text: str) -> bool:
    return bool(_SIGN.search(text) or any(map(text.__contains__, _BEGINS)) and _HINT.search(text) or _LETTERS_ALONE.search(text))


#: Characters that are permuted as one number, and rounds of the network.
BLOCK, ROUNDS = 160, 6


def _feistel(key: bytes, label: str, x: int, size: int, back: bool = False) -> int:
    """A permutation of range(size), by key and label; back: its inverse."""
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8

    def drawn(i: int, b: int) -> int:
        message = f"{label}/{size}/{i}/".encode() + b.to_bytes(width, "big")
        d, n = b"", 0
        while len(d) < width:
            d += hmac.digest(key, message + bytes([n]), "sha256")
            n += 1
        return int.from_bytes(d[:width], "big") & mask

    while True:
        a, b = x >> half, x & mask
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            a, b = (b ^ drawn(i, a), a) if back else (b, a ^ drawn(i, b))
        x = a << half | b
        if x < size:
            return x


def permuted(key: bytes, label: str, text: str, sets: Callable[[str], str | None] = _SET_OF.get) -> str:
    """text with its varying characters permuted; others, and so the format, stay. Never text itself, if another is there.

    Beyond BLOCK characters, blocks are permuted in turn, each by a digest of those before it: still a permutation, in
    time that grows with the length.
    """
    if len(text) > BLOCK:
        before, out = hashlib.sha256(), []
        for i in range(0, len(text), BLOCK):
            out.append(permuted(key, f"{label}:{before.hexdigest()}" if i else label, text[i : i + BLOCK], sets))
            before.update(text[i : i + BLOCK].encode())
        return "".join(out)
    own = [sets(c) for c in text]
    x, size = 0, 1
    for c, s in zip(text, own, strict=True):
        if s:
            x = x * len(s) + s.index(c)
            size *= len(s)
    form = "".join(s[0] if s else c for c, s in zip(text, own, strict=True))
    x = moved(key, f"{label}:{form}", x, size)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if s := own[i]:
            x, k = divmod(x, len(s))
            out[i] = s[k]
    return "".join(out)


def moved(key: bytes, label: str, x: int, size: int) -> int:
    """A permutation of range(size) without fixed points, if size > 1: one permutation says the order in a single cycle, x is followed by the next."""
    return _feistel(key, label, (_feistel(key, label, x, size, back=True) + 1) % size, size) if size > 1 else x


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _within(text: str, keep: str, new: str) -> str:
    """text with the characters of `keep` replaced by those of `new`, one by one."""
    it = iter(new)
    return "".join(next(it) if c in keep else c for c in text)


def _digits(key: bytes, kind: str, text: str, first: int = 0) -> str:
    """The digits from place `first` on, permuted; punctuation stays where it is, so one number has one surrogate however it is written."""
    own = "".join(c for c in text if c in string.digits)
    return _within(text, string.digits, own[:first] + permuted(key, f"{kind}:{own[:first]}", own[first:]))


def _card(key: bytes, text: str) -> str:
    """A number with a valid check digit gets a valid one, any other an invalid one."""
    own = "".join(c for c in text if c in string.digits)
    head = permuted(key, "card", own[:-1])
    # The tail's distance from the right check digit stays: one number has one surrogate, and a valid one a valid one.
    right = lambda x: next(k for k in range(10) if _luhn(x + str(k)) == 0)
    return _within(text, string.digits, head + str((int(own[-1]) - right(own[:-1]) + right(head)) % 10))


def _iban(key: bytes, text: str) -> str:
    """However it is spaced. Country and format stay; check digits are right if they are, by ISO 7064, and as wrong if they aren't."""
    own = text.replace(" ", "")
    body = permuted(key, f"iban:{own[:2]}", own[4:])
    right = lambda x: (98 - int("".join(str(int(c, 36)) for c in x + own[:2] + "00")) % 97) % 100
    new = iter(f"{own[:2]}{(int(own[2:4]) - right(own[4:]) + right(body)) % 100:02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _ip(key: bytes, text: str) -> str:
    x = 0
    for part in text.split("."):
        x = x << 8 | int(part)
    x = moved(key, "ip", x, 1 << 32)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _cased(text: str, low: str) -> str:
    return "".join(n.upper() if c.isupper() else n for c, n in zip(text, low, strict=True))


def _email(key: bytes, text: str) -> str:
    """Local part and domain names permuted apart, as lower case, so that a domain stays one domain; the last label stays."""
    local, _, domain = text.rpartition("@")
    names, _, last = domain.rpartition(".")
    return f"{_cased(local, permuted(key, 'local', local.lower()))}@{_cased(names, permuted(key, 'domain', names.lower()))}.{last}"


def _word(key: bytes, word: str, names: list[str] | None) -> str:
    for own in (FEMALE, MALE) if names is None else (names,):
        if word in own:
            return own[moved(key, f"name:{own[0]}", own.index(word), len(own))]
    new = permuted(key, "name", word, _SOUND_OF.get)
    while new in FEMALE or new in MALE:  # those are the surrogates of known names
        new = permuted(key, "name", new, _SOUND_OF.get)
    return new


_WORD_ALONE = re.compile(rf"(?<![^\W_]){_NAME}")
_TITLES_BEFORE = re.compile(rf"(?:{_TITLE}\.?[ \n])*")
_WORDS = re.compile(rf"{_NAME}|[{_UPPER}](?!{_LETTER})")


def _person(key: bytes, text: str) -> str:
    """Titles and particles stay; a known first name becomes another of its gender, other names keep their script, length and case."""
    head = _TITLES_BEFORE.match(text).end()
    return text[:head] + _WORDS.sub(lambda m: _word(key, m[0], None), text[head:])


def names_of(text: str, persons: list[str]) -> set[str]:
    """Words of the persons found in a text that stand for them alone as well.

    The first ones do, up to a family name; those behind only if the text doesn't have them in lower case too.
    """
    sure, more = set(), set()
    for person in persons:
        done = False
        for m in _WORDS.finditer(person, _TITLES_BEFORE.match(person).end()):
            if len(m[0]) > 1:
                (more if done else sure).add(m[0])
                done = done or m[0] not in FEMALE and m[0] not in MALE
    if more:
        more.difference_update([w.capitalize() for w in re.findall(rf"{_LETTER}+", text) if w.islower()])
    return sure | more


def _secret(key: bytes, text: str) -> str:
    m = re.match(r"(?:sk|pk|ghp|xox[bp])[-_]|AKIA", text)
    head = m[0] if m else ""
    body = text[len(head) :]
    if not head:
        low = body.islower()
        return permuted(key, "hex", body, lambda c: _HEX if low else _HEX.upper())
    return head + permuted(key, f"secret:{head}", body)


#: Country codes of one and two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _phone(key: bytes, text: str) -> str:
    """A country code stays; without one, a number of ten digits is one of +1."""
    own = "".join(c for c in text if c in string.digits)
    code = next((own[:k] for k in (1, 2) if own[:k] in _CODES), own[:3]) if "+" in text else ""
    rest = own[len(code) :]
    new = permuted(key, f"phone:{code or ('1' if len(rest) == 10 else '')}", rest)
    return _within(text, string.digits, code + new)


_MAKE: dict[str, Callable[[bytes, str], str]] = {
    "email": _email, "secret": _secret, "ip": _ip, "card": _card, "person": _person, "phone": _phone,
    "iban": _iban,
    "ssn": lambda key, t: _digits(key, "ssn", t),
}


@lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, text: str) -> str:
    return _MAKE[kind](key, text)


_SAME: dict[str, Callable[[str], str]] = {
    "email": str.lower,
    "iban": lambda t: t.replace(" ", ""),
    **dict.fromkeys(("ssn", "card", "phone"), lambda t: re.sub("[^+0-9]", "", t)),
    "person": lambda t: t.replace("\n", " "),
}


def distinct(key: bytes, kind: str, text: str, seen: dict[tuple[str, str], str]) -> str:
    """The surrogate of an entity; seen: (type, surrogate) to entity. Where another entity has it, it is drawn anew by a key of that draw."""
    same, new, draw = _SAME.get(kind, str)(text), surrogate(key, kind, text), 0
    while seen.setdefault((kind, _SAME.get(kind, str)(new)), same) != same or new == text:
        draw += 1
        new = surrogate(hmac.digest(key, b"draw %d" % draw, "sha256"), kind, text)
        if draw == 64:  # a format of so few members has no other
            break
    return new


def replace(text: str, key: bytes, seen: dict[tuple[str, str], str] | None = None) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and how many of each type. seen: see distinct; kept over texts, it keeps their entities apart."""
    counts: dict[str, int] = {}
    if not hinted(text):
        return text, counts
    known = {} if seen is None else seen

    def one(m: re.Match) -> str:
        kind = m.lastgroup
        counts[kind] = counts.get(kind, 0) + 1
        return distinct(key, kind, m[0], known)

    found = list(_PATTERN.finditer(text))
    names = names_of(text, [m[0] for m in found if m.lastgroup == "person"])

    def again(m: re.Match) -> str:
        if m[0] not in names:
            return m[0]
        counts["person"] = counts.get("person", 0) + 1
        return _word(key, m[0], None)

    between = lambda a, b: _WORD_ALONE.sub(again, text[a:b]) if names else text[a:b]
    out, at = [], 0
    for m in found:
        out += [between(at, m.start()), one(m)]
        at = m.end()
    return "".join([*out, between(at, len(text))]), counts


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced, types) for each row: the whole text with surrogates; types counts them by type.

    A null text stays null, with nothing replaced; an empty one stays empty. Repeated rows give repeated results. The
    key must be kept secret, and the same for tables whose entities are to be compared. Nothing is shuffled. Texts are
    searched whole, one at a time. An entity written in several ways has one surrogate, written alike. Should two
    entities of a batch meet in one, the later is drawn anew: their formats' permutations make that impossible within a
    format, so it can only concern entities of unlike formats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str], str] = {}
            made, n, types = [], [], []
            for text in b.column("text").to_pylist():
                new, counts = (None, {}) if text is None else replace(text, key, seen)
                made.append(new)
                n.append(sum(counts.values()))
                types.append(list(counts.items()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.string()), pa.array(n, pa.int64()), pa.array(types, pa.map_(pa.string(), pa.int64()))], ["doc_id", "text", "n_replaced", "types"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, text string, n_replaced long, types map<string, long>")


def derived_key(phrase: str) -> bytes:
    return hashlib.sha256(phrase.encode()).digest()
