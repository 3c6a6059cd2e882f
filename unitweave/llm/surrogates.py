"""Personal data replaced by keyed surrogates of the same type and format.

Every replacement is a keyed one-to-one mapping of a closed class onto itself, so the same
entity has the same replacement in every document, two entities never share one, and no
entity stays as it is (except where its class has one member). An entity is a template (its
type, its separators, the class of each character: script, case, digit) and a number in
mixed radix, and the number moves one step on a keyed cycle through all numbers of the
template. Check digits are not searched for but computed: a valid number stays valid, an
invalid one keeps its difference from the valid one. Addresses stay in their network
class, dates stay dates.

Names are mapped by the word, whatever its place: a listed first name moves inside the list
of its gender and script; any other word keeps its script, its case, its vowels' places
and its last letter, which marks gender in many languages, and never becomes a listed
name. A word in capitals follows the word. So a person is the same in all documents.

Collision check: inside a document, a replacement that is already another entity's moves
on (templates of different kinds are different, so none is expected); collisions() counts
shared surrogates over a whole corpus.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import ship

#: Common first names by gender and script.
FIRST_NAMES = {
    ("male", "latin"): (
        "Alexander", "Andreas", "Antoine", "Antonio", "Benjamin", "Carlos", "Christian", "Daniel", "David", "Diego", "Edward", "Fernando", "François", "Georg", "George", "Gerhard", "Hans", "Heinrich", "Henri", "James",
        "Javier", "Jean", "Johann", "John", "Joseph", "José", "Juan", "Jürgen", "Klaus", "Laurent", "Luc", "Luis", "Manuel", "Mark", "Markus", "Martin", "Matthew", "Michael", "Michel", "Miguel",
        "Nicolas", "Olivier", "Pablo", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Sebastian", "Stefan", "Thomas", "Wilhelm", "William", "Wolfgang",
    ),
    ("female", "latin"): (
        "Alice", "Amélie", "Ana", "Andrea", "Angelika", "Anna", "Anne", "Barbara", "Brigitte", "Camille", "Carla", "Carmen", "Catherine", "Charlotte", "Christine", "Claire", "Claudia", "Elena", "Elisabeth", "Elizabeth",
        "Emily", "Emma", "Francisca", "Françoise", "Hannah", "Heike", "Helen", "Ingrid", "Isabel", "Isabelle", "Jennifer", "Jessica", "Julia", "Karin", "Katharina", "Laura", "Linda", "Lucía", "Margaret", "María",
        "Marie", "Marta", "Mary", "Monika", "Nathalie", "Patricia", "Petra", "Pilar", "Sabine", "Sandra", "Sarah", "Sophie", "Susan", "Teresa", "Ursula", "Valérie",
    ),
    ("male", "cyrillic"): ("Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"),
    ("female", "cyrillic"): ("Анна", "Вера", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
    ("male", "greek"): ("Αλέξανδρος", "Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παναγιώτης", "Χρήστος"),
    ("female", "greek"): ("Άννα", "Βασιλική", "Γεωργία", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
}
#: Titles before names.
TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Dr", "Prof")
KINDS = ("email", "phone", "ip", "card", "iban", "secret", "name", "national_id", "birth_date", "passport", "address")
_LISTED = {name: group for group, names in FIRST_NAMES.items() for name in names}
_NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩА-Я][\w’'-]+"
#: In street names at most 80 characters, so that a long run with hyphens is not read again from each of its places.
_STREET_NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩА-Я][\w’'-]{1,80}"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Words before dates of birth and passport numbers, and in street names.
_BORN = r"(?i:born(?: on)?|date of birth|dob|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)"
_PASSPORT = r"(?i:passport|reisepass|passeport|pasaporte)(?i: (?:no|nr|number|nummer|numéro|número|n°)\.?)?"
#: A text without any of these, in small letters, capitals or with a capital, has none of what BY_WORDS finds.
_HINTS = ("born", "birth", "dob", "geboren", "geburtsdatum", "né le", "née le", "naissance", "nacido", "nacida", "nacimiento", "passport", "reisepass", "passeport", "pasaporte", "street", "road", "avenue", "lane", "drive", "boulevard", "square", "straße", "strasse", "gasse", "platz", "weg", "allee", "rue", "place", "calle", "avenida", "plaza")
_STREET, _ENDING = r"(?:Street|Road|Avenue|Lane|Drive|Boulevard|Square)", r"(?:straße|strasse|gasse|platz|weg|allee)"
PATTERN = re.compile("|".join((
    r"(?P<email>(?<![\w.+-])(?=[.+-]*+\w)[\w.+-]++@\w[\w-]*+(?:\.\w[\w-]*+)+)",
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)|(?<![\w:.])(?=[A-Fa-f:]*\d)(?:{_GROUPS}{{7}}|(?:{_GROUPS}{{0,6}})?::(?:{_GROUPS}{{0,6}})?)(?![\w:]|\.\d))",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    r"(?P<secret>(?<!\w)(?:[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?!\w))",
    r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    r"(?P<national_id>(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-HJ-NP-TV-Z])(?![\w-]))",
    r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)"
    r"|(?<![\w.])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\w)|(?<![\w.])0\d(?:[ .-]\d{2}){4}(?!\w)|(?<![\w.])(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])\d{5,8}(?!\w))",
)))
#: What has no form of its own: found by the words around it.
BY_WORDS = re.compile("|".join((
    rf"(?<!\w){_BORN}:? (?P<birth_date>\d{{4}}-\d\d-\d\d|\d\d(?P<mark>[./])\d\d(?P=mark)\d{{4}})(?!\w)",
    rf"(?<!\w){_PASSPORT}:? (?P<passport>[A-Z]{{0,2}}\d{{6,9}}[A-Z]?)(?!\w)",
    rf"(?P<address>(?<!\w)(?:[1-9]\d{{0,4}} {_STREET_NAME}(?: {_STREET_NAME})? {_STREET}|{_STREET_NAME}{_ENDING} [1-9]\d{{0,3}}|[1-9]\d{{0,3}},? (?:rue|avenue|boulevard|place) (?:(?:de la|de|du|des) )?{_STREET_NAME}|(?:Calle|Avenida|Plaza) (?:(?:de la|de|del) )?{_STREET_NAME},? [1-9]\d{{0,3}})(?!\w))",
)))
#: A text without any of these has none of the entities but names: all others have a digit or an @, but secrets of letters.
_SIGNS = re.compile("[0-9@]|AKIA|gh[pousr]_|sk-|[A-Fa-f]{32}")
_AFTER_TITLE, _AFTER_FIRST = re.compile(rf"\.? ({_NAME})(?: ({_NAME}))?"), re.compile(rf" ({_NAME})")
_POSSESSIVE = re.compile("['’][sS]$")
_DIGITS = "0123456789"
#: Characters that move together as one number.
_BLOCK = 256
#: Alphabets by script, case and kind of letter.
_SCRIPTS = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", _DIGITS, "àáâãäåèéêëìíîïòóôõöøùúûü", "çñ", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ", "ÇÑ",
    "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
)
_ALPHABET = {c: a for a in _SCRIPTS for c in a}
_LETTERS = {c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_GLOBAL, _UNIQUE_LOCAL = ipaddress.IPv6Network("2000::/3"), ipaddress.IPv6Network("fc00::/7")
#: Dates of birth move inside these days.
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 130 * 365


def _number(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest(), "big")


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: eight Feistel rounds over the next even number of bits, walked until inside."""
    if size <= 1:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(k: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{k}|{v}".encode("utf-8", "surrogatepass"), key=key, digest_size=max(16, min(64, half // 8 + 9))).digest(), "big") & mask

    while True:
        left, right = x >> half, x & mask
        for k in range(7, -1, -1) if back else range(8):
            left, right = (right ^ mixed(k, left), left) if back else (right, left ^ mixed(k, right))
        x = left << half | right
        if x < size:
            return x


def move(x: int, size: int, key: bytes, tweak: str) -> int:
    """Another number of range(size), one to one: a keyed rotation of permuted numbers, which leaves none in its place."""
    if size <= 1:
        return x
    step = 1 + _number(key, tweak, "step") % (size - 1)
    return permute((permute(x, size, key, tweak) + step) % size, size, key, tweak, back=True)


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str | None:
    """The class of a character that names and the like are made of: listed, or the letters of its block with its category. None: it stays."""
    if c in _ALPHABET or c.isascii() or not c.isalnum():
        return _ALPHABET.get(c)
    first, kind = ord(c) & ~0xFF, unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind and x not in _ALPHABET)


def reshape(text: str, sets: list[str | None], key: bytes, tweak: str) -> str:
    """text with the characters that have an alphabet moved inside it, as one number.

    A long text moves block by block, each on a cycle that the blocks before it choose: one to one too, and in time that grows with its length.
    """
    if len(text) > _BLOCK:
        out, chain = [], hashlib.blake2b(key=key)
        for k in range(0, len(text), _BLOCK):
            out.append(reshape(text[k : k + _BLOCK], sets[k : k + _BLOCK], key, f"{tweak}|{chain.hexdigest()}"))
            chain.update(text[k : k + _BLOCK].encode("utf-8", "surrogatepass"))
        return "".join(out)
    size, x, form = 1, 0, [c if s is None else s[0] for c, s in zip(text, sets, strict=True)]
    for c, s in zip(text, sets, strict=True):
        if s:
            size, x = size * len(s), x * len(s) + s.index(c)
    x, out = move(x, size, key, f"{tweak}|{''.join(form)}"), []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            x, r = divmod(x, len(s))
            c = s[r]
        out.append(c)
    return "".join(reversed(out))


def _free(text: str, fixed: int = 0) -> list[str | None]:
    """Each character's class: letters of one case, digits, or as in names; the first `fixed` stay."""
    return [None if k < fixed else _LETTERS.get(c) or alphabet(c) for k, c in enumerate(text)]


def luhn(number: str) -> bool:
    return _luhn_digit([int(c) for c in number if c in _DIGITS][:-1]) == int([c for c in number if c in _DIGITS][-1])


def _luhn_digit(body: list[int]) -> int:
    return -sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(body))) % 10


def _card(card: str, key: bytes) -> str:
    """The first digit stays; the last keeps its difference from the check digit."""
    at = [k for k, c in enumerate(card) if c in _DIGITS]
    off = (int(card[at[-1]]) - _luhn_digit([int(card[k]) for k in at[:-1]])) % 10
    body = reshape(card[: at[-1]], [_DIGITS if k in at[1:] else None for k in range(at[-1])], key, f"card|{off}")
    return f"{body}{(_luhn_digit([int(body[k]) for k in at[:-1]]) + off) % 10}{card[at[-1] + 1 :]}"


def address_class(ip: str) -> str:
    a, b = (int(x) for x in ip.split(".")[:2])
    private = a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168)
    return "private" if private else "loopback" if a == 127 else "other" if a == 0 or a >= 224 else "public"


def _ip(ip: str, key: bytes) -> str:
    """Public addresses among public ones; others inside their network."""
    x, own = int.from_bytes(bytes(int(p) for p in ip.split(".")), "big"), address_class(ip)
    bits = {"private": {10: 24, 172: 20, 192: 16}.get(x >> 24, 0), "public": 32}.get(own, 24)
    net, x = x >> bits << bits, x & ((1 << bits) - 1)
    while True:
        x = move(x, 1 << bits, key, f"ip|{own}|{net}")
        found = ".".join(map(str, (net | x).to_bytes(4, "big")))
        if address_class(found) == own:
            return found


def hex_case(s: str) -> str:
    """The case of a hex number's letters, a class that a replacement keeps."""
    lower, upper = any(c in "abcdef" for c in s), any(c in "ABCDEF" for c in s)
    return "mixed" if lower and upper else "lower" if lower else "upper" if upper else "digits"


def _hex(entity: str, key: bytes, kind: str, fixed: int = 0, same=lambda s: None) -> str:
    """Hex digits in one case among those with a letter; digits alone among digits; where cases are mixed, place by place."""
    case = hex_case(entity)
    whole = {"digits": _DIGITS, "lower": _DIGITS + "abcdef", "upper": _DIGITS + "ABCDEF"}.get(case)
    sets = [None if k < fixed or not c.isalnum() else whole or next(a for a in (_DIGITS, "abcdef", "ABCDEF") if c in a) for k, c in enumerate(entity)]
    found = entity
    while True:
        found = reshape(found, sets, key, f"{kind}|{case}|{entity[:fixed]}")
        if hex_case(found) == case and same(found) == same(entity):
            return found


def address6_class(ip: str) -> str:
    try:
        a = ipaddress.IPv6Address(ip)
    except ValueError:
        return "invalid"
    return "loopback" if a.is_loopback else "link" if a.is_link_local else "multicast" if a.is_multicast else "private" if a in _UNIQUE_LOCAL else "global" if a in _GLOBAL else "other"


def _ip6(ip: str, key: bytes) -> str:
    """The first digit of a global address stays, of others the first group."""
    own = address6_class(ip)
    return _hex(ip, key, "ip6", 0 if ip.startswith("::") else 1 if own == "global" else ip.index(":"), address6_class)


_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _dni(number: str) -> bool:
    return _DNI[int(number[:8]) % 23] == number[-1]


def _national_id(entity: str, key: bytes) -> str:
    """The letter of a Spanish number keeps its difference from the right one; the last letter of a British one is A to D."""
    if re.fullmatch(r"\d{8}-?[A-Z]", entity):
        off = _DNI.index(entity[-1]) - int(entity[:8]) % 23
        body = reshape(entity[:8], [_DIGITS] * 8, key, f"dni|{off % 23}|{len(entity)}")
        return body + entity[8:-1] + _DNI[(int(body) + off) % 23]
    return reshape(entity, [*_free(entity[:-1]), "ABCD" if entity[-1] in "ABCD" else _DIGITS], key, "national")


def _mod97(iban: str) -> int:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(iban: str, key: bytes) -> str:
    """The country stays; the account moves, and the check digits keep their difference from the right ones."""
    right = lambda s: 98 - _mod97(s[:2] + "00" + s[4:])
    off = (int(iban[2:4]) - right(iban)) % 100
    body = reshape(f"{iban[:2]}00{iban[4:]}", _free(iban, 4), key, f"iban|{off}")
    return f"{iban[:2]}{(right(body) + off) % 100:02d}{body[4:]}"


def _email(email: str, key: bytes) -> str:
    """User and host move; the top-level part, and example.* reserved for examples, stay."""
    user, host = email.rsplit("@", 1)
    labels = host.split(".")
    kept = 2 if labels[-2:-1] == ["example"] else 1
    tail = "." + ".".join(labels[-kept:])
    free = ".".join(labels[:-kept])
    if not free:
        return reshape(user, _free(user), key, f"email|@{host}") + "@" + host
    return reshape(f"{user}@{free}", _free(f"{user}@{free}"), key, f"email|{tail}") + tail


def _phone(phone: str, key: bytes) -> str:
    """A country code that stands apart, and a leading zero, stay."""
    fixed = re.match(r"(?:\+\d{1,3}(?=[ .-]))?", phone).end()
    zero = re.match(r"[ .-]?\(?0", phone[fixed:])
    fixed += zero.end() if zero else 0
    return reshape(phone, _free(phone, fixed), key, f"phone|{phone[:fixed]}")


def _birth_date(date: str, key: bytes) -> str:
    """Another day between 1900 and 2029 in the same form; what is no such date moves by its digits."""
    parts = re.split("[-./]", date)
    year, month, day = parts if len(parts[0]) == 4 else parts[::-1]
    try:
        n = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
        if not 0 <= n < _DAYS:
            raise ValueError
    except ValueError:
        return reshape(date, _free(date), key, "no date")
    d = datetime.date.fromordinal(_FIRST_DAY + move(n, _DAYS, key, f"birth|{'-' if len(parts[0]) == 4 else date[2]}"))
    return d.isoformat() if len(parts[0]) == 4 else f"{d.day:02d}{date[2]}{d.month:02d}{date[2]}{d.year:04d}"


def _address(address: str, key: bytes) -> str:
    """House number and name of the street move; words for streets, and articles, stay."""
    out = []
    for part in re.split("([ ,]+)", address):
        ending = re.search(_ENDING + "$", part)
        if part.isdigit():
            part = reshape(part, ["123456789"] + [_DIGITS] * (len(part) - 1), key, "house")
        elif ending:
            part = name_word(part[: ending.start()], key) + ending[0]
        elif part[:1].isupper() and not re.fullmatch(_STREET + "|Calle|Avenida|Plaza", part):
            part = name_word(part, key)
        out.append(part)
    return "".join(out)


def name_word(word: str, key: bytes) -> str:
    """The surrogate of a word of a name; parts joined by a hyphen or an apostrophe are words of their own."""
    return "".join(p if p in "-'’" else _name_part(p, key) for p in re.split("([-'’])", word))


def _name_part(word: str, key: bytes) -> str:
    if len(word) > 1 and word.isupper():  # follows the word in small letters
        small = word[0] + word[1:].lower()
        if small != word and small.upper() == word:
            found = _name_part(small, key).upper()
            if len(found) == len(word) or small in _LISTED:
                return found
    group = _LISTED.get(word)
    if group:
        names = FIRST_NAMES[group]
        return names[move(names.index(word), len(names), key, f"first|{group}")]
    kept = 1 if len(word) > 2 else 0
    sets = [alphabet(c) for c in word[: len(word) - kept]] + [None] * kept
    while True:
        word = reshape(word, sets, key, "name")
        if word not in _LISTED:
            return word


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """The replacement of an entity; of a name, of one word of it."""
    if kind == "ip":
        return _ip6(entity, key) if ":" in entity else _ip(entity, key)
    if kind == "secret":
        if re.fullmatch("[0-9A-Fa-f]+", entity):
            return _hex(entity, key, "secret")
        return reshape(entity, _free(entity, 4 if entity[:4] == "AKIA" or entity[3:4] == "_" else 3), key, "secret")
    if kind == "passport":
        return reshape(entity, _free(entity), key, "passport")
    by_kind = {"email": _email, "iban": _iban, "card": _card, "national_id": _national_id, "phone": _phone, "name": name_word, "birth_date": _birth_date, "address": _address}
    return by_kind[kind](entity, key)


@lru_cache(maxsize=1)
def _automaton():
    """Of titles, listed first names and hints, also in capitals."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for role, words in (("hint", _HINTS), ("title", TITLES), ("first", _LISTED)):
        for word in words:
            for form in {word, word.upper(), word.capitalize() if role == "hint" else word}:
                found.add_word(form, (form, role))
    found.make_automaton()
    return found


def people(text: str) -> tuple[set[str], bool]:
    """Words of names: those behind a title, and a listed first name with the capitalised word behind it. And: is a hint there?"""
    found, hint = set(), False
    for end, (form, role) in _automaton().iter(text):
        if role == "hint":
            hint = True
            continue
        start = end + 1 - len(form)
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        m = (_AFTER_TITLE if role == "title" else _AFTER_FIRST).match(text, end + 1)
        if m and (role == "first" or not form.isupper() or m[1].isupper()):  # MS SMITH, not MS Windows
            found.update(w for w in (None if role == "title" else form, *m.groups()) if w)
    return {w for w in (_POSSESSIVE.sub("", w).rstrip("-'’") for w in found) if len(w) > 1}, hint


def mentions(text: str, words: set[str]) -> list[tuple[int, int]]:
    """Places where one of the words stands by itself: from the left, of several at one place the longest, none inside another."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, len(w))
    found.make_automaton()
    inner = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    places = sorted((end + 1 - n, -n) for end, n in found.iter(text) if not inner(end - n) and not inner(end + 1))
    out, at = [], 0
    for start, n in places:
        if start >= at:
            at = start - n
            out.append((start, at))
    return out


def pseudonymize(text: str | None, key: bytes) -> tuple[str | None, dict[str, int], list[tuple[str, str, str]]]:
    """The text with surrogates, entities by kind, and (kind, entity, surrogate) of each different entity."""
    if not text:
        return text, {}, []
    spans: list[tuple[int, int, str, str]] = []  # start, end, kind, entity
    words, hint = people(text)
    if _SIGNS.search(text):
        for m in BY_WORDS.finditer(text) if hint else ():
            kind = next(k for k in ("birth_date", "passport", "address") if m[k])
            spans.append((*m.span(kind), kind, m[kind]))
        own = list(spans)
        spans += [(*m.span(), m.lastgroup, m[0]) for m in PATTERN.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _, _ in own)]
        spans.sort()
    if words:  # every mention of the same words, also in capitals, is the same person
        taken = iter([*spans, (len(text), len(text), "", "")])
        a, b, *_ = next(taken)
        for start, end in mentions(text, words | {w.upper() for w in words}):
            while b <= start:
                a, b, *_ = next(taken)
            if a >= end:
                spans.append((start, end, "name", text[start:end]))
    if not spans:
        return text, {}, []
    spans.sort()
    new, used = {}, set()
    for kind, entity in sorted({(k, e) for _, _, k, e in spans}):
        found = surrogate(kind, entity, key)
        while found in used:
            found = surrogate(kind, found, key)
        used.add(found)
        new[kind, entity] = found
    out, at, counts = [], 0, {}
    for a, b, kind, entity in spans:
        out += [text[at:a], new[kind, entity]]
        at, counts[kind] = b, counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]), counts, [(k, e, s) for (k, e), s in new.items()]


def replace_entities(docs: DataFrame, key: str = "unitweave-surrogates") -> DataFrame:
    """docs with `text` replaced, and n_<kind> counts of replaced mentions appended.

    Columns of docs keep names and order; where one is named like a count, the count
    is left out of the result. A null text stays null, an empty one empty; texts of any
    length are read whole. Repeated rows get the same replacement, and so do mentions of
    one entity in any document. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    at, secret = docs.columns.index("text"), key.encode()[:64]
    kinds = [k for k in KINDS if f"n_{k}" not in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pseudonymize(t, secret) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([d[0] for d in done], pa.string())
            columns += [pa.array([d[1].get(k, 0) for d in done], pa.int32()) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(f"n_{k}" for k in kinds)])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"n_{k} int" for k in kinds])
    return docs.mapInArrow(run, schema)


def entities(docs: DataFrame, key: str = "unitweave-surrogates") -> DataFrame:
    """kind, entity, surrogate: a row for each different entity of each batch of documents."""
    ship(docs.sparkSession)
    secret = key.encode()[:64]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({e for t in batch.column(0).to_pylist() for e in pseudonymize(t, secret)[2]})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["kind", "entity", "surrogate"])

    return docs.select(docs["text"].cast("string")).mapInArrow(run, "kind string, entity string, surrogate string")


def collisions(docs: DataFrame, key: str = "unitweave-surrogates") -> DataFrame:
    """kind, surrogate, entities: surrogates shared by different entities of a corpus, or an entity with several. Expected to be empty."""
    pairs = entities(docs, key).distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")
    torn = pairs.groupBy("kind", F.col("entity").alias("surrogate")).agg(F.count("*").alias("entities")).where("entities > 1")
    return shared.unionByName(torn)
