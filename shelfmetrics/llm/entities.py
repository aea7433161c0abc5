"""Personal data in a text, and replacements of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Mention:
    """One place in a text. ``value`` is the entity's normal form: the same in every spelling."""

    start: int
    end: int
    kind: str
    value: str


# Words that announce a name, and the gender they tell.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Signor": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f",
    "Signora": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Доктор": "n",
}

# What syllables and endings of invented names are made of.
SYLLABLES = {
    "latin": ("ba", "do", "ri", "le", "ma", "ne", "so", "ta", "vi", "ka", "ro", "mi", "lu", "ze", "pa", "go"),
    "cyrillic": ("ба", "до", "ри", "ле", "ма", "не", "со", "та", "ви", "ка", "ро", "ми", "лу", "зе", "па", "го"),
    "greek": ("βα", "δο", "ρι", "λε", "μα", "νε", "σο", "τα", "βι", "κα", "ρο", "μι", "λου", "ζε", "πα", "γο"),
}
ENDINGS = {
    ("latin", "m"): ("n", "r", "s", "l"), ("latin", "f"): ("na", "ra", "la", "sa"), ("latin", "n"): ("ne", "re", "le", "se"),
    ("cyrillic", "m"): ("н", "р", "с", "л"), ("cyrillic", "f"): ("на", "ра", "ла", "са"), ("cyrillic", "n"): ("не", "ре", "ле", "се"),
    ("greek", "m"): ("νος", "ρος", "λος", "σος"), ("greek", "f"): ("να", "ρα", "λα", "σα"), ("greek", "n"): ("νι", "ρι", "λι", "σι"),
}

KINDS = ("email", "secret", "iban", "ip", "ssn", "card", "phone", "name")
_TITLE = "|".join([*TITLES, *(title.upper() for title in TITLES)])
_NAME_WORD = r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}})
    | (?P<secret>\bAKIA[0-9A-Z]{{16}}\b
        | (?i:\b(?:password|passwd|token|secret|api_?key)["']?\s*[=:]\s*["']?)
            (?P<held>(?=(?:[^\s"']*?[A-Za-z0-9]){{4}})[^\s"']{{7,}}[^\s"'.,;:)\]}}]))
    | (?P<iban>\b[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
    | (?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))
    | (?P<ssn>(?<![\d-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\d-]))
    | (?P<card>(?<![\d+])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?!\d))
    | (?P<phone>(?<![\w+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:[ .-]?[0-9]{{2,4}}){{2,3}}
        |\([0-9]{{3}}\)[ ]?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}})(?!\d))
    | (?P<name>\b(?P<title>{_TITLE})\b\.?[ ](?P<person>{_NAME_WORD}(?:[ ]{_NAME_WORD}){{0,2}}))
    """,
    re.VERBOSE,
)

_FIRST_LETTERS = "".join(sorted({title[0] for title in TITLES} | {"A"}))

#: Matches every text that may hold an entity; the same in Java and Python. The look-ahead keeps
#: the long alternation from being tried at every letter.
MAY_HOLD = rf"[0-9@=:]|(?<![A-Za-z])(?=[{_FIRST_LETTERS}])(?:AKIA|{_TITLE})"


def luhn_valid(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        double = int(digit) * (1 + place % 2)
        total += double - 9 * (double > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN")
    return next((s for s in ("cyrillic", "greek") if name.startswith(s.upper())), "latin")


def _surname_gender(word: str, script: str) -> str:
    """Only some scripts inflect surnames."""
    if script == "latin":
        return "n"
    return "f" if word.casefold().endswith(("а", "я", "η", "ου", "α")) else "m"


def _name_words(match: re.Match) -> Iterator[Mention]:
    """The capitalised words after a title; every word is an entity, so partial mentions agree.

    A word where another entity or title begins ends the name.
    A single word is a surname; of several the last one is, and the title's gender is theirs.
    """
    gender = next(TITLES[title] for title in TITLES if match["title"] in (title, title.upper()))
    words = []
    for word in re.finditer(_NAME_WORD, match["person"]):
        if not word[0][0].isupper():
            break
        other = _PATTERN.match(match.string, match.start("person") + word.start())
        if other and (other["name"] or _checked(other)):
            break
        words.append(word)
    for place, word in enumerate(words):
        script = script_of(word[0])
        own = _surname_gender(word[0], script) if place == len(words) - 1 else gender
        start = match.start("person") + word.start()
        yield Mention(start, start + len(word[0]), "name", f"{script}:{own}:{word[0].casefold()}")


def _checked(match: re.Match) -> Mention | None:
    """The entity of a match that is no name; none if its check digits are wrong."""
    kind = next(name for name in KINDS if match[name])
    span, raw = match.span(), match[0]
    if kind == "secret" and match["held"]:
        span, raw = match.span("held"), match["held"]
    if kind == "card":
        raw = re.sub(r"\D", "", raw)
        if not luhn_valid(raw) or raw[0] == "0":
            return None
    elif kind == "iban":
        # capitals behind the number may look like more groups of it
        ends = [place for place, c in enumerate(raw) if c == " "] + [len(raw)]
        numbers = ((end, raw[:end].replace(" ", "")) for end in reversed(ends))
        valid = next(((end, number) for end, number in numbers if len(number) >= 12 and iban_valid(number)), None)
        if valid is None:
            return None
        span, raw = (span[0], span[0] + valid[0]), valid[1]
    elif kind == "phone":
        raw = re.sub(r"[^\d+]", "", raw)
    elif kind == "ip":
        raw = ".".join(str(int(octet)) for octet in raw.split("."))  # as written, an octet may begin with 0
    elif kind == "email":
        raw = raw.lower()
    return Mention(*span, kind, raw)


def find(text: str) -> list[Mention]:
    """All mentions in order; they do not overlap.

    The search goes on behind what was accepted, so words and digits that a match has only
    looked at may begin another mention.
    """
    found: list[Mention] = []
    known: dict[str, str] = {}
    at = 0
    while match := _PATTERN.search(text, at):
        if match["name"]:
            at = match.start("person")
            for mention in _name_words(match):
                found.append(mention)
                known[text[mention.start : mention.end].casefold()] = mention.value
                at = mention.end
            continue
        mention = _checked(match)
        if mention:
            found.append(mention)
        at = mention.end if mention else match.start() + 1
    if known:
        found += _later_mentions(text, known, found)
        found.sort(key=lambda mention: mention.start)
    return found


def _later_mentions(text: str, known: dict[str, str], found: list[Mention]) -> list[Mention]:
    """The same names without a title, where they are capitalised."""
    taken = {place for mention in found for place in range(mention.start, mention.end)}
    more = []
    for word in re.finditer(_NAME_WORD, text):
        value = known.get(word[0].casefold())
        if value and word[0][0].isupper() and word.start() not in taken:
            more.append(Mention(word.start(), word.end(), "name", value))
    return more


# --- replacements -------------------------------------------------------------------------------


class _Draw:
    """A stream of numbers from key, entity and attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.at, self.held = key, "\x1f".join(parts).encode(), 0, b""

    def below(self, limit: int) -> int:
        if len(self.held) < 8:
            self.held = hashlib.blake2b(self.seed + self.at.to_bytes(4, "big"), key=self.key).digest()
            self.at += 1
        number, self.held = int.from_bytes(self.held[:8], "big"), self.held[8:]
        return number % limit

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case; the rest stays."""
        hexadecimal = re.fullmatch(r"(?=.*[a-f])(?=.*\d)[0-9a-f]{8,}", text) is not None
        return "".join(
            "0123456789abcdef"[self.below(16)]
            if hexadecimal
            else "0123456789"[self.below(10)]
            if c.isdigit()
            else chr(ord("a") + self.below(26))
            if "a" <= c <= "z"
            else chr(ord("A") + self.below(26))
            if "A" <= c <= "Z"
            else c
            for c in text
        )


#: Draws after which the space of a surrogate counts as crowded.
CROWDED = 4


def _address(draw: _Draw, value: str, attempt: int) -> str:
    """Private stays in its private network, public stays public.

    Where a network has no room left, later attempts draw from the largest private one, then from
    the reserved block that no host has.
    """
    given = ipaddress.IPv4Address(value)
    for prefix in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16"):
        network = ipaddress.IPv4Network(prefix)
        if given in network:
            if attempt >= CROWDED:
                network = ipaddress.IPv4Network("10.0.0.0/8" if attempt < 2 * CROWDED else "240.0.0.0/4")
            return str(network[1 + draw.below(network.num_addresses - 2)])
    while True:
        drawn = ipaddress.IPv4Address(draw.below(1 << 32))
        if drawn.is_global and not drawn.is_multicast:
            return str(drawn)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement's normal form.

    From ``CROWDED`` attempts on the space of equal length counts as full: names have grown with every
    attempt, texts of free length grow by a character with each further one, and phone numbers
    give up the digits they kept. Numbers of fixed length have only their own space.
    """
    longer = max(attempt - CROWDED + 1, 0)
    draw = _Draw(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        place = _Draw(key, "domain", domain)
        return f"{draw.like(local + 'x' * longer)}@{'.'.join([*(place.like(x) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        return _address(draw, value, attempt)
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        return next(body + str(check) for check in range(10) if luhn_valid(body + str(check)))
    if kind == "iban":
        body = draw.like(value[4:])
        moved = "".join(str(int(c, 36)) for c in body + value[:2] + "00")
        return f"{value[:2]}{98 - int(moved) % 97:02d}{body}"
    if kind == "phone":
        # the country code and, at home, a leading digit that is not 0 stay
        digits = value.lstrip("+")
        keep = max(len(digits) - 10, 1) if value.startswith("+") and not longer else 0
        return "+" * value.startswith("+") + digits[:keep] + str(2 + draw.below(8)) + draw.like(digits[keep + 1 :])
    if kind == "name":
        script, gender, _ = value.split(":", 2)
        parts = SYLLABLES[script]
        body = "".join(parts[draw.below(len(parts))] for _ in range(2 + min(attempt, 24)))
        ends = ENDINGS[script, gender]
        return f"{script}:{gender}:{body}{ends[draw.below(len(ends))]}"
    if kind == "ssn":
        return draw.like(value)
    if kind == "secret" and value.startswith("AKIA"):
        return "AKIA" + "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw.below(36)] for _ in value[4:])
    return draw.like(value + "x" * longer)


def render(original: str, kind: str, value: str) -> str:
    """The replacement in the spelling of the mention: separators, blanks, capitals."""
    if kind == "name":
        word = value.split(":", 2)[2]
        return word.upper() if len(original) > 1 and original.isupper() else word.capitalize()
    if kind == "email":
        return value.upper() if original.isupper() else value
    if kind in ("card", "iban", "phone"):
        left = iter(value.lstrip("+"))
        return "".join(next(left) if c.isalnum() else c for c in original)
    return value


def replace(text: str, mapping: dict[tuple[str, str], str]) -> str:
    """The text with every mention replaced."""
    out, at = [], 0
    for mention in find(text):
        out.append(text[at : mention.start])
        spelled = text[mention.start : mention.end]
        out.append(render(spelled, mention.kind, mapping[mention.kind, mention.value]))
        at = mention.end
    return "".join([*out, text[at:]])
