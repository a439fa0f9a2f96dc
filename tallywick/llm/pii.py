"""Personal data replaced by keyed surrogates.

Entities are found by pattern, once for each text. Each gets a surrogate drawn from a keyed hash of its
canonical form, so one entity has one surrogate in every document; it keeps type, length, grouping, letter
case and script, a card number keeps whether its check digit holds and an account number its country and
valid check digits. A name is found behind a title, and then its parts wherever they stand in that document;
it is replaced part by part, so "Dr. Ada Lund", "Ada" and "Dr. Lund" still agree. A given name has one gender
in the whole corpus: the one that its titles show, none if they show both, else that of its ending. The
distinct entities of the corpus are then compared: where two of a type would get one surrogate, or a
surrogate is itself an entity of the corpus, all but one (or the one) draw again, until none are left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, map_columns, staged

#: Redrawn entities up to which they are broadcast; beyond, they are joined to the documents that hold them.
MAX_BROADCAST_REDRAWN = 100_000

#: Draws of one length: an entity that has lost so many gets a surrogate one character or syllable longer.
DRAWS = 16

#: Titles and the gender that they show. Fixed values.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Sir": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Doña": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "", "Prof": "",
}

#: Type -> pattern; group "x" is what is replaced. In the order in which they win where they overlap.
PATTERNS = {
    "email": r"(?P<x>[\w.+%-]*\w@[^\W_](?:[\w-]*\w)?(?:\.[^\W_](?:[\w-]*\w)?)*\.[^\W\d_]{2,})",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)(?P<x>[A-Za-z0-9_+/=.-]{8,})",
    "iban": r"(?<!\w)(?P<x>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?!\w)",
    "ipv6": r"(?<![\w:.])(?P<x>[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7})(?![\w:])",
    "birth": r"(?i:\b(?:born(?: on)?|date of birth|dob|birthday)\b:?\s*)(?P<x>\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\w)",
    "ip": r"(?<![\w.])(?P<x>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?!\w|\.\d)",
    "card": r"(?<![\w.+-])(?P<x>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?!\w|[-.]\d)",
    "ssn": r"(?<![\w-])(?P<x>\d{3}-\d{2}-\d{4})(?![\w-])",
    "phone": r"(?<![\w.])(?P<x>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w|[-.]\d)",
    "phone cued": r"(?i:\b(?:tel|phone|call|mobile|fax)\b[.:]?\s*)(?P<x>\d{10})(?!\w|[-.]\d)",
    "name": r"\b(?P<title>" + "|".join(TITLES) + r")\b\.? (?P<x>[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[ -][^\W\d_a-zа-яα-ω][^\W\d_]+){0,2})",
}
#: What a text must contain for the pattern to be worth a search.
_NEEDS = {
    "email": re.compile("@"),
    "secret": re.compile("(?i)token|secret|passw|api[_-]?key|access[_-]?key"),
    "iban": re.compile(r"[A-Z]{2}\d\d ?[A-Z0-9]{4}"),
    "ipv6": re.compile(r"(?::[0-9A-Fa-f]{1,4}){2}"),
    "birth": re.compile("(?i)born|birth|dob"),
    "ip": re.compile(r"\d\.\d"),
    "card": re.compile(r"\d{4}[ -]?\d{4}"),
    "ssn": re.compile(r"\d-\d\d-\d"),
    "phone": re.compile(r"\+\d|\(\d|\d{3}[ .-]\d{3}"),
    "phone cued": re.compile(r"\d{10}"),
    "name": re.compile("|".join(rf"{t}\b\.? " for t in TITLES)),
}
_ANY = re.compile(r"[@\d]|\b(?:" + "|".join(TITLES) + r")\b|(?i:token|secret|passw|api[_-]?key|access[_-]?key)")
_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}


#: A capitalised word of two letters or more.
_CAPITAL = re.compile(r"\b[^\W\d_a-zа-яα-ω][^\W\d_]+")

Entity = tuple[str, str, str]
Mention = tuple[int, int, str, list[Entity]]


def mentions(text: str) -> list[Mention]:
    """(start, end, type, entities) of every mention, in order and apart; of overlapping ones the first type wins.

    An entity is its type, its canonical form, and the gender that the mention shows (m, f or none).
    """
    found: list[Mention] = []
    if not _ANY.search(text):
        return found
    taken: list[tuple[int, int]] = []
    roles: dict[str, str] = {}
    for pattern, compiled in _COMPILED.items():
        if not _NEEDS[pattern].search(text):
            continue
        own, kind = [], pattern.split()[0]
        for m in compiled.finditer(text):
            start, end = m.span("x")
            if any(a < end and start < b for a, b in taken) or not _PROPER.get(pattern, bool)(m["x"]):
                continue
            own.append((start, end))
            entities = named(m["x"], TITLES[m["title"]], roles) if kind == "name" else canonical(kind, m["x"])
            found.append((start, end, kind, entities))
        taken += own
    if roles:
        found += bare_names(text, roles, taken)
    return sorted(found)


def named(name: str, gender: str, roles: dict[str, str]) -> list[Entity]:
    """The parts of a titled name; ``roles`` learns what each is."""
    parts = re.split("[ -]", name.lower())
    kinds = ["name_given"] * (len(parts) - 1) + ["name_family"]
    for part, kind in zip(parts, kinds, strict=True):
        roles.setdefault(part, kind)
    return [(k, p, gender if k == "name_given" else "") for k, p in zip(kinds, parts, strict=True)]


def bare_names(text: str, roles: dict[str, str], taken: list[tuple[int, int]]) -> list[Mention]:
    """Mentions of known parts of names without a title; neighbouring parts are one mention."""
    found: list[Mention] = []
    busy = iter(sorted(taken))
    block = next(busy, None)
    for m in _CAPITAL.finditer(text):
        start, end = m.span()
        while block is not None and block[1] <= start:
            block = next(busy, None)
        part = m[0].lower()
        if part not in roles or block is not None and block[0] < end:
            continue
        entity = (roles[part], part, "")
        if found and start == found[-1][1] + 1 and text[start - 1] in " -":
            found[-1] = (found[-1][0], end, "name", [*found[-1][3], entity])
        else:
            found.append((start, end, "name", [entity]))
    return found


def canonical(kind: str, text: str) -> list[Entity]:
    """The entities of a mention that is no name: of an e-mail address both sides, else one."""
    if kind == "email":
        local, _, domain = text.lower().rpartition("@")
        return [("email_local", local, ""), ("email_domain", domain, "")]
    if kind in ("card", "ssn", "phone"):
        return [(kind, "".join(c for c in text[fixed(kind, text) :] if c.isdigit()), "")]
    if kind == "iban":
        return [(kind, text.replace(" ", ""), "")]
    return [(kind, text.lower() if kind == "ipv6" else text, "")]


def account_remainder(account: str) -> int:
    """The check of an account number: 1 if it holds."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _is_address(text: str) -> bool:
    import ipaddress

    try:
        return ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


#: Patterns whose finds are looked at again.
_PROPER: dict[str, Callable[[str], bool]] = {
    "card": lambda x: not x.isdigit() or luhn(x),  # plain digits are a card only if the check digit holds
    "phone": lambda x: sum(c.isdigit() for c in x) >= 8,
    "iban": lambda x: account_remainder(x.replace(" ", "")) == 1,
    "ipv6": _is_address,
}


def ending_gender(name: str) -> str:
    """The gender that a given name's ending suggests, for titles that show none."""
    return "f" if name[-1] in "aаяαη" else "m"


def fixed(kind: str, text: str) -> int:
    """Length of what a mention keeps: the country code of a phone number."""
    m = re.match(r"\+\d{1,3}(?=[ .(-])", text) if kind == "phone" else None
    return m.end() if m else 0


class Stream:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.seed = hmac.new(key, "\0".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.blocks = self._bytes()

    def _bytes(self) -> Iterator[int]:
        n = 0
        while True:
            yield from hashlib.sha256(self.seed + n.to_bytes(4, "big")).digest()
            n += 1

    def below(self, n: int) -> int:
        x = 0
        for _ in range(4):
            x = x << 8 | next(self.blocks)
        return x % n


def like(c: str, draw: Stream) -> str:
    """A character of the same kind: digit, or letter of the same script block and case; others stay."""
    if c.isdecimal():
        zero = ord(c) - int(c)
        return chr(zero + draw.below(10))
    if not c.isalpha():
        return c
    if c.isascii():
        return chr((0x41 if c.isupper() else 0x61) + draw.below(26))
    start = ord(c) & ~0x3F
    near = [x for x in map(chr, range(start, start + 0x40)) if x.isalpha() and not x.isascii() and x.isupper() == c.isupper() and x.islower() == c.islower()]
    return near[draw.below(len(near))]


#: Sounds of surrogate names for each script: consonants, vowels, and endings by gender. Fixed values.
SOUNDS = {
    "latin": ("b d f g k l m n p r s t v", "a e i o u", {"m": "n r s d", "f": "a ia ena", "": "el in o"}),
    "cyrillic": ("б в г д к л м н п р с т", "а е и о у", {"m": "н р в д", "f": "а ия ина", "": "ль ко"}),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ", "α ε ι ο", {"m": "ος ης ας", "f": "α η ια", "": "ου ις"}),
}


def name_like(part: str, gender: str, draw: Stream, more: int = 0) -> str:
    """A made-up name in the script of ``part`` (lower case) with an ending of the gender; in other scripts letter by letter."""
    c = ord(part[0])
    script = "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin" if c < 0x250 else ""
    if not script:
        return "".join(like(x, draw) for x in part + more * part[-1])
    consonants, vowels, endings = SOUNDS[script]
    consonants, vowels, ends = consonants.split(), vowels.split(), endings[gender].split()
    size = max(2, min(5, len(part) // 2)) + more
    name = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(size - 1))
    name += consonants[draw.below(len(consonants))] + ends[draw.below(len(ends))]
    return name


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0, gender: str = "") -> str:
    """The surrogate of an entity in canonical form.

    It is as long as the entity. Each DRAWS attempts it grows, since short formats have fewer forms than a
    large corpus has entities; an address then takes any numbers. ``gender`` (m, f or none) shapes a given name.
    """
    draw = Stream(key, kind, canon, attempt)
    more = attempt // DRAWS
    if kind.startswith("name_"):
        return name_like(canon, gender, draw, more)
    if kind == "email_domain":
        labels = canon.split(".")
        labels[0] += more * labels[0][0]
        return ".".join(["".join(like(c, draw) for c in x) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        low = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        return ".".join(str(draw.below(256) if more else low[len(x)][0] + draw.below(low[len(x)][1])) for x in canon.split("."))
    if kind == "ipv6":
        return ":".join("".join("0123456789abcdef"[draw.below(16)] for _ in x) for x in canon.split(":"))
    if kind == "iban":
        body = "".join(like(c, draw) for c in canon[4:] + more * canon[-1])
        return f"{canon[:2]}{98 - account_remainder(canon[:2] + '00' + body):02d}{body}"
    if kind == "birth":
        return date_like(canon, draw)
    if kind == "card":
        body = "".join(like(c, draw) for c in more * canon[0] + canon[:-1])
        sums = [d for d in "0123456789" if luhn(body + d) == luhn(canon)]
        return body + sums[draw.below(len(sums))]
    if kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", canon):
        digits = "0123456789abcdef" if canon.lower() == canon else "0123456789ABCDEF"
        return "".join(digits[draw.below(16)] for _ in range(len(canon) + more))
    last = next((c for c in reversed(canon) if c.isalpha() or c.isdecimal()), "0")
    return "".join(like(c, draw) for c in canon + more * last)


def date_like(date: str, draw: Stream) -> str:
    """A date in the form of ``date``, each part with as many digits."""
    spread = {4: (1900, 200), 2: (10, 3), 1: (1, 9)}
    parts = []
    for x in re.split("([-./])", date):
        low, n = spread.get(len(x), (0, 0)) if x.isdigit() else (0, 0)
        parts.append(str(low + draw.below(n)) if n else x)
    return "".join(parts)


def replaced(text: str, found: list[Mention], key: bytes, changed: dict[tuple[str, str], tuple[int, str]], memo: dict[tuple[str, str], str]) -> str:
    """The text with surrogates in place of ``found``; ``changed`` has attempt and gender of entities that differ from the first draw."""
    out, at = [], 0
    for start, end, kind, entities in found:
        subs = []
        for entity in ((k, c) for k, c, _ in entities):
            if entity not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                attempt, gender = changed.get(entity) or (0, own_gender(*entity))
                memo[entity] = surrogate(key, *entity, attempt, gender)
            subs.append(memo[entity])
        out += [text[at:start], shaped(kind, text[start:end], subs)]
        at = end
    return "".join(out) + text[at:]


def own_gender(kind: str, canon: str) -> str:
    """The gender of an entity whose titles show none: that of a given name's ending."""
    return ending_gender(canon) if kind == "name_given" else ""


def shaped(kind: str, mention: str, subs: list[str]) -> str:
    """Surrogates in the format of the mention."""
    if kind == "name":
        parts = iter(subs)
        return re.sub("[^ -]+", lambda m: next(parts).upper() if m[0].isupper() else next(parts).capitalize(), mention)
    if kind == "email":
        made = "@".join(subs)
        return made.upper() if mention.isupper() else made
    if kind in ("card", "ssn", "phone"):
        digits, start = iter(subs[0]), fixed(kind, mention)
        return mention[:start] + "".join(next(digits) if c.isdigit() else c for c in mention[start:]) + "".join(digits)
    if kind == "iban":
        letters = iter(subs[0])
        return "".join(c if c == " " else next(letters) for c in mention) + "".join(letters)
    if kind == "ipv6":
        return subs[0].upper() if mention.isupper() else subs[0]
    return subs[0]


_MENTIONS = "array<struct<start: int, end: int, kind: string, parts: array<struct<kind: string, canon: string, gender: string>>>>"


def detected(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the mentions of every text (none for null) as column ``name``."""

    def make() -> Callable[[str | None], tuple]:
        return lambda body: ([{"start": a, "end": b, "kind": k, "parts": [{"kind": x, "canon": c, "gender": g} for x, c, g in e]} for a, b, k, e in mentions(body or "")],)

    return map_columns(docs, [F.col(text)], docs.columns, f"{name} {_MENTIONS}", make)


def entity_table(found: DataFrame, name: str, key: bytes) -> DataFrame:
    """Distinct entities (kind, canon) of ``detected`` rows with their gender, attempt 0 and first surrogate."""
    each = found.select(F.explode(name).alias("x")).select(F.explode("x.parts").alias("x")).select("x.*")
    shown = each.groupBy("kind", "canon").agg(F.max(F.col("gender") == "m").alias("m"), F.max(F.col("gender") == "f").alias("f"))

    def make() -> Callable[..., tuple]:
        return lambda kind, canon, m, f: ("" if m and f else "m" if m else "f" if f else own_gender(kind, canon),)

    gendered = map_columns(shown, [F.col(c) for c in ("kind", "canon", "m", "f")], ("kind", "canon"), "gender string", make)
    return _drawn(gendered.withColumn("attempt", F.lit(0)), key)


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    columns = ("kind", "canon", "attempt", "gender")

    def make() -> Callable[..., tuple]:
        return lambda kind, canon, attempt, gender: (surrogate(key, kind, canon, attempt, gender),)

    return map_columns(entities, [F.col(c) for c in columns], columns, "surrogate string", make)


def without_collisions(table: DataFrame, key: bytes, rounds: int = 64) -> DataFrame:
    """``table`` with the attempts at which no two entities of a kind share a surrogate and none gets an entity of the corpus.

    Of the entities that share one the smallest keeps it. Each round compares all entities and draws anew
    for the losers, at length in longer forms, so that short formats do not run out. An error says if some
    still clash after ``rounds``.
    """
    table = staged(table, "pii-entities", few=True)
    real = table.select("kind", F.col("canon").alias("surrogate")).withColumn("is_real", F.lit(True))
    first = table
    for _ in range(rounds):
        kept = table.groupBy("kind", "surrogate").agg(F.min("canon").alias("winner"))
        clash = table.join(kept, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        lost = staged(clash.filter((F.col("canon") != F.col("winner")) | F.col("is_real")).select("kind", "canon"), "pii-redrawn", few=True)
        if lost.isEmpty():
            return table
        again = table.join(lost, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("surrogate")
        left = table.join(lost, ["kind", "canon"], "left_anti").unionByName(_drawn(again, key))
        table = staged(left, "pii-entities", instead_of=table if table is not first else None, few=True)
    raise ValueError("surrogates of some format cannot be made distinct")


def pseudonymised(
    docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id", spans: str | None = None, max_broadcast: int = MAX_BROADCAST_REDRAWN
) -> DataFrame:
    """``docs`` with every detected entity replaced by its surrogate; other columns as they are.

    With ``spans`` a column of that name, in place of one that is there already, lists start, end (code
    points of the original) and kind of each mention. Null texts stay null and have no entities, empty texts
    and texts without any stay as they are, repeated rows are changed alike, and an empty table has no rows.
    Very long texts are read as a whole, one at a time. Texts are searched once and written with what was
    found. Ids, whole numbers, are used only where redrawn entities are too many to broadcast; null ids and
    ids of several texts are told apart by a hash of the text.
    """
    others = [c for c in docs.columns if spans is None or c == text or c.lower() != spans.lower()]
    rows, did, hash_ = keyed(docs.select(others), doc_id, text) if doc_id in others else keyed(docs, doc_id, text)
    found_, own, new = fresh(rows, "found", "own", "new_text")
    rows = staged(detected(rows, text, found_), "pii-mentions")
    some = rows.filter(F.size(found_) > 0)
    table = without_collisions(entity_table(some, found_, key), key)
    changed = _changed(table)
    if changed.count() <= max_broadcast:
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in changed.collect()})
        some = some.withColumn(own, F.lit(None).cast("array<struct<kind: string, canon: string, attempt: int, gender: string>>"))
    else:
        sent = None
        each = some.select(did, hash_, F.explode(found_).alias("x")).select(did, hash_, F.explode("x.parts").alias("x")).select(did, hash_, "x.kind", "x.canon").distinct()
        held = each.join(changed, ["kind", "canon"]).groupBy(did, hash_).agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias(own))
        some = some.join(held, [did, hash_], "left")

    def make() -> Callable[..., tuple]:
        memo: dict[tuple[str, str], str] = {}

        def call(body: str, found: list[dict], own: list[dict] | None) -> tuple[str]:
            listed = [(x["start"], x["end"], x["kind"], [(e["kind"], e["canon"], e["gender"]) for e in x["parts"]]) for x in found]
            if sent is not None:
                return (replaced(body, listed, key, sent.value, memo),)
            return (replaced(body, listed, key, {(x["kind"], x["canon"]): (x["attempt"], x["gender"]) for x in own or []}, {}),)

        return call

    kept = [c for c in others if c != text]
    made = map_columns(some, [F.col(text), F.col(found_), F.col(own)], [*kept, found_], f"{new} string", make)
    both = made.unionByName(rows.filter(F.size(found_) == 0).select(*kept, found_, F.col(text).alias(new)))
    of = F.transform(found_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return both.select(*[F.col(new).alias(c) if c == text else F.col(c) for c in others], *([of.alias(spans)] if spans else []))


def _changed(table: DataFrame) -> DataFrame:
    """(kind, canon, attempt, gender) of the entities that are not as their first draw has them."""

    def make() -> Callable[..., tuple]:
        return lambda kind, canon, attempt, gender: (attempt > 0 or gender != own_gender(kind, canon),)

    columns = ("kind", "canon", "attempt", "gender")
    return map_columns(table, [F.col(c) for c in columns], columns, "differs boolean", make).filter("differs").drop("differs")
