"""Personal data: surrogates that keep type and format, one for each detected entity.

Detected are e-mail addresses, telephone numbers, payment cards (Luhn), IPv4 addresses, IBAN (check
digits), social security numbers, other numbers of 15 or 16 digits, and names after a title with their
later mentions in the text.  An entity's surrogate is a keyed
permutation of its alphabet: digits stay digits, letters keep case and script, separators stay where
they are, and given names change into names of the same gender and script.  A permutation gives
different surrogates to different entities and the same one to every mention (coreference), without
a table of entities.  What is compared (case of an address, separators of a number) is left out
of the key.  `distinct_surrogates` checks all entities of a table for distinctness and draws those
that collide anew; `collisions` reports them.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8

# Given names by (gender, script), and titles that show a gender.
NAMES = {
    ("f", "latin"): "Anna Clara Elena Julia Laura Maria Nina Paula Sofia Teresa".split(),
    ("m", "latin"): "Adam Bruno David Felix Hugo Jonas Lucas Martin Oscar Paul".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Иван Михаил Олег Павел Сергей".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madame Mme Frau Señora Sra Госпожа".split(),
    "m": "Mr Sir Monsieur Herr Señor Sr Господин".split(),
    "": "Dr Prof".split(),
}

_TITLE = "|".join(t for group in TITLES.values() for t in dict.fromkeys([x for w in group for x in (w, w.upper())]))
#: a word of a name: letters, with an apostrophe or hyphen between two of them
_WORD = r"[^\W\d_](?:['’-]?[^\W\d_])+"
#: kind -> pattern; at one place the first kind in this order wins
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])|(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}(?!\x20[0-9])|0[1-9](?:[\x20.-][0-9]{2}){4}(?!\x20[0-9]))(?![\w]|[.-][0-9])",
    "name": rf"(?<=\b)(?:{_TITLE})\.?\x20{_WORD}(?:\x20{_WORD})?",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
_NOT_CARD = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items() if kind != "card"))
_DIGITS = re.compile(r"[0-9]+")
# a text without any of these cannot hold an entity
_MAYBE = re.compile(rf"@|[0-9]|\b(?:{_TITLE})\b")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if _luhn(body + c))


def _iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def permute(secret: bytes, kind: str, number: int, size: int) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network, walked until it is in range."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for step in range(ROUNDS):
            message = f"{kind}/{size}/{step}/{right}".encode()
            draw = int.from_bytes(hmac.digest(secret, message, hashlib.sha256)[:16], "big")
            # halves wider than one digest are drawn longer
            while half > 128 and draw.bit_length() < half:
                draw = (draw << 128) | int.from_bytes(
                    hmac.digest(secret, message + str(draw).encode(), hashlib.sha256)[:16], "big"
                )
            left, right = right, left ^ (draw & mask)
        number = (left << half) | right
        if number < size:
            return number


def _letters_digits(secret: bytes, kind: str, text: str) -> str:
    """`text` with its ASCII letters and digits permuted: a letter for a letter, a digit for a digit.

    The permutation runs over all texts of the same shape; lower and upper case map alike.
    """
    shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in text)
    number = 0
    size = 1
    for c, s in zip(text, shape):
        base = 10 if s == "0" else 26 if s == "a" else 1
        value = int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0
        number, size = number * base + value, size * base
    number = permute(secret, f"{kind}:{shape}", number, size)
    out = []
    for c, s in zip(reversed(text), reversed(shape)):
        base = 10 if s == "0" else 26 if s == "a" else 1
        number, value = divmod(number, base) if base > 1 else (number, 0)
        new = str(value) if base == 10 else chr(97 + value) if base == 26 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def _digits_into(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _email(secret: bytes, value: str) -> str:
    """The local part changes, also by domain; the domain's host becomes one of example.com."""
    local, _, domain = value.partition("@")
    ascii_ = "".join(c if c.isascii() else "x" for c in local)
    # letters outside ASCII are not permuted: the tag tells such addresses apart
    name = domain.lower() if local == ascii_ else f"{local.lower()}@{domain.lower()}"
    tag = hmac.digest(secret, f"domain/{name}".encode(), hashlib.sha256).hex()[:16]
    return f"{_letters_digits(secret, 'email/' + domain.lower(), ascii_)}@{'m' + tag}.example.com" if (
        local == ascii_
    ) else f"{_letters_digits(secret, 'email/' + local.lower(), ascii_)}@{'u' + tag}.example.com"


def _card(secret: bytes, value: str) -> str:
    digits = re.sub(r"\D", "", value)
    body = _letters_digits(secret, "card", digits[1:-1])
    return _digits_into(value, digits[0] + body + _luhn_digit(digits[0] + body))


def _number(secret: bytes, value: str) -> str:
    """A number that fails the card check stays one: the permutation is walked past valid ones."""
    digits = re.sub(r"\D", "", value)
    while _luhn(digits := _letters_digits(secret, "number", digits)):
        pass
    return _digits_into(value, digits)


def _iban(secret: bytes, value: str) -> str:
    plain = value.replace(" ", "")
    body = _letters_digits(secret, "iban/" + plain[:2], plain[4:])
    rest = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    made = iter(f"{plain[:2]}{98 - rest:02d}{body}")
    return "".join(" " if c == " " else next(made) for c in value)


def _ip(secret: bytes, value: str) -> str:
    if ":" in value:
        # a digit for a digit, groups and their lengths as they are
        digits = value.replace(":", "")
        new = iter(f"{permute(secret, f'ip6/{len(digits)}', int(digits, 16), 16 ** len(digits)):0{len(digits)}x}")
        made = "".join(c if c == ":" else next(new) for c in value)
        return made.upper() if value.upper() == value else made
    number = int.from_bytes(bytes(map(int, value.split("."))), "big")
    return ".".join(map(str, permute(secret, "ip", number, 1 << 32).to_bytes(4, "big")))


def _phone(secret: bytes, value: str) -> str:
    """The country code stays."""
    code = re.match(r"\+[0-9]{1,3}(?=[^0-9])", value)
    head = code[0] if code else ""
    digits = re.sub(r"\D", "", value[len(head) :])
    return head + _digits_into(value[len(head) :], _letters_digits(secret, f"phone/{head}", digits))


def _ssn(secret: bytes, value: str) -> str:
    return _digits_into(value, _letters_digits(secret, "ssn", value.replace("-", "")))


@lru_cache(maxsize=1000)
def _alphabet(page: int) -> str:
    """Lower-case letters that take each other's place: of a page of 256 code points, or Russian ones."""
    if page < 0:
        return "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
    cased = (chr(i) for i in range(max(page << 8, 128), (page + 1) << 8))
    return "".join(c for c in cased if c.isalpha() and c.upper().lower() == c and len(c.upper()) == 1 and c not in _alphabet(-1))


def _page(c: str) -> int:
    return -1 if c in _alphabet(-1) else ord(c) >> 8


def _same_script(secret: bytes, word: str) -> str:
    """A word of the same length, case and script: a permutation of the words of one shape."""
    if word.isascii():
        return "".join(
            _letters_digits(secret, f"name/{i}", part) if part.isalpha() else part
            for i, part in enumerate(re.split(r"([^A-Za-z]+)", word))
        )
    number, size, shape, sets = 0, 1, [], []
    for c in word:
        low = c.lower()
        letters = "abcdefghijklmnopqrstuvwxyz" if "a" <= low <= "z" else _alphabet(_page(low)) if len(low) == 1 else ""
        if low not in letters or low == "":
            letters = low  # without a case or an alphabet: it stays
        shape.append(letters[0] if len(letters) > 1 else letters)
        sets.append(letters)
        if len(letters) > 1 and len(low) == 1:
            number, size = number * len(letters) + letters.index(low), size * len(letters)
    number = permute(secret, f"name:{'/'.join(shape)}", number, size)
    out = []
    for c, letters in zip(reversed(word), reversed(sets)):
        if len(letters) > 1 and len(c.lower()) == 1:
            number, value = divmod(number, len(letters))
            out.append(letters[value].upper() if c.isupper() else letters[value])
        else:
            out.append(c)
    return "".join(reversed(out))


_LISTED = {n.lower(): (group, i) for group, names in NAMES.items() for i, n in enumerate(names)}


def _name_word(secret: bytes, word: str) -> str:
    """A given name of the lists becomes one of its list, any other word a word outside the lists."""
    if found := _LISTED.get(word.lower()):
        (gender, script), at = found
        names = NAMES[gender, script]
        new = names[permute(secret, f"given/{gender}/{script}", at, len(names))]
        return new.upper() if word.isupper() else new.lower() if word.islower() else new
    while (word := _same_script(secret, word)).lower() in _LISTED:
        pass
    return word


def _name(secret: bytes, value: str) -> str:
    title, *words = value.split(" ")
    return " ".join([title, *(_name_word(secret, w) for w in words)])


_MAKERS: dict[str, Callable[[bytes, str], str]] = {
    "email": _email, "card": _card, "number": _number, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn, "name": _name,
}


@lru_cache(maxsize=100_000)
def surrogate(secret: bytes, kind: str, value: str) -> str:
    return _name_word(secret, value) if kind == "name" and " " not in value else _MAKERS[kind](secret, value)


def plain(kind: str, value: str) -> str:
    """What is compared of an entity or a surrogate."""
    value = value.lower()
    return re.sub(r"[^0-9a-z+]", "", value) if kind in ("card", "number", "iban", "phone", "ssn") else value


def _inside(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The first entity that begins at a group of digits of a number that is no card."""
    groups = [(start + g.start(), start + g.end()) for g in _DIGITS.finditer(text[start:end])]
    for i, (at, _) in enumerate(groups):
        if m := _NOT_CARD.match(text, at):
            return m.lastgroup, at, m.end()
        for _, stop in reversed(groups[i:]):
            digits = re.sub(r"\D", "", text[at:stop])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                return "card", at, stop
    return None


def entities(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a whole text, leftmost first, without overlaps."""
    if not text or not _MAYBE.search(text):
        return
    at = 0
    while m := _ANY.search(text, at):
        kind, value = m.lastgroup, m[0]
        at = m.end()
        if kind == "card" and not _luhn(re.sub(r"\D", "", value)):
            if other := _inside(text, m.start(), m.end()):
                at = other[2]
                yield other
                continue
            kind = "number" if 15 <= len(re.sub(r"\D", "", value)) <= 16 else ""
        if kind == "iban" and not _iban_ok(value.replace(" ", "")):
            kind, at = "", m.start() + 2
        if kind == "name":
            # the word after a name is part of it if it begins with no small letter
            *most, last = value.split(" ")
            if len(most) > 1 and last[0].islower():
                at = m.end() - len(last) - 1
        if kind:
            yield kind, m.start(), at


def mentions(text: str | None) -> list[tuple[str, int, int]]:
    """`entities`, with later mentions of the words of a detected name that begin with no small letter."""
    found = list(entities(text))
    first: dict[str, int] = {}
    for kind, start, end in found:
        if kind == "name":
            for word in text[start:end].split(" ")[1:]:
                if not word[0].islower():
                    first.setdefault(word, end)
    if not first:
        return found
    taken = iter([*found, ("", len(text), len(text))])
    kind, start, end = next(taken)
    more = []
    for m in re.finditer(_WORD, text):
        while end <= m.start() and kind:
            kind, start, end = next(taken)
        if first.get(m[0], len(text)) <= m.start() and m.end() <= start and (m.start() == 0 or not re.match(r"[\w]", text[m.start() - 1])):
            more.append(("name", m.start(), m.end()))
    return sorted(found + more, key=lambda e: e[1])


def replaced(text: str, secret: bytes, again: dict | None = None) -> tuple[str, list[tuple]]:
    """The text with surrogates, and (kind, start, end, surrogate) for each entity of the input.

    `again` has the number of the key for entities that are drawn anew, by (kind, plain value).
    """
    out, found, at = [], [], 0
    for kind, start, end in mentions(text):
        value = text[start:end]
        turn = again.get((kind, plain(kind, value)), 0) if again else 0
        key = hmac.digest(secret, f"again/{turn}".encode(), hashlib.sha256) if turn else secret
        new = surrogate(key, kind, value)
        out += text[at:start], new
        found.append((kind, start, end, new))
        at = end
    return "".join([*out, text[at:]]), found


def with_surrogates(
    docs: DataFrame, secret: str, text: str = "text", out: str = "text", spans: str | None = None,
    again: dict | None = None,
) -> DataFrame:
    """`docs` with surrogates in column `out`; `spans` names a column for (kind, start, end, surrogate).

    All rows and other columns stay as they are.  A null text stays null and has no spans, and a
    text without entities is unchanged.  Positions are code points of the input text.  Each row
    depends on its own text and the secret only, so repeated rows are alike and lost tasks can be
    run again.
    """
    key = hashlib.sha256(secret.encode()).digest()
    kinds = T.StructType.fromDDL(
        "text string, spans array<struct<kind:string,start:int,end:int,surrogate:string>>"
    )

    @F.pandas_udf(kinds)
    def change(texts: pd.Series) -> pd.DataFrame:
        rows = [replaced(t, key, again) if isinstance(t, str) else (None, []) for t in texts]
        as_dicts = [[dict(zip(("kind", "start", "end", "surrogate"), s)) for s in f] for _, f in rows]
        return pd.DataFrame({"text": [r[0] for r in rows], "spans": as_dicts}, columns=["text", "spans"])

    made = docs.select("*", change(F.col(text)).alias("__made"))
    made = made.withColumn(out, F.col("__made.text"))
    return (made.withColumn(spans, F.col("__made.spans")) if spans else made).drop("__made")


def distinct_surrogates(docs: DataFrame, secret: str, text: str = "text", out: str = "text", spans: str | None = None) -> DataFrame:
    """`with_surrogates` after a look at all entities of the table.

    Entities are reduced to distinct ones and counted by surrogate.  Of those that share one, all but
    the smallest get a surrogate of another key, until no two share one.  All kinds but telephone
    numbers written with and without a separated country code are permutations, so few are sent to
    the driver.
    """
    key = hashlib.sha256(secret.encode()).digest()
    again: dict[tuple[str, str], int] = {}
    while True:

        def each(frames: Iterator[pd.DataFrame], again=dict(again)) -> Iterator[pd.DataFrame]:
            for frame in frames:
                seen = set()
                for t in frame["text"]:
                    if isinstance(t, str):
                        seen.update((k, plain(k, t[a:b]), plain(k, new)) for k, a, b, new in replaced(t, key, again)[1])
                yield pd.DataFrame(list(seen), columns=["kind", "value", "made"])

        pairs = docs.select(F.col(text).alias("text")).mapInPandas(each, "kind string, value string, made string").distinct()
        shared = pairs.groupBy("kind", "made").agg(F.min("value").alias("least"), F.countDistinct("value").alias("n")).where("n > 1")
        worse = pairs.join(shared, ["kind", "made"]).where("value > least").select("kind", "value").distinct().collect()
        if not worse:
            return with_surrogates(docs, secret, text, out, spans, again)
        for r in worse:
            again[r.kind, r.value] = again.get((r.kind, r.value), 0) + 1


def collisions(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """(kind, surrogate, n): surrogates that stand for more than one entity of the table.

    `found` has the input text and its spans.  Entities are reduced to distinct ones before they are
    counted, so a frequent one is no hot group.
    """
    each = found.select(F.col(text).alias("t"), F.explode(spans).alias("s"))
    value = F.lower(F.substring("t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    plain = F.when(F.col("s.kind").isin("card", "number", "iban", "phone", "ssn"), F.regexp_replace(value, "[^0-9a-z+]", "")).otherwise(value)
    made = F.lower(F.col("s.surrogate"))
    bare = F.when(F.col("s.kind").isin("card", "number", "iban", "phone", "ssn"), F.regexp_replace(made, "[^0-9a-z+]", "")).otherwise(made)
    pairs = each.select(F.col("s.kind").alias("kind"), plain.alias("value"), bare.alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
