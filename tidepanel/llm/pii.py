"""Personal data replaced by keyed surrogates of the same kind.

Each entity becomes a number in the domain of its own format (digits, letters by class, places in a list of names) and is
moved inside that domain by a keyed permutation without fixed points: encrypt, add one, decrypt. So equal entities get
equal surrogates in all documents, different entities of a format get different ones, and none stands for itself. Every
surrogate is checked against the names reserved for other formats and walked on along the permutation until it is
clear of them. Nothing is looked up or shared between tasks, so no shuffle is needed.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KEY = "change-me"
ROUNDS = 6

# Given names by script and gender, as replacements for each other.
GIVEN = {
    ("LATIN", "f"): "Anna Maria Elena Laura Julia Sarah Emma Sofia Clara Lucia Marie Alice Eva Ines Nora Paula Greta Helen Rosa Irene".split(),
    ("LATIN", "m"): "John Peter Paul Thomas Daniel David Martin Simon Lucas Felix Hugo Victor Oscar Leon Anton Carlos Pedro Louis Henri Karl".split(),
    ("CYRILLIC", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split(),
    ("CYRILLIC", "m"): "Иван Пётр Сергей Алексей Николай Дмитрий Андрей Михаил".split(),
    ("GREEK", "f"): "Μαρία Ελένη Άννα Σοφία".split(),
    ("GREEK", "m"): "Γιώργος Νίκος Δημήτρης Κώστας".split(),
}
# Forms of address and the gender they say, if any.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Sr": "m", "Signor": "m", "Signora": "f", "г-н": "m", "г-жа": "f",
}
_KNOWN = {n.lower(): (script, gender, k) for (script, gender), names in GIVEN.items() for k, n in enumerate(names)}
_LETTERS = [  # classes of letters that take each other's place
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "ñçßøåæœýÿãõšžčřćđłśźż",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ",
]
_CLASS = {c: s for s in _LETTERS for c in s}
_DIGITS, _HEX = "0123456789", "0123456789abcdef"

_SECRETS = [f(w) for w in ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "access-key")
            for f in (str.lower, str.upper, str.capitalize)]
# What may follow in the same word: another part of it or a plural, so that "secretary" or "tokenizer" is none.
_SECRET_END = r"(?:[_-][\w-]*|[0-9A-Z][\w-]*|s|keys?|value|hash)?(?![\w-])"
_NAME = r"[A-ZÀ-ÖØ-ÞŁŚŠŽČĆĐА-ЯЁΑ-ΩΆΈΉΊΌΎΏ][^\W\d_]*(?:[-'’][^\W\d_]+)*"


def _any(names) -> str:
    return "|".join(sorted(map(re.escape, names), key=len, reverse=True))


_GIVEN = [n for v in GIVEN.values() for n in v]
# No entity goes over the end of a line.
ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    rf"|(?<![\w-])(?=[\w-]*?(?:{_any(_SECRETS)}){_SECRET_END})(?P<secret>[\w-]++[\"']?[ \t]*[:=][ \t]*[\"']?)(?P<value>[A-Za-z0-9+/_-]{{8,}})"
    r"|(?<![\w.])(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![\w]|\.[0-9])"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w+.-])(?P<card>[0-9]{13,19}|[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w]|[.-][0-9])"
    r"|(?<![\w:])(?P<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![\w:])"
    r"|(?<![\w+])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.+-])(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|0[0-9](?:[ .-][0-9]{2}){4}"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})(?![\w]|[.-][0-9])"
    rf"|\b(?P<title>{_any(TITLES)})(?P<gap>\.?[ \u00a0])(?P<titled>{_NAME}(?:[ \u00a0]{_NAME}){{0,2}})"
    rf"|\b(?P<given>{_any(_GIVEN)})(?P<space>[ \u00a0])(?P<family>{_NAME}(?:[ \u00a0]{_NAME})?)")


def _triggers() -> ahocorasick.Automaton:
    """What every entity has somewhere: a digit, an at sign, a secret's name, a form of address or a given name."""
    out = ahocorasick.Automaton()
    for mark in [*"0123456789@", *_SECRETS, *TITLES, *_GIVEN]:
        out.add_word(mark, (len(mark), mark in TITLES or mark in _GIVEN))  # names of secrets stand inside words, too
    out.make_automaton()
    return out


def suspects(text: str, triggers: ahocorasick.Automaton) -> Iterator[tuple[int, int]]:
    """The lines that can hold an entity."""
    done = -1
    for last, (size, alone) in triggers.iter(text):
        first = last - size + 1
        if first < done:
            continue
        if alone and (last + 1 < len(text) and text[last + 1].isalnum() or first and text[first - 1].isalnum()):
            continue  # part of another word
        end = text.find("\n", last)
        done = len(text) if end < 0 else end
        yield text.rfind("\n", 0, first) + 1, done


class Permutation:
    """A keyed permutation of 0..n-1 by a Feistel network over the next even number of bits, walked back into range."""

    def __init__(self, key: str, label: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask, self.seed = (1 << self.half) - 1, hashlib.blake2b(f"{label}|{n}".encode(), key=hashlib.sha256(key.encode()).digest()).digest()

    def _mix(self, turn: int, x: int) -> int:
        size = (self.half + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(turn.to_bytes(1, "big") + block.to_bytes(2, "big") + x.to_bytes(size, "big"), key=self.seed[:64]).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & self.mask

    def _pass(self, x: int, turns: range, forward: bool) -> int:
        a, b = x >> self.half, x & self.mask
        for t in turns:
            a, b = (b, a ^ self._mix(t, b)) if forward else (b ^ self._mix(t, a), a)
        return a << self.half | b

    def encrypt(self, x: int) -> int:
        while True:
            x = self._pass(x, range(ROUNDS), True)
            if x < self.n:
                return x

    def decrypt(self, x: int) -> int:
        while True:
            x = self._pass(x, range(ROUNDS - 1, -1, -1), False)
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        """Another number for each number: encrypt, add one, decrypt."""
        return x if self.n < 2 else self.decrypt((self.encrypt(x) + 1) % self.n)


class Surrogates:
    """Replacements under one key."""

    def __init__(self, key: str = KEY):
        self.key = key
        self._permutation = lru_cache(4096)(lambda label, n: Permutation(key, label, n))
        self.replace = lru_cache(100_000)(self._replace)

    def _over(self, label: str, text: str, sets: list[str], clear: Callable[[str], bool] = lambda x: True) -> str:
        """Move a text in the domain of its places' character sets, on to the first that is clear."""
        n, x = 1, 0
        for c, s in zip(text, sets, strict=True):
            n, x = n * len(s), x * len(s) + s.index(c)
        permutation = self._permutation(f"{label}|{'|'.join(sets)}", n)
        for _ in range(n):
            x = permutation.next(x)
            out, rest = [], x
            for s in reversed(sets):
                rest, d = divmod(rest, len(s))
                out.append(s[d])
            found = "".join(reversed(out))
            if clear(found):
                return found
        return found

    def _digits(self, label: str, text: str) -> str:
        """The digits of a text moved together; whatever stands between them stays."""
        digits = [c for c in text if c in _DIGITS]
        new = iter(self._over(label, "".join(digits), [_DIGITS] * len(digits)))
        return "".join(next(new) if c in _DIGITS else c for c in text)

    def _marks(self, label: str, text: str) -> str:
        """Letters by their class and digits moved together, case and other signs kept."""
        low = unicodedata.normalize("NFC", text).lower()
        if len(low) != len(text):
            low = text
        at = [k for k, c in enumerate(low) if c in _DIGITS or c in _CLASS]
        if not at:
            return text
        sets = [_DIGITS if low[k] in _DIGITS else _CLASS[low[k]] for k in at]
        reserved = label == "name"
        new = self._over(label, "".join(low[k] for k in at), sets, lambda x: not (reserved and x in _KNOWN))
        out = list(text)
        for k, c in zip(at, new, strict=True):
            out[k] = c.upper() if text[k].isupper() and len(c.upper()) == 1 else c
        return "".join(out)

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return f"{self._marks('local', local.lower())}@{self._marks('domain', labels.lower())}.{top.lower()}"

    def phone(self, text: str) -> str:
        """The country code stays; the number's digits move alike however it is written."""
        code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        head = code[0] if code else ""
        return head + self._digits("phone", text[len(head):])

    def card(self, text: str) -> str:
        """All but the last digit move; a right check digit stays right, a wrong one as wrong as it was."""
        digits = [c for c in text if c in _DIGITS]
        body = self._over("card", "".join(digits[:-1]), [_DIGITS] * (len(digits) - 1))
        wrong = (int(digits[-1]) - _luhn("".join(digits[:-1]))) % 10
        new = iter(body + str((_luhn(body) + wrong) % 10))
        return "".join(next(new) if c in _DIGITS else c for c in text)

    def ip(self, text: str) -> str:
        """Another address of the same sort (private, public and so on)."""
        try:
            address = ipaddress.IPv4Address(".".join(str(int(x)) for x in text.split(".")))
        except ValueError:
            return self._digits("version", text)
        sort = _sort(address)
        permutation, x = self._permutation("ip", 1 << 32), int(address)
        while True:
            x = permutation.next(x)
            if _sort(ipaddress.IPv4Address(x)) == sort:
                return str(ipaddress.IPv4Address(x))

    def hexadecimal(self, label: str, text: str) -> str:
        """The hexadecimal digits of a text moved together, case and whatever stands between them kept."""
        digits = [c for c in text.lower() if c in _HEX]
        new = iter(self._over(label, "".join(digits), [_HEX] * len(digits)))
        moved = "".join(next(new) if c in _HEX else c for c in text.lower())
        return moved if text.lower() == text else moved.upper()

    def word(self, text: str) -> str:
        """A name: from the list of its script and gender if it is listed, else by classes of letters."""
        if "-" in text or "'" in text or "’" in text:
            return "".join(self.word(p) if p.isalpha() else p for p in re.split(r"([-'’])", text))
        known = _KNOWN.get(text.lower())
        if known is None:
            return self._marks("name", text)
        script, gender, k = known
        pool = GIVEN[script, gender]
        new = pool[self._permutation(f"given|{script}|{gender}", len(pool)).next(k)]
        return new.upper() if text.isupper() and len(text) > 1 else new

    def person(self, text: str) -> str:
        return "".join(self.word(p) if p.strip() else p for p in re.split(r"([  ])", text))

    def _replace(self, kind: str, text: str) -> str:
        if kind == "secret":
            return self.hexadecimal("hex", text) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) else self._marks("secret", text)
        return {"email": self.email, "phone": self.phone, "card": self.card, "ip": self.ip, "person": self.person,
                "ip6": lambda t: self.hexadecimal("ip6", t), "ssn": lambda t: self._digits("ssn", t), "iban": lambda t: t[:2] + self._marks("iban", t[2:])}[kind](text)


def _luhn(body: str) -> int:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _sort(address: ipaddress.IPv4Address) -> tuple:
    return (address.is_loopback, address.is_link_local, address.is_multicast, address.is_private, address.is_reserved,
            int(address) >> 24 == 0)


def entities(text: str, triggers: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity in a text, in order; name words of its persons also where they stand alone."""
    out: list[tuple[int, int, str]] = []
    for a, b in suspects(text, triggers):
        for m in ENTITY.finditer(text, a, b):
            if m["secret"]:
                out.append((*m.span("value"), "secret"))
            elif m["title"]:
                out.append((*m.span("titled"), "person"))
            elif m["given"]:
                out.append((*m.span(), "person"))
            else:
                out.append((*m.span(), next(k for k in ("email", "ip", "ip6", "ssn", "card", "iban", "phone") if m[k])))
    words = {w for a, b, kind in out if kind == "person" for w in _WORD.findall(text[a:b])}
    names = {w for word in words for w in (word, *_PART.findall(word)) if len(w) > 1 and w[0].isupper()}
    return _with_repeats(text, out, names) if names else out


_PART = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:[-'’][^\W\d_]+)*(?!\w)")


def _with_repeats(text: str, found: list[tuple[int, int, str]], names: set[str]) -> list[tuple[int, int, str]]:
    """The entities and, between them, the words that are a name word of some person, as it is or in capitals."""
    out, at = [], 0
    forms = names | {w.upper() for w in names} | {w.capitalize() for w in names if w.isupper()}
    for start, end, kind in [*found, (len(text), len(text), "")]:
        for m in _WORD.finditer(text, at, start):
            found_in = [m] if m[0] in forms else [p for p in _PART.finditer(text, *m.span()) if p[0] in forms]
            out += [(*p.span(), "person") for p in found_in]
        if kind:
            out.append((start, end, kind))
        at = end
    return out


def _run(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, triggers = Surrogates(key), _triggers()
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                texts, found = [], []
                for text in part.column("text").to_pylist():
                    spans, pieces, at = [], [], 0
                    for start, end, kind in entities(text, triggers) if text else []:
                        new = names.replace(kind, text[start:end])
                        pieces += [text[at:start], new]
                        spans.append({"kind": kind, "start": start, "end": end, "surrogate": new})
                        at = end
                    texts.append("".join([*pieces, text[at:]]) if spans else text)
                    found.append(spans)
                kept = {n: part.column(n) for n in part.schema.names if n != "text"}
                yield pa.RecordBatch.from_pydict(kept | {"text": pa.array(texts, pa.string()), "entities": pa.array(found, _SPANS)})
    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def replace_personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, key: str = KEY) -> DataFrame:
    """Per row: the columns of ``keep``, ``text`` with surrogates, ``entities`` (kind, start and end in the text as it
    was, surrogate), in order.

    Null texts stay null, empty ones empty; texts without entities come back as they are, and so do all characters
    outside entities. Every row is returned, repeated ones alike. Columns that are not asked for are ignored, so their
    names can't clash. An empty table gives an empty result. The key decides the surrogates: keep it secret.
    """
    keep = keep or []
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields if f.name != "text")
    out = source.mapInArrow(_run(key), f"{kinds}text string, entities array<struct<kind string, start int, end int, surrogate string>>")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "entities")


def surrogate_collisions(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """(kind, surrogate, originals) of surrogates that stand for several entities: a check that stays empty."""
    marked = docs.select(F.col(text_col).alias("original")).where("original is not null")
    pairs = replace_personal_data(marked, "original", ["original"], key).select("original", F.explode("entities").alias("e"))
    found = pairs.select("e.kind", "e.surrogate", F.expr("lower(substring(original, e.start + 1, e.end - e.start))").alias("was"))
    return found.distinct().groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).where("originals > 1")
