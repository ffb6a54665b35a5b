"""Personal data by a linear-chain conditional random field over word shapes.

The field labels words as parts of e-mail addresses, IP addresses, payment cards, phone numbers, social
security numbers and bank account numbers.  It learns from a small labelled table: ``PATTERNS`` filled by
``VALUES`` with digits and words drawn from a fixed seed.

Words without a digit, ``@`` or bracket, and not next to one that has, can only be outside; moves into and
out of them weigh the same for all texts.  The chain therefore falls apart there, and every run of
other words is a sequence that Viterbi decodes in numpy batches.  A labelled span is kept if it passes an exact check of its
kind (numbers of digits, check digits), trimmed to what the check matches.

The base kinds are also found by their patterns (``base_spans``); the field's spans are added where they
touch none of them.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingwatch.llm import crf
from wingwatch.llm.common import _SPACE, WordHasher, mix64, row_chunks, text_buffer, text_of

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE = 4  # the first kinds have base patterns
CONTEXT = 2  # words beside a run that features look at
SEQUENCES = 1500  # of the labelled table

# --- base patterns -------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only begin where a run of digits does, and none of the runs is ever given back
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping within a kind, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in (g.lstrip("0") for g in m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- exact checks of the field's spans -----------------------------------------------------

_WORD = r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?=[A-Za-z0-9]))*"
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[\[({]\x20?at\x20?[\])}]\x20?)", r"(?:\x20?\.\x20?|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)"
_HOST = r"[A-Za-z0-9-]+"
_CHECKS = {
    "email": re.compile(rf"(?i){_WORD}{_AT}{_HOST}(?:{_DOT}{_HOST})+"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Fa-f:])|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){13,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9])(?!000|666|9)[0-9]{3}[\x20-](?!00)[0-9]{2}[\x20-](?!0000)[0-9]{4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
}


def _iban_ok(text: str) -> bool:
    raw = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _ip_ok(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def checked(kind: str, text: str) -> tuple[int, int] | None:
    """Start and end of what the exact check of ``kind`` finds in a labelled span."""
    found = _CHECKS[kind].search(text)
    if not found:
        return None
    digits = _DIGITS.sub("", found[0])
    fits = {"card": lambda: luhn(digits), "phone": lambda: len(digits) >= 9 or found[0].startswith(("+", "(", "0")),
            "iban": lambda: _iban_ok(found[0]), "ip": lambda: _ip_ok(found[0])}.get(kind, lambda: True)()
    return found.span() if fits else None


# --- words, runs and features --------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)  # a byte's class in a word's shape: itself, or one letter for many
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = ord("d"), ord("A"), ord("a"), ord("a")
_HINT = np.zeros(256, bool)  # bytes that make a word a candidate
_HINT[48:58] = _HINT[[ord(c) for c in "@[({"]] = True
_SEGMENT = 1 << 17  # of the hashers, which are made where they are used
_N_FEATURES = 14


def _class_hash(data: np.ndarray, start: np.ndarray, squeeze: bool) -> np.ndarray:
    """Hash of each word's shape; ``squeeze`` keeps one of equal neighbours."""
    if not len(start):
        return np.zeros(0, np.uint64)
    shape = _CLASS[data]
    keep = np.zeros(len(data) + 1, bool)
    keep[:-1] = ~_SPACE[data]
    if squeeze:
        same = np.zeros(len(data) + 1, bool)
        same[1:-1] = shape[1:] == shape[:-1]
        same[start] = False
        keep &= ~same
    place = np.append(0, np.cumsum(keep[:-1]))
    flat = shape[keep[:-1]]
    gaps = np.insert(flat, place[start], 32)  # a space before every word
    return WordHasher(False, _SEGMENT).words(gaps)[2]


def _shift(x: np.ndarray, by: int, row: np.ndarray) -> np.ndarray:
    """``x`` of the word ``by`` places on in the same row and without a gap, 0 where there is none."""
    out = np.zeros_like(x)
    if by > 0:
        ok = row[by:] == row[:-by]
        out[:-by][ok] = x[by:][ok]
    else:
        ok = row[:by] == row[-by:]
        out[-by:][ok] = x[:by][ok]
    return out


def runs(data: np.ndarray, offsets: np.ndarray):
    """(start and end byte, row, features, sequence number) of the candidate words of all rows."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    none = np.zeros(0, np.int64)
    hints = np.flatnonzero(_HINT[data])
    if not len(hints):
        return none, none, none, np.zeros((0, _N_FEATURES), np.uint64), none
    row = np.searchsorted(offsets, start, side="right") - 1
    hint = np.zeros(len(start) + 1, bool)
    hint[np.searchsorted(start, hints, side="right") - 1] = True
    hint = hint[:-1]

    def spread(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        out[1:] |= x[:-1] & (row[1:] == row[:-1])
        out[:-1] |= x[1:] & (row[1:] == row[:-1])
        return out

    inner = spread(hint)
    outer = inner
    for _ in range(CONTEXT):
        outer = spread(outer)
    at = np.flatnonzero(outer)
    s, e, n = start[at], end[at], len(at)
    size = e - s
    begin = np.cumsum(size + 1) - size - 1
    compact = np.full(int((size + 1).sum()), 32, np.uint8)  # the words with one space after each
    take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    compact[np.repeat(begin, size) + take] = data[np.repeat(s, size) + take]
    digit = np.append(0, np.cumsum((compact >= 48) & (compact < 58)))
    digits = digit[begin + size] - digit[begin]
    word = WordHasher(True, _SEGMENT).words(compact)[2]
    full, shape = (_class_hash(compact, begin, z) for z in (False, True))
    # words that are neighbours in the text share a group
    group = np.cumsum(np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    plain = (digits == 0) & ~np.isin(compact[begin], np.frombuffer(b"[({", np.uint8))
    word = np.where(plain, word, np.uint64(1))
    total = np.zeros(n, np.int64)  # digits of the neighbouring words with digits, together
    block = np.cumsum(np.append(True, (digits[1:] > 0) != (digits[:-1] > 0)) | np.append(True, group[1:] != group[:-1]))
    total = np.bincount(block, digits)[block].astype(np.int64)
    u = lambda x: x.astype(np.uint64)
    ends = u(compact[begin]) * np.uint64(256) + u(compact[begin + size - 1])
    columns = [full, shape, u(np.minimum(digits, 20)), word, _shift(word, -1, group), _shift(word, -2, group), _shift(shape, -1, group),
               _shift(shape, 1, group), _shift(full, -1, group), _shift(full, 1, group), u(np.minimum(total, 40)), u(_CLASS[compact[begin]]) * np.uint64(256)
               + u(_CLASS[compact[begin + size - 1]]), ends, mix64(shape) + _shift(shape, 1, group)]
    keep = inner[at]
    features = np.stack([mix64(c[keep] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k, c in enumerate(columns)], axis=1)
    chosen = at[keep]
    sequence = np.cumsum(np.append(True, (chosen[1:] != chosen[:-1] + 1) | (row[chosen[1:]] != row[chosen[:-1]]))) - 1
    return s[keep], e[keep], row[chosen], features, sequence


# --- the labelled table --------------------------------------------------------------------

#: sentences with places for values; {w} is any plain word.  What VALUES marks with a kind is labelled.
PATTERNS = (
    "{w} {w} {email} {w} {w}", "write to {email}, {w}", "{w} e-mail: {email}", "contact {email} or {phone}.", "{email} {w} {w}",
    "{w} {w} <{email}> {w}", "mail {spoken} {w}", "{w} reach me at {spoken} {w}", "{w} {spoken}, {w}", "{w} {email}; {email} {w}",
    "{w} server {ip} {w}", "host {ip} {w} {w}", "{w} {w} {ip} {w}", "from {ip}, {w}", "login from {ip6} {w}", "{w} address {ip6}.",
    "{w} card {card} {w}", "{w} {card} {w}", "paid with {card}, {w}", "visa {card} expires {month}", "{w} heat {card} {w} {w}",
    "call {phone} {w}", "tel. {phone}", "{w} {phone} {w} {w}", "phone: {phone}, {w}", "my number is {phone}.", "{w} the {phone} {w}",
    "call {local} {w}", "tel: {local}", "phone {local}, {w}", "fax {local} {w}", "{w} {w} {area} {w}", "mobile {area}.", "{w} {area}, {w}",
    "ssn {ssn} {w}", "social security number {ssn}.", "{w} {ssn} {w}", "SSN: {ssn}, {w}",
    "iban {iban} {w}", "IBAN: {iban}.", "account {iban} {w}", "{w} {iban} {w}",
    "in {year} {w} {w}", "{w} {int} {w} {w}", "{w} {w} {int}, {w} {int}", "on {date} {w}", "{w} {date}: {w}", "at {time} {w}", "{w} {time} - {time}",
    "costs {price} {w}", "{w} {price} {w}", "version {version} {w}", "isbn {isbn} {w}", "{w} ({int}) {w}", "{w} [{int}] {w}", "order {code} {w}",
    "{w} {code} {w}", "({w} {w}) {w}", "{w} @ {w} {w}", "{int} {int} {int}", "{w} {percent} {w}", "section {version} {w}", "{w} {hex} {w}",
    "{w} {long} {w}", "{int}/{int} {w}", "{w} {w} {year}-{year} {w}", "id {long} {w}", "{w} {date} {time} {int} {w}",
    "({year}) {w}", "{w} ({w}) {int} {w}", "{w} {price} {price} {price}", "{w} {code}, {code} {w}",
)
#: value -> (kind or none, forms).  # is a digit, ? a small letter, ! a capital, ~ a plain word.
VALUES = {
    "email": ("email", ("~@~.com", "~.~@~.org", "~##@~#.example.com", "~.##@~#.example.com", "~_~@~-~.net", "~+~@~.co.uk", "~@~.~.de")),
    "spoken": ("email", ("~ [at] ~ [dot] com", "~ (at) ~ (dot) org", "~[at]~[dot]net", "~(at)~.de", "~ {at} ~ {dot} org", "~ [at] ~.com")),
    "ip": ("ip", ("1#.#.#.#", "1##.##.#.##", "##.1##.##.#", "10.#.#.1##", "192.168.#.##", "1#.##.###.#")),
    "ip6": ("ip", ("2001:db8:####::#", "fe80::####:####:####:####", "2a0#:####:#:#:#:#:#:#")),
    "card": ("card", ("4###############", "5### #### #### ####", "4###-####-####-####", "37## ###### #####", "4### #### #### ####", "6###############")),
    "phone": ("phone", ("+1 (###) ###-####", "+49 ## #######", "+44 #### ######", "+33 # ## ## ## ##", "+1-###-###-####", "+34 ### ### ###", "+1##########")),
    "local": ("phone", ("0## #######", "0##/######", "0### ### ###", "(0##) ######")),
    "area": ("phone", ("(###) ###-####", "###-###-####", "0049 ## #######", "(###) ### ####", "(0##) #### ####")),
    "ssn": ("ssn", ("1##-##-####", "2##-##-####", "4##-##-####", "5## ## ####")),
    "iban": ("iban", ("DE## #### #### #### #### ##", "GB##!!!!##############", "FR## #### #### #### #### #### ###", "ES####################")),
    "year": (None, ("19##", "20##")), "int": (None, ("#", "##", "###", "####", "#,###", "#####", "##,###,###")), "percent": (None, ("##%", "#.#%")),
    "date": (None, ("20##-0#-1#", "1#/0#/20##", "##.0#.19##", "0#/1#/##")), "time": (None, ("1#:##", "0#:##:##")),
    "price": (None, ("$##.##", "##.## EUR", "€###", "#.###,##")), "version": (None, ("#.#", "#.#.#", "v#.##")), "month": (None, ("0#/##",)),
    "isbn": (None, ("978-#-##-######-#", "978##########")), "code": (None, ("!!-####", "!##", "?#?##", "A-###-##", "####-!!")),
    "hex": (None, ("?##?#??##?##?#", "##??####??####")), "long": (None, ("##########", "#######", "############", "#### ####")),
}


def labelled(n: int = SEQUENCES, seed: int = 12) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """``n`` rows of the labelled table: text and its (start, kind, end) spans."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word() -> str:
        made = "".join(pick(letters) for _ in range(int(rng.integers(2, 10))))
        return pick((made, made, made.capitalize(), made + ",", made + "."))

    def value(form: str) -> str:
        drawn = {"#": lambda: pick("0123456789"), "?": lambda: pick("abcdef"), "!": lambda: pick(letters).upper(),
                 "~": lambda: "".join(pick(letters) for _ in range(int(rng.integers(3, 9))))}
        return "".join(drawn[c]() if c in drawn else c for c in form)

    out = []
    for i in range(n):
        text, spans = "", []
        for piece in re.split(r"(\{\w+\})", PATTERNS[i % len(PATTERNS)]):
            name = piece[1:-1]
            if piece == "{w}":
                text += word()
            elif piece.startswith("{"):
                kind, forms = VALUES[name]
                made = value(pick(forms))
                if kind:
                    spans.append((len(text), kind, len(text) + len(made)))
                text += made
            else:
                text += piece
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def model() -> crf.Model:
    """The field, trained on the labelled table (a few seconds, the same each time)."""
    rows = labelled()
    raw = [t.encode() for t, _ in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    start, end, row, features, sequence = runs(data, offsets)
    label = np.zeros(len(start), np.int64)
    for i, (text, spans) in enumerate(rows):
        for a, kind, b in spans:
            a, b = (offsets[i] + len(text[:x].encode()) for x in (a, b))
            held = np.flatnonzero((start < b) & (end > a))
            label[held] = 2 * KINDS.index(kind) + 2
            label[held[:1]] -= 1
    return crf.fit(features, label, np.bincount(sequence), len(KINDS))


# --- finding -------------------------------------------------------------------------------

def field_spans(field: crf.Model, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """row -> (start, kind, end) of the field's checked spans, in code points."""
    start, end, row, features, sequence = runs(data, offsets)
    out: dict[int, list] = {}
    if not len(start):
        return out
    label = crf.decode(field, features, np.bincount(sequence))
    head = np.flatnonzero(label % 2 == 1)
    goes_on = (label > 0) & (label % 2 == 0)
    stop = np.append(np.flatnonzero(~goes_on), len(label))
    last = stop[np.searchsorted(stop, head, side="right")] - 1
    for i, j in zip(head, last):
        k = int(label[i] - 1) // 2
        text = data[start[i]:end[j]].tobytes().decode()
        if found := checked(KINDS[k], text):
            out.setdefault(int(row[i]), []).append((int(start[i]), k, text, found))
    for r, spans in out.items():
        base = offsets[r]
        points = np.append(0, np.cumsum((data[base:offsets[r + 1]] & 0xC0) != 0x80))
        out[r] = [(int(points[s - base]) + a, k, int(points[s - base]) + b) for s, k, _, (a, b) in spans]
    return out


def merged(base: list, field: list) -> list:
    """All base spans and the field's that touch none of them, by start, then kind."""
    free = [x for x in field if not any(a < x[2] and x[0] < b for a, _, b in base)] if len(base) * len(field) < 1000 else _free(base, field)
    return sorted(base + free)


def _free(base: list, field: list) -> list:
    """The same for many spans: by the furthest end of the base spans that begin before."""
    starts = np.array([a for a, _, _ in base])
    ends = np.maximum.accumulate(np.array([b for _, _, b in base]))
    at = np.searchsorted(starts, [x[2] for x in field], side="left") - 1
    return [x for x, i in zip(field, at) if i < 0 or ends[i] <= x[0]]


_BASE_HINT = np.zeros(256, bool)
_BASE_HINT[48:58] = _BASE_HINT[ord("@")] = True


def _found(field: crf.Model, texts: pa.Array):
    """(base spans, all spans) of each text."""
    data, offsets = text_buffer(texts)
    for a, b in row_chunks(offsets, 4 << 20):
        lo = offsets[a]
        part, places = data[lo:offsets[b]], offsets[a:b + 1] - lo
        extra = field_spans(field, part, places)
        hints = np.append(0, np.cumsum(_BASE_HINT[part]))
        for i in range(b - a):
            if hints[places[i]] == hints[places[i + 1]]:
                base = []
            else:
                base = base_spans(part[places[i]:places[i + 1]].tobytes().decode())
            yield base, merged(base, extra[i]) if i in extra else base


def _told(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` with n_<base kind>, base and spans (``kind:start:end``, code points, end
    exclusive, comma-joined, by start and kind) and n_added."""
    field = model()
    names = [f"n_{k}" for k in KINDS[:BASE]]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        for b in batches:
            base, every = zip(*_found(field, b.column("pii_text"))) if b.num_rows else ((), ())
            counts = [pa.array([sum(k == i for _, k, _ in x) for x in base], pa.int64()) for i in range(BASE)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in carry], *counts, pa.array([_told(x) for x in base], pa.string()), pa.array([_told(x) for x in every], pa.string()),
                 pa.array([len(y) - len(x) for x, y in zip(base, every)], pa.int64())],
                [*carry, *names, "base", "spans", "n_added"])

    rows = docs.select(*carry, text_of().alias("pii_text"))
    return rows.mapInArrow(run, f"{kept}, {', '.join(f'{n} long' for n in names)}, base string, spans string, n_added long")


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping ones by one mark); a null text stays null.
    n_chars, where the column is there, follows the new text."""
    field, schema = model(), docs.schema

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, (_, spans) in enumerate(_found(field, b.column("text")) if b.num_rows else ()):
                if not spans:
                    continue
                out, end = [], 0
                for a, _, z in spans:
                    if a >= end:
                        out += [texts[i][end:a], mark]
                    end = max(end, z)
                texts[i] = "".join(out) + texts[i][end:]
            at = b.schema.get_field_index("text")
            new = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            if (k := b.schema.get_field_index("n_chars")) >= 0:
                kept = [len(t) if t is not None else n for t, n in zip(texts, b.column(k).to_pylist())]
                same = [x == y for x, y in zip(texts, b.column("text").to_pylist())]
                counts = [o if s else n for o, n, s in zip(b.column(k).to_pylist(), kept, same)]
                new = new.set_column(k, b.schema.field(k), pa.array(counts, b.schema.field(k).type))
            yield new

    return docs.mapInArrow(run, schema)


def op12_find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and n_added) for every row of ``docs``.

    The counts and base_sha256 are of the base spans; ``spans`` has the field's too.  A null or empty text
    has none.  Of labellings with equal scores the one with the lower labels wins.  A very long text
    is one row of one task; memory grows with that text alone.  Repeated rows each get their result,
    an empty table gives no rows.
    """
    return find(docs, ["doc_id"]).select("doc_id", *[f"n_{k}" for k in KINDS[:BASE]], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
