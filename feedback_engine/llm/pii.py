"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found by pattern on the text as it is. Then small transducers rewrite disguised stretches (look-alike letters,
spelled digits, at/dot words) to plain text and keep, for every character they write, the source stretch it
came from. The same patterns run on the rewritten text, and what they find is mapped back to source offsets. Spans are code
points, end exclusive.

Patterns read a stretch a bounded number of times, so a text's cost is linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like ASCII ones, digits as words, top-level domains for bare at/dot words.
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХαονρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXaovpikABEZHIKMNOPTYX", strict=True))
_LOOKS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
_LOOKS |= {chr(0x2010 + i): "-" for i in range(6)}
_DIGITS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_TOP_LEVEL = "com org net edu gov io co info de fr es uk eu us"

_DIGIT_OF = {word: str(i) for line in _DIGITS for i, word in enumerate(line.split())} | {"oh": "0"}
_ANY_DIGIT = "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + "|[0-9]"
_LOOK_TABLE = str.maketrans(_LOOKS)
_LOOK_SEARCH = re.compile("[" + "".join(map(re.escape, sorted(_LOOKS))) + "]")
_SPELLED = re.compile(rf"(?i)(?<![a-zà-ÿ0-9])(?:(?:{_ANY_DIGIT})(?![a-zà-ÿ])[ ,-]{{0,2}}){{7,}}")
_DIGIT_WORD = re.compile(rf"(?i){_ANY_DIGIT}")
_WORDS = re.compile("[a-zà-ÿ]+")
_AT = re.compile(r"(?i)(?<=[a-z0-9])\s?(?:\[at\]|\(at\)|\{at\}|<at>)\s?(?=[a-z0-9])")
_DOT = re.compile(r"(?i)(?<=[a-z0-9])\s?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\s?(?=[a-z0-9])")
_AT_WORD = re.compile(r"(?i) at(?= )")
_LOCAL_END = re.compile(r"(?i)[a-z0-9_%+-]+\Z")
_LOCAL_WORD = re.compile(r"(?i)[a-z0-9_-]+")
_HOST_WORD = re.compile(r"(?i)[a-z0-9-]+")
_LETTERS = re.compile(r"(?i)[a-z0-9]+")
_TOPS = frozenset(_TOP_LEVEL.split())


def _local_start(words: list[str]) -> int | None:
    """Characters at the end of the joined ``words`` that are ``a dot b dot c``: the longest such local part."""
    size, best = 0, None
    i = len(words) - 1
    while i >= 0:
        own = _LOCAL_END.search(words[i])
        if own is None:
            break
        if own.start() == 0 or words[i][own.start() - 1] != ".":
            best = size + len(own[0])
        if i < 2 or words[i - 1].lower() != "dot" or not _LOCAL_WORD.fullmatch(words[i]):
            break
        size += len(words[i]) + 5
        i -= 2
    return best


def _host_end(words: list[str]) -> int | None:
    """Characters of ``words`` up to the first top-level domain in ``host dot name dot com``."""
    if not _HOST_WORD.fullmatch(words[0]):
        return None
    size = len(words[0])
    for i in range(1, len(words) - 1, 2):
        if words[i].lower() != "dot":
            return None
        letters = _LETTERS.match(words[i + 1])
        if letters and letters[0].lower() in _TOPS:
            return size + 5 + len(letters[0])
        if not _HOST_WORD.fullmatch(words[i + 1]):
            return None
        size += 5 + len(words[i + 1])
    return None


def bare_addresses(text: str) -> list[Span]:
    """``name at host dot com`` in plain words. The stretches between the words ``at`` are each read twice, never more."""
    out: list[Span] = []
    places, free = [m.start() for m in _AT_WORD.finditer(text)], 0
    for i, at in enumerate(places):
        following = places[i + 1] if i + 1 < len(places) else len(text)
        end = _host_end(text[at + 4 : following].split(" ")) if following > at + 4 else None
        start = _local_start(text[free:at].split(" ")) if end and at > free else None
        free = at + 4
        if start:
            out.append((at - start, at + 4 + end))
            free = at + 4 + end
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _only_digits(found: str) -> str:
    return "".join(c for c in found if c in "0123456789")


def emails(text: str) -> list[Span]:
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        local = text[free:at]
        size = len(local) - len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at) if size else None
        free = at + 1
        if domain:
            out.append((at - size, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def ips(text: str) -> list[Span]:
    return [
        m.span() for m in _IP.finditer(text)
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split("."))
    ]


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 14 <= len(d := _only_digits(m[0])) <= 19 and _luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]


_FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def plain_spans(text: str) -> dict[str, list[Span]]:
    digits = any(d in text for d in "0123456789")
    return {k: find(text) if (digits if k != "email" else "@" in text) else [] for k, find in _FINDERS.items()}


def _may_spell(low: str) -> bool:
    """Whether a text has a digit word, and seven of them and digits together."""
    spelled = sum(map(_DIGIT_OF.__contains__, _WORDS.findall(low)))
    return spelled >= 7 or spelled > 0 and spelled + sum(map(low.count, "0123456789")) >= 7


def rewrite(text: str) -> tuple[str, list[int], list[int]] | None:
    """Rewritten text, and for each of its characters where its source begins and ends; None if nothing is disguised."""
    look = text.translate(_LOOK_TABLE) if not text.isascii() and _LOOK_SEARCH.search(text) else text  # one sign each
    low = look.lower()
    edits: list[tuple[int, int, list[tuple[str, int, int]]]] = []  # source stretch -> (sign, begin, end)
    if _may_spell(low):
        for m in _SPELLED.finditer(look):
            signs = []
            for w in _DIGIT_WORD.finditer(look, *m.span()):
                word = w[0].lower()
                sign = word if word in "0123456789" else _DIGIT_OF[word]
                signs.append((sign, w.start(), w.end()))
            tail = signs[-1][2]
            edits.append((m.start(), tail, signs))
    if "at" in low and "dot" in low or "at]" in low or "at)" in low or "at}" in low or "at>" in low:
        for pattern, sign in ((_AT, "@"), (_DOT, ".")):
            edits += [(*m.span(), [(sign, *m.span())]) for m in pattern.finditer(look)]
        if " dot " in low and " at " in low:
            for start, end in bare_addresses(look):
                for w in re.finditer(r"(?i) (at|dot) ", look[start:end]):
                    a, b = start + w.start(), start + w.end()
                    edits.append((a, b, [("@" if w[1].lower() == "at" else ".", a, b)]))
    if look == text and not edits:
        return None
    out, begins, ends, at = [], [], [], 0
    for start, end, signs in sorted(edits):
        if start < at:  # overlaps an earlier edit
            continue
        out.append(look[at:start])
        begins += range(at, start)
        ends += range(at + 1, start + 1)
        for sign, a, b in signs:
            out.append(sign)
            begins.append(a)
            ends.append(b)
        at = end
    out.append(look[at:])
    begins += range(at, len(look))
    ends += range(at + 1, len(look) + 1)
    return "".join(out), begins, ends


def hidden_spans(text: str) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows; a card or phone may be a run of spelled digits without a plus."""
    done = rewrite(text)
    if done is None:
        return {}
    flat, begins, ends = done
    found = plain_spans(flat)
    found["phone"] = found["phone"] + [
        m.span() for m in re.finditer(r"(?<![0-9+])[0-9]{10,13}(?![0-9])", flat)
        if ends[m.end() - 1] - begins[m.start()] > m.end() - m.start() and not _luhn(m[0])
    ]
    return {k: [(begins[a], ends[b - 1]) for a, b in spans] for k, spans in found.items()}


def _joined(spans: dict[str, list[Span]]) -> str:
    order = {kind: i for i, kind in enumerate(KINDS)}
    rows = sorted((a, order[kind], b, kind) for kind, found in spans.items() for a, b in found)
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in rows)


def all_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Base spans, and hidden ones that overlap none of them."""
    out = {k: list(v) for k, v in base.items()}
    starts: list[int] = []  # of stretches taken, apart from each other and in order
    ends: list[int] = []
    for a, b in sorted(s for v in base.values() for s in v):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, spans in hidden_spans(text).items():
        for a, b in spans:
            i = bisect_right(starts, a)
            if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b):
                out[kind].append((a, b))
                starts.insert(i, a)
                ends.insert(i, b)
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (of the plain spans), base_sha256, spans.

    Null text is empty and has no spans: the hash is that of an empty string. Rows that repeat an id are read one by one.
    An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            hashes, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = plain_spans(text)
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
                hashes.append(sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(all_spans(text, base)))
            yield pa.record_batch(
                [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
