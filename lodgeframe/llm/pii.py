"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters before and behind a span in which words count as nearby.
NEARBY = 40
#: Points of 100 from which a span is reported. Base kinds start there, so all their valid spans are.
LEAST = 60

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: ["NO"],
    16: ["BE"],
    18: ["DK", "FI", "FO", "GL", "NL"],
    19: ["MK", "SI"],
    20: ["AT", "BA", "EE", "KZ", "LT", "LU", "XK"],
    21: ["CH", "HR", "LI", "LV"],
    22: ["BG", "BH", "DE", "GB", "GE", "IE", "ME", "RS", "VA"],
    23: ["AE", "GI", "IL", "IQ", "TL"],
    24: ["AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"],
    25: ["PT"],
    26: ["IS", "TR"],
    27: ["FR", "GR", "IT", "MC", "MR", "SM"],
    28: ["AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "PL", "SV"],
    29: ["BR", "EG", "PS", "QA", "UA"],
    30: ["JO", "KW", "MU"],
    31: ["MT", "SC"],
}


def iban_pattern() -> str:
    """Country, check digits and the country's number of further characters, in runs of four."""

    def of(length: int, countries: list[str]) -> str:
        fours, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        return f"(?:{'|'.join(countries)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}"

    return r"\b(?:" + "|".join(of(n, c) for n, c in IBAN_LENGTHS.items()) + r")\b"


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and its own digits added, makes a sum of tens."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether the account number with its first four characters last, letters as 10 to 35, leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _ip(found: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(found: str) -> bool:
    return 9 <= sum(c.isdigit() for c in found) <= 15


def _iban(found: str) -> bool:
    return mod_97(found.replace(" ", ""))


def _ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``points`` are its score without, ``points`` + ``gain`` with one of ``words`` nearby.

    Matches are the leftmost ones that do not overlap; a text without a match of ``needs`` has none.
    ``confirm`` rejects matches, which are not tried again. ``propose`` finds spans another way than by
    searching for the whole pattern.
    """

    name: str
    pattern: str
    needs: str
    confirm: Callable[[str], bool] | None
    points: int
    gain: int
    words: str
    base: bool = True
    propose: Callable[[str, re.Pattern], Iterator[tuple[int, int]]] | None = None


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def emails(text: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of addresses. Each @ is looked at once, with the characters in front of it that no earlier one has."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = len(before.rstrip(_LOCAL)) + free
        found = domain.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        # what stands before this @ cannot belong to the next one
        free = found.end() if found else at + 1
        at = text.find("@", free)


#: A digit run starts only where no digit stands before it: from inside it nothing else could be found, and
#: looking there would take the square of its length. The same holds for what stands before an @, see emails().
KINDS = (
    Kind("email", r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", None, 80, 10, "mail|contact|write", propose=emails),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.", _ip, 60, 30, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])+", "[0-9]", _card, 70, 25, "card|credit|visa|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _phone, 60, 30, "phone|tel|call|mobile|fax"),
    Kind("iban", iban_pattern(), "[A-Z]{2}[0-9]{2}", _iban, 80, 15, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[0-9]-", _ssn, 30, 50, "ssn|social security", False),
    Kind(
        "local_phone", r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b", "[0-9]", None, 30, 40,
        "phone|tel|call|mobile|fax|ring", False,
    ),
)

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SPANS = "array<struct<kind: string, start: int, stop: int, score: int>>"


def finder(kinds: Sequence[Kind] = KINDS, nearby: int = NEARBY, least: int = LEAST):
    """A function from a text to its spans (kind, start, stop, score), by kind as listed, then start."""
    plans = [
        (k, *(re.compile(p, re.ASCII) for p in (k.pattern, k.needs, rf"\b(?:{k.words})\b"))) for k in kinds
    ]

    def spans(text: str) -> list[tuple[str, int, int, int]]:
        base, out = [], []
        for kind, pattern, needs, words in plans:
            if needs.search(text) is None:
                continue
            if kind.propose is not None:
                found = kind.propose(text, pattern)
            else:
                found = (m.span() for m in pattern.finditer(text))
            for start, stop in found:
                if kind.confirm is not None and not kind.confirm(text[start:stop]):
                    continue
                score = kind.points
                sides = text[max(0, start - nearby) : start], text[stop : stop + nearby]
                if any(words.search(s.translate(_LOWER)) for s in sides):
                    score += kind.gain
                if score >= least:
                    (base if kind.base else out).append((kind.name, start, stop, score))
        return base + (apart(out, base) if base and out else out)

    return spans


def apart(spans: list[tuple], others: list[tuple]) -> list[tuple]:
    """Those of ``spans`` that overlap none of ``others``."""
    ends = sorted((start, stop) for _, start, stop, _ in others)
    starts = [a for a, _ in ends]
    furthest = list(accumulate((b for _, b in ends), max))

    def free(start: int, stop: int) -> bool:
        earlier = bisect_left(starts, stop)
        return earlier == 0 or furthest[earlier - 1] <= start

    return [s for s in spans if free(s[1], s[2])]


def _emit(spans: Callable, redact: bool):
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.int32())])
    )

    def redacted(text: str | None, found: list[tuple]) -> str | None:
        at, out = 0, []
        for name, start, stop, _ in sorted(found, key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [text[at:start], f"<{name.upper()}>"]
            at = max(at, stop)
        return "".join([*out, text[at:]]) if out else text

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for text in batch.column("text"):
                text = text.as_py()
                found.append(spans(text or ""))
                if redact:
                    texts.append(redacted(text, found[-1]))
            rows = [[dict(zip(("kind", "start", "stop", "score"), s)) for s in one] for one in found]
            columns = [batch.column("doc_id"), pa.array(rows, kind)]
            names = ["doc_id", "spans"]
            if redact:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return emit


def find_pii(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    kinds: Sequence[Kind] = KINDS,
    nearby: int = NEARBY,
    least: int = LEAST,
    redact: bool = False,
) -> DataFrame:
    """``doc_id`` and ``spans`` of every row, and with ``redact`` also the text with each span as ``<KIND>``.

    A span has ``kind``, ``start`` and ``stop`` in characters (code points, stop exclusive) and ``score``, in points
    of 100. Spans are ordered by kind as listed (base kinds first), then start. Every valid span of the base kinds email, ip, card and phone is
    reported, also where two kinds overlap; spans of the other kinds need ``least`` points and no base span
    in their place. Rows are neither dropped nor merged; a missing or empty text has no spans; an empty table
    gives no rows; other columns are ignored, whatever their names. No shuffle; time grows with the text's length.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id long, spans {SPANS}" + (", redacted string" if redact else "")
    return narrow.mapInArrow(_emit(finder(kinds, nearby, least), redact), schema)
