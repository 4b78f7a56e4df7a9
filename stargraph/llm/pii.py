"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text reports the anchors: at-signs, digits, ``+digit``, ``://`` and identifier
cues ("iban", "account no", ...).  Around each anchor a deterministic parser expands to both sides and
validates.  Kinds, in output order:

email, ip, card, phone   the base kinds, defined by the patterns in ``BASE`` (leftmost, non-overlapping per kind;
                         ip parts at most 255, card 16 to 19 digits passing Luhn, phone 8 to 15 digits; a match
                         that fails its check is dropped and the text is not searched again inside it)
address                  from a scheme: ``scheme://host...`` whose host is a dotted name, an IPv4 address or
                         ``localhost``; trailing punctuation is left out
account                  from a cue: an IBAN (country letters, mod-97 check) or an account, customer, passport,
                         tax or social security number of 6 to 20 letters and digits with at least 5 digits, also
                         in blank-separated groups (of up to 4, or of equal size up to 6); cues match in any case

Spans are code points, end exclusive.  Null text: empty.  Null ids and repeated rows stay rows of their own; extra
columns are ignored; an empty table gives an empty result.  Every parser is linear in the text.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargraph.llm.common import by_value

#: The base kinds as patterns (the parsers below find the same spans without their quadratic cases).
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "address", "account")

CUES = (
    "iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "customer id", "passport", "tax id",
    "ssn", "social security",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_URL = re.compile(r"://(?:[^\s/@?#<>\"']*@)?([A-Za-z0-9.-]+)(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_AFTER_CUE = re.compile(r"(?:\s{0,2}(?:number|no\.?|nr\.?|id|n°))?\s{0,2}[:#=]?\s{0,2}", re.I)
_NUMBER = re.compile(r"[A-Z0-9](?:[ -]?[A-Z0-9]){5,33}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
        found.add_word("+" + digit, ("plus", 2))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """A-Z to a-z and nothing else, so that every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier that follows a cue ending at ``at``."""
    start = _AFTER_CUE.match(text, at).end()
    found = _NUMBER.match(text, start)
    if not found or start == at:
        return None
    # an IBAN first, as grouped runs shrink from the right; else blank-separated groups, the most first; else the
    # first run of letters and digits
    pieces = [m.end() for m in re.finditer(r"[A-Z0-9]+", found.group())]
    for end in reversed(pieces):
        if iban(re.sub("[ -]", "", found.group()[:end])):
            return start, start + end
    groups = re.match(r"[A-Z0-9]+(?: [A-Z0-9]+)*", found.group()).group().split(" ")
    while len(groups) > 1:
        value, end = "".join(groups), start + len(" ".join(groups))
        sizes = {len(g) for g in groups}
        alike = max(sizes) <= 4 or len(sizes) == 1 and max(sizes) <= 6
        marked = all(any(c.isdigit() for c in g) for g in groups[1:]) and (len(groups[0]) <= 3 or not groups[0].isalpha())
        whole = not text[end : end + 1].isalnum() and text[end : end + 1] != "-"
        if alike and marked and whole and 6 <= len(value) <= 20 and sum(c.isdigit() for c in value) >= 5:
            return start, end
        groups.pop()
    run = re.match(r"[A-Z0-9]+(?:-[A-Z0-9]+)*", found.group()).group()
    value = run.replace("-", "")
    if 6 <= len(value) <= 20 and sum(c.isdigit() for c in value) >= 5:
        return start, start + len(run)
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, in text order."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    email_end = ip_end = card_end = phone_end = address_end = account_end = 0
    for last, (anchor, width) in anchors.iter(lowered(text)):
        at = last - width + 1
        if anchor == "digit":
            if at >= ip_end:
                ip_end = _DOTTED.match(text, at).end()
                runs = [m.span() for m in _DIGITS.finditer(text, at, ip_end)]
                for i in range(0, len(runs) - 3, 4):
                    if all(len(text[a:b].lstrip("0")) <= 3 and int(text[max(a, b - 3) : b]) <= 255 for a, b in runs[i : i + 4]):
                        out["ip"].append((runs[i][0], runs[i + 3][1]))
            if at >= card_end:
                found = _CARD.match(text, at)
                card_end = found.end() if found else at + 1
                if found and found.end() - at >= 16:
                    digits = _NOT_DIGIT.sub("", found.group())
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(found.span())
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                email_end = domain.end()
                out["email"].append((start, email_end))
        elif anchor == "plus":
            found = _PHONE.match(text, at) if at >= phone_end else None
            if found:
                end = found.end()
                while not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end - at >= 4:  # the plus, a digit, one character between, a digit
                    phone_end = end
                    if 8 <= len(_NOT_DIGIT.sub("", text[at:end])) <= 15:
                        out["phone"].append((at, end))
        elif anchor == "scheme":
            start = at
            while start > address_end and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            found = _URL.match(text, at) if start < at else None
            host = found.group(1).strip(".-") if found else ""
            if found and (host.lower() == "localhost" or _DOMAIN.fullmatch(host)):
                address_end = at + len(found.group().rstrip(".,;:!?)]}"))
                out["address"].append((start, address_end))
        elif at >= account_end and not (at and text[at - 1].isalnum()):
            found = _account(text, last + 1)
            if found:
                account_end = found[1]
                out["account"].append(found)
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, found``: per document the kind, start and end of every span, by kind then start."""
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = spans(text.as_py() or "", anchors)
                rows.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]])
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(rows, schema.field("found").type)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, found array<struct<kind:string,start:long,end:long>>"
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans as text."""
    shown = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(
        F.filter("found", lambda s: s["kind"].isin(*BASE)),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]),
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs).select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(shown, ",").alias("spans"),
    )


by_value(__name__)
