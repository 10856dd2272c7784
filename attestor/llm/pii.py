"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of all kinds in a single pass over the text: at-signs,
plus signs, digits, ``://`` after a scheme, and words that announce an identifier. Each anchor is
handed to a deterministic parser that grows it to both sides, checks it and gives its span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from attestor.llm.common import per_row, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_HOST = re.compile(r"[^\s\"'<>]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_VALUE = re.compile(r"[ \t]*[:=][ \t]*([\"']?)([A-Za-z0-9_/+=.-]{16,})\1")

# fixed values: the words that announce a secret, and the longest scheme looked back for
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
SCHEME_LENGTH = 16


def _automaton() -> ahocorasick.Automaton:
    anchors = {"@": "email", "+": "phone", "://": "url"} | {str(d): "digit" for d in range(10)}
    for cue in CUES:
        anchors |= {form: "secret" for form in (cue, cue.upper(), cue.capitalize())}
    found = ahocorasick.Automaton()
    for word, kind in anchors.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_end(text: str, start: int) -> int:
    """Where a valid account number that starts here ends, or 0; the longest valid one counts."""
    m = _IBAN.match(text, start)
    if not m or start and text[start - 1].isalnum():
        return 0
    end = m.end()
    while end - start >= 15:
        if not text[end:end + 1].isalnum():
            plain = text[start:end].replace(" ", "")
            turned = plain[4:] + plain[:4]
            if text[end - 1] != " " and 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                return end
        end -= 1
    return 0


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, in the order of KINDS and then of starts.

    Of one kind, spans do not overlap and the leftmost wins; a match that fails its check is
    used up all the same, as nothing is tried again inside it.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = iban = 0  # where the next span of the kind may begin
    for last, (kind, length) in ANCHORS.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                plain = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(plain) <= 19 and luhn(plain):
                    found["card"].append(m.span())
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:  # what follows the digits decides, so no later digit of them can succeed
                    ip = _DIGITS.match(text, at).end()
            if at - 2 >= iban and text[at - 2:at].isalpha() and (end := _iban_end(text, at - 2)):
                found["iban"].append((at - 2, end))
                iban = end
        elif kind == "email":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                email = m.end()
        elif kind == "phone":
            if (m := _PHONE.match(text, at)) and 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found["phone"].append(m.span())
        elif kind == "url":
            left = _SCHEME.search(text[max(0, at - SCHEME_LENGTH):at])
            right = _HOST.match(text, at + 3)
            if left and right and "." in right[0].strip("."):
                end = at + 3 + len(right[0].rstrip(".,;:!?)]}"))
                found["url"].append((at - len(left[0]), end))
        elif m := _VALUE.match(text, last + 1):
            if any("0" <= c <= "9" for c in m[2]):
                found["secret"].append(m.span(2))
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def listed(found: Iterator[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every span of personal data as (kind, start, end, value).

    A null or empty text has none. Repeated rows give repeated rows, a null key stays null, and
    other columns are ignored.
    """
    return per_row(texts(docs, key, text),
                   lambda d, t: (d, [(k, a, b, t[a:b]) for k, a, b in spans(t or "")]),
                   "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts and the digest of the base spans, and all spans as text."""
    def work(doc_id, text):
        found = spans(text or "")
        base = [s for s in found if s[0] in BASE]
        counts = [sum(s[0] == k for s in base) for k in BASE]
        return (doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found))
    return per_row(texts(docs), work, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                                      "base_sha256 string, spans string")
