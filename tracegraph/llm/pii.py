"""Personal data by anchor expansion.

Method.  One Aho-Corasick pass over a text finds anchors: at-signs, plus signs,
digits, URL schemes and identifier cues.  At each anchor a deterministic local
parser expands to the left and right and validates the candidate.  The parsers
of the base kinds return what the leftmost non-overlapping matches of these
patterns would:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits, Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits

Further kinds: ``url`` (an address with a scheme), ``iban`` (mod 97) and
``account`` (an identifier after a cue such as "account no").

Cases: a null or empty text has no spans; spans of different kinds may overlap;
positions are code points, end exclusive; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from tracegraph.llm._common import id_and_text, map_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
CUES = ("account", "acct", "iban", "passport", "customer id", "user id", "konto", "kontonummer", "compte", "cuenta", "member no", "policy no")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = "0123456789"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
REST = re.compile(r"://[^\s<>\"'`{}|\\^]+").match
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}").search
NAMED = re.compile(r"(?:\s*(?:no|nr|number|id|n°|num)\b\.?)?[\s:#=]{1,3}([A-Za-z0-9](?:-?[A-Za-z0-9]){4,33})", re.IGNORECASE).match


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+" + DIGITS:
        a.add_word(c, (c, 1))
    a.add_word("://", ("://", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``; its local part begins at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at or not (domain := DOMAIN(text, at + 1)):
        return None
    return start, domain.end()


def ips_in(text: str, chain: re.Match) -> list[tuple[int, int]]:
    """Runs of dotted numbers split into consecutive fours from the left."""
    parts = chain[0].split(".")
    out, at = [], chain.start()
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(int(p[-4:]) <= 255 and (len(p) < 5 or not p[:-4].strip("0")) for p in four):
            out.append((at, end))
        at = end + 1
    return out


def url_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around ``://`` at ``at``, without trailing punctuation."""
    start = at
    while start > floor and text[start - 1] in SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    rest = REST(text, at)
    if start == at or not rest:
        return None
    end = rest.end()
    while end > at + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if end > at + 3 else None


def account_at(text: str, end: int) -> tuple[str, int, int] | None:
    """The identifier after a cue that ends at ``end``: an IBAN close by, else a named number with a digit."""
    if (m := IBAN(text, end, min(len(text), end + 60))) and text[end : m.start()].strip(" :#=.-nNoOrR") == "":
        raw = m[0]
        for cut in range(len(raw), 14, -1):
            if raw[cut - 1] != " " and mod97(raw[:cut].replace(" ", "")):
                return "iban", m.start(), m.start() + cut
    if (m := NAMED(text, end)) and any(c in DIGITS for c in m[1]):
        return "account", m.start(1), m.end(1)
    return None


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = chain_end = card_end = phone_end = url_end = account_end = 0
    for last, (kind, width) in automaton().iter(text):
        at = last - width + 1
        if kind in DIGITS:
            if at >= chain_end:
                chain = DOTTED(text, at)
                chain_end = chain.end()
                out["ip"] += ips_in(text, chain)
            if at >= card_end and (m := GROUPED(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "@":
            if at >= email_end and (span := email_at(text, at, email_end)):
                out["email"].append(span)
                email_end = span[1]
        elif kind == "+":
            if at >= phone_end and (m := DIALLED(text, at)):
                phone_end = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "://":
            if at >= url_end and (span := url_at(text, at, url_end)):
                out["url"].append(span)
                url_end = span[1]
        elif at >= account_end and not (at and text[at - 1].isalnum()) and (got := account_at(text, last + 1)):
            out[got[0]].append(got[1:])
            account_end = got[2]
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def mask(text: str, spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = (*BASE, "iban", "account")) -> str:
    """``text`` with each span of ``kinds`` replaced by its kind; of overlapping ones the first, then longest, names the whole."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in sorted(((a, b, k) for k in kinds for a, b in spans[k]), key=lambda x: (x[0], -x[1], x[2])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += (text[at:a], f"<{k.upper()}>")
        at = b
    return "".join(out) + text[at:]


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, ``base`` and ``spans`` (kind:start:end, joined by commas) of every row."""
    docs = id_and_text(df, id_col, text_col)

    def make():
        def fn(cols: dict) -> dict:
            got = [find_spans(t) for t in cols[text_col]]
            counts = {f"n_{k}": [len(s[k]) for s in got] for k in BASE}
            return {id_col: cols[id_col], **counts, "base": [joined(s, BASE) for s in got], "spans": [joined(s, KINDS) for s in got]}

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs, make, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def digests(df: DataFrame) -> DataFrame:
    """The base spans as one hash, beside counts and all spans."""
    return spans(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, the personal data in ``text_col`` replaced by its kind; a null text stays null."""
    schema = df.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t if t is None else mask(t, find_spans(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    return df.mapInArrow(run, schema)
