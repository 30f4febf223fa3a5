"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, URL schemes, digits, plus
signs before digits, account cues). At each anchor a small deterministic parser expands to
the boundaries and validates; nothing else of the text is looked at.
Offsets are code points, ends exclusive. Kinds and their rules:

email    local part, "@", labels with at least one dot
ip       four runs of digits joined by dots, each at most 255
card     a maximal chain of digits with single blanks or hyphens, 12-19 digits, Luhn
phone    "+", digits and separators, 9-15 digits
url      scheme://user:password@host - an address with credentials
account  a cue (iban, account, acct), then an identifier of 8+ characters with 6+ digits

Within a kind matches run left to right without overlap; a candidate that
fails its test is dropped and not tried again shorter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import long_id, released

KINDS = ("email", "ip", "card", "phone", "url", "account")
SCHEMA = "id long, spans array<struct<kind:string,start:int,end:int>>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_URL = re.compile(r"://[A-Za-z0-9._~%+-]+:[^\s@/]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
#: The identifier is a word and those after it that have a digit; the rest of the text is not looked at.
_ACCOUNT = re.compile(r"(?:[ ]?(?:no\.?|number|nr\.?|#))?[ ]?[:=#]?[ ]?([A-Za-z0-9]+(?:[ -](?=[A-Za-z]*[0-9])[A-Za-z0-9]+)*)")
_CUES = ("iban", "IBAN", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


class Finder:
    def __init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        anchors = {"@": "at", **{str(d): "digit" for d in range(10)}, **{f"+{d}": "plus" for d in range(10)}}
        anchors |= {s + "://": "scheme" for s in ("http", "https", "ftp", "ssh", "postgres", "mysql", "mongodb", "redis", "amqp")}
        anchors |= dict.fromkeys(_CUES, "cue")
        for a, what in anchors.items():
            self.auto.add_word(a, (what, len(a)))
        self.auto.make_automaton()

    def spans(self, t: str) -> list[tuple[int, int, str]]:
        """(start, kind number, end) by start, then kind as listed."""
        found = []
        done = dict.fromkeys(KINDS, 0)  # the end of what a kind has consumed
        digits_to = 0

        def take(kind: str, start: int, end: int, good: bool) -> None:
            done[kind] = end
            if good:
                found.append((start, KINDS.index(kind), end))

        for last, (what, size) in self.auto.iter(t):
            at = last + 1 - size
            if what == "digit":
                if at < digits_to:
                    continue
                digits_to = _DIGITS.match(t, at).end()
                if at >= done["ip"] and (m := _IP.match(t, at)):
                    take("ip", at, m.end(), all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) < 4) and all(len(p.lstrip("0")) < 4 for p in m[0].split(".")))
                if at >= done["card"] and (m := _CHAIN.match(t, at)):
                    only = m[0].replace(" ", "").replace("-", "")
                    take("card", at, m.end(), 12 <= len(only) <= 19 and luhn(only))
            elif what == "at":
                start = at
                while start > done["email"] and t[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(t, at + 1)):
                    take("email", start, m.end(), True)
            elif what == "plus":
                if at >= done["phone"] and (m := _PHONE.match(t, at)):
                    take("phone", at, m.end(), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
            elif what == "scheme":
                if at >= done["url"] and (m := _URL.match(t, last - 2)):
                    take("url", at, m.end(), True)
            elif at >= done["account"] and not (at and t[at - 1].isalnum()) and (m := _ACCOUNT.match(t, last + 1)):
                value, start = m[1], m.start(1)
                only = value.replace(" ", "").replace("-", "")
                if len(only) >= 8 and sum("0" <= c <= "9" for c in only) >= 6:
                    take("account", start, start + len(value), True)
        found.sort()
        return found


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row; spans by start, then kind as listed in KINDS.

    Null text counts as empty and gives no spans; ids may be null or repeat (a
    row each). Whole texts are read, of any length. An empty table gives an
    empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for text in b.column("text"):
                t = text.as_py()
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in finder.spans(t)] if t else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "spans"])

    rows = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), SCHEMA)


def span_columns(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """(doc_id, n_<kind> of the base kinds, base_sha256, spans as text) from (id, spans)."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"),
        *[number(k).alias(f"n_{k}") for k in base],
        F.sha2(text(of_base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
