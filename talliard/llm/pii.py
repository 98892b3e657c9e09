"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate around them.

One automaton finds at-signs, plus signs, scheme marks, digits and identifier cues in a single pass over each whole
text. Every anchor is handed to a small parser that grows from it to the next delimiter, however far that is: an at-sign grows to the left
and right into an email address, a digit that starts a run into an IP address or a card number, a plus sign into a
phone number, a scheme mark into a url with credentials, and a cue into the secret or account number behind it.
Parsers of one kind go from left to right and never overlap; what fails validation is dropped and not retried.
The automaton is built in each task from the fixed cues; the work is a map over Arrow batches without a shuffle.

The base kinds (email, ip, card, phone) follow fixed patterns, see the parsers; secret, account and url are added
and leave the base spans as they are. Positions are code points, the end exclusive. Null and empty texts have no
spans. Ties go by start, then by kind in the order of KINDS. Repeated rows are judged each by itself; extra columns
pass through, those that clash with a result's name are replaced; an empty table gives an empty result.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm.common import texts, wider
from talliard.tables import table

KINDS = ["email", "ip", "card", "phone", "secret", "account", "url"]
BASE = KINDS[:4]

#: Cues in small letters, as any case counts, and the kind of value that they announce.
CUES = {
    "token": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "api_key": "secret", "api-key": "secret", "apikey": "secret",
    "account": "account", "acct": "account", "iban": "account", "ssn": "account",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"""["']?\s{0,3}[=:]\s{0,3}["']?([^\s"']{8,}+)""")
ACCOUNT = re.compile(r"(?:\s{0,3}(?:no|nr|number|id)\b)?[.:#= ]{1,4}([A-Z0-9][A-Z0-9-]{5,})\b", re.IGNORECASE)
#: What stands between an account's cue and a printed IBAN, and the IBAN: the longest that the standard allows, in groups of four.
LEAD = re.compile(r"(?:\s{0,3}(?:no|nr|number|id)\b)?[.:#= ]{1,4}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ \u00A0\u202F]?[A-Z0-9]{4}){2,7}(?:[ \u00A0\u202F]?[A-Z0-9]{1,3})?", re.IGNORECASE | re.ASCII)
IBAN_LENGTHS = range(15, 35)
USERINFO = re.compile(r"""://[^\s/@:"'<>]++:[^\s/@"'<>]++@[^\s"'<>]++""")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for key in ["@", "+", "://", *DIGITS]:
        found.add_word(key, (key if key not in DIGITS else "0", len(key)))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def folded(text: str) -> str:
    """Small letters, place by place: the one letter whose small form is longer goes first."""
    return text.replace("\u0130", "\0").lower()


def iban_end(text: str, at: int) -> int | None:
    """The end of the longest valid IBAN from a place, in groups or whole."""
    m = IBAN.match(text, at)
    for end in range(m.end(), at, -1) if m else ():
        if text[end - 1].isalnum() and not text[end : end + 1].isalnum():
            code = re.sub("[ \u00A0\u202F]", "", text[at:end])
            if len(code) in IBAN_LENGTHS and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return end
    return None


def spans_of(text: str, anchors) -> list[tuple[int, str, int]]:
    """(start, kind, end) of one text, by start and then kind."""
    found, over = [], dict.fromkeys([*KINDS, "start"], 0)
    for last, (anchor, length) in anchors.iter(folded(text)):
        at = last + 1 - length
        if anchor == "0":
            if at >= over["ip"] and (at == 0 or text[at - 1] not in DIGITS) and (m := IP.match(text, at)):
                over["ip"] = m.end()
                if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups()):
                    found.append((at, "ip", m.end()))
            if at >= over["card"] and (m := CARD.match(text, at)):
                over["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, "card", m.end()))
        elif anchor == "@":
            start = at
            while start > over["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                over["email"] = m.end()
                found.append((start, "email", m.end()))
        elif anchor == "+":
            if at >= over["phone"] and (m := PHONE.match(text, at)):
                over["phone"] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found.append((at, "phone", m.end()))
        elif anchor == "://":
            if at >= over["url"] and (m := USERINFO.match(text, at)):
                start = at
                while start > over["url"] and text[start - 1] in SCHEME:
                    start -= 1
                over["url"] = m.end()
                found.append((start, "url", m.end()))
        elif anchor == "account" and at >= over[anchor] and (m := LEAD.match(text, last + 1)) and (end := iban_end(text, m.end())):
            over[anchor] = end
            found.append((m.end(), anchor, end))
        elif at >= over[anchor] and (m := (SECRET if anchor == "secret" else ACCOUNT).match(text, last + 1)):
            over[anchor] = m.end()
            if any(c in DIGITS for c in m[1]) if anchor == "secret" else sum(c in DIGITS for c in m[1]) >= 6:
                found.append((m.start(1), anchor, m.end(1)))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with spans, an array of (kind, start, end)."""
    docs = docs.drop(*({"spans"} & set(docs.columns)))

    def scan(batches):
        anchors = automaton()
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, k, e in spans_of(t, anchors)] if t else [] for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPAN)], [*batch.schema.names, "spans"])

    return docs.mapInArrow(scan, wider(docs, "spans array<struct<kind:string,start:bigint,end:bigint>>"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with redacted: each span of the text replaced by its kind in brackets; overlapping spans as one, by the first's kind."""

    def scan(batches):
        anchors = automaton()
        for batch in batches:
            out = []
            for t in texts(batch, text):
                parts, at = [], 0
                for s, k, e in spans_of(t, anchors) if t else []:
                    if s >= at:
                        parts += [t[at:s], f"[{k}]"]
                    at = max(at, e)
                out.append(None if t is None else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "redacted"])

    docs = docs.drop(*({"redacted"} & set(docs.columns)))
    return docs.mapInArrow(scan, wider(docs, "redacted string"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind in ('" + "','".join(BASE) + "'))"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}") for k in BASE),
        F.expr(f"sha2({joined.format(base)}, 256) as base_sha256"),
        F.expr(f"{joined.format('spans')} as spans"),
    )
