"""PII by anchor expansion.

Aho-Corasick finds anchors in a text: at-signs, plus signs, digits, schemes and identifier cues. A local parser expands each to its
boundaries and validates it; of a run of digits only the first is expanded, and none that a match of the kind holds already. Base kinds (leftmost, non-overlapping per kind,
failing matches dropped without retries): email, ip (parts to 255), card (14 to 19 digits, Luhn), phone (+ and 10 to
15 digits). Added: iban (two letters before two digits, or a cue and any case; mod 97), account (a cue, then 6 to 17
digits), login (user information in a URL), mailto (what a mailto link is addressed to), passport (a cue, then 6 to 9 capitals and digits, 4 digits at least).

Defined cases: a null or empty text has no spans; a very long text is scanned whole, in time in proportion to its length; equal starts
are ordered by kind as listed, then end; offsets are in code points; rows that repeat give the same result each; an empty table gives an
empty result; other columns are not read, so their names cannot clash; doc_id may be of any type.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import read

KINDS = ("email", "ip", "card", "phone", "iban", "account", "login", "mailto", "passport")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn", "routing")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"(?i:\s*(?:no|nr|number|num)?)[.:#=\s]{1,4}([0-9][0-9 -]{4,20}[0-9])")
ANY_IBAN = re.compile(r"(?i:\s*(?:no|nr|number|num)?)[.:#=\s]{0,4}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
PASSPORT = re.compile(r"(?i:\s*(?:no|nr|number|num)?)[.:#=\s]{1,4}([A-Z0-9]{6,9})(?![A-Za-z0-9])")
MAILTO = re.compile(r"[^\s<>\"'?&@]+@[^\s<>\"'?&@,;]+(?:[,;][^\s<>\"'?&@]+@[^\s<>\"'?&@,;]+)*")
LOGIN = re.compile(r"[^\s/@?#]+@")
DIGITS = frozenset("0123456789")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _automaton(words):
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


_machine = None


def anchors(text: str):
    """(end, anchor) for each place of an anchor, in order; cues in lower case or with a capital, or in capitals."""
    global _machine
    if _machine is None:
        _machine = _automaton(["@", "+", *"0123456789", *SCHEMES, *{f(c) for c in CUES for f in (str, str.capitalize, str.upper)}])
    return _machine.iter(text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban_valid(said: str) -> bool:
    s = said.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban(text: str, start: int, stop: int) -> int:
    """The end of the longest part of a run that is valid, or 0."""
    for end in range(stop, start + 14, -1):
        if text[end - 1] != " " and iban_valid(text[start:end].upper()):
            return end
    return 0


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kind is a number in KINDS."""
    text = text or ""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = iban_end = account_end = login_end = mailto_end = passport_end = 0
    for last, anchor in anchors(text):
        if anchor in DIGITS:
            before = text[last - 1] if last else ""
            if last >= card_end and (m := CARD.match(text, last)):
                card_end = m.end()
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((last, 2, card_end))
            if before in DIGITS and before:
                continue
            if last >= ip_end and (m := IP.match(text, last)):
                ip_end = m.end()
                if all(map(_small, m[0].split("."))):
                    out.append((last, 1, ip_end))
            if last - 2 >= iban_end and "A" <= before <= "Z" and (m := IBAN.match(text, last - 2)) and (end := _iban(text, last - 2, m.end())):
                iban_end = end
                out.append((last - 2, 4, end))
        elif anchor == "@":
            if last < email_end:
                continue
            start = last
            while start > email_end and text[start - 1] in LOCAL_SET:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif anchor == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((last, 3, phone_end))
        elif anchor == "mailto:":
            if last >= mailto_end and (m := MAILTO.match(text, last + 1)):
                mailto_end = m.end()
                out.append((last + 1, 7, mailto_end))
        elif anchor in SCHEMES:
            if last >= login_end and (m := LOGIN.match(text, last + 1)):
                login_end = m.end()
                out.append((last + 1, 6, login_end - 1))
        elif anchor.lower() == "iban":
            # one in capitals is found at its digits
            if last >= iban_end and (m := ANY_IBAN.match(text, last + 1)) and not m[1][:2].isupper() and (end := _iban(text, m.start(1), m.end())):
                iban_end = end
                out.append((m.start(1), 4, end))
        elif anchor.lower() == "passport":
            if last >= passport_end and (m := PASSPORT.match(text, last + 1)) and len(_digits(m[1])) >= 4:
                passport_end = m.end()
                out.append((m.start(1), 8, passport_end))
        elif last >= account_end:
            if m := ACCOUNT.match(text, last + 1):
                account_end = m.end()
                if 6 <= len(_digits(m[1])) <= 17:
                    out.append((m.start(1), 5, account_end))
    return sorted(out)


def said(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str | None, mask: str = "[{}]") -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in spans(text):
        if a >= at:
            out += [text[at:a], mask.format(KINDS[k].upper())]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def _scan(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            found = spans(text)
            base = [s for s in found if s[1] < 4]
            rows.append((doc_id, *[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(said(base).encode()).hexdigest(), said(found)))
        yield pd.DataFrame(rows, columns=names)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of their spans, all spans."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, which pandas keeps as it is
    return rows.mapInPandas(_scan, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    def found(kind: int, pattern: str, keep: str) -> str:
        return f"""SELECT doc_id, '{KINDS[kind]}' AS kind, {kind} AS k, stop - length(m) AS start, stop FROM (SELECT doc_id, m, (sum(gap + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop FROM
        (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(list_transform(string_split_regex(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))], lambda x: length(x))) AS gap,
         generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM d)) WHERE {keep}"""

    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT WHEN substr(reverse({digits}), i, 1)::INT > 4 THEN substr(reverse({digits}), i, 1)::INT * 2 - 9 ELSE substr(reverse({digits}), i, 1)::INT * 2 END))"
    parts = [
        found(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        found(1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
        found(2, r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn_sum} % 10 = 0"),
        found(3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS ({" UNION ALL ".join(parts)})
SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone,
  sha256(coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k) FILTER (WHERE k IS NOT NULL), '')) AS base_sha256 FROM d LEFT JOIN b USING (doc_id) GROUP BY doc_id
"""


#: The base kinds alone: the added ones, with mod 97 and cues, are tested against brute force.
BASE_SQL = _sql()
