"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of every kind in one pass over a whole text: at-signs, schemes, plus signs,
digits and identifier cues. From each anchor a small parser expands to both sides and validates what it found, so no
pattern is tried at every position. Positions are code points, ends exclusive; matches of one kind never overlap.

Base kinds: email, ip, card, phone (fixed patterns, see the parsers). Added kinds: url (scheme and what follows it up to
white space), account (an identifier after a cue such as "account no." or "IBAN", or one whose IBAN check digits hold) and
secret (the value after "password", "token" and the like). Added spans may overlap base spans; base ones stay.

Edge cases: a null text is empty and has no spans. Repeated rows, null ids and empty tables need nothing special. Text of
any length is read whole; every parser moves forward only, so time grows with the length. Input columns named `spans`
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.flat import slices, worker_cache

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "url", "account", "secret"]
SPAN = "array<struct<kind:string,start:int,end:int>>"

# Fixed values of the contract: characters and limits of each kind.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
LABEL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
DIGITS = frozenset("0123456789")
PHONE = frozenset(" ().-0123456789")
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)

ACCOUNT_CUES = ["account", "acct", "iban", "konto", "cuenta", "compte", "passport", "customer id"]
SECRET_CUES = ["password", "passwd", "token", "api_key", "apikey", "secret"]
_AFTER_ACCOUNT = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id|#))?\s*[:=#]?\s*([A-Za-z]{0,4}[0-9][A-Za-z0-9]{0,33}(?:(?: [A-Za-z0-9]{2,34}|-[A-Za-z0-9]{1,34})(?![A-Za-z0-9])){0,8})")
_AFTER_SECRET = re.compile(r"\s*[=:]\s*(\"[^\"\s]+\"|'[^'\s]+'|[^\s\"']+)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_URL_END = frozenset(" \t\n\x0b\f\r<>\"'`{}|\\^")
_TRAILING = ".,;:!?)]}"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, kind)
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at `at`."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part before the at-sign at `at` (not before `floor`), then a label and one or more dotted labels."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dotted = end
    while dotted < len(text) and text[dotted] == ".":
        more = _run(text, dotted + 1, LABEL)
        if more == dotted + 1:
            break
        dotted = more
    return (start, dotted) if dotted > end else None


def ip_at(text: str, start: int) -> tuple[int, bool] | None:
    """Four dotted runs of digits: the end, and whether no part is over 255."""
    at, fits = start, True
    for part in range(4):
        end = _run(text, at, DIGITS)
        if end == at:
            return None
        number = text[at:end].lstrip("0")
        fits = fits and (len(number) < 3 or (len(number) == 3 and int(number) <= 255))
        if part < 3:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        at = end
    return at, fits


def card_at(text: str, start: int) -> tuple[int, bool] | None:
    """Two or more digits with single blanks or hyphens between: the end, and whether it is a card number."""
    digits, at, n = [text[start]], start + 1, len(text)
    while at < n:
        if text[at] in DIGITS:
            step = 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            step = 2
        else:
            break
        digits.append(text[at + step - 1])
        at += step
    if len(digits) < 2:
        return None
    return at, CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)


def luhn(digits: list[str]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def phone_at(text: str, at: int) -> tuple[int, bool] | None:
    """A plus sign, a digit, one or more of PHONE, a digit: the end, and whether the number of digits is right."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return None
    return end, PHONE_DIGITS[0] <= sum(c in DIGITS for c in text[at:end]) <= PHONE_DIGITS[1]


def url_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """A scheme of letters before "://" and what follows up to white space, without trailing punctuation."""
    start = at
    while start > floor and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    if start == at:
        return None
    end, n = at + 3, len(text)
    while end < n and text[end] not in _URL_END:
        end += 1
    while end > at + 3 and text[end - 1] in _TRAILING:
        end -= 1
    return (start, end) if end > at + 3 else None


def iban_holds(value: str) -> bool:
    """Check digits of an IBAN: the rearranged number leaves 1 when divided by 97."""
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_at(text: str, start: int) -> tuple[int, int] | None:
    """The longest whole groups from `start` whose IBAN check digits hold."""
    found = _IBAN.match(text, start)
    for end in range(found.end(), start + 14, -1) if found else ():
        ends = not (text[end - 1] == " " or (end < len(text) and text[end].isalnum()))
        if ends and iban_holds(text[start:end]):
            return start, end
    return None


def account_at(text: str, after: int) -> tuple[int, int] | None:
    """The identifier that follows a cue: at least six characters, four of them digits; an IBAN if one fits there.

    Of several groups, those after the first count up to the last that holds a digit, and no further than to a word that
    holds none and is not all capitals.
    """
    found = _AFTER_ACCOUNT.match(text, after)
    if not found:
        return None
    if iban := iban_at(text, found.start(1)):
        return iban
    groups, kept = found[1].split(" "), 1
    for k, group in enumerate(groups[1:], 2):
        if any(c in DIGITS for c in group):
            kept = k
        elif not group.isupper():
            break
    value = " ".join(groups[:kept])
    if sum(c.isalnum() for c in value) < 6 or sum(c in DIGITS for c in value) < 4:
        return None
    return found.start(1), found.start(1) + len(value)


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed in KINDS, then by start."""
    out: dict[str, list[tuple[int, int]]] = {}
    ends = dict.fromkeys([*KINDS, "run"], 0)

    def add(kind: str, start: int, end: int, valid: bool = True) -> None:
        ends[kind] = end
        if valid:
            out.setdefault(kind, []).append((start, end))

    for last, anchor in anchors.iter(text):
        if anchor == "digit":
            # One parse per run of digits and kind: what starts inside a run fails or holds as the run's start does.
            if last >= ends["run"]:
                ends["run"] = _run(text, last, DIGITS)
                if last >= ends["ip"] and (ip := ip_at(text, last)):
                    add("ip", last, *ip)
                if last >= ends["card"] and (card := card_at(text, last)):
                    add("card", last, *card)
                if last >= max(2, ends["account"] + 2) and (last == 2 or not text[last - 3].isalnum()) and (iban := iban_at(text, last - 2)):
                    add("account", *iban)
        elif anchor == "at":
            if last >= ends["email"] and (email := email_at(text, last, ends["email"])):
                add("email", *email)
        elif anchor == "plus":
            if last >= ends["phone"] and (phone := phone_at(text, last)):
                add("phone", last, *phone)
        elif anchor == "scheme":
            if last - 2 >= ends["url"] and (url := url_at(text, last - 2, ends["url"])):
                add("url", *url)
        else:
            cue = last + 1
            if cue < ends[anchor] or (cue < len(text) and text[cue].isalnum()):
                continue
            if anchor == "account":
                span = account_at(text, cue)
            else:
                found = _AFTER_SECRET.match(text, cue)
                span = found.span(1) if found else None
            if span and span[0] >= ends[anchor]:
                add(anchor, *span)
    return [(kind, start, end) for kind in KINDS for start, end in out.get(kind, ())]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span becomes its kind in angle brackets; spans that overlap become one, named by the first."""
    parts, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _anchors() -> ahocorasick.Automaton:
    cache = worker_cache()
    if "anchors" not in cache:
        cache["anchors"] = automaton()
    return cache["anchors"]


def _spans_of(texts):
    anchors = _anchors()
    return texts.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, anchors)] if t else [])


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with `spans`: kind, start and end of everything found."""
    return docs.select(*[c for c in docs.columns if c != "spans"], F.pandas_udf(_spans_of, SPAN)(F.coalesce(docs[text], F.lit(""))).alias("spans"))


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = _anchors()
    for batch in slices(batches, "text"):
        texts = [t if not t else redact(t, find_spans(t, anchors)) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def personal_data_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: what was found is replaced by its kind. n_chars, if there, follows the new text."""
    redacted = docs.mapInArrow(_redact_batches, docs.schema)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(docs.columns)
