"""Personal data with disguises: offset-preserving deobfuscation, then detection.

A text passes a chain of transducers.  Each one rewrites the text that the one before wrote, and their maps
to the source are composed, so that disguises mix freely:

1. homoglyphs: look-alike letters and full-width forms become ASCII, one character for one;
2. invisible characters (zero-width, soft hyphen) are dropped;
3. bracketed at and dot: "(at)", "[dot]", "{@}" and their like become "@" and ".";
4. bare at and dot: in the shape of an address ("jo at mail dot example dot com", "jo @ example . com") "at",
   "dot" and signs with blanks around become "@" and "."; parts may be plain or come from step 3.  With a bare "at"
   and no disguised dot ("jo at example.com") the domain has to end in one of `TOP_LEVEL` and not begin with "www.", and the word before
   must be none of `NOT_NAMES`, since "look at example.com" is no address;
5. spelled digits: runs of at least three digits or numbers of up to four digits, of which one is a word
   ("four one 5"), become the digits without what separates them.

Identifiers (email, phone, credit card with its check digit, IPv4, US social security number, IBAN with
its check digits, access keys and named secrets) are found in the normalised text, and their spans are
mapped to the source: start and finish are character offsets of the source text, text[start:finish] is
what a redaction has to replace.

All of the text is processed, in time that grows with its length: patterns have a fixed longest match or can't start within
a run of their own characters, and addresses are read from their "@" outwards.  The map is a list of
segments, so its size follows the number of rewritings and not that of the characters.  Before a step is tried, a cheaper
search asks whether the text has what it can't do without.

Defined results: null and empty texts and an empty table have no rows; repeated rows have their rows repeated; texts of any
length are read whole; extra columns, whatever their names, are ignored; of overlapping finds the longer one,
then the one of the earlier kind in `KINDS`, then the first in the text is reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, map_arrow

KINDS = ("email", "credit_card", "iban", "phone", "ssn", "ipv4", "secret")

_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ɡ": "g", "ӏ": "l", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "т": "t", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ", "“": '"', "”": '"', "＂": '"',
}
_TABLE = {ord(k): v for k, v in _LOOKALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: chr(48 + (c - 0x0660)) for c in range(0x0660, 0x066A)} | {0x1D7CE + k: chr(48 + k % 10) for k in range(50)}
#: Which characters the table rewrites, to leave other texts alone.
_REWRITTEN = re.compile("[" + "".join(map(re.escape, map(chr, _TABLE))) + "]")

_DIGITS = {
    "0": "zero oh null cero zéro", "1": "one eins uno", "2": "two zwei dos deux", "3": "three drei tres trois", "4": "four vier cuatro quatre", "5": "five fünf cinco cinq",
    "6": "six sechs seis", "7": "seven sieben siete sept", "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}
_DIGIT_OF = {w: d for d, words in _DIGITS.items() for w in words.split()}
_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_HIDDEN_RE = re.compile(r"[​-‏⁠﻿­]+")
_BRACKETS = (r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}"), ("<", ">")
_SIGN_RE = re.compile(
    "|".join(
        rf"(?P<{word}>(?:(?<!\s)\s++)?(?:" + "|".join(rf"{a}\s*(?:{word}|{sign})\s*{b}" for a, b in _BRACKETS) + r")\s*)"
        for word, sign in (("at", "@"), ("dot", r"\."))
    ),
    re.I,
)
_SIGN_HINT = re.compile(r"[(\[{<]\s*(?:at|dot|@|\.)\s*[)\]}>]", re.I)
#: Where an address may have its "@", and what goes on behind it.
_AT_RE = re.compile(r"(?<!\s)(?P<bare>\s++at\s++)|(?:(?<!\s)\s++)?@\s*+", re.I)
_DOMAIN_RE = re.compile(r"[\w-]++(?:(?:\s++dot\s++|\s++\.\s++|\.)[\w-]++)++", re.I)
_DOT_RE = re.compile(r"(?<!\s)\s++(?:dot|\.)\s++", re.I)
_NUMBER_RE = re.compile(rf"(?<!\w)(?:(?P<word>{_WORD})|\d{{1,4}})(?!\w)", re.I)
_SPELLED_RE = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
_BETWEEN_RE = re.compile(r"[ \t.,-]+")

TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app ai co us uk de fr es it nl eu at ch be pl ru jp cn in br au ca se no fi dk cz pt".split())
NOT_NAMES = frozenset(
    "a an the is are was were be been being am it its us me him her you them this that these those here there look looks looked looking see seen visit visited find found available hosted host listed "
    "live lives living stay stays stayed work works worked working meet meets met read more out up in on at by of and or but not now today online only also page pages site website server service docs documentation "
    "blog post posted article published shop buy order sold sign join learn download downloads get go back arrive arrived start started begin stop point points aim aimed based directly us contact hier dort".split()
)

#: Letters that re.I takes for ASCII ones and lower() doesn't.
_FOLDS = str.maketrans("ſİıK", "siik")
_LOCAL_END = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+-."
_LABELS_RE = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_TOP_RE = re.compile(r"[A-Za-z]{2,24}(?![A-Za-z0-9])")

_PATTERNS = (
    ("ssn", re.compile(r"(?<![\w.-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?<!\d[ -])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w|[ .-]\d)|(?<!\w)\+\d{8,15}(?!\w)")),
    ("ipv4", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    (
        "secret",
        re.compile(
            r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+\b|\bsk-[A-Za-z0-9_-]{20,}+|\bxox[abprs]-[A-Za-z0-9-]{10,}+|-----BEGIN (?:[A-Z]++ )*+PRIVATE KEY-----"
            r"|(?i:\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password)\b\s*+[:=]\s*+[\"']?[^\s\"']{8,}+[\"']?)"
        ),
    ),
)
_CARD_RUN = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,}+(?!\w)")
_IBAN_SIZE = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
        "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_IBAN_RE = re.compile(rf"\b(?:{'|'.join(_IBAN_SIZE)})\d{{2}}(?: ?[A-Z0-9]){{11,30}}(?![a-z])")
_SPELLED_PHONE = re.compile(r"(?<!\w)\+?\d{7,15}(?!\w)")
_DIGIT = re.compile(r"\d")
_NAMES = ("token", "secret", "key", "passw", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "akia", "asia")


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDS).lower()


def _ends_word(text: str, at: int, least: int) -> int:
    """Where the run of word characters, + and - that ends at `at` begins; not before least."""
    while at > least and (text[at - 1].isalnum() or text[at - 1] in "_+-"):
        at -= 1
    return at


def _skip_blanks(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def _hidden(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "") for m in _HIDDEN_RE.finditer(text)] if not text.isascii() else []


def _signs(text: str) -> list[tuple[int, int, str]]:
    if not _SIGN_HINT.search(text):
        return []
    return [(m.start(), m.end(), "@" if m.lastgroup == "at" else ".") for m in _SIGN_RE.finditer(text)]


def _bare(text: str) -> list[tuple[int, int, str]]:
    low = _lower(text)
    if not ("at" in low and ("dot" in low or "." in low) or "@" in low):
        return []
    out, done, dotted = [], 0, _DOT_RE.search(text)
    for m in _AT_RE.finditer(text):
        if m.start() < done or m.end() - m.start() == 1 and not dotted:
            continue
        domain = _DOMAIN_RE.match(text, m.end())
        if not domain:
            continue
        at = m.start()
        begin = _ends_word(text, at, done)
        if begin == at:
            continue
        first = text[begin:at]
        dots = [(d.start(), d.end(), ".") for d in _DOT_RE.finditer(text, domain.start(), domain.end())]
        if m.group("bare") and not dots:
            name = _lower(domain.group())
            if name.startswith("www.") or name.rsplit(".", 1)[1] not in TOP_LEVEL or _lower(first) in NOT_NAMES:
                continue
        before = []
        while True:  # further parts of the name: "jo dot doe", "jo . doe", "jo.doe"
            p = _skip_blanks(text, begin, done)
            size = 3 if _lower(text[max(done, p - 3) : p]) == "dot" else 1 if text[p - 1 : p] == "." and p > done else 0
            dot = p - size
            left = _skip_blanks(text, dot, done)
            if not size or (p < begin) != (left < dot) or size == 3 and p == begin:
                break
            part = _ends_word(text, left, done)
            if part == left:
                break
            if p < begin:
                before.append((left, begin, "."))
            begin = part
        if m.end() - m.start() > 1:
            before.insert(0, (m.start(), m.end(), "@"))
        out += sorted(before + dots)
        done = domain.end()
    return out


def _numbers(text: str) -> list[tuple[int, int, str]]:
    if not _SPELLED_RE.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def close() -> None:
        if len(run) > 2 and any(m.group("word") for m in run):
            out.append((run[0].start(), run[-1].end(), "".join(_DIGIT_OF[_lower(m.group())] if m.group("word") else m.group() for m in run)))

    for m in _NUMBER_RE.finditer(text):
        if run and not _BETWEEN_RE.fullmatch(text, run[-1].end(), m.start()):
            close()
            run = []
        run.append(m)
    close()
    return out


def _compose(begins: list[int], segments: list[tuple[int, int, bool]], rewrites: list[tuple[int, int, str]], length: int) -> tuple[list[int], list[tuple[int, int, bool]]]:
    """The map of a text of this length with the rewritings applied to it."""
    new_begins, new_segments, shift, at, i = [], [], 0, 0, 0
    for lo, hi, new in [*rewrites, (length, length, "")]:
        while at < lo:  # what is kept between two rewritings, segment by segment
            while i + 1 < len(begins) and begins[i + 1] <= at:
                i += 1
            stop = min(lo, begins[i + 1]) if i + 1 < len(begins) else lo
            a, b, old = segments[i]
            new_begins.append(at + shift)
            new_segments.append((a, b, True) if old else (a + at - begins[i], a + stop - begins[i], False))
            at = stop
        if new:
            a, b, _ = source_span(begins, segments, lo, hi)
            new_begins.append(lo + shift)
            new_segments.append((a, b, True))
        shift += len(new) - (hi - lo)
        at = hi
    return new_begins, new_segments


def normalise(text: str) -> tuple[str, list[int], list[tuple[int, int, bool]]]:
    """The normalised text and its segments: where each begins in it, and for each its place in the
    source and whether it was rewritten."""
    begins, segments = ([0], [(0, len(text), False)]) if text else ([], [])
    if not text.isascii() and _REWRITTEN.search(text):
        text = text.translate(_TABLE)
    for step in (_hidden, _signs, _bare, _numbers):
        if rewrites := step(text):
            begins, segments = _compose(begins, segments, rewrites, len(text))
            parts, at = [], 0
            for lo, hi, new in rewrites:
                parts += [text[at:lo], new]
                at = hi
            text = "".join([*parts, text[at:]])
    return text, begins, segments


def source_span(begins: list[int], segments: list[tuple[int, int, bool]], start: int, finish: int) -> tuple[int, int, bool]:
    """The span of the source behind a span of the normalised text; whether any of it was rewritten.
    A rewritten segment counts as a whole."""
    i, j = bisect_right(begins, start) - 1, bisect_right(begins, finish - 1) - 1
    lo, hi = segments[i], segments[j]
    a = lo[0] if lo[2] else lo[0] + start - begins[i]
    b = hi[1] if hi[2] else hi[0] + finish - begins[j]
    return a, b, any(s[2] for s in segments[i : j + 1])


def _emails(text: str):
    """(start, finish) of addresses, read outwards from each "@"."""
    done = 0
    for m in re.finditer("@", text):
        at = m.start()
        head = text[done:at]
        local = head[len(head.rstrip(_LOCAL_END)) :]
        local = local[local.rfind("..") + 1 :].lstrip(".") if ".." in local else local.lstrip(".")
        labels = _LABELS_RE.match(text, at + 1)
        if local and not local.endswith(".") and labels:
            parts, end = labels.group().split("."), labels.end()
            while len(parts) > 1:
                last = parts.pop()
                end -= len(last)
                # the label of the end itself, which what follows it may cut short
                if top := _TOP_RE.match(text, end, end + len(last) + 1):
                    yield at - len(local), top.end()
                    done = top.end()
                    break
                end -= 1
        done = max(done, at + 1)


def _cards(text: str):
    """(start, finish) of credit card numbers: in a run of digits, from each of its groups on, the longest part up
    to the end of a group that has its check digit; a run without separators is a number or none."""
    for m in _CARD_RUN.finditer(text):
        run = m.group()
        groups = [g.span() for g in re.finditer(r"\d+", run)]
        count = [0, *accumulate(b - a for a, b in groups)]  # digits before each group
        digits = [int(c) for c in run if c not in " -"]
        twice = [d * 2 - 9 * (d > 4) for d in digits]
        # sums with the digits at even places, or at odd ones, as they are and the others doubled
        sums = [[0, *accumulate(d if k % 2 == parity else t for k, (d, t) in enumerate(zip(digits, twice)))] for parity in (0, 1)]
        i = j = 0
        while i < len(groups):
            p = count[i]
            j = max(i, j)
            while j < len(groups) and count[j + 1] - p <= 19:
                j += 1
            for k in range(j, i, -1):
                q = count[k]
                if q - p < 13:
                    k = i
                    break
                if (sums[(q - 1) % 2][q] - sums[(q - 1) % 2][p]) % 10 == 0 and len(set(digits[p:q])) > 1:
                    yield m.start() + groups[i][0], m.start() + groups[k - 1][1]
                    break
            else:
                k = i
            i = max(k, i + 1)


def _ibans(text: str):
    """(start, finish) of account numbers with the length of their country and its check digits."""
    at = 0
    while m := _IBAN_RE.search(text, at):
        at = m.start() + 4
        plain = m.group().replace(" ", "")
        size = _IBAN_SIZE[plain[:2]]
        if len(plain) >= size and int("".join(str(int(c, 36)) for c in plain[4:size] + plain[:4])) % 97 == 1:
            finish, left = m.start(), size
            while left:
                left -= text[finish] != " "
                finish += 1
            if not text[finish : finish + 1].isalnum():
                yield m.start(), finish
                at = finish


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, finish, normalised identifier), in the order of the text."""
    normal, begins, segments = normalise(text)
    found = []
    digit, low = _DIGIT.search(normal), normal.lower()
    if "@" in normal:
        found += [("email", a, b) for a, b in _emails(normal)]
    if digit:
        found += [("credit_card", a, b) for a, b in _cards(normal)]
        found += [("iban", a, b) for a, b in _ibans(normal)]
    for kind, pattern in _PATTERNS:
        # what each kind can't do without
        if any(n in low for n in _NAMES) if kind == "secret" else digit:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(normal)]
    if any(s[2] for s in segments):  # digits in a row are a phone number only if someone took the pains to hide them
        for m in _SPELLED_PHONE.finditer(normal):
            i, j = bisect_right(begins, m.start()) - 1, bisect_right(begins, m.end() - 1) - 1
            if any(s[2] and normal[max(b, m.start()) : m.end()][:1].isdigit() and s[1] - s[0] > 1 for s, b in zip(segments[i : j + 1], begins[i : j + 1])):
                found.append(("phone", m.start(), m.end()))
    kept: list[tuple[int, int, str]] = []  # in the order of the text
    for kind, a, b in sorted(found, key=lambda x: (x[1] - x[2], KINDS.index(x[0]), x[1])):
        at = bisect_right(kept, (a, b, kind))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
            kept.insert(at, (a, b, kind))
    return [(kind, *source_span(begins, segments, a, b)[:2], normal[a:b]) for a, b, kind in kept]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, finish, surface, normalised): one row for each identifier."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(it):
        for b in it:
            for s in batches([b]):
                rows, out = [], ([], [], [], [], [])
                for i, text in enumerate(s.column(1).to_pylist()):
                    for kind, lo, hi, value in find(text) if text else ():
                        rows.append(i)
                        for column, x in zip(out, (kind, lo, hi, text[lo:hi], value)):
                            column.append(x)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "kind", "start", "finish", "surface", "normalised"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, f"doc_id {id_type}, kind string, start int, finish int, surface string, normalised string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


ORACLE_SQL = None
