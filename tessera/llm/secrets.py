"""Secret scans: rules for known shapes, and sliding-window Shannon entropy for the rest.

A candidate string is a maximal run of characters that keys are written with. It is looked at once for each character
class, over the runs of that class: hex of any case, lower case with digits, upper case with digits, and base64 text
(its parts that are words or numbers, as in a path, do not count as key). A window slides over a run; the entropy of its
characters is kept from counts that change by one character out and one in. Windows at or above the class's own
threshold are merged into a span, unless the allow-list knows the span's text. Spans of the rules always stay; of an
entropy span, what a rule or an earlier class has not covered is given.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import lean, text_array

# The rules' patterns and least lengths, in the order in which kinds sort at one start.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_lower", "entropy_upper", "entropy_base64")

#: Candidate strings, by the characters of which keys are made.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Runs of each class inside a candidate, and the least entropy, in bits a character, of a window.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0),
    ("entropy_lower", re.compile(r"[0-9a-z]{20,}"), 3.5),
    ("entropy_upper", re.compile(r"[0-9A-Z]{20,}"), 3.5),
)
BASE64_BITS = 3.9

# Texts that look random and are not secrets.
ALLOWED = re.compile(
    r"^[0-9]+$"  # numbers
    r"|^[A-Za-z]+$"  # letters only: words run together
    r"|^[A-Za-z]+[0-9]+$|^[0-9]+[A-Za-z]+$"  # words with a number
    r"|(?i:example|sample|dummy|placeholder|changeme|lorem|0123456789|abcdefghij|x{6,})"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"  # UUID
    r"|^(?:[A-Za-z]+[-_/=+])+[A-Za-z]*[0-9]{0,4}$"  # words joined by signs: slugs and paths
    r"|^(?:[0-9]+[-_/=+])+[0-9]*$"  # dates, phone numbers
)
#: Parts of a candidate that are no part of a key: words and numbers between signs; at its ends, short ones too.
_SIGN = re.compile(r"[+/_=-]")
_WORDLIKE = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}|[0-9]{1,10}")
_SHORT = re.compile(r"|[A-Za-z]{1,3}|[A-Za-z]?[0-9]{1,3}")
_BITS = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def windows_above(text: str, least: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows whose entropy is at least `least` bits; counts move by one character."""
    spans: list[tuple[int, int]] = []
    if len(text) < WINDOW:
        return spans
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2 c
    most = WINDOW * (math.log2(WINDOW) - least) + 1e-9
    for i, x in enumerate(text):
        if i >= WINDOW:
            y = text[i - WINDOW]
            c = counts[y]
            total += _BITS[c - 1] - _BITS[c]
            counts[y] = c - 1
        c = counts.get(x, 0)
        total += _BITS[c + 1] - _BITS[c]
        counts[x] = c + 1
        if i >= WINDOW - 1 and total <= most:
            start = i - WINDOW + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def minus(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What covered, sorted and without overlaps, leaves of [start, end)."""
    out = []
    k = bisect_right(covered, (start, start))
    k -= k > 0 and covered[k - 1][1] > start
    while k < len(covered) and covered[k][0] < end:
        if covered[k][0] > start:
            out.append((start, covered[k][0]))
        start = max(start, covered[k][1])
        k += 1
    return [*out, (start, end)] if start < end else out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def key_parts(candidate: str) -> list[tuple[int, int]]:
    """[start, end) of the parts of a candidate between words and numbers."""
    parts: list[list[tuple[int, int]]] = [[]]
    at = 0
    for m in [*_SIGN.finditer(candidate), None]:
        end = m.start() if m else len(candidate)
        if _WORDLIKE.fullmatch(candidate, at, end):
            parts.append([])
        else:
            parts[-1].append((at, end))
        at = end + 1
    out = []
    for part in parts:
        low, high = 0, len(part)
        while low < high and _SHORT.fullmatch(candidate, *part[low]):
            low += 1
        while low < high and _SHORT.fullmatch(candidate, *part[high - 1]):
            high -= 1
        if low < high:
            out.append((part[low][0], part[high - 1][1]))
    return out


def entropy_spans(text: str, covered: list[tuple[int, int]] = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of random-looking parts of the candidate strings, without what is covered already."""
    out = []
    for m in CANDIDATE.finditer(text):
        candidate, at = m.group(), m.start()
        if ALLOWED.fullmatch(candidate):
            continue
        looked = [(kind, [(r.start(), r.end()) for r in runs.finditer(candidate) if not r.group().isdigit()], bits) for kind, runs, bits in CLASSES]
        if any("A" <= x <= "Z" for x in candidate) and any("a" <= x <= "z" for x in candidate):
            looked.append(("entropy_base64", key_parts(candidate), BASE64_BITS))
        taken: list[tuple[int, int]] = []  # by the classes before
        for kind, runs, bits in looked:
            new = []
            for low, high in runs:
                run = candidate[low:high]
                if not any(x.isdigit() for x in run):
                    continue
                for a, b in windows_above(run, bits):
                    if not ALLOWED.search(run[a:b]):
                        new += minus(a + low, b + low, taken)
            for a, b in new:
                out += [(x, y, kind) for x, y in minus(a + at, b + at, covered)]
            taken = merged(taken + new)
    return out


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' matches, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(rule spans, all spans), each by start, then by kind as listed in KINDS; positions are code points."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(rule_spans(text), key=order)
    return base, sorted(base + entropy_spans(text, merged([(a, b) for a, b, _ in base])), key=order)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: one row per input row, in one pass and without a shuffle.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, secrets (array of kind, start, end, text).
    A null text counts as empty: no spans, and the digest of the empty string. Very long texts are scanned whole, in time
    that grows with their length; repeated rows are scanned alike, and of equal starts the kinds stand in KINDS' order; a
    table without rows gives none; other columns, whatever their names, are not read. `secrets` holds the found texts
    themselves: drop it, as the registered query does, where they must not travel on.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy", "secrets")}
            for value in text_array(batch):
                text = value.as_py()
                base, every = scan(text)
                for k in ("assign", "access", "hex"):
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(every))
                out["n_entropy"].append(len(every) - len(base))
                out["secrets"].append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for a, b, k in every])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(
        lean(run),
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, "
        "secrets array<struct<kind: string, start: long, end: long, text: string>>",
    )
