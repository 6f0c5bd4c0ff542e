r"""Personal data: base patterns, and a character BiLSTM-CRF that adds spans.

The base spans (email, ip, card, phone) are the contract's patterns, leftmost and
non-overlapping within each kind; email is sought from each ``@`` outwards, so a long run
without one costs its length.  The tagger is trained on the driver from labelled spans:
windows of all regions of a documented, bounded sample of the corpus (``TRAIN_DOCS`` texts,
of which ids are chosen first and ``TRAIN_WINDOWS`` windows are cut in the executors), labelled
by the base patterns, and as many made-up ones in layouts that these patterns miss: letters
beyond ASCII, ``(at)`` signs, dots and slashes between groups.  Every span of any kind holds a
digit or an at sign, so the tagger reads the regions around those characters, of every whole
text: the whole blank-delimited run that holds one, and ``WINDOW`` characters on either side.  A
region is cut into overlapping windows, each is run through both LSTMs, emissions of
overlapping windows are averaged, and one Viterbi pass over the whole region reconciles
them.  Tagged spans that touch no base span, and hold what their kind needs (a card a right
check digit, for one), are added; base spans always stay.

Defined results: null and empty texts have no spans; rows that repeat are searched
each, and ties have no influence, since a text's spans depend on it alone; very long texts
are read whole; no rows give no rows; extra columns are unused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.char_tagger import PAD, Tagger, codes
from quarrymill.llm.common import BLANK_CLASS, BLANKS, documents
from quarrymill.llm.tokenisation import text_chunks

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # a run of digits is tried once, from its first: what fails there fails from every later one
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TRAIN_DOCS = 200
TRAIN_WINDOWS = 384
WINDOW, STRIDE = 64, 48
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
_BLANK = re.compile(BLANK_CLASS)
_LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")
_TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == "card":
        digits = re.sub(r"[\x20-]", "", found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= sum(c in "0123456789" for c in found) <= 15
    return True


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def emails(text: str) -> list[tuple[int, int]]:
    """What the email pattern finds, leftmost and without overlap, in one pass: a match holds one
    ``@``, its local part reaches back to the last match or the last character that it cannot hold."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at):
            start = at
            while start > floor and (text[start - 1] in _LOCAL_SET):
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                floor = domain.end()
        floor = max(floor, at + 1)
        at = text.find("@", at + 1)
    return out


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for k, kind in enumerate(KINDS[1:], 1):
        if kind == "phone" and "+" not in text or kind == "card" and not _LONG_NUMBER.search(text):
            continue
        out += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if _valid(kind, m[0])]
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Places that can hold a span: runs with a digit or ``@`` and their context, merged where they meet."""
    out: list[list[int]] = []
    end = 0
    while m := _TRIGGER.search(text, end):
        start = max(text.rfind(c, end, m.start()) for c in BLANKS) + 1 or end
        blank = _BLANK.search(text, m.end())
        end = blank.start() if blank else len(text)
        lo, hi = max(0, start - WINDOW), min(len(text), end + WINDOW)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def windows_of(size: int) -> list[int]:
    """Starts of the overlapping windows of a region."""
    return list(range(0, max(1, size - WINDOW + STRIDE), STRIDE)) if size > WINDOW else [0]


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(size, np.int64)
    for start, kind, end in spans:
        lo, hi = max(0, start), min(size, end)
        if lo < hi:
            y[lo:hi] = 2 + 2 * kind
            if start >= 0:
                y[lo] = 1 + 2 * kind
    return y


def _made_up(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with spans in varied layouts, and decoys without."""
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    name = lambda: "".join(str(rng.choice(list("äöüéñ"))) if rng.random() < 0.05 else c for c in word() + str(rng.choice(["", "-"])) + (word() if rng.random() < 0.5 else ""))

    def span(kind: int) -> str:
        if kind == 0:
            at = str(rng.choice(["@", "@", "@", "@", "(at)", "[at]"]))
            return f"{name()}{rng.choice(['', '.', '_', '+'])}{name()}{at}{name()}{word()}.{rng.choice(['com', 'org', 'net', 'example', 'io', 'de', 'fr', 'co.uk'])}"
        if kind == 1:
            return ".".join(str(x) for x in rng.integers(0, 256, 4))
        if kind == 2:
            d = digits(15)
            d += next(c for c in "0123456789" if luhn(d + c))
            return rng.choice(["", " ", "-", "."]).join(d[i : i + 4] for i in range(0, 16, 4))
        gap = rng.choice([" ", "-", ".", "/", " (0) "])
        return f"+{rng.integers(1, 99)}{gap}{digits(3)}{gap[0]}{digits(3)}{gap[0]}{digits(4)}"

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(int(rng.integers(1, 5)))) + " ", []
        kind = int(rng.integers(0, 6))
        if kind < 4:
            own = span(kind)
            spans.append((len(text), kind, len(text) + len(own)))
            text += own
        else:
            text += str(rng.choice([digits(4), digits(6), digits(8), f"{digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"@{word()}", f"{digits(4)}-{digits(2)}-{digits(2)}", "".join(rng.choice(list("0123456789abcdef"), 32))]))
        text += rng.choice([" ", ".", ", ", "\n"]) + " ".join(word() for _ in range(int(rng.integers(1, 4))))
        out.append((text, spans))
    return out


def cut_windows(text: str, spans: list[tuple[int, int, int]], places: list[tuple[int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of the places, each with its part of the spans."""
    at = [(a + s, min(b, a + s + WINDOW)) for a, b in places for s in windows_of(b - a)]
    return [(text[a:b], [(s - a, k, e - a) for s, k, e in spans if s < b and e > a]) for a, b in at]


def training_windows(own: list[tuple[str, list]], most: int = TRAIN_WINDOWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of made-up windows and of the corpus' own."""
    pairs = [w for text, spans in _made_up(np.random.default_rng(seed), most // 2) for w in cut_windows(text, spans, [(0, len(text))])] + own
    x, y = np.full((len(pairs), WINDOW), PAD), np.zeros((len(pairs), WINDOW), np.int64)
    for i, (text, spans) in enumerate(pairs):
        x[i, : len(text)], y[i, : len(text)] = codes(text), tags_of(len(text), spans)
    return x, y


def sample_windows(docs: DataFrame, most: int = TRAIN_WINDOWS - TRAIN_WINDOWS // 2) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled windows out of all regions of ``TRAIN_DOCS`` texts: ids are drawn by hash, then
    their texts are joined to them, cut where they lie, and windows drawn by hash."""
    marked = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(_TRIGGER.pattern))
    ids = marked.select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(TRAIN_DOCS).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            for text in batch.column("text").to_pylist():
                found = cut_windows(text, base_spans(text), regions(text))
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([[x for s in spans for x in s] for _, spans in part], pa.list_(pa.int64()))], ["part", "spans"])

    windows = marked.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "part string, spans array<long>")  # at most TRAIN_DOCS ids
    drawn = windows.orderBy(F.md5("part"), "part").limit(most).collect()
    return [(r["part"], [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in drawn]


def train_tagger(docs: DataFrame, epochs: int = 24) -> Tagger:
    tagger = Tagger(_TAGS)
    tagger.fit(*training_windows(sample_windows(docs)), epochs=epochs)
    return tagger


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of each text by the tagger, over all its regions."""
    where, parts = [], []
    for i, text in enumerate(texts):
        for a, b in regions(text):
            starts = windows_of(b - a)
            where.append((i, a, b, starts))
            parts += [text[a + s : min(b, a + s + WINDOW)] for s in starts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    distinct = {p: n for n, p in enumerate(dict.fromkeys(parts))}
    x = np.full((len(distinct), WINDOW), PAD)
    for p, n in distinct.items():
        x[n, : len(p)] = codes(p)
    em = np.concatenate([tagger.emissions(x[k : k + 1024])[0] for k in range(0, len(x), 1024)], axis=1)
    at, seen = 0, {}
    for i, a, b, starts in where:
        own = tuple(distinct[p] for p in parts[at : at + len(starts)])
        at += len(starts)
        key = (own, b - a)
        if key not in seen:
            total, cover = np.zeros((b - a, _TAGS)), np.zeros((b - a, 1))
            for n, s in zip(own, starts, strict=True):
                size = min(WINDOW, b - a - s)
                total[s : s + size] += em[:size, n]
                cover[s : s + size] += 1
            seen[key] = spans_of(tagger.decode(total / cover))
        out[i] += [(a + s, k, a + e) for s, k, e in seen[key]]
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one kind; a begin tag opens a new one."""
    out: list[tuple[int, int, int]] = []
    open_at, kind = None, -1
    for t, tag in enumerate([*tags.tolist(), 0]):
        k = (tag - 1) // 2 if tag else -1
        if open_at is not None and (k != kind or tag % 2 == 1):
            out.append((open_at, kind, t))
            open_at = None
        if tag and open_at is None:
            open_at, kind = t, k
    return out


def plausible(text: str, kind: int, start: int, end: int) -> bool:
    """An added span must hold what its kind cannot do without: an email a sign and a domain, an
    address four parts of at most 255, a card a check digit that is right, a phone a prefix."""
    part = text[start:end]
    digits = "".join(c for c in part if c in "0123456789")
    if kind == 0:
        return re.search(r"[^\s](@|\(at\)|\[at\])[^\s]+\.[^\s]", part) is not None
    if kind == 1:
        parts = re.split(r"[^0-9]+", part)
        return len(parts) == 4 and all(parts) and all(int(p) <= 255 for p in parts if len(p) <= 3) and max(map(len, parts)) <= 3
    if kind == 2:
        # a card of its own, not a piece of a longer number
        whole = not (start and text[start - 1].isdigit()) and not (end < len(text) and text[end].isdigit())
        return whole and 12 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 9 <= len(digits) <= 15 and part.lstrip("(").startswith(("+", "00"))


def whole(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """A tagged span without signs at its end; an email to the ends of its words."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    if kind == 0:
        while start and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        while end < len(text) and (text[end].isalnum() or text[end] in ".-" and text[end + 1 : end + 2].isalnum()):
            end += 1
    return start, end


def merged(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    added: list[tuple[int, int, int]] = []
    for start, kind, end in tagged:
        start, end = whole(text, kind, start, end)
        taken = base + added
        if start < end and plausible(text, kind, start, end) and all(end <= s or start >= e for s, _, e in taken):
            added.append((start, kind, end))
    return sorted(base + added)


def find_pii(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand weights

    def line(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in text_chunks(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            tagged = tagged_spans(tagger, texts)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(line(b).encode()).hexdigest() for b in base]
            every = [line(merged(t, b, g) if g else b) for t, b, g in zip(texts, base, tagged, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digest), pa.array(every)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_pii(docs, train_tagger(docs))
