r"""Secrets: base patterns, and strings that a Markov model of random characters explains best.

The base spans (assign, access, hex) are the contract's patterns, leftmost and non-overlapping
within each kind.  Two character Markov models of order two, each mixed with its first and zeroth
order (weights by how often a context was seen), are trained on the driver from labelled samples:

* *random*: the values of base spans in ``TRAIN_DOCS`` texts, and strings drawn in the alphabets
  that keys are written in;
* *ordinary*: words of the same texts outside base spans, identifiers, paths, numbers, dates and
  versions made of them, and letters in one case that spell nothing known.

A run of ``[A-Za-z0-9+/_=-]`` of ``LEAST`` characters or more, that no letter beyond ASCII touches,
is added as kind ``random`` where it overlaps no base span and its log-likelihood ratio is above
the cutoff: one that no held-out ordinary sample reaches, with a margin.  A run is scored whole and
in its pieces between ``/``, ``=``, ``_`` and ``-``, since a path or a name is ordinary piece by piece,
and the lower of both counts; a run of digits and signs alone is a number, one of few distinct
characters a rule or filler, and neither a secret.

Defined results: null and empty texts have no spans; rows that repeat are searched each, and ties
have no influence, since a text's spans depend on it alone; very long texts and runs are read
whole; no rows give no rows, and the models are then trained on what is made up; extra columns
are unused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents
from quarrymill.llm.tokenisation import text_chunks

KINDS = ("assign", "access", "hex", "random")
# letters in either case are ASCII letters here
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
LEAST = 16
#: Distinct characters without which a run only repeats itself.
VARIETY = 6
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Labelled texts, and samples of each class, that the models see at most.
TRAIN_DOCS, TRAIN_STRINGS = 400, 20_000
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(_ALPHABET), np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_CODES = len(_ALPHABET) + 1  # with the edge of a string
_CUT = re.compile(r"[/=_-]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    # a run is the longest there is, so that asking for the length at once drops the same matches
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


class CharacterModel:
    """Order two, mixed with lower orders: a context's weight is n / (n + its distinct followers)."""

    def __init__(self, strings: list[str]):
        first, second = np.zeros((_CODES, _CODES)), np.zeros((_CODES, _CODES, _CODES))
        edge = np.full(2, _CODES - 1)
        for text in strings:
            c = np.concatenate([edge, codes(text)])
            np.add.at(first, (c[1:-1], c[2:]), 1)
            np.add.at(second, (c[:-2], c[1:-1], c[2:]), 1)
        zeroth = first.sum(axis=0) + 1.0
        zeroth /= zeroth.sum()
        p = self._mixed(first, np.broadcast_to(zeroth, first.shape))
        self.log = np.log(self._mixed(second, np.broadcast_to(p, second.shape)))

    @staticmethod
    def _mixed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total, kinds = counts.sum(axis=-1, keepdims=True), (counts > 0).sum(axis=-1, keepdims=True)
        return (counts + np.maximum(kinds, 1) * lower) / (total + np.maximum(kinds, 1))


def _likelihood(models: np.ndarray, c: np.ndarray) -> float:
    each = models[c[:-2], c[1:-1], c[2:]].sum(axis=0)
    top = each.max()
    return float(top + np.log(np.exp(each - top).mean()))


class SecretModel:
    """The log-likelihood ratio of random against ordinary, and its cutoff.  Either has a model for
    each way to write it, equally likely: a string is written in one of them throughout."""

    def __init__(self, random: list[list[str]], ordinary: list[list[str]], held_out: list[str]):
        self.ordinary, self.random = (np.stack([CharacterModel(strings).log for strings in each if strings], axis=-1) for each in (ordinary, random))
        self.cutoff = max([0.0, *(self.score(s) for s in held_out)]) + MARGIN

    def _sum(self, text: str) -> float:
        c = np.concatenate([np.full(2, _CODES - 1), codes(text)])
        return _likelihood(self.random, c) - _likelihood(self.ordinary, c)

    def score(self, run: str) -> float:
        """Of the whole run, or of the sum of its pieces where that is less."""
        pieces = [p for p in _CUT.split(run) if p]
        if len(set(run)) < VARIETY or not any(c.isalpha() for c in run):
            return -np.inf
        return min(self._sum(run), sum(map(self._sum, pieces))) if len(pieces) > 1 else self._sum(run)


#: Nats above the highest held-out ordinary string: e**-5 of its chance.
MARGIN = 5.0
_SETS = ("0123456789abcdef", "0123456789ABCDEF", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567", "abcdefghijklmnopqrstuvwxyz0123456789")


def drawn_strings(rng: np.random.Generator, n: int) -> list[list[str]]:
    """Strings of independent characters, for each alphabet of keys."""
    return [["".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(LEAST, 65)))) for _ in range(n // len(_SETS))] for letters in _SETS]


def ordinary_strings(rng: np.random.Generator, words: list[str], n: int) -> list[str]:
    """Identifiers, paths, numbers, dates and versions, made of words."""
    pick = lambda: words[int(rng.integers(len(words)))]
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    out = []
    for k in range(n):
        own = [pick() + (number(int(rng.integers(1, 4))) if rng.random() < 0.2 else "") for _ in range(int(rng.integers(2, 6)))]
        match k % 8:
            case 0:
                out.append("_".join(own))
            case 1:
                out.append("-".join(own))
            case 2:
                out.append("".join(w.capitalize() for w in own))
            case 3:
                out.append(own[0].lower() + "".join(w.capitalize() for w in own[1:]) + number(int(rng.integers(0, 4))))
            case 4:
                out.append("/".join(own))
            case 5:
                out.append("_".join(own).upper())
            case 6:
                out.append("-".join([own[0], number(4), number(2), number(2)]) if rng.random() < 0.5 else "-".join(number(4) for _ in range(4)))
            case _:
                out.append("".join(own))
    return out


def unknown_words(rng: np.random.Generator, n: int) -> list[list[str]]:
    """Letters in one case that spell nothing known, as words of a language not seen here would:
    all small, capitalised, all capital."""
    own = ["".join(_ALPHABET[i] for i in rng.integers(0, 26, int(rng.integers(2, 24)))) for _ in range(n)]
    return [own, [w.capitalize() for w in own], [w.upper() for w in own]]


#: Words for ordinary strings where a corpus has none.
_PLAIN = "account address archive button category channel client config content counter country customer default delete document element error event field filter folder format handler header height history image index insert label language length level library list manager member message method module monitor name number object option order output package page parameter parent password path pattern payment platform policy position process product profile project property query queue record region report request response result return router sample schema screen script search section select server service session setting signal source state status storage stream string style subject support switch system table target template thread title update upload value version video view width window worker".split()


def sample_texts(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """Values of base spans, and words outside them, of texts drawn by the hash of their id: ids are
    drawn first, and of each text at most ``TRAIN_STRINGS / most`` distinct words come to the driver."""
    each = max(1, TRAIN_STRINGS // most)
    own = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    by = F.md5(F.col("doc_id").cast("string"))
    plain = own.select("doc_id").orderBy(by, "doc_id").limit(most)
    marked = own.where(F.col("text").rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}")).select("doc_id").orderBy(by, "doc_id").limit(most)
    ids = plain.unionByName(marked).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            random, ordinary = [], []
            for text in batch.column("text").to_pylist():
                spans, free, at = base_spans(text), [], 0
                random.append(sorted({value_of(text, s) for s in spans if any(c.isalpha() for c in value_of(text, s))})[:each])
                for start, _, end in spans:
                    free.append(text[at:start])
                    at = max(at, end)
                free.append(text[at:])
                words = sorted({w for part in free for w in re.findall(r"(?<![^\W])[A-Za-z]{2,}(?!\w)", part)})
                ordinary.append(sorted(words, key=lambda w: hashlib.md5(w.encode()).digest())[:each])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(random, kind), pa.array(ordinary, kind)], ["random", "ordinary"])

    rows = own.join(ids.hint("broadcast"), "doc_id").select("text").mapInArrow(run, "random array<string>, ordinary array<string>")  # at most 2 x most ids
    random = rows.select(F.explode("random").alias("s")).distinct().orderBy(F.md5("s"), "s").limit(TRAIN_STRINGS).collect()
    ordinary = rows.select(F.explode("ordinary").alias("s")).distinct().orderBy(F.md5("s"), "s").limit(TRAIN_STRINGS).collect()
    return [r["s"] for r in random], [r["s"] for r in ordinary]


def value_of(text: str, span: tuple[int, int, int]) -> str:
    """The part of a base span that is the secret, in the model's alphabet."""
    start, kind, end = span
    found = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
    return "".join(c for c in found if c in _KNOWN)


_KNOWN = frozenset(_ALPHABET)


def train_models(docs: DataFrame, seed: int = 11) -> SecretModel:
    random, words = sample_texts(docs)
    rng = np.random.default_rng(seed)
    words = words if len(words) >= 50 else words + _PLAIN
    random = [random, *drawn_strings(rng, TRAIN_STRINGS // 4)]
    ordinary = [words + ordinary_strings(rng, words, TRAIN_STRINGS // 4) + ordinary_strings(rng, _PLAIN, TRAIN_STRINGS // 8), *unknown_words(rng, TRAIN_STRINGS // 8)]
    held_out = ordinary_strings(rng, words, TRAIN_STRINGS // 8) + ordinary_strings(rng, _PLAIN, TRAIN_STRINGS // 8) + sum(unknown_words(rng, TRAIN_STRINGS // 16), [])
    return SecretModel(random, ordinary, [s for s in held_out if len(s) >= LEAST])


def added_spans(model: SecretModel, text: str, base: list[tuple[int, int, int]], known: dict[str, bool]) -> list[tuple[int, int, int]]:
    out = []
    for m in RUN.finditer(text):
        start, end = m.span()
        # a letter beyond ASCII makes the run a part of a word
        if start and text[start - 1].isalpha() or end < len(text) and text[end].isalpha():
            continue
        run = m[0]
        if run not in known:
            known[run] = model.score(run) > model.cutoff
        if known[run] and all(end <= s or start >= e for s, _, e in base):
            out.append((start, 3, end))
    return out


#: Distinct runs whose verdict a task remembers; when full it starts afresh.
_REMEMBERED = 100_000


def find_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each three characters

    def line(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in text_chunks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                added = added_spans(model, text, base, known)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                own = line(base)
                rows.append((*counts, hashlib.sha256(own.encode()).hexdigest(), line(sorted(base + added)) if added else own))
                if len(known) > _REMEMBERED:
                    known.clear()
            n_assign, n_access, n_hex, digest, spans = zip(*rows, strict=True)
            counts = [pa.array(c, pa.int64()) for c in (n_assign, n_access, n_hex)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digest), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_secrets(docs, train_models(docs))
