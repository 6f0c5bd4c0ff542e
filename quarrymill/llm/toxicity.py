"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the word classes of a clause: insult, threat, target,
negation and reported speech.  They are composed once into one machine, whose path
through a clause emits one label, such as "insult at a target" or "negated insult".
A document's score is a logistic function of its clauses' labels and of the learned
strength of the insults in them; single words outside a matched clause count nothing.

Learned from labels (never from rows whose crc32(doc_id) mod 5 is 0, and never from
``lang``, ``source`` or ``doc_id``): the insult lexicon (words and word beginnings)
and the weights of the clause labels.  Learning uses a documented, bounded sample: at most
``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows, in hash order.  Scoring reads every
whole text in one pass without a shuffle.

Clauses are read whole, from end to end, however far apart their words stand.

Defined results: null and empty texts have no clause and get the base score; rows
that repeat are scored each, and ties have no influence; a null ``doc_id`` is not held out;
very long texts, and ones without any clause end, are read whole; without labels of both
kinds every score is the base score of 0.5 / (rows + 1) or so; empty tables give no rows, or
learn nothing; extra columns are unused.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, labels, materialise
from quarrymill.llm.tokenisation import text_chunks

TOXIC_ROWS = 2000
CLEAN_ROWS = 6000
BEGINNINGS = (4, 5, 6, 7)
MIN_LOG_ODDS = 3.0

#: Word classes of the grammar that are not learned.
THREAT = frozenset("kill hurt destroy beat burn shoot stab attack hang smash punch crush".split())
TARGET = frozenset("you your yours u ur he him his she her they them their this that these those people".split())
NEGATION = frozenset("not no never none nobody isn't aren't wasn't don't doesn't didn't nicht kein keine pas jamais nunca".split())
REPORTED = frozenset("said says say called calls quoted quote wrote claimed alleged reported allegedly".split())
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_CLAUSE_END = re.compile("[.!?;:\n|\u2026\u3002\uff01\uff1f\uff1b\uff1a\u061f\u061b]+")  # also the ellipsis, CJK and Arabic ends


class Transducer:
    """Deterministic weighted transducer over word classes.  ``arcs[state][class]`` is
    ``(next, weight)``; a missing class keeps the state at weight 0.  ``finals[state]``
    is the state's output."""

    def __init__(self, arcs: dict, finals: dict, start=0):
        self.arcs, self.finals, self.start = arcs, finals, start

    def step(self, state, symbol: str):
        return self.arcs.get(state, {}).get(symbol, (state, 0.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same clause; weights add up and outputs are joined."""
        arcs: dict = {}
        finals: dict = {}
        todo, seen = [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            finals[state] = (*_tuple(self.finals.get(state[0], ())), *_tuple(other.finals.get(state[1], ())))
            for symbol in CLASSES:
                (a, v), (b, w) = self.step(state[0], symbol), other.step(state[1], symbol)
                arcs.setdefault(state, {})[symbol] = ((a, b), v + w)
                todo.append((a, b))
        return Transducer(arcs, finals, (self.start, other.start))


def _tuple(x) -> tuple:
    return x if isinstance(x, tuple) else (x,)


CLASSES = "ITYNRO"  # insult, threat, target, negation, reported speech, other


def grammar() -> Transducer:
    insult = Transducer({0: {"I": (1, 1.0)}, 1: {"I": (2, 0.5)}, 2: {"I": (2, 0.25)}}, {1: "insult", 2: "insults"})
    threat = Transducer({0: {"T": (1, 0.5)}, 1: {"Y": (2, 1.0)}}, {2: "threat"})
    target = Transducer({0: {"Y": (1, 0.0)}}, {1: "target"})
    # a negation reaches three words on; an insult within reach is negated
    negation = Transducer(
        {0: {"N": (1, 0.0)}} | {k: dict.fromkeys("TYO", (k + 1 if k < 3 else 0, 0.0)) | {"I": (4, -1.0), "R": (0, 0.0), "N": (1, 0.0)} for k in (1, 2, 3)}, {4: "negated"}
    )
    reported = Transducer({0: {"R": (1, 0.0)}, 1: {"I": (2, -0.5), "T": (2, -0.5)}}, {2: "reported"})
    machine = insult
    for part in (threat, target, negation, reported):
        machine = machine.compose(part)
    return machine


#: What is counted of a document: clauses by label, and summed and highest clause weights.
FEATURES = ("insult", "insult_at", "negated", "reported", "threat", "weight", "strongest", "repeated")


class Scorer:
    """Clause matcher with a learned lexicon (item -> strength; ``x*`` is a beginning)."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        self.begins = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.lengths = sorted({len(k) for k in self.begins})
        self.machine = grammar()
        self.seek = ahocorasick.Automaton()
        for word in {*self.words, *self.begins, *THREAT}:
            self.seek.add_word(word, len(word))
        self.seek.make_automaton()

    def strength(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return max((self.begins[word[:n]] for n in self.lengths if word[:n] in self.begins), default=0.0)

    def symbol(self, word: str) -> str:
        if self.strength(word):
            return "I"
        return "T" if word in THREAT else "Y" if word in TARGET else "N" if word in NEGATION else "R" if word in REPORTED else "O"

    def features(self, text: str) -> list[float] | None:
        """None when no insult and no threat stands at a word's start."""
        text = text.lower()
        hits = [end - n + 1 for end, n in self.seek.iter(text) if end == n - 1 or not (text[end - n].isalnum() or text[end - n] == "'")]
        if not hits:
            return None
        out = dict.fromkeys(FEATURES, 0.0)
        upto = -1
        for hit in hits:
            if hit < upto:
                continue  # its clause has been read
            begin = max((m.end() for m in _CLAUSE_END.finditer(text, max(upto, 0), hit)), default=max(upto, 0))
            end = _CLAUSE_END.search(text, hit)
            upto = end.start() if end else len(text)
            words = _WORD.findall(text, begin, upto)
            state, total, best = self.machine.start, 0.0, 0.0
            for word in words:
                symbol = self.symbol(word)
                state, weight = self.machine.step(state, symbol)
                if symbol == "I":
                    weight *= self.strength(word)
                    best = max(best, self.strength(word))
                total += weight
            labels = self.machine.finals[state]
            if "insult" in labels or "insults" in labels:
                out["negated" if "negated" in labels else "reported" if "reported" in labels else "insult_at" if "target" in labels else "insult"] += 1
                out["repeated"] += "insults" in labels
            out["threat"] += "threat" in labels
            if labels and total:
                out["weight"] += max(0.0, total)
                out["strongest"] = max(out["strongest"], best)
        return [np.log1p(out[k]) if k not in ("strongest",) else out[k] for k in FEATURES]


def items(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 1}
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k}


def _held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _counts(rows: DataFrame, only: set[str] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = items(text or "")
                count.update(own if only is None else own & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["item", "n"])

    return rows.select("text").mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))


def least_count(n_toxic: int) -> int:
    """An item must stand in so many toxic rows of the sample: chance words do not."""
    return max(4, n_toxic // 80)


def choose_lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Items far likelier in toxic rows; a word is left out where its beginning is in."""
    least = least_count(n_toxic)
    odds = {}
    for item, n in toxic.items():
        score = np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(item, 0) + 0.5) / (n_clean + 1))
        if n >= least and score >= MIN_LOG_ODDS and clean.get(item, 0) <= 0.02 * n + 1:
            odds[item] = float(score)
    chosen: dict[str, float] = {}
    for item in sorted(odds, key=lambda x: (not x.endswith("*"), len(x), x)):
        stem = item.rstrip("*")
        if not any(stem[:k] + "*" in chosen for k in BEGINNINGS if k <= len(stem)):
            chosen[item] = odds[item] / 4
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 200, l2: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the intercept is moved to the true prior."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x1.shape[1])
    ridge = np.diag([1e-6] + [l2] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + ridge, x1.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    share = y.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return w


def learn(docs: DataFrame, marks: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and label weights, from the sample."""
    known = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n_toxic, n_clean = min(sizes.get(1, 0), TOXIC_ROWS), min(sizes.get(0, 0), CLEAN_ROWS)
    flat = np.zeros(1 + len(FEATURES))
    if not n_toxic or not n_clean:
        flat[0] = -np.log(2 * sum(sizes.values()) + 1) if not n_toxic else 0.0
        return {}, flat
    first = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(n)
    chosen = first(1, TOXIC_ROWS).unionByName(first(0, CLEAN_ROWS))
    rows = materialise(docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id"), "sample")
    toxic = {r["item"]: r["n"] for r in _counts(rows.where("toxic = 1"), None).where(F.col("n") >= least_count(n_toxic)).collect()}
    clean = {r["item"]: r["n"] for r in _counts(rows.where("toxic = 0"), set(toxic)).collect()}
    lexicon = choose_lexicon(toxic, clean, n_toxic, n_clean)
    found = _featured(rows.select("doc_id", "text", "toxic"), lexicon, "toxic").collect()  # the sample's features only
    x = np.array([r["f"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    y = np.array([r["toxic"] for r in found], dtype=float)
    if not 0 < y.mean() < 1:
        return lexicon, flat
    return lexicon, fit_logistic(x, y, prior=(sizes[1] + 0.5) / (sizes[0] + sizes[1] + 1))


def _featured(rows: DataFrame, lexicon: dict[str, float], carry: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, none = Scorer(lexicon), [0.0] * len(FEATURES)
        for batch in batches:
            found = [scorer.features(t) or none if t else none for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(carry).cast(pa.int64()), pa.array(found, pa.list_(pa.float64()))], [carry, "f"])

    return rows.select(carry, "text").mapInArrow(run, f"{carry} long, f array<double>")


def score_toxicity(docs: DataFrame, lexicon: dict[str, float], weights: Iterable[float]) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    weights = np.asarray(list(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, none = Scorer(lexicon), [0.0] * len(FEATURES)
        for batch in text_chunks(batches, "text"):
            x = np.array([scorer.features(t) or none if t else none for t in batch.column("text").to_pylist()], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            out = [zlib.crc32(str(d).encode()) % 5 == 0 if d is not None else False for d in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean_rows(docs: DataFrame, lexicon: dict[str, float], weights: Iterable[float]) -> DataFrame:
    """The rows, with all their columns, whose score is below 0.5; no shuffle."""
    weights = np.asarray(list(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, none = Scorer(lexicon), [0.0] * len(FEATURES)
        for batch in text_chunks(batches, "text"):
            x = np.array([scorer.features(t) or none if t else none for t in batch.column("text").to_pylist()], dtype=float)
            yield batch.filter(pa.array(weights[0] + x @ weights[1:] < 0))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, *learn(docs, labels(spark, sf_dir)))
