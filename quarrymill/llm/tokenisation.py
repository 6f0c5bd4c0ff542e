"""Pre-tokens of a byte-pair vocabulary with word ends, and their merging in numpy.

Used by the token counts and by the packing.  ``RankMerger`` merges many
pre-tokens together; ``PieceTable`` turns an Arrow array of texts into codes of
distinct white-space-free pieces, so that work is done once for each distinct
piece of a chunk and once for each distinct pre-token of a worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pre-tokens remembered by a worker; when full it starts afresh, so memory is bounded.
CACHE_ENTRIES = 300_000
_CONTROL = "[\x1c-\x1f]"
_NO_LIMIT = np.int64(1 << 40)


class RankMerger:
    """Counts byte-pair symbols of many pre-tokens at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        vocab = spec["model"]["vocab"]
        self.vocab = vocab
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.width = np.int64(max(vocab.values()) + 2)
        self.unknown = np.int64(self.width - 1)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of, self.made_by_rank = key[order], rank[order], made
        lowest = np.full(int(self.width), _NO_LIMIT)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.safe = lowest[made] > rank
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pre_tokens(self, piece: str) -> tuple[list[str], int]:
        """Byte-level pre-tokens of a white-space-free piece, and its special tokens."""
        extra = 0
        parts = [piece]
        if self.special is not None and self.special.search(piece):
            extra = len(self.special.findall(piece))
            parts = [p for p in self.special.split(piece) if p]
        out: list[str] = []
        for part in parts:
            text = self.library.normalizer.normalize_str(part)
            out += [t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return out, extra

    def merge(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all pre-tokens, in order, and how many each has."""
        if not tokens:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        get, unknown = self.vocab.get, int(self.unknown)
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = [get(c, unknown) for t in tokens for c in (*t[:-1], t[-1] + self.suffix)]
        symbols = np.array(flat, dtype=np.int64)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while symbols.size > 1:
            same = owner[:-1] == owner[1:]
            key = np.where(same, symbols[:-1] * self.width + symbols[1:], np.int64(-1))
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            rank = np.where(self.keys[at] == key, self.rank_of[at], _NO_LIMIT)
            rank = np.append(rank, _NO_LIMIT)
            starts = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, starts)
            live = best < _NO_LIMIT
            spans = np.diff(np.append(starts, symbols.size))
            going = np.repeat(live, spans)
            if not live.all():  # sequences without a pair are done
                done.append((symbols[~going], owner[~going]))
                if not live.any():
                    symbols = symbols[:0]
                    break
            place = np.flatnonzero((rank == np.repeat(best, spans)) & going)
            seq = np.repeat(np.arange(starts.size), spans)[place]
            run_start = np.append(True, (np.diff(place) != 1) | (np.diff(seq) != 0))
            first = np.flatnonzero(run_start)
            within = place - np.repeat(place[first], np.diff(np.append(first, place.size)))
            leftmost = np.append(True, np.diff(seq) != 0)
            place = place[np.where(self.safe[rank[place]], within % 2 == 0, leftmost)]
            symbols[place] = self.made_by_rank[rank[place]]
            keep = going
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if symbols.size:
            done.append((symbols, owner))
        symbols = np.concatenate([x for x, _ in done])
        owner = np.concatenate([x for _, x in done])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(tokens))


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def text_chunks(batches: Iterable[pa.RecordBatch], name: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most about ``most`` bytes of text, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(size):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def split_pieces(text: str) -> list[str]:
    """Cut at Unicode white space.  str.split and Arrow also cut at \\x1c-\\x1f, which
    are no white space to the vocabulary, so texts with those go this slow way."""
    import regex

    return [p for p in regex.split(r"[\p{White_Space}]+", text) if p]


class PieceTable:
    """Ids of pieces; distinct pre-tokens are merged once and remembered.

    The pre-token pattern is the vocabulary's own (fixed by its file) for pieces of
    plain Latin letters, where normalisation is lower-casing alone; any other piece
    goes through the library's normaliser and pre-tokenizer.
    """

    def __init__(self, path: str):
        import regex

        self.merger = merger(path)
        self.special_id = {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
        self.plain = re.compile("[\x21-\x7e\u00a1-\u024f ]*")
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")
        # the byte-level alphabet: visible Latin-1 stands for itself, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: Iterable[str], spell) -> None:
        tokens = list(tokens)
        symbols, counts = self.merger.merge([spell(t) for t in tokens])
        raw, cuts = symbols.astype("<u4").tobytes(), [0, *np.cumsum(counts * 4).tolist()]
        self.known.update((t, raw[cuts[i] : cuts[i + 1]]) for i, t in enumerate(tokens))

    def _spell(self, token: str) -> str:
        return token if token.isascii() else token.encode().decode("latin-1").translate(self.alphabet)

    def _odd(self, piece: str) -> bytes:
        """A piece with special strings or characters outside the plain range."""
        special, out = self.merger.special, []
        parts = re.split(f"({special.pattern})", piece) if special is not None else [piece]
        for part in filter(None, parts):
            if part in self.special_id:
                out.append(np.uint32(self.special_id[part]).tobytes())
                continue
            tokens, _ = self.merger.pre_tokens(part)
            new = [t for t in dict.fromkeys(tokens) if "\0" + t not in self.known]
            if new:
                symbols, counts = self.merger.merge(new)
                raw, cuts = symbols.astype("<u4").tobytes(), [0, *np.cumsum(counts * 4).tolist()]
                self.known.update(("\0" + t, raw[cuts[i] : cuts[i + 1]]) for i, t in enumerate(new))
            out += [self.known["\0" + t] for t in tokens]
        return b"".join(out)

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, and how many each has."""
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        joined = " ".join(pieces)
        odd: dict[int, bytes] = {}
        if "<|" in joined or not self.plain.fullmatch(joined):
            full = self.plain.fullmatch
            odd = {i: self._odd(p) for i, p in enumerate(pieces) if "<|" in p or not full(p)}
            joined = " ".join("" if i in odd else p for i, p in enumerate(pieces))
        tokens = self.pattern.findall(joined.lower())
        self.known[" "] = b""
        new = set(tokens) - self.known.keys()
        if new:
            self._learn(new, self._spell)
        own = list(map(self.known.__getitem__, tokens))
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        cut = np.fromiter((t == " " for t in tokens), dtype=bool, count=len(tokens))
        counts = np.bincount(np.cumsum(cut), weights=size, minlength=len(pieces)).astype(np.int64)
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        if odd:
            starts = np.cumsum(counts) - counts
            parts, last = [], 0
            for i, raw in odd.items():
                parts += [flat[last : starts[i]], np.frombuffer(raw, dtype="<u4")]
                last, counts[i] = starts[i], len(raw) // 4
            flat = np.concatenate([*parts, flat[last:]])
        return flat, counts

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row cuts (n + 1), piece codes, flat ids of the distinct pieces, how many each has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring_regex(texts, _CONTROL)).as_py():
            lists = pa.array([split_pieces(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        cuts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        pieces = encoded.dictionary.to_pylist()
        flat, counts = self.ids_of(pieces) if pieces else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
        return cuts, encoded.indices.to_numpy(zero_copy_only=False), flat, counts


def row_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[cuts[1:]] - total[cuts[:-1]]


def gather(codes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids of the pieces named by ``codes``, one after another."""
    starts = np.cumsum(counts) - counts
    size = counts[codes]
    ends = np.cumsum(size)
    if not codes.size or not ends[-1]:
        return np.zeros(0, dtype="<u4")
    return flat[np.arange(ends[-1]) + np.repeat(starts[codes] - (ends - size), size)]
