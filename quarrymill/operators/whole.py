"""Documents that fit into a task, resolved whole: cascade, references and what is handed down.

Rows come dealt and sorted by document, so a task settles many documents at once on machine words:
values are numbers into a table of strings, a parent is a place, and pointers double over all rows
together.  What it gives is what ``cascade.cascaded`` and ``scopes.resolved`` give in rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarrymill.operators.cascade import BLANKS, FROM_PARENT, INITIAL

#: Rows and bytes of whole documents that one step takes; texts whose reading a task remembers.
ROWS, BYTES, REMEMBERED = 65536, 1 << 25, 4096
#: What an element makes of its parent's container; from INERT on the parent's stays.
PAINTED, RESOURCE, UNCHECKED, INERT, HIDDEN = range(1, 6)
CONTAINERS = (None, "painted", "resource", "unchecked", "inert", "hidden")

_DECLARED = re.compile(r"^[^:]*?([-\w]+)\s*:\s*(\S.*)$", re.A | re.S)
_SPACE = re.compile(r"\s+", re.A)
_IMPORTANT = re.compile(r"\s*!\s*important\s*$", re.A | re.I)
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_PLAIN_AT = re.compile(r"@(?:charset|import|namespace)[^;{]*;", re.A | re.I)
_PIECE = re.compile(r"[^{}]*[{}]")
_JOINT = re.compile(r"\s*([>+~])\s*", re.A)
_TAG = re.compile(r"(?<![.#\w-])([-\w]+)", re.A)
_ID, _CLASS = re.compile(r"#([-\w]+)", re.A), re.compile(r"\.([-\w]+)", re.A)
_LOW = "".join(map(chr, range(33)))
_DOUBLE = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|0x(?:[\da-f]+\.?[\da-f]*|\.[\da-f]+)p[+-]?\d+)[fd]?", re.A | re.I)


def declared(block: str) -> dict[str, tuple[str, bool]]:
    """Value and importance of each property of a block of declarations; the last of a property wins."""
    found = {}
    for part in block.split(";"):
        if m := _DECLARED.match(part):
            text = _SPACE.sub(" ", m[2]).strip(" ")
            value = _IMPORTANT.sub("", text)
            found[m[1].lower()] = value, value != text
    return found


def style_rules(sheet: str) -> list[tuple[int, int, str, dict[str, tuple[str, bool]]]]:
    """Place, turn, selector and declarations of each rule of a sheet, as written."""
    text = _PLAIN_AT.sub("", _COMMENT.sub("", sheet))
    found, shut_at, level, inside, head = [], {}, 0, 0, None
    for at, piece in enumerate(_PIECE.findall(text)):
        body = piece[:-1].strip(BLANKS)
        if piece[-1] == "{":
            level += 1
            low = body.lower()
            shut = low.startswith("@") and not (low.startswith("@media") and ("print" in low or "all" in low))
            shut_at[level] = shut
            inside += shut
            head = body
        else:
            shut = shut_at.get(level, False)
            shut_at[level] = False
            level -= 1
            inside -= shut
            if head is not None and not inside and not shut and not head.startswith("@"):
                block = declared(body)
                found += [(at, turn, selector.strip(BLANKS), block) for turn, selector in enumerate(head.split(","))]
            head = None
    return found


def selector_steps(selector: str) -> list[tuple[str | None, str | None, tuple[str, ...]]] | None:
    """Tag, id and classes of each step of a selector of descendants; null where it has anything else."""
    text = _SPACE.sub(" ", _JOINT.sub(r"\1", selector.strip(" ")))
    if re.search(r"[\[\]:>+~]", text):
        return None
    steps = []
    for part in re.findall(r" ?[^ >+~]+", text):
        tag, ids, classes = _TAG.search(part), _ID.findall(part), tuple(dict.fromkeys(c.lower() for c in _CLASS.findall(part)))
        steps.append((tag and tag[1].lower(), ids[-1].lower() if ids else None, classes))
    return steps if steps and all(t is not None or i is not None or c for t, i, c in steps) else None


def clear(opacity: str) -> bool:
    """Whether an opacity is known to be nought, its number read as Spark casts it."""
    text = opacity.strip(" ").removesuffix("%").strip(_LOW).lower()
    if not _DOUBLE.fullmatch(text):
        return text in ("-inf", "-infinity")
    text = text.rstrip("fd")
    try:
        return (float.fromhex(text) if "x" in text else float(text)) <= 0
    except OverflowError:
        return text.startswith("-")


def starts(doc: pa.ChunkedArray) -> np.ndarray:
    """Where documents begin in a sorted column; rows without one stand alone."""
    same = pc.fill_null(pc.equal(doc.slice(1), doc.slice(0, len(doc) - 1)), False)
    return np.flatnonzero(np.append(True, ~same.to_numpy()))


def whole_documents(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole documents, of sorted batches that cut them; of a document of more than ``most`` rows
    there is no end."""
    held, rows, size, last, opened = [], 0, 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc_id")
        begins = starts(pa.chunked_array([doc] if last is None else [last, doc]))
        begins = begins if last is None else begins[1:] - 1
        last = doc.slice(batch.num_rows - 1)
        if opened > most:
            over = begins[0] if len(begins) else batch.num_rows
            batch, begins = batch.slice(over), begins - over
            if not batch.num_rows:
                continue
        if len(begins) and held and (rows + batch.num_rows >= ROWS or size + batch.nbytes >= BYTES):
            yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
            batch, begins, held, rows, size = batch.slice(begins[-1]), begins[:1] * 0, [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        opened = batch.num_rows - begins[-1] if len(begins) else opened + batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


class _Strings:
    """Strings as numbers; -1 is null."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def of(self, value: str) -> int:
        return self.number.setdefault(value, len(self.number))

    def coded(self, column: pa.ChunkedArray) -> np.ndarray:
        codes, values = _coded(column)
        return _table([self.of(v) for v in values])[codes]

    def named(self, codes: np.ndarray) -> pa.Array:
        return pa.array(list(self.number), pa.string()).take(pa.array(codes, mask=codes < 0))

    def judged(self, say) -> np.ndarray:
        """What ``say`` makes of each string, and of null (the last) -1."""
        return _table([say(v) for v in self.number])


def _table(values: Sequence[int]) -> np.ndarray:
    """The values and one more, so that a code of -1 stays -1."""
    return np.array([*values, -1], np.int32)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Numbers of a column's values, -1 for null, and these values."""
    both = column.combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    return pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False), both.dictionary.to_pylist()


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of numbers, nought for null, and which are there."""
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first``."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Drawings:
    """A table of whole documents: where each row's parent stands and its subtree ends."""

    def __init__(self, table: pa.Table):
        self.rows = table.num_rows
        self.known = pc.is_valid(table["doc_id"]).to_numpy()
        self.first = starts(table["doc_id"])
        self.size = np.diff(np.append(self.first, self.rows))
        self.doc = np.repeat(np.arange(len(self.first)), self.size)
        node, self.placed = _numbers(table["node_id"])
        parent, has = _numbers(table["parent_id"])
        names, rank = np.unique(np.concatenate([node, parent]), return_inverse=True)
        own, up = rank[: self.rows], np.where(has, rank[self.rows :], len(names))
        base = self.doc * (len(names) + 1)
        there = np.flatnonzero(self.placed)
        keys = (base + own)[there]
        at = np.minimum(np.searchsorted(keys, base + up), max(len(keys) - 1, 0))
        self.parent = np.full(self.rows, -1)
        if len(keys):
            self.parent = np.where(has & self.known & (keys[at] == base + up), there[at], -1)
        self._sibling = base + up
        self._last = None

    def climbed(self, columns: list[np.ndarray], rules: list) -> list[np.ndarray]:
        """The columns with what stands above composed into them by their rules."""
        jump = self.parent
        for _ in range(self.rows.bit_length() + 1):
            if not (jump >= 0).any():
                break
            moves = np.flatnonzero(jump >= 0)
            above = jump[moves]
            columns = [_put(c, moves, f(c[moves], c[above])) for c, f in zip(columns, rules, strict=True)]
            jump = _put(jump, moves, jump[above])
        return columns

    def last(self) -> np.ndarray:
        """The last place of each subtree: before the next sibling, else where the parent's ends."""
        if self._last is None:
            order = np.argsort(self._sibling, kind="stable")
            near = self._sibling[order[1:]] == self._sibling[order[:-1]]
            end = np.full(self.rows, -1)
            end[order[:-1][near]] = order[1:][near] - 1
            (end,) = self.climbed([end], [nearest])
            self._last = np.where(end < 0, (self.first + self.size - 1)[self.doc], end)
        return self._last


def _put(values: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[at] = new
    return out


def nearest(own: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The own value, else what stands above."""
    return np.where(own < 0, above, own)


def contained(own: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Hidden and inert swallow what stands below, anything else hands on what the element does not set."""
    return np.where((above >= INERT) | (own == 0), above, own)


class Reader:
    """What texts say, remembered for the next ones."""

    def __init__(self, properties: Sequence[str]):
        self.properties = {p: i for i, p in enumerate(properties)}
        self._blocks, self._sheets = {}, {}

    def _once(self, known: dict, text: str, read):
        if text not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[text] = read(text)
        return known[text]

    def block(self, text: str) -> list[tuple[int, str, bool]]:
        said = lambda b: [(self.properties[p], *v) for p, v in b.items() if p in self.properties]
        return self._once(self._blocks, text, lambda t: said(declared(t)))

    def sheet(self, text: str) -> list[tuple[int, int, list, list[tuple[int, str, bool]]]]:
        """Order, weight, steps and declarations of the rules that ask for a property."""

        def read(sheet: str) -> list:
            found = []
            for order, (_, _, selector, block) in enumerate(style_rules(sheet)):
                said, steps = [(self.properties[p], *v) for p, v in block.items() if p in self.properties], selector_steps(selector)
                if said and steps:
                    weight = (sum(i is not None for _, i, _ in steps) << 42) + (sum(len(c) for *_, c in steps) << 21) + sum(t is not None for t, *_ in steps)
                    found.append((order, weight, steps, said))
            return found

        return self._once(self._sheets, text, read)


def from_sheets(table: pa.Table, tree: Drawings, reader: Reader, strings: _Strings) -> tuple[np.ndarray, np.ndarray]:
    """Value and importance of the sheets' best declaration, by property and row."""
    value, important = np.full((len(reader.properties), tree.rows), -1, np.int32), np.zeros((len(reader.properties), tree.rows), bool)
    codes, texts = _coded(table["sheet"])
    used = np.flatnonzero((codes >= 0) & tree.known)
    if not len(used):
        return value, important
    tag_of, tags = _coded(table["tag"])
    lowered: dict[str, int] = {}
    tag_of = _table([lowered.setdefault(t.lower(), len(lowered)) for t in tags])[tag_of]
    id_of, ids = _coded(table["id"])
    id_at = {v: i for i, v in enumerate(ids)}
    class_of, classes = _coded(table["class"])
    class_sets = [set(_SPACE.split(c.strip(" ").lower())) for c in classes] + [set()]
    has: dict[str, np.ndarray] = {}

    def fits(step, rows: np.ndarray) -> np.ndarray:
        tag, ident, wanted = step
        fit = tree.placed[rows]
        if tag is not None:
            fit = fit & (tag_of[rows] == lowered.get(tag, -2))
        if ident is not None:
            fit = fit & (id_of[rows] == id_at.get(ident, -2))
        for c in wanted:
            if len(rows) < len(class_sets):
                fit = fit & np.fromiter((c in class_sets[k] for k in class_of[rows]), bool, len(rows))
            else:
                if c not in has:
                    has[c] = np.array([c in s for s in class_sets])
                fit = fit & has[c][class_of[rows]]
        return fit

    # a document's later copy of a sheet outweighs its earlier ones
    pair = codes[used].astype(np.int64) * len(tree.first) + tree.doc[used]
    kept = used[len(used) - 1 - np.unique(pair[::-1], return_index=True)[1]]  # by text, then document
    cuts = np.flatnonzero(np.diff(codes[kept])) + 1
    hits = []
    for uses in np.split(kept, cuts):
        docs = tree.doc[uses]
        rows, sheet = _spread(tree.first[docs], tree.size[docs]), np.repeat(uses, tree.size[docs])
        for order, weight, steps, said in reader.sheet(texts[codes[uses[0]]]):
            chosen = fits(steps[0], rows)
            for step in steps[1:]:
                # an interval that opened before a row and ends no earlier holds it
                ends = np.maximum.accumulate(np.where(chosen, tree.last()[rows], -1))
                chosen = fits(step, rows) & (np.concatenate([[-1], ends[:-1]]) >= rows)
            hit = np.flatnonzero(chosen)
            if len(hit):
                hits += [(rows[hit], sheet[hit], p, strings.of(v), i, weight, order) for p, v, i in said]
    if hits:
        long = [len(h[0]) for h in hits]
        row, sheet = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
        prop, code, marked, weight, order = (np.repeat([h[k] for h in hits], long) for k in range(2, 7))
        key = row * len(reader.properties) + prop
        best = np.lexsort((order, sheet, weight, marked, key))
        best = best[np.append(np.diff(key[best]) != 0, True)]
        value[prop[best], row[best]], important[prop[best], row[best]] = code[best], marked[best]
    return value, important


def cascaded(table: pa.Table, tree: Drawings, reader: Reader, strings: _Strings) -> np.ndarray:
    """The value that wins the cascade, by property and row: important inline, important rule,
    inline, rule, attribute."""
    css, css_marked = from_sheets(table, tree, reader, strings)
    style_of, styles = _coded(table["style"])
    own, marked = np.full((len(reader.properties), len(styles) + 1), -1, np.int32), np.zeros((len(reader.properties), len(styles) + 1), bool)
    for k, text in enumerate(styles):
        for p, v, i in reader.block(text):
            own[p, k], marked[p, k] = strings.of(v), i
    plain = lambda p: strings.coded(table[f"attr_{p}"]) if f"attr_{p}" in table.column_names else np.int32(-1)
    won = np.empty_like(css)
    for p in range(len(css)):
        inline = own[p][style_of]
        rest = np.where(css[p] >= 0, css[p], plain(p))
        won[p] = np.where((inline >= 0) & (marked[p][style_of] | ~css_marked[p]), inline, rest)
    return won


def referred(table: pa.Table, tree: Drawings, link: re.Pattern) -> np.ndarray:
    """Whether anything in its document names a row's id."""
    id_of, ids = _coded(table["id"])
    id_at = {v: i for i, v in enumerate(ids)}
    used_of, used = _coded(table["used"])
    used_of = _table([id_at.get(u, -1) for u in used])[used_of]
    text_of, texts = _coded(table["links"])
    named = [[id_at[v] for v in link.findall(t) if v in id_at] for t in texts]
    many = np.array([*map(len, named), 0])
    begin, rows = np.cumsum(many) - many, np.flatnonzero(text_of >= 0)
    linked = np.array([v for n in named for v in n], np.int64)[_spread(begin[text_of[rows]], many[text_of[rows]])]
    row, asked = np.append(np.repeat(rows, many[text_of[rows]]), np.flatnonzero(used_of >= 0)), np.append(linked, used_of[used_of >= 0])
    wide = len(ids) + 1
    return tree.known & (id_of >= 0) & np.isin(tree.doc * wide + id_of, tree.doc[row] * wide + asked)


def settled(batches: Iterable[pa.RecordBatch], names: dict[str, str], own: Sequence[str], kinds: dict[str, int], link: str, kept: Sequence[str] | None, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``doc_id, node_id, tag``, the inherited ``names`` in force, ``own`` values, ``scaled``,
    ``scope`` (of those ``kept``) and ``late``: a row that only names a document of more than ``most`` rows."""
    properties = tuple(dict.fromkeys((*names.values(), "display", "opacity", "visibility", *own)))
    reader, link = Reader(properties), re.compile(link, re.A)
    number = reader.properties
    wanted = np.array([kept is None or c in kept for c in CONTAINERS])
    for table in whole_documents(batches, most):
        first = starts(table["doc_id"])
        size = np.diff(np.append(first, table.num_rows))
        if size.max() > most:
            left = np.where(size > most, 1, size)
            table, late = table.take(pa.array(_spread(first, left))), np.repeat(size > most, left)
        else:
            late = np.zeros(table.num_rows, bool)
        tree, strings = Drawings(table), _Strings()
        won = cascaded(table, tree, reader, strings)
        kind_of, tags = _coded(table["tag"])
        asked = referred(table, tree, link)
        gone = strings.judged(lambda v: v.strip(" ").rstrip(";").lower() == "none")[won[number["display"]]] == 1
        gone |= strings.judged(clear)[won[number["opacity"]]] == 1
        sees = {"hidden": 1, "collapse": 1, "visible": 0, "initial": 0}
        seen = strings.judged(lambda v: sees.get(v.strip(" ").lower(), -1))[won[number["visibility"]]]
        kind = np.array([*(kinds.get(t.lower(), 0) for t in tags), 0])[kind_of]
        turn = np.where(gone, HIDDEN, np.where(kind == INERT, INERT, np.where(asked, PAINTED, kind)))
        initial = strings.of(INITIAL)
        said = lambda v: -1 if (low := v.strip(" ").lower()) in FROM_PARENT else initial if low == "initial" or low.startswith("initial ") else strings.of(v)
        handed = strings.judged(said)
        scaled = pc.fill_null(table["scaled"], False).to_numpy().astype(bool)
        columns = [turn, seen, scaled, *(handed[won[number[p]]] for p in names.values())]
        turn, seen, scaled, *passed = tree.climbed(columns, [contained, nearest, np.logical_or, *[nearest] * len(names)])
        scope = np.where(seen == 1, HIDDEN, np.where(turn == 0, PAINTED, turn))
        out = np.flatnonzero(wanted[scope] | late)
        inherited = [strings.named(np.where(c == initial, -1, c)[out]) for c in passed]
        values = [strings.named(won[number[p]][out]) for p in own]
        rows = [table[c].take(pa.array(out)) for c in ("doc_id", "node_id", "tag")]
        rest = [pa.array(scaled[out]), pa.array(CONTAINERS, pa.string()).take(pa.array(scope[out])), pa.array(late[out])]
        labels = ["doc_id", "node_id", "tag", *names, *(f"own_{p}" for p in own), "scaled", "scope", "late"]
        yield from pa.Table.from_arrays([*rows, *inherited, *values, *rest], names=labels).combine_chunks().to_batches()
