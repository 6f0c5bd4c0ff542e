"""N-gram Jaccard self-join by universe-partition pigeonhole, and its components.

A text's set is its distinct ``WIDTH``-word shingles.  Two sets with a Jaccard
similarity of 4/5 or more differ in at most ``(|r| + |s|) / 9`` shingles.

* Universe partition: sets fall into size bands that double; a set belongs to its own
  band and, when smaller partners may lie there, to the band below.  A band cuts the
  universe of shingles by hash into segments, so many that a set fills more of them than
  any partner can differ in: similar sets agree in a filled segment.  Signatures are
  hashes of (band, segment, the shingles of the set in it).
* Allocation: a set needs one credit more than the differences to allow for.  Agreement
  in a whole segment is worth one; agreement up to one shingle (the one-deletion
  neighbourhood: the segment, and the segment without each of its shingles) is worth two.
  Segments that few sets share (``HOT`` at most) are taken first.  A set that lacks
  credits then buys them from its dear segments at least cost: the rarest whole, or one
  neighbourhood in place of two whole ones where these together have more sets than
  the largest.  Only sets that lack credits can miss each other among the cheap segments,
  so only they are entered, with all their segments, in the neighbourhood index.
* Nothing quadratic leaves a group.  A dear signature links each of its sets with its
  least one (a star); map tasks do so for their own sets first and pass on a few.  In
  the neighbourhood index parity sketches of the sets, which show no more differences than
  there are, leave few pairs of different components.  A group passes on no more of them
  than it has rows: all, or a least spanning forest over its components.  Where the whole
  forest is similar, or all pairs were passed on, the group is settled.  In the others a set
  asks for its nearest smaller partners of other components.  Of a pair always the same one
  asks, so what a set has asked for in full is settled: a next round is only for sets that
  found more partners than they could ask for at once, and for the keys by which these ask.
* Verification is exact: words are numbered, not hashed, and sets of shingles compared.

The output is components only: pairs inside one component are dropped unverified, so
neither the links themselves nor their number is known.

Equal sets enter once, named by a 96-bit digest.  Texts travel to verification once for
each candidate pair, keyed by the smaller partner; a partner with many pairs is dealt
over as many keys as ``PAIRS_PER_KEY`` asks for.

Defined results: null and blank texts have empty sets and are their own components;
a null ``doc_id`` has component null and links nothing; repeated rows share a set, and
rows that share a ``doc_id`` with other texts each have their own component; ties have no
influence, since components do not depend on the order; very long texts are read whole, a
chunk holding one at least; no rows give no rows; extra columns are unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import dispose, documents, materialise, shuffle_width
from quarrymill.llm.components import components
from quarrymill.llm.hashing import mixed, numbered, run_hashes, word_hashes, word_numbers
from quarrymill.llm.tokenisation import text_chunks

WIDTH = 5
HOT = 8
PAIRS_PER_KEY = 256
SKETCH_WORDS = 16
#: Partners a set asks for at once: in a group, and in a round.
ASK, ASK_ROUND = 16, 64
#: Sets of one group that a task holds; larger groups are dealt in blocks.
BLOCK = 4096
#: Signatures that a task holds before it hands them on.
_FLUSH = 500_000
_SEEN = 100_000
#: Bytes of text hashed at once; numpy holds some 80 times as many.
_CHUNK_BYTES = 1 << 19


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of each text, sorted by the first of their two lanes."""
    words, cuts = word_hashes(texts, lower=True)
    runs = [run_hashes(words[k], width, k) for k in (0, 1)]
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= width:
            first, at = np.unique(runs[0][lo : hi - width + 1], return_index=True)
            out.append((first, runs[1][lo : hi - width + 1][at]))
        elif hi > lo:
            out.append(tuple(run_hashes(words[k, lo:hi], hi - lo, k) ^ np.uint64(hi - lo) for k in (0, 1)))
        else:
            out.append((words[0, :0], words[1, :0]))
    return out


def band_of(n: int) -> int:
    """Sizes 2**b .. 2**(b + 1) - 1."""
    return n.bit_length() - 1


def segments(band: int) -> int:
    top = (2 << band) - 1
    return 8 * top if top < 64 else -(-top // 3) * 2 if top < 256 else int(top / 3.3) + 1


def memberships(n: int) -> list[tuple[int, int]]:
    """Bands of a set of n shingles, each with the differences to allow for there."""
    band = band_of(n)
    out = [(band, n // 4)]
    below = (1 << band) - 1
    if band and -(-4 * n // 5) <= below:
        out.append((band - 1, (n + below) // 9))
    return out


def by_segment(items: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle values ordered by segment, starts of the filled segments, their sums and salts."""
    spread = mixed(items ^ np.uint64(band + 1))
    segment = spread % np.uint64(segments(band))
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], mixed(spread[order])
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    return value, starts, np.add.reduceat(value, starts), mixed(segment[starts] + np.uint64((band + 1) << 40))


def signatures(items: np.ndarray, band: int) -> np.ndarray:
    """One signature for each filled segment."""
    _, _, sums, salts = by_segment(items, band)
    return mixed(sums ^ salts)


def neighbourhood(items: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the filled segments, those without each one shingle (segments of two or
    more), and the segment of each of the latter."""
    value, starts, sums, salts = by_segment(items, band)
    size = np.diff(np.append(starts, value.size))
    owner = np.repeat(np.arange(starts.size), size)
    many = size[owner] > 1
    return mixed(sums ^ salts), mixed((sums[owner] - value) ^ salts[owner])[many], owner[many]


def set_id(items: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(items[0].tobytes() + items[1].tobytes(), digest_size=12).digest()


def spare_segments(items: np.ndarray) -> list[int]:
    """For each membership: filled segments beyond those a partner can differ in, less one."""
    out = []
    for band, differ in memberships(items.size):
        filled = np.zeros(segments(band), dtype=bool)
        filled[(mixed(items ^ np.uint64(band + 1)) % np.uint64(segments(band))).astype(np.int64)] = True
        out.append(int(filled.sum()) - differ - 1)
    return out


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the shingles in ``SKETCH_WORDS * 64`` places.  Two sketches disagree in no
    more places than their sets have shingles apart, so they rule pairs out without loss."""
    odd = np.bincount((mixed(items) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, key, n_shingles, node, spare`` of every document; equal sets have equal nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            sets = shingle_sets(batch.column("text"), width)
            arrays = [
                batch.column("doc_id"), batch.column("key"), pa.array([s.size for s, _ in sets], pa.int64()),
                pa.array([set_id(s) if s[0].size else None for s in sets], pa.binary()),
                pa.array([spare_segments(s) if s.size else None for s, _ in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_shingles", "node", "spare"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, n_shingles long, node binary, spare array<long>")


_PACK = np.dtype([("sig", "<u4"), ("part", "u1"), ("n0", "<u8"), ("n1", "<u4")])
#: A member of a signature that is dear in one task already, with the least one there.
_OVER = np.dtype([("sig", "<i8"), ("part", "u1"), ("n0", "<u8"), ("n1", "<u4"), ("lead_part", "u1"), ("l0", "<u8"), ("l1", "<u4")])
_FOUND = "a binary, part_a int, b binary, part_b int, n long, sig long"


def _nodes(n0: np.ndarray, n1: np.ndarray) -> pa.Array:
    body = np.empty(n0.size, dtype=[("a", "<u8"), ("b", "<u4")])
    body["a"], body["b"] = n0, n1
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), n0.size, [None, pa.py_buffer(body.tobytes())]).cast(pa.binary())


def _found(first: tuple, second: tuple, shares: np.ndarray, dear: tuple, sig: np.ndarray) -> pa.RecordBatch:
    """Candidate pairs (``sig`` null), then members of dear signatures (``b`` null); sides are
    ``(n0, n1, part)``."""
    m, k = sig.size, shares.size
    both = [np.append(x, y) for x, y in zip(first, dear, strict=True)]
    arrays = [
        _nodes(both[0], both[1]), pa.array(both[2].astype(np.int32)),
        pa.concat_arrays([_nodes(second[0], second[1]), pa.nulls(m, pa.binary())]), pa.concat_arrays([pa.array(second[2].astype(np.int32)), pa.nulls(m, pa.int32())]),
        pa.concat_arrays([pa.array(shares, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(sig, pa.int64())]),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["a", "part_a", "b", "part_b", "n", "sig"])


def _groups(pack: np.ndarray, bins: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs in order of (signature, part, node) without repeats; signatures; starts of groups."""
    sig = pack["sig"].astype(np.int64) | (np.asarray(bins, dtype=np.int64) << 32)
    order = np.lexsort((pack["n1"], pack["n0"], pack["part"], sig))
    pack, sig = pack[order], sig[order]
    if sig.size:
        new = np.append(True, (sig[1:] != sig[:-1]) | (pack["n0"][1:] != pack["n0"][:-1]) | (pack["n1"][1:] != pack["n1"][:-1]) | (pack["part"][1:] != pack["part"][:-1]))
        pack, sig = pack[new], sig[new]
    return pack, sig, np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if sig.size else np.zeros(0, dtype=np.int64)


def packed_signatures(docs: DataFrame, bins: int, width: int) -> DataFrame:
    """``bin, pack``: signatures of a task for each of ``bins`` ranges, 17 bytes each (32
    bits of signature and the bin: a chance agreement is a candidate that verification drops).

    Of a signature that many sets of a task share only ``HOT + 1`` go on to the bin, which
    suffice to show that it is dear; the others hang on the least of them here, in packs
    whose ``bin`` is negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, bytes, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            full = np.concatenate([h[0] for h in held])
            count = [h[0].size for h in held]
            pack = np.empty(full.size, dtype=_PACK)
            pack["sig"], pack["part"] = full >> np.uint64(32), np.repeat([h[2] for h in held], count)
            ids = np.frombuffer(b"".join(h[1] for h in held), dtype=[("a", "<u8"), ("b", "<u4")])
            pack["n0"], pack["n1"] = np.repeat(ids["a"], count), np.repeat(ids["b"], count)
            pack, sig, starts = _groups(pack, (full % np.uint64(bins)).astype(np.int64))
            span = np.diff(np.append(starts, sig.size))
            beyond = np.arange(sig.size) - np.repeat(starts, span) > HOT
            beyond &= np.repeat(pack["part"][starts] == 0, span)  # without a set of the band itself nothing can be said here
            at, lead = np.flatnonzero(beyond), np.repeat(starts, span)[beyond]
            over = np.empty(at.size, dtype=_OVER)
            for name, values in (("sig", sig[at]), ("part", pack["part"][at]), ("n0", pack["n0"][at]), ("n1", pack["n1"][at]), ("lead_part", pack["part"][lead]), ("l0", pack["n0"][lead]), ("l1", pack["n1"][lead])):
                over[name] = values
            pack, where = pack[~beyond], (sig[~beyond] >> 32)
            order = np.argsort(where, kind="stable")
            where, pack = where[order], pack[order]
            begin = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            end = np.append(begin[1:], where.size)
            packs = [pack[s:e].tobytes() for s, e in zip(begin, end, strict=True)]
            names = where[begin].tolist()
            for k in range(0, over.size, 20_000):
                packs.append(over[k : k + 20_000].tobytes())
                names.append(-1 - (hash(held[0][1]) + k // 20_000) % bins)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(packs, pa.binary())], ["bin", "pack"])

        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            for items in shingle_sets(batch.column("text"), width):
                if not items[0].size or (node := set_id(items)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                for part, (band, differ) in enumerate(memberships(items[0].size)):
                    sig = signatures(items[0], band)
                    if sig.size <= differ:  # the rare set that fills too few meets all such sets of its band
                        sig = np.append(sig, mixed(np.array([band], dtype=np.uint64) + np.uint64(1 << 60)))
                    held.append((sig, node, part))
                    size += sig.size
            if size > _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bin int, pack binary")


def sig_ids(sig: np.ndarray, bins: int) -> np.ndarray:
    """Signatures as the bins name them: the bin, then 32 bits."""
    return (sig >> np.uint64(32)).astype(np.int64) | ((sig % np.uint64(bins)).astype(np.int64) << 32)


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packs ordered by bin: candidate pairs with the number of signatures they share
    (``sig`` null), and the members of dear signatures (``b`` null).

    Two sets that both belong to the band from above meet in their own band, not here."""
    at, parts = None, []

    def solve() -> pa.RecordBatch:
        pack, sig, starts = _groups(np.frombuffer(b"".join(parts), dtype=_PACK), at)
        part = pack["part"]
        span = np.diff(np.append(starts, sig.size))
        count = np.where(part[starts] == 1, 1, span)  # no set of the band itself
        first, second = [], []
        for k in np.unique(count[(count > 1) & (count <= HOT)]).tolist():
            group = starts[count == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            first.append(group[:, i].ravel())
            second.append(group[:, j].ravel())
        dear = np.repeat(count > HOT, span)
        lead = np.repeat(starts, span)
        star = np.flatnonzero(dear & (np.arange(sig.size) != lead))
        # a star is a candidate that shares no counted signature
        one = np.concatenate([*first, lead[star]]).astype(np.int64)
        two = np.concatenate([*second, star]).astype(np.int64)
        shares = np.append(np.ones(one.size - star.size, dtype=np.int64), np.zeros(star.size, dtype=np.int64))
        fit = part[one] + part[two] <= 1
        one, two, shares = one[fit], two[fit], shares[fit]
        # places in ``pack`` differ from signature to signature: pairs are of distinct (node, part)
        place, at_place = np.unique(np.concatenate([one, two]), return_inverse=True)
        named = pack[place]
        order = np.lexsort((named["part"], named["n1"], named["n0"]))
        named = named[order]
        new = np.append(False, (named["n0"][1:] != named["n0"][:-1]) | (named["n1"][1:] != named["n1"][:-1]) | (named["part"][1:] != named["part"][:-1]))
        same = np.empty(place.size, dtype=np.int64)
        same[order] = np.cumsum(new[: place.size])
        same = same[at_place]
        both = same[: one.size] * np.int64(sig.size + 1) + same[one.size :]
        _, head, owner = np.unique(both, return_index=True, return_inverse=True)
        n = np.bincount(owner, weights=shares, minlength=head.size).astype(np.int64) if both.size else shares
        side = lambda at: (pack["n0"][at], pack["n1"][at], pack["part"][at])
        return _found(side(one[head]), side(two[head]), n, side(dear), sig[dear])

    def hung(pack: bytes) -> pa.RecordBatch:
        over = np.frombuffer(pack, dtype=_OVER)
        fit = over[over["lead_part"] + over["part"] <= 1]
        return _found((fit["l0"], fit["l1"], fit["lead_part"]), (fit["n0"], fit["n1"], fit["part"]), np.zeros(fit.size, dtype=np.int64), (over["n0"], over["n1"], over["part"]), over["sig"])

    for batch in batches:
        for where, pack in zip(batch.column("bin").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            if where < 0:
                yield hung(pack)
                continue
            if where != at and parts:
                yield solve()
                parts = []
            at = where
            parts.append(pack)
    if parts:
        yield solve()


def exact_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sets of shingles as sorted numbers, equal within this call where the words are equal."""
    words, cuts = word_numbers(pa.array(texts, pa.binary()), lower=True)
    out, span = words, 1
    while span < width and out.size:
        step = min(span, width - span)
        out = numbered(out[:-step], out[step:])
        span += step
    short: dict[bytes, int] = {}
    found = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= width:
            found.append(np.unique(out[lo : hi - width + 1]))
        else:
            found.append(np.array([-1 - short.setdefault(words[lo:hi].tobytes(), len(short))] if hi > lo else [], dtype=np.int64))
    return found


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``a, b, similar`` of pairs of nodes, by their texts (``node, text``)."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("keys", F.ceil(F.col("n") / PAIRS_PER_KEY).cast("int"))
    named = lambda name: texts.select(F.col("node").alias(name), "text")
    leads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("salt")).join(named("a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    others = pairs.join(counts.select("a", "keys"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("keys")).cast("int")).join(named("b"), "b").select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = b""
        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            texts = [lead, *batch.column("text").to_pylist()]
            sets = exact_sets(texts, width)
            own, similar, pick = sets[0], [], []
            for i, b in enumerate(batch.column("b").to_pylist()):
                items = sets[i + 1]
                if b is None:
                    lead, own = texts[i + 1], items
                    continue
                pick.append(i)
                both = 0 if 5 * min(items.size, own.size) < 4 * max(items.size, own.size) else np.intersect1d(items, own, assume_unique=True).size
                similar.append(both > 0 and 100 * both >= 80 * (items.size + own.size - both))
            part = batch.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similar, pa.bool_())], ["a", "b", "similar"])

    dealt = leads.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a binary, b binary, similar boolean")


def allocate(lack: int, dear: list[tuple[int, int]], wide: set[int]) -> tuple[list[int], list[int]]:
    """Signatures to agree on whole, and up to one deletion, that give ``lack`` credits.

    ``dear`` has (sets that share it, signature); a neighbourhood is priced as the sets of
    the dearest signature, since members of other variants of the segment come with it.
    ``wide``: signatures of segments with two shingles or more."""
    dear = sorted(dear)
    price = dear[-1][0] if dear else 0
    whole, near = [], []
    while lack > 0 and dear:
        two = sum(n for n, _ in dear[: min(2, lack)])
        if lack > 1 and two > price and dear[0][1] in wide:
            near.append(dear.pop(0)[1])
            lack -= 2
        else:
            whole.append(dear.pop(0)[1])
            lack -= 1
    return whole, near


def neighbourhood_index(lacking: DataFrame, bins: int, width: int) -> DataFrame:
    """``key, node, deleted, probe`` of sets that lack credits: all their segments
    (``deleted``: without one shingle).  ``probe`` is 1 where the set asks for whole
    agreement, 2 where for agreement up to one deletion, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            owner, keys, deleted, probes = [], [], [], []
            for i, ((items, _), wants) in enumerate(zip(shingle_sets(batch.column("text"), width), batch.column("wants").to_pylist(), strict=True)):
                bands = memberships(items.size)
                for want in wants:
                    band, differ = bands[want["part"]]
                    full, less, seg = neighbourhood(items, band)
                    ids = sig_ids(full, bins)
                    whole, near = allocate(want["lack"], [(d["sets"], d["sig"]) for d in want["dear"]], set(ids[seg].tolist()))
                    ask = np.where(np.isin(ids, near), 2, np.where(np.isin(ids, whole), 1, 0))
                    if full.size <= differ:  # its common signature, too
                        own = mixed(np.array([band], dtype=np.uint64) + np.uint64(1 << 60))
                        full, ask = np.append(full, own), np.append(ask, 1)
                    keys += [full, less]
                    probes += [ask, np.where(ask[seg] == 2, 2, 0)]
                    deleted += [np.zeros(full.size, dtype=bool), np.ones(less.size, dtype=bool)]
                    owner.append(np.full(full.size + less.size, i))
            if not keys:
                continue
            node = batch.column("node").take(pa.array(np.concatenate(owner)))
            arrays = [pa.array(np.concatenate(keys).view(np.int64)), node, pa.array(np.concatenate(deleted)), pa.array(np.concatenate(probes).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "deleted", "probe"])

    return lacking.mapInArrow(run, "key long, node binary, deleted boolean, probe int")


def profiles(lacking: DataFrame, width: int) -> DataFrame:
    """``node, size, sketch`` of sets that lack credits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", _CHUNK_BYTES):
            sets = [s for s, _ in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.size for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], ["node", "size", "sketch"])

    return lacking.select("node", "text").mapInArrow(run, "node binary, size long, sketch binary")


_MEMBER = ("node", "component", "deleted", "probe", "size", "role", "refuted", "sketch")


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """``key`` and rows of each (key, block) that has two rows or more."""
    at, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "bx", "by", *_MEMBER)]
        for key, bx, by, *row in zip(*columns, strict=True):
            if (key, bx, by) != at:
                if len(rows) > 1:
                    yield at[0], rows
                at, rows = (key, bx, by), []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield at[0], rows


def _fitting(rows: list[tuple]) -> Iterator[tuple]:
    """For some asking rows at once: the group's sets and components, both as places in the order of their
    names, the asking rows, those that answer, their distances, and which are smaller partners of other
    components that the asking set has not been refuted with."""
    node, component, deleted, probe, size, role, refuted, sk = zip(*rows, strict=True)
    comp, name = (np.unique(np.array(c, dtype=object), return_inverse=True)[1] for c in (component, node))
    probe, role, deleted, size = np.array(probe), np.array(role), np.array(deleted), np.array(size)
    sk = np.frombuffer(b"".join(sk), dtype=np.uint64).reshape(-1, SKETCH_WORDS)
    asks, offers = np.flatnonzero((probe > 0) & (role & 1 > 0)), np.flatnonzero(role & 2 > 0)
    asks = asks[name[asks] > (name[offers].min() if offers.size else 0)]
    where: dict[bytes, list[int]] = {}
    for k, y in enumerate(offers.tolist()):
        where.setdefault(node[y], []).append(k)
    for lo in range(0, asks.size, 64):
        x = asks[lo : lo + 64]
        apart = np.bitwise_count(sk[x][:, None, :] ^ sk[offers][None]).sum(axis=2, dtype=np.int64)
        total = size[x][:, None] + size[offers][None]
        fit = (comp[x][:, None] != comp[offers][None]) & (name[x][:, None] > name[offers][None]) & (9 * apart <= total) & (9 * np.minimum(size[x][:, None], size[offers][None]) >= 4 * total)
        fit &= ~(deleted[x][:, None] & deleted[offers][None]) & ((probe[x][:, None] == 2) | ~deleted[offers][None])
        for i, p in enumerate(x.tolist()):
            for y in refuted[p] or ():
                fit[i, where.get(y, [])] = False
        yield name, comp, x, offers, apart, fit


def least_forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a least spanning forest over ``n`` points, of edges ordered from the least."""
    label, left, kept = np.arange(n), np.arange(u.size), [np.zeros(0, dtype=np.int64)]
    while True:
        a, b = label[u[left]], label[v[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not left.size:
            return np.sort(np.concatenate(kept))
        best = np.full(n, u.size)
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        own = np.flatnonzero(best < u.size)
        pick = best[own]
        kept.append(np.unique(pick))
        up = np.arange(n)
        up[own] = label[u[pick]] + label[v[pick]] - own
        root = (up[up] == np.arange(n)) & (np.arange(n) < up)  # two that picked the same edge
        up[root] = np.flatnonzero(root)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of index rows ordered by (key, block): the pairs that fit (``key, x, y``); where they are more than
    the group's rows, a least spanning forest of them over its components (``whole`` false)."""

    def solve(rows: list[tuple]) -> tuple[list[bytes], list[bytes], bool]:
        def least(pairs: np.ndarray) -> np.ndarray:
            pairs = pairs[:, np.lexsort((name[pairs[2]], name[pairs[1]], pairs[0]))]
            return pairs[:, least_forest(comp[pairs[1]], comp[pairs[2]], len(rows))]

        pairs, whole = np.zeros((3, 0), dtype=np.int64), True  # distance, asking row, answering row
        for name, comp, x, offers, apart, fit in _fitting(rows):
            i, k = np.nonzero(fit)
            pairs = np.append(pairs, np.stack([apart[i, k], x[i], offers[k]]), axis=1)
            if pairs.shape[1] > len(rows):
                pairs, whole = least(pairs), False
        if not whole:
            pairs = least(pairs)
        return [rows[i][0] for i in pairs[1].tolist()], [rows[i][0] for i in pairs[2].tolist()], whole

    out: list[list] = [[], [], [], []]
    for key, rows in _groups_of(batches):
        x, y, whole = solve(rows)
        for held, more in zip(out, ([key] * len(x), x, y, [whole] * len(x)), strict=True):
            held += more
        if len(out[0]) > 50_000:
            yield _spanned(out)
            out = [[], [], [], []]
    if out[0]:
        yield _spanned(out)


def _spanned(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["key", "x", "y", "whole"])


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of index rows ordered by (key, block): for each asking set its ``ASK`` nearest smaller partners
    of other components that it has not been refuted with (``x, y, apart``; ``cut``: it has more here)."""
    out = []
    for _, rows in _groups_of(batches):
        for _, _, x, offers, apart, fit in _fitting(rows):
            for i, p in enumerate(x.tolist()):
                near = np.flatnonzero(fit[i])
                more = near.size > ASK
                if more:
                    near = near[np.argpartition(apart[i, near], ASK - 1)[:ASK]]
                out += [(rows[p][0], rows[offers[k]][0], int(apart[i, k]), more) for k in near.tolist()]
        if len(out) > 50_000:
            yield _near_rows(out)
            out = []
    if out:
        yield _near_rows(out)


def _near_rows(rows: list[tuple]) -> pa.RecordBatch:
    x, y, apart, cut = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(apart, pa.int64()), pa.array(cut, pa.bool_())], ["x", "y", "apart", "cut"])


def served(every: DataFrame) -> DataFrame:
    """Index rows of keys where one set asks and another answers.  Two sets without a shingle each do not
    meet, so a key needs a whole segment, and such a row is of use where it asks, or a whole one asks for it."""
    asked = every.groupBy("key").agg(F.max("probe").alias("most"), F.max(F.when(~F.col("deleted"), F.col("probe"))).alias("wide"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    asked = asked.where("most > 0 AND wide IS NOT NULL AND lo < hi").select("key", "wide")
    return every.join(asked, "key").where("NOT deleted OR probe > 0 OR wide = 2").drop("wide")


def narrowed(index: DataFrame, still: DataFrame) -> DataFrame:
    """Index rows of the keys by which the sets ``still`` (``node``) ask; others only answer there."""
    own = still.withColumn("asks", F.lit(True))
    keys = index.where("probe > 0").join(own, "node", "left_semi").select("key").distinct()
    rows = index.join(keys, "key", "left_semi").join(own, "node", "left")
    return rows.select(*(F.when(F.col("asks"), F.col(c)).otherwise(0).alias(c) if c == "probe" else F.col(c) for c in index.columns))


def dealt(index: DataFrame, known: DataFrame, labels: DataFrame, refuted: DataFrame) -> DataFrame:
    """Index rows with their sketches (``known``), of keys that still hold two components, by (key, block)."""
    members = _labelled(index, labels, "node", "component")
    torn = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("probe").alias("asked"), F.count(F.lit(1)).alias("n")).where("lo < hi AND asked > 0").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    no = refuted.groupBy("x").agg(F.collect_list("y").alias("refuted")).withColumnRenamed("x", "node")
    held = members.join(torn, "key").join(known, "node").join(no, "node", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    side = lambda x, y, role: F.struct(x.cast("int").alias("bx"), y.cast("int").alias("by"), F.lit(role).alias("role"))
    steps = F.sequence(F.lit(0), F.col("blocks") - 1)
    places = F.when(F.col("blocks") == 1, F.array(side(F.lit(0), F.lit(0), 3))).otherwise(F.concat(F.transform(steps, lambda k: side(F.col("own"), k, 1)), F.transform(steps, lambda k: side(k, F.col("own"), 2))))
    rows = held.withColumn("place", F.explode(places)).select("key", "place.*", "node", "component", "deleted", "probe", "size", "refuted", "sketch")
    return rows.repartition("key", "bx", "by").sortWithinPartitions("key", "bx", "by")


def forests(index: DataFrame, known: DataFrame, labels: DataFrame, refuted: DataFrame) -> DataFrame:
    """``key, x, y, whole``: pairs of each key that fit, or a forest of them."""
    return dealt(index, known, labels, refuted).mapInArrow(spanning, "key long, x binary, y binary, whole boolean")


def unsettled(index: DataFrame, found: DataFrame, no: DataFrame) -> DataFrame:
    """Index rows of the keys whose forest (of ``found``) has a pair that is not similar (``no``: ``x, y``)."""
    return index.join(found.where("NOT whole").join(no, ["x", "y"], "left_semi").select("key").distinct(), "key", "left_semi")


def partners(index: DataFrame, known: DataFrame, labels: DataFrame, refuted: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that asking sets (``b``) have still to be compared with, the nearest few of each;
    ``cut``: there may be more of ``b``."""
    found = dealt(index, known, labels, refuted).mapInArrow(nearest, "x binary, y binary, apart long, cut boolean")
    each = found.groupBy("x", "y").agg(F.min("apart").alias("apart"), F.bool_or("cut").alias("cut")).groupBy("x")
    best = each.agg(F.slice(F.sort_array(F.collect_list(F.struct("apart", "y"))), 1, ASK_ROUND).alias("near"), (F.bool_or("cut") | (F.count(F.lit(1)) > ASK_ROUND)).alias("cut"))
    return best.select(F.explode("near.y").alias("a"), F.col("x").alias("b"), "cut")


def _labelled(table: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return table.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def candidates(docs: DataFrame, nodes: DataFrame, bins: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of nodes (``a, b, n``), and sets that lack credits (``node, wants``:
    for each membership the credits lacking and the dear signatures, by number of sets).

    A pair must share as many signatures as a set fills beyond the differences allowed;
    those of its dear ones that the count left out are granted."""
    packs = packed_signatures(docs, bins, width)
    found = materialise(packs.repartition("bin").sortWithinPartitions("bin").mapInArrow(bucket_rows, _FOUND), "candidates")
    dear = found.where("sig IS NOT NULL").select(F.col("a").alias("node"), F.col("part_a").alias("part"), "sig").distinct()
    load = dear.groupBy("node", "part").agg(F.count(F.lit(1)).alias("dear"))
    spare = nodes.select("node", "size", F.posexplode("spare").alias("part", "spare"))
    needs = spare.join(load, ["node", "part"], "left").select("node", "part", "size", (F.col("spare") + 1 - F.coalesce("dear", F.lit(0))).alias("need"))
    side = lambda x: needs.select(*(F.col(c).alias(f"{c}_{x}") for c in needs.columns))
    a, b = F.least("a", "b"), F.greatest("a", "b")
    shared = found.where("sig IS NULL").select(a.alias("a"), b.alias("b"), F.when(F.col("a") < F.col("b"), F.col("part_a")).otherwise(F.col("part_b")).alias("pa"), F.when(F.col("a") < F.col("b"), F.col("part_b")).otherwise(F.col("part_a")).alias("pb"), "n")
    pairs = (
        shared.where("a <> b").groupBy("a", "b", "pa", "pb").agg(F.sum("n").alias("n"))
        .join(side("a"), (F.col("a") == F.col("node_a")) & (F.col("pa") == F.col("part_a")))
        .join(side("b"), (F.col("b") == F.col("node_b")) & (F.col("pb") == F.col("part_b")))
        .where("n >= need_a AND n >= need_b AND 5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")
        .groupBy("a", "b").agg(F.max("n").alias("n"))
    )
    common = dear.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"))
    lacking = dear.join(needs.where("need < 1"), ["node", "part"]).join(common.hint("merge"), "sig")
    wants = lacking.groupBy("node", "part").agg((1 - F.first("need")).alias("lack"), F.collect_list(F.struct("sets", "sig")).alias("dear"))
    pairs, wants = materialise(pairs, "pairs"), materialise(wants.groupBy("node").agg(F.collect_list(F.struct("part", "lack", "dear")).alias("wants")), "wants")
    dispose(found)
    return pairs, wants


def similar_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, key, n_shingles, component_id`` of every row; ``key`` is 16 bytes of the text's SHA-256."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    bins = 4 * shuffle_width(docs.sparkSession)
    sets = materialise(set_table(docs, width), "sets")
    known = sets.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = materialise(known.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.min("n_shingles").alias("size"), F.first("spare").alias("spare")).select("node", "rep.doc_id", "rep.key", "size", "spare"), "nodes")
    pairs, wants = candidates(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), nodes, bins, width)
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(wants.select("node")).distinct()
    texts = materialise(docs.join(nodes.join(involved, "node", "left_semi").select("doc_id", "key", "node"), ["doc_id", "key"]).select("node", "text"), "texts")

    # each set's likeliest partner first: groups of near copies become one component
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    labels = components(verified(best, texts, width).where("similar").select("a", "b"))
    joined = lambda more: components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    # then every other pair that would join two components
    rest = _labelled(_labelled(pairs, labels, "a", "left_of"), labels, "b", "right_of").where("left_of <> right_of").select("a", "b")
    rest = materialise(rest.join(best, ["a", "b"], "left_anti"), "rest")
    labels = joined(verified(rest, texts, width).where("similar").select("a", "b"))
    # then sets that lack credits, across components
    refuted = docs.sparkSession.createDataFrame([], "x binary, y binary")
    if not wants.isEmpty():
        lacking = materialise(texts.dropDuplicates(["node"]).join(wants, "node"), "lacking")
        known = materialise(profiles(lacking, width), "profiles")
        every = materialise(neighbourhood_index(lacking, bins, width), "every")
        index = materialise(served(every), "index")
        dispose(every, lacking)
        # first what each group needs to become one, so that the asking is for groups where that fails
        first = materialise(forests(index, known, labels, refuted), "forests")
        judged = materialise(verified(first.select(F.col("y").alias("a"), F.col("x").alias("b")).distinct(), texts, width).distinct(), "judged")
        found = judged.where("similar").select("a", "b")
        if not found.isEmpty():
            labels = joined(found)
        refuted = judged.where("NOT similar").selectExpr("b AS x", "a AS y")
        last, index = index, materialise(unsettled(index, first, refuted), "index")
        dispose(last, first)
        while True:
            more = materialise(partners(index, known, labels, refuted), "partners")
            if more.isEmpty():
                break
            judged = materialise(verified(more.select("a", "b"), texts, width).distinct(), "judged")
            found = judged.where("similar").select("a", "b")
            if not found.isEmpty():
                labels = joined(found)
            still = more.where("cut").select(F.col("b").alias("node")).distinct()
            if still.isEmpty():
                break
            refuted = refuted.unionByName(judged.where("NOT similar").selectExpr("b AS x", "a AS y"))
            last, index = index, materialise(narrowed(index, still), "index")
            dispose(last, more)
        dispose(index, more, known)
    dispose(pairs, wants, texts, rest)
    label = _labelled(nodes.select("node", "doc_id"), labels, "node", "component")
    least = label.groupBy("component").agg(F.min("doc_id").alias("least"))
    ids = label.join(least.hint("merge"), "component").select("node", "least")
    # a row's own id counts, too: its set's representative has the least id of all with that set
    return sets.join(ids.hint("merge"), "node", "left").select("doc_id", "key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir)).drop("key")
