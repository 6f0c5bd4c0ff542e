r"""Source divergence audit: a two-pass vocabulary automaton.

Terms are the runs of letters (``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``, only A-Z lower-cased).

1. *Exact document frequencies.*  Texts are reduced to their terms (ASCII non-letters become one
   delimiter, documents are parted by line ends) and packed by (lang, source) into compressed
   pieces, which are dealt over blocks: a group has as many blocks as its size asks for, so a hot
   source is many tasks.  A block counts in how many of its documents each term stands and sends
   the counts on by shards of the vocabulary, where they are added up; a shard answers each block
   with those of the block's own terms that stand in ``MIN_DOCS`` documents of the language.
2. *Recount.*  Each block puts the kept terms that it holds, padded with the delimiter, into an
   Aho-Corasick automaton and runs it over its texts.  The automaton is as large as the block
   allows, never as large as the vocabulary, and nothing is broadcast.

The recounts are sparse postings ``lang, source, term, n``.  For a pair of sources, a term that
neither has counts a constant, a term that one has depends on its count alone (so a histogram of
counts serves), and only terms that both have need the two counts: for those the difference to
the first two cases is summed over each term's posting list in numpy, in parts of bounded size.

Defined results: null text, lang and source count as ''; a text without terms only makes its group
occur; rows that repeat count each; equal values are ranked by the item's UTF-8; very long texts
are read whole, none is cut between blocks; no rows give no rows; extra columns are unused.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import dispose, documents, materialise
from quarrymill.llm.tokenisation import text_chunks

MIN_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Bytes of reduced text in a piece, held by a task before it writes pieces, and in a block.
PIECE_BYTES, HELD_BYTES, BLOCK_BYTES = 1 << 20, 24 << 20, 12 << 20
#: Bytes of text for which the vocabulary gets one more shard.
SHARD_BYTES = 48 << 20
#: Pairs of postings that are worked on at once.
PAIRS_AT_ONCE = 1 << 20
_REDUCED = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PIECE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("deal", pa.int64()), ("bytes", pa.int64()), ("body", pa.binary())])
PIECE_SCHEMA = "lang string, source string, deal long, bytes long, body binary"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduced texts by group, compressed; ``deal`` is drawn from the content, to deal pieces by."""
    codec = pa.Codec("zstd")
    held: dict[tuple[str, str], list[bytes]] = {}
    size: Counter = Counter()

    def flush(keys: list[tuple[str, str]]) -> pa.RecordBatch:
        rows = []
        for key in keys:
            text = b"\n".join(held.pop(key))
            rows.append((*key, zlib.crc32(text), len(text), codec.compress(text, asbytes=True)))
            size.pop(key)
        return _batch(_PIECE, *zip(*rows, strict=True))

    for batch in batches:
        for part in text_chunks([batch], "text"):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").to_pylist(), strict=True):
                key = (lang or "", source or "")
                reduced = (text or b"").translate(_REDUCED)
                held.setdefault(key, []).append(reduced)
                size[key] += len(reduced) + 1
                if size[key] >= PIECE_BYTES:
                    yield flush([key])
            if size.total() >= HELD_BYTES:
                yield flush(list(held))
    if held:
        yield flush(list(held))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes]]:
    codec = pa.Codec("zstd")
    for lang, source, block, n, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "block", "bytes", "body")), strict=True):
        yield (lang, source, block), codec.decompress(body, n, asbytes=True)


_SHARE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("shard", pa.int64()), ("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64()))])
SHARE_SCHEMA = "lang string, source string, block long, shard long, terms array<binary>, docs array<long>"


def document_frequencies(shards: int):
    """Over pieces ordered by block: each block's terms with their documents, by vocabulary shard."""

    def shares(key: tuple, seen: Counter) -> pa.RecordBatch:
        terms = list(seen)
        shard = np.fromiter((zlib.crc32(t) % shards for t in terms), np.int64, len(terms))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
        at = np.append(cuts, len(terms)).astype(np.int32)
        flat = pa.array(terms, pa.binary()).take(pa.array(order))
        counts = np.fromiter(seen.values(), np.int64, len(terms))[order]
        n = len(cuts)
        lists = (pa.ListArray.from_arrays(pa.array(at), flat), pa.ListArray.from_arrays(pa.array(at), pa.array(counts)))
        return pa.RecordBatch.from_arrays([pa.array([k] * n, f.type) for k, f in zip(key, _SHARE, strict=False)] + [pa.array(shard[order][cuts]), *lists], schema=_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, Counter()
        for batch in batches:
            for key, text in _texts(batch):
                if key != at:
                    if seen:
                        yield shares(at, seen)
                    at, seen = key, Counter()
                for doc in text.split(b"\n"):
                    seen.update(set(doc.split()))
        if seen:
            yield shares(at, seen)

    return run


_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("terms", pa.list_(pa.binary())), ("found", pa.int64())])
KEPT_SCHEMA = "lang string, source string, block long, terms array<binary>, found long"


def kept_terms(least: int):
    """Over shares ordered by (lang, shard): each block's terms that ``least`` documents of the
    language have; ``found``, on one row of a shard, is the number of such terms in it."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        lists = pa.chunked_array([r["terms"] for r in rows]).combine_chunks()
        coded = lists.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, codes, np.concatenate([r["docs"] for r in rows]))
        keep = total >= least
        stays = keep[codes]
        cuts = np.append(0, np.cumsum([len(r["terms"]) for r in rows]))
        left = np.append(0, np.cumsum(stays))[cuts].astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(left), lists.filter(pa.array(stays)))
        found = np.zeros(len(rows), np.int64)
        found[0] = keep.sum()
        heads = [pa.array([r[c] for r in rows], _KEPT.field(c).type) for c in ("lang", "source", "block")]
        return pa.RecordBatch.from_arrays([*heads, terms, pa.array(found)], schema=_KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            heads = [batch.column(c).to_pylist() for c in ("lang", "source", "block", "shard")]
            for i, (lang, source, block, shard) in enumerate(zip(*heads, strict=True)):
                if (lang, shard) != at:
                    if rows:
                        yield solve(rows)
                    at, rows = (lang, shard), []
                rows.append({"lang": lang, "source": source, "block": block, "terms": batch.column("terms")[i].values, "docs": batch.column("docs")[i].values.to_numpy()})
        if rows:
            yield solve(rows)

    return run


_COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])


def recounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over each block's kept terms and then its pieces: occurrences of the kept terms."""
    import ahocorasick

    def counted(key: tuple, terms: list[str], counts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if counts is None or not counts.any():
            return
        own = pa.array(terms, pa.string())
        n = len(own)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), own, pa.array(counts)], schema=_COUNT)

    at, terms, counts, machine = None, [], None, None
    for batch in batches:
        own = batch.column("terms")
        codec = pa.Codec("zstd")
        for i, (lang, source, block, n, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "block", "bytes", "body")), strict=True)):
            if (lang, source, block) != at:
                yield from counted(at, terms, counts)
                at, terms, counts, machine = (lang, source, block), [], None, None
            if body is None:
                terms += own[i].values.cast(pa.string()).to_pylist()
                continue
            if not terms:
                continue
            if machine is None:
                machine, counts = ahocorasick.Automaton(ahocorasick.STORE_INTS), np.zeros(len(terms), np.int64)
                for k, term in enumerate(terms):
                    machine.add_word(f" {term} ", k)
                machine.make_automaton()
            text = " " + codec.decompress(body, n, asbytes=True).decode().replace("\n", " ") + " "
            counts += np.bincount(np.fromiter((k for _, k in machine.iter(text)), np.int64), minlength=len(terms))
    yield from counted(at, terms, counts)


def postings(docs: DataFrame, least: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: ``lang, source, term, n``; the groups ``lang, source``; ``lang, v``."""
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    packed = materialise(docs.mapInArrow(pieces, PIECE_SCHEMA), "pieces")
    groups = materialise(packed.groupBy("lang", "source").agg(F.sum("bytes").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes"), F.sum(F.ceil(F.col("bytes") / BLOCK_BYTES))).first()
    shards, blocks = int((total[0] or 0) // SHARD_BYTES) + 1, int(total[1] or 1)
    # a hot group's pieces are dealt over its blocks; the table of groups has a row for each group
    dealt = packed.join(groups.select("lang", "source", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("long").alias("blocks")), ["lang", "source"])
    dealt = dealt.select("lang", "source", F.pmod(F.col("deal"), F.greatest("blocks", F.lit(1))).alias("block"), "bytes", "body")
    shares = dealt.repartition(blocks, "lang", "source", "block").sortWithinPartitions("lang", "source", "block").mapInArrow(document_frequencies(shards), SHARE_SCHEMA)
    kept = materialise(shares.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(kept_terms(least), KEPT_SCHEMA), "kept")
    both = kept.select("lang", "source", "block", "terms", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("binary").alias("body")).unionByName(dealt.withColumn("terms", F.lit(None).cast("array<binary>")))
    # nulls sort first: a block's terms come before its texts
    counted = both.repartition(blocks, "lang", "source", "block").sortWithinPartitions("lang", "source", "block", F.col("body").isNotNull()).mapInArrow(recounts, "lang string, source string, term string, n long")
    found = materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")
    sizes = materialise(groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.sum("found").alias("v")), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v")), "sizes")
    dispose(packed, kept)
    return found, groups.select("lang", "source"), sizes


def _share(count: str, total: str, v: str):
    """``1 + floor(10^9 (count + 1) / (total + v))``, exact."""
    return F.expr(f"1L + CAST({SCALE}BD * ({count} + 1) AS DECIMAL(38,0)) div CAST({total} + {v} AS DECIMAL(38,0))")


def _gap(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over postings ordered by (lang, term): for each two sources the sum, over terms that both
    have, of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), where p0, q0 are the shares of no count."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    names: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}

    def gap(p, q):
        return (p - q) * (p - q) // q

    def add(group, p, p0, first, size) -> None:
        """Pairs of every posting with all of its term, in parts of bounded size."""
        partners = np.repeat(size, size)
        ends = np.cumsum(partners)
        lo = 0
        while lo < partners.size:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            n = partners[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            within = np.arange(left.size) - np.repeat(np.cumsum(n) - n, n)
            right = np.repeat(np.repeat(first, size)[lo:hi], n) + within
            left, right = left[left != right], right[left != right]
            value = gap(p[left], p[right]) - gap(p[left], p0[right]) - gap(p0[left], p[right]) + gap(p0[left], p0[right])
            key, place = np.unique(group[left] << 32 | group[right], return_inverse=True)
            total = np.zeros(key.size, np.int64)
            np.add.at(total, place, value)
            for k, s in zip(key.tolist(), total.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + s
            lo = hi

    def flush() -> pa.RecordBatch:
        back = list(names)
        rows = [(*back[k >> 32], back[k & 0xFFFFFFFF][1], s) for k, s in sums.items()]
        sums.clear()
        return _batch(schema, *zip(*rows, strict=True))

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        rest = _whole_terms(table, False, names, add)
        if len(sums) > 1 << 19:
            yield flush()
    if rest is not None:
        _whole_terms(rest, True, names, add)
    if sums:
        yield flush()


def _whole_terms(table: pa.Table, last: bool, names: dict, add) -> pa.Table | None:
    """Works on all terms of the table but the last, which may go on; returns that one's rows."""
    lang, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
    source = table.column("source").combine_chunks().dictionary_encode()
    code = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    l, t, s = code(lang), code(term), code(source)
    first = np.flatnonzero(np.append(True, (np.diff(l) != 0) | (np.diff(t) != 0)))
    stop = table.num_rows if last else int(first[-1])
    first = first[first < stop]
    if stop:
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        pair, place = np.unique(l[:stop] * len(sources) + s[:stop], return_inverse=True)
        number = np.array([names.setdefault((langs[x // len(sources)], sources[x % len(sources)]), len(names)) for x in pair.tolist()])
        add(number[place], *(table.column(c).to_numpy()[:stop] for c in ("p", "p0")), first, np.diff(np.append(first, stop)))
    return table.slice(stop) if stop < table.num_rows else None


def audit(docs: DataFrame, least: int = MIN_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of all groups."""
    found, groups, sizes = postings(docs, least)
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    sums = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang")
    sums = sums.select("lang", "source", "v", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("held", F.lit(0)).alias("held"))
    sums = materialise(sums.withColumn("p0", F.when(F.col("v") > 0, _share("0", "total", "v"))), "sums")
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    scored = found.join(sums.select("lang", "source", "v", "total", "p0"), ["lang", "source"]).withColumn("p", _share("n", "total", "v"))

    met = scored.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(pair_corrections, "lang string, source string, item string, value long")
    levels = scored.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    other = sums.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = levels.join(other, "lang").where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _gap("p", "q0")).alias("mine"), F.sum(F.col("k") * _gap("q0", "p")).alias("theirs"))
    pairs = sums.join(sums.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("item_held")), "lang").where("source <> item")
    none = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.expr("(v - held - item_held)") * _gap("p0", "q0")).otherwise(0).alias("value"))
    parts = none.unionByName(met).unionByName(alone.select("lang", "source", "item", F.col("mine").alias("value"))).unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("value")))
    pair = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    whole = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    term = scored.join(whole, ["lang", "term"]).join(langs, "lang").withColumn("q", _share("lang_n", "lang_total", "v")).where("p > q")
    term = term.select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"), F.lit("term").alias("part"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(by))
    term = term.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)
    return pair.unionByName(term).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH words AS (
  SELECT rowid AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM (SELECT row_number() OVER () AS rowid, lang, source, text FROM documents)),
each AS (SELECT doc, lang, source, unnest(found) AS term FROM words),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
grp AS (SELECT DISTINCT lang, source FROM words),
v AS (SELECT g.lang, count(k.term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM each JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM grp g LEFT JOIN cnt c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p
      FROM tot t JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (any_value(tl) + any_value(v.v)) AS q
      FROM p JOIN (SELECT lang, sum(total)::HUGEINT AS tl FROM tot GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, o.source AS item, sum((s.p - o.p) * (s.p - o.p) // o.p) AS value
             FROM p s JOIN p o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
