"""Point-in-time features of sales: a Fenwick sweep over rows in the order they became known.

A row is *known* from ``avail``, the later of its own time ``ts`` and its arrival plus ``DELAY``
(lines: also their shipping).  A probe at ``t`` sees, for a window of d days, what is known at t
and has ``t - d < ts``: a row is seen in ``[avail, ts + d)``.

* Rows of one client with equal ``avail`` and ``ts`` are added up before anything else, so a hot
  client's busy seconds shrink map-side.
* *Item trees.*  A client's lines of one item make intervals ``[avail, ts + d)``.  Their union counts
  one item at a time.  Lines that are seen until the end of the hour in which they become known
  are one interval from first to last activity in that hour (an aggregation, combined before its
  shuffle); what is left, at most a few intervals an hour, is merged in order of time.
  Each interval enters an item tree with the part by which it makes the union longer.
* *Shards.*  Clients of up to ``LARGE_ROWS`` rows stay whole.  A larger client is cut along its own
  time by range partitioning on (client, time), so no client is a hot task.  Each of its rows then
  stands in the shard in which it becomes known and in those in which its windows end.
* *Sweep.*  A shard processes its rows by availability and inserts them into Fenwick trees indexed
  by the rank of ``ts`` from the latest down, one for each window; a probe asks for the sums over
  the suffix ``ts > t - d`` and for the latest click in it.  The trees are kept versioned (a node's
  history is the run of its updates by position in the sweep), so that all clients of a batch are
  swept in numpy together.
* *Carry.*  What became known in earlier shards and is seen to the end of a shard is one constant
  for it: sums of shards, prefixed over a client's shards in two levels.  Rows from earlier shards
  whose window ends in the shard enter its trees at the start.

Only totals that choose the number of partitions reach the driver; nothing is broadcast by order.

Defined results: sales without client or time have no row and no features; a null ``sale_id`` has
crc32 of the empty text and no lines; rows without a time or arrival are never known, but a sale
without arrival still makes labels; lines without shipping or sale do not count; null amounts
and kinds count as 0 and as no purchase; equal clicks count once, equal sales and lines each;
among clicks of one time the largest ``click_id`` is last, null the smallest; windows of empty tables
are 0 and null; extra columns only take part in telling equal clicks apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import dispose, materialise, shuffle_width

SECOND = 1_000_000
DAY = 86_400 * SECOND
HOUR = 3_600 * SECOND
DAYS = (2, 14)
LABEL_DAYS = 7
DELAY = 240 * 60 * SECOND
SPREAD = 259_200
#: Rows beyond which a client is cut along its time.
LARGE_ROWS = 20_000
#: Rows for which the sweep gets one more partition, and rows of small clients swept together.
SHARD_ROWS, SWEEP_ROWS = 250_000, 1 << 16
#: Shards of one client that one task adds up.
BLOCK_SHARDS = 64
#: After every time; before every id.
NEVER, NO_ID = 1 << 61, -(1 << 63)

SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents")
MARK, LEAVES, ENTERS, PROBE = 0, 1, 2, 3
FINAL, OPEN, NET, CARRIED = 0, 1, 2, 3


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(F.col(name))
    gap = f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"((extract(DAY FROM {gap}) * 24L + extract(HOUR FROM {gap})) * 60L + extract(MINUTE FROM {gap})) * {60 * SECOND}L + CAST(extract(SECOND FROM {gap}) * {SECOND} AS BIGINT)")


def cents(name: str) -> Column:
    """``floor(100 x + 0.5)``; nothing for null."""
    return F.coalesce(F.floor(F.col(name) * 100 + 0.5).cast("long"), F.lit(0).cast("long"))


def probes(sales: DataFrame) -> DataFrame:
    """``sale_id, client, t`` of every sale with client and time."""
    at = micros(sales, "sold_at") + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit(""))) % SPREAD * SECOND
    return sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", F.col("client_id").alias("client"), at.alias("t"))


def _event(df: DataFrame, days: tuple[int, ...], **given: Column) -> DataFrame:
    """All columns of an event, nought where nothing is given."""
    names = [*SUMS, *(f"items_{d}" for d in days)]
    zero = F.lit(0).cast("long")
    return df.select("client", "avail", "ts", *(given.get(n, zero).cast("long").alias(n) for n in names), given.get("id", F.lit(None)).cast("long").alias("id"))


def known_lines(sales: DataFrame, lines: DataFrame, longest: int) -> DataFrame:
    """``client, item, avail, ts, n_lines, line_cents`` of lines that a window can see."""
    own = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select("sale_id", micros(lines, "shipped_at").alias("shipped"), F.col("item_id").alias("item"), cents("amount").alias("cents"))
    own = own.groupBy("sale_id", "shipped", "item").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("cents").alias("line_cents"))
    out = own.join(sales.select("sale_id", "client", "avail", "ts"), "sale_id")
    return out.select("client", "item", F.greatest("avail", "shipped").alias("avail"), "ts", "n_lines", "line_cents").where(F.col("avail") < F.col("ts") + longest * DAY)


def item_intervals(lines: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """``client, d, avail, ts``: parts of ``[avail, ts + d)`` that make up each item's union."""
    seen = lines.where("item IS NOT NULL").select("client", "item", "avail", "ts", F.explode(F.array(*map(F.lit, days))).alias("d"))
    span = F.col("d") * F.lit(DAY)
    hour = F.floor(F.col("avail") / HOUR)
    # intervals that reach the end of their hour overlap there; others stand for themselves
    whole = F.col("ts") + span >= (hour + 1) * HOUR
    seen = seen.where(F.col("avail") < F.col("ts") + span).withColumn("lone", F.when(~whole, F.col("avail"))).withColumn("hour", F.when(whole, hour))
    cells = seen.groupBy("client", "item", "d", "hour", "lone").agg(F.min("avail").alias("avail"), F.max("ts").alias("ts"))
    before = F.max("ts").over(Window.partitionBy("client", "item", "d").orderBy("avail").rowsBetween(Window.unboundedPreceding, -1))
    parts = cells.withColumn("before", before).where("before IS NULL OR ts > before")
    return parts.select("client", "d", F.greatest("avail", F.col("before") + span).alias("avail"), "ts")


def events(clicks: DataFrame, sales: DataFrame, lines: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """Everything a probe can see, added up by client, ``avail`` and ``ts``; written."""
    longest = max(days)
    own = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").dropDuplicates()
    own = own.select("click_id", F.col("client_id").alias("client"), F.greatest(micros(own, "ts"), micros(own, "arrived_at") + DELAY).alias("avail"), micros(own, "ts").alias("ts"), "kind", cents("value").alias("cents"))
    own = own.where(F.col("avail") < F.col("ts") + longest * DAY)
    seen = _event(own, days, n_clicks=F.lit(1), n_purchases=F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("int"), click_cents=F.col("cents"), id=F.coalesce("click_id", F.lit(NO_ID)))

    sold = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL")
    sold = sold.select("sale_id", F.col("client_id").alias("client"), micros(sold, "sold_at").alias("ts"), F.coalesce(F.greatest(micros(sold, "sold_at"), F.when(F.col("arrived_at").isNotNull(), micros(sold, "arrived_at") + DELAY)), F.lit(NEVER)).alias("avail"), F.col("arrived_at").isNull().alias("lost"), cents("total").alias("cents"))
    sold = sold.withColumn("avail", F.when(F.col("lost"), F.lit(NEVER)).otherwise(F.col("avail")))
    seen = seen.unionByName(_event(sold, days, n_sales=F.lit(1), sale_cents=F.col("cents")))

    known = materialise(known_lines(sold, lines, longest), "lines")
    seen = seen.unionByName(_event(known, days, n_lines=F.col("n_lines"), line_cents=F.col("line_cents")))
    items = item_intervals(known, days)
    seen = seen.unionByName(_event(items, days, **{f"items_{d}": (F.col("d") == d).cast("int") for d in days}))
    names = [*SUMS, *(f"items_{d}" for d in days)]
    out = materialise(seen.groupBy("client", "avail", "ts").agg(*(F.sum(n).alias(n) for n in names), F.max("id").alias("id")), "events")
    dispose(known)
    return out


def shard_rows(found: DataFrame, asked: DataFrame, large: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """Rows of the sweep: what each shard has to insert, to let go, to mark and to answer."""
    cut = large.select("client", F.lit(1).alias("large"))
    names = [*SUMS, *(f"items_{d}" for d in days), "id"]
    tagged = found.join(cut, "client", "left").withColumn("large", F.coalesce("large", F.lit(0)))
    row = lambda kind, at, d=0: F.struct(F.lit(kind).alias("kind"), F.lit(d).alias("d"), at.alias("at"))
    leaves = [F.when(F.col("avail") < F.col("ts") + d * DAY, row(LEAVES, F.col("ts") + d * DAY, d)) for d in days]
    only_large = F.array(F.when(F.col("n_sales") > 0, row(MARK, F.col("ts"))), *leaves, F.when(F.col("avail") < F.lit(NEVER), row(ENTERS, F.col("avail"))))
    each = F.when(F.col("large") == 1, only_large).otherwise(F.array(row(ENTERS, F.col("avail"))))
    rows = tagged.withColumn("row", F.explode(F.filter(each, lambda x: x.isNotNull()))).select("client", "large", "row.*", "avail", "ts", *names)
    ask = asked.join(cut, "client", "left").select("client", F.coalesce("large", F.lit(0)).alias("large"), F.lit(PROBE).alias("kind"), F.lit(0).alias("d"), F.col("t").alias("at"), F.col("t").alias("avail"), F.col("t").alias("ts"), *(F.lit(0).cast("long").alias(n) for n in names[:-1]), F.col("sale_id").alias("id"))
    return rows.unionByName(ask).withColumn("place", F.when(F.col("large") == 1, F.col("at")).otherwise(0))


def fenwick(group: np.ndarray, ts: np.ndarray, position: np.ndarray, ask_group: np.ndarray, ask_after: np.ndarray, ask_position: np.ndarray):
    """Histories of the nodes of one Fenwick tree a group, by rank of ``ts`` from the latest down.

    Event i is inserted at ``position[i]`` of the sweep; probe j asks at ``ask_position[j]`` for the
    events of its group with ``ts > ask_after[j]``.  Returns ``total(values)``, the sums a probe
    sees, and ``top(ranks)``, the largest positive rank it sees (0: none)."""
    n, m = group.size, ask_group.size
    # one order of events and probes: by group, latest first, a probe before events of its own time
    order = np.lexsort((np.repeat([1, 0], [n, m]), -np.concatenate([ts, ask_after]), np.concatenate([group, ask_group])))
    is_event = order < n
    upto = np.cumsum(is_event)
    groups = int(max(group.max(initial=-1), ask_group.max(initial=-1))) + 1
    size = np.bincount(group, minlength=groups)
    base = np.cumsum(size) - size
    number = np.empty(n + m, np.int64)
    number[order] = upto
    rank, asked = number[:n] - base[group], number[n:] - base[ask_group]
    nodes, places, owners, levels = [], [], [], []
    who, at = np.arange(n), rank.copy()
    while who.size:
        nodes.append(base[group[who]] + at)
        places.append(position[who])
        owners.append(who)
        at = at + (at & -at)
        live = at <= size[group[who]]
        who, at = who[live], at[live]
    updates = sum(x.size for x in nodes)
    who, at = np.flatnonzero(asked > 0), asked[asked > 0]
    while who.size:
        nodes.append(base[ask_group[who]] + at)
        places.append(ask_position[who])
        levels.append(who)
        at = at - (at & -at)
        live = at > 0
        who, at = who[live], at[live]
    node = np.concatenate([np.zeros(0, np.int64), *nodes])
    source = np.concatenate([np.zeros(0, np.int64), *owners])
    place = np.concatenate([np.zeros(0, np.int64), *places])
    history = np.lexsort((place, node))
    ordered = node[history]
    opens = np.flatnonzero(np.append(True, np.diff(ordered) != 0))[: ordered.size]
    start = np.repeat(opens, np.diff(np.append(opens, ordered.size)))
    back = np.empty(history.size, np.int64)
    back[history] = np.arange(history.size)
    asks = back[updates:]

    def gathered(seen: np.ndarray, join) -> np.ndarray:
        out, lo = np.zeros(m, np.int64), 0
        for who in levels:
            out[who] = join(out[who], seen[lo : lo + who.size])
            lo += who.size
        return out

    def total(values: np.ndarray) -> np.ndarray:
        if not values.any() or not asks.size:
            return np.zeros(m, np.int64)
        added = np.zeros(history.size + 1, np.int64)
        added[back[:updates] + 1] = values[source]
        run = np.cumsum(added)
        return gathered(run[asks] - run[start[asks]], np.add)

    def top(ranks: np.ndarray) -> np.ndarray:
        if not ranks.any() or not asks.size:
            return np.zeros(m, np.int64)
        step = np.int64(ranks.max() + 1)
        value = ordered * step
        value[back[:updates]] += ranks[source]
        return gathered(np.maximum.accumulate(value)[asks] - ordered[asks] * step, np.maximum)

    return total, top


def _next_mark(mark_group: np.ndarray, mark: np.ndarray, group: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The first mark of its group after each time; NEVER where there is none."""
    n = mark.size
    order = np.lexsort((np.repeat([0, 1], [n, t.size]), np.concatenate([mark, t]), np.concatenate([mark_group, group])))
    place = np.where(order < n, np.arange(order.size), order.size)
    following = np.minimum.accumulate(place[::-1])[::-1]
    every = np.concatenate([mark_group, group])
    out = np.full(order.size, NEVER, np.int64)
    found = following < order.size
    target = order[following[found]]
    same = every[target] == every[order[found]]
    out[order[found]] = np.where(same, np.concatenate([mark, t])[target], NEVER)
    return out[n:]


SWEPT = ["sale_id", "client", "shard", "state", "d", "t", "next_sale", "click_ts", "click_id", *SUMS, "n_items"]
SWEPT_SCHEMA = ", ".join(f"{n} {'int' if n in ('shard', 'state', 'd') else 'long'}" for n in SWEPT)


def sweep(days: tuple[int, ...]):
    """Over rows ordered by client: answers of small clients (FINAL), and of a shard of a large
    client its answers so far (OPEN), what it adds to later shards (NET) and what of earlier ones
    is in its trees (CARRIED)."""

    def solve(rows: dict[str, np.ndarray], missing: np.ndarray, large: bool, shard: int) -> Iterator[pa.RecordBatch]:
        client, kind, at, avail, ts, ident = (rows[c] for c in ("client", "kind", "at", "avail", "ts", "id"))
        heads = np.append(True, np.diff(client) != 0)
        group = np.cumsum(heads) - 1
        order = np.lexsort((kind, at, group))  # at one time rows enter before probes ask
        position = np.empty(order.size, np.int64)
        position[order] = np.arange(order.size)
        enters, asks = np.flatnonzero(kind == ENTERS), np.flatnonzero(kind == PROBE)
        first = np.minimum.reduceat(at, np.flatnonzero(heads))[group]
        marks = np.flatnonzero(kind == MARK) if large else enters[rows["n_sales"][enters] > 0]
        following = _next_mark(group[marks], ts[marks], group[asks], at[asks])
        clicked = np.flatnonzero((rows["n_clicks"] > 0) & ((kind == ENTERS) | (kind == LEAVES)))
        by_time = clicked[np.lexsort((ident[clicked], ts[clicked]))]
        rank = np.zeros(client.size, np.int64)
        rank[by_time] = np.arange(1, by_time.size + 1)

        def out(state: int, d: int, sale, who, t, following, place, sums) -> pa.RecordBatch:
            n = len(who)
            hit = place > 0
            click = by_time[np.maximum(place, 1) - 1] if by_time.size else np.zeros(n, np.int64)
            columns = [pa.array(sale[0], pa.int64(), mask=sale[1]), pa.array(who), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, state, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(t), pa.array(following)]
            columns += [pa.array(ts[click], pa.int64(), mask=~hit), pa.array(ident[click], pa.int64(), mask=~hit)]
            return pa.RecordBatch.from_arrays(columns + [pa.array(s) for s in sums], SWEPT)

        for d in days:
            fields = [rows[n] for n in (*SUMS, f"items_{d}")]
            lets = np.flatnonzero((kind == LEAVES) & (rows["d"] == d))
            carried = lets[avail[lets] < first[lets]]
            own = enters[avail[enters] < ts[enters] + d * DAY]
            tree = np.concatenate([own, carried])
            total, top = fenwick(group[tree], ts[tree], np.concatenate([position[own], np.full(carried.size, -1)]), group[asks], at[asks] - d * DAY, position[asks])
            yield out(OPEN if large else FINAL, d, (ident[asks], missing[asks]), client[asks], at[asks], following, top(rank[tree]), [total(f[tree]) for f in fields])
            if large:
                one = np.array([client[0]])
                blank = (np.zeros(1, np.int64), np.ones(1, bool))
                mark = np.array([ts[marks].min(initial=NEVER)])
                yield out(NET, d, blank, one, one, mark, np.array([rank[own].max(initial=0)]), [np.array([f[own].sum() - f[lets].sum()]) for f in fields])
                yield out(CARRIED, d, blank, one, one, np.array([NEVER]), np.zeros(1, np.int64), [np.array([f[carried].sum()]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()

        def ready(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            """Whole clients: each large one alone, small ones together."""
            table = pa.concat_tables(parts)
            rows = {c: table.column(c).fill_null(0).to_numpy() for c in table.column_names}
            missing = table.column("id").is_null().to_numpy()
            cuts = np.flatnonzero(np.append(True, np.diff(rows["client"]) != 0))
            big = rows["large"][cuts].astype(bool)
            # runs of small clients, and single large ones
            opens = cuts[np.append(True, big[1:] | big[:-1])]
            for lo, hi in zip(opens, np.append(opens[1:], len(missing)), strict=True):
                yield from solve({c: v[lo:hi] for c, v in rows.items()}, missing[lo:hi], bool(rows["large"][lo]), shard)

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            client = table.column("client").to_numpy()
            turns = np.flatnonzero(np.diff(client) != 0) + 1
            if held and client[0] != held[-1].column("client")[-1].as_py():
                turns = np.append(0, turns)
            if not turns.size or sum(t.num_rows for t in held) + int(turns[-1]) < SWEEP_ROWS:
                held.append(table)
                continue
            stop = int(turns[-1])  # the last client may go on
            yield from ready([*held, table.slice(0, stop)])
            held = [table.slice(stop)]
        if held:
            yield from ready(held)

    return run


def carries(swept: DataFrame) -> DataFrame:
    """``client, shard, d``: what a large client's shard gets from those before it (sums and latest
    click) and from those after it (first sale).  Shards are added up in blocks, then blocks."""
    names = [*SUMS, "n_items"]
    net = swept.where(F.col("state") == NET).withColumn("block", F.floor(F.col("shard") / BLOCK_SHARDS))
    net = net.withColumn("click", F.when(F.col("click_ts").isNotNull(), F.struct("click_ts", "click_id"))).select("client", "d", "block", "shard", "next_sale", "click", *names)

    def around(df: DataFrame, keys: list[str], by: str, tag: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(by)
        past, future = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(1, Window.unboundedFollowing)
        return df.select(*keys, by, *(F.coalesce(F.sum(n).over(past), F.lit(0)).alias(f"{tag}{n}") for n in names), F.max("click").over(past).alias(f"{tag}click"), F.min("next_sale").over(future).alias(f"{tag}next"))

    blocks = net.groupBy("client", "d", "block").agg(*(F.sum(n).alias(n) for n in names), F.max("click").alias("click"), F.min("next_sale").alias("next_sale"))
    out = around(net, ["client", "d", "block"], "shard", "in_").join(around(blocks, ["client", "d"], "block", "out_"), ["client", "d", "block"])
    held = swept.where(F.col("state") == CARRIED).select("client", "d", "shard", *(F.col(n).alias(f"held_{n}") for n in names))
    out = out.join(held, ["client", "d", "shard"])
    return out.select("client", "d", "shard", *((F.col(f"in_{n}") + F.col(f"out_{n}") - F.col(f"held_{n}")).alias(f"base_{n}") for n in names), F.greatest("in_click", "out_click").alias("base_click"), F.least("in_next", "out_next").alias("base_next"))


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, days: tuple[int, ...] = DAYS, large_rows: int = LARGE_ROWS, shard_size: int = SHARD_ROWS) -> DataFrame:
    """A row for each sale with client and time and each window of ``days``."""
    spark = sales.sparkSession
    found = events(clicks, sales, lines, days)
    large = materialise(found.groupBy("client").count().where(F.col("count") > large_rows), "large")
    rows = shard_rows(found, probes(sales), large, days)
    width = max(shuffle_width(spark), -(-2 * found.count() // shard_size))
    swept = rows.repartitionByRange(width, "client", "place").sortWithinPartitions("client").drop("place").mapInArrow(sweep(days), SWEPT_SCHEMA)
    swept = materialise(swept, "swept")
    dispose(found)
    names = [*SUMS, "n_items"]
    small = swept.where(F.col("state") == FINAL).select("sale_id", "d", "t", "next_sale", F.struct("click_ts", "click_id").alias("click"), *names)
    # a shard's answers and its one row of carried sums meet in a window, not in a join
    own = swept.where(F.col("state") == OPEN).withColumn("click", F.when(F.col("click_ts").isNotNull(), F.struct("click_ts", "click_id"))).select("client", "shard", "d", "state", "sale_id", "t", "next_sale", "click", *names)
    shard = Window.partitionBy("client", "d", "shard")
    base = carries(swept)
    part = own.unionByName(base, allowMissingColumns=True)
    part = part.withColumns({c: F.max(c).over(shard) for c in base.columns if c.startswith("base_")}).where("state IS NOT NULL")
    # the next sale is in this shard or a later one; the latest click in its trees or before it
    part = part.select("sale_id", "d", "t", F.least("next_sale", "base_next").alias("next_sale"), F.greatest("click", "base_click").alias("click"), *((F.col(n) + F.col(f"base_{n}")).alias(n) for n in names))
    out = small.unionByName(part)
    inside = F.col("click.click_ts") > F.col("t") - F.col("d") * F.lit(DAY)
    last = F.when(inside & (F.col("click.click_id") != NO_ID), F.col("click.click_id"))
    return out.select("sale_id", "d", F.col("t").alias("t_us"), (F.col("next_sale") <= F.col("t") + LABEL_DAYS * DAY).alias("label"), "n_clicks", "n_purchases", "click_cents", last.alias("last_click_id"), "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(*(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("clicks", "sales", "sale_lines")))


OP13_SQL = """
WITH bits AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT range AS i FROM range(256))),
probe AS (
  SELECT sale_id, client_id, epoch_us(sold_at) + 1000000 * (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 259200) AS t
  FROM sales, bits WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
seen AS (
  SELECT client_id, sale_id, epoch_us(sold_at) AS ts, epoch_us(arrived_at) + 14400000000 AS known, coalesce(floor(100 * total + 0.5), 0)::BIGINT AS cents FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
click AS (
  SELECT client_id, click_id, epoch_us(ts) AS ts, epoch_us(arrived_at) + 14400000000 AS known, coalesce(kind = 'purchase', false) AS bought, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents
  FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL),
line AS (
  SELECT s.client_id, s.ts, greatest(s.known, epoch_us(l.shipped_at)) AS known, l.item_id, coalesce(floor(100 * l.amount + 0.5), 0)::BIGINT AS cents
  FROM sale_lines l JOIN seen s USING (sale_id) WHERE l.shipped_at IS NOT NULL AND s.known IS NOT NULL),
wide AS (SELECT rowid AS r, *, t - d * 86400000000 AS since FROM (SELECT row_number() OVER () AS rowid, * FROM probe), (VALUES (2), (14)) AS x(d)),
label AS (SELECT w.r, w.d FROM wide w JOIN seen s ON s.client_id = w.client_id AND s.ts > w.t AND s.ts <= w.t + 604800000000 GROUP BY w.r, w.d),
c AS (SELECT w.r, w.d, count(*) AS n_clicks, count(*) FILTER (bought) AS n_purchases, sum(cents) AS click_cents, arg_max(click_id, (e.ts, click_id)) AS last_click_id
      FROM wide w JOIN click e ON e.client_id = w.client_id AND e.ts > w.since AND e.ts <= w.t AND e.known <= w.t GROUP BY w.r, w.d),
s AS (SELECT w.r, w.d, count(*) AS n_sales, sum(cents) AS sale_cents FROM wide w JOIN seen e ON e.client_id = w.client_id AND e.ts > w.since AND e.ts <= w.t AND e.known <= w.t GROUP BY w.r, w.d),
l AS (SELECT w.r, w.d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(cents) AS line_cents FROM wide w JOIN line e ON e.client_id = w.client_id AND e.ts > w.since AND e.ts <= w.t AND e.known <= w.t GROUP BY w.r, w.d)
SELECT w.sale_id, w.d::INTEGER AS d, w.t::BIGINT AS t_us, label.r IS NOT NULL AS label, coalesce(n_clicks, 0)::BIGINT AS n_clicks, coalesce(n_purchases, 0)::BIGINT AS n_purchases,
       coalesce(click_cents, 0)::BIGINT AS click_cents, last_click_id, coalesce(n_sales, 0)::BIGINT AS n_sales, coalesce(sale_cents, 0)::BIGINT AS sale_cents,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(line_cents, 0)::BIGINT AS line_cents
FROM wide w LEFT JOIN label USING (r, d) LEFT JOIN c USING (r, d) LEFT JOIN s USING (r, d) LEFT JOIN l USING (r, d)
"""
