"""Joins, duplicates, samples and orders that the record queries are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stitch(left: DataFrame, right: DataFrame, key: str, prefer: str = "right") -> DataFrame:
    """Full outer join by key; of columns on both sides the preferred one's value, else the other's."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    a, b = left.withColumnsRenamed({c: f"{c}__l" for c in shared}), right.withColumnsRenamed({c: f"{c}__r" for c in shared})
    first, second = ("r", "l") if prefer == "right" else ("l", "r")
    out = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), key, "full_outer")
    picked = [F.coalesce(f"{c}__{first}", f"{c}__{second}").alias(c) for c in shared]
    rest = [c for c in out.columns if not c.endswith(("__l", "__r")) and c not in ("_l", "_r")]
    origin = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right").alias("origin")
    return out.select(*rest, *picked, origin)


def graded_and_stale(recorded: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Recorded rows with whether they are listed, and listed rows without a record."""
    names = listed.select(key).distinct().withColumn("on_disk", F.lit(True))
    graded = recorded.join(names, key, "left").withColumn("on_disk", F.coalesce("on_disk", F.lit(False)))
    return graded, listed.join(recorded.select(key), key, "left_anti")


def first_of(*candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """Value and name of the first candidate that is not null."""
    scope = F.when(F.lit(False), "")
    for name, value in candidates:
        scope = scope.when(value.isNotNull(), name)
    return F.coalesce(*(v for _, v in candidates)), scope.otherwise("absent")


def duplicate_groups(df: DataFrame, digest: str, key: str) -> DataFrame:
    """``key, digest, first, n`` of rows whose digest others share: membership, a row for each
    key, so that a digest that many share is no giant row."""
    groups = df.groupBy(digest).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.select(key, digest).join(groups.hint("merge"), digest)


def mark_duplicates(df: DataFrame, digest: str, key: str) -> DataFrame:
    """``duplicate_of``: the first key of the same digest, null for that one.  The first
    keys come from a partial aggregation, so a digest that many rows share is no hot window."""
    firsts = df.groupBy(digest).agg(F.min(key).alias("_first"))
    out = df.join(firsts, digest)
    return out.withColumn("duplicate_of", F.when(F.col(key) != F.col("_first"), F.col("_first"))).drop("_first")


def common_to_all(df: DataFrame, item: str, owner: str) -> DataFrame:
    """Items that every owner has."""
    owners = df.agg(F.count_distinct(owner).alias("_all"))
    return df.groupBy(item).agg(F.count_distinct(owner).alias("owners")).join(F.broadcast(owners), F.col("owners") == F.col("_all")).drop("_all")  # one row


def round_robin(df: DataFrame, strata: list[str], order: list[Column], cap: int) -> DataFrame:
    """Rows taken in turn from each stratum, up to ``cap``."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return ranked.where(F.col("turn") <= cap).orderBy("turn", *strata, *order).limit(cap)


def top_with_rest(df: DataFrame, key: str, order: list[Column], k: int, value: str) -> DataFrame:
    """The first k rows of each key, and one row that counts and sums the others."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    top = ranked.where(F.col("place") <= k).select(key, F.col("place").cast("long").alias("place"), F.col(value).cast("double").alias(value), F.lit(1).cast("long").alias("rows"))
    rest = ranked.where(F.col("place") > k).groupBy(key).agg(F.lit(k + 1).cast("long").alias("place"), F.round(F.sum(value), 2).alias(value), F.count(F.lit(1)).alias("rows"))
    return top.unionByName(rest)


def ranged(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` in one order over all rows, without bringing them together: ``place`` from 1, and
    ``upto_<sum>`` and ``all_<sum>``, the running and whole sums.

    Rows are dealt over ranges of the order, which Spark draws from a sample; a range is a partition of
    a written table, ranges are summed up and carried over, one row each, and a window orders a range."""
    from quarrymill.scratch import written

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    whole = Window.partitionBy()
    carry = totals.select("_range", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)).alias(f"_before_{c}") for c in sums), *(F.sum(f"_sum_{c}").over(whole).alias(f"all_{c}") for c in sums))
    inside = Window.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.join(carry, "_range").withColumns({"place": (F.col("_before") + F.row_number().over(inside)).cast("long"), **{f"upto_{c}": F.col(f"_before_{c}") + F.sum(c).over(upto) for c in sums}})
    return both.drop("_range", "_before", *(f"_before_{c}" for c in sums))


def running_share(df: DataFrame, count: str, order: list[Column]) -> DataFrame:
    """``share, cumulative, rn``: share of the total, running share and place of each group."""
    out = ranged(df, order, [count])
    return out.withColumns({"share": F.col(count) / F.col(f"all_{count}"), "cumulative": F.col(f"upto_{count}") / F.col(f"all_{count}")}).withColumnRenamed("place", "rn").drop(f"all_{count}", f"upto_{count}")


def ordinal_zip(a: Column, b: Column, name: str = "pair") -> Column:
    """Two arrays joined by position."""
    return F.explode(F.arrays_zip(a.alias("left"), b.alias("right"))).alias(name)


def as_of(left: DataFrame, right: DataFrame, key: str, time_left: str, time_right: str, value: str, hours: int = 24) -> DataFrame:
    """Each left row with the latest right value at or before its time (an extension).

    Both sides are ordered once, together, in blocks of ``hours`` (times may be numbers, as seconds): a block's last value is carried to
    the blocks after it, so a key with half of all rows is many tasks.  No pair of rows is made."""
    a = left.select(F.col(key).alias("_k"), F.col(time_left).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(F.col(key).alias("_k"), F.col(time_right).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    moment = F.unix_seconds("_t") if dict(left.dtypes)[time_left] == "timestamp" else F.col("_t").cast("double")
    both = a.unionByName(b).withColumn("_block", F.floor(moment / (3600 * hours)))
    upto = Window.partitionBy("_k", "_block").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy("_k", "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_k", "_block", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = both.withColumn("_last", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1")
    same = inside["_k"].eqNullSafe(carry["_k"]) & inside["_block"].eqNullSafe(carry["_block"])
    return inside.join(carry, same, "left").select("_row.*", F.coalesce("_last", "_carry").alias(value))


def gap_sessions(df: DataFrame, key: str, time: str, gap_seconds: int, hours: int = 24) -> DataFrame:
    """``key, session, n``: rows of a key in sessions that a pause of ``gap_seconds`` ends.

    Rows of one moment are counted first; the moment before, and the sessions begun so far, are
    carried over blocks of ``hours`` (see ``running``), so a hot key is many tasks."""
    block = 3_600_000_000 * hours
    moments = df.where(F.col(time).isNotNull()).groupBy(F.col(key), F.unix_micros(time).alias("us")).agg(F.count(F.lit(1)).alias("n"))
    opened = running(moments, [key], "us", "us", F.max, block)
    opened = opened.withColumn("opens", F.when(F.col("us") - F.col("_us") < gap_seconds * 1_000_000, 0).otherwise(1))
    counted = running(opened.drop("_us"), [key], "us", "opens", F.sum, block)
    return counted.groupBy(key, (F.coalesce("_opens", F.lit(0)) + F.col("opens")).alias("session")).agg(F.sum("n").alias("n"))


def parameter_grid(base: DataFrame, **axes) -> DataFrame:
    """Every combination of the axes' values."""
    for name, values in axes.items():
        base = base.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return base


def distinct_by(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row of each key, the first by the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def comparison_order() -> list[Column]:
    """Hard, verdict, advisory, artwork error; a missing error counts as none."""
    return [F.col("hard").asc(), F.col("verdict_rank").asc(), F.col("advisory").asc(), F.coalesce("mae_art", F.lit(0.0)).asc(), F.col("file").asc()]


def hand_order(key: str) -> list[Column]:
    """Hard, advisory, artwork error; here a missing reading comes last."""
    clamped = F.when(F.col("mae_art").isNotNull(), F.least(F.greatest(F.col("mae_art"), F.lit(0.0)), F.lit(999.999)))
    return [F.col("hard").asc_nulls_last(), F.col("advisory").asc_nulls_last(), clamped.asc_nulls_last(), F.col(key).asc()]


def bench_order(error: str, colours: str, energy: str, name: str) -> list[Column]:
    """Errors last; then fewest colours, least edge energy, name."""
    known = lambda c: F.when(F.col(error), F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0)))
    return [F.coalesce(error, F.lit(False)).asc(), known(colours).asc(), known(energy).asc(), F.col(name).asc()]


def variant_order(passed: str, error: str, advisory: str, name: str) -> list[Column]:
    """Passed, then not passed, by advisories; without a reading, or a faulty one, last."""
    none = F.col(passed).isNull() | F.coalesce(error, F.lit(False))
    return [F.when(none, 2).when(F.col(passed), 0).otherwise(1).asc(), F.when(none, 0).otherwise(F.coalesce(advisory, F.lit(0))).asc(), F.col(name).asc()]


def cell_order(mae: str, nodes: str, name: str) -> list[Column]:
    return [F.col(mae).asc_nulls_last(), F.col(nodes).asc_nulls_last(), F.col(name).asc()]


def weak_images(images: DataFrame, page: str, least: float) -> DataFrame:
    """Images whose lesser resolution is below the least, and the worst one's, for each page."""
    lesser = images.withColumn("_ppi", F.least("x_ppi", "y_ppi")).where(F.col("_ppi") < least)
    return lesser.groupBy(page).agg(F.count(F.lit(1)).alias("weak"), F.min("_ppi").alias("worst"))


def area_slots(counts: DataFrame, image: str, colour: str, n: str, slots: list[int], background: int) -> DataFrame:
    """Heaviest colour to the background, the next ones to the slots in order of area; the
    rest to the slot whose value is nearest, the first on a tie."""
    place = F.row_number().over(Window.partitionBy(image).orderBy(F.col(n).desc(), F.col(colour)))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col(colour) - s).alias("d"), F.lit(i).alias("i"), F.lit(s).cast("long").alias("s")) for i, s in enumerate(slots))))["s"]
    rank = F.col("place") - 1
    return counts.withColumn("place", place.cast("long")).withColumns({
        "slot": F.when(rank == 0, F.lit(background)).when(rank <= len(slots), F.get(F.array(*map(F.lit, slots)), rank.cast("int") - 1)).otherwise(near).cast("long"),
        "why": F.when(rank == 0, "background anchor").when(rank <= len(slots), F.concat(F.lit("area rank "), rank)).otherwise("collapsed onto nearest"),
    })


def next_index(files: DataFrame, run: str, name: str) -> DataFrame:
    """``following``: one more than the highest candidate number among a run's files."""
    number = F.regexp_extract(name, r"candidate_(\d+)", 1)
    return files.groupBy(run).agg((1 + F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0))).alias("following"))


def running(df: DataFrame, keys: list[str], by: str, value: str, f, block: int) -> DataFrame:
    """``df`` with ``_<value>``: ``f`` (sum, max or min) of the values strictly before each row of its keys.

    Rows are cut into blocks of ``by``, a number: a block is summed up, blocks are summed up in order,
    and a row meets its block's carry and the rows before it in its block.  So one key is many tasks."""
    cut = df.withColumn("_block", F.floor(F.col(by) / block))
    past = lambda *part: Window.partitionBy(*part)
    sums = cut.groupBy(*keys, "_block").agg(f(value).alias("_sum"))
    carry = sums.select(*keys, "_block", f("_sum").over(past(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = f(value).over(past(*keys, "_block").orderBy(by).rangeBetween(Window.unboundedPreceding, -1))
    both = cut.withColumn("_inside", inside).join(carry.hint("merge"), [*keys, "_block"])
    return both.withColumn(f"_{value}", f_of_two(f, F.col("_inside"), F.col("_carry"))).drop("_block", "_inside", "_carry")


def f_of_two(f, a: Column, b: Column) -> Column:
    """A sum, maximum or minimum of two, where null counts for nothing."""
    if f is F.sum:
        return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.greatest(a, b) if f is F.max else F.least(a, b)


def climb(nodes: DataFrame, rules: dict[str, Column], open_while: Column, along: Sequence[str] | None = None) -> DataFrame:
    """``nodes`` (``doc_id, node_id, parent_id`` and more; a node is one row) with columns carried down from
    all ancestors.

    Each rule composes a node's column with its ancestors' (``_<name>``), and composition must be
    associative.  Pointers double each round, so rounds grow as the logarithm of the depth; a node
    stops once ``open_while``, over the carried columns, is false for it.  The state between rounds is a
    written table of the carried columns alone; the others join at the end.  Where ``along`` names the
    few others that are wanted, these go along in the state instead, and nothing joins at the end."""
    from quarrymill.scratch import drop, written

    up = lambda df: df.withColumn("_up", F.when(open_while, F.col("_up")))
    own = [c for c in along or () if c not in rules]
    base = nodes if along is not None else written(nodes, "climb")
    state = up(base.select("doc_id", "node_id", *own, *rules, F.col("parent_id").alias("_up")))
    if along is not None:
        state = written(state, "climb")
    while not state.where("_up IS NOT NULL").isEmpty():
        above = state.select("doc_id", F.col("node_id").alias("_up"), *(F.col(n).alias(f"_{n}") for n in rules), F.col("_up").alias("_next"))
        waiting = state.where("_up IS NOT NULL").join(above.hint("merge"), ["doc_id", "_up"], "left")
        moved = waiting.select("doc_id", "node_id", *own, *(rules[c].alias(c) for c in rules), F.col("_next").alias("_up"))
        following = written(up(moved).unionByName(state.where("_up IS NULL")), "climb")
        drop(state)
        state = following
    if along is not None:
        return state.drop("_up")
    carried = state.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_node"), *rules)
    own = base.drop(*rules)
    both = own.join(carried.hint("merge"), own["doc_id"].eqNullSafe(carried["_doc"]) & own["node_id"].eqNullSafe(carried["_node"]))
    return both.select(*nodes.columns)


def nearest_ancestors(elements: DataFrame, props: list[str]) -> DataFrame:
    """Each element's inherited properties: its own, or its nearest ancestor's.

    Pointers double each round, so the rounds grow as the logarithm of the depth; the
    state between rounds is a written table."""
    from quarrymill.scratch import written

    names = [f"v{i}" for i in range(len(props))]
    own = [F.try_element_at("attrs", F.lit(p)).alias(n) for p, n in zip(props, names, strict=True)]
    state = elements.select("doc_id", "node_id", *own, F.col("parent_id").alias("up"))
    lacks = F.lit(False)
    for n in names:
        lacks = lacks | F.col(n).isNull()
    state = written(state.withColumn("up", F.when(lacks, F.col("up"))), "ancestors")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select("doc_id", F.col("node_id").alias("up"), *(F.col(n).alias(f"_{n}") for n in names), F.col("up").alias("_up"))
        joined = state.join(above, ["doc_id", "up"], "left").select("doc_id", "node_id", *(F.coalesce(n, f"_{n}").alias(n) for n in names), F.col("_up").alias("up"))
        state = written(joined.withColumn("up", F.when(lacks, F.col("up"))), "ancestors")
    return state.select("doc_id", "node_id", *(F.col(n).alias(p) for p, n in zip(props, names, strict=True)))


def nearest_ancestor(elements: DataFrame, prop: str) -> DataFrame:
    return nearest_ancestors(elements, [prop])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of links ``a, b``.

    Large and small stars in turn: a node's larger neighbours hang on its smallest, then its smaller
    ones, until nothing moves; rounds grow as the logarithm of the longest path.  Links between rounds
    are a written table, and what moved is told by two digests of it."""
    from quarrymill.scratch import drop, written

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    code = F.xxhash64("u", "v")
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(code), F.sum(F.pmod(code, F.lit(1 << 31)))).first())
    state, before = digest(edges), None
    while state != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        following = written(small, "stars")
        drop(edges)
        edges, before, state = following, state, digest(following)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
