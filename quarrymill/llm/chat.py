r"""Chat formatting by quotation linking (DataFrame functions only).

A line's quote level is the number of ``>`` before its text.  Passages are normalised (lower
case, blanks and line ends collapsed) and hashed by SHA-256: each line; each run of lines of
one level without a blank line between, so a quotation may be wrapped anew; and the whole
unquoted text of a message.  Quoted passages meet the unquoted ones of earlier turns of the
same conversation, each the latest earlier turn that said it.  A message replies to the turn
that the longest quoted words of its outermost matched level name (ties: the latest), else
to the turn before it.

A message that answers an earlier turn than the one before it opens a branch; those after
it, up to the next such one, carry it on.  Branches hang on the turns they answer.  Messages
are placed in reply order: after a message first what carries its branch on, then the branches
that answer it, by turn; no message comes before the one it answers.  Places of branches are
added up by pointer doubling over written tables, so rounds grow as the logarithm of their depth.

A line said in every turn of a giant conversation, or that conversation itself, may hold any
share of the rows: turns are cut in blocks, totals and last sayings of blocks are carried
over, and only a block is ordered in one task; branches that hang on one are cut in blocks, too.

Defined results: a null text has an empty body; rows without conversation or turn
keep a null ``reply_to`` and ``position``; repeated turns tie, and share position and reply;
a quote that matches nothing, or a part of a line, leaves the message a plain reply; very long
texts are split by lines, each whole; no rows give no rows; extra columns are unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import dispose, materialise

BLOCK_TURNS = 1024
QUOTED = r"^[ \t]*>[> \t]*"
_MARK = r"(?m)^[ \t]*>"


def _level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), r"[ \t]", ""))


def _normal(line):
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, QUOTED, ""), r"[\x20\x09-\x0D]+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, said, words`` of lines, runs of lines and whole unquoted texts.

    Lines are rows: a run begins where the level changes or a line, or the one before, is blank, and
    its number is a running count of beginnings; so a message of any length is read once."""
    texts = messages.select("conv_id", "turn", "text").distinct().withColumn("own", F.sha2("text", 256))
    rows = texts.select("conv_id", "turn", "own", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("conv_id", "turn", "own", "pos", _level(F.col("line")).alias("level"), _normal(F.col("line")).alias("said"))
    order = Window.partitionBy("conv_id", "turn", "own").orderBy("pos")
    begins = F.coalesce((F.lag("level").over(order) != F.col("level")) | (F.lag("said").over(order) == "") | (F.col("said") == ""), F.lit(True))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    text = lambda keep: F.array_join(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "said"))))["said"], " ")
    shown = F.col("said") != ""
    runs = rows.where(shown).groupBy("conv_id", "turn", "own", "run").agg(F.max("level").alias("level"), text(F.lit(True)).alias("said"))
    whole = rows.groupBy("conv_id", "turn", "own").agg(F.lit(0).alias("level"), text(shown & (F.col("level") == 0)).alias("said"))
    found = rows.select("conv_id", "turn", "level", "said").unionByName(runs.select("conv_id", "turn", "level", "said")).unionByName(whole.select("conv_id", "turn", "level", "said"))
    return found.where("said <> ''").distinct().withColumn("words", F.size(F.split("said", " ")).cast("long"))


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, quoted`` of messages whose quoted passages were said before."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    with_quotes = known.where(F.col("text").rlike(_MARK)).select("conv_id").distinct()
    found = passages(known.join(with_quotes, "conv_id", "left_semi"))
    said = found.groupBy("conv_id", "turn", "level", F.sha2("said", 256).alias("hash")).agg(F.max("words").alias("words")).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    plain = F.when(F.col("level") == 0, F.col("turn"))
    blocks = said.groupBy("conv_id", "hash", "block").agg(F.max(plain).alias("last"))
    ahead = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "hash", "block", F.max("last").over(ahead).alias("carried"))
    earlier = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    placed = said.withColumn("here", F.max(plain).over(earlier)).join(carried, ["conv_id", "hash", "block"])
    matched = placed.withColumn("source", F.coalesce("here", "carried")).where("level > 0 AND source IS NOT NULL")
    votes = matched.groupBy("conv_id", "turn", "level", "source").agg(F.sum("words").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "source")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.source").alias("quoted"))


def turn_order(messages: DataFrame, links: DataFrame) -> DataFrame:
    """``conv_id, turn, quoted, position, before, thread``: place in reply order, turn before, and
    the turn that opened the message's branch (null for the conversation's own)."""
    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    turns = turns.join(links, ["conv_id", "turn"], "left").withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.max("last").over(ahead).alias("last"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn")
    placed = turns.join(carried, ["conv_id", "block"]).select(
        "conv_id", "turn", "quoted", "block", (F.col("base") + F.row_number().over(within)).cast("long").alias("rank"), F.coalesce(F.lag("turn").over(within), "last").alias("before")
    )
    # branches: their first turn, carried over blocks as above
    opens = F.when(F.col("quoted") != F.col("before"), F.col("turn"))
    firsts = placed.groupBy("conv_id", "block").agg(F.max(opens).alias("branch"))
    carried = firsts.select("conv_id", "block", F.max("branch").over(ahead).alias("carried"))
    placed = placed.join(carried, ["conv_id", "block"]).withColumn("thread", F.coalesce(F.max(opens).over(within), "carried"))
    placed = materialise(placed.select("conv_id", "turn", "quoted", "rank", "before", "thread"), "turns")
    branches = placed.groupBy("conv_id", "thread").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    heads = placed.where("turn = thread").select("conv_id", "thread", F.col("quoted").alias("at"))
    above = placed.select("conv_id", F.col("turn").alias("at"), F.col("thread").alias("up"))
    bases = branch_bases(branches, heads.join(above, ["conv_id", "at"]))
    bases = bases.select(F.col("conv_id").alias("of"), F.col("thread").alias("own"), "first", "base")
    full = placed.join(bases, (F.col("conv_id") == F.col("of")) & F.col("thread").eqNullSafe(F.col("own")))
    return full.select("conv_id", "turn", "quoted", (F.col("base") + F.col("rank") - F.col("first") + 1).cast("long").alias("position"), "before", "thread")


def branch_bases(branches: DataFrame, hung: DataFrame) -> DataFrame:
    """``conv_id, thread, first, base`` of branches (``conv_id, thread, n, first``; a null thread is the
    conversation's own): the messages placed before each.  ``hung`` says where (``at``) and on which
    branch (``up``) each hangs.

    A branch comes after all of the branch that it hangs on, and after the branches hung there at
    later places, each with all that hangs on it.  So a first doubling of pointers sums up what hangs on
    a branch, a running sum over blocks of places adds up those beside it, and a second doubling adds
    what that comes to along the branches above.  Rows stay as many as branches, however deep."""
    own = hung.join(branches.select("conv_id", "thread", "n"), ["conv_id", "thread"])
    state = materialise(own.select("conv_id", "thread", "at", "up", F.col("up").alias("far"), F.col("n").alias("size")), "sizes")
    while not state.where("far IS NOT NULL").isEmpty():
        gains = state.where("far IS NOT NULL").groupBy("conv_id", F.col("far").alias("thread")).agg(F.sum("size").alias("gain"))
        beyond = state.select("conv_id", F.col("thread").alias("far"), F.col("far").alias("further"))
        moved = state.join(gains, ["conv_id", "thread"], "left").join(beyond, ["conv_id", "far"], "left")
        following = materialise(moved.select("conv_id", "thread", "at", "up", F.col("further").alias("far"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "sizes")
        dispose(state)
        state = following
    # among the branches of one, later places first; sums of blocks of places are carried over
    beside = state.withColumn("block", F.floor(-F.col("at") / BLOCK_TURNS))
    blocks = beside.groupBy("conv_id", "up", "block").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("conv_id", "up").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(F.col("conv_id").alias("c"), F.col("up").alias("u"), F.col("block").alias("b"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("carried"))
    within = Window.partitionBy("conv_id", "up", "block").orderBy(-F.col("at"), "thread").rowsBetween(Window.unboundedPreceding, -1)
    beside = beside.withColumn("here", F.coalesce(F.sum("size").over(within), F.lit(0)))
    beside = beside.join(carried, (F.col("conv_id") == F.col("c")) & F.col("up").eqNullSafe(F.col("u")) & (F.col("block") == F.col("b")))
    parents = branches.select(F.col("conv_id").alias("pc"), F.col("thread").alias("pt"), F.col("n").alias("pn"))
    step = beside.join(parents, (F.col("conv_id") == F.col("pc")) & F.col("up").eqNullSafe(F.col("pt"))).select("conv_id", "thread", "up", (F.col("pn") + F.col("here") + F.col("carried")).alias("base"))
    step = materialise(step, "bases")
    while not step.where("up IS NOT NULL").isEmpty():
        above = step.select("conv_id", F.col("thread").alias("up"), F.col("base").alias("_base"), F.col("up").alias("_up"))
        following = materialise(step.join(above, ["conv_id", "up"], "left").select("conv_id", "thread", F.col("_up").alias("up"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base")), "bases")
        dispose(step)
        step = following
    dispose(state)
    return branches.join(step.select("conv_id", "thread", "base"), ["conv_id", "thread"], "left").select("conv_id", "thread", "first", F.coalesce("base", F.lit(0)).alias("base"))


def chat_format(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, placed in reply order, ready for a chat template."""
    messages = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = turn_order(messages, quote_links(messages)).withColumnsRenamed({"conv_id": "c", "turn": "t"})
    quoted = F.coalesce(F.col("text").rlike(_MARK), F.lit(False))
    lines = F.split("text", "\n")
    parsed = messages.select(
        "conv_id", "turn", "role",
        F.when(quoted, F.array_join(F.filter(lines, lambda x: ~x.rlike(QUOTED)), "\n")).otherwise(F.coalesce("text", F.lit(""))).alias("plain"),
        F.when(quoted, F.size(F.filter(lines, lambda x: x.rlike(QUOTED)))).otherwise(0).cast("long").alias("quoted_lines"),
        F.when(quoted, F.array_max(F.transform(lines, _level))).otherwise(0).cast("long").alias("quote_depth"),
    )
    body = F.btrim("plain", F.lit(" \t\n\x0b\x0c\r"))
    joined = parsed.join(order, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return joined.select(
        "conv_id", "turn", "role", "position",
        F.coalesce("quoted", "before").alias("reply_to"),
        F.when(F.col("quoted").isNotNull(), "quotation").when(F.col("before").isNotNull(), "previous").otherwise("opening").alias("link"),
        "thread", "quoted_lines", "quote_depth", body.alias("body"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), body, F.lit("\n")).alias("rendered"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
l AS (
  SELECT rid, conv_id, turn, line, regexp_matches(line, '^[ \t]*>') AS q,
    length(regexp_replace(regexp_extract(line, '^[ \t]*>[> \t]*'), '[ \t]', '', 'g')) AS level,
    lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*>[> \t]*', ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS said, pos
  FROM (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m WHERE text IS NOT NULL)
), marked AS (
  SELECT *, sum(CASE WHEN said = '' OR lag_said = '' OR lag_level <> level THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run
  FROM (SELECT *, lag(said) OVER w AS lag_said, lag(level) OVER w AS lag_level FROM l WINDOW w AS (PARTITION BY rid ORDER BY pos))
), said AS (
  SELECT conv_id, turn, level, said FROM l
  UNION SELECT conv_id, turn, any_value(level), string_agg(said, ' ' ORDER BY pos) FROM marked GROUP BY rid, conv_id, turn, run
  UNION SELECT conv_id, turn, 0, trim(string_agg(said, ' ' ORDER BY pos) FILTER (level = 0 AND said <> ''), ' ') FROM l GROUP BY rid, conv_id, turn
), h AS (
  SELECT conv_id, turn, level, said, length(said) - length(replace(said, ' ', '')) + 1 AS words FROM said WHERE said <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), s AS (
  SELECT *, max(CASE WHEN level = 0 THEN turn END) OVER (PARTITION BY conv_id, said ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM h
), v AS (
  SELECT conv_id, turn, level, source, sum(words) AS n FROM s WHERE level > 0 AND source IS NOT NULL GROUP BY ALL
), k AS (
  SELECT conv_id, turn, arg_max(source, (-level, n, source)) AS quoted FROM v GROUP BY ALL
), ranked AS (
  SELECT conv_id, turn, quoted, row_number() OVER w AS rnk, lag(turn) OVER w AS before
  FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) LEFT JOIN k USING (conv_id, turn)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), branched AS (
  SELECT *, max(CASE WHEN quoted <> before THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS thread FROM ranked
), paths AS (
  SELECT DISTINCT conv_id, CAST(NULL AS BIGINT) AS thread, CAST([] AS BIGINT[][]) AS path FROM branched
  UNION ALL SELECT b.conv_id, b.turn, p.path || [[-b.quoted, b.turn]] FROM paths p JOIN branched o ON o.conv_id = p.conv_id AND o.thread IS NOT DISTINCT FROM p.thread
    JOIN branched b ON b.conv_id = o.conv_id AND b.turn = b.thread AND b.quoted = o.turn
), bases AS (
  SELECT paths.conv_id, paths.thread, coalesce(sum(n) OVER (PARTITION BY paths.conv_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, first
  FROM paths JOIN (SELECT conv_id, thread, count(*) AS n, min(rnk) AS first FROM branched GROUP BY ALL) c ON c.conv_id = paths.conv_id AND c.thread IS NOT DISTINCT FROM paths.thread
), t AS (
  SELECT b.conv_id, b.turn, quoted, before, b.thread, CAST(base + rnk - first + 1 AS BIGINT) AS position FROM branched b JOIN bases a ON a.conv_id = b.conv_id AND a.thread IS NOT DISTINCT FROM b.thread
), p AS (
  SELECT rid, count(*) FILTER (q) AS quoted_lines, max(level) AS quote_depth, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT q), '') AS plain FROM l GROUP BY rid
)
SELECT m.conv_id, m.turn, m.role, position, coalesce(quoted, before) AS reply_to,
  CASE WHEN quoted IS NOT NULL THEN 'quotation' WHEN before IS NOT NULL THEN 'previous' ELSE 'opening' END AS link,
  thread, coalesce(quoted_lines, 0) AS quoted_lines, coalesce(quote_depth, 0) AS quote_depth,
  trim(coalesce(plain, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body,
  concat('<|', coalesce(m.role, 'user'), '|>', chr(10), trim(coalesce(plain, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), chr(10)) AS rendered
FROM m LEFT JOIN t ON m.conv_id = t.conv_id AND m.turn = t.turn LEFT JOIN p USING (rid)
"""
