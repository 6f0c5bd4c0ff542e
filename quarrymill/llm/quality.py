r"""Quality rules with risk-controlled thresholds (DataFrame and SQL functions only).

Base counts come from each text alone.  Beside the fixed base rule, four ratios are
cut where labelled holdouts allow it: for every stratum (``lang``), ratio and cutoff
of a fixed grid, the share of good documents that the cutoff would reject is bounded
by an exact binomial test at a level corrected for all tests made (Bonferroni over
strata x ratios x cutoffs); of the cutoffs that pass, the lowest is used, and a
stratum whose holdout proves nothing rejects nothing.  The four ratios share the
permitted false-rejection rate, so together they keep it.

The holdout is every labelled good document of a stratum that passes the base rule,
counted by plain aggregation; binomial tails are summed in log space, so no size of a
stratum makes them underflow.

Repeated three-word windows are found inside a row: window hashes carry their place
in the low bits, a primitive sort brings equal ones together, and neighbours are
compared word by word, so nothing is exploded or shuffled.

Defined results: null and blank texts have no words and fail the base rule; a null
``lang`` is a stratum of its own, apart from the empty one; repeated rows are judged each
(and rows that share a labelled ``doc_id`` all count as labelled), so ties have no influence;
very long texts are counted whole; an unlabelled or empty label table certifies no cutoff;
no documents give no rows; extra columns are unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import documents, labels, materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
FALSE_REJECTION = 0.05
CONFIDENCE_MISS = 0.05
CUTOFFS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "capital_ratio")

_BLANKS = r"' \t\n\u000b\u000c\r'"
_PLACE = (1 << 24) - 1
# one lambda variable for the words and one for the sorted windows: each is evaluated once
_SAME = (
    "(({y} & ~{m}L) = (x & ~{m}L) AND get(w, cast({y} & {m}L AS int)) = get(w, cast(x & {m}L AS int))"
    " AND get(w, cast({y} & {m}L AS int) + 1) = get(w, cast(x & {m}L AS int) + 1)"
    " AND get(w, cast({y} & {m}L AS int) + 2) = get(w, cast(x & {m}L AS int) + 2))"
)
_WORDS = r"filter(split(body, '[\\x20\\x09-\\x0D]+'), v -> v != '')"


def _repeats(place_mask: int) -> str:
    before, after = (_SAME.format(y=f"get(s, j {d} 1)", m=place_mask) for d in "-+")
    windows = f"transform(if(size(w) < 3, cast(array() AS array<int>), sequence(0, size(w) - 3)), i -> (xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) & ~{place_mask}L) | i)"
    found = f"filter(s, (x, j) -> coalesce({before}, false) OR coalesce({after}, false))"
    covered = "aggregate(transform(p, (v, j) -> coalesce(least(3L, get(p, j + 1) - v), 3L)), 0L, (a, b) -> a + b)"
    return f"get(transform(array(sort_array({windows})), s -> get(transform(array(sort_array(transform({found}, x -> x & {place_mask}L))), p -> {covered}), 0)), 0)"


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` and the counts of every row; no shuffle."""
    body = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    counted = f"get(transform(array({_WORDS}), w -> named_struct('n', cast(size(w) AS long), 'r', if(size(w) <= {_PLACE}, {_repeats(_PLACE)}, {_repeats((1 << 31) - 1)}))), 0)"
    lines = f"get(transform(array(filter(split(body, '\\n'), l -> btrim(l, {_BLANKS}) != '')), l -> named_struct('n', cast(size(l) AS long), 'd', cast(size(l) - size(array_distinct(l)) AS long))), 0)"
    return body.select(
        "doc_id", "lang",
        F.expr(f"cast(char_length(translate(body, {_BLANKS}, '')) AS long)").alias("word_chars"),
        F.expr(f"cast(char_length(body) - char_length(translate(body, '{SYMBOLS}', '')) AS long)").alias("n_symbols"),
        F.expr("cast(char_length(body) - char_length(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS long)").alias("n_capitals"),
        F.expr(counted).alias("c"), F.expr(lines).alias("l"),
    ).select(
        "doc_id", "lang", F.col("c.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"),
        F.col("c.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals",
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    of = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select(
        "*", failed.alias("base_failed"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")).alias("stratum"),
        of("n_symbols", "word_chars").alias("symbol_ratio"), of("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        of("n_repeat_words", "n_words").alias("repeat_ratio"), of("n_capitals", "word_chars").alias("capital_ratio"),
    )


def binomial_tail(share: float) -> str:
    """SQL text of ``P(X <= k)`` of ``n`` trials with ``share``, term by term in log space.

    From ``n * share`` on the tail is a half or more (the median is no larger than the
    mean rounded up), which no level allows: 1 stands for it, and nothing is summed."""
    step = f"a.t + ln((n - i + 1) / i * {share}D / (1 - {share}D))"
    start = f"n * ln(1 - {share}D)"
    added = f"greatest(a.s, {step}) + ln(1 + exp(-abs(a.s - ({step}))))"
    summed = f"aggregate(if(k < 1, cast(array() AS array<long>), sequence(1L, k)), named_struct('t', {start}, 's', {start}), (a, i) -> named_struct('t', {step}, 's', {added}), a -> exp(a.s))"
    return f"if(k >= n * {share}D, 1D, {summed})"


def certified_cutoffs(judged: DataFrame, marks: DataFrame, rate: float = FALSE_REJECTION, miss: float = CONFIDENCE_MISS) -> DataFrame:
    """One row for each stratum: ``stratum`` and, for each ratio, the lowest certified cutoff or null."""
    good = marks.where("quality = 1").select(F.col("doc_id").cast("long")).distinct()
    holdout = judged.where("NOT base_failed").join(good, "doc_id").select("stratum", *RATIOS)
    over = [F.count_if(F.col(r) > c).alias(f"k{i}_{j}") for i, r in enumerate(RATIOS) for j, c in enumerate(CUTOFFS)]
    sums = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over)
    tests = F.array(*(F.struct(F.lit(r).alias("ratio"), F.lit(c).alias("cutoff"), F.col(f"k{i}_{j}").alias("k")) for i, r in enumerate(RATIOS) for j, c in enumerate(CUTOFFS)))
    # strata are counted before the tests unfold them: counted in one step with inline, each would count once a test
    tried = sums.withColumn("strata", F.expr("count(1) OVER ()")).select("stratum", "n", "strata", F.inline(tests))
    passed = tried.withColumn("tail", F.expr(binomial_tail(rate / len(RATIOS)))).where(F.col("tail") <= F.lit(miss) / (F.col("strata") * len(RATIOS) * len(CUTOFFS)))
    return passed.groupBy("stratum").agg(*(F.min(F.when(F.col("ratio") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RATIOS))


def quality_rules(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Counts, ratios, cutoffs and the verdict of every row."""
    judged = with_ratios(materialise(base_counts(docs), "counts"))
    cutoffs = certified_cutoffs(judged, marks)
    rejected = F.lit(False)
    for r in RATIOS:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False))
    return judged.join(cutoffs, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_GRID = ", ".join(str(c) for c in CUTOFFS)
OP10_SQL = rf"""
WITH body AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS body FROM documents
), words AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM body)
), windows AS (
  SELECT rid, pos, word, lead(word) OVER q AS w2, lead(word, 2) OVER q AS w3 FROM words WINDOW q AS (PARTITION BY rid ORDER BY pos)
), twice AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT pos + k) AS r FROM twice, (VALUES (0), (1), (2)) s(k) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM body)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), counts AS (
  SELECT b.rid, b.doc_id, b.stratum,
    CAST(len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    coalesce(l.d, 0) AS n_dup_lines, coalesce(r.r, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM body b LEFT JOIN repeats r USING (rid) LEFT JOIN lines l USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(word_chars, 1)::DOUBLE AS symbol_ratio, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
    n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio, n_capitals / greatest(word_chars, 1)::DOUBLE AS capital_ratio
  FROM counts
), holdout AS (
  SELECT * FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), long AS (
  SELECT stratum, ratio, value FROM holdout UNPIVOT (value FOR ratio IN (symbol_ratio, dup_line_ratio, repeat_ratio, capital_ratio))
), tests AS (
  SELECT stratum, ratio, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
  FROM long, (SELECT unnest([{_GRID}]::DOUBLE[]) AS cutoff) GROUP BY ALL
), passed AS (
  SELECT stratum, ratio, min(cutoff) AS cutoff FROM (
    SELECT *, CASE WHEN k >= n * {FALSE_REJECTION / len(RATIOS)} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({FALSE_REJECTION / len(RATIOS)}) + (n - i) * ln(1 - {FALSE_REJECTION / len(RATIOS)})))) END AS tail
    FROM tests
  ) WHERE tail <= {CONFIDENCE_MISS} / ((SELECT count(DISTINCT stratum) FROM tests) * {len(RATIOS) * len(CUTOFFS)}) GROUP BY ALL
), rejected AS (
  SELECT DISTINCT rid FROM judged j JOIN passed p USING (stratum)
  WHERE CASE ratio WHEN 'symbol_ratio' THEN symbol_ratio WHEN 'dup_line_ratio' THEN dup_line_ratio
    WHEN 'repeat_ratio' THEN repeat_ratio ELSE capital_ratio END > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
FROM judged
"""
