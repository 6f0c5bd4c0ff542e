"""Style sheets over a table of elements: rules, selectors, the cascade and what is inherited.

An element's ``node_id`` is its place in the document; its descendants follow it up to ``last``.
A selector is matched from the left: each step keeps the elements that fit its compound and stand
in the right relation to one kept before.  For a descendant that is an interval join, which a
running maximum of interval ends answers, since an earlier interval that ends no earlier than a
node holds it; for a child or a sibling it is a join on the parent.  Nothing is walked per document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.relations import climb, running
from quarrymill.scratch import collected, drop, once, written

#: The properties that rules ask for; those that pass to descendants; keywords that ask the parent.
INHERITED = ("fill", "stroke", "stroke-width", "fill-opacity", "stroke-opacity", "color", "visibility")
OWN = ("stop-color", "flood-color", "lighting-color", "display", "opacity", "filter", "mask", "clip-path")
PROPERTIES = (*INHERITED, *OWN)
FROM_PARENT = ("inherit", "unset", "revert", "revert-layer")
#: Stands for ``initial`` until an inherited value has been found.
INITIAL = "\x00initial"
BLANKS = " \t\n\r\f"
#: Nodes of one document that one task compares at a time.
BLOCK = 4096


def declared(block: Column) -> Column:
    """A block of declarations as structs of property, value and importance; the last of a property wins."""
    parts = F.filter(F.split(F.coalesce(block, F.lit("")), ";"), lambda p: p.rlike(r"(?s)^[^:]*[-\w]\s*:\s*\S"))
    name = lambda p: F.lower(F.regexp_extract(p, r"(?s)([-\w]+)\s*:", 1))
    text = lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1), r"\s+", " "))
    mark = r"(?i)\s*!\s*important\s*$"
    said = F.transform(parts, lambda p: F.named_struct(F.lit("prop"), name(p), F.lit("text"), text(p)))
    marked = lambda s: s["text"].contains("!")
    every = F.transform(said, lambda s: F.named_struct(F.lit("prop"), s["prop"], F.lit("value"), F.when(marked(s), F.regexp_replace(s["text"], mark, "")).otherwise(s["text"]), F.lit("important"), marked(s) & s["text"].rlike(mark)))
    # bound by a transform of one, else each declaration would read the block anew
    last = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda later: later["prop"] == x["prop"]))
    return F.get(F.transform(F.array(every), last), 0)


def style_rules(sheets: DataFrame) -> DataFrame:
    """``doc_id, rule, selector, prop, value, important`` of sheets (``doc_id, node_id, text``);
    ``rule`` orders rules as written, one for each selector of a group.

    Comments go; of at-rules only the bodies of print and all media stay.  Braces are rows: a
    brace's level is a running sum, an opening and its closing are neighbours in their level, and
    what an at-rule closes off is a running sum again."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)/\*.*?\*/", ""), r"(?i)@(?:charset|import|namespace)[^;{]*;", "")
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[^{}]*[{}]"), F.lit(0))
    rows = sheets.select("doc_id", F.col("node_id").alias("sheet"), F.posexplode(pieces).alias("at", "piece"))
    rows = rows.withColumn("opens", F.col("piece").endswith("{")).withColumn("body", F.btrim(F.expr("left(piece, length(piece) - 1)"), F.lit(BLANKS)))
    order = Window.partitionBy("doc_id", "sheet").orderBy("at")
    after = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(order)
    rows = rows.withColumn("level", F.when(F.col("opens"), after).otherwise(after + 1))
    head = F.lower("body")
    kept_media = head.startswith("@media") & (head.contains("print") | head.contains("all"))
    rows = rows.withColumn("shut", F.when(F.col("opens") & head.startswith("@") & ~kept_media, 1).otherwise(0))
    pairs = Window.partitionBy("doc_id", "sheet", "level").orderBy("at")
    change = F.when(F.col("opens"), F.col("shut")).otherwise(-F.coalesce(F.lag("shut").over(pairs), F.lit(0)))
    rows = rows.withColumn("change", change)
    rows = rows.withColumn("inside", F.sum("change").over(order)).withColumn("head", F.lag("body").over(order)).withColumn("after_open", F.lag("opens").over(order))
    blocks = rows.where(~F.col("opens") & F.col("after_open") & (F.col("inside") == 0) & (F.col("change") == 0) & ~F.col("head").startswith("@"))
    each = blocks.select("doc_id", "sheet", "at", F.posexplode(F.split("head", ",")).alias("turn", "selector"), declared(F.col("body")).alias("found"))
    return each.select("doc_id", F.struct("sheet", "at", "turn").alias("rule"), F.btrim("selector", F.lit(BLANKS)).alias("selector"), F.explode("found").alias("x")).select("doc_id", "rule", "selector", "x.*")


def selector_steps(rules: DataFrame, combinators: str = " ") -> DataFrame:
    """``doc_id, rule, step, steps, combinator, tag, id, classes, ids_n, classes_n, tags_n`` of
    selectors made of tags, classes and ids, joined by the given combinators (of ``>``, ``+``,
    ``~`` and the blank).  Selectors with anything else are left out, not guessed at."""
    odd = "".join(c for c in ">+~" if c not in combinators)
    text = F.regexp_replace(F.regexp_replace(F.trim("selector"), r"\s*([>+~])\s*", "$1"), r"\s+", " ")
    parts = rules.select("doc_id", "rule", text.alias("selector")).distinct().where(~F.col("selector").rlike(rf"[\[\]:{odd}]") & (F.col("selector") != ""))
    steps = parts.select("doc_id", "rule", F.posexplode(F.regexp_extract_all("selector", F.lit(r"[ >+~]?[^ >+~]+"), F.lit(0))).alias("step", "part"))
    name = lambda mark: F.transform(F.regexp_extract_all("part", F.lit(rf"{mark}([-\w]+)"), F.lit(1)), lambda x: F.lower(x))
    steps = steps.withColumn("combinator", F.when(F.col("part").rlike("^[ >+~]"), F.substring("part", 1, 1)).otherwise(" "))
    steps = steps.withColumns({"tag": F.get(name(r"(?<![.#\w-])"), 0), "id": F.element_at(F.concat(F.array(F.lit(None).cast("string")), name("#")), -1), "classes": F.array_distinct(name(r"\."))})
    whole = Window.partitionBy("doc_id", "rule")
    empty = F.col("tag").isNull() & F.col("id").isNull() & (F.size("classes") == 0)
    one = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    steps = steps.withColumns({"empty": F.max(empty).over(whole), "steps": F.count(F.lit(1)).over(whole), "ids_n": F.sum(one("id")).over(whole), "classes_n": F.sum(F.size("classes")).over(whole), "tags_n": F.sum(one("tag")).over(whole)})
    return steps.where(~F.col("empty")).drop("part", "empty")


def subtrees(elements: DataFrame) -> DataFrame:
    """``doc_id, node_id, parent_id, turn, last``: the last node of each subtree, and the place
    among its siblings.  A node's subtree ends before its next sibling, or where its parent's does."""
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    rows = elements.select("doc_id", "node_id", "parent_id", F.row_number().over(siblings).alias("turn"), (F.lead("node_id").over(siblings) - 1).alias("end"))
    whole = elements.groupBy("doc_id").agg(F.max("node_id").alias("whole"))
    found = climb(rows, {"end": F.coalesce(F.col("end"), F.col("_end"))}, F.col("end").isNull())
    return found.join(whole.hint("merge"), "doc_id").select("doc_id", "node_id", "parent_id", "turn", F.coalesce("end", "whole").alias("last"))


def _fits(steps: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements that fit a compound.  Both sides meet on the rarest thing that the compound names:
    its id, else a class, else its tag."""
    hook = F.coalesce(F.concat(F.lit("#"), "id"), F.concat(F.lit("."), F.get("classes", 0)), F.col("tag"))
    own = F.split(F.lower(F.trim(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")))), r"\s+")
    ident = F.try_element_at("attrs", F.lit("id"))
    table = elements.select("doc_id", "node_id", F.lower("tag").alias("own_tag"), ident.alias("own_id"), own.alias("own_classes"))
    hooks = F.array_compact(F.concat(F.array(F.col("own_tag"), F.concat(F.lit("#"), "own_id")), F.transform(F.array_distinct("own_classes"), lambda c: F.concat(F.lit("."), c))))
    table = table.withColumn("hook", F.explode(hooks))
    met = table.join(steps.withColumn("hook", hook).hint("merge"), ["doc_id", "hook"])
    fits = (F.col("tag").isNull() | (F.col("tag") == F.col("own_tag"))) & (F.col("id").isNull() | (F.col("id") == F.col("own_id"))) & (F.size(F.array_except("classes", "own_classes")) == 0)
    return met.where(fits).select("doc_id", "rule", "step", "steps", "combinator", "ids_n", "classes_n", "tags_n", "node_id")


def selector_matches(rules: DataFrame, elements: DataFrame, combinators: str = " ") -> DataFrame:
    """``doc_id, rule, node_id, ids_n, classes_n, tags_n``: the elements that each rule selects."""
    elements = once(elements, "elements")
    every = written(_fits(selector_steps(rules, combinators), elements), "hooks")
    found = [every.where("step = 0 AND steps = 1")]
    # only selectors of several steps ask where their elements stand
    longest = every.agg(F.max("steps")).first()[0] or 0
    if longest < 2:
        return found[0].select("doc_id", "rule", "node_id", "ids_n", "classes_n", "tags_n")
    with collected() as spent:
        places = subtrees(elements)
    fits = written(places.join(every.where("steps > 1").hint("merge"), ["doc_id", "node_id"]), "fits")
    drop(*spent)
    kept = fits.where("step = 0")
    keys = ["doc_id", "rule"]
    for step in range(1, longest):
        before, now = kept.where("steps > step + 1"), fits.where(F.col("step") == step)
        # an interval that opened before a node and ends no earlier holds it
        marks = before.select(*keys, "node_id", F.lit(0).alias("side"), F.col("last").alias("end")).unionByName(now.where("combinator = ' '").select(*keys, "node_id", F.lit(1).alias("side"), F.lit(None).cast("long").alias("end")))
        reached = running(marks, keys, "node_id", "end", F.max, BLOCK)
        ways = [reached.where("side = 1 AND _end >= node_id").select(*keys, "node_id")]
        if combinators.strip():
            up = before.select(*keys, F.col("node_id").alias("parent_id"))
            ways.append(now.where("combinator = '>'").join(up, [*keys, "parent_id"], "left_semi").select(*keys, "node_id"))
            beside = before.select(*keys, "parent_id", (F.col("turn") + 1).alias("turn"))
            ways.append(now.where("combinator = '+'").join(beside, [*keys, "parent_id", "turn"], "left_semi").select(*keys, "node_id"))
            first = before.groupBy(*keys, "parent_id").agg(F.min("turn").alias("first"))
            ways.append(now.where("combinator = '~'").join(first, [*keys, "parent_id"]).where("turn > first").select(*keys, "node_id"))
        kept = written(now.join(reduce(DataFrame.unionByName, ways).hint("merge"), [*keys, "node_id"], "left_semi"), "matches")
        found.append(kept.where(F.col("steps") == step + 1))
    return reduce(DataFrame.unionByName, [f.select("doc_id", "rule", "node_id", "ids_n", "classes_n", "tags_n") for f in found])


def cascaded(elements: DataFrame, combinators: str = " ", properties: Sequence[str] = PROPERTIES) -> DataFrame:
    """``elements`` with ``style``, a map of ``properties`` to ``value`` and ``source`` (style, css
    or attr): important inline, important rule, inline, rule, attribute; among rules the more
    specific, then the later."""
    elements = once(elements, "elements")
    found = elements.withColumn("own", F.map_from_entries(F.transform(declared(F.try_element_at("attrs", F.lit("style"))), lambda x: F.struct(x["prop"], F.named_struct(F.lit("value"), x["value"], F.lit("important"), x["important"])))))
    if "text" in elements.columns:
        rules = written(style_rules(elements.where(F.lower("tag") == "style")).where(F.col("prop").isin(*properties)), "rules")
        hits = rules.join(selector_matches(rules, elements, combinators).hint("merge"), ["doc_id", "rule"])
        weight = F.struct("important", "ids_n", "classes_n", "tags_n", "rule")
        best = hits.groupBy("doc_id", "node_id", "prop").agg(F.max_by(F.struct("value", "important"), weight).alias("best"))
        css = best.groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("prop", "best"))).alias("css"))  # at most one entry a property
        found = found.join(css.hint("merge"), ["doc_id", "node_id"], "left")
    else:
        found = found.withColumn("css", F.lit(None).cast("map<string,struct<value:string,important:boolean>>"))

    def value(prop: Column) -> Column:
        inline, css, plain = (F.try_element_at(c, prop) for c in ("own", "css", "attrs"))
        say = lambda v, s: F.named_struct(F.lit("value"), v, F.lit("source"), F.lit(s))
        return F.when(inline["important"], say(inline["value"], "style")).when(css["important"], say(css["value"], "css")).when(inline.isNotNull(), say(inline["value"], "style")).when(css.isNotNull(), say(css["value"], "css")).when(plain.isNotNull(), say(plain, "attr"))

    named = [F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("own", "css", "attrs")]
    every = F.transform(F.array_intersect(F.concat(*named), F.array(*map(F.lit, properties))), lambda p: F.named_struct(F.lit("key"), p, F.lit("value"), value(p)))
    entries = F.filter(every, lambda e: e["value"].isNotNull())
    return found.withColumn("style", F.map_from_entries(entries)).drop("own", "css")


def own_value(prop: str) -> Column:
    """The element's own cascaded value."""
    return F.try_element_at("style", F.lit(prop))["value"]


def handed_down(prop: str) -> Column:
    """What an element says of an inherited property: null leaves it to the parent."""
    text = F.lower(F.trim(own_value(prop)))
    return F.when(text.isin(*FROM_PARENT), None).when((text == "initial") | text.startswith("initial "), F.lit(INITIAL)).otherwise(own_value(prop))
