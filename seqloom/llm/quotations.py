"""Conversations in reply order without quotes: quoted passages are linked to the messages they come from.

DataFrame functions only. Nothing is gathered beyond one message's own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import drop_written, written

#: A run of quote marks at the start of a line, with or without spaces between them.
QUOTE = "^[ \\\\t]*((?:>[ \\\\t]?)+)"
#: The line that announces a quote, in the languages of the corpus.
ANNOUNCES = "(?i)(wrote|writes|schrieb|a écrit|escribió|original message)\\\\s*:?[ \\\\t-]*$"

#: Words of a passage that are compared at once, across line breaks.
WINDOW = 4
#: Scripts without spaces between words: each character is compared as a word.
SPACELESS = "([\\\\p{IsHan}\\\\p{IsHiragana}\\\\p{IsKatakana}])"


def _level(line: str) -> str:
    return f"length(regexp_replace(regexp_extract({line}, '{QUOTE}', 1), '[^>]', ''))"


def _plain(line: str) -> str:
    """A line as it is compared: no marks, lower case, single spaces."""
    return f"trim(regexp_replace(lower(regexp_replace({line}, '{QUOTE}', '')), '\\\\s+', ' '))"


def _lines(messages: DataFrame) -> DataFrame:
    """Adds `parts`: the message's lines as (level, plain, raw), and `body`: its own text without quotes and their announcements."""
    lines = "transform(split(replace(coalesce(text, ''), '\\r', ''), '\\n'), l -> named_struct('level', {0}, 'plain', {1}, 'raw', l))".format(_level("l"), _plain("l"))
    own = f"filter(parts, (p, i) -> p.level = 0 and not (p.raw rlike '{ANNOUNCES}' and coalesce(element_at(filter(slice(parts, i + 2, 2), q -> q.plain <> '' or q.level > 0), 1).level, 0) > 0))"
    with_parts = messages.withColumn("parts", F.expr(lines))
    return with_parts.withColumn("body", F.expr(f"trim(both '\\n' from regexp_replace(array_join(transform({own}, p -> p.raw), '\\n'), '\\n([ \\\\t]*\\n){{2,}}', '\\n\\n'))"))


def _words(line: str) -> str:
    return f"filter(split(regexp_replace({line}, '{SPACELESS}', ' $1 '), ' +'), w -> w <> '')"


def _units(rows: DataFrame) -> DataFrame:
    """What is compared: (row, place, conv, level, line, word, n, h1, h2) for every line and every word.

    A line (word is null) counts n words. A word has the hash of the window of WINDOW
    words that starts there, which runs over line breaks but not into another
    level; where no window fits the hash is null.
    """
    lines = rows.select("row", "place", "conv", F.expr(f"transform(parts, (p, i) -> named_struct('level', p.level, 'line', i, 'plain', p.plain, 'words', {_words('p.plain')}))").alias("parts"))
    words = lines.select("row", "place", "conv", "parts", F.expr("flatten(transform(parts, p -> transform(p.words, w -> named_struct('level', p.level, 'line', p.line, 'w', w))))").alias("w"))
    fits = " and ".join(f"get(w, j + {k}).level = x.level" for k in range(1, WINDOW))
    text = "concat_ws(' ', " + ", ".join(f"get(w, j + {k}).w" for k in range(WINDOW)) + ")"
    of_words = f"transform(w, (x, j) -> named_struct('level', x.level, 'line', x.line, 'word', j, 'n', 1L, 'text', if({fits}, concat('w ', {text}), null)))"
    of_lines = "transform(parts, p -> named_struct('level', p.level, 'line', p.line, 'word', cast(null as int), 'n', cast(size(p.words) as bigint), 'text', concat('l ', p.plain)))"
    units = words.select("row", "place", "conv", F.explode(F.expr(f"concat({of_lines}, {of_words})")).alias("u")).select("row", "place", "conv", "u.*")
    return units.withColumn("h1", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).withColumn("h2", F.when(F.col("text").isNotNull(), F.hash("text"))).drop("text")


def _part(row: str = "row") -> Column:
    return F.shiftright(row, 33).alias("part")


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """Adds `row`, which rises in this order: rows are dealt by ranges, equal ones too, so no group is one task's."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*(F.col(c) for c in order), F.col("_tie")]
    return df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("row", F.monotonically_increasing_id())


def _places(rows: DataFrame, group: str) -> DataFrame:
    """(row, group, place): the place from 1 of each row of a written _ranged() table within its group."""
    firsts = rows.groupBy(_part(), group).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select("part", group, "_first", before.alias("_before"))
    return rows.select("row", group, _part()).join(firsts, ["part", group]).select("row", group, (F.col("row") - F.col("_first") + F.col("_before") + 1).alias("place"))


def _latest(rows: DataFrame, value: str) -> DataFrame:
    """(row, value): the greatest value up to the row within its conversation, range by range."""
    slim = rows.select("row", "conv", _part(), value)
    carried = slim.groupBy("part", "conv").agg(F.max(value).alias("_v"))
    carried = carried.select("part", "conv", F.max("_v").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("_v"))
    own = slim.withColumn(value, F.max(value).over(W.partitionBy("part", "conv").orderBy("row").rowsBetween(W.unboundedPreceding, 0)))
    return own.join(carried, ["part", "conv"]).select("row", F.coalesce(value, "_v").alias(value))


def _preorder(heads: DataFrame) -> DataFrame:
    """(node, after, depth) of branches (node, parent, at, size) with a parent or child: messages from the branch's start to the conversation's end, and depth.

    The tour that enters and leaves every branch in order is a list; sums to its end are
    found by pointer doubling, so rounds grow with the logarithm of the number of branches.
    """
    children = written(_ranged(heads.where("parent is not null").withColumn("_at", -F.col("at")), "parent", "_at", "node"), "children")
    if children.isEmpty():
        drop_written(children)
        return heads.select("node", F.col("size").alias("after"), F.lit(0).cast("bigint").alias("depth"))
    child = written(children.select("row", "node").join(_places(children, "parent"), "row").select("parent", "place", "node"), "child")
    first = child.where("place = 1").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    sibling = child.select("parent", (F.col("place") - 1).alias("place"), F.col("node").alias("sibling"))
    near = heads.join(first, "node", "left").join(child.select("node", "place"), "node", "left").join(sibling, ["parent", "place"], "left")
    enters = near.select((2 * F.col("node")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("node") + 1).alias("next"), F.col("size").alias("after"), F.lit(1).cast("bigint").alias("d"))
    leaves = near.select((2 * F.col("node") + 1).alias("e"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"), F.lit(0).cast("bigint").alias("after"), F.lit(-1).cast("bigint").alias("d"))
    now = written(enters.unionByName(leaves), "tour")
    drop_written(children, child)
    while not now.where("next is not null").isEmpty():
        far = now.select(F.col("e").alias("next"), F.col("next").alias("_next"), F.col("after").alias("_after"), F.col("d").alias("_d"))
        # what has come to its end is left out of the join: all of it has the same null
        step = now.where("next is not null").join(far, "next").select("e", F.col("_next").alias("next"), (F.col("after") + F.col("_after")).alias("after"), (F.col("d") + F.col("_d")).alias("d"))
        step = written(step.unionByName(now.where("next is null")), "tour")
        drop_written(now)
        now = step
    return now.where("e % 2 = 0").select((F.col("e") / 2).cast("bigint").alias("node"), "after", (-F.col("d")).alias("depth"))


def linked(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) with what they reply to; written.

    Rows: row, conv_id, turn, role, body, n_quoted (quoted lines with words), n_found (those
    found in an earlier message), max_level, place (order in the conversation),
    reply_place, quoted (whether the reply was found by its quotes).

    Quoted lines are taken without their marks; lines of one level that follow each other
    are one passage. Windows of its words, over line breaks, and its lines are
    hashed and joined with those of the own text of the conversation's earlier messages:
    each finds the latest message that holds it. A line is found if it is a line there or
    each of its words lies in a found window; a passage of fewer than WINDOW words is found by whole
    lines alone. The message that most words at the first level come from is the one replied to (ties:
    the latest); without any it is the message before. Equal turns are ordered by role, then text.
    """
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # a null conv_id is a conversation of its own, so keys are compared by a hash that covers nulls
    rows = rows.withColumn("conv", F.xxhash64(F.coalesce("conv_id", F.lit(-1)), F.col("conv_id").isNull()))
    rows = _lines(_ranged(rows, "conv_id", "turn", "role", "text"))
    rows = written(rows.select("row", "conv_id", "conv", "turn", "role", "body", F.expr("filter(parts, p -> p.plain <> '')").alias("parts")), "messages")
    places = written(_places(rows, "conv"), "places")
    keyed = rows.select("row", "conv", "parts")
    quoting = F.expr("exists(parts, p -> p.level > 0)")
    units = _units(keyed.join(keyed.where(quoting).select("conv").distinct(), "conv", "left_semi").join(places.select("row", "place"), "row"))
    quotes = written(units.where("level > 0"), "quotes")
    wanted = quotes.where("h1 is not null").groupBy("row", "place", "conv", "h1", "h2").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    sources = units.where("level = 0").join(wanted.select("conv", "h1", "h2").distinct(), ["conv", "h1", "h2"], "left_semi").select("conv", "h1", "h2", "place").distinct()
    both = sources.select("conv", "h1", "h2", "place", F.lit(None).cast("bigint").alias("row")).unionByName(wanted)
    earlier = W.partitionBy("conv", "h1", "h2").orderBy("place").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("source", F.max(F.when(F.col("row").isNull(), F.col("place"))).over(earlier)).where("row is not null and source is not null")
    at = quotes.join(found.select("row", "h1", "h2", "source"), ["row", "h1", "h2"], "left").select("row", "level", "line", "word", "n", "source")
    covers = W.partitionBy("row", F.col("word").isNull()).orderBy("word").rowsBetween(1 - WINDOW, 0)
    at = written(at.withColumn("covered", F.when(F.col("word").isNotNull(), F.max(F.col("source").isNotNull()).over(covers))), "found")
    lines = at.groupBy("row", "line", "level").agg(F.greatest(F.max(F.when(F.col("word").isNull(), F.col("source").isNotNull())), F.min("covered")).alias("is_found"))
    counts = lines.groupBy("row").agg(F.count(F.lit(1)).alias("n_quoted"), F.count_if("is_found").alias("n_found"), F.max("level").alias("max_level"))
    votes = at.where("source is not null").groupBy("row", "level", "source").agg(F.sum("n").alias("n"))
    per = counts.join(votes.groupBy("row").agg(F.max(F.struct((-F.col("level")).alias("l"), F.col("n").alias("n"), F.col("source").alias("s"))).alias("best")), "row", "left")
    out = rows.join(places.select("row", "place"), "row").join(per, "row", "left").select(
        "row", "conv_id", "conv", "turn", "role", "body", "place",
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("max_level", F.lit(0)).alias("max_level"),
        F.coalesce("best.s", F.when(F.col("place") > 1, F.col("place") - 1)).alias("reply_place"), F.col("best").isNotNull().alias("quoted"),
    )
    out = written(out, "linked")
    drop_written(rows, places, quotes, at)
    return out


def reply_order(messages: DataFrame) -> DataFrame:
    """A row per message, in reply order within its conversation: chat(...) without the hashes' inner columns.

    Columns: conv_id, position (from 1), turn, role, reply_to (turn replied to), depth
    of branches, n_quoted, n_found, max_level, text (own words only), chat (role and text in
    one formatted block). A message comes after the one it replies to and before
    later replies to that one (preorder). Null ids, roles and texts are values of their own;
    messages of nothing but quotes keep an empty text; repeated rows stay; an empty
    table gives no row; other columns are ignored.

    A message that replies to the one before continues its run; only the others start
    branches, and the order of branches takes rounds by the logarithm of their number.
    Messages are numbered and runs followed by ranges, so a long conversation is no single task's.
    """
    found = linked(messages)
    starts = F.coalesce(F.col("reply_place") != F.col("place") - 1, F.lit(True))
    m = found.select("row", "conv", "place", "reply_place", starts.alias("starts")).withColumn("node", F.when(F.col("starts"), F.col("row")))
    of = written(_latest(m, "node"), "branches")
    at = m.select("row", "conv", "place").join(of, "row").select("conv", F.col("place").alias("reply_place"), F.col("node").alias("parent"))
    sizes = of.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    heads = m.where("starts").select("node", "conv", "reply_place").join(at, ["conv", "reply_place"], "left").join(sizes, "node")
    heads = written(heads.select("node", "conv", "parent", F.col("reply_place").alias("at"), "size"), "heads")
    order = _preorder(heads)
    totals = heads.groupBy("conv").agg(F.sum("size").alias("total"))
    begins = heads.select("node", "conv").join(order, "node").join(totals, "conv").select(F.col("node").alias("row"), (F.col("total") - F.col("after") + 1).alias("start"), "depth")
    run = m.select("row", "conv", "place").join(begins, "row", "left").withColumn("run", F.when(F.col("start").isNotNull(), F.struct("place", "start", "depth")))
    run = _latest(run, "run").select("row", F.col("run.place").alias("first"), F.col("run.start").alias("start"), F.col("run.depth").cast("int").alias("depth"))
    turns = found.select("conv", F.col("place").alias("reply_place"), F.col("turn").alias("reply_to"))
    reply = found.where("reply_place is not null").select("row", "conv", "reply_place").join(turns, ["conv", "reply_place"]).select("row", "reply_to")
    out = found.join(run, "row").join(reply, "row", "left").withColumn("position", F.col("start") + F.col("place") - F.col("first"))
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    result = written(out.select("conv_id", "position", "turn", "role", "reply_to", "depth", "n_quoted", "n_found", F.col("max_level").cast("int").alias("max_level"), F.col("body").alias("text"), chat.alias("chat")), "conversations")
    drop_written(found, of, heads, order)
    return result
