"""Gloss streams to sentences and word error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import edit_ops, sentence, token_norm
from seqloom.operators.ordered_scan import ordered_scan
from seqloom.operators.sentences import SentenceScan

LEXICON_SCHEMA = "gloss string, vi string, pos string, tense string"


def lexicon(spark, entries: dict) -> DataFrame:
    """A lexicon table from gloss: (written form, part of speech, tense); larger ones are files (sources.io.read_lexicon)."""
    return spark.createDataFrame([(g, *e) for g, e in entries.items()], LEXICON_SCHEMA)


def drop_control(tokens: DataFrame, gloss: str = "gloss") -> DataFrame:
    """Removes empty glosses and control labels such as __NOSIGN__."""
    return tokens.filter((F.coalesce(gloss, F.lit("")) != "") & ~F.col(gloss).startswith("__"))


def lookup(tokens: DataFrame, lex: DataFrame, gloss: str = "gloss") -> DataFrame:
    """Adds norm, vi, pos and tense; an unknown gloss is its own lower-case word.

    The lexicon is a dictionary keyed by gloss; Spark broadcasts it when small
    and splits hot glosses (AQE) when it is not.
    """
    t = tokens.drop("vi", "pos", "tense").withColumn("norm", token_norm(F.col(gloss)))
    entry = lex.select(F.col("gloss").alias("norm"), F.struct("vi", "pos", "tense").alias("_e"))
    unknown = F.struct(
        F.lower(F.translate("norm", "-", " ")).alias("vi"), F.lit("X").alias("pos"), F.lit(None).cast("string").alias("tense")
    )
    return t.join(entry, "norm", "left").withColumn("_e", F.coalesce("_e", unknown)).select("*", "_e.vi", "_e.pos", "_e.tense").drop("_e")


def translate(tokens: DataFrame, lex: DataFrame, by: list[str], order: str, insert_tense: bool = True) -> DataFrame:
    """One written sentence per group of gloss rows in ``order``.

    Sentences without a single real gloss come out as ''.
    """
    e = lookup(tokens.select(*by, F.col(order).alias("_ord"), "gloss"), lex)
    real = (F.coalesce("gloss", F.lit("")) != "") & ~F.col("gloss").startswith("__")
    item = F.when(real, F.struct(F.col("_ord").alias("ord"), "vi", "pos", "tense"))
    g = e.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return g.select(*by, sentence(F.col("items"), insert_tense).alias("sentence"))


def sentence_rows(tokens: DataFrame, lex: DataFrame, reset: Column) -> DataFrame:
    """The rows SentenceScan reads: real glosses looked up, with `reset` rows between them; no value is null."""
    t = tokens.withColumn("reset", F.coalesce(reset, F.lit(False)))
    t = t.filter(F.col("reset") | ((F.coalesce("gloss", F.lit("")) != "") & ~F.col("gloss").startswith("__")))
    t = lookup(t.withColumn("gloss", F.coalesce("gloss", F.lit(""))), lex).drop("norm")
    return t.withColumns({c: F.when(F.col("reset"), "").otherwise(F.coalesce(c, F.lit(""))) for c in ("vi", "pos", "tense")})


def sentence_digests(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """After every gloss of a stream the running sentence's words, length, digest and the gloss's place in it.

    ``rows`` come from sentence_rows; the cost of a gloss does not depend on the sentence's length,
    and a stream of any length is spread over tasks.
    """
    return ordered_scan(rows, key, order, SentenceScan()).filter(~F.col("reset")).drop("vi", "pos", "tense", "reset")


def with_edit_ops(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Adds sub, dele, ins and n_ref for pairs of token arrays."""
    e = pairs.withColumn("_e", edit_ops(F.col(ref), F.col(hyp))).withColumn("n_ref", F.size(ref))
    return e.select("*", "_e.sub", "_e.dele", "_e.ins").drop("_e")


def pair_wer(edits: DataFrame) -> DataFrame:
    return edits.withColumn("wer", F.round((F.col("sub") + F.col("dele") + F.col("ins")) / F.greatest(F.col("n_ref"), F.lit(1)), 3))


def corpus_wer(edits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors over reference words, summed over all pairs."""
    return edits.groupBy(*(by or [])).agg(
        F.round(F.sum(F.col("sub") + F.col("dele") + F.col("ins")) / F.greatest(F.sum("n_ref"), F.lit(1)), 4).alias("wer"),
        F.sum("sub").alias("sub"),
        F.sum("dele").alias("dele"),
        F.sum("ins").alias("ins"),
        F.sum("n_ref").alias("ref_words"),
    )


def threshold_sweep(scored: DataFrame, thresholds: list[float], by: str, order: str, y: str = "y", pred: str = "pred", conf: str = "conf") -> DataFrame:
    """corpus_wer of the predictions accepted at each confidence threshold (``conf >= threshold``), per group's label sequence.

    A group's hypothesis changes only at thresholds that part its confidences, so edits are counted once
    for each run of thresholds that accept the same rows, and then summed for all of them.
    """
    grid = sorted(set(thresholds))
    passed = sum((F.col(conf) >= F.lit(t)).cast("int") for t in grid)  # thresholds that accept the row
    row = F.struct(F.col(order).alias("o"), F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("p"), F.coalesce(passed, F.lit(0)).alias("n"))
    groups = scored.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # threshold i starts a run if some row passes i thresholds and no more
    firsts = F.array_sort(F.array_union(F.array(F.lit(0)), F.filter(F.array_distinct(F.col("rows.n")), lambda x: x < len(grid))))
    runs = groups.select(by, "rows", firsts.alias("firsts")).select(by, "rows", "firsts", F.posexplode("firsts").alias("k", "first"))
    to = F.coalesce(F.get("firsts", F.col("k") + 1), F.lit(len(grid)))
    pairs = runs.select("first", to.alias("to"), F.col("rows.y").alias("ref"), F.expr("transform(filter(rows, r -> r.n > first), r -> r.p)").alias("hyp"))
    edits = with_edit_ops(pairs).groupBy("first", "to").agg(*[F.sum(c).alias(c) for c in ("sub", "dele", "ins", "n_ref")])
    each = edits.select("*", F.explode(F.slice(F.array(*[F.lit(t) for t in grid]), F.col("first") + 1, F.col("to") - F.col("first"))).alias("threshold"))
    return corpus_wer(each, ["threshold"])


def false_alarms(emissions: DataFrame, streams: DataFrame) -> DataFrame:
    """Emissions per idle minute; streams has n_frames and fps per idle stream."""
    n = emissions.join(streams.select("stream_id"), "stream_id", "left_semi").agg(F.count("*").alias("emitted"))
    mins = streams.agg((F.sum(F.col("n_frames") / F.col("fps")) / 60.0).alias("minutes"))
    m = mins.withColumn("emitted", n.scalar())
    return m.select("emitted", F.round("minutes", 2).alias("idle_minutes"), F.round(F.col("emitted") / F.greatest(F.col("minutes"), F.lit(1e-6)), 2).alias("false_per_min"))
