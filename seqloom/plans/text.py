"""Registered queries: tokens, word error rate, gloss sentences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.functions.text import token_norm, tokens
from seqloom.operators import gloss as G
from seqloom.operators import scoring as C
from seqloom.plans import scoring as S
from seqloom.session import shared_dir
from seqloom.sources import io
from seqloom.sources import surrogates as V

# Parts of speech given to the event types.
EVENT_LEXICON = {
    "PURCHASE": ("hôm qua", "TIME", "past"),
    "ERROR": ("không", "NEG", None),
    "CLICK": ("đi", "VERB", None),
    "VIEW": ("chợ", "NOUN", None),
    "SIGNUP": ("tôi", "PRON", None),
    "NGÀY-MAI": ("ngày mai", "TIME", "fut"),
    "GÌ": ("gì", "WH", None),
    "VUI": ("vui", "ADJ", None),
}

GLOSS = """case when event_id % 17 = 0 then '__NOSIGN__' when event_id % 13 = 0 then ' Xyz  lạ ' when event_id % 11 = 0 then 'gì'
  when event_id % 19 = 0 then 'Ngày mai' when event_id % 23 = 0 then 'vui' else event_type end"""


def event_glosses(spark, sf):
    return V.table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr("event_id div 5").alias("sentence_id"), F.expr(GLOSS).alias("gloss"))


def turn_pairs(spark, sf):
    """Each conversation turn with the next one, as whole token sequences."""
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("tok"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tok").alias("hyp"))
    return c.withColumnRenamed("tok", "ref").join(nxt, ["conv_id", "turn"])


def token_norm_q(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", token_norm(F.col("text")).alias("norm"))


def edit_ops_q(spark, sf):
    return G.with_edit_ops(turn_pairs(spark, sf)).select("conv_id", "turn", "n_ref", "sub", "dele", "ins")


def wer_per_pair(spark, sf):
    return G.pair_wer(G.with_edit_ops(turn_pairs(spark, sf))).select("conv_id", "turn", "wer")


def wer_corpus(spark, sf):
    return G.corpus_wer(G.with_edit_ops(turn_pairs(spark, sf)))


REPORT = "conv_id bigint, turn bigint, wer double, sub bigint, dele bigint, ins bigint"


def wer_report(spark, sf):
    """One evaluation report, written, and read back with its summary beside each pair."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex[:12]}.json"
    each = G.pair_wer(G.with_edit_ops(turn_pairs(spark, sf))).withColumn("key", F.struct("conv_id", "turn"))
    total = G.corpus_wer(each).withColumn("videos", F.lit(each.count()))
    io.write_report(total, each.select("key", "conv_id", "turn", "wer", "sub", "dele", "ins"), "key", path)
    summary, rows = io.read_report(spark, path, "wer double, sub bigint, dele bigint, ins bigint, ref_words bigint, videos bigint", REPORT)
    whole = summary.select(F.struct(F.col("wer").alias("corpus_wer"), "ref_words", "videos").alias("s")).scalar()
    return rows.withColumn("s", whole).select(*rows.columns, "s.*")


THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def threshold_sweep(spark, sf):
    """WER of accepted predictions against the true labels, per confidence threshold.

    A 'video' is a block of 20 consecutive documents; its reference is the label
    of every test document, its hypothesis the accepted predictions.
    """
    p = C.with_margin(S.letters_run(spark, sf)).withColumn("video", F.expr("clip_id div 20"))
    return G.threshold_sweep(p, THRESHOLDS, "video", "clip_id")


def gloss_lookup(spark, sf):
    t = G.lookup(G.drop_control(event_glosses(spark, sf)), G.lexicon(spark, EVENT_LEXICON))
    return t.select("event_id", F.col("norm").alias("gloss"), "vi", "pos", "tense")


def gloss_sentence(spark, sf):
    return G.translate(event_glosses(spark, sf), G.lexicon(spark, EVENT_LEXICON), ["sentence_id"], "event_id")


# ß is upper-cased to SS, as in the query; DuckDB's own upper() makes it one letter. Its \s lacks the vertical tab.
PAIRS = """tk as (select conv_id, turn, case when t = '' then [] else string_split_regex(t, '[\\s\\x0b]+') end as tok
  from (select conv_id, turn, upper(replace(regexp_replace(text, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'), 'ß', 'ss')) as t from conversations)),
pr as (select a.conv_id, a.turn, a.tok as ref, b.tok as hyp from tk a join tk b on b.conv_id = a.conv_id and b.turn = a.turn + 1)"""

_C, _S = 1 << 40, 1 << 20


def edits_sql(pairs: str, keys: str) -> str:
    """Edit operations of ``pairs(keys, ref, hyp)`` by a row-at-a-time recursion."""
    best = lambda s, d, i: (
        f"case when {s} // {_C} <= {d} // {_C} and {s} // {_C} <= {i} // {_C} then {s} when {d} // {_C} <= {i} // {_C} then {d} else {i} end"
    )
    cell = best("x[1]", "x[2]", f"(acc[len(acc)] + {_C})")
    return f"""dp as (
  select {keys}, ref, hyp, 0 as i, list_transform(range(len(hyp)+1), lambda j: j*{_C}::bigint) as row from {pairs}
  union all
  select {keys}, ref, hyp, i+1, list_reduce(
      list_transform(range(1, len(hyp)+1), lambda j: [row[j::int] + case when ref[i+1] = hyp[j::int] then 0 else {_C + _S} end, row[(j+1)::int] + {_C + 1}]),
      lambda acc, x: list_append(acc, {cell}), [row[1] + {_C + 1}])
  from dp where i < len(ref)),
ed as (select {keys}, len(ref)::int as n_ref, (row[len(row)] // {_S}) % {_S} as sub, row[len(row)] % {_S} as dele,
   row[len(row)] // {_C} - (row[len(row)] // {_S}) % {_S} - row[len(row)] % {_S} as ins from dp where i = len(ref))"""


LEX_SQL = "lex as (select * from (values " + ", ".join(
    f"('{g}', '{v}', '{p}', {'null' if t is None else chr(39) + t + chr(39)})" for g, (v, p, t) in EVENT_LEXICON.items()
) + ") l(gloss, vi, pos, tense))"

TOKENS_SQL = f"""ev as (select event_id, event_id // 5 as sentence_id, user_id, ts, {GLOSS} as raw from events),
tkn as (select ev.*, n as gloss, coalesce(vi, lower(replace(n, '-', ' '))) as vi, coalesce(pos, 'X') as pos, tense
  from (select *, upper(regexp_replace(trim(raw), '\\s+', '-', 'g')) as n from ev) ev left join lex on lex.gloss = n where raw not like '\\_\\_%' escape '\\')"""


def sentence_sql(src: str, key: str, order: str) -> str:
    """Written sentence per key from rows (key, order, vi, pos, tense), relationally."""
    return f"""s0 as (select {key} as k, {order} as o, vi, pos, tense,
    row_number() over (partition by {key} order by case pos when 'TIME' then 0 when 'NEG' then 2 else 1 end, {order}) as rn,
    sum((pos = 'NEG')::int) over (partition by {key} order by {order}) as negno from {src}),
s1 as (select *, min(case when pos in ('VERB','ADJ') then o end) over (partition by k) as anchor from s0 where not (pos = 'NEG' and negno > 1)),
s2 as (select *, row_number() over (partition by k order by case when pos = 'TIME' then 0 else 1 end,
    case when pos = 'NEG' then coalesce(anchor, 9223372036854775807) else o end, case when pos = 'NEG' then 0 else 1 end) as q from s1),
s3 as (select *, lag(pos) over (partition by k order by q) as prev, max((pos = 'VERB')::int) over (partition by k) as has_verb,
    max((pos = 'NEG')::int) over (partition by k) as has_neg, min(case when pos = 'VERB' then q end) over (partition by k) as v1,
    first_value(case when pos = 'TIME' then tense end ignore nulls) over (partition by k order by q rows between unbounded preceding and unbounded following) as tn from s2),
s4 as (select k, string_agg(case when prev in ('NOUN','PRON') and pos = 'NOUN' and has_verb = 0 then 'là ' else '' end
      || case when q = v1 and has_neg = 0 and tn = 'past' then 'đã ' when q = v1 and has_neg = 0 and tn = 'fut' then 'sẽ ' else '' end || vi, ' ' order by q) as t,
    max((pos = 'WH')::int) as wh from s3 group by k),
snt as (select k, upper(t[1]) || t[2:] || case when wh = 1 then '?' else '.' end as sentence from s4)"""


REGISTRY = {
    "token_norm": (
        token_norm_q,
        r"select conv_id, turn, upper(regexp_replace(regexp_replace(replace(text, 'ß', 'ss'), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g')) as norm from conversations",
    ),
    "edit_ops": (edit_ops_q, f"with recursive {PAIRS}, {edits_sql('pr', 'conv_id, turn')} select * from ed"),
    "wer_per_pair": (
        wer_per_pair,
        f"with recursive {PAIRS}, {edits_sql('pr', 'conv_id, turn')} select conv_id, turn, round((sub+dele+ins)/greatest(n_ref, 1), 3) as wer from ed",
    ),
    "wer_corpus": (
        wer_corpus,
        f"""with recursive {PAIRS}, {edits_sql('pr', 'conv_id, turn')} select round(sum(sub+dele+ins)/greatest(sum(n_ref), 1), 4) as wer,
            sum(sub)::bigint as sub, sum(dele)::bigint as dele, sum(ins)::bigint as ins, sum(n_ref)::bigint as ref_words from ed""",
    ),
    "wer_report": (
        wer_report,
        f"""with recursive {PAIRS}, {edits_sql('pr', 'conv_id, turn')} select conv_id, turn, round((sub+dele+ins)/greatest(n_ref, 1), 3) as wer, sub::bigint as sub, dele::bigint as dele, ins::bigint as ins,
            (select round(sum(sub+dele+ins)/greatest(sum(n_ref), 1), 4) from ed) as corpus_wer, (select sum(n_ref)::bigint from ed) as ref_words, (select count(*) from ed) as videos from ed""",
    ),
    "threshold_sweep": (
        threshold_sweep,
        f"""with recursive {S.RUNS}, o as (select clip_id, clip_id // 20 as video, any_value(y) as y, any_value(pred) as pred, max(p) as conf from letters group by clip_id),
            th as (select unnest({THRESHOLDS})::double as threshold),
            sq as (select threshold, video, list(y::varchar order by clip_id) as ref,
              coalesce(list(pred::varchar order by clip_id) filter (conf >= threshold), []) as hyp from o, th group by threshold, video),
            {edits_sql('sq', 'threshold, video')}
            select threshold, round(sum(sub+dele+ins)/greatest(sum(n_ref), 1), 4) as wer,
              sum(sub)::bigint as sub, sum(dele)::bigint as dele, sum(ins)::bigint as ins, sum(n_ref)::bigint as ref_words from ed group by threshold""",
    ),
    "gloss_lookup": (gloss_lookup, f"with {LEX_SQL}, {TOKENS_SQL} select event_id, gloss, vi, pos, tense from tkn"),
    "gloss_sentence": (
        gloss_sentence,
        f"""with {LEX_SQL}, {TOKENS_SQL}, {sentence_sql('tkn', 'sentence_id', 'event_id')}
            select sentence_id, coalesce(sentence, '') as sentence from (select distinct sentence_id from ev) left join snt on k = sentence_id""",
    ),
}
