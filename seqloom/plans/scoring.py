"""Registered queries: classification, prediction reports, run comparison."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import layout as L
from seqloom.functions.rand import uniform
from seqloom.operators import evaluation as E
from seqloom.operators import scoring as C
from seqloom.plans import sql
from seqloom.sources import surrogates as V

# The letters whose relative frequencies describe a document.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâçéèêëîïôùûäöüß"
LANGS = ["de", "en", "es", "fr"]


def _r(c: str, digits: int = 5):
    return F.round(c, digits).alias(c)


_PIECE = 1 << 16  # code points counted at once
_SLICE = 1 << 20  # bytes of text that are Python strings at once


def letter_counts(text: str, own: np.ndarray) -> np.ndarray:
    """How often each letter occurs, a piece of the text at a time; own: each code point's place among LETTERS from 1, else 0."""
    counts = np.zeros(len(LETTERS) + 1, np.int64)
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts += np.bincount(own[np.minimum(codes, 512)], minlength=len(counts))
    return counts[1:]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def letter_freq(text: pd.Series) -> pd.Series:
    """Relative frequency of each letter; a null text has none. Memory follows a piece, not a batch or a long text."""
    own = np.zeros(513, np.int64)
    own[[ord(ch) for ch in LETTERS]] = np.arange(1, len(LETTERS) + 1)
    return pd.Series([letter_counts(t, own) / max(len(t), 1) for t in text.fillna("")], index=text.index, dtype=object)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def letter_vectors(text: pa.Array) -> pa.Array:
    """letter_freq of a batch, whose texts become strings a slice at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(size // _SLICE)) + 1).tolist(), len(text)]
    found = [f for a, b in zip(edges, edges[1:]) for f in letter_freq.func(text.slice(a, b - a).to_pandas())]
    flat = np.concatenate([np.zeros(0), *found])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(LETTERS)), pa.array(flat))


def letter_features(spark, sf) -> DataFrame:
    d = V.table(spark, sf, "documents").select("doc_id", "lang", F.lower("text").alias("t"))
    y = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    split = uniform(F.col("doc_id"), "split")
    return d.select(
        F.col("doc_id").alias("clip_id"),
        y.cast("int").alias("y"),
        letter_vectors("t").alias("vec"),
        F.when(uniform(F.col("doc_id"), "fold") < 0.3, "test").otherwise("train").alias("fold"),
        F.when(split < 0.2, "test").otherwise("train").alias("orig_split"),
    )


def vector_features(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("clip_id"),
        F.col("label").alias("y"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.when(uniform(F.col("vec_id"), "fold") < 0.3, "test").otherwise("train").alias("fold"),
        F.when(uniform(F.col("vec_id"), "split") < 0.2, "test").otherwise("train").alias("orig_split"),
    )


def _run(feat: DataFrame, run: str, dims: int, classes: int, scale: float, power: int = 2) -> DataFrame:
    m = C.fit_centroids(feat.filter("fold = 'train'"), dims, classes, scale, power=power)
    t = feat.filter("fold = 'test'")
    return m.transform(t).select("clip_id", F.lit(run).alias("run"), "y", "pred", "prob", "orig_split")


def letters_run(spark, sf, absolute: bool = False) -> DataFrame:
    run = ("letters_l1", 20.0, 1) if absolute else ("letters", 100.0, 2)
    return _run(letter_features(spark, sf), run[0], len(LETTERS), len(LANGS), *run[1:])


def vectors_run(spark, sf, absolute: bool = False) -> DataFrame:
    run = ("vectors_l1", 4.0, 1) if absolute else ("vectors", 40.0, 2)
    return _run(vector_features(spark, sf), run[0], 64, 10, *run[1:])


def all_runs(spark, sf) -> DataFrame:
    runs = [letters_run(spark, sf), letters_run(spark, sf, True), vectors_run(spark, sf), vectors_run(spark, sf, True)]
    return reduce(lambda a, b: a.unionByName(b), runs)


def two_runs(spark, sf) -> DataFrame:
    return letters_run(spark, sf).unionByName(vectors_run(spark, sf))


# Split mode of each run; the last one recorded none.
MODES = {"letters": "provided", "letters_l1": "provided", "vectors": "random"}


def metrics_table(spark, sf) -> DataFrame:
    mode = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    return E.eval_metrics(all_runs(spark, sf)).withColumn("split_mode", F.try_element_at(mode, F.col("run")))


def softmax_scores(spark, sf):
    e = vector_features(spark, sf).withColumn("prob", C.softmax(F.transform("vec", lambda x: x * 20)))
    return e.select("clip_id", F.posexplode_outer("prob").alias("dim", "p")).select("clip_id", "dim", _r("p", 6))


def centroid_classify(spark, sf):
    p = two_runs(spark, sf)
    return p.select("run", "clip_id", "y", "pred", F.posexplode_outer("prob").alias("cls", "p")).select("run", "clip_id", "y", "pred", "cls", _r("p"))


def eval_metrics(spark, sf):
    m = E.eval_metrics(all_runs(spark, sf))
    return m.select("run", "n", _r("acc"), _r("macro_f1"), _r("macro_f1_true"), _r("top5"))


def per_class_report(spark, sf):
    r = E.per_class_report(two_runs(spark, sf))
    return r.select("run", "cls", _r("precision"), _r("recall"), _r("f1"), "support")


def top_confusions(spark, sf):
    return E.top_confusions(vectors_run(spark, sf)).select("run", "actual", "predicted", "n", _r("rate"))


def confidence_curve(spark, sf):
    return E.confidence_curve(two_runs(spark, sf)).select("run", "threshold", _r("coverage"), _r("accuracy"), "n")


def run_compare(spark, sf):
    return E.run_compare(metrics_table(spark, sf))


def best_run(spark, sf):
    return E.best_run(metrics_table(spark, sf)).select("run", _r("macro_f1"))


def ensemble_vote(spark, sf):
    p = vectors_run(spark, sf).unionByName(vectors_run(spark, sf, True))
    m = E.eval_metrics(C.ensemble(p, ["vectors", "vectors_l1"]))
    return m.select("run", "n", _r("acc"), F.round("macro_f1_true", 5).alias("macro_f1"), _r("top5"))


def acc_by_origin(spark, sf):
    return E.acc_by_origin(two_runs(spark, sf)).select("run", "orig_split", "n", _r("acc"))


def confidence_gate(spark, sf):
    p = two_runs(spark, sf).withColumn("name", F.when((F.col("run") == "vectors") & (F.col("pred") == 9), L.NOSIGN).otherwise(F.concat("run", F.col("pred").cast("string"))))
    return C.gate(p, L.GateRules(0.5, 0.15)).select("run", "clip_id", "name", _r("conf"), _r("margin"))


def topn_predictions(spark, sf):
    return C.top_n(two_runs(spark, sf), 3).select("run", "clip_id", "true_rank", "rank", "cls", _r("p"))


_N = len(LETTERS)


def _feat_sql() -> str:
    u = sql.u
    return f"""lf as (
  select doc_id as clip_id, list_position(['de','en','es','fr'], lang) - 1 as y,
    list_transform(range({_N}), lambda i: (length(t) - length(replace(t, substr('{LETTERS}', (i+1)::int, 1), '')))::double / greatest(length(t), 1)) as vec,
    case when {u('doc_id', 'fold')} < 0.3 then 'test' else 'train' end as fold, case when {u('doc_id', 'split')} < 0.2 then 'test' else 'train' end as orig_split
  from (select doc_id, lang, lower(text) as t from documents)),
vf as (
  select vec_id as clip_id, label as y, list_transform(embedding, lambda x: x::double) as vec,
    case when {u('vec_id', 'fold')} < 0.3 then 'test' else 'train' end as fold, case when {u('vec_id', 'split')} < 0.2 then 'test' else 'train' end as orig_split
  from embeddings)"""


def _run_sql(run: str, feat: str, dims: int, scale: float, power: int = 2) -> str:
    return f"""{run}_c as (select y as cls, d, avg(vec[d::int]) as m from {feat}, range(1, {dims + 1}) t(d) where fold = 'train' group by all),
{run}_k as (select cls, list(m order by d) as c from {run}_c group by cls),
{run}_z as (select clip_id, y, orig_split, cls, -{scale} * list_sum(list_transform(range(1, {dims + 1}), lambda i: power(abs(vec[i::int]-c[i::int]), {power}))) as z
   from {feat}, {run}_k where fold = 'test'),
{run}_e as (select *, exp(z - max(z) over (partition by clip_id)) as e from {run}_z),
{run} as (select '{run}' as run, clip_id, orig_split, y::int as y, cls::int as cls, e / sum(e) over (partition by clip_id) as p,
   first_value(cls) over (partition by clip_id order by z desc, cls)::int as pred from {run}_e)"""


RUNS = ",\n".join(
    [
        _feat_sql(),
        _run_sql("letters", "lf", _N, 100.0),
        _run_sql("letters_l1", "lf", _N, 20.0, 1),
        _run_sql("vectors", "vf", 64, 40.0),
        _run_sql("vectors_l1", "vf", 64, 4.0, 1),
        "two as (select * from letters union all select * from vectors)",
        "allp as (select * from letters union all select * from letters_l1 union all select * from vectors union all select * from vectors_l1)",
    ]
)


def _metrics_sql(src: str, labels: str = "union") -> str:
    """Metrics per run of a long table (run, clip_id, y, cls, p, pred)."""
    only = "where c in (select y from o2 where o2.run = q.run)" if labels == "true_only" else ""
    return f"""(with o as (select run, clip_id, any_value(y) as y, any_value(pred) as pred,
          count(*) filter (p > py or (p = py and cls < y)) + 1 as rk, count(*) as nc
        from (select *, max(case when cls = y then p end) over (partition by run, clip_id) as py from {src}) group by run, clip_id),
      o2 as (select distinct run, y from o),
      q as (select run, y as c from o union select run, pred from o),
      f as (select q.run, c, 2.0 * (select count(*) from o where o.run = q.run and y = c and pred = c)
              / ((select count(*) from o where o.run = q.run and y = c) + (select count(*) from o where o.run = q.run and pred = c)) as f1 from q {only})
      select run, count(*) as n, avg((y = pred)::int) as acc, (select avg(f1) from f where f.run = o.run) as macro_f1,
        avg((rk <= least(5, nc))::int) as top5 from o group by run)"""


ONE = "o as (select run, clip_id, any_value(orig_split) as orig_split, any_value(y) as y, any_value(pred) as pred, max(p) as conf from two group by run, clip_id)"
MODE_SQL = "case run when 'letters' then 'provided' when 'letters_l1' then 'provided' when 'vectors' then 'random' end"

REGISTRY = {
    "softmax_scores": (
        softmax_scores,
        """with x as (select vec_id as clip_id, j - 1 as dim, embedding[j::int]::double * 20 as z from embeddings, range(1, 65) t(j)),
             e as (select *, exp(z - max(z) over (partition by clip_id)) as e from x)
           select clip_id, dim::int as dim, round(e / sum(e) over (partition by clip_id), 6) as p from e""",
    ),
    "centroid_classify": (centroid_classify, f"with {RUNS} select run, clip_id, y, pred, cls, round(p, 5) as p from two"),
    "eval_metrics": (
        eval_metrics,
        f"""with {RUNS} select u.run, u.n, round(u.acc, 5) as acc, round(u.macro_f1, 5) as macro_f1, round(t.macro_f1, 5) as macro_f1_true, round(u.top5, 5) as top5
            from {_metrics_sql('allp')} u join {_metrics_sql('allp', 'true_only')} t using (run)""",
    ),
    "per_class_report": (
        per_class_report,
        f"""with {RUNS}, {ONE}, q as (select run, y as c from o union select run, pred from o),
            k as (select run, c as cls, (select count(*) from o where o.run = q.run and y = c and pred = c) as tp,
              (select count(*) from o where o.run = q.run and y = c) as s, (select count(*) from o where o.run = q.run and pred = c) as pr from q)
            select run, cls, round(case when pr > 0 then tp/pr else 0 end, 5) as precision, round(case when s > 0 then tp/s else 0 end, 5) as recall,
              round(2*tp/(s+pr), 5) as f1, s as support from k""",
    ),
    "top_confusions": (
        top_confusions,
        f"""with {RUNS}, {ONE}, b as (select run, y, pred, count(*) as n from o where run = 'vectors' group by run, y, pred),
            c as (select *, sum(n) over (partition by run, y) as t from b)
            select run, y as actual, pred as predicted, n, round(n/t, 5) as rate from c where y <> pred order by n desc, run, actual, predicted limit 20""",
    ),
    "confidence_curve": (
        confidence_curve,
        f"""with {RUNS}, {ONE}, g as (select i / 20.0::double as t from range(20) r(i))
            select run, round(t, 2) as threshold, round(count(*) / (select count(*) from o o2 where o2.run = o.run), 5) as coverage,
              round(avg((y = pred)::int), 5) as accuracy, count(*) as n from o join g on conf >= t group by run, t""",
    ),
    "run_compare": (
        run_compare,
        f"""with {RUNS} select run, coalesce({MODE_SQL}, '?') as split_mode, round(acc, 4) as acc, round(macro_f1, 4) as macro_f1, round(top5, 4) as top5
            from {_metrics_sql('allp')}""",
    ),
    "best_run": (
        best_run,
        f"with {RUNS} select run, round(macro_f1, 5) as macro_f1 from {_metrics_sql('allp')} where {MODE_SQL} = 'provided' order by macro_f1 desc, run desc limit 1",
    ),
    "ensemble_vote": (
        ensemble_vote,
        f"""with {RUNS}, s as (select clip_id, y, cls, sum(p) as p from allp where run in ('vectors', 'vectors_l1') group by all),
            ens as (select 'vectors+vectors_l1' as run, *, first_value(cls) over (partition by clip_id order by p desc, cls) as pred from s)
            select run, n, round(acc, 5) as acc, round(macro_f1, 5) as macro_f1, round(top5, 5) as top5 from {_metrics_sql('ens', 'true_only')}""",
    ),
    "acc_by_origin": (
        acc_by_origin,
        f"with {RUNS}, {ONE} select run, orig_split, count(*) as n, round(avg((y = pred)::int), 5) as acc from o group by run, orig_split",
    ),
    "confidence_gate": (
        confidence_gate,
        f"""with {RUNS}, x as (select run, clip_id, any_value(pred) as pred, max(p) as conf, max(p) - coalesce(max(case when cls <> pred then p end), 0) as margin
              from two group by run, clip_id)
            select run, clip_id, run||pred as name, round(conf, 5) as conf, round(margin, 5) as margin from x
            where not (run = 'vectors' and pred = 9) and conf >= 0.5 and margin >= 0.15""",
    ),
    "topn_predictions": (
        topn_predictions,
        f"""with {RUNS}, r as (select *, row_number() over (partition by run, clip_id order by p desc, cls) as rank from two),
            t as (select *, max(case when cls = y then rank end) over (partition by run, clip_id) as true_rank from r)
            select run, clip_id, true_rank::int as true_rank, rank::int as rank, cls, round(p, 5) as p from t where rank <= 3""",
    ),
}
