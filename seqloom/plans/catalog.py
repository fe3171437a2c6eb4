"""Registered queries: sources, manifests, joins, reports, splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import manifest as M
from seqloom.operators import processed as P
from seqloom.operators import ranking as R
from seqloom.operators import splits as S
from seqloom.plans import sql
from seqloom.session import shared_dir
from seqloom.sources import io
from seqloom.sources import surrogates as V


def r6(c: str | F.Column, name: str | None = None, digits: int = 6):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or c)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return V.documents_manifest(spark, sf)


def _with_status(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.withColumn("status", F.expr("case when doc_id % 29 = 0 then 'error' when doc_id % 31 = 0 then 'empty' else 'ok' end")).withColumn(
        "det_rate", F.expr("if(doc_id % 11 = 0, null, det_rate)")
    )


def _union(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("row_ord", F.col("doc_id"))
    return M.union_manifests([("docs", docs), ("convs", V.conversations_manifest(spark, sf))])


def catalog_paths(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return M.clip_catalog(pages, "url", ("", ".html")).select("page_id", "label", "stem", "suffix")


def derive_group(spark, sf):
    d = _docs(spark, sf)
    return d.select(
        "doc_id",
        M.derive_group(F.col("stem")).alias("group_id"),
        M.derive_group(F.col("npz"), r"(\d+)").alias("unmatched_group"),
        M.derive_signer(F.col("video"), r"/(src\d+)/").alias("signer_id"),
    )


def keep_labels_semi(spark, sf):
    toxic = V.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    keep = _docs(spark, sf).join(toxic, "doc_id", "left_semi").filter("n_frames > 150")
    return M.keep_labels(_docs(spark, sf), keep).select("npz", "label")


def clip_quality_filter(spark, sf):
    return M.usable_clips(_with_status(spark, sf)).select("npz", "label", "n_frames", r6("det_rate"))


def frame_stride(spark, sf):
    f = V.embedding_frames(spark, sf).select("clip_id", "frame_idx", "label").withColumn(
        "fps", F.expr("case when label % 4 = 0 then cast('NaN' as double) when label % 4 = 1 then 0.0D when label % 4 = 2 then null else 25.0D end")
    )
    return M.stride_frames(f, stride=3).select("clip_id", "frame_idx", "kept_idx", r6("fps"))


def clip_quality(spark, sf):
    q = M.clip_quality(V.embedding_frames(spark, sf))
    return q.select("clip_id", "n_frames", r6("det_rate"), r6("lhand_rate"), r6("rhand_rate"))


def catalog_summary(spark, sf):
    s = M.catalog_summary(_with_status(spark, sf))
    return s.select(
        "total", "usable", "rejected", "errors", "n_labels", "n_groups", "n_signers",
        r6("mean_per_label"), "min_per_label", r6("lhand_mean"), r6("rhand_mean"),
    )


def manifest_union(spark, sf):
    return _union(spark, sf).select(
        "src_ord", "row_ord", "source", "npz", "video", "label", "stem", "group_id", "signer_id", "split", "n_frames", "fps", r6("det_rate")
    )


def manifest_dedup(spark, sf):
    return M.first_by_path(_union(spark, sf)).select("npz", "source", "label", "group_id", "n_frames")


def manifest_summary(spark, sf):
    return M.manifest_summary(M.first_by_path(_union(spark, sf)))


def rarest_labels(spark, sf):
    return M.rarest_labels(_union(spark, sf), 10)


def incremental_anti(spark, sf):
    done = V.table(spark, sf, "labels").select("doc_id")
    return M.not_yet_done(_docs(spark, sf), done, "doc_id").select("doc_id", "npz")


def incremental_load(spark, sf):
    """Three runs into a bucketed table: a first half, everything, and the second run once more."""
    name = f"processed_{uuid.uuid4().hex[:12]}"
    P.processed_table(spark, name, f"{shared_dir(spark)}/{name}", "doc_id bigint, npz string", "doc_id")
    d = _docs(spark, sf).select("doc_id", "npz")
    P.load_run(d.filter("doc_id % 2 = 0"), name, "doc_id", "run-1")
    for _ in range(2):
        P.load_run(d, name, "doc_id", "run-2")
    return spark.table(name)


def labels_missing_in_test(spark, sf):
    d = _docs(spark, sf).withColumn("label", F.concat("label", F.lit("-"), F.col("n_frames") % 7))
    return M.labels_only_in(d)


def stem_overlap(spark, sf):
    return M.keys_in_both(_docs(spark, sf), "group_id")


def manifest_orphans(spark, sf):
    d = _docs(spark, sf)
    files = V.table(spark, sf, "documents").filter("n_chars >= 200").select(
        F.concat(F.lit("clips/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".npz")).alias("npz")
    )
    return M.orphans(d, files).select("npz", "label")


def complete_sources(spark, sf):
    return M.complete_sources(_docs(spark, sf), "group_id")


def ordinal_pairing(spark, sf):
    vids = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    refs = V.table(spark, sf, "documents").filter("lang <> 'en'").select("doc_id")
    v = R.global_ordinal(vids, "conv_id")
    r = R.global_ordinal(refs, "doc_id")
    pairs = v.join(r, "ordinal", "full").withColumn("paired", F.col("conv_id").isNotNull() & F.col("doc_id").isNotNull())
    none = F.lit(-1).cast("bigint")  # the side that has no row at this place
    return pairs.select("ordinal", *[F.coalesce(c, none).alias(c) for c in ("conv_id", "turns", "doc_id")], "paired")


def label_map(spark, sf):
    return M.label_map(_docs(spark, sf))


def label_lookup(spark, sf):
    """Every clip's label index, and the label that the index leads back to."""
    d, labels = _docs(spark, sf), M.label_map(_docs(spark, sf))
    there = M.with_label_index(d.select("doc_id", "label"), labels)
    return there.join(labels.select("idx", F.col("label").alias("back")), "idx").select("doc_id", "label", "idx", "back")


def recording_log(spark, sf):
    """Recordings appended to a log in two sessions, read back and summed up by signer and mode."""
    path = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex[:12]}"
    c = V.table(spark, sf, "conversations")
    log = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("file"), F.col("role").alias("prompt"), F.concat(F.lit("s"), F.col("conv_id") % 7).alias("signer"),
        F.when(F.col("turn") % 2 == 0, "sentence").otherwise("word").alias("mode"), (F.length("text") / 16.0).alias("seconds"), "turn",
    )
    for session in (0, 1):
        io.append_json(log.filter(F.col("turn") % 2 == session).drop("turn"), path)
    back = io.read_recordings(spark, path)
    return back.groupBy("signer", "mode", "prompt").agg(F.count_distinct("file").alias("files"), F.round(F.sum("seconds"), 3).alias("seconds"))


def class_weights(spark, sf):
    d = _docs(spark, sf)
    return M.class_weights(d.filter("split = 'train'"), M.label_map(d)).select("idx", "label", r6("n"), r6("weight"))


def top_k_labels(spark, sf):
    return M.top_labels(_docs(spark, sf).filter("split = 'train'"), 12)


def min_support_filter(spark, sf):
    return M.min_support(_docs(spark, sf), 8, 15).select("npz", "label")


def balanced_shards(spark, sf):
    return M.balanced_shards(_docs(spark, sf), 4)


def cohort_pivot(spark, sf):
    tag = F.lower(F.trim("split"))
    d = _docs(spark, sf).withColumn("split", F.when(tag == "", "untagged").otherwise(tag))
    return M.cohort_pivot(d, d.filter("n_frames > 290"), ["train", "test", "val", "untagged"])


def frame_stats(spark, sf):
    return M.frame_stats(_docs(spark, sf)).select(
        r6("mean_frames"), r6("median_frames"), "max_frames", "low_det_clips", r6("lhand_mean"), r6("rhand_mean")
    )


def _fold_query(mode):
    def run(spark, sf):
        return S.make_splits(_docs(spark, sf), mode).select("npz", "fold")

    return run


def split_report(spark, sf):
    return S.split_report(S.make_splits(_docs(spark, sf), "group"))


def leakage_check(spark, sf):
    return S.leaking_keys(S.make_splits(_docs(spark, sf), "random"), "group_id")


def stratified_fraction(spark, sf):
    return S.stratified_fraction(_docs(spark, sf), 0.25).select("npz", "label")


def lexicon_override(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    defaults = p.groupBy("p_name").agg(F.min("p_type").alias("t")).select(
        io.token_norm(F.col("p_name")).alias("gloss"), F.lower("t").alias("vi"), F.lit("NOUN").alias("pos"), F.lit(None).cast("string").alias("tense")
    )
    lines = p.filter("p_size % 2 = 0").select(
        F.col("p_partkey").alias("ord"),
        F.expr(
            """case when p_size % 10 = 0 then concat('{"', p_name, ' ', cast(p_size as string), '": "', p_brand, '", "_note": "', p_type, '"}')
                    when p_size % 6 = 0 then concat('{"', p_name, '": {"vi": "', p_brand, '", "pos": "TIME", "tense": "past"}}')
                    else concat('{"', p_name, '": {"vi": "', p_brand, '", "pos": "VERB"}}') end"""
        ).alias("json"),
    )
    return io.override_lexicon(defaults, io.parse_lexicon(lines, "json", "ord"))


D = sql.DOCS


def _split_sql(key: str, least: int) -> str:
    floor = (lambda x: f"greatest({least}, floor({x})::bigint)") if least else (lambda x: f"floor({x})::bigint")
    return f"""with {D}, k as (select {key} as key, row_number() over (order by {sql.hexkey(key, 'split42')}) as rk, count(*) over () as n
        from (select distinct {key} from docm))
      select npz, case when rk <= {floor('n*0.15')} then 'test' when rk <= {floor('n*0.15')} + {floor('n*0.15')} then 'val' else 'train' end as fold
      from docm join k on k.key = docm.{key}"""


PROVIDED = f"""with {D}, t as (select *, lower(trim(split)) = 'test' as is_test from docm),
    k as (select group_id as key, row_number() over (order by {sql.hexkey('group_id', 'split42')}) as rk, count(*) over () as n
          from (select distinct group_id from t where not is_test))
  select npz, case when is_test then 'test' when rk <= greatest(1, floor(n*0.15)::bigint) then 'val' else 'train' end as fold
  from t left join k on k.key = t.group_id"""

LEXICON = """with p as (select *, replace(upper(trim(p_name)),' ','-') as g from part),
  d as (select g as gloss, lower(min(p_type)) as vi, 'NOUN' as pos, null::varchar as tense from p group by p_name, g),
  o as (select p_partkey, case when p_size % 10 = 0 then g||'-'||p_size else g end as gloss, p_brand as vi,
          case when p_size % 10 = 0 then null when p_size % 6 = 0 then 'TIME' else 'VERB' end as pos,
          case when p_size % 10 = 0 then null when p_size % 6 = 0 then 'past' end as tense
        from p where p_size % 2 = 0),
  l as (select gloss, vi, pos, tense from (select *, row_number() over (partition by gloss order by p_partkey desc) rn from o) where rn = 1)
  select * from l union all select * from d where gloss not in (select gloss from l)"""

REGISTRY = {
    "catalog_paths": (
        catalog_paths,
        """with b as (select page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') as p from pages),
             s as (select page_id, string_split(p, '/') as a from b),
             n as (select page_id, a[-2] as label, a[-1] as name, regexp_extract(a[-1], '^.+(\\.[^.]+)$', 1) as suffix from s)
           select page_id, label, substr(name, 1, length(name)-length(suffix)) as stem, suffix from n where suffix in ('', '.html')""",
    ),
    "derive_group": (
        derive_group,
        f"""with {D} select doc_id, regexp_extract(stem, '^([0-9]+)', 1) as group_id, npz as unmatched_group,
             regexp_extract(video, '/(src[0-9]+)/', 1) as signer_id from docm""",
    ),
    "keep_labels_semi": (
        keep_labels_semi,
        f"""with {D} select npz, label from docm where label in
             (select label from docm where n_frames > 150 and doc_id in (select doc_id from labels where toxic = 1))""",
    ),
    "clip_quality_filter": (
        clip_quality_filter,
        f"""with {sql.STATUS} select npz, label, n_frames, round(coalesce(det_rate, 1.0), 6) as det_rate from st
            where status = 'ok' and coalesce(det_rate, 1.0) >= 0.3 and n_frames >= 6""",
    ),
    "frame_stride": (
        frame_stride,
        """with f as (select label, label||'-'||(vec_id // 300) as clip_id,
               row_number() over (partition by label, vec_id // 300 order by vec_id) - 1 as frame_idx from embeddings)
           select clip_id, frame_idx::int as frame_idx, (frame_idx // 3)::int as kept_idx,
             round(case when label % 4 = 3 then 25.0 else 30.0 end / 3, 6) as fps
           from f where frame_idx % 3 = 0""",
    ),
    "clip_quality": (
        clip_quality,
        """select label||'-'||(vec_id // 300) as clip_id, count(*) as n_frames,
             round(avg((vec_id % 7 <> 3 and vec_id % 300 >= 20)::int), 6) as det_rate,
             round(avg((vec_id % 5 <> 0)::int), 6) as lhand_rate, round(avg((vec_id % 4 <> 1)::int), 6) as rhand_rate
           from embeddings group by 1""",
    ),
    "catalog_summary": (
        catalog_summary,
        f"""with {sql.STATUS}, x as (select *, status = 'ok' as ok,
               status = 'ok' and coalesce(det_rate, 1.0) >= 0.3 and n_frames >= 6 as use from st)
            select count(*) as total, count(*) filter (use) as usable, count(*) filter (ok and not use) as rejected,
              count(*) filter (status = 'error') as errors, count(distinct label) filter (use) as n_labels,
              count(distinct group_id) filter (use) as n_groups, count(distinct signer_id) filter (use and signer_id <> '') as n_signers,
              round(count(*) filter (use) / greatest(count(distinct label) filter (use), 1)::double, 6) as mean_per_label,
              (select min(c) from (select count(*) c from x where use group by label)) as min_per_label,
              round(avg(lhand_rate) filter (use), 6) as lhand_mean, round(avg(rhand_rate) filter (use), 6) as rhand_mean from x""",
    ),
    "manifest_union": (
        manifest_union,
        f"""with {sql.UNION} select src_ord, row_ord, source, npz, video, label, stem, group_id, signer_id, split, n_frames, fps,
            round(det_rate, 6) as det_rate from uni""",
    ),
    "manifest_dedup": (manifest_dedup, f"with {sql.DEDUP} select npz, source, label, group_id, n_frames from ded"),
    "manifest_summary": (
        manifest_summary,
        f"""with {sql.DEDUP}, t as (select case when split = '' then '(untagged)' else split end as split, source, label, group_id, signer_id from ded)
            select case grouping(split, source) when 1 then 'split' when 2 then 'source' else 'all' end as level,
              coalesce(split, source, '') as value, count(*) as clips, count(distinct label) as labels, count(distinct group_id) as groups,
              count(distinct nullif(signer_id, '')) as signers, count(nullif(signer_id, '')) as signer_clips
            from t group by grouping sets ((split), (source), ())""",
    ),
    "rarest_labels": (
        rarest_labels,
        f"with {sql.UNION} select label, count(*) as clips from uni group by label order by clips, label desc limit 10",
    ),
    "incremental_anti": (
        incremental_anti,
        f"with {D} select doc_id, npz from docm where doc_id not in (select doc_id from labels)",
    ),
    "incremental_load": (
        incremental_load,
        f"with {D} select doc_id, npz, case when doc_id % 2 = 0 then 'run-1' else 'run-2' end as run_id from docm",
    ),
    "labels_missing_in_test": (
        labels_missing_in_test,
        f"""with {D}, x as (select label||'-'||(n_frames % 7) as label, split from docm)
            select label, count(*) filter (split = 'train') as n_have from x group by label
            having count(*) filter (split = 'train') > 0 and count(*) filter (split = 'test') = 0""",
    ),
    "stem_overlap": (
        stem_overlap,
        f"""with {D} select group_id, count(*) filter (split = 'train') as n_a, count(*) filter (split = 'test') as n_b from docm
            where group_id in (select group_id from docm where split = 'train' intersect select group_id from docm where split = 'test')
            group by group_id""",
    ),
    "manifest_orphans": (
        manifest_orphans,
        f"with {D} select npz, label from docm where doc_id not in (select doc_id from documents where n_chars >= 200)",
    ),
    "complete_sources": (
        complete_sources,
        f"""with {D} select group_id, count(*) as n_clips from docm group by group_id
            having list_has_all(list(distinct split), ['train', 'test'])""",
    ),
    "ordinal_pairing": (
        ordinal_pairing,
        """with v as (select conv_id, count(*) as turns, row_number() over (order by conv_id) as ordinal from conversations group by conv_id),
             r as (select doc_id, row_number() over (order by doc_id) as ordinal from documents where lang <> 'en')
           select ordinal, coalesce(conv_id, -1) as conv_id, coalesce(turns, -1) as turns, coalesce(doc_id, -1) as doc_id, conv_id is not null and doc_id is not null as paired from v full join r using (ordinal)""",
    ),
    "label_map": (
        label_map,
        f"""with {D}, l as (select label, 0 as x from docm union select '__NOSIGN__', 1)
            select (row_number() over (order by x, label) - 1)::int as idx, label from l""",
    ),
    "label_lookup": (
        label_lookup,
        f"""with {D}, m as (select label, row_number() over (order by label) - 1 as idx from (select distinct label from docm))
            select doc_id, docm.label, idx::int as idx, m.label as back from docm join m on m.label = docm.label""",
    ),
    "recording_log": (
        recording_log,
        """select 's' || (conv_id % 7) as signer, case when turn % 2 = 0 then 'sentence' else 'word' end as mode, role as prompt, count(distinct conv_id || '-' || turn) as files,
            round(sum(length(text) / 16.0), 3) as seconds from conversations group by all""",
    ),
    "class_weights": (
        class_weights,
        f"""with {D}, l as (select label, 0 as x from docm union select '__NOSIGN__', 1),
              m as (select (row_number() over (order by x, label) - 1)::int as idx, label from l),
              c as (select idx, m.label, (select count(*) from docm d where d.label = m.label and d.split = 'train')::double as n from m),
              f as (select idx, label, case when n = 0 then (select avg(n) from c where n > 0) else n end as n from c)
            select idx, label, round(n, 6) as n,
              round(greatest(0.2, least(5.0, (select sum(n) from f) / ((select count(*) from f) * n))), 6) as weight from f""",
    ),
    "top_k_labels": (
        top_k_labels,
        f"with {D} select label, count(*) as clips from docm where split = 'train' group by label order by clips desc, label limit 12",
    ),
    "min_support_filter": (
        min_support_filter,
        f"""with {D} select npz, label from docm where label in
            (select label from docm group by label having count(*) >= 8 order by count(*) desc, label limit 15)""",
    ),
    "balanced_shards": (
        balanced_shards,
        f"""with recursive {D}, c as (select label, count(*) as clips, row_number() over (order by count(*) desc, label) as i from docm group by label),
              w as (select 0::bigint as i, [0::bigint, 0, 0, 0] as load, -1 as shard
                    union all
                    select c.i, list_transform(load, lambda v, j: case when j = list_position(load, list_min(load)) then v + clips else v end),
                      (list_position(load, list_min(load)) - 1)::int from w join c on c.i = w.i + 1)
            select label, clips, shard from w join c using (i)""",
    ),
    "cohort_pivot": (
        cohort_pivot,
        f"""with {D}, t as (select label, lower(trim(split)) as split,
               case when label in (select label from docm where n_frames > 290) then 'old' else 'new' end as cohort from docm)
            select cohort, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test,
              count(*) filter (split = 'val') as val, count(*) filter (split = '') as untagged
            from t group by cohort""",
    ),
    "frame_stats": (
        frame_stats,
        f"""with {D} select round(avg(n_frames), 6) as mean_frames, round(median(n_frames), 6) as median_frames, max(n_frames) as max_frames,
            count(*) filter (det_rate < 0.6) as low_det_clips, round(avg(lhand_rate), 6) as lhand_mean, round(avg(rhand_rate), 6) as rhand_mean from docm""",
    ),
    "split_random": (_fold_query("random"), _split_sql("npz", 0)),
    "split_group": (_fold_query("group"), _split_sql("group_id", 1)),
    "split_signer": (_fold_query("signer"), _split_sql("signer_id", 1)),
    "split_provided": (_fold_query("provided"), PROVIDED),
    "split_report": (
        split_report,
        f"""with s as ({_split_sql('group_id', 1)}), {D}
            select fold, count(*) as clips, count(distinct label) as labels, count(distinct group_id) as groups,
              count(distinct nullif(signer_id, '')) as signers from docm join s using (npz) group by fold""",
    ),
    "leakage_check": (
        leakage_check,
        f"""with s as ({_split_sql('npz', 0)}), {D}
            select group_id as key, max((fold = 'train')::int) as in_train, max((fold = 'val')::int) as in_val, max((fold = 'test')::int) as in_test
            from docm join s using (npz) group by group_id having count(distinct fold) > 1""",
    ),
    "stratified_fraction": (
        stratified_fraction,
        f"""with {D}, r as (select npz, label, row_number() over (partition by label order by {sql.hexkey('npz', 'frac42')}) as rk,
               count(*) over (partition by label) as n from docm)
            select npz, label from r where rk <= ceil(0.25 * n)""",
    ),
    "lexicon_override": (lexicon_override, LEXICON),
}
