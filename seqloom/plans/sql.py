"""ANSI-SQL building blocks for the cross-check queries (run by DuckDB)."""

from __future__ import annotations


def u(key: str, tag: str) -> str:
    return f"(('0x'||substr(md5(({key})::varchar||':{tag}'),1,8))::ubigint/4294967296.0)"


def hexkey(key: str, tag: str) -> str:
    return f"md5(({key})::varchar||':{tag}')"


def seed31(key: str, tag: str) -> str:
    return f"(('0x'||substr(md5(({key})::varchar||':{tag}'),1,7))::bigint + 1)"


DOCS = f"""docm as (
  select doc_id, 'clips/'||lang||'/'||doc_id||'.npz' as npz,
    'videos/'||source||'/'||lang||'/'||doc_id||'.mp4' as video,
    lang||'-'||(n_chars % 10) as label,
    (doc_id // 3)||'_'||(doc_id % 3) as stem,
    (doc_id // 3)::varchar as group_id,
    case when doc_id % 10 = 0 then '' else source end as signer_id,
    case when {u('doc_id', 'split')} < 0.15 then 'test' when {u('doc_id', 'split')} < 0.2 then ' TEST '
         when {u('doc_id', 'split')} < 0.3 then 'val' when {u('doc_id', 'split')} < 0.4 then '' else 'train' end as split,
    (n_chars % 300)::int as n_frames, 25.0::double as fps,
    {u('doc_id', 'det')} as det_rate, {u('doc_id', 'lhand')} as lhand_rate, {u('doc_id', 'rhand')} as rhand_rate
  from documents)"""

CONVS = """convm as (
  select conv_id*1000+turn as row_ord, 'clips/en/'||conv_id||'.npz' as npz, role as label,
    conv_id::varchar as stem, (length(text) % 300)::int as n_frames
  from conversations)"""

UNION = f"""{DOCS}, {CONVS}, uni as (
  select npz, video, label, stem, 'docs:'||group_id as group_id, signer_id, split, n_frames, fps, det_rate, lhand_rate, rhand_rate,
    doc_id as row_ord, 'docs' as source, 0 as src_ord from docm
  union all
  select npz, '', label, stem, 'convs:0', '', '', n_frames, 0.0, 0.0, 0.0, 0.0, row_ord, 'convs', 1 from convm)"""

DEDUP = f"""{UNION}, ded as (
  select * from (select *, row_number() over (partition by npz order by src_ord, row_ord) rn from uni) where rn = 1)"""

STATUS = f"""{DOCS}, st as (
  select * exclude (det_rate), case when doc_id % 11 = 0 then null else det_rate end as det_rate,
    case when doc_id % 29 = 0 then 'error' when doc_id % 31 = 0 then 'empty' else 'ok' end as status
  from docm)"""
