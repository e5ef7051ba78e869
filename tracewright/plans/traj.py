"""Views of the driver's tables that stand for trajectories and judge labels, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TRAJ = """
select d.doc_id as raw_index,
 cast(cast(floor(d.doc_id/8) as bigint) as {s}) as source_id,
 cast(d.doc_id % 8 as int) as sample_idx,
 cast(floor(d.doc_id/8) as bigint) % 2 as gold,
 case when d.doc_id % 23 = 0 then 'length' when d.doc_id % 29 = 0 then null else 'stop' end as finish_reason,
 case when d.doc_id % 31 = 0 then null else -cast(d.n_chars % 97 as double) end as score,
 l.quality, l.toxic,
 concat(
  case when d.doc_id % 5 = 0 then '<think>draft</think>' else '' end,
  '<text_evidence>', case when d.doc_id % 8 in (3,5) then concat('same', case when d.doc_id % 8 = 3 then '  ' else ' ' end,'claim') else d.text end, '</text_evidence>',
  '<audio_evidence>', d.lang, '</audio_evidence>',
  case when d.doc_id % 17 = 0 then '<visual_evidence>dup</visual_evidence>' else '' end,
  '<visual_evidence>', case when d.doc_id % 8 in (3,5) then 'v' else d.source end, '</visual_evidence>',
  case when d.doc_id % 13 = 0 then '' else '<integration>i</integration>' end,
  '<ANSWER> ', case when cast(floor(d.doc_id/8) as bigint) % 5 = 0 then case when cast(floor(d.doc_id/8) as bigint) % 2 = 1 then 'Sarcasm' else 'Non-Sarcasm' end when cast(floor(d.doc_id/8) as bigint) % 5 = 1 then case when cast(floor(d.doc_id/8) as bigint) % 2 = 1 then 'Non-Sarcasm' else 'Sarcasm' end else case d.doc_id % 6 when 0 then 'Sarcasm' when 1 then 'Non-Sarcasm' when 2 then 'sarcastic' when 3 then 'non_sarcasm' when 4 then 'NON SARCASM' else case when coalesce(l.quality, d.doc_id % 2) = 1 then 'sarcasm' else 'maybe' end end end, ' </answer>') as response
from documents d left join labels l on d.doc_id = l.doc_id
"""

_LABELS = """
select doc_id as judge_id,
 case when doc_id % 10 <> 0 then 1 else 0 end as text, case when n_chars % 4 <> 0 then 1 else 0 end as audio,
 case when doc_id % 3 <> 0 then 1 else 0 end as visual, case when doc_id % 50 <> 0 then 1 else 0 end as integration
from documents
"""

_RAW_JSON = """
select judge_id, case judge_id % 12
  when 0 then concat('{{"text":', text, ',"audio":true,"visual":1,"integration":1}}')
  when 1 then concat('{{"text":', text, ',"audio":1.0,"visual":1,"integration":1}}')
  when 2 then concat('{{"text":"1","audio":', audio, ',"visual":1,"integration":1}}')
  when 3 then concat('{{"text":', text, ',"audio":', audio, ',"visual":', visual, '}}')
  when 4 then concat('{{"text":', text, ',"audio":', audio, ',"visual":', visual, ',"integration":1,"more":1}}')
  when 5 then concat('[', text, ']')
  when 6 then '  '
  when 7 then 'SUPPORTED'
  when 8 then concat('{{"text":', text, ',"audio":', audio, ',"visual":', visual, ',"integration":2}}')
  else concat('{{"integration":', integration, ', "text":', text, ',"audio":', audio, ',"visual":', visual, '}}') end as raw
from lab
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents", "labels")
    return spark.sql(_TRAJ.format(s="string"))


def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents")
    return spark.sql(_LABELS)


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    component_labels(spark, sf_dir).createOrReplaceTempView("lab")
    return spark.sql(_RAW_JSON.format())


def _section(name: str) -> str:
    found = f"regexp_extract_all(response, '(?is)<{name}>(.*?)</{name}>', 1)"
    return f"case when len({found}) = 1 then nullif(trim({found}[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') end as {name}"


#: CTEs for the oracles: trajectories, their sections, and the first failing check.
TRAJ_SQL = f"traj as ({_TRAJ.format(s='varchar(20)')})"
_SECTIONS = ", ".join(_section(n) for n in ("text_evidence", "audio_evidence", "visual_evidence", "integration", "answer"))
PARSED_SQL = f"""{TRAJ_SQL}, parsed0 as (select *, {_SECTIONS} from traj), parsed as (
 select *, case when regexp_replace(lower(answer), '[\\s_-]+', '', 'g') in ('sarcasm', 'sarcastic') then 1
   when regexp_replace(lower(answer), '[\\s_-]+', '', 'g') in ('nonsarcasm', 'nonsarcastic') then 0 end as prediction from parsed0)"""
CLASSIFIED_SQL = f"""{PARSED_SQL}, cl as (select *,
 case when finish_reason is distinct from 'stop' then 'finish_reason'
  when text_evidence is null or audio_evidence is null or visual_evidence is null or integration is null or answer is null then 'malformed_structure'
  when prediction is null then 'unparseable_answer' when prediction <> gold then 'wrong_prediction' end as reject_reason,
 '<text_evidence>' || chr(10) || text_evidence || chr(10) || '</text_evidence>' || chr(10) || chr(10) || '<audio_evidence>' || chr(10) || audio_evidence || chr(10) || '</audio_evidence>' || chr(10) || chr(10)
  || '<visual_evidence>' || chr(10) || visual_evidence || chr(10) || '</visual_evidence>' || chr(10) || chr(10) || '<integration>' || chr(10) || integration || chr(10) || '</integration>' as reasoning,
 from parsed), usable as (select *, reasoning || chr(10) || chr(10) || '<answer>' || chr(10) || case prediction when 1 then 'Sarcasm' else 'Non-Sarcasm' end || chr(10) || '</answer>' as target from cl where reject_reason is null)"""
LABELS_SQL = f"lab as ({_LABELS})"
RAW_JSON_SQL = f"{LABELS_SQL}, raws as ({_RAW_JSON.format()})"
