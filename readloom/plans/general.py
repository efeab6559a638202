"""Queries of the two general problems: hot keys and rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import frequency, rejects
from ..sources.tables import table


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return frequency.heavy_keys_mode(table(s, d, "read_barcodes"), "barcode", "len1", 0.01)


def p1_profile(s: SparkSession, d: str) -> DataFrame:
    return frequency.key_profile(table(s, d, "read_barcodes"), "barcode", "len1")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(s, d, "raw_reads", "rec_id", "fmt", "raw"))


def p5_reads(s: SparkSession, d: str) -> DataFrame:
    return rejects.accepted(table(s, d, "raw_reads", "rec_id", "fmt", "raw"))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p5_found, p5_reads)}

_ROWS = """
with r as (select distinct * from read_barcodes where barcode is not null and barcode <> -1),
f as (select barcode, len1, count(*) as n from r group by 1, 2)
"""

_FIELD = '"(?:[^"]|"")*"|[^",]*'
_RAW = f"""
with a as (select rec_id, fmt, raw, case when ends_with(raw, chr(10)) then left(raw, length(raw) - 1) else raw end as body from raw_reads),
b as (select *, case when ends_with(body, chr(13)) then left(body, length(body) - 1) else body end as line,
  list_transform(string_split(body, chr(10)), lambda x: case when ends_with(x, chr(13)) then left(x, length(x) - 1) else x end) as l from a),
c as (select *, list_transform(regexp_extract_all(',' || line, '(?s),({_FIELD})', 1), lambda f: case when starts_with(f, '"') then replace(substr(f, 2, length(f) - 2), '""', '"') else f end) as f from b),
d as (select rec_id, fmt, raw, line, len(l) as n_lines, len(f) as n_fields, raw is null or regexp_full_match(raw, '[ \t\r\n]*') as blank, not regexp_full_match(line, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') as broken,
  case when fmt = 'fq' then regexp_extract(l[1], '^@([^ \t]+)', 1) else f[1] end as name, case when fmt = 'fq' then regexp_extract(l[1], '(?s)^@[^ \t]+[ \t](.*)$', 1) else f[2] end as info,
  case when fmt = 'fq' then l[2] else f[3] end as seq, case when fmt = 'fq' then l[3] else f[4] end as note, case when fmt = 'fq' then l[4] else f[5] end as qual from c),
e as (select *, case when blank then 'blank' when fmt = 'csv' and broken then 'quoting' when (fmt = 'fq' and n_lines <> 4) or (fmt = 'csv' and (n_fields <> 5 or contains(line, chr(10)))) then 'columns'
  when name = '' or not starts_with(note, '+') then 'header' when not regexp_full_match(seq, '[ACGTNacgtn]+') then 'seq' when length(qual) <> length(seq) or not regexp_full_match(qual, '[!-~]+') then 'qual'
  when contains(info, 'BX:Z:') and (not regexp_full_match(regexp_extract(info, 'BX:Z:([^ \t]*)', 1), '[ACGTN]{{18}}') or (contains(info, 'QB:Z:') and length(regexp_extract(info, 'QB:Z:([^ \t]*)', 1)) <> 18)) then 'info' end as reason from d)
"""

SQL = {
    "p5_found": _RAW + "select rec_id, reason from e where reason is not null",
    "p5_reads": _RAW + "select rec_id, name, nullif(info, '') as info, seq, note, qual from e where reason is null",
    "p1_found": _ROWS
    + """select barcode, len1 from (
      select barcode, len1, row_number() over (partition by barcode order by n desc, len1) as k from f where len1 > 0
      and barcode in (select barcode from r group by 1 having count(*) >= 0.01 * (select count(*) from r))) where k = 1""",
    "p1_profile": _ROWS
    + """, t as (select barcode, sum(n)::bigint as n_rows from f group by 1),
    v as (select *, sum(n) over (partition by barcode order by len1) as upto, sum(n) over (partition by barcode) as total from f where len1 > 0),
    q as (select barcode, count(*) as n_distinct, arg_max(len1, n * 100000 - len1) as mode, min(case when upto >= ceil(0.5 * total) then len1 end) as median, min(case when upto >= ceil(0.9 * total) then len1 end) as p90 from v group by 1)
    select t.barcode, n_rows, coalesce(n_distinct, 0) as n_distinct, mode, median, p90 from t left join q using (barcode)""",
}
