"""Queries on reads, k-mers and minimizers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import alignment, kmers, links, minimizers, reads, unitigs
from ..sources.tables import table

K, SMALL_K, MINIMIZER_K, MINIMIZER_W = 31, 15, 17, 17


def _reads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "seq_reads")


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "read_barcodes")


def _slots(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kmer_hash")


def _local(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mm_db", "edge", "p", "mm")


def _global(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mm_align", "edge", "pos", "mm").withColumnRenamed("pos", "p")


QUERIES = {
    "revcomp_reads": lambda s, d: reads.reverse_complements(_reads(s, d)),
    "barcode_tags": lambda s, d: reads.barcode_tags(_reads(s, d)),
    "barcode_inline": lambda s, d: reads.inline_barcodes(_reads(s, d).filter("lib = '10x'")),
    "fastq_records": lambda s, d: reads.fastq_records(_reads(s, d)),
    "mate_pairs": lambda s, d: reads.mate_pairs(_reads(s, d)),
    "barcode_frequency": lambda s, d: reads.barcode_frequency(_records(s, d)),
    "barcode_index": lambda s, d: reads.barcode_index(_records(s, d)),
    "barcode_sort": lambda s, d: reads.sort_by_barcode(_records(s, d)).select("rec_id", "barcode", "lane", "rec_offset"),
    "reads_of_coverage_sets": lambda s, d: reads.reads_of_sets(_records(s, d), links.members(table(s, d, "edge_barcodes", "edge", "kind", "keys", "cnts"), "COV", 2)),
    "kmer_count": lambda s, d: kmers.counts(_reads(s, d), K, 2),
    "kmer_spectrum": lambda s, d: kmers.spectrum(_reads(s, d), K),
    "kmer_adjacency": lambda s, d: kmers.adjacency(_reads(s, d), 21, 2),
    "kmer_table": lambda s, d: kmers.table_kmers(_slots(s, d)),
    "kmer_branching": lambda s, d: kmers.branching(_slots(s, d)),
    "kmer_support": lambda s, d: kmers.support(_reads(s, d), _slots(s, d)),
    "kmer_missing": lambda s, d: kmers.missing(_reads(s, d), _slots(s, d)),
    "mate_kmer_match": lambda s, d: kmers.mate_match(_reads(s, d), SMALL_K),
    "unitigs": lambda s, d: unitigs.unitigs(_reads(s, d), K),
    "unitigs_45": lambda s, d: unitigs.unitigs(_reads(s, d), 45),
    "unitigs_61": lambda s, d: unitigs.unitigs(_reads(s, d), 61),
    "tagged_records": lambda s, d: reads.tagged_records(_reads(s, d)),
    "read_graph": lambda s, d: unitigs.read_graph(_reads(s, d), 45).drop("holes"),
    "read_graph_local": lambda s, d: unitigs.read_graph(_reads(s, d), 31).drop("holes"),
    "similar_reads": lambda s, d: alignment.similar_reads(_reads(s, d)),
    "minimizers": lambda s, d: minimizers.of_sequences(_reads(s, d), MINIMIZER_K, MINIMIZER_W),
    "minimizer_index": lambda s, d: minimizers.index(_local(s, d)),
    "minimizer_index_stats": lambda s, d: minimizers.index_stats(_local(s, d)),
    "minimizer_leading_hits": lambda s, d: minimizers.leading_hits(_global(s, d), _local(s, d)),
    "minimizer_best_edge": lambda s, d: minimizers.best_edges(_global(s, d), _local(s, d)),
    "minimizer_runs": lambda s, d: minimizers.runs(_global(s, d), _local(s, d)),
}

_REVCOMP = "reverse(translate(upper({0}), 'ACGT', 'TGCA'))"
_R = "with r as (select distinct read_id, mate, seq from seq_reads)"
_CODE5 = "list_reduce(list_concat([0::bigint], list_transform(string_split({0}, ''), lambda c: (instr('ACGTN', c) - 1)::bigint)), lambda a, b: a * 5 + b)"


def _power_digits(code: str, n: int, base: int, alphabet: str) -> str:
    parts = [f"substr('{alphabet}', (({code} // {base**i}) % {base} + 1)::int, 1)" for i in range(n - 1, -1, -1)]
    return " || ".join(parts)


def _kmers(k: int, keep: str = "") -> str:
    return f"""{_R}, x as (select {keep} substr(upper(seq), i::int, {k}) as km from r, unnest(range(1, greatest(1, length(seq) - {k} + 2))) t(i) where length(seq) >= {k}),
    k as (select {keep} km, reverse(translate(km, 'ACGT', 'TGCA')) as rc from x where regexp_full_match(km, '[ACGT]+'))"""


_TABLE = f"""t as (select keys as key, bit_or(coalesce(adjs, 0)) as adj, count(*) as n_slots from (select distinct * from kmer_hash) where keys is not null group by 1),
tk as (select *, {_power_digits("key", 31, 4, "ACGT")} as kmer from t)"""
_INDEX = """e as (select distinct edge, p, mm from mm_db where p is not null and mm is not null),
idx as (select mm, arg_min(edge, edge * 1000000 + p) as edge, arg_min(p, edge * 1000000 + p) as p, count(*) as n from e group by 1)"""
_PROBE = f"with {_INDEX}, q as (select distinct edge as query, pos as p, mm from mm_align where mm is not null)"

def _unitigs(k: int) -> str:
    return f"""with recursive {_kmers(k + 1)[5:]}, c as (select least(km, rc) as km from k group by 1 having count(*) >= 2), x2 as (select km from c union select reverse(translate(km, 'ACGT', 'TGCA')) from c),
      st as (select left(km, {k}) as a, right(km, {k}) as b from x2), one_out as (select a, min(b) as b from st group by 1 having count(*) = 1), one_in as (select b from st group by 1 having count(*) = 1),
      f as (select b as id, a as prev from one_out join one_in using (b) where a <> b and reverse(translate(a, 'ACGT', 'TGCA')) <> b), ids as (select a as id from st union select b from st),
      walk as (select id as head, id as tip, id as seq, 1 as n from ids where id not in (select id from f) union all select head, f.id, seq || right(f.id, 1), n + 1 from walk join f on f.prev = walk.tip),
      full_run as (select head, arg_max(seq, n) as seq, max(n) as n_kmers from walk group by 1),
      ring as (select id as head, id as tip, id as seq, 1 as n from f where id not in (select tip from walk) union all select head, f.id, seq || right(f.id, 1), n + 1 from ring join f on f.prev = ring.tip where f.id <> head),
      ring_run as (select head, arg_max(seq, n) as seq, max(n) as n_kmers, min(tip) as low, min(reverse(translate(tip, 'ACGT', 'TGCA'))) as rc_low from ring group by 1)
      select distinct least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) as seq, n_kmers::bigint as n_kmers, false as is_cycle from full_run
      union all select seq, n_kmers::bigint, true from ring_run where head = low and low <= rc_low"""


def _graph(k: int) -> str:
    """The graph of the reads as CTEs, the last one g: (k+1)-mers are walked on through k-mers with one in and one out."""
    rc = _REVCOMP.format
    return f"""{_kmers(k + 1)[5:]}, c as (select least(km, rc) as km, count(*) as n from k group by 1 having count(*) >= 2),
      x2 as (select km, n from c union select {rc("km")}, n from c), st as (select km, n, left(km, {k}) as a, right(km, {k}) as b from x2),
      o1 as (select a as node, min(km) as km from st group by 1 having count(*) = 1), i1 as (select b as node, min(km) as prev from st group by 1 having count(*) = 1),
      f as (select km, prev from o1 join i1 using (node) where km <> prev),
      walk as (select km as head, km as tip, km as seq, n, 1 as m from st where km not in (select km from f) union all select head, f.km, seq || right(f.km, 1), walk.n + st.n, m + 1 from walk join f on f.prev = walk.tip join st on st.km = f.km),
      full_run as (select head, arg_max(seq, m) as seq, max(n) as cnt from walk group by 1),
      one as (select seq, {rc("seq")} as rcs, cnt, row_number() over (order by seq) - 1 as i from full_run where seq <= {rc("seq")}),
      e as (select 2 * i as edge_id, case when seq = rcs then 2 * i else 2 * i + 1 end as rc_id, seq, cnt from one union all select 2 * i + 1, 2 * i, rcs, cnt from one where seq <> rcs),
      nodes as (select kmer, row_number() over (order by kmer) - 1 as node from (select left(seq, {k}) as kmer from e union select right(seq, {k}) from e)),
      g as (select edge_id, rc_id, x.node as node_from, y.node as node_to, '{"global" if k == 45 else "local"}' as graph, length(seq)::int as seq_len, cnt::bigint as cnt, seq from e join nodes x on x.kmer = left(seq, {k}) join nodes y on y.kmer = right(seq, {k}))"""


SQL = {
    "revcomp_reads": f"{_R} select read_id, mate, {_REVCOMP.format('seq')} as rc from r",
    "barcode_tags": f"""with r as (select distinct read_id, mate, info from seq_reads), t as (select read_id, mate, case when contains(info, 'BX:Z:') then regexp_extract(info, 'BX:Z:([^ \t]*)', 1) end as bx,
      case when contains(info, 'QB:Z:') then regexp_extract(info, 'QB:Z:([^ \t]*)', 1) end as qb from r)
      select read_id, mate, bx, qb, case when regexp_full_match(bx, '[ACGTN]{{18}}') then {_CODE5.format('bx')} end as code from t""",
    "barcode_inline": """with r as (select distinct read_id, seq, qual from seq_reads where lib = '10x' and mate = 1 and seq is not null)
      select read_id, case when length(seq) >= 23 then left(seq, 16) end as barcode, case when length(seq) >= 23 then substr(seq, 17, 7) end as umi, case when length(seq) >= 23 then substr(seq, 24) else seq end as seq,
      case when length(seq) >= 23 then substr(qual, 24) else qual end as qual, case when length(seq) >= 23 then length(seq) - 23 else length(seq) end as len from r""",
    "fastq_records": """with r as (select distinct read_id, mate, name, info, seq, qual from seq_reads where seq is not null)
      select read_id, mate, concat_ws(chr(10), '@' || regexp_replace(name, '/[12]$', '') || '/' || mate || case when info <> '' then ' ' || info else '' end, seq, '+', case when length(qual) = length(seq) then qual else repeat('F', length(seq)) end) as record from r""",
    "mate_pairs": """with r as (select distinct read_id, mate, regexp_replace(name, '/[12]$', '') as name, seq from seq_reads),
      g as (select read_id, max(case when mate = 1 then length(seq) end) as len1, max(case when mate = 2 then length(seq) end) as len2, max(case when mate = 1 then name end) as n1, max(case when mate = 2 then name end) as n2 from r group by 1)
      select read_id, len1, len2, n1 = n2 as same_name from g""",
    "barcode_frequency": f"select barcode, {_power_digits('barcode', 18, 5, 'ACGTN')} as text, count(*) as n from (select distinct * from read_barcodes where barcode is not null and barcode <> -1) group by 1",
    "barcode_index": """select barcode, lane, min(rec_offset) as first_offset, count(*) as n, sum(case when len1 > 0 then len1 else 0 end)::bigint as bases1, sum(case when len2 > 0 then len2 else 0 end)::bigint as bases2
      from (select distinct * from read_barcodes where barcode is not null and barcode <> -1) group by 1, 2""",
    "barcode_sort": "select distinct rec_id, barcode, lane, rec_offset from read_barcodes where barcode is not null and barcode <> -1",
    "reads_of_coverage_sets": """with m as (select distinct edge, k from (select edge, unnest(keys) as k, unnest(cnts) as c from edge_barcodes where kind = 'COV') where k <> -1 and c >= 2),
      n as (select barcode, count(*) as n from (select distinct rec_id, barcode from read_barcodes) group by 1)
      select edge, sum(n)::bigint as n_records from m join n on k = barcode group by 1""",
    "kmer_count": _kmers(K) + " select least(km, rc) as kmer, count(*) as n from k group by 1 having count(*) >= 2",
    "kmer_spectrum": _kmers(K) + ", c as (select least(km, rc) as kmer, count(*) as n from k group by 1) select n, count(*) as kmers from c group by 1",
    "kmer_adjacency": _kmers(22)
    + """, e as (select km, count(*) as n from k group by 1),
      z as (select left(km, 21) as a, instr('ACGT', right(km, 1)) - 1 as b, n from e union all select reverse(translate(substr(km, 2), 'ACGT', 'TGCA')), instr('ACGT', translate(left(km, 1), 'ACGT', 'TGCA')) - 1, n from e),
      y as (select *, reverse(translate(a, 'ACGT', 'TGCA')) as rc from z)
      select least(a, rc) as kmer, bit_or(case when a <= rc then (1 << b::int) else (1 << (b + 4)::int) end)::int as mask, sum(n)::bigint as n from y group by 1 having sum(n) >= 2""",
    "kmer_table": f"with {_TABLE} select key, kmer, adj, n_slots from tk",
    "kmer_branching": f"""with {_TABLE}, b as (select key, bit_count(adj & 15)::int as n_out, bit_count(adj & 240)::int as n_in from t)
      select *, case when n_out = 1 and n_in = 1 then 'pass' when n_out = 0 and n_in = 0 then 'lone' when n_out = 0 or n_in = 0 then 'end' else 'branch' end as kind from b""",
    "kmer_support": _kmers(K) + f", {_TABLE}, c as (select least(km, rc) as kmer, count(*) as n from k group by 1) select key, least(coalesce(c.n, 0), 999) as n from tk left join c on c.kmer = least(tk.kmer, {_REVCOMP.format('tk.kmer')})",
    "kmer_missing": _kmers(K) + f", {_TABLE} select key from tk where least(kmer, {_REVCOMP.format('kmer')}) not in (select least(km, rc) from k)",
    "mate_kmer_match": _kmers(SMALL_K, "read_id, mate,")
    + """, c as (select read_id, least(km, rc) as kmer, count(*) filter (mate = 1) as a, count(*) filter (mate = 2) as b from k group by 1, 2)
      select read_id, sum(least(a, b))::bigint as matches from c group by 1 having sum(least(a, b)) > 0""",
    "unitigs": _unitigs(31),
    "unitigs_45": _unitigs(45),
    "unitigs_61": _unitigs(61),
    "tagged_records": """with r as (select distinct read_id, mate, name, info, seq from seq_reads where seq is not null and contains(info, 'BX:Z:')), t as (select *, regexp_extract(info, 'BX:Z:([^ \t]*)', 1) as bx, case when contains(info, 'QB:Z:') then regexp_extract(info, 'QB:Z:([^ \t]*)', 1) end as qb from r)
      select read_id, mate, '@' || regexp_replace(name, '/[12]$', '') || ' BX:Z:' || bx || ' QB:Z:' || case when length(qb) = 18 then qb else repeat('F', 18) end as header from t where regexp_full_match(bx, '[ACGTN]{18}')""",
    "read_graph": "with recursive " + _graph(45) + " select * from g",
    "read_graph_local": "with recursive " + _graph(31) + " select * from g",
    "minimizers": f"""{_R}, x as (select read_id, mate, i as p, substr(upper(seq), i::int, 17) as km, length(seq) - 16 as n from r, unnest(range(1, greatest(1, length(seq) - 15))) t(i) where length(seq) >= 17),
      d as (select km, row_number() over (order by md5(km)) as place from (select distinct km from x where regexp_full_match(km, '[ACGT]+'))),
      h as (select x.*, place * 1000000 + p as h from x left join d using (km)),
      w as (select *, min(h) over (partition by read_id, mate, n order by p rows between current row and 16 following) as m from h),
      f as (select distinct read_id, mate, m from w where m is not null and p <= greatest(1, n - 16))
      select f.read_id, f.mate, h.p::int as p, h.km as kmer from f join h on h.read_id = f.read_id and h.mate = f.mate and h.h = f.m""",
    "minimizer_index": f"with {_INDEX} select * from idx",
    "minimizer_index_stats": f"with {_INDEX} select count(*) filter (n = 1) as singles, count(*) filter (n > 1) as repeated from idx",
    "minimizer_leading_hits": _PROBE
    + """, j as (select query, q.p, q.mm, idx.edge, coalesce(idx.n = 1, false) as good from q left join idx using (mm)),
      l as (select *, min(good::int) over (partition by query order by p, mm rows between unbounded preceding and current row) as run from j)
      select query, edge, count(*) as hits from l where run = 1 group by 1, 2""",
    "minimizer_best_edge": _PROBE
    + """, h as (select query, idx.edge, count(*) as hits from q join idx using (mm) where idx.n = 1 group by 1, 2),
      t as (select *, max(hits) over (partition by query) as top from h), b as (select query, min(edge) as edge, count(*) as ties, top as hits from t where hits = top group by query, top)
      select query, edge, hits from b where ties = 1 and hits >= 2""",
    "minimizer_runs": _PROBE
    + """, j as (select query, q.p, q.mm, case when idx.n = 1 then idx.edge end as hit from q left join idx using (mm)),
      n as (select *, (hit is distinct from lag(hit) over w or row_number() over w = 1)::int as new from j window w as (partition by query order by p, mm)),
      g as (select *, sum(new) over (partition by query order by p, mm rows unbounded preceding) as run from n)
      select query, hit as edge, min(p) as start, max(p) as stop, count(*) as n from g where hit is not null group by query, run, hit""",
}
