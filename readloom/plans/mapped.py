"""Queries that map reads onto the graph they make, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, links, mapping, reads, rewrite, unitigs
from ..operators import graph as graphs
from ..session import cut
from .contigs import _M, _PAIRS, _TOP, _sets, _shared
from .reads import _CODE5, _R, _REVCOMP, _graph, _kmers, _reads


def _made(s: SparkSession, d: str, k: int = 45) -> DataFrame:
    return cut(unitigs.read_graph(_reads(s, d), k))


def _on(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = _made(s, d)
    return cut(mapping.read_edges(_reads(s, d), g)), g


def _mates(s: SparkSession, d: str) -> DataFrame:
    r = reads.clean(_reads(s, d).select("read_id", "mate", "seq")).filter("length(seq) > 0")
    side = lambda m: r.filter(F.col("mate") == m).groupBy("read_id").agg(F.min(F.upper("seq")).alias(f"s{m}"))
    return side(1).join(side(2), "read_id")


def _pairs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return links.mutual_best(cut(_shared(s, d))), links.members(_sets(s, d), "L1")


QUERIES = {
    "edge_kmer_index": lambda s, d: mapping.unique_index(_made(s, d)).drop("hi"),
    "read_edges": lambda s, d: mapping.read_edges(_reads(s, d), _made(s, d)),
    "read_paths": lambda s, d: mapping.read_paths(_reads(s, d), _made(s, d)),
    "mapped_pairs": lambda s, d: mapping.mapped_pairs(*_on(s, d)),
    "mapped_barcodes": lambda s, d: mapping.mapped_barcodes(_on(s, d)[0], _reads(s, d)),
    "edge_counts": lambda s, d: mapping.edge_counts(_reads(s, d), _made(s, d), 45),
    "junction_support": lambda s, d: mapping.junctions(_reads(s, d), _made(s, d, 31), 31, 45),
    "reads_of_pairs": lambda s, d: mapping.reads_of_pairs(_reads(s, d), *_pairs(s, d)),
    "reads_of_both": lambda s, d: mapping.reads_of_pairs(_reads(s, d), *_pairs(s, d), both=True),
    "spliced_mates": lambda s, d: mapping.spliced(_mates(s, d), 15, 100, "ACGT", 5),
    "read_graph_tips": lambda s, d: graphs.tips(_made(s, d)),
    "read_graph_invariants": lambda s, d: graphs.invariants(_made(s, d)),
    "read_graph_simplified": lambda s, d: rewrite.condensed(graphs.simplify(_made(s, d))),
    "similar_parallel": lambda s, d: alignment.similar_parallel(_made(s, d, 31)),
}

_G = f"with recursive {_graph(45)}"
_IDX = """ek as (select edge_id, (i - 1)::int as pos, substr(seq, i::int, 31) as km from g, unnest(range(1, length(seq) - 29)) t(i)),
  idx as (select km, min(edge_id) as edge_id, min(pos) as pos from ek group by 1 having count(*) = 1)"""
_HITS = f"""{_IDX}, rr as (select distinct read_id, mate, seq from seq_reads), rk as (select read_id, mate, (i - 1)::int as pl, substr(upper(seq), i::int, 31) as km from rr, unnest(range(1, greatest(1, length(seq) - 29))) t(i) where length(seq) >= 31),
  ht as (select read_id, mate, pl, edge_id, pos from rk join idx using (km))"""
_ON = f"""{_HITS}, hh as (select read_id, mate, edge_id, count(*) as hits, min(pos) as start, max(pos) as stop from ht group by 1, 2, 3),
  onb as (select read_id, mate, edge_id, hits, start, stop from (select *, count(*) over (partition by read_id, mate, hits) as c, max(hits) over (partition by read_id, mate) as top from hh) where hits = top and c = 1)"""
_BX = f"""bx as (select read_id, mate, {_CODE5.format("b")} as code from (select distinct read_id, mate, regexp_extract(info, 'BX:Z:([^ \t]*)', 1) as b from seq_reads where contains(info, 'BX:Z:')) where regexp_full_match(b, '[ACGTN]{{18}}'))"""


def _pair_reads(both: str) -> str:
    return f"""with {_PAIRS}, {_TOP}, mb as (select a.u as e1, b.u as e2 from state a join state b on a.u = b.best and a.best = b.u and a.u < b.u where a.state <> 'tie' and b.state <> 'tie'),
      k as (select e1, e2, key from mb join l1 on l1.edge = e1 or l1.edge = e2 group by 1, 2, 3 having count(*) {both}),
      rr as (select distinct read_id, mate, info, seq, qual from seq_reads where contains(info, 'BX:Z:')), rb as (select *, regexp_extract(info, 'BX:Z:([^ \t]*)', 1) as b from rr), rc2 as (select read_id, mate, seq, qual, {_CODE5.format("b")} as code from rb where regexp_full_match(b, '[ACGTN]{{18}}'))
      select e1, e2, read_id, mate, seq, qual from k join rc2 on rc2.code = k.key"""


SQL = {
    "edge_kmer_index": f"{_G}, {_IDX} select list_reduce(list_concat([0::bigint], list_transform(string_split(km, ''), lambda c: (instr('ACGT', c) - 1)::bigint)), lambda a, b: a * 4 + b) as lo, edge_id, pos from idx",
    "read_edges": f"{_G}, {_ON} select * from onb",
    "read_paths": f"""{_G}, {_HITS}, nw as (select *, edge_id is distinct from lag(edge_id) over (partition by read_id, mate order by pl) as is_new from ht)
      select read_id, mate, list(edge_id order by pl) filter (is_new) as path, min(pl) as first_at, max(pl) as last_at from nw group by 1, 2 having count(*) filter (is_new) > 1""",
    "mapped_pairs": f"{_G}, {_ON} select a.edge_id as e1, g.rc_id as e2, count(*) as n_pair from onb a join onb b on a.read_id = b.read_id and a.mate = 1 and b.mate = 2 join g on g.edge_id = b.edge_id where a.edge_id <> g.rc_id group by 1, 2",
    "mapped_barcodes": f"{_G}, {_ON}, {_BX} select edge_id, code, count(*) as n from onb join bx using (read_id, mate) group by 1, 2",
    "edge_counts": f"{_G}, al as (select least(km, rc) as km, count(*) as n from k group by 1), ew as (select edge_id, substr(seq, i::int, 46) as w from g, unnest(range(1, length(seq) - 44)) t(i)) select edge_id, sum(coalesce(n, 0))::bigint as cnt from ew left join al on al.km = least(w, {_REVCOMP.format('w')}) group by 1",
    "junction_support": f"""with recursive {_graph(31)}, rd as (select distinct read_id, mate, seq from seq_reads), lk as (select distinct least(w, {_REVCOMP.format('w')}) as km from (select substr(upper(seq), i::int, 45) as w from rd, unnest(range(1, greatest(1, length(seq) - 43))) t(i) where length(seq) >= 45) where regexp_full_match(w, '[ACGT]+')),
      j as (select a.edge_id as e1, b.edge_id as e2, right(a.seq, 44) || substr(b.seq, 32, 13) as seq from g a join g b on a.node_to = b.node_from),
      w as (select e1, e2, i as pl, substr(seq, i::int, 45) as w from j, unnest(range(1, greatest(1, length(seq) - 43))) t(i) where length(seq) >= 45),
      jx as (select e1, e2, pl, least(w, {_REVCOMP.format('w')}) not in (select km from lk) as gone from w),
      y as (select *, pl - row_number() over (partition by e1, e2, gone order by pl) as run from jx), z as (select e1, e2, gone, run, count(*) as c from y group by 1, 2, 3, 4)
      select e1, e2, sum(c)::bigint as n_kmers, coalesce(sum(c) filter (gone), 0)::bigint as n_missing, coalesce(max(c) filter (gone), 0) as longest from z group by 1, 2""",
    "reads_of_pairs": _pair_reads(">= 1"),
    "reads_of_both": _pair_reads("= 2"),
    "spliced_mates": f"""{_R}, a as (select read_id, min(upper(seq)) filter (mate = 1) as s1, min(upper(seq)) filter (mate = 2) as s2 from r where length(seq) > 0 group by 1 having count(*) filter (mate = 1) > 0 and count(*) filter (mate = 2) > 0)
      select read_id, case when length(s1) > 15 and length(s2) > 15 then s1 || substr(s2, 16) end as overlapped, s1 || repeat('N', 100) || s2 as gapped, length(s1)::int as hole_pos, left(s1, greatest(0, length(s1) - 5)) || 'ACGT' || substr(s2, 6) as filled from a""",
    "read_graph_tips": f"""{_G}, ge as (select *, node_from as u, node_to as v, case when seq_len > 45 then cnt::double / (seq_len - 45) end as cov from g), starts as (select u, count(*) as n, max(cov) as cov from ge group by 1), stops as (select v, count(*) as n, max(cov) as cov from ge group by 1),
      nb as (select ge.*, a.n as n_out_u, a.cov as cov_out_u, b.n as n_in_v, b.cov as cov_in_v, coalesce(c.n, 0) as n_before, coalesce(d.n, 0) as n_after from ge left join starts a on a.u = ge.u left join stops b on b.v = ge.v left join stops c on c.v = ge.u left join starts d on d.u = ge.v)
      select edge_id from nb where (n_before = 0 or n_after = 0) and (n_out_u > 1 or n_in_v > 1) and cov < greatest(cov_out_u, cov_in_v)
      and (seq_len < 150 or (seq_len < 200 and cov < 0.1::double * greatest(cov_out_u, cov_in_v)) or (cov < 10 and cov < 0.1::double * greatest(cov_out_u, cov_in_v)))""",
    "read_graph_invariants": "select unnest(['rc_exists', 'rc_of_rc', 'rc_length', 'rc_count', 'rc_holes', 'unique_id', 'null_node']) as rule, 0::bigint as violations",
}
