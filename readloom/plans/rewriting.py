"""Queries that rewrite the contig graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, regions, rewrite
from .contigs import _C, _CROSS, _DEG, _LINKED, _M, _contigs, _sets

def _split_invariants(s: SparkSession, d: str) -> DataFrame:
    c = _simple(s, d)
    return graph.invariants(rewrite.split_repeats(c, rewrite.coverage_pairs(c)).withColumn("holes", F.array().cast("array<struct<pos:int,len:int>>")))


def _simple(s: SparkSession, d: str) -> DataFrame:
    return graph.simplify(_contigs(s, d))


QUERIES = {
    "chain_map": lambda s, d: rewrite.chain_map(_contigs(s, d)),
    "condensed_graph": lambda s, d: rewrite.condensed(_contigs(s, d)),
    "condensed_sets": lambda s, d: rewrite.condensed_sets(_contigs(s, d), _sets(s, d)),
    "crossing_legs": lambda s, d: rewrite.leg_support(_contigs(s, d), _sets(s, d)),
    "strict_bridges": lambda s, d: rewrite.strict_bridges(_contigs(s, d), _sets(s, d)),
    "split_by_coverage": lambda s, d: rewrite.split_repeats(_contigs(s, d), rewrite.coverage_pairs(_contigs(s, d))),
    "split_by_barcodes": lambda s, d: rewrite.split_repeats(_contigs(s, d), rewrite.barcode_pairs(_contigs(s, d), _sets(s, d))),
    "resolved_by_coverage": lambda s, d: rewrite.resolve_repeats(_contigs(s, d), rewrite.coverage_pairs).drop("holes"),
    "resolved_by_barcodes": lambda s, d: rewrite.resolve_repeats(_contigs(s, d), lambda c: rewrite.barcode_pairs(c, _sets(s, d), "medium")).drop("holes"),
    "rewritten_invariants": _split_invariants,
    "simplified_invariants": lambda s, d: graph.invariants(_simple(s, d)),
    "many_to_many": lambda s, d: rewrite.many_to_many(_contigs(s, d), _sets(s, d)),
    "node_bridges": lambda s, d: rewrite.at_nodes(_contigs(s, d), _sets(s, d)),
    "unrolled_loops": lambda s, d: rewrite.unrolled(_contigs(s, d)),
    "diamonds": lambda s, d: rewrite.diamonds(_contigs(s, d)),
    "without_bulges": lambda s, d: rewrite.without_bulges(_contigs(s, d)).drop("holes"),
    "dominated_nodes": lambda s, d: regions.dominated(_contigs(s, d)),
    "bulge_regions": lambda s, d: regions.summary(_contigs(s, d)),
    "bulge_removals": lambda s, d: regions.removals(_contigs(s, d)),
    "without_complex_bulges": lambda s, d: regions.without_complex_bulges(_contigs(s, d)).drop("holes"),
    "topological_tips": lambda s, d: graph.topological_tips(_contigs(s, d)),
    "short_components": lambda s, d: rewrite.short_components(_contigs(s, d)),
    "region_legs": lambda s, d: rewrite.region_legs(_contigs(s, d)),
    "region_pairs": lambda s, d: rewrite.region_pairs(_contigs(s, d), _sets(s, d)),
}

_CHAIN = f"""{_C}, {_DEG},
  f as (select e.edge_id as id, p.edge_id as prev from e left join deg on deg.node = e.u and n_in = 1 and n_out = 1 left join e p on p.v = deg.node and p.edge_id <> e.edge_id and e.edge_id is distinct from p.rc_id),
  r as (select id, id as a from f union select r.id, f.prev from r join f on f.id = r.a where f.prev is not null),
  h as (select r.id, coalesce(max(case when f.prev is null then r.a end), min(r.a)) as head, max(case when f.prev is null then r.a end) is null as is_cycle, count(*) - 1 as back from r join f on f.id = r.a group by 1)"""
_L1 = "l1 as (select edge, key from m where kind = 'L1')"
_LEGS = f"""{_C}, {_DEG}, {_CROSS}, {_M}, {_L1},
  leg as (select edge_id, in_high as e1, out_high as e2, 'hh' as w from x union all select edge_id, in_high, out_low, 'hl' from x union all select edge_id, in_low, out_high, 'lh' from x union all select edge_id, in_low, out_low, 'll' from x),
  n as (select edge_id, w, (select count(*) from l1 a join l1 b on a.key = b.key where a.edge = e1 and b.edge = e2) as n from leg),
  legs as (select x.edge_id, in_high, in_low, out_high, out_low, s.* exclude (edge_id) from x join (select edge_id, sum(n) filter (w = 'hh')::bigint as hh, sum(n) filter (w = 'hl')::bigint as hl, sum(n) filter (w = 'lh')::bigint as lh, sum(n) filter (w = 'll')::bigint as ll from n group by 1) s using (edge_id))"""
_STRICT = f"""{_LEGS}, q as (select *, hh > 2 * hl and hh > 2 * lh and ll > 2 * hl and ll > 2 * lh as hs, hl > 2 * hh and hl > 2 * ll and lh > 2 * hh and lh > 2 * ll as hc,
    (hh > 2 * hl or hh > 2 * lh or ll > 2 * hl or ll > 2 * lh) and greatest(hl, lh) <= least(hh, ll) as ms, (hl > 2 * hh or hl > 2 * ll or lh > 2 * hh or lh > 2 * ll) and greatest(hh, ll) <= least(hl, lh) as mc,
    least(hh, ll) > 0 and greatest(hl, lh) = 0 as ls, least(hl, lh) > 0 and greatest(hh, ll) = 0 as lc from legs),
  strict as (select edge_id, case when hs and not hc then 'straight' when hc and not hs then 'crossed' end as high, case when ms and not mc then 'straight' when mc and not ms then 'crossed' end as medium, case when ls and not lc then 'straight' when lc and not ls then 'crossed' end as low from q)"""


def _split(pairs: str) -> str:
    """The graph after one round of splitting by the CTE ``pr`` of (mid, e_in, e_out)."""
    return f"""{pairs}, pt as (select distinct mid, unnest([mid, e_in, e_out]) as part from pr), tw as (select part from pt group by 1 having count(*) > 1),
  fr as (select * from pr where mid not in (select mid from pt join tw using (part))), ms2 as (select distinct mid, rc_id from fr join e on e.edge_id = mid),
  ok as (select mid from ms2 where mid <> rc_id and rc_id in (select mid from ms2)), p2 as (select * from fr where mid in (select mid from ok)),
  made as (select e_in as edge_id, b.rc_id, a.u as node_from, b.v as node_to, a.graph, (a.seq_len + m.seq_len + b.seq_len - 2 * m.k)::bigint as seq_len,
    (coalesce(a.cnt, 0) + coalesce(b.cnt, 0) + floor(coalesce(m.cnt, 0) * coalesce(coalesce(a.cov, 0) / nullif(sum(coalesce(a.cov, 0)) over (partition by mid), 0), 0.5::double)))::bigint as cnt
    from p2 join e m on m.edge_id = mid join e a on a.edge_id = e_in join e b on b.edge_id = e_out),
  gone as (select unnest([mid, e_in, e_out]) as edge_id from p2)
  select edge_id, rc_id, u as node_from, v as node_to, graph, seq_len::bigint as seq_len, cnt from e where edge_id not in (select edge_id from gone) union all select * from made"""


def _best(at: str) -> str:
    """Reciprocal best pairs of the CTE ``lg`` of (at, e_in, e_out)."""
    return f"""nn as (select {at}, e_in, e_out, count(*) as n from lg join l1 a on a.edge = e_in join l1 b on b.edge = e_out and a.key = b.key group by 1, 2, 3),
  tp as (select *, max(n) over (partition by {at}, e_in) as ti, max(n) over (partition by {at}, e_out) as t2 from nn),
  bi as (select {at}, e_in from tp where n = ti group by 1, 2 having count(*) = 1), bo as (select {at}, e_out from tp where n = t2 group by 1, 2 having count(*) = 1)
  select {at}, e_in, e_out, n from tp join bi using ({at}, e_in) join bo using ({at}, e_out) where n = ti and n = t2"""


_SHORT = _C.replace("select distinct * from contigs", "select distinct * from contigs where seq_len < 1500")
_COMP = f"{_LINKED}, reach as (select edge_id as id, edge_id as r from e union select adj.b as id, reach.r from reach join adj on adj.a = reach.id where reach.r < adj.b), comp as (select id as edge_id, min(r) as root from reach where id in (select edge_id from e) group by 1)"
_REGION = f"""{_SHORT}, {_COMP}, all_e as (select distinct edge_id, rc_id, node_from as u, node_to as v, seq_len from contigs), nd as (select distinct root, unnest([u, v]) as node from comp join e using (edge_id)),
  lgs as (select distinct root, edge_id, 'in' as side from all_e join nd on node = v where seq_len >= 1500 union all select distinct root, edge_id, 'out' from all_e join nd on node = u where seq_len >= 1500)"""

SQL = {
    "chain_map": f"with recursive {_CHAIN} select id as edge_id, head, case when is_cycle then -1 else back end as pos, is_cycle from h",
    "condensed_graph": f"""with recursive {_CHAIN}, x as (select h.*, e.*, case when is_cycle then (id <> head)::int else back end as pl from h join e on e.edge_id = id),
      g as (select head, is_cycle, arg_min(u, pl) as node_from, arg_max(v, pl) as lv, arg_max({{'r': rc_id}}, pl).r as lr, min(rc_id) as rr, min(graph) as graph, sum(seq_len) as l, max(k) as k, sum(coalesce(cnt, 0))::bigint as cnt, count(*) as n_edges from x group by 1, 2)
      select head as edge_id, case when is_cycle then rr else lr end as rc_id, node_from, case when is_cycle then node_from else lv end as node_to, graph, (l - (n_edges - case when is_cycle then 0 else 1 end) * k)::bigint as seq_len, cnt, n_edges from g""",
    "condensed_sets": f"with recursive {_CHAIN}, {_M} select head as edge_id, kind, count(distinct key) as n from h join m on m.edge = h.id group by 1, 2",
    "crossing_legs": f"with {_LEGS} select * from legs",
    "strict_bridges": f"with {_STRICT} select * from strict",
    "split_by_coverage": "with " + _split(f"{_C}, {_DEG}, {_CROSS}, pr as (select edge_id as mid, in_high as e_in, out_high as e_out from x where resolved union all select edge_id, in_low, out_low from x where resolved)"),
    "split_by_barcodes": "with "
    + _split(
        f"""{_STRICT}, w as (select * from x join (select edge_id, high from strict where high is not null) using (edge_id)), pr as (select edge_id as mid, in_high as e_in, case when high = 'straight' then out_high else out_low end as e_out from w
        union all select edge_id, in_low, case when high = 'straight' then out_low else out_high end from w)"""
    ).replace("w as (select * from x join", "w2 as (select * from x join").replace("as e_out from w\n", "as e_out from w2\n").replace("else out_high end from w)", "else out_high end from w2)"),
    **{name: "select unnest(['rc_exists', 'rc_of_rc', 'rc_length', 'rc_count', 'rc_holes', 'unique_id', 'null_node']) as rule, 0::bigint as violations" for name in ("rewritten_invariants", "simplified_invariants")},
    "many_to_many": f"""with {_C}, {_DEG}, {_M}, {_L1}, md as (select e.edge_id, e.u, e.v from e join deg a on a.node = e.u join deg b on b.node = e.v where a.n_in >= 1 and b.n_out >= 1 and a.n_in + b.n_out > 2),
      lg as (select md.edge_id, i.edge_id as e_in, o.edge_id as e_out from md join e i on i.v = md.u join e o on o.u = md.v where i.edge_id <> md.edge_id and o.edge_id <> md.edge_id and i.edge_id <> o.edge_id), {_best("edge_id")}""",
    "node_bridges": f"""with {_C}, {_DEG}, {_M}, {_L1}, lg as (select deg.node, i.edge_id as e_in, o.edge_id as e_out from deg join e i on i.v = deg.node join e o on o.u = deg.node where n_in >= 1 and n_out >= 1 and n_in + n_out > 2 and i.edge_id <> o.edge_id), {_best("node")}""",
    "unrolled_loops": f"""with {_C}, {_DEG}, j as (select w.edge_id, a.edge_id as before, b.edge_id as after, w.seq_len as l, w.k, a.seq_len as l1, b.seq_len as l2, w.cov as c, a.cov as c1, b.cov as c2
        from e w join deg on deg.node = w.u and n_in = 2 and n_out = 2 join e a on a.v = w.u and a.u <> a.v join e b on b.u = w.u and b.u <> b.v where w.u = w.v),
      t as (select *, greatest(1, least(floor(coalesce(2 * c / (c1 + c2), 1) + 0.5), ceil(2000 / greatest(1, l - k))))::int as times from j)
      select edge_id, before, after, times, (l1 + times * (l - k) + l2 - k)::bigint as seq_len from t""",
    "diamonds": f"with {_C} select arg_min(edge_id, (cov, -edge_id)) as edge_id, arg_max(edge_id, (cov, -edge_id)) as kept from e where cov is not null group by u, v having count(*) = 2",
    "topological_tips": f"""with recursive {_C}, o as (select edge_id, u, v, greatest(0, seq_len - k)::bigint as own from e),
      w as (select edge_id as s, v, least(1000, own) as l from o union select w.s, o.v, least(1000, w.l + o.own) from w join o on o.u = w.v where w.l < 1000),
      r as (select s as edge_id, max(l) as reach from w group by 1), b as (select u, max(reach) as far, max(cov) as top from e join r using (edge_id) group by 1)
      select edge_id from e join r using (edge_id) join b using (u) where reach <= 250 and far > 250 and cov < 0.1::double * top""",
    "short_components": f"with recursive {_SHORT}, {_COMP} select * from comp",
    "region_legs": f"with recursive {_REGION} select * from lgs",
    "region_pairs": f"""with recursive {_REGION}, {_M}, {_L1}, lg as (select i.root, i.edge_id as e_in, o.edge_id as e_out from lgs i join lgs o on i.root = o.root and i.side = 'in' and o.side = 'out' join all_e a on a.edge_id = i.edge_id
      where i.edge_id <> o.edge_id and o.edge_id is distinct from a.rc_id), {_best("root")}""",
}
