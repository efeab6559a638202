"""Queries on contigs, links, the graph and scaffolds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import contigs, graph, links, reads, scaffold
from ..sources.tables import table

LEAST = 13  # shared barcodes of a pair


def _contigs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "contigs")


def _links(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "contig_links")


def _sets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edge_barcodes", "edge", "kind", "keys", "cnts")


def _shared(s: SparkSession, d: str) -> DataFrame:
    return links.shared_counts(links.members(_sets(s, d), "L1"), LEAST)


def _pairs(s: SparkSession, d: str, least: int = 1) -> DataFrame:
    return links.mirrored(_links(s, d), _contigs(s, d)).filter(f"n >= {least}").selectExpr("v as u", "u as v")


def _scaffolds(s: SparkSession, d: str) -> DataFrame:
    return scaffold.scaffolds(_links(s, d), _contigs(s, d))


QUERIES = {
    "contig_lengths": lambda s, d: contigs.lengths(_contigs(s, d)),
    "contig_coverage": lambda s, d: contigs.coverage(_contigs(s, d)),
    "coverage_units": lambda s, d: contigs.units(_contigs(s, d)),
    "copy_ranges": lambda s, d: contigs.copies(_contigs(s, d)),
    "contig_classes": lambda s, d: contigs.classes(_contigs(s, d)),
    "n50_l50": lambda s, d: contigs.n50(_contigs(s, d)),
    "length_histogram": lambda s, d: contigs.length_histogram(_contigs(s, d)),
    "barcode_set_sizes": lambda s, d: links.set_sizes(_sets(s, d)),
    "barcode_sets_filtered": lambda s, d: links.members(_sets(s, d), None, 3).drop("kind").join(_contigs(s, d).selectExpr("edge_id as edge").distinct(), "edge", "left_semi").groupBy("edge").count().withColumnRenamed("count", "n"),
    "barcode_level_sets": lambda s, d: links.level_sets(_sets(s, d), _contigs(s, d)),
    "barcode_set_operations": lambda s, d: links.set_operations(_sets(s, d)),
    "barcode_positive": lambda s, d: links.positive(_sets(s, d), _links(s, d), _contigs(s, d)),
    "shared_barcode_pairs": _shared,
    "shared_barcode_pairs_low": lambda s, d: links.shared_counts(links.members(_sets(s, d), "L1"), 2),
    "shared_barcode_pairs_high": lambda s, d: links.shared_counts(links.members(_sets(s, d), "L1"), 50),
    "barcode_similarity": lambda s, d: links.similarity(links.members(_sets(s, d), "L1"), LEAST),
    "barcode_top_two": lambda s, d: links.top_two(_shared(s, d)),
    "mutual_best_pair": lambda s, d: links.mutual_best(_shared(s, d)),
    "candidate_top_k_gap": lambda s, d: links.candidates(links.similarity(links.members(_sets(s, d), "L1"), LEAST)),
    "link_counts": lambda s, d: links.latest_counts(_links(s, d)),
    "link_mirrored": lambda s, d: links.mirrored(_links(s, d), _contigs(s, d)),
    "next_candidate": lambda s, d: links.next_candidate(_links(s, d), _contigs(s, d)),
    "link_density": lambda s, d: links.dense(_links(s, d), _contigs(s, d)),
    "link_degree_filter": lambda s, d: links.sparse_degree(_pairs(s, d), 40),
    "link_one_strand": lambda s, d: links.one_strand(_pairs(s, d), _contigs(s, d)),
    "link_triangle_filter": lambda s, d: links.without_triangles(_pairs(s, d, 30)),
    "repeat_partners": lambda s, d: links.repeat_partners(_links(s, d), table(s, d, "repeat_contigs")),
    "graph_invariants": lambda s, d: graph.invariants(_contigs(s, d)),
    "node_degrees": lambda s, d: graph.degrees(_contigs(s, d)),
    "components": lambda s, d: graph.components(_contigs(s, d)),
    "component_sizes": lambda s, d: graph.component_sizes(_contigs(s, d)),
    "chain_condense": lambda s, d: graph.condense(_contigs(s, d)),
    "graph_tips": lambda s, d: graph.tips(_contigs(s, d)),
    "graph_chimeric": lambda s, d: graph.chimeric(_contigs(s, d)),
    "graph_loops": lambda s, d: graph.loops(_contigs(s, d)),
    "graph_bubbles": lambda s, d: graph.bubbles(_contigs(s, d)),
    "graph_crossings": lambda s, d: graph.crossings(_contigs(s, d)),
    "graph_simplify": lambda s, d: graph.simplify(_contigs(s, d)).drop("holes"),
    "bfs_levels": lambda s, d: graph.bfs(_contigs(s, d)),
    "neighbourhood": lambda s, d: graph.neighbourhood(_contigs(s, d)),
    "shortest_paths": lambda s, d: graph.shortest_paths(_contigs(s, d)),
    "path_counts": lambda s, d: graph.path_counts(_contigs(s, d)),
    "graph_bulges": lambda s, d: graph.bulges(_contigs(s, d)),
    "barcode_hits": lambda s, d: links.barcode_hits(_sets(s, d)),
    "adjacent_support": lambda s, d: links.adjacent_support(_sets(s, d), _contigs(s, d)),
    "crossing_support": lambda s, d: links.crossing_support(graph.crossings(_contigs(s, d)), _sets(s, d)),
    "local_reads": lambda s, d: reads.local_reads(table(s, d, "seq_reads"), links.mutual_best(_shared(s, d)), links.members(_sets(s, d), "L1")),
    "shared_reads": lambda s, d: reads.local_reads(table(s, d, "seq_reads"), links.mutual_best(_shared(s, d)), links.members(_sets(s, d), "L1"), both=True),
    "component_histogram": lambda s, d: graph.component_sizes(_contigs(s, d)).selectExpr("least(floor(bases / 10000), 34) as bin").groupBy("bin").count().withColumnRenamed("count", "n"),
    "downstream_reach": lambda s, d: graph.downstream_reach(_contigs(s, d)),
    "cyclic_core": lambda s, d: graph.cyclic_core(_contigs(s, d)),
    "scaffold_paths": _scaffolds,
    "scaffold_summary": lambda s, d: scaffold.summary(_scaffolds(s, d), _contigs(s, d)),
    "estimated_counts": lambda s, d: contigs.estimated_counts(_contigs(s, d)),
    "neighbour_coverage": lambda s, d: contigs.neighbour_coverage(_contigs(s, d)),
    "dead_ends": lambda s, d: contigs.dead_ends(_contigs(s, d)),
    "scaffold_refined": lambda s, d: scaffold.refined(_scaffolds(s, d), links.mirrored(_links(s, d), _contigs(s, d)), _contigs(s, d)),
    "scaffold_cover": lambda s, d: scaffold.cover(_scaffolds(s, d), _contigs(s, d)),
    "scaffold_totals": lambda s, d: scaffold.totals(_scaffolds(s, d), _contigs(s, d)),
    "scaffold_marks": lambda s, d: scaffold.marks(_contigs(s, d)),
    "adaptive_best": lambda s, d: scaffold.adaptive_best(links.similarity(links.members(_sets(s, d), "L1"), LEAST)),
    "scaffold_bridges": lambda s, d: scaffold.bridges(_scaffolds(s, d), _contigs(s, d)),
}

_C = """c0 as (select distinct * from contigs),
c as (select *, case when graph = 'global' then 45 else 31 end as k, coalesce(list_sum(list_transform(holes, lambda h: h.len)), 0)::int as hole_len, coalesce(len(holes), 0) as n_holes from c0),
e as (select edge_id, rc_id, node_from as u, node_to as v, graph, seq_len, cnt, k, holes, seq_len + hole_len as full_len, case when seq_len - (n_holes + 1) * k > 0 then cnt::double / (seq_len - (n_holes + 1) * k) end as cov from c)"""
_UNIT = """unit as (select graph, arg_max(cov, seq_len::hugeint * 10000000000000 - edge_id) as unit from e where cov is not null group by 1)"""
_M = """m as (select edge, kind, k as key, max(coalesce(c, 0)) as cnt from (select edge, kind, unnest(keys) as k, unnest(cnts) as c from edge_barcodes where edge is not null) where k <> -1 group by 1, 2, 3)"""
_PAIRS = f"""{_M}, l1 as (select edge, key from m where kind = 'L1'),
pairs as (select a.edge as e1, b.edge as e2, count(*) as n from l1 a join l1 b on a.key = b.key and a.edge < b.edge group by 1, 2 having count(*) >= {LEAST}),
bw as (select e1 as u, e2 as v, n from pairs union all select e2, e1, n from pairs)"""
_SCORE = f"""size as (select edge, count(*) as s from l1 group by 1),
scored as (select e1, e2, n, round(n / least(x.s, y.s), 6) as score from pairs join size x on x.edge = e1 join size y on y.edge = e2)"""
_TOP = """top as (select *, row_number() over (partition by u order by n desc, v) as k from bw),
two as (select a.u, a.v as best, a.n as n1, coalesce(b.n, 0) as n2 from top a left join top b on a.u = b.u and b.k = 2 where a.k = 1),
state as (select *, case when n1 > 2 * n2 then 'clear' when n1 > n2 then 'greater' else 'tie' end as state from two)"""
_L = """l as (select e1, e2, sum(coalesce(n_read, 0))::bigint as n_read, sum(coalesce(n_pair, 0))::bigint as n_pair from (select distinct * from contig_links) where e2 is not null and e1 <> e2 group by 1, 2)"""
_MIRROR = f"""{_L}, rc as (select distinct edge_id, rc_id from contigs where rc_id is not null),
j as (select l.e1 as v, l.e2 as u, n_pair as n, a.rc_id as v_rc, b.rc_id as u_rc from l left join rc a on a.edge_id = l.e1 left join rc b on b.edge_id = l.e2 where l.e2 is distinct from a.rc_id or a.rc_id is null),
mir as (select v, u, sum(n)::bigint as n from (select v, u, n from j union all select u_rc, v_rc, n from j where u_rc is not null and v_rc is not null) group by 1, 2),
p as (select v as u, u as v, n from mir where n >= {{least}})"""
_DEG = "deg as (select node, sum(i)::bigint as n_in, sum(o)::bigint as n_out from (select u as node, 0 as i, 1 as o from e union all select v, 1, 0 from e) group by 1)"
_NB = """starts as (select u, count(*) as n, max(cov) as cov from e group by 1), stops as (select v, count(*) as n, max(cov) as cov from e group by 1),
nb as (select e.*, a.n as n_out_u, a.cov as cov_out_u, b.n as n_in_v, b.cov as cov_in_v, coalesce(c.n, 0) as n_before, c.cov as max_before, coalesce(d.n, 0) as n_after, d.cov as max_after
  from e left join starts a on a.u = e.u left join stops b on b.v = e.v left join stops c on c.v = e.u left join starts d on d.u = e.v)"""
_LINKED = """meet as (select e.edge_id as a, f.edge_id as b from e join e f on e.u = f.u or e.u = f.v or e.v = f.v union select edge_id, rc_id from e where rc_id is not null union select rc_id, edge_id from e where rc_id is not null),
adj as (select a, b from meet union select b, a from meet)"""
_REACH = f"with recursive {_C}, {_LINKED}, reach as (select edge_id as id, edge_id as r from e union select adj.b as id, reach.r from reach join adj on adj.a = reach.id where reach.r < adj.b), comp as (select id as edge_id, min(r) as root from reach where id in (select edge_id from e) group by 1)"

_CROSS = """w as (select * from e where cov is not null),
      i as (select v as node, count(*) as n, arg_max(edge_id, (cov, -edge_id)) as hi, arg_min(edge_id, (cov, -edge_id)) as lo, max(cov) as ch, min(cov) as cl from w group by 1),
      o as (select u as node, count(*) as n, arg_max(edge_id, (cov, -edge_id)) as hi, arg_min(edge_id, (cov, -edge_id)) as lo, max(cov) as ch, min(cov) as cl from w group by 1),
      x as (select w.edge_id, i.hi as in_high, i.lo as in_low, o.hi as out_high, o.lo as out_low, i.ch > 1.7::double * i.cl and o.ch > 1.7::double * o.cl and least(i.ch, o.ch) >= 0.8::double * greatest(i.ch, o.ch) and least(i.cl, o.cl) >= 0.8::double * greatest(i.cl, o.cl) as resolved
      from w join deg x on x.node = w.u and x.n_in = 2 and x.n_out = 1 join deg y on y.node = w.v and y.n_in = 1 and y.n_out = 2 join i on i.node = w.u and i.n = 2 join o on o.node = w.v and o.n = 2)"""

SQL = {
    "estimated_counts": f"with {_C} select edge_id, floor(cov * full_len)::bigint as n from e",
    "neighbour_coverage": f"with {_C} select a.edge_id as e1, b.edge_id as e2, least(a.cov, b.cov) * 3::double < greatest(a.cov, b.cov) as too_different, least(a.cov, b.cov) >= 0.8::double * greatest(a.cov, b.cov) as similar from e a join e b on a.v = b.u and a.edge_id <> b.edge_id where a.cov is not null and b.cov is not null",
    "dead_ends": f"with {_C}, q as (select edge_id, u not in (select v from e) as no_before, v not in (select u from e) as no_after from e) select * from q where no_before or no_after",
    "scaffold_cover": "select distinct least(edge_id, rc_id) as edge_id, 1::bigint as n from contigs where rc_id is not null",
    "scaffold_marks": f"with {_C}, {_UNIT} select distinct edge_id, coalesce(greatest(1, least(3, floor(cov / round(unit, 6) + 0.5))), 1)::int as copies from e left join unit using (graph)",
    "adaptive_best": f"""with {_PAIRS}, {_SCORE}, b2 as (select e1 as u, e2 as v, score from scored union all select e2, e1, score from scored), b3 as (select u, v, score from (select *, row_number() over (partition by u order by score desc, v) as k from b2) where k = 1)
      select u, v, score from b3 where score >= (select avg(score) from scored) / 5""",
    "contig_lengths": f"with {_C} select edge_id, full_len, coalesce(list_sum(list_transform(list_filter(holes, lambda h: h.pos < 5000), lambda h: h.len)), 0)::int as head_hole from e",
    "contig_coverage": f"with {_C} select edge_id, round(cov, 6) as cov from e",
    "coverage_units": f"""with {_C}, {_UNIT} select graph, round(unit, 6) as longest_cov, round(sum(case when full_len >= 1000 then seq_len * floor(cov)::bigint end)::double / sum(case when full_len >= 1000 then seq_len end), 6) as mean_cov
      from e join unit using (graph) where cov is not null group by graph, unit""",
    "copy_ranges": f"""with {_C}, {_UNIT}, r as (select edge_id, cov / unit as r from e join unit using (graph) where cov is not null)
      select edge_id, (floor(r) + case when r - floor(r) > 0.75 then 1 else 0 end)::bigint as low, (floor(r) + case when r - floor(r) >= 0.25 then 1 else 0 end)::bigint as high from r""",
    "contig_classes": f"with {_C}, {_UNIT} select edge_id, case when seq_len >= 4000 then 'long' when seq_len >= 100 then 'short' else 'tiny' end as size_class, cov >= 0.15::double * unit as keep, cov > 1.2::double * unit as is_repeat from e left join unit using (graph)",
    "n50_l50": f"""with {_C}, o as (select graph, edge_id, seq_len::bigint as len from e where rc_id is null or edge_id <= rc_id),
      r as (select *, sum(len) over (partition by graph order by len desc, edge_id rows unbounded preceding) as upto, row_number() over (partition by graph order by len desc, edge_id) as k, sum(len) over (partition by graph) as total, max(len) over (partition by graph) as largest from o)
      select graph, total::bigint as total, largest, max(len) as n50, min(k) as l50 from r where upto * 2 >= total group by graph, total, largest""",
    "length_histogram": "select least(seq_len // 10000, 34)::bigint as bin, count(*) as n from (select distinct edge_id, seq_len from contigs) group by 1",
    "barcode_set_sizes": f"with {_M} select edge, kind, count(*) as n from m group by 1, 2",
    "barcode_sets_filtered": f"with {_M} select edge, count(*) as n from m where cnt >= 3 and edge in (select edge_id from contigs) group by 1",
    "barcode_level_sets": f"""with {_M}, s as (select edge, case kind when 'L0' then 0 when 'L1' then 1 when 'L2' then 2 end as r, count(*) as n from m where kind in ('L0', 'L1', 'L2') group by 1, 2),
      c as (select distinct edge_id as edge, seq_len from contigs where seq_len >= 200), w as (select edge, case when seq_len < 500 then 0 when seq_len < 3000 then 1 else 2 end as want from c)
      select w.edge, 'L' || want as level, coalesce(arg_max(s.n, s.r), 0) as n from w left join s on s.edge = w.edge and s.r <= want group by 1, 2""",
    "barcode_set_operations": f"""with {_M}, g as (select edge, key, max((kind = 'L0')::int) as a, max((kind = 'L1')::int) as b from m where kind in ('L0', 'L1') group by 1, 2)
      select edge, count(*) filter (a = 1 and b = 1) as n_both, count(*) filter (a = 1 and b = 0) as n_one, count(*) filter (a = 0 and b = 1) as n_two, count(*) as n_any from g group by 1""",
    "barcode_positive": f"""with {_M}, {_L}, l1 as (select edge, key from m where kind = 'L1'), s as (select edge, count(*) as s from l1 group by 1), c as (select distinct edge_id, seq_len from contigs),
      p as (select e1, e2 from l where e1 < e2), h as (select p.e1, p.e2, count(*) as n from p join l1 a on a.edge = e1 join l1 b on b.edge = e2 and a.key = b.key group by 1, 2)
      select p.e1, p.e2, case when x.seq_len >= 200 and y.seq_len >= 200 then (h.n is not null and h.n >= 0.044 * least(coalesce(s1.s, 0), coalesce(s2.s, 0)))::int end as verdict
      from p left join h using (e1, e2) left join c x on x.edge_id = p.e1 left join c y on y.edge_id = p.e2 left join s s1 on s1.edge = p.e1 left join s s2 on s2.edge = p.e2""",
    "shared_barcode_pairs": f"with {_PAIRS} select * from pairs",
    "shared_barcode_pairs_low": f"with {_M}, l1 as (select edge, key from m where kind = 'L1') select a.edge as e1, b.edge as e2, count(*) as n from l1 a join l1 b on a.key = b.key and a.edge < b.edge group by 1, 2 having count(*) >= 2",
    "shared_barcode_pairs_high": f"with {_M}, l1 as (select edge, key from m where kind = 'L1') select a.edge as e1, b.edge as e2, count(*) as n from l1 a join l1 b on a.key = b.key and a.edge < b.edge group by 1, 2 having count(*) >= 50",
    "barcode_similarity": f"with {_PAIRS}, {_SCORE} select * from scored",
    "barcode_top_two": f"with {_PAIRS}, {_TOP} select * from state",
    "mutual_best_pair": f"with {_PAIRS}, {_TOP} select a.u as e1, b.u as e2, a.n1 as n from state a join state b on a.u = b.best and a.best = b.u and a.u < b.u where a.state <> 'tie' and b.state <> 'tie'",
    "candidate_top_k_gap": f"""with {_PAIRS}, {_SCORE}, s as (select e1 as u, e2 as v, score from scored union all select e2, e1, score from scored),
      r as (select *, row_number() over w as rank, lag(score) over w as before from s window w as (partition by u order by score desc, v)),
      g as (select *, max((score = 0 or coalesce(score < 0.5 * before, false))::int) over (partition by u order by rank rows unbounded preceding) as cut from r where rank <= 11)
      select u, v, score, rank::int as rank from g where cut = 0""",
    "link_counts": f"with {_L} select * from l",
    "link_mirrored": f"with {_MIRROR.format(least=0)} select * from mir",
    "next_candidate": f"""with {_MIRROR.format(least=1)}, r as (select v, u, n, row_number() over (partition by v order by n desc, u) as k from mir where n > 0),
      t as (select a.v, a.u, a.n, coalesce(b.n, 0) as second from r a left join r b on a.v = b.v and b.k = 2 where a.k = 1)
      select * from t where n > 1.3 * (second + 10) and u in (select edge_id from contigs where seq_len >= 100)""",
    "link_density": f"""with {_L}, c as (select distinct edge_id, seq_len from contigs where seq_len >= 500)
      select e1, e2, n_read as n, round(n_read::double / (least(x.seq_len, 5000) + least(y.seq_len, 5000)), 8) as density from l join c x on x.edge_id = e1 join c y on y.edge_id = e2 where n_read >= 0.005::double * (least(x.seq_len, 5000) + least(y.seq_len, 5000))""",
    "link_degree_filter": f"with {_MIRROR.format(least=1)}, d as (select x from (select u as x from p union all select v from p) group by 1 having count(*) > 40) select u, v from p where u not in (select x from d) and v not in (select x from d)",
    "link_one_strand": f"with {_MIRROR.format(least=1)} select p.u, p.v from p left join rc on rc.edge_id = p.v where (p.u <> rc.rc_id or rc.rc_id is null) and not exists (select 1 from p q where q.u = p.u and q.v = rc.rc_id)",
    "link_triangle_filter": f"""with {_MIRROR.format(least=30)}, t as (select u from p group by 1 having count(*) = 2)
      select p.u, p.v from p where not exists (select 1 from p a join p b on a.v = b.u where a.u = p.u and b.v = p.v and p.u in (select u from t))""",
    "repeat_partners": f"with {_L} select edge_id, copies, count(*) as n_edges, sum(n_read)::bigint as n_read from l join (select distinct edge_id, copies from repeat_contigs) r on r.edge_id = l.e2 group by 1, 2",
    "graph_invariants": f"""with {_C}, j as (select e.*, t.edge_id as te, t.rc_id as trc, t.seq_len as tl, t.cnt as tc, t.holes as th from e left join e t on e.rc_id = t.edge_id where e.rc_id is not null),
      r as (select count(*) filter (te is null) as a, count(*) filter (trc is not null and trc <> edge_id) as b, count(*) filter (tl <> seq_len) as c, count(*) filter (tc <> cnt) as d, count(*) filter (len(holes) <> len(th)) as f from j)
      select 'rc_exists' as rule, a as violations from r union all select 'rc_of_rc', b from r union all select 'rc_length', c from r union all select 'rc_count', d from r union all select 'rc_holes', f from r
      union all select 'unique_id', count(*) from (select edge_id from e group by 1 having count(*) > 1) union all select 'null_node', count(*) filter (u is null) + count(*) filter (v is null) from e""",
    "node_degrees": f"with {_C}, {_DEG} select * from deg",
    "components": f"{_REACH} select * from comp",
    "component_sizes": f"{_REACH} select root, count(*) as n_edges, (sum(seq_len) // 2)::bigint as bases from comp join e using (edge_id) group by 1",
    "chain_condense": f"""with recursive {_C}, {_DEG},
      f as (select e.edge_id as id, p.edge_id as prev from e left join deg on deg.node = e.u and n_in = 1 and n_out = 1 left join e p on p.v = deg.node and p.edge_id <> e.edge_id and e.edge_id is distinct from p.rc_id),
      r as (select id, id as a from f union select r.id, f.prev from r join f on f.id = r.a where f.prev is not null),
      h as (select r.id, max(case when f.prev is null then r.a end) as top, min(r.a) as low from r join f on f.id = r.a group by 1),
      g as (select coalesce(top, low) as head, top is null as is_cycle, count(*) as n_edges, sum(seq_len) as l, max(k) as k, sum(coalesce(cnt, 0))::bigint as cnt from h join e on e.edge_id = h.id group by 1, 2)
      select head, n_edges, (l - (n_edges - case when is_cycle then 0 else 1 end) * k)::bigint as seq_len, cnt, is_cycle from g""",
    "graph_tips": f"""with {_C}, {_NB} select edge_id from nb where (n_before = 0 or n_after = 0) and (n_out_u > 1 or n_in_v > 1) and cov < greatest(cov_out_u, cov_in_v)
      and (seq_len < 150 or (seq_len < 200 and cov < 0.1::double * greatest(cov_out_u, cov_in_v)) or (cov < 10 and cov < 0.1::double * greatest(cov_out_u, cov_in_v)))""",
    "graph_chimeric": f"with {_C}, {_NB} select edge_id from nb where seq_len < 200 and cov < 15 and n_before > 0 and n_after > 0 and cov < 0.1::double * least(greatest(cov_out_u, max_before), greatest(cov_in_v, max_after))",
    "graph_loops": f"""with {_C} select edge_id, 'self' as kind from e where u = v union select a.edge_id, 'rc' from e a join e b on a.rc_id = b.edge_id where a.v = b.u and a.u <> a.v
      union select a.edge_id, 'two' from e a join e b on a.v = b.u and a.u = b.v where a.u <> a.v""",
    "graph_bubbles": f"with {_C} select u, v, arg_max(edge_id, seq_len::hugeint * 10000000000000 - edge_id) as kept, count(*) as n, sum(coalesce(cnt, 0))::bigint as cnt from e group by 1, 2 having count(*) > 1",
    "graph_crossings": f"with {_C}, {_DEG}, {_CROSS} select * from x",
    "crossing_support": f"""with {_C}, {_DEG}, {_CROSS}, {_M}, l1 as (select edge, key from m where kind = 'L1'),
      leg as (select edge_id, in_high as e1, out_high as e2, true as st from x union all select edge_id, in_low, out_low, true from x union all select edge_id, in_high, out_low, false from x union all select edge_id, in_low, out_high, false from x),
      n as (select edge_id, e1, e2, st, (select count(*) from l1 a join l1 b on a.key = b.key where a.edge = e1 and b.edge = e2) as n from leg),
      g as (select edge_id, sum(case when st then n else 0 end)::bigint as straight, sum(case when not st then n else 0 end)::bigint as crossed from n group by 1)
      select *, case when straight > 2 * crossed then 'straight' when crossed > 2 * straight then 'crossed' else 'open' end as verdict from g""",
    "adjacent_support": f"""with {_C}, {_M}, l1 as (select edge, key from m where kind = 'L1'), p as (select distinct a.edge_id as e1, b.edge_id as e2 from e a join e b on a.v = b.u and a.edge_id <> b.edge_id),
      h as (select e1, e2, count(*) as n from p join l1 a on a.edge = e1 join l1 b on b.edge = e2 and a.key = b.key group by 1, 2) select e1, e2, coalesce(n, 0) as n from p left join h using (e1, e2)""",
    "barcode_hits": f"""with {_M}, g as (select key, count(*) as n_edges, sum(cnt)::bigint as n_hits, max(cnt) as top, arg_max(edge, (cnt, -edge)) as best from m where kind = 'L1' group by 1)
      select key, n_edges, n_hits, best, n_edges <= 2 or top >= 0.85::double * n_hits as is_sure from g""",
    "path_counts": f"""with recursive {_C}, far as (select * from e where seq_len >= 4000), inn as (select u, v, seq_len - k as a from e where seq_len < 3000),
      r as (select edge_id as src, rc_id as src_rc, v as node, 0::bigint as ins, 0 as n from far union all select r.src, r.src_rc, inn.v, r.ins + a, r.n + 1 from r join inn on inn.u = r.node where r.n < 30 and r.ins + a <= 4000)
      select src, far.edge_id as des, count(*) as n_paths from r join far on far.u = r.node where far.edge_id <> src and far.edge_id is distinct from src_rc group by 1, 2""",
    "graph_bulges": f"""with recursive {_C}, sh as (select u, v, edge_id, seq_len::bigint as l, seq_len - k as a from e where seq_len <= 1200 and seq_len > k),
      w as (select x.edge_id as x, x.v as xv, x.seq_len as xl, sh.v as tip, sh.l, 1 as n from e x join sh on sh.u = x.u and sh.edge_id <> x.edge_id where x.seq_len <= 1000 and sh.l <= 1.2::double * x.seq_len
        union select x, xv, xl, sh.v, w.l + sh.a, n + 1 from w join sh on sh.u = w.tip and sh.edge_id <> x where w.l + sh.a <= 1.2::double * xl),
      h as (select x, n, l from w where n > 1 and tip = xv and l >= 0.8::double * xl)
      select x as edge_id, min(n) as n_edges, arg_min(l, n * 1000000 + l) as length from h group by 1""",
    "local_reads": f"""with {_PAIRS}, {_TOP}, mb as (select a.u as e1, b.u as e2 from state a join state b on a.u = b.best and a.best = b.u and a.u < b.u where a.state <> 'tie' and b.state <> 'tie'),
      r as (select distinct read_id, mate, regexp_extract(info, 'BX:Z:([^ \t]*)', 1) as bx from seq_reads where contains(info, 'BX:Z:')), t as (select read_id, mate, list_reduce(list_concat([0::bigint], list_transform(string_split(bx, ''), lambda c: (instr('ACGTN', c) - 1)::bigint)), lambda a, b: a * 5 + b) as code from r where regexp_full_match(bx, '[ACGTN]{{18}}')),
      z as (select read_id, mate, coalesce(length(seq), 0) as bases from (select distinct read_id, mate, seq from seq_reads)), per as (select code, count(*) as n, sum(bases) as bases from t join z using (read_id, mate) group by 1),
      k as (select distinct e1, e2, key from mb join l1 on l1.edge = e1 or l1.edge = e2), g as (select e1, e2, sum(n)::bigint as n_reads, sum(bases)::bigint as n_bases from k join per on per.code = k.key group by 1, 2)
      select e1, e2, coalesce(n_reads, 0) as n_reads, coalesce(n_bases, 0) as n_bases from mb left join g using (e1, e2)""",
    "shared_reads": f"""with {_PAIRS}, {_TOP}, mb as (select a.u as e1, b.u as e2 from state a join state b on a.u = b.best and a.best = b.u and a.u < b.u where a.state <> 'tie' and b.state <> 'tie'),
      r as (select distinct read_id, mate, regexp_extract(info, 'BX:Z:([^ \t]*)', 1) as bx from seq_reads where contains(info, 'BX:Z:')), t as (select read_id, mate, list_reduce(list_concat([0::bigint], list_transform(string_split(bx, ''), lambda c: (instr('ACGTN', c) - 1)::bigint)), lambda a, b: a * 5 + b) as code from r where regexp_full_match(bx, '[ACGTN]{{18}}')),
      z as (select read_id, mate, coalesce(length(seq), 0) as bases from (select distinct read_id, mate, seq from seq_reads)), per as (select code, count(*) as n, sum(bases) as bases from t join z using (read_id, mate) group by 1),
      k as (select e1, e2, key from mb join l1 on l1.edge = e1 or l1.edge = e2 group by 1, 2, 3 having count(*) = 2), g as (select e1, e2, sum(n)::bigint as n_reads, sum(bases)::bigint as n_bases from k join per on per.code = k.key group by 1, 2)
      select e1, e2, coalesce(n_reads, 0) as n_reads, coalesce(n_bases, 0) as n_bases from mb left join g using (e1, e2)""",
    "component_histogram": f"{_REACH}, s as (select root, (sum(seq_len) // 2)::bigint as bases from comp join e using (edge_id) group by 1) select least(bases // 10000, 34)::bigint as bin, count(*) as n from s group by 1",
    "downstream_reach": f"""with recursive {_C}, o as (select edge_id, u, v, greatest(0, seq_len - k)::bigint as own from e),
      w as (select edge_id as s, v, least(1000, own) as l from o union select w.s, o.v, least(1000, w.l + o.own) from w join o on o.u = w.v where w.l < 1000)
      select s as edge_id, max(l) as reach from w group by 1""",
    "cyclic_core": f"""with recursive {_C}, r as (select u as a, v as b from e union select r.a, e.v from r join e on e.u = r.b), ring as (select a as n from r where a = b),
      after as (select n from ring union select r.b from ring join r on r.a = ring.n), before as (select n from ring union select r.a from ring join r on r.b = ring.n)
      select edge_id from e where u in (select n from after) and v in (select n from before)""",
    "bfs_levels": f"""with recursive {_C}, s as (select graph, arg_max(edge_id, seq_len::hugeint * 10000000000000 - edge_id) as edge_id from e group by 1),
      b(graph, edge_id, level) using key (graph, edge_id) as (select graph, edge_id, 0 from s union select b.graph, f.edge_id, min(b.level) + 1 from b join e on e.edge_id = b.edge_id join e f on f.u = e.v
        where not exists (select 1 from recurring.b r where r.graph = b.graph and r.edge_id = f.edge_id) group by 1, 2)
      select graph, edge_id, level from b""",
    "neighbourhood": f"""with {_C}, s as (select distinct a.edge_id, b.edge_id as t from e a join e b on a.v = b.u), d as (select edge_id, t, 1 as d from s union all select a.edge_id, b.t, 2 from s a join s b on a.t = b.edge_id),
      m as (select edge_id, t, min(d) as d from d where edge_id <> t group by 1, 2) select edge_id, count(*) filter (d = 1) as n1, count(*) filter (d = 2) as n2 from m group by 1""",
    "shortest_paths": f"""with recursive {_C}, far as (select * from e where seq_len >= 4000), inn as (select u, v, seq_len - k as a from e where seq_len < 3000 and seq_len > k),
      r as (select edge_id as src, rc_id as src_rc, v as node, 0::bigint as ins, 0 as n from far union select r.src, r.src_rc, inn.v, r.ins + a, r.n + 1 from r join inn on inn.u = r.node where r.ins + a <= 4000),
      t as (select src, far.edge_id as des, ins, n from r join far on far.u = r.node where far.edge_id <> src and far.edge_id is distinct from src_rc)
      select src, des, min(ins) as inserted, arg_min(n, ins * 100 + n) as n_middle from t group by 1, 2""",
}
