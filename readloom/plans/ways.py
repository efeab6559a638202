"""Queries on ways through the contig graph, with their SQL."""

from __future__ import annotations

from ..operators import paths
from .contigs import _C, _DEG, _M, _MIRROR, _UNIT, _contigs, _links, _sets

QUERIES = {
    "path_lists": lambda s, d: paths.listed(_contigs(s, d)),
    "path_lists_twice": lambda s, d: paths.listed(_contigs(s, d), most=2000, uses=2),
    "path_shortest": lambda s, d: paths.shortest(paths.listed(_contigs(s, d))),
    "path_ranks": lambda s, d: paths.ranked(paths.listed(_contigs(s, d))),
    "path_kinds": lambda s, d: paths.kinds(paths.listed(_contigs(s, d))),
    "path_edges": lambda s, d: paths.on_paths(paths.listed(_contigs(s, d))),
    "path_middle": lambda s, d: paths.best_middle(paths.listed(_contigs(s, d)), _contigs(s, d)),
    "path_support": lambda s, d: paths.best_supported(paths.listed(_contigs(s, d)), _links(s, d), _contigs(s, d)),
    "longest_paths": lambda s, d: paths.longest(_contigs(s, d)),
    "plain_regions": lambda s, d: paths.plain_regions(_contigs(s, d)),
    "pair_extension": lambda s, d: paths.extended(_links(s, d), _contigs(s, d)),
    "barcode_lines": lambda s, d: paths.barcode_lines(_contigs(s, d), _sets(s, d)),
    "links_on_graph": lambda s, d: paths.linked_on_graph(_links(s, d), _contigs(s, d)),
    "links_without_detours": lambda s, d: paths.without_detours(paths.listed(_contigs(s, d))),
}


def _list(most: int = 4000, uses: int = 1) -> str:
    return f"""{_C}, far as (select * from e where seq_len >= 4000), inn as (select u, v, edge_id as via, seq_len - k as a from e where seq_len < 3000 and seq_len > k),
  r as (select edge_id as src, rc_id as src_rc, v as node, []::bigint[] as path, 0::bigint as ins from far
    union all select r.src, r.src_rc, inn.v, list_append(r.path, via), r.ins + a from r join inn on inn.u = r.node where r.ins + a <= {most} and len(list_filter(r.path, lambda x: x = via)) < {uses}),
  pl as (select src, far.edge_id as des, path, ins as inserted, len(path)::int as n_middle from r join far on far.u = r.node where far.edge_id <> src and far.edge_id is distinct from src_rc),
  rk as (select *, row_number() over (partition by src, des order by ins2, n_middle, path) as rank from (select *, inserted as ins2 from pl)), sp as (select src, des, path, inserted from rk where rank = 1)"""


_OP = "select distinct src, des, path, unnest(path) as edge_id from pl"

SQL = {
    "path_lists": f"with recursive {_list()} select * from pl",
    "path_lists_twice": f"with recursive {_list(2000, 2)} select * from pl",
    "path_shortest": f"with recursive {_list()} select * from sp",
    "path_ranks": f"with recursive {_list()} select src, des, rank::int as rank, path from rk",
    "path_kinds": f"with recursive {_list()} select src, des, count(*) as n_paths, case when count(*) > 1 then 'complex' when max(n_middle) = 0 then 'adjacent' else 'simple' end as kind from pl group by 1, 2",
    "path_edges": f"with recursive {_list()}, op as ({_OP}) select src, des, edge_id, count(*) as n_paths from op group by 1, 2, 3",
    "path_middle": f"with recursive {_list()}, op as ({_OP}) select src, des, arg_max(op.edge_id, (seq_len, -op.edge_id)) as edge_id, max(seq_len) as seq_len from op join e on e.edge_id = op.edge_id group by 1, 2",
    "path_support": f"""with recursive {_list()}, {_MIRROR.format(least=0)}, st as (select src, des, path, inserted, n_middle, unnest(list_zip(list_prepend(src, path), list_append(path, des))) as s from pl),
      su as (select src, des, path, inserted, n_middle, sum(coalesce(mir.n, 0))::bigint as pairs from st left join mir on mir.v = s[1] and mir.u = s[2] group by 1, 2, 3, 4, 5),
      rr as (select *, row_number() over (partition by src, des order by pairs desc, inserted, n_middle, path) as k from su) select src, des, path, pairs from rr where k = 1""",
    "longest_paths": f"""with recursive {_C}, t as (select u as a, v as b from e union select t.a, e.v from t join e on e.u = t.b), ring as (select a as node from t where a = b), bad as (select node from ring union select t.a from ring join t on t.b = ring.node),
      w as (select edge_id as s, v, 0 as n from e where v not in (select node from bad) union select w.s, e.v, n + 1 from w join e on e.u = w.v)
      select s as edge_id, max(n)::bigint as n_after from w group by 1""",
    "plain_regions": f"""with recursive {_C}, {_DEG}, meet as (select e.edge_id as a, f.edge_id as b from e join e f on e.u = f.u or e.u = f.v or e.v = f.v or e.v = f.u),
      reach as (select edge_id as id, edge_id as r from e union select meet.b, reach.r from reach join meet on meet.a = reach.id where reach.r < meet.b), cc as (select id as edge_id, min(r) as root from reach group by 1),
      t as (select u as a, v as b from e union select t.a, e.v from t join e on e.u = t.b), ring as (select a as node from t where a = b),
      g as (select root, count(*) as n_edges, count(*) filter (x.n_in = 0) as f, count(*) filter (y.n_out = 0) as l from e join cc using (edge_id) join deg x on x.node = e.u join deg y on y.node = e.v group by 1)
      select root, n_edges from g where n_edges > 1 and f = 1 and l = 1 and root not in (select root from e join cc using (edge_id) where u in (select node from ring))
        and root not in (select cc.root from e join cc using (edge_id) join cc d on d.edge_id = e.rc_id where cc.root = d.root)""",
    "pair_extension": f"""with recursive {_C}, {_UNIT}, {_MIRROR.format(least=1)}, rn as (select v, u, n, row_number() over (partition by v order by n desc, u) as k from mir where n > 0),
      tt as (select a.v, a.u, a.n, coalesce(b.n, 0) as second from rn a left join rn b on a.v = b.v and b.k = 2 where a.k = 1), nc as (select v, u from tt where n > 1.3 * (second + 10) and u in (select edge_id from contigs where seq_len >= 100)),
      f as (select e.edge_id as id, q.prev from (select distinct edge_id from e) e left join (select u, min(v) as prev from nc where u not in (select edge_id from e join unit using (graph) where cov > 1.2::double * unit) group by 1 having count(*) = 1) q on q.u = e.edge_id),
      r as (select id, id as a from f union select r.id, f.prev from r join f on f.id = r.a where f.prev is not null)
      select r.id as edge_id, coalesce(max(case when f.prev is null then r.a end), min(r.a)) as head, case when max(case when f.prev is null then r.a end) is null then -1 else count(*) - 1 end as pos from r join f on f.id = r.a group by 1""",
    "barcode_lines": f"""with {_C}, {_M}, l1 as (select edge, key from m where kind = 'L1' and edge in (select edge_id from e where seq_len >= 500)),
      s1 as (select distinct a.edge_id as a, b.edge_id as b from e a join e b on a.v = b.u), nr as (select a, b from s1 where a <> b union select x.a, y.b from s1 x join s1 y on x.b = y.a where x.a <> y.b),
      j as (select p.key, nr.a, nr.b from nr join l1 p on p.edge = nr.a join l1 q on q.edge = nr.b and q.key = p.key)
      select key, a as e1, b as e2 from (select *, count(*) over (partition by key, a) as na, count(*) over (partition by key, b) as nb from j) where na = 1 and nb = 1""",
    "links_on_graph": f"with recursive {_list()}, {_MIRROR.format(least=1)} select src, des, mir.n, sp.inserted from sp join mir on mir.v = src and mir.u = des where mir.n >= 1",
    "links_without_detours": f"with recursive {_list()} select a.src, a.des from sp a where not exists (select 1 from sp b where b.src = a.src and list_contains(a.path, b.des))",
}
