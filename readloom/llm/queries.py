"""Queries of the problems tagged llm, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import encode, heavy, mixing, overlap, residue, setjoin, spans

Query = Callable[[SparkSession, str], DataFrame]


def _members(s: SparkSession, d: str) -> DataFrame:
    bc = setjoin.barcode_sets(table(s, d, "edge_barcodes", "edge", "kind", "keys"))
    return bc.unionByName(setjoin.partner_sets(table(s, d, "contig_links", "e1", "e2")))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(_members(s, d), 6, 10).select("src", F.col("id1").alias("e1"), F.col("id2").alias("e2"))


def p2_classes(s: SparkSession, d: str) -> DataFrame:
    return setjoin.links_per_record(_members(s, d), 6, 10)


def _values(s: SparkSession, d: str) -> DataFrame:
    seq = table(s, d, "seq_reads", "seq").filter(F.col("seq") != "").select(F.lit("seq").alias("src"), F.upper("seq").alias("val"))
    keys = table(s, d, "kmer_hash", "keys").filter(F.col("keys").isNotNull()).select(F.lit("keys").alias("src"), F.col("keys").cast("string").alias("val"))
    return seq.unionByName(keys)


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_counts(_values(s, d), 0.01).select("src", "val")


def p3_bounds(s: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_values(_values(s, d), 0.01)


def p3_intervals(s: SparkSession, d: str) -> DataFrame:
    """The heavy values with their exact counts and whether the sketch's bounds hold them."""
    values = _values(s, d)
    bounds = heavy.heavy_values(values, 0.01).select("src", "val", "lower", "upper")
    got = heavy.heavy_counts(values, 0.01).join(bounds, ["src", "val"], "left")
    return got.select("src", "val", "n", F.coalesce((F.col("lower") <= F.col("n")) & (F.col("n") <= F.col("upper")), F.lit(False)).alias("covered"))


def _entries(s: SparkSession, d: str) -> DataFrame:
    return spans.records(table(s, d, "mm_db", "edge", "p", "mm"), table(s, d, "mm_align", "edge", "pos", "mm"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_entries(_entries(s, d), 12)


def p4_shared(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(_entries(s, d), 12)


def _cov(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return overlap.coverage_members(table(s, d, "edge_barcodes", "edge", "kind", "keys", "cnts"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping(*_cov(s, d), 0.3)


def p6_estimates(s: SparkSession, d: str) -> DataFrame:
    return overlap.sampled_overlaps(*_cov(s, d), 0.3)


def p6_intervals(s: SparkSession, d: str) -> DataFrame:
    """Pairs above the limit with their exact overlap and whether the estimate's interval holds it."""
    return overlap.intervals(*_cov(s, d), 0.3)


def p7_ids(s: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(s, d, "documents", "doc_id", "text"))


def p7_round_trip(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents", "doc_id", "text")
    back = encode.decode(encode.encode(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def _counted(s: SparkSession, d: str) -> DataFrame:
    return encode.count_tokens(table(s, d, "documents", "doc_id", "source", "text"), "doc_id", "source")


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    from ..session import cut

    return mixing.mixture(cut(_counted(s, d)), table(s, d, "mix_targets"))


def p8_shares(s: SparkSession, d: str) -> DataFrame:
    from ..session import cut

    counted, targets = cut(_counted(s, d)), table(s, d, "mix_targets")
    return mixing.reached(mixing.mixture(counted, targets), mixing.source_sizes(counted, targets))


def _planned(s: SparkSession, d: str, **how) -> tuple[DataFrame, DataFrame, list[tuple]]:
    """Counted documents, targets and the plan for as many tokens as the documents of the sources have."""
    from ..session import cut

    counted, targets = cut(_counted(s, d)), table(s, d, "mix_targets")
    sizes = mixing.source_sizes(counted, targets).collect()  # one row per source
    rows = [(r["source"], r["tokens"], r["target_share"], r["max_repeats"]) for r in sizes]
    return counted, targets, mixing.plan(rows, budget=sum(r["tokens"] for r in sizes if r["target_share"] > 0), **how)


PLAN = "source string, tokens long, target_share double, max_repeats int, weight double, quota double"


def p8_temperature(s: SparkSession, d: str) -> DataFrame:
    """The weights at the least exponent that uses as many tokens as all documents have."""
    return s.createDataFrame(_planned(s, d)[2], PLAN)


def p8_entropy(s: SparkSession, d: str) -> DataFrame:
    """The weights for the same budget whose entropy is at most nine tenths of that of equal weights."""
    targets = table(s, d, "mix_targets").filter("target_share > 0").select("source").distinct().count()
    return s.createDataFrame(_planned(s, d, entropy_at_most=0.9 * log(max(targets, 2)))[2], PLAN)


def p8_tempered(s: SparkSession, d: str) -> DataFrame:
    """The mixture that those weights give: limits force the exponent above 0."""
    counted, targets, plan = _planned(s, d)
    return mixing.mixture(counted, targets, budget=sum(r[1] for r in plan if r[2] > 0))


def p8_tempered_shares(s: SparkSession, d: str) -> DataFrame:
    counted, targets, plan = _planned(s, d)
    mix = mixing.mixture(counted, targets, budget=sum(r[1] for r in plan if r[2] > 0))
    return mixing.reached(mix, mixing.source_sizes(counted, targets))


def p8_order(s: SparkSession, d: str) -> DataFrame:
    """The exact-target mixture as block permutations, one row per use."""
    return mixing.ordered(p8_mixture(s, d))


def p8_limits(s: SparkSession, d: str) -> DataFrame:
    """Whether each source of ``p8_shares`` keeps its limit and has its target share."""
    return mixing.kept(p8_shares(s, d), table(s, d, "mix_targets"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return residue.flagged(table(s, d, "documents", "doc_id", "text"))


def p9_sites(s: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(s, d, "documents", "doc_id", "text"))


def p9_templates(s: SparkSession, d: str) -> DataFrame:
    return residue.aligned(table(s, d, "documents", "doc_id", "text"))


def p9_messages(s: SparkSession, d: str) -> DataFrame:
    return residue.templates(table(s, d, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_classes, p3_found, p3_bounds, p3_intervals, p4_found, p4_shared, p6_found, p6_estimates, p6_intervals, p7_ids, p7_round_trip, p8_mixture, p8_shares, p8_limits, p8_order, p8_temperature, p8_entropy, p8_tempered, p8_tempered_shares, p9_found, p9_sites, p9_templates, p9_messages)}

_SETS = """
with m as (
  select distinct 'bc' as src, edge as id, k as tok from (select edge, unnest(keys) as k from edge_barcodes where kind = 'L1') where k <> -1 and edge is not null
  union all
  select distinct 'link', e1, e2 from contig_links where e1 <> e2
), n as (select src, id, count(*) as n from m group by 1, 2),
c as (select a.src, a.id as e1, b.id as e2, count(*) as c from m a join m b on a.src = b.src and a.tok = b.tok and a.id < b.id group by 1, 2, 3),
pairs as (select c.src, e1, e2 from c join n x on x.src = c.src and x.id = e1 join n y on y.src = c.src and y.id = e2 where c * 10 >= (x.n + y.n - c) * 6)
"""

_VALUES = """
with v as (
  select 'seq' as src, upper(seq) as val from seq_reads where seq <> ''
  union all select 'keys', cast(keys as varchar) from kmer_hash where keys is not null
), n as (select src, count(*) as n_rows from v group by 1)
"""

_SPANS = """
with e as (
  select distinct edge, p, mm from (select edge, p, mm from mm_db union all select edge, pos, mm from mm_align) where p is not null
), o as (select *, row_number() over w as i, lead(p) over w - p as gap, lead(mm) over w as next_mm from e window w as (partition by edge order by p, mm)),
s as (select *, list(case when mm is not null and next_mm is not null then mm || ':' || gap || ':' || next_mm end) over (partition by edge order by i rows between current row and 10 following) as step from o),
f as (select edge, i, array_to_string(step, ' ') as span from s where len(step) = 11 and len(list_filter(step, lambda x: x is null)) = 0),
g as (select span from f group by 1 having min(edge) <> max(edge)),
hit as (select distinct f.edge, f.i + x.j as i from f join g using (span), range(12) x(j))
"""

_COV = """
with m as (select distinct edge, k from (select edge, unnest(keys) as k, unnest(cnts) as c from edge_barcodes where kind = 'COV') where k <> -1 and c >= 2),
n as (select edge, count(*) as n from m group by 1),
c as (select a.edge as e1, b.edge as e2, count(*) as c from m a join m b on a.k = b.k and a.edge < b.edge group by 1, 2)
"""

SQL: dict[str, str] = {
    "p2_found": _SETS + "select src, e1, e2 from pairs",
    "p2_classes": _SETS
    + """, sets as (select src, id, list(tok order by tok) as toks from m group by 1, 2), k as (select src, id, min(id) over (partition by src, toks) as class_id from sets),
    l as (select src, e1 as id, e2 as o from pairs union all select src, e2, e1 from pairs)
    select k.src, k.id, k.class_id, count(l.o) as n_links from k left join l on l.src = k.src and l.id = k.id group by 1, 2, 3""",
    "p3_found": _VALUES + "select v.src, val from v join n on v.src = n.src group by v.src, val, n_rows having count(*) * 100 >= n_rows",
    "p3_intervals": _VALUES + "select v.src, val, count(*) as n, true as covered from v join n on v.src = n.src group by v.src, val, n_rows having count(*) * 100 >= n_rows",
    "p4_found": _SPANS + "select o.edge, cast(o.p as integer) as p from hit join o on o.edge = hit.edge and o.i = hit.i",
    "p4_shared": _SPANS + "select o.edge, count(*) as n_entries, count(hit.i) as n_shared from o left join hit on o.edge = hit.edge and o.i = hit.i group by 1",
    "p6_found": _COV + "select e1, e2 from c join n x on x.edge = e1 join n y on y.edge = e2 where c >= 0.3 * least(x.n, y.n)",
    "p6_intervals": _COV + "select e1, e2, c as shared, true as covered from c join n x on x.edge = e1 join n y on y.edge = e2 where c >= 0.3 * least(x.n, y.n)",
    "p8_limits": "select distinct source, true as within_limit, true as near_target from mix_targets",
    "p7_round_trip": "select doc_id, true as same from documents",
}
