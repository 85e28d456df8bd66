"""Queries of the orphan-reference operator over the citation tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.orphans import Reference, orphan_counts, orphan_rows
from brindle.session import read


def references(spark: SparkSession, root: str) -> list[Reference]:
    cites, clusters, opinions = (read(spark, root, t) for t in ("cl_citation_map", "cl_opinion_cluster", "opinion_text"))
    return [
        Reference("cl_citation_map", cites, "cited_opinion_id", clusters, "opinion_id"),
        Reference("opinion_text", opinions, "cluster_id", clusters, "cluster_id"),
        Reference("cl_opinion_cluster", clusters, "opinion_id", opinions, "opinion_id", deletable=False),
    ]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return reduce(DataFrame.unionByName, map(orphan_rows, references(spark, root)))


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    return reduce(DataFrame.unionByName, map(orphan_counts, references(spark, root)))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}

_KEY = "nullif(case when regexp_matches({0}, '[0-9]') then regexp_replace(regexp_extract({0}, '([0-9]+)', 1), '^0+([0-9])', '\\1') else lower(regexp_replace({0}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')) end, '')"


def _child(table: str, fk: str) -> str:
    return f"select '{table}' as ref_table, row_id, {_KEY.format(fk)} as k, date_trunc('month', loaded_at) + interval 1 month as e, strftime(loaded_at, '%Y-%m') as load_month from {table}"


def _with() -> str:
    return (
        "with parents as ("
        f"select 'cl_citation_map' as t, {_KEY.format('opinion_id')} as k, loaded_at as a, deleted_at as d from cl_opinion_cluster"
        f" union all select 'opinion_text', {_KEY.format('cluster_id')}, loaded_at, deleted_at from cl_opinion_cluster"
        f" union all select 'cl_opinion_cluster', {_KEY.format('opinion_id')}, loaded_at, null from opinion_text),"
        f" refs as ({_child('cl_citation_map', 'cited_opinion_id')} union all {_child('opinion_text', 'cluster_id')} union all {_child('cl_opinion_cluster', 'opinion_id')}),"
        " keyed as (select * from refs where k is not null and e is not null),"
        " lost as (select distinct ref_table, k, e from keyed r where not exists (select 1 from parents p where p.t = r.ref_table and p.k = r.k and p.a < r.e and (p.d is null or p.d >= r.e)))"
    )


SQL = {
    "p4_found": f"{_with()} select distinct r.ref_table, r.load_month, r.row_id from keyed r join lost l on l.ref_table = r.ref_table and l.k = r.k and l.e = r.e",
    "p4_counts": f"{_with()} select r.ref_table, r.load_month, count(*) as ref_rows, count(l.k) as orphan_rows, count(distinct l.k) as orphan_keys from keyed r left join lost l on l.ref_table = r.ref_table and l.k = r.k and l.e = r.e group by 1, 2",
}
