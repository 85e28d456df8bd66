"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

_CLUSTER = "regexp_replace(regexp_extract(cluster_id, '([0-9]+)', 1), '^0+([0-9])', '\\1')"
_KIND = "regexp_extract(lower(opinion_type), '^[^a-z]*([a-z]+)', 1)"

SQL = {
    "p2_found": (
        f"with o as (select *, {_CLUSTER} as k from opinion_text where {_CLUSTER} <> '')"
        " select k as cluster_id, row_id from o qualify count(*) over (partition by k) > 1 and row_number() over (partition by k order by"
        f" case when {_KIND} in ('combined', 'lead') then 0 else 1 end, length(coalesce(plain_text, '')) desc, loaded_at desc nulls last, row_id) = 1"
    ),
}
