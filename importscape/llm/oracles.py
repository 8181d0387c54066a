"""DuckDB SQL for the queries that SQL can express."""

#: Exact containment of the distinct five-word shingles (whole sequence if shorter), without any search structure.
OP1 = r"""
with words as (
    select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents
    union all
    select 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') from benchmark
), shingles as (
    select distinct kind, id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words
), items as (
    select id, s, count(*) over (partition by id) as n_item from shingles where kind = 'i'
)
select d.id as doc_id, i.id as item_id, i.n_item as n_item, count(*) as n_shared, count(*) / i.n_item as containment
from shingles d join items i on d.s = i.s where d.kind = 'd'
group by d.id, i.id, i.n_item having 5 * count(*) >= 4 * i.n_item
"""
