"""The queries of this package and the SQL that gives their rows."""

from __future__ import annotations

from inkwell.llm.bpe import op5_bpe
from inkwell.llm.decontaminate import op1_decontaminate
from inkwell.llm.jaccard import op6_jaccard_join
from inkwell.llm.language_model import op10_lm_score
from inkwell.llm.neighbours import op7_neighbours
from inkwell.llm.packed_ids import op4_packed_ids
from inkwell.llm.quality import op3_quality
from inkwell.llm.substrings import op8_substring_dedup
from inkwell.llm.token_counts import op2_token_counts
from inkwell.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_quality, op4_packed_ids, op5_bpe, op6_jaccard_join, op7_neighbours, op8_substring_dedup, op9_toxicity, op10_lm_score)}

ORACLES: dict[str, str] = {}

# Lower-casing is of A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_decontaminate"] = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
win as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as t from (select item, w, least(10, len(w)) as n, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
cut as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as t from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from win) where len(w) >= n)),
hit as (select r, i, cut.n, item from cut join win using (t)),
covered as (select r, count(distinct p) as n from (select r, unnest(generate_series(i, i + n - 1)) as p from (select distinct r, i, n from hit)) group by r),
items as (select r, count(*) as n, sha256(string_agg(item, ',' order by item)) as h from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(items.n, 0) as n_items, coalesce(h, sha256('')) as items_sha256, covered.n is not null as contaminated
from d left join covered using (r) left join items using (r)"""

ORACLES["op6_jaccard_join"] = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
s as (select distinct r, array_to_string(w[i : i + 4], ' ') as s from (select r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
both_ as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.s = b.s and a.r <> b.r group by a.r, b.r),
link as (select distinct da.doc_id as a, db.doc_id as b from both_ join n x on x.r = a join n y on y.r = b join d da on da.r = a join d db on db.r = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select distinct doc_id as a, doc_id as b from d union select reach.a, link.b from reach join link on link.a = reach.b),
root as (select a, min(b) as component_id from reach group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id from d left join n using (r) join root on root.a = doc_id"""

ORACLES["op8_substring_dedup"] = r"""
with d as (select distinct doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
win as (select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) as t from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d where len(w) >= 20)),
later as (select doc_id, i from win qualify row_number() over (partition by t order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) as i from later),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
kept as (select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from word anti join gone using (doc_id, i) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""
