"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pixelloom.llm.audit import op11_audit
from pixelloom.llm.decontaminate import op2_decontaminate
from pixelloom.llm.html import op7_html
from pixelloom.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, op13_licenses
from pixelloom.llm.maxent import op1_lm
from pixelloom.llm.mixing import op5_mixing
from pixelloom.llm.quality import op9_quality
from pixelloom.llm.ranking import op12_ranking
from pixelloom.llm.sharding import op3_sharding
from pixelloom.llm.simhash import op6_simhash
from pixelloom.llm.substrings import op4_substrings
from pixelloom.llm.toxicity import op10_toxicity
from pixelloom.llm.warc import op8_warc

QUERIES = {
    "op1_lm": op1_lm,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_substrings": op4_substrings,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_audit": op11_audit,
    "op12_ranking": op12_ranking,
    "op13_licenses": op13_licenses,
}

#: Words, windows and lines are counted anew here, from texts; documents of equal text are one.
OP9_SQL = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, source from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        string_split(text, chr(10)) as ls from t),
f as (select rid, doc_id, source, ls, ws, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines from w),
win as (select rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') as g from f, unnest(range(1, len(ws) - 6)) r(i) where len(ws) >= 8),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from win) where n > 1),
rep as (select rid, sum(least(8, i - last))::bigint as n from (select rid, i, coalesce(lag(i) over (partition by rid order by i), i - 8) as last from dup) group by rid),
ln as (select rid, source, pos, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) as l
        from f, unnest(ls) with ordinality r(l, pos)),
lw as (select rid, source, l, len(string_split(l, ' '))::bigint as w from ln where l <> ''),
freq as (select lw.source, l, count(distinct text) as n from lw join t using (rid) group by all),
host as (select source, count(distinct text) as docs from t group by source),
bad as (select freq.source, l from freq join host on freq.source is not distinct from host.source where n >= 50 and n > 0.005 * docs),
gone as (select rid, sum(w)::bigint as gone from lw join bad on lw.l = bad.l and lw.source is not distinct from bad.source group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
       n_words < 20 or 100 * coalesce(rep.n, 0) > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * coalesce(rep.n, 0) > 30 * n_words) and coalesce(gone, 0) <= 0.7 * n_words as kept,
       coalesce(gone, 0) as n_removed_words
from f left join rep using (rid) left join gone using (rid)
"""

OP8_SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as d from pages),
m as (select d, max(page_id) as first from p where octet_length(b) >= 1000 group by d)
select page_id, octet_length(b)::bigint as payload_bytes, d as payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join m using (d)
"""

#: Each order is followed filter by filter over single documents.
OP11_SQL = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
l as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels where doc_id is not null group by doc_id),
w as (select t.*, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        coalesce(min(t.doc_id) over (partition by text) < t.doc_id, false) as e from t left join l using (doc_id)),
f as (select rid, part, good, toxic, unnest([
        {'f': 'A', 'x': len(ws) < 200},
        {'f': 'B', 'x': 100 * len(list_distinct(ws)) < 50 * len(ws)},
        {'f': 'C', 'x': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text)},
        {'f': 'D', 'x': regexp_matches(text, '[#$%&*|]')},
        {'f': 'E', 'x': e}]) as c from w),
g as (select rid, part, good, toxic, string_agg(c.f, '' order by c.f) filter (where c.x) as fails from f group by all),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order
        from (values ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) b(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) c(x),
             (values ('A'), ('B'), ('C'), ('D'), ('E')) d(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) e(x)
        where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
k as (select part, coalesce(fails, '') as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from g group by all),
s as (select part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) as f, contains(fails, substr(filter_order, step, 1)) as hit, fails,
        len(list_intersect(string_split(substr(filter_order, 1, step - 1), ''), string_split(fails, ''))) = 0 or step = 1 or fails = '' as there
      from k, o, range(1, 6) r(step)),
r as (select part, filter_order, step::int as step, f,
        coalesce(sum(n) filter (where there and not hit), 0)::bigint as kept, coalesce(sum(n) filter (where there and hit), 0)::bigint as removed,
        coalesce(sum(n) filter (where not there and hit), 0)::bigint as redundant, coalesce(sum(n) filter (where fails = f), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where there and hit), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where there and hit), 0)::bigint as toxic_lost from s group by all)
select * exclude (f), sum(removed) over (partition by part, f)::bigint as shapley from r
"""

#: Every document that has a term of the item is scored and sorted.
OP12_SQL = r"""
with t as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
s as (select count(*)::bigint as nd, sum(len(ws))::bigint as l from t where len(ws) > 0),
p as (select rid, w, count(*)::bigint as tf from (select rid, unnest(ws) as w from t) group by all),
d as (select w, count(*) as df from p group by w),
q as (select item_id, w, count(*)::bigint as times from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark) group by all),
x as (select item_id, rid, sum(times * floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ws) * nd) // l))))::bigint as score
      from q join d using (w) join p using (w) join t using (rid), s group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last, rid) as rank from x join t using (rid) where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""

_quoted = lambda x: "'" + x.replace("'", "''") + "'"

#: Every block of a text is compared with every template, and every place with every phrase.
OP13_SQL = rf"""
with t as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
phrases(ps, label) as (values {", ".join(f"({p.split()}, {_quoted(x)})" for p, x in PHRASES.items())}),
places as (select rid, label, i from t join phrases on list_has_all(ws, ps), unnest(range(0, len(ws)::bigint)) r(i) where ws[i + 1:i + len(ps)] = ps),
base as (select rid, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list(distinct label)) as base_labels from places group by rid),
templates as (select label, list_distinct(ws) as own, len(ws) as n from (select label, regexp_extract_all(lower(x), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from (values {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}) v(label, x))),
st as (select max(n)::bigint as step from templates),
blocks as (select rid, list_distinct(ws[k * step + 1:(k + 2) * step]) as b from t, st, unnest(range(0, greatest(1, (len(ws) + step - 1) // step - 1)::bigint)) r(k)),
hits as (select rid, label, len(list_intersect(b, own)) / len(own)::double as share from blocks, templates where len(list_intersect(b, own)) >= ceil({THRESHOLD} * len(own) - 1e-9)),
own as (select rid, list(distinct label) as labels, max(share) as score from hits group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(array_to_string(base_labels, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '') as labels, coalesce(score, 0)::double as score
from t left join base using (rid) left join own using (rid)
"""

ORACLE_SQL = {"op8_warc": OP8_SQL, "op9_quality": OP9_SQL, "op11_audit": OP11_SQL, "op12_ranking": OP12_SQL, "op13_licenses": OP13_SQL}
