"""Registered operators on text direction and line breaks and their SQL, character by character."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import text as T

QUERIES = {}
ORACLE_SQL = {}

#: Every third word is written in Hebrew letters, every seventh in Han characters and stops; the others stay.
_FROM, _HEBREW, _HAN = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתךםןף", "一丁七万三上下不与专且世丘。「」、両並中串丸主久乎乏"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    words = F.split(F.lower("text"), " ")
    turned = F.transform(words, lambda w, k: F.when((k + F.col("doc_id")) % 3 == 0, F.translate(w, _FROM, _HEBREW)).when((k + F.col("doc_id")) % 7 == 0, F.translate(w, _FROM, _HAN)).when(k % 11 == 0, F.concat(w, F.lit(" 1"), k.cast("string"))).otherwise(w))
    return docs.select("doc_id", F.array_join(turned, " ").alias("text"))


_HEB, _HANS = "'" + _HEBREW + "'", "'" + _HAN + "'"
_ranges = lambda pairs: "(" + " or ".join(f"cp between {a} and {b}" for a, b in pairs) + ")"
_script = "case when not (cp between 65 and 90 or cp between 97 and 122 or (cp >= 192 and cp <> 215 and cp <> 247)) then 'Zyyy' " + " ".join(f"when cp between {a} and {b} then '{s}'" for a, b, s in T.SCRIPTS) + " else 'Zyyy' end"
_CHARS = f"""with t as (select doc_id, array_to_string(list_transform(string_split(lower(text), ' '), lambda w, k: case when (k - 1 + doc_id) % 3 = 0 then translate(w, '{_FROM}', {_HEB}) when (k - 1 + doc_id) % 7 = 0 then translate(w, '{_FROM}', {_HANS}) when (k - 1) % 11 = 0 then w || ' 1' || (k - 1)::varchar else w end), ' ') as text from documents),
  c as (select doc_id, i, ch, unicode(ch) as cp from t, unnest(string_split(text, '')) with ordinality u(ch, i) where text <> ''),
  s as (select *, {_script} as script from c),
  k as (select *, case when {_ranges(T.DIGITS)} then 'E' when script in ('Hebr', 'Arab') then 'R' when script = 'Zyyy' and (cp < 65 or {_ranges(T.NEUTRAL)}) then 'N' else 'L' end as kind from s),
  b as (select doc_id, case when arg_min(kind, i) = 'R' then 1 else 0 end as base from k where kind in ('L', 'R') group by doc_id),
  n as (select k.*, coalesce(base, 0) as base, case when base = 1 then 'R' else 'L' end as own,
    last_value(case when kind in ('L', 'R') then kind end ignore nulls) over (partition by doc_id order by i rows unbounded preceding) as strong,
    last_value(case kind when 'N' then null when 'E' then 'R' else kind end ignore nulls) over (partition by doc_id order by i rows unbounded preceding) as before,
    first_value(case kind when 'N' then null when 'E' then 'R' else kind end ignore nulls) over (partition by doc_id order by i rows between current row and unbounded following) as after,
    coalesce(last_value(case when script <> 'Zyyy' then script end ignore nulls) over (partition by doc_id order by i rows unbounded preceding), 'Zyyy') as run_script from k left join b using (doc_id)),
  l as (select *, case kind when 'L' then 2 * base when 'R' then 1 when 'E' then (case when coalesce(strong, own) = 'R' then 2 else 2 * base end)
    else (case when (case when coalesce(before, own) = coalesce(after, own) then coalesce(before, own) else own end) = 'R' then 1 else 2 * base end) end as level from n)"""

QUERIES["text_items"] = lambda spark, d: T.items(_mixed(spark, d))
ORACLE_SQL["text_items"] = _CHARS + """, e as (select *, case when lag(level) over w = level and lag(run_script) over w = run_script then 0 else 1 end as new from l window w as (partition by doc_id order by i)),
  r as (select *, sum(new) over (partition by doc_id order by i) as run from e)
  select doc_id, base::int as base, (min(i) - 1)::bigint as first, count(*) as n, run_script as script, level::int as level from r group by doc_id, base, run, run_script, level"""

QUERIES["text_visual"] = lambda spark, d: T.visual(_mixed(spark, d))
ORACLE_SQL["text_visual"] = _CHARS + """, e as (select *, case when level >= 1 and coalesce(lag(level) over w, 0) >= 1 then 0 else 1 end as new1, case when level >= 2 and coalesce(lag(level) over w, 0) >= 2 then 0 else 1 end as new2 from l window w as (partition by doc_id order by i)),
  r as (select *, sum(new1) over (partition by doc_id order by i) as run1, sum(new2) over (partition by doc_id order by i) as run2 from e),
  p as (select *, case when level >= 2 then min(i) over (partition by doc_id, run2) + max(i) over (partition by doc_id, run2) - i else i end as p2 from r),
  q as (select *, case when level >= 1 then min(i) over (partition by doc_id, run1) + max(i) over (partition by doc_id, run1) - p2 else p2 end as p1 from p)
  select t.doc_id, coalesce(any_value(base), 0)::int as base, coalesce(string_agg(ch, '' order by p1), '') as text from t left join q using (doc_id) group by t.doc_id"""

QUERIES["text_breaks"] = lambda spark, d: T.breaks(_mixed(spark, d)).select("doc_id", F.size("places").cast("long").alias("n"), F.aggregate("places", F.lit(0).cast("long"), lambda n, v: n + v).alias("places"))
_in = lambda c, points: f"{c} in ({', '.join(map(str, points))})"
ORACLE_SQL["text_breaks"] = _CHARS + f""", w as (select doc_id, i, cp, script, ch, lag(cp) over v as pcp, lag(script) over v as pscript from l window v as (partition by doc_id order by i)),
  o as (select doc_id, i - 1 as place from w where pcp is not null and (({_in('pcp', T.SPACES)} and not {_in('cp', T.SPACES)}) or ({_in('pcp', T.DASHES)} and not {_in('cp', T.SPACES)} and regexp_matches(ch, '\\p{{L}}')) or pcp = {T.ZERO_SPACE}
    or ((script in ('Hani', 'Hira', 'Kana', 'Hang') or pscript in ('Hani', 'Hira', 'Kana', 'Hang')) and not {_in('cp', T.SPACES)} and not {_in('pcp', T.SPACES)} and not {_in('cp', T.NO_START)} and not {_in('pcp', T.NO_END)}))
    union all select doc_id, length(text) from t)
  select doc_id, count(*) as n, sum(place)::bigint as places from o group by doc_id"""
