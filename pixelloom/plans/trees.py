"""Registered changes and readings of layer trees, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import layer_tree as T
from pixelloom.sources.rasters import layer_trees

QUERIES = {}
ORACLE_SQL = {}

_TREE = """with recursive la as (
  select n_regionkey::bigint as doc, n_nationkey::bigint as id, null::bigint as parent, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::bigint as z, 'Group ' || n_nationkey as name, 'group' as kind, true as visible, n_nationkey % 4 <> 0 as expanded, false as clipped, 1.0::double as opacity, null::bigint as source from nation
  union all select n_regionkey, c_custkey + 1000, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1, 'Layer ' || c_custkey, 'pixel', c_acctbal > 0, false, false, 0.5::double, c_custkey % 7 from customer join nation on c_nationkey = n_nationkey),
pa as (select *, [z] as path, []::bigint[] as above from la where parent is null union all select c.*, p.path || [c.z], p.above || [c.parent] from pa p join la c on c.doc = p.doc and c.parent = p.id)"""
_REST = "name, kind, visible, expanded, clipped, opacity, source"
_anew = lambda of, order: f" select doc, id, parent, (row_number() over (partition by doc, parent order by {order}) - 1)::bigint as z, {_REST} from {of}"


def _one(name: str, fn, sql: str) -> None:
    """Trees are shown with -1 for no parent and no source."""

    def run(spark, sf_dir):
        out = fn(layer_trees(spark, sf_dir))
        return out.fillna(-1, ["parent", "source"]) if "parent" in out.columns else out

    QUERIES[name] = run
    # Changes end with a select of whole layers, which is wrapped.
    at = max(sql.rfind(f" select {k}doc, id, {k}parent, ") for k in ("", "la."))
    ORACLE_SQL[name] = _TREE + (sql if at < 0 else f"{sql[:at]}, done as ({sql[at:]}) select * replace (coalesce(parent, -1) as parent, coalesce(source, -1) as source) from done")


def _some(layers: DataFrame, where: str) -> DataFrame:
    return layers.where(where).select("doc", "id")


_one("tree_walk", T.walk, " select doc, id, (len(path) - 1)::bigint as depth, (row_number() over (partition by doc order by path) - 1)::bigint as place from pa")
_one("tree_panel", T.panel, ", op as (select * from pa where parent is null or not exists (select 1 from la g where g.doc = pa.doc and g.kind = 'group' and not g.expanded and list_contains(pa.above, g.id))) select doc, id, (len(path) - 1)::bigint as depth, (row_number() over (partition by doc order by list_transform(path, lambda v: -v)) - 1)::bigint as place from op")
_one("tree_counts", T.counts, " select la.doc, count(*) as layers, count(*) filter (kind = 'group') as groups, count(*) filter (visible) as visible, coalesce(max(n), 0)::bigint as sources from la left join (select doc, count(*) as n from (select doc, source from la where source is not null group by all having count(*) > 1) group by doc) s on s.doc = la.doc group by la.doc")
_one("tree_instances", T.instances, " select doc, source, count(*) as n from la where source is not null group by all")
_GONE = "(kind = 'group' and id % 5 = 0) or (kind = 'pixel' and id % 3 = 0)"
_one("tree_delete", lambda t: T.deleted(t, _some(t, _GONE)), f", le as (select * from la where not ({_GONE}) and (parent is null or parent % 5 <> 0))" + _anew("le", "z"))
_one("tree_update", lambda t: T.updated(t, _some(t, "id % 4 = 1"), visible=~F.col("visible"), opacity=F.col("opacity") * 0.25), f" select doc, id, parent, z, name, kind, case when id % 4 = 1 then not visible else visible end as visible, expanded, clipped, case when id % 4 = 1 then opacity * 0.25 else opacity end as opacity, source from la")
_one("tree_clip", lambda t: T.clipped(t, _some(t, "id % 2 = 0")), " select doc, id, parent, z, name, kind, visible, expanded, id % 2 = 0 and z > 0 as clipped, opacity, source from la")


def _new(t: DataFrame) -> DataFrame:
    made = t.where("id % 6 = 2").select("doc", F.col("id").alias("beside"), (F.col("id") + 100_000).alias("id"))
    top = t.select("doc").distinct().select("doc", F.lit(None).cast("long").alias("beside"), F.lit(999_999).cast("long").alias("id"))
    return made.union(top).select("doc", "beside", "id", F.lit("New").alias("name"), F.lit("pixel").alias("kind"), F.lit(True).alias("visible"), F.lit(False).alias("expanded"), F.lit(False).alias("clipped"), F.lit(1.0).alias("opacity"), F.lit(None).cast("long").alias("source"))


for _above in (True, False):
    _side = "+ 0.5" if _above else "- 0.5"
    _one(
        f"tree_insert_{'above' if _above else 'below'}", lambda t, above=_above: T.inserted(t, _new(t), above),
        f", ne as (select doc, id, parent, z::double as z, {_REST} from la union all select doc, id + 100000, parent, z {_side}, 'New', 'pixel', true, false, false, 1.0, null from la where id % 6 = 2 union all select distinct doc, 999999, null::bigint, 1e12, 'New', 'pixel', true, false, false, 1.0, null from la)" + _anew("ne", "z"),
    )
_HIT = "(kind = 'group' and id % 3 = 1) or id % 10 = 7 and kind = 'pixel' and parent % 3 <> 1"
_one(
    "tree_duplicate", lambda t: T.duplicated(t, _some(t, _HIT), 1_000_000),
    f", du as (select doc, id, parent, z::double as z, {_REST} from la union all select doc, id + 1000000, parent, z + 0.5, name || ' copy', kind, visible, expanded, clipped, opacity, source from la where {_HIT} union all select doc, id + 1000000, parent + 1000000, z, {_REST} from la where parent % 3 = 1)" + _anew("du", "z"),
)
_one(
    "tree_reorder", lambda t: T.reordered(t, t.where("z = 2").select("doc", "id", F.when(F.col("kind") == "group", -5).otherwise(F.col("id") % 6).cast("long").alias("delta"))),
    f", mv as (select doc, parent, least(greatest(0, 2 + case when kind = 'group' then -5 else id % 6 end), last) as dest from (select *, max(z) over (partition by doc, parent) as last from la) where z = 2) select la.doc, id, la.parent, (case when dest is null then z when z = 2 then dest when z > 2 and z <= dest then z - 1 when z < 2 and z >= dest then z + 1 else z end)::bigint as z, {_REST} from la left join mv on mv.doc = la.doc and mv.parent is not distinct from la.parent",
)
_PICK = "kind = 'group' and z in (0, 2)"
_one(
    "tree_group", lambda t: T.grouped(t, _some(t, _PICK), 777_777),
    f", gr as (select doc, id, case when {_PICK} then 777777 else parent end as parent, z, {_REST} from la union all select doc, 777777, null, max(z), 'Group', 'group', true, true, false, 1.0, null from la where {_PICK} group by doc)" + _anew("gr", "z"),
)
_one(
    "tree_ungroup", lambda t: T.ungrouped(t, _some(t, "kind = 'group' and id % 2 = 0")),
    f", un as (select c.doc, c.id, case when g.id is not null then g.parent else c.parent end as parent, coalesce(g.z, c.z) as z1, case when g.id is not null then c.z else 0 end as z2, {', '.join(f'c.{k.strip()}' for k in _REST.split(','))} from la c left join la g on g.doc = c.doc and g.id = c.parent and g.id % 2 = 0 where not (c.kind = 'group' and c.id % 2 = 0))" + _anew("un", "z1, z2"),
)
_one("tree_next_names", lambda t: T.next_names(t, "Layer"), " select doc, 'Layer ' || (coalesce(max(try_cast(substr(name, 7) as bigint)), 0) + 1) as name from la where starts_with(name, 'Layer ') group by doc")
