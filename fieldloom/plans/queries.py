"""Registered queries of the parcel operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.indices import RANGES, VEGETATION, with_indices
from ..functions.shared import stored
from ..operators import boosting, clusters, labels, mixtures, quality, scoring, spatial, texture, training, validity, zonal
from ..sources import fixtures as fx

INDICES = tuple(RANGES)
MONTHS = fx.MONTHS
#: The features of a tensor, in order.
SHAPE = ("mean", "median", "cv", "skew", "kurt", "q25", "q75")
FEATURES = (*(f"{k}_{s}" for k in VEGETATION for s in SHAPE), *(f"{k}_{s}" for k in ("ISI", "UBI", "NDWI") for s in ("mean", "median", "cv", "q25", "q75")), "GLCM_Contrast", "GLCM_Correlation", "LBP_Variance", "delta_NDVI")
CHANGES = ("UBI_q95", "NDWI_q95", "NDVI_q05")


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()


REGISTRY: dict[str, Query] = {}


def _even(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of a sum doesn't show."""
    return df.select(*((F.rint(F.col(f"`{c}`") * 1e6) / 1e6 + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        REGISTRY[name] = Query(lambda spark, sf_dir: _even(f(spark, sf_dir)), sql, tuple(doubles.split()))
        return f

    return add


def oracle(q: Query) -> str:
    if not q.doubles:
        return q.sql
    even = ", ".join(f'round_even("{c}" * 1e6, 0) / 1e6 + 0.0 as "{c}"' for c in q.doubles)
    return f"select * replace ({even}) from ({q.sql})"


# --- SQL that the oracles share ---------------------------------------------------------------------------------------
def _px(key: str = "l_suppkey", more: str = "") -> str:
    band = lambda e: f"case when l_quantity = 50 then 0.0::double else {e} end"
    return f"""select cast({key} as varchar) as parcel_id, month(l_shipdate)::integer as month{more}, {band('200 + l_tax::double * 10000')} as blue,
      {band('300 + l_discount::double * 8000')} as green, {band('400 + l_quantity::double * 40')} as red, {band('500 + l_extendedprice::double / 20')} as nir
      from lineitem where month(l_shipdate) between 4 and 10"""


def _ix(source: str, raw: bool = False) -> str:
    """source: with a column `none`."""
    f = {
        "NDVI": "(n - r) / nullif(n + r, 0)", "EVI": "2.5 * (n - r) / nullif(n + 6.0 * r - 7.5 * b + 1.0, 0)", "GCVI": "n / nullif(g, 0) - 1.0", "SAVI": "1.5 * (n - r) / nullif(n + r + 0.5, 0)",
        "ISI": "0.8192 * sb - 0.5735 * sn + 0.0750", "UBI": "1.34 * sb - 2.24 * sg", "NDWI": "(g - n) / nullif(g + n, 0)",
    }
    cell = lambda k: f"case when {k} between {RANGES[k][0]} and {RANGES[k][1]} then {k} end as {k}"
    bands = {"b": "blue", "g": "green", "r": "red", "n": "nir"}
    none = "false" if raw else "blue = 0 and green = 0 and red = 0 and nir = 0"
    div = 1 if raw else 10000
    return f"""select * exclude (NDVI, EVI, GCVI, SAVI, ISI, UBI, NDWI), {', '.join(cell(k) for k in f)} from (
      select * exclude (b, g, r, n, sb, sg, sn), {', '.join(f'{v} as {k}' for k, v in f.items())} from (
        select *, {', '.join(f'case when not ({none}) then {v} / {div}::double end as {k}' for k, v in bands.items())},
          {', '.join(f'case when not ({none}) then {bands[k]} / 10000::double end as s{k}' for k in 'bgn')}, case when not ({none}) then nir end as NIR_
        from ({source})))"""


def _stats(source: str) -> str:
    out = []
    for k in INDICES:
        n = f"count({k})"
        m2, m3, m4 = (f"avg(({k} - m_{k}) ^ {e})" for e in (2, 3, 4))
        s = {"mean": f"avg({k})", "median": f"quantile_cont({k}, 0.5)", "cv": f"case when abs(avg({k})) <= 1e-6 then 0.0 else stddev_pop({k}) / abs(avg({k})) end", "skew": f"coalesce({m3} / nullif({m2}, 0) ^ 1.5, 0)", "kurt": f"coalesce({m4} / nullif({m2}, 0) ^ 2 - 3, 0)", "q25": f"quantile_cont({k}, 0.25)", "q75": f"quantile_cont({k}, 0.75)"}
        out += [f"case when {n} >= 3 then {v} end as {k}_{c}" for c, v in s.items()] + [f"{n} as {k}_valid_count", f"{n}::double / count(*) as {k}_valid_ratio"]
    means = ", ".join(f"avg({k}) over (partition by parcel_id, month) as m_{k}" for k in INDICES)
    return f"select parcel_id, month, {', '.join(out)} from (select *, {means} from ({source})) group by parcel_id, month"


def _tails(source: str) -> str:
    out = []
    for k in INDICES:
        q = (0.05, 0.10, "q05", "q10") if k in VEGETATION else (0.90, 0.95, "q90", "q95")
        s = {"mean": f"avg({k})", "median": f"quantile_cont({k}, 0.5)", "cv": f"case when abs(avg({k})) <= 1e-6 then 0.0 else stddev_pop({k}) / avg({k}) end", q[2]: f"quantile_cont({k}, {q[0]})", q[3]: f"quantile_cont({k}, {q[1]})"}
        out += [f"case when count({k}) >= 3 then {v} else 0.0 end as {k}_{c}" for c, v in s.items()]
    return f"select parcel_id, month, {', '.join(out)} from ({source}) group by parcel_id, month"


_STAT = " ".join(f"{k}_{s}" for k in INDICES for s in (*SHAPE, "valid_ratio"))
_TAIL = " ".join(f"{k}_{s}" for k in INDICES for s in ("mean", "median", "cv", *(("q05", "q10") if k in VEGETATION else ("q90", "q95"))))
_DENSE, _SPARSE, _RAW = _ix(_px()), _ix(_px("l_partkey")), _ix(_px(), raw=True)
_KEYS = f"(select p.parcel_id, m.month from (select distinct parcel_id from z) p, (select unnest({list(MONTHS)})::integer as month) m)"


def dense(spark: SparkSession, d: str) -> DataFrame:
    return with_indices(fx.pixels(spark, d))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return with_indices(fx.pixels(spark, d, "l_partkey"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    return with_indices(fx.pixels(spark, d), raw=True)


# --- indices, statistics, composite -----------------------------------------------------------------------------------
def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy("parcel_id", "month").agg(F.count("*").alias("pixels"), *(x for k in INDICES for x in (F.count(k).alias(f"n_{k}"), F.sum(k).alias(f"sum_{k}"))))


def _counts_sql(source: str) -> str:
    return f"select parcel_id, month, count(*) as pixels, {', '.join(f'count({k}) as n_{k}, sum({k}) as sum_{k}' for k in INDICES)} from ({source}) group by all"


_SUMS = " ".join(f"sum_{k}" for k in INDICES)
query("p01_p03_indices_scaled", _counts_sql(_DENSE), _SUMS)(lambda s, d: _counts(dense(s, d)))
query("p02_p03_indices_raw", _counts_sql(_RAW), _SUMS)(lambda s, d: _counts(raw(s, d)))
query("a01_a06_zonal_stats", _stats(_DENSE), _STAT)(lambda s, d: zonal.zonal_stats(dense(s, d)))
query("a06_zonal_stats_sparse", _stats(_SPARSE), _STAT)(lambda s, d: zonal.zonal_stats(sparse(s, d)))
query("a03_a07_tail_stats", _tails(_RAW), _TAIL)(lambda s, d: zonal.tail_stats(raw(s, d)))
query("a09_max_composite", f"select month, y, x, {', '.join(f'max({k}) as {k}' for k in INDICES)} from ({_ix(_px(more=', ((l_partkey % 64) // 8)::integer as y, (l_partkey % 8)::integer as x'))}) group by month, y, x", " ".join(INDICES))(lambda s, d: zonal.composite(with_indices(fx.scenes(s, d))))


# --- panel ------------------------------------------------------------------------------------------------------------
@query("w01_j07_delta_ndvi", f"""with z as ({_stats(_SPARSE)}) select a.parcel_id, a.month, a.NDVI_mean, case when a.month = 4 then 0.0 else a.NDVI_mean - b.NDVI_mean end as delta_NDVI
  from z a left join z b on a.parcel_id = b.parcel_id and b.month = a.month - 1""", "NDVI_mean delta_NDVI")
def delta(spark, d):
    return zonal.delta_calendar(zonal.zonal_stats(sparse(spark, d), ["NDVI"]), "NDVI_mean", MONTHS).select("parcel_id", "month", "NDVI_mean", "delta_NDVI")


@query("j03_p04_wide_panel", f"with z as ({_stats(_SPARSE)}) select parcel_id, {', '.join(f'max(case when month = {m} then {f} end) as {f}_M{m}' for m in MONTHS for f in ('NDVI_mean', 'EVI_cv'))} from z group by parcel_id", " ".join(f"{f}_M{m}" for m in MONTHS for f in ("NDVI_mean", "EVI_cv")))
def wide(spark, d):
    return zonal.wide(zonal.zonal_stats(sparse(spark, d), ["NDVI", "EVI"]), ["NDVI_mean", "EVI_cv"], MONTHS)


@query("u02_long_panel", f"with z as ({_stats(_SPARSE)}) select k.parcel_id, k.month, coalesce(NDVI_mean, 0.0) as NDVI_mean, coalesce(EVI_cv, 0.0) as EVI_cv from {_KEYS} k left join z using (parcel_id, month)", "NDVI_mean EVI_cv")
def long(spark, d):
    return zonal.long(wide(spark, d), ["NDVI_mean", "EVI_cv"], MONTHS)


@query("a08_median_imputation", f"""with z as ({_stats(_SPARSE)}), k as (select k.parcel_id, k.month, NDVI_mean, NDWI_cv from {_KEYS} k left join z using (parcel_id, month)), m as (select month, median(NDVI_mean) as a, median(NDWI_cv) as b from k group by month)
  select parcel_id, month, coalesce(NDVI_mean, a, 0.0) as NDVI_mean, coalesce(NDWI_cv, b, 0.0) as NDWI_cv from k join m using (month)""", "NDVI_mean NDWI_cv")
def imputed(spark, d):
    z = zonal.zonal_stats(sparse(spark, d), ["NDVI", "NDWI"]).select("parcel_id", "month", "NDVI_mean", "NDWI_cv")
    return zonal.impute_median(zonal.spine(z, MONTHS), ["NDVI_mean", "NDWI_cv"])


@query("a14_m01_m04_zscores", f"with z as ({_stats(_DENSE)}) select parcel_id, month, (NDVI_mean - (select avg(NDVI_mean) from z)) / (select stddev_pop(NDVI_mean) from z) as NDVI_mean, (GCVI_q75 - (select avg(GCVI_q75) from z)) / (select stddev_pop(GCVI_q75) from z) as GCVI_q75 from z", "NDVI_mean GCVI_q75")
def scored(spark, d):
    return zonal.zscores(zonal.zonal_stats(dense(spark, d), ["NDVI", "GCVI"]).select("parcel_id", "month", "NDVI_mean", "GCVI_q75"), ["NDVI_mean", "GCVI_q75"])


@query("m25_tensor", f"""with z as ({_stats(_SPARSE)}) select k.parcel_id, list(round_even(coalesce(NDVI_mean, 0.0) * 1e6, 0) / 1e6 + 0.0 order by k.month) as ndvi, list(round_even(coalesce(UBI_q75, 0.0) * 1e6, 0) / 1e6 + 0.0 order by k.month) as ubi
  from {_KEYS} k left join z using (parcel_id, month) group by k.parcel_id""")
def tensor(spark, d):
    t = zonal.tensor(zonal.zonal_stats(sparse(spark, d), ["NDVI", "UBI"]), ["NDVI_mean", "UBI_q75"], MONTHS)
    pick = lambda i: F.transform("t", lambda row: F.rint(row[i] * 1e6) / 1e6 + 0.0)
    return t.select("parcel_id", pick(0).alias("ndvi"), pick(1).alias("ubi"))


_CHG = ", ".join(f"coalesce({v}, 0.0) as {v}" for v in CHANGES)
_MUT = f"""with z as ({_tails(_ix(_px('l_partkey'), raw=True))}), k as (select k.parcel_id, k.month, {_CHG} from {_KEYS} k left join z using (parcel_id, month)),
  c as (select *, {', '.join(f'{v} - lag({v}) over (partition by parcel_id order by month) as delta_{v}' for v in CHANGES)} from k)"""


@query("w02_mutation", f"{_MUT} select * from c", " ".join(f"{p}{v}" for v in CHANGES for p in ("", "delta_")))
def changed(spark, d):
    t = zonal.tail_stats(with_indices(fx.pixels(spark, d, "l_partkey"), raw=True)).select("parcel_id", "month", *CHANGES)
    return zonal.mutation(t, CHANGES, MONTHS)


query("w03_mutation_extremes", f"{_MUT} select parcel_id, max(delta_UBI_q95) as MAX_JUMP_UBI, max(delta_NDWI_q95) as MAX_JUMP_NDWI, min(delta_NDVI_q05) as MAX_DROP_NDVI from c group by parcel_id", "MAX_JUMP_UBI MAX_JUMP_NDWI MAX_DROP_NDVI")(lambda s, d: zonal.extremes(changed(s, d)))

_CLIP = lambda e: f"greatest(least(coalesce({e}, 1.0), 1.0), 0.05)"
_FIVE = ("NDVI", "EVI", "GCVI", "SAVI", "NDWI")
_VALID = f"list_avg(list_filter([{', '.join(f'{k}_valid_ratio' for k in INDICES)}], lambda x: x is not null))"
_MISS = f"(({' + '.join(f'({k}_mean is null)::integer' for k in _FIVE)}) / 5.0::double)"
_SPREAD = f"list_median(list_filter([{', '.join(f'{k}_cv' for k in _FIVE)}], lambda x: x is not null))"


@query("m24_w04_quality", f"""with z as ({_stats(_SPARSE)}), k as (select k.parcel_id, k.month, z.* exclude (parcel_id, month) from {_KEYS} k left join z using (parcel_id, month)),
  b as (select parcel_id, month, NDVI_mean, {_CLIP(f"(0.5 * {_CLIP(_VALID)} + 0.25 * {_CLIP(f'1 - {_MISS}')} + 0.25 * {_CLIP(f'1 / (1 + least(greatest({_SPREAD}, 0.0), case when {_SPREAD} is not null then 3.0 end))')})")} as q,
    lag(NDVI_mean) over w as p, lead(NDVI_mean) over w as f from k window w as (partition by parcel_id order by month)),
  j as (select *, abs(NDVI_mean - case when p is null then f when f is null then p else (p + f) / 2 end) as jump from b)
  select parcel_id, month, {_CLIP(f"case when month between 5 and 9 then q * {_CLIP('case when jump is null then 1.0 else 1 / (1 + least(jump / 0.25, 4.0)) end')} else q end")} as quality from j""", "quality")
def quality_score(spark, d):
    return quality.quality(zonal.spine(zonal.zonal_stats(sparse(spark, d)), MONTHS), MONTHS, dict.fromkeys(MONTHS, 1.0))


@query("w05_keep_first", "select cast(l_suppkey as varchar) as parcel_id, arg_min(l_linenumber, (l_orderkey, l_linenumber, l_partkey)) as first_line, min(l_orderkey) as first_order from lineitem group by l_suppkey")
def first_rows(spark, d):
    rows = fx.read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("parcel_id"), F.col("l_orderkey").alias("first_order"), F.col("l_linenumber").alias("first_line"), "l_partkey")
    return zonal.keep_first(rows, ["parcel_id"], ["first_order", "first_line", "l_partkey"]).drop("l_partkey")


# --- filters, ids, labels ---------------------------------------------------------------------------------------------
_PARCELS = "(select cast(s_suppkey as varchar) as parcel_id, (s_nationkey % 10)::integer as g10_cls_id, ((s_suppkey % 32) * 10 + 1)::double as minx, ((s_suppkey // 32) * 10 + 1)::double as miny, ((s_suppkey % 32) * 10 + 9)::double as maxx, ((s_suppkey // 32) * 10 + 9)::double as maxy from supplier)"
_LABELS = "(select cast(s_suppkey as varchar) as parcel_id, (s_suppkey % 4)::integer as label from supplier)"
query("p06_p05_land_class", f"select parcel_id, g10_cls_id from {_PARCELS} where g10_cls_id in (2, 8)")(lambda s, d: fx.parcels(s, d).where(F.col("g10_cls_id").isin(2, 8)).select("parcel_id", "g10_cls_id"))
query("a13_value_counts", f"select g10_cls_id, count(*) as n from {_PARCELS} group by g10_cls_id")(lambda s, d: fx.parcels(s, d).groupBy("g10_cls_id").agg(F.count("*").alias("n")))
query("p07_p08_label_list", f"select * from {_LABELS} where label in (1, 2)")(lambda s, d: fx.labels(s, d).where(F.col("label").isin(1, 2)))
query("p09_equal_label", f"select * from {_LABELS} where label = 1")(lambda s, d: fx.labels(s, d).where("label = 1"))
query("j06_u04_exclusion", f"select * from {_PARCELS} where parcel_id not in (select parcel_id from {_LABELS} where label in (1, 2))")(lambda s, d: labels.without(fx.parcels(s, d), fx.labels(s, d).where(F.col("label").isin(1, 2))))
query("j05_membership", f"select * from {_PARCELS} where parcel_id in (select parcel_id from {_LABELS} where label = 3)")(lambda s, d: fx.parcels(s, d).join(fx.labels(s, d).where("label = 3"), "parcel_id", "left_semi"))
query("j04_parcel_export", f"select p.*, l.label, count(*) over () as matched from {_PARCELS} p join {_LABELS} l using (parcel_id) where l.label > 0")(lambda s, d: (lambda j: j.crossJoin(F.broadcast(j.agg(F.count("*").alias("matched")))))(fx.parcels(s, d).join(fx.labels(s, d).where("label > 0"), "parcel_id")))
query("p15_clean_ids", r"""with r as (select s_suppkey, case s_suppkey % 4 when 0 then s_suppkey::varchar when 1 then s_suppkey::varchar || '.0' when 2 then ' ' || s_suppkey::varchar || '.0' else s_suppkey::varchar || chr(9) end as raw_id from supplier)
  select s_suppkey, regexp_replace(regexp_replace(raw_id, '\.0$', ''), '^\s+|\s+$', '', 'g') as cut_first, regexp_replace(regexp_replace(raw_id, '^\s+|\s+$', '', 'g'), '\.0$', '') as strip_first from r""")(lambda s, d: fx.dirty_ids(s, d).select("s_suppkey", C.clean_id(F.col("raw_id")).alias("cut_first"), C.clean_id(F.col("raw_id"), True).alias("strip_first")))
def _short(spark, d):
    z = zonal.zonal_stats(dense(spark, d), ["NDVI"]).where("month = 4").select("parcel_id", "NDVI_mean", "NDVI_valid_count", "NDVI_valid_ratio")
    return z.withColumnsRenamed(C.short_names(z.columns)).fillna(-9999.0, ["NDVI_vali1"])


REGISTRY["p18_p14_p19_short_names"] = Query(lambda s, d: _even(_short(s, d)), f"select parcel_id, NDVI_mean, NDVI_valid_count as NDVI_valid, coalesce(NDVI_valid_ratio, -9999) as NDVI_vali1 from ({_stats(_DENSE)}) where month = 4", ("NDVI_mean", "NDVI_vali1"))
query("p20_p21_lenient_numbers", """with r as (select c_custkey, case c_custkey % 5 when 0 then 'x' when 1 then 'inf' when 2 then '' else (c_acctbal::double / 5000)::varchar end as t, c_acctbal::double / 5000 as v from customer), n as (select c_custkey, case when c_custkey % 5 > 2 then v end as number from r)
  select c_custkey, number, greatest(least(coalesce(number, 1.0), 1.0), 0.05) as quality from n""", "number quality")(lambda s, d: fx.read(s, d, "customer").select("c_custkey", C.number(F.when(F.col("c_custkey") % 5 == 0, "x").when(F.col("c_custkey") % 5 == 1, "inf").when(F.col("c_custkey") % 5 == 2, "").otherwise((F.col("c_acctbal").cast("double") / 5000).cast("string"))).alias("number")).withColumn("quality", C.clip_quality(F.col("number"))))
query("p22_month_weights", f"select parcel_id, month, sum(case month when 5 then 0.5 when 8 then 0.25 else 1.0 end)::double as weight from ({_px()}) group by all", "weight")(lambda s, d: fx.pixels(s, d).groupBy("parcel_id", "month").agg(F.sum(C.month_weight(F.col("month"), {5: 0.5, 8: 0.25})).alias("weight")))
_PSEUDO, _GOLD = f"(select parcel_id, label from {_LABELS} where label < 3)", f"(select parcel_id, (label + 1) % 3 as label from {_LABELS} where label >= 2)"
query("j12_p12_label_merge", f"select coalesce(g.parcel_id, p.parcel_id) as parcel_id, coalesce(g.label, p.label)::integer as label, case when g.label is not null then 10.0 else 0.1 end::double as weight from {_GOLD} g full join {_PSEUDO} p on g.parcel_id = p.parcel_id", "weight")(lambda s, d: labels.merge(labels.true_labels(fx.labels(s, d).select("parcel_id", F.when(F.col("label") >= 2, (F.col("label") + 1) % 3).otherwise(labels.UNREVIEWED).alias("ture_label"))), fx.labels(s, d).where("label < 3")))
query("p10_p23_pseudo_labels", "select cast(c_custkey as varchar) as parcel_id, case when c_mktsegment like '%AUTO%' then 1 when c_mktsegment like '%BUILD%' then 2 else 0 end::integer as label from customer where c_acctbal > 5000")(lambda s, d: labels.pseudo_labels(fx.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("parcel_id"), F.when(F.contains("c_mktsegment", F.lit("AUTO")), "果树与林地").when(F.contains("c_mktsegment", F.lit("BUILD")), "撂荒与裸地").otherwise("经济作物").alias("semantic"), F.when(F.col("c_acctbal") > 5000, 0.99).otherwise(0.5).alias("confidence"))))
query("u03_w05_union_distinct", f"select distinct parcel_id from (select parcel_id from {_PSEUDO} union all select parcel_id from {_GOLD})")(lambda s, d: zonal.keep_first(fx.labels(s, d).where("label < 3").select("parcel_id", F.lit(0).alias("o")).union(fx.labels(s, d).where("label >= 2").select("parcel_id", F.lit(1))), ["parcel_id"], ["o"]).select("parcel_id"))

_MORE = "(select ' ' || s_suppkey::varchar || '.0' as parcel_id, case when s_suppkey % 3 = 0 then null else s_name end as XGB_Semantic, case when s_suppkey % 5 = 0 then null else s_acctbal::double end as XGB_Confidence from supplier where s_suppkey % 2 = 0)"


@query("p14_p19_export_join", f"select p.parcel_id, coalesce(m.XGB_Semantic, '') as xgb_sem, coalesce(m.XGB_Confidence, -9999.0) as xgb_conf, p.g10_cls_id from {_PARCELS} p join (select * replace (trim(regexp_replace(parcel_id, '\\.0$', '')) as parcel_id) from {_MORE}) m using (parcel_id)", "xgb_conf")
def export(spark, d):
    """Parcels with their class by an export join: the layer's own columns of these names give way, ids are cleaned on both sides."""
    k = F.col("s_suppkey")
    layer = fx.parcels(spark, d).withColumnRenamed("parcel_id", "DKM").withColumns({"xgb_semantic": F.lit("old"), "XGB_Confidence": F.lit(1)}).select("g10_cls_id", "xgb_semantic", "XGB_Confidence", "DKM")
    ledger = fx.read(spark, d, "supplier").where(k % 2 == 0).select(F.concat(F.lit(" "), k.cast("string"), F.lit(".0")).alias("parcel_id"), F.when(k % 3 != 0, F.col("s_name")).alias("XGB_Semantic"), F.when(k % 5 != 0, F.col("s_acctbal").cast("double")).alias("XGB_Confidence"))
    return C.export_join(layer, ledger, {"XGB_Semantic": "xgb_sem", "XGB_Confidence": "xgb_conf"}, ["parcel_id", "xgb_sem", "xgb_conf", "none", "g10_cls_id"])


# --- scores -----------------------------------------------------------------------------------------------------------
_MSE = "(select cast(c_custkey as varchar) as parcel_id, exp(c_acctbal::double / 4000) / 10 as mse from customer)"
_DENSITY = f"""with s as {_MSE}, b as (select mse from s where mse < (select quantile_cont(mse, 0.98) from s)), t as (select min(mse) as lo, max(mse) as hi, stddev_samp(mse) * count(*) ^ -0.2 as w, count(*) as n from b),
  g as (select i as k, lo + (hi - lo) * i / 499 as x, w, n from t, (select unnest(range(500))::integer as i)), e as (select k, x, sum(exp(-0.5 * ((x - mse) / w) ^ 2)) / any_value(w * n) / 2.5066282746310002 as density from g, b group by k, x)"""
_KNEE = f"""{_DENSITY}, p as (select arg_min(k, (-density, k)) as pk, max(k) as last from e), q as (select (select x from e where k = pk) as x1, (select density from e where k = pk) as y1, (select x from e where k = last) as x2, (select density from e where k = last) as y2 from p),
  f as (select k, x, abs((x2 - x1) * (density - y1) - (y2 - y1) * (x - x1)) / (sqrt((x2 - x1) ^ 2 + (y2 - y1) ^ 2) + 1e-8) as far from e, q, p where k >= pk), h as (select arg_min(x, (-round(far, 9), k)) as threshold from f)"""
_CONF = f"""{_KNEE}, c as (select parcel_id, mse, threshold, case when mse <= threshold then case when threshold - (select min(mse) from s) < 1e-6 then 10.0 else ln(99.0::double) / (threshold - (select min(mse) from s)) end else 3.0 / (coalesce((select stddev_pop(mse) from s, h where mse > threshold), 0.0) + 1e-8) end as a from s, h),
  p2 as (select parcel_id, mse, threshold, round_even(1 / (1 + exp(-a * (mse - threshold))) * 1e4, 0) / 1e4 as p from c)"""
query("a18_kde", f"{_DENSITY} select * from e", "x density")(lambda s, d: scoring.kernel_density(fx.scores(s, d)))
query("s14_histogram", f"""with s as {_MSE}, k as (select mse from s where mse <= (select quantile_cont(mse, 0.98) from s)), e as (select min(mse) as a, max(mse) as b from k), c as (select least(floor((mse - a) / (b - a) * 100), 99)::integer as bin, count(*) as n from k, e group by 1)
  select i as bin, a + (b - a) * i / 100 as lo, a + (b - a) * (i + 1) / 100 as hi, coalesce(n, 0)::bigint as n from e, (select unnest(range(100))::integer as i) g left join c on c.bin = g.i""", "lo hi")(lambda s, d: scoring.histogram(fx.scores(s, d)))
query("m11_knee", f"{_KNEE} select * from h", "threshold")(lambda s, d: scoring.knee(scoring.kernel_density(fx.scores(s, d))))
query("m12_confidence", f"{_CONF} select * from p2", "mse threshold p")(lambda s, d: scoring.confidence(fx.scores(s, d), stored(scoring.knee(scoring.kernel_density(fx.scores(s, d))))))
_AGRO = f"""with z as ({_stats(_DENSE)}), v as (select parcel_id, month, coalesce(NDVI_mean, 0.0) as ndvi, coalesce(NDVI_cv, 0.0) * 100 as glcm from z), m as (select parcel_id, max(case when month between 5 and 9 then ndvi end) as peak, max(case when month = 4 then ndvi end) as spring, stddev_pop(ndvi) as sd, avg(glcm) as tex from v group by parcel_id),
  f as (select *, coalesce(peak < 0.55, false) as abandoned, coalesce(spring >= 0.18 and sd < 0.20 and tex > (select avg(tex) from m), false) as orchard from m)"""


@query("m13_a11_a15_agronomy", f"{_AGRO} select *, case when abandoned and orchard then 'physical_veto_abandoned_and_orchard' when abandoned then 'physical_veto_abandoned' when orchard then 'physical_veto_orchard' end as veto_reason from f", "peak spring sd tex")
def agronomy(spark, d):
    z = zonal.zonal_stats(dense(spark, d), ["NDVI"])
    return scoring.agronomy(z.select("parcel_id", "month", F.col("NDVI_mean").alias("ndvi"), (F.col("NDVI_cv") * 100).alias("glcm")))


def _veto(spark, d):
    k = F.col("c_custkey")
    a, o = k % 7 == 0, k % 5 == 0
    return fx.read(spark, d, "customer").select(k.cast("string").alias("parcel_id"), a.alias("abandoned"), o.alias("orchard"), F.when(a & o, "physical_veto_abandoned_and_orchard").when(a, "physical_veto_abandoned").when(o, "physical_veto_orchard").alias("veto_reason"))


_ROUTE = f"""{_CONF}, v as (select cast(c_custkey as varchar) as parcel_id, c_custkey % 7 = 0 as ab, c_custkey % 5 = 0 as orch from customer), r as (select p2.*, ab, orch, mse > threshold as over, round_even((1 - p) * 1e4, 0) / 1e4 as grain from p2 join v using (parcel_id)),
  w as (select *, ab or orch as veto, not over and grain < 0.8 as doubt from r), x as (select parcel_id, mse, p, grain, case when over or veto or doubt then 'anomaly' else 'safe' end as pool,
    case when over and veto then 'mse_anomaly_and_physical_veto' when ab and orch then 'physical_veto_abandoned_and_orchard' when ab then 'physical_veto_abandoned' when orch then 'physical_veto_orchard' when doubt then 'low_confidence_safe_review' when over then 'mse_anomaly' else 'strict_safe_grain' end as reason from w)
  select parcel_id, mse, pool, reason, case when pool = 'safe' then grain when reason like '%physical%' then greatest(p, 0.65) else p end as confidence from x"""


@query("m14_p24_o01_routing", _ROUTE, "mse confidence")
def routing(spark, d):
    s = scoring.confidence(fx.scores(spark, d), stored(scoring.knee(scoring.kernel_density(fx.scores(spark, d))))).join(_veto(spark, d), "parcel_id")
    return scoring.route(s).select("parcel_id", "mse", "pool", "reason", "confidence").orderBy(F.desc_nulls_last("confidence"), "parcel_id")


_POST = "(select cast(k as varchar) as parcel_id, a / (a + b + c)::double as p0, b / (a + b + c)::double as p1, c / (a + b + c)::double as p2 from (select c_custkey as k, 1 + c_custkey % 7 as a, 1 + (c_custkey * 3) % 11 as b, 1 + (c_custkey * 5) % 13 as c from customer))"
_CLS = f"""with p as (select *, greatest(p0, p1, p2) as most, list_sort([p0, p1, p2], 'DESC') as o from {_POST}), c as (select parcel_id, p0, p1, p2, case when most < 0.6 then 0 when p0 = most then 0 when p1 = most then 1 else 2 end::integer as "class", case when most < 0.6 then p0 else most end as class_confidence, most < 0.6 as floored, o[1] - o[2] as margin from p)"""
query("m20_o03_o04_classify", f"{_CLS} select * from c", "p0 p1 p2 class_confidence margin")(lambda s, d: scoring.classify(fx.posteriors(s, d)))
query("m23_o02_review_batch", f"""{_CLS}, u as (select *, row_number() over (partition by "class" order by round(margin, 12), parcel_id)::integer as rank from c where "class" in (1, 2) and parcel_id not in (select parcel_id from {_LABELS})) select *, -9999::integer as true_label from u where rank <= case when "class" = 1 then 10 else 11 end""", "p0 p1 p2 class_confidence margin")(lambda s, d: scoring.review_batch(scoring.classify(fx.posteriors(s, d)).withColumn("margin", F.round("margin", 12)), fx.labels(s, d), 21))
query("m22_j02_joint_confidence", f"""{_CLS} select s.parcel_id, mse, class_confidence, round_even(least(mse, 1.0) * class_confidence * 1e4, 0) / 1e4 as joint from {_MSE} s left join c using (parcel_id)""", "mse class_confidence joint")(lambda s, d: fx.scores(s, d).join(scoring.classify(fx.posteriors(s, d)).select("parcel_id", "class_confidence"), "parcel_id", "left").withColumn("joint", C.round4(F.least(F.col("mse"), F.lit(1.0)) * F.col("class_confidence"))))
query("o05_hash_sample", f"select * from {_MSE} s order by md5(parcel_id), parcel_id limit 10000", "mse")(lambda s, d: fx.scores(s, d).orderBy(F.md5("parcel_id"), "parcel_id").limit(10_000))
query("o06_small_loss", f"with s as {_MSE} select parcel_id, mse from (select *, row_number() over (order by mse, parcel_id) as r from s) where r <= floor((select count(*) from s) * 0.65)", "mse")(lambda s, d: scoring.small_loss(fx.scores(s, d), "mse", 0.35))
_LOSS = "(select cast(c_custkey as varchar) as parcel_id, exp(c_acctbal::double / 4000) / 10 as a, (c_custkey % 97) / 97.0::double as b from customer)"
query("m08_co_teaching", f"with l as {_LOSS}, n as (select floor(count(*) * 0.65) as k from l), ra as (select *, row_number() over (order by a, parcel_id) as i, row_number() over (order by b, parcel_id) as j from l) select (select avg(a) from ra, n where j <= k) as loss_a, (select avg(b) from ra, n where i <= k) as loss_b", "loss_a loss_b")(lambda s, d: scoring.co_teaching(fx.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("parcel_id"), (F.exp(F.col("c_acctbal").cast("double") / 4000) / 10).alias("a"), ((F.col("c_custkey") % 97) / 97.0).alias("b")), 0.35))
query("a17_weighted_mse", f"select parcel_id, sum(q * sq) / (sum(q) * 47 + 1e-8) as mse from (select parcel_id, month, sum(red / 10000) as sq, count(*) / 100.0::double as q from ({_px()}) group by all) group by parcel_id", "mse")(lambda s, d: scoring.weighted_mse(fx.pixels(s, d).groupBy("parcel_id", "month").agg(F.sum(F.col("red") / 10000).alias("sq"), (F.count("*") / 100.0).alias("quality")), 47))
query("m21_reason_text", """select cast(c_custkey as varchar) as parcel_id, case when v1 <= 0 then '依据不足，模型置信度偏低' else '首要依据: [' || 'mean' || ']特征显著' || case when v2 > 0 then '；次要依据: [Contrast]协同判定' else '' end end as reason from (select c_custkey, c_acctbal::double as v1, c_acctbal::double - 3000 as v2 from customer)""")(lambda s, d: labels.reasons(fx.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("parcel_id"), F.lit("NDVI_mean").alias("top1"), F.col("c_acctbal").cast("double").alias("value1"), F.lit("GLCM_Contrast").alias("top2"), (F.col("c_acctbal").cast("double") - 3000).alias("value2"))).select("parcel_id", "reason"))

# --- clusters ---------------------------------------------------------------------------------------------------------
_VEC = """with v as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as c from v group by all), d as (select vec_id, v.label as cluster, sqrt(sum((x - c) ^ 2)) as distance from v join m on v.label = m.label and v.i = m.i group by all)"""


@query("m03_distances", f"{_VEC} select * from d", "distance")
def measured(spark, d):
    p = fx.vectors(spark, d).withColumnRenamed("label", "cluster")
    return clusters.distances(p, clusters.centroids(p, "cluster", "v"), "cluster", "v").drop("v")


query("a16_w07_cores", f"{_VEC} select *, (distance <= (select quantile_cont(e.distance, 0.3) from d e where e.cluster = d.cluster))::integer as is_core from d", "distance")(lambda s, d: clusters.cores(measured(s, d), "cluster"))
_NAMED = f"""with z as ({_stats(_DENSE)}), p as (select parcel_id::bigint % 7 as cluster, month, avg(NDVI_mean) as ndvi, avg(NDVI_cv) as glcm, count(*) as n from z group by all)"""


def _profile(spark, d):
    z = zonal.zonal_stats(dense(spark, d), ["NDVI"]).withColumn("cluster", F.col("parcel_id").cast("long") % 7)
    return clusters.profiles(z.select("cluster", "month", F.col("NDVI_mean").alias("ndvi"), F.col("NDVI_cv").alias("glcm")), ["ndvi", "glcm"])


query("a12_profiles", f"{_NAMED} select * from p", "ndvi glcm")(_profile)
query("m16_w06_cluster_names", f"""{_NAMED}, m as (select cluster, max(case when month between 5 and 9 then ndvi end) as peak, max(case when month = 4 then ndvi end) as spring, stddev_pop(ndvi) as sd, avg(glcm) as tex from p group by cluster), g as (select avg(glcm) as a from p),
  l as (select cluster, case when peak < 0.55 then '撂荒与裸地' when spring >= 0.18 and sd < 0.2 and tex > a then '果树与林地' when peak >= 0.6 and tex < a then '经济作物' else '长势衰弱主粮' end as name from m, g), r as (select *, row_number() over (partition by name order by cluster) - 1 as n from l)
  select cluster, case when n = 0 then name else name || '_亚种' || n end as label from r""")(lambda s, d: (lambda p: clusters.name_clusters(p, p.agg(F.avg("glcm").alias("all_tex"))))(_profile(s, d)))
query("m01_standardise", "with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), s as (select i, avg(x) as m, stddev_pop(x) as sd from v group by i) select vec_id, sum(((x - m) / sd) * i) as weighted from v join s using (i) group by vec_id", "weighted")(lambda s, d: clusters.standardised(fx.vectors(s, d), "vec_id", "v").select("vec_id", F.posexplode("v").alias("i", "x")).groupBy("vec_id").agg(F.sum(F.col("x") * (F.col("i") + 1)).alias("weighted")))
query("m02_kmeans")(lambda s, d: clusters.kmeans(fx.vectors(s, d), "v").select("vec_id", "cluster"))

# --- space and texture ------------------------------------------------------------------------------------------------
query("j09_box_join", f"select p.parcel_id, n.n_nationkey::integer as scene from {_PARCELS} p join nation n on p.minx < (n.n_nationkey % 5) * 70 + 80 and p.maxx > (n.n_nationkey % 5) * 70 and p.miny < (n.n_nationkey // 5) * 70 + 80 and p.maxy > (n.n_nationkey // 5) * 70")(lambda s, d: spatial.box_join(fx.parcels(s, d), fx.scene_boxes(s, d), "parcel_id", "scene"))


def _shapes(spark, d):
    def wkb(x0, y0, x1, y1):
        import pandas as pd

        return pd.Series([spatial.polygon_wkb([[(a, b), (c, b), (c, e), (a, e), (a, b)]]) for a, b, c, e in zip(x0, y0, x1, y1, strict=True)])

    return fx.parcels(spark, d).mapInPandas(lambda it: (b.assign(geometry=wkb(b["minx"], b["miny"], b["maxx"], b["maxy"])) for b in it), "parcel_id string, g10_cls_id int, minx double, miny double, maxx double, maxy double, geometry binary")


@query("j08_zonal_join", f"""with c as (select c_custkey, (c_custkey * 37 % 330)::double as px, (c_custkey * 91 % 330)::double as py from customer) select parcel_id, c_custkey, px, py from c join {_PARCELS} p on px >= minx and px < maxx and py >= miny and py < maxy""", "px py")
def zonal_boxes(spark, d):
    shapes = _shapes(spark, d)
    points = fx.read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 330).cast("double").alias("px"), (F.col("c_custkey") * 91 % 330).cast("double").alias("py"))
    return spatial.zonal_join(points, validity.valid_only(shapes))


#: Outlines for the validity check, by supplier: points (dx, dy) from a box's corner, the shell's and the hole's.
_OUTLINES = {
    0: [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)]],
    1: [[(0, 0), (8, 8), (8, 0), (0, 8), (0, 0)]],
    2: [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]],
    3: [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(6, 2), (12, 2), (12, 4), (6, 4), (6, 2)]],
    4: [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(20, 2), (22, 2), (22, 4), (20, 4), (20, 2)]],
    5: [[(0, 0), (8, 0), (8, 8), (4, 0), (0, 8), (0, 0)]],
    6: [[(0, 0), (8, 0), (4, 0), (0, 0)]],
}
_RINGS = ", ".join(f"({k}, {r}, {i}, {x}::double, {y}::double)" for k, rings in _OUTLINES.items() for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring))
_VALID = f"""with t(k, ring, i, dx, dy) as (values {_RINGS}), r as (select parcel_id, ring, i, minx + dx as x, miny + dy as y from {_PARCELS} p join t on p.parcel_id::bigint % 7 = k),
  s as (select parcel_id, ring, i, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1, count(*) over (partition by parcel_id, ring) - 1 as n from r window w as (partition by parcel_id, ring order by i) qualify x1 is not null),
  area as (select parcel_id from s group by parcel_id, ring having sum(x0 * y1 - x1 * y0) = 0 and any_value(n) < 4),
  o as (select a.parcel_id, a.ring = b.ring as same, b.i = a.i + 1 or (a.i = 0 and b.i = a.n - 1) as beside, sign((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) as b0, sign((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) as b1,
    sign((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) as a0, sign((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) as a1, least(greatest(a.x0, a.x1), greatest(b.x0, b.x1)) - greatest(least(a.x0, a.x1), least(b.x0, b.x1)) as w, least(greatest(a.y0, a.y1), greatest(b.y0, b.y1)) - greatest(least(a.y0, a.y1), least(b.y0, b.y1)) as h
    from s a join s b on a.parcel_id = b.parcel_id and (a.ring, a.i) < (b.ring, b.i) where w >= 0 and h >= 0),
  m as (select parcel_id, same, beside, b0 * b1 <= 0 and a0 * a1 <= 0 as meet, b0 * b1 < 0 and a0 * a1 < 0 as proper, b0 = 0 and b1 = 0 and (w > 0 or h > 0) as overlap from o),
  ray as (select h.parcel_id, count(*) filter ((s.y0 > h.y) <> (s.y1 > h.y) and h.x < s.x0 + (h.y - s.y0) * (s.x1 - s.x0) / nullif(s.y1 - s.y0, 0)) % 2 as inside from r h join s on h.parcel_id = s.parcel_id and s.ring = 0 where h.ring = 1 group by h.parcel_id, h.i),
  f as (select parcel_id, 1 as flaw from area union all select parcel_id, 2 from m where same and case when beside then overlap else meet end union all select parcel_id, 3 from m where not same and (proper or overlap) union all select parcel_id, 4 from ray where inside = 0)
  select parcel_id, min(flaw) is null as valid, case min(flaw) when 1 then 'no area' when 2 then 'self-intersection' when 3 then 'crossing rings' when 4 then 'hole outside shell' end as reason from {_PARCELS} left join f using (parcel_id) group by parcel_id"""


@query("p11_validity", _VALID)
def outlines(spark, d):
    def wkb(key, x, y):
        import pandas as pd

        shapes = [_OUTLINES[int(k) % 7] for k in key]
        return pd.Series([spatial.polygon_wkb([[(a + dx, b + dy) for dx, dy in ring] for ring in rings]) for rings, a, b in zip(shapes, x, y, strict=True)])

    drawn = fx.parcels(spark, d).mapInPandas(lambda it: (b[["parcel_id"]].assign(geometry=wkb(b["parcel_id"], b["minx"], b["miny"])) for b in it), "parcel_id string, geometry binary")
    return validity.validity(drawn)


_GRID = f"""with o as (select *, row_number() over (partition by l_suppkey, month(l_shipdate) order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as rn from lineitem where month(l_shipdate) between 4 and 10),
  g as (select cast(l_suppkey as varchar) as parcel_id, month(l_shipdate)::integer as month, (rn // 8)::integer as y, (rn % 8)::integer as x, case when l_quantity <> 50 then 500 + l_extendedprice::double / 20 end as v from o),
  q as (select parcel_id, month, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi, count(v) as n, max(y) as y1, max(x) as x1 from g group by all),
  e as (select q.*, yy.y, xx.x from q, (select unnest(range(64))::integer as y) yy, (select unnest(range(8))::integer as x) xx where n >= 9 and yy.y <= y1 and xx.x <= x1),
  l as (select e.parcel_id, e.month, e.y, e.x, coalesce(case when hi - lo >= 1e-5 then floor((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255) end, 0)::double as level, v is not null as valid from e left join g using (parcel_id, month, y, x)),
  f as (select * from (values (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) t(k, dy, dx)),
  c as (select a.parcel_id, a.month, k, avg((a.level - b.level) ^ 2) as contrast, avg((a.level + b.level) / 2) as m, avg((a.level ^ 2 + b.level ^ 2) / 2) as s, avg(a.level * b.level) as ab from l a, f, l b where b.parcel_id = a.parcel_id and b.month = a.month and b.y = a.y + dy and b.x = a.x + dx group by all)
  select parcel_id, month, avg(contrast) as GLCM_Contrast, avg(case when s - m * m < 1e-15 then 1.0 else (ab - m * m) / (s - m * m) end) as GLCM_Correlation from c group by all"""


def _levels(spark, d):
    return texture.levels(with_indices(fx.grid(spark, d)))


query("a10_cooccurrence", _GRID, "GLCM_Contrast GLCM_Correlation")(lambda s, d: texture.cooccurrence(_levels(s, d)))
_CELL = {(y, x): f"{v}::double" for (y, x), v in zip(((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)), ("nw", "n_", "ne", "w", "level", "e", "sw", "s_", "se"), strict=True)}
_LBP = f"""with {_GRID.removeprefix("with ").partition("f as (select")[0].strip().rstrip(",")},
  r as (select *, lag(level, 1, 0) over xs as w, lead(level, 1, 0) over xs as e from l window xs as (partition by parcel_id, month, y order by x)),
  k as (select *, {", ".join(f"{f}({a}, 1, 0) over ys as {b}" for f, side in (("lag", "n"), ("lead", "s")) for a, b in (("w", side + "w"), ("level", side + "_"), ("e", side + "e")))} from r window ys as (partition by parcel_id, month, x order by y))
  select parcel_id, month, var_pop({texture.pattern_sql(lambda y, x: _CELL[y, x])}) as LBP_Variance from k where valid group by all"""
query("a10_binary_patterns", _LBP, "LBP_Variance")(lambda s, d: texture.binary_patterns(_levels(s, d)))
query("s18_geometry_types", f"select 'Polygon' as geom_type, count(*) as n from {_PARCELS}")(lambda s, d: _shapes(s, d).groupBy(spatial.geometry_type().alias("geom_type")).agg(F.count("*").alias("n")))

@query("j01_optical_texture_join", f"with z as ({_stats(_DENSE)}), t as ({_GRID}) select z.parcel_id, z.month, NDVI_mean, coalesce(GLCM_Contrast, 0.0) as GLCM_Contrast, coalesce(GLCM_Correlation, 0.0) as GLCM_Correlation from z left join (from t where month <> 7) t using (parcel_id, month)", "NDVI_mean GLCM_Contrast GLCM_Correlation")
def texture_join(spark, d):
    """Optical statistics with texture, which one month lacks altogether: zeros there."""
    t = texture.cooccurrence(_levels(spark, d).where("month != 7"))
    return zonal.zonal_stats(dense(spark, d), ["NDVI"]).select("parcel_id", "month", "NDVI_mean").join(t, ["parcel_id", "month"], "left").fillna(0.0, ["GLCM_Contrast", "GLCM_Correlation"])


_TENSOR = f"""with z as ({_stats(_DENSE)}), g as ({_GRID}), l as ({_LBP}), s as (select k.parcel_id, k.month, z.* exclude (parcel_id, month), g.* exclude (parcel_id, month), LBP_Variance, case when z.parcel_id is null then null when k.month = 4 then 0.0 else NDVI_mean - lag(NDVI_mean) over (partition by k.parcel_id order by k.month) end as delta_NDVI
  from {_KEYS} k left join z using (parcel_id, month) left join g using (parcel_id, month) left join l using (parcel_id, month))
  select parcel_id, month, [{", ".join(f"round_even(coalesce({f}, median({f}) over (partition by month), 0.0) * 1e6, 0) / 1e6 + 0.0" for f in FEATURES)}] as features from s"""


def panel(spark, d, stats=None):
    """(parcel_id, month, FEATURES) on a full spine, nulls by the month's median; statistics, both textures and the NDVI change."""
    z = zonal.delta_calendar(zonal.zonal_stats(dense(spark, d)) if stats is None else stats, "NDVI_mean", MONTHS)
    at = stored(_levels(spark, d))
    both = texture.cooccurrence(at).join(texture.binary_patterns(at), ["parcel_id", "month"], "full")
    full = zonal.spine(z.join(both, ["parcel_id", "month"], "left").select("parcel_id", "month", *FEATURES), MONTHS)
    return zonal.impute_median(stored(full), FEATURES)


@query("m25_full_tensor", _TENSOR)
def full_tensor(spark, d):
    return panel(spark, d).select("parcel_id", "month", F.array(*(F.rint(F.col(f) * 1e6) / 1e6 + 0.0 for f in FEATURES)).alias("features"))


@query("m09_m10_trained_scan")
def trained_scan(spark, d):
    """Two nets learn to reconstruct the standardised panel of all 47 features, and the better one scores every parcel."""
    stats = stored(zonal.zonal_stats(dense(spark, d)))
    t = zonal.tensor(panel(spark, d, stats), FEATURES, MONTHS)
    q = quality.quality(zonal.spine(stats, MONTHS), MONTHS, dict.fromkeys(MONTHS, 1.0))
    by_parcel = q.groupBy("parcel_id").agg(F.array(*(F.max(F.when(F.col("month") == m, F.col("quality"))) for m in MONTHS)).alias("q"))
    both = stored(t.join(by_parcel, "parcel_id"))
    scores = training.scaled(both, training.fit_scaler(both))
    model = training.train(scores)
    return training.scan(scores, model)


_AT = lambda c, m: f"coalesce(max(case when month = {m} then {c} end), 0.0)"
_EACH = lambda c: ", ".join(_AT(c, m) for m in MONTHS)
_M18 = f"""with z as ({_stats(_DENSE)}), t as ({_GRID}), p as (select parcel_id, month, NDVI_mean as ndvi, GLCM_Contrast as tex, NDVI_valid_ratio as q from z left join t using (parcel_id, month)),
  w as (select parcel_id, {", ".join(f'{_AT(c, m)} as "{n}_{m}月"' for m in MONTHS for c, n in (("ndvi", "NDVI"), ("tex", "GLCM")))}, [{_EACH("ndvi")}] as nd, [{_EACH("tex")}] as tx, [{_EACH("q")}] as qs from p group by parcel_id)
  select * exclude (nd, tx, qs), list_max(nd[2:6]) as "{scoring.MACRO[0]}", nd[1] as "{scoring.MACRO[1]}", list_stddev_pop(nd) as "{scoring.MACRO[2]}", list_avg(tx) as "{scoring.MACRO[3]}", list_avg(qs) as "{scoring.QUALITY[0]}", len(list_filter(qs, lambda x: x < 0.5))::integer as "{scoring.QUALITY[1]}" from w"""


@query("m18_interpretable", _M18, " ".join((*scoring.MACRO, scoring.QUALITY[0], *(f"{n}_{m}月" for m in MONTHS for n in ("NDVI", "GLCM")))))
def interpretable(spark, d):
    z = zonal.zonal_stats(dense(spark, d), ["NDVI"]).select("parcel_id", "month", F.col("NDVI_mean").alias("ndvi"), F.col("NDVI_valid_ratio").alias("quality"))
    t = texture.cooccurrence(_levels(spark, d)).select("parcel_id", "month", F.col("GLCM_Contrast").alias("texture"))
    return scoring.interpretable(z.join(t, ["parcel_id", "month"], "left"), MONTHS)


@query("m15_mixture")
def mixture(spark, d):
    """Standard scores of the four macro features of each parcel; k = 3 to 8 by BIC with 5 starts, fitted again with 10."""
    macro = interpretable(spark, d).select("parcel_id", F.array(*(F.col(c) for c in scoring.MACRO)).alias("v"))
    points = stored(clusters.standardised(macro, "parcel_id", "v"))
    found = mixtures.fit_best(points, "parcel_id", "v")
    return mixtures.assign(points, "v", found).select("parcel_id", "cluster", "confidence")


@query("m19_m21_boosted_trees")
def boosted(spark, d):
    """Three classes learnt from golden labels over pseudo labels of the physical rules, 100 rounds at depth 3; each parcel's class,
    and the two features whose Shapley values say most for it."""
    panel = stored(interpretable(spark, d))
    names = [c for c in panel.columns if c != "parcel_id"]
    z = zonal.zonal_stats(dense(spark, d), ["NDVI"])
    flags = scoring.agronomy(z.select("parcel_id", "month", F.col("NDVI_mean").alias("ndvi"), (F.col("NDVI_cv") * 100).alias("glcm")))
    pseudo = flags.select("parcel_id", F.when(F.col("orchard"), 1).when(F.col("abandoned"), 2).otherwise(0).alias("label"))
    golden = labels.true_labels(fx.labels(spark, d).select("parcel_id", F.when(F.col("label") >= 2, (F.col("label") + 1) % 3).otherwise(labels.UNREVIEWED).alias("true_label")))
    trees = boosting.fit(panel.join(labels.merge(golden, pseudo), "parcel_id"), names)
    judged = stored(scoring.classify(boosting.chances(panel, trees)).join(panel, "parcel_id"))
    top = boosting.top_two(boosting.attributions(judged, trees, ["parcel_id"]), names)
    said = labels.reasons(top).select("parcel_id", "top1", "value1", "top2", "value2", F.col("reason").alias("own"))
    reason = F.when(F.col("floored"), labels.UNSURE).otherwise(F.col("own")).alias("reason")
    return judged.join(said, "parcel_id").select("parcel_id", "p0", "p1", "p2", "class", "class_confidence", "margin", "top1", "value1", "top2", "value2", reason)


_M10 = f"""with z as ({_stats(_SPARSE)}), p as (select parcel_id, avg(NDVI_valid_ratio) as mean_quality, sum((NDVI_valid_ratio < 0.5)::integer)::bigint as low from z group by parcel_id)
  select s.parcel_id, s.mse, mean_quality, coalesce(low, 0)::bigint as low_quality_months from {_MSE} s left join p using (parcel_id)"""


@query("m10_scan_report", _M10, "mse mean_quality")
def scan_report(spark, d):
    z = zonal.zonal_stats(sparse(spark, d), ["NDVI"]).select("parcel_id", "month", F.col("NDVI_valid_ratio").alias("quality"))
    return scoring.scan_report(fx.scores(spark, d), z)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {k: oracle(q) for k, q in REGISTRY.items() if q.sql}
