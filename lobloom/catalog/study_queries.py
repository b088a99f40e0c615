"""Queries over the stock-day panel: cross-sections, evaluation, portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobloom.catalog.registry import query, rounded
from lobloom.catalog.sqlgen import avg_rank, clip, fin, pct, residual, zsc
from lobloom.catalog.views import PANEL, STUDY, sql

from lobloom.operators import crosssection as C
from lobloom.operators import history as H
from lobloom.plans import evaluation as E
from lobloom.plans import studies as S
from lobloom.session import stage
from lobloom.sources.derived import panel, study

ST = ["style1", "style2", "style3", "style4", "style5"]
D, DD = "date", "date, domain"


@query("x01_forward_returns", sql(PANEL, """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS dn FROM (SELECT DISTINCT date FROM panel))""",
    "p AS (SELECT symbol, date, dn, ret FROM panel JOIN cal USING (date))",
    fin("""SELECT p.symbol, p.date, a.ret AS ret_d1, (1+a.ret)*(1+b.ret)-1 AS ret_d2, (1+a.ret)*(1+b.ret)*(1+c.ret)-1 AS ret_d3,
      (1+a.ret)*(1+b.ret)*(1+c.ret)*(1+d.ret)*(1+e.ret)-1 AS ret_d5 FROM p
      LEFT JOIN p a ON a.symbol=p.symbol AND a.dn=p.dn+1 LEFT JOIN p b ON b.symbol=p.symbol AND b.dn=p.dn+2 LEFT JOIN p c ON c.symbol=p.symbol AND c.dn=p.dn+3
      LEFT JOIN p d ON d.symbol=p.symbol AND d.dn=p.dn+4 LEFT JOIN p e ON e.symbol=p.symbol AND e.dn=p.dn+5""", "ret_d1 ret_d2 ret_d3 ret_d5", 9)))
def x01(spark, sf):
    return rounded(E.forward_returns(panel(spark, sf)), 9)


@query("x02_winsorise", sql(PANEL, fin(f"SELECT symbol, date, {clip('factor', D)} AS factor_w, {clip('ret', D, 0.05, 0.95)} AS ret_w FROM panel", "factor_w ret_w", 9)))
def x02(spark, sf):
    p = panel(spark, sf).select("symbol", "date", "factor", "ret")
    w = C.winsorise(p, ["date"], {"factor_w": "factor"})
    r = C.winsorise(p, ["date"], {"ret_w": "ret"}, 0.05, 0.95)
    return rounded(w.select("symbol", "date", "factor_w").join(r.select("symbol", "date", "ret_w"), ["symbol", "date"]), 9)


@query("x03_zscore", sql(PANEL, fin(f"SELECT symbol, date, {zsc('factor', D)} AS factor_z, {zsc('depth', D)} AS depth_z FROM panel", "factor_z depth_z")))
def x03(spark, sf):
    z = C.zscore(panel(spark, sf), ["date"], {"factor_z": "factor", "depth_z": "depth"})
    return rounded(z.select("symbol", "date", "factor_z", "depth_z"))


@query("x04_residualise", sql(PANEL, "px AS (SELECT *, style1+style2 AS twin FROM panel)",
    residual("ra", "px", D, {"neutral": "factor"}, [*ST, "twin"], r2=True),
    fin("SELECT symbol, date, neutral, neutral_r2, 5 AS neutral_rank FROM ra", "neutral neutral_r2")))
def x04(spark, sf):
    p = panel(spark, sf).withColumn("twin", F.col("style1") + F.col("style2"))
    r = C.residualise(p, ["date"], {"neutral": ("factor", [*ST, "twin"])}, r2=True, rank=True)
    return rounded(r.select("symbol", "date", "neutral", "neutral_r2", "neutral_rank"))


@query("x05_neutralise_scopes", sql(STUDY, residual("ra", "study", D, {"market_neutral": "factor"}, ST[:2]),
    residual("rb", "ra", DD, {"domain_neutral": "factor"}, ST[:2]),
    fin("SELECT symbol, date, domain, market_neutral, domain_neutral FROM rb", "market_neutral domain_neutral")))
def x05(spark, sf):
    s = study(spark, sf).select("symbol", "date", "domain", "factor", *ST[:2])
    m = E.neutralise(s, "factor", ST[:2], "market", "market_neutral")
    d = E.neutralise(s, "factor", ST[:2], "domain", "domain_neutral")
    k = ["symbol", "date", "domain"]
    return rounded(m.select(*k, "market_neutral").join(d.select(*k, "domain_neutral"), k))


@query("x06_rank_ic", sql(PANEL, f"r AS (SELECT date, factor, ret, {avg_rank('factor', D)} AS a, {avg_rank('ret', D)} AS b FROM panel)",
    fin("SELECT date, count(*) AS n, corr(a,b) AS rank_ic, corr(factor,ret) AS pearson_ic FROM r GROUP BY 1 HAVING count(*)>=3", "rank_ic pearson_ic")))
def x06(spark, sf):
    p = panel(spark, sf)
    return rounded(C.rank_ic(p, ["date"], "factor", "ret", "rank_ic").join(
        C.pearson(p, ["date"], "factor", "ret", "pearson_ic").drop("n"), "date"))


@query("x07_tail_spread", sql(PANEL, "r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY depth, symbol) AS p, count(*) OVER (PARTITION BY date) AS n FROM panel)",
    fin("""SELECT date, n, avg(ret) FILTER (p>n-greatest(1,n//10)) AS top, avg(ret) FILTER (p<=greatest(1,n//10)) AS bottom,
        avg(ret) FILTER (p>n-greatest(1,n//10)) - avg(ret) FILTER (p<=greatest(1,n//10)) AS spread FROM r GROUP BY 1,2""", "top bottom spread", 9)))
def x07(spark, sf):
    return rounded(C.tail_spread(panel(spark, sf), ["date"], "depth", "ret"), 9)


_DEC = ", ".join(f"avg(ret) FILTER (dc={d}) AS d{d}" for d in range(1, 11))


@query("x08_decile_table", sql(PANEL,
    f"r AS (SELECT date, factor, ret, ceil(10.0*row_number() OVER (PARTITION BY date ORDER BY factor, symbol)/count(*) OVER (PARTITION BY date)) AS dc, {avg_rank('factor', D)} AS a, {avg_rank('ret', D)} AS b FROM panel)",
    f"g AS (SELECT date, count(*) AS n, {_DEC}, avg(ret) AS universe_ret, corr(factor,ret) AS pearson_ic, corr(a,b) AS rank_ic FROM r GROUP BY 1 HAVING count(*)>=10)",
    fin("SELECT *, d10-d1 AS top_bottom, d10-universe_ret AS top_excess FROM g",
        " ".join(f"d{d}" for d in range(1, 11)) + " universe_ret pearson_ic rank_ic top_bottom top_excess", 8)))
def x08(spark, sf):
    return rounded(E.decile_table(panel(spark, sf), "factor", "ret"), 8)


@query("x09_tail_grid", sql(PANEL, "r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, symbol) AS p, count(*) OVER (PARTITION BY date) AS n FROM panel)",
    "w AS (SELECT *, greatest(1, floor(n*wd))::BIGINT AS k FROM r CROSS JOIN (VALUES (0.05::DOUBLE),(0.1),(0.2)) v(wd))",
    fin("""SELECT *, top_return-bottom_return AS top_minus_bottom FROM (SELECT date, wd AS tail_width, count(*) AS n, k AS tail_names, avg(ret) FILTER (p>n-k) AS top_return, avg(ret) FILTER (p<=k) AS bottom_return
      FROM w GROUP BY date, wd, k)""", "top_return bottom_return top_minus_bottom", 9)))
def x09(spark, sf):
    return rounded(E.tail_grid(panel(spark, sf), "factor", "ret", [0.05, 0.1, 0.2]), 9)


def _scoped(src: str, factors: list[str], targets: list[str], minimum: int, tag: str = "") -> str:
    long = " UNION ALL ".join(
        f"SELECT symbol, date, domain, exchange, '{f}' AS factor_name, ({f})::DOUBLE AS score, {', '.join(targets)} FROM {src} WHERE {f} IS NOT NULL" for f in factors)
    g = "date, domain, factor_name"
    cols = ", ".join(targets)
    goals = " UNION ALL ".join(f"SELECT symbol, date, factor_name, scope, scope_key, score, '{t}' AS target_name, {t} AS target FROM sc{tag}" for t in targets)
    key = "scope, scope_key, date, factor_name, target_name"
    return f"""
lo{tag} AS ({long}),
lr{tag} AS (SELECT *, {pct('score', g)} AS pc, count(*) OVER (PARTITION BY {g}) AS dn_ FROM lo{tag}),
sc{tag} AS (SELECT symbol, date, factor_name, 'domain' AS scope, domain AS scope_key, score, {cols} FROM lr{tag}
  UNION ALL SELECT symbol, date, factor_name, 'domain_rank_aggregate', 'all_domains', pc, {cols} FROM lr{tag} WHERE dn_>={minimum}
  UNION ALL SELECT symbol, date, factor_name, 'exchange', exchange, score, {cols} FROM lr{tag}
  UNION ALL SELECT symbol, date, factor_name, 'all_market', 'all', score, {cols} FROM lr{tag}),
sg{tag} AS (SELECT * FROM ({goals}) WHERE target IS NOT NULL),
sr{tag} AS (SELECT *, {avg_rank('score', key)} AS ra, {avg_rank('target', key)} AS rb, row_number() OVER (PARTITION BY {key} ORDER BY score, symbol) AS p, count(*) OVER (PARTITION BY {key}) AS nn FROM sg{tag}),
ev{tag} AS (SELECT {key}, count(*) AS n, CASE WHEN stddev_pop(ra)>0 AND stddev_pop(rb)>0 THEN corr(ra, rb) END AS rank_ic,
   avg(target) FILTER (p>nn-greatest(1,nn//10)) - avg(target) FILTER (p<=greatest(1,nn//10)) AS d10_d1 FROM sr{tag} GROUP BY ALL HAVING count(*)>={minimum})"""


def _tstat(v: str) -> str:
    return f"CASE WHEN count({v})>1 AND stddev_samp({v})>0 THEN avg({v})/(stddev_samp({v})/sqrt(count({v}))) END"


def _summary(src: str = "ev", key: str = "scope, scope_key, factor_name, target_name") -> str:
    return f"""SELECT {key}, count(*) AS n_dates, sum(n)::BIGINT AS n_obs, avg(n) AS avg_names, avg(rank_ic) AS rank_ic, {_tstat('rank_ic')} AS rank_ic_t,
      avg((round(rank_ic,12)>0)::INTEGER) AS rank_ic_positive_date_share, avg(d10_d1) AS d10_d1, {_tstat('d10_d1')} AS d10_d1_t, avg((round(d10_d1,12)>0)::INTEGER) AS d10_d1_positive_date_share
      FROM {src} GROUP BY {key}"""


SUM_D = "avg_names rank_ic rank_ic_t rank_ic_positive_date_share d10_d1 d10_d1_t d10_d1_positive_date_share"


@query("x10_scoped_evaluation", sql(STUDY, _scoped("study", ["factor", "vr"], ["ret", "ret30"], 15), fin("SELECT * FROM ev", "rank_ic d10_d1")))
def x10(spark, sf):
    return rounded(E.evaluate(study(spark, sf), ["factor", "vr"], ["ret", "ret30"], 15))


@query("x11_style_exposure", sql(PANEL, residual("ra", "panel", D, {"e": "factor"}, ST[:3], r2=True),
    "rr AS (SELECT *, " + ", ".join(f"{avg_rank(c, D)} AS k{i}" for i, c in enumerate(["factor", *ST[:3]])) + " FROM ra)",
    fin("""SELECT date, count(*) AS n, corr(k0,k1) AS rank_exposure_style1, corr(k0,k2) AS rank_exposure_style2, corr(k0,k3) AS rank_exposure_style3,
      any_value(e_r2) AS joint_r2, 3 AS effective_rank, (abs(corr(k0,k1))+abs(corr(k0,k2))+abs(corr(k0,k3)))/3 AS mean_abs_exposure FROM rr GROUP BY 1""",
      "rank_exposure_style1 rank_exposure_style2 rank_exposure_style3 joint_r2 mean_abs_exposure")))
def x11(spark, sf):
    return rounded(E.style_exposure(panel(spark, sf), "factor", ST[:3]))


@query("x12_hac_summary", sql(PANEL,
    "g AS (SELECT date, avg(ret) AS v FROM panel GROUP BY 1)",
    "t AS (SELECT l AS lags, date, v FROM g CROSS JOIN (VALUES (0),(1),(2),(4)) x(l))",
    "c AS (SELECT *, v-avg(v) OVER (PARTITION BY lags) AS c FROM t)",
    "cl AS (SELECT *, lag(c,1) OVER q AS c1, lag(c,2) OVER q AS c2, lag(c,3) OVER q AS c3, lag(c,4) OVER q AS c4 FROM c WINDOW q AS (PARTITION BY lags ORDER BY date))",
    fin("""SELECT lags, avg(v) AS mean, CASE WHEN lags=0 THEN avg(v)/(stddev_samp(v)/sqrt(count(*))) ELSE
       avg(v)/sqrt(greatest(0, (sum(c*c) + 2*greatest(0,1-1/(lags+1.0::DOUBLE))*sum(c*c1) + 2*greatest(0,1-2/(lags+1.0::DOUBLE))*sum(c*c2)
         + 2*greatest(0,1-3/(lags+1.0::DOUBLE))*sum(c*c3) + 2*greatest(0,1-4/(lags+1.0::DOUBLE))*sum(c*c4))/count(*))/count(*)) END AS t,
       count(*) AS n_dates, avg((v>0)::INTEGER) AS positive_date_share FROM cl GROUP BY lags""", "mean t positive_date_share")))
def x12(spark, sf):
    g = panel(spark, sf).groupBy("date").agg(F.avg("ret").alias("v"))
    lags = g.withColumn("lags", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 4)])))
    return rounded(E.newey_west(lags, ["lags"], "v", "lags"))


@query("x13_neutral_return_event_gap", sql(STUDY, residual("ra", "study", D, {"nf": "factor", "nr": "ret"}, ST),
    f"q AS (SELECT *, least(5, floor(({pct('round(nf,10)', D)})*5)+1) AS b FROM ra)",
    fin("""SELECT *, rp - rc AS positive_gap, rn - rc AS negative_gap FROM (SELECT date, avg(nr) FILTER (b=5) AS rp, avg(nr) FILTER (b=1) AS rn, avg(nr) FILTER (b BETWEEN 2 AND 4) AS rc,
        count(*) FILTER (b IN (1,5)) AS n_events, count(*) AS n FROM q GROUP BY 1)""", "positive_gap negative_gap rp rn rc", 8)))
def x13(spark, sf):
    r = C.residualise(study(spark, sf), ["date"], {"nf": ("factor", ST), "nr": ("ret", ST)}).select(
        "symbol", "date", F.round("nf", 10).alias("nf"), "nr")
    b = C.percentile_ranks(stage(r), ["date"], {"p": "nf"}).withColumn("b", C.quintile("p"))
    b = b.withColumn("event", F.when(F.col("b") == 5, 1).when(F.col("b") == 1, -1).otherwise(0))
    gaps = E.event_gap(b, ["date"], "event", "nr")
    legs = b.groupBy("date").agg(
        F.avg(F.when(F.col("event") == 1, F.col("nr"))).alias("rp"), F.avg(F.when(F.col("event") == -1, F.col("nr"))).alias("rn"),
        F.avg(F.when(F.col("event") == 0, F.col("nr"))).alias("rc"))
    return rounded(gaps.join(legs, "date"), 8)


@query("x15_vr_state_contrast", sql(STUDY, "b AS (SELECT *, floor(3.0*(row_number() OVER (PARTITION BY date, domain ORDER BY vr, symbol)-1)/count(*) OVER (PARTITION BY date, domain)) AS k FROM study)",
    fin("SELECT *, high_mean-low_mean AS high_minus_low FROM (SELECT date, domain, avg(ret) FILTER (k=0) AS low_mean, avg(ret) FILTER (k=1) AS mid_mean, avg(ret) FILTER (k=2) AS high_mean, count(ret) AS n FROM b GROUP BY 1,2)",
        "low_mean mid_mean high_mean high_minus_low", 9)))
def x15(spark, sf):
    s = S.vr_states(study(spark, sf).select("symbol", "date", "domain", "vr", "ret"), "vr")
    return rounded(S.state_contrast(s, "vr_state", "ret", ["date", "domain"]), 9)


_LADDER = {"raw": [], "vr": ["vr"], "vr_flow": ["vr", "flow"], "styles": ["vr", "flow", "style1", "style2"]}
_LC = ["factor", "vr", "flow", "style1", "style2"]


@query("x16_model_ladder", sql(STUDY, "r AS (SELECT symbol, date, " + ", ".join(f"{pct(c, D)} - 0.5 AS r_{c}" for c in _LC) + " FROM study)",
    residual("l1", "r", D, {"raw": "r_factor"}, []), residual("l2", "l1", D, {"vr": "r_factor"}, ["r_vr"]),
    residual("l3", "l2", D, {"vr_flow": "r_factor"}, ["r_vr", "r_flow"]),
    residual("l4", "l3", D, {"styles": "r_factor"}, ["r_vr", "r_flow", "r_style1", "r_style2"]),
    fin("SELECT symbol, date, raw, vr, vr_flow, styles FROM l4", "raw vr vr_flow styles")))
def x16(spark, sf):
    s = study(spark, sf).select("symbol", "date", *_LC)
    return rounded(S.ranked_ladder(s, "factor", _LC[1:], _LADDER, ["date"]).select("symbol", "date", *_LADDER))


@query("x16_tail_grid_states", sql(STUDY, """b AS (SELECT *, floor(3.0*(row_number() OVER (PARTITION BY date ORDER BY vr, symbol)-1)/count(*) OVER (PARTITION BY date)) AS k FROM study)""",
    """h AS (SELECT *, least(4, floor(5.0*(row_number() OVER (PARTITION BY date ORDER BY factor, symbol)-1)/count(*) OVER (PARTITION BY date)))::INTEGER+1 AS b_bucket,
         (floor(3.0*(row_number() OVER (PARTITION BY date ORDER BY past_return, symbol)-1)/count(*) OVER (PARTITION BY date)))::INTEGER+1 AS pre_bucket FROM b WHERE k=2)""",
    fin("SELECT date, b_bucket, pre_bucket, count(*) AS n, avg(ret) AS mean_return FROM h GROUP BY 1,2,3", "mean_return", 9)))
def x16b(spark, sf):
    s = study(spark, sf).select("symbol", "date", "vr", "factor", "past_return", "ret")
    high = stage(S.vr_states(s, "vr", ["date"]).filter(F.col("vr_state") == "high"))
    h = C.equal_buckets(C.equal_buckets(high, ["date"], "factor", 5, "b"), ["date"], "past_return", 3, "p")
    return rounded(h.groupBy("date", (F.col("b") + 1).alias("b_bucket"), (F.col("p") + 1).alias("pre_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_return")), 9)


@query("x17_reversal_scores", sql(STUDY, f"""r AS (SELECT symbol, date, domain, -({pct('factor', DD)} - 0.5) AS rev, {pct('vr', DD)} AS pv, n_obs/(n_obs + median(n_obs) OVER (PARTITION BY date, domain)) AS w FROM study)""",
    fin("SELECT symbol, date, domain, rev AS b_reversal, rev*pv AS b_reversal_vr, rev*pv*sqrt(w) AS b_reversal_vr_reliability FROM r", "b_reversal b_reversal_vr b_reversal_vr_reliability")))
def x17(spark, sf):
    s = study(spark, sf).select("symbol", "date", "domain", "factor", "vr", "n_obs")
    return rounded(S.reversal_scores(s, S.SLICE, "factor", "vr", "n_obs").drop("factor", "vr", "n_obs"))


def _legs(group: str) -> str:
    rows = []
    for name, (bl, vl, bs, vs) in S.LEGS.items():
        lo = f"pb<={bl}" + (f" AND pv<={vl}" if vl else "")
        hi = f"pb>={bs}" + (f" AND pv>={vs}" if vs else "")
        rows.append(f"""SELECT {group}, '{name}' AS strategy, count(*) AS signal_n, count(ret) AS universe_n, count(ret) FILTER ({lo}) AS long_n, count(ret) FILTER ({hi}) AS short_n,
          avg(ret) FILTER ({lo}) AS long_ret, avg(ret) FILTER ({hi}) AS short_ret, avg(ret) AS universe_ret FROM r GROUP BY {group}""")
    return " UNION ALL ".join(rows)


@query("x18_intersection_legs", sql(STUDY, f"r AS (SELECT date, domain, ret, {pct('factor', D, 'open')} AS pb, {pct('vr', D, 'open')} AS pv FROM study)",
    f"g AS ({_legs('date')})",
    fin("SELECT *, long_ret-short_ret AS long_short, long_ret-universe_ret AS long_excess, short_ret-universe_ret AS short_excess FROM g WHERE long_n>=5 AND short_n>=5 AND universe_n>=20",
        "long_ret short_ret universe_ret long_short long_excess short_excess", 9)))
def x18(spark, sf):
    return rounded(S.intersection_legs(study(spark, sf).select("symbol", "date", "factor", "vr", "ret"), "factor", "vr", "ret", ["date"]), 9)


@query("x18_factor_correlation", sql(STUDY, f"r AS (SELECT date, domain, {avg_rank('factor', DD)} AS a, {avg_rank('vr', DD)} AS b FROM study)",
    fin("SELECT date, domain, count(*) AS n, CASE WHEN count(*)>=3 AND stddev_pop(a)>0 AND stddev_pop(b)>0 THEN corr(a,b) END AS rank_correlation FROM r GROUP BY 1,2", "rank_correlation")))
def x18b(spark, sf):
    return rounded(S.factor_correlation(study(spark, sf), ["date", "domain"], "factor", "vr"))


@query("x19_top_intersection", sql(STUDY, "r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, symbol) AS pf, row_number() OVER (PARTITION BY date ORDER BY depth, symbol) AS pd, count(*) OVER (PARTITION BY date) AS n FROM study)",
    fin("SELECT date, count(*) AS n_both, avg(ret) AS mean_ret FROM r WHERE pf>n-greatest(1,ceil(n*0.2::DOUBLE)) AND pd>n-greatest(1,ceil(n*0.2::DOUBLE)) GROUP BY 1", "mean_ret", 9)))
def x19(spark, sf):
    s = study(spark, sf).select("symbol", "date", "factor", "depth", "ret")
    a = S.top_fraction(s, ["date"], "factor", 0.2).filter("is_top").select("symbol", "date", "ret")
    b = S.top_fraction(s, ["date"], "depth", 0.2).filter("is_top").select("symbol", "date")
    return rounded(a.join(b, ["symbol", "date"], "left_semi").groupBy("date").agg(
        F.count(F.lit(1)).alias("n_both"), F.avg("ret").alias("mean_ret")), 9)


_BANDS = {"none": "true", "not_bottom20": "bp>=0.20", "middle_20_90": "bp BETWEEN 0.20 AND 0.90"}
_PORT = " UNION ALL ".join(
    f"""SELECT date, 's_{c}__b_{b}' AS portfolio, count(*) FILTER (ps>n-greatest(1,floor(n*{f}::DOUBLE)) AND {cond}) AS n_selected, count(*) AS n_benchmark,
      avg(ret) FILTER (ps>n-greatest(1,floor(n*{f}::DOUBLE)) AND {cond}) AS long_return, avg(ret) AS benchmark_return FROM r GROUP BY 1"""
    for c, f in (("top10", 0.1), ("top20", 0.2)) for b, cond in _BANDS.items())


@query("x20_long_only", sql(STUDY, f"r AS (SELECT date, ret, {pct('factor2', D, 'pos')} AS bp, row_number() OVER (PARTITION BY date ORDER BY factor, symbol) AS ps, count(*) OVER (PARTITION BY date) AS n FROM study)",
    fin(f"SELECT *, long_return-benchmark_return AS excess_return FROM ({_PORT}) WHERE n_selected>0", "long_return benchmark_return excess_return", 9)))
def x20(spark, sf):
    return rounded(S.long_only(study(spark, sf).select("symbol", "date", "factor", "factor2", "ret"), "factor", "factor2", "ret", ["date"]), 9)


HYST = f"""
c AS (SELECT symbol, date, ret30, ret, {pct('factor', D, 'pos')} AS sp, {pct('factor2', D, 'pos')} AS bp FROM study),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS dn FROM (SELECT DISTINCT date FROM c)),
gr AS (SELECT symbol, date, dn, coalesce(sp>=0.7 AND bp>=0.1,false) AS st, coalesce(sp>=0.9 AND bp>=0.2,false) AS en, ret30, ret
  FROM (SELECT symbol, min(date) AS lo FROM c WHERE sp>=0.9 AND bp>=0.2 GROUP BY 1) JOIN cal ON date>=lo LEFT JOIN c USING (symbol, date)),
il AS (SELECT *, sum((NOT st)::INTEGER) OVER (PARTITION BY symbol ORDER BY dn) AS k FROM gr),
hd AS (SELECT * FROM (SELECT *, st AND max((en AND st)::INTEGER) OVER (PARTITION BY symbol, k ORDER BY dn)=1 AS held FROM il) WHERE held),
pd AS (SELECT date, dn, count(*) AS n_selected FROM hd GROUP BY 1,2),
ch AS (SELECT *, lag(dn) OVER (ORDER BY dn) AS pdn, lag(n_selected) OVER (ORDER BY dn) AS pn FROM pd),
bo AS (SELECT h.date, ch.n_selected, ch.pn, h.ret30, h.ret, w.symbol IS NOT NULL AS was FROM hd h JOIN ch USING (date) LEFT JOIN hd w ON w.symbol=h.symbol AND w.dn=ch.pdn),
dy AS (SELECT date, n_selected, pn, count(*) FILTER (was) AS n_retained,
    sum(greatest(0, 1.0::DOUBLE/n_selected - CASE WHEN was THEN 1.0::DOUBLE/pn ELSE 0 END)) AS buy_turnover, sum(greatest(0, CASE WHEN was THEN 1.0::DOUBLE/pn ELSE 0 END - 1.0::DOUBLE/n_selected)) AS sk,
    sum(ret30/n_selected) AS selected_first_return, sum(ret/n_selected) AS selected_total_return FROM bo GROUP BY 1,2,3),
bn AS (SELECT date, avg(ret30) AS base_first_return, avg(ret) AS base_total_return, count(*) AS n_benchmark FROM study GROUP BY 1),
hp AS (SELECT date, n_selected, n_retained, n_selected-n_retained AS n_entered, coalesce(pn,0)-n_retained AS n_exited, coalesce(n_retained/pn::DOUBLE,0) AS holding_overlap,
    buy_turnover, CASE WHEN pn>0 THEN sk + (pn-n_retained)/pn::DOUBLE ELSE 1 END AS sell_turnover, selected_first_return, selected_total_return,
    base_first_return, base_total_return, n_benchmark FROM dy JOIN bn USING (date))"""


@query("x21_hysteresis_portfolio", sql(STUDY, HYST, fin("""
  SELECT *, gross_total_return-trading_cost AS net_total_return, gross_total_return-trading_cost-base_total_return AS net_active_return FROM (
    SELECT *, 0.2*(buy_turnover+sell_turnover) AS nav_two_way_turnover, selected_total_return-selected_first_return AS selected_remainder,
      0.8*base_total_return+0.2*selected_total_return AS gross_total_return, 0.2*(buy_turnover*5+sell_turnover*10)/10000 AS trading_cost FROM hp)""",
  "holding_overlap buy_turnover sell_turnover selected_first_return selected_total_return base_first_return base_total_return nav_two_way_turnover selected_remainder gross_total_return trading_cost net_total_return net_active_return", 9)))
def x21(spark, sf):
    return rounded(S.hysteresis_portfolio(study(spark, sf).select("symbol", "date", "factor", "factor2", "ret30", "ret"), "factor", "factor2", "ret30", "ret"), 9)


@query("x21_nav_summary", sql(STUDY, "g AS (SELECT date, avg(ret) AS r, avg(ret30) AS b FROM study GROUP BY 1)",
    fin("""SELECT count(*) AS n_days, avg(r) AS avg_daily_ret, product(1+r)-1 AS cum_ret, avg(r)*252 AS ann_ret_simple, stddev_samp(r)*sqrt(252) AS ann_vol, avg(r)/stddev_samp(r)*sqrt(252) AS sharpe,
       avg(r)/(stddev_samp(r)/sqrt(count(*))) AS t_stat, avg((r>0)::INTEGER) AS win_rate, product(1+r)/product(1+b)-1 AS relative_cum FROM g""",
       "avg_daily_ret cum_ret ann_ret_simple ann_vol sharpe t_stat win_rate relative_cum")))
def x21b(spark, sf):
    g = study(spark, sf).groupBy("date").agg(F.avg("ret").alias("r"), F.avg("ret30").alias("b"))
    return rounded(E.annual_summary(g, [], "r").join(
        g.agg((F.product(1.0 + F.col("r")) / F.product(1.0 + F.col("b")) - 1.0).alias("relative_cum"))))


@query("x22_overlay", sql(STUDY, "g AS (SELECT date, avg(ret) FILTER (style5>=20) AS l, avg(ret) AS b FROM study GROUP BY 1)",
    "o AS (SELECT *, 0.2*l AS long_leg_contribution, -0.2*b AS underweight_leg_contribution, 2*0.2::DOUBLE*15/10000 AS trading_cost FROM g WHERE l IS NOT NULL)",
    fin("""SELECT *, long_leg_contribution+underweight_leg_contribution AS gross_active_return, long_leg_contribution+underweight_leg_contribution-trading_cost AS net_active_return,
      b+long_leg_contribution+underweight_leg_contribution-trading_cost AS net_total_return, product(1+b+long_leg_contribution+underweight_leg_contribution-trading_cost) OVER (ORDER BY date) AS nav FROM o""",
      "l b long_leg_contribution underweight_leg_contribution trading_cost gross_active_return net_active_return net_total_return nav", 9)))
def x22(spark, sf):
    g = study(spark, sf).groupBy("date").agg(F.avg(F.when(F.col("style5") >= 20, F.col("ret"))).alias("l"), F.avg("ret").alias("b"))
    o = S.overlay(g.filter(F.col("l").isNotNull()), "l", "b")
    return rounded(S.nav(o, "net_total_return"), 9)


_TS = """CASE WHEN future_buy_volume+future_sell_volume>0 THEN (future_buy_volume-future_sell_volume)/(future_buy_volume+future_sell_volume) END AS future_net_share,
  ln(1+future_buy_volume+future_sell_volume) AS log_future_active_volume, ln(1+future_event_count) AS log_future_event_count, ln(1+future_realized_vol_bps) AS log_future_realized_vol,
  end_spread_bps-spread_bps AS spread_change_bps, ln((end_bid_depth3+end_ask_depth3)/(bid_depth3+ask_depth3)) AS log_depth_change, (end_bid_depth3-end_ask_depth3)/(end_bid_depth3+end_ask_depth3) AS end_book_imbalance3"""
_CS = """active_net_share AS active_flow, chain_net_share AS chain_flow, chain_net_share*(1-multi_chain_share) AS single_chain_confirmation, -chain_net_share*multi_chain_share AS multi_chain_exhaustion,
  coalesce((aggressive_add_buy-aggressive_add_sell)/nullif(aggressive_add_buy+aggressive_add_sell,0),0) AS quote_confirmation,
  (chain_net_share+coalesce((aggressive_add_buy-aggressive_add_sell)/nullif(aggressive_add_buy+aggressive_add_sell,0),0))/2 AS chain_quote_confirmed,
  coalesce((near_cancel_sell-near_cancel_buy)/nullif(near_cancel_sell+near_cancel_buy,0),0) AS quote_withdrawal, pred_fill_sell-pred_fill_buy AS execution_pressure, book_imbalance3"""
_CSN = "active_flow chain_flow single_chain_confirmation multi_chain_exhaustion quote_confirmation chain_quote_confirmed quote_withdrawal execution_pressure book_imbalance3"
_TSN = "future_net_share log_future_active_volume log_future_event_count log_future_realized_vol spread_change_bps log_depth_change end_book_imbalance3"


@query("x23_chain_scores", sql(STUDY, fin(f"SELECT symbol, date, {_CS}, {_TS} FROM study", _CSN + " " + _TSN, 8)))
def x23(spark, sf):
    cols = S.chain_scores() | S.state_targets()
    return rounded(study(spark, sf).select("symbol", "date", *[e.alias(n) for n, e in cols.items()]), 8)


@query("x24_incremental_ladder", sql(STUDY, "s2 AS (SELECT symbol, date, domain, quote_withdrawal, a, a*a AS a2, a*a*a AS a3, style1, style2 FROM (SELECT *, active_net_share AS a, "
    "coalesce((near_cancel_sell-near_cancel_buy)/nullif(near_cancel_sell+near_cancel_buy,0),0) AS quote_withdrawal FROM study))",
    residual("l1", "s2", D, {"style_only": "quote_withdrawal"}, ["style1", "style2"], r2=True),
    residual("l2", "l1", D, {"m1_linear": "quote_withdrawal"}, ["style1", "style2", "a"], r2=True),
    residual("l3", "l2", D, {"m1_cubic": "quote_withdrawal"}, ["style1", "style2", "a", "a2", "a3"], r2=True),
    fin("SELECT symbol, date, style_only, m1_linear, m1_cubic, style_only_r2, m1_linear_r2, m1_cubic_r2 FROM l3", "style_only m1_linear m1_cubic style_only_r2 m1_linear_r2 m1_cubic_r2")))
def x24(spark, sf):
    s = study(spark, sf).select("symbol", "date", "style1", "style2", F.col("active_net_share").alias("a"), S.chain_scores()["quote_withdrawal"].alias("q"))
    s = s.withColumns({"a2": F.col("a") * F.col("a"), "a3": F.col("a") * F.col("a") * F.col("a")})
    st = ["style1", "style2"]
    r = C.residualise(s, ["date"], {"style_only": ("q", st), "m1_linear": ("q", [*st, "a"]), "m1_cubic": ("q", [*st, "a", "a2", "a3"])}, r2=True)
    return rounded(r.drop("style1", "style2", "a", "a2", "a3", "q"))


@query("x25_path_residuals", sql(STUDY, "s2 AS (SELECT *, endpoint_book*endpoint_book AS e2, endpoint_book*endpoint_book*endpoint_book AS e3, book5*book5 AS b2, book5*book5*book5 AS b3, book30*book30 AS c2, book30*book30*book30 AS c3 FROM study)",
    residual("l1", "s2", DD, {"old_endpoint_residual": "flow1"}, ["endpoint_book", "e2", "e3"]), residual("l2", "l1", DD, {"flow5_minus_book5": "flow5"}, ["book5", "b2", "b3"]),
    residual("l3", "l2", DD, {"flow30_minus_book30": "flow30"}, ["book30", "c2", "c3"]), residual("l4", "l3", DD, {"terminal_shock": "flow5"}, ["flow30", "book30", "book5", "book_shift"]),
    residual("l5", "l4", DD, {"flow5_minus_book5_over_flow1": "flow5_minus_book5", "terminal_shock_over_flow1": "terminal_shock"}, ["flow1"]),
    fin("""SELECT symbol, date, old_endpoint_residual, flow5_minus_book5, flow30_minus_book30, terminal_shock, flow5_minus_book5_over_flow1, terminal_shock_over_flow1,
      flow1*execution_pressure AS confirmation1, flow5*execution_pressure AS confirmation5, flow30*execution_pressure AS confirmation30 FROM l5 WHERE dn_>=15""".replace("FROM l5 WHERE dn_>=15",
      "FROM (SELECT *, count(*) OVER (PARTITION BY date, domain) AS dn_ FROM l5) WHERE dn_>=15"),
      "old_endpoint_residual flow5_minus_book5 flow30_minus_book30 terminal_shock flow5_minus_book5_over_flow1 terminal_shock_over_flow1 confirmation1 confirmation5 confirmation30", 5)))
def x25(spark, sf):
    cols = ["symbol", "date", "domain", "flow1", "flow5", "flow30", "endpoint_book", "book5", "book30", "book_shift", "execution_pressure"]
    s = C.attach(study(spark, sf).select(*cols), S.SLICE, {"slice_n": F.count(F.lit(1))}).filter("slice_n >= 15").drop("slice_n")
    r = S.path_residuals(stage(s, "path"))
    return rounded(r.drop(*cols[2:]), 5)


_Q = {f: f"quantile_cont({f}, {{q}}) OVER (PARTITION BY date, domain)" for f in ("flow5", "book5", "flow_shift", "book_shift", "fillability")}


def _ter(f: str) -> str:
    return f"CASE WHEN {f}<={f}_lo THEN 'low' WHEN {f}>={f}_hi THEN 'high' ELSE 'mid' END"


MSTATES = "m0 AS (SELECT *, sign(flow5) AS dir, round(CASE WHEN flow5>=0 THEN ask5/ask30 ELSE bid5/bid30 END, 12) AS ratio, abs(flow5) AS fa, sign(flow5)*past_return AS resp, sign(flow5)*book5 AS al FROM study),\n" + \
    "m1 AS (SELECT *, " + ", ".join(f"{e.format(q=1 / 3)} AS {f}_lo, {e.format(q=2 / 3)} AS {f}_hi" for f, e in _Q.items()) + \
    f""", quantile_cont(resp, {1 / 3}) OVER (PARTITION BY date, domain) AS rlo, quantile_cont(ratio, 0.5) OVER (PARTITION BY date, domain) AS rmid, quantile_cont(fa, {2 / 3}) OVER (PARTITION BY date, domain) AS fhi FROM m0),
m2 AS (SELECT *, CASE WHEN {_ter('flow5')}<>'mid' AND {_ter('book5')}<>'mid' THEN 'active_' || CASE WHEN {_ter('flow5')}='low' THEN 'sell' ELSE 'buy' END || '_book_' || CASE WHEN {_ter('book5')}='low' THEN 'ask' ELSE 'bid' END ELSE 'other' END AS quadrant_state,
  'flow_shift_' || {_ter('flow_shift')} || '_book_shift_' || {_ter('book_shift')} AS path_state,
  CASE WHEN fa>=fhi AND al<0 AND resp<=rlo THEN CASE WHEN ratio<=rmid THEN 'absorbed_depleting' ELSE 'absorbed_replenishing' END WHEN fa>=fhi THEN 'strong_flow_not_absorbed' ELSE 'other' END AS absorption_state,
  {_ter('fillability')} AS fillability_state, dir*fa*greatest(0,-al)*greatest(0,1-ratio) AS breakout_score, dir*fa*greatest(0,-al)*greatest(0,ratio-1) AS replenishing_score FROM m1)"""
_MCOLS = ["symbol", "date", "domain", "flow5", "book5", "flow_shift", "book_shift", "fillability", "past_return", "ask5", "ask30", "bid5", "bid30", "ret", "ret30"]


@query("x26_market_states", sql(STUDY, MSTATES, fin("SELECT symbol, date, quadrant_state, path_state, absorption_state, fillability_state, breakout_score, replenishing_score FROM m2", "breakout_score replenishing_score")))
def x26(spark, sf):
    r = S.market_states(study(spark, sf).select(*_MCOLS))
    return rounded(r.select("symbol", "date", "quadrant_state", "path_state", "absorption_state", "fillability_state", "breakout_score", "replenishing_score"))


_STT = " UNION ALL ".join(f"SELECT '{s}' AS state_type, domain, {s} AS state, '{t}' AS target_name, date, {t} AS v FROM m2" for s in ("quadrant_state", "absorption_state") for t in ("ret", "ret30"))


@query("x26_x36_state_table", sql(STUDY, MSTATES, f"dl AS (SELECT state_type, domain, state, target_name, date, avg(v) AS m, count(*) AS n FROM ({_STT}) WHERE state<>'other' AND v IS NOT NULL GROUP BY ALL)",
    fin(f"SELECT state_type, domain, state, target_name, count(*) AS n_dates, sum(n)::BIGINT AS n_obs, avg(m) AS mean_target, {_tstat('m')} AS mean_target_t FROM dl GROUP BY 1,2,3,4", "mean_target mean_target_t")))
def x26b(spark, sf):
    return rounded(S.state_table(S.market_states(study(spark, sf).select(*_MCOLS)), ["quadrant_state", "absorption_state"], ["ret", "ret30"]))


_F018 = "round(-sign(flow5)*ln(1+CASE WHEN flow5>=0 THEN buy5/greatest(ask5,1e-12) ELSE sell5/greatest(bid5,1e-12) END), 12)"


@query("x27_opponent_pressure", sql(STUDY, fin(f"SELECT symbol, date, domain, {_F018} AS f018 FROM study", "f018")))
def x27(spark, sf):
    return rounded(study(spark, sf).select("symbol", "date", "domain", S.opponent_pressure().alias("f018")))


_CT = {"flow": ["flow5", "f2", "f3"], "flow_ret": ["flow5", "past_return", "ar"], "all": ["flow5", "f2", "past_return", "lv", "ls"]}
_CTC = ["flow5", "f2", "f3", "past_return", "ar", "lv", "ls"]


@query("x28_control_ladder", sql(STUDY, f"s2 AS (SELECT symbol, date, domain, {_F018} AS f018, flow5, flow5*flow5 AS f2, flow5*flow5*flow5 AS f3, past_return, abs(past_return) AS ar, ln(1+buy5+sell5) AS lv, ln(1+style2) AS ls FROM study)",
    "s3 AS (SELECT symbol, date, domain, " + clip("f018", DD) + " AS fw, " + ", ".join(f"{clip(c, DD)} AS w_{c}" for c in _CTC) + " FROM (SELECT *, count(*) OVER (PARTITION BY date, domain) AS n_ FROM s2) WHERE n_>=15)",
    residual("l1", "s3", DD, {"flow": "fw"}, [f"w_{c}" for c in _CT["flow"]], r2=True), residual("l2", "l1", DD, {"flow_ret": "fw"}, [f"w_{c}" for c in _CT["flow_ret"]], r2=True),
    residual("l3", "l2", DD, {"all": "fw"}, [f"w_{c}" for c in _CT["all"]], r2=True).replace('AS all,', 'AS "all",').replace("AS all ", 'AS "all" '),
    fin('SELECT symbol, date, domain, fw AS factor_w, flow, flow_ret, "all" AS all_controls, flow_r2, flow_ret_r2, all_r2 AS all_controls_r2 FROM l3', "factor_w flow flow_ret all_controls flow_r2 flow_ret_r2 all_controls_r2", 5)))
def x28(spark, sf):
    c = F.col
    s = study(spark, sf).select(
        "symbol", "date", "domain", F.round(S.opponent_pressure(), 12).alias("f018"), "flow5", (c("flow5") * c("flow5")).alias("f2"),
        (c("flow5") * c("flow5") * c("flow5")).alias("f3"), "past_return", F.abs("past_return").alias("ar"),
        F.log1p(c("buy5") + c("sell5")).alias("lv"), F.log1p("style2").alias("ls"))
    s = stage(C.attach(s, S.SLICE, {"n_": F.count(F.lit(1))}).filter("n_ >= 15").drop("n_"), "controls")
    specs = {("all_controls" if k == "all" else k): v for k, v in _CT.items()}
    r = S.control_ladder(s, "f018", specs)
    return rounded(r.select("symbol", "date", "domain", "factor_w", *specs, *[f"{k}_r2" for k in specs]), 5)


LIQ = f"""
lq0 AS (SELECT symbol, date, domain, exchange, ret, {_F018} AS f018, round((1 - {pct('style2', DD)} + {pct('ask5', DD)} + {pct('buy5', DD)} + {pct('n_obs', DD)})/4, 12) AS liquidity_score FROM study),
lq AS (SELECT *, CASE floor(3.0*(row_number() OVER (PARTITION BY date, domain ORDER BY liquidity_score, symbol)-1)/count(*) OVER (PARTITION BY date, domain)) WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS liquidity_state FROM lq0)"""


def _liq(spark, sf, whole=None):
    whole = E.fits(study(spark, sf)) if whole is None else whole
    s = study(spark, sf).select("symbol", "date", "domain", "exchange", "ret", F.round(S.opponent_pressure(), 12).alias("f018"), "style2", "ask5", "buy5", "n_obs")
    return S.liquidity_scores(s, "style2", "ask5", "buy5", "n_obs", whole).drop("style2", "ask5", "buy5", "n_obs")


@query("x29_liquidity_states", sql(STUDY, LIQ, fin("SELECT * FROM lq", "f018 liquidity_score ret", 8)))
def x29(spark, sf):
    return rounded(_liq(spark, sf), 8)


@query("x29_liquidity_performance", sql(STUDY, LIQ, *[_scoped(f"(SELECT * FROM lq WHERE liquidity_state='{s}')", ["f018"], ["ret"], 8, s) for s in ("low", "mid", "high")],
    _scoped("lq", ["f018"], ["ret"], 8, "all"),
    fin("SELECT 'low' AS liquidity_state, * FROM evlow UNION ALL SELECT 'mid', * FROM evmid UNION ALL SELECT 'high', * FROM evhigh UNION ALL SELECT 'all', * FROM evall", "rank_ic d10_d1")))
def x29b(spark, sf):
    whole = E.fits(study(spark, sf))
    rows = _liq(spark, sf, whole)
    return rounded(E.evaluate(rows if whole else stage(rows, "liq"), ["f018"], ["ret"], 8, whole, split="liquidity_state"))


_HG = "least(1, greatest(0, (q-1.0::DOUBLE/3)/(1-1.0::DOUBLE/3)))"


@query("x30_liquidity_composites", sql(STUDY, LIQ, f"c0 AS (SELECT symbol, date, domain, 2*({pct('f018', DD)})-1 AS b, {pct('liquidity_score', DD)} AS q FROM lq)",
    f"c1 AS (SELECT *, {_HG} AS h FROM c0)",
    fin("""SELECT symbol, date, domain, q AS liquidity_rank, b AS base_rank, b*q AS composite, b*q*q AS composite_square, b*(0.25+0.75*q) AS composite_floor25, h AS hinge_weight,
       h*h*(3-2*h) AS smoothstep_weight, b*h AS composite_hinge, b*h*h*(3-2*h) AS composite_smoothstep FROM c1""",
       "liquidity_rank base_rank composite composite_square composite_floor25 hinge_weight smoothstep_weight composite_hinge composite_smoothstep")))
def x30(spark, sf):
    r = S.liquidity_composites(stage(_liq(spark, sf), "liq"))
    return rounded(r.drop("exchange", "ret", "f018", "liquidity_score", "liquidity_state"))


CAPI = f"""
ca AS (SELECT symbol, date, domain, ret, flow5, round(ln(CASE WHEN flow5>=0 THEN ask5/ask30 ELSE bid5/bid30 END), 12) AS capacity FROM study),
cb AS (SELECT *, 2*({pct('flow5', DD)})-1 AS flow_rank, 2*({pct('capacity', DD)})-1 AS capacity_rank FROM ca),
cc AS (SELECT *, flow5*capacity AS flow_x_capacity, flow_rank*capacity_rank AS rank_product, CASE WHEN capacity_rank<=-1.0::DOUBLE/3 THEN 'low' WHEN capacity_rank>=1.0::DOUBLE/3 THEN 'high' ELSE 'mid' END AS capacity_state,
  -flow_rank*capacity_rank AS soft_switch, CASE WHEN capacity_rank<=-1.0::DOUBLE/3 THEN flow_rank WHEN capacity_rank>=1.0::DOUBLE/3 THEN -flow_rank ELSE 0 END AS hard_switch FROM cb),
""" + residual("cd", "cc", DD, {"incremental": "rank_product"}, ["flow_rank", "capacity_rank"])


def _cap(spark, sf):
    return S.capacity_interaction(study(spark, sf).select("symbol", "date", "domain", "ret", "flow5", "ask5", "ask30", "bid5", "bid30")).drop("ask5", "ask30", "bid5", "bid30")


@query("x31_x32_capacity_interaction", sql(STUDY, CAPI, fin("SELECT * FROM cd", "ret flow5 capacity flow_rank capacity_rank flow_x_capacity rank_product soft_switch hard_switch incremental")))
def x31(spark, sf):
    return rounded(_cap(spark, sf))


@query("x31_daily_slope", sql(STUDY, CAPI, residual("ce", "(SELECT symbol, date, domain, ret, rank_product, flow_rank, capacity_rank FROM cd)", D, {"x": "rank_product", "y": "ret"}, ["flow_rank", "capacity_rank"]),
    fin("SELECT date, count(*) AS n, sum(x*y)/sum(x*x) AS slope FROM ce GROUP BY 1 HAVING sum(x*x)>1e-10", "slope")))
def x31b(spark, sf):
    return rounded(S.daily_slope(stage(_cap(spark, sf), "cap"), ["date"], "rank_product", "ret", ["flow_rank", "capacity_rank"]).filter(F.col("slope").isNotNull()))


@query("x33_side_symmetry", sql(STUDY, f"fx AS (SELECT *, {_F018} AS side_score FROM study)",
    _scoped("(SELECT * FROM fx WHERE flow5>0)", ["side_score"], ["ret"], 10, "b"), _scoped("(SELECT * FROM fx WHERE flow5<0)", ["side_score"], ["ret"], 10, "s"),
    fin("""SELECT b.scope, b.scope_key, b.date, b.n AS buy_n, b.rank_ic AS buy_rank_ic, b.d10_d1 AS buy_d10_d1, s.n AS sell_n, s.rank_ic AS sell_rank_ic, s.d10_d1 AS sell_d10_d1,
      b.rank_ic-s.rank_ic AS rank_ic_buy_minus_sell, b.d10_d1-s.d10_d1 AS d10_d1_buy_minus_sell FROM evb b JOIN evs s ON b.scope=s.scope AND b.scope_key=s.scope_key AND b.date=s.date""",
      "buy_rank_ic buy_d10_d1 sell_rank_ic sell_d10_d1 rank_ic_buy_minus_sell d10_d1_buy_minus_sell")))
def x33(spark, sf):
    return rounded(S.side_symmetry(study(spark, sf), "ret", 10))


_LIM = {"signal_close_at_up": "style5=1", "signal_close_at_down": "style5=2", "entry_close_at_up": "style5=3", "entry_close_at_down": "style5=4", "entry_locked_up": "style5=5",
        "entry_locked_down": "style5=6", "exit_locked_up": "style5=7", "exit_locked_down": "style5=8", "post_entry_touch_up": "style5 IN (3,9)", "post_entry_touch_down": "style5=10"}
_SMP = {"all": "true", "entry_off_limit": "NOT (entry_close_at_up OR entry_close_at_down)",
        "signal_and_entry_off_limit": "NOT (entry_close_at_up OR entry_close_at_down OR signal_close_at_up OR signal_close_at_down)",
        "entry_not_locked": "NOT (entry_locked_up OR entry_locked_down)",
        "entry_off_limit_exit_not_locked": "NOT (entry_close_at_up OR entry_close_at_down OR exit_locked_up OR exit_locked_down)",
        "entry_off_limit_no_post_touch": "NOT (entry_close_at_up OR entry_close_at_down OR post_entry_touch_up OR post_entry_touch_down)",
        "entry_at_limit_diagnostic": "entry_close_at_up OR entry_close_at_down", "post_entry_touch_diagnostic": "post_entry_touch_up OR post_entry_touch_down"}


@query("x34_p16_executability_samples", sql(STUDY, "lm AS (SELECT *, " + ", ".join(f"({e}) AS {n}" for n, e in _LIM.items()) + " FROM study)",
    "sm AS (" + " UNION ALL ".join(f"SELECT '{s}' AS sample, date, factor, ret FROM lm WHERE {c}" for s, c in _SMP.items()) + ")",
    f"rk AS (SELECT *, {avg_rank('factor', 'sample, date')} AS a, {avg_rank('ret', 'sample, date')} AS b FROM sm)",
    fin("SELECT sample, date, count(*) AS n, CASE WHEN count(*)>=3 AND stddev_pop(a)>0 AND stddev_pop(b)>0 THEN corr(a,b) END AS rank_ic FROM rk GROUP BY 1,2", "rank_ic")))
def x34(spark, sf):
    s = study(spark, sf).withColumns({n: F.expr(e) for n, e in _LIM.items()})
    return rounded(C.rank_ic(S.by_sample(s, S.executable_samples()), ["sample", "date"], "factor", "ret", "rank_ic"))


_LEND = "bal AS (SELECT symbol, date, (style5-15)::DOUBLE AS balance FROM panel WHERE style5<5 OR style5>25)"


@query("x35_j19_lending_proxy", sql(STUDY, _LEND, """SELECT s.symbol, s.date, (count(b.date)>0)::INTEGER AS ever_prior,
    coalesce(max((b.balance>0 AND strptime(b.date::VARCHAR,'%Y%m%d') >= strptime(s.date::VARCHAR,'%Y%m%d') - INTERVAL 60 DAY)::INTEGER),0) AS positive_60d_prior
    FROM study s LEFT JOIN bal b ON b.symbol=s.symbol AND b.date<s.date GROUP BY 1,2"""))
def x35(spark, sf):
    bal = panel(spark, sf).filter((F.col("style5") < 5) | (F.col("style5") > 25)).select("symbol", "date", (F.col("style5") - 15).alias("balance"))
    return S.lending_proxy(study(spark, sf), bal)


@query("x35_proxy_interaction", sql(STUDY, f"pr AS (SELECT date, domain, symbol, ret, (style5>15)::INTEGER AS px, 2*({pct('factor', DD)})-1 AS x0, count(*) OVER (PARTITION BY date, domain) AS n_ FROM study)",
    "pv AS (SELECT date, x0, px-avg(px) OVER g AS x1, x0*px-avg(x0*px) OVER g AS x2, ret-avg(ret) OVER g AS y FROM pr WHERE n_>=15 WINDOW g AS (PARTITION BY date, domain))",
    residual("q0", "(SELECT * FROM pv)", D, {"dummy": "y"}, []),
    "sm AS (SELECT date, count(*) AS n, sum(x0*x0) a, sum(x0*x1) b, sum(x0*x2) c, sum(x1*x1) d, sum(x1*x2) e, sum(x2*x2) f, sum(x0*y) p, sum(x1*y) q, sum(x2*y) r FROM pv GROUP BY 1)",
    # Elimination without pivoting: the matrix is positive definite.
    "el AS (SELECT *, d-b*b/a AS d1, e-b*c/a AS e1, f-c*c/a AS f1, q-b*p/a AS q1, r-c*p/a AS r1 FROM sm WHERE n>=30)",
    "sl AS (SELECT *, (r1-e1*q1/d1)/(f1-e1*e1/d1) AS z FROM el)",
    fin("SELECT date, n, (p-b*(q1-e1*z)/d1-c*z)/a AS factor_slope, (q1-e1*z)/d1 AS proxy_level, z AS factor_x_proxy FROM sl", "factor_slope proxy_level factor_x_proxy")))
def x35b(spark, sf):
    s = study(spark, sf).select("symbol", "date", "domain", "factor", "ret", (F.col("style5") > 15).cast("int").alias("px"))
    return rounded(S.proxy_interaction(s, "factor", "px", "ret"))


_SUM = [_scoped("study", ["flow1", "flow5", "book5"], ["ret", "ret30"], 15)]


@query("x36_direct_target_summary", sql(STUDY, *_SUM, fin(_summary(), SUM_D)))
def x36(spark, sf):
    return rounded(E.summarise(E.evaluate(study(spark, sf), ["flow1", "flow5", "book5"], ["ret", "ret30"], 15)))


# One row of settings per evaluation study: factor, target, styles, smallest group.
PRESETS = {
    "impact": ("factor", "ret", ST[:3], 20), "joint_gap": ("factor2", "ret", ST[:2], 15),
    "behavior_daily": ("vr", "ret", ST, 20), "behavior_intraday": ("vr", "ret30", ST[:2], 15), "active_take": ("flow", "ret30", ST[2:4], 15),
}


def _preset_sql() -> tuple[list[str], str]:
    parts, outs = [], []
    for name, (f, t, st, m) in PRESETS.items():
        parts.append(residual(f"n_{name}", "study", D, {f"neutral_{name}": f}, st))
        parts.append(f"nr_{name} AS (SELECT * REPLACE (round(neutral_{name},10) AS neutral_{name}) FROM n_{name})")
        parts.append(_scoped(f"nr_{name}", [f, f"neutral_{name}"], [t], m, f"_{name}"))
        outs.append(f"SELECT '{name}' AS study, * FROM ({_summary(f'ev_{name}')})")
    return parts, " UNION ALL ".join(outs)


_PP, _PO = _preset_sql()


@query("x37_study_presets", sql(STUDY, *_PP, fin(_PO, SUM_D, 5)))
def x37(spark, sf):
    base = study(spark, sf)
    out, whole = None, E.fits(base)
    for name, (f, t, st, m) in PRESETS.items():
        n = E.neutralise(base, f, st, "market", f"neutral_{name}").withColumn(f"neutral_{name}", F.round(f"neutral_{name}", 10))
        part = E.summarise(E.evaluate(n, [f, f"neutral_{name}"], [t], m, whole)).withColumn("study", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


_NP = ["symbol", "date", "domain", "active_buy_volume", "active_sell_volume", "active_count", "near_cancel_buy", "near_cancel_sell", "bid_depth3", "ask_depth3", "pred_fill_buy", "pred_fill_sell", "book_imbalance3", "spread_bps", "fill_history_buy", "fill_history_sell"]
_NPD = ("m1 np01_execution_pressure np02_fillability np02_logit_fillability np03_confirmation np05_cancel_intensity np05_abs_cancel_imbalance np05_signed_cancel_imbalance np05_buy_cancel_shock np05_sell_cancel_shock "
        "np01_m1_linear np01_m1_cubic np02_activity_residual np04_flow_minus_book")
NPSQL = [f"""
np0 AS (SELECT symbol, date, domain, (active_buy_volume-active_sell_volume)/(active_buy_volume+active_sell_volume) AS m1, pred_fill_sell-pred_fill_buy AS np01_execution_pressure,
  (pred_fill_buy+pred_fill_sell)/2 AS np02_fillability, (ln(pred_fill_buy/(1-pred_fill_buy))+ln(pred_fill_sell/(1-pred_fill_sell)))/2 AS np02_logit_fillability,
  (near_cancel_buy+near_cancel_sell)/(bid_depth3+ask_depth3+1e-12) AS np05_cancel_intensity, abs(near_cancel_sell-near_cancel_buy)/(near_cancel_buy+near_cancel_sell+1e-12) AS np05_abs_cancel_imbalance,
  (near_cancel_sell-near_cancel_buy)/(near_cancel_buy+near_cancel_sell+1e-12) AS np05_signed_cancel_imbalance, near_cancel_buy/(bid_depth3+1e-12) AS np05_buy_cancel_shock, near_cancel_sell/(ask_depth3+1e-12) AS np05_sell_cancel_shock,
  ln(1+active_buy_volume+active_sell_volume) AS lv, ln(1+active_count) AS lc, ln(1+bid_depth3+ask_depth3) AS ld, ln(1+fill_history_buy) AS hb, ln(1+fill_history_sell) AS hs, spread_bps, book_imbalance3 AS bk, count(*) OVER (PARTITION BY date, domain) AS slice_n FROM study),
np1 AS (SELECT *, m1*np01_execution_pressure AS np03_confirmation, m1*m1 AS m2, m1*m1*m1 AS m3, bk*bk AS b2, bk*bk*bk AS b3, abs(m1) AS am, abs(np01_execution_pressure) AS ae, abs(bk) AS ab FROM np0 WHERE slice_n>=15),
np2 AS (SELECT *, quantile_cont(am, {1 / 3}) OVER g AS mlo, quantile_cont(am, {2 / 3}) OVER g AS mhi, quantile_cont(ae, {1 / 3}) OVER g AS elo, quantile_cont(ae, {2 / 3}) OVER g AS ehi, quantile_cont(ab, {2 / 3}) OVER g AS bhi FROM np1 WINDOW g AS (PARTITION BY date, domain))""",
    residual("l1", "np2", DD, {"np01_m1_linear": "np01_execution_pressure"}, ["m1"]), residual("l2", "l1", DD, {"np01_m1_cubic": "np01_execution_pressure"}, ["m1", "m2", "m3"]),
    residual("l3", "l2", DD, {"np02_activity_residual": "np02_fillability"}, ["lv", "lc", "hb", "hs", "spread_bps", "ld"]), residual("l4", "l3", DD, {"np04_flow_minus_book": "m1"}, ["bk", "b2", "b3"])]


@query("f38_fill_pressure_candidates", sql(STUDY, *NPSQL, fin(f"""SELECT symbol, date, domain, slice_n, {_NPD.replace(' ', ', ')},
   CASE WHEN am>=mhi AND ae>=ehi AND m1*np01_execution_pressure>0 THEN 'both_strong_same' WHEN am<=mlo AND ae>=ehi THEN 'm1_weak_ep_strong' WHEN am>=mhi AND m1*np01_execution_pressure<0 THEN 'm1_strong_ep_opposite'
     WHEN am<=mlo AND ae<=elo THEN 'both_weak' ELSE 'other' END AS np03_state,
   CASE WHEN am<mhi OR ab<bhi THEN 'other' ELSE 'active_' || CASE WHEN m1>0 THEN 'buy' ELSE 'sell' END || '_book_' || CASE WHEN bk>0 THEN 'buy' ELSE 'sell' END END AS np04_state FROM l4""", _NPD, 5)))
def f38(spark, sf):
    r = S.fill_pressure_candidates(study(spark, sf).select(*_NP))
    return rounded(r.drop(*_NP[3:]), 5)


_HS = f"""hs AS (SELECT symbol, date, {pct('factor', D, 'pos')} AS sp FROM study)"""


@query("w26_hysteresis", sql(STUDY, _HS, "k AS (SELECT *, sum((sp<0.7)::INTEGER) OVER (PARTITION BY symbol ORDER BY date) AS isl FROM hs)",
    "SELECT symbol, date, sp>=0.7 AND max((sp>=0.9)::INTEGER) OVER (PARTITION BY symbol, isl ORDER BY date)=1 AS held FROM k"))
def w26(spark, sf):
    r = C.percentile_rank(study(spark, sf).select("symbol", "date", "factor"), ["date"], "factor", mode="pos", out="sp")
    return H.hysteresis(r, ["symbol"], F.col("sp") >= 0.9, F.col("sp") >= 0.7).select("symbol", "date", "held")


@query("x14_dimension_filter", sql(STUDY, "l AS (SELECT symbol, date, 'daily' AS window_name, 1 AS horizon, factor AS value FROM study UNION ALL SELECT symbol, date, 'intraday', 5, factor2 FROM study)",
    "SELECT symbol, date, value FROM l WHERE window_name='intraday' AND horizon=5"))
def x14(spark, sf):
    dims = F.explode(F.array(
        F.struct(F.lit("daily").alias("window_name"), F.lit(1).alias("horizon"), F.col("factor").alias("value")),
        F.struct(F.lit("intraday").alias("window_name"), F.lit(5).alias("horizon"), F.col("factor2").alias("value"))))
    long = study(spark, sf).withColumn("_d", dims).select("symbol", "date", "_d.*")
    return long.filter((F.col("window_name") == "intraday") & (F.col("horizon") == 5)).select("symbol", "date", "value")


