"""Queries of the mechanism study on both clocks, and its contrast tables."""

from __future__ import annotations

from lobloom.catalog.mechanism_queries import (
    _DROWS, _LH, _MK, _OROWS, _PPR, _QROWS, _TH2, HL, MB, MC, MH, MI, MINIMUM, MO, MP, MPP, MQ, TH, V, WARM, WINDOW, _mom, _run)
from lobloom.catalog.registry import query, rounded
from lobloom.catalog.sqlgen import fin
from lobloom.catalog.views import sql
from lobloom.plans import contrasts as C
from lobloom.plans import mechanism as M
from lobloom.session import stage
from lobloom.sources.derived import lob

WINDOWS = (300, 600, 1200)
HLP, THP = f"hl{HL}", f"teh{TH}"

# Twins: positions are dense, so what follows a trade is a join at seq + h, one row per horizon.
MLT = f"""pww AS (SELECT *, unnest({list(WINDOWS)}) AS w FROM pv),
pwr AS (SELECT b.*, ln(b.mid/t.mid) AS ret FROM (SELECT *, ms-w*1000 AS bk FROM pww) b ASOF LEFT JOIN pt t ON t.symbol=b.symbol AND t.date=b.date AND t.session=b.session AND b.bk>=t.ms),
pws AS (SELECT symbol, bucket, w, CASE WHEN count(ret)>={MINIMUM} THEN stddev_pop(ret) END AS sg FROM pwr WHERE date<{WARM} AND (seq-1)%10=0 GROUP BY 1,2,3),
pwt AS (SELECT pwr.symbol, row_id, w, CASE WHEN ret IS NULL OR coalesce(sg,0)<=0 OR pc IS NULL THEN 'unknown' WHEN ret>1.5*sg AND mid>greatest(om,pc) THEN 'up' WHEN ret<-1.5*sg AND mid<least(om,pc) THEN 'down' ELSE 'normal' END AS ps
  FROM pwr LEFT JOIN pws USING (symbol, bucket, w) LEFT JOIN pdy ON pdy.symbol=pwr.symbol AND pdy.date=pwr.date WHERE pwr.date>={WARM}),
lb AS (SELECT *, hl_b+hl_s AS heat, te_b+te_s AS theat, sum(CASE WHEN trd THEN CASE source_side WHEN 'B' THEN source_volume WHEN 'S' THEN -source_volume END END) OVER u AS net,
  sum(CASE WHEN trd THEN CASE source_side WHEN 'B' THEN 1 WHEN 'S' THEN -1 END END) OVER u AS cnt FROM mst WINDOW u AS (PARTITION BY symbol, date, session ORDER BY row_id)),
lg AS (SELECT a.symbol, a.date, a.row_id, a.source_side AS side, a.st, a.tst, a.h, CASE WHEN a.source_side='B' THEN 1 ELSE -1 END*(f.net-a.net) AS fv, CASE WHEN a.source_side='B' THEN 1 ELSE -1 END*(f.cnt-a.cnt) AS fc, f.heat-a.heat AS dh, f.theat-a.theat AS dth
  FROM (SELECT *, unnest({list(M.HORIZONS)}) AS h FROM lb WHERE trd AND st IS NOT NULL) a JOIN lb f ON f.symbol=a.symbol AND f.date=a.date AND f.session=a.session AND f.seq=a.seq+a.h),
lgp AS (SELECT lg.*, coalesce(price_state,'unknown') AS pr FROM lg LEFT JOIN pst ON pst.symbol=lg.symbol AND pst.row_id=lg.row_id)"""
_G = "'trigger=' || side || '|state=' || {s}"


def _clock(p: str, st: str, d: str) -> list[str]:
    g, on = _G.format(s=st), f"FROM lgp WHERE {st} IS NOT NULL"
    return [
        f"SELECT symbol, date, 'M1' AS mechanism, '{p}n' || h || '_future_signed_volume' AS variant, {g} AS group_key, fv::DOUBLE AS v {on}",
        f"SELECT symbol, date, 'M1', '{p}n' || h || '_future_signed_count', {g}, fc::DOUBLE {on}",
        f"SELECT symbol, date, 'M2', '{p}n' || h || '_delta_heat', 'price=' || pr || '|' || {g}, {d} {on}",
        f"SELECT symbol, date, 'M3', '{p}n' || h || '_delta_heat', CASE WHEN pr='up' THEN 'buy_up' ELSE 'buy_non_up' END, {d} {on} AND side='B'"]


_L2 = " UNION ALL ".join([
    *_clock("", "st", "dh"), *_clock(f"{THP}_", "tst", "dth"),
    "SELECT symbol, date, 'M3', 'n' || h || '_positive_heat', unnest(CASE WHEN pr='up' AND side='B' THEN ['all','up_buy'] ELSE ['all'] END), CASE WHEN dh IS NOT NULL THEN greatest(dh,0) END FROM lgp",
    f"SELECT lg.symbol, date, 'M2', 'w' || x.w || '_k1.5_n' || h || '_delta_heat', 'price=' || coalesce(ps,'unknown') || '|' || {_G.format(s='st')}, dh FROM lg CROSS JOIN (SELECT unnest({list(WINDOWS)}) AS w) x LEFT JOIN pwt ON pwt.symbol=lg.symbol AND pwt.row_id=lg.row_id AND pwt.w=x.w"])


def _labels(spark, sf):
    r = _run(spark, sf)
    windows = M.price_window_states(r["rows"], WARM, WINDOWS, minimum=MINIMUM)
    return r, M.trigger_labels(r["states"], r["prices"], HLP, trade_profile=THP, price_windows=windows)


@query("f23_labels_both_clocks", sql(V, MB, MI, MC, MP, MLT, _mom(_L2)))
def f23(spark, sf):
    return rounded(_labels(spark, sf)[1], 4)


M5T = MH + """,
d6 AS (SELECT symbol, date, n, s2, avg(ln(1+b3+a3)) AS v FROM (
  SELECT symbol, date, n, unnest([z,'all']) AS s2, b3, a3 FROM (
    SELECT symbol, date, p.bid3 AS b3, p.ask3 AS a3, unnest([{'n':'','z':st},{'n':'%s_','z':tst}], recursive := true) FROM mst WHERE (seq-1)%%10=0 AND p IS NOT NULL) WHERE z IS NOT NULL AND b3 IS NOT NULL AND a3 IS NOT NULL) GROUP BY 1,2,3,4)""" % THP
_D6 = """ UNION ALL SELECT symbol, date, 'M5', n || 'mean_log_total_depth3', 'heat=' || hg || '|state=' || s2, v FROM d6 JOIN hh USING (symbol, date)
 UNION ALL SELECT symbol, date, 'M5', 'daily_active_volume', 'heat=' || hg, dh FROM hh"""


def _depth(r):
    return M.depth_stats(r["states"], [HLP, THP], HLP, r["heat"], trade_profile=THP)


@query("f24_depth_both_clocks", sql(V, MB, MI, MC, M5T, _mom(_DROWS + _D6)))
def f24(spark, sf):
    return rounded(_depth(_run(spark, sf, False)), 4)


# The outcomes of one order, grouped once by the state of either clock.
MO2 = MO.replace("ox AS (SELECT", "oy AS (SELECT", 1) + f""",
ot AS (SELECT oa.symbol, oa.date, 'side=' || source_side || '|state=' || coalesce(tst,'unknown') || '|distance=' || ds AS g, source_volume, v10, v60, v300, vall, cn FROM oa JOIN of_ ON of_.symbol=oa.symbol AND of_.date=oa.date AND of_.side=source_side AND of_.oid=oa.oid JOIN oc ON oc.symbol=oa.symbol AND oc.date=oa.date AND oc.side=source_side AND oc.oid=oa.oid),
ox AS (SELECT '' AS clock, * FROM oy UNION ALL SELECT '{THP}_', * FROM ot)"""
_O2 = f"SELECT symbol, date, 'M6' AS mechanism, clock || u.n AS variant, g AS group_key, u.x::DOUBLE AS v FROM (SELECT symbol, date, clock, g, unnest([{', '.join(f'''{{'n':'{n}','x':({e})::DOUBLE}}''' for n, e in [('submitted_orders', '1'), ('submitted_volume', 'source_volume'), ('cancel_volume', 'cn')] + [(f'filled_orders_{n}', f'({v}>0)::INTEGER') for n, v in (('10s', 'v10'), ('60s', 'v60'), ('300s', 'v300'), ('continuous', 'vall'))] + [(f'filled_volume_{n}', v) for n, v in (('10s', 'v10'), ('60s', 'v60'), ('300s', 'v300'), ('continuous', 'vall'))])}]) AS u FROM ox)"


def _outcomes(r):
    return M.passive_outcomes(r["states"], HLP, trade_profile=THP)


@query("f25_outcomes_both_clocks", sql(V, MB, MI, MC, MO2, _mom(_O2)))
def f25(spark, sf):
    return rounded(_outcomes(_run(spark, sf, False)), 4)


# ---------------------------------------------------------------- contrast tables

_OUT = "left_mean right_mean difference difference_t ci95_lower ci95_upper symbol_mean_difference symbol_t date_mean_difference date_t"


def _text(v) -> str:
    return "NULL" if v is None else "'" + v + "'"


def _se(v: str) -> str:
    return f"CASE WHEN count({v})>1 THEN CASE WHEN max({v})=min({v}) THEN 0.0 ELSE stddev_samp({v})/sqrt(count({v})) END END"


def _t(v: str) -> str:
    return f"CASE WHEN count({v})>1 THEN CASE WHEN max({v})=min({v}) THEN 0.0 ELSE avg({v})/(stddev_samp({v})/sqrt(count({v}))) END END"


def _contrast_sql(rows: str, contrasts, within: bool = False) -> tuple[str, str]:
    defs = ", ".join(
        "(" + ", ".join([_text(k.mechanism), _text(k.name), _text(k.left.label), _text(k.right.label), _text(side), _text(leg.variant), _text(leg.exact),
                         "[" + ", ".join(map(_text, leg.parts)) + "]::VARCHAR[]"]) + ")"
        for k in contrasts for side, leg in (("l", k.left), ("r", k.right)))
    unit = "symbol" if within else "symbol, date"
    by = "domain, mechanism, contrast, left_group, right_group"
    means = (f"SELECT *, stock_days AS symbols, difference AS symbol_mean_difference, difference_t AS symbol_t, NULL::BIGINT AS dates, NULL::DOUBLE AS date_mean_difference, NULL::DOUBLE AS date_t FROM ct"
             if within else f"SELECT ct.*, s.n AS symbols, s.m AS symbol_mean_difference, s.t AS symbol_t, d.n AS dates, d.m AS date_mean_difference, d.t AS date_t FROM ct JOIN cs s USING ({by}) JOIN cd d USING ({by})")
    per = lambda u: (f"SELECT {by}, count(x) AS n, avg(x) AS m, {_t('x')} AS t FROM (SELECT {by}, {u}, avg(df) AS x FROM cu GROUP BY ALL) GROUP BY ALL")
    cu_units = "" if within else f", cs AS ({per('symbol')}), cd AS ({per('date')})"
    ctes = f"""ms0 AS (SELECT {_MK}, sum(v) AS value_sum, count(*)::DOUBLE AS weight_sum FROM ({rows}) WHERE v IS NOT NULL GROUP BY ALL),
mdom AS (SELECT unnest(['all/all', 'start/' || left(symbol,1)]) AS domain, * FROM ms0),
def AS (SELECT * FROM (VALUES {defs}) t(mechanism, contrast, left_group, right_group, leg, variant, exact, parts)),
cl AS (SELECT {by}, leg, symbol, date, sum(value_sum)/sum(weight_sum) AS v FROM mdom JOIN def USING (mechanism, variant) WHERE coalesce(exact=group_key, len(list_filter(parts, lambda p: NOT contains(group_key, p)))=0) GROUP BY ALL),
cu AS (SELECT {by}, {unit}, avg(v) FILTER (leg='l') AS lv, avg(v) FILTER (leg='r') AS rv, avg(v) FILTER (leg='l')-avg(v) FILTER (leg='r') AS df FROM cl GROUP BY ALL),
ct AS (SELECT {by}, count(df) AS stock_days, avg(lv) FILTER (df IS NOT NULL) AS left_mean, avg(rv) FILTER (df IS NOT NULL) AS right_mean, avg(df) AS difference, {_t('df')} AS difference_t, avg(df)-1.96*({_se('df')}) AS ci95_lower, avg(df)+1.96*({_se('df')}) AS ci95_upper FROM cu GROUP BY ALL){cu_units},
cx AS ({means})"""
    return ctes, fin("SELECT * FROM cx", _OUT, 4)


def _domains(stats):
    """A domain table of (symbol, date), here by the first sign of the symbol."""
    days = stats.select("symbol", "date").distinct()
    return M.with_domains(stats, days.selectExpr("symbol", "date", "concat('start/', left(symbol, 1)) AS domain"))


def _values(stats, contrasts):
    # A domain is a set of stock-days, so a stock-day's legs are the same in each of its domains.
    legs = C.leg_values(M.with_domains(stage(stats, "mech-stats")), contrasts)
    return stage(_domains(legs.drop("domain")), "contrast-legs")


STATE = C.state_contrasts(10, HLP, THP)
HEAT = C.heat_contrasts(THP)
QUOTE = C.quote_contrasts(_LH, _TH2)
PREPOST = C.prepost_contrasts(_LH, _TH2)


@query("f42_state_contrasts", sql(V, MB, MI, MC, MP, MLT, MO2, *_contrast_sql(_L2 + " UNION ALL " + _DROWS + " UNION ALL " + _O2, STATE)))
def f42_state(spark, sf):
    r, labels = _labels(spark, sf)
    depth = M.depth_stats(r["states"], [HLP, THP], HLP, r["heat"])
    stats = labels.unionByName(depth.filter("mechanism = 'M4'")).unionByName(_outcomes(r))
    return rounded(C.paired(_values(stats, STATE), STATE), 4)


@query("f42_heat_contrasts", sql(V, MB, MI, MC, M5T, *_contrast_sql(_D6.strip().removeprefix("UNION ALL ").replace("'M5', n || 'mean_log_total_depth3', 'heat=' || hg || '|state=' || s2, v",
       "'M5' AS mechanism, n || 'mean_log_total_depth3' AS variant, 'heat=' || hg || '|state=' || s2 AS group_key, v"), HEAT, within=True)))
def f42_heat(spark, sf):
    return rounded(C.within_symbol(_values(_depth(_run(spark, sf, False)), HEAT), HEAT), 4)


@query("f42_quote_contrasts", sql(V, MB, MQ, *_contrast_sql(_QROWS, QUOTE)))
def f42_quote(spark, sf):
    return rounded(C.paired(_values(M.trigger_responses(lob(spark, sf), _LH, _TH2), QUOTE), QUOTE), 4)


@query("f42_prepost_contrasts", sql(V, MB, MPP, *_contrast_sql(_PPR, PREPOST)))
def f42_prepost(spark, sf):
    return rounded(C.paired(_values(M.pre_post_flow(lob(spark, sf), _LH, _TH2), PREPOST), PREPOST), 4)
