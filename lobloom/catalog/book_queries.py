"""Queries over the event table: book paths, chains, quotes and order state."""

from __future__ import annotations


from lobloom.catalog.registry import query, rounded
from lobloom.catalog.sqlgen import fin
from lobloom.catalog.views import lob_views, sql
from lobloom.plans import order_state as O
from lobloom.plans import primitives as P
from lobloom.plans import window_path as W
from lobloom.session import stage
from lobloom.sources.derived import lob

V = lob_views()
DEP = ["bid1", "bid3", "bid10", "ask1", "ask3", "ask10"]


def _dep(side: str, k: int) -> str:
    return f"CASE WHEN len({side}_vol)>={k} THEN list_sum({side}_vol[1:{k}]) END"


PR = "pr AS (SELECT *, coalesce(b1>0 AND a1>b1 AND bid1 IS NOT NULL AND bid10 IS NOT NULL AND ask10 IS NOT NULL, false) AS ok FROM (SELECT *, " + ", ".join(
    f"{_dep(s, k)} AS {s}{k}" for s in ("bid", "ask") for k in (1, 3, 10)) + " FROM sess WHERE session='AM'))"


def _im(k: int, p: str = "") -> str:
    return f"coalesce(({p}bid{k}-{p}ask{k})/nullif({p}bid{k}+{p}ask{k},0)::DOUBLE,0)"


PRN = f"""prn AS (SELECT *, lead(ms) OVER (PARTITION BY symbol, date ORDER BY row_id) AS nms,
  first_value(CASE WHEN ok THEN ms END IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nok FROM pr)"""
_BW = "(VALUES " + ",".join(f"('{n}',{a},{b})" for n, (a, b) in W.BOOK_WINDOWS.items()) + ") bw(win,wa,wb)"
_FW = "(VALUES " + ",".join(f"('{n}',{a},{b})" for n, (a, b) in W.FLOW_WINDOWS.items()) + ") fw(win,wa,wb)"
_TW = ", ".join([f"sum({d}*dt)/sum(dt) AS {d}_twap" for d in DEP])
BP = f"""bi AS (SELECT symbol, date, win, (wb-wa)/1000.0::DOUBLE AS ln_, (least(coalesce(nok,37800000),wb)-greatest(ms,wa))/1000.0::DOUBLE AS dt, {_im(1)} AS bi1, {_im(3)} AS bi3, {_im(10)} AS bi10,
    (a1-b1)/((a1+b1)/2.0::DOUBLE)*10000 AS sp, {', '.join(DEP)} FROM prn JOIN {_BW} ON ok AND least(coalesce(nok,37800000),wb)>greatest(ms,wa)),
bp AS (SELECT *, coalesce((bid1_twap+ask1_twap)/nullif(bid3_twap+ask3_twap,0),0) AS depth1_to_depth3, coalesce((bid3_twap+ask3_twap)/nullif(bid10_twap+ask10_twap,0),0) AS depth3_to_depth10 FROM (
  SELECT symbol, date, win AS "window", sum(dt) AS coverage_seconds, sum(dt)/max(ln_) AS coverage_ratio, sum(bi1*dt)/sum(dt) AS bi1_twap, sum(bi3*dt)/sum(dt) AS bi3_twap, sum(bi10*dt)/sum(dt) AS bi10_twap,
    sqrt(greatest(0, sum(bi3*bi3*dt)/sum(dt) - (sum(bi3*dt)/sum(dt))*(sum(bi3*dt)/sum(dt)))) AS bi3_time_std, sum(sp*dt)/sum(dt) AS spread_bps_twap,
    coalesce(sum(dt) FILTER (bi3>0),0)/sum(dt) AS positive_time_share, coalesce(sum(dt) FILTER (bi3<0),0)/sum(dt) AS negative_time_share, {_TW} FROM bi GROUP BY 1,2,3))"""
_BD = ("coverage_seconds coverage_ratio bi1_twap bi3_twap bi10_twap bi3_time_std spread_bps_twap positive_time_share negative_time_share "
       + " ".join(f"{d}_twap" for d in DEP) + " depth1_to_depth3 depth3_to_depth10")
FP = f"""ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date, source_recid, CASE WHEN source_recid IS NULL THEN row_id END ORDER BY row_id) AS k FROM prn WHERE source_action='TRADE' AND source_volume>0) WHERE k=1),
fp AS (SELECT symbol, date, win AS "window", coalesce(sum(source_volume) FILTER (source_side='B'),0)::BIGINT AS buy_volume, coalesce(sum(source_volume) FILTER (source_side='S'),0)::BIGINT AS sell_volume,
    count(DISTINCT coalesce(oid, -1-coalesce(source_recid,row_id))) FILTER (source_side='B') AS buy_order_count, count(DISTINCT coalesce(oid, -1-coalesce(source_recid,row_id))) FILTER (source_side='S') AS sell_order_count
  FROM ft JOIN {_FW} ON ms>=wa AND ms<wb GROUP BY 1,2,3),
fpx AS (SELECT *, buy_volume+sell_volume AS total_volume, buy_order_count+sell_order_count AS order_count, coalesce((buy_volume-sell_volume)/nullif(buy_volume+sell_volume,0)::DOUBLE,0) AS net_share FROM fp)"""


@query("f30_book_path", sql(V, PR, PRN, BP, fin("SELECT * FROM bp", _BD)))
def f30a(spark, sf):
    return rounded(W.book_path(W.path_rows(lob(spark, sf))))


@query("f30_flow_path", sql(V, PR, PRN, FP, fin("SELECT * FROM fpx", "net_share")))
def f30b(spark, sf):
    return rounded(W.flow_path(W.path_rows(lob(spark, sf))))


RUNS = f"""sg AS (SELECT symbol, date, row_id, sign({_im(3)})::INTEGER AS s, greatest(ms,36000000) AS t FROM prn WHERE ok AND least(coalesce(nok,37800000),37800000)>greatest(ms,36000000) AND bid3<>ask3),
st AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY symbol, date ORDER BY row_id) AS ps FROM sg) WHERE ps IS DISTINCT FROM s),
sd AS (SELECT *, (coalesce(lead(t) OVER (PARTITION BY symbol, date ORDER BY row_id), 37800000)-t)/1000.0::DOUBLE AS d FROM st),
rn AS (SELECT symbol, date, count(*)-1 AS book_sign_flips, coalesce(max(d) FILTER (s>0),0) AS longest_positive_seconds, coalesce(max(d) FILTER (s<0),0) AS longest_negative_seconds FROM sd GROUP BY 1,2)"""


@query("w19_imbalance_runs", sql(V, PR, PRN, RUNS, fin("SELECT * FROM rn", "longest_positive_seconds longest_negative_seconds")))
def w19(spark, sf):
    return rounded(W.imbalance_runs(W.path_rows(lob(spark, sf))))


_MS = (1, 5, 10)
_bf = [x for x in _BD.split()]
_ff = ["buy_volume", "sell_volume", "buy_order_count", "sell_order_count", "total_volume", "order_count", "net_share"]


def _bk(t: int) -> str:
    return f"max_by({{'b':b1,'a':a1,'bd':bid3,'ad':ask3}}, row_id) FILTER (ok AND ms<{t})"


def _bi(s: str) -> str:
    return f"coalesce(({s}.bd-{s}.ad)/nullif({s}.bd+{s}.ad,0)::DOUBLE,0)"


def _sp(s: str) -> str:
    return f"({s}.a-{s}.b)/(({s}.a+{s}.b)/2.0::DOUBLE)*10000"


WP = RUNS + f""",
lat AS (SELECT *, ln(mid/lag(mid) OVER (PARTITION BY symbol, date ORDER BY row_id))**2 AS sq FROM prn WHERE ok AND ms<38400000),
vol AS (SELECT symbol, date, {', '.join(f"sum(sq) FILTER (ms>=37800000 AND ms<{37800000 + m * 60000}) AS v{m}" for m in _MS)} FROM lat GROUP BY 1,2),
base AS (SELECT symbol, date, {_bk(37800000)} AS e, {', '.join(f"{_bk(37800000 + m * 60000)} AS f{m}, count(*) FILTER (ms>=37800000 AND ms<{37800000 + m * 60000}) AS future{m}m_event_count" for m in _MS)},
    coalesce(sum((least(coalesce(nms,37800000),37800000)-ms)/1000.0::DOUBLE) FILTER (ms>=36000000 AND ms<37800000 AND NOT ok),0) AS invalid_chain_seconds FROM prn GROUP BY 1,2),
fw AS (SELECT symbol, date, {', '.join(f"""coalesce(max({f}) FILTER ("window"='{n}'),0) AS {n}_{f}""" for n in W.FLOW_WINDOWS for f in _ff)} FROM fpx GROUP BY 1,2),
bw AS (SELECT symbol, date, {', '.join(f"""max({f}) FILTER ("window"='{n}') AS {n}_{f}""" for n in ('book30m', 'book5m') for f in _bf)},
   {', '.join(f"""max({f}) FILTER ("window"='{n}') AS {n}_{f}""" for n in W.BOOK_WINDOWS if n.startswith('bin') for f in ('bi3_twap', 'spread_bps_twap', 'coverage_ratio'))} FROM bp GROUP BY 1,2),
wpj AS (SELECT * FROM base LEFT JOIN vol USING (symbol,date) LEFT JOIN fw USING (symbol,date) LEFT JOIN bw USING (symbol,date) LEFT JOIN rn USING (symbol,date) WHERE e IS NOT NULL),
wp AS (SELECT symbol, date, 1030 AS signal_time, invalid_chain_seconds, coalesce(book_sign_flips,0) AS book_sign_flips, coalesce(longest_positive_seconds,0) AS longest_positive_seconds, coalesce(longest_negative_seconds,0) AS longest_negative_seconds,
   {', '.join(f"coalesce({n}_{f},0) AS {n}_{f}" for n in W.FLOW_WINDOWS for f in _ff)}, {', '.join(f"coalesce({n}_{f},0) AS {n}_{f}" for n in ('book30m', 'book5m') for f in _bf)},
   {', '.join(f"coalesce({n}_{f},0) AS {n}_{f}" for n in W.BOOK_WINDOWS if n.startswith('bin') for f in ('bi3_twap', 'spread_bps_twap', 'coverage_ratio'))},
   {_bi('e')} AS endpoint_bi3, {_sp('e')} AS endpoint_spread_bps, e.bd::DOUBLE AS endpoint_bid_depth3, e.ad::DOUBLE AS endpoint_ask_depth3,
   {', '.join(f"future{m}m_event_count, {_bi(f'f{m}')} AS future{m}m_end_bi3, {_sp(f'f{m}')} AS future{m}m_end_spread_bps, sqrt(coalesce(v{m},0))*10000 AS future{m}m_realized_vol_bps" for m in _MS)},
   coalesce(book5m_bi3_twap,0)-coalesce(book30m_bi3_twap,0) AS book_shift_5m_minus_30m, coalesce(flow5m_net_share,0)-coalesce(flow30m_net_share,0) AS flow_shift_5m_minus_30m, {_bi('e')}-coalesce(book5m_bi3_twap,0) AS endpoint_minus_book5m FROM wpj)"""
_WPD = " ".join(
    ["invalid_chain_seconds longest_positive_seconds longest_negative_seconds endpoint_bi3 endpoint_spread_bps endpoint_bid_depth3 endpoint_ask_depth3 book_shift_5m_minus_30m flow_shift_5m_minus_30m endpoint_minus_book5m"]
    + [f"{n}_net_share" for n in W.FLOW_WINDOWS] + [f"{n}_{f}" for n in ("book30m", "book5m") for f in _bf]
    + [f"{n}_{f}" for n in W.BOOK_WINDOWS if n.startswith("bin") for f in ("bi3_twap", "spread_bps_twap", "coverage_ratio")]
    + [f"future{m}m_{x}" for m in _MS for x in ("end_bi3", "end_spread_bps", "realized_vol_bps")])


@query("f30_window_path", sql(V, PR, PRN, BP, FP, WP, fin("SELECT * FROM wp", _WPD)))
def f30(spark, sf):
    return rounded(W.window_path(lob(spark, sf)))


_NEST = " OR ".join(f"NOT (flow1m_{s}_volume<=flow5m_{s}_volume AND flow5m_{s}_volume<=flow30m_{s}_volume)" for s in ("buy", "sell"))
_TARGETS = " OR ".join(f"NOT (future1m_{s}<=future5m_{s} AND future5m_{s}<=future10m_{s})" for s in ("buy_volume", "sell_volume", "event_count"))
_CHECKS = {
    "bad_signal_time": "signal_time<>1030", "sz_rows": "starts_with(symbol, 'SZ')", "sh_rows": "starts_with(symbol, 'SH')",
    "incomplete_5m_coverage": "book5m_coverage_ratio<0.999999", "incomplete_30m_coverage": "book30m_coverage_ratio<0.999999",
    "bad_coverage": "book30m_coverage_ratio NOT BETWEEN 0 AND 1.000001 OR book5m_coverage_ratio NOT BETWEEN 0 AND 1.000001",
    "bad_invalid_seconds": "invalid_chain_seconds NOT BETWEEN 0 AND 1800.001", "bad_signal_nesting": _NEST, "bad_target_nesting": _TARGETS}


@query("f41_output_quality", sql(V, PR, PRN, BP, FP, WP, f"""SELECT (SELECT count(*) FROM wp) AS rows, (SELECT count(DISTINCT symbol) FROM wp) AS symbols, (SELECT count(DISTINCT date) FROM wp) AS dates, (SELECT min(date) FROM wp) AS min_date, (SELECT max(date) FROM wp) AS max_date,
   {', '.join(f"(SELECT count(*) FROM wp WHERE {w})::BIGINT AS {n}" for n, w in _CHECKS.items())},
   (SELECT coalesce(sum(k-1), 0)::BIGINT FROM (SELECT count(*) AS k FROM wp GROUP BY symbol, date)) AS duplicate_keys"""))
def f41(spark, sf):
    return W.quality_report(stage(W.window_path(lob(spark, sf)), "window-path"))


PW = "pw AS (SELECT *, mid IS NOT NULL AS ok, " + ", ".join(f"{_dep(s, k)} AS {s}{k}" for s in ("bid", "ask") for k in (1, 3)) + """, bid_cnt[1] AS bn, ask_cnt[1] AS an FROM sess WHERE time>=100000000 AND time<103000000),
pq AS (SELECT *, last_value(CASE WHEN ok THEN {'r':row_id,'b':b1,'a':a1,'b1':bid1,'a1':ask1,'b3':bid3,'a3':ask3} END IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM pw),
sgm AS (SELECT symbol, date, p.r AS seg, any_value(p) AS p, count(*) FILTER (NOT ok) AS inv, min(source_side) FILTER (source_action='TRADE') AS lo, max(source_side) FILTER (source_action='TRADE') AS hi,
    arg_max([oid], row_id) FILTER (source_action='TRADE')[1] AS lastoid, max_by({'r':row_id,'ms':ms,'m':mid,'b3':bid3,'a3':ask3}, row_id) FILTER (ok) AS af FROM pq WHERE p IS NOT NULL GROUP BY 1,2,3),
tre AS (SELECT q.symbol, q.date, source_side AS side, oid AS order_id, row_id, q.ms, source_price, source_volume, (q.p.b+q.p.a)/2.0::DOUBLE AS before_mid, inv>0 AS atomic,
    CASE WHEN inv=0 THEN CASE WHEN source_side='B' THEN mid-(q.p.b+q.p.a)/2.0::DOUBLE ELSE (q.p.b+q.p.a)/2.0::DOUBLE-mid END END AS immediate,
    CASE WHEN inv=0 THEN CASE WHEN source_side='B' THEN q.p.a3-ask3 ELSE q.p.b3-bid3 END END AS dl FROM pq q JOIN sgm s ON s.symbol=q.symbol AND s.date=q.date AND s.seg=q.p.r WHERE source_action='TRADE' AND source_volume>0),
ato AS (SELECT symbol, date, seg AS segment, coalesce(lo=hi,false) AS one_sided, CASE WHEN lo=hi THEN lo END AS side, lastoid AS order_id, af.r AS row_id, af.ms AS ms, (p.b+p.a)/2.0::DOUBLE AS before_mid,
    CASE WHEN lo=hi THEN CASE WHEN lo='B' THEN af.m-(p.b+p.a)/2.0::DOUBLE ELSE (p.b+p.a)/2.0::DOUBLE-af.m END END AS immediate,
    CASE WHEN lo=hi THEN CASE WHEN lo='B' THEN p.a3-af.a3 ELSE p.b3-af.b3 END END AS dl FROM sgm WHERE inv>0 AND af IS NOT NULL)"""


@query("f32_atomic_chains", sql(V, PW, fin("SELECT symbol, date, segment, one_sided, side, order_id, row_id, ms, before_mid, immediate, immediate/before_mid*10000 AS impact_bps, (CASE WHEN dl>0 THEN dl END)::BIGINT AS depth_loss FROM ato", "before_mid immediate impact_bps")))
def f32(spark, sf):
    rows = P.window_rows(lob(spark, sf))
    return rounded(P.atomic_effects(P.segments(rows)))


CH = """chn AS (SELECT symbol, date, side, order_id, min(ms) AS f, max(ms) AS l, count(*) AS trade_count, sum(source_volume)::BIGINT AS volume, sum(source_volume*source_price)::BIGINT AS notional,
    coalesce(sum(immediate/before_mid*10000),0) AS ib, coalesce(sum(dl) FILTER (dl>0),0)::BIGINT AS d, list(ms ORDER BY row_id) AS ts FROM tre WHERE order_id IS NOT NULL GROUP BY 1,2,3,4),
chx AS (SELECT symbol, date, side, order_id, sum(immediate/before_mid*10000) AS xi, sum(dl) FILTER (dl>0)::BIGINT AS xd FROM ato WHERE one_sided AND order_id IS NOT NULL GROUP BY 1,2,3,4),
chr AS (SELECT symbol, date, side, order_id, f/1000.0::DOUBLE AS first_seconds, l/1000.0::DOUBLE AS last_seconds, (l-f)/1000.0::DOUBLE AS duration_seconds, trade_count, volume, notional, ib+coalesce(xi,0) AS directional_impact_bps_sum, d+coalesce(xd,0) AS depth_loss,
    CASE WHEN trade_count>=4 THEN ((ts[1+(trade_count-1)//2]-ts[1]) - (ts[trade_count]-ts[trade_count-(trade_count-1)//2]))/1000.0::DOUBLE/((trade_count-1)//2) END AS acceleration_seconds FROM chn LEFT JOIN chx USING (symbol,date,side,order_id))"""
_CHD = "first_seconds last_seconds duration_seconds directional_impact_bps_sum acceleration_seconds"


@query("f31_order_chains", sql(V, PW, CH, fin("SELECT * FROM chr", _CHD)))
def f31(spark, sf):
    p = P.primitives(lob(spark, sf))
    return rounded(p["chains"])


RT = """shots AS (SELECT symbol, date, side, row_id, ms, before_mid, immediate FROM tre WHERE NOT atomic UNION ALL SELECT symbol, date, side, row_id, ms, before_mid, immediate FROM ato WHERE one_sided),
pb AS (SELECT *, ms+h*1000 AS dl FROM shots CROSS JOIN (VALUES (5),(30),(60)) v(h)),
rtn AS (SELECT b.symbol, b.date, side, b.row_id, b.ms, before_mid, immediate, h AS horizon, CASE WHEN side='B' THEN v.mid-before_mid ELSE before_mid-v.mid END AS retained, v.mid IS NULL AS censored,
    CASE WHEN v.mid IS NOT NULL THEN (immediate<>0 AND (CASE WHEN side='B' THEN v.mid-before_mid ELSE before_mid-v.mid END)*immediate<0)::INTEGER END AS is_reversed
  FROM pb b ASOF LEFT JOIN (SELECT symbol, date, ms, arg_min(mid,row_id) AS mid FROM pw WHERE ok GROUP BY 1,2,3) v ON v.symbol=b.symbol AND v.date=b.date AND b.dl<=v.ms)"""


@query("f33_impact_retention", sql(V, PW, RT, fin("SELECT * FROM rtn", "before_mid immediate retained")))
def f33(spark, sf):
    return rounded(P.primitives(lob(spark, sf))["retention"])


QT = """vq AS (SELECT symbol, date, row_id, ms, source_action, b1, a1, lag(b1) OVER w AS pb, lag(a1) OVER w AS pa FROM pw WHERE ok WINDOW w AS (PARTITION BY symbol, date ORDER BY row_id)),
fh AS (SELECT symbol, date, side, order_id, min(row_id) AS ft FROM tre WHERE order_id IS NOT NULL GROUP BY 1,2,3,4),
q0 AS (SELECT q.*, CASE WHEN source_side='B' THEN b1 ELSE a1 END AS qp FROM pq q JOIN sgm s ON s.symbol=q.symbol AND s.date=q.date AND s.seg=q.p.r AND inv=0 LEFT JOIN fh ON fh.symbol=q.symbol AND fh.date=q.date AND fh.side=source_side AND fh.order_id=oid
  WHERE ok AND source_action='ORDER_ADD' AND NOT (q.symbol LIKE 'SH%' AND coalesce(ft<q.row_id,false)) AND CASE WHEN source_side='B' THEN b1>q.p.b AND b1<q.p.a ELSE a1<q.p.a AND a1>q.p.b END),
q1 AS (SELECT q0.*, (SELECT min_by({'r':v.row_id,'ms':v.ms,'b':v.b1,'a':v.a1,'act':v.source_action}, v.row_id) FROM vq v WHERE v.symbol=q0.symbol AND v.date=q0.date AND v.row_id>q0.row_id AND CASE WHEN q0.source_side='B' THEN v.b1<>q0.qp ELSE v.a1<>q0.qp END) AS e FROM q0),
qlf AS (SELECT symbol, date, source_side AS side, row_id AS start_row_id, e.r AS end_row_id, qp AS quote_price, (CASE WHEN source_side='B' THEN bid1 ELSE ask1 END)::BIGINT AS quote_quantity, CASE WHEN source_side='B' THEN bn ELSE an END AS quote_count,
    (CASE WHEN source_side='B' THEN p.b1 ELSE p.a1 END)::BIGINT AS prior_side_quantity, (CASE WHEN source_side='B' THEN bid1 ELSE ask1 END)::DOUBLE/nullif(CASE WHEN source_side='B' THEN p.b1 ELSE p.a1 END,0) AS relative_depth,
    (coalesce(e.ms,37800000)-ms)/1000.0::DOUBLE AS lifetime_seconds, (EXISTS (SELECT 1 FROM pw t WHERE t.symbol=q1.symbol AND t.date=q1.date AND t.source_action='TRADE' AND t.source_price=qp AND t.row_id>q1.row_id AND t.row_id<=coalesce(q1.e.r, 9e18)))::INTEGER AS rehit,
    coalesce(e.b=p.b AND e.a=p.a, false)::INTEGER AS restored_pre_event_book, (e IS NULL)::INTEGER AS censored_at_signal, coalesce(e.act,'CENSORED') AS removal_action FROM q1)"""


@query("f34_quote_lifecycles", sql(V, PW, QT, fin("SELECT * FROM qlf", "relative_depth lifetime_seconds")))
def f34(spark, sf):
    return rounded(P.primitives(lob(spark, sf))["quotes"])


_HZ = (5, 30, 60)
SIG = f"""bk AS (SELECT symbol, date, count(mid) AS valid_books, count(*) FILTER (NOT ok) AS invalid_books, avg((a1-b1)/mid*10000) FILTER (ok) AS mean_spread_bps,
    {', '.join(f"sum({s}{k}) FILTER (ok)/greatest(1,count(mid))::DOUBLE AS mean_{s}_depth{k}" for s in ('bid', 'ask') for k in (1, 3))}, sum(bn) FILTER (ok)/greatest(1,count(mid))::DOUBLE AS mean_bid_count1, sum(an) FILTER (ok)/greatest(1,count(mid))::DOUBLE AS mean_ask_count1 FROM pw GROUP BY 1,2),
ac AS (SELECT symbol, date, coalesce(sum(source_volume) FILTER (side='B'),0)::BIGINT AS active_buy_volume, coalesce(sum(source_volume) FILTER (side='S'),0)::BIGINT AS active_sell_volume, count(*) FILTER (side='B') AS active_buy_count, count(*) FILTER (side='S') AS active_sell_count,
    count(*) FILTER (order_id IS NULL) AS missing_active_order_id FROM tre GROUP BY 1,2),
cc AS (SELECT symbol, date, count(*) AS chain_count, count(*) FILTER (trade_count>1) AS multi_trade_chain_count, coalesce(sum(volume) FILTER (trade_count>1),0)/sum(volume)::DOUBLE AS multi_trade_chain_volume_share,
    sum(s*s) AS chain_volume_hhi, -sum(s*ln(s)) AS chain_volume_entropy, max(s) AS largest_chain_volume_share FROM (SELECT *, volume/sum(volume) OVER (PARTITION BY symbol, date)::DOUBLE AS s FROM chr) GROUP BY 1,2),
qq AS (SELECT symbol, date, count(*) AS new_quote_count, avg(relative_depth) AS new_quote_relative_depth_mean, avg((relative_depth<0.5)::INTEGER) AS new_quote_thin_share_lt_0_5, avg(rehit) AS new_quote_rehit_share, avg(restored_pre_event_book) FILTER (censored_at_signal=0) AS new_quote_restored_share,
    sum(censored_at_signal)::BIGINT AS new_quote_censored_count, count(*) FILTER (side='B') AS passive_improve_buy_count, count(*) FILTER (side='S') AS passive_improve_sell_count FROM qlf GROUP BY 1,2),
aa AS (SELECT symbol, date, count(*) AS atomic_book_chains, count(*) FILTER (NOT one_sided) AS atomic_ambiguous_chains FROM ato GROUP BY 1,2),
ii AS (SELECT symbol, date, {', '.join(f"count(*) FILTER (horizon={h} AND NOT censored) AS impact_observations_{h}s, count(*) FILTER (horizon={h} AND censored) AS impact_censored_{h}s, avg(immediate) FILTER (horizon={h} AND NOT censored) AS directional_immediate_impact_mean_{h}s, avg(retained) FILTER (horizon={h}) AS directional_retained_impact_mean_{h}s, avg(is_reversed) FILTER (horizon={h}) AS impact_reversal_share_{h}s" for h in _HZ)} FROM rtn GROUP BY 1,2),
sj AS (SELECT * FROM bk LEFT JOIN ac USING (symbol,date) LEFT JOIN cc USING (symbol,date) LEFT JOIN qq USING (symbol,date) LEFT JOIN aa USING (symbol,date) LEFT JOIN ii USING (symbol,date))"""
_SC = ["active_buy_volume", "active_sell_volume", "active_buy_count", "active_sell_count", "missing_active_order_id", "chain_count", "multi_trade_chain_count", "new_quote_count", "new_quote_censored_count",
       "passive_improve_buy_count", "passive_improve_sell_count", "atomic_book_chains", "atomic_ambiguous_chains", *[f"impact_{x}_{h}s" for h in _HZ for x in ("observations", "censored")]]


@query("f35_lob_signal_row", sql(V, PW, CH, RT, QT, SIG, fin(
    f"SELECT * REPLACE ({', '.join(f'coalesce({x},0) AS {x}' for x in _SC)}), (active_buy_volume-active_sell_volume)/nullif(active_buy_volume+active_sell_volume,0)::DOUBLE AS active_net_share FROM sj",
    "mean_spread_bps mean_bid_depth1 mean_bid_depth3 mean_ask_depth1 mean_ask_depth3 mean_bid_count1 mean_ask_count1 multi_trade_chain_volume_share chain_volume_hhi chain_volume_entropy largest_chain_volume_share new_quote_relative_depth_mean "
    "new_quote_thin_share_lt_0_5 new_quote_rehit_share new_quote_restored_share active_net_share " + " ".join(f"directional_immediate_impact_mean_{h}s directional_retained_impact_mean_{h}s impact_reversal_share_{h}s" for h in _HZ))))
def f35(spark, sf):
    return rounded(P.signal_row(P.primitives(lob(spark, sf))))


OS = f"""sr0 AS (SELECT *, {_dep('bid', 3)} AS bid3, {_dep('ask', 3)} AS ask3, (source_action='TRADE' AND source_volume>0) AS tr0 FROM sess WHERE session='AM'),
sr1 AS (SELECT *, coalesce(b1>0 AND a1>=b1 AND bid3 IS NOT NULL AND ask3 IS NOT NULL, false) AS ok,
    tr0 AND oid IS NOT NULL AND (source_recid IS NULL OR row_number() OVER (PARTITION BY symbol, date, tr0, source_recid ORDER BY row_id)=1) AS trd FROM sr0),
sr2 AS (SELECT *, last_value(CASE WHEN ok THEN {{'b':b1,'a':a1,'bd':bid3,'ad':ask3}} END IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    min(CASE WHEN trd THEN row_id END) OVER (PARTITION BY symbol, date, source_side, oid) AS ft, lead(ms) OVER (PARTITION BY symbol, date ORDER BY row_id) AS nms,
    coalesce(lag(trd) OVER w AND trd AND lag(source_side) OVER w=source_side AND lag(oid) OVER w=oid, false) AS cont FROM sr1 WINDOW w AS (PARTITION BY symbol, date ORDER BY row_id)),
sr AS (SELECT *, coalesce(source_action='ORDER_ADD' AND NOT coalesce(ft<row_id,false) AND CASE WHEN source_side='B' THEN source_price<p.a AND source_price>=p.b ELSE source_price>p.b AND source_price<=p.a END, false) AS aga,
    coalesce(source_action='CANCEL' AND CASE WHEN source_side='B' THEN source_price>=p.b-(p.b+p.a)/2.0::DOUBLE*10/10000 ELSE source_price<=p.a+(p.b+p.a)/2.0::DOUBLE*10/10000 END, false) AS ncn,
    CASE WHEN source_action='ORDER_ADD' AND p IS NOT NULL THEN CASE WHEN source_side='B' THEN CASE WHEN source_price>=p.a THEN NULL WHEN source_price>=p.b THEN 'best' WHEN source_price>=(p.b+p.a)/2.0::DOUBLE*(1-10.0::DOUBLE/10000) THEN 'near' END
       ELSE CASE WHEN source_price<=p.b THEN NULL WHEN source_price<=p.a THEN 'best' WHEN source_price<=(p.b+p.a)/2.0::DOUBLE*(1+10.0::DOUBLE/10000) THEN 'near' END END END AS dist FROM sr2),
chg AS (SELECT symbol, date, grp AS chain, any_value(source_side) AS side, any_value(oid) AS order_id, sum(source_volume)::BIGINT AS volume, count(*) AS children, min(row_id) AS first_row, max(row_id) AS last_row, min(ms) AS first_ms, max(ms) AS last_ms, arg_max(coalesce(nms,41400000),row_id) AS closed_ms
  FROM (SELECT *, sum((trd AND NOT cont)::INTEGER) OVER (PARTITION BY symbol, date ORDER BY row_id) AS grp FROM sr) WHERE trd GROUP BY 1,2,3),
gt AS (SELECT * FROM (SELECT symbol, date, max(ms) AS mx FROM sr GROUP BY 1,2) CROSS JOIN (VALUES (36000000),(36600000),(37200000),(37800000)) v(g) WHERE g<=mx),
ge AS (SELECT symbol, date, g, {', '.join(f"coalesce(sum(source_volume) FILTER ({f} AND source_side='{s}'),0)::BIGINT AS {n.format(t)}" for f, n in (('trd', 'active_{}_volume'), ('aga', 'aggressive_add_{}'), ('ncn', 'near_cancel_{}')) for s, t in (('B', 'buy'), ('S', 'sell')))},
    count(*) FILTER (trd AND source_side='B') AS active_buy_count, count(*) FILTER (trd AND source_side='S') AS active_sell_count FROM gt JOIN sr USING (symbol, date) WHERE ms<g AND ms>g-60000 GROUP BY 1,2,3),
gc AS (SELECT symbol, date, g, coalesce(sum(volume) FILTER (side='B'),0)::BIGINT AS chain_buy_volume, coalesce(sum(volume) FILTER (side='S'),0)::BIGINT AS chain_sell_volume, count(*) AS chain_count, count(*) FILTER (children>1) AS multi_chain_count
  FROM gt JOIN chg USING (symbol, date) WHERE closed_ms<g AND last_ms>g-60000 GROUP BY 1,2,3),
gs AS (SELECT symbol, date, g AS grid, {', '.join(f"coalesce({n},0) AS {n}" for n in ('active_buy_volume', 'active_sell_volume', 'aggressive_add_buy', 'aggressive_add_sell', 'near_cancel_buy', 'near_cancel_sell', 'active_buy_count', 'active_sell_count', 'chain_buy_volume', 'chain_sell_volume', 'chain_count', 'multi_chain_count'))}
  FROM gt LEFT JOIN ge USING (symbol,date,g) LEFT JOIN gc USING (symbol,date,g)),
ct AS (SELECT d.symbol, d.date, d.bk, median(h.active_buy_volume) AS buy_cut, median(h.active_sell_volume) AS sell_cut FROM (SELECT DISTINCT symbol, date, grid//1800000 AS bk FROM gs) d LEFT JOIN gs h ON h.symbol=d.symbol AND h.date<d.date AND h.grid//1800000=d.bk GROUP BY 1,2,3)"""


@query("w06_trade_chains", sql(V, OS, "SELECT * REPLACE (chain::BIGINT AS chain) FROM chg"))
def w06(spark, sf):
    return O.trade_chains(O.state_rows(lob(spark, sf)))


@query("w18_grid_samples", sql(V, OS, "SELECT * FROM gs"))
def w18(spark, sf):
    rows = stage(O.quote_class(stage(O.state_rows(lob(spark, sf)))))
    return O.grid_samples(rows, O.trade_chains(rows))


FH = """po0 AS (SELECT s.*, CASE WHEN ms>=37800000 THEN 37800000 WHEN ms>=37200000 THEN 37200000 WHEN ms>=36600000 THEN 36600000 WHEN ms>=36000000 THEN 36000000 END AS gr FROM sr s WHERE source_action='ORDER_ADD' AND dist IS NOT NULL AND oid IS NOT NULL AND ms<38400000),
po1 AS (SELECT o.symbol, o.date, o.source_side AS side, o.oid, o.row_id, o.ms, o.dist, o.source_volume, o.gr, coalesce(sum(t.source_volume) FILTER (t.source_side='B'),0) AS fb, coalesce(sum(t.source_volume) FILTER (t.source_side='S'),0) AS fs
  FROM po0 o LEFT JOIN sr t ON t.symbol=o.symbol AND t.date=o.date AND t.trd AND t.row_id<o.row_id AND t.ms>coalesce(o.gr-60000,0) GROUP BY ALL),
po2 AS (SELECT po1.*, CASE WHEN buy_cut IS NOT NULL AND sell_cut IS NOT NULL THEN 'B'||(fb>buy_cut)::INTEGER||'S'||(fs>sell_cut)::INTEGER ELSE 'unknown' END AS state, row_number() OVER (PARTITION BY po1.symbol, po1.date, side, oid ORDER BY row_id) AS k
  FROM po1 LEFT JOIN ct ON ct.symbol=po1.symbol AND ct.date=po1.date AND ct.bk=po1.ms//1800000),
po AS (SELECT o.symbol, o.date, o.side, o.oid AS order_id, o.row_id, o.ms, state, o.dist AS distance, o.source_volume, coalesce(sum(t.source_volume),0)::BIGINT AS filled_60s FROM po2 o
  LEFT JOIN sr t ON t.symbol=o.symbol AND t.date=o.date AND t.trd AND t.source_side<>o.side AND t.pid=o.oid AND t.row_id>o.row_id AND t.ms-o.ms<=60000
  WHERE k=1 AND NOT EXISTS (SELECT 1 FROM sr a WHERE a.trd AND a.symbol=o.symbol AND a.date=o.date AND a.source_side=o.side AND a.oid=o.oid) GROUP BY ALL),
fd AS (SELECT symbol, date, side, state, distance, count(*) AS n, count(*) FILTER (filled_60s>0) AS f FROM po WHERE state<>'unknown' GROUP BY ALL),
fg AS (SELECT * FROM (SELECT DISTINCT symbol, date FROM sr) CROSS JOIN (VALUES ('B'),('S')) a(side) CROSS JOIN (VALUES ('B0S0'),('B0S1'),('B1S0'),('B1S1')) b(state) CROSS JOIN (VALUES ('best'),('near')) c(distance)),
fq AS (SELECT g.symbol, g.date, g.side, g.state, g.distance, coalesce(sum(d.n),0)::BIGINT AS cell_n, coalesce(sum(d.f),0)::BIGINT AS cell_f FROM fg g LEFT JOIN fd d ON d.symbol=g.symbol AND d.side=g.side AND d.state=g.state AND d.distance=g.distance AND d.date<g.date GROUP BY 1,2,3,4,5),
fr AS (SELECT *, (sum(cell_n) OVER g)::BIGINT AS all_n, (sum(cell_f) OVER g)::BIGINT AS all_f FROM fq WINDOW g AS (PARTITION BY symbol, date, side, distance)),
fpb AS (SELECT *, CASE WHEN all_n>={minimum} THEN (cell_f+20*(all_f/all_n::DOUBLE))/(cell_n+20) END AS pred_fill FROM fr)"""


@query("f29_fill_probability", sql(V, OS, FH.replace("{minimum}", "5"), fin("SELECT * FROM fpb", "pred_fill")))
def f29(spark, sf):
    rows = stage(O.quote_class(stage(O.state_rows(lob(spark, sf)))))
    cuts = stage(O.history_thresholds(O.grid_samples(rows, O.trade_chains(rows))))
    hist = O.fill_history(O.passive_orders(rows, cuts), rows.select("symbol", "date"))
    return rounded(O.fill_probability(hist, 5))


_SH = "coalesce(({a}-{b})/nullif({a}+{b},0)::DOUBLE,0)"


@query("f28_order_state_1030", sql(V, OS, FH.replace("{minimum}", "1"),
    """lb0 AS (SELECT *, CASE WHEN ok THEN (b1+a1)/2.0::DOUBLE END AS m FROM sr),
lb1 AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM lb0),
lb AS (SELECT symbol, date, coalesce(sum(source_volume) FILTER (w AND trd AND source_side='B'),0)::BIGINT AS future_buy_volume, coalesce(sum(source_volume) FILTER (w AND trd AND source_side='S'),0)::BIGINT AS future_sell_volume, count(*) FILTER (w) AS future_event_count,
    count(*) FILTER (w AND trd AND source_side='B') AS future_buy_count, count(*) FILTER (w AND trd AND source_side='S') AS future_sell_count,
    sqrt(coalesce(sum(ln(m/pm)**2) FILTER (w),0))*10000 AS future_realized_vol_bps, count(ln(m/pm)) FILTER (w) AS future_mid_moves, max_by({'b':b1,'a':a1,'bd':bid3,'ad':ask3},row_id) FILTER (ok AND ms<37800000) AS nw, max_by({'b':b1,'a':a1,'bd':bid3,'ad':ask3},row_id) FILTER (ok AND ms<38400000) AS en
  FROM (SELECT *, ms>=37800000 AND ms<38400000 AS w FROM lb1) GROUP BY 1,2),
pf AS (SELECT symbol, date, state, max(pred_fill) FILTER (side='B') AS pred_fill_buy, max(cell_n) FILTER (side='B') AS fill_history_buy, max(pred_fill) FILTER (side='S') AS pred_fill_sell, max(cell_n) FILTER (side='S') AS fill_history_sell FROM fpb WHERE distance='best' GROUP BY 1,2,3),
s30 AS (SELECT gs.* EXCLUDE (grid), CASE WHEN buy_cut IS NOT NULL AND sell_cut IS NOT NULL THEN 'B'||(active_buy_volume>buy_cut)::INTEGER||'S'||(active_sell_volume>sell_cut)::INTEGER ELSE 'unknown' END AS state FROM gs LEFT JOIN ct ON ct.symbol=gs.symbol AND ct.date=gs.date AND ct.bk=gs.grid//1800000 WHERE grid=37800000)""",
    fin(f"""SELECT * EXCLUDE (nw, en), {_SH.format(a='active_buy_volume', b='active_sell_volume')} AS active_net_share, {_SH.format(a='chain_buy_volume', b='chain_sell_volume')} AS chain_net_share, coalesce(multi_chain_count/nullif(chain_count,0)::DOUBLE,0) AS multi_chain_share,
      chain_count-multi_chain_count AS single_chain_count, future_buy_volume-future_sell_volume AS future_net_flow, future_buy_volume+future_sell_volume AS future_total_active_volume,
      aggressive_add_buy-aggressive_add_sell AS quote_aggressive_net, near_cancel_sell-near_cancel_buy AS quote_cancel_net, {_sp('nw')} AS spread_bps, nw.bd::BIGINT AS bid_depth3, nw.ad::BIGINT AS ask_depth3, {_bi('nw')} AS book_imbalance3, pred_fill_buy-pred_fill_sell AS fill_opportunity_diff,
      {_sp('en')} AS end_spread_bps, en.bd::BIGINT AS end_bid_depth3, en.ad::BIGINT AS end_ask_depth3 FROM s30 JOIN pf USING (symbol,date,state) JOIN lb USING (symbol,date) WHERE pred_fill_buy IS NOT NULL AND pred_fill_sell IS NOT NULL AND nw IS NOT NULL""",
      "future_realized_vol_bps pred_fill_buy pred_fill_sell active_net_share chain_net_share multi_chain_share spread_bps book_imbalance3 fill_opportunity_diff end_spread_bps")))
def f28(spark, sf):
    return rounded(O.order_state_1030(lob(spark, sf), minimum=1))
