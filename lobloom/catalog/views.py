"""DuckDB text of the derived tables, for the cross-engine checks."""

# Same fixed rules as lobloom.sources.derived, written for DuckDB.
LOB = """
lob AS (
  SELECT symbol, date, (c//3600000)*10000000 + (c//60000%60)*100000 + (c//1000%60)*1000 + c%1000 AS time,
         event_id AS row_id, act AS source_action, sd AS source_side,
         (CASE WHEN event_id%41=0 THEN NULL WHEN event_id%5=0 THEN -1 - c//1200000 ELSE event_id END)::BIGINT AS source_recid,
         CASE WHEN (act='TRADE' OR sd='B') AND event_id%47<>0 THEN 1 + (c//600000)%12 END::BIGINT AS source_buy_order_id,
         CASE WHEN act='TRADE' OR sd='S' THEN 101 + (c//480000)%15 END::BIGINT AS source_sell_order_id,
         (CASE WHEN act='TRADE' THEN CASE WHEN sd='B' THEN ask ELSE bid END
               WHEN sd='B' THEN bid - 100*(event_id%4) ELSE ask + 100*(event_id%4) END)::BIGINT AS source_price,
         (100*(1 + floor(value)::BIGINT % 20))::BIGINT AS source_volume,
         CASE event_id%3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'PARTIAL' ELSE 'NA' END AS source_link_status,
         CASE WHEN event_id%29=0 THEN []::BIGINT[] ELSE [(bid - 100*(l-1))::BIGINT FOR l IN range(1, lv+1)] END AS bid_px,
         CASE WHEN event_id%29=0 OR event_id%31=0 THEN []::BIGINT[] ELSE [(ask + 100*(l-1))::BIGINT FOR l IN range(1, lv+1)] END AS ask_px,
         CASE WHEN event_id%29=0 THEN []::BIGINT[] ELSE [(100*(1+(event_id+l)%9))::BIGINT FOR l IN range(1, lv+1)] END AS bid_vol,
         CASE WHEN event_id%29=0 OR event_id%31=0 THEN []::BIGINT[] ELSE [(100*(1+(event_id+2*l)%9))::BIGINT FOR l IN range(1, lv+1)] END AS ask_vol,
         CASE WHEN event_id%29=0 THEN []::BIGINT[] ELSE [(1+(event_id+l)%5)::BIGINT FOR l IN range(1, lv+1)] END AS bid_cnt,
         CASE WHEN event_id%29=0 OR event_id%31=0 THEN []::BIGINT[] ELSE [(1+(event_id+3*l)%5)::BIGINT FOR l IN range(1, lv+1)] END AS ask_cnt
  FROM (
    SELECT *, bid + CASE WHEN event_id%17=0 THEN 0 WHEN event_id%19=0 THEN -100 ELSE 100*(1+event_id%3) END AS ask,
           CASE WHEN event_id%13=0 THEN 2 ELSE 10 END AS lv
    FROM (
      SELECT event_id, value,
             (CASE WHEN (user_id//{ups})%2=0 THEN 'SH' ELSE 'SZ' END) || (600000 + user_id//{ups})::VARCHAR AS symbol,
             (year(ts)*10000 + month(ts)*100 + day(ts))::INTEGER AS date,
             CASE WHEN md < 43200000 THEN 34200000 + md//6 ELSE 46800000 + ((md-43200000)*13)//80 END AS c,
             CASE WHEN event_type IN ('view','click') THEN 'ORDER_ADD' WHEN event_type IN ('purchase','error') THEN 'TRADE' ELSE 'CANCEL' END AS act,
             CASE WHEN (event_id//4)%2=0 THEN 'B' ELSE 'S' END AS sd,
             100000 + 100*((event_id*37)%23) AS bid
      FROM (SELECT *, (epoch_us(ts) % 86400000000)//1000 AS md FROM events)))
)"""

SESS = """
sess AS (
  SELECT *, CASE WHEN time < 120000000 THEN 'AM' ELSE 'PM' END AS session,
         (time//10000000)*3600000 + (time//100000%100)*60000 + (time//1000%100)*1000 + time%1000 AS ms,
         bid_px[1] AS b1, ask_px[1] AS a1,
         CASE WHEN source_side='B' THEN source_buy_order_id ELSE source_sell_order_id END AS oid,
         CASE WHEN source_side='B' THEN source_sell_order_id ELSE source_buy_order_id END AS pid,
         CASE WHEN bid_px[1] > 0 AND ask_px[1] > bid_px[1] THEN (bid_px[1]::DOUBLE + ask_px[1])/2 END AS mid
  FROM lob
  WHERE (time >= 93000000 AND time < 113000000) OR (time >= 130000000 AND time < 145700000)
)"""

CONTROLS = """
controls AS (
  SELECT symbol, date, 8.0::DOUBLE + (p%700)/100.0::DOUBLE AS close_1000, 1 AS security_category,
         (r%53=0)::INTEGER AS is_st, (r%59=0)::INTEGER AS is_suspended,
         (r%97+8)::INTEGER AS listing_days, (r%89+18)::INTEGER AS liquidity_history_days,
         'b' || (substr(symbol,3,6)::BIGINT%3)::VARCHAR AS board,
         (v%997)/100.0::DOUBLE - 5.0::DOUBLE AS ret5_lagged, (p%613)/50.0::DOUBLE AS turnover20,
         (v*7%401)/40.0::DOUBLE AS amihud20, (p*3%211)/30.0::DOUBLE AS residual_volatility,
         200000.0::DOUBLE + (v*131%8000000) AS cap
  FROM (SELECT symbol, date, count(*) n, sum(source_volume)::BIGINT v,
               sum(source_price%1000)::BIGINT p, min(row_id) r FROM lob GROUP BY 1,2)
)"""

PANEL = """
panel AS (
  SELECT CASE WHEN sid%7=0 THEN 'SH688' WHEN sid%2=0 THEN 'SH600' ELSE 'SZ000' END || lpad(sid::VARCHAR,12,'0') AS symbol,
         date, CASE WHEN sid%7=0 OR sid%2=0 THEN 'SH' ELSE 'SZ' END AS exchange,
         round(cents::DOUBLE/qty/100000*5, 6) AS unit,
         round((cents%9973)/100.0::DOUBLE - 50, 6) AS factor,
         round((qty*100::DOUBLE)/n, 6) AS factor2,
         round(disc::DOUBLE/n, 6) AS vr, round(tax::DOUBLE/n - 4, 6) AS flow,
         qty::DOUBLE AS depth, n AS n_obs,
         round((cents%7919)/79.19::DOUBLE, 6) AS style1, round((minc%6007)/60.07::DOUBLE, 6) AS style2,
         maxq::DOUBLE AS style3, round(ln(cents::DOUBLE), 6) AS style4, (qty%31)::DOUBLE AS style5,
         round(4 + (minc%1300)/100.0::DOUBLE, 6) AS price, 100000.0::DOUBLE + (cents*3%9000000) AS cap,
         round((cents%601)/10000.0::DOUBLE - 0.03::DOUBLE, 6) + 0.0::DOUBLE AS ret,
         round((minc%401)/20000.0::DOUBLE - 0.01::DOUBLE, 6) + 0.0::DOUBLE AS ret30,
         (sid%40=0)::INTEGER AS limit_hit, sid
  FROM (SELECT l_suppkey AS sid, (year(l_shipdate)*10000+month(l_shipdate)*100+1)::INTEGER AS date,
               count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS qty,
               sum(round(l_extendedprice*100)::BIGINT)::BIGINT AS cents,
               sum(round(l_discount*100)::BIGINT)::BIGINT AS disc, sum(round(l_tax*100)::BIGINT)::BIGINT AS tax,
               max(l_quantity::BIGINT) AS maxq, min(round(l_extendedprice*100)::BIGINT) AS minc
        FROM lineitem GROUP BY 1,2)
)"""


def lob_views(ups: int = 25) -> str:
    return LOB.replace("{ups}", str(ups)) + "," + SESS


def sql(*parts: str) -> str:
    """WITH <views>, <ctes> <final select>; the last part is the select."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


STUDY = PANEL.strip() + """,
study0 AS (
  SELECT *, lag(cap) OVER (PARTITION BY symbol ORDER BY date) AS prev_cap, flow AS flow5,
    (flow*0.5 + (style5-15)/10) AS flow1, ((style1-50)/50) AS flow30,
    depth*3 + n_obs*10 AS buy5, depth*2 + style5*5 AS sell5, (style1*10+50) AS ask5, (style2*10+50) AS bid5,
    style3*10+50 AS ask30, (style1*5+style2*5+50) AS bid30,
    ((style2-style1)/100) AS book5, ((style3-25)/25) AS book30, (style2/100) AS fillability,
    ((style1-style2)/100) AS execution_pressure, (ret30/2) AS past_return FROM panel),
study AS (
  SELECT *, CASE WHEN prev_cap<500000 THEN 'low' WHEN prev_cap<5000000 THEN 'mid' ELSE 'high' END || '_' ||
      CASE WHEN symbol LIKE 'SH688%' THEN 'star' WHEN price<10 THEN 'lt10' ELSE 'ge10' END AS domain,
    ((bid5-ask5)/(bid5+ask5)) AS endpoint_book, (flow5-flow30) AS flow_shift, (book5-book30) AS book_shift,
    buy5 AS active_buy_volume, sell5 AS active_sell_volume, n_obs AS active_count, n_obs*3+style3 AS fill_history_buy, depth+style1*2 AS fill_history_sell, style5*10 AS near_cancel_buy, style3*4 AS near_cancel_sell,
    style3*3 AS aggressive_add_buy, style5*6 AS aggressive_add_sell, (flow/5) AS active_net_share, (flow1/5) AS chain_net_share,
    (style2/100) AS multi_chain_share, (0.1::DOUBLE+style1/200) AS pred_fill_buy, (0.1::DOUBLE+style2/200) AS pred_fill_sell,
    bid5 AS bid_depth3, ask5 AS ask_depth3, bid30 AS end_bid_depth3, ask30 AS end_ask_depth3, style2 AS spread_bps, style1 AS end_spread_bps,
    depth*2 AS future_buy_volume, style5*30 AS future_sell_volume, n_obs::DOUBLE AS future_event_count, style3 AS future_realized_vol_bps,
    ((bid5-ask5)/(bid5+ask5)) AS book_imbalance3
  FROM study0 WHERE prev_cap IS NOT NULL AND NOT (symbol LIKE 'SH688%' AND price<10)
)"""
