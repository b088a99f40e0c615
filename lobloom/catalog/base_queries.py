"""Queries for the building blocks: scans, predicates, joins, aggregates, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lobloom.catalog.book_queries import BP, CH, FP, PR, PRN, PW, QT, RT, SIG, WP, _SC
from lobloom.catalog.registry import ORACLES, query, rounded
from lobloom.catalog.sqlgen import avg_rank, fin, pct
from lobloom.catalog.views import CONTROLS, PANEL, STUDY, lob_views, sql
from lobloom.functions import expr as X
from lobloom.operators import crosssection as C
from lobloom.operators import history as H
from lobloom.operators import lifecycle as L
from lobloom.operators.asof import asof
from lobloom.operators.ordered import dense_order, shift_dense
from lobloom.plans import impact, primitives, summaries, window_path
from lobloom.plans import evaluation as E
from lobloom.session import shared_folder, stage
from lobloom.sources import readers as R
from lobloom.sources.derived import controls, lob, panel, read_table, sessions, study

V = lob_views()
DAY = ["symbol", "date"]


@query("s02_p01_p07_event_columns", sql(V, fin("""
  SELECT symbol, date, row_id, session, ms, b1 AS bid, a1 AS ask, mid, CASE WHEN b1>0 AND a1>=b1 THEN (b1+a1)/2.0::DOUBLE END AS mid_locked,
    CASE WHEN b1 IS NULL OR a1 IS NULL OR b1<=0 OR a1<=0 THEN 'missing' WHEN b1=a1 THEN 'locked' WHEN b1>a1 THEN 'crossed' ELSE 'valid' END AS book_state,
    CASE WHEN len(bid_vol)>=3 THEN list_sum(bid_vol[1:3]) END::BIGINT AS bid_depth3, CASE WHEN len(ask_vol)>=10 THEN list_sum(ask_vol[1:10]) END::BIGINT AS ask_depth10,
    oid AS own_id, pid AS other_id, session || lpad(((CASE WHEN session='AM' THEN ms-34200000 ELSE ms-46800000 END)//1800000)::VARCHAR,2,'0') AS bucket FROM sess""", "mid mid_locked")))
def base_columns(spark, sf):
    e = sessions(lob(spark, sf))
    b, a = X.best("bid"), X.best("ask")
    mid = (b.cast("double") + a) / 2.0
    return rounded(e.select(
        *DAY, "row_id", "session", X.clock_ms().alias("ms"), b.alias("bid"), a.alias("ask"), F.when(X.book_ok("strict"), mid).alias("mid"),
        F.when(X.book_ok("locked_ok"), mid).alias("mid_locked"), X.book_state(b, a).alias("book_state"), X.depth("bid_vol", 3).alias("bid_depth3"),
        X.depth("ask_vol", 10).alias("ask_depth10"), X.own_side_id().alias("own_id"), X.other_side_id().alias("other_id"), X.half_hour_bucket().alias("bucket")))


@query("s03_clock_range_scan", sql(V, "SELECT symbol, date, source_action, count(*) AS n, sum(source_volume)::BIGINT AS volume FROM lob WHERE time>=100000000 AND time<103000000 GROUP BY 1,2,3"))
def clock_scan(spark, sf):
    e = lob(spark, sf).filter(X.in_window(100000000, 103000000)).select(*DAY, "source_action", "source_volume")
    return e.groupBy(*DAY, "source_action").agg(F.count(F.lit(1)).alias("n"), F.sum("source_volume").alias("volume"))


def _event_files(spark, sf) -> str:
    """The event table as month/symbol files, once per session and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FILES:
        root = f"{shared_folder(spark)}/lobloom/files-{uuid.uuid4().hex}"
        R.write_event_files(lob(spark, sf), root)
        _FILES[key] = root
    return _FILES[key]


_FILES: dict = {}


@query("s01_s04_file_scan_round_trip", sql(V, "SELECT symbol, date, count(*) AS n, sum(source_volume)::BIGINT AS volume, max(time) AS last_time FROM lob GROUP BY 1,2"))
def file_scan(spark, sf):
    """All rows of all month/symbol files, read back with the symbol from the file name."""
    e = R.read_events(spark, _event_files(spark, sf), ["date", "time", "source_volume"])
    return e.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), F.sum("source_volume").alias("volume"), F.max("time").alias("last_time"))


_CSV = "symbol string, date int, ret double, cap double, style1 double"


@query("s05_t01_csv_panels", sql(PANEL, fin("SELECT symbol, date, round(ret, 8) AS ret, NULL::DOUBLE AS cap, NULL::DOUBLE AS style1 FROM panel WHERE (date//100)%2=0 UNION ALL SELECT symbol, date, NULL, round(cap, 8), round(style1, 8) FROM panel WHERE (date//100)%2=1", "ret cap style1")))
def csv_panels(spark, sf):
    """Two CSV panels with different columns, written and read back as one by column name."""
    root = f"{shared_folder(spark)}/lobloom/panels-{uuid.uuid4().hex}"
    p = panel(spark, sf)
    R.write_csv(p.filter("(date div 100) % 2 = 0").select("symbol", "date", F.round("ret", 8).alias("ret")), f"{root}/a")
    R.write_csv(p.filter("(date div 100) % 2 = 1").select("symbol", "date", F.round("cap", 8).alias("cap"), F.round("style1", 8).alias("style1")), f"{root}/b")
    both = R.read_panels(spark, [f"{root}/a", f"{root}/b"], typed=_CSV)
    return rounded(R.require_columns(both, ["symbol", "date", "ret", "cap", "style1"]).select("symbol", "date", "ret", "cap", "style1"))


@query("s13_t01_lending_balances", sql(PANEL, fin("SELECT symbol, date, cap AS balance FROM panel", "balance")))
def lending(spark, sf):
    """A balance table written in date folders and read with its declared types."""
    out = f"{shared_folder(spark)}/lobloom/lending-{uuid.uuid4().hex}"
    R.write_parquet(panel(spark, sf).select("symbol", "date", F.col("cap").alias("balance")), out, ["date"])
    return rounded(R.read_lending_balances(spark, out))


_UNIVERSE = "un AS (SELECT symbol, CASE WHEN crc%5=0 THEN 2 ELSE 1 END AS security_category FROM (SELECT DISTINCT symbol, length(symbol)+right(symbol, 3)::INT AS crc FROM lob))"


def _universe(spark, sf):
    c = F.length("symbol") + F.right("symbol", F.lit(3)).cast("int")
    return lob(spark, sf).select("symbol").distinct().select("symbol", F.when(c % 5 == 0, 2).otherwise(1).alias("security_category"))


@query("s06_certified_inputs", sql(V, _UNIVERSE, "SELECT DISTINCT (date//100)::VARCHAR AS month, symbol, security_category=1 AS is_certified FROM lob JOIN un USING (symbol)"))
def s06(spark, sf):
    """The files on disk, each with whether its symbol is a stock of the universe."""
    files = R.list_files(spark, _event_files(spark, sf))
    return R.certified_inputs(files, _universe(spark, sf)).select("month", "symbol", "is_certified")


@query("s06_certified_scan", sql(V, _UNIVERSE, "SELECT symbol, count(*) AS n, sum(source_volume)::BIGINT AS volume FROM lob JOIN un USING (symbol) WHERE security_category=1 GROUP BY 1"))
def s06_scan(spark, sf):
    """Reads the certified files of an input list; a file outside the universe would stop the job."""
    inputs = R.certified_inputs(R.list_files(spark, _event_files(spark, sf)), _universe(spark, sf)).filter("is_certified")
    paths = [r.path for r in R.assert_certified(inputs).filter("is_certified").select("path").collect()]  # the input list: names only
    return R.read_events(spark, paths, ["source_volume"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_volume").alias("volume"))


@query("s07_point_in_time_universe", """WITH ls AS (SELECT o_custkey AS symbol, min(o_orderdate)::DATE AS listed, CASE WHEN count(*)%3=0 THEN max(o_orderdate)::DATE END AS delisted FROM orders GROUP BY 1),
  mo AS (SELECT DISTINCT strftime(o_orderdate,'%Y%m') AS month, date_trunc('month',o_orderdate)::DATE AS ms FROM orders)
  SELECT symbol, month FROM ls JOIN mo ON listed < ms + INTERVAL 1 MONTH AND (delisted IS NULL OR delisted >= ms)""")
def s07(spark, sf):
    o = read_table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    ls = o.groupBy(F.col("o_custkey").alias("symbol")).agg(
        F.min("d").alias("listed"), F.when(F.count(F.lit(1)) % 3 == 0, F.max("d")).alias("delisted"))
    return R.point_in_time_universe(ls, o.select(F.date_format("d", "yyyyMM").alias("month")).distinct())


@query("s08_calendar", sql(PANEL, "SELECT date, row_number() OVER (ORDER BY date) AS day_seq FROM (SELECT DISTINCT date FROM panel)"))
def s08(spark, sf):
    return L.calendar(panel(spark, sf))


_BARS = """bars AS (SELECT symbol, date, lpad((time//10000000)::VARCHAR,2,'0') || lpad((time//100000%100//15*15)::VARCHAR,2,'0') AS stamp, arg_min(source_price,row_id)/10000.0::DOUBLE AS open, max(source_price)/10000.0::DOUBLE AS high,
  min(source_price)/10000.0::DOUBLE AS low, arg_max(source_price,row_id)/10000.0::DOUBLE AS close FROM sess WHERE source_action='TRADE' GROUP BY 1,2,3)"""


def _bars(spark, sf):
    t = F.col("time")
    stamp = F.concat(F.lpad(F.floor(t / 10000000).cast("string"), 2, "0"), F.lpad((F.floor((F.floor(t / 100000) % 100) / 15) * 15).cast("string"), 2, "0"))
    e = sessions(lob(spark, sf)).filter(F.col("source_action") == "TRADE")
    p = F.col("source_price") / 10000.0
    return e.groupBy(*DAY, stamp.alias("stamp")).agg(
        F.min_by(p, "row_id").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, "row_id").alias("close"))


@query("s09_minute_closes", sql(V, _BARS, fin("SELECT symbol, date, max(close) FILTER (stamp='1000') AS close_1000, max(close) FILTER (stamp='1015') AS close_1015, max(close) FILTER (stamp='1030') AS close_1030 FROM bars WHERE stamp IN ('1000','1015','1030') GROUP BY 1,2 HAVING count(DISTINCT stamp)=3", "close_1000 close_1015 close_1030")))
def s09(spark, sf):
    return rounded(R.minute_closes(_bars(spark, sf), ["1000", "1015", "1030"]))


_LK = "greatest(abs({n}.open-{l}),abs({n}.high-{l}),abs({n}.low-{l}),abs({n}.close-{l}))<=1e-6"


@query("s10_limit_states", sql(V, _BARS, "lm AS (SELECT symbol, date, max(high) AS up_limit, min(low) AS down_limit FROM bars GROUP BY 1,2)",
    "b AS (SELECT symbol, date, max({'open':open,'high':high,'low':low,'close':close}) FILTER (stamp='1000') AS s, max({'open':open,'high':high,'low':low,'close':close}) FILTER (stamp='1015') AS e, max({'open':open,'high':high,'low':low,'close':close}) FILTER (stamp='1045') AS x, max(high) FILTER (stamp>'1015' AND stamp<='1045') AS ph, min(low) FILTER (stamp>'1015' AND stamp<='1045') AS pl FROM bars WHERE stamp>='1000' AND stamp<='1045' GROUP BY 1,2)",
    fin("SELECT symbol, date, up_limit, down_limit, " + ", ".join(f"abs({n}.close-{s}_limit)<=1e-6 AS {w}_close_at_{s}, {_LK.format(n=n, l=s + '_limit')} AS {w}_locked_{s}" for n, w in (("s", "signal"), ("e", "entry"), ("x", "exit")) for s in ("up", "down"))
        + ", ph>=up_limit-1e-6 AS post_entry_touch_up, pl<=down_limit+1e-6 AS post_entry_touch_down FROM b JOIN lm USING (symbol, date)", "up_limit down_limit")))
def s10(spark, sf):
    bars = stage(_bars(spark, sf), "bars")
    limits = bars.groupBy(*DAY).agg(F.max("high").alias("up_limit"), F.min("low").alias("down_limit"))
    return rounded(R.limit_states(bars, limits, "1000", "1015", "1045"))


@query("s14_u03_pending_work", "SELECT DISTINCT l_suppkey AS symbol, strftime(l_shipdate,'%Y%m') AS month FROM lineitem WHERE (l_suppkey, strftime(l_shipdate,'%Y%m')) NOT IN (SELECT DISTINCT l_suppkey, strftime(l_shipdate,'%Y%m') FROM lineitem WHERE l_returnflag='R')")
def s14(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.date_format("l_shipdate", "yyyyMM").alias("month"), "l_returnflag")
    return R.pending_only(li.select("symbol", "month").distinct(), li.filter(F.col("l_returnflag") == "R"))


@query("s14_month_rerun", """SELECT l_suppkey AS symbol, strftime(l_shipdate,'%Y%m') AS month, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2""")
def s14_rerun(spark, sf):
    """A table by month in which every third month was left half done and is run again: each month is replaced once."""
    li = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.date_format("l_shipdate", "yyyyMM").alias("month"), "l_quantity", "l_returnflag")
    out = f"{shared_folder(spark)}/lobloom/months-{uuid.uuid4().hex}"
    done = lambda rows: rows.groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    again = F.col("month").cast("int") % 3 == 0
    R.replace_partitions(done(li.filter(~again | (F.col("l_returnflag") == "N"))), out, ["month"])
    R.replace_partitions(done(li.filter(again)), out, ["month"])
    R.replace_partitions(done(li.filter(again)), out, ["month"])
    back = spark.read.schema("symbol long, n long, quantity long, month string").parquet(out)
    return back.select("symbol", "month", "n", "quantity")


@query("p08_add_class", sql(V, """SELECT s.symbol, s.date, s.row_id, CASE WHEN s.symbol LIKE 'SZ%' OR s.oid IS NULL THEN 'unclassified' WHEN ft<row_id THEN 'aggressive_remainder' ELSE 'genuine_passive' END AS add_class
  FROM sess s LEFT JOIN (SELECT symbol, date, source_side AS sd, oid, min(row_id) AS ft FROM sess WHERE source_action='TRADE' AND oid IS NOT NULL GROUP BY 1,2,3,4) t ON t.symbol=s.symbol AND t.date=s.date AND t.oid=s.oid AND sd=source_side WHERE source_action='ORDER_ADD'"""))
def p08(spark, sf):
    r = impact.classify_adds(sessions(lob(spark, sf)))
    return r.filter(F.col("source_action") == "ORDER_ADD").select(*DAY, "row_id", "add_class")


@query("p11_domains", sql(STUDY, "SELECT date, domain, count(*) AS n FROM study GROUP BY 1,2"))
def p11(spark, sf):
    return study(spark, sf).groupBy("date", "domain").agg(F.count(F.lit(1)).alias("n"))


@query("p12_tradable_universe", sql(V, CONTROLS, "SELECT symbol, date FROM controls WHERE security_category=1 AND is_st=0 AND is_suspended=0 AND listing_days>=10 AND liquidity_history_days>=20"))
def p12(spark, sf):
    return controls(spark, sf).filter(X.tradable()).select(*DAY)


@query("p13_depth_bins", sql(PANEL, "SELECT symbol, date, CASE WHEN style1/100<=0.1 THEN '01_<=0.10' WHEN style1/100<=0.25 THEN '02_0.10-0.25' WHEN style1/100<=0.5 THEN '03_0.25-0.50' WHEN style1/100<=1 THEN '04_0.50-1.00' ELSE '05_>1.00' END AS depth_bin FROM panel"))
def p13(spark, sf):
    return panel(spark, sf).select(*DAY, (F.col("style1") / 100).alias("relative_depth")).select(*DAY, summaries.depth_bin().alias("depth_bin"))


@query("j03_j16_order_audit", sql(V, """t AS (SELECT symbol, date, source_side AS side, oid, min(row_id) AS ft, sum(source_volume)::BIGINT AS tq, count(*) AS tn FROM sess WHERE source_action='TRADE' AND oid IS NOT NULL AND source_volume>0 GROUP BY 1,2,3,4)""",
    "a AS (SELECT symbol, date, source_side AS side, oid, min(row_id) AS fa, sum(source_volume)::BIGINT AS aq, count(*) AS an FROM sess WHERE source_action='ORDER_ADD' AND oid IS NOT NULL AND source_volume>0 GROUP BY 1,2,3,4)",
    "k AS (SELECT *, CASE WHEN ft IS NULL THEN 'passive_only' WHEN fa IS NULL THEN 'trade_only_active' WHEN ft<fa THEN 'posttrade_remainder' WHEN fa<ft THEN 'pretrade_active_add' ELSE 'same_row_unresolved' END AS cl FROM t FULL JOIN a USING (symbol,date,side,oid))",
    "x AS (SELECT k.*, coalesce((SELECT sum(source_volume) FROM sess e WHERE e.source_action='TRADE' AND e.symbol=k.symbol AND e.date=k.date AND e.source_side=k.side AND e.oid=k.oid AND e.row_id<k.fa),0)::BIGINT AS iq FROM k)",
    """SELECT symbol, date, side, oid AS order_id, cl AS classification, fa AS first_add_row, ft AS first_trade_row, coalesce(aq,0) AS add_qty, coalesce(tq,0) AS active_trade_qty, iq AS immediate_trade_qty, coalesce(an,0) AS add_events, coalesce(tn,0) AS trade_events,
     CASE cl WHEN 'posttrade_remainder' THEN aq+iq WHEN 'trade_only_active' THEN tq ELSE aq END AS reconstructed_submit_qty FROM x"""))
def f40(spark, sf):
    return summaries.order_audit(lob(spark, sf))


@query("f40_audit_summary", sql(V, """k AS (SELECT symbol, date, source_side AS side, oid, min(row_id) FILTER (source_action='TRADE') AS ft, min(row_id) FILTER (source_action='ORDER_ADD') AS fa, coalesce(sum(source_volume) FILTER (source_action='TRADE'),0) AS tq,
     coalesce(sum(source_volume) FILTER (source_action='ORDER_ADD'),0) AS aq FROM sess WHERE source_action IN ('TRADE','ORDER_ADD') AND oid IS NOT NULL GROUP BY 1,2,3,4)""",
    "i AS (SELECT k.symbol, k.date, side, k.oid, sum(source_volume) AS iq FROM k JOIN sess e ON e.source_action='TRADE' AND e.symbol=k.symbol AND e.date=k.date AND e.source_side=k.side AND e.oid=k.oid AND e.row_id<fa GROUP BY 1,2,3,4)",
    "c AS (SELECT *, CASE WHEN ft IS NULL THEN 'passive_only' WHEN fa IS NULL THEN 'trade_only_active' WHEN ft<fa THEN 'posttrade_remainder' ELSE 'pretrade_active_add' END AS classification FROM k LEFT JOIN i USING (symbol,date,side,oid))",
    "SELECT left(symbol,2) AS exchange, classification, count(*) AS orders, sum(CASE classification WHEN 'posttrade_remainder' THEN aq+coalesce(iq,0) WHEN 'trade_only_active' THEN tq ELSE aq END)::BIGINT AS submitted, count(*) FILTER (classification='pretrade_active_add' AND tq>aq) AS over_executed FROM c GROUP BY 1,2"))
def f40b(spark, sf):
    return summaries.audit_summary(summaries.order_audit(lob(spark, sf)))


@query("f40_p03_book_quality", sql(V, "SELECT symbol, date, 0::BIGINT AS clock_breaks, count(*) FILTER (bid_px[1] IS NULL OR ask_px[1] IS NULL OR bid_px[1]<=0 OR ask_px[1]<=0) AS missing_books, count(*) FILTER (bid_px[1]=ask_px[1]) AS locked_books, count(*) FILTER (bid_px[1]>ask_px[1]) AS crossed_books, count(*) FILTER (bid_px[1]<ask_px[1]) AS valid_books FROM lob GROUP BY 1,2"))
def f40c(spark, sf):
    return summaries.book_quality(lob(spark, sf))


@query("j04_w04_match_passive", sql(V, """e AS (SELECT symbol, date, source_side AS side, oid, min(row_id) AS er FROM sess WHERE source_action='ORDER_ADD' AND oid IS NOT NULL AND source_price>0 GROUP BY 1,2,3,4)""",
    "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date, source_recid, CASE WHEN source_recid IS NULL THEN row_id END ORDER BY row_id) AS k FROM sess WHERE source_action='TRADE' AND source_volume>0) WHERE k=1)",
    "SELECT t.symbol, t.date, t.row_id, er IS NOT NULL AS is_matched FROM t LEFT JOIN e ON e.symbol=t.symbol AND e.date=t.date AND e.oid=t.pid AND e.side<>t.source_side AND er<t.row_id"))
def j04(spark, sf):
    rows = sessions(lob(spark, sf))
    pre = L.prebook(rows, "strict")
    trades = L.trades_once(rows.drop("bid_px", "ask_px", "bid_vol", "ask_vol", "bid_cnt", "ask_cnt"))
    return L.match_passive(trades, L.entry_gaps(pre)).select(*DAY, "row_id", "is_matched")


@query("j09_w01_event_clock_shift", sql(V, fin("SELECT symbol, date, row_id, lag(mid,1) OVER w AS prev_mid, lead(mid,5) OVER w AS mid_5, lead(mid,20) OVER w AS mid_20 FROM sess WHERE mid IS NOT NULL WINDOW w AS (PARTITION BY symbol, date, session ORDER BY row_id)", "prev_mid mid_5 mid_20")))
def j09(spark, sf):
    e = sessions(lob(spark, sf)).filter(X.book_ok("strict"))
    v = dense_order(e.select(*DAY, "session", "row_id", ((X.best("bid").cast("double") + X.best("ask")) / 2.0).alias("mid")))
    r = shift_dense(v, [*DAY, "session"], "seq", {"prev_mid": (F.col("mid"), -1), "mid_5": (F.col("mid"), 5), "mid_20": (F.col("mid"), 20)}, span=64)
    return rounded(r.select(*DAY, "row_id", "prev_mid", "mid_5", "mid_20"))


def _asof_sql(op: str, shift: int) -> str:
    pick = "arg_min" if op == "<=" else "arg_max"
    return sql(V, f"v AS (SELECT symbol, date, session, ms, {pick}(mid,row_id) AS m FROM sess WHERE mid IS NOT NULL GROUP BY 1,2,3,4)",
               f"p AS (SELECT symbol, date, session, row_id, ms+({shift}) AS t FROM sess WHERE source_action='TRADE')",
               fin(f"SELECT p.symbol, p.date, p.row_id, v.m AS found_mid, v.ms AS found_ms FROM p ASOF LEFT JOIN v ON p.symbol=v.symbol AND p.date=v.date AND p.session=v.session AND p.t{op}v.ms", "found_mid"))


def _asof(spark, sf, direction, shift):
    e = sessions(lob(spark, sf)).withColumn("ms", X.clock_ms())
    v = e.filter(X.book_ok("strict")).select(*DAY, "session", "row_id", "ms", ((X.best("bid").cast("double") + X.best("ask")) / 2.0).alias("mid"))
    p = e.filter(F.col("source_action") == "TRADE").select(*DAY, "session", "row_id", (F.col("ms") + shift).alias("t"))
    r = asof(p, v, [*DAY, "session"], "t", "ms", {"found_mid": F.col("mid")}, direction=direction)
    return rounded(r.select(*DAY, "row_id", "found_mid", F.col("t_hit").alias("found_ms")))


@query("j10_asof_forward", _asof_sql("<=", 60000))
def j10(spark, sf):
    return _asof(spark, sf, "forward", 60000)


@query("j11_asof_backward", _asof_sql(">=", -60000))
def j11(spark, sf):
    return _asof(spark, sf, "backward", -60000)


@query("j12_previous_market_day", sql(PANEL, "c AS (SELECT date, row_number() OVER (ORDER BY date) AS dn FROM (SELECT DISTINCT date FROM panel))", "x AS (SELECT symbol, date, dn, style1 FROM panel JOIN c USING (date))",
    fin("SELECT a.symbol, a.date, b.date AS control_date, b.style1 AS prev_style1 FROM x a JOIN x b ON a.symbol=b.symbol AND b.dn=a.dn-1", "prev_style1")))
def j12(spark, sf):
    p = panel(spark, sf).select(*DAY, "style1").join(L.calendar(panel(spark, sf)), "date")
    prior = p.select("symbol", (F.col("day_seq") + 1).alias("day_seq"), F.col("date").alias("control_date"), F.col("style1").alias("prev_style1"))
    return rounded(p.select(*DAY, "day_seq").join(prior, ["symbol", "day_seq"]).drop("day_seq"))


@query("j17_w24_lagged_panel", sql(PANEL, fin("SELECT symbol, date, cap, lag(cap) OVER w AS prev_cap, price, lag(style1) OVER w AS prev_style1 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)", "cap prev_cap price prev_style1")))
def j17(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    return rounded(panel(spark, sf).select(*DAY, "cap", F.lag("cap").over(w).alias("prev_cap"), "price", F.lag("style1").over(w).alias("prev_style1")))


@query("a04_group_quantiles", sql(PANEL, fin("SELECT date, quantile_cont(factor,0.1) AS p10, median(factor) AS p50, quantile_cont(factor,0.9) AS p90 FROM panel GROUP BY 1", "p10 p50 p90")))
def a04(spark, sf):
    return rounded(C.exact_quantiles(panel(spark, sf), ["date"], "factor", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


@query("a06_a13_concentration", sql(PANEL, "s AS (SELECT date, exchange, depth/sum(depth) OVER (PARTITION BY date, exchange) AS s FROM panel WHERE depth>0)",
    fin("SELECT date, exchange, sum(s*s) AS hhi, -sum(s*ln(s)) AS entropy, max(s) AS largest_share FROM s GROUP BY 1,2", "hhi entropy largest_share")))
def a13(spark, sf):
    return rounded(primitives.concentration(panel(spark, sf), ["date", "exchange"], "depth"))


@query("a10_pivot", sql(PANEL, fin("SELECT date, sum(depth) FILTER (exchange='SH') AS SH, sum(depth) FILTER (exchange='SZ') AS SZ FROM panel GROUP BY 1", "SH SZ")))
def a10(spark, sf):
    return rounded(panel(spark, sf).groupBy("date").pivot("exchange", ["SH", "SZ"]).agg(F.sum("depth")))


@query("a20_event_gap", sql(PANEL, "e AS (SELECT *, CASE WHEN style5<4 THEN 1 WHEN style5>26 THEN -1 ELSE 0 END AS ev FROM panel)",
    fin("SELECT date, avg(ret) FILTER (ev=1)-avg(ret) FILTER (ev=0) AS positive_gap, avg(ret) FILTER (ev=-1)-avg(ret) FILTER (ev=0) AS negative_gap, count(*) FILTER (ev<>0) AS n_events, count(*) AS n FROM e GROUP BY 1", "positive_gap negative_gap")))
def a20(spark, sf):
    ev = F.when(F.col("style5") < 4, 1).when(F.col("style5") > 26, -1).otherwise(0)
    return rounded(E.event_gap(panel(spark, sf).withColumn("ev", ev), ["date"], "ev", "ret"))


@query("w07_ntile", sql(PANEL, "SELECT symbol, date, ntile(3) OVER (PARTITION BY date ORDER BY price, symbol)::INTEGER AS tile FROM panel"))
def w07(spark, sf):
    p = C.position(panel(spark, sf).select(*DAY, "price"), ["date"], [F.col("price"), F.col("symbol")], out="p", total="n")
    return p.select(*DAY, summaries.ntile(F.col("p"), F.col("n"), 3).alias("tile"))


@query("w11_own_history", sql(PANEL, "h AS (SELECT symbol, date, factor, list(factor) OVER w AS l, avg(factor) OVER w AS m, stddev_pop(factor) OVER w AS s FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))",
    fin("SELECT symbol, date, coalesce(len(l),0) AS history_n, CASE WHEN len(l)>=8 THEN CASE WHEN s>0 THEN (factor-m)/s ELSE 0 END END AS history_z, CASE WHEN len(l)>=8 THEN (len(list_filter(l, lambda x: x<factor))+0.5*len(list_filter(l, lambda x: x=factor)))::DOUBLE/len(l) END AS history_rank FROM h", "history_z history_rank")))
def w11(spark, sf):
    return rounded(H.lagged_z_and_rank(panel(spark, sf).select(*DAY, "factor"), ["symbol"], "factor", 24, 8).drop("factor"))


@query("w20_w21_rank_conventions", sql(PANEL, fin("SELECT symbol, date, " + f"{avg_rank('depth', 'date')} AS rank, " + ", ".join(f"{pct('depth', 'date', m)} AS r_{m}" for m in ("pct_half", "pct_zero", "open", "centred", "pos")) + " FROM panel",
    "rank r_pct_half r_pct_zero r_open r_centred r_pos")))
def w21(spark, sf):
    p = panel(spark, sf).select(*DAY, "depth")
    r = C.average_rank(p, ["date"], "depth", "rank")
    for m in ("pct_half", "pct_zero", "open", "centred"):
        r = r.withColumn(f"r_{m}", C.rank_score("rank", "rank_n", m))
    pos = C.percentile_rank(p, ["date"], "depth", "pos", out="r_pos").select(*DAY, "r_pos")
    return rounded(r.drop("depth", "rank_n").join(pos, DAY))


@query("w22_w23_buckets", sql(PANEL, "r AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY depth, symbol) AS p, count(*) OVER (PARTITION BY date) AS n FROM panel)",
    "SELECT symbol, date, (7*(p-1)//n)::INTEGER AS bucket, ceil(10.0*p/n)::INTEGER AS decile FROM r"))
def w22(spark, sf):
    p = panel(spark, sf).select(*DAY, "depth")
    a = C.equal_buckets(p, ["date"], "depth", 7).select(*DAY, "bucket")
    return a.join(C.slice_deciles(p, ["date"], "depth").select(*DAY, "decile"), DAY)


@query("t02_top_bottom", sql(PANEL, "r AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY depth, symbol) AS p, count(*) OVER (PARTITION BY date) AS n FROM panel)", "SELECT symbol, date, CASE WHEN p<=5 THEN 'bottom' ELSE 'top' END AS side FROM r WHERE p<=5 OR p>n-5"))
def t02(spark, sf):
    p = C.position(panel(spark, sf).select(*DAY, "depth"), ["date"], [F.col("depth"), F.col("symbol")], out="p", total="n")
    return p.filter((F.col("p") <= 5) | (F.col("p") > F.col("n") - 5)).select(*DAY, F.when(F.col("p") <= 5, "bottom").otherwise("top").alias("side"))


@query("t03_hashed_sample", sql(PANEL, "SELECT symbol FROM (SELECT DISTINCT symbol FROM panel) ORDER BY sha256('seed|' || symbol), symbol LIMIT 20"))
def t03(spark, sf):
    s = panel(spark, sf).select("symbol").distinct()
    return s.orderBy(F.sha2(F.concat(F.lit("seed|"), F.col("symbol")), 256), "symbol").limit(20)


@query("t04_first_rows", sql(V, "SELECT symbol, date, row_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY row_id) AS k FROM sess) WHERE k<=3"))
def t04(spark, sf):
    e = sessions(lob(spark, sf)).select(*DAY, "row_id")
    return C.position(e, DAY, [F.col("row_id")], out="k").filter(F.col("k") <= 3).drop("k")


@query("u01_u02_unions", sql(V, "SELECT symbol, date, src FROM (SELECT DISTINCT symbol, date, 'trade' AS src FROM sess WHERE source_action='TRADE' UNION ALL SELECT DISTINCT symbol, date, 'add' FROM sess WHERE source_action='ORDER_ADD') UNION SELECT symbol, date, 'any' FROM sess"))
def u01(spark, sf):
    e = sessions(lob(spark, sf))
    parts = [e.filter(F.col("source_action") == a).select(*DAY, F.lit(n).alias("src")) for a, n in (("TRADE", "trade"), ("ORDER_ADD", "add"))]
    return parts[0].unionByName(parts[1]).unionByName(e.select(*DAY, F.lit("any").alias("src"))).distinct()


DOMAINS = [f"{c}_{p}" for c in ("low", "mid", "high") for p in ("lt10", "ge10", "star")]


@query("f39_stratified_symbols", sql(STUDY, "un AS (SELECT symbol, arg_max(domain, date) AS domain, left(symbol,2) AS exchange FROM study GROUP BY symbol)",
    "qt AS (SELECT * FROM (VALUES " + ",".join(f"('{d}',{4 + int(i < 4)})" for i, d in enumerate(DOMAINS)) + ") v(domain,quota))",
    "x AS (SELECT *, row_number() OVER (PARTITION BY domain, exchange ORDER BY sha256(domain || '|' || symbol), symbol) AS k, CASE WHEN domain LIKE '%star' THEN quota ELSE CASE WHEN exchange='SH' THEN quota//2 + CASE WHEN quota%2=1 AND right(sha256(domain),1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE 0 END ELSE quota - quota//2 - CASE WHEN quota%2=1 AND right(sha256(domain),1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE 0 END END END AS tg FROM un JOIN qt USING (domain))",
    "g AS (SELECT domain, count(*) FILTER (k<=tg) AS got FROM x GROUP BY 1)", "r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sha256(domain || '|fill|' || symbol), symbol) AS rk FROM x WHERE k>tg)",
    "SELECT domain, symbol, exchange FROM x WHERE k<=tg UNION ALL SELECT domain, symbol, exchange FROM r JOIN g USING (domain) WHERE rk<=quota-got"))
def f39(spark, sf):
    un = study(spark, sf).groupBy("symbol").agg(F.max_by("domain", "date").alias("domain"))
    return summaries.stratified_symbols(un, 40, DOMAINS)


_CD = """SELECT symbol, date, coalesce(m.n, 0) AS multi_chain_rows, a.* EXCLUDE (symbol, date, vol), a.vol::DOUBLE AS chain_volume, m.vol/a.vol::DOUBLE AS multi_chain_volume_share, m.mean_multi_duration, m.median_multi_duration, m.p90_multi_duration
  FROM (SELECT symbol, date, count(*) AS chain_rows, sum(volume) AS vol, sum(trade_count)/count(*)::DOUBLE AS mean_fragments, median(trade_count)::DOUBLE AS median_fragments, quantile_cont(trade_count, 0.9)::DOUBLE AS p90_fragments,
      sum(acceleration_seconds)/count(acceleration_seconds) AS mean_acceleration, count(acceleration_seconds) AS acceleration_rows FROM chr GROUP BY 1,2) a
  LEFT JOIN (SELECT symbol, date, count(*) AS n, sum(volume) AS vol, sum(duration_seconds)/count(duration_seconds) AS mean_multi_duration, median(duration_seconds) AS median_multi_duration, quantile_cont(duration_seconds, 0.9) AS p90_multi_duration
      FROM chr WHERE trade_count>1 GROUP BY 1,2) m USING (symbol, date)"""


@query("f36_chain_day", sql(V, PW, CH, fin(_CD, "chain_volume multi_chain_volume_share mean_fragments median_fragments p90_fragments mean_multi_duration median_multi_duration p90_multi_duration mean_acceleration")))
def f36a(spark, sf):
    return rounded(summaries.chain_day(primitives.primitives(lob(spark, sf))["chains"]))


@query("f36_quote_tables", sql(V, PW, QT, "qb AS (SELECT *, CASE WHEN relative_depth<=0.1 THEN '01_<=0.10' WHEN relative_depth<=0.25 THEN '02_0.10-0.25' WHEN relative_depth<=0.5 THEN '03_0.25-0.50' WHEN relative_depth<=1 THEN '04_0.50-1.00' ELSE '05_>1.00' END AS depth_bin FROM qlf WHERE relative_depth>=0)",
    fin("""SELECT * FROM (SELECT symbol, date, depth_bin, count(*) AS quote_events, sum(relative_depth)/count(*) AS mean_relative_depth, sum(rehit)/count(*)::DOUBLE AS rehit_share, sum(censored_at_signal)/count(*)::DOUBLE AS censored_share FROM qb GROUP BY ALL)
      LEFT JOIN (SELECT symbol, date, depth_bin, avg(restored_pre_event_book) AS restored_share_closed, avg(CASE WHEN removal_action='TRADE' THEN 1 WHEN removal_action IS NOT NULL THEN 0 END) AS trade_removal_share_closed,
          avg(lifetime_seconds) AS mean_lifetime_closed, median(lifetime_seconds)::DOUBLE AS median_lifetime_closed FROM qb WHERE censored_at_signal=0 GROUP BY ALL) USING (symbol, date, depth_bin)""",
        "mean_relative_depth rehit_share restored_share_closed trade_removal_share_closed censored_share mean_lifetime_closed median_lifetime_closed")))
def f36b(spark, sf):
    return rounded(summaries.quote_day_bin(primitives.primitives(lob(spark, sf))["quotes"]))


@query("f36_quote_day", sql(V, PW, QT, fin("""SELECT symbol, date, count(*) AS quote_events, sum(thin) AS thin_quote_events, count(*) FILTER (relative_depth<=0.1) AS ultra_thin_quote_events, sum(thin)/count(*)::DOUBLE AS thin_quote_share,
    sum(relative_depth)/count(*) AS relative_depth_mean, avg(rehit) FILTER (thin=1) AS thin_rehit_share, avg(restored_pre_event_book) FILTER (thin=1 AND censored_at_signal=0) AS thin_restored_share_closed, avg(censored_at_signal) FILTER (thin=1) AS thin_censored_share
  FROM (SELECT *, CASE WHEN relative_depth<0.5 THEN 1 ELSE 0 END::BIGINT AS thin FROM qlf WHERE relative_depth>=0) GROUP BY 1,2""".replace("sum(thin) AS", "sum(thin)::BIGINT AS"),
    "thin_quote_share relative_depth_mean thin_rehit_share thin_restored_share_closed thin_censored_share")))
def f36_day(spark, sf):
    return rounded(summaries.quote_day_features(primitives.primitives(lob(spark, sf))["quotes"]))


_HZ = (5, 30, 60)
SG = SIG + f""",
sgr AS (SELECT * REPLACE ({', '.join(f'coalesce({x},0) AS {x}' for x in _SC)}) FROM sj),
cpx AS (SELECT symbol, date, close_1000 AS price, lag(cap) OVER (PARTITION BY symbol ORDER BY date) AS lag_cap FROM controls),
enr AS (SELECT *, ntile(3) OVER (PARTITION BY date ORDER BY price, symbol)::INTEGER AS price_tercile, ntile(3) OVER (PARTITION BY date ORDER BY lag_cap, symbol)::INTEGER AS cap_tercile FROM sgr JOIN cpx USING (symbol,date) WHERE price>0 AND lag_cap>0),
ftr AS (SELECT symbol, date, price, lag_cap, price_tercile, cap_tercile, (price_tercile=1 AND cap_tercile=3)::INTEGER AS low_price_large_cap, {', '.join(f"directional_immediate_impact_mean_{h}s/price AS immediate_bps_{h}s, directional_retained_impact_mean_{h}s/price AS retained_bps_{h}s, directional_retained_impact_mean_{h}s/price-directional_immediate_impact_mean_{h}s/price AS drift_bps_{h}s, impact_reversal_share_{h}s AS reversal_share_{h}s, impact_observations_{h}s AS observations_{h}s" for h in _HZ)} FROM enr),
lgh AS ({' UNION ALL '.join(f"SELECT symbol, date, {h} AS horizon, observations_{h}s AS ob, immediate_bps_{h}s AS i, retained_bps_{h}s AS r, reversal_share_{h}s AS v FROM ftr WHERE observations_{h}s>0" for h in _HZ)})"""
_FD = "price lag_cap " + " ".join(f"immediate_bps_{h}s retained_bps_{h}s drift_bps_{h}s reversal_share_{h}s" for h in _HZ)


def _features(spark, sf):
    sig = stage(primitives.signal_row(primitives.primitives(lob(spark, sf))), "signals")
    ct = controls(spark, sf)
    enriched = stage(summaries.enriched_signals(sig, ct), "enriched")
    return sig, ct, enriched, summaries.impact_features(enriched)


@query("f36_impact_features", sql(V, CONTROLS, PW, CH, RT, QT, SG, fin("SELECT * FROM ftr", _FD)))
def f36c(spark, sf):
    return rounded(_features(spark, sf)[3])


@query("f37_a08_retention_summary", sql(V, CONTROLS, PW, CH, RT, QT, SG, "bd AS (SELECT date, horizon, count(*) AS st, sum(ob) AS ob, avg(i) AS i, avg(r) AS r, avg(v) AS v FROM lgh GROUP BY 1,2)",
    "lb AS (SELECT (date//100)::VARCHAR AS month, * FROM bd UNION ALL SELECT 'ALL', * FROM bd)",
    fin("SELECT month, horizon, count(*) AS dates, sum(st)::BIGINT AS stock_days, sum(ob)::BIGINT AS observations, avg(i) AS date_equal_immediate_bps, avg(r) AS date_equal_retained_bps, avg(r-i) AS date_equal_drift_bps, avg(v) AS date_equal_reversal_share, stddev_samp(r-i)/sqrt(count(*)) AS drift_se, avg(r-i)/(stddev_samp(r-i)/sqrt(count(*))) AS drift_t FROM lb GROUP BY 1,2",
        "date_equal_immediate_bps date_equal_retained_bps date_equal_drift_bps date_equal_reversal_share drift_se drift_t")))
def f37a(spark, sf):
    return rounded(summaries.retention_summary(_features(spark, sf)[3]))


@query("f37_a21_impact_by_exchange", sql(V, CONTROLS, PW, CH, RT, QT, SG, "bd AS (SELECT date, left(symbol,2) AS exchange, horizon, count(*) AS st, sum(ob) AS ob, avg(i) AS ei, avg(r) AS er, sum(i*ob) AS wi, sum(r*ob) AS wr FROM lgh GROUP BY 1,2,3)",
    fin("SELECT exchange, horizon, count(*) AS dates, sum(st)::BIGINT AS stock_days, sum(ob)::BIGINT AS observations, avg(ei) AS stock_day_equal_immediate_bps, avg(er) AS stock_day_equal_retained_bps, sum(wi)/sum(ob) AS event_weighted_immediate_bps, sum(wr)/sum(ob) AS event_weighted_retained_bps FROM bd GROUP BY 1,2",
        "stock_day_equal_immediate_bps stock_day_equal_retained_bps event_weighted_immediate_bps event_weighted_retained_bps")))
def f37b(spark, sf):
    return rounded(summaries.impact_by_exchange(_features(spark, sf)[3]))


@query("f37_price_cap_grid", sql(V, CONTROLS, PW, CH, RT, QT, SG, "bd AS (SELECT date, price_tercile, cap_tercile, count(*) AS st, avg(immediate_bps_5s) AS i, avg(reversal_share_30s) AS r FROM ftr GROUP BY 1,2,3)",
    fin("SELECT price_tercile, cap_tercile, count(*) AS dates, sum(st)::BIGINT AS stock_days, avg(i) AS immediate_bps_5s, avg(r) AS reversal_share_30s FROM bd GROUP BY 1,2", "immediate_bps_5s reversal_share_30s")))
def f37c(spark, sf):
    return rounded(summaries.price_cap_grid(_features(spark, sf)[3]))


@query("f37_a07_quality_summary", sql(V, CONTROLS, PW, CH, RT, QT, SG, "SELECT CASE WHEN grouping(date//100)=1 THEN 'ALL' ELSE (date//100)::VARCHAR END AS month, count(*) AS stock_days, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates, sum(valid_books)::BIGINT AS valid_books, sum(invalid_books)::BIGINT AS invalid_books, sum(chain_count)::BIGINT AS chains FROM sgr GROUP BY GROUPING SETS ((date//100), ())"))
def f37d(spark, sf):
    return summaries.quality_summary(_features(spark, sf)[0])


@query("f37_j18_join_coverage", sql(V, CONTROLS, PW, CH, RT, QT, SG, "SELECT count(*) AS signal_rows, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates, count(price) AS price_covered, count(lag_cap) AS lag_cap_covered, (SELECT count(*) FROM enr) AS fully_enriched_rows, count(*)-count(DISTINCT (symbol,date)) AS duplicate_keys FROM sgr LEFT JOIN cpx USING (symbol,date)"))
def f37e(spark, sf):
    sig, ct, enriched, _ = _features(spark, sf)
    return summaries.join_coverage(sig, ct, enriched)


def _snapshots(spark, sf):
    """Events with per-order queues next to the ladders, from a fixed rule."""
    def flat(side):
        return F.flatten(F.transform(f"{side}_cnt", lambda n, l: F.transform(
            F.sequence(F.lit(1).cast("long"), n), lambda i: 100 * (1 + (F.col("row_id") + l + i) % 4))))

    return lob(spark, sf).withColumns({"bid_ordvol": flat("bid"), "ask_ordvol": flat("ask")})


def _q(row: str, cnt: str, idx: str) -> str:
    return f"[100*(1+({row}+({idx})-1+i)%4) FOR i IN range(1, {cnt}[{idx}]+1)]"


def _sweep(s: str) -> str:
    hit = f"(p{s}[j]>=p{s}[1] AND p{s}[j]<c{s}[1])" if s == "a" else f"(p{s}[j]<=p{s}[1] AND p{s}[j]>c{s}[1])"
    return f"""coalesce(list_sum([list_sum({_q('prow', f'pn{s}', 'j')}) FOR j IN range(1, len(p{s})+1) IF {hit}]),0) AS full_{s},
      len([j FOR j IN range(1, len(p{s})+1) IF {hit}]) AS gone_{s}, len([j FOR j IN range(1, len(p{s})+1) IF {hit} AND list_contains(c{s}, p{s}[j])]) AS still_{s}, list_position(p{s}, c{s}[1]) AS pos_{s}"""


@query("f01_fifo_active_take", sql(V, """sn AS (SELECT symbol, date, row_id, bid_px AS cb, ask_px AS ca, bid_cnt AS cnb, ask_cnt AS cna, ((time>=93000000 AND time<113000000) OR (time>=130000000 AND time<145700000)) AS live,
      lag(row_id) OVER w AS prow, lag(bid_px) OVER w AS pb, lag(ask_px) OVER w AS pa, lag(bid_cnt) OVER w AS pnb, lag(ask_cnt) OVER w AS pna, lag((time>=93000000 AND time<113000000) OR (time>=130000000 AND time<145700000)) OVER w AS plive FROM lob WINDOW w AS (PARTITION BY symbol, date ORDER BY row_id)),
s1 AS (SELECT *, (cb[1]+ca[1])/2.0::DOUBLE-(pb[1]+pa[1])/2.0::DOUBLE AS d FROM sn WHERE prow IS NOT NULL)""",
    f"s2 AS (SELECT *, {_sweep('a')}, {_sweep('b')} FROM s1 WHERE live AND plive AND d<>0)",
    f"s3 AS (SELECT *, CASE WHEN pos_a>0 THEN {_q('prow', 'pna', 'pos_a')} END AS oa, {_q('row_id', 'cna', '1')} AS na, CASE WHEN pos_b>0 THEN {_q('prow', 'pnb', 'pos_b')} END AS ob, {_q('row_id', 'cnb', '1')} AS nb FROM s2)",
    "s4 AS (SELECT *, " + ", ".join(f"CASE WHEN o{s} IS NOT NULL AND list_sum(o{s})>list_sum(n{s}) AND len(n{s})<=len(o{s}) AND o{s}[len(o{s})-len(n{s})+2:]=n{s}[2:] AND n{s}[1]<=o{s}[len(o{s})-len(n{s})+1] THEN list_sum(o{s})-list_sum(n{s}) ELSE 0 END AS part_{s}" for s in "ab") + " FROM s3)",
    "s5 AS (SELECT *, (CASE WHEN d>0 AND ca[1]>pa[1] AND gone_a>0 AND still_a=0 THEN full_a+part_a WHEN d<0 AND cb[1]<pb[1] AND gone_b>0 AND still_b=0 THEN full_b+part_b END)::BIGINT AS q FROM s4)",
    "s6 AS (SELECT symbol, date, count(*) AS mid_moves, count(q) FILTER (q>0) AS ev, coalesce(sum(q) FILTER (q>0),0)::BIGINT AS qq, coalesce(sum(abs(d)) FILTER (q>0),0) AS gp, coalesce(sum(d) FILTER (q>0),0) AS sg, sum(abs(d)) AS al FROM s5 GROUP BY 1,2)",
    fin("SELECT symbol, date, count(*) FILTER (live AND plive) AS transitions, coalesce(any_value(mid_moves),0) AS mid_moves, coalesce(any_value(ev),0) AS active_take_events, coalesce(any_value(qq),0) AS active_take_qty, coalesce(any_value(gp),0)/10000 AS active_take_mid_gap, coalesce(any_value(sg),0)/10000 AS active_take_mid_gap_signed, coalesce(any_value(al),0)/10000 AS all_mid_gap, coalesce(any_value(gp)/nullif(any_value(al),0),0) AS active_take_share FROM s1 LEFT JOIN s6 USING (symbol,date) GROUP BY 1,2",
        "active_take_mid_gap active_take_mid_gap_signed all_mid_gap active_take_share")))
def f01(spark, sf):
    return rounded(summaries.fifo_active_take(_snapshots(spark, sf)))


@query("s12_f01_json_snapshots", ORACLES["f01_fifo_active_take"])
def s12(spark, sf):
    """Snapshots as JSON lines with broken lines among them, read back with their types into the FIFO measure."""
    out = f"{shared_folder(spark)}/lobloom/snapshots-{uuid.uuid4().hex}"
    rows = _snapshots(spark, sf)
    rows.write.json(out)
    spark.range(3).select(F.lit('{"symbol": "SH600000", "row_id": "not a num').alias("value")).write.mode("append").text(out)
    good, _ = R.read_snapshots(spark, out)
    return rounded(summaries.fifo_active_take(good))


@query("p15_full_coverage", sql(V, PR, PRN, BP, FP, WP, fin("SELECT symbol, date, book30m_coverage_ratio, book5m_coverage_ratio FROM wp WHERE book30m_coverage_ratio>=0.999999 AND book5m_coverage_ratio>=0.999999",
    "book30m_coverage_ratio book5m_coverage_ratio")))
def p15(spark, sf):
    """Window paths whose book was known throughout: the gate before every window-path study."""
    full = window_path.full_coverage(window_path.window_path(lob(spark, sf)))
    return rounded(full.select(*DAY, "book30m_coverage_ratio", "book5m_coverage_ratio"))


_XM = ("1030", "1045", "1100", "1445")


@query("x01_fixed_minutes", sql(V, _BARS, "mc AS (SELECT symbol, date, " + ", ".join(f"max(close) FILTER (stamp='{t}') AS c{t}" for t in ("1015", *_XM)) + " FROM bars GROUP BY 1,2)",
    fin("SELECT symbol, date, " + ", ".join(f"c{t}/c1015-1 AS ret_1015_{t}, abs(c{t}/c1015-1) AS abs_ret_1015_{t}" for t in _XM) + " FROM mc WHERE c1015>0",
        " ".join(f"ret_1015_{t} abs_ret_1015_{t}" for t in _XM))))
def x01_minutes(spark, sf):
    return rounded(E.fixed_minute_returns(_bars(spark, sf), "1015", _XM))
