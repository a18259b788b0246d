"""Calendar, text keys and the questions about stocks, managers and the market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import adapter
from checks.context import CheckModel
from checks.oracle import cut, rounded
from checks.registry import check
from checks.settings import PARAMS as P
from tidegauge.functions import text, verdicts
from tidegauge.operators import calendar, holders, identity, positions, reads, resolve

# --- calendar -------------------------------------------------------------------------------------


def _filed_years(m: CheckModel) -> DataFrame:
    return m.table("submissions").select(F.year("filing_date").alias("year")).distinct()


check("quarter_spine", "SELECT * FROM periods")(lambda m: m.plan("periods"))
check(
    "federal_holidays",
    """
SELECT y.year, c.day AS holiday FROM (SELECT DISTINCT year(filing_date) AS year FROM submissions) y
JOIN calendar_days c ON year(c.day) = y.year AND c.closed AND c.isodow <= 5
WHERE NOT (month(c.day) = 12 AND day(c.day) = 31)
UNION ALL
SELECT y.year, CAST(make_date(y.year - 1, 12, 31) AS DATE) FROM (SELECT DISTINCT year(filing_date) AS year FROM submissions) y
WHERE isodow(make_date(y.year, 1, 1)) = 6
""",
)(lambda m: calendar.federal_holidays(_filed_years(m)))
check(
    "filing_deadline",
    "SELECT q.period, q.deadline FROM all_quarters q WHERE q.period IN (SELECT period FROM submissions)",
)(lambda m: calendar.deadlines(m.table("submissions").select("period").distinct()))
check(
    "first_full_period",
    "SELECT w.start, min(q.period) AS period FROM all_quarters q, (SELECT min(window_start) AS start FROM windows) w "
    "WHERE q.deadline >= w.start GROUP BY w.start",
)(lambda m: calendar.first_full_period(m.table("windows")))
check("period_complete", "SELECT period, deadline, complete, data_through FROM periods")(
    lambda m: m.plan("periods").select("period", "deadline", "complete", "data_through")
)
check("scan_filing_windows", "SELECT * FROM windows WHERE window_start >= DATE '2024-06-01'")(
    lambda m: calendar.filing_windows(m.table("raw_submission"), "2024-06-01")
)
check("freshness", "SELECT max(period) AS through, date_diff('day', max(period), DATE '2026-11-01') AS age_days FROM periods")(
    lambda m: calendar.freshness(m.table("periods"), "period", F.to_date(F.lit("2026-11-01")))
)

# --- text keys over whole tables --------------------------------------------------------------------

check(
    "share_lines",
    "SELECT CUSIP, SSHPRNAMTTYPE, count(*) AS lines, count(DISTINCT ACCESSION_NUMBER) AS filings FROM share_lines GROUP BY ALL",
)(
    lambda m: positions.share_lines(m.table("raw_infotable"))
    .groupBy("CUSIP", "SSHPRNAMTTYPE")
    .agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("ACCESSION_NUMBER").alias("filings"))
)
check(
    "valid_cusip",
    f"""
SELECT period, count(*) FILTER (good) AS valid, count(*) FILTER (NOT good) AS invalid FROM (
    SELECT period, regexp_matches(cusip, '^[0-9A-Z*@#]{{8}}[0-9]$') AND
           (10 - list_sum([v // 10 + v % 10 FOR v IN [(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#', cusip[i]) - 1)
               * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END FOR i IN range(1, 9)]]) % 10) % 10 = CAST(cusip[9] AS INTEGER) AS good
    FROM cusip_holders)
GROUP BY period
""",
)(lambda m: resolve.invalid_by_period(m.table("cusip_holders")))
_RAW_TICKERS = (
    "(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) || '.b' ELSE ' /' || p_type || '/A ' END AS raw FROM part)"
)


def _raw_tickers(m: CheckModel) -> DataFrame:
    n = F.col("p_partkey")
    return m.part.select(
        n,
        F.when(n % 2 == 0, F.concat(F.lower("p_brand"), F.lit(".b")))
        .otherwise(F.concat(F.lit(" /"), F.col("p_type"), F.lit("/A ")))
        .alias("raw"),
    )


check(
    "symbol_key",
    f"SELECT p_partkey, trim(regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '-', 'g'), '-') AS key FROM {_RAW_TICKERS}",
)(lambda m: _raw_tickers(m).select("p_partkey", text.symbol_key(F.col("raw")).alias("key")))
check("compact_key", f"SELECT p_partkey, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS key FROM {_RAW_TICKERS}")(
    lambda m: _raw_tickers(m).select("p_partkey", text.compact_key(F.col("raw")).alias("key"))
)


def _issuers(m: CheckModel) -> DataFrame:
    n = F.col("p_partkey")
    return m.part.select(n, adapter.issuer_name(n, F.col("p_name")).alias("name"))


_ENDINGS = "[" + ", ".join(f"'{e}'" for e in adapter.NAME_ENDINGS) + "]"
ISSUER_SQL = f"""(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'The ' WHEN p_partkey % 7 = 0 THEN 'U.S. ' WHEN p_partkey % 11 = 0
    THEN 'O''Neil ' ELSE '' END || upper(p_name) || ' ' || CAST(p_partkey // 3 AS VARCHAR) || {_ENDINGS}[p_partkey % {len(adapter.NAME_ENDINGS)} + 1]
    AS name FROM part)"""


def stripped(expression: str, times: int = 6) -> str:
    """One trailing word or pair taken off, as often as a name can need it."""
    plain = "|".join((*text.LEGAL_WORDS, *text.CLASS_WORDS))
    spelled = "|".join(" ".join(w) for w in text.LEGAL_WORDS if len(w) in (2, 3))
    for _ in range(times):
        pair = rf"regexp_replace({expression}, '( |^)((CL|CLASS|SER|SERIES) [A-Z0-9]|CAP STK)$', '')"
        word = rf"regexp_replace({pair}, '( |^)({plain})$', '')"
        expression = rf"regexp_replace({word}, '([A-Z0-9]) ({spelled})$', '\1')"
    return expression


def issuer_key_sql(name: str) -> str:
    upper = rf"regexp_replace(upper({name}), '\s*/[A-Z ]{{1,4}}/?\s*$', '')"
    joined = rf"replace(replace({upper}, '&', ' AND '), '''', '')"
    initials = rf"regexp_replace({joined}, '\b([A-Z])\.([A-Z])\b', '\1\2', 'g')"
    words = f"trim(regexp_replace({initials}, '[^A-Z0-9]+', ' ', 'g'))"
    bare = f"regexp_replace({words}, '^THE( |$)', '')"
    return f"replace({stripped(bare)}, ' ', '')"


check("issuer_name_key", f"SELECT p_partkey, {issuer_key_sql('name')} AS key FROM {ISSUER_SQL}")(
    lambda m: _issuers(m).select("p_partkey", text.issuer_name_key(F.col("name")).alias("key"))
)
_SUFFIXES = "(" + ", ".join(f"'{w}'" for w in text.SEARCH_SUFFIXES) + ")"
check(
    "name_search_key",
    f"""
SELECT p_partkey, array_to_string([w FOR w IN regexp_split_to_array(upper(name), '[^0-9A-Z&]+') IF w NOT IN {_SUFFIXES}], '') AS key
FROM {ISSUER_SQL}
""",
)(lambda m: _issuers(m).select("p_partkey", text.name_search_key(F.col("name")).alias("key")))
_CAPITALS = "(" + ", ".join(f"'{w}'" for w in text.CAPITAL_WORDS) + ")"


def display_sql(name: str) -> str:
    """A filed name in title case, word by word."""
    return f"""array_to_string([CASE WHEN regexp_replace(upper(w), '[^A-Z&]', '', 'g') IN {_CAPITALS} THEN upper(w)
    WHEN regexp_matches(w, '[0-9]') THEN w ELSE upper(w[1]) || lower(w[2:]) END
    FOR w IN regexp_split_to_array(trim({name}), '\\s+')], ' ')"""


check("display_name", f"SELECT p_partkey, {display_sql('name')} AS shown FROM {ISSUER_SQL}")(
    lambda m: _issuers(m).select(
        "p_partkey", text.display_name(F.col("name"), F.lit(None).cast("string")).alias("shown")
    )
)
_TYPES = "['Common Stock', 'ETP', 'REIT', 'Open-End Fund', NULL]"
check(
    "security_kind",
    f"""
SELECT p_partkey, CASE WHEN st = 'ETP' THEN 'etf' WHEN st IN ('Common Stock', 'REIT') THEN 'stock' WHEN st IS NOT NULL THEN 'other'
    WHEN list_has_any(string_split(upper(title || ' ' || name), ' '), ['ETF', 'ETFS']) THEN 'etf'
    WHEN list_has_any(string_split(upper(title), ' '), ['NOTE', 'PFD', 'WT', 'UNIT']) THEN 'other' ELSE 'stock' END AS kind
FROM (SELECT p_partkey, p_name AS name, {_TYPES}[p_partkey % 5 + 1] AS st,
             ['COM', 'PFD A', 'SPDR ETF', 'WT EXP', 'UNIT', 'COM UNITED'][p_partkey % 6 + 1] AS title FROM part)
""",
)(
    lambda m: m.part.select(
        "p_partkey",
        "p_name",
        F.element_at(
            F.array(*map(F.lit, ("Common Stock", "ETP", "REIT", "Open-End Fund", None))),
            (F.col("p_partkey") % 5 + 1).cast("int"),
        ).alias("st"),
        F.element_at(
            F.array(*map(F.lit, ("COM", "PFD A", "SPDR ETF", "WT EXP", "UNIT", "COM UNITED"))),
            (F.col("p_partkey") % 6 + 1).cast("int"),
        ).alias("title"),
    ).select("p_partkey", verdicts.security_kind(F.col("st"), F.col("title"), F.col("p_name")).alias("kind"))
)

# --- market-wide reads ------------------------------------------------------------------------------


def _sp(m: CheckModel) -> tuple[DataFrame, DataFrame]:
    return m.table("stock_periods"), m.table("stocks")


def _default(m: CheckModel) -> DataFrame:
    return calendar.default_period(m.table("periods"))


_CHANGE_FLOATS = "funds_pct filers_pct vs_tide_pts market_median_pct vs_median_pts shares_pct"
_CHANGE_COLUMNS = """cusip, name_filed, name_mixed, title_of_class, ticker, security_type, kind, ticker_source, ticker_as_of,
    funds_holding AS funds, funds_prev, funds_change, funds_pct, filers_pct, vs_tide_pts, market_median_pct, vs_median_pts, shares,
    shares_prev, shares_pct, share_check, streak, direction"""
for _name, _by, _most, _kind, _rule in (
    ("ranked_changes", "tide", "added", "all", "vs_tide_pts > 0 ORDER BY vs_tide_pts DESC"),
    ("ranked_changes_lost", "tide", "lost", "all", "vs_tide_pts < 0 ORDER BY vs_tide_pts"),
    ("ranked_changes_by_count", "count", "added", "stocks", "funds_change > 0 AND kind = 'stock' ORDER BY funds_change DESC"),
    ("ranked_changes_etfs", "count", "lost", "etfs", "funds_change < 0 AND kind = 'etf' ORDER BY funds_change"),
):
    check(
        _name,
        rounded(
            f"(SELECT {_CHANGE_COLUMNS} FROM compared_stocks WHERE period = (SELECT period FROM default_period) AND {_rule}, cusip LIMIT 10)",
            _CHANGE_FLOATS,
        ),
    )(
        lambda m, by=_by, most=_most, kind=_kind: reads.ranked_changes(
            *_sp(m), _default(m), P.min_funds, by, most, kind, 10
        )
    )
check(
    "change_summary",
    f"""
SELECT t.period, count(c.cusip) AS stocks, count(*) FILTER (c.funds_change > 0) AS more, count(*) FILTER (c.funds_change < 0) AS fewer,
       {cut("median(c.funds_pct)", "median_pct")}, t.filers, {cut("t.filers_pct", "filers_pct")}
FROM tide t LEFT JOIN compared_stocks c ON c.period = t.period GROUP BY t.period, t.filers, t.filers_pct
""",
)(lambda m: reads.change_summary(*_sp(m), m.table("periods"), m.table("filers_total"), P.min_funds))
check(
    "kind_counts",
    """
SELECT period, kind, count(*) AS stocks FROM compared_stocks GROUP BY period, kind
UNION ALL SELECT period, 'all', count(*) FROM compared_stocks GROUP BY period
""",
)(lambda m: reads.kind_counts(*_sp(m), P.min_funds))
check(
    "periods_overview",
    f"""
SELECT t.period, t.seq, t.prev_period, t.filers, {cut("t.filers_pct", "filers_pct")}, d.label, d.deadline, d.complete, d.data_through,
       {cut("s.market_median_pct", "stock_pct")}, s.market_median_stocks AS stock_count,
       {cut("e.market_median_pct", "etf_pct")}, e.market_median_stocks AS etf_count
FROM tide t JOIN periods d ON d.period = t.period
LEFT JOIN typical_changes s ON s.period = t.period AND s.kind = 'stock'
LEFT JOIN typical_changes e ON e.period = t.period AND e.kind = 'etf'
""",
)(
    lambda m: reads.periods_overview(m.table("periods"), m.table("filers_total"), m.table("stock_periods"))
    .withColumns(
        {
            "stock_pct": F.col("typical")["stock"]["pct"],
            "stock_count": F.col("typical")["stock"]["stocks"],
            "etf_pct": F.col("typical")["etf"]["pct"],
            "etf_count": F.col("typical")["etf"]["stocks"],
        }
    )
    .drop("typical")
)
check(
    "security_lookup",
    """
SELECT s.cusip, s.stock, s.latest_period, coalesce(t.name_filed, s.name_filed) AS name_filed, coalesce(t.name_mixed, s.name_mixed) AS name_mixed,
       coalesce(t.title_of_class, s.title_of_class) AS title_of_class, coalesce(t.figi, s.figi) AS figi, t.ticker, t.security_type,
       coalesce(t.kind, 'stock') AS kind, t.ticker_source, t.ticker_as_of
FROM securities s LEFT JOIN stocks t ON t.cusip = s.stock
""",
)(lambda m: identity.security_lookup(m.table("securities"), m.table("stocks")))
check(
    "earlier_cusips",
    f"""
SELECT k.stock, c.period, d.label, c.old_cusip, c.new_cusip, {cut("c.exchange_ratio", "exchange_ratio")}, c.moved, c.departed, s.name_filed, s.name_mixed
FROM cusip_changes c, stock_keys k, periods d, securities s
WHERE k.cusip = c.old_cusip AND d.period = c.period AND s.cusip = c.old_cusip
""",
)(
    lambda m: identity.earlier_cusips(
        m.table("cusip_changes"), m.table("stock_keys"), m.table("periods"), m.table("securities")
    )
)

# --- per stock ----------------------------------------------------------------------------------------

_SERIES_FLOATS = (
    "funds_pct filers_pct share_of_filers market_median_pct vs_tide_pts vs_median_pts shares_pct value_pct price_pct "
    "shares_vs_value_pts median_price bought_value sold_value net_flow"
)


def _series(m: CheckModel) -> DataFrame:
    return m.derived(
        "stock_series",
        lambda: reads.stock_series(
            m.table("stock_periods"), m.table("holders"), m.table("periods"), m.table("filers_total")
        ),
    )


# shares_prev is a whole number in a series
check("stock_series", rounded("stock_series", _SERIES_FLOATS))(
    lambda m: reads.stock_series(
        m.table("stock_periods"), m.table("holders"), m.table("periods"), m.table("filers_total")
    )
)
check("series_restreak", "SELECT cusip, period, direction, streak FROM stock_series")(
    lambda m: reads.series_restreak(_series(m).drop("direction", "streak")).select(
        "cusip", "period", "direction", "streak"
    )
)
check("streak", "SELECT cusip, seq, direction, streak FROM stock_periods")(
    lambda m: holders.streaks(m.table("stock_periods").select("cusip", "seq", "direction"))
)
check(
    "trailing_flow_run",
    f"""
SELECT cusip, max(period) AS period, CAST(max_by(sgn, period) AS INTEGER) AS sign,
       count(*) FILTER (period > coalesce(last_other, DATE '1900-01-01')) AS run, {cut("max_by(net_flow, period)", "net_flow")}
FROM (SELECT *, max(CASE WHEN sgn <> latest THEN period END) OVER (PARTITION BY cusip) AS last_other
      FROM (SELECT *, sign(net_flow) AS sgn, last_value(sign(net_flow)) OVER (PARTITION BY cusip ORDER BY period
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest
            FROM stock_series WHERE net_flow IS NOT NULL))
GROUP BY cusip
""",
)(lambda m: reads.trailing_flow_run(_series(m)))
check(
    "peak_low_distance",
    """
SELECT l.cusip, l.funds, if(l.funds < p.funds, 'peak', 'low') AS from_kind, if(l.funds < p.funds, p.period, w.period) AS from_period,
       if(l.funds < p.funds, p.funds, w.funds) AS from_funds, l.funds - if(l.funds < p.funds, p.funds, w.funds) AS distance
FROM (SELECT cusip, funds, period FROM stock_series QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY period DESC) = 1) l
JOIN (SELECT s.cusip, s.funds, s.period FROM stock_series s WHERE s.period < (SELECT max(period) FROM stock_series z WHERE z.cusip = s.cusip)
      QUALIFY row_number() OVER (PARTITION BY s.cusip ORDER BY s.funds DESC, s.period DESC) = 1) p ON p.cusip = l.cusip
JOIN (SELECT s.cusip, s.funds, s.period FROM stock_series s WHERE s.period < (SELECT max(period) FROM stock_series z WHERE z.cusip = s.cusip)
      QUALIFY row_number() OVER (PARTITION BY s.cusip ORDER BY s.funds, s.period) = 1) w ON w.cusip = l.cusip
""",
)(lambda m: reads.peak_low_distance(_series(m)))
check(
    "ahead_of_kind_count",
    """
SELECT cusip, count(*) AS compared, count(*) FILTER (vs_median_pts > 0) AS ahead
FROM (SELECT cusip, vs_median_pts FROM stock_series WHERE vs_median_pts IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY period DESC) <= 8) GROUP BY cusip
""",
)(lambda m: reads.ahead_of_kind_count(_series(m)))
check(
    "change_over_span",
    f"""
SELECT a.cusip, a.period AS first_period, z.period AS latest_period, z.seq - a.seq AS quarters, z.funds - a.funds AS funds_diff,
       {cut("z.funds / CAST(nullif(a.funds, 0) AS DOUBLE)", "funds_ratio")},
       if(a.shown AND z.shown AND a.shares <> 0, z.shares - a.shares, NULL) AS shares_diff,
       {cut("if(a.shown AND z.shown AND a.shares <> 0, z.shares / CAST(a.shares AS DOUBLE), NULL)", "shares_ratio")}
FROM (SELECT *, held AND shares IS NOT NULL AND share_check <> 'outran' AS shown FROM stock_series
      QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY seq) = 1) a
JOIN (SELECT *, held AND shares IS NOT NULL AND share_check <> 'outran' AS shown FROM stock_series
      QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY seq DESC) = 1) z ON z.cusip = a.cusip AND z.seq > a.seq
WHERE z.held
""",
)(lambda m: reads.change_over_span(_series(m)))


def _moves(m: CheckModel) -> DataFrame:
    from tidegauge.plans.model import after_first

    return reads.who_moved(
        after_first(m.table("position_pairs"), m.table("periods")), m.table("report_pairs"), m.table("manager_totals"),
        m.table("managers"), m.table("holders"), m.table("periods"),
    )


def _kept_moves(m: CheckModel) -> DataFrame:
    return m.derived("who_moved", lambda: _moves(m))


check("who_moved", rounded("manager_moves", "shares_prev shares_now weight_prev weight_now flow"))(_moves)
check(
    "manager_action",
    "SELECT period, action, count(*) AS managers FROM manager_moves GROUP BY period, action",
)(lambda m: _moves(m).groupBy("period", "action").agg(F.count(F.lit(1)).alias("managers")))
check(
    "moves_summary",
    f"""
SELECT stock, period, count(*) FILTER (action NOT IN ('hold', 'incomplete', 'not filed')) AS moves, count(*) FILTER (action = 'hold') AS held,
       count(*) FILTER (action = 'not filed') AS not_filed, count(*) FILTER (action = 'incomplete') AS incomplete,
       {cut("coalesce(sum(flow) FILTER (flow > 0), 0)", "bought")}, {cut("coalesce(-sum(flow) FILTER (flow < 0), 0)", "sold")}
FROM manager_moves GROUP BY stock, period
""",
)(lambda m: reads.moves_summary(_kept_moves(m)))
# Whole lists are sorted over all tasks, never ranked group by group.
check(
    "move_order",
    f"""
SELECT stock, period, cik, action, {cut("flow", "flow")} FROM manager_moves WHERE action NOT IN ('hold', 'incomplete', 'not filed')
ORDER BY stock, period, flow IS NULL, abs(coalesce(manager_moves.flow, 0)) DESC
""",
)(
    lambda m: _kept_moves(m)
    .where(~F.col("action").isin("hold", "incomplete", "not filed"))
    .orderBy("stock", "period", *reads.move_order())
    .select("stock", "period", "cik", "action", "flow")
)
check(
    "top_flows_two_sided",
    f"""
SELECT stock, period, cik, action, {cut("flow", "flow")}, place, widest FROM (
    SELECT *, abs(flow) = max(abs(flow)) OVER (PARTITION BY stock, period) AS widest
    FROM (SELECT *, row_number() OVER (PARTITION BY stock, period, flow > 0 ORDER BY abs(flow) DESC, cik) AS place
          FROM manager_moves WHERE flow <> 0) WHERE place <= 7)
""",
)(
    lambda m: reads.top_flows_two_sided(_kept_moves(m), ["stock", "period"], "cik").select(
        "stock", "period", "cik", "action", "flow", "place", (F.col("width") == 100).alias("widest")
    )
)
check("largest_weights", rounded("largest_weights", "weight weight_prev"))(
    lambda m: reads.largest_weights(
        m.table("positions"), m.table("stock_keys"), m.table("manager_totals"), m.table("periods"), P
    )
)
check("rank_in_book", "SELECT cik, period, stock, value, rank FROM book_places")(
    lambda m: reads.rank_in_book(reads.stock_books(m.table("positions"), m.table("stock_keys")))
)
check("left_out_rows", rounded("left_out_rows", "implied_price median_price price_ratio"))(
    lambda m: reads.left_out_rows(m.table("price_check"), m.table("stock_keys"))
)
check(
    "flagged_share_totals",
    f"""
SELECT cusip, period, shares, {cut("shares_vs_value_pts", "shares_vs_value_pts")} FROM
    (SELECT * FROM stock_periods QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY period DESC) = 1) WHERE share_check = 'outran'
""",
)(lambda m: reads.flagged_share_totals(m.table("stock_periods")))

# --- per manager --------------------------------------------------------------------------------------


def _headers(m: CheckModel) -> DataFrame:
    return reads.book_headers(m.table("manager_totals"), m.table("filings"), m.table("periods"))


def _book(m: CheckModel) -> DataFrame:
    return reads.manager_book(m.table("position_pairs"), _headers(m), m.table("stocks"), m.table("holders"))


def _kept_book(m: CheckModel) -> DataFrame:
    return m.derived("manager_book", lambda: _book(m))


check("book_headers", "SELECT * FROM book_headers")(_headers)
check("manager_book", rounded("manager_book", "shares_prev shares_now weight_prev weight_now flow"))(_book)
check("book_order", "SELECT cik, period, cusip, action, value_now FROM manager_book")(
    lambda m: _kept_book(m)
    .orderBy("cik", "period", *reads.book_order())
    .select("cik", "period", "cusip", "action", "value_now")
)
check(
    "manager_periods",
    "SELECT cik, list(period ORDER BY period) AS periods, max(period) AS default_period FROM manager_totals GROUP BY cik",
)(lambda m: reads.manager_periods(m.table("manager_totals")))
check(
    "book_summary",
    f"""
SELECT g.cik, g.period, g.positions, opened, added, trimmed, exited, {cut("top10_now", "top10_now")}, {cut("top10_prev", "top10_prev")},
       CASE WHEN g.positions = 0 THEN 'empty' WHEN top10_now >= 0.6 THEN 'concentrated' WHEN top10_now <= 0.2 THEN 'broad' ELSE 'between' END AS shape,
       {cut("if(h.first_filing, NULL, g.flow)", "net_buying")}, NOT h.first_filing AND h.complete AND h.complete_before AS comparable
FROM (SELECT cik, period, count(*) FILTER (shares_now <> 0) AS positions, count(*) FILTER (action = 'new') AS opened,
             count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'trim') AS trimmed, count(*) FILTER (action = 'exit') AS exited,
             list_sum(list_reverse_sort(list(if(shares_now <> 0, coalesce(weight_now, 0), 0)))[1:10]) AS top10_now,
             list_sum(list_reverse_sort(list(if(shares_prev <> 0, coalesce(weight_prev, 0), 0)))[1:10]) AS top10_prev,
             sum(flow) AS flow FROM manager_book GROUP BY cik, period) g
JOIN book_headers h ON h.cik = g.cik AND h.period = g.period
""",
)(lambda m: reads.book_summary(_kept_book(m), _headers(m)))
check(
    "managers_list",
    """
SELECT t.cik, t.manager_name AS name, t.value, t.positions, t.filing_date AS filed, z.value AS value_prev
FROM manager_totals t JOIN periods d ON d.period = t.period AND d.period = (SELECT period FROM latest_period)
LEFT JOIN manager_totals z ON z.cik = t.cik AND z.period = d.prev_period
WHERE t.manager_name ILIKE '%manager%' AND t.manager_name ILIKE '%lp%'
ORDER BY t.value DESC NULLS LAST, t.manager_name, t.cik LIMIT 20
""",
)(
    lambda m: reads.managers_list(
        m.table("manager_totals"), m.table("periods"), m.table("periods").agg(F.max("period").alias("period")),
        "manager LP", 20,
    )
)

# --- search and watchlist -------------------------------------------------------------------------------

_TICKER_KEY = "regexp_replace(upper(coalesce(t.ticker, '')), '[^A-Z0-9]', '', 'g')"


def _search_sql(words: list[str], key: str, hint: str, limit: int) -> str:
    every = " AND ".join(
        f"(s.name_filed ILIKE '%{w}%' OR s.name_mixed ILIKE '%{w}%' OR s.title_of_class ILIKE '%{w}%' OR s.cusip ILIKE '{w}%')"
        for w in words
    )
    by_ticker = f"OR {_TICKER_KEY} LIKE '{key}%'" if 1 <= len(key) <= 6 else ""
    class_match = (
        rf"regexp_matches(upper(concat(t.title_of_class, ' ', t.name_filed)), '\bCL(ASS)?\s*{hint}\b')" if hint else "false"
    )
    return f"""
SELECT t.cusip, t.ticker, t.security_type, t.kind, t.name_filed, t.name_mixed, t.title_of_class, coalesce(h.funds_holding, 0) AS funds,
       {_TICKER_KEY} = '{key}' AS ticker_match, {class_match} AS class_match
FROM stocks t LEFT JOIN holders h ON h.cusip = t.cusip AND h.period = (SELECT period FROM latest_period)
WHERE t.cusip IN (SELECT s.stock FROM securities s WHERE {every}) {by_ticker}
ORDER BY ticker_match DESC, class_match DESC, funds DESC, t.name_filed, t.cusip LIMIT {limit}
"""


def _search(m: CheckModel, query: str, limit: int = 25) -> DataFrame:
    return reads.search(m.table("securities"), m.table("stocks"), m.table("holders"), m.table("periods"), query, limit)


_CLASS_SQL = _search_sql(["brand", "group"], "BRANDGROUPCLASSA", "A", 25)
check("search", _CLASS_SQL)(lambda m: _search(m, "brand group class A"))
# Two class hints: the first ranks, neither needs to match; a hint alone asks for nothing.
check("search_two_classes", _search_sql(["brand", "group"], "CLASSBBRANDGROUPCLA", "B", 25))(
    lambda m: _search(m, "class B brand group cl. A")
)
check("search_by_ticker", _search_sql(["BRK"], "BRK", "", 25))(lambda m: _search(m, "BRK"))
check("suggest", f"SELECT * FROM ({_CLASS_SQL}) WHERE funds > 0 ORDER BY ticker_match DESC, class_match DESC, funds DESC, name_filed, cusip LIMIT 8")(
    lambda m: reads.suggest(_search(m, "brand group class A"), 8)
)
check(
    "suggest_managers",
    f"""
SELECT 'stock' AS what, cusip AS id, ticker, coalesce(name_mixed, name_filed) AS name, funds, CAST(NULL AS BIGINT) AS value FROM (
    SELECT * FROM ({_search_sql(["an"], "AN", "", 25)}) WHERE funds > 0
    ORDER BY ticker_match DESC, class_match DESC, funds DESC, name_filed, cusip LIMIT 8)
UNION ALL
SELECT 'manager', CAST(cik AS VARCHAR), '', manager_name, 0, value FROM (
    SELECT * FROM manager_totals WHERE period = (SELECT period FROM latest_period) AND manager_name ILIKE '%an%'
    ORDER BY value DESC, manager_name, cik LIMIT 3)
""",
)(
    lambda m: reads.suggest_managers(
        reads.suggest(_search(m, "an"), 8),
        reads.managers_list(
            m.table("manager_totals"), m.table("periods"), m.table("periods").agg(F.max("period").alias("period")), "an", 3
        ),
    )
)
check("best_match", f"SELECT * FROM ({_search_sql(['BR', 'Q'], 'BRQ', '', 25)}) WHERE ticker_match")(
    lambda m: reads.best_match(_search(m, "BR/Q"), "BR/Q")
)
check(
    "scan_watchlist_entries",
    "SELECT w.cusip, k.stock FROM watchlist w LEFT JOIN stock_keys k ON k.cusip = w.cusip",
)(
    lambda m: m.table("watchlist").join(m.table("stock_keys").select("cusip", "stock"), "cusip", "left").select(
        "cusip", "stock"
    )
)


def _overview(m: CheckModel) -> DataFrame:
    return reads.watchlist_overview(
        m.table("watchlist"), m.table("securities"), m.table("stocks"), _series(m), m.table("price_check"),
        m.table("stock_keys"),
    )


from checks.oracle import table  # noqa: E402

table(
    "watched",
    """
SELECT w.cusip AS entry, s.stock, w.line_no FROM watchlist w LEFT JOIN securities s ON s.cusip = w.cusip
QUALIFY row_number() OVER (PARTITION BY coalesce(s.stock, w.cusip) ORDER BY w.line_no) = 1
""",
)
table(
    "watchlist_overview",
    f"""
SELECT w.entry, w.stock, w.line_no, z.cusip IS NULL AS missing, t.ticker, coalesce(t.name_mixed, t.name_filed) AS name, z.period, z.funds,
       z.funds_change, {cut("z.funds_pct", "funds_pct")}, {cut("z.vs_median_pts", "vs_median_pts")}, z.share_check, z.streak,
       (SELECT list(q.funds ORDER BY q.seq) FROM stock_series q WHERE q.cusip = w.stock) AS spark,
       {cut("if(a.period <> z.period, z.funds / CAST(nullif(a.funds, 0) AS DOUBLE) - 1, NULL)", "long_change")},
       if(z.held, (SELECT count(*) FROM price_check c JOIN stock_keys k ON k.cusip = c.cusip
                   WHERE k.stock = w.stock AND c.period = z.period AND c.left_out), 0) AS left_out_total
FROM watched w
LEFT JOIN (SELECT * FROM stock_series QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY seq DESC) = 1) z ON z.cusip = w.stock
LEFT JOIN (SELECT * FROM stock_series QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY seq) = 1) a ON a.cusip = w.stock
LEFT JOIN stocks t ON t.cusip = w.stock
""",
)
check("watchlist_overview", "SELECT * FROM watchlist_overview")(
    lambda m: _overview(m).withColumn("spark", F.transform("spark", lambda x: x["funds"]))
)
check(
    "watchlist_summary",
    """
SELECT count(*) AS stocks, count(*) FILTER (funds_change > 0) AS gained, count(*) FILTER (funds_change < 0) AS lost,
       max_by(stock, (vs_median_pts, stock)) FILTER (vs_median_pts IS NOT NULL) AS furthest_ahead,
       min_by(stock, (vs_median_pts, stock)) FILTER (vs_median_pts IS NOT NULL) AS furthest_behind,
       count(*) FILTER (share_check = 'outran') AS outran, CAST(coalesce(sum(left_out_total), 0) AS BIGINT) AS left_out
FROM watchlist_overview WHERE NOT missing
""",
)(lambda m: reads.watchlist_summary(_overview(m)))
