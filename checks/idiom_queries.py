"""The relational idioms the engine is built from, each on whole model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks.context import CheckModel
from checks.oracle import cut
from checks.registry import check
from checks.settings import PARAMS as P
from tidegauge.functions.stats import exact_median, first_per_group, product_minus_one
from tidegauge.functions.text import compact_key
from tidegauge.operators import fundamentals, identity
from tidegauge.operators.calendar import with_next


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# --- joins --------------------------------------------------------------------------------------------


def _before(m: CheckModel) -> DataFrame:
    """Holders of each identifier, dated with the next period."""
    ahead = F.broadcast(with_next(m.table("periods").select("period")).where(F.col("next_period").isNotNull()))
    return m.table("cusip_holders").join(ahead, "period").select(
        "cusip", F.col("next_period").alias("period"), F.col("funds").alias("funds_prev")
    )


check(
    "join_inner_multi_key",
    "SELECT p.period, f.restated, count(*) AS n FROM positions p JOIN filings f ON f.cik = p.cik AND f.period = p.period GROUP BY ALL",
)(
    lambda m: m.table("positions").select("cik", "period")
    .join(m.table("filings").select("cik", "period", "restated"), ["cik", "period"])
    .groupBy("period", "restated").agg(_n())
)
check(
    "join_left_outer",
    """
SELECT s.accession, c.AMENDMENTTYPE AS label FROM submissions s LEFT JOIN (SELECT * FROM raw_coverpage WHERE ISAMENDMENT = 'Y') c
  ON c.ACCESSION_NUMBER = s.accession
""",
)(
    lambda m: m.table("submissions").select("accession").join(
        m.table("raw_coverpage").where(F.col("ISAMENDMENT") == "Y").select(
            F.col("ACCESSION_NUMBER").alias("accession"), F.col("AMENDMENTTYPE").alias("label")
        ),
        "accession", "left",
    )
)
check(
    "join_full_outer",
    """
SELECT coalesce(a.cusip, z.cusip) AS cusip, coalesce(a.period, z.period) AS period, a.funds, z.funds AS funds_prev
FROM cusip_holders a FULL JOIN (SELECT h.cusip, d.period, h.funds FROM cusip_holders h JOIN periods d ON d.prev_period = h.period) z
  ON z.cusip = a.cusip AND z.period = a.period
""",
)(lambda m: m.table("cusip_holders").join(_before(m), ["cusip", "period"], "full"))
_FILED_AGAIN = "EXISTS (SELECT 1 FROM filings n JOIN periods d ON d.period = n.period WHERE n.cik = f.cik AND d.prev_period = f.period)"


def _next_filings(m: CheckModel) -> DataFrame:
    dates = F.broadcast(m.table("periods").where(F.col("prev_period").isNotNull()).select("period", "prev_period"))
    return m.table("filings").select("cik", "period").join(dates, "period").select(
        "cik", F.col("prev_period").alias("period")
    )


for _name, _how, _not in (("join_left_semi", "left_semi", ""), ("join_left_anti", "left_anti", "NOT ")):
    check(_name, f"SELECT cik, period FROM filings f WHERE {_not}{_FILED_AGAIN}")(
        lambda m, how=_how: m.table("filings").select("cik", "period").join(_next_filings(m), ["cik", "period"], how)
    )
check(
    "join_in_subquery",
    "SELECT role, count(*) AS n FROM submissions WHERE period IN (SELECT period FROM periods WHERE prev_period IS NOT NULL) GROUP BY role",
)(
    lambda m: m.table("submissions").join(
        F.broadcast(m.table("periods").where(F.col("prev_period").isNotNull()).select("period")), "period", "left_semi"
    ).groupBy("role").agg(_n())
)
check(
    "join_not_in_subquery",
    "SELECT cusip, stock, ratio FROM stock_keys WHERE cusip IS NOT NULL AND stock NOT IN (SELECT stock FROM stock_keys WHERE cusip <> stock)",
)(lambda m: identity.unlinked_cusips(m.table("stock_keys")).select("cusip", "stock", "ratio"))
check(
    "join_exists_correlated",
    """
SELECT s.cusip, EXISTS (SELECT 1 FROM raw_sec_tickers t WHERE regexp_replace(upper(t.ticker), '[^A-Z0-9]', '', 'g')
    = regexp_replace(upper(s.ticker), '[^A-Z0-9]', '', 'g')) AS listed FROM stocks s
""",
)(
    lambda m: m.table("stocks").select("cusip", compact_key(F.col("ticker")).alias("key")).join(
        m.table("raw_sec_tickers").select(compact_key(F.col("ticker")).alias("key"), F.lit(True).alias("l")).distinct(),
        "key", "left",
    ).select("cusip", F.col("l").isNotNull().alias("listed"))
)
check(
    "join_self_previous_period",
    """
SELECT a.cusip, a.period, a.funds - z.funds AS change FROM cusip_holders a JOIN periods d ON d.period = a.period
JOIN cusip_holders z ON z.cusip = a.cusip AND z.period = d.prev_period
""",
)(
    lambda m: m.table("cusip_holders").join(_before(m), ["cusip", "period"]).select(
        "cusip", "period", (F.col("funds") - F.col("funds_prev")).alias("change")
    )
)
check(
    "join_equi_inequality",
    f"""
SELECT o.period, o.cusip AS old_cusip, n.cusip AS new_cusip, count(*) AS moved, o.movers AS departed, n.movers AS arrived
FROM turned_holdings o JOIN turned_holdings n ON n.period = o.period AND n.cik = o.cik AND n.cusip <> o.cusip
WHERE o.left_it AND NOT n.left_it AND o.movers >= {P.change_min_moved} AND n.movers >= {P.change_min_moved}
  AND 2 * o.movers >= n.movers AND o.movers >= least({P.change_partial_moved}, o.movers / 2)
  AND n.movers >= least({P.change_partial_moved}, o.movers / 2)
GROUP BY ALL
""",
)(
    lambda m: identity.all_moves(*identity.movers(*map(m.table, ("periods", "cusip_holders", "positions", "filings")), m.params), m.params).groupBy(
        "period", "old_cusip", "new_cusip"
    ).agg(
        _n("moved"), F.max("departed").alias("departed"), F.max("arrived").alias("arrived")
    )
)
check(
    "join_row_value_comparison",
    """
SELECT a.cik, a.period, count(*) AS later FROM filing_parts a JOIN filing_parts b ON b.cik = a.cik AND b.period = a.period
WHERE a.role = 'new holdings' AND b.role <> 'new holdings' AND (a.filing_date, a.accession) > (b.filing_date, b.accession) GROUP BY ALL
""",
)(
    lambda m: m.table("filing_parts").where(F.col("role") == "new holdings").join(
        m.table("filing_parts").where(F.col("role") != "new holdings").select(
            "cik", "period", F.struct("filing_date", "accession").alias("base")
        ),
        ["cik", "period"],
    ).where(F.struct("filing_date", "accession") > F.col("base")).groupBy("cik", "period").agg(_n("later"))
)
check(
    "join_band_self",
    """
SELECT l.cik, l.fiscal_end, z.fiscal_end AS prior_fiscal_end FROM fundamentals_history l JOIN fundamentals_history z
  ON z.cik = l.cik AND z.n = l.n + 1 AND z.fiscal_end BETWEEN l.fiscal_end - 380 AND l.fiscal_end - 350
""",
)(
    lambda m: m.table("fundamentals_history").alias("l").join(
        m.table("fundamentals_history").select(
            "cik", (F.col("n") - 1).alias("n"), F.col("fiscal_end").alias("before")
        ),
        ["cik", "n"],
    ).where(F.datediff("fiscal_end", "before").between(350, 380)).select(
        "cik", "fiscal_end", F.col("before").alias("prior_fiscal_end")
    )
)
check("join_values", "SELECT measure, rank, count(*) AS n FROM known_facts GROUP BY measure, rank")(
    lambda m: fundamentals.known_facts(m.table("raw_xbrl_frames")).groupBy("measure", "rank").agg(_n())
)
check(
    "join_scalar_count",
    """
SELECT b.cik, b.period, b.stock, 1 + (SELECT count(*) FROM stock_books o WHERE o.cik = b.cik AND o.period = b.period AND o.value > b.value) AS rank
FROM stock_books b WHERE b.value IS NOT NULL
""",
)(
    lambda m: _ranked(m)
)
check(
    "join_cross",
    "SELECT p.period, l.symbol, l.latest_close > 0 AS priced FROM periods p CROSS JOIN latest_closes l WHERE p.prev_period IS NOT NULL",
)(lambda m: _grid(m))


def _ranked(m: CheckModel) -> DataFrame:
    from tidegauge.operators import reads

    books = reads.stock_books(m.table("positions"), m.table("stock_keys"))
    return reads.rank_in_book(books).select("cik", "period", "stock", "rank")


def _grid(m: CheckModel) -> DataFrame:
    """Every symbol in every period: the calendar's few rows as one array beside each symbol."""
    from tidegauge.operators import prices

    latest = prices.latest_prices(m.table("quarter_prices"))
    dated = m.table("periods").where(F.col("prev_period").isNotNull()).agg(F.collect_list("period")).scalar()
    return latest.select(F.explode(dated).alias("period"), "symbol", (F.col("latest_close") > 0).alias("priced"))


# --- aggregates -----------------------------------------------------------------------------------------

check(
    "agg_basic",
    f"SELECT period, sum(shares)::BIGINT AS total, count(*) AS n, min(value) AS least, max(value) AS most, {cut('avg(shares)', 'mean')} FROM positions GROUP BY period",
)(
    lambda m: m.table("positions").groupBy("period").agg(
        F.sum("shares").alias("total"), _n(), F.min("value").alias("least"), F.max("value").alias("most"),
        F.avg("shares").alias("mean"),
    )
)
check("agg_group_by_all", "SELECT cusip, period, price_flag, count(*) AS n FROM positions GROUP BY ALL")(
    lambda m: m.spark.sql("SELECT cusip, period, price_flag, count(*) AS n FROM {p} GROUP BY ALL", p=m.table("positions"))
)
check("agg_count_distinct", "SELECT cusip, count(DISTINCT cik) AS managers FROM positions GROUP BY cusip")(
    lambda m: m.table("positions").groupBy("cusip").agg(F.count_distinct("cik").alias("managers"))
)
check(
    "agg_filter",
    "SELECT period, count(*) FILTER (price_flag) AS flagged, coalesce(sum(shares) FILTER (NOT price_flag), 0)::BIGINT AS kept FROM positions GROUP BY period",
)(
    lambda m: m.table("positions").groupBy("period").agg(
        F.count_if("price_flag").alias("flagged"),
        F.coalesce(F.sum(F.when(~F.col("price_flag"), F.col("shares"))), F.lit(0)).alias("kept"),
    )
)
check(
    "agg_conditional_pivot",
    f"""
SELECT cik, period_end, {cut("max(val) FILTER (measure = 'capex')", "capex")}, {cut("max(val) FILTER (measure = 'diluted_shares')", "diluted_shares")}
FROM known_facts WHERE measure IN ('capex', 'diluted_shares') GROUP BY cik, period_end
""",
)(
    lambda m: fundamentals.known_facts(m.table("raw_xbrl_frames"))
    .where(F.col("measure").isin("capex", "diluted_shares"))
    .groupBy("cik", "period_end").pivot("measure", ["capex", "diluted_shares"]).agg(F.max("val"))
)
check("agg_exact_median", f"SELECT cusip, period, {cut('median(implied_price)', 'm')} FROM positions WHERE shares > 0 GROUP BY cusip, period")(
    lambda m: exact_median(m.table("positions").where(F.col("shares") > 0), ["cusip", "period"], "implied_price", "m")
)
check(
    "agg_mode",
    """
SELECT CUSIP AS cusip, NAMEOFISSUER AS name FROM (SELECT CUSIP, NAMEOFISSUER, count(*) AS n FROM share_lines GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY CUSIP ORDER BY n DESC, NAMEOFISSUER) = 1
""",
)(
    lambda m: _mode(m)
)


def _mode(m: CheckModel) -> DataFrame:
    from tidegauge.operators.positions import share_lines

    counted = share_lines(m.table("raw_infotable")).groupBy("CUSIP", "NAMEOFISSUER").agg(_n())
    return counted.groupBy(F.col("CUSIP").alias("cusip")).agg(
        F.min_by("NAMEOFISSUER", F.struct(-F.col("n"), "NAMEOFISSUER")).alias("name")
    )


check(
    "agg_arg_max_tuple",
    "SELECT cik, period, max_by(accession, (filing_date, accession)) AS latest FROM filing_parts GROUP BY cik, period",
)(
    lambda m: m.table("filing_parts").groupBy("cik", "period").agg(
        F.max_by("accession", F.struct("filing_date", "accession")).alias("latest")
    )
)
check("agg_bool_or", "SELECT cusip, bool_or(price_flag) AS flagged FROM positions GROUP BY cusip")(
    lambda m: m.table("positions").groupBy("cusip").agg(F.bool_or("price_flag").alias("flagged"))
)
check("agg_any_value", f"SELECT cusip, period, {cut('any_value(median_price)', 'median_price')} FROM positions GROUP BY cusip, period")(
    lambda m: m.table("positions").groupBy("cusip", "period").agg(
        F.any_value("median_price", ignoreNulls=True).alias("median_price")
    )
)
check("agg_having", "SELECT cusip, period, count(*) AS n FROM positions GROUP BY cusip, period HAVING count(*) >= 20")(
    lambda m: m.table("positions").groupBy("cusip", "period").agg(_n()).where(F.col("n") >= 20)
)
check(
    "agg_share_within_tolerance",
    f"SELECT cusip, period, {cut('avg(CASE WHEN abs(price_ratio - 1) <= 0.05 THEN 1.0 ELSE 0.0 END)', 'near')} FROM positions GROUP BY cusip, period",
)(
    lambda m: m.table("positions").groupBy("cusip", "period").agg(
        F.avg(F.when(F.abs(F.col("price_ratio") - 1) <= 0.05, 1.0).otherwise(0.0)).alias("near")
    )
)
check(
    "agg_clipped_sum",
    f"SELECT stock, period, {cut('sum(greatest(coalesce(shares_now, 0) - coalesce(shares_prev, 0), 0)) FILTER (NOT flagged)', 'bought')} FROM book_sides GROUP BY stock, period",
)(
    lambda m: m.table("position_pairs").groupBy("stock", "period").agg(
        F.sum(
            F.when(
                ~F.col("flagged"),
                F.greatest(F.coalesce("shares_now", F.lit(0.0)) - F.coalesce("shares_prev", F.lit(0.0)), F.lit(0.0)),
            )
        ).alias("bought")
    )
)
check("agg_distinct", "SELECT DISTINCT cik, cusip FROM positions")(
    lambda m: m.table("positions").select("cik", "cusip").distinct()
)
check(
    "agg_ordered_distinct_list",
    "SELECT period, list(DISTINCT reason ORDER BY reason) AS reasons FROM price_check GROUP BY period",
)(lambda m: m.table("price_check").groupBy("period").agg(F.array_sort(F.collect_set("reason")).alias("reasons")))
check(
    "agg_product",
    f"SELECT cusip, {cut('product(1 + quarter_pct) - 1', 'compounded')} FROM stock_prices WHERE quarter_pct IS NOT NULL GROUP BY cusip",
)(lambda m: _compounded(m))


def _compounded(m: CheckModel) -> DataFrame:
    """A stock's quarterly returns one after another: the array holds one return per quarter."""
    returns = F.array_sort(F.collect_list(F.struct("period", "quarter_pct")))
    rows = m.table("stock_prices").where(F.col("quarter_pct").isNotNull()).groupBy("cusip").agg(returns.alias("r"))
    return rows.select("cusip", product_minus_one(F.transform("r", lambda x: x["quarter_pct"])).alias("compounded"))


# --- windows and sets -------------------------------------------------------------------------------------

check(
    "first_per_group",
    """
SELECT cusip, cik, shares FROM positions WHERE period = (SELECT max(period) FROM positions)
QUALIFY row_number() OVER (PARTITION BY cusip ORDER BY shares DESC, cik) = 1
""",
)(
    lambda m: first_per_group(
        m.table("positions").join(
            F.broadcast(m.table("positions").agg(F.max("period").alias("period"))), "period", "left_semi"
        ).select("cusip", "cik", "shares"),
        ["cusip"], [-F.col("shares"), F.col("cik")],
    )
)
check(
    "latest_n_years",
    "SELECT cik, fiscal_end, n FROM fundamentals_history",
)(
    lambda m: identity.ranked_years(m.table("fundamentals_history").select("cik", "fiscal_end"), "cik", "fiscal_end")
)
check("set_union_all", "SELECT period FROM periods UNION ALL SELECT prev_period FROM periods")(
    lambda m: m.table("periods").select("period").unionByName(m.table("periods").select(F.col("prev_period").alias("period")))
)
check(
    "set_union_distinct",
    "SELECT cik FROM filings UNION SELECT cik FROM submissions",
)(lambda m: m.table("filings").select("cik").union(m.table("submissions").select("cik")).distinct())
_PAIRS = "SELECT b.stock AS cusip, b.cik FROM stock_books b WHERE b.period = (SELECT {} FROM periods WHERE period = (SELECT max(period) FROM periods))"


def _books_at(m: CheckModel, column: str) -> DataFrame:
    at = m.table("periods").agg(F.max_by(column, "period").alias("period"))
    held = m.table("positions").where(F.col("shares") > 0).join(F.broadcast(at), "period", "left_semi")
    return held.join(m.table("stock_keys"), "cusip").select(F.col("stock").alias("cusip"), "cik").distinct()


for _name, _op, _word in (("set_intersect", "intersect", "INTERSECT"), ("set_difference", "subtract", "EXCEPT")):
    check(_name, f"{_PAIRS.format('period')} {_word} {_PAIRS.format('prev_period')}")(
        lambda m, op=_op: getattr(_books_at(m, "period"), op)(_books_at(m, "prev_period"))
    )
check(
    "cast_and_date_functions",
    """
SELECT accession, TRY_CAST(AMENDMENTNO AS INTEGER) AS no, CAST(period + INTERVAL 90 DAY AS DATE) AS later,
       CAST(period - INTERVAL 18 MONTH AS DATE) AS oldest, left(accession, 6) AS head, length(manager_name) AS letters
FROM submissions JOIN raw_coverpage ON ACCESSION_NUMBER = accession
""",
)(
    lambda m: m.table("submissions").select("accession", "period", "manager_name").join(
        m.table("raw_coverpage").select(F.col("ACCESSION_NUMBER").alias("accession"), "AMENDMENTNO"), "accession"
    ).select(
        "accession", F.col("AMENDMENTNO").try_cast("int").alias("no"), F.date_add("period", 90).alias("later"),
        F.add_months("period", -18).alias("oldest"), F.left("accession", F.lit(6)).alias("head"),
        F.length("manager_name").alias("letters"),
    )
)
check(
    "star_modifiers",
    "SELECT * EXCLUDE (median_price, price_ratio, implied_price) REPLACE (upper(cusip) AS cusip) FROM positions",
)(
    lambda m: m.spark.sql(
        "SELECT * EXCEPT (median_price, price_ratio, implied_price, cusip), upper(cusip) AS cusip FROM {p}",
        p=m.table("positions"),
    )
)
check(
    "latest_position_rank",
    "SELECT cik, period, cusip, CAST(rank() OVER (PARTITION BY cik, period ORDER BY shares DESC) AS INTEGER) AS place FROM positions",
)(
    lambda m: m.table("positions").select(
        "cik", "period", "cusip",
        F.rank().over(Window.partitionBy("cik", "period").orderBy(F.col("shares").desc())).alias("place"),
    )
)
