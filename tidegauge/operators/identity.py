"""Which identifiers are the same stock: replaced identifiers, names, tickers and kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import desc_date, exact_median, first_per_group, is_true
from tidegauge.functions.text import compact_key
from tidegauge.functions.verdicts import security_kind
from tidegauge.operators.calendar import with_next
from tidegauge.operators.positions import share_lines
from tidegauge.params import Params
from tidegauge.sources.tables import staged


#: Pairs of a manager's departures and arrivals that one task forms.
PAIRS = 100_000


def movers(
    periods: DataFrame, cusip_holders: DataFrame, positions: DataFrame, filings: DataFrame, p: Params = Params()
) -> tuple[DataFrame, DataFrame]:
    """Managers that left a shrunk identifier (period, cik, old_cusip, s0, v0, departed) and managers that opened
    a grown one (period, cik, new_cusip, s1, v1, arrived), with how many did so."""
    spine = F.broadcast(periods.select("period", "prev_period").where(F.col("prev_period").isNotNull()))
    ahead = F.broadcast(with_next(periods.select("period")))
    # Counts of each identifier on both dates: an equi-join, no self-range.
    now = cusip_holders.join(spine, "period").select("cusip", "period", "prev_period", "funds")
    before = (
        cusip_holders.join(ahead, "period")
        .where(F.col("next_period").isNotNull())
        .select("cusip", F.col("next_period").alias("period"), F.col("funds").alias("funds_prev"))
    )
    sides = now.drop("prev_period").join(before, ["cusip", "period"], "full")
    count_now, count_prev = F.coalesce("funds", F.lit(0)), F.coalesce("funds_prev", F.lit(0))
    shrunk = sides.where((count_prev >= p.change_min_funds) & (count_now <= count_prev - p.change_min_moved))
    grown = sides.where((count_now >= p.change_min_moved) & (count_prev <= count_now * 0.5))

    held = positions.where(F.col("shares") > 0).select(
        "cik", "period", "cusip", F.col("shares").cast("double").alias("shares"),
        F.col("value_checked").cast("double").alias("value"),
    )
    held_before = held.join(ahead, "period").select(
        "cik", F.col("next_period").alias("period"), "cusip", "shares", "value"
    )
    filed = filings.where(F.col("lines") > 0).select("cik", "period")
    # Both sides of each comparison are cut to the candidate identifiers first, so that the joins
    # on (manager, period, identifier) never move the whole positions table.
    of = lambda rows, candidates: rows.join(candidates.select("cusip", "period"), ["cusip", "period"], "left_semi")
    departed = (
        of(held_before, shrunk)
        .join(filed, ["cik", "period"], "left_semi")
        .join(of(held.select("cik", "period", "cusip"), shrunk), ["cik", "period", "cusip"], "left_anti")
    )
    arrived = of(held, grown).join(
        of(held_before.select("cik", "period", "cusip"), grown), ["cik", "period", "cusip"], "left_anti"
    )
    # A pair's movers number at most the smaller of its two counts, so each side is cut by its own count.
    rows = F.count(F.lit(1))
    departures = departed.groupBy("period", F.col("cusip").alias("old_cusip")).agg(rows.alias("departed"))
    arrivals = arrived.groupBy("period", F.col("cusip").alias("new_cusip")).agg(rows.alias("arrived"))
    departures = departures.where(F.col("departed") >= p.change_min_moved)
    arrivals = arrivals.where(F.col("arrived") >= p.change_min_moved)
    left = departed.select(
        "period", "cik", F.col("cusip").alias("old_cusip"), F.col("shares").alias("s0"), F.col("value").alias("v0")
    ).join(departures, ["period", "old_cusip"])
    opened = arrived.select(
        "period", "cik", F.col("cusip").alias("new_cusip"), F.col("shares").alias("s1"), F.col("value").alias("v1")
    ).join(arrivals, ["period", "new_cusip"])
    return left, opened


def _possible(p: Params) -> Column:
    """Whether counts of both sides leave room for enough movers."""
    at_most = F.least("departed", "arrived")
    return (
        (F.col("old_cusip") != F.col("new_cusip"))
        & (at_most >= F.col("arrived") * 0.5)
        & ((at_most >= F.col("departed") * 0.5) | (at_most >= p.change_partial_moved))
    )


def all_moves(left: DataFrame, opened: DataFrame, p: Params = Params()) -> DataFrame:
    """Every pair of a departure and an arrival of one manager and quarter that both counts leave possible."""
    return left.join(opened, ["period", "cik"]).where(_possible(p))


def candidate_pairs(left: DataFrame, opened: DataFrame, p: Params = Params(), at_once: int = PAIRS) -> DataFrame:
    """period, old_cusip, new_cusip: every pair that may share as many movers as a replacement needs, and few others.

    A replacement shares at least t movers: of the new identifier's, half; of the old one's, half or the number
    that shows one under way; never under the least number. Managers have one order, by how many pairs they
    would form. Two sets that share t elements share one among all but the last t - 1 of each, so only these
    meet, and a manager with thousands of departures and arrivals, last in the order, is seldom among them. Where
    it is, its departures are dealt into parts, so that no task forms more than about `at_once` pairs a part."""
    key = ["period", "cik"]
    both = left.groupBy(*key).agg(F.count(F.lit(1)).alias("departures")).join(opened.groupBy(*key).agg(F.count(F.lit(1)).alias("arrivals")), key)
    loads = both.select(*key, (F.col("departures") * F.col("arrivals")).alias("load"))
    half = lambda c: F.ceil(F.col(c) * 0.5)
    least = F.lit(p.change_min_moved)
    old_needs = F.greatest(least, F.least(half("departed"), F.lit(p.change_partial_moved)))
    new_needs = F.greatest(least, half("arrived"))

    def first(rows: DataFrame, code: str, needs: Column) -> DataFrame:
        group = Window.partitionBy("period", code)
        placed = rows.join(loads, key).withColumns(
            {"place": F.row_number().over(group.orderBy("load", "cik")), "size": F.count(F.lit(1)).over(group)}
        )
        return placed.where(F.col("place") <= F.col("size") - needs + 1).select(*key, code, "departed" if code == "old_cusip" else "arrived")

    old, new = staged(first(left, "old_cusip", old_needs), "movers-old"), staged(first(opened, "new_cusip", new_needs), "movers-new")
    met = old.groupBy(*key).agg(F.count(F.lit(1)).alias("n_old")).join(new.groupBy(*key).agg(F.count(F.lit(1)).alias("n_new")), key)
    parts = met.select(*key, F.ceil(F.col("n_old") * F.col("n_new") / at_once).cast("int").alias("parts"))
    dealt = old.join(parts, key).withColumn("part", F.pmod(F.xxhash64("old_cusip"), F.col("parts")).cast("int")).drop("parts")
    copied = new.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(copied, [*key, "part"]).where(_possible(p)).select("period", "old_cusip", "new_cusip").distinct()


def cusip_moves(
    periods: DataFrame, cusip_holders: DataFrame, positions: DataFrame, filings: DataFrame, p: Params = Params()
) -> DataFrame:
    """Managers that left a shrunk identifier and opened a grown one in the same quarter, with the ratios of
    shares and value, for the pairs that enough managers may share. First the pairs, without their ratios, then
    the ratios of those that are left. Write this table before reading it: several passes follow."""
    left, opened = (staged(side, "movers") for side in movers(periods, cusip_holders, positions, filings, p))
    pairs = staged(candidate_pairs(left, opened, p), "move-pairs")
    to_new = pairs.join(opened, ["period", "new_cusip"])
    return to_new.join(left, ["period", "old_cusip", "cik"]).select(
        "period", "old_cusip", "new_cusip", "cik", "departed", "arrived",
        (F.col("s1") / F.col("s0")).alias("ratio"),
        (F.col("v1") / F.nullif("v0", F.lit(0.0))).alias("value_ratio"),
    )


def cusip_changes(moves: DataFrame, p: Params = Params()) -> DataFrame:
    """Identifiers replaced by another: most funds that left the old one opened the new one, at
    one exchange ratio and keeping their value."""
    pair = ["period", "old_cusip", "new_cusip"]
    enough = (
        moves.groupBy(*pair)
        .agg(
            F.count(F.lit(1)).alias("moved"), F.first("departed").alias("departed"), F.first("arrived").alias("arrived")
        )
        .where((F.col("moved") >= p.change_min_moved) & (F.col("moved") >= F.col("arrived") * 0.5))
    )
    kept = moves.join(enough.select(*pair), pair, "left_semi")
    # Both medians in one pass: two rows a mover, told apart by what they hold.
    pair_of = lambda what, x: F.struct(F.lit(what).alias("what"), F.col(x).alias("x"))
    two = F.explode(F.array(pair_of(0, "ratio"), pair_of(1, "value_ratio")))
    medians = exact_median(kept.select(*pair, two.alias("two")).select(*pair, "two.*"), [*pair, "what"], "x", "median")
    rates = medians.where("what = 0").select(*pair, F.col("median").alias("exchange_ratio"))
    values = medians.where("what = 1").select(*pair, F.col("median").alias("value_ratio"))
    close = F.when(F.abs(F.col("ratio") / F.col("exchange_ratio") - 1) <= 0.05, 1.0).otherwise(0.0)
    alike = kept.join(rates, pair).groupBy(*pair).agg(
        F.avg(close).alias("same_ratio"), F.first("exchange_ratio").alias("exchange_ratio")
    )
    scored = enough.join(alike, pair).join(values, pair)
    completed = (F.col("moved") >= F.col("departed") * 0.5) & (F.col("same_ratio") >= p.change_same_ratio)
    under_way = (F.col("moved") >= p.change_partial_moved) & (F.col("same_ratio") >= p.change_partial_same)
    real = scored.where(
        F.col("value_ratio").between(p.change_value_low, p.change_value_high) & (completed | under_way)
    ).withColumn("partial", F.col("moved") < F.col("departed") * 0.5)
    same_issuer = F.left("new_cusip", F.lit(6)) == F.left("old_cusip", F.lit(6))
    return first_per_group(
        real, ["period", "old_cusip"], [~same_issuer, -F.col("moved"), F.col("new_cusip")]
    ).select(
        *pair, "moved", "departed", "arrived", "exchange_ratio", "same_ratio", "value_ratio", "partial"
    )


def _walked(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges (cusip, stock, ratio; one per cusip) followed to their end by doubling: those that reach one,
    the edges of those that never do (they lead into a circle), and how many these are.

    Every round doubles the steps and is written, so a chain of n steps takes log n rounds. A round that
    brings none to its end shows that the rest circles: else its chain would hold one at each distance."""
    walk, left = edges, -1
    while True:
        unfinished = walk.join(edges.select(F.col("cusip").alias("stock")), "stock", "left_semi")
        n = unfinished.count()
        if n in (0, left):
            circling = edges.join(unfinished.select("cusip"), "cusip", "left_semi")
            return walk.join(unfinished.select("cusip"), "cusip", "left_anti"), circling, n
        left = n
        onward = walk.select(F.col("cusip").alias("stock"), F.col("stock").alias("next"), F.col("ratio").alias("more"))
        walk = _staged(
            walk.join(onward, "stock", "left").select(
                "cusip", F.coalesce("next", "stock").alias("stock"), (F.col("ratio") * F.coalesce("more", F.lit(1.0))).alias("ratio")
            )
        )


def _circled(edges: DataFrame, n: int) -> DataFrame:
    """Ends of `n` edges that all lead into circles: each stops before it would meet itself or the node
    at which it came in again, so at that node's predecessor."""
    ahead, steps = edges.select("cusip", "stock", F.col("stock").alias("least")), 1
    while steps < n:
        onward = ahead.select(F.col("cusip").alias("stock"), F.col("stock").alias("next"), F.col("least").alias("other"))
        ahead = _staged(
            ahead.join(onward, "stock").select("cusip", F.col("next").alias("stock"), F.least("least", "other").alias("least"))
        )
        steps *= 2
    # After as many steps as there are nodes, all stand on circles, and every node of one is stood on.
    on = ahead.select(F.col("stock").alias("cusip")).distinct()
    ring = edges.join(on, "cusip", "left_semi").join(ahead.select("cusip", "least"), "cusip")
    around = ring.groupBy("least").agg(F.product("ratio").alias("whole"))
    ends = ring.join(around, "least").select(
        F.col("stock").alias("cusip"), F.col("cusip").alias("stock"), (F.col("whole") / F.col("ratio")).alias("ratio")
    )
    ends = _staged(ends)
    tails, _, _ = _walked(_staged(edges.join(on, "cusip", "left_anti")))
    last = ends.select(F.col("cusip").alias("entry"), F.col("stock").alias("end"), F.col("ratio").alias("more"))
    led = tails.join(last, F.col("stock") == F.col("entry"))
    return ends.unionByName(led.select("cusip", F.col("end").alias("stock"), (F.col("ratio") * F.col("more")).alias("ratio")))


def _staged(df: DataFrame) -> DataFrame:
    return staged(df, "walk")


def stock_keys(cusip_holders: DataFrame, cusip_changes: DataFrame) -> DataFrame:
    """Each identifier's stock (the end of its chain of replacements) and the ratio to its shares. Chains
    may be of any length; a circle of replacements stops before it closes."""
    first = first_per_group(
        cusip_changes.select("old_cusip", "new_cusip", "exchange_ratio", "period"), ["old_cusip"], [F.col("period")]
    )
    edges = _staged(
        first.select(F.col("old_cusip").alias("cusip"), F.col("new_cusip").alias("stock"), F.col("exchange_ratio").alias("ratio"))
    )
    ended, circling, n = _walked(edges)
    if n:
        ended = ended.unionByName(_circled(_staged(circling), n))
    return (
        cusip_holders.select("cusip")
        .distinct()
        .join(ended, "cusip", "left")
        .select("cusip", F.coalesce("stock", "cusip").alias("stock"), F.coalesce("ratio", F.lit(1.0)).alias("ratio"))
    )


def spelled_names(cusip_holders: DataFrame, filing_parts: DataFrame, raw_infotable: DataFrame) -> DataFrame:
    """How the lines of each identifier's latest period spell its name, class and FIGI, with their number.
    Lines of other periods are dropped before anything is grouped; the one scan of the lines for names."""
    latest = cusip_holders.groupBy("cusip").agg(F.max("period").alias("latest_period"))
    lines = share_lines(raw_infotable).select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.col("CUSIP").alias("cusip"),
        F.trim("NAMEOFISSUER").alias("name"),
        F.trim("TITLEOFCLASS").alias("class"),
        F.nullif(F.trim("FIGI"), F.lit("")).alias("figi"),
    )
    parts = filing_parts.select("accession", F.col("period").alias("latest_period"))
    # Only reports of a period that is some identifier's latest, written so that their size is known: while
    # they are few enough to broadcast, the lines stay where they are.
    parts = staged(parts.join(F.broadcast(latest.select("latest_period").distinct()), "latest_period", "left_semi"), "latest-parts")
    return (
        lines.join(parts, "accession")
        .join(latest, ["cusip", "latest_period"], "left_semi")
        .groupBy("cusip", "latest_period", "name", "class", "figi")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def securities(spelled: DataFrame, stock_keys: DataFrame) -> DataFrame:
    """The name, class and FIGI most filers use for each identifier, in its latest period."""

    def most_used(column: str, out: str) -> DataFrame:
        counted = spelled.where(F.col(column).isNotNull()).groupBy("cusip", column).agg(F.sum("n").alias("n"))
        return counted.groupBy("cusip").agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(out))

    names = spelled.groupBy("cusip", "latest_period", "name").agg(F.sum("n").alias("n")).withColumn("key", compact_key(F.col("name")))
    order = F.struct(-F.col("n"), "name")
    top = names.groupBy("cusip", "latest_period").agg(F.min_by(F.struct("name", "key"), order).alias("top"))
    mixed = (
        names.where(F.col("name") != F.upper("name"))
        .join(top.drop("latest_period"), "cusip")
        .where(F.col("key") == F.col("top.key"))
        .groupBy("cusip")
        .agg(F.min_by("name", order).alias("name_mixed"))
    )
    return (
        top.join(stock_keys.select("cusip", "stock"), "cusip")
        .join(mixed, "cusip", "left")
        .join(most_used("class", "title_of_class"), "cusip", "left")
        .join(most_used("figi", "figi"), "cusip", "left")
        .select(
            "cusip", "stock", F.col("top.name").alias("name_filed"), "name_mixed", "title_of_class", "figi",
            "latest_period",
        )
    )


def stocks(
    stock_keys: DataFrame, cusip_holders: DataFrame, securities: DataFrame, lookups: DataFrame, fallbacks: DataFrame
) -> DataFrame:
    """Per stock: the name of its most reported identifier, its ticker and its kind."""
    counts = cusip_holders.join(stock_keys, "cusip")
    named = counts.groupBy("stock").agg(
        F.min_by("cusip", F.struct(desc_date(F.col("period")), -F.col("funds"), "cusip")).alias("named_from")
    )
    latest = cusip_holders.groupBy("cusip").agg(F.max("period").alias("period"))
    keyed = stock_keys.join(latest, "cusip", "left")
    # The current identifier first, then the most recent of the earlier ones.
    order = F.struct(F.col("cusip") != F.col("stock"), desc_date(F.col("period")), "cusip")

    def preferred(table: DataFrame, row: list, out: str) -> DataFrame:
        return keyed.join(table, "cusip").groupBy("stock").agg(F.min_by(F.struct(*row), order).alias(out))

    known = lookups.where(is_true(F.col("found")) & F.col("ticker").isNotNull())
    known = known.select("cusip", "ticker", "security_type", F.col("name").alias("figi_name"))
    listed = preferred(known, ["ticker", "security_type", "figi_name"], "t")
    provisional = preferred(fallbacks.select("cusip", "ticker", "source", "as_of"), ["ticker", "source", "as_of"], "f")
    described = securities.select(
        F.col("cusip").alias("named_from"), "name_filed", "name_mixed", "title_of_class", "figi"
    )
    has_ticker = F.col("t.ticker").isNotNull()
    return (
        named.join(described, "named_from")
        .join(listed, "stock", "left")
        .join(provisional, "stock", "left")
        .select(
            F.col("stock").alias("cusip"),
            "name_filed",
            "name_mixed",
            "title_of_class",
            "figi",
            "named_from",
            F.coalesce("t.ticker", "f.ticker").alias("ticker"),
            F.when(has_ticker, "openfigi").otherwise(F.col("f.source")).alias("ticker_source"),
            F.when(~has_ticker, F.col("f.as_of")).alias("ticker_as_of"),
            F.col("t.security_type").alias("security_type"),
            F.col("t.figi_name").alias("figi_name"),
            security_kind(F.col("t.security_type"), F.col("title_of_class"), F.col("name_filed")).alias("kind"),
        )
    )


def earlier_cusips(
    cusip_changes: DataFrame, stock_keys: DataFrame, periods: DataFrame, securities: DataFrame
) -> DataFrame:
    """The replacements that led to each stock's current identifier."""
    return (
        cusip_changes.join(stock_keys.select(F.col("cusip").alias("old_cusip"), "stock"), "old_cusip")
        .join(F.broadcast(periods.select("period", "label")), "period")
        .join(securities.select(F.col("cusip").alias("old_cusip"), "name_filed", "name_mixed"), "old_cusip", "left")
        .select(
            "stock", "period", "label", "old_cusip", "new_cusip", "exchange_ratio", "moved", "departed",
            "name_filed", "name_mixed",
        )
    )


def security_lookup(securities: DataFrame, stocks: DataFrame) -> DataFrame:
    """Each identifier, named the way its stock is named."""
    mine = securities.select("cusip", "stock", "latest_period", *(F.col(c).alias(f"own_{c}") for c in _NAMING))
    theirs = stocks.withColumnRenamed("cusip", "stock")
    return mine.join(theirs, "stock", "left").select(
        "cusip", "stock", "latest_period",
        *(F.coalesce(c, f"own_{c}").alias(c) for c in _NAMING),
        "ticker", "security_type", F.coalesce("kind", F.lit("stock")).alias("kind"), "ticker_source", "ticker_as_of",
    )


_NAMING = ("name_filed", "name_mixed", "title_of_class", "figi")


def linked_stocks(stock_keys: DataFrame) -> DataFrame:
    """Stocks reported under more than one identifier."""
    return stock_keys.where(F.col("cusip") != F.col("stock")).select("stock").distinct()


def unlinked_cusips(stock_keys: DataFrame) -> DataFrame:
    """Identifiers that are their own stock and nothing else's."""
    return stock_keys.where(F.col("cusip").isNotNull()).join(linked_stocks(stock_keys), "stock", "left_anti")


def ranked_years(facts: DataFrame, key: str, day: str) -> DataFrame:
    """Rows numbered newest first within a key."""
    return facts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(day).desc())))
