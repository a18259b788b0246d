"""Secret scans over a ledger of content-addressed blobs, in DataFrame operations only.

A version of a file is its path and text; a blob is a distinct text, named by its SHA-256. The ledger
holds what was found in a blob by a version of the rules, so each pair is scanned once, however many
paths and runs it turns up in. Findings are then joined back to all paths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidegauge.llm.common import free_name, staged


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost first and not overlapping; those whose `group` is shorter than
    `least` are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The patterns of the base rules. Runs of one class are as long as they can be, so their
# least lengths may stand in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = (*BASE_RULES, *MORE_RULES)
MASK = "[SECRET]"

LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rules", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    """The name of a text; a null text is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, place: int, rule: Rule) -> Column:
    """One row a match of one rule: its number, its length, the length of the text since the match
    before, and whether it counts. Texts without a match cost one search."""
    regex = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"),
        F.split(text, rule.pattern, -1).alias("gap"),
    )
    rows = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(place).alias("place"),
            i.alias("number"),
            F.length(z.getField("gap")).cast("long").alias("gap"),
            F.length(z.getField("whole")).cast("long").alias("size"),
            (F.length(z.getField("part")) >= rule.least).alias("counts"),
        ),
    )
    found = F.filter(rows, lambda r: r.getField("size").isNotNull())
    return F.when(text.rlike(rule.pattern), found).otherwise(F.filter(found, lambda _: F.lit(False)))


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of the ledger for blobs (blob, text): one a finding, or one without a kind where there is none."""
    text = F.coalesce("text", F.lit(""))
    per_rule = [_matches(text, i, r) for i, r in enumerate(rules)]
    raw = staged(blobs.select("blob", F.explode_outer(F.flatten(F.array(*per_rule))).alias("m")).select("blob", "m.*"), "matches")
    so_far = Window.partitionBy("blob", "place").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    found = (
        raw.where("place is not null")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
        .where("counts")
        .select("blob", kinds[F.col("place")].alias("kind"), "place", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    none = {"kind": "string", "place": "int", "start": "long", "end": "long"}
    scanned = raw.where("place is null or number = 0").select("blob").distinct()
    marks = scanned.select("blob", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    return found.unionByName(marks).select("blob", F.lit(rules_version(rules)).alias("rules"), *none)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger (a Parquet folder) up to date for all texts of `versions` (a column `text`, any
    others), then return its findings under these rules, one row each: blob, kind, place (of the rule in
    the list), start and end (code points, end exclusive).

    Only texts that the ledger lacks under these rules are read by a pattern, each once. Copies are
    folded on the map side, so a text of a third of all rows costs no more than another. Null is the
    empty text; a table without rows adds nothing."""
    spark = versions.sparkSession
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], LEDGER)
    mine = F.col("rules") == rules_version(rules)
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.any_value("text").alias("text"))
    unseen = blobs.join(known.where(mine & F.col("kind").isNull()).select("blob"), "blob", "left_anti")
    _scan(unseen, rules).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).where(mine & F.col("kind").isNotNull()).drop("rules").distinct()


def by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of `versions` (all columns but text) with blob, spans (an array of kind:start:end by
    start, then rule) and base, the same of the base rules. Repeated rows all stay; columns of these names
    are replaced."""
    base = len(BASE_RULES)
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    lists = (
        findings.groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("start", "place", span.alias("span")))).alias("all"))
        .select(
            "blob",
            F.transform("all", lambda x: x.getField("span")).alias("spans"),
            F.transform(F.filter("all", lambda x: x.getField("place") < base), lambda x: x.getField("span")).alias("base"),
        )
    )
    named = versions.drop("spans", "base").withColumn("blob", blob_of(F.col("text"))).drop("text")
    empty = F.array().cast("array<string>")
    return named.join(lists, "blob", "left").withColumns({c: F.coalesce(c, empty) for c in ("spans", "base")})


def masked(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every finding in `text` (of these rules) replaced by MASK (touching or overlapping ones by one)
    and n_chars, where there is such a column, brought up to date. Rows and other columns stay. A text that no
    rule's pattern meets anywhere has no finding, and stays where it is: only the others move to join theirs."""
    meets = F.coalesce(reduce(Column.__or__, (F.col("text").rlike(r.pattern) for r in rules)), F.lit(False))
    return _masked(docs.where(meets), findings).unionByName(docs.where(~meets))


def _masked(docs: DataFrame, findings: DataFrame) -> DataFrame:
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("blob").orderBy("start", "end")) == 1
    opens = findings.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0))).withColumn("first", first)
    blob, gaps, last = (free_name(docs, c) for c in ("blob", "gaps", "last"))
    gap = F.when(F.col("first") | (F.col("start") > F.col("from")), F.struct("from", "start"))
    cuts = opens.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(gap)).alias(gaps), F.max("end").alias(last))
    text = F.col("text")
    between = F.transform(gaps, lambda g: F.substring(text, g.getField("from") + 1, g.getField("start") - g.getField("from")))
    tail = F.substring(text, F.col(last) + 1, F.length(text))
    hit = F.col(gaps).isNotNull()
    out = docs.withColumn(blob, blob_of(text)).join(cuts, blob, "left")
    out = out.withColumn("text", F.when(hit, F.concat_ws(MASK, between, F.array(tail))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
