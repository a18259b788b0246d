"""The operators of this folder as queries with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import held_out, prepare, staged, staging_folder, table
from tidegauge.llm.html_text import text_of_pages
from tidegauge.llm.neighbours import nearest
from tidegauge.llm.packing import pack
from tidegauge.llm.passages import without_repeats
from tidegauge.llm.pieces import decoded, encoded
from tidegauge.llm.quality_classifier import fit_quality, score_quality
from tidegauge.llm.quality_rules import judge
from tidegauge.llm.ranked_search import search
from tidegauge.llm.secrets import RULES, by_path, scan_versions
from tidegauge.llm.simhash import near_copies, with_fingerprints
from tidegauge.llm.spelling import spelling_variants
from tidegauge.llm.toxicity import fit_toxicity, score_toxicity
from tidegauge.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")), "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = staged(with_fingerprints(docs).select("doc_id", "simhash"), "simhash")
    return marked.join(near_copies(marked), "simhash").select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, folder, "labels")), "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = by_path(docs, scan_versions(docs, staging_folder(spark, "ledger")))
    count = lambda kind: F.size(F.filter("base", lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", text_of_pages("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = staging_folder(spark, "archives")
    write_archives(table(spark, folder, "pages"), archives)
    read = read_archives(spark, archives, with_data=False).where("last")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = docs.withColumn("ids", encoded("text")).withColumn("back", decoded("ids"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.crc32(listed.cast("binary")).alias("ids_crc32"),
        (F.col("back") == F.col("text")).alias("round_trip"),
    )


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(spark, table(spark, folder, "documents"))


@query
def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_passages(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(spark, table(spark, folder, "documents"), kept=False)


def _secrets_sql() -> str:
    """Matches by the other engine's expressions, placed by adding up the texts between them."""
    quoted = [r.pattern.replace("'", "''") for r in RULES]
    per_rule = " UNION ALL ".join(
        f"SELECT n, {i} AS place, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS wholes, "
        f"regexp_extract_all(t, '{p}', {r.group}) AS parts, string_split_regex(t, '{p}') AS gaps FROM texts"
        for i, (r, p) in enumerate(zip(RULES, quoted, strict=True))
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES[:3])
    return f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({per_rule}),
single AS (
    SELECT n, place, kind, least, unnest(range(len(wholes))) AS i, unnest(wholes) AS whole, unnest(parts) AS part,
           unnest(gaps[1:len(wholes)]) AS gap
    FROM matched WHERE len(wholes) > 0
),
placed AS (
    SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY n, place ORDER BY i) AS BIGINT) AS finish FROM single
),
found AS (
    SELECT n, place, kind, finish - length(whole) AS start, concat_ws(':', kind, finish - length(whole), finish) AS span
    FROM placed WHERE length(part) >= least
)
SELECT doc_id, {counts},
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM texts LEFT JOIN found USING (n) GROUP BY n, doc_id
"""


ORACLES["op8_secrets"] = _secrets_sql()
# Base32 by hand: four symbols of five bits for every five hexadecimal digits.
ORACLES["op4_warc"] = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((list_sum(list_transform(range(5), lambda d: CAST(
            (strpos('0123456789abcdef', substr(h, CAST(1 + 5 * (i // 4) + d AS BIGINT), 1)) - 1) * power(16, 4 - d) AS BIGINT)))::BIGINT
            >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest
    FROM hashed
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM named
)
SELECT page_id, payload_bytes, payload_digest, if(page_id = head, 'response', 'revisit') AS record_type,
       if(page_id = head, NULL, head) AS refers_to
FROM firsts
"""

# The checksum byte by byte from a table made by its rule; near words by the letter left out at one place.
ORACLES["op11_spelling"] = """
WITH RECURSIVE steps AS (
    SELECT i, i AS c, 0 AS k FROM range(256) r(i)
    UNION ALL
    SELECT i, if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS entries FROM steps WHERE k = 8),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
    FROM documents
), counted AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (
    SELECT run, times, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS h FROM counted
), hashed AS (
    SELECT run, times, xor(list_reduce(
        list_transform(range(length(h) // 2), lambda i: CAST(concat('0x', substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
        lambda c, b: xor(c >> 8, entries[CAST(xor(c & 255, b) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
    FROM coded, crc_table
), damaged AS (
    SELECT if(crc % 199 = 0, concat(substr(run, 1, crc % length(run)), substr(run, crc % length(run) + 2)), run) AS word, times
    FROM hashed
), words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), less AS (
    SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM words, range(64) r(i) WHERE i < length(word)
), pairs AS (
    SELECT x.word, y.word AS near, y.n AS m FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
    UNION
    SELECT x.word, y.word, y.n FROM less x JOIN words y ON x.rest = y.word
    UNION
    SELECT y.word, x.word, x.n FROM less x JOIN words y ON x.rest = y.word
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS near, max(m) AS m FROM pairs GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, if(m >= 5 * n, near, NULL) AS form, if(m >= 5 * n, m, NULL) AS form_n
    FROM words LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root, form AS onward FROM formed
    UNION ALL
    SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.onward
)
SELECT word, form, chain.root, n, n_near, form_n FROM formed JOIN chain USING (word) WHERE onward IS NULL
"""

ORACLES["op12_search"] = """
WITH found AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents
), counted AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
lengths AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM sizes, corpus),
asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark
    ) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counted, corpus GROUP BY term, n_docs
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

# Every string of 50 bytes by its hexadecimal digits; a removed byte has such a string 0 to 49 bytes before it.
ORACLES["op13_passages"] = """
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
coded AS (SELECT n, doc_id, t, strlen(t) AS size, hex(encode(t)) AS h FROM texts),
strings AS (
    SELECT n, doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s
    FROM (SELECT n, doc_id, h, unnest(range(size - 49)) AS i FROM coded WHERE size >= 50)
), earliest AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT n, i FROM strings JOIN earliest USING (s) WHERE first < doc_id),
marked AS (
    SELECT n, i, if(i - lag(i) OVER w <= 50, 0, 1) AS opens FROM gone WINDOW w AS (PARTITION BY n ORDER BY i)
), numbered AS (
    SELECT n, i, sum(opens) OVER (PARTITION BY n ORDER BY i) AS run FROM marked
), runs AS (SELECT n, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY n, run),
around AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY n ORDER BY a) AS left_end FROM runs),
kept AS (
    SELECT n, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
           string_agg(substr(h, CAST(2 * left_end + 1 AS BIGINT), CAST(2 * (a - left_end) AS BIGINT)), '' ORDER BY a) AS parts
    FROM around JOIN coded USING (n) GROUP BY n
)
SELECT doc_id, size AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(if(last IS NULL, encode(t), unhex(concat(parts, substr(h, CAST(2 * last + 1 AS BIGINT)))))) AS kept_sha256
FROM coded LEFT JOIN kept USING (n)
"""
