"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import decontaminate, filter_audit, knn_quality, language, mixing, near_dup, pii, sharding, spelling, substring, url_trie, warc, weak_rules

URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the vote of the quality rules keeps."""
    return weak_rules.judge(_read(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark, one row per pair."""
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is of good quality, by its labelled neighbours."""
    return knn_quality.predict(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of nearly equal bytes."""
    return sharding.balanced_shards(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document a mix by source weights takes."""
    mixed = mixing.copies(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_trie.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return language.predict_documents(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once passages that an earlier one has are removed."""
    return substring.remove_repeats(_read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that every document belongs to."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the more frequent spelling that each may be a variant of."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters keeps, removes and loses, per source."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written as archives and read back."""
    found = warc.archive_pages(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_quality_rules,
        op3_benchmark_decontamination,
        op4_quality_classifier,
        op5_sharding,
        op6_mixing,
        op7_url_filters,
        op8_language_id,
        op9_substring_dedup,
        op10_minhash_near_dedup,
        op11_spelling_variants,
        op12_filter_audit,
        op13_warc,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"
#: The checksum's table of 256 entries, from its polynomial.
_ENTRIES = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS entry"""

ORACLES = {
    "op5_sharding": f"""
        WITH entries AS ({_ENTRIES}),
        cut AS (
            SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
                list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2],
                    lambda h: CAST('0x' || h AS BIGINT)) AS codes
            FROM documents),
        sized AS (
            SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, codes),
                lambda r, x: xor(r >> 8, entry[(xor(r, x) & 255) + 1]))) AS text_crc32
            FROM cut, entries),
        placed AS (
            SELECT *, row_number() OVER w AS place, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM sized
            WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
        shared AS (SELECT *, CAST((2 * before + size) * 8 // (2 * total) AS INTEGER) AS shard FROM placed)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
            place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM shared""",
    "op6_mixing": rf"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (
            SELECT *, 2 * source_size AS cap,
                [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight
            FROM totals),
        placed AS (
            SELECT *, cap / weight AS ratio,
                (1.5::DOUBLE * (sum(cap) OVER () / 2)
                    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(weight) OVER ()
                    - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM weighed),
        settled AS (
            SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
                ELSE (SELECT level FROM placed WHERE ratio > level ORDER BY ratio, source LIMIT 1) * weight END AS target
            FROM placed),
        rated AS (
            SELECT doc_id, size, source_size, target,
                CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS BIGINT)
                    / 4503599627370496::DOUBLE AS drawn
            FROM sized JOIN settled ON sized.source IS NOT DISTINCT FROM settled.source)
        SELECT doc_id, size, source_size, target,
            CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM rated""",
    "op7_url_filters": """
        WITH cut AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        judged AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM cut)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE entries AS ({_ENTRIES}),
        runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{7,}}')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        tallied AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
        cut AS (
            SELECT run, times, list_transform(string_split(regexp_replace(
                hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2],
                lambda h: CAST('0x' || h AS BIGINT)) AS codes
            FROM tallied),
        drawn AS (
            SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, codes),
                lambda r, x: xor(r >> 8, entry[(xor(r, x) & 255) + 1]))) AS h
            FROM cut, entries),
        words AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
                CAST(sum(times) AS BIGINT) AS n
            FROM drawn GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words),
        shorter AS (SELECT word, n, spot, substr(word, 1, spot - 1) || substr(word, spot + 1) AS rest FROM places),
        pairs AS (
            SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.spot = b.spot AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word FROM shorter a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word FROM shorter a JOIN words b ON a.rest = b.word),
        ranked AS (
            SELECT pairs.word, other, n, count(*) OVER (PARTITION BY pairs.word) AS n_near,
                row_number() OVER (PARTITION BY pairs.word ORDER BY n DESC, encode(other)) AS place
            FROM pairs JOIN words ON words.word = other),
        found AS (
            SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
                CASE WHEN ranked.n >= 10 * words.n THEN other END AS form, CASE WHEN ranked.n >= 10 * words.n THEN ranked.n END AS form_n
            FROM words LEFT JOIN ranked ON words.word = ranked.word AND place = 1),
        followed(word, root, step) AS (
            SELECT word, word, 0 FROM found
            UNION ALL SELECT followed.word, form, step + 1 FROM followed JOIN found ON followed.root = found.word WHERE form IS NOT NULL)
        SELECT found.word, form, root, n, n_near, form_n FROM found
        JOIN (SELECT word, arg_max(root, step) AS root FROM followed GROUP BY word) USING (word)""",
    "op12_filter_audit": rf"""
        WITH cut AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
        judged AS (
            SELECT doc_id, part,
                CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
            FROM cut),
        marks AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        combined AS (
            SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
        placed AS (
            SELECT part, filter_order, step, failed, n, good, toxic, filter_order[step] AS letter,
                translate(failed, filter_order[:step - 1], '') <> failed AS gone,
                contains(failed, filter_order[step]) AS fails
            FROM combined, steps),
        counted AS (
            SELECT part, filter_order, step, letter,
                CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (failed = letter), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
            FROM placed GROUP BY part, filter_order, step, letter)
        SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted""",
    "op13_warc": """
        WITH paid AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        led AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM paid)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM led""",
}
