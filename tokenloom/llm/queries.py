"""Registered queries of the subpackage, and the same as DuckDB SQL where it can say them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import new_path
from . import alignment, exact, idstore, licenses, lines, mixing, ngrams, pieces, quality, spelling, suffixes, urls, warc


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was
    started; on a cluster the package is shipped with the application."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = lines.without_repeated_lines(docs, out="kept", count_as="n_removed")
    return cleaned.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        "n_removed",
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_checked(docs).select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), "round_trip"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.span_report(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.best_license(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    read = warc.read_archives(archives, new_path(spark, "any"))
    return read.select(
        F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("bigint"))
        .otherwise(F.col("page_id"))
        .alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    paths = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    return alignment.align_report(_table(spark, sf_dir, "documents").select("doc_id", "text"), *paths)


def op12_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    store = idstore.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return idstore.stored_checksums(store)


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_source_mix": op5_source_mix,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_ngram_join": op10_ngram_join,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_index": op12_token_index,
    "op13_spelling_groups": op13_spelling_groups,
}

_W = r"[\x20\x09-\x0D]+"

ORACLES = {
    "op1_line_dedup": rf"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), tokens AS (
    SELECT *, list_distinct(list_filter(string_split_regex(lower(line), '{_W}'), lambda x: x <> '')) AS t FROM lines
), firsts AS (
    SELECT list_sort(t) AS s, min(doc_id * 1000000 + line_no) AS sid FROM tokens WHERE len(t) > 0 GROUP BY 1
), exploded AS (
    SELECT sid, len(s) AS n, unnest(s) AS w FROM firsts
), rarity AS (
    SELECT w, count(*) AS c FROM exploded GROUP BY w
), ranked AS (
    SELECT sid, n, w, row_number() OVER (PARTITION BY sid ORDER BY c, w) AS pos FROM exploded JOIN rarity USING (w)
), prefixes AS (
    SELECT sid, n, w FROM ranked WHERE pos <= n - ceil(n * 80 / 100) + 1
), pairs AS (
    SELECT DISTINCT b.sid AS later, a.sid AS earlier FROM prefixes a JOIN prefixes b
    ON a.w = b.w AND a.sid < b.sid AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), matched AS (
    SELECT DISTINCT later AS sid FROM pairs JOIN firsts a ON a.sid = earlier JOIN firsts b ON b.sid = later
    WHERE len(list_intersect(a.s, b.s)) * 180 >= (len(a.s) + len(b.s)) * 80
), judged AS (
    SELECT doc_id, line_no, line, len(t) > 0
        AND (doc_id * 1000000 + line_no <> f.sid OR f.sid IN (SELECT sid FROM matched)) AS gone
    FROM tokens LEFT JOIN firsts f ON list_sort(t) = f.s
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op5_source_mix": rf"""
WITH sized AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS host,
        CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_W}'), lambda x: x <> '')) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT host, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY host
), weighted AS (
    SELECT host, source_size, row_number() OVER (ORDER BY host = '', host) - 1 AS place FROM sources
), weights AS (
    SELECT host, source_size, place,
        CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM weighted
), sums AS (
    SELECT *, sum(source_size) OVER () AS sizes, sum(weight) OVER () AS weights,
        sum(source_size) OVER w - source_size AS sizes_before, sum(weight) OVER w - weight AS weights_before
    FROM weights WINDOW w AS (ORDER BY source_size / weight, place ROWS UNBOUNDED PRECEDING)
), marked AS (
    SELECT *, (150 * sizes - 200 * sizes_before) * weight >= 200 * source_size * (weights - weights_before) AS stopped
    FROM sums
), gone AS (
    SELECT coalesce(sum(source_size) FILTER (WHERE stopped), 0) AS size_gone,
        coalesce(sum(weight) FILTER (WHERE stopped), 0) AS weight_gone FROM marked
), targets AS (
    SELECT host, source_size, CASE WHEN stopped THEN CAST(2 * source_size AS DOUBLE)
        ELSE CAST((150 * sizes - 200 * size_gone) * weight AS DOUBLE) / CAST(100 * (weights - weight_gone) AS DOUBLE)
        END AS target
    FROM marked CROSS JOIN gone
), placed AS (
    SELECT doc_id, size, host, row_number() OVER (PARTITION BY host ORDER BY size, doc_id) AS place FROM sized
), rated AS (
    SELECT doc_id, size, source_size, target, place,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        CAST(CAST('0x' || substr(md5('17:' || host), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
    FROM placed JOIN targets USING (host)
)
SELECT doc_id, size, source_size, target,
    CAST(floor(CAST(place AS DOUBLE) * rate + shift) - floor(CAST(place - 1 AS DOUBLE) * rate + shift) AS BIGINT) * size AS taken
FROM rated
""",
    "op7_quality_rules": rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS host FROM documents
), words AS (
    SELECT *, list_filter(string_split_regex(text, '{_W}'), lambda x: x <> '') AS words FROM texts
), placed AS (
    SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM words
), windows AS (
    SELECT r, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM placed
    WINDOW o AS (PARTITION BY r ORDER BY i)
), repeated AS (
    SELECT r, i FROM (
        SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL
    ) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM repeated CROSS JOIN (VALUES (0), (1), (2)) t(d) GROUP BY r
), lines AS (
    SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM texts
), normal AS (
    SELECT r, host, md5(text) AS same, line,
        list_filter(string_split_regex(line, '{_W}'), lambda x: x <> '') AS lw FROM lines
), keyed AS (
    SELECT r, host, same, line, len(lw) AS n, lower(array_to_string(lw, ' ')) AS key FROM normal WHERE len(lw) > 0
), per_text AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM keyed GROUP BY r
), totals AS (
    SELECT host, count(DISTINCT md5(text)) AS total FROM texts GROUP BY host
), frequent AS (
    SELECT host, key FROM (SELECT host, key, count(DISTINCT same) AS docs FROM keyed GROUP BY host, key)
    JOIN totals USING (host) WHERE docs > 20 AND docs * 100 > total * 10
), removed AS (
    SELECT r, sum(n) AS removed FROM keyed SEMI JOIN frequent USING (host, key) GROUP BY r
), judged AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(removed, 0) AS BIGINT) AS removed
    FROM words LEFT JOIN per_text USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 2 * (n_words - removed) < n_words AS kept
FROM judged
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op9_warc": """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), hashed AS (
    SELECT page_id, payload, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex,
        min(page_id) OVER (PARTITION BY payload) AS first_id
    FROM payloads
), parts AS (
    SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)) AS v FROM hashed
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
        lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> b) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM parts
""",
    "op10_ngram_join": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s
    FROM words
), sizes AS (
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), shingles AS (
    SELECT doc_id, unnest(s) AS x FROM sets
), shared AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
    FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS (
    SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
    WHERE 100 * common >= 80 * (a.n + b.n - common)
), links AS (
    SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked
), reached AS (
    SELECT doc_id, doc_id AS r FROM sizes
    UNION
    SELECT doc_id, v FROM reached JOIN links ON r = u
)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id
FROM sizes JOIN reached USING (doc_id) GROUP BY doc_id
""",
    # The checksum's table of 256 numbers follows from its polynomial.
    "op13_spelling_groups": r"""
WITH RECURSIVE bits(v, x, k) AS (
    SELECT i, i, 0 FROM range(256) t(i)
    UNION ALL
    SELECT v, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(x ORDER BY v) AS t FROM bits WHERE k = 8
), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS before, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
), distinct_runs AS (
    SELECT before, run, count(*) AS c, hex(encode(before || run)) AS x FROM runs GROUP BY before, run
), hashed AS (
    SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2),
        lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda a, b: xor(t[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8)), 4294967295) AS h
    FROM distinct_runs CROSS JOIN crc
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
        || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed
), counted AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), shorter AS (
    SELECT word, n, unnest(list_transform(range(1, length(word) + 1),
        lambda i: {'at': i, 'rest': substr(word, 1, i - 1) || substr(word, i + 1)}), recursive := true)
    FROM counted
), pairs AS (
    SELECT DISTINCT a.word AS word, b.word AS near FROM shorter a JOIN counted b ON a.rest = b.word
    UNION
    SELECT DISTINCT b.word, a.word FROM shorter a JOIN counted b ON a.rest = b.word
    UNION
    SELECT DISTINCT a.word, b.word FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.at = b.at AND a.word <> b.word
), ranked AS (
    SELECT p.word, p.near, b.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
        row_number() OVER (PARTITION BY p.word ORDER BY b.n DESC, p.near) AS place
    FROM pairs p JOIN counted b ON p.near = b.word
), formed AS (
    SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * c.n THEN near END AS form,
        CASE WHEN near_n >= 2 * c.n THEN near_n END AS form_n
    FROM counted c LEFT JOIN ranked r ON c.word = r.word AND place = 1
), followed AS (
    SELECT word, word AS root, form AS onward FROM formed
    UNION ALL
    SELECT w.word, f.word, f.form FROM followed w JOIN formed f ON w.onward = f.word
)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (SELECT word, root FROM followed WHERE onward IS NULL) USING (word)
""",
}
