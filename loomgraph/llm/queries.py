"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint, language, line_dedup, near_dedup, quality, resampling, sharding, spelling, toxicity, url_filter, warc
from .common import only, read


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), ranks_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"), least_bytes=0)


#: The rules of the query.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=16)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), size=5, percent=75)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(only(read(spark, sf_dir, "documents"), "doc_id", "text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, least_words=20, longest=1)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(read(spark, sf_dir, "documents"))


_ALL = (op1_decontamination, op2_bpe, op3_warc, op4_url_rules, op5_quality, op6_shards, op7_toxicity, op8_fingerprint, op9_minhash, op10_line_dedup, op11_spelling, op12_resampling, op13_language)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Common table expressions for CRC-32: crc_table is one row with the 256 remainders of the reversed polynomial 0xEDB88320.
_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t)"


def _crc_sql(value: str) -> str:
    """CRC-32 of the UTF-8 of a string that is not empty, beside crc_table's t."""
    octets = f"list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


ORACLES: dict[str, str] = {
    "op11_spelling": f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
        own AS (SELECT d, w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY d, w),
        hashed AS (SELECT w, n, {_crc_sql("d || ':' || w")} AS h FROM own, crc_table),
        cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
        vocabulary AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        less AS (SELECT word, n, i, left(word, i::INT) AS a, substr(word, i::INT + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
        pairs AS (
            SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS m FROM less x JOIN less y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, x.n, y.word, y.n FROM less x JOIN vocabulary y ON y.word = x.a || x.b
            UNION SELECT y.word, y.n, x.word, x.n FROM less x JOIN vocabulary y ON y.word = x.a || x.b),
        best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM pairs GROUP BY word),
        named AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.other END AS form, CASE WHEN b.m >= 2 * v.n THEN b.m END AS form_n FROM vocabulary v LEFT JOIN best b USING (word)),
        way(word, root, step) AS (SELECT word, word, 0 FROM named UNION ALL SELECT w.word, n.form, step + 1 FROM way w JOIN named n ON n.word = w.root WHERE n.form IS NOT NULL)
        SELECT word, form, root, n, n_near, form_n FROM named JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word) USING (word)
    """,
    "op12_resampling": f"""
        WITH {_CRC_TABLE},
        split AS (SELECT 0 AS part, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        times AS MATERIALIZED (SELECT part, r, word, count(*) AS n FROM (SELECT part, r, unnest(w) AS word FROM split) GROUP BY ALL),
        placed AS MATERIALIZED (SELECT word, {_crc_sql('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM times), crc_table),
        held AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) x(b) LEFT JOIN (SELECT bucket, sum(n) FILTER (part = 0) AS s, sum(n) FILTER (part = 1) AS t FROM times JOIN placed USING (word) GROUP BY bucket) y ON y.bucket = x.b),
        gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM held),
        weighed AS (SELECT r, sum(n * g)::BIGINT AS weight FROM times JOIN placed USING (word) JOIN gain USING (bucket) WHERE part = 0 GROUP BY r),
        scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM split LEFT JOIN weighed USING (r) WHERE part = 0),
        lined AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p, count(*) FILTER (n_features >= 20) OVER () AS many FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * many // 100 THEN p END AS rank, n_features AS n_words FROM lined
    """,
    "op3_warc": """
        WITH rows_ AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        wide AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS best, list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(x, i, 10))::BIGINT) AS v FROM rows_)
        SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
        FROM wide
    """,
    "op9_minhash": f"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM split WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.doc_id)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
        FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
    """,
    "op4_url_rules": """
        WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        fits AS (SELECT p.page_id, max_by(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, max_by(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
            FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
    """,
}
