"""The contract queries of the corpus operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table


def word_tokenizer() -> str:
    """The vocabulary file of the packing query; installed beside the tokenizers, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import Store
    from .warc import read_archives, write_archives

    packages = write_archives(table(spark, sf_dir, "pages"), Store(spark, "warc"))
    return read_archives(packages, payloads=False).drop("url")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, joined, personal_data

    out = personal_data(table(spark, sf_dir, "documents"))
    n = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, toxicity

    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text", "matches", "longest")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    out = align(table(spark, sf_dir, "documents"), *(str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    return out.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import longest, periodic_runs, with_repeats

    out = periodic_runs(with_repeats(table(spark, sf_dir, "documents"))).withColumn("best", F.expr(longest()))
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    best = [F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), F.expr("1000 * best.length DIV best.period").alias("exponent_milli")]
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.sha2(F.expr(listed), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_pii, op3_best_fit_packing, op4_minhash, op5_sketches, op6_toxicity, op7_suffixes, op8_html, op9_line_dedup, op10_decontamination, op11_alignment, op12_periodic_runs, op13_jaccard_join)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, octet_length(b) AS n, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f""",
    "op9_line_dedup": rf"""
        WITH line AS (
            SELECT doc_id, i, t[i] AS line, regexp_replace(translate(t[i], '{UPPER}', '{LOWER}'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
            FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))),
        frequent AS (SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN f.key IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM line LEFT JOIN frequent f ON line.key = f.key GROUP BY doc_id""",
    "op4_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({ASCII_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n_shingles + q.n_shingles - k)),
        b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS v, doc_id AS to_ FROM documents UNION SELECT r.v, b.y FROM r JOIN b ON r.to_ = b.x)
        SELECT n.doc_id, n_shingles, m AS component_id, n.doc_id = m AS kept FROM n JOIN (SELECT v, min(to_) AS m FROM r GROUP BY v) ON v = n.doc_id""",
    "op7_suffixes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
        s AS (SELECT doc_id, unnest(range(0, n - 49)) AS i, unnest(list_transform(range(0, n - 49), lambda i: substr(h, 2 * i + 1, 100))) AS g FROM d WHERE n >= 50),
        f AS (SELECT g, min(doc_id) AS m FROM s GROUP BY g),
        c AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 THEN 1 ELSE 0 END AS fresh FROM s JOIN f USING (g) WHERE m < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c) GROUP BY doc_id, k),
        q AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM r),
        t AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last FROM r GROUP BY doc_id),
        k AS (SELECT q.doc_id, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS head FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
        SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op10_decontamination": rf"""
        WITH dw AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
        occ AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, i, occ.k, item_id FROM occ JOIN win ON occ.g = win.g AND occ.k = win.k),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
        SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id""",
    "op12_periodic_runs": r"""
        WITH c AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h FROM documents),
        o AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM o),
        e AS MATERIALIZED (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
        g AS (SELECT row, n, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT row, n, w, unnest(range(0, n - 4)) AS i FROM e)),
        s AS (SELECT x.row, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.row = y.row AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        f AS (SELECT row, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM s) GROUP BY row, q, k),
        r AS (SELECT row, start, length, min(q) AS period FROM f WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
        t AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
                     first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS b FROM r GROUP BY row),
        d AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
        l AS (SELECT v.row, string_agg(v.x, ' ' ORDER BY v.i) AS kept FROM (SELECT row, unnest(range(0, n)) AS i, unnest(w) AS x FROM e) v LEFT JOIN d ON v.row = d.row AND v.i = d.i WHERE d.i IS NULL GROUP BY v.row)
        SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, (1000 * b.length) // b.period AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM e LEFT JOIN t ON t.row = e.row LEFT JOIN l ON l.row = e.row""",
    "op13_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({ASCII_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
        n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n_shingles + q.n_shingles - k)),
        b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS v, doc_id AS to_ FROM documents UNION SELECT r.v, b.y FROM r JOIN b ON r.to_ = b.x)
        SELECT n.doc_id, n_shingles, m AS component_id FROM n JOIN (SELECT v, min(to_) AS m FROM r GROUP BY v) ON v = n.doc_id""",
}
