"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, hmm, html_extract, lexical, line_dedup, mixing, nearest, ngram_join, pii, prefix_trie, quality, substring_dedup, suffix_dedup
from tidemark.llm.spread import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """A document's fold, from its id as text (nothing, if there is none)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, its rows written, and the tables that it wrote on the way deleted."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark) as keep:
            return keep(query(spark, sf_dir))

    return run


@tidy
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold=fold(3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@tidy
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@tidy
def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.score_texts(table(spark, sf_dir, "documents"), learn=fold(7) != 2)
    return out.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("pii", lambda s: s["kind"] == kind)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@tidy
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), origin=conv - conv % 5, shared=F.crc32(conv.cast("string")) % 9, most=8)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_line_dedup, op3_ngram_jaccard, op4_nearest, op5_hmm, op6_pii, op7_substring_dedup, op8_mix_sources, op9_suffix_dedup, op10_decontaminate, op11_html_extract, op12_prefix_trie, op13_lexical)
}

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TERMS = rf"list_filter(regexp_split_to_array({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: crc32 of an id's digits, bit by bit; 3988292384 is the reversed polynomial.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_transform(range(0, length(c::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE ascii(substr(c::VARCHAR, i, 1))::BIGINT END),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
        one AS (SELECT list_sort(sh) AS sh, min(doc_id) AS c, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
        e AS (SELECT c, n, unnest(sh) AS g FROM one),
        links AS (SELECT a.c AS x, b.c AS y FROM e a JOIN e b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
                  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (SELECT c AS x, c AS y FROM one UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
        comp AS (SELECT x, min(y) AS least FROM reach GROUP BY x)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.least, s.doc_id) AS component_id
        FROM s LEFT JOIN one ON list_sort(s.sh) = one.sh LEFT JOIN comp ON comp.x = one.c""",
    "op7_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, coalesce({WORDS.format(text="text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
        hit AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS hits FROM gone GROUP BY doc_id),
        kept AS (SELECT d.doc_id, w, coalesce(hits, CAST([] AS BIGINT[])) AS hits FROM d LEFT JOIN hit USING (doc_id)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM kept),
        left_over AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words k
                      ANTI JOIN (SELECT doc_id, unnest(hits) AS i FROM hit) g ON k.doc_id = g.doc_id AND k.i = g.i GROUP BY k.doc_id)
        SELECT kept.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM kept LEFT JOIN left_over USING (doc_id)""",
    "op8_mix_sources": f"""
        WITH n AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
        w AS (SELECT source, rows, pow(rows::DOUBLE, {mixing.TEMPERATURE}::DOUBLE) AS weight FROM n),
        r AS (SELECT source, weight / (SELECT sum(weight) FROM w) * (SELECT sum(rows) FROM w)::DOUBLE / rows AS rate FROM w),
        k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
        cdf AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY source ORDER BY k) AS p FROM k),
        u AS (SELECT *, ('0x' || substr(sha256('{mixing.SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13))::UBIGINT::DOUBLE / pow(2::DOUBLE, 52) AS u FROM documents),
        c AS (SELECT doc_id, any_value(u.text) AS text, any_value(u.lang) AS lang, any_value(u.source) AS source, any_value(u.n_chars) AS n_chars, count(*) FILTER (WHERE p <= u.u) AS copies
              FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id)
        SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, copies)) AS INTEGER) AS copy FROM c""",
    "op10_decontaminate": r"""
        WITH lowered AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        w AS (SELECT kind, id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), CAST([] AS VARCHAR[])) AS w FROM lowered),
        p AS (SELECT DISTINCT id AS item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS t
              FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM w WHERE kind = 'b' AND len(w) > 0)),
        hits AS (SELECT d.id AS doc_id, d.i, p.n, p.item_id FROM (SELECT id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t
                 FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT n AS m FROM p) WHERE kind = 'd')) d JOIN p ON p.t = d.t AND p.n = d.m),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
        SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM w LEFT JOIN words ON words.doc_id = w.id LEFT JOIN items ON items.doc_id = w.id WHERE kind = 'd'""",
    "op9_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) AS h, md5_number_lower(substr(x, 2 * i + 1, 200)) AS h2 FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d)),
        gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h, h2 ORDER BY doc_id, i) AS rn FROM s) WHERE rn > 1),
        runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
                 FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone)),
        spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b, lag(max(i) + 100, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS kept_from FROM runs GROUP BY doc_id, run),
        cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS rest FROM spans GROUP BY doc_id),
        head AS (SELECT s.doc_id, string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS t FROM spans s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
        SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(t, '') || substr(x, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN head ON head.doc_id = d.doc_id""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations GROUP BY conv_id),
        h AS (SELECT c, turns, {CRC32} % 9 AS h FROM t),
        r AS (SELECT h.c, list_concat(CASE WHEN o.turns IS NULL THEN h.turns[1:0] ELSE o.turns[1:h.h] END, h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN t o ON o.c = h.c - h.c % 5),
        p AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
        n AS (SELECT depth, turns[1:depth] AS prefix, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (WHERE len(turns) = depth) AS ended FROM p GROUP BY 1, 2),
        v AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(prefix[depth].text)) END AS worth, prefix[1:depth - 1] AS above FROM n),
        k AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1, 2),
        w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM v LEFT JOIN k ON k.depth = v.depth AND k.prefix = v.prefix),
        up AS (SELECT prefix[1:d] AS prefix, d AS depth, sum(worth) AS saved, sum(leaf) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w) GROUP BY 1, 2)
        SELECT w.conv_id, w.depth, pa.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
               sha256(coalesce(array_to_string(w.ended, ','), '')) AS ends_sha256
        FROM w JOIN up ON up.prefix = w.prefix AND up.depth = w.depth LEFT JOIN w pa ON pa.prefix = w.above AND pa.depth = w.depth - 1""",
    "op13_lexical": rf"""
        WITH d AS (SELECT doc_id, unnest({TERMS}) AS t FROM documents),
        q AS (SELECT item_id, t, count(*) AS many FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY ALL),
        size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM size),
        tf AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
        i AS (SELECT tf.doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // l)))) AS i FROM tf JOIN size USING (doc_id) JOIN w USING (t), s),
        scored AS (SELECT item_id, doc_id, CAST(sum(i * many) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""",
}
