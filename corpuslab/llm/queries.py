"""One query per operator, over its whole table, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import ann, collocations, decontaminate, exact_dedup, filter_audit, mixing, ngram_join, packing, relative_lz, suffix_repeats, token_file, toxicity, warc
from corpuslab.llm.common import Scratch, table, word_count
from corpuslab.llm.registry import query

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op10_exact_dedup", EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.exact_groups(docs, carry=["text_sha256"])


WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def mix_sql(documents: str = "documents") -> str:
    """Common table expressions up to ``mixed`` (doc_id, source, size, source_size, target, copies, row_id)."""
    first = f"""
sized AS (SELECT *, row_number() OVER () AS row_id, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM {documents}),
ranked AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) AS rk FROM sized GROUP BY source),
weighed AS (SELECT *, rk % 3 + 1 AS w, source_size * 3 AS cap, (source_size * 3) / (rk % 3 + 1) AS ratio FROM ranked),
running AS (SELECT *, sum(cap) OVER (ORDER BY ratio, rk) AS caps, sum(w) OVER (ORDER BY ratio, rk) AS ws,
  CAST(sum(source_size) OVER () AS DOUBLE) AS budget, sum(w) OVER () AS all_w FROM weighed),
tested AS (SELECT *, caps + ratio * (all_w - ws) <= budget AS capped FROM running),
leftover AS (SELECT max(budget) AS b, coalesce(sum(cap) FILTER (capped), 0) AS used, coalesce(sum(w) FILTER (NOT capped), 0) AS open FROM tested),
goals AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE (b - used) / nullif(open, 0) * w END AS target FROM tested, leftover),
r0 AS (SELECT s.*, source_size, target, coalesce(target / nullif(source_size, 0), 0.0) AS ratio,
  (('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '?')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
r1 AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS f FROM r0),
rows_ AS (SELECT *, (u / (1 - u)) / nullif(f / (1 - f), 0.0) AS q FROM r1),
pool0 AS (SELECT row_id, source, doc_id, size, q, target - whole * source_size AS gap FROM rows_ WHERE f > 0 AND size > 0)"""
    steps = []
    for k in range(mixing.PASSES):
        steps.append(f"""
m{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size, row_id ROWS UNBOUNDED PRECEDING) <= gap AS taken FROM pool{k} WHERE gap > 0 AND size <= gap),
s{k} AS (SELECT source, sum(size) AS spent FROM m{k} WHERE taken GROUP BY source),
pool{k + 1} AS (SELECT m.row_id, m.source, m.doc_id, m.size, m.q, m.gap - coalesce(spent, 0) AS gap FROM m{k} m LEFT JOIN s{k} s ON m.source IS NOT DISTINCT FROM s.source WHERE NOT taken)""")
    chosen = " UNION ALL ".join(f"SELECT row_id FROM m{k} WHERE taken" for k in range(mixing.PASSES))
    last = f"""
mixed AS (SELECT r.*, CAST(whole AS BIGINT) + CASE WHEN row_id IN ({chosen}) THEN 1 ELSE 0 END AS copies FROM rows_ r)"""
    return ",".join([first, *steps, last])


MIX_SQL = f"""
WITH {mix_sql()}
SELECT doc_id, size, coalesce(source_size, 0) AS source_size, coalesce(target, 0.0) AS target, CAST(size * copies AS BIGINT) AS taken FROM mixed
"""


@query("op9_pareto_mix", MIX_SQL)
def op9_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count("text").alias("size"))
    sizes = Scratch(spark, "op9").settle(docs, "sizes")
    mixed = mixing.mix(sizes, mixing.source_targets(sizes))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_file")
def op1_token_file(spark: SparkSession, folder: str) -> DataFrame:
    return token_file.encode_table(table(spark, folder, "documents"), tokenizer_path(), end_id=2)


@query("op4_pack")
def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(), end_id=1)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM d
"""


@query("op2_warc", WARC_SQL)
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages")).drop("url")


@query("op5_cross_polytope")
def op5_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_string_kernel")
def op6_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_all(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_suffix_repeats")
def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_relative_lz")
def op8_relative_lz(spark: SparkSession, folder: str) -> DataFrame:
    found = relative_lz.remove_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


FOLDED_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEST_WORDS_SQL = rf"list_filter(string_split_regex({FOLDED_SQL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
LEAK_SQL = f"""
WITH d AS (SELECT doc_id, {TEST_WORDS_SQL} AS ws FROM documents),
items AS (SELECT item_id, {TEST_WORDS_SQL} AS ws FROM benchmark),
sized AS (SELECT *, least(10, len(ws)) AS m FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM sized)),
grams AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM sized) WHERE len(ws) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN windows USING (m, gram)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op11_positional_index", LEAK_SQL)
def op11_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


AUDIT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, {WORDS_SQL} AS ws FROM documents),
m AS (SELECT d.doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
    100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body), regexp_matches(body, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
t AS (SELECT part, filter_order, step, n, good, toxic, filter_order[step] AS x, fails[instr('ABCDE', filter_order[step])] AS here,
    list_bool_or(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: y <> '' AND fails[instr('ABCDE', y)])) AS before,
    len(list_filter(fails, lambda y: y)) AS n_fails FROM c, s),
r AS (SELECT part, filter_order, step, any_value(x) AS x,
    sum(n) FILTER (NOT here AND NOT before) AS kept, sum(n) FILTER (here AND NOT before) AS removed, sum(n) FILTER (here AND before) AS redundant,
    sum(n) FILTER (here AND n_fails = 1) AS unique_fails, sum(n) FILTER (here AND NOT before AND good) AS good_lost,
    sum(n) FILTER (here AND NOT before AND toxic) AS toxic_lost FROM t GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM r
"""


@query("op12_packed_audit", AUDIT_SQL)
def op12_packed_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


COLLOCATION_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({FOLDED_SQL}, '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
inner_ AS (SELECT lang, a, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c WHERE m > 2))),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT cuts.*, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (x.a + y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_tiled_collocations", COLLOCATION_SQL)
def op13_tiled_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
