"""The registered queries of this package and, where SQL can say the same, their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import audit, ctw, exactdedup, gam, maxsketch, mixing, packing, pii, sharding, simhash, tensorhash, urlfilter, winnow
from sentrylake.llm.common import WORD, remainder

# Production parameters.
DOMAINS = {"web": range(0, 5), "books": range(5, 10), "code": range(10, 15), "forum": range(15, 20)}
PARTS = {"web": 35, "books": 30, "code": 20, "forum": 15, "other": 5,
         **{f"{d}/{lang}": w for d in (*DOMAINS, "other") for lang, w in (("en", 60), ("de", 15), ("fr", 15), ("es", 10))}}
SHARE, MAX_EPOCHS, DEFAULT_PART = 0.75, 3, 5
SHARDS = 8
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
END_ID = 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain():
    sources = {f"src{i}": name for name, numbers in DOMAINS.items() for i in numbers}
    table = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
    return F.coalesce(table[F.coalesce(F.col("source"), F.lit(""))], F.lit("other"))


def mixed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, "doc_id", F.regexp_count("text", F.lit(WORD)), levels, PARTS, SHARE, MAX_EPOCHS, DEFAULT_PART, carry=carry)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_read(spark, sf_dir, "documents"))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_read(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urlfilter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), "url", rules)
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(_read(spark, sf_dir, "documents"), "doc_id", "text")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame) -> DataFrame:
    out = packing.packed(docs, "doc_id", "text", packing.encoder(tokenizer_path()), END_ID)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_copies(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = gam.fit(docs, "doc_id", "text", labels, "doc_id", "quality", remainder("doc_id", 5) != 0)
    rows = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return gam.scored(rows, "text", model)


def op11_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose two-word shingle sets reach a Jaccard similarity of 0.8."""
    return tensorhash.near_sets(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op12_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return maxsketch.search(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "benchmark"), "item_id", "text")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    return audit.audit(_read(spark, sf_dir, "documents"), "doc_id", "text", "source", _read(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_rendezvous_sharding, op3_url_filters, op4_winnowing, op5_vector_packing, op6_exact_dedup, op7_context_tree, op8_simhash,
                                   op9_contextual_pii, op10_additive_quality, op11_tensored_minhash, op12_max_sketch_search, op13_filter_audit)}


def _weight_sql(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PARTS.items()) + f" ELSE {DEFAULT_PART} END::DOUBLE"


def _pour_sql(nodes: str, parent: str, name: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    ahead = f"({by} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    level = (f"SELECT *, (budget - coalesce(sum(capacity) OVER {ahead}, 0)) / (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER {ahead}, 0)) AS level FROM ({nodes})")
    return f"SELECT * REPLACE (least(capacity, weight * max(level) OVER ({by})) AS budget) FROM ({level})"


def _mixing_sql() -> str:
    sources = " ".join(f"WHEN source IN ({', '.join(repr(f'src{i}') for i in numbers)}) THEN '{d}'" for d, numbers in DOMAINS.items())
    level1 = _pour_sql(f"SELECT domain, sum(capacity) AS capacity, {_weight_sql('domain')} AS weight, any_value(total) AS budget FROM leaves, (SELECT sum(available) * {SHARE}::DOUBLE AS total FROM leaves) GROUP BY domain", "", "domain")
    level2 = _pour_sql(f"SELECT domain, lang, sum(l.capacity) AS capacity, {_weight_sql('''domain || '/' || lang''')} AS weight, any_value(p.budget) AS budget FROM leaves l JOIN level1 p USING (domain) GROUP BY domain, lang", "domain", "lang")
    level3 = _pour_sql(f"SELECT domain, lang, source, l.capacity, {float(DEFAULT_PART)}::DOUBLE AS weight, p.budget FROM leaves l JOIN level2 p USING (domain, lang)", "domain, lang", "source")
    return f"""
WITH rows AS (SELECT doc_id, CASE {sources} ELSE 'other' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS available, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS capacity FROM rows GROUP BY ALL),
level1 AS ({level1}), level2 AS ({level2}), level3 AS ({level3}),
quotas AS (SELECT domain, lang, source, available, floor(budget)::BIGINT AS quota FROM leaves JOIN level3 USING (domain, lang, source)),
copies AS (SELECT rows.*, available, quota, unnest(range({MAX_EPOCHS}))::INTEGER AS epoch FROM rows JOIN quotas USING (domain, lang, source) WHERE quota > 0),
placed AS (SELECT *, epoch * available + coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('mix:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM copies)
SELECT doc_id, domain, lang, source, epoch, start, tokens, least(tokens, quota - start) AS take_tokens FROM placed WHERE start < quota AND epoch * available < quota"""


def _crc32_sql(text: str) -> tuple[str, str]:
    """CRC-32 of a text's UTF-8 bytes with the table t, and the table, worked out from its rule."""
    step = lambda c: f"CASE WHEN {c} % 2 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    table = "list_transform(range(256), lambda i: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c ELSE " + step("c") + " END, i))"
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)", table


def _sharding_sql() -> str:
    crc, table = _crc32_sql("coalesce(text, '')")
    cost = lambda i: f"-ln((('0x' || substr(md5('shard:{i}:' || name), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    costs = lambda n: "list_min([" + ", ".join(f"{{'cost': {cost(i)}, 'shard': {i}}}" for i in range(n)) + "]).shard::INTEGER"
    return f"""
WITH crc_table AS MATERIALIZED (SELECT {table} AS t),
rows AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {crc} END::BIGINT AS text_crc32,
  coalesce('=' || doc_id::VARCHAR, 'null') AS name FROM documents, crc_table),
placed AS (SELECT *, {costs(SHARDS)} AS shard, {costs(SHARDS + 1)} AS grown_shard FROM rows)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""


def _urls_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH places AS (SELECT page_id, row_number() OVER () AS row, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES {rules}),
fits AS (SELECT row, h || p AS rule, v, row_number() OVER (PARTITION BY row ORDER BY length(h) + length(p) DESC, length(h) DESC, v DESC) AS k
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM places LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (row)"""


def _exact_sql() -> str:
    return """
WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM rows WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id NULLS LAST)"""


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _near_sets_sql() -> str:
    """Two sets at 0.8 share one of the first n - ceil(0.8 n) + 1 shingles of either, in any common order."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
nodes AS MATERIALIZED (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT node, n, unnest(s) AS x FROM nodes),
rare AS (SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY c, x) AS r FROM shingles JOIN (SELECT x, count(*) AS c FROM shingles GROUP BY x) USING (x)),
first AS MATERIALIZED (SELECT * FROM rare WHERE r <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM first a JOIN first b ON a.x = b.x AND a.node != b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN nodes m ON m.node = a JOIN nodes o ON o.node = b WHERE 180 * len(list_intersect(m.s, o.s)) >= 80 * (m.n + o.n)),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) IS NOT DISTINCT FROM doc_id AS kept
FROM sets LEFT JOIN nodes ON sets.s = nodes.s LEFT JOIN lowest USING (node)"""


def _search_sql() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = f"regexp_extract_all({_LOWER_SQL.format('text')}, '{pattern}')"
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, {found} AS t FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS total FROM docs WHERE len(t) > 0),
terms AS (SELECT doc_id, row, term, count(*)::BIGINT AS tf, n::BIGINT AS n FROM (SELECT doc_id, row, len(t) AS n, unnest(t) AS term FROM docs) GROUP BY ALL),
items AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({found}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM terms, sizes WHERE term IN (SELECT term FROM items) GROUP BY term, n_docs),
scored AS (SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN terms USING (term), sizes GROUP BY item, item_id, row, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""


def _audit_sql() -> str:
    masks = "CASE f WHEN 'A' THEN 16 WHEN 'B' THEN 8 WHEN 'C' THEN 4 WHEN 'D' THEN 2 ELSE 1 END"
    return f"""
WITH rows AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) OR (doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS again FROM rows),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (SELECT part, (CASE WHEN len(w) < 50 THEN 16 ELSE 0 END) | (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 8 ELSE 0 END)
  | (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END) | (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 2 ELSE 0 END)
  | (CASE WHEN coalesce(again, false) THEN 1 ELSE 0 END) AS code, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM words LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, {masks} AS bit, list_sum(list_transform(range(1, step), lambda i: {masks.replace("CASE f", "CASE filter_order[i]")}))::INTEGER AS ahead
  FROM (SELECT filter_order, step, filter_order[step] AS f FROM orders, range(1, 6) s(step))),
counted AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN code & (coalesce(ahead, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN code & coalesce(ahead, 0) = 0 AND code & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN code & coalesce(ahead, 0) > 0 AND code & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN code = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN code & coalesce(ahead, 0) = 0 AND code & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN code & coalesce(ahead, 0) = 0 AND code & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE bit, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted"""


ORACLE = {"op1_mixing": _mixing_sql(), "op2_rendezvous_sharding": _sharding_sql(), "op3_url_filters": _urls_sql(), "op6_exact_dedup": _exact_sql(),
          "op11_tensored_minhash": _near_sets_sql(), "op12_max_sketch_search": _search_sql(), "op13_filter_audit": _audit_sql()}
