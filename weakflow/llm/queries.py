"""The registered queries of the numbered operators, and SQL for those that SQL can say."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.llm import (
    op1_lm,
    op2_decontamination,
    op3_token_blocks,
    op4_warc,
    op5_urls,
    op6_packing,
    op7_toxicity,
    op8_quality,
    op9_jaccard,
    op10_sharding,
    op11_divergence,
    op12_extraction,
    op13_conversations,
)
from weakflow.plans.registry import Registry

registry = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registry.add("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_lm.language_model(table(spark, sf_dir, "documents"))


@registry.add(
    "op2_decontamination",
    """
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (
      SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    wanted AS (
      SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + 12], ' ') AS phrase
      FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT size FROM wanted),
    seen AS (
      SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
      FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
    found AS (SELECT s.doc_id, s.i, s.size, x.item_id FROM seen s JOIN wanted x USING (size, phrase)),
    hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(size)) AS t(j) GROUP BY doc_id),
    items AS (
      SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM found WHERE item_id IS NOT NULL GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
      CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
      sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256,
      coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op2_decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op2_decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))


@registry.add("op3_token_blocks")
def op3_token_blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = op3_token_blocks.write_parts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return op3_token_blocks.read_documents(spark, path)


@registry.add(
    "op4_warc",
    """
    WITH p AS (
      SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
        sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to, 'ok' AS status
    FROM g
    """,
)
def op4_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = op4_warc.write_archive(table(spark, sf_dir, "pages"))
    return op4_warc.read_archive(spark, path)


# The rules of the URL filter.
URL_RULES = [
    op5_urls.Rule("allow", "org", "/"),
    op5_urls.Rule("block", "example.org", "/es/"),
    op5_urls.Rule("block", "example.org", "/en/1"),
    op5_urls.Rule("allow", "com", "/fr/"),
    op5_urls.Rule("block", "com", "/de/"),
]


@registry.add("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages show documents, whose number ends their path: a URL is bad if its document was
    labelled toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    shown = pages.withColumn("doc_id", F.regexp_extract("url", r"/(\d{1,18})(?:[/.?#]|$)", 1).try_cast("long"))
    labelled = shown.join(labels.select("doc_id", bad.alias("bad")), "doc_id")
    model = op5_urls.train(labelled.select("url", "bad"), pages=pages)
    return op5_urls.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "p_bad")


@registry.add("op6_packing")
def op6_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", op6_packing.token_count("text").alias("length"))
    return op6_packing.pack(counted, F.col("length")).drop("length")


@registry.add("op7_toxicity")
def op7_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = op7_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op7_toxicity.score(docs, grammar).select(
        "doc_id",
        op7_toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= op7_toxicity.BLOCK_FROM).cast("int").alias("predicted"),
    )


@registry.add("op8_quality")
def op8_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality.score(table(spark, sf_dir, "documents"))


@registry.add(
    "op9_jaccard_join",
    """
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
      FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
    reach AS (
      SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
    least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id
    FROM d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_id r ON r.x = d.doc_id
    """,
)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_jaccard.join(table(spark, sf_dir, "documents"))


#: The crc32 of the UTF-8 bytes ``crc_hex`` (hex digits) in SQL: each byte is taken in and followed by eight shifts.
_CRC32_HEX = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
  range(0, length(crc_hex) // 2),
  lambda i: [CAST('0x' || substr(crc_hex, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


@registry.add(
    "op10_sharding",
    f"""
    WITH d AS (
      SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS crc_hex,
        coalesce('=' || source, 'NULL') AS stratum,
        md5('{op10_sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'NULL')) AS mark FROM documents),
    sums AS (SELECT *, {_CRC32_HEX} AS text_crc32 FROM d),
    ranked AS (
      SELECT *, (CAST(row_number() OVER (PARTITION BY stratum ORDER BY mark, doc_id, size, text_crc32) - 1 AS DOUBLE)
          + CAST('0x' || substr(md5('{op10_sharding.SEED}/' || stratum), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))
        / count(*) OVER (PARTITION BY stratum) AS fraction FROM sums),
    placed AS (
      SELECT *, row_number() OVER (ORDER BY fraction, stratum, mark, doc_id, size, text_crc32) - 1 AS position,
        count(*) OVER () AS total FROM ranked),
    cut AS (SELECT *, CAST((position * 24) // total AS INTEGER) AS shard FROM placed)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY position) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM cut
    """,
)
def op10_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op10_sharding.interleave(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registry.add(
    "op11_source_divergence",
    """
    WITH d AS (
      SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
    langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
    totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, source),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
        1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
      LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY x.lang, x.source, y.source) m
      ON m.lang = a.lang AND m.source = a.source AND m.other = b.source),
    terms AS (
      SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_divergence.audit(table(spark, sf_dir, "documents"))


@registry.add("op12_main_text")
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages show documents, whose number ends their path: these texts label the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    number = F.regexp_extract("url", r"/(\d{1,18})(?:[/.?#]|$)", 1).try_cast("long")
    labelled = op12_extraction.label_pages(pages, table(spark, sf_dir, "documents"), number)
    return op12_extraction.extract(pages, op12_extraction.train(labelled))


#: The crc32 of ``crc_key`` (ASCII) in SQL: each byte is taken in and followed by eight shifts (-1).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(crc_key) + 1),
  lambda i: [CAST(ord(substr(crc_key, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


def _repair_sql() -> str:
    """A fold over the rows of each conversation that keeps, for every state, the least
    (cost, audit, repaired text)."""

    def add(state: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"

    def closed(columns: str, source: str) -> str:
        put_u = ", ".join(add(s, "5", "I", "'user:'") for s in ("s0", "s1", "s3"))
        put_a = add("s2", "5", "I", "'assistant:'")
        return (
            f"SELECT {columns}, s0, s1, s2, least(s3, {put_a}) AS s3 FROM "
            f"(SELECT {columns}, s0, s1, least(s2, {put_u}) AS s2, s3 FROM {source})"
        )

    u, a, own = "'user:' || r.text", "'assistant:' || r.text", "r.role || ':' || r.text"

    def stays(state: str, letter: str, line: str, cost: str, condition: str = "true") -> str:
        return f"CASE WHEN NOT r.gone AND {condition} THEN {add(state, cost, letter, line)} END"

    def into_u(state: str) -> str:
        keep = stays(state, "K", own, "r.extra", "r.initial = 'u'")
        return f"{keep}, {stays(state, 'R', u, '1 + r.extra')}"

    step = f"""
      SELECT f.conv, f.i + 1 AS i,
        {add("f.s0", "2", "D")} AS s0,
        least({add("f.s1", "2", "D")}, {stays("f.s0", "K", own, "r.extra", "r.initial = 's'")}) AS s1,
        least({add("f.s2", "2", "D")}, {into_u("f.s0")}, {into_u("f.s1")}, {into_u("f.s3")}) AS s2,
        least({add("f.s3", "2", "D")}, {stays("f.s2", "K", own, "r.extra", "r.initial = 'a'")},
          {stays("f.s2", "R", a, "1 + r.extra")}) AS s3
      FROM f JOIN r ON r.conv = f.conv AND r.i = f.i + 1"""
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
    start = f"""
      SELECT conv, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0,
        {nothing} AS s1, {nothing} AS s2, {nothing} AS s3 FROM sizes"""
    return f"""
    WITH RECURSIVE o AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_CRC32} % 20 AS fate
      FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS crc_key
        FROM conversations)),
    d AS (
      SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM o, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) WHERE fate <> 0),
    n AS (
      SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS conv,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM d),
    m AS (
      SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
        substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM n),
    r AS (
      SELECT *, blank OR dup AS gone,
        NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
        CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM m),
    sizes AS (
      SELECT conv, any_value(conv_id) AS conv_id, count(*) AS size,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
        count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
      FROM r GROUP BY conv),
    f AS (
      ({closed("conv, i", f"({start})")})
      UNION ALL
      ({closed("conv, i", f"({step})")})),
    best AS (SELECT s.*, least(f.s0, f.s3) AS b FROM sizes s JOIN f ON f.conv = s.conv AND f.i = s.size),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
      CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
      CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
      coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
    FROM ids LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
    """


@registry.add("op13_conversation_repair", _repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return op13_conversations.repair(rows, op13_conversations.damage(rows))


# --- the parts of four operators that SQL can say -----------------------------------------

_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


@registry.add(
    "lm_base_counts",
    f"""
    WITH d AS (
      SELECT doc_id, {_CRC32} % 7 = 2 AS held_out, {_WORDS.format(text="lowered")} AS w
      FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS crc_key, translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)),
    t AS (SELECT doc_id, held_out, unnest(list_append(w, ' end')) AS token FROM d),
    c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
    totals AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
    SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known,
      any_value(totals.n) AS train_tokens,
      round(sum(log10((coalesce(c.c, 0) + 1) / CAST(totals.n + totals.v + 1 AS DOUBLE))), 5) AS base_score
    FROM t LEFT JOIN c USING (token), totals GROUP BY doc_id
    """,
)
def lm_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base score of the language model, without its neural part."""
    scored = op1_lm.language_model(table(spark, sf_dir, "documents"))
    counts = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    return scored.select(*counts, F.round("base_score", 5).alias("base_score"))


_RULES_SQL = " UNION ALL ".join(
    f"SELECT '{r.verdict}' AS verdict, '{r.host}' AS rule_host, '{r.path}' AS rule_path" for r in URL_RULES
)


@registry.add(
    "url_rules",
    rf"""
    WITH p AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN
          regexp_replace(substr(url, strpos(url, '://') + 3), '#(.|\n)*$', '') ELSE '' END AS rest FROM pages),
    cut AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path FROM p),
    rules AS ({_RULES_SQL}),
    fits AS (
      SELECT page_id, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
      FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, verdict AS rule_verdict
    FROM cut LEFT JOIN fits USING (page_id) WHERE coalesce(place, 1) = 1
    """,
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict where a rule decides."""
    judged = op5_url_filter(spark, sf_dir)
    by_rule = F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict")
    return judged.select("page_id", "host", "path", "rule", by_rule)


@registry.add(
    "quality_base_counts",
    f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
      FROM d, unnest(range(1, len(w) - 1)) AS x(i)),
    repeated AS (
      SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, unnest(range(3)) AS y(j) WHERE times > 1 GROUP BY doc_id),
    counted AS (
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN repeated r USING (doc_id))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
    """,
)
def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of the quality rules, without the distances."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return op8_quality_query(spark, sf_dir).select("doc_id", *counts, "base_failed")


def queries() -> dict:
    return dict(registry.queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry.oracles)
