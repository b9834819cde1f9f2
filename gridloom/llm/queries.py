"""The queries of the numbered operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import cotraining, exact_dedup, hard_negatives, hash_ring, lattice_lm, merkle, mixing, ngram_join, packing, secrets, suffix_dedup, telephony, url_rules

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op(sql: str | None = None):
    def register(fn):
        RUN[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(RUN)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@op()
def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as stored telephony audio, read back and described."""
    return telephony.stored_features(_table(spark, sf_dir, "documents"))


@op()
def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the scores of both views, the combined score and whether it is kept."""
    docs = _table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, _table(spark, sf_dir, "labels"))
    return cotraining.classify(docs, model).select("doc_id", "text_score", "metadata_score", "score", "kept")


def _rake_sql(power: float, rate: float) -> str:
    """Raking as a recursion over cycles, until no margin is off by more than the tolerance."""
    targets = ", ".join(
        f"target_{m} AS (SELECT {m}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS target_{m} FROM cells GROUP BY {m})"
        for m in mixing.MARGINS
    )
    counts = {name: f"(length(body) - length(replace(body, '{t}', ''))) // {len(t)}" for name, t in mixing.TOPIC_TERMS}
    best = "greatest(" + ", ".join(counts.values()) + ")"
    topic = f"CASE WHEN {best} = 0 THEN 'other' " + " ".join(f"WHEN {c} = {best} THEN '{n}'" for n, c in counts.items()) + " END"
    joins = " ".join(f"JOIN target_{m} USING ({m})" for m in mixing.MARGINS)
    scaled = "raked"
    for m in mixing.MARGINS:
        scaled = (
            f"(SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * target_{m} / sum(weight) OVER (PARTITION BY {m}) "
            f"ELSE 0 END AS weight) FROM {scaled} WHERE gap > {mixing.TOLERANCE})"
        )
    off = ", ".join(f"CASE WHEN target_{m} > 0 THEN abs(sum(weight) OVER (PARTITION BY {m}) / (sum(weight) OVER ()) / target_{m} - 1) ELSE 0 END" for m in mixing.MARGINS)
    return f"""
WITH RECURSIVE bodies AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS body FROM documents),
slim AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM bodies),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM slim GROUP BY ALL),
{targets},
seeded AS MATERIALIZED (SELECT *, tokens AS weight, 1e9::DOUBLE AS gap, 0 AS k FROM cells {joins}),
raked AS (SELECT * FROM seeded UNION ALL
  SELECT * EXCLUDE (apart) REPLACE (max(apart) OVER () AS gap, k + 1 AS k) FROM (SELECT *, greatest({off}) AS apart FROM {scaled}) WHERE k < {mixing.CYCLES}),
done AS (SELECT * FROM raked WHERE k = (SELECT max(k) FROM raked)),
rates AS (SELECT source, lang, topic, weight, CASE WHEN tokens > 0 AND weight > 0 THEN weight / tokens ELSE 0 END
  * ({rate} * sum(tokens) OVER () / sum(weight) OVER ()) AS expected FROM done),
drawn AS (SELECT doc_id, source, lang, topic, tokens, weight, CASE WHEN tokens > 0 THEN expected ELSE 0 END AS expected,
          ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / pow(16, 12) AS lot
          FROM slim JOIN rates USING (source, lang, topic))
SELECT doc_id, source, lang, topic, tokens, round(weight, 9) AS weight, round(expected, 9) AS expected,
  floor(expected)::BIGINT + (CASE WHEN lot < expected - floor(expected) THEN 1 ELSE 0 END) AS copies FROM drawn
"""


# Of the query: powers of the target shares, and tokens of the sample as a share of those of the corpus.
MIX_POWER, MIX_RATE = 0.7, 0.5


@op(_rake_sql(MIX_POWER, MIX_RATE))
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's raked weight, the copies expected of it and the copies drawn."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), powers={m: MIX_POWER for m in mixing.MARGINS}, rate=MIX_RATE)
    group = lambda c: F.coalesce(F.col(c), F.lit("(none)")).alias(c)
    return mixed.select(
        "doc_id", group("source"), group("lang"), "topic", "tokens", F.round("weight", 9).alias("weight"),
        F.round("expected", 9).alias("expected"), "copies",
    )


def _secret_sql() -> str:
    rules = ((0, secrets.ASSIGN, 2, 6), (1, secrets.ACCESS, 0, 20), (2, secrets.HEX, 0, 24), (3, "[A-Za-z0-9+/_-]{20,}", 0, 20))
    quoted = lambda p: p.replace("'", "''")
    parts = " UNION ALL ".join(
        f"SELECT row_id, doc_id, source, lang, {k} AS kind, {least} AS least, string_split_regex(body, '{quoted(p)}') AS gaps, "
        f"regexp_extract_all(body, '{quoted(p)}', 0) AS wholes, regexp_extract_all(body, '{quoted(p)}', {g}) AS vals "
        f"FROM bodies WHERE regexp_matches(body, '{quoted(p)}')"
        for k, p, g, least in rules
    )
    return f"""
WITH bodies AS (SELECT row_number() OVER () AS row_id, doc_id, source, lang, coalesce(text, '') AS body FROM documents),
found AS ({parts}),
numbered AS (SELECT *, unnest(range(1, len(wholes) + 1)) AS i FROM found),
pieces AS (SELECT row_id, doc_id, source, lang, kind, least, i, length(gaps[i]) AS gap, length(wholes[i]) AS size, vals[i] AS value FROM numbered),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY row_id, kind ORDER BY i) AS stop FROM pieces),
spans AS (SELECT row_id, doc_id, source, lang, kind, value, stop - size AS start, stop FROM placed WHERE length(value) >= least),
free AS (SELECT * FROM spans WHERE kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT EXISTS (
  SELECT 1 FROM spans b WHERE b.row_id = spans.row_id AND b.kind < 3 AND b.start < spans.stop AND b.stop > spans.start))),
owned AS (SELECT value, count(DISTINCT coalesce(free.source, '')) AS owners, count(DISTINCT body) AS texts FROM free JOIN bodies USING (row_id) GROUP BY value),
judged AS (SELECT free.*, owners, texts, CASE WHEN owners >= 3 OR texts >= {secrets.COPIED_TEXTS} THEN 'copied_example' WHEN owners = 1 THEN 'owner_specific'
  ELSE 'shared' END AS verdict, ['assign', 'access', 'hex', 'owner'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS line
  FROM free JOIN owned USING (value)),
per AS (SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(line, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (kind = 3) AS n_owner, count(*) FILTER (verdict = 'owner_specific') AS n_owner_specific, count(*) FILTER (verdict = 'copied_example') AS n_copied_example,
  string_agg(line || ':' || owners || ':' || texts || ':' || verdict, ',' ORDER BY start, kind) AS verdicts
  FROM judged GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owner, 0) AS n_owner, coalesce(n_owner_specific, 0) AS n_owner_specific,
  coalesce(n_copied_example, 0) AS n_copied_example, coalesce(verdicts, '') AS verdicts
FROM bodies LEFT JOIN per USING (row_id)
"""


@op(_secret_sql())
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the secrets of the base rules and opaque tokens, with counts of the verdicts."""
    return secrets.digest(*secrets.scan(_table(spark, sf_dir, "documents")))


@op("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the identifier that stays of its group of equal texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.content_sort(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@op()
def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 1024 tokens. The vocabulary file is part of the environment."""
    import public_tokenizers

    cut = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continued", "continues")


# The rules of the query (host, path, verdict).
URL_RULES = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
)


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict FROM split, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
"""


@op(_url_sql())
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the longest rule that fits its url."""
    rules = spark.createDataFrame(list(URL_RULES), url_rules.RULES)
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


@op()
def op10_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the trained lattice, beside a word unigram."""
    import public_tokenizers

    return lattice_lm.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@op()
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least identifier among its near copies (four-word shingles, 85 percent)."""
    return ngram_join.join(_table(spark, sf_dir, "documents"), words=4, percent=85)


@op()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that lie in a repeated string of 400 bytes; shared passages from 256 bytes on are told."""
    return suffix_dedup.remove(_table(spark, sf_dir, "documents"), floor=256)


# CRC-32 in SQL: the table of its polynomial, and the checksum of a text's UTF-8 bytes over that table.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i))"


def _crc_sql(text: str) -> str:
    return (
        f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT), "
        "lambda a, b: xor(a >> 8, crc_table[1 + (xor(a, b) & 255)]), 4294967295::BIGINT))"
    )


def _merkle_sql(depth: int, top_depth: int) -> str:
    """Trees of at most ``16 ** depth`` leaves and ``16 ** top_depth`` sources, level by level."""
    parts = []

    def tree(name: str, depth: int, first: str) -> None:
        """Levels name_0.. (tree, idx, n, h), each node with its run as a list, its slot in it, and its parent's idx."""
        parts.append(f"{name}_0 AS ({first})")
        for k in range(depth):
            parts.append(f"{name}_run_{k} AS (SELECT tree, idx // 16 AS run, list(h ORDER BY idx) AS members, any_value(n) AS n FROM {name}_{k} WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{name}_{k + 1} AS (SELECT tree, run AS idx, (n + 15) // 16 AS n, sha256(array_to_string(members, '')) AS h FROM {name}_run_{k})")
        parts.append(f"{name}_roots AS (" + " UNION ALL ".join(f"SELECT tree, h AS root FROM {name}_{k} WHERE n = 1" for k in range(depth + 1)) + ")")

    def climb(name: str, depth: int, start: str) -> str:
        """From (key, tree, idx, proof, fold) up to the root: siblings added to proof, fold hashed with them."""
        parts.append(f"{name}_up_0 AS ({start})")
        for k in range(depth):
            left, right = "coalesce(array_to_string(members[1:idx % 16], ''), '')", "coalesce(array_to_string(members[idx % 16 + 2:], ''), '')"
            parts.append(
                f"{name}_up_{k + 1} AS (SELECT key, u.tree, idx // 16 AS idx, CASE WHEN members IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, "
                f"CASE WHEN members IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold "
                f"FROM {name}_up_{k} u LEFT JOIN {name}_run_{k} r ON r.tree = u.tree AND r.run = u.idx // 16)"
            )
        return f"{name}_up_{depth}"

    field = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts.append(f"crc AS (SELECT {CRC_TABLE} AS crc_table)")
    parts.append(
        f"leaves AS (SELECT *, {leaf('text')} AS h, {leaf('changed')} AS changed_h FROM (SELECT *, row_number() OVER () AS key, coalesce('+' || source, '') AS tree, "
        f"CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, '{url_rules.UPPER}', '{url_rules.LOWER}') ELSE text END AS changed FROM documents, crc))"
    )
    parts.append("placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, key) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves)")
    tree("low", depth, "SELECT tree, idx, n, h FROM placed")
    tree("top", top_depth, "SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, root AS h FROM low_roots")
    parts.append("tops AS (SELECT tree, root, row_number() OVER (ORDER BY tree) - 1 AS place FROM low_roots)")
    done = climb("low", depth, "SELECT key, tree, idx, '' AS proof, changed_h AS fold FROM placed")
    done = climb("top", top_depth, f"SELECT key, '' AS tree, place AS idx, proof, fold FROM {done} JOIN tops USING (tree)")
    levels = lambda name, depth: " + ".join(f"(CASE WHEN {name} > {16 ** k} THEN 1 ELSE 0 END)" for k in range(depth))
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, p.h AS leaf, t.root AS subroot, r.root, sha256(u.proof) AS proof_sha256, u.fold AS folded_root, u.fold = r.root AS verified, p.idx,
  ({levels('p.n', depth)} + {levels('(SELECT count(*) FROM tops)', top_depth)})::INTEGER AS depth
FROM placed p JOIN tops t ON t.tree = p.tree JOIN {done} u USING (key), top_roots r
"""


@op(_merkle_sql(5, 2))
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, its source's root, the root, its proof, and the root it folds to after tampering."""
    return merkle.check_rows(_table(spark, sf_dir, "documents"))


@op("""
WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector, for each of its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label=label, anchor=F.col("vec_id") % 100 == 0)


def _ring_sql(shards: int) -> str:
    """The ring's rounds one after another; loads are counts of rows, rooms without slack."""
    digits = hash_ring.DIGITS
    key = "coalesce(doc_id::VARCHAR, '')"
    place = lambda name: f"('0x' || substr(md5({name}), 1, {digits}))::BIGINT"
    parts = [
        f"crc AS (SELECT {CRC_TABLE} AS crc_table)",
        f"points AS (SELECT point, min(shard) AS shard FROM (SELECT s AS shard, {place('s || chr(58) || c')} AS point FROM range({shards}) a(s), range({hash_ring.POINTS}) b(c)) GROUP BY point)",
        "arcs AS (SELECT row_number() OVER (ORDER BY point) - 1 AS arc, point, shard FROM points)",
        # Shards in the order in which they follow an arc: by the distance of their next point.
        "turns AS (SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY steps) - 1 AS turn FROM (SELECT a.arc, b.shard, "
        "min((b.arc - a.arc + (SELECT count(*) FROM arcs)) % (SELECT count(*) FROM arcs)) AS steps FROM arcs a, arcs b GROUP BY ALL))",
        f"slim AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce({_crc_sql('text')}, 0) AS text_crc32, "
        f"{place(key)} AS place FROM documents, crc)",
        "met AS (SELECT slim.*, coalesce(arcs.arc, 0) AS arc FROM slim ASOF LEFT JOIN arcs ON slim.place <= arcs.point)",
        "keys AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY place, doc_id, size, text_crc32) - 1 AS idx FROM met)",
        "left_0 AS (SELECT arc, count(*) AS rest, 0::BIGINT AS low FROM keys GROUP BY arc)",
        f"room_0 AS (SELECT s AS shard, (SELECT count(*) FROM keys) // {shards} + (CASE WHEN s < (SELECT count(*) FROM keys) % {shards} THEN 1 ELSE 0 END) AS room FROM range({shards}) a(s))",
    ]
    for k in range(shards):
        parts.append(
            f"ask_{k} AS MATERIALIZED (SELECT arc, rest, low, shard, least(rest, greatest(0, room - coalesce(sum(rest) OVER (PARTITION BY shard ORDER BY arc "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS take FROM left_{k} JOIN turns USING (arc) JOIN room_{k} USING (shard) WHERE turn = {k})"
        )
        parts.append(f"room_{k + 1} AS (SELECT shard, room - coalesce((SELECT sum(take) FROM ask_{k} a WHERE a.shard = r.shard), 0) AS room FROM room_{k} r)")
        parts.append(f"left_{k + 1} AS (SELECT arc, rest - take AS rest, low + take AS low FROM ask_{k} WHERE take < rest)")
    parts.append("cut AS (" + " UNION ALL ".join(f"SELECT arc, low, low + take AS high, shard FROM ask_{k} WHERE take > 0" for k in range(shards)) + ")")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, size, text_crc32, 'rows' AS law, c.shard::INTEGER AS shard, row_number() OVER (PARTITION BY c.shard ORDER BY k.arc, idx) - 1 AS slot,
  NULL::INTEGER AS grown_shard, a.shard::INTEGER AS home
FROM keys k JOIN cut c ON c.arc = k.arc AND idx >= low AND idx < high JOIN arcs a ON a.arc = k.arc
"""


@op(_ring_sql(16))
def op12_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of sixteen and its slot there; counts differ by one at most."""
    return hash_ring.described(_table(spark, sf_dir, "documents"))
