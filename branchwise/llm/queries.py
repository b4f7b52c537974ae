"""The registered queries of the operators, one per operator, over whole tables, with SQL forms where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from branchwise.llm import alignment, mixing, pieces, pii, prefix_trie, quality, sharding, simhash, substring, templates, token_scan, topk, toxicity
from branchwise.llm.words import table
from branchwise.session import configure, durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20
SEPARATOR = 50256


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)
    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def public_file(name: str) -> bytes:
    """A vocabulary file, read once by the driver: executors get its bytes (a few MB at most)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_token_counts(spark, sf_dir):
    """Every document's token count, read back from flat token files by scanning for separators."""
    blocks = durable(token_scan.pack(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.tiktoken"), bpe_pattern(), SEPARATOR))
    return token_scan.scan(blocks, SEPARATOR)


@query
def op2_source_mixing(spark, sf_dir):
    """Words that the mix takes from every document, and its source's size and target."""
    return mixing.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_quality_rules(spark, sf_dir):
    """Counts and verdict of every document; cutoffs from all labelled documents."""
    measured = durable(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.judge(measured, quality.certify(measured.join(labels, "doc_id")))


@query
def op4_line_templates(spark, sf_dir):
    """Every document without its lines of recurring templates."""
    return templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_piece_encoding(spark, sf_dir):
    """Digests of every document's ids and decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_file("piece_bpe_32k.model"), digest=True)


@query
def op6_toxicity_scores(spark, sf_dir):
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op7_substring_dedup(spark, sf_dir):
    """Every document's words, removed words and digest of what is kept."""
    return substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


@query
def op8_exact_top_k(spark, sf_dir):
    """The five nearest other vectors, by inner product, of every vector whose id is divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op10_simhash_groups(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    marked = durable(simhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return simhash.groups(marked).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_extendible_sharding(spark, sf_dir):
    """The shard of every document, by doc_id and UTF-8 size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    placed, _ = sharding.assign(docs, "doc_id", F.col("size"), SHARD_BYTES)
    return placed.drop("size")


@query
def op11_token_alignment(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers in every document, and how common its links are."""
    return alignment.links(table(spark, sf_dir, "documents").select("doc_id", "text"), public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"))


@query
def op12_conversation_trie(spark, sf_dir):
    """The nodes of the prefix trie of all conversations, rebuilt with their shared beginnings."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_personal_data(spark, sf_dir):
    """Personal data of every document: plain forms counted and digested, all spans listed."""
    found = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


ORACLES["op9_extendible_sharding"] = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
     n AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS n_rows
           FROM d, (SELECT unnest(range(0, 60))::INTEGER AS depth) GROUP BY ALL),
     leaf AS (SELECT c.* FROM n c LEFT JOIN n p ON p.depth = c.depth - 1 AND p.prefix = c.prefix >> 1
              WHERE (c.shard_bytes <= {SHARD_BYTES} OR c.n_rows = 1)
                AND (c.depth = 0 OR (p.shard_bytes > {SHARD_BYTES} AND p.n_rows > 1)))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, n_bytes,
       CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM d JOIN leaf ON leaf.prefix = d.h >> (60 - leaf.depth)
"""

ORACLES["op8_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 5
"""

WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op7_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {WORD_SQL} AS ws FROM documents),
     win AS (SELECT doc_id, s, list_slice(ws, s, s + 12) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w)),
     low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
     hit AS (SELECT DISTINCT doc_id, s + o AS p FROM win JOIN low USING (k), (SELECT unnest(range(0, 13)) AS o) WHERE m < doc_id),
     each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_line_templates"] = rf"""
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
     l AS (SELECT doc_id, text, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS no FROM a),
     t AS (SELECT doc_id, text, no,
                  list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{templates.FIELD}' ELSE w END) AS ws FROM l),
     f AS (SELECT *, row(len(ws), ws[1:{templates.DEPTH}]) AS leaf FROM t WHERE len(ws) > 0),
     c AS (SELECT f.* FROM f JOIN (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT text) >= {templates.RECUR}) USING (leaf)),
     d AS (SELECT leaf, ws, count(*) AS n FROM c GROUP BY ALL),
     e AS (SELECT leaf, ws, n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
     o AS (SELECT leaf, p, word FROM e WHERE word <> '{templates.FIELD}' GROUP BY ALL HAVING sum(n) >= {templates.RECUR}),
     g AS (SELECT e.leaf, e.ws, string_agg(CASE WHEN o.word IS NULL THEN '{templates.FIELD}' ELSE e.word END, ' ' ORDER BY e.p) AS tpl
           FROM e LEFT JOIN o ON o.leaf = e.leaf AND o.p = e.p AND o.word = e.word GROUP BY ALL
           HAVING avg(CASE WHEN o.word IS NOT NULL OR e.word = '{templates.FIELD}' THEN 1.0 ELSE 0 END) >= {templates.CONSTANT}
              AND avg(CASE WHEN o.word IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.5),
     j AS (SELECT c.leaf, tpl, doc_id, text, no FROM c JOIN g ON g.leaf = c.leaf AND g.ws = c.ws),
     r AS (SELECT leaf, tpl, min(doc_id) AS first_id FROM j GROUP BY ALL
           HAVING count(DISTINCT text) >= {templates.RECUR}),
     x AS (SELECT DISTINCT doc_id, text, no FROM j JOIN r USING (leaf, tpl) WHERE doc_id IS DISTINCT FROM first_id),
     gone AS (SELECT doc_id, text, count(*) AS n FROM x GROUP BY ALL),
     kept AS (SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.no) AS new_text FROM (SELECT DISTINCT doc_id, text, line, no FROM l) l
              ANTI JOIN x ON x.doc_id = l.doc_id AND x.text = l.text AND x.no = l.no SEMI JOIN gone ON gone.doc_id = l.doc_id AND gone.text = l.text GROUP BY ALL)
SELECT a.doc_id, CASE WHEN gone.n IS NULL THEN a.text ELSE coalesce(kept.new_text, '') END AS text,
       CAST(coalesce(len(a.a), 0) AS BIGINT) AS n_lines, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_dropped
FROM a LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.text = a.text LEFT JOIN kept ON kept.doc_id = a.doc_id AND kept.text = a.text
"""


ORACLES["op12_conversation_trie"] = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
             FROM conversations WHERE conv_id IS NOT NULL),
     size AS (SELECT conv_id, count(*) AS len FROM own GROUP BY conv_id),
     ids AS (SELECT conv_id, conv_id - conv_id % {prefix_trie.SHARED} AS base,
                    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
             FROM size),
     r AS (SELECT ids.conv_id, pos, role, text FROM ids JOIN own ON own.conv_id = base AND pos <= h
           UNION ALL
           SELECT own.conv_id, pos - h + least(h, coalesce(b.len, 0)), role, text FROM own JOIN ids ON ids.conv_id = own.conv_id AND pos > h
           LEFT JOIN size b ON b.conv_id = base),
     c AS (SELECT ids.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ts
           FROM ids LEFT JOIN r ON r.conv_id = ids.conv_id GROUP BY ids.conv_id),
     p AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM c),
     n AS (SELECT d, ts[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = d), '') AS e
           FROM p GROUP BY ALL),
     kids AS (SELECT n.d, n.k, count(c.d) AS m FROM n LEFT JOIN n c ON c.d = n.d + 1 AND c.k[1:n.d] = n.k GROUP BY ALL),
     w AS (SELECT n.*, m, CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * length(n.k[n.d].text) END AS own FROM n JOIN kids ON kids.d = n.d AND kids.k = n.k)
SELECT a.conv_id, a.d AS depth, any_value(u.conv_id) AS parent_conv_id, any_value(a.n) AS n_convs, any_value(a.m) AS n_children,
       CAST(count(*) FILTER (s.m = 0) AS BIGINT) AS n_leaves, CAST(sum(s.own) AS BIGINT) AS saved_tokens, sha256(any_value(a.e)) AS ends_sha256
FROM w a JOIN w s ON s.d >= a.d AND s.k[1:a.d] = a.k LEFT JOIN n u ON u.d = a.d - 1 AND u.k = a.k[1:a.d - 1]
GROUP BY a.d, a.k, a.conv_id
"""


def _hash_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _mixing_sql(block: int = mixing.BLOCK, shard: int = mixing.SHARD, rounds: int = mixing.ROUNDS, repeats: int = mixing.REPEATS) -> str:
    key = _hash_sql(f"concat('mix|key|', s, '|', round * {rounds} + r)")
    partner = f"((({key} - a) % n_blocks + n_blocks) % n_blocks)"
    exchange = f"CASE WHEN substr(md5(concat('mix|swap|', s, '|', round, '|', r, '|', greatest(a, {partner}))), 1, 1) < '8' THEN {partner} ELSE a END"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({WORD_SQL}), 0) AS BIGINT) AS size FROM documents),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, [{', '.join(f'{v}.0::DOUBLE' for v in mixing.WEIGHTS)}][s % {len(mixing.WEIGHTS)} + 1] AS weight
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source)),
lv AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
tg AS (SELECT *, least(cap, coalesce(max(CASE WHEN lvl <= cap / weight THEN lvl END) OVER () * weight, cap)) AS target, CAST(ceil(source_size / {block}) AS BIGINT) AS n_blocks FROM lv),
qt AS (SELECT *, CAST(least({repeats} * n_blocks, floor(coalesce(target * n_blocks / nullif(source_size, 0), 0) + 0.5)) AS BIGINT) AS quota FROM tg),
src AS (SELECT *, CAST(sum(quota) OVER (ORDER BY s) AS BIGINT) AS hi FROM qt),
pk AS (SELECT d.*, src.s, src.source_size, src.target, CAST(coalesce(sum(size) OVER (PARTITION BY src.s
              ORDER BY {_hash_sql("coalesce(CAST(doc_id AS VARCHAR), '')")}, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
       FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
total AS (SELECT CAST(sum(quota) AS BIGINT) AS n FROM src),
pt AS (SELECT id // {shard} AS shard, CAST(floor(CAST({_hash_sql("concat('mix|draw|', id)")} AS DOUBLE) / 1152921504606846976.0::DOUBLE * n) AS BIGINT) AS place
       FROM (SELECT unnest(range(n)) AS id, n FROM total)),
ct AS (SELECT shard, s, count(*) AS c FROM pt JOIN src ON place >= hi - quota AND place < hi GROUP BY ALL),
kp AS (SELECT ct.*, least(greatest(quota - coalesce(sum(c) OVER (PARTITION BY ct.s ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), c)::BIGINT AS keep
       FROM ct JOIN src USING (s)),
sp AS (SELECT shard, unnest(range(upto - m, upto)) AS r FROM (SELECT *, CAST(sum(m) OVER (ORDER BY shard, s) AS BIGINT) AS upto FROM (SELECT *, c - keep AS m FROM kp) WHERE m > 0)),
ms AS (SELECT s, unnest(range(upto - m, upto)) AS r FROM (SELECT *, CAST(sum(m) OVER (ORDER BY s) AS BIGINT) AS upto FROM
         (SELECT src.s, CAST(quota - coalesce(got, 0) AS BIGINT) AS m FROM src LEFT JOIN (SELECT s, sum(keep) AS got FROM kp GROUP BY s) USING (s)) WHERE m > 0)),
fc AS (SELECT shard, s, CAST(sum(n) AS BIGINT) AS n FROM (SELECT shard, s, keep AS n FROM kp WHERE keep > 0 UNION ALL SELECT shard, s, 1 FROM sp JOIN ms USING (r)) GROUP BY ALL),
st AS (SELECT s, n, CAST(coalesce(sum(n) OVER (PARTITION BY s ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k FROM fc),
slot AS (SELECT s, n_blocks, i // n_blocks AS round, i % n_blocks AS x FROM (SELECT s, unnest(range(k, k + n)) AS i FROM st) JOIN src USING (s)),
us AS (SELECT s, list_reduce(list_prepend(x, range({rounds})), lambda a, r: {exchange}) AS j, count(*) AS times FROM slot GROUP BY ALL),
pc AS (SELECT s, off, size, unnest(range(off // {block}, (off + size - 1) // {block} + 1)) AS j FROM pk WHERE size > 0),
tk AS (SELECT s, off, CAST(sum((least((j + 1) * {block}, off + size) - greatest(j * {block}, off)) * times) AS BIGINT) AS taken FROM pc JOIN us USING (s, j) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM pk LEFT JOIN tk ON pk.size > 0 AND tk.s = pk.s AND tk.off = pk.off
"""


ORACLES["op2_source_mixing"] = _mixing_sql()
