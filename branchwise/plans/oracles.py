"""The registered queries in SQL for a second engine, over the same tables."""

from __future__ import annotations

import inspect

from branchwise.operators.lexicon import LEXICON_FEATURES, POS_TAGS
from branchwise.plans import queries as q
from branchwise.plans.stance_features import TEXT_ORDER
from branchwise.functions import text as tx
from branchwise.sources.conversations import MSG_SQL

ORACLES: dict[str, str] = {}

WORD = tx.WORD.replace("'", "''")
SPACES = tx.SPACES
URL = tx.REDDIT_URL.replace("'", "''")

STANCE = "(CASE {0} WHEN 0 THEN 'Supporting' WHEN 1 THEN 'Denying' WHEN 2 THEN 'Querying' WHEN 3 THEN 'Commenting' END)"
TRUTH = "(CASE {0} WHEN 0 THEN 'False' WHEN 1 THEN 'True' WHEN 2 THEN 'Unverified' END)"


def bucket(n: str) -> str:
    return f"(CASE WHEN {n} <= 3 THEN {n} WHEN {n} <= 5 THEN 4 WHEN {n} <= 7 THEN 6 WHEN {n} <= 9 THEN 8 ELSE 10 END)"


CTES = {
    "msg": MSG_SQL,
    # Masked text, tokens and ids as the canonical message table has them.
    "m": rf"""
SELECT conv_id, turn, parent_turn, 'm' || conv_id || '_0' AS source_id, msg_id,
       CASE WHEN turn > 0 THEN 'm' || conv_id || '_' || parent_turn END AS parent_id,
       turn = 0 AS is_source, sdqc, parent_sdqc, truth, created_s,
       regexp_replace(regexp_replace(replace(text, chr(10), ''), '{tx.TWEET_URL}', 'urlurlurl ', 'g'), '{tx.TWEET_MENTION}', 'refrefref ', 'g') AS text
FROM msg""",
    "mt": f"SELECT *, regexp_extract_all(lower(text), '{WORD}') AS tokens, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> '') AS words FROM m",
    "dt": f"SELECT *, regexp_extract_all(lower(text), '{WORD}') AS tokens FROM documents",
    # Paths from a direct reply down to every message, then the leaves among them.
    "walk": """
SELECT conv_id, turn, [turn] AS path FROM msg WHERE turn > 0 AND parent_turn = 0
UNION ALL
SELECT c.conv_id, c.turn, list_append(w.path, c.turn) FROM walk w JOIN msg c ON c.conv_id = w.conv_id AND c.parent_turn = w.turn AND c.turn > 0""",
    "br": """
SELECT conv_id, 'm' || conv_id || '_0' AS source_id, 'm' || conv_id || '_' || turn AS leaf_id, path, CAST(len(path) AS BIGINT) AS branch_len,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS BIGINT) AS branch_idx
FROM walk w WHERE NOT EXISTS (SELECT 1 FROM msg c WHERE c.conv_id = w.conv_id AND c.parent_turn = w.turn AND c.turn > 0)""",
    "mem": """
SELECT conv_id, source_id, leaf_id, branch_idx, branch_len, unnest(path) AS turn, CAST(unnest(range(len(path))) AS BIGINT) AS pos FROM br""",
    "mf": "SELECT mem.*, 'm' || conv_id || '_' || turn AS msg_id, msg.sdqc, msg.truth, msg.created_s FROM mem JOIN msg USING (conv_id, turn)",
    # Seconds since the first message of the branch, and the observations with their time feature.
    "obs": """
SELECT *, min(created_s) OVER (PARTITION BY source_id, leaf_id) AS earliest, max(created_s) OVER (PARTITION BY source_id, leaf_id) AS latest,
       CASE WHEN branch_len = 1 THEN 0.0 ELSE log10((created_s - min(created_s) OVER (PARTITION BY source_id, leaf_id)) / 3600.0 + 1) END AS t
FROM mf""",
    "seq": """
SELECT conv_id, source_id, leaf_id, branch_idx, CAST(max(truth) AS BIGINT) AS veracity,
       string_agg(CAST(sdqc AS VARCHAR), ',' ORDER BY pos) AS stances, sum(t) AS t_sum FROM obs GROUP BY ALL""",
    "rank": "SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS vec_id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM dt) GROUP BY token)",
    "vec": "SELECT token, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM rank JOIN embeddings USING (vec_id)",
    # One row per component, so that sums of vectors are plain sums.
    "comp": "SELECT token, unnest(range(len(v))) AS i, unnest(v) AS x FROM vec",
    "mtok": "SELECT msg_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM mt",
    "msum": "SELECT msg_id, i, sum(x) AS x FROM mtok JOIN comp USING (token) GROUP BY ALL",
    "mnorm": "SELECT msg_id, sqrt(sum(x * x)) AS norm FROM msum GROUP BY msg_id",
    "ctx": """
SELECT m.msg_id, m.source_id, m.parent_id AS prev_id, f.leaf_id FROM m JOIN (
  SELECT msg_id, leaf_id FROM mf QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY source_id, branch_idx, pos) = 1) f USING (msg_id)""",
    "first": "SELECT msg_id, source_id, branch_idx, pos FROM mf QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY source_id, branch_idx, pos) = 1",
    "kept": "SELECT leaf_id FROM mf GROUP BY leaf_id HAVING count(*) FILTER (WHERE sdqc = 3) < count(*)",
    "ep": """
SELECT event_type AS params, CAST(day(ts) AS BIGINT) AS epoch, round(avg(value), 2) AS f1_macro FROM events GROUP BY ALL""",
    "jd": "SELECT doc_id, toxic AS actual, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS predicted FROM labels",
    "ann": "SELECT doc_id, u AS user_id, (doc_id * u) % 3 AS label FROM documents, (SELECT unnest([1, 2, 3]) AS u)",
}
NEEDS = {
    "m": ["msg"], "mt": ["m"], "walk": ["msg"], "br": ["walk"], "mem": ["br"], "mf": ["mem"], "obs": ["mf"], "seq": ["obs"],
    "rank": ["dt"], "vec": ["rank"], "comp": ["vec"], "mtok": ["mt"], "msum": ["mtok", "comp"], "mnorm": ["msum"],
    "ctx": ["m", "mf"], "first": ["mf"], "kept": ["mf"],
}


def with_ctes(*names: str, extra: str = "") -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)
    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + ([extra] if extra else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def oracle(name: str, ctes: list[str], sql: str, extra: str = "") -> None:
    ORACLES["q_" + name] = (with_ctes(*ctes, extra=extra) if ctes or extra else "") + inspect.cleandoc(sql)


# --- trees ------------------------------------------------------------------------------------

oracle("thread_summary", ["msg", "br"], f"""
    SELECT 'm' || conv_id || '_0' AS source_id, {TRUTH.format('max(truth)')} AS truth,
           coalesce(max(n_branches), 0) AS n_branches, coalesce(max(longest), 0) AS longest,
           CAST(count(*) FILTER (WHERE turn > 0 AND sdqc = 0) AS BIGINT) AS n_support, CAST(count(*) FILTER (WHERE turn > 0 AND sdqc = 1) AS BIGINT) AS n_deny,
           CAST(count(*) FILTER (WHERE turn > 0 AND sdqc = 2) AS BIGINT) AS n_query, CAST(count(*) FILTER (WHERE turn > 0 AND sdqc = 3) AS BIGINT) AS n_comment
    FROM msg LEFT JOIN (SELECT conv_id, count(*) AS n_branches, max(branch_len) AS longest FROM br GROUP BY conv_id) USING (conv_id)
    GROUP BY conv_id""")
oracle("branches", ["br"], "SELECT source_id, leaf_id, branch_idx, branch_len FROM br")
oracle("branch_members", ["mf"], "SELECT source_id, branch_idx, pos, branch_len, msg_id FROM mf")
oracle("roots", ["m", "walk"], """
    SELECT msg_id, msg_id AS root_id, CAST(0 AS BIGINT) AS depth, true AS complete FROM m WHERE turn = 0
    UNION ALL SELECT 'm' || conv_id || '_' || turn, 'm' || conv_id || '_0', CAST(len(path) AS BIGINT), true FROM walk""")
oracle("children", ["m"], """
    SELECT parent_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY created_s, msg_id) - 1 AS BIGINT) AS ord, msg_id AS child_id
    FROM m WHERE turn > 0""")
PRE = """pre AS (
    SELECT w.conv_id, w.turn, w.path, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.path) AS enter, s.sdqc FROM walk w JOIN msg s USING (conv_id, turn)
    UNION ALL SELECT conv_id, turn, list_slice([turn], 1, 0), 0, sdqc FROM msg WHERE turn = 0),
below AS (
    SELECT a.conv_id, a.turn AS top, b.turn, len(a.path) AS depth, len(b.path) - len(a.path) AS distance, a.enter, a.sdqc AS top_sdqc, b.sdqc
    FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND list_slice(b.path, 1, len(a.path)) = a.path)"""
oracle("subtree", ["msg", "walk"], """
    SELECT 'm' || conv_id || '_0' AS source_id, 'm' || conv_id || '_' || top AS msg_id, CAST(depth AS BIGINT) AS depth, CAST(enter AS BIGINT) AS enter,
           CAST(enter + count(*) AS BIGINT) AS leave, CAST(count(*) FILTER (WHERE sdqc = 1) AS BIGINT) AS n_denying
    FROM below GROUP BY conv_id, top, depth, enter""", extra=PRE)
oracle("subtree_members", ["msg", "walk"], """
    SELECT 'm' || conv_id || '_' || top AS top_id, 'm' || conv_id || '_0' AS source_id, 'm' || conv_id || '_' || turn AS msg_id, CAST(distance AS BIGINT) AS distance
    FROM below WHERE top_sdqc = 1""", extra=PRE)
oracle("thread_closure", ["m"], """
    SELECT source_id AS root_id, msg_id FROM m WHERE source_id IN (SELECT source_id FROM m WHERE sdqc = 1)""")
oracle("root_dedupe", ["m"], """
    SELECT DISTINCT source_id AS root_id FROM m WHERE msg_id IN (SELECT parent_id FROM m WHERE turn > 0 GROUP BY parent_id HAVING count(*) >= 2)""")
oracle("direct_replies", ["m"], "SELECT source_id, msg_id, is_source FROM m WHERE turn = 0 OR parent_turn = 0")
oracle("popular_threads", ["m"], """
    SELECT source_id, msg_id FROM m WHERE source_id IN (SELECT source_id FROM m GROUP BY source_id HAVING count(*) FILTER (WHERE turn > 0) >= 5)""")
oracle("reply_totals", ["m"], """
    SELECT source_id, replies, CAST(sum(replies) OVER (ORDER BY source_id) AS BIGINT) AS running
    FROM (SELECT source_id, count(*) FILTER (WHERE turn > 0) AS replies FROM m GROUP BY source_id)""")
oracle("previous_and_source", ["mf"], """
    SELECT source_id, leaf_id, pos, msg_id, coalesce(lag(msg_id) OVER (PARTITION BY source_id, leaf_id ORDER BY pos), source_id) AS prev_id FROM mf""")
oracle("first_occurrence", ["first"], "SELECT msg_id, source_id, branch_idx, pos FROM first")
oracle("unplaced", ["m"], """
    SELECT source_id, msg_id, 'orphan' AS reason FROM live WHERE NOT is_source AND msg_id NOT IN (SELECT msg_id FROM reach)""",
       extra="""live AS (SELECT * FROM m WHERE is_source OR sdqc <> 1),
reach AS (SELECT msg_id FROM live WHERE is_source UNION ALL SELECT l.msg_id FROM reach r JOIN live l ON l.parent_id = r.msg_id)""")
oracle("branch_tokens", ["mf", "mt"], """
    SELECT source_id, branch_idx, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens,
           string_agg(array_to_string(tokens, ' '), ' ' ORDER BY pos) FILTER (WHERE len(tokens) > 0) AS pool
    FROM (SELECT mf.source_id, branch_idx, pos, tokens FROM mf JOIN mt USING (msg_id)) GROUP BY source_id, branch_idx""")
oracle("drop_commenting_branches", ["mf"], """
    SELECT source_id, leaf_id, branch_len, CAST(count(*) FILTER (WHERE sdqc = 3) AS BIGINT) AS n_commenting FROM mf
    GROUP BY ALL HAVING count(*) FILTER (WHERE sdqc = 3) < count(*)""")
oracle("length_buckets", ["br"], f"SELECT CAST({bucket('branch_len')} AS BIGINT) AS bucket, count(*) AS n FROM br GROUP BY 1")
oracle("data_size", ["msg", "br"], """
    SELECT count(*) FILTER (WHERE turn = 0) AS threads, count(*) FILTER (WHERE turn > 0) AS replies,
           (SELECT count(*) FROM br) AS branches, (SELECT CAST(sum(branch_len) AS BIGINT) FROM br) AS members FROM msg""")
oracle("source_reply_pairs", ["m"], """
    SELECT r.source_id, r.msg_id, 'Source: ' || s.text || chr(10) || chr(10) || 'Reply: ' || r.text AS text
    FROM m r JOIN m s ON s.msg_id = r.source_id WHERE r.turn > 0""")
oracle("claims_to_label", ["m"], "SELECT source_id, text FROM m WHERE turn = 0")

# --- text -------------------------------------------------------------------------------------

oracle("mask_tweets", ["m"], "SELECT msg_id, text, left(text, 200) AS preview FROM m")
oracle("mask_reddit", [], rf"""
    SELECT doc_id, regexp_replace(replace(regexp_replace(text, '{tx.REDDIT_QUOTE}', 'refrefref', 'g'), chr(10), ''), '{URL}', 'urlurlurl', 'g') AS text FROM documents""")
oracle("tokens", ["dt"], "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM dt")
oracle("reddit_tokens", ["dt"], f"""
    SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, array_to_string(k, ' ') AS tokens
    FROM (SELECT doc_id, list_filter(tokens, lambda t: regexp_matches(t, '{tx.KEPT_TOKEN}')) AS k FROM dt)""")
oracle("tweet_tokens", ["m"], rf"""
    SELECT msg_id, CAST(len(k) AS BIGINT) AS n_tokens, array_to_string(k, ' ') AS tokens
    FROM (SELECT msg_id, regexp_extract_all(lower(text), '{tx.WORD_OR_MARK}') AS k FROM m)""")


def features(table: str, key: str) -> str:
    """Raw flags and counts of a table with text, tokens and words."""
    return rf"""
    SELECT {key}, CAST(contains(text, '.') AS BIGINT) AS period, CAST(contains(text, '!') AS BIGINT) AS e_mark,
           CAST(contains(text, '?') OR len(list_filter(words, lambda w: starts_with(w, 'hv'))) > 0 AS BIGINT) AS q_mark,
           CAST(contains(text, '...') AS BIGINT) AS has_trip_dot,
           CAST(len(list_filter(tokens, lambda t: t = 'urlurlurl')) AS BIGINT) AS url_count,
           CAST((length(text) - length(replace(text, '...', ''))) / 3 AS BIGINT) AS trip_dot_count,
           CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS q_mark_count,
           CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS e_mark_count,
           CAST(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS cap_count,
           CAST(length(text) AS BIGINT) AS txt_len,
           CASE WHEN len(tokens) > 0 THEN CAST(len(tokens) AS BIGINT) END AS tokens_len,
           CASE WHEN len(tokens) > 0 THEN list_sum(list_transform(tokens, lambda t: length(t))) / len(tokens) END AS avg_word_len,
           CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '{tx.CAPITAL_RUN}'), lambda r: length(r))), 0) AS BIGINT) AS cap_sequence_max_len,
           CAST(len(list_filter(tokens, lambda t: t = 'refrefref')) AS BIGINT) AS quote_count
    FROM {table}"""


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" if c == "avg_word_len" else c for c in q.FLAGS_AND_COUNTS)
oracle("text_features", ["mt"], f"SELECT msg_id, {ROUNDED} FROM ({features('mt', 'msg_id')})")
oracle("document_features", ["dt"], f"""
    SELECT doc_id, {ROUNDED} FROM ({features("(SELECT *, list_filter(regexp_split_to_array(text, '" + SPACES + "'), lambda w: w <> '') AS words FROM dt)", 'doc_id')})""")


def scaled(column: str, low: str, high: str) -> str:
    return (f"coalesce(CASE WHEN {column} = 0 THEN 0.0 WHEN {high} <> {low} THEN (CAST({column} AS DOUBLE) - {low}) / ({high} - {low}) "
            f"ELSE CAST({column} AS DOUBLE) END, 0.0)")


RAW_REPLIES = f"raw AS ({features('(SELECT * FROM mt WHERE turn > 0)', 'msg_id')})"


def ranges_of(columns, table: str = "raw") -> str:
    return "SELECT " + ", ".join(f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in columns) + f" FROM {table}"


def text_group(c: str) -> str:
    if c in tx.FLAG_FEATURES:
        return f"CAST({c} AS DOUBLE) AS {c}"
    if c == "cap_ratio":
        return f"round(CASE WHEN txt_len > 0 THEN {scaled('cap_count', 'lo_cap_count', 'hi_cap_count')} / txt_len ELSE 0.0 END, 6) AS cap_ratio"
    return f"round({scaled(c, 'lo_' + c, 'hi_' + c)}, 6) AS {c}"


oracle("normalised_features", ["mt"], f"""
    SELECT msg_id, {', '.join(text_group(c) for c in TEXT_ORDER)} FROM raw, ({ranges_of(tx.COUNT_FEATURES)})""", extra=RAW_REPLIES)
oracle("value_ranges_plain", ["mt"], " UNION ALL ".join(
    f"SELECT '{c}' AS property, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM raw"
    for c in tx.COUNT_FEATURES), extra=RAW_REPLIES)
# The running update itself, row by row in order of first occurrence, for every property.
oracle("value_ranges_ordered", ["mt", "first"], """
    SELECT property, round(lo, 6) AS min, round(hi, 6) AS max FROM run QUALIFY row_number() OVER (PARTITION BY property ORDER BY seq DESC) = 1""",
       extra=f"""raw AS ({features('(SELECT * FROM mt WHERE turn > 0)', 'msg_id')}),
prop AS ({' UNION ALL '.join(f"SELECT '{c}' AS property, msg_id, CAST({c} AS DOUBLE) AS x FROM raw WHERE {c} IS NOT NULL" for c in tx.COUNT_FEATURES)}),
line AS (SELECT property, x, row_number() OVER (PARTITION BY property ORDER BY source_id, branch_idx, pos) AS seq FROM prop JOIN first USING (msg_id)),
run AS (SELECT property, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS lo, CAST(0 AS DOUBLE) AS hi FROM (SELECT DISTINCT property FROM line)
  UNION ALL SELECT r.property, l.seq, CASE WHEN l.x < r.lo OR r.lo = 0 THEN l.x ELSE r.lo END, greatest(r.hi, l.x)
  FROM run r JOIN line l ON l.property = r.property AND l.seq = r.seq + 1)""")

LISTS = {name: [w for n, w in q.LEXICON if n == name] for name in LEXICON_FEATURES}


def lexicon_count(name: str) -> str:
    source = "tokens" if name in LEXICON_FEATURES[:2] else "words"
    inside = ", ".join(f"'{w}'" for w in LISTS[name])
    return f"CAST(len(list_filter({source}, lambda t: t IN ({inside}))) AS BIGINT) AS {name}"


SENTIMENT_SUM = "CAST(coalesce(list_sum(list_transform(tokens, lambda t: CASE t " + " ".join(
    f"WHEN '{t}' THEN {s}" for t, s in q.SENTIMENT) + " ELSE 0 END)), 0) AS BIGINT) AS sentiment"
oracle("lexicon_counts", ["mt"], f"SELECT msg_id, {', '.join(lexicon_count(n) for n in LEXICON_FEATURES)} FROM mt")
oracle("sentiment", ["mt"], f"SELECT msg_id, {SENTIMENT_SUM} FROM mt")
TAGS = "[" + ", ".join(f"'{t}'" for t in POS_TAGS) + "]"
TAGGED = f"list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN 'X' ELSE {TAGS}[length(t) % 17 + 1] END)"
oracle("pos_tag_lines", ["mt"], f"SELECT msg_id, array_to_string({TAGGED}, ' ') AS tags FROM mt WHERE len(tokens) > 0")
oracle("pos_vector", ["mt"], "SELECT msg_id, " + " || ".join(f"CASE WHEN list_contains(k, '{t}') THEN '1' ELSE '0' END" for t in POS_TAGS)
       + f" AS slots FROM (SELECT msg_id, {TAGGED} AS k FROM mt)")

# --- time, labels, sequences -------------------------------------------------------------------

oracle("log_time", ["obs"], "SELECT source_id, leaf_id, pos, msg_id, round(t, 6) AS t FROM obs")
oracle("scaled_time", ["obs"], """
    SELECT source_id, leaf_id, pos, msg_id, round(CASE WHEN branch_len = 1 OR latest = earliest THEN 0.0 ELSE (created_s - earliest) / CAST(latest - earliest AS DOUBLE) END, 6) AS t FROM obs""")
oracle("branch_span", ["obs"], "SELECT DISTINCT source_id, leaf_id, CAST(earliest AS BIGINT) AS earliest, CAST(latest AS BIGINT) AS latest FROM obs")
oracle("sequences", ["seq"], "SELECT source_id, branch_idx, veracity, stances, round(t_sum, 6) AS t_sum FROM seq")
oracle("sequences_skip_first", ["seq"], "SELECT source_id, branch_idx, veracity, stances FROM seq WHERE branch_idx > 0")
oracle("sequences_without_commenting", ["obs"], """
    SELECT source_id, leaf_id, CAST(max(truth) AS BIGINT) AS veracity, string_agg(CAST(sdqc AS VARCHAR), ',' ORDER BY pos) AS stances
    FROM obs WHERE sdqc <> 3 GROUP BY source_id, leaf_id""")
oracle("sequence_casts", ["seq"], """
    SELECT unverified_cast, veracity, count(*) AS n FROM (
      SELECT 'true' AS unverified_cast, CASE WHEN veracity = 2 THEN 1 ELSE veracity END AS veracity FROM seq
      UNION ALL SELECT 'false', CASE WHEN veracity = 2 THEN 0 ELSE veracity END FROM seq
      UNION ALL SELECT 'none', veracity FROM seq) GROUP BY ALL""")
oracle("attach_stances", ["m"], f"""
    SELECT msg_id, CASE WHEN sdqc = 3 THEN 'Underspecified' ELSE {STANCE.format('sdqc')} END AS sdqc,
           CAST(CASE WHEN sdqc <> 3 THEN sdqc END AS BIGINT) AS code, {STANCE.format('sdqc')} AS as_source FROM m""")
oracle("sequences_of_labelled", ["obs"], """
    SELECT source_id, leaf_id, CAST(max(truth) AS BIGINT) AS veracity, string_agg(CAST(sdqc AS VARCHAR), ',' ORDER BY pos) AS stances, round(sum(t), 6) AS t_sum
    FROM obs WHERE sdqc <> 3 GROUP BY source_id, leaf_id""")
oracle("attach_claims", ["m"], f"SELECT source_id, {TRUTH.format('truth')} AS truth FROM m WHERE turn = 0")

# --- word vectors -----------------------------------------------------------------------------

KNOWN = "known AS (SELECT msg_id, count(*) AS n_known FROM mtok WHERE token IN (SELECT token FROM vec) GROUP BY msg_id)"
oracle("average_vectors", ["mt", "msum"], """
    SELECT msg_id, CAST(len(tokens) AS BIGINT) AS n_tokens, coalesce(n_known, 0) AS n_known,
           round(coalesce(s, 0.0), 5) AS checksum, round(coalesce(q, 0.0), 6) AS square
    FROM mt LEFT JOIN known USING (msg_id)
    LEFT JOIN (SELECT msg_id, sum(x / len(tokens) * (i + 1)) AS s, sum(x / len(tokens) * (x / len(tokens))) AS q FROM msum JOIN mt USING (msg_id) GROUP BY msg_id) USING (msg_id)""",
       extra=KNOWN)
oracle("document_average_vectors", ["dt", "comp"], """
    SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, coalesce(n_known, 0) AS n_known, round(coalesce(s / len(tokens), 0.0), 5) AS checksum
    FROM dt LEFT JOIN (SELECT doc_id, count(*) AS n_known, sum(w) AS s FROM (SELECT doc_id, unnest(tokens) AS token FROM dt)
      JOIN (SELECT token, sum(x * (i + 1)) AS w FROM comp GROUP BY token) USING (token) GROUP BY doc_id) USING (doc_id)""")
oracle("token_matrices", ["mt", "mtok", "vec"], """
    SELECT msg_id, CASE WHEN len(tokens) > 0 THEN coalesce(n, 0) END AS n_rows, round(CASE WHEN len(tokens) > 0 THEN coalesce(c, 0.0) END, 3) AS checksum
    FROM mt LEFT JOIN (SELECT msg_id, count(*) AS n, sum(w * r) AS c FROM (
        SELECT msg_id, w, row_number() OVER (PARTITION BY msg_id ORDER BY pos) AS r FROM mtok
        JOIN (SELECT token, list_sum(list_transform(v, lambda x, i: x * i)) AS w FROM vec) USING (token)) GROUP BY msg_id) USING (msg_id)""")


def cosines(other: str, pair: str) -> str:
    """msg_id and cosine of its sum with the sum of message ``other`` in relation ``pair``."""
    return (f"SELECT p.msg_id, sum(a.x * b.x) / (max(na.norm) * max(nb.norm)) AS sim FROM {pair} p JOIN msum a ON a.msg_id = p.msg_id "
            f"JOIN msum b ON b.msg_id = p.{other} AND b.i = a.i JOIN mnorm na ON na.msg_id = p.msg_id JOIN mnorm nb ON nb.msg_id = p.{other} GROUP BY p.msg_id")


oracle("set_cosine", ["m", "msum", "mnorm"], f"""
    SELECT msg_id, round(coalesce(sim, 0.0), 6) AS similarity FROM m LEFT JOIN ({cosines('source_id', 'm')}) USING (msg_id) WHERE turn > 0""")
oracle("similarities", ["ctx", "msum", "mnorm"], f"""
    SELECT msg_id, round(coalesce(s.sim, 0.0), 6) AS sim_to_src, round(coalesce(p.sim, 0.0), 6) AS sim_to_prev, round(coalesce(b.sim, 0.0), 6) AS sim_to_branch
    FROM ctx LEFT JOIN ({cosines('source_id', 'ctx')}) s USING (msg_id) LEFT JOIN ({cosines('prev_id', 'ctx')}) p USING (msg_id)
    LEFT JOIN (SELECT c.msg_id, sum(a.x * b.x) / (max(na.norm) * max(nb.norm)) AS sim FROM ctx c JOIN msum a ON a.msg_id = c.msg_id
               JOIN bsum b ON b.leaf_id = c.leaf_id AND b.i = a.i JOIN mnorm na ON na.msg_id = c.msg_id JOIN bnorm nb ON nb.leaf_id = c.leaf_id GROUP BY c.msg_id) b USING (msg_id)""",
       extra="""bsum AS (SELECT leaf_id, i, sum(x) AS x FROM mf JOIN msum USING (msg_id) GROUP BY ALL),
bnorm AS (SELECT leaf_id, sqrt(sum(x * x)) AS norm FROM bsum GROUP BY leaf_id)""")
oracle("word_similarity", ["mtok", "vec"], """
    SELECT w1, w2, round(coalesce(list_cosine_similarity(a.v, b.v), 0.0), 6) AS similarity
    FROM (SELECT DISTINCT a.token AS w1, b.token AS w2 FROM mtok a JOIN mtok b ON b.msg_id = a.msg_id AND b.pos = a.pos + 1)
    LEFT JOIN vec a ON a.token = w1 LEFT JOIN vec b ON b.token = w2""")
oracle("nearest_words", ["vec"], """
    SELECT word, rank, neighbour, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, neighbour) AS rank FROM (
        SELECT a.token AS word, b.token AS neighbour, list_cosine_similarity(a.v, b.v) AS similarity
        FROM vec a JOIN vec b ON a.token <> b.token WHERE a.token IN ('the', 'la', 'und'))) WHERE rank <= 10
    UNION ALL SELECT w, 1, w, 1.0 FROM (SELECT unnest(['the', 'la', 'und', 'zzz-unknown']) AS w) WHERE w NOT IN (SELECT token FROM vec)""")
oracle("in_vocabulary", ["mtok", "vec"], "SELECT DISTINCT token, token IN (SELECT token FROM vec) AS known FROM mtok")

# --- features ---------------------------------------------------------------------------------

KEPT_RAW = f"""raw AS (SELECT r.*, {', '.join('l.' + n for n in LEXICON_FEATURES)}, l.sentiment FROM ({features('(SELECT * FROM mt WHERE turn > 0)', 'msg_id')}) r
  JOIN (SELECT msg_id, {', '.join(lexicon_count(n) for n in LEXICON_FEATURES)}, {SENTIMENT_SUM} FROM mt) l USING (msg_id)
  WHERE r.msg_id IN (SELECT msg_id FROM mf WHERE leaf_id IN (SELECT leaf_id FROM kept))),
feat AS (SELECT msg_id, {', '.join(text_group(c) for c in TEXT_ORDER)},
  {', '.join(f"round({scaled(c, 'lo_' + c, 'hi_' + c)}, 6) AS {c}" for c in [*LEXICON_FEATURES, 'sentiment'])}
  FROM raw, ({ranges_of([*tx.COUNT_FEATURES, *LEXICON_FEATURES, 'sentiment'])}))"""
oracle("stance_feature_table", ["mt", "kept"], f"""
    SELECT msg_id, CAST(sdqc AS BIGINT) AS stance, CAST(parent_sdqc AS BIGINT) AS sdqc_parent, {', '.join(q.FEATURE_COLUMNS)} FROM feat JOIN m USING (msg_id)""", extra=KEPT_RAW)
oracle("branch_features", ["mt", "kept"], f"""
    SELECT source_id, leaf_id, count(*) AS n, {', '.join(f'round(sum({c}), 4) AS {c}' for c in TEXT_ORDER)}
    FROM mf JOIN feat USING (msg_id) WHERE leaf_id IN (SELECT leaf_id FROM kept) GROUP BY ALL""",
       extra=KEPT_RAW.replace("round(", "(").replace(", 6) AS", ") AS"))
# Rows of a message's matrix and their position-weighted sum.
MATRICES = """counts AS (SELECT msg_id, count(*) AS n, sum(w * r) AS c FROM (
  SELECT msg_id, w, row_number() OVER (PARTITION BY msg_id ORDER BY pos) AS r FROM mtok
  JOIN (SELECT token, list_sum(list_transform(v, lambda x, i: x * i)) AS w FROM vec) USING (token)) GROUP BY msg_id)"""
oracle("vector_feature_table", ["mtok", "vec", "mt", "msum"], """
    SELECT msg_id, sim_to_src, sim_to_prev, sim_to_branch, a.n AS n_comment, b.n AS n_source, round(a.c, 3) AS comment_checksum, round(b.c, 3) AS source_checksum,
           round(coalesce(avg_sum, 0.0), 4) AS avg_checksum
    FROM sims JOIN m USING (msg_id) JOIN counts a USING (msg_id) JOIN counts b ON b.msg_id = m.source_id
    LEFT JOIN (SELECT msg_id, sum(x / len(tokens) * (i + 1)) AS avg_sum FROM msum JOIN mt USING (msg_id) GROUP BY msg_id) USING (msg_id)""",
       extra=MATRICES + ",\nsims AS ("
             + ORACLES["q_similarities"] + ")")

# --- statistics and metrics ---------------------------------------------------------------------

oracle("label_histogram", ["msg"], f"""
    SELECT {STANCE.format('sdqc')} AS sdqc, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM msg WHERE turn > 0 GROUP BY sdqc""")
oracle("label_histogram_by_truth", ["msg"], f"""
    SELECT {TRUTH.format('truth')} AS claim, {STANCE.format('sdqc')} AS sdqc, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share
    FROM msg WHERE turn > 0 GROUP BY truth, sdqc""")
oracle("majority_label", ["msg"], f"""
    SELECT {TRUTH.format('truth')} AS truth, CAST(sdqc AS BIGINT) AS stance, n FROM (SELECT truth, sdqc, count(*) AS n FROM msg GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY truth ORDER BY n DESC, sdqc) = 1""")


def score_sql(rows: str, columns: list[str], by: str = "") -> str:
    """All scores from rows with actual and predicted, per group ``by``."""
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    same = " AND ".join(f"r.{c.strip()} = l.{c.strip()}" for c in by.split(",")) + " AND " if by else ""
    return f"""
    SELECT {comma}{', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM (
      SELECT {comma}avg(f1) AS f1_macro, avg(p) AS precision_macro, avg(r) AS recall_macro,
             coalesce(max(p) FILTER (WHERE label = 1), 0.0) AS precision, coalesce(max(r) FILTER (WHERE label = 1), 0.0) AS recall FROM (
        SELECT {comma}label, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM (
          SELECT {', '.join('l.' + c.strip() for c in by.split(',')) + ', ' if by else ''}label, count(*) FILTER (WHERE actual = label AND predicted = label) AS tp,
                 count(*) FILTER (WHERE actual <> label AND predicted = label) AS fp, count(*) FILTER (WHERE actual = label AND predicted <> label) AS fn
          FROM (SELECT {comma}actual AS label FROM {rows} UNION SELECT {comma}predicted FROM {rows}) l JOIN {rows} r ON {same}true GROUP BY ALL)) {group}) s
    JOIN (SELECT {comma}avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS f1_micro FROM {rows} {group}) a {using}"""


METRICS = ["f1_macro", "f1_micro", "accuracy", "precision", "recall"]
oracle("majority_baseline", ["seq"], score_sql("judged", METRICS), extra="""
vs AS (SELECT CASE WHEN veracity = 2 THEN 1 ELSE veracity END AS actual FROM seq),
judged AS (SELECT actual, (SELECT actual FROM vs GROUP BY actual ORDER BY count(*) DESC, actual LIMIT 1) AS predicted FROM vs)""")
oracle("confusion", ["jd"], """
    SELECT CAST(a AS BIGINT) AS actual, CAST(p AS BIGINT) AS predicted, (SELECT count(*) FROM jd WHERE actual = a AND predicted = p) AS n
    FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS p)""")
oracle("class_accuracy", ["jd"], """
    SELECT CAST(a AS BIGINT) AS actual, (SELECT round(avg(CASE WHEN predicted = a THEN 1.0 ELSE 0.0 END), 6) FROM jd WHERE actual = a) AS accuracy
    FROM (SELECT unnest([0, 1, 2]) AS a)""")
oracle("scores", ["jd"], score_sql("jd", [*METRICS, "precision_macro", "recall_macro"]))
BUCKETED = f"""judged AS (SELECT CASE WHEN truth = 2 THEN 1 ELSE truth END AS actual, sdqc % 2 AS predicted, created_s % 5 AS fold, CAST({bucket('branch_len')} AS BIGINT) AS length
  FROM mf WHERE msg_id = leaf_id)"""
oracle("bucket_metrics", ["mf"], f"""
    SELECT length, {', '.join(f'round(sum({c}) / 5, 6) AS {c}' for c in METRICS)} FROM ({score_sql('judged', METRICS, 'length, fold').replace('round(', '(').replace(', 6) AS', ') AS')}) GROUP BY length""",
       extra=BUCKETED)
oracle("learning_curve", ["ep"], "SELECT params, epoch, f1_macro FROM ep")
oracle("best_epoch", ["ep"], "SELECT params, epoch, f1_macro FROM ep QUALIFY row_number() OVER (PARTITION BY params ORDER BY f1_macro DESC, epoch) = 1")

# --- splits -----------------------------------------------------------------------------------

oracle("kfold", [], """
    SELECT doc_id, CASE WHEN rn // size < 7 THEN rn // size END AS fold FROM (
      SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) - 1 AS rn, (SELECT count(*) // 7 FROM documents) AS size FROM documents)""")
oracle("holdout", [], """
    SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) <= (SELECT floor(count(*) * 0.2) FROM documents) AS is_test FROM documents""")
oracle("stratified_split", [], """
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 10007, doc_id) <= round(count(*) OVER (PARTITION BY lang) * 0.25) AS is_test FROM documents""")

# --- hidden Markov models -----------------------------------------------------------------------

A = q.TRANS
DISCRETE = "par AS (SELECT * FROM (VALUES " + ", ".join(
    f"({c}, {s}, " + ", ".join(str(x[s]) for x in q.EMISSION[c]) + ")" for c in range(3) for s in range(4)) + ") t(label, s, b0, b1))"
GAUSS = "par AS (SELECT * FROM (VALUES " + ", ".join(
    f"({c}, " + ", ".join(str(float(v)) for st in range(2) for v in (*q.MEANS[c][st], *q.VARIANCES[c][st])) + ")"
    for c in range(3)) + ") t(label, m0, n0, u0, w0, m1, n1, u1, w1))"


def density(state: int) -> str:
    m, n, u, w = (f"{x}{state}" for x in "mnuw")
    return f"exp(-(sdqc - {m}) * (sdqc - {m}) / (2 * {u}) - (t - {n}) * (t - {n}) / (2 * {w})) / sqrt(2 * pi() * {u}) / sqrt(2 * pi() * {w})"


FORWARD = f"""
f AS (SELECT source_id, leaf_id, label, pos, {q.START[0]} * b0 AS a0, {q.START[1]} * b1 AS a1 FROM e WHERE pos = 0
  UNION ALL SELECT e.source_id, e.leaf_id, e.label, e.pos, (f.a0 * {A[0][0]} + f.a1 * {A[1][0]}) * e.b0, (f.a0 * {A[0][1]} + f.a1 * {A[1][1]}) * e.b1
  FROM f JOIN e ON e.source_id = f.source_id AND e.leaf_id = f.leaf_id AND e.label = f.label AND e.pos = f.pos + 1),
ll AS (SELECT source_id, leaf_id, CAST(label AS BIGINT) AS label, ln(a0 + a1) AS ll FROM f QUALIFY row_number() OVER (PARTITION BY source_id, leaf_id, label ORDER BY pos DESC) = 1)"""
HMM_DISCRETE = DISCRETE + ", e AS (SELECT source_id, leaf_id, pos, label, CAST(b0 AS DOUBLE) AS b0, CAST(b1 AS DOUBLE) AS b1 FROM mf JOIN par ON s = sdqc)," + FORWARD
HMM_GAUSS = GAUSS + f", e AS (SELECT source_id, leaf_id, pos, label, {density(0)} AS b0, {density(1)} AS b1 FROM obs, par)," + FORWARD
BEST = "best AS (SELECT source_id, leaf_id, label AS predicted FROM ll QUALIFY row_number() OVER (PARTITION BY source_id, leaf_id ORDER BY ll DESC, label) = 1)"
oracle("hmm_score", ["mf"], "SELECT source_id, leaf_id, label, round(ll, 6) AS ll FROM ll", extra=HMM_DISCRETE)
oracle("hmm_score_gaussian", ["obs"], "SELECT source_id, leaf_id, label, round(ll, 6) AS ll FROM ll", extra=HMM_GAUSS)
oracle("hmm_predict", ["mf"], "SELECT source_id, leaf_id, predicted FROM best", extra=HMM_DISCRETE + "," + BEST)
oracle("hmm_test", ["seq"], score_sql("judged", [*METRICS, "precision_macro", "recall_macro"]),
       extra=HMM_DISCRETE + "," + BEST + ", judged AS (SELECT veracity AS actual, predicted FROM seq JOIN best USING (source_id, leaf_id))")

oracle("hmm_fit_one_state", ["obs"], """
    SELECT CAST(truth AS BIGINT) AS label, round(avg(sdqc), 6) AS stance_mean, round(avg(t), 6) AS time_mean,
           round(var_pop(sdqc), 6) AS stance_var, round(var_pop(t), 6) AS time_var FROM obs GROUP BY truth""")

# Siblings in the files from the latest to the first.
LATE = """
late AS (SELECT source_id, leaf_id, veracity, stances, t_sum, CAST(row_number() OVER (PARTITION BY br.conv_id ORDER BY list_transform(path, lambda x: -x)) - 1 AS BIGINT) AS branch_idx
         FROM br JOIN seq USING (source_id, leaf_id))"""
oracle("reddit_file", ["br", "seq"], "SELECT source_id, leaf_id, branch_idx, veracity, stances, round(t_sum, 6) AS t_sum FROM late WHERE branch_idx > 0", extra=LATE)
oracle("tweet_file", ["br", "seq"], "SELECT source_id, leaf_id, branch_idx, veracity, stances, round(t_sum, 6) AS t_sum FROM late", extra=LATE)
oracle("stance_annotation_file", ["m"], f"SELECT msg_id, {STANCE.format('sdqc')} AS sdqc FROM m WHERE NOT is_source")
oracle("label_round_trip", ["m"], f"""
    SELECT source_id, msg_id, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'Underspecified' ELSE {STANCE.format('sdqc')} END AS sdqc FROM m WHERE turn > 0""")
oracle("claim_overview_file", ["m"], f"SELECT source_id, {TRUTH.format('truth')} AS truth FROM m WHERE is_source")
oracle("thread_folder_file", ["br", "seq"], """
    SELECT edges, source_id, leaf_id, branch_idx, veracity, stances, round(t_sum, 6) AS t_sum FROM seq, (SELECT unnest(['structure', 'replies']) AS edges)""")
ORACLES["q_claim_marks_file"] = ORACLES["q_claim_overview_file"]
ORACLES["q_epoch_file"] = ORACLES["q_best_epoch"]
oracle("thread_selection", ["msg"], """
    SELECT test, 'm' || conv_id || '_0' AS source_id, n FROM t, (SELECT unnest(['lang', 'hashtag', 'near', 'own', 'all']) AS test)
    WHERE CASE test WHEN 'lang' THEN conv_id % 3 = 0 WHEN 'hashtag' THEN conv_id % 5 = 3 WHEN 'near' THEN km <= 250 WHEN 'own' THEN conv_id % 4 <> 0
               ELSE conv_id % 3 = 1 AND conv_id % 4 <> 0 AND n > 3 END""", extra="""
t AS (SELECT conv_id, count(*) AS n, 2 * 6371.0 * asin(sqrt(pow(sin(radians(54.0 - (50 + conv_id % 10)) / 2), 2)
             + cos(radians(50 + conv_id % 10)) * cos(radians(54.0)) * pow(sin(radians(8.0 - (5 + conv_id % 7)) / 2), 2))) AS km FROM msg GROUP BY conv_id)""")
oracle("flagged_claims", ["mf"], f"""
    SELECT source_id, leaf_id, 'False' AS veracity, string_agg({STANCE.format('sdqc')}, ',' ORDER BY pos) AS stances
    FROM mf JOIN best USING (source_id, leaf_id) WHERE predicted = 0 GROUP BY source_id, leaf_id""", extra=HMM_DISCRETE + "," + BEST)

# --- stores, corpora, labelling -------------------------------------------------------------------

oracle("merge_stores", ["m"], """
    SELECT source_id, msg_id, CASE WHEN truth = 2 THEN 'new' ELSE 'old' END AS origin FROM m""")
oracle("upsert_store", ["m"], """
    SELECT source_id, msg_id, CASE WHEN truth = 0 THEN 'old' ELSE 'new' END AS origin FROM m""")
ORACLES["q_upsert_store_files"] = ORACLES["q_upsert_store"]
oracle("upsert_store_buckets", ["m"], """
    SELECT source_id, msg_id, CASE truth WHEN 0 THEN 'old' WHEN 1 THEN 'new' ELSE 'newest' END AS origin FROM m WHERE truth < 2 OR turn = 0""")
oracle("upsert_store_keys", ["m"], """
    SELECT source_id, msg_id, CASE truth WHEN 0 THEN 'old' WHEN 1 THEN 'new' ELSE 'newest' END AS origin FROM m
    WHERE (truth < 2 OR turn = 0) AND source_id IN (SELECT source_id FROM m WHERE sdqc = 1)""")
oracle("corpus_union", ["m"], """
    SELECT 'threads' AS corpus, count(*) AS n, count(DISTINCT source_id) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM m
    UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id), CAST(sum(length(text)) AS BIGINT) FROM documents""")
AGREED = "agreed AS (SELECT doc_id, count(DISTINCT user_id) AS n_users, min(label) = max(label) AS agree, min(label) AS label FROM ann GROUP BY doc_id)"
oracle("agreement", ["ann"], "SELECT doc_id, n_users, agree, CASE WHEN agree THEN CAST(label AS VARCHAR) END AS labels FROM agreed", extra=AGREED)
oracle("agreement_split", ["ann"], """
    SELECT 'agreed' AS output, count(*) AS n, count(*) AS n_items FROM agreed WHERE agree
    UNION ALL SELECT 'disputed', count(*), count(DISTINCT doc_id) FROM ann JOIN agreed USING (doc_id) WHERE NOT agree""", extra=AGREED)
oracle("claim_decode", [], """
    SELECT doc_id, CASE WHEN c2 THEN false WHEN c1 THEN true END AS claim,
           CASE WHEN c1 AND NOT c2 AND c4 THEN 'Subjective' WHEN c1 AND NOT c2 AND c3 THEN 'Verifiable' END AS verifiability,
           CASE WHEN c1 AND NOT c2 AND c3 AND NOT c4 THEN CASE WHEN c7 THEN 'False' WHEN c6 THEN 'Unverified' WHEN c5 THEN 'True' END END AS truth,
           CASE WHEN NOT c1 AND NOT c2 THEN 'claim' WHEN c1 AND NOT c2 AND NOT c3 AND NOT c4 THEN 'verifiability'
                WHEN c1 AND NOT c2 AND c3 AND NOT c4 AND NOT c5 AND NOT c6 AND NOT c7 THEN 'truth' END AS label_error
    FROM (SELECT doc_id, """ + ", ".join(f"(doc_id // {1 << (c - 1)}) % 2 = 1 AS c{c}" for c in range(1, 8)) + " FROM documents)")
oracle("stance_decode", [], """
    SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN
             CASE doc_id % 4 WHEN 0 THEN 'Supporting' WHEN 1 THEN 'Denying' WHEN 2 THEN 'Querying' ELSE 'Commenting' END END AS sdqc,
           CASE WHEN doc_id % 7 = 0 THEN 'count' WHEN doc_id % 11 = 0 THEN 'code' END AS label_error FROM documents""")
oracle("integrate_labels", ["msg", "ann"], f"""
    SELECT msg_id, CASE WHEN agree THEN {STANCE.format('label')} ELSE 'Underspecified' END AS sdqc
    FROM msg LEFT JOIN agreed ON doc_id = conv_id""", extra=AGREED)
oracle("evaluation_grid", [], """
    SELECT lang, unverified_cast, remove_commenting, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS majority_share FROM (
      SELECT lang, unverified_cast, remove_commenting, CASE WHEN doc_id % 3 = 2 THEN CASE unverified_cast WHEN 'true' THEN 1 ELSE 0 END ELSE doc_id % 3 END AS label, count(*) AS n
      FROM documents, (SELECT unnest(['true', 'false']) AS unverified_cast), (SELECT unnest([true, false]) AS remove_commenting)
      WHERE NOT (remove_commenting AND n_chars % 4 = 3) GROUP BY ALL) GROUP BY ALL""")

oracle("evaluation_sweep_majority", ["obs"], """
    SELECT model || '_majority' AS model, unverified_cast, remove_commenting, testdata_type, model_type, timestamps,
           round(sum(f1_macro) / 5, 6) AS f1_macro, round(sum(accuracy) / 5, 6) AS f1_micro, round(sum(accuracy) / 5, 6) AS accuracy,
           round(sum(precision) / 5, 6) AS precision, round(sum(recall) / 5, 6) AS recall
    FROM metric, (VALUES ('gaussian', false), ('gaussian', true), ('discrete', false)) k(model_type, timestamps)
    GROUP BY ALL""", extra="""
branch AS (SELECT source_id, leaf_id, max(truth) AS truth, count(*) FILTER (WHERE sdqc <> 3) AS said FROM mf GROUP BY ALL),
corpus AS (SELECT 'm' || conv_id || '_0' AS source_id, CASE WHEN dayofweek(make_timestamp(CAST(created_s AS BIGINT) * 1000000)) < 3 THEN 'early' ELSE 'late' END AS corpus FROM msg WHERE turn = 0),
view AS (SELECT c.unverified_cast, r.remove_commenting, corpus, source_id, leaf_id,
                CASE WHEN truth = 2 THEN CASE c.unverified_cast WHEN 'true' THEN 1 ELSE 0 END ELSE truth END AS actual
         FROM branch JOIN corpus USING (source_id), (VALUES ('true'), ('false')) c(unverified_cast), (VALUES ('true'), ('false')) r(remove_commenting)
         WHERE r.remove_commenting = 'false' OR said > 0),
fold AS (SELECT *, CASE WHEN rn // size < 5 THEN rn // size END AS fold FROM (
           SELECT *, row_number() OVER (PARTITION BY unverified_cast, remove_commenting, corpus ORDER BY md5(source_id || '|' || leaf_id), source_id, leaf_id) - 1 AS rn,
                  count(*) OVER (PARTITION BY unverified_cast, remove_commenting, corpus) // 5 AS size FROM view)),
tests AS (SELECT * FROM (VALUES ('early', ['early']), ('late', ['late']), ('early+late', ['early', 'late'])) t(testdata_type, tested)),
models AS (SELECT * FROM (VALUES ('early', ['early']), ('late', ['late']), ('early+late', ['early', 'late'])) t(model, trained)),
asked AS (SELECT f.*, testdata_type, tested, model, trained FROM fold f, tests, models WHERE fold IS NOT NULL AND list_contains(tested, corpus)),
votes AS (SELECT unverified_cast, remove_commenting, testdata_type, model, k AS fold, actual, count(*) AS n
          FROM fold, tests, models, range(5) g(k) WHERE list_contains(trained, corpus) AND NOT (list_contains(tested, corpus) AND fold IS NOT DISTINCT FROM k) GROUP BY ALL),
winner AS (SELECT unverified_cast, remove_commenting, testdata_type, model, fold, actual AS predicted FROM votes
           QUALIFY row_number() OVER (PARTITION BY unverified_cast, remove_commenting, testdata_type, model, fold ORDER BY n DESC, actual) = 1),
judged AS (SELECT a.*, coalesce(predicted, -1) AS predicted FROM asked a LEFT JOIN winner w USING (unverified_cast, remove_commenting, testdata_type, model, fold)),
label AS (SELECT unverified_cast, remove_commenting, testdata_type, model, fold, label, count(*) FILTER (WHERE actual = label AND predicted = label) AS tp,
                 count(*) FILTER (WHERE actual = label) AS real, count(*) FILTER (WHERE predicted = label) AS said
          FROM judged, (SELECT unnest([-1, 0, 1]) AS label) WHERE actual = label OR predicted = label GROUP BY ALL),
metric AS (SELECT unverified_cast, remove_commenting, testdata_type, model, fold, avg(2.0 * tp / (real + said)) AS f1_macro, sum(tp) / sum(real) AS accuracy,
                  coalesce(max(CASE WHEN label = 1 AND said > 0 THEN tp / said END), 0) AS precision, coalesce(max(CASE WHEN label = 1 AND real > 0 THEN tp / real END), 0) AS recall
           FROM label GROUP BY ALL)""")

oracle("cooccurrences", ["dt"], """
    SELECT a, b, n, CASE WHEN n * total > na * nb THEN round(ln(n * total / (na * nb)), 6) END AS weight
    FROM pair JOIN (SELECT a, CAST(sum(n) AS DOUBLE) AS na FROM pair GROUP BY a) USING (a) JOIN (SELECT a AS b, CAST(sum(n) AS DOUBLE) AS nb FROM pair GROUP BY a) USING (b),
         (SELECT CAST(sum(n) AS DOUBLE) AS total FROM pair)""", extra="""
tok AS (SELECT doc_id, unnest(tokens) AS w, unnest(range(len(tokens))) AS p FROM dt),
often AS (SELECT w FROM tok GROUP BY w HAVING count(*) >= 50),
pair AS (SELECT x.w AS a, y.w AS b, count(*) AS n FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.p <> y.p AND y.p BETWEEN x.p - 5 AND x.p + 5
         WHERE x.w IN (SELECT w FROM often) AND y.w IN (SELECT w FROM often) GROUP BY ALL)""")

# --- written and read back -------------------------------------------------------------------------

oracle("sequence_file", ["seq"], "SELECT veracity, stances, count(*) AS n, round(sum(t_sum), 4) AS t_sum FROM seq GROUP BY ALL")
oracle("word_list_file", ["dt"], "SELECT DISTINCT unnest(tokens) AS word FROM dt")
oracle("sentence_file", [], f"""
    SELECT count(*) AS n_lines, CAST(sum(len(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda w: w <> ''))) AS BIGINT) AS n_words
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""")
oracle("vector_file", ["vec"], """
    SELECT token, CAST(len(v) AS BIGINT) AS dim, round(list_sum(list_transform(v, lambda x, i: x * i)), 4) AS checksum FROM vec""")
oracle("matrix_file", ["m", "mtok", "vec"], """
    SELECT m.msg_id, CAST(sdqc AS BIGINT) AS sdqc, a.n AS n_comment, b.n AS n_source, round(a.c, 3) AS comment_checksum, round(b.c, 3) AS source_checksum
    FROM m JOIN counts a USING (msg_id) JOIN counts b ON b.msg_id = m.source_id WHERE turn > 0""", extra=MATRICES)
oracle("annotation_task_files", ["msg"], """
    SELECT 'claims' AS task, msg_id AS id_str, text, CAST(0 AS BIGINT) AS n_labels FROM msg WHERE turn = 0
    UNION ALL SELECT 'stances', r.msg_id, 'Source: ' || s.text || chr(10) || chr(10) || 'Reply: ' || r.text, 0
    FROM msg r JOIN msg s ON s.conv_id = r.conv_id AND s.turn = 0 WHERE r.turn > 0""")
oracle("level_metrics", ["mf"], """
    SELECT length, fold, round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (real + said) ELSE 0 END), 6) AS f1_macro, round(sum(tp) / sum(real), 6) AS f1_micro, round(sum(tp) / sum(real), 6) AS accuracy,
           round(coalesce(max(CASE WHEN label = 1 AND said > 0 THEN tp / said END), 0), 6) AS precision, round(coalesce(max(CASE WHEN label = 1 AND real > 0 THEN tp / real END), 0), 6) AS recall
    FROM label GROUP BY length, fold, lg, fg""", extra=BUCKETED + """,
label AS (SELECT length, fold, grouping(length) AS lg, grouping(fold) AS fg, label, CAST(count(*) FILTER (WHERE actual = label AND predicted = label) AS DOUBLE) AS tp,
                 CAST(count(*) FILTER (WHERE actual = label) AS DOUBLE) AS real, CAST(count(*) FILTER (WHERE predicted = label) AS DOUBLE) AS said
          FROM judged, (SELECT unnest([0, 1]) AS label) WHERE actual = label OR predicted = label
          GROUP BY GROUPING SETS ((label), (label, length), (label, fold), (label, length, fold)))""")
oracle("metric_file", ["mf"], f"""
    SELECT 'leaf' AS model, length, round(sum(f1_macro) / 5, 3) AS f1_macro, round(sum(accuracy) / 5, 3) AS accuracy
    FROM ({score_sql('judged', METRICS, 'length, fold').replace('round(', '(').replace(', 6) AS', ') AS')}) GROUP BY length""", extra=BUCKETED)

# --- streams --------------------------------------------------------------------------------------

oracle("activity_tumbling", [], """
    SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL""")
ORACLES["q_activity_stream"] = ORACLES["q_activity_tumbling"]
oracle("activity_sliding", [], """
    SELECT start_s, event_type, count(*) AS n FROM (
      SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) - o AS start_s, event_type FROM events, (SELECT unnest([0, 21600]) AS o)) GROUP BY ALL""")
oracle("activity_sessions", [], """
    SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN us - prev < 7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
        SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
    GROUP BY user_id, s""")
oracle("repeats_stream", [], "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
oracle("thread_stream", ["br"], "SELECT source_id, leaf_id, branch_len FROM br")
ORACLES["q_quiet_thread_stream"] = ORACLES["q_thread_stream"]
