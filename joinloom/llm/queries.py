"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm import chat, decontaminate, knn, langid, mixing, secrets, simhash, tokens, urls, warc
from joinloom.llm.common import pick, table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_DEALT = f"('0x' || substr(md5('{mixing.SEED}/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 15))::BIGINT"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, {_SIZE} AS size, {_DEALT} AS dealt FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
-- the level is the greatest of those at which the sources that fill up first are full
l AS (SELECT max(level) AS level FROM (
  SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY source_size * (6 // weight), place))),
t AS (SELECT *, least(2.0::DOUBLE * source_size, weight * level) AS target FROM w, l),
b AS (SELECT CAST(3 * sum(source_size) AS BIGINT) // 2 AS budget FROM w),
p AS (SELECT r, size, source_size, weight, place, coalesce(sum(size) OVER (PARTITION BY place ORDER BY dealt, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, n % many * {mixing.PIECE} AS start, least({mixing.PIECE}, size - start) AS words, (before + n // many * source_size + start + words) * (6 // weight) AS finish
      FROM (SELECT *, unnest(range(2 * many)) AS n FROM (SELECT *, (size + {mixing.PIECE} - 1) // {mixing.PIECE} AS many FROM p WHERE size > 0))),
c AS (SELECT r, words, sum(words) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) - words AS position FROM q),
k AS (SELECT r, sum(least(words, budget - position)) AS taken FROM c, b WHERE position < budget GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k USING (r)
"""


@query("op10_mix_to_weights", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, least(10, len(w)) AS n, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
grams AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT r, n, k, item_id FROM grams JOIN wins USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, n, k FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, run: n + run["to"] - run["from"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(spark, docs, langid.learn(langid.learned_rows(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")).replace("|[Kk]", "_?[Kk]")
_KINDS = {0: rf"({_KEYWORD})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1: "AKIA[A-Z0-9]+", 2: "[0-9a-f]{16,}"}
_FOUND = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM d" for k, p in _KINDS.items())
_NAME = "['assign', 'access', 'hex', 'live'][kind + 1] || ':' || b || ':' || e"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, kind, found, gaps, unnest(range(1, len(found) + 1)) AS k FROM ({_FOUND})),
-- a match begins after all gaps up to its own and all matches before it
s AS (SELECT r, kind, found[k] AS whole, CASE kind WHEN 0 THEN regexp_extract(found[k], '{_KINDS[0]}', 2) ELSE found[k] END AS value,
             CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM m),
base AS (SELECT *, b + length(whole) AS e, b + length(whole) - length(value) AS vb FROM s WHERE length(value) >= [12, 18, 16][kind + 1]),
owned AS (SELECT value, count(*) AS owners, sum(n) AS repositories FROM (SELECT value, source, count(DISTINCT doc_id) AS n FROM base JOIN d USING (r) GROUP BY value, source) GROUP BY value),
told AS (SELECT DISTINCT r, vb, e, owners, repositories FROM base JOIN owned USING (value)
         WHERE list_aggregate(string_split(value, ''), 'entropy') >= {secrets.LEAST_BITS} AND NOT list_bool_or(list_transform({list(secrets.STAND_INS)}, lambda w: contains(lower(value), w)))),
live AS (SELECT DISTINCT r, 3 AS kind, vb AS b, e FROM told WHERE owners < {secrets.SHARED_OWNERS} AND repositories < {secrets.SHARED_REPOSITORIES}),
x AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({_NAME}, ',' ORDER BY b, kind) AS said FROM base GROUP BY r),
y AS (SELECT r, string_agg({_NAME}, ',' ORDER BY b, kind, e) AS spans, count(*) FILTER (kind = 3) AS n_live FROM (SELECT r, kind, b, e FROM base UNION ALL SELECT * FROM live) GROUP BY r),
z AS (SELECT r, string_agg(vb || ':' || e || ':' || owners || ':' || repositories, ',' ORDER BY vb, e, owners, repositories) AS ownership FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(ownership, '') AS ownership
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r) LEFT JOIN z USING (r)
"""


@query("op6_secret_scan", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark, table(spark, sf_dir, "documents"))
    live = F.transform("live", lambda s: F.struct(s["start"].alias("start"), F.lit(secrets.KINDS.index("live")).alias("kind"), s["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    names = F.array(*map(F.lit, secrets.KINDS))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    digest = F.sha2(told(base).cast("binary"), 256).alias("base_sha256")
    numbers = F.transform("judged", lambda s: F.concat_ws(":", *(s[n].cast("string") for n in ("start", "end", "owners", "repositories"))))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, told(F.concat(base, live)).alias("spans"), F.size("live").cast("long").alias("n_live"), F.array_join(numbers, ",").alias("ownership"))


OP5_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
             CASE WHEN strlen(h) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY h) THEN max(page_id) OVER (PARTITION BY h) END AS refers_to
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""


@query("op5_warc_normalise", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = warc.archive(spark, table(spark, sf_dir, "pages"))
    return warc.read_back(spark, folder, files)


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id))
WHERE rank <= 5
"""


@query("op2_top_products", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_products(spark, knn.quantised(table(spark, sf_dir, "embeddings")), lambda i: i % 50 == 0)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(spark, table(spark, sf_dir, "documents"), tokens.vocabulary())


#: How conversations are read as calls: a user's turn calls the tool, the turn after it is the result,
#: and a call waits for the call two turns before it. In one conversation of four, by number, it waits for
#: the call two turns later; in another, the calls of the first two turns do, which makes a circle. In one
#: of five, calls from turn 4 on have the identifier of the call four turns before.
REPLY = {"type": "object", "required": ["prompt", "turn"], "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0, "maximum": 5}}, "additionalProperties": False}

OP4_SQL = """
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS r, *, role = 'user' AS calls, role = 'assistant' AS answers,
         CASE role WHEN 'user' THEN conv_id || '/' || CASE WHEN conv_id % 5 = 0 AND turn >= 4 THEN turn - 4 ELSE turn END
                   WHEN 'assistant' THEN conv_id || '/' || (turn - 1) END AS id,
         CASE WHEN role = 'user' THEN
           CASE WHEN conv_id % 4 = 2 OR (conv_id % 4 = 3 AND turn < 2) THEN conv_id || '/' || (turn + 2) WHEN turn >= 2 THEN conv_id || '/' || (turn - 2) END END AS after
  FROM conversations),
heads AS (SELECT conv_id, id, arg_min(r, turn) AS head FROM m WHERE calls GROUP BY ALL),
-- a result waits for the first call of its identifier, that for all that is named by what it comes after
e AS (SELECT x.r AS x, head AS y FROM m x JOIN heads h USING (conv_id, id) WHERE x.answers
      UNION ALL SELECT x.r, y.r FROM heads h JOIN m x ON x.r = head JOIN m y ON y.conv_id = x.conv_id AND y.id = x.after AND (y.answers OR y.r IN (SELECT head FROM heads))),
reach AS (SELECT x, y FROM e UNION SELECT a.x, e.y FROM reach a JOIN e ON a.y = e.x),
moved AS (SELECT DISTINCT x FROM reach JOIN m a ON a.r = x JOIN m b ON b.r = y WHERE b.turn >= a.turn),
em AS (SELECT x, y FROM e WHERE x IN (SELECT x FROM moved) AND y IN (SELECT x FROM moved)),
round AS (SELECT x, y FROM em UNION SELECT a.x, em.y FROM round a JOIN em ON a.y = em.x),
stuck AS (SELECT DISTINCT x FROM round WHERE y IN (SELECT x FROM round WHERE x = y)),
paths AS (SELECT x, y, 1 AS k FROM e WHERE x NOT IN (SELECT x FROM stuck) AND y NOT IN (SELECT x FROM stuck)
          UNION SELECT p.x, e.y, p.k + 1 FROM paths p JOIN e ON p.y = e.x AND e.y NOT IN (SELECT x FROM stuck)),
far AS (SELECT x AS r, max([turn, k]) AS place FROM paths JOIN m ON m.r = y GROUP BY 1),
n AS (SELECT conv_id, id, count(*) AS results FROM m WHERE answers GROUP BY ALL)
SELECT conv_id, turn, role, CASE WHEN calls THEN 'call' WHEN answers THEN 'result' ELSE 'message' END AS kind,
       CASE WHEN r IN (SELECT x FROM stuck) THEN 'circular'
            WHEN calls THEN CASE WHEN head <> r THEN 'duplicate' WHEN results IS NULL THEN 'open' ELSE 'linked' END
            WHEN answers THEN CASE WHEN head IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'plain' END AS status,
       CASE WHEN calls THEN concat_ws('; ', CASE WHEN text IS NULL THEN '$.prompt: missing' WHEN text = '' THEN '$.prompt: minLength' WHEN length(text) > 400 THEN '$.prompt: maxLength' END,
                                      CASE WHEN turn > 5 THEN '$.turn: above maximum' END) ELSE '' END AS faults,
       greatest(place, [turn, 0])[1] AS ready, greatest(place, [turn, 0])[2] AS depth,
       CASE WHEN calls THEN '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' END
              || '"turn":' || turn || '},"id":"' || id || '","name":"reply","role":"user","type":"tool_call"}'
            WHEN answers THEN '{"call_id":"' || id || '","content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"assistant","type":"tool_result"}'
            ELSE '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"type":"message"}' END AS json
FROM m LEFT JOIN heads h USING (conv_id, id) LEFT JOIN n USING (conv_id, id) LEFT JOIN far USING (r)
"""


@query("op4_tool_links", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    def name(turn: Column) -> Column:
        return F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))

    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    user, assistant, turn, conv = F.col("role") == "user", F.col("role") == "assistant", F.col("turn"), F.col("conv_id")
    later = (conv % 4 == 2) | ((conv % 4 == 3) & (turn < 2))
    messages = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(user, name(F.when((conv % 5 == 0) & (turn >= 4), turn - 4).otherwise(turn))).alias("call_id"),
        F.when(user, F.lit("reply")).alias("tool"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).alias("arguments"),
        F.when(assistant, name(turn - 1)).alias("result_of"),
        F.when(user & later, F.array(name(turn + 2))).when(user & (turn >= 2), F.array(name(turn - 2))).alias("after"),
    )
    found = chat.linked(spark, messages, {"reply": REPLY})
    return found.select("conv_id", "turn", "role", "kind", "status", F.array_join("faults", "; ").alias("faults"), "ready", "depth", "json")
