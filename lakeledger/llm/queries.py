"""One query for each corpus operator over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm import contamination, licence_texts, licences, mixing, negatives, packing, sharding, simhash, toolcalls, topk, toxicity, trie, warc, wrapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tree's first level is not in the tables: sources by kind, the busiest one by itself.
DOMAINS = {"crawl": ["src0"], "forum": [f"src{i}" for i in range(1, 10)]}
WEIGHTS = {"domain": {"crawl": 30, "forum": 30, "reference": 40}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def domain():
    """Domain of a source; unlisted and null ones are ``reference``."""
    c = F.lit("reference")
    for name, sources in DOMAINS.items():
        c = F.when(F.col("source").isin(sources), name).otherwise(c)
    return c


def test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("question"), F.lit("").alias("answer"))


@query("op2_decontamination")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in training documents."""
    return contamination.matches(table(spark, sf_dir, "documents"), test_items(spark, sf_dir))


@query("op6_toxicity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=~toxicity.held_out("id"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "offending")


@query("op7_simhash_near_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3).select("doc_id", "fingerprint", "component_id")


@query("op8_sharding")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes, equal texts together."""
    out = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_WORDS = r"[^ \t\n\x0B\f\r]+"
_KIND = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in ss)}) THEN '{d}'" for d, ss in DOMAINS.items()) + " ELSE 'reference' END"


def _weight(name: str) -> str:
    cases = " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in WEIGHTS[name].items())
    return f"(CASE {cases} ELSE 1 END)" if cases else "1"


def _share(to: str, children: str, name: str, parent: list[str]) -> str:
    """One level of the tree: the closed form of sharing ``given`` by weight under capacities."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    also = f"PARTITION BY {', '.join([*parent, 'takes'])}"
    ahead = f"({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {name} NULLS FIRST ROWS BETWEEN"
    return f"""
{to}_a AS (SELECT *, least(given, sum(capacity) OVER ({by})) AS b, {_weight(name)} AS weight FROM ({children})),
{to}_b AS (SELECT *, b - coalesce(sum(capacity) OVER {ahead} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
           sum(weight) OVER {ahead} CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM {to}_a),
{to}_c AS (SELECT *, NOT (CAST(capacity AS HUGEINT) * w <= CAST(weight AS HUGEINT) * room) AS takes FROM {to}_b),
{to}_d AS (SELECT *, b - coalesce(sum(capacity) FILTER (NOT takes) OVER ({by}), 0) AS left_over,
           sum(weight) FILTER (takes) OVER ({by}) AS open FROM {to}_c),
{to}_e AS (SELECT *, CASE WHEN takes THEN weight * CAST(left_over AS HUGEINT) // open ELSE 0 END AS even FROM {to}_d),
{to}_f AS (SELECT *, left_over - sum(even) OVER ({by}) AS over_all, row_number() OVER ({also} ORDER BY {name} NULLS FIRST) AS nth FROM {to}_e),
{to} AS (SELECT * EXCLUDE (given), CAST(CASE WHEN takes THEN even + CASE WHEN nth <= over_all THEN 1 ELSE 0 END ELSE capacity END AS BIGINT) AS given FROM {to}_f)"""


MIX_SQL = f"""
WITH slim AS (
  SELECT doc_id, lang, source, {_KIND} AS domain, md5(coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS BIGINT) * 4 AS capacity FROM slim GROUP BY ALL),
langs AS (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY ALL),
domains AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY ALL),
{_share("top", "SELECT *, (SELECT sum(tokens) // 2 FROM leaves) AS given FROM domains", "domain", [])},
{_share("mid", "SELECT l.*, t.given FROM langs l JOIN top t ON l.domain IS NOT DISTINCT FROM t.domain", "lang", ["domain"])},
{_share("low", "SELECT l.*, t.given FROM leaves l JOIN mid t ON l.domain IS NOT DISTINCT FROM t.domain AND l.lang IS NOT DISTINCT FROM t.lang", "source", ["domain", "lang"])},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM low),
drawn AS (
  SELECT s.*, p.whole, p.rest, md5('42:' || p.whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest) AS key
  FROM slim s JOIN plan p ON s.domain IS NOT DISTINCT FROM p.domain AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM drawn),
counted AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, CAST(unnest(generate_series(0, CAST(times AS BIGINT) - 1)) AS INTEGER) AS epoch, domain, lang, source, CAST(tokens AS BIGINT) AS tokens
FROM counted WHERE times > 0
"""


@query("op5_mixing", MIX_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, mixed to the weights of domains, languages and sources."""
    out = mixing.mix(table(spark, sf_dir, "documents"), domain(), (1, 2), 4, WEIGHTS)
    return out.select("doc_id", F.col("mix_epoch").alias("epoch"), F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("tokens"))


TOP_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_top_k", TOP_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best other vectors for every fiftieth one."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5, 256)


@query("op11_best_fit_packing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 4,096 tokens as it can."""
    from public_tokenizers import path

    return packing.pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


NEGATIVE_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""


@query("op12_hard_negatives", NEGATIVE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels made wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label)


#: crc32 of a decimal text, eight polynomial steps a byte; DuckDB has no such function.
_CRC = "list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda a, b: list_reduce([xor(a, b)] || [CAST(i AS UBIGINT) FOR i IN range(8)], lambda v, w: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS UBIGINT)) ELSE v // 2 END))"
TRIE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS step,
         length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, CAST(xor({_CRC.format(x="CAST(c AS VARCHAR)")}, CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h FROM t),
r AS (SELECT i.c, t.k, t.step, t.size FROM ids i JOIN t ON t.c = i.c - i.c % 100 AND t.k <= i.h UNION ALL SELECT i.c, t.k + 1000000, t.step, t.size FROM ids i JOIN t ON t.c = i.c AND t.k > i.h),
s AS (SELECT c, list(md5(step) ORDER BY k) AS steps, list(size ORDER BY k) AS sizes FROM r GROUP BY c),
p AS (SELECT i.c, coalesce(s.steps, []) AS steps, coalesce(s.sizes, []) AS sizes FROM ids i LEFT JOIN s USING (c)),
m AS (SELECT c, d, list_aggregate(steps[1:d], 'string_agg', '') AS node, list_aggregate(steps[1:d - 1], 'string_agg', '') AS parent, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(steps) AS ends
      FROM (SELECT *, unnest(range(len(steps) + 1)) AS d FROM p)),
n AS (SELECT d, coalesce(node, '') AS node, CASE WHEN d > 0 THEN coalesce(any_value(parent), '') END AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, coalesce(node, '')),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.node) AS n_children FROM n),
up(node, above) AS (SELECT node, node FROM k UNION ALL SELECT up.node, k.parent FROM up JOIN k ON k.node = up.above WHERE k.parent IS NOT NULL),
tree AS (SELECT up.above AS node, CAST(count(*) FILTER (k.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(k.own) AS BIGINT) AS saved_tokens FROM up JOIN k ON k.node = up.node GROUP BY up.above)
SELECT k.conv_id, k.d AS depth, x.conv_id AS parent_conv_id, k.n_convs, k.n_children, tree.n_leaves, tree.saved_tokens, k.ends_sha256
FROM k JOIN tree USING (node) LEFT JOIN k x ON x.node = k.parent
"""


@query("op13_prefix_trie", TRIE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix that rebuilt conversations share, with its members, leaves and savings."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
"""


@query("op9_warc", WARC_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the capture index."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    found = warc.lookup(archive, pages, id_col="page_id", payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_html_extraction")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """The canonical form again, in DuckDB's terms."""
    c = f"regexp_replace(lower(coalesce({text}, '')), '\\r\\n?', chr(10), 'g')"
    for a, b in licences.EQUIVALENT:
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    c = f"regexp_replace({c}, {_quoted(licences.COPYRIGHT_LINE)}, '\\1', 'g')"
    c = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"trim(regexp_replace({c}, ' *\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


LICENCE_SQL = f"""
WITH known(licence, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licence_texts.KNOWN)}),
book AS (SELECT sha256(replace(lines, chr(10), ' ')) AS digest, min(licence) AS licence FROM (SELECT licence, {_canonical_sql("text")} AS lines FROM known) GROUP BY ALL),
docs AS (SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents),
digests AS (SELECT doc_id, lines, CASE WHEN lines <> '' THEN sha256(replace(lines, chr(10), ' ')) END AS digest FROM docs),
parts AS (SELECT doc_id, digest, unnest(string_split(lines, chr(10))) AS part FROM digests),
met AS (SELECT doc_id, digest, string_agg(DISTINCT licence, ' ' ORDER BY licence) AS notices
        FROM (SELECT p.doc_id, p.digest, b.licence FROM parts p JOIN book b ON part <> '' AND sha256(part) = b.digest) GROUP BY ALL)
SELECT d.doc_id, d.digest, b.licence, coalesce(m.notices, '') AS notices
FROM digests d LEFT JOIN book b ON d.digest = b.digest LEFT JOIN met m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND d.digest = m.digest
"""


@query("op1_license_scan", LICENCE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every whole document, and of its lines."""
    known = spark.createDataFrame(licence_texts.KNOWN, "licence_id string, text string")
    out = licences.scan(table(spark, sf_dir, "documents"), known)
    return out.select("doc_id", "digest", "licence", F.array_join("notices", " ").alias("notices"))


#: Tools that turns of the given chats are read as calls of: parameter, type, required.
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("search", "filters", "object", False),
    ("translate", "text", "string", True),
    ("translate", "to", "string", True),
    ("count", "text", "string", True),
    ("count", "unit", "string", False),
    ("weather", "place", "string", True),
    ("weather", "days", "number", False),
    ("weather", "metric", "boolean", False),
]


def chat_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results that every turn of ``conversations`` stands for.

    An assistant's turn is a call; it needs the call two turns before or, in every fifth chat, the one
    two turns later. A user's turn is the result of the call before it. Texts give tool and
    arguments; some arguments lack a parameter, have a wrong type or are cut off.
    """
    t = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    h = F.col("conv_id") * 7 + F.col("turn") * 3 + F.length(F.coalesce("text", F.lit("")))
    text, size = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x"))).substr(F.lit(6), F.lit(1 << 30)), F.length(F.coalesce("text", F.lit(""))).cast("string")  # "...text...}
    arguments = (
        F.when(h % 4 == 0, F.concat(F.lit('{"query": '), text.substr(F.lit(1), F.length(text) - 1), F.when(h % 12 == 0, F.concat(F.lit(', "limit": "'), size, F.lit('"'))).otherwise(F.concat(F.lit(', "limit": '), size)), F.lit(', "filters": {"z": 1, "a": [true, null]}}')))
        .when(h % 4 == 1, F.concat(F.lit('{"to": "en", "text": '), text))
        .when(h % 4 == 2, F.concat(F.lit('{"unit": "word", "words": '), size, F.lit(', "text": '), text))
        .when(h % 20 == 3, F.lit('{"place": "x", "days": '))
        .otherwise(F.concat(F.lit('{"metric": true, "days": 1.5, "place": '), text))
    )
    tool = F.element_at(F.array(*[F.lit(x) for x in ("search", "translate", "count", "weather")]), (h % 4 + 1).cast("int"))
    ahead = F.when(F.col("conv_id") % 5 == 0, F.col("turn") + 2).otherwise(F.col("turn") - 2)
    calls = t.filter("role = 'assistant'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", tool.alias("tool"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(ahead))).alias("depends_on"))
    results = t.filter("role = 'user' AND turn > 0").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


_CALL_ID = "'call_' || conv_id || '_' || "
_SIZE = "length(coalesce(text, ''))"
_TEXT = "to_json(coalesce(text, ''))"
CHAT_SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, {_CALL_ID}turn AS call_id, text, conv_id * 7 + turn * 3 + {_SIZE} AS h,
         CASE WHEN turn >= 2 THEN CASE WHEN conv_id % 5 = 0 THEN turn + 2 ELSE turn - 2 END END AS need
  FROM conversations WHERE role = 'assistant'),
ids AS (SELECT DISTINCT conv_id, turn, need FROM c),
chain(conv_id, turn, place, step) AS (
  SELECT conv_id, turn, turn, 0 FROM ids
  UNION ALL SELECT n.conv_id, n.turn, i.need, n.step + 1 FROM chain n JOIN ids i ON i.conv_id = n.conv_id AND i.turn = n.place
    JOIN ids j ON j.conv_id = i.conv_id AND j.turn = i.need WHERE i.need > i.turn),
placed AS (SELECT conv_id, turn, max(place) AS order_turn, CAST(max(step) AS BIGINT) AS order_step FROM chain GROUP BY ALL),
r AS (SELECT conv_id, {_CALL_ID}(turn - 1) AS call_id, min(turn) AS result_turn, min(text) AS content, count(*) AS results
      FROM conversations WHERE role = 'user' AND turn > 0 GROUP BY conv_id, turn),
made AS (
  SELECT c.*, p.order_turn, p.order_step,
         CASE h % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' WHEN 2 THEN 'count' ELSE 'weather' END AS tool,
         CASE WHEN h % 4 = 0 AND h % 12 = 0 THEN 'not integer: limit' WHEN h % 4 = 2 THEN 'unknown words' WHEN h % 20 = 3 THEN 'arguments are not JSON' ELSE '' END AS wrong,
         CASE WHEN need IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.conv_id = c.conv_id AND i.turn = c.need) THEN 'needs unknown ' || {_CALL_ID}need ELSE '' END AS lost,
         CASE WHEN h % 4 = 0 THEN '"arguments":{{"filters":{{"a":[true,null],"z":1}},"limit":' || CASE WHEN h % 12 = 0 THEN '"' || {_SIZE} || '"' ELSE CAST({_SIZE} AS VARCHAR) END || ',"query":' || {_TEXT} || '}}'
              WHEN h % 4 = 1 THEN '"arguments":{{"text":' || {_TEXT} || ',"to":"en"}}'
              WHEN h % 4 = 2 THEN '"arguments":{{"text":' || {_TEXT} || ',"unit":"word","words":' || {_SIZE} || '}}'
              WHEN h % 20 = 3 THEN '"arguments_text":"{{\\"place\\": \\"x\\", \\"days\\": "'
              ELSE '"arguments":{{"days":1.5,"metric":true,"place":' || {_TEXT} || '}}' END AS arguments
  FROM c JOIN placed p USING (conv_id, turn)),
exchanges AS (
  SELECT coalesce(m.conv_id, r.conv_id) AS conv_id, coalesce(m.call_id, r.call_id) AS call_id, m.tool, m.turn AS call_turn, r.result_turn, coalesce(r.results, 0) AS results,
         CASE WHEN m.call_id IS NULL THEN 'no call' WHEN r.call_id IS NULL THEN 'no result' ELSE 'linked' END AS status, m.order_turn, m.order_step,
         CASE WHEN m.call_id IS NULL THEN 'result without call' ELSE concat_ws('; ', nullif(m.wrong, ''), nullif(m.lost, '')) END AS errors,
         CASE WHEN m.call_id IS NOT NULL THEN '"call":{{' || m.arguments || ',"id":"' || m.call_id || '","tool":"' || m.tool || '","turn":' || m.turn || '}},' ELSE '' END AS call_part,
         CASE WHEN r.call_id IS NOT NULL THEN ',"result":{{' || CASE WHEN r.content IS NULL THEN '' ELSE '"content":' || to_json(r.content) || ',' END || '"id":"' || r.call_id || '","turn":' || r.result_turn || '}}' ELSE '' END AS result_part
  FROM made m FULL JOIN r ON m.conv_id = r.conv_id AND m.call_id = r.call_id)
SELECT conv_id, call_id, tool, call_turn, result_turn, results, status, order_turn, order_step, false AS in_cycle, errors = '' AS valid, errors,
       '{{' || call_part || '"conversation":' || conv_id || result_part || '}}' AS message
FROM exchanges
"""


@query("op3_tool_call_linking", CHAT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all chats with their results, places, errors and canonical form."""
    calls, results = chat_calls(spark, sf_dir)
    schemas = spark.createDataFrame(TOOLS, "tool string, parameter string, type string, required boolean")
    out = toolcalls.link(calls, results, schemas)
    return out.withColumn("errors", F.array_join("errors", "; "))
