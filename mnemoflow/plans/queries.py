"""Queries over the generated tables, one for each operator or family, and DuckDB SQL with the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, tools
from ..functions import text as X
from ..operators import budget, dedup, episodes, messages, metrics, prompts, propositions, retrieval, vectors
from ..operators import turns as T
from ..sources.tables import conversations
from ..streaming import state
from . import agents

KEYS = ["conv_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BUDGET = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cleaned(conversations(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumn("tok", X.quarter_tokens("text"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.paired(_turns(spark, sf_dir), KEYS)


TURNS = "t AS (SELECT conv_id, turn, role, replace(text, '<|endoftext|>', '') AS text FROM conversations WHERE role IN ('user', 'assistant'))"
SIZED = TURNS + ", z AS (SELECT *, coalesce(length(text) // 4, 0) AS tok FROM t)"
SUFFIX = SIZED + f", k AS (SELECT * FROM (SELECT *, CAST(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_from_here FROM z) WHERE tokens_from_here <= {BUDGET})"
PAIRS = TURNS + """, p AS (
    SELECT conv_id, turn, before_text AS user_text, text AS assistant_text FROM (
        SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ) WHERE role = 'assistant' AND before_role = 'user')"""
STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
LINES = r"regexp_split_to_array({}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
WORDS = r"regexp_extract_all(lower({}), '[\pL\pN_]+')"


@query(f"WITH {TURNS} SELECT conv_id, turn, role, text FROM t")
def turns_clean(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", "role", "text")


@query(f"WITH {PAIRS} SELECT conv_id, turn, user_text, assistant_text FROM p")
def turn_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"WITH {TURNS} SELECT conv_id, count(*) AS n_turns, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id")
def session_batch_text(spark, sf_dir):
    return T.batches(_turns(spark, sf_dir), KEYS)


@query(f"WITH {SUFFIX} SELECT conv_id, turn, tok, tokens_from_here FROM k")
def memory_budget_suffix(spark, sf_dir):
    return budget.recent(_sized(spark, sf_dir), KEYS, "turn", "tok", BUDGET).select("conv_id", "turn", "tok", "tokens_from_here")


MEMORY = f"WITH {SUFFIX} SELECT conv_id, coalesce(any_value(memory), '') AS memory FROM (SELECT DISTINCT conv_id FROM t) LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS memory FROM k GROUP BY conv_id) USING (conv_id) GROUP BY conv_id"


@query(MEMORY)
def memory_condensed_text(spark, sf_dir):
    return budget.condensed(_sized(spark, sf_dir), KEYS, "turn", "tok", "text", BUDGET).select("conv_id", "memory")


@query(f"WITH {SIZED} SELECT conv_id, turn, tok, CASE WHEN sum(tok) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 35 THEN 'short' ELSE 'long' END AS tier FROM z")
def short_long_split(spark, sf_dir):
    return budget.tiers(_sized(spark, sf_dir), KEYS, "turn", "tok").select("conv_id", "turn", "tok", "tier")


@query()
def flush_waves(spark, sf_dir):
    return budget.flushed(_sized(spark, sf_dir), KEYS, "turn", "tok").select("conv_id", "turn", F.col("wave").cast("long").alias("wave"))


@query(f"""WITH {SIZED}, b AS (SELECT conv_id, turn, tok, turn % 3 AS priority, sum(tok) OVER (PARTITION BY conv_id ORDER BY turn % 3, turn ROWS UNBOUNDED PRECEDING) AS s FROM z)
SELECT conv_id, turn, tok, priority FROM b WHERE priority = 0 OR s <= {BUDGET}""")
def priority_blocks(spark, sf_dir):
    rows = _sized(spark, sf_dir).withColumn("priority", F.col("turn") % 3)
    return budget.by_priority(rows, KEYS, "priority", "tok", BUDGET, "turn").select("conv_id", "turn", "tok", "priority")


STATEMENTS = TURNS + f""", l AS (SELECT conv_id, turn, unnest({LINES.format('text')}) AS x, generate_subscripts({LINES.format('text')}, 1) AS line FROM t),
s AS (SELECT conv_id, turn, line, {STRIP.format('x')} AS proposition FROM l WHERE {STRIP.format('x')} <> ''),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, proposition ORDER BY turn, line) AS nth FROM s) WHERE nth = 1)"""


def _statements(spark, sf_dir):
    """Every turn's lines as statements, each first one of a conversation."""
    # lines keep the numbers that they have before empty ones go
    each = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.transform(X.lines("text"), X.strip)).alias("line", "proposition")).where("proposition <> ''")
    each = each.withColumn("line", (F.col("line") + 1).cast("long"))
    return dedup.first_of_each(each, KEYS, "proposition", ["turn", "line"])


@query(f"WITH {STATEMENTS} SELECT conv_id, turn, CAST(line AS BIGINT) AS line, proposition FROM u")
def props_first_distinct(spark, sf_dir):
    return _statements(spark, sf_dir).select("conv_id", "turn", "line", "proposition")


@query(f"WITH {STATEMENTS} SELECT conv_id, count(*) AS n FROM u GROUP BY conv_id HAVING count(*) >= 20")
def props_cap_trigger(spark, sf_dir):
    return dedup.over_cap(_statements(spark, sf_dir), KEYS, 20)


@query()
def proposition_fold_offline(spark, sf_dir):
    return propositions.learnt(T.batches(_turns(spark, sf_dir), KEYS, roles=False).withColumn("session", F.lit(0)), KEYS, "session", "text", most=50)


EPISODES = PAIRS + f""", e0 AS (SELECT conv_id, turn, {STRIP.format('user_text')} AS u, {STRIP.format('assistant_text')} AS a FROM p),
e1 AS (SELECT *, {STRIP.format('lower(left(u, 300))')} AS k FROM e0 WHERE u <> '' AND a <> ''),
e AS (SELECT conv_id, turn, left(u, 300) AS user_input, left(a, 300) AS agent_output,
    '[USER INPUT]: ' || u || chr(10) || '[AGENT OUTPUT]: ' || a || chr(10) || '[OUTCOME]: None' || chr(10) || '[LOCATION]: None' || chr(10) || '[REFLECTION]: None' AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS nth FROM e1) WHERE length(u) > 300 OR k = '' OR nth = 1)"""


def _episodes(spark, sf_dir):
    none = [F.lit(None).cast("string").alias(c) for c in ("outcome", "location", "reflection")]
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", X.strip("user_text").alias("user_input"), X.strip("assistant_text").alias("agent_output"), *none, F.array().cast("array<string>").alias("categorical_tags"))
    return episodes.stored(rows.where("user_input <> '' and agent_output <> ''"), KEYS, ["turn"], F.lpad(F.col("turn").cast("string"), 10, "0"))


@query(f"WITH {EPISODES} SELECT conv_id, turn, user_input, agent_output, text FROM e")
def episodes_from_pairs(spark, sf_dir):
    return _episodes(spark, sf_dir).select("conv_id", "turn", "user_input", "agent_output", "text")


@query("WITH " + PAIRS + f""", x AS (SELECT conv_id, turn, '<results><result> ' || user_text || '</result><result></result><result>' || assistant_text || ' </result><result>a</result><result>b</result><result>c</result><result>tag</result></results>' AS xml FROM p),
f AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(xml, '(?s)<result>(.*?)</result>', 1), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS r FROM x)
SELECT conv_id, turn, r[1] AS user_summary, r[2] AS agent_summary, r[3] AS outcome, r[4] AS location, r[5] AS reflection, array_to_string(r[6:], '|') AS tags FROM f""")
def episode_xml_parse(spark, sf_dir):
    tag = lambda c: F.concat(F.lit("<result>"), c, F.lit("</result>"))
    xml = F.concat(F.lit("<results>"), tag(F.concat(F.lit(" "), F.col("user_text"))), tag(F.lit("")), tag(F.concat(F.col("assistant_text"), F.lit(" "))), *[tag(F.lit(x)) for x in ("a", "b", "c", "tag")], F.lit("</results>"))
    got = _pairs(spark, sf_dir).select("conv_id", "turn", episodes.parsed(xml).alias("e")).select("conv_id", "turn", "e.*")
    return got.withColumn("tags", F.array_join("categorical_tags", "|")).drop("categorical_tags")


READ = EPISODES + f""", m AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS memory FROM e GROUP BY conv_id),
n AS (SELECT conv_id, unnest({LINES.format('memory')}) AS x, generate_subscripts({LINES.format('memory')}, 1) AS i FROM m),
o AS (SELECT conv_id, i, {STRIP.format('x')} AS line FROM n),
g AS (SELECT *, sum(CASE WHEN starts_with(line, '[USER INPUT]') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS mem FROM o WHERE line <> ''),
kv AS (SELECT conv_id, mem, i, {STRIP.format("left(line, instr(line, ': ') - 1)")} AS k, {STRIP.format("substr(line, instr(line, ': ') + 2)")} AS v FROM g WHERE instr(line, ': ') > 0),
d AS (SELECT conv_id, mem, k, arg_max(v, i) AS v FROM kv GROUP BY ALL),
c AS (SELECT conv_id, i, mem FROM g WHERE starts_with(line, '[REFLECTION]') AND i >= (SELECT min(i) FROM kv WHERE kv.conv_id = g.conv_id AND kv.mem = g.mem)),
r AS (SELECT conv_id, mem, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS nth FROM c)
"""


def _memories(spark, sf_dir):
    return episodes.read_back(budget.joined(_episodes(spark, sf_dir), KEYS, "turn", "text"), KEYS, "memory")


@query("WITH " + READ + "SELECT r.conv_id, r.nth, d.k AS key, d.v AS value FROM r JOIN d USING (conv_id, mem)")
def memory_text_parse(spark, sf_dir):
    return _memories(spark, sf_dir).select("conv_id", "nth", F.explode("fields").alias("key", "value"))


HISTORY = READ + """, f AS (SELECT r.conv_id, r.nth, map_from_entries(list((d.k, d.v))) AS f FROM r JOIN d USING (conv_id, mem) GROUP BY r.conv_id, r.nth),
h AS (SELECT conv_id, nth, 'User: ' || f['[USER INPUT]'] || chr(10) || 'Assistant: ' || f['[AGENT OUTPUT]']
    || coalesce(chr(10) || 'Outcome: ' || nullif(f['[OUTCOME]'], ''), '') || coalesce(chr(10) || 'Location: ' || nullif(f['[LOCATION]'], ''), '') || coalesce(chr(10) || 'Reflection: ' || nullif(f['[REFLECTION]'], ''), '') AS x FROM f)
"""


@query("WITH " + HISTORY + """SELECT conv_id, 'User: What did I ask?' || chr(10) || 'Known context (may be empty):' || chr(10) || string_agg(x, chr(10) ORDER BY nth) || chr(10) || chr(10) || 'Assistant:' AS prompt FROM h GROUP BY conv_id""")
def prompt_assembly(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("nth", episodes.history(F.col("fields")).alias("x"))))
    context = _memories(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("context"))
    return context.select("conv_id", prompts.answer(F.lit("What did I ask?"), F.col("context")).alias("prompt"))


OVERLAP = f""", q AS (SELECT item_id, list_distinct({WORDS.format('text')}) AS qw FROM benchmark),
w AS (SELECT conv_id * 1000 + turn AS seq, list_distinct({WORDS.format("user_input || ' ' || agent_output")}) AS ew FROM e),
s AS (SELECT item_id, seq, CAST(len(list_intersect(qw, ew)) AS BIGINT) AS score FROM q, w)
"""


@query("WITH " + EPISODES + OVERLAP + "SELECT item_id AS query_id, seq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seq) AS rank FROM s WHERE score > 0) WHERE rank <= 5")
def episodic_overlap_topk(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), retrieval.query_words("text").alias("words"))
    e = _episodes(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), retrieval.episode_words("user_input", "agent_output").alias("words"), F.array().cast("array<string>").alias("tags"))
    return retrieval.best(retrieval.indexed(q, e, [])).select("query_id", "seq", "score", "rank")


@query(f"""WITH q AS (SELECT item_id, list_distinct({WORDS.format(STRIP.format('text'))}) AS qw FROM benchmark),
e AS (SELECT doc_id, list_distinct(list_concat({WORDS.format('text')}, regexp_extract_all(lang || ' ' || source, '[\\pL\\pN_]+'))) AS ew, [lang, source] AS tags FROM documents),
i AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(qw) AS w FROM q) JOIN (SELECT doc_id, unnest(ew) AS w FROM e) USING (w) GROUP BY ALL),
b AS (SELECT item_id, doc_id, len(list_filter(tags, lambda g: len(list_filter(qw, lambda x: contains(lower(g), x))) > 0)) AS n FROM q, e),
s AS (SELECT b.item_id, b.doc_id, CAST(coalesce(i.n, 0) + b.n AS BIGINT) AS score FROM b LEFT JOIN i USING (item_id, doc_id))
SELECT item_id AS query_id, doc_id AS seq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def episodic_tag_bonus_topk(spark, sf_dir):
    # documents never pass the store, so all words of their texts count
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), retrieval.query_words("text").alias("words"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq"), "text", F.array("lang", "source").alias("tags"))
    e = d.select("seq", retrieval.episode_words("text", F.lit(""), "tags").alias("words"), "tags")
    return retrieval.best(retrieval.indexed(q, e, [])).select("query_id", "seq", "score", "rank")


@query(f"WITH {TURNS} SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t) WHERE r <= 5")
def episodic_fallback_last5(spark, sf_dir):
    return retrieval.newest(_turns(spark, sf_dir).withColumn("seq", F.col("turn")), KEYS).select("conv_id", "turn", "text")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, rank, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def vector_topk_cosine(spark, sf_dir):
    # every twentieth vector against all, as many as the table has
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return vectors.nearest(q, v).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


#: The SQL writes out so many levels of a tree: 3 ** 12 leaves an owner.
DEEPEST = 12


def _levels_sql() -> str:
    """l0 to l12 and n, the nodes of all levels up to the depth of the largest owner, as the DataFrame has them."""
    kid = lambda k: f"any_value(e) FILTER (node % 3 = {k})"
    part = lambda k: f"any_value(left(text, 80)) FILTER (node % 3 = {k})"
    mean = "list_transform(k0, lambda x, i: (x + coalesce(k1[i], 0) + coalesce(k2[i], 0)) / n)"
    out = ["""l0 AS (SELECT CAST(label AS BIGINT) AS owner, CAST(0 AS BIGINT) AS level, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS node,
    CAST(vec_id AS VARCHAR) AS text, embedding::DOUBLE[] AS e FROM embeddings)""", "d AS (SELECT min(k) AS top FROM range(0, 13) r(k) WHERE pow(3, k) >= (SELECT max(node) + 1 FROM l0))"]
    for k in range(1, DEEPEST + 1):
        out.append(
            f"l{k} AS (SELECT owner, CAST({k} AS BIGINT) AS level, up AS node, concat_ws(' | ', t0, t1, t2) AS text, {mean} AS e FROM (SELECT owner, node // 3 AS up, count(*) AS n, "
            f"{kid(0)} AS k0, {kid(1)} AS k1, {kid(2)} AS k2, {part(0)} AS t0, {part(1)} AS t1, {part(2)} AS t2 FROM l{k - 1}, d WHERE top >= {k} GROUP BY owner, node // 3))"
        )
    return ",\n".join([*out, "n AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(DEEPEST + 1)) + ")"])


TREE = _levels_sql()
ASKED = """q AS (SELECT CAST(label AS BIGINT) AS owner, vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, level, node, list_cosine_similarity(q, e) AS c FROM q JOIN n USING (owner))"""


def _path_sql() -> str:
    """p12 to p0: what each query finds at a level below what it found above."""
    out = []
    for k in range(DEEPEST, -1, -1):
        above = f"LEFT JOIN p{k + 1} a USING (query_id)" if k < DEEPEST else ""
        below = f"top = {k} OR s.node // 3 = a.node" if k < DEEPEST else f"top = {k}"
        out.append(f"p{k} AS (SELECT query_id, level, node, c FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.c DESC NULLS LAST, s.node) AS r FROM s {above} CROSS JOIN d WHERE s.level = {k} AND ({below})) WHERE r = 1)")
    return ",\n".join(out)


def _tree(spark, sf_dir):
    leaves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("owner"), "vec_id", F.col("vec_id").cast("string").alias("text"), "embedding")
    return vectors.tree(leaves, ["owner"], "vec_id")


@query("""WITH RECURSIVE c AS (SELECT label AS owner, count(*) AS n FROM embeddings GROUP BY label),
l AS (SELECT CAST(owner AS BIGINT) AS owner, CAST(0 AS BIGINT) AS level, n FROM c UNION ALL SELECT owner, level + 1, (n + 2) // 3 FROM l WHERE level < (SELECT max(d) FROM (SELECT CAST(ceil(log(n) / log(3) - 1e-9) AS BIGINT) AS d FROM c)))
SELECT owner, level, CAST(n AS BIGINT) AS nodes FROM l""")
def tree_levels(spark, sf_dir):
    return _tree(spark, sf_dir).groupBy("owner", "level").agg(F.count("*").alias("nodes"))


@query(f"WITH {TREE}, {ASKED} SELECT query_id, level, node, rank, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, level, node) AS rank FROM s WHERE c IS NOT NULL) WHERE rank <= 3")
def tree_collapsed_topk(spark, sf_dir):
    return vectors.collapsed(_tree_questions(spark, sf_dir), _tree(spark, sf_dir), ["owner"]).select("query_id", "level", "node", "rank", F.round("similarity", 6).alias("similarity"))


def _tree_questions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.where("vec_id % 20 = 0").select(F.col("label").cast("long").alias("owner"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"WITH {TREE}, {ASKED}, {_path_sql()} " + " UNION ALL ".join(f"SELECT query_id, level, node, round(c, 6) AS similarity FROM p{k}" for k in range(DEEPEST + 1)))
def tree_traverse(spark, sf_dir):
    return vectors.traversed(_tree_questions(spark, sf_dir), _tree(spark, sf_dir), ["owner"]).select("query_id", "level", "node", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {TREE} SELECT owner, concat_ws('/', " + ", ".join(f"CASE WHEN level <= {j} AND {j} <= top THEN lpad(CAST(node // CAST(pow(3, {j} - level) AS BIGINT) AS VARCHAR), 12, '0') END" for j in range(DEEPEST, -1, -1))
       + f") AS place, repeat('  ', top - level) || '- ' || left({STRIP.format("regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')")}, 80) AS line FROM n, d")
def tree_printed(spark, sf_dir):
    return vectors.printed(_tree(spark, sf_dir), ["owner"]).select("owner", "place", "line")


@query(f"""WITH {TURNS} SELECT conv_id, turn, left(CAST(conv_id * 1000000 + turn AS VARCHAR), 6) || ': ' || left({STRIP.format("regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')")}, 80) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t) WHERE r <= 5""")
def documents_last_listed(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("node_id", F.col("conv_id") * 1000000 + F.col("turn"))
    return vectors.last_listed(rows, KEYS, "turn", "node_id")


COSTS = SIZED + """, r AS (SELECT conv_id, CAST(sum(tok) AS BIGINT) AS mi, CAST(sum(CASE WHEN role = 'assistant' THEN tok ELSE 0 END) AS BIGINT) AS mo,
    CAST(sum(CASE WHEN role = 'user' THEN tok ELSE 0 END) AS BIGINT) AS qi, CAST(count(*) AS BIGINT) AS qo FROM z GROUP BY conv_id),
c AS (SELECT *, mi / 1000.0::DOUBLE * 1e-4 + mo / 1000.0::DOUBLE * 4e-4 AS mc, qi / 1000.0::DOUBLE * 1e-4 + qo / 1000.0::DOUBLE * 4e-4 AS qc FROM r)
"""


def _records(spark, sf_dir):
    tok = lambda role: F.sum(F.when(F.col("role") == role, F.col("tok")).otherwise(F.lit(0)))
    r = _sized(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("question_id")).agg(
        F.sum("tok").alias("memory_input_tokens"), tok("assistant").alias("memory_output_tokens"), tok("user").alias("query_input_tokens"), F.count("*").alias("query_output_tokens")
    )
    return metrics.records(r.withColumns({"hypothesis": F.lit("answer"), "memory_time": F.lit(0.0), "query_time": F.lit(0.0)}))


@query("WITH " + COSTS + "SELECT CAST(conv_id AS VARCHAR) AS question_id, mi AS memory_input_tokens, mo AS memory_output_tokens, round(mc, 9) AS memory_cost, qi AS query_input_tokens, qo AS query_output_tokens, round(qc, 9) AS query_cost, mi + qi AS question_input_tokens, mo + qo AS question_output_tokens, round(mc + qc, 9) AS question_cost FROM c")
def question_cost(spark, sf_dir):
    cols = [f"{s}_{p}" for s in ("memory", "query", "question") for p in ("input_tokens", "output_tokens")]
    return _records(spark, sf_dir).select("question_id", *cols, *[F.round(f"{s}_cost", 9).alias(f"{s}_cost") for s in ("memory", "query", "question")])


@query("WITH " + COSTS + """SELECT CAST(sum(mi) AS BIGINT) AS memory_loading_prompt_tokens, CAST(sum(mo) AS BIGINT) AS memory_loading_completion_tokens, round(sum(mc), 6) AS memory_loading_cost,
CAST(sum(qi) AS BIGINT) AS query_prompt_tokens, CAST(sum(qo) AS BIGINT) AS query_completion_tokens, round(sum(qc), 6) AS query_cost, CAST(sum(mi + qi) AS BIGINT) AS total_prompt_tokens, CAST(sum(mo + qo) AS BIGINT) AS total_completion_tokens,
CAST(sum(mi + qi + mo + qo) AS BIGINT) AS total_tokens, round(sum(mc + qc), 6) AS total_cost, round(sum(mi + qi) / count(*), 6) AS average_prompt_tokens_per_question, round(sum(mo + qo) / count(*), 6) AS average_completion_tokens_per_question, round(sum(mc + qc) / count(*), 6) AS average_total_cost_per_question FROM c""")
def run_summary(spark, sf_dir):
    s = metrics.summary(_records(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"WITH {TURNS} SELECT DISTINCT conv_id FROM t WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark, sf_dir):
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("conv_id")).where("conv_id is not null").distinct()
    return _turns(spark, sf_dir).select("conv_id").distinct().join(done, "conv_id", "left_anti")


@query("SELECT CAST(n AS BIGINT) AS attempt, least(1.5 * pow(2.0, n - 1), 20.0)::DOUBLE AS store_delay, least(1.5 * pow(2.0, n - 1), 30.0)::DOUBLE AS answer_delay FROM range(1, 9) r(n)")
def backoff_schedule(spark, sf_dir):
    n = spark.range(1, cost.ATTEMPTS + 1).select(F.col("id").alias("attempt"))
    return n.select("attempt", cost.backoff(F.col("attempt")).alias("store_delay"), cost.backoff(F.col("attempt"), cost.ANSWER_CAP).alias("answer_delay"))


@query("""SELECT part_.p_partkey AS p_partkey, part_.p_size * part_.p_retailprice AS product, part_.p_retailprice / nullif(part_.p_size - 1, 0) AS quotient, CAST(part_.p_size + part_.p_partkey AS BIGINT) AS total,
CAST(part_.p_size - part_.p_partkey AS BIGINT) AS difference, 'Echo: ' || part_.p_name AS echoed FROM part AS part_""")
def arithmetic_tools(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = F.col
    return p.select("p_partkey", tools.multiply(c("p_size"), c("p_retailprice")).alias("product"), tools.divide(c("p_retailprice"), c("p_size") - 1).alias("quotient"), tools.add(c("p_size"), c("p_partkey")).cast("long").alias("total"), tools.subtract(c("p_size"), c("p_partkey")).cast("long").alias("difference"), tools.echo(c("p_name")).alias("echoed"))


@query(f"WITH {TURNS} SELECT conv_id, turn, 'error' AS keyword FROM t WHERE contains(lower(text), 'the') OR contains(lower(text), 'error')")
def keyword_turns(spark, sf_dir):
    return _turns(spark, sf_dir).where(X.has_any("text", ["The", "ERROR"])).select("conv_id", "turn", F.lit("error").alias("keyword"))


@query(f"""WITH {TURNS} SELECT conv_id, turn, text || chr(10) || '({{''tool_calls'': [{{''name'': ''search'', ''args'': {{''q'': ' || turn || '}}}}], ''x'': True}})' AS entry FROM t""")
def message_entries(spark, sf_dir):
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    calls = F.concat(F.lit('[{"function": {"name": "search", "arguments": {"q": '), F.col("turn").cast("string"), F.lit("}}}]"))
    kwargs = F.create_map(F.lit("session_id"), F.lit('"s"'), F.lit("tool_calls"), calls, F.lit("x"), F.lit("true"))
    blocks = F.array(block("text", F.col("text")), block("image", F.lit("none")))
    return _turns(spark, sf_dir).select("conv_id", "turn", messages.entry(blocks, kwargs).alias("entry"))


def _streamed(spark: SparkSession, df: DataFrame, build, mode: str) -> DataFrame:
    """Runs df as a file stream of several micro-batches through build, and reads what the sink holds."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{base}/mnemoflow-stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="mnemoflow-")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    try:
        df.repartition(4, F.xxhash64(*df.columns)).write.mode("overwrite").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/n={number:06d}")

        build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


@query(MEMORY)
def stream_budget_state(spark, sf_dir):
    rows = _sized(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), "tok", "text")
    out = _streamed(spark, rows, lambda s: state.token_buffer(s, "conv_id", BUDGET), "update")
    return state.latest(out, "conv_id", "batch").select("conv_id", "memory")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_seen_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    return _streamed(spark, rows, lambda s: state.distinct_values(s, ["user_id", "event_type"]), "append").select("user_id", "event_type")


def _instances(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conversations as evaluation turns, and each one's first user turn as its question."""
    t = conversations(spark, sf_dir).select(F.col("conv_id").cast("string").alias("question_id"), F.lit(0).cast("long").alias("session"), "turn", "role", "text")
    asked = t.where("role = 'user'").groupBy("question_id").agg(F.min_by("text", "turn").alias("question"))
    return t, asked


def _answers(strategy, **how):
    def run(spark, sf_dir):
        got = agents.answered(strategy(*_instances(spark, sf_dir)), **how)
        return got.select("question_id", "hypothesis", "memory_input_tokens", "memory_output_tokens", "query_input_tokens", "query_output_tokens")

    return run


#: The offline answer: of the memory's lines, without their speakers, the first that shares most words with the question.
ORACLE_SQL["agent_summary"] = f"""WITH {SIZED}, k AS (SELECT * FROM (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM z) WHERE s <= {budget.AGENT_LIMIT}),
m AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS memory FROM k GROUP BY conv_id),
w AS (SELECT conv_id, CAST(sum(tok) AS BIGINT) AS loaded FROM z GROUP BY conv_id),
q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id, question, coalesce(memory, '') AS memory, coalesce(loaded, 0) AS loaded FROM q LEFT JOIN m USING (conv_id) LEFT JOIN w USING (conv_id)),
l AS (SELECT conv_id, question, unnest({LINES.format('memory')}) AS x, generate_subscripts({LINES.format('memory')}, 1) AS i FROM a),
b AS (SELECT conv_id, question, i, regexp_replace({STRIP.format('x')}, '^(User|Assistant): ', '') AS line FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY len(list_intersect(list_distinct({WORDS.format('question')}), list_distinct({WORDS.format('line')}))) DESC, i) AS r
    FROM b WHERE line <> '' AND line NOT IN ('Outcome: None', 'Location: None', 'Reflection: None')),
f AS (SELECT conv_id, coalesce(line, 'I don''t know.') AS said FROM a LEFT JOIN (SELECT conv_id, line FROM c WHERE r = 1) USING (conv_id))
SELECT CAST(conv_id AS VARCHAR) AS question_id, {STRIP.format('said')} AS hypothesis, loaded AS memory_input_tokens, CAST(0 AS BIGINT) AS memory_output_tokens,
    CAST(length(question || memory) // 4 AS BIGINT) AS query_input_tokens, CAST(length(said) // 4 AS BIGINT) AS query_output_tokens FROM a JOIN f USING (conv_id)"""

QUERIES["agent_summary"] = _answers(agents.summary_memory)
QUERIES["agent_reductive"] = _answers(agents.reductive_memory)
QUERIES["agent_episodic"] = _answers(agents.episodic_memory)
QUERIES["agent_hierarchical"] = _answers(agents.tree_memory, after_context=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condensed memory of every conversation."""
    return memory_condensed_text(spark, sf_dir)

