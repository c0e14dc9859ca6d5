"""Conversation queries: text guards, rendering, memory, users, sessions, evaluation.

conversations is the message log: a user row and the next row, if it is an assistant's, make a turn.
message_id is conv_id * 100 + turn, a turn's time is its number in minutes after a fixed start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, memory, messages, models
from tessera.plans._pairs import duck, spark_query

START, HISTORY = "2024-01-01 00:00:00", 3
SAMPLES = (
    ('<think>a\nb</think> {"binary_score":"yes"}', "<THINK>x</think>A<think>y</THINK>B", "<think>x", "analysis assistantfinal  hello", "assistantfinal a assistantfinal b", 'Json {"branch":"other"}')
    + ('assistantfinal json {"language":"it"}', "plain", "oops", '{"binary_score":"maybe"}', '{"binary_score":"no"}', "  padded \n")
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id int, s string")


_LITERALS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(x.replace("'", "''") for x in SAMPLES))
_SAMPLES = f"samples(id, s) AS (VALUES {_LITERALS})"
_ENDS = r"'^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$', '', 'g'"
_THINK = rf"regexp_replace(regexp_replace(s, '(?is)<think>.*?</think>', '', 'g'), {_ENDS})"
_CUT1 = rf"CASE WHEN regexp_matches(s, '(?s)assistantfinal\s*(.*)') THEN regexp_replace(regexp_extract(s, '(?s)assistantfinal\s*(.*)', 1), {_ENDS}) ELSE s END"
_CUT2 = rf"CASE WHEN regexp_matches(s, '(?s)[Jj][Ss][Oo][Nn]\s*(\{{.*)') THEN regexp_replace(regexp_extract(s, '(?s)[Jj][Ss][Oo][Nn]\s*(\{{.*)', 1), {_ENDS}) ELSE s END"
#: Whole documents as a model would answer with them, in three forms.
_ANSWERS = """answers AS (SELECT doc_id::INTEGER + 1000 AS id, CASE doc_id % 3 WHEN 0 THEN '<think>x' || chr(10) || '</think> AssistantFinal assistantfinal' || chr(10) || text
    WHEN 1 THEN text || '<THINK>' || lang || '</think> json' || chr(10) || chr(10) || '{"binary_score":"' || CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'maybe' END || '"}' ELSE text || ' <think>' END AS s FROM documents
    WHERE text IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT * FROM samples)"""
_FINAL = f"think AS (SELECT id, {_THINK} AS s FROM answers), cut AS (SELECT id, {_CUT1} AS s FROM think), final AS (SELECT id, {_CUT2} AS s FROM cut)"


def _answers(spark, sf_dir) -> DataFrame:
    d, k = _read(spark, sf_dir, "documents").where("text is not null and lang is not null"), F.col("doc_id")
    final = F.concat(F.lit("<think>x\n</think> AssistantFinal assistantfinal\n"), "text")
    scored = F.concat("text", F.lit("<THINK>"), "lang", F.lit('</think> json\n\n{"binary_score":"'), F.when(k % 2 == 0, "yes").otherwise("maybe"), F.lit('"}'))
    s = F.when(k % 3 == 0, final).when(k % 3 == 1, scored).otherwise(F.concat("text", F.lit(" <think>")))
    return d.select((k.cast("int") + 1000).alias("id"), s.alias("s")).union(_samples(spark))


def strip_think(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", T.strip_think(F.col("s")).alias("cleaned"))


def get_final(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", models.free_text(F.col("s")).alias("final"))


def parse_json(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", T.parse_field(F.col("props"), "k").cast("bigint").alias("k"))


def validate_domain(spark, sf_dir):
    final = T.get_final(T.strip_think(F.col("s")))
    valid = F.when(final.startswith("{"), T.structured(F.col("s"), "binary_score", ("yes", "no")))
    return _answers(spark, sf_dir).select("id", valid.alias("score"), valid.isNull().alias("faulted"))


def _messages(spark, sf_dir) -> DataFrame:
    """(conv_id, messages) with typed messages in order, other roles dropped."""
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    typed = _read(spark, sf_dir, "conversations").withColumn("type", kind).where("type is not null")
    each = F.array_sort(F.collect_list(F.struct("turn", "type", F.col("text").alias("content"))))
    return typed.groupBy("conv_id").agg(F.transform(each, lambda m: F.struct(m["type"].alias("type"), m["content"].alias("content"))).alias("messages"))


def render_history(spark, sf_dir):
    m = F.col("messages")
    return _messages(spark, sf_dir).select("conv_id", T.render_messages(F.slice(m, 1, F.size(m) - 1)).alias("history"))


def memory_tail(spark, sf_dir):
    """The last messages of each conversation, ranked before they are gathered."""
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    typed = messages.last_messages(_read(spark, sf_dir, "conversations").withColumn("type", kind).where("type is not null"), 2 * HISTORY)
    each = F.array_sort(F.collect_list(F.struct("turn", "type", F.col("text").alias("content"))))
    return typed.groupBy("conv_id").agg(each.alias("m")).select("conv_id", T.render_messages(F.col("m")).alias("history"))


def to_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.posexplode("messages").alias("pos", "m")).select("conv_id", "pos", "m.type", "m.content")


def rolling_messages(spark, sf_dir):
    """Each conversation's messages up to turn 3 merged with those from turn 2 on, whose texts replace the earlier ones."""
    c = _read(spark, sf_dir, "conversations")
    some = lambda keep, text: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", text.alias("text"))))), lambda m: F.struct(m["turn"].alias("id"), m["text"].alias("text")))
    both = c.groupBy("conv_id").agg(some(F.col("turn") <= 3, F.col("text")).alias("a"), some(F.col("turn") >= 2, F.reverse("text")).alias("b"))
    return both.select("conv_id", F.posexplode(messages.add_messages(F.col("a"), F.col("b"))).alias("pos", "m")).select("conv_id", "pos", "m.id", "m.text")


_TYPED = "typed AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' END AS type, text FROM conversations WHERE role IN ('user', 'assistant')), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM typed)"


def detect_language(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


def _hits(words: tuple[str, ...]) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))"


_LANGUAGE = f"""WITH words AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents),
  hits AS (SELECT doc_id, {', '.join(f'{_hits(v)} AS {k}' for k, v in T.STOP_WORDS.items())} FROM words)
  SELECT doc_id, CASE WHEN coalesce(greatest(de, en, es, fr), 0) = 0 THEN 'en' {' '.join(f"WHEN {k} = greatest(de, en, es, fr) THEN '{k}'" for k in T.STOP_WORDS)} END AS language FROM hits"""


def _turns(spark, sf_dir) -> DataFrame:
    """(session_id, message_id, question, response, created_at): user rows with the next row's text if it is an assistant's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    at = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    return c.where("role = 'user'").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("response"), at.alias("created_at"), "turn"
    )


_TURNS = f"""turns AS (SELECT conv_id AS session_id, conv_id * 100 + turn AS message_id, text AS question, CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS response,
    TIMESTAMP '{START}' + to_minutes(turn) AS created_at, turn
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) WHERE role = 'user')"""


def history_last_n(spark, sf_dir):
    return memory.history(_turns(spark, sf_dir), HISTORY).select("session_id", "message_id", "rank")


def _log(spark, sf_dir) -> DataFrame:
    """A write log: each event upserts a feedback of its user on one of 5 messages; every 7th event deletes it."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.array(F.lit("feedback"), F.col("user_id").cast("string")).alias("namespace"), (F.col("event_id") % 5).cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "delete").otherwise("put").alias("op")
    )


_LATEST = "entries AS (SELECT user_id, key, value, seq FROM (SELECT user_id, (event_id % 5)::VARCHAR AS key, event_type AS value, event_id AS seq, event_id % 7 = 0 AS gone, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND NOT gone)"


def kv_latest(spark, sf_dir):
    return memory.latest(_log(spark, sf_dir)).select(F.get("namespace", F.lit(1)).alias("session_id"), "key", "value", "seq")


def session_feedback(spark, sf_dir):
    return memory.scan(memory.latest(_log(spark, sf_dir)), ["feedback", "3"]).select("key", "value", "seq")


def delete_prefix(spark, sf_dir):
    entries = memory.latest(_log(spark, sf_dir))
    gone = _read(spark, sf_dir, "events").select(F.lit("feedback").alias("kind"), (F.col("user_id")).cast("string").alias("session_id")).where("session_id like '%1'").distinct()
    return memory.delete_prefix(entries, gone).select(F.get("namespace", F.lit(1)).alias("session_id"), "key", "value")


def _asked(spark, sf_dir) -> DataFrame:
    """Questions of the benchmark, ten to a guideline, one row of the source each; one question in four has no id."""
    b = _read(spark, sf_dir, "benchmark")
    q = F.struct(F.col("item_id").alias("k"), F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("q"), F.col("item_id").cast("string"))).alias("id"), F.col("text").alias("question"))
    grouped = b.groupBy(F.lpad(F.floor(F.col("item_id") / 10).cast("string"), 6, "0").alias("g")).agg(F.array_sort(F.collect_list(q)).alias("questions"))
    entry = F.struct(F.concat(F.lit("name "), F.col("g")).alias("guideline_name"), F.transform("questions", lambda x: F.struct(x["id"], x["question"])).alias("questions"))
    return grouped.select(F.create_map(F.col("g"), entry).alias("guidelines"))


_ASKED = "asked AS (SELECT lpad((item_id // 10)::VARCHAR, 6, '0') AS guideline, 'name ' || lpad((item_id // 10)::VARCHAR, 6, '0') AS guideline_name, (row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) - 1)::INTEGER AS pos, CASE WHEN item_id % 4 <> 0 THEN 'q' || item_id END AS id, text AS question FROM benchmark), defaults AS (SELECT guideline, guideline_name, pos, coalesce(id, 'Q_' || row_number() OVER (ORDER BY guideline, pos)) AS id, coalesce(question, '') AS question FROM asked)"


def eval_flatten(spark, sf_dir):
    return evaluation.flatten(_asked(spark, sf_dir))


def eval_defaults(spark, sf_dir):
    return evaluation.with_defaults(evaluation.flatten(_asked(spark, sf_dir)))


def _eval_answers(spark, sf_dir) -> DataFrame:
    asked = evaluation.with_defaults(evaluation.flatten(_asked(spark, sf_dir)))
    return evaluation.answered(asked.withColumns({"answer": F.when(F.col("pos") % 5 != 0, F.upper("id")), "error": F.lit("no answer")}))


def eval_errors(spark, sf_dir):
    return _eval_answers(spark, sf_dir).select("guideline", "id", "answer")


def eval_regroup(spark, sf_dir):
    return evaluation.regroup(_eval_answers(spark, sf_dir)).select("guideline", "guideline_name", F.array_join(F.transform("questions", lambda q: F.concat(q["id"], F.lit("="), q["answer"])), ";").alias("answers"))


def json_source(spark, sf_dir):
    """The few-shot examples, written as JSON by Spark's own function and read with a schema."""
    rows = spark.createDataFrame([('[{"input":"hi","output":"conversational"},{"input":"what does chapter 2 say","output":"document_based"}]',)], "body string")
    return rows.select(F.explode(F.from_json("body", "array<struct<input:string,output:string>>")).alias("e")).select("e.input", "e.output")


QUERIES = {
    f.__name__: f
    for f in (strip_think, get_final, parse_json, validate_domain, render_history, memory_tail, to_messages, rolling_messages, detect_language, history_last_n)
    + (kv_latest, session_feedback, delete_prefix, eval_flatten, eval_defaults, eval_errors, eval_regroup, json_source)
}
QUERIES["feedback_latest"] = kv_latest
_HISTORY = "SELECT conv_id, coalesce(string_agg(type || ': ' || text, chr(10) ORDER BY n) FILTER (WHERE {keep}), '') AS history FROM numbered GROUP BY conv_id"
ORACLES = {
    "strip_think": f"WITH {_SAMPLES}, {_ANSWERS} SELECT id, {_THINK} AS cleaned FROM answers",
    "get_final": f"WITH {_SAMPLES}, {_ANSWERS}, {_FINAL} SELECT id, s AS final FROM final",
    "parse_json": "SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events",
    "validate_domain": f"""WITH {_SAMPLES}, {_ANSWERS}, {_FINAL}, scored AS (SELECT id, CASE WHEN s LIKE '{{%' THEN json_extract_string(s, '$.binary_score') END AS v FROM final)
      SELECT id, CASE WHEN v IN ('yes', 'no') THEN v END AS score, coalesce(v NOT IN ('yes', 'no'), true) AS faulted FROM scored""",
    "render_history": f"WITH {_TYPED} " + _HISTORY.format(keep="n < total"),
    "memory_tail": f"WITH {_TYPED} " + _HISTORY.format(keep=f"n > total - {2 * HISTORY}"),
    "to_messages": f"WITH {_TYPED} SELECT conv_id, (n - 1)::INTEGER AS pos, type, text AS content FROM numbered",
    "rolling_messages": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, turn AS id, CASE WHEN turn >= 2 THEN reverse(text) ELSE text END AS text FROM conversations",
    "detect_language": _LANGUAGE,
    "history_last_n": f"WITH {_TURNS} SELECT session_id, message_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS rank FROM turns) WHERE rank <= {HISTORY}",
    "kv_latest": f"WITH {_LATEST} SELECT user_id::VARCHAR AS session_id, key, value, seq FROM entries",
    "feedback_latest": f"WITH {_LATEST} SELECT user_id::VARCHAR AS session_id, key, value, seq FROM entries",
    "session_feedback": f"WITH {_LATEST} SELECT key, value, seq FROM entries WHERE user_id = 3",
    "delete_prefix": f"WITH {_LATEST} SELECT user_id::VARCHAR AS session_id, key, value FROM entries WHERE user_id::VARCHAR NOT LIKE '%1'",
    "eval_flatten": f"WITH {_ASKED} SELECT * FROM asked",
    "eval_defaults": f"WITH {_ASKED} SELECT * FROM defaults",
    "eval_errors": f"WITH {_ASKED} SELECT guideline, id, CASE WHEN pos % 5 <> 0 THEN upper(id) ELSE 'ERROR: no answer' END AS answer FROM defaults",
    "eval_regroup": f"WITH {_ASKED} SELECT guideline, guideline_name, string_agg(id || '=' || CASE WHEN pos % 5 <> 0 THEN upper(id) ELSE 'ERROR: no answer' END, ';' ORDER BY pos) AS answers FROM defaults GROUP BY ALL",
}

#: (Spark, DuckDB) where a function's dialect differs.
DIALECTS = {
    "fmt_ts": ("SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS stamp FROM {events}", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp FROM {events}"),
    "token_count": (
        "SELECT doc_id, CAST(size(array_remove(split(text, '[ \\\\t\\\\n\\\\r]+'), '')) AS BIGINT) AS n_tokens FROM {documents}",
        "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM {documents}",
    ),
    "fewshot_prompt": (
        "SELECT lang, listagg(concat('input: ', coalesce(text, ''), ', output: ', coalesce(source, '')), '\\n') WITHIN GROUP (ORDER BY doc_id) AS prompt FROM {documents} WHERE doc_id IN (SELECT min(doc_id) FROM {documents} GROUP BY lang, source) GROUP BY lang",
        "SELECT lang, string_agg(concat('input: ', coalesce(text, ''), ', output: ', coalesce(source, '')), chr(10) ORDER BY doc_id) AS prompt FROM {documents} WHERE doc_id IN (SELECT min(doc_id) FROM {documents} GROUP BY lang, source) GROUP BY lang",
    ),
}
QUERIES |= {name: spark_query(s) for name, (s, _) in DIALECTS.items()}
ORACLES |= {name: duck(d) for name, (_, d) in DIALECTS.items()}
