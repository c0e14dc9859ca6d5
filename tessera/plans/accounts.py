"""Queries on users, sessions, telemetry and prompts.

Users come from the events: one a user_id, with a name that several share. Sessions are the conversations, each owned by the
user of its number modulo 20; a user row and the next row, if it is an assistant's, make a turn. The DuckDB
counterparts are written on the tables themselves, not on what the library makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import memory, models, sessions, telemetry, users
from tessera.plans.conversation import _ENDS, _TURNS, START
from tessera.plans.conversation import _turns as conversation_turns

MODEL, EMBEDDING, HEAT = "stand-in", "hashed words", {"generator": 0.5, "router": 0.0, "grader": 0.1}
OWNERS = 20
#: One event in so many is a request.
EACH = 100


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uuid(kind: str, number) -> F.Column:
    return V.normalize_uuid(F.md5(F.concat(F.lit(f"{kind} "), number.cast("string"))))


def _uuid_sql(kind: str, number: str) -> str:
    h = f"md5('{kind} ' || ({number})::VARCHAR)"
    return f"concat_ws('-', {h}[1:8], {h}[9:12], {h}[13:16], {h}[17:20], {h}[21:32])"


def _users(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("since"))
    requests = e.select(F.concat(F.lit("name"), (F.col("user_id") % 40).cast("string")).alias("username"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"), "user_id", "since")
    return users.create_users(requests, F.col("since"), _uuid("user", F.col("user_id")))


_USERS = f"users AS (SELECT {_uuid_sql('user', 'user_id')} AS user_id, 'name' || (user_id % 40) AS username, 'user' AS user_role, 'u' || user_id || '@example.org' AS email, min(ts) AS created_at, max(ts) AS last_active FROM events GROUP BY events.user_id)"


def user_create(spark, sf_dir):
    return _users(spark, sf_dir)


def user_lookup(spark, sf_dir):
    """Requests by id, name or address, several at once, none, or unknown ones."""
    k = F.col("event_id")
    asked = _read(spark, sf_dir, "events").where(k % EACH == 0).select(
        k.alias("request_id"), F.when(k % 300 == 0, _uuid("user", F.col("user_id"))).alias("user_id"), F.when(k % 200 == 0, F.concat(F.lit("name"), ((F.col("user_id") + 1) % 50).cast("string"))).alias("username"),
        F.when(k % 700 != 0, F.concat(F.lit("u"), (F.col("user_id") + 2).cast("string"), F.lit("@example.org"))).alias("email"),
    )
    return users.get_users(_users(spark, sf_dir), asked).select("request_id", "found", "user_id", "email")


def user_last_active(spark, sf_dir):
    activity = _read(spark, sf_dir, "events").select(_uuid("user", F.col("user_id")).alias("user_id"), F.col("ts").alias("at")).union(spark.sql("select 'nobody', timestamp'2100-01-01'"))
    return users.touch(_users(spark, sf_dir), activity).select("user_id", "created_at", "last_active")


def _sessions(spark, sf_dir) -> DataFrame:
    """A session for each conversation, made at its number in minutes after the start."""
    c = _read(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.col("conv_id")
    owner = c.select(k, _uuid("user", k % OWNERS).alias("user_id"), F.concat(F.lit("name"), (k % OWNERS).cast("string")).alias("username"), F.lit("user").alias("user_role"))
    return sessions.create_sessions(owner, F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=(k % 7).cast("int")), MODEL, EMBEDDING, _uuid("session", k))


_SESSIONS = f"""sessions AS (SELECT DISTINCT conv_id, {_uuid_sql('session', 'conv_id')} AS session_id, {_uuid_sql('user', f'conv_id % {OWNERS}')} AS service_user_id, NULL::VARCHAR AS title, 'name' || (conv_id % {OWNERS}) AS username,
    'user' AS user_role, '{MODEL}' AS model_name, '{EMBEDDING}' AS embedding_name, TIMESTAMP '{START}' + to_minutes(conv_id % 7) AS created_at FROM conversations),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY service_user_id ORDER BY created_at, session_id)::INTEGER AS ordinal FROM sessions)"""


def session_create(spark, sf_dir):
    return _sessions(spark, sf_dir)


def session_get(spark, sf_dir):
    return _sessions(spark, sf_dir).where(F.col("session_id") == _uuid("session", F.lit(7))).select("session_id", "service_user_id", "username")


def user_sessions(spark, sf_dir):
    return sessions.numbered(_sessions(spark, sf_dir)).select("service_user_id", "session_id", "ordinal")


def session_list(spark, sf_dir):
    return sessions.numbered(_sessions(spark, sf_dir)).where(F.col("service_user_id") == _uuid("user", F.lit(3))).select("session_id", "ordinal", "title")


def session_pick(spark, sf_dir):
    """Every event types an ordinal, or something else, for its user."""
    k = F.col("event_id")
    choice = F.when(k % 6 == 0, "x").when(k % 11 == 0, "0").otherwise((k % 6).cast("string"))
    asked = _read(spark, sf_dir, "events").select(k.alias("choice_id"), _uuid("user", F.col("user_id") % OWNERS).alias("service_user_id"), choice.alias("choice"))
    return sessions.pick(_sessions(spark, sf_dir), asked)


def _turns(spark, sf_dir) -> DataFrame:
    """The turns with ids of their own, and what the agent would add to them."""
    t = conversation_turns(spark, sf_dir)
    m = F.col("message_id")
    source = F.array(F.struct(F.concat(F.lit("src"), (m % 3).cast("string")).alias("filename"), (m % 7).cast("string").alias("chunk_id")))
    return t.select(
        _uuid("session", F.col("session_id")).alias("session_id"), _uuid("message", m).alias("message_id"), "question", "response", "created_at", F.when(m % 2 == 0, source).otherwise(F.slice(source, 1, 0)).alias("sources"),
        (m % 3).cast("int").alias("n_gen"), F.lower("question").alias("contextual_question"), (m % 100 / 7).alias("duration"), F.when(m % 5 == 0, "timeout").alias("error"), m.alias("seq"),
    )


def session_activity(spark, sf_dir):
    return sessions.with_activity(_sessions(spark, sf_dir), _turns(spark, sf_dir)).select("session_id", "message_count", "updated_at")


def session_status(spark, sf_dir):
    return sessions.status(sessions.with_activity(_sessions(spark, sf_dir), _turns(spark, sf_dir)))


def session_title(spark, sf_dir):
    """Every turn retitles its session; every seventh takes the title away."""
    log = _turns(spark, sf_dir).select("session_id", F.when(F.col("seq") % 7 != 0, F.col("question")).alias("title"), "seq")
    return sessions.retitle(_sessions(spark, sf_dir), log).select("session_id", "title")


def session_auto_title(spark, sf_dir):
    given = _sessions(spark, sf_dir).withColumn("title", F.when(F.col("username") == "name5", "given"))
    return sessions.auto_title(given, _turns(spark, sf_dir)).select("session_id", "title")


def _system(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "conversations").where("role = 'system'").select(_uuid("session", F.col("conv_id")).alias("session_id")).distinct()


def session_delete(spark, sf_dir):
    """Sessions after those with a system message are deleted, with what the deletion returns (an unknown id, too)."""
    ids = _system(spark, sf_dir).union(spark.sql("select 'nobody'"))
    kept, gone = sessions.delete(_sessions(spark, sf_dir), ids)
    return kept.select("session_id", F.lit(True).alias("kept"), "username").union(gone.select("session_id", F.lit(False), "username"))


def session_welcome(spark, sf_dir):
    made = _sessions(spark, sf_dir)
    both = [sessions.welcome_turns(made, language).withColumn("language", F.lit(language)) for language in ("italian", "klingon")]
    return both[0].union(both[1]).select("session_id", "language", "question")


def _log(spark, sf_dir) -> DataFrame:
    """The memory's log: three records a turn, and feedback on it, for every second turn by two users."""
    turns = _turns(spark, sf_dir)
    records = telemetry.save_agent_turns(turns, EMBEDDING, MODEL, HEAT, (F.length("question") + F.length("response")).cast("long"))
    who = F.explode(F.array(F.lit(1), F.lit(2))).alias("who")
    feedback = turns.where("seq % 2 = 1").select("*", who).select(
        "session_id", "message_id", _uuid("user", F.col("who")).alias("user_id"), V.feedback_value(F.when(F.col("who") == 1, F.lit(" Good ")).otherwise(F.lit("bad"))).alias("feedback_value"), F.lit(None).cast("string").alias("feedback_message"), "created_at", (F.col("seq") * 10 + F.col("who")).alias("seq"),
    )
    return records.unionByName(telemetry.feedback_turns(feedback))


def turn_records(spark, sf_dir):
    """The current records of all four namespaces."""
    now = memory.latest(_log(spark, sf_dir))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return now.select(
        F.get("namespace", F.lit(0)).alias("kind"), F.get("namespace", F.lit(1)).alias("session_id"), field("message_id").alias("message_id"), "key", field("question").alias("question"), field("response").alias("response"),
        field("sources[0].filename").alias("filename"), field("metadata.contextual_question").alias("contextual_question"), field("model_name").alias("model_name"), field("token_used").cast("long").alias("tokens"), field("latency_ms").cast("double").alias("latency_ms"), field("feedback_value").cast("int").alias("feedback_value"), field("error").alias("error"),
    )


def delete_session(spark, sf_dir):
    left = telemetry.delete_sessions(memory.latest(_log(spark, sf_dir)), _system(spark, sf_dir))
    return left.groupBy(F.get("namespace", F.lit(0)).alias("kind"), F.get("namespace", F.lit(1)).alias("session_id")).agg(F.count(F.lit(1)).alias("n"))


def kv_coerce(spark, sf_dir):
    """Stored turns that lack an id, an empty one or an empty object of metadata."""
    m = F.col("message_id")
    items = conversation_turns(spark, sf_dir).select(
        F.array(F.lit("conversation"), F.col("session_id").cast("string")).alias("namespace"), m.cast("string").alias("key"), F.col("created_at").cast("string").alias("created_at"), F.col("turn").alias("seq"),
        F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "").otherwise(m.cast("string")).alias("message_id"), F.when(F.col("turn") % 2 == 0, F.col("session_id").cast("string")).alias("session_id"), F.col("question"), F.when(F.col("turn") % 2 == 1, F.struct(F.lit(1).alias("n_gen"))).alias("metadata"))).alias("value"),
    )
    return memory.coerce(items)


def uuid_valid(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    k = F.col("event_id") % 5
    s = F.when(k == 0, h).when(k == 1, F.concat(F.lit("{"), F.upper(h), F.lit("}"))).when(k == 2, F.concat(F.lit("urn:uuid:"), h)).when(k == 3, F.substring(h, 1, 31)).otherwise(F.concat(F.lit("g"), F.substring(h, 2, 31)))
    return _read(spark, sf_dir, "events").select("event_id", V.normalize_uuid(s).alias("id"))


def turn_latency(spark, sf_dir):
    w = "lag(ts) over (partition by user_id order by ts, event_id)"
    return _read(spark, sf_dir, "events").withColumn("before", F.expr(w)).select("event_id", V.seconds_between(F.col("before"), F.col("ts")).alias("seconds"))


def feedback_value(spark, sf_dir):
    words = F.array(*map(F.lit, (" Positive", "pos", "GOOD", "yes\n", "negative", "Neg ", "bad", "NO", "maybe", "")))
    return _read(spark, sf_dir, "events").select("event_id", V.feedback_value(F.get(words, (F.col("event_id") % 10).cast("int"))).alias("feedback_value"))


_LINES = ("/HELP", "/feedback  good well done", " /new ", "/unknown x", "hello there", "  ", "/sessions", "/status now", "/logout", "help")


def parse_command(spark, sf_dir):
    line = F.get(F.array(*map(F.lit, _LINES)), (F.col("event_id") % len(_LINES)).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", V.parse_command(line).alias("c")).select("event_id", "c.kind", F.size("c.words").alias("n"), F.element_at("c.words", -1).alias("rest"))


def lang_default(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", V.language_or(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")), "en").alias("language"))


def thread_state(spark, sf_dir):
    last = F.max_by(F.struct("role", "text"), "turn")
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("turn"), last.alias("last"))
    return c.select("conv_id", "n_messages", "turn", "last.role", "last.text")


def prompt_render(spark, sf_dir):
    """All nodes' prompts for each question."""
    b = _read(spark, sf_dir, "benchmark")
    given = {v: F.lit(f"<{v}>") for _, s, h in models.PROMPTS.values() for _, _, v in models._variables(s + h)}
    given["question"] = F.col("text")
    every = F.array(*[F.struct(F.lit(n).alias("name"), models.render(n, **given).alias("prompt")) for n in models.PROMPTS])
    return b.select("item_id", F.explode(every).alias("p")).select("item_id", "p.name", "p.prompt")


def model_answers(spark, sf_dir):
    """A model behind the registry, here one that spells the prompt's last line backwards."""
    registry = models.Registry(_backwards, HEAT)
    return _read(spark, sf_dir, "benchmark").select("item_id", models.ask(registry, "answer_grader", question=F.col("text"), generation="x", format_instructions="").alias("answer"))


def _backwards(role: str, temperature: float):
    return lambda prompts: prompts.map(lambda p: f"<think>{role} {temperature}</think> assistantfinal " + p.split("Question: ")[1].split("\nAnswer: ")[0][::-1])


def strip_space(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.strip_space(F.concat(F.lit("\x1c  \x85"), "text", F.lit(" \x1f\n"))).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (user_create, user_lookup, user_last_active, session_create, session_get, user_sessions, session_list, session_pick, session_activity, session_status, session_title, session_auto_title, session_delete, session_welcome)
    + (turn_records, delete_session, kv_coerce, uuid_valid, turn_latency, feedback_value, parse_command, lang_default, thread_state, prompt_render, model_answers, strip_space)
}

_OWN = f"""own AS (SELECT *, {_uuid_sql('session', 'session_id')} AS sid, {_uuid_sql('message', 'message_id')} AS mid FROM turns)"""
_GONE = f"gone AS (SELECT DISTINCT {_uuid_sql('session', 'conv_id')} AS session_id FROM conversations WHERE role = 'system')"
_WORDS = "[' Positive', 'pos', 'GOOD', 'yes', 'negative', 'Neg ', 'bad', 'NO', 'maybe', '']"


def _prompt_sql() -> str:
    rows = []
    for name, (_, system, human) in models.PROMPTS.items():
        text = f"System: {system}\nHuman: {human}".replace("'", "''")
        rows.append(f"('{name}', '{text}')")
    filled = "replace(template, '{question}', chr(1))"
    for v in sorted({v for _, s, h in models.PROMPTS.values() for _, _, v in models._variables(s + h)} - {"question"}):
        filled = f"replace({filled}, '{{{v}}}', '<{v}>')"
    return f"SELECT item_id, name, replace({filled}, chr(1), coalesce(text, '')) AS prompt FROM benchmark, (VALUES {', '.join(rows)}) t(name, template)"


ORACLES = {
    "user_create": f"WITH {_USERS} SELECT * REPLACE (created_at AS last_active) FROM users",
    "user_lookup": f"""WITH {_USERS}, asked AS (SELECT event_id AS request_id, CASE WHEN event_id % 300 = 0 THEN {_uuid_sql('user', 'user_id')} END AS i, CASE WHEN event_id % 200 = 0 THEN 'name' || ((user_id + 1) % 50) END AS n,
        CASE WHEN event_id % 700 <> 0 THEN 'u' || (user_id + 2) || '@example.org' END AS e FROM events WHERE event_id % {EACH} = 0),
      hits AS (SELECT request_id, user_id, email, row_number() OVER (PARTITION BY request_id ORDER BY created_at, user_id) AS r FROM asked JOIN users u ON CASE WHEN i IS NOT NULL THEN u.user_id = i WHEN n IS NOT NULL THEN u.username = n ELSE u.email = e END)
      SELECT a.request_id, CASE WHEN coalesce(i, n, e) IS NOT NULL THEN h.user_id IS NOT NULL END AS found, h.user_id, h.email FROM asked a LEFT JOIN hits h ON h.request_id = a.request_id AND h.r = 1""",
    "user_last_active": f"WITH {_USERS} SELECT user_id, created_at, last_active FROM users",
    "session_create": f"WITH {_SESSIONS} SELECT session_id, service_user_id, title, username, user_role, model_name, embedding_name, created_at, created_at AS updated_at, 0::BIGINT AS message_count FROM sessions",
    "session_get": f"WITH {_SESSIONS} SELECT session_id, service_user_id, username FROM sessions WHERE conv_id = 7",
    "user_sessions": f"WITH {_SESSIONS} SELECT service_user_id, session_id, ordinal FROM ordered",
    "session_list": f"WITH {_SESSIONS} SELECT session_id, ordinal, title FROM ordered WHERE conv_id % {OWNERS} = 3",
    "session_pick": f"""WITH {_SESSIONS} SELECT event_id AS choice_id, session_id FROM events LEFT JOIN ordered ON conv_id % {OWNERS} = user_id % {OWNERS}
      AND ordinal = CASE WHEN event_id % 6 = 0 OR event_id % 11 = 0 THEN -1 ELSE event_id % 6 END""",
    "session_activity": f"WITH {_SESSIONS}, {_TURNS} SELECT s.session_id, count(t.message_id) AS message_count, greatest(any_value(s.created_at), max(t.created_at)) AS updated_at FROM sessions s LEFT JOIN turns t ON t.session_id = s.conv_id GROUP BY s.session_id",
    "session_status": f"WITH {_SESSIONS}, {_TURNS} SELECT s.session_id, count(t.message_id) AS message_count, any_value(s.created_at) AS created_at, greatest(any_value(s.created_at), max(t.created_at)) AS updated_at FROM sessions s LEFT JOIN turns t ON t.session_id = s.conv_id GROUP BY s.session_id",
    "session_title": f"WITH {_SESSIONS}, {_TURNS} SELECT s.session_id, CASE WHEN m % 7 <> 0 THEN question END AS title FROM sessions s LEFT JOIN (SELECT session_id, max(message_id) AS m, arg_max_null(question, message_id) AS question FROM turns GROUP BY session_id) t ON t.session_id = s.conv_id",
    "session_auto_title": f"WITH {_SESSIONS}, {_TURNS} SELECT s.session_id, CASE WHEN conv_id % {OWNERS} = 5 THEN 'given' ELSE q END AS title FROM sessions s LEFT JOIN (SELECT session_id, arg_min_null(question, message_id) AS q FROM turns GROUP BY session_id) t ON t.session_id = s.conv_id",
    "session_delete": f"WITH {_SESSIONS}, {_GONE} SELECT session_id, session_id NOT IN (SELECT session_id FROM gone) AS kept, username FROM sessions UNION ALL SELECT 'nobody', false, NULL",
    "session_welcome": f"WITH {_SESSIONS} SELECT session_id, language, question FROM sessions, (VALUES ('italian', '{V.WELCOME['italian']}'), ('klingon', '{V.WELCOME['english']}')) w(language, question)",
    "turn_records": f"""WITH {_TURNS}, {_OWN},
      none AS (SELECT NULL::VARCHAR AS v) SELECT 'conversation' AS kind, sid AS session_id, mid AS message_id, mid AS key, question, response, NULL::VARCHAR AS filename, lower(question) AS contextual_question, NULL::VARCHAR AS model_name, NULL::BIGINT AS tokens,
        NULL::DOUBLE AS latency_ms, NULL::INTEGER AS feedback_value, CASE WHEN message_id % 5 = 0 THEN 'timeout' END AS error FROM own
      UNION ALL SELECT 'retrieval', sid, mid, 'results', question, NULL, CASE WHEN message_id % 2 = 0 THEN 'src' || (message_id % 3) END, NULL, NULL, NULL, NULL, NULL, NULL FROM own
      UNION ALL SELECT 'llm', sid, mid, 'results', NULL, NULL, NULL, NULL, '{MODEL}', length(question) + length(response), round((message_id % 100)::DOUBLE / 7, 2), NULL, NULL FROM own
      UNION ALL SELECT 'feedback', sid, mid, mid, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL FROM own WHERE message_id % 2 = 1""",
    "delete_session": f"""WITH {_TURNS}, {_OWN}, {_GONE}, left_over AS (SELECT * FROM own WHERE sid NOT IN (SELECT session_id FROM gone))
      SELECT kind, sid AS session_id, count(*) AS n FROM left_over, (VALUES ('conversation'), ('retrieval'), ('llm')) k(kind) GROUP BY ALL UNION ALL SELECT 'feedback', sid, count(*) FROM left_over WHERE message_id % 2 = 1 GROUP BY sid""",
    "kv_coerce": f"""WITH {_TURNS} SELECT message_id::VARCHAR AS message_id, session_id::VARCHAR AS session_id, coalesce(question, '') AS question, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
      CASE WHEN turn % 2 = 1 THEN '{{"n_gen":1}}' ELSE '{{}}' END AS metadata, turn AS seq FROM turns""",
    "uuid_valid": """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) END AS id FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events)""",
    "turn_latency": "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000, 2) AS seconds FROM events",
    "feedback_value": f"SELECT event_id, CASE WHEN w IN ('positive', 'pos', 'good', 'yes') THEN 1 WHEN w IN ('negative', 'neg', 'bad', 'no') THEN 0 END::INTEGER AS feedback_value FROM (SELECT event_id, lower(trim({_WORDS}[event_id % 10 + 1])) AS w FROM events)",
    "parse_command": """SELECT event_id, kind, n::INTEGER AS n, rest FROM events JOIN (VALUES (0, '/help', 1, '/help'), (1, '/feedback', 3, 'well done'), (2, '/new', 1, '/new'), (3, 'message', 2, 'x'), (4, 'message', 2, 'there'), (5, 'empty', 1, ''),
      (6, '/sessions', 1, '/sessions'), (7, '/status', 2, 'now'), (8, '/logout', 1, '/logout'), (9, 'message', 1, 'help')) t(k, kind, n, rest) ON event_id % 10 = k""",
    "lang_default": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR lang IS NULL OR lang = '' THEN 'en' ELSE lang END AS language FROM documents",
    "thread_state": "SELECT conv_id, count(*) AS n_messages, max(turn) AS turn, arg_max_null(role, turn) AS role, arg_max_null(text, turn) AS text FROM conversations GROUP BY conv_id",
    "prompt_render": _prompt_sql(),
    "strip_space": rf"SELECT doc_id, regexp_replace(text, {_ENDS}) AS text FROM documents",
    "model_answers": "SELECT item_id, trim(reverse(coalesce(text, ''))) AS answer FROM benchmark",
}
