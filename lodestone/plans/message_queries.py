"""Conversations and agent episodes: cleaning, masks, prefixes, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages as M
from .registry import query, rounded
from .views import MESSAGES, messages, table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, m: the messages of each conversation in order of turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in M.MESSAGE.fields}
    part = F.struct(F.col("turn"), *[(F.col("role") if n == "role" else F.col("text") if n == "content" else e).alias(n) for n, e in empty.items()])
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("m"))
    return rows.withColumn("m", F.transform("m", lambda t: F.struct(*[t[n].alias(n) for n in M.MESSAGE.names])))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, domain, m: agent messages of each user, calls as structs."""
    e = messages(spark, sf_dir)
    call = F.when(F.col("tool_name").isNotNull(), F.array(F.struct(F.col("tool_name").alias("name"), F.lit(None).cast(M.CALL["function"].dataType).alias("function"), F.col("content").alias("arguments"))))
    part = F.struct("ord", "role", F.col("content").alias("content"), call.cast(M.MESSAGE["tool_calls"].dataType).alias("tool_calls"), F.lit(None).cast("boolean").alias("error"), F.lit(None).cast("string").alias("requestor"), F.lit(None).cast("boolean").alias("_trainable"))
    rows = e.groupBy("episode", "domain").agg(F.sort_array(F.collect_list(part)).alias("m"))
    return rows.withColumn("m", F.transform("m", lambda t: F.struct(*[t[n].alias(n) for n in M.MESSAGE.names])))


def _joined(df: DataFrame, key: str, m: str = "m") -> DataFrame:
    """Messages as one text, so that whole arrays can be compared."""
    text = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["content"], F.lit("")))), "\n")
    return df.select(key, F.size(m).cast("long").alias("n"), F.md5(text).alias("md5"))


_JOINED = "count(*)::BIGINT AS n, md5(string_agg(role || ':' || coalesce(content, ''), chr(10) ORDER BY ord)) AS md5"


@query("""WITH c AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations), k AS (SELECT conv_id, role, text AS content, turn AS ord FROM c WHERE role <> 'assistant' OR turn >= u)
SELECT conv_id, coalesce(n, 0)::BIGINT AS n, coalesce(md5, md5('')) AS md5 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, """ + _JOINED + """ FROM k GROUP BY conv_id) USING (conv_id)""")
def drop_pre_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(conversations(spark, sf_dir).select("conv_id", M.drop_pre_user(F.col("m")).alias("m")), "conv_id")


@query("SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def first_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", M.first_user(F.col("m")).alias("text"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant' AND trim(text) <> '') > 0 AS has_target FROM conversations GROUP BY conv_id")
def has_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", M.has_target(F.col("m")).alias("has_target"))


@query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role FROM conversations), u AS (SELECT conv_id, list(i ORDER BY i) AS ps FROM p WHERE role = 'user' GROUP BY conv_id),
x AS (SELECT conv_id, CASE WHEN len(ps) <= 3 THEN list_reverse(ps) ELSE list_reverse(list_sort(list_distinct([ps[round_even(j * (len(ps) - 1) / 2.0, 0)::INT + 1] FOR j IN range(3)]))) END AS ps FROM u)
SELECT conv_id, array_to_string(ps, ',') AS prefixes FROM x""")
def decision_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", F.array_join(M.decision_points(F.col("m"), 3), ",").alias("prefixes"))


_RUNS = f"""WITH {MESSAGES}, g AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER w = 'tool' THEN 0 ELSE 1 END AS new FROM messages WINDOW w AS (PARTITION BY episode ORDER BY ord)),
r AS (SELECT *, sum(new) OVER (PARTITION BY episode ORDER BY ord) AS run FROM g), m AS (SELECT episode, run AS ord, any_value(role) AS role, string_agg(content, chr(10) ORDER BY ord) AS content FROM r GROUP BY episode, run)
SELECT episode, {_JOINED} FROM m GROUP BY episode"""


@query(_RUNS)
def merge_tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = episodes(spark, sf_dir).select("episode", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["_trainable"].alias("_trainable"))).alias("m"))
    return _joined(plain.select("episode", M.merge_tool_runs(F.col("m")).alias("m")), "episode")


_CALLED = """CASE WHEN tool_name IS NULL THEN content ELSE '<tool_call>' || chr(10) || '{"name":"' || tool_name || '","arguments":' || content || '}' || chr(10) || '</tool_call>' END"""


@query(f"WITH {MESSAGES}, m AS (SELECT episode, ord, role, {_CALLED} AS content FROM messages) SELECT episode, {_JOINED} FROM m GROUP BY episode")
def clean_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(episodes(spark, sf_dir).select("episode", M.clean(F.col("m")).alias("m")), "episode")


@query(f"""WITH {MESSAGES}, i AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ord) - 1 AS i FROM messages)
SELECT episode, count(*) FILTER (role = 'assistant' AND i >= 7 AND episode % 2 = 0)::BIGINT AS marked, count(*) FILTER (role = 'assistant' AND i < 7 AND episode % 2 = 0)::BIGINT AS unmarked FROM i GROUP BY episode""")
def opd_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir).select("episode", M.opd_mask(F.col("m"), F.lit(7), F.col("episode") % 2 == 0).alias("m"))
    count = lambda want: F.size(F.filter("m", lambda x: F.coalesce(x["_trainable"] == want, F.lit(False)))).cast("long")
    return e.select("episode", count(True).alias("marked"), count(False).alias("unmarked"))


@query(f"WITH {MESSAGES} SELECT episode, string_agg(tool_name, ',' ORDER BY ord) AS names, count(tool_name)::BIGINT AS n FROM messages GROUP BY episode")
def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = M.tool_names(F.col("m"))
    return episodes(spark, sf_dir).select("episode", F.array_join(names, ",").alias("names"), F.size(names).cast("long").alias("n"))


_EXPECTED = "CASE episode % 3 WHEN 0 THEN ['click', 'refund'] WHEN 1 THEN ['view', 'click', 'view'] ELSE []::VARCHAR[] END"


@query(f"""WITH {MESSAGES}, o AS (SELECT episode, list_distinct(list(tool_name)) AS seen, {_EXPECTED} AS want FROM messages GROUP BY episode),
r AS (SELECT episode, CASE WHEN len(want) = 0 THEN 1 ELSE len(list_intersect(list_distinct(want), seen)) / len(list_distinct(want))::DOUBLE END AS recall FROM o)
SELECT episode, round(recall, 9) AS recall, recall >= 1 AS complete FROM r""")
def action_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.expr("CASE episode % 3 WHEN 0 THEN array('click', 'refund') WHEN 1 THEN array('view', 'click', 'view') ELSE CAST(array() AS ARRAY<STRING>) END")
    e = episodes(spark, sf_dir).select("episode", want.alias("want"), M.tool_names(F.col("m")).alias("seen"))
    return rounded(e.select("episode", M.action_recall(F.col("want"), F.col("seen")).alias("recall"), M.action_complete(F.col("want"), F.col("seen")).alias("complete")))


_FEATURES = f"""WITH {MESSAGES}, q AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ord DESC) AS back, CASE WHEN tool_name IS NOT NULL THEN row_number() OVER (PARTITION BY episode, tool_name IS NULL ORDER BY ord DESC) END AS tback FROM messages),
a AS (SELECT episode, count(*)::DOUBLE AS n, count(*) FILTER (role = 'assistant')::DOUBLE AS asst, count(tool_name)::DOUBLE AS calls, count(DISTINCT tool_name)::DOUBLE AS uniq, count(*) FILTER (role = 'tool')::DOUBLE AS tools,
  count(*) FILTER (role = 'tool' AND content LIKE 'Error:%')::DOUBLE AS errs, sum(length(content)) AS chars, max(tool_name) FILTER (tback = 1) AS t1, max(tool_name) FILTER (tback = 2) AS t2, bool_or(back = 1 AND role = 'tool' AND content LIKE 'Error:%') AS lasterr FROM q GROUP BY episode)
SELECT episode, round(least(n / 40, 2), 9) AS step_fraction, round(least(asst / 20, 2), 9) AS assistant_turn_fraction, round(least(calls / 20, 2), 9) AS tool_call_fraction, round(errs / greatest(tools, 1), 9) AS tool_error_fraction,
  round(least(uniq / 20, 2), 9) AS unique_tool_fraction, round((calls - uniq) / greatest(calls, 1), 9) AS repeated_tool_fraction, coalesce(calls >= 2 AND t1 = t2, false)::INT::DOUBLE AS repeated_last_tool, 0::DOUBLE AS last_assistant_without_tool,
  lasterr::INT::DOUBLE AS last_input_is_tool_error, round(least(ln(1 + chars) / 12, 1.5), 9) AS context_size FROM a"""


@query(_FEATURES)
def router_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(episodes(spark, sf_dir).select("episode", M.router_features(F.col("m")).alias("f")).select("episode", "f.*"))


@query(f"""WITH {MESSAGES}, q AS (SELECT *, tool_name IS NOT NULL AND row_number() OVER (PARTITION BY episode, tool_name ORDER BY ord) = 1 AS new FROM messages),
s AS (SELECT episode, ord, count(*) OVER w AS n, sum((role = 'assistant')::INT) OVER w AS asst, sum((tool_name IS NOT NULL)::INT) OVER w AS calls, sum(new::INT) OVER w AS uniq, sum((role = 'tool')::INT) OVER w AS tools, sum((role = 'tool' AND content LIKE 'Error:%')::INT) OVER w AS errs, sum(length(content)) OVER w AS chars FROM q WINDOW w AS (PARTITION BY episode ORDER BY ord))
SELECT episode, ord, round(least(n / 40.0::DOUBLE, 2), 9) AS step_fraction, round(least(asst / 20.0::DOUBLE, 2), 9) AS assistant_turn_fraction, round(least(calls / 20.0::DOUBLE, 2), 9) AS tool_call_fraction, round(errs / greatest(tools, 1)::DOUBLE, 9) AS tool_error_fraction,
  round(least(uniq / 20.0::DOUBLE, 2), 9) AS unique_tool_fraction, round((calls - uniq) / greatest(calls, 1)::DOUBLE, 9) AS repeated_tool_fraction, round(least(ln(1 + chars) / 12, 1.5), 9) AS context_size FROM s""")
def turn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.turn_features(messages(spark, sf_dir)))


@query("SELECT user_id AS episode, event_id AS ord, max((value >= 90)::INT) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS escalated FROM events")
def sticky_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("ord"), "value")
    return M.sticky_escalation(e, F.col("value"), 90.0).select("episode", "ord", F.coalesce("escalated", F.lit(False)).alias("escalated"))


_WEIGHTS = {"step_fraction": 0.8, "tool_error_fraction": 2.5, "repeated_tool_fraction": 1.25, "context_size": -0.5}


@query(f"SELECT episode, round(1 / (1 + exp(-greatest(-30, least(30, -1.5 + 0.8 * step_fraction + 2.5 * tool_error_fraction + 1.25 * repeated_tool_fraction - 0.5 * context_size)))), 6) AS prob FROM ({_FEATURES})")
def router_score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = router_features(spark, sf_dir)
    return rounded(f.select("episode", M.linear_score({n: F.col(n) for n in _WEIGHTS}, _WEIGHTS, -1.5).alias("prob")), 6)


@query(f"""WITH {MESSAGES}, e AS (SELECT episode, count(*) AS n FROM messages GROUP BY episode), a AS (SELECT episode, n, p, (episode * 7 + p) % 4 = 0 AS verified FROM e, unnest(range(1, n + 1)) t(p))
SELECT episode, max(p)::INT AS prefix FROM a WHERE verified GROUP BY episode""")
def opd_first_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = messages(spark, sf_dir).groupBy("episode").agg(F.count("*").alias("n"))
    a = e.withColumn("prefix", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("verified", (F.col("episode") * 7 + F.col("prefix")) % 4 == 0)
    return M.first_rescue(a, ["episode"], F.col("prefix").desc()).select("episode", "prefix")


@query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role FROM conversations), u AS (SELECT conv_id, list(i ORDER BY i) AS ps FROM p WHERE role = 'user' GROUP BY conv_id),
x AS (SELECT conv_id, CASE WHEN len(ps) <= 3 THEN ps ELSE list_distinct([ps[round_even(j * (len(ps) - 1) / 2.0, 0)::INT + 1] FOR j IN range(3)]) END AS ps FROM u)
SELECT conv_id, unnest(CASE WHEN conv_id % 3 = 0 THEN [list_max(ps)] ELSE ps END)::INT AS prefix, (conv_id % 3 = 0)::INT AS label FROM x""")
def router_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes label every prefix 0; a rescued failure labels the rescuing prefix 1."""
    p = conversations(spark, sf_dir).select("conv_id", M.decision_points(F.col("m"), 3).alias("ps"))
    good = p.where("conv_id % 3 <> 0").select("conv_id", F.explode("ps").alias("prefix"), F.lit(0).alias("label"))
    bad = p.where("conv_id % 3 = 0").select("conv_id", F.explode(F.slice("ps", 1, 1)).alias("prefix"), F.lit(1).alias("label"))
    return good.unionByName(bad)


_BLOCK = """'ok <tool_call> {"name": "' || event_type || '", "arguments": ' || props || '} </tool_call> end'"""


@query("SELECT event_id, event_type AS name, replace(props, ' ', '') AS arguments FROM events")
def parse_tool_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.skills import parse_tool_call as parse

    e = table(spark, sf_dir, "events").select("event_id", F.expr(_BLOCK).alias("text"))
    return e.withColumn("c", parse(F.col("text"))).select("event_id", "c.name", F.trim("c.arguments").alias("arguments"))


@query(f"WITH {MESSAGES} SELECT domain, count(DISTINCT episode)::BIGINT AS episodes, count(*) FILTER (role = 'tool')::BIGINT AS tool_messages, count(tool_name)::BIGINT AS calls FROM messages GROUP BY domain")
def traffic_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.groupBy("domain").agg(F.count_distinct("episode").alias("episodes"), F.count_if(F.col("role") == "tool").alias("tool_messages"), F.count("tool_name").alias("calls"))
