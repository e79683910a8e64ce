"""Operators over arrays of messages: cleaning, masks, prefixes, features.

A message is a struct of role, content, tool_calls (array of struct of name,
function.name, arguments as JSON text), error, requestor, _trainable; operators
use what they need, and everything is built from higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])), T.StructField("arguments", T.StringType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("tool_calls", T.ArrayType(CALL)), T.StructField("error", T.BooleanType()), T.StructField("requestor", T.StringType()), T.StructField("_trainable", T.BooleanType())])
CLEAN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("_trainable", T.BooleanType())])

# Features of the router, in order.
FEATURES = (
    "step_fraction", "assistant_turn_fraction", "tool_call_fraction", "tool_error_fraction", "unique_tool_fraction",
    "repeated_tool_fraction", "repeated_last_tool", "last_assistant_without_tool", "last_input_is_tool_error", "context_size",
)
STOP = "###STOP###"

# The text around the tool schemas of a system message.
TOOLS_BEFORE = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_AFTER = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
    '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)


def call_name(call: Column) -> Column:
    return F.coalesce(F.nullif(call["name"], F.lit("")), call["function"]["name"])


def tool_names(messages: Column) -> Column:
    """Names of all calls in order, repetition kept."""
    names = F.flatten(F.transform(messages, lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast(T.ArrayType(CALL))), call_name)))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def action_recall(expected: Column, observed: Column) -> Column:
    """Share of the distinct expected names that were observed; 1 if none is expected."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, observed)) / F.size(want).cast("double"))


def action_complete(expected: Column, observed: Column, declared: Column | None = None, flag: Column | None = None) -> Column:
    """All expected names observed; where nothing was declared, what the row's own flag says (no flag: no)."""
    done = F.coalesce(action_recall(expected, observed), F.lit(1.0)) >= 1.0
    if declared is None:
        return done
    return F.when(declared, done).otherwise(F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)))


def first_user(messages: Column) -> Column:
    """First non-empty user content; an error if there is none."""
    found = F.filter(messages, lambda m: (m["role"] == "user") & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.coalesce(F.try_element_at(found, F.lit(1))["content"], F.raise_error(F.lit("no user message")).cast("string"))


def drop_pre_user(messages: Column) -> Column:
    """Without assistant messages that come before the first user message."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "user")
    start = F.when(at > 0, at - 1).otherwise(F.size(messages)).cast("int")
    # cut in two, as a start inside the filter's step would be looked for anew at each message
    before = F.filter(F.slice(messages, F.lit(1), start), lambda m: m["role"] != "assistant")
    return F.concat(before, F.slice(messages, start + 1, F.size(messages)))


def merge_tool_runs(messages: Column, element: T.StructType = CLEAN) -> Column:
    """Runs of tool messages as one, contents joined by line ends."""
    def step(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(*[(F.concat_ws("\n", last["content"], m["content"]) if f.name == "content" else last[f.name]).alias(f.name) for f in element.fields])
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
        return F.when((m["role"] == "tool") & (last["role"] == "tool"), grown).otherwise(F.concat(acc, F.array(F.struct(*[m[f.name].alias(f.name) for f in element.fields]))))

    return F.aggregate(messages, F.array().cast(T.ArrayType(element)), step)


def _quote(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def render_call(call: Column) -> Column:
    """A call as a tagged JSON block; string arguments that are JSON stay JSON."""
    raw = F.coalesce(call["arguments"], call["function"]["arguments"])
    given = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("{}")).when(F.try_parse_json(raw).isNotNull(), raw).otherwise(_quote(raw))
    return F.concat(F.lit('<tool_call>\n{"name":'), _quote(call_name(call)), F.lit(',"arguments":'), given, F.lit("}\n</tool_call>"))


def clean(messages: Column) -> Column:
    """role, content (calls rendered in its place) and the training mark."""
    def one(m: Column) -> Column:
        calls = F.array_join(F.transform(m["tool_calls"], render_call), "\n")
        content = F.when(F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0, calls).otherwise(F.coalesce(m["content"], F.lit("")))
        return F.struct(m["role"].alias("role"), content.alias("content"), m["_trainable"].alias("_trainable"))

    return F.transform(messages, one)


def tools_block(tools: Column) -> Column:
    """Tool schemas (JSON texts) as a text block; empty without tools."""
    lines = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")
    return F.when(F.coalesce(F.size(tools), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit(TOOLS_BEFORE), lines, F.lit(TOOLS_AFTER)))


def opd_mask(messages: Column, branch: Column, used: Column) -> Column:
    """Marks assistant messages from the branch on as trainable, where a correction was used."""
    def one(m: Column, i: Column) -> Column:
        mark = F.when(used & (m["role"] == "assistant"), i >= branch).otherwise(m["_trainable"])
        return F.struct(*[(mark if f == "_trainable" else m[f]).alias(f) for f in MESSAGE.names])

    return F.transform(messages, one)


def has_target(messages: Column) -> Column:
    """An assistant message that says something and may be trained on (no mark: it may)."""
    return F.exists(messages, lambda m: (m["role"] == "assistant") & (F.trim(F.coalesce(m["content"], F.lit(""))) != "") & F.coalesce(m["_trainable"], F.lit(True)))


def decision_points(messages: Column, k: int = 3) -> Column:
    """Prefix lengths at which an agent decides, k of them evenly spaced, latest first."""
    asks = lambda m: ((m["role"] == "user") & ~F.contains(F.coalesce(m["content"], F.lit("")), F.lit(STOP))) | ((m["role"] == "tool") & F.coalesce(m["requestor"], F.lit("assistant")).isin("assistant"))
    points = F.array_compact(F.transform(messages, lambda m, i: F.when(asks(m), i + 1)))
    n = F.size(points)
    if k <= 1:
        return F.slice(points, F.greatest(n, F.lit(1)), F.lit(1))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * (n - 1) / F.lit(float(k - 1))).cast("int"))
    spaced = F.transform(F.sort_array(F.array_distinct(at), False), lambda i: F.get(points, i))
    return F.when(n <= k, F.reverse(points)).otherwise(spaced)


def router_features(messages: Column, max_steps: int = 40) -> Column:
    """Ten online features of a conversation so far, as a struct of doubles."""
    role = lambda r: F.filter(messages, lambda m: m["role"] == r)
    failed = lambda m: (m["role"] == "tool") & (F.coalesce(m["error"], F.lit(False)) | F.coalesce(m["content"].startswith("Error:"), F.lit(False)))
    size = lambda c: F.size(c).cast("double")
    names, assistants, tools = tool_names(messages), role("assistant"), role("tool")
    last = F.try_element_at(messages, F.lit(-1))
    last_call = F.try_element_at(assistants, F.lit(-1))
    half = max(max_steps / 2, 1.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    chars = F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit(""))))
    values = (
        F.least(size(messages) / max(max_steps, 1), F.lit(2.0)), F.least(size(assistants) / half, F.lit(2.0)), F.least(size(names) / half, F.lit(2.0)),
        size(F.filter(tools, failed)) / F.greatest(size(tools), F.lit(1.0)), F.least(size(F.array_distinct(names)) / half, F.lit(2.0)),
        (size(names) - size(F.array_distinct(names))) / F.greatest(size(names), F.lit(1.0)),
        flag((F.size(names) >= 2) & (F.try_element_at(names, F.lit(-1)) == F.try_element_at(names, F.lit(-2)))),
        flag(last_call.isNotNull() & (F.coalesce(F.size(last_call["tool_calls"]), F.lit(0)) <= 0)), flag(failed(last)),
        F.least(F.log1p(chars.cast("double")) / 12.0, F.lit(1.5)),
    )
    return F.struct(*[v.alias(n) for v, n in zip(values, FEATURES)])


def turn_features(rows: DataFrame, episode: str = "episode", order: str = "ord", max_steps: int = 40) -> DataFrame:
    """The counting features before every turn, as running windows instead of one prefix a turn.

    rows: one message each, with role, tool_name, content.
    """
    w = Window.partitionBy(episode).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    half = max(max_steps / 2, 1.0)
    total = lambda c: F.sum(c.cast("double")).over(w)
    calls, tools = total(F.col("tool_name").isNotNull()), total(F.col("role") == "tool")
    # a name counts at its first use, so that the running number of distinct names is a sum
    first = F.row_number().over(Window.partitionBy(episode, "tool_name").orderBy(order)) == 1
    rows = rows.withColumn("_new", F.col("tool_name").isNotNull() & first)
    unique = total(F.col("_new"))
    errors = total((F.col("role") == "tool") & F.col("content").startswith("Error:"))
    cap = lambda c: F.least(c, F.lit(2.0))
    return rows.select(
        episode, order,
        cap(F.count("*").over(w) / F.lit(float(max(max_steps, 1)))).alias("step_fraction"), cap(total(F.col("role") == "assistant") / half).alias("assistant_turn_fraction"),
        cap(calls / half).alias("tool_call_fraction"), (errors / F.greatest(tools, F.lit(1.0))).alias("tool_error_fraction"), cap(unique / half).alias("unique_tool_fraction"),
        ((calls - unique) / F.greatest(calls, F.lit(1.0))).alias("repeated_tool_fraction"),
        F.least(F.log1p(F.sum(F.length(F.coalesce("content", F.lit("")))).over(w).cast("double")) / 12.0, F.lit(1.5)).alias("context_size"),
    )


def sticky_escalation(rows: DataFrame, prob: Column, threshold: float, episode: str = "episode", order: str = "ord") -> DataFrame:
    """Once a turn's probability reaches the threshold, all later turns of the episode are the teacher's."""
    w = Window.partitionBy(episode).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("escalated", F.max((prob >= threshold).cast("int")).over(w) == 1)


def linear_score(features: dict[str, Column], weights: dict[str, float], bias: float) -> Column:
    """Logistic score of a weighted sum, clamped to +-30 before the exponential."""
    score = F.lit(bias)
    for name, weight in weights.items():
        score = score + F.lit(weight) * features[name]
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))


def first_rescue(attempts: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Per key the first verified attempt in order, others dropped."""
    w = Window.partitionBy(*key).orderBy(order)
    return attempts.where("verified").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
