"""Chat formatting: link tool calls with their results, order them, check and serialise them.

A message whose text is a JSON object with ``tool_calls`` makes calls, one with role
``tool`` brings the result of one.  Calls and results are joined by conversation and call
identifier.  A result goes right after its call; a call goes after the calls named in its
``after`` list.  Every event's place is (place of its message, level, message, number, kind), so the
order needs no sort of a conversation and no conversation has to fit into a task.  Several
messages of one turn are told apart by a digest of their text; equal ones are equal events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import Workspace, full, named

CALLS = (
    "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: string,"
    " after: array<string>>>, tool_call_id: string>"
)
#: Stands for a null turn where turns are compared: before all others.
NO_TURN = -(2**63)


#: A string, a number or what lies between them, in JSON without blanks.
TOKEN = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no blanks; null where it is no JSON.

    Equal numbers have one form, plain digits without needless zeros (``1``, ``1.0`` and ``1e0`` are ``1``); what
    needs more than 38 digits so keeps an exponent.  Only the parser's binary numbers need to be rewritten."""
    plain = F.to_json(F.try_parse_json(json))
    tokens = F.transform(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.rlike("^-?[0-9]"), _digits(t)).otherwise(t))
    return F.when(plain.rlike(r"[0-9]\.0(?![0-9])|[0-9]E"), F.array_join(tokens, "")).otherwise(plain)


def _digits(number: Column) -> Column:
    """The shortest plain form of a number in text."""
    value, size = number.try_cast("double"), F.abs(number.try_cast("double"))
    exact = [
        F.when(among, number.try_cast(f"decimal(38,{scale})"))
        for scale, among in ((37, size < 1), (10, (size >= 1) & (size < 1e17)), (0, size >= 1e17))
    ]
    texts = [F.when(d.cast("double") == value, F.regexp_replace(d.cast("string"), r"(\.[0-9]*?)0+$", "$1")) for d in exact[:2]]
    texts.append(F.when(exact[2].cast("double") == value, exact[2].cast("string")))
    short = F.regexp_replace(F.coalesce(*texts), r"\.$", "")
    binary = number.rlike(r"E|\.0$")
    return F.when(binary, F.when(value == 0, "0").otherwise(F.coalesce(short, number))).otherwise(number)


def events(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, ...]:
    """Plain messages, calls and results."""
    df = messages.select(
        named(conv_col).alias("conv"), named(turn_col).cast("long").alias("turn"),
        F.coalesce(named(role_col).cast("string"), F.lit("")).alias("role"), full(named(text_col)).alias("text"),
    )
    df = df.withColumn("message", F.sha2("text", 256))
    looks = F.col("text").startswith("{") & (
        (F.col("role") == "tool") | F.col("text").contains('"tool_calls"')
    )
    df = df.withColumn("j", F.from_json(F.when(looks, F.col("text")), CALLS))
    calling = F.coalesce(F.size("j.tool_calls") > 0, F.lit(False)) & (F.col("role") != "tool")
    answering = (F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull()
    plain = df.filter(~answering).select(
        "conv", "turn", "message", "role",
        F.when(calling, F.coalesce("j.content", F.lit(""))).otherwise(F.col("text")).alias("content"),
        calling.alias("calls"),
    )
    calls = df.filter(calling).select("conv", "turn", "message", F.posexplode("j.tool_calls").alias("number", "c"))
    calls = calls.select(
        "conv", "turn", "message", F.col("number").cast("long").alias("number"), F.col("c.id").alias("call_id"),
        F.coalesce("c.name", F.lit("")).alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"),
        F.coalesce("c.after", F.array().cast("array<string>")).alias("after"),
    )
    results = df.filter(answering).select(
        "conv", "turn", F.col("j.tool_call_id").alias("call_id"), F.coalesce("j.content", F.lit("")).alias("content")
    )
    return plain, calls, results


def placed(calls: DataFrame, space: Workspace) -> DataFrame:
    """Calls with ``at``: (turn, level) after the place of all calls they wait for.

    A wait for a call that lies, with all that it waits for, in earlier turns changes no place and
    is no part of a cycle; it is let go.  The other calls are settled level by level, each
    level once all that it waits for is settled: as many rounds as the longest chain of waits
    that turns do not order.  What never settles waits for itself, directly or not, or keeps its place
    only after such a call; it keeps its own turn and is marked ``cyclic``.  Unknown identifiers are
    not waited for."""
    node = lambda call: F.to_json(F.struct("conv", F.col(call).alias("call")))
    base = calls.withColumns(
        {"at": F.struct("turn", F.lit(0).cast("long").alias("level")), "cyclic": F.lit(False)}
    )
    firsts = calls.filter("first").withColumn("turn", F.coalesce("turn", F.lit(NO_TURN)))
    known = firsts.select(F.col("conv").alias("c_"), F.col("call_id").alias("i_"), F.col("turn").alias("on_turn"))
    waits = firsts.select("conv", "call_id", "turn", F.explode(F.array_distinct("after")).alias("on"))
    waits = waits.join(known, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("on") == F.col("i_")))
    waits = space.stored(waits.select(node("call_id").alias("node"), "turn", node("on").alias("on"), "on_turn"), "waits")
    waits = _unordered(waits, space)
    if waits.isEmpty():
        return base
    left = waits.groupBy("node").agg(
        F.struct(F.max("turn").alias("turn"), F.lit(0).cast("long").alias("level")).alias("at"), F.count(F.lit(1)).alias("missing")
    )
    left = space.stored(left, "left")
    free = waits.select(F.col("on").alias("node"), "on_turn").distinct().join(left.select("node"), "node", "left_anti")
    fresh = free.select("node", F.struct(F.col("on_turn").alias("turn"), F.lit(0).cast("long").alias("level")).alias("at"))
    settled, level = space.path("settled"), 0
    while True:
        # one folder for all levels: the plan that reads them does not grow
        fresh.write.mode("overwrite").parquet(f"{settled}/round={level}")
        fresh = space.spark.read.parquet(f"{settled}/round={level}")
        if fresh.isEmpty():
            break
        met = waits.join(fresh.select(F.col("node").alias("n_"), F.col("at").alias("a_")), F.col("on") == F.col("n_"))
        after = F.struct(F.col("a_.turn").alias("turn"), (F.col("a_.level") + 1).alias("level"))
        met = met.groupBy(F.col("node").alias("n_")).agg(F.count(F.lit(1)).alias("now"), F.max(after).alias("after"))
        left = left.join(met, F.col("node") == F.col("n_"), "left").select(
            "node", F.greatest("at", "after").alias("at"), (F.col("missing") - F.coalesce("now", F.lit(0))).alias("missing")
        )
        left = space.stored(left, "left")
        fresh, left = left.filter("missing = 0").select("node", "at"), left.filter("missing > 0")
        level += 1
    place = F.struct(F.nullif(F.col("at.turn"), F.lit(NO_TURN)).alias("turn"), F.col("at.level").alias("level"))
    found = space.spark.read.parquet(settled).select(F.col("node").alias("n_"), place.alias("found"), F.lit(False).alias("stuck"))
    stuck = left.select(F.col("node").alias("n_"), F.lit(None).cast(found.schema["found"].dataType).alias("found"), F.lit(True).alias("stuck"))
    base = base.join(found.unionByName(stuck), F.col("first") & (node("call_id") == F.col("n_")), "left")
    return base.withColumns(
        {"at": F.coalesce("found", "at"), "cyclic": F.coalesce("stuck", F.lit(False))}
    ).drop("n_", "found", "stuck")


def _unordered(waits: DataFrame, space: Workspace) -> DataFrame:
    """The waits whose order does not follow from turns.

    ``top`` is the latest turn among a call and all that it waits for, where that is not its own: it
    spreads from waits for later turns, to calls that lie before it only."""
    fresh = waits.filter("on_turn > turn").groupBy("node").agg(F.max("on_turn").alias("top"))
    fresh = top = space.stored(fresh, "tops")
    while not fresh.isEmpty():
        up = fresh.select(F.col("node").alias("n_"), F.col("top").alias("up"))
        high = top.select(F.col("node").alias("h_"), "top")
        more = waits.join(up, F.col("on") == F.col("n_")).join(high, F.col("node") == F.col("h_"), "left")
        more = more.filter(F.col("up") > F.greatest("turn", "top")).groupBy("node").agg(F.max("up").alias("top"))
        fresh = space.stored(more, "tops")
        top = space.stored(top.unionByName(fresh).groupBy("node").agg(F.max("top").alias("top")), "tops")
    high = top.select(F.col("node").alias("h_"), "top")
    kept = waits.join(high, F.col("on") == F.col("h_"), "left").filter(F.greatest("on_turn", "top") >= F.col("turn"))
    return space.stored(kept.select(*waits.columns), "waits")


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv, turn, message, number, problems): what is wrong with the arguments of each call, sorted.

    ``schemas`` has (name, param, type, required, most): types are those of JSON, ``most`` bounds
    a string's code points or a number, null for no bound."""
    key = ["conv", "turn", "message", "number"]
    sch = schemas.select(
        F.col("name").alias("s_name"), "param", F.col("type").alias("want"), "required", F.col("most").cast("double").alias("most")
    )
    parsed = calls.select(*key, "name", F.try_parse_json("arguments").alias("v"), "arguments")
    args = F.from_json(F.when(F.col("v").isNotNull(), F.col("arguments")), "map<string,variant>")
    parsed = parsed.withColumns({"args": args, "kind": F.schema_of_variant("v")})
    tools = sch.select(F.col("s_name").alias("t_")).distinct()
    known = parsed.join(tools, F.col("name") == F.col("t_"), "left")
    whole = (
        F.when(F.col("t_").isNull(), "unknown tool")
        .when(F.col("v").isNull(), "no JSON")
        .when(~F.col("kind").startswith("OBJECT"), "no object")
    )
    bad = known.select(*key, whole.alias("problem")).filter("problem IS NOT NULL")
    fine = known.filter(whole.isNull())
    given = fine.select(*key, "name", F.explode("args").alias("arg", "val"))
    given = given.withColumn("is", F.schema_of_variant("val"))
    given = given.join(sch, (F.col("name") == F.col("s_name")) & (F.col("arg") == F.col("param")), "left")
    is_ = F.col("is")
    kind = (
        F.when(is_ == "STRING", "string").when(is_ == "BIGINT", "integer").when(is_ == "BOOLEAN", "boolean")
        .when(is_.startswith("ARRAY"), "array").when(is_.startswith("OBJECT"), "object").when(is_ == "VOID", "null")
        .otherwise("number")
    )
    size = F.when(kind == "string", F.char_length(F.try_variant_get("val", "$", "string")).cast("double")).when(
        kind.isin("integer", "number"), F.try_variant_get("val", "$", "double")
    )
    wrong = (
        F.when(F.col("param").isNull(), F.concat(F.lit("unknown "), "arg"))
        .when((kind != F.col("want")) & ~((kind == "integer") & (F.col("want") == "number")), F.concat(F.lit("type "), "arg"))
        .when(size > F.col("most"), F.concat(F.lit("over "), "arg"))
    )
    bad = bad.unionByName(given.select(*key, wrong.alias("problem")).filter("problem IS NOT NULL"))
    need = sch.filter("required")
    need = fine.join(need, F.col("name") == F.col("s_name")).filter(~F.array_contains(F.map_keys("args"), F.col("param")))
    bad = bad.unionByName(need.select(*key, F.concat(F.lit("missing "), "param").alias("problem")))
    return bad.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("problem")), "; ").alias("problems"))


def format_chat(
    messages: DataFrame,
    schemas: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per event: conv, at_turn, level, message, number, step, kind, call_id, linked, problems, json.

    Sorting a conversation by (at_turn, level, message, number, step) gives its order: step 0 is a message, 1 a
    call, 2 its result; ``message`` is a digest of the message's text and orders those of one turn.  Of several calls
    with one identifier the first by (turn, message, number) is linked, of several results the earliest; the others, and results without a call, are kept at their own turn with
    ``linked`` false and a problem.  Null texts are empty, null roles "", null conversations one
    conversation, null turns sort first.  Texts that only look like JSON stay plain text.  Rows that
    repeat give repeated events.  Empty tables give no rows."""
    space = Workspace(messages.sparkSession)
    plain, calls, results = events(messages, conv_col, turn_col, role_col, text_col)
    first = calls.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "message", "number")).alias("f_"))
    first = first.withColumnsRenamed({"conv": "c_", "call_id": "i_"})
    calls = calls.join(first, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("call_id") == F.col("i_")), "left")
    is_first = F.coalesce(
        F.col("f_.turn").eqNullSafe(F.col("turn")) & (F.col("f_.message") == F.col("message")) & (F.col("f_.number") == F.col("number")),
        F.lit(False),
    )
    calls = space.stored(calls.withColumn("first", is_first).drop("c_", "i_", "f_"), "calls")
    calls = placed(calls, space)
    found = results.groupBy(F.col("conv").alias("c_"), F.col("call_id").alias("i_")).agg(
        F.min(F.struct("turn", "content")).alias("r_")
    )
    same = F.col("conv").eqNullSafe(F.col("c_")) & (F.col("call_id") == F.col("i_"))
    calls = calls.join(found, same & F.col("first"), "left").drop("c_", "i_")
    bad = problems(calls, schemas).withColumnsRenamed({"conv": "c_", "turn": "t_", "message": "m_", "number": "n_"})
    same = F.col("conv").eqNullSafe(F.col("c_")) & F.col("turn").eqNullSafe(F.col("t_"))
    calls = calls.join(bad, same & (F.col("message") == F.col("m_")) & (F.col("number") == F.col("n_")), "left")
    calls = space.stored(calls.drop("c_", "t_", "m_", "n_"), "linked")
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    said = plain.select(
        "conv", F.col("turn").alias("at_turn"), zero.alias("level"), "message", zero.alias("number"), F.lit(0).alias("step"),
        F.lit("message").alias("kind"), none.alias("call_id"), F.lit(True).alias("linked"), F.lit("").alias("problems"),
        F.to_json(F.struct("content", "role")).alias("json"),
    )
    note = F.concat_ws(
        "; ", F.when(~F.col("first"), "repeated call"), F.when(F.col("cyclic"), "cyclic"),
        F.when(F.col("first") & F.col("r_").isNull(), "no result"), "problems",
    )
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    text = lambda c: F.get_json_object(F.to_json(F.struct(c.alias("x"))), "$")
    quoted = lambda c: F.substring(text(c), F.lit(6), F.length(text(c)) - 6)
    asked = calls.select(
        "conv", F.col("at.turn").alias("at_turn"), F.col("at.level").alias("level"), "message", "number", F.lit(1).alias("step"),
        F.lit("call").alias("kind"), "call_id", F.col("r_").isNotNull().alias("linked"), note.alias("problems"),
        F.concat(
            F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted(F.coalesce("call_id", F.lit(""))),
            F.lit(',"name":'), quoted(F.col("name")), F.lit("}"),
        ).alias("json"),
    )
    answer = F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")))
    told = calls.filter(F.col("r_").isNotNull()).select(
        "conv", F.col("at.turn").alias("at_turn"), F.col("at.level").alias("level"), "message", "number", F.lit(2).alias("step"),
        F.lit("result").alias("kind"), "call_id", F.lit(True).alias("linked"), F.lit("").alias("problems"),
        F.col("r_.content").alias("content"),
    ).withColumn("json", answer).drop("content")
    # equal rows are counted, and as many copies as were linked are no longer lost
    taken = calls.filter(F.col("r_").isNotNull()).groupBy(
        F.col("conv").alias("c_"), F.col("call_id").alias("i_"), F.col("r_.turn").alias("t_"), F.col("r_.content").alias("x_")
    ).agg(F.count(F.lit(1)).alias("linked_"))
    lost = results.groupBy("conv", "turn", "call_id", "content").agg(F.count(F.lit(1)).alias("copies_")).join(
        taken,
        F.col("conv").eqNullSafe(F.col("c_")) & (F.col("call_id") == F.col("i_")) & F.col("turn").eqNullSafe(F.col("t_"))
        & (F.col("content") == F.col("x_")),
        "left",
    ).withColumn("over_", F.col("copies_") - F.coalesce("linked_", F.lit(0)))
    lost = lost.filter("over_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "over_")))
    lost = lost.select(
        "conv", F.col("turn").alias("at_turn"), zero.alias("level"), F.sha2("content", 256).alias("message"), zero.alias("number"), F.lit(2).alias("step"),
        F.lit("result").alias("kind"), "call_id", F.lit(False).alias("linked"), F.lit("no call for it").alias("problems"),
        "content",
    ).withColumn("json", answer).drop("content")
    every = said.unionByName(asked).unionByName(told).unionByName(lost)
    return every.withColumnRenamed("conv", conv_col)
