"""Tool-call linking on DataFrame functions only: calls meet results by identifier, get an order, are validated and serialised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractionlens.llm.shared import numbered, written

#: (tool, path of a parameter, type, required). Types: string, integer, number, boolean, null, array, object. A dot leads into an
#: object, [] to the items of an array; an object whose members are listed has no others.
SCHEMAS = (
    ("answer", "query", "string", True),
    ("answer", "turn", "integer", True),
    ("answer", "limit", "integer", False),
    ("answer", "style", "string", False),
    ("answer", "context", "object", False),
    ("answer", "context.turns", "array", False),
    ("answer", "context.turns[]", "integer", False),
)
_TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "null": "^VOID$", "array": "^ARRAY", "object": "^OBJECT"}
_FIRST = -(1 << 62)  # where a null turn stands: before all others


def _get(value: Column, name: str) -> Column:
    """A member of a variant, null without one."""
    return F.try_variant_get(value, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def _string(value: Column) -> Column:
    """A variant's string; null for other types, so that no number passes as a name."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _fits(value: Column, path: str, schema: dict[str, tuple[str, bool]]) -> Column:
    """Whether `value`, at `path` ('' is the arguments), is of its type and so is all that the schema says below it."""
    kind, _ = schema.get(path, ("object", True))
    ok = F.schema_of_variant(value).rlike(_TYPES[kind])
    inside = [p for p in schema if p.rpartition(".")[0] == path and not p.endswith("[]") and p] if path else [p for p in schema if "." not in p and not p.endswith("[]")]
    if inside:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        names = [p.rpartition(".")[2] for p in inside]
        ok = ok & (F.size(F.array_except(F.map_keys(members), F.array(*[F.lit(n) for n in names]))) == 0)
        for p, name in zip(inside, names):
            member = _get(value, name)
            ok = ok & F.when(member.isNull(), F.lit(not schema[p][1])).otherwise(_fits(member, p, schema))
    if f"{path}[]" in schema:
        ok = ok & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda item: _fits(item, f"{path}[]", schema))
    return F.coalesce(ok, F.lit(False))


def _valid(schemas: tuple[tuple[str, str, str, bool], ...], name: Column, arguments: Column) -> Column:
    """Known tool, all required parameters there, no unknown ones, every value of its JSON type."""
    ok = F.lit(False)
    for tool in sorted({s[0] for s in schemas}):
        own = {path: (kind, required) for t, path, kind, required in schemas if t == tool}
        ok = F.when(name == tool, _fits(arguments, "", own)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def _doubled(start: DataFrame) -> DataFrame:
    """(conv_id, id, at, depth) where every node has one parent at most (`next`). Each round doubles the part of a chain that a
    node knows, so a chain of n calls takes log2(n) rounds. A node whose chain is longer than its conversation has nodes lies
    on a cycle or behind one and is left out."""
    state = written(start.select("conv_id", "id", "own", "next", F.col("own").alias("at"), F.lit(0).alias("depth"), F.lit(1).alias("steps")), "order")
    longest = state.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    known = 1
    while known <= longest and state.where("next IS NOT NULL").limit(1).count():
        far = state.select("conv_id", F.col("id").alias("next"), F.col("next").alias("n_next"), F.col("at").alias("n_at"), F.col("depth").alias("n_depth"), F.col("steps").alias("n_steps"))
        both = state.join(far, ["conv_id", "next"], "left")
        later = F.coalesce(F.col("n_at") >= F.col("at"), F.lit(False))
        at = F.when(later, F.col("n_at")).otherwise(F.col("at"))
        depth = F.when(later, F.col("steps") + F.col("n_depth")).otherwise(F.col("depth"))
        state = written(both.select("conv_id", "id", "own", F.col("n_next").alias("next"), at.alias("at"), depth.alias("depth"), (F.col("steps") + F.coalesce("n_steps", F.lit(0))).alias("steps")), "order")
        known *= 2
    return state.where("next IS NULL").select("conv_id", "id", "at", "depth")


def _settled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, id, at, depth) where nodes may have several parents: a round settles the nodes whose parents are all settled.
    Rounds are as many as the longest chain of conversations that hold such nodes. Nodes on a cycle or behind one are left out."""
    ready = written(nodes.join(edges, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("own").alias("at"), F.lit(0).alias("depth")), "settled")
    done, waiting = [ready], edges.select("conv_id", "id", "own", "parent", F.lit(None).cast("long").alias("p_at"), F.lit(None).cast("int").alias("p_depth"))
    while True:
        found = ready.select("conv_id", F.col("id").alias("parent"), F.col("at").alias("f_at"), F.col("depth").alias("f_depth"))
        waiting = written(waiting.join(found, ["conv_id", "parent"], "left").select("conv_id", "id", "own", "parent", F.coalesce("p_at", "f_at").alias("p_at"), F.coalesce("p_depth", "f_depth").alias("p_depth")), "waiting")
        last = F.max(F.struct("p_at", "p_depth"))
        full = waiting.groupBy("conv_id", "id", "own").agg(last.alias("last"), F.count_if(F.col("p_at").isNull()).alias("open")).where("open = 0")
        later = F.col("last.p_at") >= F.col("own")
        ready = written(full.select("conv_id", "id", F.greatest("own", "last.p_at").alias("at"), F.when(later, F.col("last.p_depth") + 1).otherwise(0).alias("depth")), "settled")
        if not ready.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        done.append(ready)
        waiting = waiting.join(ready.select("conv_id", "id"), ["conv_id", "id"], "left_anti")


def _ordered(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, id, parents, turn) with `_at`, `_depth`: a node never comes before what it depends on.

    A node goes to the latest turn among itself and all it depends on, however far, as deep as the longest way to there. Only
    conversations in which some parent does not come earlier need work; nodes on a cycle or behind one keep their own turn."""
    node = nodes.select("conv_id", "id", F.coalesce("turn", F.lit(_FIRST)).alias("own"), "parents")
    parent = node.select("conv_id", F.col("id").alias("parent"), F.col("own").alias("p_own"))
    edges = node.select("conv_id", "id", "own", F.explode(F.array_distinct("parents")).alias("parent")).join(parent, ["conv_id", "parent"])
    edges = written(edges.select("conv_id", "id", "own", "parent", "p_own"), "edges")
    per = edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.max(F.col("p_own") >= F.col("own")).alias("late"))
    kinds = per.groupBy("conv_id").agg(F.max("n").alias("most"), F.max("late").alias("late")).where("late").drop("late")
    node, kinds = node.drop("parents"), written(kinds, "broken")
    chains, webs = kinds.where("most = 1").select("conv_id"), kinds.where("most > 1").select("conv_id")
    single = edges.join(chains, "conv_id", "left_semi").select("conv_id", "id", F.col("parent").alias("next"))
    moved = _doubled(node.join(chains, "conv_id", "left_semi").join(single, ["conv_id", "id"], "left"))
    if webs.limit(1).count():
        moved = moved.unionByName(_settled(node.join(webs, "conv_id", "left_semi"), edges.join(webs, "conv_id", "left_semi")))
    out = node.join(moved, ["conv_id", "id"], "left")
    return out.select("conv_id", "id", F.coalesce("at", "own").alias("_at"), F.coalesce("depth", F.lit(0)).alias("_depth"))


def link_tool_calls(messages: DataFrame, schemas: tuple[tuple[str, str, str, bool], ...] = SCHEMAS) -> DataFrame:
    """One row per message, call and result: conv_id, seq, turn, kind, call_id, status, json.

    A text that is a JSON object with a non-empty array tool_calls makes calls, one with a string tool_call_id a result, any
    other (null: empty; JSON with a key twice) a message. A call has id, name, arguments (an object, or a string that holds one) and
    depends_on (an id or a list of ids). Status: ok, invalid (arguments against the schema, by their JSON types), unanswered (no
    result), duplicate (a later call or result of the same id), orphan (a result without a call), message. A call without an
    id, or whose id is no string, gets no result: it is unanswered, or invalid.

    Calls and results meet by a hash join on (conv_id, id). Rows without a conv_id meet nothing and have no seq: their calls are
    unanswered or invalid, their results orphans. A null turn comes before all others. Order: by turn, but no call before any call
    it depends on and no result before its call; ties by kind, position and id. json keeps the values' types and has sorted keys
    at every depth, no spaces and no null members besides those in arguments; numbers beyond 38 digits become doubles. Repeated
    rows are calls and results of one id, so all but the first are duplicates; equal ones share the first's status. An empty
    table gives no rows. Other columns are not read, so they may have any name; a very long text is one row's JSON.

    seq comes from counts over ranges of the order, so one huge conversation is numbered by many tasks."""
    text = F.coalesce("text", F.lit(""))
    parsed = messages.select("conv_id", "turn", "role", text.alias("text"), F.when(F.startswith(F.ltrim(text), F.lit("{")), F.try_parse_json(text)).alias("_v"))
    given = F.try_variant_get("_v", "$.tool_calls", "array<variant>")

    def call(v: Column) -> Column:
        said, parents = _get(v, "arguments"), _get(v, "depends_on")
        arguments = F.when(F.schema_of_variant(said) == "STRING", F.try_parse_json(_string(said))).otherwise(said)
        listed = F.filter(F.transform(F.try_variant_get(parents, "$", "array<variant>"), _string), lambda x: x.isNotNull())
        listed = F.when(F.schema_of_variant(parents) == "STRING", F.array(_string(parents))).otherwise(F.coalesce(listed, F.array().cast("array<string>")))
        name = _string(_get(v, "name"))
        return F.struct(_string(_get(v, "id")).alias("id"), name.alias("name"), _valid(schemas, name, arguments).alias("valid"), F.to_json(arguments).alias("arguments"), listed.alias("parents"))

    content = _get(F.col("_v"), "content")
    parsed = parsed.select("conv_id", "turn", "role", "text", F.transform(given, call).alias("calls"), _string(_get(F.col("_v"), "tool_call_id")).alias("answers"), F.coalesce(_string(content), F.to_json(content)).alias("content"))
    parsed = written(parsed, "parsed")
    has_calls = F.coalesce(F.size("calls") > 0, F.lit(False))
    calls = parsed.where(has_calls).select("conv_id", "turn", F.posexplode("calls").alias("pos", "_c")).select("conv_id", "turn", "pos", "_c.*")
    results = parsed.where(~has_calls & F.col("answers").isNotNull()).select("conv_id", "turn", F.col("answers").alias("id"), F.coalesce("content", F.lit("")).alias("content"))
    plain = parsed.where(~has_calls & F.col("answers").isNull())

    at = lambda turn: F.coalesce(turn, F.lit(_FIRST))
    named = calls.where("id IS NOT NULL AND conv_id IS NOT NULL")
    first_call = named.groupBy("conv_id", "id").agg(F.min(F.struct(at(F.col("turn")).alias("at"), "pos")).alias("_f"))
    first_result = results.where("conv_id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(at(F.col("turn"))).alias("_answer"))
    linked = first_call.join(first_result, ["conv_id", "id"], "left")
    own = (at(F.col("turn")) == F.col("_f.at")) & (F.col("pos") == F.col("_f.pos"))
    firsts = named.join(first_call, ["conv_id", "id"]).where(own).groupBy("conv_id", "id", "turn").agg(F.min("parents").alias("parents"))
    order = _ordered(firsts)

    c = calls.join(linked, ["conv_id", "id"], "left").join(order, ["conv_id", "id"], "left")
    ours = F.coalesce(own, F.lit(False))
    status = F.when(F.col("_f").isNotNull() & ~ours, "duplicate").when(~F.col("valid"), "invalid").when(F.col("_answer").isNull(), "unanswered").otherwise("ok")
    parents = F.when(F.size("parents") > 0, F.array_sort(F.array_distinct("parents")))
    # the arguments are JSON already: they go in front of the other members, whose names sort after theirs
    rest = F.to_json(F.struct(parents.alias("depends_on"), F.col("id").alias("id"), F.col("name").alias("name"), F.lit("call").alias("type")))
    call_json = F.coalesce(F.concat(F.lit('{"arguments":'), "arguments", F.lit(","), F.expr("substring(_rest, 2)")), "_rest")
    c = c.withColumn("_rest", rest).select("conv_id", "turn", F.lit("call").alias("kind"), F.col("id").alias("call_id"), status.alias("status"), call_json.alias("json"), F.when(ours, F.col("_at")).otherwise(at(F.col("turn"))).alias("_at"), F.when(ours, F.col("_depth")).otherwise(0).alias("_depth"), F.lit(1).alias("_k"), "pos")
    r = results.join(linked, ["conv_id", "id"], "left").join(order, ["conv_id", "id"], "left")
    status = F.when(F.col("_f").isNull(), "orphan").when(at(F.col("turn")) != F.col("_answer"), "duplicate").otherwise("ok")
    result_json = F.to_json(F.struct(F.col("content").alias("content"), F.col("id").alias("id"), F.lit("result").alias("type")))
    moved = F.col("_at") >= at(F.col("turn"))
    r = r.select("conv_id", "turn", F.lit("result").alias("kind"), F.col("id").alias("call_id"), status.alias("status"), result_json.alias("json"), F.greatest(at(F.col("turn")), "_at").alias("_at"), F.when(moved, F.col("_depth")).otherwise(0).alias("_depth"), F.lit(2).alias("_k"), F.lit(0).alias("pos"))
    m = plain.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"), F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"), F.lit("message").alias("type"))).alias("json"), at(F.col("turn")).alias("_at"), F.lit(0).alias("_depth"), F.lit(0).alias("_k"), F.lit(0).alias("pos"))

    rows = c.unionByName(r).unionByName(m)
    placed = numbered(rows.where("conv_id IS NOT NULL"), ["_at", "_depth", "_k", "turn", "pos", "call_id", "json"], "conv_id")
    shown = lambda df, seq: df.select("conv_id", seq.cast("long").alias("seq"), "turn", "kind", "call_id", "status", "json")
    return shown(placed, F.col("pos")).unionByName(shown(rows.where("conv_id IS NULL"), F.lit(None)))


def as_tool_log(conversations: DataFrame) -> DataFrame:
    """The conversations as a tool log that has what real ones have; all of it follows from the text's length n.

    A user turn calls `answer` with its text (none: the required query is missing), its turn, and as limit n, or the text's
    first word if n mod 5 = 1, which is no integer. With n mod 3 = 0 it lists earlier turns in an object, with n mod 11 = 0 its
    arguments are a string that holds the object. It depends on the call before it, on the one after it (n mod 4 = 2; so calls
    have to move, and two that name each other are a cycle), on the two before it (n mod 4 = 3) or on none (n mod 4 = 0). With
    n mod 7 = 0 it repeats the id of the call before. The assistant turn after it is its result; other turns stay messages."""
    turn, n = F.col("turn"), F.coalesce(F.length("text"), F.lit(0))
    name = lambda at: F.concat(F.lit("c"), at.cast("string"))
    context = F.when(n % 3 == 0, F.struct(F.array(turn - 2, turn - 1).alias("turns")))
    fields = lambda limit: F.to_json(F.struct(context.alias("context"), limit.alias("limit"), F.col("text").alias("query"), turn.alias("turn")))
    arguments = F.when(n % 5 == 1, fields(F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0))).otherwise(fields(n))
    # a string in JSON: the member of a serialised struct, without the braces and the name
    quoted = lambda x: F.expr("substring({0}, 6, length({0}) - 6)".format(x))
    parents = F.when(n % 4 == 2, F.array(name(turn + 2))).when((n % 4 == 3) & (turn >= 2), F.array(name(turn - 2), name(turn - 4))).when((n % 4 == 1) & (turn >= 2), F.array(name(turn - 2)))
    depends = F.when(F.size(parents) == 1, F.concat(F.lit('"'), parents[0], F.lit('"'))).otherwise(F.to_json(parents))
    ident = F.when((n % 7 == 0) & (turn >= 2), name(turn - 2)).otherwise(name(turn))
    log = conversations.select("conv_id", "turn", "role", "text", arguments.alias("_a"), depends.alias("_d"), ident.alias("_i"), n.alias("_n"))
    log = log.withColumn("_q", F.to_json(F.struct(F.col("_a").alias("q"))))
    given = F.when(F.col("_n") % 11 == 0, quoted("_q")).otherwise(F.col("_a"))
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), "_i", F.lit('","name":"answer","arguments":'), given, F.coalesce(F.concat(F.lit(',"depends_on":'), "_d"), F.lit("")), F.lit("}]}"))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    text = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text"))
    return log.select("conv_id", "turn", "role", text.alias("text"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    return link_tool_calls(as_tool_log(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op8_chat_format": op8_chat_format}
ORACLES: dict[str, str] = {}
