"""Tool calls of chats: link calls and results, order calls, check arguments, write canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.text import staged

#: Names of JSON types by the variant types that satisfy them.
KINDS = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE"],
    "boolean": ["BOOLEAN"],
    "null": ["VOID"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
}


def canonical(text: Column) -> Column:
    """The same JSON with sorted keys and no white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


#: Longer paths than any conversation has; weights on cycles stop growing here.
FAR = 1 << 40


def levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, position, parents) with level and cyclic; staged.

    The level of a call is the number of calls on the longest way to it from one without parents. Calls on a cycle, or behind
    one, are cyclic and have level 0. Parents that do not exist are ignored here, as are null ids.

    A call's level is the largest of what its parents that are done give it and of its open parents' levels plus the length of the edge.
    In each round an edge to a call that is done turns into a bound, and an edge to a call with one open parent moves on to that
    parent: chains and trees take rounds in the logarithm of their depth. An edge is idle and dropped first if two other edges lead the same
    way, over a call whose position lies between both: such ways only get shorter, so no way is lost, nor any cycle. Every
    round ends at least one call unless all that are left are cyclic; calls that wait for several far ones can take a round a level.
    """
    ids = calls.select("conv_id", "call_id", "position")
    edges = calls.select("conv_id", F.col("call_id").alias("child"), F.explode("parents").alias("parent"))
    placed = ids.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("position").alias("at"))
    of = lambda name, at: placed.select("conv_id", F.col("call_id").alias(name), F.col("at").alias(at))
    edges = edges.join(of("parent", "at"), ["conv_id", "parent"]).join(of("child", "to"), ["conv_id", "child"])
    edges = staged(edges.groupBy("conv_id", "child", "parent", "at", "to").agg(F.lit(1).cast("long").alias("w")), "call-edges")
    many = edges.groupBy("conv_id", "child").count().filter("count > 1").select("conv_id", "child")
    direct = edges.join(many, ["conv_id", "child"], "left_semi").select("conv_id", F.col("child").alias("v"), F.col("parent").alias("b"), F.col("at").alias("b_at"), F.col("to").alias("v_at"))
    second = edges.select("conv_id", F.col("child").alias("b"), F.col("parent").alias("a"), F.col("at").alias("a_at"))
    between = ((F.col("a_at") < F.col("b_at")) & (F.col("b_at") < F.col("v_at"))) | ((F.col("a_at") > F.col("b_at")) & (F.col("b_at") > F.col("v_at")))
    idle = direct.join(second, ["conv_id", "b"]).filter(between).select("conv_id", F.col("v").alias("child"), F.col("a").alias("parent")).distinct()
    now = staged(edges.join(idle, ["conv_id", "child", "parent"], "left_anti").select("conv_id", "child", "parent", "w"), "call-edges")
    nodes = edges.select("conv_id", F.col("child").alias("id")).union(edges.select("conv_id", F.col("parent").alias("id"))).distinct()
    opened = now.select("conv_id", F.col("child").alias("id"), F.lit(False).alias("ended")).distinct()
    nodes = staged(nodes.join(opened, ["conv_id", "id"], "left").select("conv_id", "id", F.lit(0).cast("long").alias("least"), F.coalesce("ended", F.lit(True)).alias("ended")), "call-levels")
    waiting, done = nodes.filter("NOT ended").count(), []
    while waiting:
        single = now.groupBy("conv_id", F.col("child").alias("id")).agg(F.count("*").alias("k"), F.first("parent").alias("next"), F.first("w").alias("step")).filter("k = 1")
        # no edge moves on to a call that has ended: such calls are needed for one round only
        single = single.join(nodes.filter("ended").select("conv_id", F.col("id").alias("next")), ["conv_id", "next"], "left_anti")
        there = nodes.join(single, ["conv_id", "id"], "left").select("conv_id", F.col("id").alias("parent"), "least", "ended", "next", "step")
        moved = now.join(there, ["conv_id", "parent"])
        passes = F.col("ended") | F.col("next").isNotNull()
        bounds = moved.filter(passes).groupBy("conv_id", F.col("child").alias("id")).agg(F.max(F.col("least") + F.col("w")).alias("bound"))
        kept = moved.filter(~F.col("ended")).select("conv_id", "child", F.coalesce("next", "parent").alias("parent"), F.least(F.col("w") + F.coalesce("step", F.lit(0)), F.lit(FAR)).alias("w"))
        now = staged(kept.groupBy("conv_id", "child", "parent").agg(F.max("w").alias("w")), "call-edges")
        opened = now.select("conv_id", F.col("child").alias("id"), F.lit(True).alias("opened")).distinct()
        grown = nodes.filter("NOT ended").join(bounds, ["conv_id", "id"], "left").join(opened, ["conv_id", "id"], "left")
        done.append(nodes.filter("ended"))
        nodes = staged(grown.select("conv_id", "id", F.greatest("least", F.coalesce("bound", "least")).alias("least"), F.col("opened").isNull().alias("ended")), "call-levels")
        left = nodes.filter("NOT ended").count()
        if left == waiting:
            break
        waiting = left
    for part in done:
        nodes = nodes.union(part)
    ranked = nodes.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.when(F.col("ended"), F.col("least")).otherwise(0).cast("int").alias("l"), (~F.col("ended")).alias("y"))
    joined = calls.join(ranked, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    return joined.select(*calls.columns, F.coalesce("l", F.lit(0)).alias("level"), F.coalesce("y", F.lit(False)).alias("cyclic"))


def fits(kind: Column, found: Column) -> Column:
    ok = F.lit(False)
    for name, types in KINDS.items():
        ok = ok | ((kind == name) & found.isin(types))
    return ok


def problems(fields: Column, spec: Column) -> Column:
    """What is wrong with arguments (field -> type) under the fields of a schema, sorted."""
    missing = F.filter(spec, lambda s: s["required"] & ~F.map_contains_key(fields, s["field"]))
    wrong = F.filter(spec, lambda s: F.map_contains_key(fields, s["field"]) & ~fits(s["kind"], F.try_element_at(fields, s["field"])))
    extra = F.array_except(F.map_keys(fields), F.transform(spec, lambda s: s["field"]))
    say = lambda text, a: F.transform(a, lambda x: F.concat(F.lit(text), x))
    names = lambda a: F.transform(a, lambda s: s["field"])
    return F.array_sort(F.concat(say("missing ", names(missing)), say("type of ", names(wrong)), say("unknown ", extra)))


def spelled(arguments: Column, call_id: Column, name: Column, content: Column) -> Column:
    """One call with one of its results as canonical JSON; arguments are JSON, whatever is null is spelled null."""
    text = lambda c: F.coalesce(F.to_json(c.cast("variant")), F.lit("null"))
    return F.concat(
        F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"id":'), text(call_id),
        F.lit(',"name":'), text(name), F.lit(',"result":'), text(content), F.lit("}"),
    )


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row a call, and a row a result that answers no call.

    calls: conv_id, call_id, position, name, arguments (JSON), parents (call_ids of the same conversation).
    results: conv_id, call_id, position, content. schemas: name, field, kind (a key of KINDS), required.
    Output: conv_id, call_id, position, level, status (linked, unanswered or orphan), problems, valid, name, arguments
    (canonical JSON), results (position and content, sorted), json.
    The order of a conversation's calls is (level, position), cyclic ones last; these have a problem that says so. All results of a call are in ``results``, the first of them is
    in json; an orphan holds its own result only. Arguments that are no JSON object, and names without schema, are problems.
    Null ids link to nothing: such calls are unanswered, such results orphans, a row each. Calls that repeat conv_id and
    call_id are rows of their own, each with all results. Keys that repeat in an object make it no JSON.
    """
    result = F.struct("position", "content")
    with_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    answers = results.filter(with_id).groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call")).agg(F.sort_array(F.collect_list(result)).alias("found"))
    nameless = results.filter(~with_id).select("conv_id", "call_id", F.array(result).alias("results"))
    specs = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "kind", "required")).alias("spec")).withColumnRenamed("name", "s_name")
    ordered = levels(calls.select("conv_id", "call_id", "position", "name", "arguments", F.coalesce("parents", F.array().cast("array<string>")).alias("parents")))
    typed = ordered.join(specs, F.col("name") == F.col("s_name"), "left").withColumn("_v", F.try_parse_json("arguments"))
    typed = typed.withColumn("_object", F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False)))
    typed = typed.withColumn("_fields", F.when(F.col("_object"), F.from_json("arguments", "map<string, variant>")))
    kinds = F.transform_values("_fields", lambda k, v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    typed = typed.withColumn("_kinds", kinds)
    found = (
        F.when(~F.col("_object"), F.array(F.lit("no JSON object")))
        .when(F.col("spec").isNull(), F.array(F.lit("no schema")))
        .otherwise(problems(F.col("_kinds"), F.col("spec")))
    )
    checked = typed.select("conv_id", "call_id", "position", "name", "level", "cyclic", F.to_json("_v").alias("args"), F.when(F.col("cyclic"), F.array_append(found, F.lit("cycle"))).otherwise(found).alias("problems"), F.lit(True).alias("is_call"))
    both = checked.join(answers, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full")
    whole = F.array(F.coalesce("found", F.array().cast(answers.schema["found"].dataType)))
    rows = both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"), "position", "level", "name", F.col("args").alias("arguments"), "problems", "is_call",
        F.explode(F.when(F.col("is_call").isNull(), F.transform("found", lambda x: F.array(x))).otherwise(whole)).alias("results"),
    ).unionByName(nameless, allowMissingColumns=True)
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.size("results") == 0, "unanswered").otherwise("linked")
    first = F.get("results", F.lit(0))
    none = F.array().cast("array<string>")
    return rows.select(
        "conv_id", "call_id", F.coalesce(F.col("position"), first["position"]).alias("position"),
        F.coalesce("level", F.lit(0)).alias("level"), status.alias("status"), F.coalesce("problems", none).alias("problems"),
        (F.col("is_call").isNotNull() & (F.size(F.coalesce("problems", none)) == 0)).alias("valid"),
        "name", "arguments", "results", spelled(F.col("arguments"), F.col("call_id"), F.col("name"), first["content"]).alias("json"),
    )
