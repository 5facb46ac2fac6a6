"""Chat messages as linked tool calls: join, order, validate, serialise.

Calls and results meet by a hash join on the call's identifier.  Calls that need
results of other calls are ordered topologically: level 0 needs none, and every
further level needs only lower ones; calls on a cycle, or behind one, have level
-1.  Arguments are validated against the schema of the call's name, and every
exchange is written as canonical JSON (keys sorted, no white space, shortest
numbers), so equal exchanges are equal strings.

Rows equal in all columns count once, with their number in `copies`.  Of
different calls, or results, with one identifier the least by turn and content
is the exchange's and the others get status "conflict".  A call without a result
is "open", a result without a call "orphan", and a row without identifier
"unnamed"; each has a row of its own and nothing is dropped.  Needs that name no
call are listed as errors, unless the arguments can't be read, and do not hold
the call back.  An empty table gives
no rows.  Null content is JSON null.  Arguments that are nested too deep for Python, or
hold a whole number of over 4,000 digits, are an error and kept as text; half of a
surrogate pair alone is written as its escape.  Further columns are passed over.
"""

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drayage.llm.common import map_batches, stage

#: Digits of the longest whole number that is read; reading takes time in their square.
LONGEST_NUMBER = 4000
TOO_DEEP = "$: nested too deep"
_ALONE = re.compile("[\ud800-\udfff]")

# -- canonical JSON -----------------------------------------------------


def _number(x: float) -> str:
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        return digits
    power = int(exponent)
    if -7 < power < 0:
        return f"{x:.{-power + len(digits.replace('-', '').replace('.', '')) - 1}f}"
    return f"{digits}e{'+' if power > 0 else ''}{power}"


def canonical(value) -> str:
    """JSON with sorted keys, without white space and with the shortest numbers; not-a-number becomes null."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value) if math.isfinite(value) else "null"
    return json.dumps(value, ensure_ascii=False)


# -- schemas ------------------------------------------------------------

_KINDS = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return (isinstance(value, int) and not isinstance(value, bool)) or (isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value under a JSON schema (type, enum, bounds, required, properties, items)."""
    found = []
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return [f"{at}: not {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the allowed values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            found.append(f"{at}: too long")
    if _is(value, "number"):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{at}: out of range")
    if isinstance(value, list):
        for i, item in enumerate(value):
            found += errors(item, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    return found


class _LongNumber(Exception):
    pass


def _whole(digits: str) -> int:
    if len(digits) > LONGEST_NUMBER:
        raise _LongNumber
    return int(digits)


def _parsed(text):
    if text is None:
        return None, None
    try:
        return json.loads(text, parse_int=_whole), None
    except _LongNumber:
        return text, "$: number too long"
    except RecursionError:
        return text, TOO_DEEP
    except ValueError:
        return text, "$: not JSON"


def _writable(text: str) -> str:
    """The text with each half of a surrogate pair that stands alone as the JSON escape it came from."""
    return _ALONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def checked(arguments: str | None, schema: dict | None, exchange: dict) -> tuple[list[str], bool, str]:
    """What is wrong with the arguments, whether they could be read, and the exchange with them as JSON.

    Arguments that can't be read, or are nested deeper than Python follows, are kept as they are, as text.
    """
    value, broken = _parsed(arguments)
    try:
        found = [broken] if broken else errors(value, schema) if schema is not None else ["$: unknown name"]
        written = canonical(exchange | {"arguments": value})
    except RecursionError:
        found, broken, written = [TOO_DEEP], TOO_DEEP, canonical(exchange | {"arguments": arguments})
    return found, not broken, written


# -- linking ------------------------------------------------------------


def levels(calls: DataFrame) -> DataFrame:
    """id and level of the calls that need another one; round by round, each a written table."""
    edges = calls.select("id", F.explode("needs").alias("needed")).distinct()
    edges = stage(edges.join(calls.select(F.col("id").alias("needed")).distinct(), "needed", "left_semi"), "tool-needs")
    waiting = stage(edges.select("id").distinct(), "tool-waiting")
    done, level = None, 0
    open_edges = edges.join(waiting.select(F.col("id").alias("needed")), "needed", "left_semi")
    while not waiting.isEmpty():
        level += 1
        blocked = open_edges.select("id").distinct()
        ready = stage(waiting.join(blocked, "id", "left_anti"), "tool-ready")
        if ready.isEmpty():
            level = -1
            ready = waiting
        placed = ready.select("id", F.lit(level).alias("level"))
        done = placed if done is None else done.unionAll(placed)
        if level < 0:
            break
        waiting = stage(waiting.join(ready, "id", "left_anti"), "tool-waiting")
        open_edges = stage(open_edges.join(ready.select(F.col("id").alias("needed")), "needed", "left_anti"), "tool-needs")
    return done if done is not None else waiting.select("id", F.lit(0).alias("level"))


def with_unknown_needs(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """The rows with `unknown`, those of their needs that name no call; null when they need nothing."""
    needing = F.size("needs") > 0
    edges = rows.filter(needing).select("id", "needs").distinct().withColumn("needed", F.explode("needs"))
    edges = edges.filter("needed is not null").join(calls.select(F.col("id").alias("needed")), "needed", "left_anti")
    found = edges.groupBy(F.col("id").alias("of_id"), F.col("needs").alias("of_needs")).agg(F.collect_set("needed").alias("unknown"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("needs") == F.col("of_needs"))
    joined = rows.filter(needing).join(found, same, "left").drop("of_id", "of_needs")
    rest = rows.filter(~F.coalesce(needing, F.lit(False)))
    return joined.unionByName(rest.withColumn("unknown", F.lit(None).cast("array<string>")))


def _least(rows: DataFrame) -> DataFrame:
    """The least row of each identifier."""
    rest = [c for c in rows.columns if c != "id"]
    best = rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("best"))
    return best.select("id", *[F.col("best")[c].alias(c) for c in rest])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Exchanges.

    calls: id, turn, name, arguments (JSON), needs (array of ids).  results: id, turn, content.
    schemas: a JSON schema for each name; a bounded list, sent to every task.
    Gives id, name, call_turn, result_turn, level, status, valid, errors, copies, json.
    """
    calls = calls.select("id", "turn", "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    calls = stage(calls.groupBy(*calls.columns).agg(F.count("*").alias("copies")), "tool-calls")
    results = results.select("id", "turn", "content")
    results = stage(results.groupBy(*results.columns).agg(F.count("*").alias("copies")), "tool-results")
    named_calls, named_results = calls.filter("id is not null"), results.filter("id is not null")
    first = _least(named_calls)
    answers = _least(named_results).toDF("id", "result_turn", "content", "result_copies")

    met = first.join(answers, "id", "full_outer")
    status = F.when(F.col("copies").isNull(), "orphan").when(F.col("result_copies").isNull(), "open").otherwise("linked")
    met = met.select(
        "id", "name", F.col("turn").alias("call_turn"), "result_turn", "arguments", "content", "needs", status.alias("status"),
        F.coalesce("copies", "result_copies").alias("copies"),
    )

    def aside(rows: DataFrame, status: str) -> DataFrame:
        is_call = "name" in rows.columns
        none = F.lit(None)
        return rows.select(
            "id",
            (F.col("name") if is_call else none.cast("string")).alias("name"),
            (F.col("turn") if is_call else none.cast("long")).cast("long").alias("call_turn"),
            (none if is_call else F.col("turn")).cast("long").alias("result_turn"),
            (F.col("arguments") if is_call else none.cast("string")).alias("arguments"),
            (none.cast("string") if is_call else F.col("content")).alias("content"),
            (F.col("needs") if is_call else none.cast("array<string>")).alias("needs"),
            F.lit(status).alias("status"),
            "copies",
        )

    def others(rows: DataFrame, least: DataFrame) -> DataFrame:
        same = [rows[c].eqNullSafe(least[c]) for c in least.columns]
        condition = same[0]
        for s in same[1:]:
            condition &= s
        return rows.join(least, condition, "left_anti")

    conflicts = aside(others(named_calls, _least(named_calls)), "conflict").unionAll(
        aside(others(named_results, _least(named_results)), "conflict")
    )
    unnamed = aside(calls.filter("id is null"), "unnamed").unionAll(aside(results.filter("id is null"), "unnamed"))
    every = met.unionAll(conflicts).unionAll(unnamed)
    every = with_unknown_needs(every, first)
    every = every.join(levels(first), "id", "left").withColumn(
        "level", F.when(F.col("status").isin("linked", "open"), F.coalesce("level", F.lit(0)))
    )

    def run(batches):
        for batch in batches:
            valid, wrong, written = [], [], []
            for row in batch.to_pylist():
                exchange = {"id": row["id"], "status": row["status"]}
                if row["result_turn"] is not None or row["content"] is not None:
                    exchange["result"] = row["content"]
                if row["needs"]:
                    exchange["needs"] = sorted(n for n in row["needs"] if n is not None)
                if row["name"] is not None or row["arguments"] is not None:
                    exchange["name"] = row["name"]
                    found, read, text = checked(row["arguments"], schemas.get(row["name"]), exchange)
                    if read:
                        found += [f"needs: no call {n}" for n in sorted(row["unknown"] or [])]
                else:
                    found, text = [], canonical(exchange)
                valid.append(not found)
                wrong.append(_writable("; ".join(found)))
                written.append(_writable(text))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "name", "call_turn", "result_turn", "level", "status", "copies")),
                    pa.array(valid, pa.bool_()),
                    pa.array(wrong, pa.string()),
                    pa.array(written, pa.string()),
                ],
                names=["id", "name", "call_turn", "result_turn", "level", "status", "copies", "valid", "errors", "json"],
            )

    schema = "id string, name string, call_turn long, result_turn long, level int, status string, copies long, valid boolean, errors string, json string"
    return map_batches(every, run, schema)


# -- plain conversations ------------------------------------------------

#: What the messages of a plain conversation are calls of, and what their arguments must be.
SCHEMAS = {
    "configure": {
        "type": "object",
        "properties": {"instructions": {"type": "string", "minLength": 1}},
        "required": ["instructions"],
        "additionalProperties": False,
    },
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "after": {"type": ["string", "null"]}},
        "required": ["prompt"],
        "additionalProperties": False,
    },
}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations (conv_id, turn, role, text).

    A system message is a call that configures its conversation, a user message a
    call that asks for a reply and, after the first turn, needs the call that
    opened its conversation; any other message is the result of the call one turn
    before it.
    """
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.when(named, name).alias("id")
    )
    asked = rows.filter(F.col("role").isin("user", "system"))
    system = F.col("role") == "system"
    opening = F.concat(F.col("conv_id").cast("string"), F.lit(":0"))
    keep = {"ignoreNullFields": "false"}
    calls = asked.select(
        "id",
        "turn",
        F.when(system, "configure").otherwise("reply").alias("name"),
        F.when(system, F.to_json(F.struct(F.col("text").alias("instructions")), keep))
        .otherwise(F.to_json(F.struct(F.col("text").alias("prompt")), keep))
        .alias("arguments"),
        F.when(~system & (F.col("turn") > 0), F.array(opening)).alias("needs"),
    )
    answered = rows.filter(~F.coalesce(F.col("role").isin("user", "system"), F.lit(False)))
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    return calls, answered.select(F.when(named, before).alias("id"), "turn", F.col("text").alias("content"))
