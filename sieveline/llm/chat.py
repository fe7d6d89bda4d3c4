"""Operator 9 [native]: chat formatting by schema fingerprints.

A record is a JSON object of any known layout. The sorted paths of its nested fields (fields of the
envelope left out) are hashed; the hash selects a declarative mapping that gives canonical turns
(role, text). Turns are rendered with a template whose control strings all hold `<` or `[`; both are
escaped in texts and roles, so no text can forge a turn, and unescaping gives every text back. Next to the
rendered text goes the loss mask: spans of code points, one for each assistant text.

Defined results: null text and null role count as empty; turns that tie on their number are in order of
role and text, repeated ones stay; rows without a conv_id are one conversation; a record of unknown layout,
or one that is no JSON object, has null layout and turns (it is returned, not dropped); a conversation is one
value, so its turns are gathered in one row, however long their texts. An empty table gives an empty result.
Extra columns are ignored by records_of and carried by canonical and formatted, but for `layout`, `turns`,
`formatted` and `loss`, which are written anew.
"""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: In this order; undone in the opposite one.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&nl;")]
TRAINED_ROLE = "assistant"

#: Fields that say nothing of a record's layout.
ENVELOPE = ["id", "conv_id", "source", "lang", "created", "model"]
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


def _listed(field: str, role: str, text: str, aliases: bool) -> dict:
    return {"aliases": aliases, "paths": [field, f"{field}[].{role}", f"{field}[].{text}"], "schema": f"{field} array<struct<{role} string, {text} string>>", "each": (field, role, text)}


#: name: (paths, schema for from_json, and either the list that holds the turns and whether its roles have aliases, or the fields of each role in order).
LAYOUTS: dict[str, dict] = {
    "messages": _listed("messages", "role", "content", True),
    "conversations": _listed("conversations", "from", "value", True),
    "turns": _listed("turns", "role", "text", False),
    "prompt_completion": {"paths": ["prompt", "completion"], "schema": "prompt string, completion string", "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["prompt", "response"], "schema": "prompt string, response string", "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction": {"paths": ["instruction", "output"], "schema": "instruction string, output string", "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input": {"paths": ["instruction", "input", "output"], "schema": "instruction string, input string, output string", "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "system_instruction": {"paths": ["system", "instruction", "output"], "schema": "system string, instruction string, output string", "fields": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
    "question_answer": {"paths": ["question", "answer"], "schema": "question string, answer string", "fields": [("user", ["question"]), ("assistant", ["answer"])]},
}


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths, key=lambda p: p.encode())).encode()).hexdigest()


def field_paths(record: Column) -> Column:
    """Sorted paths: `key`, `key.sub` of objects, `key[].sub` of lists of objects (of any of their elements); the envelope's are left out."""
    none = F.array().cast("array<string>")
    keys_of = lambda json: F.coalesce(F.json_object_keys(json), none)

    def inner(k: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit("']")))
        elements = F.from_json(F.when(value.startswith("["), value), "array<string>")
        of_lists = F.array_distinct(F.flatten(F.transform(F.coalesce(elements, none), keys_of)))
        under = lambda subs, join: F.transform(subs, lambda s: F.concat(k, F.lit(join), s))
        return F.concat(F.array(k), under(keys_of(value), "."), under(of_lists, "[]."))

    keys = F.filter(F.coalesce(F.json_object_keys(record), none), lambda k: ~k.isin(ENVELOPE))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(keys, inner))))


def fingerprint(record: Column) -> Column:
    return F.sha2(F.array_join(field_paths(record), "\n").cast("binary"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, name: str) -> Column:
    of = LAYOUTS[name]
    read = F.from_json(record, of["schema"])
    if "each" in of:
        field, role, text = of["each"]
        rename = F.create_map(*[F.lit(x) for x in chain(*ALIASES.items())])
        said = lambda m: F.coalesce(rename[m[role]], m[role]) if of["aliases"] else m[role]
        return F.transform(read[field], lambda m: _turn(said(m), m[text]))
    return F.array(*[_turn(F.lit(role), F.concat_ws("\n\n", *[read[x] for x in fields])) for role, fields in of["fields"]])


def canonical(records: DataFrame, column: str = "record") -> DataFrame:
    """records with layout and turns (array of role, text)."""
    record = F.col(column)
    known = F.create_map(*[F.lit(x) for x in chain(*[(fingerprint_of(of["paths"]), name) for name, of in LAYOUTS.items()])])
    named = records.drop("layout", "turns").withColumn("layout", known[fingerprint(record)])
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name in LAYOUTS:
        turns = F.when(F.col("layout") == name, _mapped(record, name)).otherwise(turns)
    return named.withColumn("turns", turns)


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _undone(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(pairs)])


def formatted(conversations: DataFrame) -> DataFrame:
    """conversations (with turns) with formatted and loss, an array of (start, end) code points of formatted."""
    escaped = F.transform("turns", lambda t: F.struct(_replaced(t["role"], ROLE_ESCAPES).alias("role"), _replaced(t["text"], ESCAPES).alias("text"), (t["role"] == TRAINED_ROLE).alias("trained")))
    rows = conversations.withColumn("escaped", escaped)
    whole = F.array_join(F.transform("escaped", lambda t: F.concat(F.lit(TURN), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begins = acc["at"] + F.lit(len(TURN) + 1) + F.length(t["role"])
        ends = begins + F.length(t["text"])
        span = F.array(F.struct(begins.alias("start"), ends.alias("end")))
        return F.struct((ends + F.lit(len(END))).alias("at"), F.when(t["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate("escaped", start, step, lambda acc: acc["spans"])
    return rows.withColumns({"formatted": whole, "loss": loss}).drop("escaped")


def read_back(rows: DataFrame) -> DataFrame:
    """rows with read_turns and loss_text, both taken from formatted and loss alone."""
    pieces = F.split("formatted", r"<\|turn\|>")
    body = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.regexp_replace(p, r"<\|end\|>\n\z", ""))
    turns = F.transform(body, lambda p: F.struct(
        _undone(F.substring_index(p, "\n", 1), ROLE_ESCAPES).alias("role"),
        _undone(F.substring(p, F.instr(p, "\n") + 1, F.length(p)), ESCAPES).alias("text"),
    ))
    masked = F.transform("loss", lambda s: _undone(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]), ESCAPES))
    return rows.withColumns({"read_turns": turns, "loss_text": F.array_join(masked, "")})


def _fields_of(said: Column) -> dict[str, tuple[Column, Column]]:
    """name: (whether a conversation's turns fit the layout without loss, the record's struct) of every layout."""
    roles = F.transform(said, lambda t: t["role"])
    no_alias = ~F.arrays_overlap(roles, F.array(*map(F.lit, ALIASES)))
    out = {}
    for name, of in LAYOUTS.items():
        if "each" in of:
            field, role, text = of["each"]
            # The names that such a layout uses itself are written, so that reading undoes them.
            spoken = (lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)) if role == "from" else (lambda r: r)
            turns = F.transform(said, lambda t: F.struct(spoken(t["role"]).alias(role), t["text"].alias(text)))
            out[name] = (no_alias if of["aliases"] else F.lit(True), F.struct(turns.alias(field)))
            continue
        fits, parts = F.coalesce(roles == F.array(*[F.lit(r) for r, _ in of["fields"]]), F.lit(False)), []
        for k, (_, fields) in enumerate(of["fields"]):
            text = F.get(said, k)["text"]
            if len(fields) == 2:
                fits = fits & F.coalesce(F.contains(text, F.lit("\n\n")), F.lit(False))
                head = F.substring_index(text, "\n\n", 1)
                parts += [head.alias(fields[0]), F.substring(text, F.length(head) + 3, F.length(text)).alias(fields[1])]
            else:
                parts.append(text.alias(fields[0]))
        out[name] = (fits, F.struct(*parts))
    return out


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the conversations of a table of (conv_id, turn, role, text) as JSON, dealt by conv_id over the layouts that hold them without loss."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said"))
    of = _fields_of(F.col("said"))
    fitting = F.filter(F.array(*[F.when(fits, name) for name, (fits, _) in of.items()]), lambda n: n.isNotNull())
    dealt = gathered.withColumn("fitting", fitting).withColumn("dealt", F.get("fitting", F.pmod(F.xxhash64("conv_id"), F.size("fitting")).cast("int")))
    record = F.lit(None).cast("string")
    for name, (_, fields) in of.items():
        record = F.when(F.col("dealt") == name, F.to_json(fields)).otherwise(record)
    return dealt.select("conv_id", record.alias("record"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what the output gives back."""
    back = read_back(formatted(canonical(records_of(rows))))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
escaped AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS t,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;') AS r FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(t) + length(r) + 17) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
