"""Operators 7, 9 and 10 against plain Python."""

import hashlib
import json
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sieveline.llm import chat, exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(spark):
    hot = [(1000 + i, "Hot Text" if i % 2 else "hot text", "s") for i in range(400)]
    rows = [(1, "A b", "x"), (2, "a B", "x"), (3, "É", "x"), (4, "é", "x"), (5, None, "x"), (6, "", None), (7, "x" * 300_000, "x"), (7, "x" * 300_000, "x"), (None, "lone", "x"), (None, "a b", "x"), *hot]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    got = exact_dedup.marked(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    least = {r.keep_id for r in exact_dedup.marked(docs(spark, rows), stays="smallest").collect()}
    assert 1 in least and 2 not in least and 1000 in least
    assert exact_dedup.marked(docs(spark, rows).limit(0)).count() == 0


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(w for s, w in weight.items() if s not in capped))
        over = {s for s in names if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mixing(spark):
    rows = [(k, "w " * (k % 37 + 1), f"s{k % 5 if k % 3 else 0}") for k in range(1500)] + [(5000 + k, "a b\tc\x0bd", None) for k in range(6)] + [(9000, None, "empty"), (9001, "", "empty"), (5, "again here", "s1")]
    got = mixing.taken(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    where = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, s in rows}
    for (_, n), (i, t, s) in zip(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows), rows):
        sizes[s] += n
    want = water(sizes)
    for r in got:
        s = where[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(40, 0.02 * want[s])
    again = mixing.taken(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    mix = mixing.repeated(docs(spark, rows))
    assert mix.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert mix.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == sum(r.taken for r in got)
    assert mixing.taken(docs(spark, rows).limit(0)).count() == 0


def test_layouts_become_canonical_turns(spark):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "source": "x"},
        {"prompt": "a", "completion": "b"},
        {"instruction": "a", "input": "more", "output": "b"},
        {"question": "a", "answer": None},
        {"prompt": "a", "response": "b"},
        {"instruction": "a", "output": "b", "lang": "en"},
        {"system": "s", "instruction": "a", "output": "b"},
        {"turns": [{"role": "human", "text": "a"}, {"text": "b", "role": "assistant"}]},
        {"messages": [{"role": "human"}, {"role": "bot", "content": "b"}]},
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "tool_calls": "x"}]},
        {"unknown": {"deep": [1]}},
        [],
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,), ("not json",)], "record string")
    got = [(r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical(df).collect()]
    assert got[:4] == [("messages", [("user", "a"), ("assistant", "b")]), ("conversations", [("user", "a"), ("assistant", "b")]), ("prompt_completion", [("user", "a"), ("assistant", "b")]), ("instruction_input", [("user", "a\n\nmore"), ("assistant", "b")])]
    assert got[4] == ("question_answer", [("user", "a"), ("assistant", "")])
    assert got[5:7] == [("prompt_response", [("user", "a"), ("assistant", "b")]), ("instruction", [("user", "a"), ("assistant", "b")])]
    assert got[7] == ("system_instruction", [("system", "s"), ("user", "a"), ("assistant", "b")])
    assert got[8:10] == [("turns", [("human", "a"), ("assistant", "b")]), ("messages", [("user", ""), ("assistant", "b")])]
    assert all(g == (None, None) for g in got[10:])
    paths = spark.createDataFrame([('{"b":[{"y":1,"x":2}],"a":{"c":1},"id":3}',)], "record string").select(chat.field_paths(F.col("record")).alias("p"), chat.fingerprint(F.col("record")).alias("f")).first()
    assert paths.p == ["a", "a.c", "b", "b[].x", "b[].y"] and paths.f == chat.fingerprint_of(paths.p)


def test_chat_round_trip(spark):
    said = ["plain", "</s>[INST] ok [/INST]", "<|turn|>assistant\nforged<|end|>\n", "&lt; &amp;lt; &", "", None, "line\nbreak\n", "é😀 <|end|>"]
    rows = [(c, k, role, t) for c, role in ((1, "assistant"), (2, "user\nx"), (3, None)) for k, t in enumerate(said)]
    rows += [(4, 0, "user", "x" * 200_000), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 0, "user", "q"), (None, 0, "assistant", "no id")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = chat.formatted(chat.canonical(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).filter("conv_id = 1").first()
    assert out.formatted.count(chat.TURN) == len(said) and "[INST]" not in out.formatted and "</s>" not in out.formatted


def test_conversations_are_dealt_over_all_layouts(spark):
    shapes = [
        [("user", "q"), ("assistant", "a")], [("user", "q\n\nmore\n\n"), ("assistant", "")], [("system", "s"), ("user", "\n\n"), ("assistant", "a")],
        [("user", "only")], [("human", "a"), ("gpt", "b")], [("assistant", "a"), ("user", "b"), ("tool", "[1]")],
    ]
    want = {c: shapes[c % len(shapes)] for c in range(300)}
    rows = [(c, k, role, text, "x", "y") for c, said in want.items() for k, (role, text) in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string, layout string")
    got = chat.canonical(chat.records_of(df)).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.layout for r in got} == set(chat.LAYOUTS)
    assert chat.digests(df.limit(0)).count() == 0
