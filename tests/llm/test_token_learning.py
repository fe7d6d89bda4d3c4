"""What op 5 learns of new stretches: ids as the library's, in lines of bounded length, without Python calls for each."""

import random
import sys

import numpy as np

from sieveline.llm import token_file
from sieveline.llm.queries import tokenizer_path
from sieveline.llm.token_file import Encoder


def laid(texts):
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def test_learning_calls_python_for_lines_only():
    rng = random.Random(5)
    encode = Encoder(tokenizer_path())
    encode(*laid(["some words first"]))
    words = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzäñé.,'1", k=rng.randint(3, 11))) for _ in range(20_000)})
    text, calls = " ".join(words), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids = encode(*laid([text]))
    finally:
        sys.setprofile(None)
    assert ids[0].tolist() == encode.whole(text).tolist()
    assert calls < len(words) / 2


def test_white_space_of_any_script_beside_stretches():
    rng = random.Random(6)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    signs = [*spaces, *"aZ9.'ñàą​☃上　あ¡\U0001f600\x00", "\ud800", "</s>", "'s"]
    texts = ["".join(rng.choice(signs) if rng.random() < 0.6 else " " for _ in range(rng.randint(0, 12))).encode("utf-8", "replace").decode() for _ in range(3000)]
    texts += [f"a{s} b" for s in spaces] + [f"a {s}b" for s in spaces] + [f"{s}a b{s}" for s in spaces]
    encode = Encoder(tokenizer_path())
    for k in range(0, len(texts), 700):
        got = encode(*laid(texts[k : k + 700]))
        assert [x.tolist() for x in got] == [encode.whole(t).tolist() for t in texts[k : k + 700]]


def test_frequent_stretches_are_not_learned_again(monkeypatch):
    monkeypatch.setattr(token_file, "REMEMBERED", 500)
    rng = random.Random(7)
    encode, learned = Encoder(tokenizer_path()), []
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda contents, start, end, heads: (learned.extend(contents[a:b].tobytes() for a, b, h in zip(start.tolist(), end.tolist(), heads.tolist()) if not h), learn(contents, start, end, heads)))
    often = [f"often{k}é" for k in range(50)]
    for _ in range(30):
        texts = [" ".join(rng.sample([*often, *("rare" + "".join(rng.choices("abcdeß\n", k=12)) for _ in range(40))], 90)) for _ in range(3)]
        assert [x.tolist() for x in encode(*laid(texts))] == [encode.whole(t).tolist() for t in texts]
        assert len(encode.memory) <= 500 + 270
    assert max(learned.count(w.encode()) for w in often) == 1
