"""Operator 4: personal data by base patterns and a character-level bidirectional LSTM with a CRF.

Base spans are exact patterns over whole texts, leftmost and without overlap within a kind. The model adds
spans that the patterns miss (phones without `+`, spelled-out addresses, cards with other separators). It is
trained in numpy from labelled spans that a seeded generator writes; windows of WINDOW characters, half
overlapping, are laid over the places that hold a digit, `@` or a spelled-out sign. Where windows overlap their
scores are averaged, the more the nearer the character is to a window's middle, and the joined scores of
windows that touch are decoded once with the CRF: a span is a whole path over all of them, wherever windows
meet. A model span counts if its content is well-formed for its kind (digits, Luhn, parts) and it meets no
base span; base spans always stay.

Defined results: null counts as empty; a text without spans has empty `spans`; offsets are code points, end
exclusive; rows that repeat a doc_id come back once each; an empty table gives none. Texts of any length are
read whole, with some 40 bytes a character of windows. Two model spans never meet; of paths with equal scores
the lower tags win. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import chunks, ints, mapped, text_buffers

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 20, 12
TRAIN_WINDOWS, EPOCHS, BATCH, RATE = 3000, 6, 50, 1.5e-2
#: Windows decoded together.
TOGETHER = 512

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
#: Where windows are laid.
_ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]| at [A-Za-z0-9-]+ dot [A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    found: list[tuple[str, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        # The local part is the run of its signs before the `@`, back to the last match at most.
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# --- labelled spans ---------------------------------------------------------------------------------


def _labelled(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A line of prose with spans, and look-alikes that are none."""
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    word = lambda low=2, high=9: "".join(letters[min(25, int(rng.exponential(6)))] for _ in range(int(rng.integers(low, high))))
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def card() -> str:
        body = digits(15)
        n = body + next(c for c in "0123456789" if luhn(body + c))
        return pick(n, f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}", f"{n[:4]}-{n[4:8]}-{n[8:12]}-{n[12:]}", f"{n[:4]}.{n[4:8]}.{n[8:12]}.{n[12:]}", f"{n[:4]}_{n[4:8]}_{n[8:12]}_{n[12:]}")

    def phone() -> str:
        a, b, c, d = digits(3), digits(3), digits(4), pick("1", "44", "49", "33")
        return pick(f"+{d} ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{d} {a} {b} {c}", f"+{d}.{a}.{b}.{c}")

    def email() -> str:
        user, host, top = pick(word(), f"{word()}.{word()}", word() + digits(2)), word(), pick("com", "org", "net", "de", "fr")
        return pick(f"{user}@{host}.{top}", f"{user}@mail{digits(1)}.{host}.{top}", f"{user} (at) {host}.{top}", f"{user}[at]{host}.{top}", f"{user} (at) {host} (dot) {top}", f"{user} at {host} dot {top}")

    def ip() -> str:
        return ".".join(str(x) for x in rng.integers(1, 255, 4))

    def other() -> str:
        return pick(digits(int(rng.integers(1, 8))), f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"version {digits(1)}.{digits(1)}", f'token = "{"".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 40))}"', f"{digits(1)},{digits(3)},{digits(3)}", f"@{word()}", f"{word()}{digits(2)}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()} {word()}")

    text, spans = "", []
    for _ in range(int(rng.integers(4, 9))):
        roll = rng.random()
        kind = pick(*KINDS) if roll < 0.3 else ""
        piece = {"email": email, "ip": ip, "card": card, "phone": phone, "": other if roll > 0.8 else lambda: " ".join(word() for _ in range(int(rng.integers(1, 5))))}[kind]()
        text += pick("", "", " ", "| ", "(", '"')
        if kind:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece + pick(" ", " ", ", ", ".\n", "### ", "!! ")
    return text, spans


# --- model ------------------------------------------------------------------------------------------

#: Classes of characters: digits, letters by case, signs one by one, the rest by kind.
_SIGNS = "@+-.()[] \n_,:;\"'/|#*!&%$="
CLASSES = 10 + 26 + 1 + len(_SIGNS) + 3


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _class_table()
    return np.where(points < 128, table[np.minimum(points, 127)], CLASSES - 1).astype(np.int64)


def _class_table() -> np.ndarray:
    if not hasattr(_class_table, "table"):
        table = np.full(128, CLASSES - 2, np.int64)
        table[48:58] = np.arange(10)
        table[97:123] = 10 + np.arange(26)
        table[65:91] = 36
        for k, c in enumerate(_SIGNS):
            table[ord(c)] = 37 + k
        _class_table.table = table
    return _class_table.table


PAD = CLASSES - 3
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[a:b] = k + 1
        tags[a] = k
    return tags


def _allowed() -> np.ndarray:
    """0 where a tag may follow another (first axis), a large negative number else: inside follows begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, LSTM in both directions, a linear layer and CRF transitions; float64 numpy, trained by backpropagation with Adam."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"e": rng.normal(0, 0.5, (CLASSES, EMBED)), "o": init(2 * HIDDEN, TAGS), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {"x" + d: init(EMBED, 4 * HIDDEN), "h" + d: init(HIDDEN, 4 * HIDDEN), "g" + d: np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.allowed = _allowed()

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """LSTM over x (time, rows, EMBED); hidden states and, for training, what backpropagation needs."""
        n, rows = x.shape[:2]
        pre = x @ self.p["x" + d] + self.p["g" + d]
        h = c = np.zeros((rows, HIDDEN))
        out, kept = np.empty((n, rows, HIDDEN)), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + d]
            i, f, o = np.split(_sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, old = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep:
                kept.append((t, i, f, o, g, before, old, th))
        return out, kept

    def _emit(self, chars: np.ndarray, keep: bool = False):
        x = self.p["e"][chars.T]
        forward, kf = self._run(x, "f", keep)
        backward, kb = self._run(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return x, both, kf, kb, both @ self.p["o"] + self.p["c"]

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Scores (rows, time, TAGS) of windows of classes (rows, time)."""
        return self._emit(chars)[-1].transpose(1, 0, 2)

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best tags of windows of classes (rows, WINDOW), each on its own."""
        rows = len(chars)
        blocks = self.emissions(chars).reshape(-1, STRIDE, TAGS)
        first = np.arange(len(blocks)) % (WINDOW // STRIDE) == 0
        return self.best_path(blocks, first, np.zeros(len(blocks), bool)).reshape(rows, WINDOW)

    def best_path(self, emit: np.ndarray, first: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Best tags (blocks, STRIDE) of sequences of blocks of scores (blocks, STRIDE, TAGS), by Viterbi.

        `first` marks the blocks that begin a sequence, `whole` those of them before which there is no text, so
        that no span can reach over their start. Scores of the best paths through each block, by the tags before it and
        at its end, come for many blocks at once; only these are chained along a sequence.
        """
        step = (self.p["t"] + self.allowed).astype(np.float32)
        begin = np.where(whole[:, None] & (np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, self.p["s"]).astype(np.float32)
        n = len(emit)
        through = np.empty((n, TAGS, TAGS), np.float32)
        for a in range(0, n, TOGETHER):
            e, new = emit[a : a + TOGETHER], first[a : a + TOGETHER]
            m = np.where(new[:, None, None], begin[a : a + TOGETHER, None, :], step) + e[:, None, 0]
            for t in range(1, STRIDE):
                m = (m[:, :, :, None] + step).max(2) + e[:, None, t]
            through[a : a + TOGETHER] = m
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, n))
        start, length = start[np.argsort(-length)], np.sort(length)[::-1]
        before, entry = np.zeros((n, TAGS), np.int8), np.zeros((len(start), TAGS), np.float32)
        runs = [int(np.searchsorted(-length, -d)) for d in range(int(length[0]) if n else 0)]  # how many reach block d
        score = np.empty((n, TAGS), np.float32)
        for d, k in enumerate(runs):
            at = start[:k] + d
            paths = entry[:k, :, None] + through[at]
            before[at], best = paths.argmax(1), paths.max(1)
            score[at] = entry[:k] = best - best.max(1, keepdims=True)
        last = np.zeros(n, np.int8)
        ends = start + length - 1
        last[ends] = score[ends].argmax(1)
        for d in range(len(runs) - 1, 0, -1):
            at = start[: runs[d]] + d
            last[at - 1] = before[at, last[at]]
        tags = np.zeros((n, STRIDE), np.int8)
        for a in range(0, n, TOGETHER):
            e, at = emit[a : a + TOGETHER], np.arange(a, min(n, a + TOGETHER))
            best = np.where(first[at, None], begin[at], step[last[at - 1]]) + e[:, 0]
            back = np.zeros((STRIDE, len(at), TAGS), np.int8)
            for t in range(1, STRIDE):
                paths = best[:, :, None] + step
                back[t] = paths.argmax(1)
                best = paths.max(1) + e[:, t]
            tags[at, -1] = last[at]
            for t in range(STRIDE - 1, 0, -1):
                tags[at, t - 1] = back[t, at - a, tags[at, t]]
        return tags

    def _gradients(self, chars: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x, both, kf, kb, emit = self._emit(chars, keep=True)
        n, rows = emit.shape[:2]
        step = self.p["t"]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + self.p["s"]
        for t in range(1, n):
            alpha[t] = emit[t] + lse(alpha[t - 1][:, :, None] + step, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(step + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        demit = np.exp(alpha + beta - total[None, :, None])
        dt = np.zeros_like(step)
        for t in range(1, n):
            dt += np.exp(alpha[t - 1][:, :, None] + step + (emit[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
        g, at = gold.T, np.arange(rows)
        loss = total.sum() - self.p["s"][g[0]].sum() - sum(emit[t, at, g[t]].sum() for t in range(n)) - step[g[:-1], g[1:]].sum()
        for t in range(n):
            demit[t, at, g[t]] -= 1
        np.subtract.at(dt, (g[:-1].ravel(), g[1:].ravel()), 1)
        grads = {"t": dt, "s": demit[0].sum(0), "c": demit.sum((0, 1)), "o": np.einsum("trh,trk->hk", both, demit)}
        dboth, dx = demit @ self.p["o"].T, np.zeros_like(x)
        for d, kept, dh_all in (("f", kf, dboth[:, :, :HIDDEN]), ("b", kb, dboth[:, :, HIDDEN:])):
            dh = dc = np.zeros((rows, HIDDEN))
            gx, gh, gg = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d]), np.zeros_like(self.p["g" + d])
            for t, i, f, o, gate, before, old, th in reversed(kept):
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - th**2)
                dz = np.concatenate([dc * gate * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gate**2)], axis=1)
                gx += x[t].T @ dz
                gh += old.T @ dz
                gg += dz.sum(0)
                dx[t] += dz @ self.p["x" + d].T
                dh, dc = dz @ self.p["h" + d].T, dc * f
            grads |= {"x" + d: gx, "h" + d: gh, "g" + d: gg}
        grads["e"] = np.zeros_like(self.p["e"])
        np.add.at(grads["e"], chars.T, dx)
        return loss / rows, {k: v / rows for k, v in grads.items()}

    def fit(self, chars: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> list[float]:
        rng, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        steps = epochs * -(-len(chars) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                loss, grads = self._gradients(chars[rows], gold[rows])
                losses.append(loss)
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                norm = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
                for k, x in grads.items():
                    x = x * min(1, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return losses


def training_windows(n: int = TRAIN_WINDOWS, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of n windows of labelled lines; a span that the window's edge cuts keeps its tags within."""
    rng = np.random.default_rng(seed)
    chars, gold = np.full((n, WINDOW), PAD, np.int64), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, spans = _labelled(rng)
        first = int(rng.integers(0, max(1, len(text) - WINDOW // 2)))
        part = slice(first, first + WINDOW)
        c, t = classes(text)[part], tags_of(len(text), spans)[part]
        chars[k, : len(c)], gold[k, : len(t)] = c, t
    return chars, gold


_MODEL: dict[str, Tagger] = {}


def trained() -> Tagger:
    """The tagger, trained once in a driver process."""
    if "tagger" not in _MODEL:
        tagger = Tagger()
        tagger.fit(*training_windows())
        _MODEL["tagger"] = tagger
    return _MODEL["tagger"]


# --- windows ----------------------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Multiples of STRIDE whose windows hold the first or last character of an anchor."""
    starts: set[int] = set()
    for m in _ANCHOR.finditer(text):
        for k in {m.start() // STRIDE, (m.end() - 1) // STRIDE}:
            starts.update(x for x in (k - 1, k) if x >= 0)
    return [k * STRIDE for k in sorted(starts)]


#: How much a window counts for its characters.
_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)


def joined_tags(texts: list[str], plan: list[tuple[int, list[int]]], tagger: Tagger) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(text, starts of its blocks, their tags) for the windows that plan lays over texts."""
    at, numbers, jobs, firsts, wholes = 0, [], [], [], []
    for i, starts in plan:
        blocks = sorted({s // STRIDE + d for s in starts for d in range(WINDOW // STRIDE)})
        place = {b: at + k for k, b in enumerate(blocks)}
        jobs += [(i, s, place[s // STRIDE]) for s in starts]
        firsts += [b - 1 not in place for b in blocks]
        wholes += [b == 0 for b in blocks]
        numbers.append((i, at, blocks))
        at += len(blocks)
    scores, weight = np.zeros((at, STRIDE, TAGS), np.float32), np.zeros((at, STRIDE, 1), np.float32)
    known: dict[int, np.ndarray] = {}
    for a in range(0, len(jobs), TOGETHER):
        part = jobs[a : a + TOGETHER]
        chars = np.full((len(part), WINDOW), PAD, np.int64)
        for k, (i, s, _) in enumerate(part):
            if i not in known:
                known = {i: classes(texts[i])}  # jobs are in order of texts
            c = known[i][s : s + WINDOW]
            chars[k, : len(c)] = c
        emit, into = tagger.emissions(chars), np.array([b for *_, b in part])
        for d in range(WINDOW // STRIDE):
            half = slice(d * STRIDE, (d + 1) * STRIDE)
            scores[into + d] += emit[:, half] * _WEIGHT[half, None]
            weight[into + d] += _WEIGHT[half, None]
    tags = tagger.best_path(scores / weight, np.array(firsts, bool), np.array(wholes, bool))
    for i, first, blocks in numbers:
        yield i, [b * STRIDE for b in blocks], tags[first : first + len(blocks)]


def spans_of(length: int, starts: list[int], tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans that tags (blocks, STRIDE) from starts on mark: a begin and what is inside after it."""
    spans: list[tuple[str, int, int]] = []
    of, offset = np.nonzero(tags)
    kind, begin, end = 0, 0, -1
    for at, tag in zip((np.array(starts, np.int64)[of] + offset).tolist(), tags[of, offset].tolist()):
        if at >= length:
            break
        if kind and (at != end or (tag + 1) // 2 != kind or tag % 2 == 1):
            spans.append((KINDS[kind - 1], begin, end))
            kind = 0
        kind, begin = (kind, begin) if kind else ((tag + 1) // 2, at)
        end = at + 1
    if kind:
        spans.append((KINDS[kind - 1], begin, end))
    return spans


def well_formed(kind: str, piece: str) -> bool:
    """Whether a span that the model proposes can be what it says."""
    digits = re.sub(r"[^0-9]", "", piece)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+\s?(?:@|[(\[]at[)\]])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[(\[]dot[)\]])\s?[A-Za-z0-9-]+)+", piece)) or bool(re.fullmatch(r"[^\s@]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", piece))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", piece)) and all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and bool(re.fullmatch(r"[0-9](?:[ ._-]?[0-9])+", piece)) and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"(?:\(?[0-9]{2,4}\)?[ .-]){2,4}[0-9]{3,4}", piece))


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the joined ranges of spans."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(covered: tuple[list[int], list[int]], a: int, b: int) -> bool:
    k = bisect_left(covered[0], b)
    return k > 0 and covered[1][k - 1] > a


def found_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, spans that the model adds) of each text."""
    plan = [(i, window_starts(t)) for i, t in enumerate(texts) if _ANCHOR.search(t)]
    base = {i: base_spans(texts[i]) for i, _ in plan}
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    for i, starts, tags in joined_tags(texts, plan, tagger):
        text, covered = texts[i], _covered(base[i])
        more = []
        for kind, a, b in spans_of(len(text), starts, tags):
            while b > a and text[b - 1] in " \n.,;:!#*|":
                b -= 1
            while a < b and text[a] in " \n|":
                a += 1
            if well_formed(kind, text[a:b]) and not _meets(covered, a, b) and not (a and text[a - 1].isdigit()) and not text[b : b + 1].isdigit():
                more.append((kind, a, b))
        out[i] = (base[i], more)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, base spans by kind, their digest, all spans, and how many the model added."""
    model = documents.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ints(batch.column(0))
            _, at = text_buffers(batch.column(1))
            column = batch.column(1).fill_null("")
            for a, b in chunks(at):
                found = found_spans(column.slice(a, b - a).to_pylist(), model.value)
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
                digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], mask=ids[a:b] == -(2**63)), *counts, pa.array(digest), pa.array([joined(base + more) for base, more in found]), pa.array([len(more) for _, more in found], pa.int64())],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, SCHEMA)
