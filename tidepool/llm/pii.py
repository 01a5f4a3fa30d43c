"""Personal data: rules for four kinds, and a character-level BiLSTM with CRF transitions that adds what they miss."""

from __future__ import annotations

import io
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of the kind, end; in code points

EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # inside a run of digits no match can begin that its start has not
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return not sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping.  Anchored at each @, so a long word without one costs nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_PART:
            start -= 1
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """The rules' spans by start, then kind; not ``checked``: cards without their check digit's rule too."""
    if not TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and (not checked or luhn(digits)):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the model -------------------------------------------------------------------------------------------------------

CLASSES, TAGS = 22, 1 + 2 * len(KINDS)  # tag 0: outside; 2k+1, 2k+2: a span of kind k begins, goes on
WINDOW, STRIDE = 96, 48
NEVER = -1e4


def _class_table() -> np.ndarray:
    """Letters of "at" and "dot" have classes of their own, as these words stand for signs."""
    table = np.full(129, 20, np.int8)
    groups = ("0123456789", "bcefghijklmnpqrsuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "+", "-", "(", ")", " ", "_%", "\n\r\t\v\f", ":=\"'", ",;!?", "[{<", "]}>", "aA", "tT", "dD", "oO")
    for number, letters in enumerate(groups):
        for c in letters:
            table[ord(c)] = number
    table[128] = 21
    return table


CLASS_OF = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return CLASS_OF[np.minimum(points, 128)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forbidden() -> np.ndarray:
    """Transitions that no tagging has: into a span's inside from anything but that span."""
    out = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = True
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = False
    return out


class Tagger:
    """Both LSTMs, the emission layer and the CRF's transitions, with their gradients."""

    def __init__(self, hidden: int = 16, seed: int = 11, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        self.h, self.kind = hidden, kind
        h = hidden
        self.p = {"out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": rng.normal(0, 0.1, (TAGS, TAGS))}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 0.2, (h, 4 * h))
            self.p[f"x{d}"][:, h : 2 * h] += 0.5  # remember, at first
        self.p = {k: v.astype(kind) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        n, steps, h = *x.shape, self.h
        hidden, cell = np.zeros((n, h), self.kind), np.zeros((n, h), self.kind)
        out, tape = np.empty((n, steps, h), self.kind), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p[f"x{d}"][x[:, t]] + hidden @ self.p[f"h{d}"]
            gate = sigmoid(z[:, : 3 * h])
            i, f, o, g = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, was = cell, hidden
            cell = f * cell + i * g
            tanh = np.tanh(cell)
            hidden = o * tanh
            out[:, t] = hidden
            if keep:
                tape.append((t, i, f, o, g, before, tanh, was))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run(x, "f", False)[0], self._run(x, "b", False)[0]), axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def loss(self, x: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the taggings, and its gradients.  ``mask``: 0 where a window is padded."""
        n, steps = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        emit = ended(both @ self.p["out"] + self.p["bias"], mask)
        move = np.where(forbidden(), -1e4, self.p["move"])
        ahead, back = np.empty_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, steps):
            ahead[:, t] = logsum(ahead[:, t - 1][:, :, None] + move, 1) + emit[:, t]
        for t in range(steps - 2, -1, -1):
            back[:, t] = logsum(move[None] + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = logsum(ahead[:, -1], 1)
        d_emit = np.exp(ahead + back - total[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
        d_emit[rows, cols, tags] -= 1
        d_emit *= mask[:, :, None] / n
        d_move = np.zeros((TAGS, TAGS), self.kind)
        for t in range(1, steps):
            d_move += np.exp(ahead[:, t - 1][:, :, None] + move + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.subtract.at(d_move, (tags[:, :-1], tags[:, 1:]), 1)
        value = float((total - emit[rows, cols, tags].sum(axis=1) - move[tags[:, :-1], tags[:, 1:]].sum(axis=1)).mean())
        grads = {"out": both.reshape(-1, 2 * self.h).T @ d_emit.reshape(-1, TAGS), "bias": d_emit.sum(axis=(0, 1)), "move": np.where(forbidden(), 0, d_move / n)}
        d_both = d_emit @ self.p["out"].T
        for d, part in (("f", d_both[:, :, : self.h]), ("b", d_both[:, :, self.h :])):
            grads |= self._back(x, d, part, runs[d][1])
        return value, grads

    def _back(self, x: np.ndarray, d: str, part: np.ndarray, tape: list) -> dict:
        w = self.p[f"h{d}"]
        dx, dw = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(w)
        dh, dc = np.zeros((len(x), self.h), self.kind), np.zeros((len(x), self.h), self.kind)
        one_of = np.eye(CLASSES, dtype=self.kind)
        for t, i, f, o, g, before, tanh, was in reversed(tape):
            dh = dh + part[:, t]
            dc = dc + dh * o * (1 - tanh * tanh)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dx += one_of[x[:, t]].T @ dz
            dw += was.T @ dz
            dh, dc = dz @ w.T, dc * f
        return {f"x{d}": dx, f"h{d}": dw}

    def fit(self, x: np.ndarray, tags: np.ndarray, mask: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.02) -> Tagger:
        rng = np.random.default_rng(5)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, all_steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at, step = order[lo : lo + batch], step + 1
                pace = rate * (1.05 - step / all_steps)
                _, grads = self.loss(x[at], tags[at], mask[at])
                for k, g in grads.items():  # Adam
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tagging of each window and, for each place, what its tag has over tag 0 there (with the step to it).

        ``first``: windows that begin their text, where no span can go on."""
        emit, move = ended(self.emissions(x), mask), np.where(forbidden(), NEVER, self.p["move"])
        n, steps = x.shape
        back = np.empty(emit.shape, np.int8)
        score = emit[:, 0].copy()
        score[np.ix_(first, range(2, TAGS, 2))] += NEVER
        for t in range(1, steps):
            ways = score[:, :, None] + move
            back[:, t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + emit[:, t]
        tags = np.empty((n, steps), np.int8)
        rows = np.arange(n)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        over = np.take_along_axis(emit, tags[:, :, None].astype(int), 2)[:, :, 0] - emit[:, :, 0]
        over[:, 1:] += move[tags[:, :-1], tags[:, 1:]] - move[0, 0]
        return tags, over

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tagger:
        p = dict(np.load(io.BytesIO(raw)))
        out = cls(len(p["hf"]))
        out.p = p
        return out


def ended(emit: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Behind a text's end stands tag 0."""
    out = np.where(mask[:, :, None] > 0, emit, NEVER)
    out[:, :, 0] = np.where(mask > 0, emit[:, :, 0], 0.0)
    return out


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


# --- windows -----------------------------------------------------------------------------------------------------------

#: Signs that stand for an @ and for a dot.
AT = re.compile(r"@|[\[({<]\s*at\s*[\])}>]", re.I)
AT_WORD, DOT_WORD = re.compile(r"\sat\s", re.I), re.compile(r"\sdot\s", re.I)
DOT = re.compile(r"\.|[\[({<]\s*dot\s*[\])}>]|\sdot\s", re.I)
#: What every plausible span holds.
NEEDED = re.compile(rf"[0-9]+|{AT.pattern}|{DOT_WORD.pattern}", re.I)


def plausible(kind: int, text: str) -> bool:
    """What a decoded span must hold to count; it always holds what ``NEEDED`` matches."""
    groups = re.findall("[0-9]+", text)
    digits = sum(map(len, groups))
    if kind == 0:
        if at := AT.search(text):
            return DOT.search(text, at.end()) is not None
        return (at := AT_WORD.search(text)) is not None and DOT_WORD.search(text, at.end() - 1) is not None
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == 2:
        return 14 <= digits <= 19 and luhn("".join(groups))
    return 10 <= digits <= 15 and digits < len(text)


def trimmed(text: str, span: Span) -> Span:
    """A decoded span without blanks or letters that its kind cannot begin or end with."""
    start, kind, end = span
    ends = str.isalnum if kind == 0 else (lambda c: c in "0123456789")
    while end > start and not ends(text[end - 1]):
        end -= 1
    while start < end and not (ends(text[start]) or kind == 3 and text[start] in "+("):
        start += 1
    return start, kind, end


def snapped(text: str, span: Span) -> Span:
    """A span grown to the ends of the words that its ends stand in, by a stride's characters at most."""
    start, kind, end = span
    inside = (lambda c: c in LOCAL_PART) if kind == 0 else (lambda c: c in "0123456789")
    for _ in range(STRIDE):
        if start and inside(text[start - 1]) and inside(text[start]):
            start -= 1
        if end < len(text) and inside(text[end]) and text[end] != "." and inside(text[end - 1]):
            end += 1
    return start, kind, end


def window_count(length: int) -> int:
    """Windows begin at every multiple of the stride, until one reaches the text's end."""
    return max(1, -(-(length - WINDOW + STRIDE) // STRIDE))


def windows_to_decode(text: str) -> list[int]:
    """The numbers of the windows that wholly hold something ``NEEDED`` (of a run of digits, any digit).  In all others no
    tagging yields a plausible span, so to leave them out changes nothing."""
    out: set[int] = set()
    most = window_count(len(text)) - 1
    for m in NEEDED.finditer(text):
        one = m.end() - m.start() if m[0][0] not in "0123456789" else 1
        out.update(range(max(0, -(-(m.start() + one - WINDOW) // STRIDE)), min(most, (m.end() - one) // STRIDE) + 1))
    return sorted(out)


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(parts), WINDOW), np.int8), np.zeros((len(parts), WINDOW), np.float32)
    for k, part in enumerate(parts):
        x[k, : len(part)], mask[k, : len(part)] = part, 1
    return x, mask


def window_spans(tags: np.ndarray, over: np.ndarray, length: int, last: bool) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of the spans that a window's tagging shows whole: not those that go on from before it or
    reach its edge, unless the text ends there."""
    out = []
    for s in np.flatnonzero(tags[:length] % 2 == 1).tolist():
        e = s + 1
        while e < length and tags[e] == tags[s] + 1:
            e += 1
        if e < length or last:
            out.append((s, int(tags[s]) // 2, e, float(over[s : e + 1].sum())))
    return out


def reconciled(spans: dict[Span, float]) -> list[Span]:
    """Of one text's spans, which windows may tell differently, those that do not overlap and have the highest sum of scores;
    ties to what ends first."""
    order = sorted((s for s in spans if spans[s] > 0), key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in order]
    total, taken = [0.0], []
    for i, span in enumerate(order):
        before = bisect_right(ends, span[0], 0, i)
        with_it = total[before] + spans[span]
        taken.append((with_it > total[i], before))
        total.append(max(total[i], with_it))
    out, i = [], len(order)
    while i:
        if taken[i - 1][0]:
            out.append(order[i - 1])
            i = taken[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def found_by_model(model: Tagger, texts: list[str], needed: bool = True, at_once: int = 1024) -> list[list[Span]]:
    """The model's plausible spans of each text.

    Windows overlap by half, so what has up to ``STRIDE`` characters stands whole in one; each is decoded by itself.  A span
    that several windows tell counts with its highest score, and one choice over the whole text settles what overlaps.
    ``needed``: without the windows that cannot hold a plausible span.  Decoded are ``at_once`` windows at a time."""
    spans: list[dict[Span, float]] = [{} for _ in texts]

    def settle(held: list[tuple[int, int, np.ndarray]]) -> None:
        x, mask = padded([codes for _, _, codes in held])
        tags, over = model.decode(x, mask, np.flatnonzero([w == 0 for _, w, _ in held]))
        for i in np.flatnonzero((tags % 2 == 1).any(axis=1)).tolist():
            k, w, codes = held[i]
            at = w * STRIDE
            for s, kind, e, score in window_spans(tags[i], over[i], len(codes), at + len(codes) == len(texts[k])):
                span = trimmed(texts[k], (at + s, kind, at + e))
                if plausible(kind, texts[k][span[0] : span[2]]):
                    span = snapped(texts[k], span)
                    if plausible(kind, texts[k][span[0] : span[2]]):
                        spans[k][span] = max(score, spans[k].get(span, score))

    held: list[tuple[int, int, np.ndarray]] = []
    for k, text in enumerate(texts):
        for w in windows_to_decode(text) if needed else range(window_count(len(text))):
            held.append((k, w, classes(text[w * STRIDE : w * STRIDE + WINDOW])))
            if len(held) >= at_once:
                settle(held)
                held = []
    if held:
        settle(held)
    return [reconciled(s) for s in spans]


def all_spans(model: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(the rules' spans, those and the model's that overlap none of them) of each text."""
    out = []
    for text, more in zip(texts, found_by_model(model, texts) if model else [[]] * len(texts), strict=True):
        base = base_spans(text)
        starts, reach = [s for s, _, _ in base], np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
        free = lambda s, e: not (n := bisect_left(starts, e)) or reach[n - 1] <= s
        out.append((base, sorted(base + [s for s in more if free(s[0], s[2])])))
    return out


# --- training ------------------------------------------------------------------------------------------------------


def invented(rnd: random.Random) -> tuple[int, str]:
    """A span of some kind, in the rules' forms and in forms that they do not see."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda lo, hi: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(lo, hi)))
    kind = rnd.randrange(4)
    wide = rnd.choice(["", "", " "])
    around = lambda sign, word: rnd.choice([wide + sign + wide, f"{wide}[{word}]{wide}", f"{wide}({word}){wide}", f"{wide}{{{word}}}{wide}", f" {word} "])
    if kind == 0:
        at, dot = ("@", ".") if rnd.random() < 0.3 else (around("@", "at"), around(".", "dot"))
        if at == " at ":
            dot = " dot "
        user = w(2, 8) + rnd.choice(["", ".", "_", "-"]) + rnd.choice([w(1, 6), d(2)])
        return 0, user + at + w(3, 8) + dot + rnd.choice([w(2, 3), w(3, 7) + dot + w(2, 3)])
    if kind == 1:
        return 1, rnd.choice([".", ".", " . ", ". ", "[.]", "(.)", "[dot]", " dot ", "-"]).join(str(rnd.randrange(256)) for _ in range(4))
    if kind == 2:
        sep = rnd.choice(["", " ", "-", ".", "_", "/", " - ", "  "])
        return 2, sep.join(map(d, [4, 6, 5] if rnd.random() < 0.15 else [4, 4, 4, rnd.choice([4, 4, 4, 2, 7])]))
    plus, sep = rnd.choice(["+", "+", "00", ""]), rnd.choice(["-", " ", ".", "/", " - "])
    code = plus + d(rnd.choice([1, 2, 3])) + rnd.choice([" ", "-", " "]) if plus else ""
    return 3, code + rnd.choice([f"({d(3)}) {d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"({d(4)}){sep}{d(3)}{sep}{d(3)}", f"({d(3)}){d(3)}{sep}{d(4)}"])


def other(rnd: random.Random) -> str:
    """What looks alike and is none of the kinds."""
    d = lambda n, of="0123456789": "".join(rnd.choice(of) for _ in range(n))
    w = lambda n: d(n, "abcdefghijklmnopqrstuvwxyz")
    date = f"20{d(2)}-{d(2)}-{d(2)}"
    return rnd.choice(
        [
            *(f"{d(1)}.{d(1)}", f"Version {d(1)}.{d(1)}.{d(1)}", d(rnd.randint(1, 9)), date, f"{date} {d(2)}:{d(2)}:{d(2)}", f"{date} - 20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}"),
            *(f"password={d(18, '0123456789abcdef')}", f'token = "{d(32, "0123456789abcdef")}"', f"AKIA{d(16, 'ABCDEFGHJK0123456789')}", f"@{d(5, 'abcdef')}", f"{d(1)},{d(3)},{d(3)}", f"{d(3)},{d(3)},{d(3)}.{d(2)}"),
            *(f"look at {w(4)}.{w(3)}", f"at {d(2)}:{d(2)}", f"the dot {w(5)}", f"{d(2)} x {d(2)} x {d(2)}", f"{d(4)} {w(3)} {d(4)}", f"{w(4)} at {w(5)}", f"{d(20)}", f"{d(4)}/{d(4)}", f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        ]
    )


def invented_text(rnd: random.Random, words: list[str]) -> tuple[str, list[Span]]:
    """Words, spans and what looks like them, longer than a window."""
    text, spans = " ".join(rnd.choice(words) for _ in range(rnd.randrange(8))), []
    while len(text) < 2 * WINDOW:
        text += rnd.choice([" ", " ", "\n", ": ", ", "]) if text else ""
        if rnd.random() < 0.4:
            text += other(rnd)
        else:
            kind, piece = invented(rnd)
            spans.append((len(text), kind, len(text) + len(piece)))
            text += piece
        text += rnd.choice([" ", ". ", ", ", "\n"]) + " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))
    return text, spans


def training_windows(labelled: list[tuple[str, list[Span]]], made: int = 5000, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, tags and masks from labelled windows and from as many more of invented texts, cut anywhere.  A span's places
    are below 0 or beyond the window where the window's edges cut it."""
    rnd, rows = random.Random(seed), list(labelled)
    words = [x for t, _ in labelled for x in t.split() if x.isalpha()] or ["the", "and", "Lorem", "ipsum", "dolor,", "amet."]
    for _ in range(made):
        text, spans = invented_text(rnd, words)
        at = rnd.choice([0, rnd.randrange(len(text) - 8)])
        rows.append((text[at : at + WINDOW], [(s - at, kind, e - at) for s, kind, e in spans]))
    x, mask = padded([classes(t) for t, _ in rows])
    tags = np.zeros((len(rows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(rows):
        for start, kind, end in spans:
            tags[k, max(0, start) : max(0, min(end, len(text)))] = 2 * kind + 2
            if 0 <= start < len(text):
                tags[k, start] = 2 * kind + 1
    return x, tags, mask


def labelled_windows(docs: DataFrame, sample: int) -> DataFrame:
    """``part, spans``: up to ``sample`` of the windows that are decoded, with the rules' spans, those of the smallest hashes:
    a bound on what is trained on.  Cards are labelled whether their check digit is right or not, as that is no matter of
    form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                chosen = windows_to_decode(text)
                base = base_spans(text, checked=False) if chosen else []
                starts = [s for s, _, _ in base]
                longest = max((e - s for s, _, e in base), default=0)
                for w in chosen:
                    lo = w * STRIDE
                    near = base[bisect_left(starts, lo - longest) : bisect_left(starts, lo + WINDOW)]
                    rows.append((text[lo : lo + WINDOW], [x for s, kind, e in near if e > lo for x in (s - lo, kind, e - lo)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["part", "spans"])

    cut = docs.select("text").mapInArrow(run, "part string, spans array<long>")
    return written(cut.orderBy(F.xxhash64("part"), "part", "spans").limit(sample), "windows")


def train(docs: DataFrame, sample: int = 1500, epochs: int = 8, hidden: int = 16) -> Tagger:
    """The model, trained in one task on at most ``sample`` labelled windows and the invented ones; its few numbers come to the
    driver."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((part, spans) for b in batches for part, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([fitted(rows, epochs, hidden).to_bytes()], pa.binary())], ["model"])

    windows = labelled_windows(docs, sample)
    row = written(windows.repartition(1).mapInArrow(fit, "model binary"), "tagger").first()
    return Tagger.from_bytes(row.model) if row else fitted([], epochs, hidden)


def fitted(windows: list[tuple[str, list[int]]], epochs: int, hidden: int) -> Tagger:
    rows = [(part, [tuple(spans[i : i + 3]) for i in range(0, len(spans), 3)]) for part, spans in windows]
    return Tagger(hidden).fit(*training_windows(rows), epochs)


def find_personal_data(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``doc_id, base, spans`` (each ``array<struct<start, kind, end>>``) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            found = all_spans(model, texts_of(batch))
            columns = [pa.array([[(s, KINDS[k], e) for s, k, e in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    spans = "array<struct<start:bigint,kind:string,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def masked(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; all other columns stay.  Spans that overlap
    are replaced together, by the first one's kind."""
    names, at = docs.columns, docs.columns.index("text")

    def hide(text: str, spans: list[Span]) -> str:
        out, done = [], 0
        for start, kind, end in spans:
            if start >= done:
                out += [text[done:start], f"[{KINDS[kind].upper()}]"]
            done = max(done, end)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = all_spans(model, [t or "" for t in texts])
            new = pa.array([None if t is None else hide(t, s) for t, (_, s) in zip(texts, found, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)
