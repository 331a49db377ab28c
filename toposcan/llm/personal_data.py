"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from patterns with exact checks (``base_spans``), in time linear in the text. The network finds what these miss: entities that
stand side by side and that a greedy pattern swallows as one, numbers written without their usual marks, addresses with letters outside ASCII.

- Characters are mapped to ``CLASSES`` kinds. Two LSTMs read a window in both directions; a linear layer scores BIO tags of the four kinds, and
  learned transitions, with a start and an end, score their sequence. Training (``train``) is plain numpy on labelled spans: lines made by
  a seeded generator around spans whose place is known (``TRAIN_LINES`` of them, in one task, once). It does not read the corpus, so a text has the
  same spans in every table.
- A text is covered by windows of ``WINDOW`` characters that begin every ``STRIDE``. Every window is decoded by Viterbi; where one look at the scores
  proves that the path without any span is best, the search is left out. Windows without a digit and without an at sign hold no
  span that would pass the checks below and are not scored.
- Spans of all windows are reconciled over the whole text: equal ones add their weights, those that touch or overlap with one kind across a window's edge
  are also tried as one, each is trimmed and must pass the check of its kind, and of what is left the disjoint spans of the largest total
  weight are kept. Base spans stay; spans that overlap one are dropped.

Defined cases: a null or empty text has no span. Rows with a null id and repeated rows are rows of their own. Other columns are ignored. An empty
table gives no rows. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import io
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from toposcan.llm.common import per_process, texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
HIDDEN = 16
TRAIN_LINES, EPOCHS, SEED = 5_000, 6, 11
BATCH_WINDOWS = 2_048

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match begins where a number does: what fails from its first digit fails from the others
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern matches that pass their checks, sorted; leftmost and disjoint within a kind."""
    if not text or not _TRIGGER.search(text):
        return []
    out, past = [], 0
    at = text.find("@")
    before = -1
    while at >= 0:
        begin = max(past, before + 1)
        local = at - begin - len(text[begin:at].rstrip(_LOCAL))
        if local and (m := _DOMAIN.match(text, at + 1)):
            out.append((at - local, 0, past := m.end()))
        before, at = at, text.find("@", at + 1)
    for kind, pattern, check in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if check(m.group())]
    return sorted(out)


# ---- the network

_MARKS = "@.+-_()[]/:;,!?'\"#$%&*=<>| \n\t"
CLASSES = 8 + len(_MARKS) + 26  # pad, digit, lower, upper, other letter, other mark, other space, beginning of text; marks; the letters


def _class_table() -> np.ndarray:
    table = np.full(0x250, 5, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if "0" <= ch <= "9":
            table[c] = 1
        elif ch in _MARKS:
            table[c] = 8 + _MARKS.index(ch)
        elif "a" <= ch <= "z":
            table[c] = 8 + len(_MARKS) + ord(ch) - 97
        elif "A" <= ch <= "Z":
            table[c] = 3
        elif ch.isalpha():
            table[c] = 4
        elif ch.isspace():
            table[c] = 6
    return table


def classes(text: str) -> np.ndarray:
    """The class of every character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = per_process(("personal-data-classes",), _class_table)
    return np.where(code < len(table), table[np.minimum(code, len(table) - 1)], 4).astype(np.uint8)


TAGS = 1 + 2 * len(KINDS)  # O, then B and I of every kind
#: Transitions that BIO forbids: I of a kind after anything but B or I of that kind.
_FORBIDDEN = np.zeros((TAGS + 1, TAGS), bool)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = True
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    f = np.float32
    p = {}
    for side in "fb":
        p["e" + side] = rng.normal(0, 0.3, (CLASSES, 4 * hidden)).astype(f)
        p["e" + side][:, hidden : 2 * hidden] += 0.25  # keep what is held
        p["u" + side] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(f)
    p["w"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS)).astype(f)
    p["c"] = np.zeros(TAGS, f)
    p["t"] = np.where(_FORBIDDEN, -30, 0).astype(f)  # rows: the tag before, the last row is the start
    return p


def _lstm(x: np.ndarray, e: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (steps, rows, hidden) of classes ``x`` (steps, rows)."""
    steps, rows = x.shape
    n = u.shape[0]
    h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    out, held = np.empty((steps, rows, n), np.float32), []
    for t in range(steps):
        z = e[x[t]]
        z += h @ u
        gate = _sigmoid(z[:, : 3 * n])
        g = np.tanh(z[:, 3 * n :])
        before = c
        c = gate[:, n : 2 * n] * before + gate[:, :n] * g
        tanh_c = np.tanh(c)
        if keep:
            held.append((gate, g, before, tanh_c, h))
        h = gate[:, 2 * n :] * tanh_c
        out[t] = h
    return out, held


def _lstm_back(x: np.ndarray, u: np.ndarray, held: list, grad: np.ndarray, ge: np.ndarray, gu: np.ndarray) -> None:
    n = u.shape[0]
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        gate, g, before, tanh_c, h = held[t]
        i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tanh_c**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], 1)
        np.add.at(ge, x[t], dz)
        gu += h.T @ dz
        dh, dc = dz @ u.T, dc * f


def scores(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Tag scores (steps, rows, TAGS) of windows ``x`` (rows, steps) of classes."""
    x = np.ascontiguousarray(x.T)
    forward, _ = _lstm(x, p["ef"], p["uf"], False)
    backward, _ = _lstm(x[::-1], p["eb"], p["ub"], False)
    n = forward.shape[2]
    return forward @ p["w"][:n] + backward[::-1] @ p["w"][n:] + p["c"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(s: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the tags ``y`` (steps, rows) and its gradients by scores and transitions."""
    steps, rows, k = s.shape
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0] + t[k]
    for i in range(1, steps):
        alpha[i] = s[i] + _log_sum(alpha[i - 1][:, :, None] + t[:k], 1)
    for i in range(steps - 2, -1, -1):
        beta[i] = _log_sum(t[:k] + (s[i + 1] + beta[i + 1])[:, None, :], 2)
    whole = _log_sum(alpha[-1], 1)
    gs = np.exp(alpha + beta - whole[None, :, None])
    gt = np.zeros_like(t)
    gt[k] = gs[0].sum(0)
    for i in range(1, steps):
        gt[:k] += np.exp(alpha[i - 1][:, :, None] + t[:k] + (s[i] + beta[i])[:, None, :] - whole[:, None, None]).sum(0)
    r = np.arange(rows)
    gold = t[k, y[0]] + s[0, r, y[0]]
    np.add.at(gs, (0, r, y[0]), -1)
    np.add.at(gt, (k, y[0]), -1)
    for i in range(1, steps):
        gold = gold + t[y[i - 1], y[i]] + s[i, r, y[i]]
        gs[i, r, y[i]] -= 1
        np.add.at(gt, (y[i - 1], y[i]), -1)
    return float((whole - gold).sum()), gs, gt


def viterbi(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags (rows, steps) of scores (steps, rows, TAGS)."""
    steps, rows, k = s.shape
    best, back = s[0] + t[k], np.zeros((steps, rows, k), np.int8)
    for i in range(1, steps):
        way = best[:, :, None] + t[:k]
        back[i] = way.argmax(1)
        best = way.max(1) + s[i]
    out = np.empty((rows, steps), np.int8)
    out[:, -1] = best.argmax(1)
    for i in range(steps - 1, 0, -1):
        out[:, i - 1] = back[i, np.arange(rows), out[:, i]]
    return out


def surely_empty(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Rows for which no tag at any step can make up for leaving O: the path without a span is the best, whatever follows."""
    k = s.shape[2]
    gain = s[:, :, 1:].max(2) - s[:, :, 0] + (t.max() - min(t[0, 0], t[k, 0]))
    return (gain < 0).all(0)


# ---- labelled spans

def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _card(rng: random.Random) -> str:
    body = _digits(rng, rng.choice([13, 14, 15, 15, 15, 15, 15, 15, 17, 18]))
    return body + next(d for d in "0123456789" if luhn(body + d))


def _cut4(text: str, mark: str) -> str:
    return mark.join(text[i : i + 4] for i in range(0, len(text), 4))


def _span(rng: random.Random, kind: str) -> str:
    letters = lambda a, b: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(a, b)))
    if kind == "email":
        name = rng.choice([letters(2, 9), f"{letters(1, 7)}.{letters(2, 8)}", f"{letters(2, 8)}{_digits(rng, 2)}", f"{letters(2, 9)}.{_digits(rng, 2)}", f"{letters(2, 5)}_{letters(2, 5)}"])
        if rng.random() < 0.2:
            name = name.replace(rng.choice("aeou"), rng.choice("éüñöç"))
        host = rng.choice([letters(2, 9), f"mail{rng.randint(1, 99)}.{letters(3, 8)}", f"{letters(2, 6)}-{letters(2, 5)}"])
        out = f"{name}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'co.uk', 'io', letters(2, 3)])}"
        return out.upper() if rng.random() < 0.15 else out
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        out = _card(rng)
        return rng.choice([out, out, _cut4(out, " "), _cut4(out, "-")])
    area, a, b = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    country = rng.choice(["1", "44", "49", "33", "34", "351"])
    plain = [f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"({area}) {a} {b}", f"{area}.{a}.{b}", f"({area}){a}-{b}"]
    full = [f"+{country} ({area}) {a}-{b}", f"+{country} {area} {a} {b}", f"+{country}-{area}-{a}-{b}", f"+{country}{area}{a}{b}", f"+{country} {area}{a}{b}", f"+{country} ({area}) {a}-{b}"]
    return rng.choice(full if rng.random() < 0.6 else plain)


def _filler(rng: random.Random) -> str:
    """Words and marks that are no personal data, numbers among them."""
    kind = rng.random()
    letters = lambda a, b: "".join(rng.choices("aeiounrsthldcmpgéñüöèç" if rng.random() < 0.3 else "aeiounrsthldcmpgbfwvyk", k=rng.randint(a, b)))
    if kind < 0.72:
        word = letters(1, 10)
        word = word.capitalize() if rng.random() < 0.15 else word.upper() if rng.random() < 0.08 else word
        return word + (rng.choice([",", ".", ".\n", "!", "!!", "?", "###", "&&&", ";", ":", "$$$", ""]) if rng.random() < 0.3 else "")
    if kind < 0.78:
        return f'token = "{"".join(rng.choices("0123456789abcdef", k=rng.choice([16, 32, 40])))}"'
    return rng.choice([
        str(rng.randint(1, 9999)), _digits(rng, rng.randint(5, 9)), f"{rng.randint(0, 9)}.{rng.randint(0, 99)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 30)}",
        f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}", f"#{_digits(rng, 6)}",
        f"{rng.randint(1, 999)},{_digits(rng, 3)}", "|", "-", f"v{rng.randint(1, 20)}", f"@{letters(3, 8)}", f"{rng.randint(1, 99)}%", _digits(rng, rng.randint(20, 30)), f"${rng.randint(1, 999)}.{_digits(rng, 2)}",
    ])


def labelled_line(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of about a window and its spans ``(start, kind, end)``."""
    text, spans = "", []
    while len(text) < WINDOW:
        if rng.random() < 0.16:
            for _ in range(rng.choice([1, 1, 2, 2, 3])):  # also side by side
                kind = rng.randrange(len(KINDS))
                found = _span(rng, KINDS[kind])
                spans.append((len(text), kind, len(text) + len(found)))
                text += found + rng.choice([" ", " ", " ", " ", ", ", "; ", " / "])
            if rng.random() < 0.15:
                text = text.rstrip() + rng.choice([". ", "!! ", ".\n"])
        else:
            text += _filler(rng) + (" " if rng.random() < 0.95 else rng.choice(["\n", "", "\t"]))
    return text, spans


def _examples(rng: random.Random, lines: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((lines, WINDOW), np.uint8), np.zeros((lines, WINDOW), np.int64)
    for k in range(lines):
        text, spans = labelled_line(rng)
        at = rng.randint(0, max(0, len(text) - WINDOW)) if rng.random() < 0.5 else 0
        tags = np.zeros(len(text), np.int64)
        for start, kind, end in spans:
            tags[start:end] = 2 + 2 * kind
            tags[max(start, at)] = 1 + 2 * kind  # a span that a window cuts begins at its edge
        part = text[at : at + WINDOW]
        x[k, : len(part)], y[k, : len(part)] = classes(part), tags[at : at + len(part)]
    return x, y


def train(lines: int = TRAIN_LINES, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """Fit the network to labelled lines by stochastic gradients with per-parameter steps (Adam)."""
    rng = np.random.default_rng(seed)
    x, y = _examples(random.Random(seed), lines)
    p = initial(rng, hidden)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    size, step, total = 100, 0, epochs * (lines // 100)
    for _ in range(epochs):
        order = rng.permutation(lines)
        for first in range(0, lines - size + 1, size):
            own = order[first : first + size]
            xs, ys = np.ascontiguousarray(x[own].T), np.ascontiguousarray(y[own].T)
            forward, held_f = _lstm(xs, p["ef"], p["uf"], True)
            backward, held_b = _lstm(xs[::-1], p["eb"], p["ub"], True)
            both = np.concatenate([forward, backward[::-1]], 2)
            _, gs, gt = crf_gradient(both @ p["w"] + p["c"], p["t"], ys)
            gs = (gs / size).astype(np.float32)
            flat, gflat = both.reshape(-1, both.shape[2]), gs.reshape(-1, TAGS)
            g = {k: np.zeros_like(a) for k, a in p.items()}
            g["w"], g["c"], g["t"] = flat.T @ gflat, gflat.sum(0), np.where(_FORBIDDEN, 0, gt / size)
            gb = gs @ p["w"].T
            n = hidden
            _lstm_back(xs, p["uf"], held_f, gb[:, :, :n], g["ef"], g["uf"])
            _lstm_back(xs[::-1], p["ub"], held_b, gb[::-1, :, n:], g["eb"], g["ub"])
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def fitted(spark: SparkSession) -> dict[str, np.ndarray]:
    """The network of the default parameters: fitted once per driver process, in one task, as its thousands of small products want a single thread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            out = io.BytesIO()
            np.savez(out, **train())
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["network"])

    def load() -> dict[str, np.ndarray]:
        one = spark.range(1).coalesce(1).mapInArrow(run, "network binary").first()[0]  # some tens of KB
        return dict(np.load(io.BytesIO(bytes(one))))

    return per_process(("personal-data-network", TRAIN_LINES, EPOCHS, HIDDEN, SEED), load)


# ---- decoding and reconciling

def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], -1, 0
    for i in np.append(np.flatnonzero(tags), len(tags)).tolist():
        tag = int(tags[i]) if i < len(tags) else 0
        if start >= 0 and (tag != 2 + 2 * kind or i != past):
            out.append((start, kind, past))
            start = -1
        if tag and start < 0:
            start, kind = i, (tag - 1) // 2
        past = i + 1
    return out


_EDGE = re.compile(r"^[^0-9A-Za-z+(@À-ɏ]+|[^0-9A-Za-zÀ-ɏ]+$")
_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+\Z")
_PHONE_FORM = re.compile(r"(?:\+[0-9][\x20().0-9-]*|\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4})\Z")
_CARD_FORM = re.compile(r"[0-9](?:[\x20-]?[0-9])+\Z")
_EMAIL_GOES_ON = re.compile(r"\.?[\w@-]")
_IP_FORM = re.compile(r"[0-9]+(?:\.[0-9]+){3}\Z")


def accepted(text: str, kind: int, start: int, end: int) -> tuple[int, int] | None:
    """The trimmed span if it is whole and passes the check of its kind."""
    part = text[start:end]
    lead = _EDGE.match(part)
    start += lead.end() if lead else 0
    part = text[start:end]
    if kind == 3 and part.startswith("(") and ")" not in part:
        start, part = start + 1, part[1:]
    tail = _EDGE.search(part) if part else None
    end = start + (tail.start() if tail and tail.end() == len(part) and tail.start() else len(part))
    part = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == 0:
        ok = _EMAIL.match(part) and not re.match(r"[\w%+@-]", before) and not _EMAIL_GOES_ON.match(text, end)
    elif after.isdigit() or before.isdigit():
        ok = False  # a piece of a longer number
    elif kind == 1:
        ok = _IP_FORM.match(part) and is_ip(part)
    elif kind == 2:
        ok = _CARD_FORM.match(part) and is_card(part)
    else:
        ok = _PHONE_FORM.match(part) and is_phone(part) and not before.isalpha() and not after.isalpha()
    return (start, end) if ok else None


def reconcile(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the accepted, disjoint spans of the largest total weight among ``found`` (start, kind, end, weight), sorted."""
    votes: dict[tuple[int, int, int], float] = {}
    for start, kind, end, weight in sorted(found):
        votes[start, kind, end] = votes.get((start, kind, end), 0.0) + weight
    joined, reach = dict(votes), {}
    for (start, kind, end), weight in sorted(votes.items()):
        first, past, sum_ = reach.get(kind, (0, -1, 0.0))
        if start <= past:  # goes on across the edge of a window
            reach[kind] = (first, max(past, end), sum_ + weight)
            joined.setdefault((first, kind, max(past, end)), sum_ + weight)
        else:
            reach[kind] = (start, end, weight)
    taken = sorted((s, e) for s, _, e in base)
    past_of = np.maximum.accumulate([e for _, e in taken]) if taken else []
    free: dict[tuple[int, int, int], float] = {}
    for (start, kind, end), weight in joined.items():
        if span := accepted(text, kind, start, end):
            k = bisect_right(taken, (span[1] - 1, len(text) + 1))
            if not k or past_of[k - 1] <= span[0]:
                key = (span[1], span[0], kind)
                free[key] = max(free.get(key, 0.0), weight)
    rows = sorted(free.items())
    ends, best = [r[0][0] for r in rows], [(0.0, None)]
    for k, ((end, start, kind), weight) in enumerate(rows):  # the best choice among the spans that end first
        j = bisect_right(ends, start, 0, k)
        best.append(max((best[j][0] + weight, (j, k)), best[k] if best[k][1] is not None or k else (0.0, None), key=lambda x: x[0]))
    out, k = [], len(rows)
    while k:
        total, way = best[k]
        if way is None:
            break
        j, own = way
        (end, start, kind), _ = rows[own]
        out.append((start, kind, end))
        k = j
    return sorted([*base, *out])


def decode(p: dict[str, np.ndarray], bodies: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Spans (start, kind, end, weight) of every window of every text."""
    out: list[list] = [[] for _ in bodies]
    held: list[tuple[int, int, np.ndarray]] = []

    def told() -> None:
        if not held:
            return
        x = np.zeros((len(held), WINDOW), np.uint8)
        for k, (_, _, part) in enumerate(held):
            x[k, : len(part)] = part
        s = scores(p, x)
        rest = np.flatnonzero(~surely_empty(s, p["t"]))
        tags = viterbi(s[:, rest], p["t"]) if len(rest) else []
        for k, row in zip(rest.tolist(), tags):
            doc, begin, part = held[k]
            for start, kind, end in _spans_of(row[: len(part)]):
                own = s[start:end, k]
                margin = own[:, 1 + 2 * kind : 3 + 2 * kind].max(1) - own[:, 0]
                out[doc].append((begin + start, kind, begin + end, float(max(margin.sum(), 1e-3))))
        held.clear()

    for doc, text in enumerate(bodies):
        code, done, last = None, -1, len(range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)) - 1
        for m in _TRIGGER.finditer(text):
            first = max(0, -((WINDOW - 1 - m.start()) // STRIDE))  # the windows that hold this character
            for w in range(max(first, done + 1), min(m.start() // STRIDE, last) + 1):
                code = classes(text) if code is None else code
                held.append((doc, w * STRIDE, code[w * STRIDE : w * STRIDE + WINDOW]))
                done = w
                if len(held) >= BATCH_WINDOWS:
                    told()
    told()
    return out


def spans(p: dict[str, np.ndarray], bodies: list[str | None]) -> list[tuple[list, list]]:
    """(base, all) spans of every text."""
    base = [base_spans(t) for t in bodies]
    asked = [k for k, t in enumerate(bodies) if t and _TRIGGER.search(t)]
    out = [(b, b) for b in base]
    for k, found in zip(asked, decode(p, [bodies[k] for k in asked])):
        if found:
            out[k] = (base[k], reconcile(bodies[k], found, base[k]))
    return out


def find(docs: DataFrame, p: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``id, base, spans`` of every row: arrays of (kind, start, end), ordered by start and kind."""
    p = p or fitted(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda rows: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in rows]
        for batch in batches:
            found = spans(p, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([told(b) for b, _ in found], kind), pa.array([told(a) for _, a in found], kind)], ["id", "base", "spans"])

    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    return texts(docs).mapInArrow(run, f"id long, base {item}, spans {item}")
