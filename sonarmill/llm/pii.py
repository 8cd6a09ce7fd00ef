"""Personal data: fixed patterns, and further spans by a character BiLSTM with a CRF.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these
spans always stay. A bidirectional LSTM over character classes with CRF
transitions, trained in numpy from labelled spans, adds spans that no pattern
describes (an address with "(at)", a phone number without "+").

Training windows come from the documents (a sample of at most ``max_windows``,
labelled by the patterns) and from a seeded generator of written variants and of
look-alikes that are no personal data.

A span must hold a digit or an at-sign, in a sign or in letters, so only the
stretches round these are decoded; this loses nothing. No span cuts a run of digits
in two, and runs of more than ``LONGEST`` digits are decoded at their ends only. A stretch's place depends
on the signs, not on a grid, so a span is read alike wherever it lies. A decoded
span that comes near an end of its stretch (other than the text's own) is decoded
again with as much text on both sides as it is long, until it ends inside;
there is no greatest length. Spans that touch a pattern's span, or that fail
their kind's plausibility check, are dropped; of overlapping ones the first, then
the longest, is kept.

Nulls and empty texts have no spans. Repeated rows are treated alike; extra
columns are ignored; an empty table trains on the generator alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns.
#: A run that fails from its start fails from everywhere inside, so only starts of runs are tried: linear in the text.
EMAIL_HERE = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL = re.compile(EMAIL_HERE)
EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL_HERE)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOUBTFUL = re.compile(r"[(+]?[0-9](?:[() ./-]{0,2}[0-9]){7,}|[(\[][Aa][Tt][)\]]|\[\.\]")
DIGIT = re.compile(r"[0-9]")
GATE = re.compile(r"[0-9]+|@|[(\[ ][Aa][Tt][)\] ]")

SPAN, MIDDLE, AROUND, LONGEST = 96, 24, 40, 384
HIDDEN = 16
MAX_WINDOWS = 1200
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

_CLASSES = "@.+-()[]_%/:,;=|#*'\"!?&\n "
N_CLASSES = 6 + len(_CLASSES)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; one may begin where the last one ended, inside a run."""
    out, m = [], EMAIL_NEXT.search(text)
    while m:
        out.append(m.span())
        m = EMAIL.match(text, m.end()) or EMAIL_NEXT.search(text, m.end())
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its check."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def plausible(kind: str, s: str) -> bool:
    """What a span must hold to be taken for its kind, whatever the model says."""
    digits = "".join(DIGIT.findall(s))
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+", s, re.I))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return bool(re.fullmatch(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|\(\.\))[0-9]{1,3}){3}", s)) and all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9 ._/-]+[0-9]", s))
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"\(?[+0-9][0-9() ./-]+[0-9]", s)) and (bool(re.search(r"\([0-9]+\)", s)) or len(re.findall(r"[ ./-]", s)) >= 2)


def classes_of(text: str) -> np.ndarray:
    """Character classes: special characters, digits, lower and upper letters, other letters, other."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.full(len(code), 4, np.uint8)
    plain = code < 128
    out[~plain] = 3
    out[plain] = _TABLE[code[plain]]
    return out


_TABLE = np.full(128, 4, np.uint8)
_TABLE[48:58], _TABLE[97:123], _TABLE[65:91] = 0, 1, 2
for _k, _c in enumerate(_CLASSES):
    _TABLE[ord(_c)] = 5 + _k
PAD = N_CLASSES - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Embedding-free BiLSTM (a class picks its row of input weights), linear emissions, CRF."""

    def __init__(self, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        h, t = HIDDEN, TAGS
        self.p = {
            **{f"w{d}": rng.normal(0, 0.3, (N_CLASSES, 4 * h)).astype(np.float32) for d in "fb"},
            **{f"u{d}": rng.normal(0, 0.25, (h, 4 * h)).astype(np.float32) for d in "fb"},
            **{f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32) for d in "fb"},
            "out": rng.normal(0, 0.3, (2 * h, t)).astype(np.float32),
            "bias": np.zeros(t, np.float32),
            "trans": np.zeros((t, t), np.float32),
        }
        #: An I follows only a B or I of its kind.
        self.barred = np.zeros((t, t), np.float32)
        for k in range(len(KINDS)):
            self.barred[[j for j in range(t) if j not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e4

    def _run(self, x: np.ndarray, d: str, keep: bool):
        n, steps = x.shape
        h = HIDDEN
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, memory = np.empty((steps, n, h), np.float32), []
        w, u = self.p[f"w{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
        for t in range(steps):
            z = w[x[:, t]] + state @ u
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            tc = np.tanh(cell)
            if keep:
                memory.append((i, f, o, g, before, tc, state))
            state = o * tc
            out[t] = state
        return out, memory

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, mf = self._run(x, "f", keep)
        backward, mb = self._run(x[:, ::-1], "b", keep)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, mf, mb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequences (Viterbi), one row a window."""
        e = self.emissions(x)[0]
        steps, n, _ = e.shape
        trans = self.p["trans"] + self.barred
        score = e[0] + np.where(np.arange(TAGS) % 2 == 0, -1e4, 0) * (np.arange(TAGS) > 0)
        back = np.empty((steps, n, TAGS), np.uint8)
        for t in range(1, steps):
            total = score[:, :, None] + trans[None]
            back[t] = total.argmax(axis=1)
            score = total.max(axis=1) + e[t]
        tags = np.empty((n, steps), np.uint8)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Negative log-likelihood a window, and its gradients."""
        e, both, mf, mb = self.emissions(x, keep=True)
        steps, n, _ = e.shape
        trans = self.p["trans"] + self.barred
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            total = alpha[t - 1][:, :, None] + trans[None]
            top = total.max(axis=1)
            alpha[t] = top + np.log(np.exp(total - top[:, None]).sum(axis=1)) + e[t]
        for t in range(steps - 2, -1, -1):
            total = trans[None] + (e[t + 1] + beta[t + 1])[:, None, :]
            top = total.max(axis=2)
            beta[t] = top + np.log(np.exp(total - top[:, :, None]).sum(axis=2))
        top = alpha[-1].max(axis=1)
        log_z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
        de = np.exp(np.minimum(alpha + beta - log_z[None, :, None], 0))
        gold = np.eye(TAGS, dtype=np.float32)[y.T]
        loss = float((log_z - (e * gold).sum(axis=(0, 2)) - trans[y[:, :-1], y[:, 1:]].sum(axis=1)).mean())
        pair = alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - log_z[:, None, None]
        dtrans = np.exp(np.minimum(pair, 0)).sum(axis=(0, 1))
        np.subtract.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de = (de - gold) / n
        grads = {"trans": dtrans / n, "out": np.tensordot(both, de, ([0, 1], [0, 1])), "bias": de.sum(axis=(0, 1))}
        dboth = de @ self.p["out"].T
        for d, dh, memory, xs in (("f", dboth[:, :, :HIDDEN], mf, x), ("b", dboth[::-1, :, HIDDEN:], mb, x[:, ::-1])):
            u = self.p[f"u{d}"]
            dw, du = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u)
            later, dcell = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            one_hot = np.eye(N_CLASSES, dtype=np.float32)[xs]
            for t in range(steps - 1, -1, -1):
                i, f, o, g, before, tc, state = memory[t]
                ds = dh[t] + later
                dcell = dcell + ds * o * (1 - tc * tc)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), ds * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                dw += one_hot[:, t].T @ dz
                du += state.T @ dz
                later, dcell = dz @ u.T, dcell * f
            grads |= {f"w{d}": dw, f"u{d}": du, f"c{d}": dw.sum(axis=0)}
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 96, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over random batches; the rate falls to a tenth, and the parameters end as the mean of the last third."""
        rng = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss, late = 0.0, max(1, steps // 3)
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            loss, grads = self.gradients(x[rows], y[rows])
            lr = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = np.clip(g, -1, 1).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
                if step > steps - late:
                    mean[k] += self.p[k] / late
        self.p = mean
        return loss


def window_of(text: str, spans: dict[str, list[tuple[int, int]]], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of the window that starts at ``start``, padded."""
    x, y = np.full(SPAN, PAD, np.uint8), np.zeros(SPAN, np.uint8)
    part = classes_of(text[start : start + SPAN])
    x[: len(part)] = part
    for k, kind in enumerate(KINDS):
        for a, b in spans[kind]:
            if a < start + SPAN and b > start:
                y[max(0, a - start) : b - start] = 2 + 2 * k
                if a >= start:
                    y[a - start] = 1 + 2 * k
                elif b > start:
                    y[0] = 1 + 2 * k  # the window opens inside a span
    return x, y


def generated(n: int = 4000, seed: int = 3) -> list[tuple[str, dict[str, list[tuple[int, int]]]]]:
    """Short texts with labelled variants of each kind, and look-alikes without a label."""
    rng = np.random.Generator(np.random.PCG64(seed))

    def some(alphabet: str, lo: int, hi: int) -> str:
        return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(lo, hi + 1)))

    letters, digits = "abcdefghijklmnopqrstuvwxyzéüñ"[:26], "0123456789"

    def word() -> str:
        w = some(letters, 1, 9)
        return w.capitalize() if rng.random() < 0.2 else w

    def pick(options: list[str]) -> str:
        return options[int(rng.integers(0, len(options)))]

    def email() -> str:
        at, dot = pick(["@"] * 3 + [" (at) ", "(at)", " [at] ", " at "]), "."
        if at != "@" and rng.random() < 0.6:
            dot = pick([" dot ", " (dot) ", "[dot]"])
        return some(letters, 2, 9) + pick(["", "." + some(digits, 1, 3), "." + some(letters, 2, 6), "_" + some(digits, 1, 2)]) + at + some(letters + digits, *((20, 80) if rng.random() < 0.1 else (3, 8))) + dot + pick(["example.com", "com", "org", "net"])

    def ip() -> str:
        return pick(["."] * 3 + [" . ", "[.]"]).join(str(int(k)) for k in rng.integers(0, 256, 4))

    def card() -> str:
        body = some(digits, 15, 15)
        full = next(body + c for c in digits if luhn(body + c))
        return pick([" ", "-", "", ".", "/"]).join(full[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        made = number()
        while not plausible("phone", made):
            made = number()
        return made

    def number() -> str:
        sep = pick([" ", "-", ".", "/"])
        tail = sep.join([some(digits, 3, 3), some(digits, 3, 4), *([some(digits, 2, 4)] if rng.random() < 0.5 else [])])
        return pick(["+" + some(digits, 1, 2) + sep, "+" + some(digits, 1, 2) + " ", "", "(" + some(digits, 3, 3) + ") ", "0" + some(digits, 2, 3) + sep]) + tail

    def unlike() -> str:
        return pick([some(digits, 1, 4), "v" + ".".join(map(str, rng.integers(0, 20, 3))), f"{rng.integers(1, 3000)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", "$" + some(digits, 1, 4) + "." + some(digits, 2, 2), some("0123456789abcdef", 12, 24), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), some(digits, 1, 2) + "%", some(digits, 1, 3) + "," + some(digits, 3, 3), "CC BY-NC 4.0", f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}", some(digits, 1, 2) + "/" + some(digits, 1, 2), word() + "@" + word(), "at " + word(), "p. " + some(digits, 1, 3), some(digits, 5, 6), "password=" + some("0123456789abcdef", 18, 18)])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.integers(0, 7))), {k: [] for k in KINDS}
        for _ in range(rng.integers(1, 3)):
            text += pick([" ", " ", ": ", "\n", ", "])
            kind = pick([*KINDS, "none", "none"])
            made = unlike() if kind == "none" else makers[kind]()
            if kind != "none":
                spans[kind].append((len(text), len(text) + len(made)))
            text += made + pick(["", ".", ",", ""]) + " " + " ".join(word() for _ in range(rng.integers(0, 6)))
        out.append((text, spans))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most two windows a text: round its first pattern span, and at its first digit.

    Windows that hold what may be personal data in a form without a pattern would teach that it is none; they are left out.
    """
    for batch in batches:
        xs, ys = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            first = min((a for s in spans.values() for a, _ in s), default=None)
            number = GATE.search(text or "")
            for at in {first, number.start() if number else None} - {None}:
                start = max(0, at - SPAN // 3)
                if any(not any(a < start + m.end() and b > start + m.start() for s in spans.values() for a, b in s) for m in DOUBTFUL.finditer(text[start : start + SPAN])):
                    continue
                x, y = window_of(text, spans, start)
                xs.append(x.tobytes())
                ys.append(y.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])


def learn(docs: DataFrame, max_windows: int = MAX_WINDOWS) -> Network:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = docs.count()
    share = int(1_000_000 * min(1.0, 20 * max_windows / max(n, 1))) + 1
    sample = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < share)
    got = sample.select("text").mapInArrow(_windows, "x binary, y binary").distinct().orderBy(F.xxhash64("x"), "x").limit(max_windows).collect()
    made = [window_of(t, s, 0) for t, s in generated()]
    x = np.array([np.frombuffer(r["x"], np.uint8) for r in got] + [m[0] for m in made])
    y = np.array([np.frombuffer(r["y"], np.uint8) for r in got] + [m[1] for m in made])
    network = Network()
    network.train(x, y)
    return network


def _size(length: int) -> int:
    return -(-max(length, 1) // SPAN) * SPAN


def stretches(text: str) -> list[tuple[int, int]]:
    """(start, size) of what is decoded: AROUND characters on both sides of every digit and at-sign.

    Starts depend on the signs, not on their places in the text. Sizes are
    multiples of SPAN; stretches that meet are one, and one longer than LONGEST is
    dealt to overlapping parts.
    """
    joint: list[list[int]] = []
    for m in GATE.finditer(text):
        a, b = m.span()
        # Inside a very long run of digits no span begins or ends.
        for a, b in [(a, b)] if b - a <= LONGEST else [(a, a + 1), (b - 1, b)]:
            start, end = max(0, a - AROUND), b + AROUND
            if joint and start < joint[-1][0] + _size(joint[-1][1] - joint[-1][0]):
                joint[-1][1] = end
            else:
                joint.append([start, end])
    out = []
    for start, end in joint:
        while end - start > LONGEST:
            out.append((start, LONGEST))
            start += LONGEST - SPAN
        out.append((start, _size(end - start)))
    return out


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first < out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


class Finder:
    """Pattern spans and the network's spans of many texts at once."""

    BATCH = 512

    def __init__(self, network: Network):
        self.network = network

    def spans(self, texts: list[str]) -> list[tuple[dict, dict]]:
        """(pattern spans, added spans) of each text."""
        base = [base_spans(t) for t in texts]
        candidates: list[set[tuple[int, int, int]]] = [set() for _ in texts]
        todo = [(k, a, size, None) for k, t in enumerate(texts) for a, size in stretches(t)]
        while todo:
            cut: dict[int, list[tuple[int, int]]] = {}
            by_size: dict[int, list[tuple]] = {}
            for item in todo:
                by_size.setdefault(item[2], []).append(item)
            for size, items in sorted(by_size.items()):
                rows = max(1, self.BATCH * SPAN // size)
                for at in range(0, len(items), rows):
                    part = items[at : at + rows]
                    x = np.full((len(part), size), PAD, np.uint8)
                    for r, (k, start, _, _) in enumerate(part):
                        c = classes_of(texts[k][start : start + size])
                        x[r, : len(c)] = c
                    tags = self.network.decode(x)
                    for r in np.flatnonzero(tags.any(axis=1)):
                        k, start, _, target = part[r]
                        self._read(texts[k], start, tags[r], target, base[k], candidates[k], cut.setdefault(k, []))
            todo = []
            for k, runs in cut.items():
                for first, last in _merged(runs):
                    more = max(SPAN // 2, last - first)
                    start = max(0, first - more)
                    todo.append((k, start, _size(min(last + more, len(texts[k])) - start), (first, last)))
        added = []
        for found, own in zip(candidates, base, strict=True):
            taken: list[tuple[int, int]] = [s for spans in own.values() for s in spans]
            kept: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
            for first, minus, kind in sorted((a, -b, k) for a, b, k in found):
                if not any(first < e and -minus > s for s, e in taken):
                    taken.append((first, -minus))
                    kept[KINDS[kind]].append((first, -minus))
            added.append(kept)
        return list(zip(base, added, strict=True))

    @staticmethod
    def _read(text: str, start: int, tags: np.ndarray, target: tuple[int, int] | None, base: dict, candidates: set, cut: list) -> None:
        """Whole spans of a stretch go to ``candidates``, runs near an inner end of it to ``cut``."""
        size = len(tags)
        for a in np.flatnonzero(tags % 2 == 1).tolist():
            kind, b = (int(tags[a]) - 1) // 2, a + 1
            while b < size and tags[b] == tags[a] + 1:
                b += 1
            first, last = start + a, min(start + b, len(text))
            if first >= last or (target and not (first < target[1] and last > target[0])):
                continue
            if any(first < e and last > s for found in base.values() for s, e in found):
                continue
            if (start and a < MIDDLE) or (start + size < len(text) and b > size - MIDDLE):
                cut.append((first, last))
                continue
            while last > first and text[last - 1] in " .,;:-/\n":
                last -= 1
            if any(0 < at < len(text) and text[at - 1].isdigit() and text[at].isdigit() for at in (first, last)):
                continue  # no span cuts a number in two
            if plausible(KINDS[kind], text[first:last]):
                candidates.add((first, last, kind))


def _found(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(network)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = finder.spans(texts)
                counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
                both = [{k: b[k] + a[k] for k in KINDS} for b, a in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]), pa.array([joined(s) for s in both], pa.string()), pa.array([sum(map(len, a.values())) for _, a in found], pa.int64()), pa.array([sum(map(len, s.values())) for s in both], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"],
                )

    return run


def find(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, counts of pattern spans, digest of these, all spans, how many the network added, and how many there are."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_found(network), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, wins."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b  # the rest of an overlapping span goes with the first
    return "".join([*out, text[at:]])


def _redacted(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(network)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.schema.get_field_index("text")
                texts = part.column(column).to_pylist()
                new = []
                for t, (b, a) in zip(texts, finder.spans([t or "" for t in texts]), strict=True):
                    spans = [(k, s, e) for k in KINDS for s, e in b[k] + a[k]]
                    new.append(redacted_text(t, spans) if spans else t)
                yield part.set_column(column, part.schema.field(column), pa.array(new, part.schema.field(column).type))

    return run


def redact(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; other columns as they are."""
    return docs.mapInArrow(_redacted(network), docs.schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, learn(docs))
