"""Personal data: base rules, and a character BiLSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import documents, id_text, map_batches
from workload.registry import query

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# No kind can occur without one of these, written out or not; stretches of text around them are read.
TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.IGNORECASE)
CONTEXT = 48
WINDOW, STRIDE = 64, 32
# Longest stretch worked off at once; longer ones are cut with an overlap, in which both parts see the same.
LONGEST, OVERLAP = 8192, 192
# Labelled stretches the network is fitted on, the smallest by a hash of their text.
SAMPLE = 1500
# Share of added spans that must be right on held-out stretches, of which there must be so many.
PRECISION, HELD = 0.97, 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match at a later digit of a run fails like the first
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, in time linear in the text: from each @ to both sides."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind and start."""
    if not TRIGGER.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text within ``CONTEXT`` characters of a trigger, long ones cut with an overlap."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(k, min(k + LONGEST, b)) for a, b in out for k in range(a, max(a + 1, b - OVERLAP), LONGEST - OVERLAP)]


# -- labels the rules do not see ------------------------------------------------------------


def altered(kind: str, text: str, rnd: random.Random) -> str:
    """A span as people also write it, so that no base rule finds it whole."""
    if kind == "email":
        user, _, domain = text.partition("@")
        at, dot = rnd.choice([(" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), (" @ ", "."), ("(at)", " dot ")])
        return user + at + domain.replace(".", dot)
    if kind == "ip":
        return text.replace(".", rnd.choice([" . ", "[.]", "(.)", ". "]))
    if kind == "card":
        digits = re.sub("[^0-9]", "", text)
        parts = [digits[k:k + 4] for k in range(0, len(digits), 4)]
        return rnd.choice([".", "/", " - ", "  ", "_"]).join(parts)
    digits = re.sub("[^0-9]", "", text)
    return rnd.choice(["00" + digits, f"00{digits[:2]} {digits[2:5]} {digits[5:]}", f"({digits[:3]}) {digits[3:6]}/{digits[6:]}", text.replace(" ", "/").replace("-", "/"), text[1:]])


def taught(labelled: list[tuple[str, list[Span]]], seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Each stretch with spans a second time with its spans altered, and a third time with another span run on to one.

    Rules label what they find; the copies are labelled by how they were made, so the network
    learns what rules miss.  Stretches without spans teach what is none.
    """
    rnd = random.Random(seed)
    pool = [(k, t[a:b]) for t, spans in labelled for k, a, b in spans]
    out = list(labelled)
    for text, spans in labelled:
        spans = sorted(spans, key=lambda s: s[1])
        if not spans or any(x[2] > y[1] for x, y in zip(spans, spans[1:])):
            continue
        for run_on in (False, True):
            made, marks, done = "", [], 0
            for kind, a, b in spans:
                made += text[done:a]
                pieces = [(kind, text[a:b])] if run_on else [(kind, altered(kind, text[a:b], rnd))]
                if run_on and kind == "phone":
                    pieces.append(rnd.choice([p for p in pool if p[0] in ("phone", "card", "ip")]))
                for n, (k, piece) in enumerate(pieces):
                    made += " " * (n > 0)
                    marks.append((k, len(made), len(made) + len(piece)))
                    made += piece
                done = b
            if not run_on or len(marks) > len(spans):
                out.append((made + text[done:], marks))
    return out


# -- the network ---------------------------------------------------------------------------

EMBED, HIDDEN, CLASSES = 12, 16, 100
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
FORBIDDEN = np.zeros((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    FORBIDDEN[:, 2 + 2 * _k] = True
    FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False


def classes_of(text: str) -> np.ndarray:
    """Class of each character: printable ASCII its own, then white space, other letters, anything else; 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((codes > 32) & (codes < 127), codes - 31, 0).astype(np.int64)
    for i in np.flatnonzero(out == 0).tolist():
        c = text[i]
        out[i] = 96 if c.isspace() else 97 if c.isalpha() else 98
    return out


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if 0 <= a < b <= length and not tags[a:b].any():
            k = KINDS.index(kind)
            tags[a:b], tags[a] = 2 + 2 * k, 1 + 2 * k
    return tags


def cut_windows(length: int) -> list[int]:
    """Starts of overlapping windows that cover a stretch."""
    return list(range(0, max(1, length - WINDOW + STRIDE), STRIDE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    embed: np.ndarray  # (CLASSES, EMBED)
    into: np.ndarray   # (2, EMBED, 4 * HIDDEN): forwards and backwards
    over: np.ndarray   # (2, HIDDEN, 4 * HIDDEN)
    bias: np.ndarray   # (2, 1, 4 * HIDDEN)
    out: np.ndarray    # (2 * HIDDEN, TAGS)
    free: np.ndarray   # (TAGS,)
    move: np.ndarray   # (TAGS, TAGS): CRF transitions
    least: float = 2.0  # mean probability of its tags from which on a span is added: none until held-out spans set it

    @staticmethod
    def fresh(seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        def make(*s): return rng.normal(0, 0.2, s)
        return Tagger(make(CLASSES, EMBED), make(2, EMBED, 4 * HIDDEN), make(2, HIDDEN, 4 * HIDDEN),
                      np.zeros((2, 1, 4 * HIDDEN)), make(2 * HIDDEN, TAGS), np.zeros(TAGS), np.zeros((TAGS, TAGS)))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.into, self.over, self.bias, self.out, self.free, self.move]

    def run(self, chars: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Emissions (window, place, tag) of windows (window, place); both directions step together."""
        n, length = chars.shape
        both = np.stack((chars, chars[:, ::-1]))
        table = np.einsum("ve,kef->kvf", self.embed, self.into) + self.bias
        h, c = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
        states = np.zeros((2, n, length, HIDDEN))
        for t in range(length):
            x = both[:, :, t]
            z = np.stack((table[0][x[0]], table[1][x[1]])) + h @ self.over
            gates = sigmoid(z[..., :3 * HIDDEN])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN:2 * HIDDEN], gates[..., 2 * HIDDEN:]
            g = np.tanh(z[..., 3 * HIDDEN:])
            if trace is not None:
                trace.append((x, h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            states[:, :, t] = h
        joined = np.concatenate((states[0], states[1][:, ::-1]), axis=2)
        if trace is not None:
            trace.append(joined)
        return joined @ self.out + self.free

    def moves(self) -> np.ndarray:
        return np.where(FORBIDDEN, -1e4, self.move)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(model: Tagger, chars: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tag sequences and its gradient, by back-propagation through time."""
    n, length = chars.shape
    trace: list = []
    emit, move = model.run(chars, trace), model.moves()
    joined = trace.pop()
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    start = np.zeros(TAGS)
    start[2::2] = -1e4  # nothing begins inside
    ahead[:, 0] = emit[:, 0] + start
    for t in range(1, length):
        ahead[:, t] = emit[:, t] + log_sum(ahead[:, t - 1, :, None] + move, 1)
    for t in range(length - 2, -1, -1):
        back[:, t] = log_sum(move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = log_sum(ahead[:, -1], 1)
    rows, places = np.arange(n)[:, None], np.arange(length)
    gold = emit[rows, places, tags].sum(axis=1) + move[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    d_emit = np.exp(ahead + back - total[:, None, None])
    pairs = np.zeros((TAGS, TAGS))
    for t in range(1, length):
        pairs += np.exp(ahead[:, t - 1, :, None] + move + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None]).sum(axis=0)
    np.add.at(pairs, (tags[:, :-1], tags[:, 1:]), -1.0)
    d_emit[rows, places, tags] -= 1
    d_emit /= n
    d_out = np.einsum("ntf,ntk->fk", joined, d_emit)
    d_joined = d_emit @ model.out.T
    d_states = np.stack((d_joined[..., :HIDDEN], d_joined[:, ::-1, HIDDEN:]))
    d_table, d_over = np.zeros((2, CLASSES, 4 * HIDDEN)), np.zeros_like(model.over)
    dh, dc = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
    for t in range(length - 1, -1, -1):
        x, h, c, i, f, o, g = trace[t]
        now = f * c + i * g
        tanh = np.tanh(now)
        dh = dh + d_states[:, :, t]
        dc = dc + dh * o * (1 - tanh ** 2)
        dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g ** 2)), axis=2)
        d_over += np.einsum("knh,knf->khf", h, dz)
        for k in (0, 1):
            np.add.at(d_table[k], x[k], dz[k])
        dh, dc = dz @ model.over.transpose(0, 2, 1), dc * f
    d_into = np.einsum("ve,kvf->kef", model.embed, d_table)
    d_embed = np.einsum("kvf,kef->ve", d_table, model.into)
    grads = [d_embed, d_into, d_over, d_table.sum(axis=1, keepdims=True), d_out, d_emit.sum(axis=(0, 1)), np.where(FORBIDDEN, 0, pairs / n)]
    return float((total - gold).mean()), grads


def fit(labelled: list[tuple[str, list[Span]]], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Tagger:
    """A tagger fitted with Adam on texts and their spans, cut to windows."""
    model, rng = Tagger.fresh(seed), np.random.default_rng(seed)
    chars, tags = [], []
    for text, spans in labelled:
        codes, marks = classes_of(text), tags_of(len(text), spans)
        for a in cut_windows(len(text)):
            part = slice(a, a + WINDOW)
            pad = WINDOW - len(codes[part])
            chars.append(np.pad(codes[part], (0, pad)))
            tags.append(np.pad(marks[part], (0, pad)))
            k = tags[-1][0]
            if k and k % 2 == 0:  # a span cut by the window's edge begins there
                tags[-1][0] = k - 1
    if not chars:
        return model
    x, y = np.array(chars), np.array(tags)
    first, second = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()]
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            steps += 1
            pick = order[at:at + batch]
            _, grads = gradient(model, x[pick], y[pick])
            size = np.sqrt(sum(float((g ** 2).sum()) for g in grads))
            for p, g, m, v in zip(model.parameters(), grads, first, second):
                g = g * min(1.0, 5.0 / (size + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g ** 2 - v)
                p -= rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)
    return model


def emissions(model: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Emissions of whole stretches: overlapping windows are read apart and averaged, the middle of a window counting most."""
    cuts = [cut_windows(len(t)) for t in texts]
    codes = [classes_of(t) for t in texts]
    windows = [np.pad(c[a:a + WINDOW], (0, WINDOW - len(c[a:a + WINDOW]))) for c, cut in zip(codes, cuts) for a in cut]
    found = np.concatenate([model.run(np.array(windows[k:k + 512])) for k in range(0, len(windows), 512)]) if windows else None
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
    out, at = [], 0
    for text, cut in zip(texts, cuts):
        total, sums = np.zeros((len(text) + WINDOW, TAGS)), np.zeros((len(text) + WINDOW, 1))
        for a in cut:
            total[a:a + WINDOW] += weight * found[at]
            sums[a:a + WINDOW] += weight
            at += 1
        out.append(total[:len(text)] / sums[:len(text)])
    return out


def decode(model: Tagger, emit: list[np.ndarray]) -> list[np.ndarray]:
    """The best tag sequence of each stretch as a whole, all stretches stepping together."""
    move = model.moves()
    sizes = np.array([len(e) for e in emit])
    order = np.argsort(-sizes, kind="stable")
    length = int(sizes.max(initial=0))
    active = [int((sizes > t).sum()) for t in range(length)]
    value = np.array([emit[i][0] for i in order]) if length else np.zeros((0, TAGS))
    value[:, 2::2] -= 1e4
    came: list[np.ndarray] = []
    for t in range(1, length):
        m = active[t]
        paths = value[:m, :, None] + move
        came.append(paths.argmax(axis=1))
        value[:m] = paths.max(axis=1) + np.array([emit[i][t] for i in order[:m]])
    at = value.argmax(axis=1)
    out = [np.zeros(len(e), np.int64) for e in emit]
    for t in range(length - 1, -1, -1):
        for r in range(active[t]):
            out[order[r]][t] = at[r]
        if t:
            at[:active[t]] = came[t - 1][np.arange(active[t]), at[:active[t]]]
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a span could be of its kind at all."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        return re.search(r"@|\bat\b", text, re.IGNORECASE) is not None and re.search(r"\.|\bdot\b", text, re.IGNORECASE) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 17


def candidates(model: Tagger, text: str, parts: list[tuple[int, int]], emit: list[np.ndarray], paths: list[np.ndarray], base: list[Span]) -> list[tuple[float, Span]]:
    """(mean probability, span) of what the network found clear of every base span."""
    taken = sorted((a, b) for _, a, b in base)
    out: dict[Span, float] = {}
    for (start, end), e, path in zip(parts, emit, paths):
        share = np.exp(e - log_sum(e, 1)[:, None])[np.arange(len(path)), path]
        for a in np.flatnonzero(path % 2 == 1).tolist():
            b = a + 1
            while b < len(path) and path[b] == path[a] + 1:
                b += 1
            kind, s, t = KINDS[int(path[a] - 1) // 2], start + a, start + b
            # what a cut goes through, the part beside it sees whole
            cut = (s == start and start > 0) or (t == end and end < len(text))
            if not cut and plausible(kind, text[s:t]) and not any(x < t and s < y for x, y in taken):
                out[kind, s, t] = max(out.get((kind, s, t), 0.0), float(share[a:b].mean()))
    return [(p, span) for span, p in out.items()]


def read(model: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[tuple[float, Span]]]:
    """``candidates`` of each text; some stretches at a time, so that memory does not grow with a text."""
    out: list[list[tuple[float, Span]]] = [[] for _ in texts]
    waiting: list[tuple[int, tuple[int, int]]] = []
    size = 0

    def work() -> None:
        emit = emissions(model, [texts[k][a:b] for k, (a, b) in waiting])
        for (k, part), e, path in zip(waiting, emit, decode(model, emit)):
            out[k] += candidates(model, texts[k], [part], [e], [path], base[k])
        waiting.clear()

    for k, text in enumerate(texts):
        for part in stretches(text):
            waiting.append((k, part))
            size += part[1] - part[0]
            if size > 4 * LONGEST:
                work()
                size = 0
    if waiting:
        work()
    return out


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind as listed and start."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = [base_spans(t) for t in texts]
    out = []
    for found, more in zip(base, read(model, texts, base)):
        added: list[Span] = []
        for p, span in sorted(more, key=lambda m: (-m[0], m[1][1:])):  # the surer of two that overlap
            if p >= model.least and not any(a < span[2] and span[1] < b for _, a, b in added):
                added.append(span)
        out.append((found, sorted(found + added, key=lambda s: (order[s[0]], s[1], s[2]))))
    return out


def found_spans(model: Tagger, held: list[tuple[str, list[Span]]]) -> list[tuple[float, bool]]:
    """(mean probability, whether it is labelled) of every candidate in held-out stretches."""
    texts = [t for t, _ in held]
    base = [base_spans(t) for t in texts]
    return [(p, span in spans) for (_, spans), more in zip(held, read(model, texts, base)) for p, span in more]


def with_threshold(model: Tagger, held: list[tuple[str, list[Span]]]) -> Tagger:
    """The model with the least probability at which ``PRECISION`` of the added spans are right on held-out stretches.

    With fewer than ``HELD`` of them nothing is added.
    """
    found = sorted(found_spans(model, held), reverse=True)
    right, least = 0, 2.0
    for n, (p, hit) in enumerate(found, 1):
        right += hit
        if n >= HELD and right >= PRECISION * n:
            least = p
    return replace(model, least=least)


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[Span]]]:
    """At most ``sample`` stretches with the spans of the base rules, the smallest by hash; stretches without spans too."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for low, high in stretches(text):
                for a in range(low, high, 8 * WINDOW):  # long ones in pieces
                    b = min(a + 8 * WINDOW, high)
                    if any(s < a < e or s < b < e for _, s, e in spans):
                        continue  # a span through a cut would be labelled wrongly
                    inside = [f"{k}:{s - a}:{e - a}" for k, s, e in spans if a <= s and e <= b]
                    rows.append((text[a:b], ",".join(inside)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["part", "spans"])

    found = map_batches(id_text(docs).select("text").filter(F.col("text").rlike("(?i)" + TRIGGER.pattern)), work, "part string, spans string")
    rows = found.distinct().orderBy(F.xxhash64("part"), "part", "spans").limit(sample).collect()
    return [(r["part"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]) for r in rows]


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = 6) -> Tagger:
    """A tagger fitted on a bounded sample of stretches of ``docs``, labelled by the base rules and by alteration.

    One stretch in five is held out and sets the threshold from which on spans are added.
    """
    labelled = labelled_sample(docs, sample)
    held = labelled[::5]
    model = fit(taught([x for k, x in enumerate(labelled) if k % 5]), epochs)
    return with_threshold(model, taught(held, 6))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Tagger) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are those of the base rules; ``spans`` holds these and what the
    network adds, as kind:start:end in code points, end exclusive.  Null counts as empty;
    a text without a trigger has no spans.  Repeated rows give repeated rows, a null
    id stays null, an empty table gives no rows, other columns are not read.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = find_spans(model, batch.column("text").to_pylist())
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
            pa.array([joined(every) for _, every in found], pa.string()), pa.array([len(every) - len(base) for base, every in found], pa.int64()),
        ], names)

    kinds = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string, n_added long"])
    return map_batches(id_text(docs), work, kinds)


def redacted_text(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of the first, in brackets."""
    out, at, until = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= until:
            out.append(text[at:a] + f"[{kind.upper()}]")
        until = max(until, b)
        at = until
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Tagger) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; null stays null, all columns stay."""
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(at).to_pylist()
        made = [t if t is None else redacted_text(t, spans) for t, (_, spans) in zip(texts, find_spans(model, [t or "" for t in texts]))]
        yield batch.set_column(at, "text", pa.array(made, pa.string()))

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return map_batches(rows, work, rows.schema)


@query("op2_pii")
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return scan(docs, train(docs))
