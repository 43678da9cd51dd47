"""Personal data: exact patterns beside a character-level bidirectional LSTM with CRF transitions.

The network is written and trained in numpy. It reads windows of `WIDTH` characters that overlap
by half, taken around every digit, at-sign or spelled at-sign ('(at)', '[at]'): every kind of personal data named here
holds one of these in any spelling that `_plausible` takes, so all windows that count are read, whatever the text's length. Each window is decoded by
Viterbi; for a character that two windows cover, the tag of the one in which it lies further from
the edge counts. Spans are then read off the whole text's tags. A span of the network is added
if it overlaps no exact span and holds what its kind needs (`_plausible`).

Labelled spans: at most `FIT_WINDOWS` windows with exact spans from the documents (those of least
hash), and windows made from a fixed seed that hold personal data in more spellings than the patterns know, and look-alikes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
WIDTH, FIT_WINDOWS, MADE, SPELLED, EPOCHS = 64, 600, 900, 600, 10
HIDDEN, EMBED, SYMBOLS = 20, 12, 100
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match of these can only begin where a run of digits begins
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def exact(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end), by start, then kind; leftmost and not overlapping within a kind."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            last = m.end()
        else:
            last = max(last, a)
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _plausible(kind: str, s: str) -> bool:
    n = len(_digits(s))
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?(@|\(at\)|\[at\]) ?[^\s@]+([.]| ?(\(dot\)|\[dot\]) ?)[A-Za-z]{2,}", s))
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= n <= 19 and _luhn(_digits(s)) and not re.search(r"[A-Za-z]", s)
    return bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|\(?00[0-9 ().-]{8,}[0-9]", s)) and 10 <= n <= 15


def symbols(text: str):
    """Code points as numbers below SYMBOLS: printable ASCII, then space-like, letters beyond ASCII, others."""
    import numpy as np

    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((cp >= 32) & (cp < 127), cp - 32, np.where(cp < 32, 95, np.where(cp < 0x250, 96, 97)))


def spans_to_tags(n: int, spans) -> list[int]:
    tags = [0] * n
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        if not any(tags[a:b]):
            tags[a:b] = [k] + [k + 1] * (b - a - 1)
    return tags


def made_windows(n: int = MADE, seed: int = 11, kinds: tuple[str, ...] = (*KINDS, "", "")):
    """Labelled windows from a fixed seed: (symbols, tags) of WIDTH each; the empty kind is a look-alike."""
    import random

    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwxyzéü") for _ in range(r.randint(1, 9)))

    def card():
        d = digits(15)
        d += next(c for c in "0123456789" if _luhn(d + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def one():
        kind = r.choice(kinds)
        if kind == "email":
            at, dot = r.choice([("@", "."), ("@", "."), (" (at) ", "."), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
            name = lambda: word().encode("ascii", "ignore").decode() or "x"
            if r.random() < 0.5:  # no digit anywhere
                return kind, f"{name()}{r.choice(['.', '_', ''])}{name()}{at}{r.choice(['mail.', 'post.', ''])}{r.choice(['example', name()])}{dot}{r.choice(['com', 'org', 'net'])}"
            return kind, f"{name()}{r.choice(['.', '_', ''])}{digits(2)}{at}{r.choice(['mail', 'post'])}{digits(1)}.example{dot}{r.choice(['com', 'org', 'net'])}"
        if kind == "ip":
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, card()
        if kind == "phone":
            return kind, r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randint(30, 49)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
        return kind, r.choice([digits(r.randint(1, 8)), "".join(r.choice("0123456789abcdef") for _ in range(32)), f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(2)}", "@" + word(), f"{word()} {r.choice(['(at)', '[at]'])} {word()}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}"])

    out = []
    for _ in range(n):
        kind, s = one()
        before = " ".join(word() for _ in range(6))[: r.randint(0, WIDTH - len(s) if len(s) < WIDTH else 0)] + r.choice([" ", " ", "\n", ". "])
        text = (before + s + r.choice([" ", ". ", "### ", "\n"]) + " ".join(word() for _ in range(14)))[:WIDTH].ljust(WIDTH)
        a = len(before)
        spans = [(kind, a, a + len(s))] if kind and a + len(s) <= WIDTH else []
        if kind and not spans:
            continue
        out.append((symbols(text).tolist(), spans_to_tags(WIDTH, spans)))
    return out


class Tagger:
    """Embedding, one LSTM in each direction, linear emissions, CRF transitions."""

    def __init__(self, seed: int = 5):
        import numpy as np

        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {"E": r.normal(0, 0.3, (SYMBOLS, e)), "O": r.normal(0, 0.2, (2 * h, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"X{d}": r.normal(0, 0.25, (e, 4 * h)), f"H{d}": r.normal(0, 0.2, (h, 4 * h)), f"B{d}": np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h)))}

    def _lstm(self, x, d):
        """States for each place of x (batch, width, embed) in direction d, and what the way back needs."""
        import numpy as np

        p, h = self.p, HIDDEN
        n, w, _ = x.shape
        state, cell = np.zeros((n, h)), np.zeros((n, h))
        out, kept = np.empty((n, w, h)), [None] * w
        xs = x @ p[f"X{d}"] + p[f"B{d}"]
        for t in range(w) if d == "f" else range(w - 1, -1, -1):
            z = xs[:, t] + state @ p[f"H{d}"]
            g = np.empty_like(z)
            g[:, : 3 * h] = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))  # input, forget, output
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            old, before = cell, state
            cell = g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]
            th = np.tanh(cell)
            state = g[:, 2 * h : 3 * h] * th
            out[:, t] = state
            kept[t] = (g, old, before, th)
        return out, kept

    def emissions(self, ids):
        import numpy as np

        x = self.p["E"][ids]
        f, kf = self._lstm(x, "f")
        b, kb = self._lstm(x, "b")
        y = np.concatenate((f, b), 2)
        return y @ self.p["O"] + self.p["c"], (x, y, kf, kb)

    def decode(self, ids):
        """Viterbi: the best tags (batch, width)."""
        import numpy as np

        e, _ = self.emissions(ids)
        n, w, _ = e.shape
        best, back = e[:, 0] + self.p["s"], np.empty((n, w, TAGS), np.int8)
        for t in range(1, w):
            s = best[:, :, None] + self.p["T"]
            back[:, t] = s.argmax(1)
            best = s.max(1) + e[:, t]
        tags = np.empty((n, w), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(w - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def step(self, ids, gold):
        """Gradient of the mean negative log-likelihood, by forward-backward over the CRF and through both LSTMs."""
        import numpy as np

        p, h = self.p, HIDDEN
        e, (x, y, kf, kb) = self.emissions(ids)
        n, w, k = e.shape
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty((n, w, k)), np.zeros((n, w, k))
        alpha[:, 0] = e[:, 0] + p["s"]
        for t in range(1, w):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + p["T"], 1) + e[:, t]
        for t in range(w - 2, -1, -1):
            beta[:, t] = lse(p["T"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        g = {"s": de[:, 0].sum(0), "T": np.zeros((k, k))}
        for t in range(1, w):
            g["T"] += np.exp(alpha[:, t - 1][:, :, None] + p["T"] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(n)[:, None]
        de[rows, np.arange(w)[None], gold] -= 1
        np.subtract.at(g["s"], gold[:, 0], 1)
        np.subtract.at(g["T"], (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        g["O"], g["c"] = y.reshape(-1, 2 * h).T @ de.reshape(-1, k), de.sum((0, 1))
        dy, dx = de @ p["O"].T, np.zeros_like(x)
        for d, kept, part in (("f", kf, dy[:, :, :h]), ("b", kb, dy[:, :, h:])):
            dz_all = np.empty((n, w, 4 * h))
            dstate, dcell, dh = np.zeros((n, h)), np.zeros((n, h)), np.zeros_like(p[f"H{d}"])
            for t in range(w - 1, -1, -1) if d == "f" else range(w):
                gates, old, before, th = kept[t]
                i, f, o, u = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h : 3 * h], gates[:, 3 * h :]
                ds = part[:, t] + dstate
                dc = dcell + ds * o * (1 - th * th)
                dz = np.concatenate((dc * u * i * (1 - i), dc * old * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - u * u)), 1)
                dcell, dstate = dc * f, dz @ p[f"H{d}"].T
                dh += before.T @ dz
                dz_all[:, t] = dz
            g[f"H{d}"], g[f"B{d}"] = dh, dz_all.sum((0, 1))
            g[f"X{d}"] = x.reshape(-1, EMBED).T @ dz_all.reshape(-1, 4 * h)
            dx += dz_all @ p[f"X{d}"].T
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], ids.ravel(), dx.reshape(-1, EMBED))
        return {a: b / n for a, b in g.items()}

    def fit(self, windows, epochs: int = 7, batch: int = 32, seed: int = 3):
        import numpy as np

        ids, tags = np.array([a for a, _ in windows], np.int64), np.array([b for _, b in windows], np.int64)
        r = np.random.default_rng(seed)
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(ids))
            for a in range(0, len(ids), batch):
                t += 1
                for k, g in self.step(ids[order[a : a + batch]], tags[order[a : a + batch]]).items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def windows_of(n: int, anchors) -> list[int]:
    """Starts of the windows of a text of n characters that hold an anchor; all texts are padded to a window at least."""
    half = WIDTH // 2
    starts = set()
    for a in anchors:
        k = a // half
        starts.update(x * half for x in (k - 1, k) if x >= 0)
    return sorted(starts)


def tag(texts: list[str], tagger: Tagger, block: int = 512) -> list[list[tuple[str, int, int]]]:
    """The network's spans in each text."""
    import numpy as np

    ids, jobs = [symbols(t) for t in texts], []
    for i, s in enumerate(ids):
        spelled = [m.start() for m in _SPELLED.finditer(texts[i])]
        anchors = np.concatenate((np.flatnonzero(((s >= 16) & (s <= 25)) | (s == 32)), np.array(spelled, np.int64)))  # digits and @
        jobs += [(i, a) for a in windows_of(len(s), np.unique(anchors // (WIDTH // 2)) * (WIDTH // 2))]
    tags = [np.zeros(len(s), np.int8) for s in ids]
    depth = [np.full(len(s), -1, np.int16) for s in ids]
    inner = np.minimum(np.arange(WIDTH), WIDTH - 1 - np.arange(WIDTH))
    for at in range(0, len(jobs), block):
        part = jobs[at : at + block]
        x = np.zeros((len(part), WIDTH), np.int64)
        for r, (i, a) in enumerate(part):
            s = ids[i][a : a + WIDTH]
            x[r, : len(s)] = s
        for (i, a), row in zip(part, tagger.decode(x)):
            d = inner.copy()
            if a == 0:
                d[: WIDTH // 2] = WIDTH  # the text's own edge is none
            n = min(WIDTH, len(ids[i]) - a)
            better = d[:n] > depth[i][a : a + n]
            tags[i][a : a + n][better] = row[:n][better]
            depth[i][a : a + n][better] = d[:n][better]
    out = []
    for t in tags:
        spans, open_at, kind = [], None, -1
        for j in [*np.flatnonzero(t).tolist(), None]:
            k = -1 if j is None else (int(t[j]) - 1) // 2
            if open_at is not None and (j is None or j != last + 1 or k != kind or t[j] % 2 == 1):
                spans.append((KINDS[kind], open_at, last + 1))
                open_at = None
            if j is not None:
                if open_at is None:
                    open_at, kind = j, k
                last = j
        out.append(spans)
    return out


def labelled_windows(docs: DataFrame, limit: int = FIT_WINDOWS) -> list[tuple]:
    """Windows around exact spans, the `limit` of least hash among all documents."""
    common.tune(docs.sparkSession)

    def run(batches):
        import zlib

        import pyarrow as pa

        for _, texts in common.slices(batches):
            got: dict[str, str] = {}
            for t in texts:
                if not t or not _ANCHOR.search(t):
                    continue
                s = t.decode("utf-8", "replace")
                spans = exact(s)
                for j, (_, a, _) in enumerate(spans):
                    start = max(0, a - zlib.crc32(f"{j}:{a}".encode()) % (WIDTH // 2))
                    inside = [x for x in spans if start <= x[1] and x[2] <= start + WIDTH]
                    if not any(x[1] < start + WIDTH and x[2] > start and x not in inside for x in spans):
                        got[s[start : start + WIDTH]] = ",".join(f"{k}:{b - start}:{e - start}" for k, b, e in inside)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.string())], ["window", "spans"])

    found = docs.select("text").mapInArrow(run, "window string, spans string")
    rows = found.groupBy("window").agg(F.min("spans").alias("spans")).orderBy(F.xxhash64("window"), "window").limit(limit).collect()
    out = []
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        out.append((symbols(r["window"].ljust(WIDTH)).tolist(), spans_to_tags(WIDTH, spans)))
    return out


_ANCHOR = re.compile(rb"[0-9@]|\(at\)|\[at\]")
_SPELLED = re.compile(r"\(at\)|\[at\]")


def fitted(windows: list[tuple]) -> Tagger:
    """Trained on `windows`, the made ones, and more of the kinds that are spelled in many ways."""
    return Tagger().fit([*windows, *made_windows(), *made_windows(SPELLED, 12, ("email", "phone"))], EPOCHS)


def train(docs: DataFrame) -> Tagger:
    return fitted(labelled_windows(docs))


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and added (spans of the network alone).

    The counts and the digest are those of the exact spans. Null and empty texts have none.
    Repeated rows stay. Offsets are code points. Extra columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    sent = spark.sparkContext.broadcast(tagger)

    def run(batches):
        import hashlib
        import os

        import pyarrow as pa

        os.environ.setdefault("OMP_NUM_THREADS", "1")
        show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for cols, texts in common.slices(batches):
            base: list[list] = [[] for _ in texts]
            more: list[list] = [[] for _ in texts]
            some = [i for i, t in enumerate(texts) if t and _ANCHOR.search(t)]
            strings = [texts[i].decode("utf-8", "replace") for i in some]
            for i, s, guessed in zip(some, strings, tag(strings, sent.value)):
                base[i] = exact(s)
                more[i] = [g for g in guessed if _plausible(g[0], s[g[1] : g[2]]) and not any(g[1] < b[2] and b[1] < g[2] for b in base[i])]
            counts = [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in KINDS]
            every = [sorted({*b, *m}, key=lambda s: (s[1], KINDS.index(s[0]))) for b, m in zip(base, more)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["doc_id"], pa.int64()), *counts, pa.array([hashlib.sha256(show(b).encode()).hexdigest() for b in base]), pa.array([show(e) for e in every]), pa.array([show(m) for m in more])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added string")
