"""Secret scans: base patterns, and a character convolutional network for what they miss.

Every run of ``CANDIDATE`` characters or more that keys and tokens are made of, with a
letter or a digit in it, is a candidate where it lies outside the base findings.  A small
network in numpy reads it with its surrounding context, a long one through overlapping
windows, of which the highest score counts.  It is trained on the driver, always in the
same way, on labelled findings: ones generated by rule, and those of a bounded sample of
documents, labelled by the base patterns.  Scores are calibrated on findings held out from
training, and the threshold is the highest that keeps the wanted recall on them.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.columns import packed, unpacked

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Least characters of a candidate.
CANDIDATE = 12
_TOKEN = re.compile(f"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}")
_ALNUM = re.compile("[A-Za-z0-9]")

LEFT, INSIDE, RIGHT = 24, 48, 8
#: Characters from one window over a long candidate to the next.
STEP = 24
#: Windows that a task scores at a time, and those of one harmless finding in training.
RUN, HARMLESS_WINDOWS = 4096, 4
#: Findings of a document, and characters of one, that training may use.
DOCUMENT_FINDINGS, TRAINING_LENGTH = 20, 2048
WIDTH, FILTERS, DEPTH = 5, 24, 8
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n"
_CODES = np.full(128, len(_SYMBOLS) + 1, np.int64)
_CODES[[ord(c) for c in _SYMBOLS]] = np.arange(1, len(_SYMBOLS) + 1)
N_CODES = len(_SYMBOLS) + 2


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Findings of the base patterns as (start, kind, end), in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What the network has to judge: runs outside the findings, ``taken`` in order of start."""
    closed: list[list[int]] = []
    for s, _, e in taken:
        if closed and s <= closed[-1][1]:
            closed[-1][1] = max(closed[-1][1], e)
        else:
            closed.append([s, e])
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while at < len(closed) and closed[at][0] < end:
            out.append((start, closed[at][0]))
            start = max(start, closed[at][1])
            if closed[at][1] > end:
                break  # it goes on into the next run
            at += 1
        out.append((start, end))
    return [(s, e) for s, e in out if e - s >= CANDIDATE and _ALNUM.search(text, s, e)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate's first characters between its left and right context."""
    out = np.zeros(LEFT + INSIDE + RIGHT, np.int64)
    for part, at in ((text[max(0, start - LEFT) : start], max(0, LEFT - start)), (text[start : min(end, start + INSIDE)], LEFT), (text[end : end + RIGHT], LEFT + INSIDE)):
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[at : at + len(points)] = np.where(points < 128, _CODES[np.minimum(points, 127)], N_CODES - 1)
    return out


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """The window of a candidate, and those over all its characters if it is longer."""
    yield window(text, start, end)
    if end - start > INSIDE:
        for at in (*range(start + STEP, end - INSIDE, STEP), end - INSIDE):
            yield window(text, at, at + INSIDE)


@dataclass
class CharCnn:
    """Embedding, one convolution, ReLU, maximum over places, one linear unit."""

    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int) -> CharCnn:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (N_CODES, DEPTH)), rng.normal(0, 0.15, (WIDTH * DEPTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), np.zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.kernel, self.bias, self.out, self.shift]

    def forward(self, codes: np.ndarray) -> tuple:
        vectors = self.embedding[codes]
        spans = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH, axis=1).transpose(0, 1, 3, 2)
        spans = spans.reshape(len(codes), -1, WIDTH * DEPTH)
        maps = spans @ self.kernel + self.bias
        best = maps.argmax(axis=1)
        peaks = np.maximum(np.take_along_axis(maps, best[:, None, :], axis=1)[:, 0], 0)
        return spans, best, peaks, peaks @ self.out + self.shift[0]

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        spans, best, peaks, logits = self.forward(codes)
        error = (1 / (1 + np.exp(-logits)) - labels) / len(labels)
        slope = error[:, None] * self.out * (peaks > 0)
        rows = np.arange(len(codes))[:, None]
        picked = spans[rows, best]
        places = best[:, :, None] + np.arange(WIDTH)
        back = (slope[:, :, None] * self.kernel.T).reshape(*slope.shape, WIDTH, DEPTH)
        embedding = np.zeros_like(self.embedding)
        np.add.at(embedding, codes[rows[:, :, None], places], back)
        return [embedding, np.einsum("nf,nfk->kf", slope, picked), slope.sum(axis=0), peaks.T @ error, error.sum(keepdims=True)]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 256])[3] for i in range(0, len(codes), 256)])

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logits + self.offset)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probability of a secret for each window."""
        return self.calibrated(self.logits(codes))


def generated_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label): secrets of common forms and harmless look-alikes."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = letters + letters.upper() + digits

    def some(of: str, k: int) -> str:
        return "".join(rng.choice(of) for _ in range(k))

    def word(a: int = 2, b: int = 9) -> str:
        return some(letters, rng.randint(a, b))

    secrets = [
        lambda: some(mixed, rng.randint(20, 44)),
        lambda: base64.b64encode(rng.randbytes(rng.randint(15, 33))).decode(),
        lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "key-"]) + some(mixed, rng.randint(20, 36)),
        lambda: some("0123456789abcdef", rng.choice([16, 18, 20, 22])),
        lambda: some("0123456789ABCDEF", rng.choice([20, 32, 40])),
        lambda: some(letters.upper() + digits, rng.randint(20, 30)),
        lambda: some(mixed, rng.randint(12, 19)),
        lambda: some(letters + letters.upper(), rng.randint(20, 40)),
    ]
    harmless = [
        lambda: f"{word(5, 12)}-{word(4, 9)}-{rng.randint(1, 2030)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: f"{word(4, 9)}/{word(4, 9)}/{word(3, 8)}{rng.randint(0, 99)}",
        lambda: f"{word(6, 14)}_{word(6, 12)}_{rng.randint(0, 999)}",
        lambda: f"{word(9, 18)}{rng.randint(0, 99)}{word(6, 9)}",
        lambda: f"{word(3, 6).title()}{word(3, 6).title()}{word(5, 9).title()}{rng.randint(1, 9)}",
        lambda: word(12, 22),
        lambda: word(12, 18).title(),
        lambda: word(12, 18).upper(),
        lambda: "-".join(word(3, 8) for _ in range(rng.randint(3, 5))),
        lambda: some(digits, rng.randint(12, 20)),
        lambda: f"{'=' * rng.randint(8, 20)}{rng.randint(1, 9)}a{'=' * rng.randint(8, 20)}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        token = rng.choice(secrets if label else harmless)()
        left = " ".join(word() for _ in range(4)) + rng.choice([" ", " ", " key: ", "=", ' "', ":"])
        right = rng.choice([" ", ". ", '" ', ", ", "\n"]) + word()
        if candidates(token, []) == [(0, len(token))]:
            out.append((left + token + right, len(left), len(left) + len(token), label))
    return out


def findings_of(text: str, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings of a document: base findings as secrets, other long words as not.

    Of each label ``DOCUMENT_FINDINGS`` at most are drawn, each cut at ``TRAINING_LENGTH``.
    """
    taken = base_spans(text)
    drawn = random.Random(f"{seed}:{len(text)}")
    spans = [(s, e, 1) for s, _, e in drawn.sample(taken, min(DOCUMENT_FINDINGS, len(taken)))]
    free = candidates(text, taken)
    spans += [(s, e, 0) for s, e in drawn.sample(free, min(DOCUMENT_FINDINGS, len(free)))]
    out = []
    for s, e, label in spans:
        n = min(e - s, TRAINING_LENGTH)
        out.append((text[max(0, s - LEFT) : s + n + RIGHT], min(s, LEFT), min(s, LEFT) + n, label))
    return out


def train(findings: list[tuple[str, int, int, int]], *, recall: float = 0.95, epochs: int = 12, seed: int = 3) -> CharCnn:
    """The network fitted to three quarters of the findings and calibrated on the others.

    ``threshold`` is the highest calibrated probability that still finds ``recall`` of the
    held-out secrets.  Of a long harmless finding some of its windows are learned.
    """
    order = np.random.default_rng(seed).permutation(len(findings))
    shuffled = [findings[i] for i in order]
    fitted, held = shuffled[: 3 * len(order) // 4], shuffled[3 * len(order) // 4 :]
    drawn = random.Random(seed)
    learned = []
    for x, s, e, y in fitted:
        own = list(windows(x, s, e))
        some = own[:1] if y else own if len(own) <= HARMLESS_WINDOWS else drawn.sample(own, HARMLESS_WINDOWS)
        learned += [(w, y) for w in some]
    codes = np.stack([w for w, _ in learned])
    labels = np.array([y for _, y in learned], float)
    cut = len(labels)
    net = CharCnn.fresh(seed)
    first, second = [[np.zeros_like(w) for w in net.weights()] for _ in range(2)]
    step, rng = 0, np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(cut), max(1, cut // 64)):
            step += 1
            for w, g, m, v in zip(net.weights(), net.gradients(codes[at], labels[at]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits = np.array([net.logits(np.stack(list(windows(x, s, e)))).max() for x, s, e, _ in held])
    truth = np.array([y for *_, y in held], float)
    for _ in range(500):  # Platt's scaling by gradient descent
        error = 1 / (1 + np.exp(-(net.slope * logits + net.offset))) - truth
        net.slope -= 0.05 * float((error * logits).mean())
        net.offset -= 0.05 * float(error.mean())
    secret = np.sort(net.calibrated(logits)[truth == 1])
    net.threshold = float(secret[int((1 - recall) * len(secret))])
    return net


def trained_network(docs: DataFrame, key: str, text: str, sample: int, generated: int) -> CharCnn:
    """The network for a corpus: fitted to findings of the ``sample`` distinct rows of least hash.

    Rows alike in key and text count as one, so a row that stands often is drawn once.  The
    driver gets ``2 * DOCUMENT_FINDINGS * sample`` findings at most.
    """
    marked = docs.select(F.xxhash64(key, text).alias("mark"), F.col(text).alias("text"))
    least = marked.select("mark").distinct().orderBy("mark").limit(sample)
    drawn = marked.join(F.broadcast(least), "mark").dropDuplicates(["mark"])

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [x for text in batch["text"] if text for x in findings_of(text, seed=2)]
            yield pd.DataFrame(rows, columns=["text", "start", "end", "label"])

    found = drawn.mapInPandas(labelled, "text string, start int, end int, label int").collect()
    return train(generated_findings(generated, seed=1) + sorted(tuple(r) for r in found))


def joined(spans: list[tuple[int, str, int]]) -> str:
    """``kind:start:end`` by start, then kind, with commas."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def scan_secrets(docs: DataFrame, network: CharCnn, *, text: str = "text") -> DataFrame:
    """Every row with ``findings``: kind, start, end (code points, end exclusive) and score.

    Base findings come first in a row and have score 1; those of kind ``model`` are the
    candidates with a window that scores the network's threshold or more.  A null or empty text has no
    findings.  Repeated rows have the same.  An empty table gives an empty table.  An
    input column ``findings`` is replaced.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def scanned(texts: pd.Series) -> pd.Series:
        out, pending, held = [], [], []

        def flush() -> None:
            scores = shared.value.probability(np.stack(held)) if held else ()
            for at, score in zip(pending, scores, strict=True):
                best[at] = max(best.get(at, 0.0), float(score))
            pending.clear()
            held.clear()

        best: dict[tuple[int, int, int], float] = {}
        for i, x in enumerate(texts):
            x = x or ""
            base = base_spans(x)
            out.append([{"kind": k, "start": s, "end": e, "score": 1.0} for s, k, e in base])
            for s, e in candidates(x, base):
                for w in windows(x, s, e):
                    pending.append((i, s, e))
                    held.append(w)
                    if len(held) >= RUN:
                        flush()
        flush()
        for (i, s, e), score in best.items():
            if score >= shared.value.threshold:
                out[i].append({"kind": "model", "start": s, "end": e, "score": score})
        return pd.Series(out)

    rows = docs.select(packed(docs).alias("_row")).withColumn("_findings", scanned(F.col("_row")[text]))
    return unpacked(rows, "_row", names, findings=F.col("_findings"))


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Base findings and added ones of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs.select("doc_id", "text"), trained_network(docs, "doc_id", "text", 2000, 6000))

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digest(findings: pd.Series) -> pd.DataFrame:
        rows = []
        for own in findings:
            spans = [(x["start"], x["kind"], x["end"]) for x in own]
            base = [x for x in spans if x[1] != "model"]
            counts = [sum(k == kind for _, k, _ in base) for kind in KINDS[:3]]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.select("doc_id", digest("findings").alias("d")).select("doc_id", "d.*")
